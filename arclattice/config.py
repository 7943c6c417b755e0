"""Fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

#: (outer range in m, cell size in m) of the resolution tiers; the last has no outer range in effect.
TIERS = ((10.0, 0.05), (30.0, 0.15), (100.0, 0.50))
LEAST_RANGE = 0.5
OVERHANG_GAP = 0.4
ROOF, BRIDGE_ROOF = 2.5, 4.0
CELL_BYTES = 40
DT = 0.1

#: Raw class ids of the label files and the four classes they become; others are unknown, -1.
RAW_TO_CLASS = {
    0: -1, 1: -1, 10: 3, 11: 3, 13: 3, 15: 3, 16: 3, 18: 3, 20: 3, 30: 3, 31: 3, 32: 3, 40: 0, 44: 0, 48: 1, 49: 0, 50: 2, 51: 2,
    52: 2, 60: 0, 70: 1, 71: 2, 72: 1, 80: 2, 81: 2, 99: 1, 252: 3, 253: 3, 254: 3, 255: 3, 256: 3, 257: 3, 258: 3, 259: 3,
}


@dataclass(frozen=True)
class Fovea:
    base_radius: float = 10.0
    max_stretch: float = 2.5
    reference_speed: float = 20.0
    shear: float = 1.0
    drawn_shear: float = 0.6
    enabled: bool = True
    collision_only: bool = True
    moving_speed: float = 0.8
    lead_time: float = 1.0
    buffer: float = 4.0
    boost: float = 1.3
    farthest_threat: float = 35.0
    corridor: float = 3.2


@dataclass(frozen=True)
class Tracking:
    dt: float = DT
    coast: int = 5
    farthest: float = 5.0
    gate_confirmed: float = 13.82
    gate_tentative: float = 9.21
    hits_to_confirm: int = 3
    measurement_noise: float = 0.1
    position_noise: float = 0.05
    velocity_noise: float = 0.5
    first_position: float = 0.1
    first_velocity: float = 100.0


@dataclass(frozen=True)
class Hysteresis:
    radius_margin: float = 0.5
    sector: float = 0.02
    least_points: int = 3
    degraded_after: int = 3
    clip_margin: float = 0.1
    clip_after: int = 2


@dataclass(frozen=True)
class Segmentation:
    road_half_width: float = 4.2
    sectors: int = 24
    bin_size: float = 2.5
    bins: int = 41
    least_in_bin: int = 4
    slope: float = 0.32
    percentile: float = 0.10
    plane_percentile: float = 0.35
    hypotheses: int = 50
    inlier: float = 0.15
    upright: float = 0.80


FOVEA, TRACKING, HYSTERESIS, SEGMENTATION = Fovea(), Tracking(), Hysteresis(), Segmentation()


#: Names of settings files, by the section they stand in, and the settings they are.
NAMES = {
    "foveation": ("fovea", {
        "base_fine_radius_m": "base_radius", "max_stretch": "max_stretch", "stretch_speed_ref_mps": "reference_speed", "shear_strength": "drawn_shear", "motion_foveation_enabled": "enabled",
        "collision_focus_only": "collision_only", "motion_speed_threshold_mps": "moving_speed", "motion_lead_time_s": "lead_time", "motion_buffer_m": "buffer", "motion_acuity_boost": "boost",
        "max_threat_distance_m": "farthest_threat", "corridor_half_width_m": "corridor",
    }),
    "grid": ("hysteresis", {"hysteresis_margin_m": "radius_margin", "min_points_per_ring_sector": "least_points", "min_points_per_sector": "least_points", "degradation_history_len": "degraded_after"}),
}


def load(path: str) -> dict:
    """Settings by section (fovea, tracking, hysteresis, segmentation), tiers and class_map of a YAML file on the driver.

    A file may name them as the dataclasses do, or by NAMES; tiers stand as resolution_tiers and classes as class_map (or a name
    that ends in _to_4class), at the top or below grid and perception. What the file lacks, or holds in another type, keeps its default; so does all
    of it where there is no such file, or none that can be read.
    """
    out = {"fovea": FOVEA, "tracking": TRACKING, "hysteresis": HYSTERESIS, "segmentation": SEGMENTATION, "tiers": TIERS, "class_map": RAW_TO_CLASS}
    try:
        import yaml
    except ImportError:
        return out
    try:
        with open(path, encoding="utf-8") as f:
            found = yaml.safe_load(f)
    except (OSError, ValueError, yaml.YAMLError):
        found = None
    if not isinstance(found, dict):
        return out
    for section, (name, names) in NAMES.items():
        given = found.get(section)
        out[name] = changed(out[name], {names[k]: v for k, v in given.items() if k in names} if isinstance(given, dict) else {})
    for name in ("fovea", "tracking", "hysteresis", "segmentation"):
        out[name] = changed(out[name], found.get(name))
    for place in (found, found.get("grid"), found.get("perception")):
        if isinstance(place, dict):
            out["tiers"] = tiers_of(place.get("resolution_tiers")) or out["tiers"]
            named = [v for k, v in place.items() if isinstance(k, str) and (k == "class_map" or k.endswith("_to_4class"))]
            out["class_map"] = next(filter(None, map(classes_of, named)), out["class_map"])
    return out


def changed(value, given):
    """A dataclass with the given fields that have its types."""
    changes = {}
    for f in fields(value):
        old, new = getattr(value, f.name), given.get(f.name) if isinstance(given, dict) else None
        if isinstance(new, bool) == isinstance(old, bool) and isinstance(new, (int, float)):
            changes[f.name] = type(old)(new)
    return replace(value, **changes)


def tiers_of(given) -> tuple[tuple[float, float], ...] | None:
    """Pairs of an outer range and a cell size, both ascending, or none."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and x > 0
    if not isinstance(given, list) or not given or not all(isinstance(t, list) and len(t) == 2 and all(map(number, t)) for t in given):
        return None
    tiers = tuple((float(r), float(s)) for r, s in given)
    return tiers if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(tiers[:-1], tiers[1:], strict=True)) else None


def classes_of(given) -> dict[int, int] | None:
    if not isinstance(given, dict) or not given:
        return None
    try:
        return {int(k): int(v) for k, v in given.items()}
    except (TypeError, ValueError):
        return None
