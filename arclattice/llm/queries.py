"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from .fingerprints import op3_fingerprints
from .harmonic import op13_harmonic
from .lexical import OP11_SQL, op11_lexical
from .mixing import OP5_SQL, op5_mixing
from .neardup import op9_minhash
from .negatives import op12_negatives
from .packing import op6_packing
from .quality import op10_quality
from .sharding import op1_sharding
from .toxicity import op2_toxicity
from .urlfilter import op8_urls
from .vectors import op4_vectors
from .warc import op7_warc


def queries() -> dict[str, Callable]:
    return {
        "op1_sharding": op1_sharding,
        "op2_toxicity": op2_toxicity,
        "op3_fingerprints": op3_fingerprints,
        "op4_vectors": op4_vectors,
        "op5_mixing": op5_mixing,
        "op6_packing": op6_packing,
        "op7_warc": op7_warc,
        "op8_urls": op8_urls,
        "op9_minhash": op9_minhash,
        "op10_quality": op10_quality,
        "op11_lexical": op11_lexical,
        "op12_negatives": op12_negatives,
        "op13_harmonic": op13_harmonic,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_mixing": OP5_SQL,
        "op11_lexical": OP11_SQL,
    }
