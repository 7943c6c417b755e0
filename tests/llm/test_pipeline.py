from __future__ import annotations

from collections import Counter

import brute
import pytest
from test_operators import DOCS, awkward, check_bins, plain_mix

import __spark_entry__ as entry
import corpus_pipeline
from arclattice.llm.common import Stage, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    stage, docs, out = Stage(spark), table(spark, SF, "documents"), {}
    out["documents"] = docs
    for name, step in corpus_pipeline.STAGES:
        docs = stage.put(step(spark, docs, SF), name)
        out[name] = docs
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_columns_and_filters(spark, stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name in names[:-1]:
        assert stages[name].columns == stages["documents"].columns
    docs, clean, good = (Counter(rows(stages[n])) for n in ("documents", "toxicity", "quality"))
    assert not clean - docs and not good - clean
    truth = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    lost = [truth[r[0]] for r in docs - clean if r[0] in truth]
    assert lost and sum(t.toxic == 1 for t in lost) >= 0.8 * len(lost)
    poor = [truth[r[0]] for r in clean - good if r[0] in truth]
    assert sum(t.quality == 0 for t in poor) >= 0.8 * len(poor)
    assert sum(good.values()) > 0.7 * sum(docs.values())


def test_one_of_each_group(stages):
    before = rows(stages["quality"])
    sets = {r[0]: brute.shingles(r[1]) for r in before}
    same = {}
    links = brute.jaccard_links({i: s for i, s in sets.items() if s}) | {(same.setdefault(s, i), i) for i, s in sorted(sets.items()) if s}
    comp = brute.components(sets, links)
    assert sorted(r[0] for r in rows(stages["near-dedup"])) == sorted({comp[i] for i in comp})


def test_mix_meets_targets(stages):
    before, after = rows(stages["near-dedup"]), rows(stages["mixing"])
    _, target = plain_mix(before)
    took = Counter()
    for r in after:
        took[r[3]] += len(brute.words(r[1]))
    assert took == {s: pytest.approx(t, abs=1) for s, t in target.items()}
    whole = {r[0]: r[1] for r in before}
    assert all(whole[r[0]].startswith(r[1]) for r in after)


def test_packing_takes_all(stages):
    out = stages["packing"].collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(r[0] for r in rows(stages["mixing"]))
    bins = check_bins(out)
    assert bins <= 1.05 * sum(r.length for r in out) / 1024 + 2


def test_run_and_registry(spark):
    assert entry.queries()["pipeline"](spark, SF).count() > 0
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in entry.queries() if q.startswith("op")}


@pytest.mark.parametrize("none", [False, True])
def test_awkward_rows_through_all_stages(spark, tmp_path, none):
    names = DOCS.replace("score double", "_score double").replace("key string", "_key string").replace("rank long", "__score long")
    docs = spark.createDataFrame([] if none else awkward(), names)
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(80)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stage, now = Stage(spark), table(spark, str(tmp_path), "documents")
    sizes = [now.count()]
    for name, step in corpus_pipeline.STAGES:
        before, now = now, stage.put(step(spark, now, str(tmp_path)), name)
        if name != "packing":
            assert now.columns == docs.columns
        if name in ("toxicity", "quality", "near-dedup"):
            assert not Counter(rows(now)) - Counter(rows(before))
        if name == "near-dedup":  # rows in no group stay
            alone = lambda df: Counter(r for r in rows(df) if r[0] is None or not brute.words(r[1]))
            assert alone(now) == alone(before) if before.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty() else True
        sizes.append(now.count())
    assert sizes == [0] * 6 if none else sizes[-1] >= 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sizes[-1]
