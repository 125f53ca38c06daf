"""The pipeline's stages on the smallest tables: each one's decisions, checked plainly."""

import os
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def outputs(spark):
    from tabulon.llm.common import written

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(written(stage(spark, out[-1], DATA), name))
    return out


def test_columns(outputs):
    for df in outputs[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_good_documents(spark):
    data = DATA.replace("0.001", "0.01")  # the smallest tables have too few labels to learn from
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {r["doc_id"] for r in pipeline.keep_quality(spark, docs, data).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert np.mean([(i in kept) == (q == 1) for i, q in labels.items()]) > 0.97
    assert np.mean([i in kept for i, q in labels.items() if q == 1]) > 0.98


def test_one_of_each_group_of_copies_stays(outputs):
    before, after = outputs[1].collect(), outputs[2].collect()
    first = {}
    for r in sorted(before, key=lambda r: r["doc_id"]):
        first.setdefault(r["text"], r["doc_id"])
    kept = {r["doc_id"] for r in after}
    assert kept <= set(first.values()) and len(kept) > 0.9 * len(first)
    whole = {r["doc_id"]: r for r in before}
    assert all(whole[r["doc_id"]] == r for r in after)


def test_no_passage_stands_twice(outputs):
    before, after = outputs[2].collect(), outputs[3].collect()
    assert Counter(r["doc_id"] for r in before) == Counter(r["doc_id"] for r in after)
    texts = {r["doc_id"]: r["text"] for r in after}
    seen = set()
    for r in sorted(before, key=lambda r: r["doc_id"]):
        raw = r["text"].encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        if not gone.any():
            assert texts[r["doc_id"]] == r["text"]
        else:
            assert len(texts[r["doc_id"]].encode()) <= int((~gone).sum()) <= len(texts[r["doc_id"]].encode()) + 6 * int((np.diff(gone.astype(int)) != 0).sum())
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_mixture(outputs):
    before = {r["doc_id"]: r for r in outputs[3].collect()}
    after = Counter(r["doc_id"] for r in outputs[4].collect())
    assert max(after.values()) <= 3 and set(after) <= set(before)
    from tabulon.llm.mixing import default_weights, targets_of

    size, taken = Counter(), Counter()
    for i, r in before.items():
        n = len(r["text"].encode().split())
        size[r["source"]] += n
        taken[r["source"]] += n * after[i]
    target = targets_of(dict(size), default_weights(size))
    assert abs(sum(taken.values()) / sum(size.values()) - 1) < 0.02
    assert all(abs(taken[s] - target[s]) <= max(0.1 * target[s], 60) for s in size)


def test_everything_is_packed(outputs):
    pieces = outputs[5].collect()
    docs = outputs[4].count()
    assert sum(r["start"] == 0 for r in pieces) == docs
    assert sum(np.frombuffer(r["ids"], "<u4")[-1] == 0 and r["start"] + r["length"] == r["doc_tokens"] for r in pieces) == docs


def test_run_gives_the_last_stage(spark, outputs):
    assert pipeline.run(spark, DATA).count() == outputs[5].count()


@pytest.mark.parametrize("place", range(5))
@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_on_odd_rows(spark, place, rows):
    """Nulls, empty and long texts, repeated rows, null ids, extra columns with the operators' own names, and no rows."""
    import sys

    sys.path.insert(0, os.path.dirname(__file__))
    from test_operators import frame, texts

    some = texts() if rows == "odd" else []
    docs = frame(spark, [*some, *some[:1], *some[3:5], (None, "no id", "en", "a"), (None, None, None, None)] if some else [])
    out = pipeline.STAGES[place][1](spark, docs, DATA)
    if place < 4:
        assert out.columns == docs.columns
        assert all(r["score"] == "x" and r["copies"] == 9 and r["rid"] == "r" for r in out.collect())
    else:
        assert out.where("start = 0").count() == docs.count()
    if not some:
        assert out.count() == 0
