"""A quality classifier: naive Bayes features under a linear support vector machine."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_values, byte_batches, crc_fold, table, written
from .features import mixed, pairs_within, shape_hashes, word_hashes, word_spans

BITS = 18
#: Most labelled rows that the fit reads: those with the least hash of their id. Scores cover all rows.
SAMPLE_ROWS = 6000
#: Most bytes of the texts of a sample, so that what the driver holds is bounded however long texts are.
SAMPLE_BYTES = 64 << 20


def indicators(data: np.ndarray, bounds: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram indicators of the texts in ``data``: text numbers (ascending) and buckets, each pair once.

    N-grams are words, word pairs, word shapes and shape pairs, and a mark for a word that repeats
    the one before it.
    """
    start, end, text = word_spans(data, bounds)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = word_hashes(data, start, end, fold=False)
    shape = shape_hashes(data, start, end) + np.uint64(1)
    pair, pair_text = pairs_within(word, text)
    forms, forms_text = pairs_within(shape, text)
    again = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    echo_text = text[1:][again]
    echo = np.full(len(echo_text), mixed(np.array([7], np.uint64))[0])
    keys = np.concatenate([word, pair, shape, forms, echo])
    texts = np.concatenate([text, pair_text, text, forms_text, echo_text])
    packed = np.sort((texts.astype(np.uint64) << np.uint64(bits)) | (keys >> np.uint64(64 - bits)))
    packed = packed[np.r_[True, packed[1:] != packed[:-1]]]
    return (packed >> np.uint64(bits)).astype(np.int64), (packed & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass
class Model:
    """weight and square hold a bucket's weight times ratio, and its ratio squared; a, b map margins to scores."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    a: float
    b: float
    bits: int

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        text, bucket = indicators(data, bounds, self.bits)
        n = len(bounds) - 1
        norm = np.sqrt(np.bincount(text, self.square[bucket], n))
        margin = np.bincount(text, self.weight[bucket], n) / np.maximum(norm, 1e-9) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30)))


def log_ratios(rows: list[np.ndarray], label: np.ndarray, bits: int, smooth: float = 1.0) -> np.ndarray:
    """Log of the ratio of a bucket's smoothed shares in the two classes."""
    size = 1 << bits
    good, bad = np.full(size, smooth), np.full(size, smooth)
    for r, y in zip(rows, label):  # a row has a bucket once at most
        (good if y > 0 else bad)[r] += 1
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def dual_descent(rows: list[np.ndarray], ratio: np.ndarray, norm: np.ndarray, sign: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Linear hinge-loss machine by dual coordinate descent: one multiplier at a time, in random order.

    A row's vector is the ratios of its buckets over its norm, made when its turn comes, so the driver
    holds no more than the bucket lists. A constant feature of 1 is appended, so the diagonal is 2.
    """
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in random.permutation(len(rows)):
            at = rows[i]
            x = ratio[at] / norm[i]
            slope = sign[i] * (x @ w[at] + bias) - 1.0
            new = min(max(alpha[i] - slope / 2.0, 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[at] += step * x
                bias += step
                alpha[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w, bias


def logistic_line(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """a, b for which 1 / (1 + exp(-(a margin + b))) fits the labels (Newton steps)."""
    n1 = label.sum()
    goal = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (len(label) - n1 + 2))
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (goal - p) - 1e-3 * np.array([a, b]))
        a, b = a + step[0], b + step[1]
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[np.ndarray], label: np.ndarray, bits: int = BITS, cost: float = 1.0) -> Model:
    """A model from bucket lists and 0/1 labels; every fifth row only calibrates the scores."""
    size = 1 << bits
    if len(rows) == 0 or label.min() == label.max():  # nothing to tell apart: all get the share of label 1
        share = (label.sum() + 1) / (len(label) + 2)
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))), bits)
    held = np.arange(len(rows)) % 5 == 4
    for part in (~held, np.ones(len(rows), bool)):
        chosen = np.flatnonzero(part)
        own = [rows[i] for i in chosen]
        y = label[chosen]
        ratio = log_ratios(own, y, bits)
        square = ratio**2
        norm = np.array([max(np.sqrt(square[r].sum()), 1e-9) for r in own])
        share = np.where(y > 0, y.mean(), 1 - y.mean())
        w, bias = dual_descent(own, ratio, norm, np.where(y > 0, 1.0, -1.0), cost * 0.5 / np.maximum(share, 1e-9))
        if not part.all():
            margin = np.array([ratio[r] @ w[r] / max(np.sqrt(square[r].sum()), 1e-9) + bias for r in (rows[i] for i in np.flatnonzero(held))])
            a, b = logistic_line(margin, label[held]) if 0 < label[held].mean() < 1 else (1.0, 0.0)
    return Model((w * ratio).astype(np.float32), square.astype(np.float32), float(bias), a, b, bits)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, rows: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``rows`` (doc_id, _label, text, lang) of the labelled documents outside the held-out fold, by least hash of the id.

    Null labels say nothing. Where an id has several labels, the greatest counts; of several texts, that with
    the least hash. In the same order, a text that would bring the sample over ``most_bytes`` is left out.
    ``lang`` is null where the documents have none. The sample is a written table.
    """
    seen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max(label).alias("_label"))
    seen = seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.struct(F.xxhash64(text).alias("h"), text.alias("text"), lang.alias("lang")).alias("_own"))
    # the sample's bound is its size: at most `rows` ids
    picked = own.join(F.broadcast(seen), "doc_id").groupBy("doc_id").agg(F.max("_label").alias("_label"), F.min("_own").alias("_own"))
    picked = written(picked.select("doc_id", "_label", "_own.text", "_own.lang"), "sample")
    total, over = 0, []
    for r in picked.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect():
        if total + r["n"] > most_bytes:
            over.append(r["doc_id"])
        else:
            total += r["n"]
    return picked.where(~F.col("doc_id").isin(over)) if over else picked


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, fold: int = 0, sample_rows: int = SAMPLE_ROWS, bits: int = BITS) -> Model:
    sample = labelled_sample(docs, labels, label, crc_fold(F.col("doc_id"), folds) == fold, sample_rows)

    def run(batches):
        for batch in byte_batches(batches, 2 << 20):
            data, bounds = binary_values(batch.column(2))
            text, bucket = indicators(data, bounds, bits)
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "y", "rows"])

    got = sample.select(F.col("doc_id").cast("long"), F.col("_label").cast("int").alias("y"), F.col("text").cast("binary").alias("body")).mapInArrow(run, "doc_id long, y int, rows array<int>").toArrow()
    ids = got.column("doc_id").to_numpy()
    y = got.column("y").to_numpy()
    lists = got.column("rows").combine_chunks()
    # views of the 32-bit lists, not copies
    rows = [lists[i].values.to_numpy() for i in range(len(ids))]
    order = np.lexsort((ids, mixed(ids.astype(np.int64).view(np.uint64)))) if len(ids) else []
    return fit([rows[i] for i in order], np.array([int(y[i] > 0) for i in order], np.int64), bits)


def quality_score(model: Model, spark, text: Column) -> Column:
    """Score column of a text column: 0 to 1, higher where label 1 is likelier; null and empty texts have one too."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for part in byte_batches([pa.RecordBatch.from_arrays([column], names=["t"])], 2 << 20):
            out.append(shared.value.scores(*binary_values(part.column(0))))
        return pa.array(np.concatenate(out))

    return score(F.coalesce(text, F.lit("")).cast("binary"))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, fold: int = 0) -> DataFrame:
    """``docs`` (doc_id, text, any more columns) with held_out, score and predicted, one row per input row.

    Words and their shapes alone are judged; labels of the held-out fold are never read. An empty
    labels table gives every text the same score. Columns with these names are replaced. A null doc_id is in no fold (held_out null).
    """
    model = train(docs, labels, "quality", folds, fold)
    rows = docs.drop("held_out", "score", "predicted").withColumn("held_out", crc_fold(F.col("doc_id"), folds) == fold)
    rows = rows.withColumn("score", quality_score(model, docs.sparkSession, F.col("text")))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
