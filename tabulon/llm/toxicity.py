"""A convolutional toxicity classifier over hashed word embeddings, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_values, byte_batches, crc_fold, table
from .features import mixed, word_hashes, word_spans
from .quality import labelled_sample, logistic_line

BITS, DIM, WIDTHS, FILTERS, STEM = 15, 16, (1, 2, 3), 16, 5
#: Most labelled rows that the fit reads, by least hash of the id. Scores cover all rows and whole texts.
SAMPLE_ROWS = 8000
#: Parts of the sample that calibrate in turn until they hold this many rows of label 1; least gradient steps of a fit.
PARTS, ENOUGH, LEAST_STEPS = 5, 100, 60


def word_rows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word (A-Z lower-cased): text number, and two embedding rows: of the word and of its first bytes."""
    start, end, text = word_spans(data, bounds)
    whole = word_hashes(data, start, end, fold=True) >> np.uint64(64 - BITS)
    stem = mixed(word_hashes(data, start, np.minimum(end, start + STEM), fold=True) + np.uint64(5)) >> np.uint64(64 - BITS)
    return text, whole.astype(np.int32), stem.astype(np.int32)


@dataclass
class Net:
    """Embeddings, a filter bank for each width, and the output layer; a, b calibrate its logit."""

    embed: np.ndarray
    banks: list[np.ndarray]
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: float = 0.0
    a: float = 1.0
    b: float = 0.0
    thresholds: dict = field(default_factory=dict)

    def layers(self, x: np.ndarray, text: np.ndarray):
        """Rectified outputs of each filter at each place; windows that would cross into another text give 0."""
        for width, bank, shift in zip(WIDTHS, self.banks, self.shifts):
            n = len(x) - width + 1
            if n <= 0:
                yield np.zeros((0, FILTERS), np.float32)
                continue
            wide = x[:n] if width == 1 else np.concatenate([x[i : i + n] for i in range(width)], axis=1)
            h = np.maximum(wide @ bank + shift, 0)
            h[text[width - 1 :] != text[:n]] = 0
            yield h

    def pooled(self, text: np.ndarray, whole: np.ndarray, stem: np.ndarray, n: int) -> np.ndarray:
        """Largest output of each filter in each text."""
        x = self.embed[whole] + self.embed[stem]
        best = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
        for k, h in enumerate(self.layers(x, text)):
            if len(h):
                own = text[: len(h)]
                heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                best[own[heads], k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(h, heads, axis=0)
        return best

    def logits(self, text, whole, stem, n: int) -> np.ndarray:
        return self.pooled(text, whole, stem, n) @ self.out + self.bias

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        z = self.logits(*word_rows(data, bounds), len(bounds) - 1)
        return 1 / (1 + np.exp(-np.clip(self.a * z + self.b, -30, 30)))


def _start(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, random) -> Net:
    """Small random weights; the first embedding dimension starts at the log-odds of the word's and the stem's rows."""
    size = 1 << BITS
    counts = np.ones((2, size))
    for (whole, stem), y in zip(rows, label):
        counts[y] += np.bincount(np.unique(np.concatenate([whole, stem])), minlength=size) > 0
    odds = np.log(counts[1] / (label.sum() + 2)) - np.log(counts[0] / ((1 - label).sum() + 2))
    embed = random.normal(0, 0.1, (size, DIM)).astype(np.float32)
    embed[:, 0] = np.clip(odds, -3, 3) * (counts.sum(axis=0) > 6) / 3
    banks = [random.normal(0, 0.15, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for bank in banks:
        bank[::DIM, : FILTERS // 2] += 0.5
    return Net(embed, banks, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], random.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32))


@dataclass
class Slopes:
    """Slopes of the loss: of the output layer, the filter banks, and the embedding rows that were used."""

    out: np.ndarray
    bias: float
    banks: list[np.ndarray]
    shifts: list[np.ndarray]
    embed: list[tuple[np.ndarray, np.ndarray]]


def loss_slopes(net: Net, rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, weight: np.ndarray) -> tuple[float, Slopes]:
    """Weighted mean log-loss of some texts, and its slopes; through max pooling, each filter learns from its best place alone."""
    whole = np.concatenate([r[0] for r in rows])
    stem = np.concatenate([r[1] for r in rows])
    sizes = np.array([len(r[0]) for r in rows])
    text = np.repeat(np.arange(len(rows)), sizes)
    ends = np.cumsum(sizes)
    x = net.embed[whole] + net.embed[stem]
    best = np.zeros((len(rows), FILTERS * len(WIDTHS)), x.dtype)
    place = np.full(best.shape, -1)
    for k, h in enumerate(net.layers(x, text)):
        for t, (a, b) in enumerate(zip(ends - sizes, ends)):
            part = h[a : b - WIDTHS[k] + 1]
            if len(part):
                at = part.argmax(axis=0)
                best[t, k * FILTERS : (k + 1) * FILTERS] = part[at, np.arange(FILTERS)]
                place[t, k * FILTERS : (k + 1) * FILTERS] = at + a
    z = np.clip(best @ net.out + net.bias, -30, 30)
    loss = float((weight * (np.log1p(np.exp(z)) - label * z)).mean())
    slope = ((1 / (1 + np.exp(-z)) - label) * weight / len(rows)).astype(x.dtype)
    back = slope[:, None] * net.out[None, :] * (best > 0)
    push = np.zeros_like(x)
    banks, shifts = [], []
    for k, width in enumerate(WIDTHS):
        cols = slice(k * FILTERS, (k + 1) * FILTERS)
        t, f = np.nonzero(back[:, cols])
        g, at = back[:, cols][t, f], place[:, cols][t, f]
        bank = np.zeros_like(net.banks[k])
        if len(t):
            wide = x[at[:, None] + np.arange(width)].reshape(len(at), -1)
            np.add.at(bank.T, f, g[:, None] * wide)
            own = (g[:, None] * net.banks[k].T[f]).reshape(len(at), width, DIM)
            for i in range(width):
                np.add.at(push, at + i, own[:, i])
        banks.append(bank)
        shifts.append(np.bincount(f, g, FILTERS).astype(x.dtype))
    hit = np.flatnonzero(np.abs(push).sum(axis=1))
    embed = []
    for ids in (whole[hit], stem[hit]):
        used, inverse = np.unique(ids, return_inverse=True)
        total = np.zeros((len(used), DIM), x.dtype)
        np.add.at(total, inverse, push[hit])
        embed.append((used, total))
    return loss, Slopes(best.T @ slope, float(slope.sum()), banks, shifts, embed)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, epochs: int = 5, batch: int = 32, rate: float = 0.01, seed: int = 9, least_steps: int = 0) -> Net:
    """Trains by adaptive gradient steps, for some epochs and at least ``least_steps`` steps, so that few rows are learned too."""
    random = np.random.default_rng(seed)
    net = _start(rows, label, random)
    if not len(rows):
        return net
    weight = np.where(label > 0, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9))
    slow: dict = {}
    seen = np.full(net.embed.shape[0], 1e-8, np.float32)

    def step(name, value, slope):
        slow[name] = slow.get(name, 1e-8) + slope * slope
        return value - rate * 4 * slope / np.sqrt(slow[name])

    for _ in range(max(epochs, -(-least_steps * batch // len(rows)))):
        order = random.permutation(len(rows))
        for lo in range(0, len(order), batch):
            chosen = [i for i in order[lo : lo + batch] if len(rows[i][0])]
            if not chosen:
                continue
            _, slopes = loss_slopes(net, [rows[i] for i in chosen], label[chosen], weight[chosen])
            net.out = step("out", net.out, slopes.out + 1e-4 * net.out)
            net.bias = float(step("bias", net.bias, slopes.bias))
            for k in range(len(WIDTHS)):
                net.banks[k] = step(("bank", k), net.banks[k], slopes.banks[k])
                net.shifts[k] = step(("shift", k), net.shifts[k], slopes.shifts[k])
            for used, total in slopes.embed:
                seen[used] += (total * total).mean(axis=1)
                net.embed[used] -= rate * 4 * total / np.sqrt(seen[used])[:, None]
    return net


def _best_threshold(score: np.ndarray, label: np.ndarray) -> float:
    """The score above which the F1 of label 1 is best, halfway to the next score."""
    if not len(label) or label.min() == label.max():
        return 0.5
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + label.sum())
    at = int(f1.argmax())
    low = score[order[at + 1]] if at + 1 < len(order) else 0.0
    return float((score[order[at]] + low) / 2)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, fold: int = 2, sample_rows: int = SAMPLE_ROWS) -> Net:
    """Fits a net on the sample. Its scores and each language's threshold are calibrated by nets that did not see the row."""
    sample = labelled_sample(docs, labels, label, crc_fold(F.col("doc_id"), folds) == fold, sample_rows)

    def run(batches):
        for batch in byte_batches(batches, 2 << 20):
            data, bounds = binary_values(batch.column(3))
            text, whole, stem = word_rows(data, bounds)
            cut = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(cut, pa.array(whole)), pa.ListArray.from_arrays(cut, pa.array(stem))], names=["doc_id", "y", "lang", "whole", "stem"])

    got = sample.select(F.col("doc_id").cast("long"), F.col("_label").cast("int").alias("y"), "lang", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, y int, lang string, whole array<int>, stem array<int>").toArrow()
    ids = got.column("doc_id").to_numpy()
    y = (got.column("y").to_numpy() > 0).astype(np.int64)
    lang = np.array(got.column("lang").to_pylist(), object)
    whole, stem = (got.column(c).combine_chunks() for c in ("whole", "stem"))
    rows = [(whole[i].values.to_numpy(), stem[i].values.to_numpy()) for i in range(len(ids))]
    order = np.lexsort((ids, mixed(ids.astype(np.int64).view(np.uint64)))) if len(ids) else np.zeros(0, int)
    return fitted([rows[i] for i in order], y[order], lang[order])


def fitted(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, lang: np.ndarray, parts: int = PARTS, least_steps: int = LEAST_STEPS) -> Net:
    """A calibrated net. With few rows each of ``parts`` calibrates in turn, under a net of the others; with many the last alone."""
    if not len(rows) or y.min() == y.max():  # nothing to tell apart
        net = fit([], np.zeros(0, np.int64), epochs=0)
        net.out[:] = 0
        share = (y.sum() + 1) / (len(y) + 2)
        net.b = float(np.log(share / (1 - share)))
        net.thresholds = {None: 0.5}
        return net
    z, tried = np.zeros(len(rows)), np.zeros(len(rows), bool)
    part = np.arange(len(rows)) % parts
    for p in reversed(range(parts)):
        seen = part != p
        if y[seen].min() < y[seen].max():
            net = fit([r for r, s in zip(rows, seen) if s], y[seen], least_steps=least_steps)
            for i in np.flatnonzero(~seen):
                z[i] = net.logits(np.zeros(len(rows[i][0]), np.int64), *rows[i], 1)[0]
            tried |= ~seen
        if y[tried].sum() >= ENOUGH:
            break
    final = fit(rows, y, least_steps=least_steps)
    if tried.any() and 0 < y[tried].mean() < 1:
        final.a, final.b = logistic_line(z[tried], y[tried])
    score = 1 / (1 + np.exp(-np.clip(final.a * z + final.b, -30, 30)))
    final.thresholds = {None: _best_threshold(score[tried], y[tried])}
    for name in {x for x in lang if x is not None}:
        own = tried & (lang == name)
        if y[own].sum() >= 10:
            final.thresholds[name] = _best_threshold(score[own], y[own])
    return final


def toxicity_score(net: Net, spark, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for part in byte_batches([pa.RecordBatch.from_arrays([column], names=["t"])], 1 << 20):
            out.append(shared.value.scores(*binary_values(part.column(0))).astype(float))
        return pa.array(np.concatenate(out))

    return score(F.coalesce(text, F.lit("")).cast("binary"))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, fold: int = 2) -> DataFrame:
    """``docs`` (doc_id, text, lang if known, any more columns) with held_out, score, predicted, threshold and flagged.

    The score reads the text alone. ``predicted`` cuts it at ``threshold``; ``flagged`` cuts it at the
    threshold that was calibrated for the row's language (the common one for languages with fewer
    than ten toxic rows in the calibration, unknown and null languages). Null and empty texts get the
    score of a text without words; columns with these names are replaced; an empty labels table gives all texts one score.
    """
    net = train(docs, labels, "toxic", folds, fold)
    rows = docs.drop("held_out", "score", "predicted", "threshold", "flagged").withColumn("held_out", crc_fold(F.col("doc_id"), folds) == fold)
    rows = rows.withColumn("score", toxicity_score(net, docs.sparkSession, F.col("text")))
    limit = F.lit(net.thresholds[None])
    if "lang" in docs.columns:
        for name, value in net.thresholds.items():
            if name is not None:
                limit = F.when(F.col("lang") == name, F.lit(value)).otherwise(limit)
    rows = rows.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("threshold", limit)
    return rows.withColumn("flagged", F.col("score") >= F.col("threshold"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "flagged")
