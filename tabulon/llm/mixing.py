"""Mixing sources to target weights by pivotal dependent rounding of copy probabilities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, table, words_in, written

#: Documents of a leaf of the reduction tree, and residuals that a further level combines in one task.
LEAF, FAN = 4096, 4096
MOST_COPIES = 3


def targets_of(sizes: dict, weights: dict, cap: float = MOST_COPIES) -> dict:
    """Source to target: shares of the total by weight, none above ``cap`` times its size, excess reshared by weight."""
    total = float(sum(sizes.values()))
    target = {s: 0.0 for s in sizes}
    open_ = {s for s in sizes if sizes[s] > 0 and weights[s] > 0}
    left = total
    while open_:
        rate = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * rate > cap * sizes[s]}
        if not full:
            return target | {s: weights[s] * rate for s in open_}
        target |= {s: float(cap * sizes[s]) for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


def default_weights(sources) -> dict:
    """Sources by code point, null last, weigh 1, 2, 3, repeating."""
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: i % 3 + 1 for i, s in enumerate(order)}


def _random(*parts: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on nothing but the parts."""
    x = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        x = (x ^ p.astype(np.int64).view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) * 2.0**-53


def pivotal(size: np.ndarray, mass: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pairs documents until one at most is open; returns masses, each 0 or its size but for that one.

    ``mass`` is the words that a document is due, between 0 and its size: its probability times its
    size. A pair moves words from one to the other, in a direction drawn so that both keep their
    expected masses, until one of them is empty or full. Words are never made or lost. A round pairs
    all open documents at once.
    """
    mass = mass.astype(float).copy()
    size = size.astype(float)
    tiny = 1e-9 * np.maximum(size, 1.0)
    level = 0
    while True:
        mass = np.where(mass <= tiny, 0.0, np.where(mass >= size - tiny, size, mass))
        open_ = np.flatnonzero((mass > 0) & (mass < size))
        if len(open_) < 2:
            return mass
        a, b = open_[0 : len(open_) // 2 * 2 : 2], open_[1::2]
        up = np.minimum(size[a] - mass[a], mass[b])
        down = np.minimum(mass[a], size[b] - mass[b])
        draw = _random(key[a], key[b], np.full(len(a), level))
        move = np.where(draw * (up + down) < down, up, -down)
        mass[a] += move
        mass[b] -= move
        # what reaches a bound is set to it, for sums of floats may miss it by a hair
        level += 1


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["place", "n"], kind="stable", ignore_index=True)
    mass = pivotal(pdf["size"].to_numpy(), pdf["mass"].to_numpy(), pdf["place"].to_numpy())
    pdf["mass"] = mass
    pdf["open"] = (mass > 0) & (mass < pdf["size"])
    return pdf


def _closed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The root of a source: one open document per size class is left, settled from large to small.

    Each takes the whole copies that leave the least which the smaller ones cannot make up, and of
    those the nearest to its words and the words owed so far; what that misses is owed by the next.
    """
    pdf = pdf.sort_values(["size", "place", "n"], ascending=[False, True, True], kind="stable", ignore_index=True)
    size, base, mass = (pdf[c].to_numpy().astype(float) for c in ("size", "base", "mass"))
    # words that the documents after each could take beyond their mass, or give up
    more = np.r_[np.cumsum(((MOST_COPIES - base) * size - mass)[::-1])[::-1][1:], 0.0]
    less = np.r_[np.cumsum((base * size + mass)[::-1])[::-1][1:], 0.0]
    owed, copies = 0.0, []
    for i in range(len(pdf)):
        due = mass[i] + owed
        rest = due - np.arange(-int(base[i]), MOST_COPIES - int(base[i]) + 1) * size[i]
        beyond = np.maximum(np.maximum(rest - more[i], -rest - less[i]), 0.0)
        owed = float(rest[np.lexsort((np.abs(rest), beyond))[0]])
        copies.append(due - owed)
    pdf["mass"] = copies
    pdf["open"] = False
    return pdf


_SCHEMA = "n long, doc_id long, s int, size long, base long, mass double, cls int, place long, bucket long, open boolean"


def mix(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """``docs`` (doc_id, text, source, any more columns) to (n, doc_id, source, size, source_size, target, copies, taken), one row per input row.

    A document of size words whose source is to give target of its source_size words has
    target / source_size copies to come: the whole part is sure, the rest a probability. Sources,
    size classes (powers of two) and hashes of the row's number form the leaves of a tree; in each the pivotal
    rule pairs documents until one is open, and these residuals meet in the next level, up to the
    source, where the classes' residuals are settled from large to small. A source with most rows is
    just more leaves. Nothing depends on how the rows are stored, so reruns agree.
    Null texts and texts without words have size 0 and are not taken; a null source is a source; rows
    that repeat are documents of their own; ``n`` is the row's number by keyed().
    """
    return mix_rows(keyed(docs.select("doc_id", "text", "source")), weights)


def mix_rows(keyed_docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """mix() of rows that keyed() has numbered."""
    spark = keyed_docs.sparkSession
    rows = keyed_docs.select("row.doc_id", "row.text", "row.source", "rid")
    rows = rows.select(F.col("rid").alias("n"), F.col("doc_id").cast("long"), F.col("source").cast("string"), words_in(F.col("text")).alias("size"))
    rows = written(rows, "sizes")
    # a row for each source goes to the driver; documents don't
    found = {r["source"]: r for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).collect()}
    sizes = {s: r["size"] for s, r in found.items()}
    target = targets_of(sizes, weights if weights is not None else default_weights(sizes))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    listed = spark.createDataFrame([(i, s, sizes[s], float(target[s]), target[s] / sizes[s] if sizes[s] else 0.0, -(-found[s]["docs"] // LEAF)) for i, s in enumerate(order)], "s int, source string, source_size long, target double, rate double, leaves long")
    placed = rows.alias("a").join(listed.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("n", "doc_id", "s", "size", "rate", "leaves")
    place = F.xxhash64("n")
    work = placed.select("n", "doc_id", "s", "size", F.floor("rate").cast("long").alias("base"), ((F.col("rate") - F.floor("rate")) * F.col("size")).alias("mass"), F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int").alias("cls"), place.alias("place"), F.pmod(place, F.col("leaves")).cast("long").alias("bucket"))
    leaves = max(1, -(-max([r["docs"] for r in found.values()], default=1) // LEAF))
    work = work.withColumn("open", F.lit(True))
    whole = work.where("size = 0 or mass = 0").withColumn("open", F.lit(False))
    level = written(work.where("size > 0 and mass > 0").groupBy("s", "cls", "bucket").applyInPandas(_settled, _SCHEMA), "leaves")
    closed = [whole.select("n", "size", "base", "mass"), level.where("not open").select("n", "size", "base", "mass")]
    while leaves > 1:
        leaves = -(-leaves // FAN)
        above = level.where("open").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
        level = written(above.groupBy("s", "cls", "bucket").applyInPandas(_settled, _SCHEMA), "residuals")
        closed.append(level.where("not open").select("n", "size", "base", "mass"))
    # one open document for each size class of a source is left: 63 at most
    closed.append(level.where("open").groupBy("s").applyInPandas(_closed, _SCHEMA).select("n", "size", "base", "mass"))
    done = closed[0]
    for part in closed[1:]:
        done = done.unionAll(part)
    done = done.select("n", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("base") + F.round(F.col("mass") / F.greatest("size", F.lit(1)))).cast("long").alias("copies"))
    out = rows.join(done, "n").alias("a").join(listed.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    return out.select("n", "doc_id", "a.source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as the mix takes it (columns unchanged)."""
    rows = keyed(docs)
    taken = mix_rows(rows, weights).where("copies > 0").select(F.col("n").alias("rid"), "copies")
    return rows.join(taken, "rid").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies")
