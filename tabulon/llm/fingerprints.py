"""Threshold-scaled sketches of documents, in DataFrame functions alone.

A sketch keeps every shingle hash below a fixed fraction of the hash range. The sketch of a union is
the union of sketches, and because a long text keeps in proportion more than a short one, the share
of one sketch that another holds estimates containment however unequal the two texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, numbered, table

SHINGLE, SCALE = 5, 4
#: Rows of a block of neighbouring ids, and the most blocks (2 MB of heads in one task and in all).
BLOCK_ROWS, MOST_BLOCKS = 1000, 1 << 17
#: Hexadecimal digits of each hash in a fingerprint's text.
DIGITS = 11


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted array of the retained shingle hashes (longs of 44 bits) of a text.

    Shingles are runs of ``shingle`` words (a shorter text is one shingle); one in ``scale`` hashes is
    kept. A text with words none of whose hashes lies below the threshold keeps its least one, so
    short texts still tell themselves apart. Null and empty texts have an empty sketch.
    """
    if scale < 4 or scale & (scale - 1):
        raise ValueError("scale must be a power of two, 4 at least")
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != F.lit(""))
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        last = F.greatest(F.size(h) - shingle, F.lit(0))
        made = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(shingle))))
        return F.when(F.size(h) == 0, F.array().cast("array<long>")).otherwise(made)

    top = 2**64 // scale
    kept = lambda s: F.filter(s, lambda x: (x >= 0) & (x < F.lit(top)))
    shift = 62 - DIGITS * 4
    cut = lambda a: F.array_sort(F.array_distinct(F.transform(a, lambda x: F.shiftrightunsigned(x, shift))))

    def retained(s: Column) -> Column:
        least = F.array_min(F.transform(s, lambda x: F.shiftrightunsigned(x, 2)))
        return _let(kept(s), lambda k: F.when((F.size(k) == 0) & (F.size(s) > 0), F.array(least)).otherwise(k))

    return cut(_let(_let(hashed, shingles), retained))


def as_text(sketch_: Column) -> Column:
    return F.array_join(F.transform(sketch_, lambda x: F.lpad(F.lower(F.hex(x)), DIGITS, "0")), "")


def merged(a: Column, b: Column) -> Column:
    """The sketch of two texts taken together (where neither is a lone least hash)."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column, b: Column) -> Column:
    """The share of a's shingles that b holds too, estimated; an empty a is contained in anything."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of both; 1 for equal sketches, two empty ones too."""
    both = F.size(F.array_intersect(a, b))
    return _let(both, lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def _even_rows(rows: DataFrame, blocks_of: int, most: int) -> tuple[DataFrame, int, int, int]:
    """``rows`` with ``_at``, a long in the order of rid, and the least and greatest of it and how many blocks to cut.

    It is rid itself where rids lie so evenly that blocks of equal width hold about equally many rows. Otherwise
    rids are replaced by their ranks, which costs a join.
    """
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("lo"), F.max("rid").alias("hi")).first()
    n, lo, hi = (ends["n"], ends["lo"], ends["hi"]) if ends["n"] else (1, 0, 0)
    blocks = min(max(n // blocks_of, 1), most)
    fullest = rows.groupBy(_block_of(F.col("rid"), lo, hi, blocks).alias("_b")).count().agg(F.max("count").alias("n")).first()["n"] or 0
    if fullest <= 8 * max(blocks_of, n // blocks):
        return rows.withColumn("_at", F.col("rid")), lo, hi, blocks
    ranks = numbered(rows.select(F.col("rid").alias("_rid")), [F.col("_rid").asc()], int(max(1, n // 500_000)), "ranks")
    ranks = ranks.select("_rid", F.col("rid").alias("_at"))
    return rows.join(ranks, F.col("rid") == F.col("_rid")).drop("_rid"), 0, n - 1, blocks


def _block_of(at: Column, lo: int, hi: int, blocks: int) -> Column:
    width = (hi - lo) // blocks + 1
    # numbers may span more than a long holds
    return F.floor((at.cast("decimal(20,0)") - F.lit(str(lo)).cast("decimal(20,0)")) / F.lit(str(width)).cast("decimal(20,0)")).cast("long")


def beside_next(docs: DataFrame, carried: dict[str, Column], blocks_of: int = BLOCK_ROWS, most: int = MOST_BLOCKS) -> DataFrame:
    """Each row with ``next``, a struct of the carried columns of the next row by descending doc_id.

    After the last row comes the first. Rows are cut into blocks of neighbouring ids with about ``blocks_of`` rows,
    however the ids are spread, so no task orders them all; the head of each block is also sent to the block before it.
    Beyond ``most`` blocks the blocks grow. Repeated and null ids are ordered as keyed() says.
    """
    rows, lo, hi, blocks = _even_rows(keyed(docs).select("row.*", "rid"), blocks_of, most)
    rows = rows.withColumn("_block", _block_of(F.col("_at"), lo, hi, blocks))
    heads = rows.groupBy("_block").agg(F.max("_at").alias("_head"))
    # as many rows as blocks: one task may order them and every task may hold them
    down = Window.orderBy(F.desc("_block"))
    heads = heads.select("_head", F.coalesce(F.lag("_block").over(down), F.min("_block").over(Window.partitionBy())).alias("_to"))
    rows = rows.select("*", F.struct(*(c.alias(k) for k, c in carried.items())).alias("_own"))
    rows = rows.join(F.broadcast(heads), F.col("_at") == F.col("_head"), "left")
    place = lambda b, g: F.struct(b.alias("block"), F.lit(g).alias("guest"))
    places = F.when(F.col("_head").isNull(), F.array(place(F.col("_block"), False))).otherwise(F.array(place(F.col("_block"), False), place(F.col("_to"), True)))
    rows = rows.select(*docs.columns, F.col("_at").alias("_turn"), "_own", F.explode(places).alias("_at"))
    within = Window.partitionBy("_at.block").orderBy(F.col("_at.guest"), F.desc("_turn"))
    return rows.select("*", F.lead("_own").over(within).alias("next")).where("not _at.guest").drop("_at", "_turn").withColumnRenamed("_own", "own")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any more columns) to the sketches of each text, its edited text and the next text.

    In the edited text the last third of the code points makes way for the first as many of the next.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = beside_next(docs.select("doc_id", "text"), {"text": body, "sketch": sketch(body)})
    rows = rows.select("doc_id", "own", "next", F.length("own.text").cast("long").alias("n_chars"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.left("own.text", F.col("n_chars").cast("int") - third), F.left("next.text", third))
    rows = rows.select("doc_id", "n_chars", F.col("own.sketch").alias("sketch"), F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    return rows.select("doc_id", "n_chars", "sketch", "next_sketch", "edited", sketch(F.col("edited")).alias("edited_sketch"))


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    rows = edited_fingerprints(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
