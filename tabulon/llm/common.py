"""What the operators share: written tables in the shared folder, and Arrow helpers."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text wherever an operator counts words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: bytes.translate table that lower-cases A-Z alone.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it.

    Without the setting, a local session (tests) gets a temporary folder; a cluster gets an
    error, because a machine-local folder would lose data with its executor.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or re.match(r"local\[", master)):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    where = tempfile.mkdtemp(prefix="tabulon-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


_written: list[tuple[SparkSession, str]] = []


def forget_written() -> None:
    """Deletes all tables that written() has made: for a long session, once no result that reads them is needed. Runs at exit."""
    while _written:
        spark, path = _written.pop()
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session has gone; whoever owns the shared folder clears it
            return


atexit.register(forget_written)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tabulon-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_in(text: Column) -> Column:
    """How many words a text has (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def binary_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the offsets of its rows (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of many runs: starts[i], starts[i]+1, ... lengths[i] of them, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - firsts, lengths)


def byte_batches(batches, most: int = 32 << 20):
    """Record batches cut so that none much exceeds ``most`` bytes; a longer single row stands alone."""
    for batch in batches:
        if batch.nbytes <= most or batch.num_rows <= 1:
            yield batch
            continue
        step = max(1, int(batch.num_rows * most / batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b: the smallest node that each can reach."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        open_ = low != high
        if not open_.any():
            return label
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])
        while True:
            nearer = label[label]
            if np.array_equal(nearer, label):
                break
            label = nearer


def released(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs, whose results have been written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, order: list[Column], parts: int, name: str) -> DataFrame:
    """``df`` as a written table with ``rid``: 0, 1, 2 ... in the given order, which must leave no ties that matter.

    Rows are dealt to ``parts`` ranges of the order and counted there; a row for each range goes to the driver.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = written(dealt.select("*", F.monotonically_increasing_id().alias("_place")), name)
    part = F.shiftright("_place", 33)
    start, starts = 0, []
    for r in sorted(kept.groupBy(part.alias("part")).count().collect()):
        starts.append((r["part"], start))
        start += r["count"]
    listed = spark.createDataFrame(starts, "_part long, _start long")
    rid = F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(listed), part == F.col("_part")).select(*df.columns, rid.alias("rid"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` to (row, rid): each row as a struct, and a unique long in the order of doc_id.

    The struct keeps names of extra columns apart from the operators' own.

    It is doc_id itself where that is unique and not null. Otherwise rows are numbered from 0 in the order
    of doc_id (null last) and text, so rows that share a doc_id count as documents in that order. Rows that
    agree in both follow a hash of all their columns, and rows alike in all are told apart by their place, so
    no range of rows is too common to be split.
    """
    return keyed_and_known(docs)[0]


def keyed_and_known(docs: DataFrame, numbers: bool = True) -> tuple[DataFrame, bool]:
    """keyed(), and whether ``rid`` is doc_id. Without ``numbers`` rows that need them are left without ``rid``."""
    n = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("k"), F.countDistinct("doc_id").alias("d")).first()
    if n["n"] == n["d"] == n["k"]:
        return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("rid")), True
    if not numbers:
        return docs.select(F.struct("*").alias("row")), False
    hashable = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(*(F.col(f"`{c}`") for c in hashable)).alias("_like"), F.monotonically_increasing_id().alias("_tie"))
    order = [F.col("row.doc_id").asc_nulls_last(), F.col("row.text").asc_nulls_first(), F.col("_like").asc(), F.col("_tie").asc()]
    return numbered(rows, order, int(max(1, n["n"] // 50_000)), "keyed").select("row", "rid"), False


#: A key is hot from this many rows, or this share of all rows if that is more: there are at most 100,000 hot keys.
HOT_ROWS, HOT_SHARE = 1000, 100_000


def joined_evenly(big: DataFrame, small: DataFrame, key: list[str], counts: DataFrame, rows: int) -> DataFrame:
    """``big`` joined with ``small``, which has one row for each key at most; no key gathers its rows in one task.

    ``counts`` (the key, n) says how many of big's ``rows`` rows each key has. The hot keys, of which there are at
    most HOT_SHARE, are sent to every task; the others meet by shuffle.
    """
    hot = counts.where(F.col("n") > max(HOT_ROWS, rows // HOT_SHARE)).select(*key)
    few = written(small.join(F.broadcast(hot), key, "left_semi"), "hot")
    if few.isEmpty():
        return big.join(small, key)
    rest = big.join(F.broadcast(few.select(*key)), key, "left_anti").join(small, key)
    return big.join(F.broadcast(few), key).unionByName(rest)
