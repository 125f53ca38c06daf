"""URL filters: a blocked Bloom filter lets possible hits through to an exact hash join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table

#: A block is 512 bits: a key sets and tests PROBES bits of one block. The whole filter is at most
#: MOST_BLOCKS blocks (32 MB), whatever the list's length: beyond that more false hits pass to the join.
WORDS, PROBES, KEYS_PER_BLOCK, MOST_BLOCKS = 8, 6, 40, 1 << 19


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each hash, and its mask of 8 words."""
    u = keys.view(np.uint64)
    block = ((u >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    mask = np.zeros((len(u), WORDS), np.uint64)
    rest = u * np.uint64(0x9E3779B97F4A7C15)
    row = np.arange(len(u))
    for i in range(PROBES):
        bit = (rest >> np.uint64(9 * i)) & np.uint64(511)
        mask[row, (bit >> np.uint64(6)).astype(np.intp)] |= np.uint64(1) << (bit & np.uint64(63))
    return block.astype(np.int64), mask


def bloom_filter(keys: DataFrame, column: str = "h") -> np.ndarray:
    """Blocks x 8 words of the filter of a long column of hashes, built where the keys are.

    Only the filter's blocks, of which there is a fixed most, come to the driver.
    """
    n = keys.count()
    blocks = int(min(max(1, -(-n // KEYS_PER_BLOCK)), MOST_BLOCKS))

    def run(batches):
        for batch in batches:
            block, mask = _bits(batch.column(0).to_numpy(zero_copy_only=False), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(mask[:, i].view(np.int64)) for i in range(WORDS))], names=["block", *(f"w{i}" for i in range(WORDS))])

    masks = keys.select(column).mapInArrow(run, ", ".join(["block long", *(f"w{i} long" for i in range(WORDS))]))
    rows = masks.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))
    out = np.zeros((blocks, WORDS), np.uint64)
    got = rows.toArrow()
    if got.num_rows:
        out[got.column("block").to_numpy()] = np.stack([got.column(f"w{i}").to_numpy() for i in range(WORDS)], axis=1).view(np.uint64)
    return out


def passing(spark, filter_: np.ndarray):
    """Column function: array of structs (h, ...) to those whose h may be in the filter."""
    shared = spark.sparkContext.broadcast(filter_)

    @F.arrow_udf("array<boolean>")
    def test(hashes: pa.Array) -> pa.Array:
        flat = hashes.flatten()
        words = shared.value
        block, mask = _bits(flat.to_numpy(zero_copy_only=False).astype(np.int64), len(words))
        hit = ((words[block] & mask) == mask).all(axis=1)
        sizes = np.array([0 if n is None else n for n in pc.list_value_length(hashes).to_pylist()], np.int64)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(hit))

    # a plan that took this for an ordinary expression would move it into others
    return test.asNondeterministic()


def _last_labels(host: Column, n: int) -> Column:
    """The last n labels of a host, which has as many at least."""
    return F.substring_index(host, ".", -n)


def judged(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """``pages`` (url, any more columns) with host, path, rule and verdict, one row per input row.

    ``rules`` has host, path and verdict: canonical URLs, listed. A rule fits its host and all
    subdomains if the url's path starts with the rule's; the longest (host and path together, then
    host) wins, and of equal rules block. For each url the candidates are the ends of its host with
    as many labels as some listed host, with its path's prefixes of the lengths that the list has, so
    a url costs no more than its length for each of these; the filter drops nearly all of them, and
    the hash join with the list settles the rest. Columns of ``pages`` with these names are replaced. A url with no rule gets ``otherwise``: it is not
    listed. Null urls and urls without :// have an empty host and path, which no rule fits.
    """
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    listed = rules.groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.max(F.col("verdict") == "block").alias("_block"))
    listed = listed.select("r_host", "r_path", F.when(F.col("_block"), "block").otherwise("allow").alias("r_verdict"))
    hashed = lambda h, p: F.xxhash64(h, p)
    filter_ = bloom_filter(listed.select(hashed(F.col("r_host"), F.col("r_path")).alias("h")))
    # no more of them than the longest listed host has labels, and the longest path characters
    labels = lambda h: F.regexp_count(h, F.lit(r"\.")) + 1
    ends = sorted(r[0] for r in listed.where("r_host != ''").select(labels(F.col("r_host"))).distinct().collect())
    lengths = sorted(r[0] for r in listed.select(F.length("r_path")).distinct().collect())
    # the row's own columns stay in a struct, whatever their names
    placed = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    placed = placed.withColumn("labels", labels(F.col("host")))
    hosts = F.filter(F.array(*(F.when(F.col("labels") >= n, _last_labels(F.col("host"), n)) for n in ends)).cast("array<string>"), lambda h: h.isNotNull())
    cuts = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(cuts, lambda n: F.struct(h.alias("host"), F.left("path", n).alias("path")))))
    none = F.array().cast("array<struct<host:string,path:string>>")
    listing = placed.select("row", "host", "path", F.when(F.col("host") != "", pairs).otherwise(none).alias("pairs"))
    test = passing(spark, filter_)
    tested = listing.withColumn("hit", test(F.transform("pairs", lambda p: hashed(p["host"], p["path"]))))
    tested = tested.withColumn("pairs", F.transform(F.filter(F.arrays_zip("pairs", "hit"), lambda x: x["hit"]), lambda x: x["pairs"])).drop("hit")
    maybe = tested.where(F.size("pairs") > 0)
    # each (host, path) is joined once, however many pages share it
    hits = maybe.select("host", "path", F.explode("pairs").alias("p")).distinct()
    hits = hits.join(listed, (F.col("p.host") == F.col("r_host")) & (F.col("p.path") == F.col("r_path")))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("a"), F.length("r_host").alias("b"))
    hits = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank).alias("won"))
    own = [F.col("row").getField(c).alias(c) for c in kept]
    found = maybe.select("row", "host", "path").join(hits, ["host", "path"], "left").select(*own, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(otherwise)).alias("verdict"))
    unlisted = tested.where(F.size("pairs") == 0).select(*own, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    return found.unionAll(unlisted)


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH cut AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(r_host, r_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fit AS (
  SELECT page_id, host, path, r_host || r_path AS rule, verdict
  FROM cut LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC NULLS LAST) = 1
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit
"""
