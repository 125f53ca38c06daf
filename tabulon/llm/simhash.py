"""Near-duplicates by SimHash: fingerprints, a binary-trie self-join, and groups of linked texts."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, components, joined_evenly, keyed, keyed_and_known, ranges, written
from .components import connected

SEED = 42
#: What dealing and sorting a row of a table costs, in pairs of keys compared: 18 by CPU as measured (6 and 0.35
#: microseconds), and more for the disk that it takes.
ROW_COST = 30
_POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def simhash_of(text: bytes, shingle: int = 4, repeats: bool = True) -> int:
    """64-bit SimHash of one text: a bit is set if over half of the shingle hashes have it.

    A shingle that stands several times counts each time, or once without ``repeats``.
    """
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], np.uint64)
    if not repeats:
        hashes = np.unique(hashes)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(text: Column, shingle: int = 4) -> Column:
    """Column of 64-bit fingerprints (as signed longs); null and empty texts get zero."""

    @F.arrow_udf("long")
    def fingerprint(column: pa.Array) -> pa.Array:
        out = np.fromiter((simhash_of(x or b"", shingle) for x in (v.as_py() for v in column)), np.uint64, len(column))
        return pa.array(out.view(np.int64))

    return fingerprint(F.coalesce(text, F.lit("")).cast("binary"))


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return sum(_POP[((x >> np.uint64(s)) & np.uint64(0xFFFF)).astype(np.intp)].astype(np.int16) for s in (0, 16, 32, 48))


def trie_links(group: np.ndarray, key: np.ndarray, budget: int, skip: int, step: int = 1 << 19):
    """Pairs of rows of equal ``group`` whose 64-bit keys differ in at most ``budget`` bits.

    Rows are sorted by (group, key); the leading ``skip`` bits are equal within a group. A node
    of the trie is a range of rows that share a prefix. Pairs of nodes go down together: a step
    adds a bit wherever the two branches differ, and a pair over budget is dropped. A pair of
    single rows is settled by the bits it has left. Yields arrays (i, j) of row numbers.
    """
    n = len(key)
    if not n:
        return
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    stops = np.r_[starts[1:], n]
    many = stops - starts > 1
    starts, stops = starts[many], stops[many]
    if not len(starts):
        return
    zero = np.zeros(len(starts), np.int16)
    stack = [(starts, stops, starts, stops, zero, zero + skip)]
    while stack:
        a0, a1, b0, b1, diff, depth = stack.pop()
        if len(a0) > step:
            half = len(a0) // 2
            stack += [tuple(x[half:] for x in (a0, a1, b0, b1, diff, depth)), tuple(x[:half] for x in (a0, a1, b0, b1, diff, depth))]
            continue
        single = ((a1 - a0) == 1) & ((b1 - b0) == 1)
        i, j = a0[single], b0[single]
        near = (i != j) & (differing_bits(key[i], key[j]) <= budget)
        i, j = i[near], j[near]
        if len(i):
            yield i, j
        more = ~single & (depth < 64)
        if not more.any():
            continue
        a0, a1, b0, b1, diff, depth = (x[more] for x in (a0, a1, b0, b1, diff, depth))
        bit = np.uint64(1) << (np.uint64(63) - depth.astype(np.uint64))
        am, bm = _split(key, a0, a1, bit), _split(key, b0, b1, bit)
        own = a0 == b0
        kids = [(a0, am, b0, bm, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~own), (am, a1, bm, b1, 0, None)]
        out = []
        for x0, x1, y0, y1, cost, only in kids:
            keep = (x1 > x0) & (y1 > y0) & (diff + cost <= budget)
            keep &= ~((x0 == y0) & (x1 - x0 == 1))
            if only is not None:
                keep &= only
            out.append((x0[keep], x1[keep], y0[keep], y1[keep], diff[keep] + np.int16(cost), depth[keep] + np.int16(1)))
        merged = tuple(np.concatenate(x) for x in zip(*out))
        if len(merged[0]):
            stack.append(merged)


def _split(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """For each sorted range: the first row whose key has the bit set, by bisection in step."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        up = open_ & ((key[np.minimum(mid, len(key) - 1)] & bit) == 0)
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)


def block_plan(n: int, budget: int) -> list[tuple[int, ...]]:
    """Which bits to agree on: each entry lists the bit order of one table, agreed bits first.

    The 64 bits are cut into budget + e blocks; two keys within budget agree on some e blocks
    whole. The e whose tables cost least for n keys is taken, so pairs stay near-linear in n.
    """

    def cost(extra: int) -> float:
        blocks = budget + extra
        return comb(blocks, extra) * (n * ROW_COST + n * n / 2.0 ** (64 * extra // blocks + 1))

    extra = min(range(1, 6), key=cost)
    blocks = budget + extra
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [range(edges[i], edges[i + 1]) for i in range(blocks)]
    plans = []
    for chosen in combinations(range(blocks), extra):
        first = [b for i in chosen for b in parts[i]]
        plans.append((len(first), *first, *(b for i in range(blocks) if i not in chosen for b in parts[i])))
    return plans


def _runs(order: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """A bit order as runs (from bit, to place, length), for shifting whole runs at once."""
    runs, at = [], 0
    while at < 64:
        length = 1
        while at + length < 64 and order[at + length] == order[at] + length:
            length += 1
        runs.append((order[at], at, length))
        at += length
    return runs


def _permuted(fp: Column, order: tuple[int, ...]) -> Column:
    """The bits of fp in the given order; place 0 is the highest bit."""
    out = None
    for src, to, length in _runs(order):
        mask = (1 << length) - 1
        piece = F.shiftrightunsigned(fp, 64 - src - length).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1))
        piece = F.shiftleft(piece, 64 - to - length)
        out = piece if out is None else out.bitwiseOR(piece)
    return out


def hamming_links(fingerprints: DataFrame, budget: int = 4, group_cap: int = 4096, rows_per_task: int = 400_000) -> DataFrame:
    """``fingerprints`` (longs fp and id, both distinct) to links (u, v) of ids that join all those within budget.

    Not every pair is returned: per task the pairs found are folded into a spanning forest, which
    keeps every connection. Groups over ``group_cap`` are cut into chunks, and each pair of chunks
    meets in a task of its own, so no task holds an unbounded group and none is dropped.
    """
    n = fingerprints.count()
    plans = block_plan(max(n, 1), budget)
    keyed = F.array(*(F.struct(F.lit(t).cast("int").alias("t"), _permuted(F.col("fp"), p[1:]).alias("key"), F.lit(p[0]).cast("int").alias("skip")) for t, p in enumerate(plans)))
    rows = fingerprints.select("id", F.explode(keyed).alias("k")).select("id", "k.t", "k.key", "k.skip")
    rows = rows.withColumn("agreed", F.expr("shiftrightunsigned(key, 64 - skip)"))
    big = rows.groupBy("t", "agreed").count().where(F.col("count") > group_cap).select("t", "agreed", F.ceil(F.col("count") / (group_cap // 2)).cast("int").alias("chunks"))
    rows = rows.join(big, ["t", "agreed"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda other: F.struct(F.least(own, other).alias("lo"), F.greatest(own, other).alias("hi")))
    rows = rows.select("id", "t", "key", "skip", "agreed", F.explode(pairs).alias("p")).select("id", "t", "key", "skip", "agreed", "p.lo", "p.hi")
    tasks = max(1, -(-n * len(plans) // rows_per_task))
    dealt = rows.withColumn("grp", F.xxhash64("t", "agreed", "lo", "hi")).select("id", "key", "skip", "grp").repartition(max(tasks, 12), "grp")

    def join(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        ident, key, skip, grp = (whole.column(c).to_numpy() for c in ("id", "key", "skip", "grp"))
        key = key.view(np.uint64)
        order = np.lexsort((key, grp, skip))
        ident, key, skip, grp = ident[order], key[order], skip[order], grp[order]
        left, right, held = [], [], 0
        label = np.arange(len(ident))
        for s in np.unique(skip):
            at = np.flatnonzero(skip == s)
            for i, j in trie_links(grp[at], key[at], budget, int(s)):
                left.append(at[i])
                right.append(at[j])
                held += len(i)
                if held > 4_000_000:
                    keep = np.flatnonzero(label != np.arange(len(label)))
                    label = components(len(ident), np.concatenate([keep, *left]), np.concatenate([label[keep], *right]))
                    left, right, held = [], [], 0
        keep = np.flatnonzero(label != np.arange(len(label)))
        label = components(len(ident), np.concatenate([keep, *left]), np.concatenate([label[keep], *right]))
        keep = np.flatnonzero(label != np.arange(len(label)))
        u, v = ident[keep], ident[label[keep]]
        differ = u != v
        yield pa.RecordBatch.from_arrays([pa.array(u[differ]), pa.array(v[differ])], names=["u", "v"])

    return dealt.mapInArrow(join, "u long, v long")


def simhash_groups(docs: DataFrame, shingle: int = 4, budget: int = 4) -> DataFrame:
    """``docs`` (doc_id, text, any more columns) to (doc_id, fp, component_id), one row per input row.

    component_id is the smallest doc_id reachable over links of at most ``budget`` differing bits.
    Equal fingerprints are one node, so copies cost one row each however many there are. Null and
    empty texts have fingerprint zero and are linked like any other; rows repeated stay repeated;
    a null doc_id takes part but is never a component_id unless its whole component is null.
    """
    rows, known = keyed_and_known(docs.select("doc_id", "text"))
    prints = written(rows.select("rid", F.col("row.doc_id").alias("doc_id"), simhash(F.col("row.text"), shingle).alias("fp")), "prints")
    # a node is named by its first row, so the root of a component is its first row too
    nodes = written(prints.groupBy("fp").agg(F.min("rid").alias("id"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = connected(hamming_links(nodes.select("fp", "id"), budget))
    placed = nodes.join(roots, nodes.id == roots.node, "left").select("fp", "n", F.coalesce("root", "id").alias("top"))
    total = prints.count()
    if known:
        of_print = placed.withColumnRenamed("top", "component_id")
    else:  # rows are in the order of doc_id, null last: the first row has the smallest
        placed = written(placed, "placed")
        first = prints.select(F.col("rid").alias("top"), F.col("doc_id").alias("component_id"))
        of_print = joined_evenly(placed, first, ["top"], placed.groupBy("top").agg(F.count(F.lit(1)).alias("n")), total)
    of_print = of_print.select("fp", "component_id")
    return joined_evenly(prints, of_print, ["fp"], nodes.select("fp", "n"), total).select("doc_id", "fp", "component_id")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted hashes of the different shingles of a text (its words as one, if they are fewer)."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(shingle, len(words))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)), np.uint64, len(words) - k + 1))


def alike_links(fp: np.ndarray, sets: list[np.ndarray], budget: int, similarity: float, side: np.ndarray | None = None, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all texts within ``budget`` bits whose sets have a Jaccard of ``similarity`` at least.

    With ``side`` (0 or 1 for each text) only pairs across the sides count. Texts of one ``known`` class are joined
    already. A pair is left out only if the links before it, or its class, already join its texts.
    """
    n = len(fp)
    size = np.fromiter(map(len, sets), np.int64, n)
    first = np.r_[0, np.cumsum(size)]
    values, code = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    here = np.zeros(len(values), np.int64)
    label = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1]
    left, right = [], []
    for i in range(n - 1):
        rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        rest = rest[differing_bits(fp[i], fp[rest]) <= budget]
        if side is not None:
            rest = rest[side[rest] != side[i]]
        # most in common: the smaller set
        rest = rest[np.minimum(size[rest], size[i]) >= similarity * np.maximum(size[rest], size[i])]
        rest = rest[size[rest] > 0]
        if not len(rest):
            continue
        here[code[first[i] : first[i + 1]]] = 1
        common = np.add.reduceat(here[code[ranges(first[rest], size[rest])]], np.r_[0, np.cumsum(size[rest])[:-1]])
        here[code[first[i] : first[i + 1]]] = 0
        near = rest[common >= similarity * (size[i] + size[rest] - common) - 1e-9]
        if len(near):
            left.append(np.full(len(near), i))
            right.append(near)
            label[np.isin(label, label[near])] = label[i]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


_LINKS = "u long, v long"


def _meeting(budget: int, words: int, similarity: float):
    """Links of the texts of one chunk (id, fp, body; with side and cls, those across the sides and classes alone).

    Each text that is no class's first is linked with its class's first, so a chunk gives a row a text at most.
    """

    def meet(block: pa.Table) -> pa.Table:
        block = block.combine_chunks().sort_by("id")
        ident, fp = block.column("id").to_numpy(), block.column("fp").to_numpy().view(np.uint64)
        sets = [shingle_set(x.as_py(), words) for x in block.column("body")]
        side = block.column("side").to_numpy() if "side" in block.column_names else None
        known = block.column("cls").to_numpy() if "cls" in block.column_names else None
        i, j = alike_links(fp, sets, budget, similarity, side, known)
        label = components(len(ident), i, j)
        other = ident != ident[label]
        return pa.table({"u": pa.array(ident[other], pa.int64()), "v": pa.array(ident[label[other]], pa.int64())})

    return meet


def _chunked(texts: DataFrame, sizes: DataFrame, rows: int, chunk_texts: int, chunk_bytes: int, turn: int = 0) -> DataFrame:
    """``texts`` with ``chunk`` and ``chunks``: each group cut by hash, afresh in each turn, into chunks of about the given size."""
    chunks = F.greatest(F.ceil(F.col("n") / chunk_texts), F.ceil(F.col("bytes") / chunk_bytes)).cast("int")
    sized = joined_evenly(texts, sizes.select("grp", chunks.alias("chunks")), ["grp"], sizes.select("grp", "n"), rows)
    return sized.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(turn)), F.col("chunks")).cast("int"))


def _sizes(texts: DataFrame) -> DataFrame:
    return texts.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def _cross_links(cut: DataFrame, links: DataFrame, meet, chunk_texts: int, chunk_bytes: int, rows: int) -> DataFrame | None:
    """The links between different classes of the groups in ``cut`` (id, fp, body, size, grp); ``links`` made the classes.

    The texts outside a group's largest class meet all its texts, chunk by chunk. Where one class holds nearly all of
    a group, as with copies of one text, that is little more than one reading of the group.
    """
    roots = connected(links)
    cut = written(cut.join(roots, cut.id == roots.node, "left").select("id", "fp", "body", "size", "grp", F.coalesce("root", "id").alias("cls")), "classes")
    classes = cut.groupBy("grp", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    groups = classes.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "bytes", "cls")).alias("top"))
    groups = written(groups.where("n > top.n"), "groups")
    if groups.isEmpty():
        return None
    ceil = lambda n, b: F.greatest(F.lit(1), F.ceil(n / chunk_texts), F.ceil(b / chunk_bytes)).cast("int")
    plan = groups.select("grp", F.col("top.cls").alias("main"), ceil(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("few"), ceil(F.col("n"), F.col("bytes")).alias("all"))
    cut = joined_evenly(cut, plan, ["grp"], groups.select("grp", "n"), rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["id", "fp", "body", "grp", "cls"]
    rest = cut.where("cls != main").select(*kept, F.lit(0).alias("side"), F.pmod(F.xxhash64("id", F.lit(-1)), "few").cast("int").alias("i"), every("all").alias("j"))
    whole = cut.select(*kept, F.lit(1).alias("side"), every("few").alias("i"), F.pmod(F.xxhash64("id", F.lit(-2)), "all").cast("int").alias("j"))
    return rest.unionByName(whole).groupBy("grp", "i", "j").applyInArrow(meet, _LINKS)


def _alike_tops(rows: DataFrame, shingle: int, repeats: bool, budget: int, words: int, similarity: float, chunk_texts: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (rid, text) to the words' hashes of each (rid, lo, hi), and for each different one (lo, hi, id, n, top).

    id is the first row with these words, n how many have them, top the first row of the whole class.
    """

    @F.arrow_udf("struct<fp:long,lo:long,hi:long,size:long>")
    def look(column: pa.Array) -> pa.Array:
        texts = [x or b"" for x in (v.as_py() for v in column)]
        folded = [b" ".join(x.translate(LOWER_BYTES).split()) for x in texts]
        prints = np.fromiter((simhash_of(x, shingle, repeats) for x in folded), np.uint64, len(texts)).view(np.int64)
        lo = np.fromiter(map(xxhash.xxh3_64_intdigest, folded), np.uint64, len(texts)).view(np.int64)
        hi = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in folded), np.uint64, len(texts)).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(prints), pa.array(lo), pa.array(hi), pa.array(list(map(len, folded)), pa.int64())], ["fp", "lo", "hi", "size"])

    body = F.coalesce("text", F.lit("")).cast("binary")
    seen = written(rows.select("rid", look(body).alias("k")).select("rid", "k.*"), "prints")
    total = seen.count()
    nodes = written(seen.groupBy("lo", "hi").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.min("rid").alias("id"), F.count(F.lit(1)).alias("n")), "nodes")
    prints = written(nodes.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "prints")
    roots = connected(hamming_links(prints.select("fp", "id"), budget))
    grouped = written(prints.join(roots, prints.id == roots.node, "left").select("fp", "n", F.coalesce("root", "id").alias("grp")), "groups")
    placed = joined_evenly(nodes.select("id", "fp", "size"), grouped.select("fp", "grp"), ["fp"], grouped.select("fp", "n"), total)
    placed = written(placed, "placed")
    placed = _chunked(placed, written(_sizes(placed).where("n > 1"), "sizes"), total, chunk_texts, chunk_bytes)
    # the text of a node is that of its first row
    texts = written(rows.select("rid", body.alias("body")).join(placed, F.col("rid") == F.col("id")).drop("rid"), "texts")
    meet = _meeting(budget, words, similarity)
    cut = texts.where("chunks > 1")
    links = [written(texts.groupBy("grp", "chunk").applyInArrow(meet, _LINKS), "alike")]
    if not cut.isEmpty():
        heads, before = cut, -1
        for turn in range(1, 65):  # the first texts of classes meet in turn, while that joins many of them
            heads = written(heads.join(links[-1].select(F.col("u").alias("id")), "id", "left_anti").select("id", "fp", "body", "size", "grp"), "heads")
            sizes = written(_sizes(heads).where("n > 1"), "sizes")
            left = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
            if not left or 0 <= before and left > 0.7 * before:
                break
            before = left
            links.append(written(_chunked(heads, sizes, total, chunk_texts, chunk_bytes, turn).groupBy("grp", "chunk").applyInArrow(meet, _LINKS), "alike"))
        all_links = links[0]
        for more in links[1:]:
            all_links = all_links.unionAll(more)
        crossed = _cross_links(cut, all_links, meet, chunk_texts, chunk_bytes, total)
        if crossed is not None:
            links.append(crossed)
    joined = links[0]
    for more in links[1:]:
        joined = joined.unionAll(more)
    joined = connected(joined)
    tops = nodes.select("lo", "hi", "id", "n").join(joined, F.col("id") == joined.node, "left").select("lo", "hi", "id", "n", F.coalesce("root", "id").alias("top"))
    return seen.select("rid", "lo", "hi"), written(tops, "tops")


def alike_groups(docs: DataFrame, shingle: int, budget: int, words: int, similarity: float, chunk_texts: int = 2000, chunk_bytes: int = 8 << 20, repeats: bool = True) -> DataFrame:
    """``docs`` (doc_id, text; ids unique) to (doc_id, component_id), one row per input row.

    Texts are linked if their SimHashes differ in at most ``budget`` bits and the Jaccard of their sets of
    ``words``-word shingles is ``similarity`` at least; texts of the same words always are. SimHash groups
    only say which texts may meet. Groups over ``chunk_texts`` different texts or ``chunk_bytes`` are cut into
    chunks; texts meet within chunks, then the first texts of the classes found meet in turn, and at last
    the texts outside a group's largest class meet all of the group, so no link between classes is lost.
    """
    rows = docs.select(F.col("doc_id").alias("rid"), "text")
    seen, tops = _alike_tops(rows, shingle, repeats, budget, words, similarity, chunk_texts, chunk_bytes)
    placed = joined_evenly(seen, tops.select("lo", "hi", "top"), ["lo", "hi"], tops.select("lo", "hi", "n"), seen.count())
    return placed.select(F.col("rid").alias("doc_id"), F.col("top").alias("component_id"))


def near_dedup(docs: DataFrame, shingle: int = 4, budget: int = 4, similarity: float | None = None, words: int = 5, repeats: bool = True) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id stays; columns unchanged.

    With ``similarity`` the SimHash links are candidates only: a pair counts if the Jaccard of its sets of
    ``words``-word shingles is at least that. Rows that share a doc_id, or have none, are documents of their own, in
    the order of keyed(): a null id comes last, so it goes where any other of its group has an id. Null texts and
    texts without words are copies of each other.
    """
    rows = keyed(docs)
    texts = rows.select("rid", F.col("row.text").alias("text"))
    if similarity is None:
        groups = simhash_groups(texts.withColumnRenamed("rid", "doc_id"), shingle, budget)
        keep = groups.where("doc_id = component_id").select(F.col("doc_id").alias("rid"))
    else:
        tops = _alike_tops(texts, shingle, repeats, budget, words, similarity, 2000, 8 << 20)[1]
        keep = tops.where("id = top").select(F.col("id").alias("rid"))
    kept = rows.join(keep, "rid", "left_semi")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
