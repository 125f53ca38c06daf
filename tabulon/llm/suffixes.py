"""Repeated byte strings across a corpus, by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (smaller doc_id, or
the same document further left). Three steps find these strings without ever comparing all texts:

1. Every string of ``length`` bytes names an anchor, the least hash among its 32-byte grams, so
   equal strings name equal anchors. A run of neighbouring strings with one anchor is a segment.
   Segments with an anchor of their own cannot repeat and end here; of segments with equal
   content all but the earliest are repeats as a whole. Both happen on 64-bit pairs of hashes,
   pre-aggregated in the task that reads the text.
2. Segments that share an anchor but differ are dealt to shards by anchor. A shard gets a suffix
   array (Larsson-Sadakane refinement in numpy) and its common prefixes (Kasai), which give the
   classes of equal strings and the earliest of each.
3. An anchor with too many segments for one shard is cut into several; the sorted class
   representatives of its shards are dealt by range of hash and merged run by run with binary search.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_values, byte_batches, keyed, ranges, released, table, written

GRAM = 32
#: Bytes of text hashed at once, the most a shard's suffix array holds, and segments of one anchor in a shard.
BUFFER, SHARD_BYTES, ANCHOR_CAP = 1 << 20, 1 << 21, 8000
#: An anchor with this many different segments in one reading task skips step 1 and goes to the shards.
BUSY = 64
#: Rows of 16 bytes that are small enough to send to every task.
MOST_SENT = 100_000

ROW, REPEAT, CHECK, MARK = range(4)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_HASH = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes that start at each place, by doubling."""
    h = _BYTE_HASH[data]
    for span in (1, 2, 4, 8, 16):
        h = h[:-span] * np.uint64(0xD6E8FEB86659FD93) + h[span:]
        h ^= h >> np.uint64(29)
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def segments(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Segments of the texts in ``data`` (cut at ``bounds``): text number, start in data, strings, anchor hash, content hash."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < length:
        return none
    h = gram_hashes(data)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    anchor = (_least(key, length - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        anchor[max(lo, hi - length + 1) : hi] = -1
    start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    strings = np.diff(np.r_[start, len(anchor)])
    real = anchor[start] >= 0
    start, strings = start[real], strings[real]
    text = np.searchsorted(bounds, start, "right") - 1
    raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(raw[a:b]) for a, b in zip(start.tolist(), (start + strings + length - 1).tolist())), np.uint64, len(start))
    return text, start, strings, h[anchor[start]], content


def _pieces(batch: pa.RecordBatch, length: int):
    """(rid, offset in the text, bytes, bounds) by buffer; a text over a buffer comes in overlapping pieces."""
    rid = batch.column(0).to_numpy()
    data, bounds = binary_values(batch.column(1))
    for i in range(len(rid)):
        if bounds[i + 1] - bounds[i] > 4 * BUFFER:
            break
    else:
        yield rid, np.zeros(len(rid), np.int64), data, bounds
        return
    for i in range(len(rid)):
        text = data[bounds[i] : bounds[i + 1]]
        for at in range(0, max(1, len(text) - length + 1), BUFFER):
            part = text[at : at + BUFFER + length - 1]
            yield rid[i : i + 1], np.array([at]), part, np.array([0, len(part)])


def _rows(deal, content, rid, place, strings, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(deal.view(np.int64)), pa.array(content.view(np.int64)), pa.array(rid), pa.array(place), pa.array(strings.astype(np.int32)), pa.array(np.broadcast_to(np.int8(kind), len(rid)) if np.isscalar(kind) else kind)],
        names=["deal", "content", "rid", "place", "strings", "kind"],
    )


SEGMENT_SCHEMA = "deal long, content long, rid long, place long, strings int, kind byte"


def joined_runs(rid: np.ndarray, place: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs that touch, made one."""
    order = np.lexsort((place, rid))
    rid, place, strings = rid[order], place[order], strings[order]
    if not len(rid):
        return rid, place, strings
    new = np.r_[True, (rid[1:] != rid[:-1]) | (place[1:] > place[:-1] + strings[:-1])]
    at = np.flatnonzero(new)
    last = np.maximum.reduceat(place + strings, at)
    return rid[at], place[at], last - place[at]


def _reading(length: int):
    def run(batches):
        held, size = [], 0
        for batch in byte_batches(batches, BUFFER):
            for rid, base, data, bounds in _pieces(batch, length):
                text, start, strings, anchor, content = segments(data, bounds, length)
                held.append((rid[text], start - bounds[text] + base[text], strings, anchor, content))
                size += len(text)
            if size > 1_500_000:
                yield from settle(held)
                held, size = [], 0
        if size:
            yield from settle(held)

    def settle(held):
        rid, place, strings, anchor, content = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((place, rid, content, anchor))
        rid, place, strings, anchor, content = (x[order] for x in (rid, place, strings, anchor, content))
        other = np.r_[True, anchor[1:] != anchor[:-1]]
        first = other | np.r_[True, content[1:] != content[:-1]]
        again = joined_runs(rid[~first], place[~first], strings[~first])
        rid, place, strings, anchor, content, other = (x[first] for x in (rid, place, strings, anchor, content, other))
        sizes = np.diff(np.r_[np.flatnonzero(other), len(other)])
        busy = np.repeat(sizes >= BUSY, sizes)
        calm = ~busy
        yield _rows(anchor[calm], content[calm], rid[calm], place[calm], strings[calm], ROW)
        if len(again[0]):
            yield _rows(_mixed(again[0].view(np.uint64)), np.zeros(len(again[0]), np.uint64), *again, REPEAT)
        if busy.any():
            spread = _mixed(rid[busy].view(np.uint64) + place[busy].view(np.uint64))
            yield _rows(spread, anchor[busy], rid[busy], place[busy], strings[busy], CHECK)
            marks = np.unique(anchor[busy])
            zero = np.zeros(len(marks), np.int64)
            yield _rows(marks, zero.view(np.uint64), zero, zero, zero, MARK)

    return run


def _settle_equal(batches):
    """Of a dealt partition: repeats as they are, whole repeated segments, and segments to check."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    whole = pa.Table.from_batches(parts)
    deal, content, rid, place, strings, kind = (whole.column(i).to_numpy() for i in range(6))
    done = kind == REPEAT
    sent = kind == CHECK
    out = [(rid[done], place[done], strings[done].astype(np.int64))]
    checks = [(content[sent], rid[sent], place[sent], strings[sent])]
    plain = (kind == ROW) | (kind == MARK)
    deal, content, rid, place, strings, kind = (x[plain] for x in (deal, content, rid, place, strings, kind))
    order = np.argsort(deal)
    alone = np.r_[True, deal[order][1:] != deal[order][:-1]]
    alone &= np.r_[alone[1:], True]
    order = order[~alone]
    deal, content, rid, place, strings, kind = (x[order] for x in (deal, content, rid, place, strings, kind))
    order = np.lexsort((place, rid, content, kind, deal))
    deal, content, rid, place, strings, kind = (x[order] for x in (deal, content, rid, place, strings, kind))
    if len(deal):
        other = np.r_[True, deal[1:] != deal[:-1]]
        mark = kind == MARK
        first = other | mark | np.r_[True, (content[1:] != content[:-1]) | (kind[1:] != kind[:-1])]
        out.append((rid[~first], place[~first], strings[~first].astype(np.int64)))
        group = np.cumsum(other) - 1
        heads = np.bincount(group, weights=first & ~mark)
        marked = np.bincount(group, weights=mark) > 0
        check = first & ~mark & ((heads > 1) | marked)[group]
        checks.append((deal[check], rid[check], place[check], strings[check]))
    a = joined_runs(*(np.concatenate(x) for x in zip(*out)))
    b = tuple(np.concatenate(x) for x in zip(*checks))
    n, m = len(a[0]), len(b[0])
    for lo in range(0, n, 200_000):
        x = [v[lo : lo + 200_000] for v in a]
        yield _rows(np.zeros(len(x[0]), np.int64), np.zeros(len(x[0]), np.int64), *x, REPEAT)
    for lo in range(0, m, 200_000):
        x = [v[lo : lo + 200_000] for v in b]
        yield _rows(x[0], np.zeros(len(x[0]), np.int64), x[1], x[2], x[3], CHECK)


def _groups(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of at most 2^21 bytes.

    Larsson-Sadakane: suffixes are sorted by their first 4 bytes; then only groups still tied are
    sorted again, by the rank of the suffix as far on as is known, so the known part doubles.
    """
    n = len(text)
    if n > SHARD_BYTES:
        raise ValueError("a suffix array holds at most 2^21 bytes")
    # places beyond the end count as 0, which no byte does, so no two suffixes stay equal
    wide = np.r_[text.astype(np.uint64) + np.uint64(1), np.zeros(4, np.uint64)]
    first = (wide[:n] << np.uint64(27)) | (wide[1 : n + 1] << np.uint64(18)) | (wide[2 : n + 2] << np.uint64(9)) | wide[3 : n + 3]
    mask = np.uint64(SHARD_BYTES - 1)
    packed = np.sort((first << np.uint64(21)) | np.arange(n, dtype=np.uint64))
    order = (packed & mask).astype(np.int64)
    heads = _groups(packed >> np.uint64(21))
    sizes = np.diff(np.r_[heads, n])
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(heads, sizes)
    rank[n] = 0
    tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
    known = 4
    while len(tied):
        at = order[tied]
        ahead = np.minimum(at + known, n)
        beyond = np.where(ahead < n, rank[ahead] + 1, 0).astype(np.uint64)
        beyond = np.minimum(beyond, mask)
        here = rank[at].astype(np.uint64)
        packed = np.sort((here << np.uint64(42)) | (beyond << np.uint64(21)) | np.arange(len(tied), dtype=np.uint64))
        order[tied] = at[(packed & mask).astype(np.int64)]
        pair = packed >> np.uint64(21)
        heads = _groups(pair)
        sizes = np.diff(np.r_[heads, len(tied)])
        rank[order[tied]] = np.repeat(tied[heads], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        known *= 2
    return order


def kasai(text: np.ndarray, order: np.ndarray, most: int, lanes: int = 4096) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, up to ``most`` bytes.

    The prefix found at a place, less one, holds at the next place, so nothing is compared twice.
    ``lanes`` stretches of the text go forward in step, each with a prefix of its own.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    pad = np.r_[text, np.zeros(most + 16, np.uint8)].astype(np.uint64)
    word = np.zeros(n + most + 8, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | pad[i : i + len(word)]
    lcp = np.zeros(n, np.int64)
    stride = -(-n // lanes)
    at = np.arange(0, n, stride, dtype=np.int64)
    stop = np.minimum(at + stride, n)
    have = np.zeros(len(at), np.int64)
    steps = [np.uint64(1) << np.uint64(b) for b in range(8, 64, 8)]
    for _ in range(stride):
        on = at < stop
        if not on.all():
            at, stop, have = at[on], stop[on], have[on]
        spot = place[at]
        before = order[np.maximum(spot - 1, 0)]
        go = np.flatnonzero(spot > 0)
        have[spot == 0] = 0
        while len(go):
            x = word[at[go] + have[go]] ^ word[before[go] + have[go]]
            same = sum((x < s).astype(np.int64) for s in steps) + (x == 0)
            have[go] += same
            go = go[(same == 8) & (have[go] < most)]
        end = np.minimum(n - np.maximum(at, before), most)
        np.minimum(have, end, out=have)
        lcp[spot] = np.where(spot > 0, have, 0)
        have = np.maximum(have - 1, 0)
        at = at + 1
    return lcp


def repeated_strings(text: np.ndarray, starts: np.ndarray, strings: np.ndarray, rid: np.ndarray, place: np.ndarray, length: int):
    """Of the strings that start in segments: rows (segment, string) that repeat, and the first ones in sorted order."""
    order = suffix_array(text)
    lcp = kasai(text, order, length)
    owner = np.full(len(text), -1, np.int64)
    spots = ranges(starts, strings)
    owner[spots] = np.repeat(np.arange(len(starts)), strings)
    group = np.cumsum(lcp < length)
    which = owner[order]
    real = which >= 0
    spot, which, group = order[real], which[real], group[real]
    string = spot - starts[which]
    row, at = rid[which], place[which] + string
    by = np.lexsort((at, row, group))
    first = np.zeros(len(by), bool)
    first[by[_groups(group[by])]] = True
    return which[~first], string[~first], spot[first], which[first], string[first]


def _sharding(length: int):
    """Shards of whole anchors: what repeats in each, and for cut anchors the first strings as runs."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        whole = pa.Table.from_batches(batches)
        key, part, parts, rid, place = (whole.column(c).to_numpy() for c in ("key", "part", "parts", "rid", "place"))
        strings = whole.column("strings").to_numpy().astype(np.int64)
        data, bounds = binary_values(whole.column("segment"))
        by = np.lexsort((place, rid, part, key))
        key_, part_ = key[by], part[by]
        heads = np.flatnonzero(np.r_[True, (key_[1:] != key_[:-1]) | (part_[1:] != part_[:-1])])
        ends = np.r_[heads[1:], len(by)]
        sizes = np.add.reduceat(np.diff(bounds)[by] + 1, heads)
        at = 0
        while at < len(heads):
            to, total = at + 1, sizes[at]
            while to < len(heads) and total + sizes[to] <= SHARD_BYTES - 8:
                total += sizes[to]
                to += 1
            yield from shard(by[heads[at] : ends[to - 1]], key, part, parts, rid, place, strings, data, bounds)
            at = to

    def shard(rows, key, part, parts, rid, place, strings, data, bounds):
        sizes = (bounds[1:] - bounds[:-1])[rows]
        starts = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros(int((sizes + 1).sum()), np.uint8)
        text[ranges(starts, sizes)] = data[ranges(bounds[rows], sizes)]
        which, string, spot, own, own_string = repeated_strings(text, starts, strings[rows], rid[rows], place[rows], length)
        a = joined_runs(rid[rows][which], place[rows][which] + string, np.ones(len(which), np.int64))
        yield _found(a[0], a[1], a[2], np.zeros(len(a[0]), np.int64), np.zeros(len(a[0]), np.int64), None)
        shared = parts[rows][own] > 0
        spot, own, own_string = spot[shared], own[shared], own_string[shared]
        if not len(spot):
            return
        # sorted runs for the merge, one for each anchor, shard and range of hashes
        content = text[spot[:, None] + np.arange(length)]
        fold = np.zeros(len(spot), np.uint64)
        for i in range(0, length, 7):
            fold = _mixed(fold * np.uint64(31) + np.ascontiguousarray(np.pad(content[:, i : i + 7], ((0, 0), (0, 8 - min(7, length - i))))).view(np.uint64)[:, 0])
        slot = (fold % parts[rows][own].astype(np.uint64)).astype(np.int64)
        of = rows[own]
        by = np.lexsort((slot, part[of], key[of]))
        heads = np.flatnonzero(np.r_[True, (key[of][by][1:] != key[of][by][:-1]) | (part[of][by][1:] != part[of][by][:-1]) | (slot[by][1:] != slot[by][:-1])])
        for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(by)]):
            run_ = by[lo:hi]
            packed = content[run_].tobytes() + rid[of[run_]].tobytes() + (place[of[run_]] + own_string[run_]).tobytes()
            one = lambda x: np.array([x], np.int64)
            yield _found(one(slot[run_[0]]), one(0), one(len(run_)), key[of[run_[:1]]], part[of[run_[:1]]], packed)

    return run


FOUND_SCHEMA = "rid long, place long, strings long, key long, part long, content binary"


def _found(rid, place, strings, key, part, packed: bytes | None) -> pa.RecordBatch:
    content = pa.nulls(len(rid), pa.binary()) if packed is None else pa.array([packed], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (rid, place, strings, key, part.astype(np.int64))] + [content], names=["rid", "place", "strings", "key", "part", "content"])


def merged_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted runs (strings, owners) merged in pairs by binary search; owners that lose to an earlier one are listed."""
    lost: list[np.ndarray] = []
    while len(runs) > 1:
        after = []
        for i in range(0, len(runs) - 1, 2):
            (a, own_a), (b, own_b) = runs[i], runs[i + 1]
            spot = np.searchsorted(a, b)
            same = (spot < len(a)) & (a[np.minimum(spot, len(a) - 1)] == b)
            hit = spot[same]
            lost.append(np.maximum(own_a[hit], own_b[same]))
            own_a = own_a.copy()
            own_a[hit] = np.minimum(own_a[hit], own_b[same])
            new = ~same
            after.append((np.insert(a, spot[new], b[new]), np.insert(own_a, spot[new], own_b[new])))
        runs = after + runs[len(runs) - len(runs) % 2 :]
    return (*runs[0], lost)


def _merging(length: int):
    def run(rows: pa.Table) -> pa.Table:
        """All runs of one anchor and range of hashes."""
        runs, rid, place = [], [], []
        for packed, n in zip(rows.column("content").to_pylist(), rows.column("strings").to_pylist()):
            runs.append(np.frombuffer(packed, f"S{length}", n))
            rid.append(np.frombuffer(packed, np.int64, n, n * length))
            place.append(np.frombuffer(packed, np.int64, n, n * (length + 8)))
        sizes = np.cumsum([0, *map(len, runs)])
        rid, place = np.concatenate(rid), np.concatenate(place)
        by_age = np.lexsort((place, rid))
        age = np.empty(len(rid), np.int64)
        age[by_age] = np.arange(len(rid))
        lost = merged_runs([(r, age[a:b]) for r, a, b in zip(runs, sizes[:-1], sizes[1:])])[2]
        gone = by_age[np.concatenate(lost)] if lost else np.zeros(0, np.int64)
        return pa.table(dict(zip(("rid", "place", "strings"), joined_runs(rid[gone], place[gone], np.ones(len(gone), np.int64)))))

    return run


def repeats(texts: DataFrame, length: int = 100) -> DataFrame:
    """``texts`` (rid long, unique; body binary) to runs (rid, place, strings) of strings that start earlier elsewhere."""
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    spark = texts.sparkSession
    total = texts.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("b")).first()["b"]
    tasks = max(12, total // (12 << 20))
    rows = texts.select("rid", "body").mapInArrow(_reading(length), SEGMENT_SCHEMA)
    settled = written(rows.repartition(int(tasks), "deal").mapInArrow(_settle_equal, SEGMENT_SCHEMA), "segments")
    released(spark)
    equal = settled.where(F.col("kind") == REPEAT).select("rid", "place", F.col("strings").cast("long").alias("strings"))
    check = settled.where(F.col("kind") == CHECK).select(F.col("deal").alias("key"), "rid", "place", "strings")
    sizes = check.groupBy("key").count()
    # an anchor's segments are at most 2 x length bytes each, and must fit a suffix array
    cap = min(ANCHOR_CAP, SHARD_BYTES * 3 // 4 // (2 * length))
    over = F.col("count") > cap
    m = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count_if(over).alias("cut")).first()
    if not m["n"]:
        return equal
    if m["cut"]:
        big = sizes.where(over).select("key", F.ceil(F.col("count") / max(1, cap // 2)).alias("parts"))
        # anchors to cut are few where the corpus is not huge; the join by key would gather each in one task
        dealt = check.join(F.broadcast(big) if m["cut"] <= MOST_SENT else big, "key", "left")
    else:
        dealt = check.withColumn("parts", F.lit(None).cast("long"))
    dealt = dealt.select("key", "rid", "place", "strings", F.coalesce(F.pmod(F.xxhash64("rid", "place"), "parts"), F.lit(0)).alias("part"), F.coalesce("parts", F.lit(0)).alias("parts"))
    lists = dealt.groupBy("rid").agg(F.collect_list(F.struct("key", "place", "strings", "part", "parts")).alias("segments"))
    cut_out = texts.join(lists, "rid").select("rid", "body", F.explode("segments").alias("s"))
    cut_out = cut_out.select("s.key", "s.part", "s.parts", "rid", "s.place", "s.strings", F.expr(f"substring(body, cast(s.place + 1 as int), s.strings + {length - 1})").alias("segment"))
    shards = max(12, m["n"] // 40_000)
    found = written(cut_out.repartition(int(shards), "key", "part").mapInArrow(_sharding(length), FOUND_SCHEMA), "shards")
    released(spark)
    out = equal.unionAll(found.where("content is null").select("rid", "place", "strings"))
    if m["cut"]:
        firsts = found.where("content is not null")
        out = out.unionAll(firsts.groupBy("key", F.col("rid").alias("slot")).applyInArrow(_merging(length), "rid long, place long, strings long"))
    return out


_KEPT = {
    "bytes": ("binary", pa.binary(), lambda x: x),
    "sha256": ("string", pa.string(), lambda x: hashlib.sha256(x).hexdigest()),
    "text": ("string", pa.string(), lambda x: x.decode("utf-8", "ignore")),
}


def _whole_characters(raw: bytes, start: list[int], stop: list[int]) -> None:
    """Widens spans to the characters that they touch."""
    for i in range(len(start)):
        while start[i] and raw[start[i]] & 0xC0 == 0x80:
            start[i] -= 1
        while stop[i] < len(raw) and raw[stop[i]] & 0xC0 == 0x80:
            stop[i] += 1


def _cutting(length: int, kept: str) -> Column:
    name, kind, form = _KEPT[kept]

    @F.arrow_udf(f"struct<n_bytes:long,n_removed:long,n_spans:long,kept:{name}>")
    def cut(body: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for i in range(len(body)):
            raw = body[i].as_py()
            if not runs[i].is_valid:
                out.append((len(raw), 0, 0, form(raw)))
                continue
            own = runs[i].values
            start, count = own.field("place").to_numpy(), own.field("strings").to_numpy()
            by = np.argsort(start, kind="stable")
            start, stop = start[by], (start + count + length - 1)[by]
            reach = np.maximum.accumulate(stop)
            at = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
            start, stop = start[at].tolist(), np.maximum.reduceat(stop, at).tolist()
            removed = sum(stop) - sum(start)
            if kept == "text":
                _whole_characters(raw, start, stop)
            rest = b"".join(raw[a:b] for a, b in zip([0, *stop], [*start, len(raw)]))
            out.append((len(raw), removed, len(start), form(rest)))
        columns = list(zip(*out)) if out else [()] * 4
        return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], kind)], ["n_bytes", "n_removed", "n_spans", "kept"])

    return cut


def cut_repeats(docs: DataFrame, length: int = 100, kept: str = "bytes") -> DataFrame:
    """``docs`` (doc_id, text, any more columns) to (row, cut): the row as a struct, and (n_bytes, n_removed, n_spans, kept).

    ``kept`` is what is left, as "bytes", as its "sha256", or as "text"; in a text, a character of
    which a byte is removed goes whole.

    A byte is removed if a ``length``-byte string that covers it also starts earlier; strings are
    judged on the input texts as UTF-8 bytes and never cross documents. Null texts are empty; texts
    shorter than ``length`` are kept whole; repeated rows are documents of their own, see keyed().
    """
    rows = keyed(docs)
    body = F.col("row.text").cast("binary")
    texts = rows.select("rid", body.alias("body"))
    runs = repeats(texts, length)
    per_text = runs.groupBy("rid").agg(F.collect_list(F.struct("place", "strings")).alias("_runs"))
    joined = rows.join(per_text, "rid", "left")
    return joined.select("row", _cutting(length, kept)(F.coalesce(body, F.lit(b"")), F.col("_runs")).alias("cut"))


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = cut_repeats(docs, 100, "sha256")
    return rows.select("row.doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.col("cut.kept").alias("kept_sha256"))
