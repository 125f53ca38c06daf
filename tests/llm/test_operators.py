"""Each operator over hand-made tables: against brute force, and with nulls, empty and long texts, ties, repeated rows,
empty tables and clashing column names."""

import hashlib
import re
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
import xxhash

from tabulon.llm import fingerprints, mixing, neighbours, packing, pseudolikelihood, quality, simhash, suffixes, toxicity, urls
from tabulon.llm.common import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, copies int, rid string, row int, fp string, component_id string"


def prose(seed, n):
    random = np.random.default_rng(seed)
    return " ".join(random.choice(WORDS, n).tolist())


def texts():
    shared = prose(1, 40)
    base = prose(2, 120)
    return [
        (0, base, "en", "a"),
        (1, base, "en", "a"),  # an exact copy
        (2, base.replace("alpha", "ALPHA", 1), "en", "b"),
        (3, prose(3, 30) + " " + shared + " " + prose(4, 30), "en", None),
        (4, prose(5, 10) + "\n" + shared + "\n" + prose(6, 10), "de", "b"),
        (5, None, None, None),
        (6, "", "en", "c"),
        (7, "   \n\t ", "fr", "c"),
        (8, "one", "fr", "a"),
        (9, "ab" * 400, "fr", "a"),  # repeats itself
        (10, "é字😀 " * 60 + shared, "es", "b"),
        (11, prose(7, 6000), "en", "a"),  # long
        (12, "Ünïcode only ß", "de", "ä"),
        (14, "zero \x00\x00 bytes \x00" + shared, "en", "b"),
        (13, "one", "en", None),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), "x", 9, "r", 7, "f", "c") for i, t, l, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts()).cache()


@pytest.fixture(scope="module")
def repeated(spark):
    rows = texts()
    return frame(spark, [*rows, rows[0], rows[3], rows[3], (None, "no id " + rows[3][1], "en", "a"), (None, None, "en", "a")])


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# -- suffix-array dedup


def cut_plainly(rows, length=100):
    seen, out = set(), []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def cut(df):
    return [(r["row"]["doc_id"], *r["cut"]) for r in suffixes.cut_repeats(df, 100, "sha256").collect()]


def key(row):
    return tuple((v is None, v) for v in row)


def test_suffix_dedup(docs, repeated, none):
    rows = sorted((i, t) for i, t, _, _ in texts())
    assert sorted(cut(docs)) == cut_plainly(rows)
    # rows that share an id count in the order of their texts; null ids come last
    rows = sorted(((r["doc_id"], r["text"]) for r in repeated.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert sorted(cut(repeated), key=key) == sorted(cut_plainly(rows), key=key)
    assert cut(none) == []


def test_suffix_dedup_with_cut_anchors(docs, monkeypatch):
    monkeypatch.setattr(suffixes, "ANCHOR_CAP", 2)
    monkeypatch.setattr(suffixes, "BUSY", 2)
    monkeypatch.setattr(suffixes, "BUFFER", 512)
    assert sorted(cut(docs)) == cut_plainly(sorted((i, t) for i, t, _, _ in texts()))


def test_cut_texts_keep_whole_characters(docs):
    for r in suffixes.cut_repeats(docs, 100, "text").collect():
        assert "�" not in r["cut"]["kept"]
        if not r["cut"]["n_removed"]:
            assert r["cut"]["kept"] == (r["row"]["text"] or "")


# -- SimHash


def plain_simhash(text, shingle=4, repeats=True):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    k = min(shingle, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    h = h if repeats else sorted(set(h))
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows):
    prints = np.array([plain_simhash(t) for _, t in rows], np.uint64)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(int(prints[i] ^ prints[j])).count("1") <= 4]
    label = components(len(rows), np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int))
    low = {}
    for n, (i, _) in zip(label, rows):
        if i is not None:
            low[n] = min(low.get(n, i), i)
    return sorted(((i, int(p), low.get(n)) for (i, _), p, n in zip(rows, prints, label)), key=key)


@pytest.mark.parametrize("name", ["docs", "repeated", "none"])
def test_simhash_groups(name, request):
    df = request.getfixturevalue(name)
    got = sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_groups(df).collect()), key=key)
    assert got == plain_groups([(r["doc_id"], r["text"]) for r in df.collect()])


def test_hamming_links_cut_groups_and_chains(spark):
    random = np.random.default_rng(8)
    # a chain, each 4 bits from the one before, and a ball that fills its groups
    chain = [int(random.integers(0, 2**62))]
    for i in range(12):
        chain.append(chain[-1] ^ (0b1111 << (4 * i)))
    ball = [(5 << 40) ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(16, 30)]
    prints = sorted({*chain, *ball})
    df = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, id long")
    links = simhash.hamming_links(df, 4, group_cap=20, rows_per_task=300).collect()
    from tabulon.llm.components import connected

    roots = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "u long, v long")).collect()}
    at = {p: i for i, p in enumerate(prints)}
    assert {roots[at[p]] for p in chain} == {at[min(chain)]} and {roots[at[p]] for p in ball} == {at[min(ball)]}


def test_near_dedup(docs, repeated):
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    for df in (docs, repeated):
        rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
        prints = np.array([plain_simhash(t) for _, t in rows], np.uint64)
        pairs = [(i, j) for i in range(len(rows)) for j in range(i) if bin(int(prints[i] ^ prints[j])).count("1") <= 4]
        label = components(len(rows), np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int))
        want = [rows[i] for i in range(len(rows)) if label[i] == i]
        assert sorted(((r["doc_id"], r["text"]) for r in simhash.near_dedup(df).collect()), key=key) == sorted(want, key=key)


def test_near_dedup_of_rows_without_ids(spark):
    rows = [(None, prose(60, 50)), (None, prose(60, 50)), (None, prose(61, 50)), (7, prose(61, 50)), (8, prose(62, 50))]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 1, 8, 0.8, repeats=False).collect()
    assert sorted(map(tuple, kept), key=key) == sorted([rows[0], rows[3], rows[4]], key=key)


def test_a_giant_component_and_hot_keys(spark, monkeypatch):
    from tabulon.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_SHARE", 10**9)
    base = prose(70, 60).split()
    rows = [(i, " ".join([*base, f"tail{i % 40}"])) for i in range(200)] + [(1000 + i, prose(300 + i, 60)) for i in range(40)] + [(2000 + i, "") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_groups(df).collect()), key=key)
    assert got == plain_groups(rows)
    twice = spark.createDataFrame([*rows, *rows[:20], (None, rows[3][1])], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_groups(twice).collect()), key=key)
    assert got == plain_groups([*rows, *rows[:20], (None, rows[3][1])])
    groups = {r["doc_id"]: r["component_id"] for r in simhash.alike_groups(df, 1, 8, 5, 0.8, chunk_texts=6, repeats=False).collect()}
    assert {groups[i] for i in range(200)} == {0} and len({groups[1000 + i] for i in range(40)}) == 40 and {groups[2000 + i] for i in range(30)} == {2000}


def test_numbering_cannot_be_held_up_by_rows_that_agree(spark):
    from tabulon.llm.common import keyed

    df = spark.createDataFrame([(5, "same", i % 3) for i in range(300)] + [(None, None, 1)] * 50 + [(4, "first", 0)], "doc_id long, text string, rid int").repartition(7)
    rows = keyed(df).orderBy("rid").collect()
    assert [r["rid"] for r in rows] == list(range(351))
    assert [r["row"]["doc_id"] for r in rows] == [4] + [5] * 300 + [None] * 50
    like = [r["row"]["rid"] for r in rows[1:301]]
    assert len({(a, b) for a, b in zip(like, like[1:])}) <= 3 + 2  # rows alike in all stand together


@pytest.mark.parametrize("chunk, shingle, repeats", [(2000, 2, True), (7, 2, True), (3, 1, False)])
def test_near_copies_are_confirmed(spark, chunk, shingle, repeats):
    random = np.random.default_rng(4)
    rows = []
    for base in range(6):
        words = prose(100 + base, 150).split()
        for k in (0, 0, 1, 1, 2, 3, 4, 6, 9, 14):  # from the same text to a similarity far below 0.8
            some = list(words)
            for at in random.choice(150, k, replace=False):
                some[at] = f"new{random.integers(1000)}"
            rows.append((len(rows), " ".join(some)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", None, " \n", "One", "one", "two", "a b c d", "a b c d e"])]

    def shingles(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)} if w else set()

    sets, prints = [shingles(t) for _, t in rows], [plain_simhash(t, shingle, repeats) for _, t in rows]
    pairs, linked = [], 0
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 8:
                linked += 1
                if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    pairs.append((i, j))
    assert 10 < len(pairs) < linked
    want = components(len(rows), np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])).tolist()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.alike_groups(df, shingle, 8, 5, 0.8, chunk_texts=chunk, repeats=repeats).collect()}
    assert [got[i] for i in range(len(rows))] == want
    assert sorted(r["doc_id"] for r in simhash.near_dedup(df, shingle, 8, 0.8, repeats=repeats).collect()) == sorted(set(want))


def test_near_dedup_keeps_different_texts_of_one_id(spark):
    rows = [(1, prose(50, 80)), (2, prose(50, 80)), (2, prose(51, 80)), (3, prose(52, 80)), (3, prose(53, 80)), (3, prose(53, 80))]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2, 8, 0.8).collect()
    assert sorted(map(tuple, kept)) == sorted({rows[0], *rows[2:]})


def test_connected_components_of_odd_links(spark):
    from tabulon.llm.components import connected

    links = spark.createDataFrame([(1, 1), (2, None), (9, 8), (8, 9), (7, 9), (3, 4)], "u long, v long")
    assert sorted((r["node"], r["root"]) for r in connected(links).collect()) == [(3, 3), (4, 3), (7, 7), (8, 7), (9, 7)]
    assert connected(links.limit(0)).collect() == []


# -- fingerprints


def test_fingerprints(docs, repeated, none):
    rows = sorted(((i, t or "") for i, t, _, _ in texts()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    for at, (i, t) in enumerate(rows):
        after, m = rows[(at + 1) % len(rows)][1], len(t) // 3
        assert (got[i]["n_chars"], got[i]["edited"]) == (len(t), t[: len(t) - m] + after[:m])
    assert got[0]["sketch"] == got[1]["sketch"] and got[5]["sketch"] == got[6]["sketch"] == []
    assert all(g["sketch"] for g in got.values() if plain_simhash(g["edited"]) and len(g["sketch"]) > 0)
    assert fingerprints.edited_fingerprints(repeated).count() == repeated.count()
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_one_document_is_its_own_next(spark):
    (r,) = fingerprints.edited_fingerprints(frame(spark, [(-(2**62), "abcdef", "en", "a")])).collect()
    assert r["edited"] == "abcdab" and r["sketch"] == r["next_sketch"]


def test_blocks_of_spread_ids(spark):
    random = np.random.default_rng(5)
    ids = np.unique(random.integers(-(2**62), 2**62, 2500)).tolist()
    df = frame(spark, [(i, f"text {i}", "en", "a") for i in ids])
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r["next"]["id"] for r in fingerprints.beside_next(df.select("doc_id", "text"), {"id": F.col("doc_id")}).collect()}
    down = ids[::-1]
    assert got == dict(zip(down, [*down[1:], down[0]]))


def test_one_far_id_and_null_ids_do_not_fill_a_block(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 50)
    far = spark.createDataFrame([(i, f"t{i}") for i in [*range(2000), 10**15]], "doc_id long, text string")
    nulls = spark.createDataFrame([(None, f"t{i}") for i in range(2000)], "doc_id long, text string")
    for df in (far, nulls):
        rows, lo, hi, blocks = fingerprints._even_rows(fingerprints.keyed(df).select("row.*", "rid"), 50, 1 << 17)
        fullest = rows.groupBy(fingerprints._block_of(F.col("_at"), lo, hi, blocks)).count().agg(F.max("count")).first()[0]
        assert fullest <= 100
    got = {r["doc_id"]: r["next"]["id"] for r in fingerprints.beside_next(far, {"id": F.col("doc_id")}, 50).collect()}
    down = sorted(got, reverse=True)
    assert got == dict(zip(down, [*down[1:], down[0]]))
    texts_ = [r["text"] for r in nulls.orderBy("text").collect()]
    got = {r["text"]: r["next"]["t"] for r in fingerprints.beside_next(nulls, {"t": F.col("text")}, 50).collect()}
    assert got == dict(zip(texts_[::-1], [*texts_[::-1][1:], texts_[-1]]))


def test_likeness_and_containment(spark):
    from pyspark.sql import functions as F

    a, b = prose(20, 3000), prose(21, 3000)
    df = spark.createDataFrame([(a, a + " " + b, b), ("", "", a), ("x", "x", "y")], "a string, b string, c string")
    s = df.select(*(fingerprints.sketch(F.col(c)).alias(c) for c in "abc"))
    got = s.select(fingerprints.containment(F.col("a"), F.col("b")), fingerprints.likeness(F.col("a"), F.col("b")), fingerprints.likeness(F.col("a"), F.col("c")), F.size(fingerprints.merged(F.col("a"), F.col("c")))).collect()
    assert got[0][0] > 0.99 and abs(got[0][1] - 0.5) < 0.05 and got[0][2] < 0.05 and abs(got[0][3] - 1500) < 150
    assert got[1][1] == 1.0 and got[1][2] == 0.0 and got[2][1] == 1.0 and got[2][2] == 0.0


# -- mixing


@pytest.mark.parametrize("name", ["docs", "repeated", "none"])
def test_mixing(name, request):
    df = request.getfixturevalue(name)
    rows = mixing.mix(df).collect()
    again = {r["n"]: r["taken"] for r in mixing.mix(df).collect()}
    assert len(rows) == df.count() and again == {r["n"]: r["taken"] for r in rows}
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        by[r["source"]][0] += r["size"]
        by[r["source"]][1] += r["taken"]
        by[r["source"]][2] = r["target"]
    want = mixing.targets_of({s: v[0] for s, v in by.items()}, mixing.default_weights(by))
    for s, (size, taken, target) in by.items():
        assert abs(target - want[s]) < 1e-6 and taken <= 3 * size
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in rows)


def test_mixing_meets_its_targets_over_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 16)
    monkeypatch.setattr(mixing, "FAN", 4)
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 90)), "en", "hot" if i % 3 else f"s{i % 5}") for i in range(900)]
    got = mixing.mix(frame(spark, rows)).collect()
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    assert all(abs(taken - target) <= 3 for taken, target in by.values())


# -- packing


def packed(df):
    import public_tokenizers

    return packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect()


@pytest.mark.parametrize("name", ["docs", "repeated", "none"])
def test_packing_is_an_exact_round_trip(name, request, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(packing, "GROUP_TOKENS", 4096)
    df = request.getfixturevalue(name)
    rows = packed(df)
    plain = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r["doc_id"], tuple(plain.encode(r["text"] or "", add_special_tokens=False).ids) + (0,)) for r in df.collect())
    pieces, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)
    if name != "repeated":
        got = Counter()
        for (i, n), parts in pieces.items():
            whole = [t for _, ids in sorted(parts) for t in ids]
            assert len(whole) == n
            got[i, tuple(whole)] += 1
        assert got == want
    assert sum(r["length"] for r in rows) == sum(len(ids) * c for (_, ids), c in want.items())


def test_rows_without_ids_are_spread(spark, monkeypatch):
    """Null and repeated ids fall into as many groups of packing, and leaves of mixing, as other rows."""
    monkeypatch.setattr(packing, "GROUP_TOKENS", 512)
    monkeypatch.setattr(mixing, "LEAF", 16)
    rows = [(None, "same words here", "en", "a")] * 300 + [(5, "same words here", "en", "a")] * 300
    pieces = packed(frame(spark, rows))
    groups = Counter(r["sequence_id"] >> 32 for r in pieces)
    assert len(groups) >= 4 and max(groups.values()) < 0.6 * len(pieces)
    assert sum(r["start"] == 0 for r in pieces) == 600
    mixed = mixing.mix(frame(spark, rows)).collect()
    assert len(mixed) == 600 and sum(r["taken"] for r in mixed) == 1800


# -- classifiers and scores


def labelled(spark, n=400):
    good = [(i, prose(100 + i, 30), "en" if i % 2 else "de", "a") for i in range(n)]
    bad = [(n + i, " ".join(f"{w.upper()}!!" for w in prose(900 + i, 30).split()) + (" scum" if i % 3 else " loser"), "en", "a") for i in range(n)]
    labels = [(i, 1, 0, "clash") for i in range(n)] + [(n + i, 0, 1, "clash") for i in range(n)] + [(None, 1, 1, ""), (3, None, None, "")]
    return frame(spark, good + bad), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_classifiers_on_held_out_rows(spark):
    df, labels = labelled(spark)
    for module, good in ((quality, 1), (toxicity, 0)):
        rows = [r for r in module.scored(df, labels).collect() if r["held_out"]]
        assert len(rows) > 50 and np.mean([(r["predicted"] == good) == (r["doc_id"] < 400) for r in rows]) > 0.97
    assert {"threshold", "flagged"} <= set(toxicity.scored(df, labels).columns)


def test_held_out_labels_are_never_read(spark):
    from pyspark.sql import functions as F

    df, labels = labelled(spark, 60)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    for module, column, folds, out in ((quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)):
        turned = labels.withColumn(column, F.when(fold % folds == out, 1 - F.col(column)).otherwise(F.col(column)))
        a = {r["doc_id"]: r["score"] for r in module.scored(df, labels).collect()}
        assert a == {r["doc_id"]: r["score"] for r in module.scored(df, turned).collect()}


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_odd_rows(spark, module, repeated, none):
    _, labels = labelled(spark, 40)
    for known in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = module.scored(repeated, known).collect()
        assert len(rows) == repeated.count()
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
        assert len({r["score"] for r in rows if not (r["text"] or "").split()}) == 1
    assert module.scored(none, labels).count() == 0


def test_the_sample_is_bounded_in_rows_and_bytes(spark):
    from pyspark.sql import functions as F

    df = frame(spark, [(i % 20, f"text {i} of {i % 20}", "en", "a") for i in range(4000)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    sample = quality.labelled_sample(df, labels, "quality", F.lit(False), 10)
    assert sample.count() == 10 == sample.select("doc_id").distinct().count()
    again = quality.labelled_sample(df.repartition(3), labels, "quality", F.lit(False), 10)
    assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, again.collect()))
    small = quality.labelled_sample(df, labels, "quality", F.lit(False), 10, most_bytes=50).select(F.sum(F.octet_length("text"))).first()[0]
    assert 0 < small <= 50


def test_pseudo_likelihood_does_not_depend_on_how_texts_are_stored(spark, repeated):
    rows = [(i, prose(400 + i, 80), "en", "a") for i in range(120)]
    some = frame(spark, rows)
    models = [pseudolikelihood.train(some.repartition(n), batch=256, places=2000) for n in (2, 7)]
    for a, b in zip(models[0].net.parts(), models[1].net.parts()):
        assert np.array_equal(a, b)
    # repeated rows, null ids and extra columns with the operator's own names
    odd = repeated.selectExpr("*", "1 AS h", "2 AS word", "3 AS value", "4 AS n_words", "5 AS _s", "6 AS _h")
    out = pseudolikelihood.scored(odd, models[0])
    got = out.collect()
    assert len(got) == repeated.count() and out.columns.count("n_words") == 1 and all(r["_s"] == 5 and r["h"] == 1 for r in got)
    by_text = defaultdict(set)
    for r in got:
        by_text[r["text"]].add(r["log_likelihood"])
    assert all(max(v) - min(v) <= 1e-5 * abs(min(v)) for v in by_text.values())


def test_pseudo_likelihood(spark, docs, none):
    order = "one two three four five six seven eight".split()
    rows = [(i, " ".join(order[(i + k) % 8] for k in range(60)), "en", "a") for i in range(300)]
    model = pseudolikelihood.train(frame(spark, rows))
    random = np.random.default_rng(0)
    test = frame(spark, [(0, " ".join(order * 5), "en", "a"), (1, " ".join(random.choice(order, 40).tolist()), "en", "a")])
    told, shuffled = pseudolikelihood.scored(test, model).orderBy("doc_id").collect()
    assert told["per_word"] > shuffled["per_word"] + 0.5
    got = {r["doc_id"]: r for r in pseudolikelihood.scored(docs).collect()}
    for i, t, _, _ in texts():
        assert got[i]["n_words"] == len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert (got[i]["per_word"] is None) == (got[i]["n_words"] == 0) and got[i]["log_likelihood"] <= 0
    assert got[0]["log_likelihood"] == pytest.approx(got[1]["log_likelihood"], rel=1e-6)
    assert pseudolikelihood.scored(none).count() == 0


def test_pseudo_likelihood_tells_words_of_a_shared_id_apart(spark):
    words = [f"w{i}" for i in range(12000)]  # more than have an id of their own
    rows = [(i, " ".join(words[j] for j in range(12000) if j % (1 + i) == 0), "en", "a") for i in range(12)]
    model = pseudolikelihood.train(frame(spark, rows), rounds=1)
    count = Counter(w for _, t, _, _ in rows for w in t.split())
    hashed = {}
    for w in [*count, "never1", "never2"]:
        raw = np.frombuffer(w.encode(), np.uint8)
        _, ids, _ = pseudolikelihood.word_ids(raw, np.array([0, len(raw)]), model.vocabulary, model.rank)
        hashed[w] = int(ids[0])
    some = [w for w in [*count, "never1", "never2"] if hashed[w] >= pseudolikelihood.WORDS]
    test = frame(spark, [(i, w, "en", "a") for i, w in enumerate(some)])
    got = {some[r["doc_id"]]: r["log_likelihood"] for r in pseudolikelihood.scored(test, model).collect()}
    whole = Counter()
    for w, n in count.items():
        whole[hashed[w]] += n
    alone = {}
    for w in some:  # less the word's share of its id, words of one id have the same probability
        alone.setdefault(hashed[w], []).append(got[w] - np.log(max(count[w], 1) / (whole[hashed[w]] + 1)))
    assert any(len(x) > 1 for x in alone.values())
    for x in alone.values():
        assert x == pytest.approx([x[0]] * len(x), rel=1e-6)
    assert len({round(got[w], 6) for w in some}) > len(alone)
    # the same scores, whether counts are listed with every task or met by shuffle
    n = sorted(count.values(), reverse=True)
    for most in (0, 500, 5000):
        h, found = pseudolikelihood.listed_counts(model.counts, most)
        assert len(h) <= most and sorted(found.tolist(), reverse=True) == n[: len(h)] and (h[1:] > h[:-1]).all()
        assert most < 500 or len(h)
        met = pseudolikelihood.scored(test, replace(model, listed=h, listed_log=np.log(found))).collect()
        assert {some[r["doc_id"]]: r["log_likelihood"] for r in met} == pytest.approx(got, rel=1e-9)


def test_pseudo_likelihood_trains_on_every_place(spark):
    text = np.repeat([0, 1, 3], [1, 7, 40])  # text 2 has no words
    doc_id = np.array([5, 9, 2, -1])
    visits = [pseudolikelihood.round_places(doc_id, text, turn, 2) for turn in range(2)]
    assert sorted(np.concatenate(visits).tolist()) == list(range(48))
    # texts of two words: each is trained on, so the network knows every pair
    rows = [(i, f"left{i % 8} right{i % 8}", "en", "a") for i in range(4000)]
    model = pseudolikelihood.train(frame(spark, rows).repartition(2), batch=64)
    test = frame(spark, [(0, "left3 right3", "en", "a"), (1, "left3 right4", "en", "a")])
    told, crossed = pseudolikelihood.scored(test, model).orderBy("doc_id").collect()
    assert told["per_word"] > -0.3 and told["per_word"] > crossed["per_word"] + 2


def test_pseudo_likelihood_is_a_distribution():
    net = pseudolikelihood.new_net()
    around = np.full((4, pseudolikelihood.IDS), 3)
    every = pseudolikelihood.log_probabilities(net, around, np.arange(pseudolikelihood.IDS))
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)


# -- urls


def plain_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


URLS = ["http://a.net/x", "HTTPS://A.Example.NET/en/1?q=/de/", "http://example.net/en", "http://example.com/de/x#y", "http://xexample.com/de/", "https://m.b.org/fr/", "https://org/fr/", "http://net", "http://net?x", "mailto:x", "", None, "x://y://z.net/", "http:///path", "http://É.net/ü", "http://.net/", "http://a.net./", "http://www.example.com:80/de/", "http://a\nb.net/c"]


def test_url_rules(spark):
    rules = [*urls.RULES, ("deep.example.net", "/en/private", "block"), ("net", "", "allow"), ("x", "/", "allow"), ("x", "/", "block")]
    for some in (urls.RULES, rules, []):
        pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS + ["http://deep.example.net/en/private/1", "http://x/"] * 3)], "page_id long, url string, host string, rule string")
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(pages, spark.createDataFrame(some, "host string, path string, verdict string")).collect()}
        for r in pages.collect():
            want = plain_verdict(r["url"], [x for x in some if x != ("x", "/", "allow")])
            assert got[r["page_id"]] == want, r["url"]
    assert urls.judged(pages.limit(0), spark.createDataFrame(urls.RULES, "host string, path string, verdict string")).count() == 0


def test_urls_with_clashing_columns_and_without_end(spark):
    import time

    names = ("won", "row", "labels", "pairs", "hit", "r_host", "host", "verdict", "_pairs")
    some = [*URLS[:4], "http://" + "a." * 400_000 + "net/x", "http://a.net/" + "en/" * 300_000, "x" * 1_000_000, "http://" + "b" * 1_000_000 + ".org/fr/" + "?" * 1000]
    pages = spark.createDataFrame([(i, u, *names) for i, u in enumerate(some)], ["page_id", "url", *names])
    began = time.time()
    rows = urls.judged(pages, spark.createDataFrame(urls.RULES, "host string, path string, verdict string")).collect()
    assert time.time() - began < 30
    for r in rows:
        host, path, rule, verdict = plain_verdict(some[r["page_id"]], urls.RULES)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict) and r["won"] == "won" and r["row"] == "row"
    assert len(rows) == len(some)


def test_bloom_filter_never_misses(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS h")
    bits = urls.bloom_filter(keys)
    hashes = np.array([r["h"] for r in keys.collect()])
    other = np.array([r["h"] for r in spark.range(10_000, 30_000).selectExpr("xxhash64(id) AS h").collect()])

    def hit(h):
        block, mask = urls._bits(h, len(bits))
        return ((bits[block] & mask) == mask).all(axis=1)

    assert hit(hashes).all() and hit(other).mean() < 0.02


# -- nearest neighbours


def test_nearest(spark):
    random = np.random.default_rng(6)
    vectors = random.normal(size=(600, 8))
    vectors[100:300] = vectors[100]  # a common vector: ties go to the smaller id
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(vectors)]
    odd = [(1000, None, ""), (1020, [0.0] * 8, ""), (1040, [float("nan")] + [1.0] * 7, ""), (1060, [None] + [1.0] * 7, ""), (1080, [float("inf")] * 8, ""), (1100, [], ""), (None, [1.0] * 8, ""), (1120, [1.0, 2.0], ""), (1121, [2.0, 1.0], "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=20, shard=200).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    assert set(got) == {*range(0, 600, 20), 1120} and [x[0] for x in got[1120]] == [1121]
    hits = 0
    for q in range(0, 600, 20):
        exact = vectors @ vectors[q]
        exact[q] = -np.inf
        best = np.lexsort((np.arange(600), -exact))[:20]
        hits += len(set(best.tolist()) & {x[0] for x in got[q]})
        assert [x[2] for x in got[q]] == list(range(1, 21))
        assert np.allclose([x[1] for x in got[q]], [vectors[x[0]] @ vectors[q] for x in got[q]], rtol=0, atol=1e-12)
    assert hits / 600 >= 0.95
    repeated = df.where("vec_id < 50").unionAll(df.where("vec_id < 10"))  # an id that several rows have counts once
    found = neighbours.nearest(repeated, repeated.where("vec_id = 0"), k=5).collect()
    assert sorted(r["rank"] for r in found) == [1, 2, 3, 4, 5] and len({r["vec_id"] for r in found}) == 5 and all(r["vec_id"] != 0 for r in found)
    few = neighbours.nearest(df.where("vec_id < 5"), df.where("vec_id = 0")).collect()
    assert len(few) == 4
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0
