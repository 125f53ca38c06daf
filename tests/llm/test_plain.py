"""The operators' inner parts and registered queries against plain versions, written without the operators' code."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tabulon.llm import fingerprints, mixing, neighbours, pseudolikelihood, quality, simhash, suffixes, toxicity
from tabulon.llm.queries import queries

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet").collect()


@pytest.fixture(scope="module")
def documents(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return {r["doc_id"]: r for r in rows_of(spark, "documents")}


def answer(spark, name):
    (found,) = [q for n, q in queries().items() if n.startswith(f"{name}_")]
    df = found(spark, DATA)
    return dict(df.dtypes), df.collect()


# -- mixing


def hash_of_long(n):
    return xxhash.xxh64_intdigest(n.to_bytes(8, "little", signed=True), 42)


def as_long(x):
    return x - 2**64 if x >= 2**63 else x


def drawn(*parts):
    m, x = 2**64, 0
    for p in parts:
        x = ((x ^ (p % m)) + 0x9E3779B97F4A7C15) % m
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % m
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % m
        x ^= x >> 31
    return (x >> 11) * 2.0**-53


def settled_plainly(docs):
    """One pair after another, by rounds; docs: lists [place, n, size, base, mass]."""
    docs = sorted(docs)
    level = 0
    while True:
        for d in docs:
            if d[4] <= 1e-9 * max(d[2], 1):
                d[4] = 0.0
            elif d[4] >= d[2] - 1e-9 * max(d[2], 1):
                d[4] = float(d[2])
        pending = [d for d in docs if 0 < d[4] < d[2]]
        if len(pending) < 2:
            return docs
        for a, b in zip(pending[::2], pending[1::2]):
            up, down = min(a[2] - a[4], b[4]), min(a[4], b[2] - b[4])
            move = up if drawn(a[0], b[0], level) * (up + down) < down else -down
            a[4] += move
            b[4] -= move
        level += 1


def mixed_plainly(docs, leaf):
    """doc_id to words taken. docs: (doc_id, size, source)."""
    by = defaultdict(list)
    for n, size, source in docs:
        by[source].append((n, size))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    size = {s: sum(z for _, z in by[s]) for s in by}
    target, left, open_ = dict.fromkeys(by, 0.0), float(sum(size.values())), {s for s in by if size[s]}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * rate > 3 * size[s]}
        for s in full or open_:
            target[s] = 3.0 * size[s] if full else weight[s] * rate
        if not full:
            break
        left -= sum(3 * size[s] for s in full)
        open_ -= full
    taken = {}
    for s in order:
        rate = target[s] / size[s] if size[s] else 0.0
        leaves = -(-len(by[s]) // leaf)
        groups = defaultdict(list)
        for n, z in by[s]:
            place = as_long(hash_of_long(n))
            base = int(rate // 1)
            mass = (rate - base) * z
            if z == 0 or mass == 0:
                taken[n] = base * z
            else:
                groups[z.bit_length() - 1, place % leaves].append([place, n, z, base, mass])
        residue = defaultdict(list)
        for (cls, _), some in sorted(groups.items()):
            for d in settled_plainly(some):
                (residue[cls].append(d) if 0 < d[4] < d[2] else taken.__setitem__(d[1], d[3] * d[2] + round(d[4])))
        last = []
        for some in residue.values():
            for d in settled_plainly(some) if leaves > 1 else some:
                (last.append(d) if 0 < d[4] < d[2] else taken.__setitem__(d[1], d[3] * d[2] + round(d[4])))
        last.sort(key=lambda d: (-d[2], d[0], d[1]))
        owed = 0.0
        for i, (_, n, z, base, mass) in enumerate(last):
            more = sum((3 - d[3]) * d[2] - d[4] for d in last[i + 1 :])
            less = sum(d[3] * d[2] + d[4] for d in last[i + 1 :])
            best = None
            for copies in range(-base, 4 - base):
                rest = mass + owed - copies * z
                rank = (max(rest - more, -rest - less, 0.0), abs(rest))
                if best is None or rank < best[0]:
                    best = (rank, copies, rest)
            owed = best[2]
            taken[n] = (base + best[1]) * z
    return taken, target


@pytest.mark.parametrize("leaf", [1024, 8])
def test_mixing_equals_a_plain_version(spark, documents, monkeypatch, leaf):
    monkeypatch.setattr(mixing, "LEAF", leaf)
    types, rows = answer(spark, "op1")
    assert types | {"copies": "bigint"} == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint", "copies": "bigint"}
    docs = [(i, len(WORD.findall(r["text"] or "")), r["source"]) for i, r in documents.items()]
    taken, target = mixed_plainly(docs, leaf)
    size = defaultdict(int)
    for _, z, s in docs:
        size[s] += z
    assert len(rows) == len(docs)
    for r in rows:
        s = documents[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"]) == (len(WORD.findall(documents[r["doc_id"]]["text"] or "")), size[s])
        assert r["target"] == pytest.approx(target[s]) and r["taken"] == taken[r["doc_id"]] <= 3 * r["size"]


# -- pseudo-likelihood


def test_log_probabilities_equal_a_plain_version():
    random = np.random.default_rng(1)
    net = pseudolikelihood.new_net(3)
    for p in net.parts():
        p += random.normal(0, 0.3, p.shape).astype(np.float32)
    ids = random.integers(0, pseudolikelihood.IDS, 40)
    text = np.repeat([0, 1, 2], [25, 1, 14])
    got = pseudolikelihood.log_probabilities(net, pseudolikelihood.surroundings(text, ids), ids)
    for t in range(40):
        hidden = net.shift.astype(float).copy()
        for k, o in enumerate(pseudolikelihood.OFFSETS):
            at = t + o
            hidden += net.context[k][ids[at] if 0 <= at < 40 and text[at] == text[t] else pseudolikelihood.IDS]
        hidden = np.tanh(hidden)
        kind, member = ids[t] % pseudolikelihood.CLASSES, ids[t] // pseudolikelihood.CLASSES
        z = hidden @ net.classes + net.class_shift
        y = hidden @ net.members[kind] + net.member_shift[kind]
        want = z[kind] - np.log(np.exp(z).sum()) + y[member] - np.log(np.exp(y).sum())
        assert got[t] == pytest.approx(want, abs=1e-4)


def test_training_steps_follow_the_slope_of_the_loss():
    random = np.random.default_rng(2)
    start = pseudolikelihood.Net(*(p.astype(float) + random.normal(0, 0.2, p.shape) for p in pseudolikelihood.new_net(4).parts()))
    ids = random.integers(0, 200, 30)
    around = pseudolikelihood.surroundings(np.repeat([0, 1], [20, 10]), ids)
    trainer = pseudolikelihood.Trainer(start, rate=1.0)
    trainer.seen = [np.full(s.shape, 1e12) for s in trainer.seen]  # a step is then a millionth of the slope
    trainer.step(around, ids)
    loss = lambda net: -pseudolikelihood.log_probabilities(net, around, ids).mean()
    for k, (old, new) in enumerate(zip(start.parts(), trainer.net.parts())):
        slope = (old - new) * 1e6
        used = np.argwhere(np.abs(slope) > 1e-6)
        for at in map(tuple, used[random.choice(len(used), 12)]):
            pair = []
            for e in (1e-4, -1e-4):
                parts = [p.copy() for p in start.parts()]
                parts[k][at] += e
                pair.append(loss(pseudolikelihood.Net(*parts)))
            assert slope[at] == pytest.approx((pair[0] - pair[1]) / 2e-4, rel=1e-3, abs=1e-7), k


# -- quality


def test_log_ratios_and_the_dual_equal_plain_versions():
    random = np.random.default_rng(3)
    rows = [np.sort(random.choice(16, random.integers(1, 8), replace=False)) for _ in range(30)]
    label = np.array([int(r.sum() + random.integers(0, 20) > 40) for r in rows])
    ratio = quality.log_ratios(rows, label, 4)
    for b in range(16):
        good, bad = (1 + sum(b in r for r, y in zip(rows, label) if y == c) for c in (1, 0))
        whole = [16 + sum(len(r) for r, y in zip(rows, label) if y == c) for c in (1, 0)]
        assert ratio[b] == pytest.approx(np.log(good / whole[0]) - np.log(bad / whole[1]))
    norm = np.array([np.sqrt((ratio[r] ** 2).sum()) for r in rows])
    sign, cost = np.where(label > 0, 1.0, -1.0), np.full(30, 0.7)
    w, bias = quality.dual_descent(rows, ratio, norm, sign, cost, rounds=4000)
    x = np.zeros((30, 17))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / norm[i]
    x[:, 16] = 1
    q = (x * sign[:, None]) @ (x * sign[:, None]).T
    alpha = np.zeros(30)
    for _ in range(60_000):  # projected steps along the whole gradient
        alpha = np.clip(alpha - (q @ alpha - 1) / 40, 0, cost)
    want = (alpha * sign) @ x
    loss = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()
    assert loss(np.r_[w, bias]) == pytest.approx(loss(want), rel=1e-3)
    assert np.allclose(np.r_[w, bias], want, atol=0.02)


# -- fingerprints


def chained(*longs):
    h = 42
    for x in longs:
        h = xxhash.xxh64_intdigest((x % 2**64).to_bytes(8, "little"), h)
    return h


def sketched_plainly(text):
    words = [as_long(xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORD.findall(text)]
    if not words:
        return []
    k = min(5, len(words))
    # a shorter text is one shingle; words that are missing leave the hash as it is
    shingles = [chained(*words[i : i + k]) for i in range(len(words) - k + 1)]
    kept = [h for h in shingles if h < 2**62] or [min(h >> 2 for h in shingles)]
    return sorted({h >> 18 for h in kept})


def alike(a, b):
    a, b = set(a), set(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_fingerprints_equal_a_plain_version(spark, documents):
    types, rows = answer(spark, "op8")
    assert types == {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    down = sorted(documents, reverse=True)
    after = dict(zip(down, [*down[1:], down[0]]))
    assert sorted(r["doc_id"] for r in rows) == sorted(down)
    written = lambda s: "".join(f"{x:011x}" for x in s)
    for r in rows:
        text, following = documents[r["doc_id"]]["text"] or "", documents[after[r["doc_id"]]]["text"] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        own, other, next_ = sketched_plainly(text), sketched_plainly(edited), sketched_plainly(following)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (written(own), written(other))
        assert r["near_edited"] == pytest.approx(alike(own, other)) and r["near_next"] == pytest.approx(alike(own, next_))


# -- toxicity


def small_net(random):
    net = toxicity._start([(np.array([1, 2]), np.array([3, 4]))] * 2, np.array([0, 1]), random)
    return toxicity.Net(random.normal(0, 0.5, (60, toxicity.DIM)), [random.normal(0, 0.3, b.shape) for b in net.banks], [random.normal(0, 0.3, s.shape) for s in net.shifts], random.normal(0, 0.5, net.out.shape), 0.2)


def test_convolution_equals_a_plain_version():
    random = np.random.default_rng(5)
    net = small_net(random)
    rows = [(random.integers(0, 60, n), random.integers(0, 60, n)) for n in (9, 1, 2, 0, 30)]
    text = np.repeat(np.arange(5), [len(r[0]) for r in rows])
    got = net.logits(text, np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), 5)
    for (whole, stem), z in zip(rows, got):
        best = np.zeros(toxicity.FILTERS * len(toxicity.WIDTHS))
        for k, width in enumerate(toxicity.WIDTHS):
            for at in range(len(whole) - width + 1):
                window = np.concatenate([net.embed[whole[at + i]] + net.embed[stem[at + i]] for i in range(width)])
                for f in range(toxicity.FILTERS):
                    here = window @ net.banks[k][:, f] + net.shifts[k][f]
                    best[k * toxicity.FILTERS + f] = max(best[k * toxicity.FILTERS + f], here)
        assert z == pytest.approx(best @ net.out + net.bias, abs=1e-5)


def test_slopes_of_the_net_are_those_of_its_loss():
    random = np.random.default_rng(6)
    net = small_net(random)
    rows = [(random.integers(0, 60, n), random.integers(0, 60, n)) for n in (9, 3, 12, 7)]
    label, weight = np.array([0, 1, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0])
    _, slopes = toxicity.loss_slopes(net, rows, label, weight)
    embed = np.zeros_like(net.embed)
    for used, total in slopes.embed:
        np.add.at(embed, used, total)

    def checked(values, slope):
        for at in map(tuple, np.argwhere(np.abs(slope) > 1e-5)[:: max(1, int((np.abs(slope) > 1e-5).sum() // 12))]):
            old, pair = values[at], []
            for e in (1e-6, -1e-6):
                values[at] = old + e
                pair.append(toxicity.loss_slopes(net, rows, label, weight)[0])
            values[at] = old
            assert slope[at] == pytest.approx((pair[0] - pair[1]) / 2e-6, rel=1e-3, abs=1e-6)

    for values, slope in [(net.out, slopes.out), (net.embed, embed), *zip(net.banks, slopes.banks), *zip(net.shifts, slopes.shifts)]:
        checked(values, slope)


def test_few_labels_still_calibrate():
    random = np.random.default_rng(7)
    rows, y = [], []
    for i in range(120):
        toxic = int(i % 8 == 0)
        words = random.integers(0, 400, 20)
        if toxic:
            words[random.integers(20)] = 401
        rows.append((words, words + 500))
        y.append(toxic)
    net = toxicity.fitted(rows[:80], np.array(y[:80]), np.array([None] * 80, object))
    z = np.array([net.logits(np.zeros(20, np.int64), *r, 1)[0] for r in rows[80:]])
    late = np.array(y[80:])
    assert (z[late == 1][:, None] > z[late == 0][None, :]).mean() > 0.9


# -- the registered queries' own columns


def test_suffix_query(spark, documents):
    types, rows = answer(spark, "op5")
    assert types == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    seen, want = set(), {}
    for i in sorted(documents):
        raw = (documents[i]["text"] or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = hashlib.blake2b(raw[p : p + 100], digest_size=16).digest()
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        want[i] = (len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want


def test_packing_query(spark, documents):
    tokenizers, public_tokenizers = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    plain = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    types, rows = answer(spark, "op6")
    assert types == {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    ids = {i: np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4") for i, r in documents.items()}
    cover, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] > 0 and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        cover[r["doc_id"]].append((r["start"], r["length"]))
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, whole in [*((cover[i], len(ids[i])) for i in documents), *((p, None) for p in fill.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == whole if whole is not None else at <= 1024
    assert sum(sum(n for _, n in p) for p in fill.values()) == sum(map(len, ids.values()))


@pytest.mark.parametrize("name, column, folds, out", [("op7", "quality", 5, 0), ("op9", "toxic", 4, 2)])
def test_classifier_queries(spark, documents, name, column, folds, out):
    types, rows = answer(spark, name)
    assert {k: types[k] for k in ("doc_id", "held_out", "score", "predicted")} == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == out)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    by_text = defaultdict(set)
    for r in rows:
        by_text[documents[r["doc_id"]]["text"]].add(r["score"])
    assert all(max(v) - min(v) < 1e-6 for v in by_text.values())


def test_simhash_query(spark, documents):
    types, rows = answer(spark, "op10")
    assert types == {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}
    prints = {}
    for i, r in documents.items():
        words = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or ""))
        k = min(4, len(words))
        h = [xxhash.xxh64_intdigest(" ".join(words[j : j + k]).encode(), 42) for j in range(len(words) - k + 1)] if words else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if bin(prints[i] ^ prints[j]).count("1") <= 4 and root[j] < root[i]:
                    root[i], changed = root[j], True
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}


def test_neighbour_query(spark, documents):
    types, rows = answer(spark, "op4")
    assert types == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows_of(spark, "embeddings") if r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])}
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        assert r["score"] == pytest.approx(float(vectors[r["query_id"]] @ vectors[r["vec_id"]]), abs=1e-12)
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) == {i for i in vectors if i % 20 == 0}
    hits = [len(set(found) & set(sorted((j for j in vectors if j != q), key=lambda j: (-float(vectors[q] @ vectors[j]), j))[:20])) for q, found in got.items()]
    assert np.mean(hits) / min(20, len(vectors) - 1) >= 0.9


def test_pseudo_likelihood_query(spark, documents):
    types, rows = answer(spark, "op2")
    assert types == {"doc_id": "bigint", "n_words": "bigint", "log_likelihood": "double", "per_word": "double"}
    assert {r["doc_id"]: r["n_words"] for r in rows} == {i: len(WORD.findall(r["text"] or "")) for i, r in documents.items()}
    assert neighbours.SHARD and simhash.SEED == 42 and fingerprints.SHINGLE == 5 and suffixes.GRAM == 32
