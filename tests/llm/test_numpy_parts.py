"""The operators' numpy cores against plain versions."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.llm import mixing, neighbours, packing, simhash, suffixes
from tabulon.llm.common import components, ranges
from tabulon.llm.features import word_hashes, word_spans


@given(st.binary(max_size=300), st.sampled_from([1, 2, 3, 50]))
@settings(max_examples=60, deadline=None)
def test_suffix_array_and_prefixes(raw, letters):
    text = np.frombuffer(raw, np.uint8) % letters
    order = suffixes.suffix_array(text)
    body = text.tobytes()
    # a zero byte at the end sorts like the end itself, so compare what is left padded
    assert sorted(order.tolist()) == list(range(len(text)))
    plain = sorted(range(len(text)), key=lambda i: body[i:])
    assert order.tolist() == plain
    lcp = suffixes.kasai(text, order, 40, lanes=7)
    for a, b, got in zip(order[:-1].tolist(), order[1:].tolist(), lcp[1:].tolist()):
        want = 0
        while max(a, b) + want < len(body) and want < 40 and body[a + want] == body[b + want]:
            want += 1
        assert got == want


@given(st.lists(st.binary(max_size=250).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=5))
@settings(max_examples=40, deadline=None)
def test_segments_cover_every_string_once_and_equal_strings_share_an_anchor(texts):
    length = 48
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    text, start, strings, anchor, content = suffixes.segments(data, bounds, length)
    seen = {}
    for t, s, n, a in zip(text.tolist(), start.tolist(), strings.tolist(), anchor.tolist()):
        for p in range(s, s + n):
            assert bounds[t] <= p <= bounds[t + 1] - length
            assert seen.setdefault(p, a) == a
            seen.setdefault(data[p : p + length].tobytes(), a) == a
    assert sum(isinstance(k, int) for k in seen) == sum(max(0, len(x) - length + 1) for x in texts)


def test_merged_runs():
    random = np.random.default_rng(0)
    runs = []
    for i in range(5):
        values = np.unique(random.integers(0, 40, 25))
        runs.append((np.array([b"%04d" % v for v in values]), values * 0 + np.arange(len(values)) + 100 * i))
    strings, owners, lost = suffixes.merged_runs(runs)
    first = {}
    for s, o in runs:
        for x, y in zip(s, o):
            first[x] = min(first.get(x, y), y)
    assert dict(zip(strings, owners)) == first
    assert sorted(np.concatenate(lost).tolist()) == sorted(int(y) for s, o in runs for x, y in zip(s, o) if first[x] != y)


@pytest.mark.parametrize("near", [False, True])
def test_trie_links(near):
    random = np.random.default_rng(1)
    key = random.integers(0, 2**63, 300, dtype=np.uint64)
    if near:
        key = key[:20, None] ^ (np.uint64(1) << random.integers(0, 56, (20, 15)).astype(np.uint64)) ^ (np.uint64(1) << random.integers(0, 56, (20, 15)).astype(np.uint64))
        key = np.unique(key.ravel())
    else:
        key = np.unique(key)
    group = (key >> np.uint64(60)).astype(np.int64)
    order = np.lexsort((key, group))
    key, group = key[order], group[order]
    found = {tuple(sorted(p)) for i, j in simhash.trie_links(group, key, 4, 0, step=64) for p in zip(i.tolist(), j.tolist())}
    want = {(i, j) for i in range(len(key)) for j in range(i + 1, len(key)) if group[i] == group[j] and bin(int(key[i] ^ key[j])).count("1") <= 4}
    assert found == want


@pytest.mark.parametrize("n", [1, 10_000, 10**7, 10**10])
def test_block_plans_lose_no_pair(n):
    plans = simhash.block_plan(n, 4)
    assert all(sorted(p[1:]) == list(range(64)) for p in plans)
    agreed = [set(p[1 : 1 + p[0]]) for p in plans]
    random = np.random.default_rng(2)
    for _ in range(300):
        differ = set(random.choice(64, 4, replace=False).tolist())
        assert any(not differ & bits for bits in agreed)


@given(st.lists(st.tuples(st.integers(0, 19), st.integers(0, 19)), max_size=30))
@settings(max_examples=50, deadline=None)
def test_components(links):
    a, b = (np.array([x[i] for x in links], int) for i in (0, 1))
    got = components(20, a, b)
    want = list(range(20))
    for _ in range(20):
        for x, y in links:
            want[x] = want[y] = min(want[x], want[y])
    assert got.tolist() == want


def test_ranges():
    assert ranges(np.array([5, 9]), np.array([3, 0])).tolist() == [5, 6, 7]


def test_pivotal_keeps_the_sum_and_the_odds():
    random = np.random.default_rng(3)
    size = random.integers(1, 50, 101)
    mass = size * random.random(101)
    out = mixing.pivotal(size, mass, np.arange(101))
    assert abs(out.sum() - mass.sum()) < 1e-6 and ((out > 0) & (out < size)).sum() <= 1
    taken = np.mean([mixing.pivotal(np.ones(3), np.array([0.2, 0.5, 0.3]), np.arange(3) + 10 * k) for k in range(4000)], axis=0)
    assert np.abs(taken - [0.2, 0.5, 0.3]).max() < 0.03


def test_targets():
    sizes = {"a": 100, "b": 1, "c": 50, None: 0}
    target = mixing.targets_of(sizes, mixing.default_weights(sizes))
    assert target["b"] == 3 and target[None] == 0 and abs(sum(target.values()) - 151) < 1e-9
    assert abs(target["a"] / target["c"] - 1 / 3) < 1e-9


def test_windows_and_round_robin():
    assert list(packing.windows_of(2148, 1024)) == [1024, 1024, 64, 32, 4]
    lengths = [[700, 40, 900], [300], [5] * 60]
    share = [0.6, 0.2, 0.2]
    seen = {}
    fill = {}
    for window, s, place, start, take, offset in packing.round_robin(lengths, share, [0.0, 5.0, -5.0], 256, grain=16):
        assert seen.get((s, place), 0) == start and fill.get(window, 0) == offset and take > 0
        seen[(s, place)] = start + take
        fill[window] = offset + take
    assert seen == {(s, i): n for s, q in enumerate(lengths) for i, n in enumerate(q)}
    assert all(n == 256 or not n & (n - 1) for n in fill.values())


def test_round_robin_keeps_to_the_shares():
    lengths = [[1000] * 60, [500] * 60, [100] * 100]
    total = sum(map(sum, lengths))
    share = [sum(q) / total for q in lengths]
    got = np.zeros((total // 1024 + 20, 3))
    for window, s, _, _, take, _ in packing.round_robin(lengths, share, [0.0] * 3, 1024):
        got[window, s] += take
    for w in range(10, total // 1024, 10):
        assert np.abs(got[:w].sum(axis=0) - np.array(share) * 1024 * w).max() < 300


public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    return packing.Encoder(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)


def same(both, text):
    ours, theirs = both
    assert np.frombuffer(ours(text), np.uint16).tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("text", ["", " ", "a", "  a", "a  b", "a b\nc", "a \n b", "\n\na\n", "it's we'll", "été ñandú 123 4", "a b c", "x <|endoftext|> y", "<|endoftext|>", "tab\there \x1c z", "字 文字", "a\x85 b"])
def test_encoder_on_hard_texts(both, text):
    same(both, text)


@given(st.text(alphabet=" \n\tab'sll1é字.  ", max_size=40))
@settings(max_examples=200, deadline=None)
def test_encoder_is_the_tokenizer(both, text):
    same(both, text)


def test_words():
    texts = ["one two", "", "  three\tone ", "é x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    start, end, text = word_spans(data, bounds)
    words = [data[a:b].tobytes().decode() for a, b in zip(start, end)]
    assert words == ["one", "two", "three", "one", "é x"] and text.tolist() == [0, 0, 2, 2, 3]
    h = word_hashes(data, start, end, True)
    assert h[0] == h[3] and len(set(h.tolist())) == 4


@pytest.mark.parametrize("n", [0, 1, 5, 2500])
def test_graph_recall(n):
    random = np.random.default_rng(4)
    vectors = random.normal(size=(n, 24)) * random.random((n, 1)) * 3
    if n > 100:
        vectors[::7] = vectors[0]
    ids = random.permutation(10 * n)[:n]
    if not n:
        return
    index = neighbours.ShardIndex(ids, vectors, 11)
    hits = total = 0
    for q in range(0, n, 25):
        ((_, got, score),) = list(index.search(ids[q : q + 1], vectors[q : q + 1], 10, 64))
        exact = vectors @ vectors[q]
        exact[q] = -np.inf
        best = np.lexsort((ids, -exact))[: min(10, n - 1)]
        hits += len(set(got.tolist()) & set(ids[best].tolist()))
        total += len(best)
        assert (np.diff(score) <= 0).all()
    assert total == 0 or hits / total >= 0.9


@pytest.mark.parametrize("degree, slack", [(3, 0), (6, 2), (28, 16)])
def test_every_node_of_a_graph_can_be_reached(degree, slack):
    random = np.random.default_rng(8)
    points = random.normal(size=(1500, 6)).astype(np.float32)
    points[:700] *= 0.01  # a dense middle, whose nodes push one another out
    edges, entry = neighbours.build_graph(points, degree, slack)
    met, front = set(entry.tolist()), entry.tolist()
    while front:
        near = {int(e) for node in front for e in edges[node] if e >= 0}
        front = list(near - met)
        met |= near
    assert met == set(range(1500))
    assert all(len(set(own[own >= 0].tolist())) == (own >= 0).sum() and node not in own for node, own in enumerate(edges))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_classifier_parts_agree_on_empty_input():
    from tabulon.llm import quality, toxicity

    model = quality.fit([], np.zeros(0, np.int64))
    assert model.scores(np.zeros(0, np.uint8), np.array([0, 0])).tolist() == [0.5]
    net = toxicity.fit([], np.zeros(0, np.int64), epochs=0)
    assert net.scores(np.zeros(0, np.uint8), np.array([0, 0])).shape == (1,)
