import random

import numpy as np
import xxhash

from tessera.llm import simhash
from tessera.llm.common import Scratch
from tessera.llm.components import components


def _brute(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < k else [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_fingerprints_match_brute_force():
    texts = [None, "", " ", "One", "one TWO", "a b c", "É é x \x1c y z " * 9, "to be or not to be " * 50]
    texts += [" ".join(f"w{i * j % 17}" for i in range(40)) for j in range(1, 20)]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) == _brute(t)


def test_balls_lose_no_link():
    rng = np.random.default_rng(1)
    for buckets in (1, 7):
        layers = [rng.integers(0, 2**63, 40).astype(np.uint64)]
        for flips in (1, 2, 3, 3):
            y = layers[-1].copy()
            for _ in range(flips):
                y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
            layers.append(y)
        values = np.unique(np.concatenate(layers))
        held = {}
        for at, blob in simhash._deal(values, buckets):
            held.setdefault(at, []).append(blob)
        links = [(int(a), int(b)) for blobs in held.values() for a, b in zip(*simhash._meet(blobs))]
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        near = [(int(a), int(b)) for a in values for b in values[np.bitwise_count(values ^ a) <= 3]]
        nodes = values.tolist()
        assert _groups(nodes, links) == _groups(nodes, near)


def test_balls_of_radius_two_lose_no_link():
    rng = np.random.default_rng(7)
    values = rng.integers(0, 2**63, 60).astype(np.uint64)
    for _ in range(3):
        flip = np.uint64(1) << rng.integers(0, 64, len(values)).astype(np.uint64)
        values = np.unique(np.append(values, values ^ np.resize(flip, len(values))))
    held = {}
    for at, blob in simhash._deal(values, 5, 2):
        held.setdefault(at, []).append(blob)
    links = [(int(a), int(b)) for blobs in held.values() for a, b in zip(*simhash._meet(blobs, 2))]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    near = [(int(a), int(b)) for a in values for b in values[np.bitwise_count(values ^ a) <= 2]]
    assert _groups(values.tolist(), links) == _groups(values.tolist(), near)


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    found = components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "test")).collect()
    want = _groups({x for link in links for x in link}, links)
    assert {(r.u, r.v) for r in found} == {(n, r) for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "test")).count() == 0


def test_near_duplicates(spark, docs_dir, small_docs, no_docs):
    base = [" ".join(f"w{(i * 7 + j) % 60}" for i in range(80)) for j in range(6)]
    texts = base + base[:2] + [b + " tail" for b in base[:3]] + [None, "", " "]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.op6_simhash(spark, docs_dir(rows)).collect()}
    prints = {i: _brute(t) for i, t in enumerate(texts)}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints and all(len(r.fingerprint) == 16 for r in got.values())
    links = [(a, b) for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {i: r.component_id for i, r in got.items()} == _groups(prints, links)
    odd = simhash.near_duplicates(small_docs).collect()
    assert len(odd) == small_docs.count() and all(r.component_id is not None for r in odd if r.doc_id is not None)
    assert simhash.near_duplicates(no_docs).count() == 0


def _resemblance(a, b, k=5):
    def shingles(t):
        words = (t or "").lower().split()
        return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def _edited(rng, words, edits):
    own = list(words)
    for _ in range(edits):
        at = rng.randrange(len(own))
        own[at : at + 1] = rng.choice([[], [f"new{rng.random()}"], [own[at], f"new{rng.random()}"]])
    return " ".join(own)


def test_sketches_estimate_the_resemblance():
    rng, errors = np.random.default_rng(2), []
    pick = random.Random(3)
    for n in (12, 40, 300, 3000):
        for edits in (0, 1, n // 60, n // 30, n // 10):
            words = [f"w{x}" for x in rng.zipf(1.3, n)]
            a, b = " ".join(words), _edited(pick, words, edits)
            found = simhash.similarity(simhash.profile(a.encode())[2], simhash.profile(b.encode())[2])
            errors.append(found - _resemblance(a, b))
    assert max(map(abs, errors)) < 0.12 and abs(np.mean(errors)) < 0.02
    assert simhash.similarity(simhash.profile(b"")[2], simhash.profile(None)[2]) == 1.0


def test_near_copies_are_found_and_others_left_alone(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, of = [], {}
    for base in range(60):
        words = rng.choices(vocabulary, range(3000, 0, -1), k=rng.randrange(60, 900))
        texts = [" ".join(words)] + [_edited(rng, words, max(1, len(words) // 80)) for _ in range(3)] + [" ".join(words).upper()]
        shuffled = " ".join(rng.sample(words, len(words)))  # the same words in another order are no copy
        for t in [*texts, shuffled]:
            of[len(rows)] = t
            rows.append((len(rows), t))
    large = rng.choices(vocabulary, k=200)
    rows += [(1000 + i, _edited(rng, large, 1)) for i in range(400)]
    found = {r.doc_id: r.component for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({found[i] for i in found if i >= 1000}) == 1
    near = missed = 0
    for base in range(0, 360, 6):
        for a in range(base, base + 6):
            for b in range(a + 1, base + 6):
                same, r = found[a] == found[b], _resemblance(of[a], of[b])
                near, missed = near + (r >= 0.8), missed + (r >= 0.8 and not same)
                assert not (b == base + 5 and same)
    assert near > 300 and missed <= 0.05 * near
    assert len({found[i] for i in range(0, 360, 6)}) == 60


def test_near_copies_of_odd_rows(spark, small_docs, no_docs):
    odd = simhash.near_copies(small_docs).collect()
    assert len(odd) == small_docs.count() and all(r.component_id is not None for r in odd if r.doc_id is not None)
    empty = {r.component for r in odd if r.doc_id in (2, 3, 5)}
    assert len(empty) == 1 and simhash.near_copies(no_docs).count() == 0


def test_dealing_and_buckets_grow_together():
    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    for buckets in (1, 50):
        rows = list(simhash._deal(values, buckets))
        held = sum(len(simhash._unpack(b)[0]) for _, b in rows)
        odd = int((np.bitwise_count(values) % 2).sum())
        assert held == odd * simhash.ODD_MASKS + (len(values) - odd) * len(simhash.MASKS)
