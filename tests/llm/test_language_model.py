import math
import random
from collections import Counter

import numpy as np

from tessera.llm import common
from tessera.llm import language_model as lm


def _docs():
    rng = random.Random(8)
    phrases = [[f"p{k}w{i}" for i in range(6)] for k in range(12)]
    rows = []
    for i in range(260):
        words = [w for _ in range(rng.randrange(1, 8)) for w in rng.choice(phrases)]
        rows.append((i, " ".join(words) + (" Rare%d" % i if i % 3 else ""), "en", "s", 0))
    return [*rows, (900, None, "en", "s", 0), (901, "", "en", "s", 0)]


def test_base_counts_and_scores(spark, docs_dir):
    rows = _docs()
    got = {r.doc_id: r for r in lm.op5_language_model(spark, docs_dir(rows)).collect()}
    tokens = {i: (t or "").encode().lower().split() + [b"\0end"] for i, t, *_ in rows}
    held = {i for i in tokens if common.local_fold(i, 10) == 0}
    counts = Counter(w for i, own in tokens.items() if i not in held for w in own)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for i, own in tokens.items():
        r = got[i]
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(own), sum(w in counts for w in own), n)
        assert math.isclose(r.base_score, want, rel_tol=1e-9)
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_scores_do_not_depend_on_blocks_or_ranges(spark):
    documents = spark.createDataFrame(_docs(), "doc_id long, text string, lang string, source string, n_chars long")
    one = {r.doc_id: r.score for r in lm.score(documents.coalesce(1)).collect()}
    many = {r.doc_id: r.score for r in lm.score(documents.repartition(3, "doc_id"), lm.Config(block_tokens=300, keys_per_range=200)).collect()}
    assert one.keys() == many.keys() and all(math.isclose(one[k], many[k], rel_tol=1e-9) for k in one)


def test_scores_equal_a_brute_force_mixture(spark):
    rows = _docs()
    rng = np.random.default_rng(4)
    weights = rng.random((lm.BUCKETS, 4))
    weights /= weights.sum(axis=1, keepdims=True)
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.score for r in lm.score(documents, lm.Config(block_tokens=900, keys_per_range=500), weights).collect()}
    tokens = {i: ["^", "^", *(t or "").lower().split(), "$"] for i, t, *_ in rows}
    grams = [Counter() for _ in range(4)]  # by length; those of length 2 and 3 also stand for contexts
    for i, own in tokens.items():
        if common.local_fold(i, 10) == 0:
            continue
        for k in range(2, len(own)):
            for n in (1, 2, 3):
                grams[n][tuple(own[k - n + 1 : k + 1])] += 1
    starts = sum(common.local_fold(i, 10) != 0 for i in tokens)
    total, words = sum(grams[1].values()), len(grams[1])

    def seen(context):
        return starts if set(context) == {"^"} else grams[len(context)][context]

    def bucket(c):
        return c if c < 4 else min(int(math.log2(c)) + 2, 15)

    for i, own in tokens.items():
        want = 0.0
        for k in range(2, len(own)):
            c2, c3 = seen(tuple(own[k - 1 : k])), seen(tuple(own[k - 2 : k]))
            p = [grams[n][tuple(own[k - n + 1 : k + 1])] / c if c else 0.0 for n, c in ((3, c3), (2, c2), (1, total))]
            w = weights[bucket(c3 or c2) + 16 * (c3 > 0)]
            want += math.log10(sum(a * b for a, b in zip(w, [*p, 1 / (words + 1)])))
        assert math.isclose(got[i], want, rel_tol=1e-9), i


def test_sizes_follow_the_tokens():
    config = lm.Config()
    small, large, huge = (lm.Sizes.of(n, config) for n in (10**8, 10**11, 10**13))
    assert small.block_tokens == config.block_tokens and (small.bits, huge.bits) == (48, 64)
    for n, sizes in ((10**11, large), (10**13, huge)):
        keys = 2 * n
        rows = (n / sizes.block_tokens) * sizes.longer
        assert 0.9 < keys / rows / config.least_keys < 1.1  # so rows grow as the tokens do
    assert huge.block_tokens / large.block_tokens < 10.1
    for n in (10**6, 10**8, 10**10, 10**12):
        assert 2 * n / 2 ** lm.Sizes.of(n, config).bits <= 2**-20


def test_estimates_are_distributions():
    texts = [b"a b a c", b"a b", b"c c c a"]
    tokens = lm.Tokens(texts)
    counts = []
    for keys in (tokens.one, tokens.two, tokens.three):
        c = Counter(keys.tolist())
        counts.append(np.array([float(c[k]) for k in keys.tolist()]))
    bucket, p3, p2, p1 = lm.estimates(counts, tokens.begin, len(tokens.one), 3)
    assert math.isclose(p1[0], 3 / 13 + 1 / 13) and math.isclose(p2[0], 2 / 3) and math.isclose(p3[0], 2 / 3)
    assert math.isclose(p2[1], 2 / 4) and math.isclose(p3[1], 2 / 2)
    by_context = {}
    seen = {}
    for d, t in enumerate(texts):
        words = [b"^", *t.split(), b"$"]
        for k, (u, w) in enumerate(zip(words, words[1:])):
            seen[u, w] = p2[tokens.begin[d] + k]
    for (u, _), p in seen.items():
        by_context[u] = by_context.get(u, 0) + p
    assert all(math.isclose(x, 1) for x in by_context.values())
    assert bucket.max() < lm.BUCKETS


def test_expectation_maximisation_finds_the_mixture():
    rng = np.random.default_rng(0)
    good, poor = np.full(4000, 0.5), np.full(4000, 1 / 64)
    used = rng.random(4000) < 0.8
    cells = lm._cells(np.full(4000, 20), np.where(used, good, 0), poor, poor)
    cells, n = np.unique(cells, return_counts=True)
    weights = lm.learn_weights(cells, n.astype(float), 1000)
    assert 0.7 < weights[20, 0] < 0.82 and np.allclose(weights.sum(axis=1), 1)
    assert np.allclose(weights[3], weights[20], atol=1e-3)


def test_packed_integers_round_trip():
    rng = np.random.default_rng(1)
    for top in (1, 200, 2**31, 2**63):
        x = np.unique(rng.integers(0, top, 500, dtype=np.uint64))
        assert (lm.unpack(lm.pack(x)) == x).all() and (lm.unpack_sorted(lm.pack_sorted(x)) == x).all()
    assert len(lm.unpack(lm.pack(np.zeros(0, np.uint64)))) == 0


def test_odd_rows(spark, small_docs, no_docs):
    out = lm.score(small_docs).collect()
    assert len(out) == small_docs.count() and all(r.score < 0 for r in out)
    assert lm.score(no_docs).count() == 0
