import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import common, quality_classifier, quality_rules, toxicity

BAD = ["grubby", "snarl", "vexing", "blight"]


def _corpus(n=240, seed=3):
    rng = random.Random(seed)
    words = [a + b for a in ("ta", "re", "no", "li", "mo", "su") for b in ("ne", "ri", "ka", "do", "th", "ple")]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        own = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        if toxic:
            for w in rng.sample(BAD, 2):
                own.insert(rng.randrange(len(own)), w)
        junk = i % 5 == 0
        text = " ".join(w.upper() + "!!###" if junk else w for w in own) + "."
        rows.append((i, text, rng.choice(["en", "de"]), "s", len(text)))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def test_toxicity_learns_from_the_training_fold_alone(spark, docs_dir):
    rows, labels = _corpus()
    flipped = [(i, q, 1 - t if common.local_fold(i, 3) == 1 else t) for i, q, t in labels]
    first = {r.doc_id: r for r in toxicity.op1_toxicity(spark, docs_dir(rows, labels=labels)).collect()}
    truth = {i: t for i, _, t in labels}
    held = [r for r in first.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if common.local_fold(i, 3) == 1}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in first.values())
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    other = toxicity.fit(documents, toxicity.learnable(spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")))
    again = {r.doc_id: r.toxicity for r in toxicity.score(documents, other).collect()}
    assert all(abs(again[i] - r.score) < 1e-12 for i, r in first.items())


def _tiny_model(rng, words=7, d=3, f=4, widths=(1, 2, 3)):
    slots = {"e": rng.normal(size=(words + 1, d)), "d": rng.normal(size=f * len(widths)), "db": rng.normal(size=1)}
    slots["e"][0] = 0
    slots |= {f"k{w}": rng.normal(size=(w, d, f)) for w in widths} | {f"b{w}": rng.normal(size=f) for w in widths}
    return slots, widths


def _score_by_hand(slots, widths, rows):
    """Every filter at every window of the text, one product at a time; the text is followed by places without a word."""
    padded, pooled = [*rows, *[0] * max(widths)], []
    for w in widths:
        for k in range(slots[f"b{w}"].shape[0]):
            values = []
            for at in range(max(1, len(rows) + max(widths) - w + 1)):
                values.append(sum(slots["e"][padded[at + j]][c] * slots[f"k{w}"][j][c][k] for j in range(w) for c in range(slots["e"].shape[1])))
            pooled.append(max(0.0, max(values) + slots[f"b{w}"][k]))
    z = sum(a * b for a, b in zip(pooled, slots["d"])) + slots["db"][0]
    return 1 / (1 + np.exp(-z))


def test_convolution_by_hand():
    rng = np.random.default_rng(6)
    slots, widths = _tiny_model(rng)
    model = toxicity.Model(np.arange(7, dtype=np.uint32), slots["e"], {w: slots[f"k{w}"] for w in widths}, {w: slots[f"b{w}"] for w in widths}, slots["d"], slots["db"][0])
    documents = [rng.integers(0, 8, n) for n in (0, 1, 2, 3, 9, 40)]
    got = toxicity.predict(model, model.tables(), documents)
    assert np.allclose(got, [_score_by_hand(slots, widths, d.tolist()) for d in documents])


def test_gradient_by_differences():
    rng = np.random.default_rng(8)
    slots, widths = _tiny_model(rng)
    documents, labels = [rng.integers(1, 8, n) for n in (3, 5, 8, 12)], np.array([1.0, 0.0, 0.0, 1.0])

    def loss():
        p = np.array([_score_by_hand(slots, widths, d.tolist()) for d in documents])
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grad = toxicity.gradient(slots, documents, labels, widths)
    for name, values in slots.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in values.shape)
            if name == "e" and at[0] == 0:
                continue  # the row of no word stays zero
            before, h = values[at], 1e-5
            values[at] = before + h
            up = loss()
            values[at] = before - h
            down = loss()
            values[at] = before
            assert abs((up - down) / (2 * h) - grad[name][at]) < 1e-6, (name, at)


def test_samples_hold_one_text_for_each_id_and_keep_their_bounds(spark):
    rows, labels = _corpus(120)
    documents = spark.createDataFrame(rows + rows[:1] * 300 + [(0, "another text", "en", "s", 0)] * 5, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels + labels, "doc_id long, quality int, toxic int")
    kept = toxicity._sample(documents, marks, toxicity.Config(max_documents=50))
    assert len(kept) == 50 and len({r[2] for r in kept}) == 50 and [r[2] for r in kept] == sorted(r[2] for r in kept)
    few = toxicity._sample(documents, marks, toxicity.Config(max_documents=50, max_tokens=300))
    assert few and sum(len(r[1]) for r in few) <= 300 < sum(len(r[1]) for r in kept[: len(few) + 1])
    assert toxicity._sample(documents, marks, toxicity.Config(max_tokens=1)) == []
    forest = quality_classifier.fit(documents, marks, quality_classifier.Config(max_rows=60))
    again = quality_classifier.fit(documents.dropDuplicates(), marks, quality_classifier.Config(max_rows=60))
    assert np.array_equal(forest.threshold, again.threshold) and np.array_equal(forest.value, again.value)


def test_toxicity_of_odd_rows(spark, small_docs, no_docs):
    model = toxicity.train([np.array([1, 2], np.uint32), np.array([3], np.uint32)] * 20, np.array([1, 0] * 20))
    out = toxicity.score(small_docs, model).collect()
    assert len(out) == small_docs.count() and all(0 <= r.toxicity <= 1 for r in out)
    assert len({r.toxicity for r in out if not (r.text or "").strip()}) == 1
    assert toxicity.score(no_docs, model).count() == 0
    one_class = toxicity.train([np.array([1], np.uint32)] * 3, np.zeros(3))
    assert abs(toxicity.predict(one_class, one_class.tables(), [np.zeros(0, np.int64)])[0] - 0.125) < 1e-6
    clash = small_docs.withColumnRenamed("size", "toxicity")
    assert toxicity.score(clash, model).schema["toxicity"].dataType.simpleString() == "double"


def test_thresholds_follow_the_languages_clean_scores():
    config = toxicity.Config(min_language=10)
    model = toxicity.train([], np.zeros(0), config)
    scores, labels = np.array([0.9] * 20 + [0.2] * 20 + [0.99] * 5), np.array([0] * 40 + [1] * 5)
    toxicity.calibrate(model, scores, labels, ["de"] * 20 + ["en"] * 20 + ["fr"] * 5, config)
    assert model.thresholds["de"] == 0.9 and model.thresholds["en"] == 0.5
    assert model.thresholds["fr"] == model.default_threshold


def test_thresholds_count_all_labelled_rows_that_training_left(spark):
    rows, labels = _corpus(500, seed=8)
    # Clean documents of the small language use the words of toxic ones.
    rows = [(i, t + " " + BAD[i % 3], "xx", s, n) if i % 10 == 1 else (i, t, lang, s, n) for i, t, lang, s, n in rows]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    config = toxicity.Config(max_documents=100, min_language=30, max_clean_rejected=0.1)
    model = toxicity.fit(documents, marks, config)
    ranks = {r.doc_id: r.h for r in documents.select("doc_id", F.xxhash64(common.id_text()).alias("h")).collect()}
    trained = sorted(ranks, key=ranks.get)[:100]
    scores = {r.doc_id: r.toxicity for r in toxicity.score(documents, model).collect()}
    for name in ("xx", "en", "de"):
        clean = [scores[i] for i, _, lang, _, _ in rows if lang == name and labels[i][2] == 0 and i not in trained]
        assert len(clean) >= 30
        edge = (int(np.quantile(clean, 0.9, method="inverted_cdf") * config.bins) + 1) / config.bins
        assert model.thresholds[name] == min(max(edge, 0.5), 0.95)


def test_quality_finds_junk_and_walks_like_a_tree(spark, docs_dir, small_docs, no_docs):
    rows, labels = _corpus()
    out = quality_classifier.op2_quality_classifier(spark, docs_dir(rows, labels=labels)).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in out if r.held_out]
    assert held and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality_classifier.FEATURES)))
    forest = quality_classifier.train(x, (x[:, 3] + x[:, 5] > 0).astype(float))
    for row, got in zip(x[:20], forest.raw(x[:20])):
        want = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            want += v[k - len(f)]
        assert abs(want - got) < 1e-9
    assert ((forest.predict(x) > 0.5) == (x[:, 3] + x[:, 5] > 0)).mean() > 0.9
    scored = quality_classifier.score(small_docs, forest)
    assert scored.count() == small_docs.count() and quality_classifier.score(no_docs, forest).count() == 0


def test_statistics_by_hand():
    text = "The cat #1 | saw THE dog!\nthe cat\n\n  The cat #1 | saw THE dog!  \nÉté représentation? end\tx$"
    words, lines = text.split(), [x.strip() for x in text.split("\n") if x.strip()]
    low, n, c = text.lower().split(), len(text.split()), len(text)
    pairs = Counter(zip(low, low[1:]))
    want = {
        "words": np.log1p(n), "characters": np.log1p(c), "word_length": c / n, "space_share": text.count(" ") / c,
        "upper_share": len(re.findall("[A-Z]", text)) / c, "digit_share": len(re.findall("[0-9]", text)) / c,
        "symbol_share": len(re.findall(r"[#*$%&<>@^~_=+/\\{}\[\]]", text)) / c, "bang_share": text.count("!") / n, "pipe_share": text.count("|") / n,
        "other_punctuation": len(re.findall(r"[?;:'\"(),.-]", text)) / n, "wide_share": len(re.findall("[^\x00-\x7f]", text)) / c,
        "stop_share": sum(w in ("the", "of", "and", "to", "in", "is") for w in low) / n, "line_words": np.log1p(n / len(lines)),
        "unpunctuated_lines": sum(x[-1] not in ".!?:;" for x in lines) / len(lines), "repeated_lines": 1 - len(set(lines)) / len(lines),
        "distinct_words": len(set(low)) / n, "top_word": max(Counter(low).values()) / n, "repeated_pairs": sum(x for x in pairs.values() if x > 1) / n,
        "short_words": sum(len(w.encode()) <= 2 for w in words) / n, "long_words": sum(len(w.encode()) >= 12 for w in words) / n,
        "symbol_words": sum(w[-1] in "#*$%&|" for w in words) / n,
    }
    got = dict(zip(quality_classifier.FEATURES, quality_classifier.statistics(text.encode())))
    for name, value in want.items():
        assert abs(got[name] - value) < 1e-12, name
    assert set(got) - set(want) == {"capital_words"} and not quality_classifier.statistics(None).any()


def test_splits_are_the_best_of_all():
    rng = np.random.default_rng(3)
    x = np.zeros((300, len(quality_classifier.FEATURES)))
    x[:, :4] = rng.normal(size=(300, 4)).round(1)
    y = (x[:, 2] + 0.5 * x[:, 1] + rng.normal(0, 0.5, 300) > 0.4).astype(float)
    config = quality_classifier.Config(trees=1, depth=1, bins=1000)
    forest = quality_classifier.train(x, y, config)
    p = (y.sum() + 0.5) / (len(y) + 1)
    g, h, r = p - y, np.full(len(y), p * (1 - p)), config.ridge

    def gain(left):
        parts = [(g[m].sum(), h[m].sum()) for m in (left, ~left)]
        return sum(a * a / (b + r) for a, b in parts) if min(b for _, b in parts) >= config.least_hessian else -1.0

    best = max((gain(x[:, j] <= t), -j, -t) for j in range(4) for t in np.unique(x[:, j])[:-1])
    got = gain(x[:, forest.feature[0, 0]] <= forest.threshold[0, 0])
    assert abs(got - best[0]) < 1e-9 and forest.feature[0, 0] == 2
    for leaf, own in enumerate((x[:, 2] <= forest.threshold[0, 0], x[:, 2] > forest.threshold[0, 0])):
        assert abs(forest.value[0, leaf] + config.rate * g[own].sum() / (h[own].sum() + r)) < 1e-9


def test_quality_of_clashing_columns(spark, small_docs):
    forest = quality_classifier.Forest(0.0, np.zeros((0, 15), np.int64), np.zeros((0, 15)), np.zeros((0, 16)))
    out = quality_classifier.score(small_docs.withColumnRenamed("size", "quality_score"), forest)
    assert out.columns.count("quality_score") == 1 and {r.quality_score for r in out.collect()} == {0.5}


def _shares(text):
    """Shares of characters in repeated lines and n-grams, and the verdict, by counting."""
    limits = quality_rules.Limits()
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, total = len(words), sum(map(len, words))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    line_share, line_chars = len(again) / len(lines), min(1.0, sum(len(x.replace(" ", "")) for x in again) / total)
    top = dup = chars = 0.0
    for k, limit in limits.top_ngrams:
        counts = Counter(tuple(words[i : i + k]) for i in range(n - k + 1))
        most = max(counts.values(), default=0)
        if most > 1:
            top = max(top, max(most * sum(map(len, g)) for g, c in counts.items() if c == most) / total / limit)
    for k, limit in limits.ngrams:
        counts = Counter(tuple(words[i : i + k]) for i in range(n - k + 1))
        inside = {i + j for i in range(n - k + 1) if counts[tuple(words[i : i + k])] > 1 for j in range(k)}
        share = sum(len(words[i]) for i in inside) / total
        dup, chars = max(dup, share / limit), max(chars, share)
    base = _brute(text)[5]
    kept = not (base or line_share > limits.line_share or line_chars > limits.line_characters or top > 1 or dup > 1)
    return kept, line_share, line_chars, top, dup, chars


def test_shares_and_verdicts_match_counting():
    rng = random.Random(9)
    verdicts = Counter()
    for _ in range(120):
        passages = [" ".join(rng.choice(["é", "w%d" % rng.randrange(400), "zz"]) for _ in range(rng.randrange(3, 25))) for _ in range(6)]
        text = "\n".join(rng.choice(passages) if rng.random() < rng.choice([0.1, 0.4]) else " ".join("v%d" % rng.randrange(900) for _ in range(20)) for _ in range(rng.randrange(3, 14)))
        got, want = quality_rules.measure_text(text.encode()), _shares(text)
        assert got[6] == want[0] and np.allclose(got[7:], want[1:]), text
        verdicts[want[0]] += 1
    assert min(verdicts.values()) > 10


def _brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    covered = {i + k for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_quality_rules_match_brute_force(spark, small_docs, no_docs):
    rng = random.Random(5)
    parts = ["é", "one", "two", "#x", "\n", "a|b", "🙂", "\x1c", " ", "tail", " "]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(0, 120))) for _ in range(200)]
    texts += [r.text for r in small_docs.collect()] + ["alpha beta gamma delta epsilon zeta\n" * 30]
    texts.append(" ".join(f"w{i}" for i in range(300)))
    for t in texts:
        got = quality_rules.measure_text(None if t is None else t.encode())
        assert got[:6] == _brute(t), repr(t)
        assert not (got[5] and got[6])
    assert quality_rules.measure_text(texts[-1].encode())[6] is True
    long = [f"w{i}" for i in range(200)]
    assert quality_rules.measure_text(" ".join(long + long[20:90]).encode())[6] is False
    out = quality_rules.measure(small_docs.withColumnRenamed("size", "n_words"))
    assert out.count() == small_docs.count() and out.schema["n_words"].dataType.simpleString() == "bigint"
    assert quality_rules.measure(no_docs).count() == 0


def test_rolling_hashes_equal_for_equal_windows_only():
    rng = np.random.default_rng(1)
    numbers = rng.integers(0, 3, 400)
    for n, h in quality_rules.rolling(numbers, 6):
        windows = [tuple(numbers[i : i + n]) for i in range(len(numbers) - n + 1)]
        assert len(set(windows)) == len(set(h.tolist())) == len(set(zip(windows, h.tolist())))
