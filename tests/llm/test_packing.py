import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tessera.llm import packing, tokens


def test_runs_encode_like_whole_texts():
    direct, own = Tokenizer.from_file(tokens.default_path()), tokens.RunTokens(tokens.default_path(), most=50)
    rng = random.Random(2)
    alphabet = "aAbB'sStLl éÉé  \x1c\n\t.,!?0129ΣσςİıßﬁÅ̧🙂<|endoftext|>‍漢字"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 25))) for _ in range(3000)]
    texts += ["<|ENDOFTEXT|> x", "a <|endoftext|>b.", "x" * 3000, "word " * 300_000]
    for t in texts:
        assert np.frombuffer(own.encode(t.encode()), "<u4").tolist() == direct.encode(t, add_special_tokens=False).ids


def test_texts_encode_together_as_apart(monkeypatch):
    direct = Tokenizer.from_file(tokens.default_path())
    rng = random.Random(6)
    alphabet = "abstvremld'\"$%&*|<>-_.,!?09  \n\x0b\x1c\x85ßẞÀàÿŸ×÷µªéÉ\u0301İK漢🙂"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    texts += ["", " ", "'s''t$'re", "x" * 64 + "ß" * 40, "a1b2" * 100 + ".", "Bad <|endoftext|> <|ENDOFTEXT|> A<|b", "word, Word$$$ " * 400]
    want = [direct.encode(t, add_special_tokens=False).ids for t in texts]
    for most, part in ((1_000_000, 1 << 22), (40, 1 << 22), (300, 1000)):
        monkeypatch.setattr(tokens, "PART", part)
        own = tokens.RunTokens(tokens.default_path(), most)
        got = [x for at in range(0, len(texts), 500) for x in own.encode_all([t.encode() for t in texts[at : at + 500]])]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_what_a_worker_remembers_is_bounded():
    own = tokens.RunTokens(tokens.default_path(), most=1000)
    own.encode_all([b"%d%s" % (i, b"x" * 300) for i in range(2000)])  # long runs are used, not kept
    assert len(own.runs) == 0
    for k in range(20):
        own.encode_all([b"the same words " + b" ".join(b"w%d.%d" % (k, i) for i in range(200))])
        assert len(own.runs) <= 1000 and own.runs.nbytes + own.ids.nbytes < 100_000 and len(own.pieces) <= 100
    made = []
    own._run = lambda run: made.append(run) or b""
    own.encode(b"the same words new new")
    assert made == [b"new"]  # what is asked for stays; a run is made once


def test_batches_are_taken_in_small_parts():
    texts = ["x" * 50, None, "", "y" * 500, "z", "z" * 30] * 20
    batch = pa.RecordBatch.from_pydict({"text": texts})
    found = list(packing._slices(iter([batch, batch.slice(0, 0), batch.slice(3, 5)]), 100))
    assert [t for x in found for t in x.column("text").to_pylist()] == [*texts, *texts[3:8]]
    assert all(x.num_rows == 1 or sum(len(t or "") for t in x.column("text").to_pylist()) <= 100 for x in found)


def _valid(bins, lengths, capacity):
    assert sorted(i for own in bins.items for i in own) == list(range(len(lengths)))
    assert all(capacity - sum(lengths[i] for i in own) == r >= 0 for own, r in zip(bins.items, bins.room))


def test_operators_keep_packings_whole():
    rng = random.Random(4)
    lengths = [rng.randrange(1, 60) for _ in range(300)]
    order = list(range(300))
    a = packing.best_fit(sorted(order, key=lambda i: -lengths[i]), lengths, 100)
    b = packing.best_fit(rng.sample(order, 300), lengths, 100)
    _valid(a, lengths, 100), _valid(b, lengths, 100)
    _valid(packing.crossover(a, b, lengths, rng), lengths, 100)
    _valid(packing.mutate(b, lengths, rng), lengths, 100)
    config = packing.Config(capacity=100)
    start = [packing._labels(b, 300)]
    best, _ = packing.evolve(lengths, start, config, 1)
    assert best[0].max() + 1 <= len(b.items)


def test_best_fit_is_the_tightest_bin():
    bins = packing.Bins(10)
    for room in (7, 4, 5):
        bins.add([], room)
    bins.fit(0, 4)
    assert bins.items[1] == [0] and bins.room[1] == 0
    bins.fit(1, 6)
    assert bins.items[0] == [1]


def _triples(n, capacity, seed=9):
    """Triples that fill a bin exactly; best fit by decreasing length finds few of them."""
    rng, lengths = random.Random(seed), []
    for _ in range(n):
        a = rng.randrange(capacity * 26 // 100, capacity * 48 // 100)
        b = rng.randrange(capacity * 26 // 100, min(capacity * 48 // 100, capacity * 3 // 4 - a))
        lengths += [a, b, capacity - a - b]
    return lengths


def _best_fit(lengths, capacity):
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    return len(packing.best_fit(order, lengths, capacity).items)


def test_evolution_beats_best_fit_where_that_is_not_optimal():
    for n, seed in ((40, 9), (40, 10), (200, 11)):
        lengths = _triples(n, 2048, seed)
        config = packing.Config(generations=40)
        best, crossed = packing.evolve(lengths, [], config, 3)
        best, more = packing.evolve(lengths, best, config, 4)
        assert n <= best[0].max() + 1 < _best_fit(lengths, 2048) and crossed and more
        _valid(packing._bins(best[0], lengths, 2048), lengths, 2048)


def test_packing_beats_best_fit_on_planted_triples(spark):
    lengths = _triples(60, 2048)
    rows = [(i, "the " * (n - 1)) for i, n in enumerate(lengths)]
    packed, report = packing.pack_and_report(spark.createDataFrame(rows, "doc_id long, text string"))
    rows = packed.collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    got, level = len({r.sequence_id for r in rows}), report.first()
    assert 60 <= got < _best_fit(lengths, 2048) == level.best_fit and got == level.bins
    assert level.crossovers > 0 and level.above_bound == 1


def test_levels_win_back_what_blocks_waste(spark):
    rng = random.Random(3)
    rows = [(i, "the " * rng.choice([rng.randrange(1, 60), rng.randrange(300, 900)])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    packed, report = packing.pack_and_report(df, packing.Config(block=60, generations=2, rounds=1))
    rows, levels = packed.collect(), report.orderBy("level").collect()
    assert len(rows) == 900 and len(levels) > 1 and levels[-1].reopened == 0
    bound = -(-sum(r.length for r in rows) // 2048)
    assert len({r.sequence_id for r in rows}) < levels[0].bins and len({r.sequence_id for r in rows}) <= bound + 1 + len(levels)


def test_pack_places_every_piece_once(spark, small_docs, no_docs):
    config = packing.Config(capacity=64, block=10)
    rows = packing.pack(small_docs, config, with_ids=True).collect()
    direct = Tokenizer.from_file(tokens.default_path())
    want = []
    for r in small_docs.collect():
        ids = direct.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 64)):
            own = np.array(ids[at : at + 64], "<u4").tobytes()
            want.append((r.doc_id, k, at, len(own) // 4, zlib.crc32(own), own))
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(no_docs, config).count() == 0


def test_packing_is_near_the_bound(spark):
    rows = [(i, "word " * (37 * i % 300)) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    bound = -(-sum(r.length for r in got) // 2048)
    assert len({r.sequence_id for r in got}) <= bound + 1
