"""Language-model scores by deleted interpolation (Jelinek and Mercer, 1980).

Maximum-likelihood estimates of orders 3, 2 and 1 and a uniform one are mixed with weights that depend on how often
the context was seen. The weights are learned by expectation-maximisation on held-out counts: of a fold of the training
documents, each is judged by the counts of all others, its own being deleted. For that the tokens of the fold are
counted on a grid of (context bucket, rounded log estimates), which is all that reaches the driver and is bounded by
the grid.

The corpus is cut into blocks of whole documents, about ``block_tokens`` each, written to the shared folder. A block asks
for the counts of its distinct n-grams, as sorted hashes dealt to ranges of the hash; each range sums what the blocks
counted and answers every block in the order it asked. So an n-gram takes a few bytes a block in the shuffle, however
often it occurs, and no word is hot. Every count covers all training documents.

Sizes follow the corpus (``Sizes``). Rows of the exchange number blocks times ranges; both grow with the root of the
tokens once a row would hold fewer than ``least_keys`` keys, so the rows grow in proportion to the tokens, and a task's
memory with their root. Tasks number in proportion to ranges and blocks. Words are told apart by 64 bits. Longer n-grams have 20 bits more than the corpus needs to
number its tokens, up to 64: an n-gram meets another by chance with probability 2^-20 at most, whatever the size.

Defined cases: a null or empty text is one end token; without training documents only the uniform estimate is left;
repeated rows are documents of their own; rows without doc_id are in the fold of the empty text; an empty table gives
none; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import Scratch

BUCKETS = 32
RANGES_PER_TASK = BLOCKS_PER_TASK = 4
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
END, START = np.uint64(0x1F3D5B79AB12CD34), np.uint64(0x5A17C0DE83F2961B)
_PAIR, _TRIPLE = np.uint64(0x27D4EB2F165667C5), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Config:
    block_tokens: int = 800_000
    keys_per_range: int = 1_500_000
    least_keys: int = 64
    spare_bits: int = 20
    folds: int = 10
    held_out: int = 0
    tuning: int = 1
    rounds: int = 60
    least_uniform: float = 1e-4


@dataclass(frozen=True)
class Sizes:
    """What follows the number of tokens: a block's tokens, a range's keys, ranges of longer n-grams and of words, bits of a key."""

    block_tokens: int
    longer: int
    words: int
    bits: int

    @staticmethod
    def of(tokens: int, config: Config) -> "Sizes":
        # A block's 2 keys a token are dealt to 1.5 tokens / keys_per_range ranges.
        grown = max(1.0, math.sqrt(config.least_keys * tokens / (1.3 * config.block_tokens * config.keys_per_range)))
        longer = max(1, -(-tokens * 3 // 2 // int(config.keys_per_range * grown)))
        bits = min(64, max(40, (tokens + 1).bit_length() + 1 + config.spare_bits))
        return Sizes(int(config.block_tokens * grown), longer, max(1, longer // 8), bits)


class _Words(dict):
    """Word to 64-bit hash; forgets everything when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed; empty planes take no room."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + b
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


class Tokens:
    """A block's tokens: hashes of words and ends, each document's bounds, and the keys of its n-grams."""

    def __init__(self, texts: list[bytes], bits: int = 64) -> None:
        shift = np.uint64(64 - bits)
        words = [t.lower().split() for t in texts]
        self.length = np.array([len(own) + 1 for own in words], np.int64)
        self.end = self.length.cumsum()
        self.begin = self.end - self.length
        with np.errstate(over="ignore"):
            self.one = np.full(int(self.length.sum()), END)
            inside = np.ones(len(self.one), bool)
            inside[self.end - 1] = False
            self.one[inside] = np.fromiter(map(_words.__getitem__, chain.from_iterable(words)), np.uint64)
            del words, inside
            before, early = np.empty_like(self.one), np.empty_like(self.one)
            before[1:], early[2:] = self.one[:-1], self.one[:-2]
            before[self.begin] = early[self.begin] = START
            second = self.begin[self.length > 1] + 1
            early[second] = START
            self.two = _mix(before ^ _PAIR, self.one) >> shift
            self.three = _mix(_mix(early ^ _TRIPLE, before), self.one) >> shift

    def of(self, documents: np.ndarray) -> np.ndarray:
        """Which tokens belong to the documents that are marked."""
        return np.repeat(documents, self.length)


def _ranges(keys: np.ndarray, bits: int, count: int) -> list[int]:
    """Where ``count`` equal ranges of the hash begin in sorted keys, and their end."""
    edges = [min((i << bits) // count, (1 << bits) - 1) for i in range(1, count)]
    return [0, *np.searchsorted(keys, np.array(edges, np.uint64)).tolist(), len(keys)]


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins in a sorted array."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how many of each are in training documents."""
    ordered, learnt = np.sort(keys), np.sort(keys[train])
    distinct = ordered[_firsts(ordered)]
    counts = np.zeros(len(distinct), np.int64)
    first = _firsts(learnt)
    counts[np.searchsorted(distinct, learnt[first])] = np.diff(first, append=len(learnt))
    return distinct, counts


def _spread(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """At every key the value of its place among the distinct keys in order."""
    order = np.argsort(keys)
    ordered = keys[order]
    rank = np.zeros(len(keys), np.int64)
    rank[1:] = (ordered[1:] != ordered[:-1]).cumsum()
    out = np.empty(len(keys), float)
    out[order] = values[rank]
    return out


def blocks(documents: DataFrame, config: Config, block_tokens: int) -> DataFrame:
    """One row for each block: its documents' ids, folds and texts."""
    base = documents.select("doc_id", common.fold(config.folds).cast("int").alias("__fold"), "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"block long, tuning boolean, tokens long, train_tokens long, train_documents long, ids array<{kind}>, folds binary, sizes binary, texts binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held = {True: ([], [], [], []), False: ([], [], [], [])}  # tuning documents are apart from others
        number, full = 0, {True: 0, False: 0}

        def row(tuning: bool) -> pa.RecordBatch:
            nonlocal number
            ids, folds, texts, counts = held[tuning]
            train = np.array(folds) != config.held_out
            number += 1
            arrays = [
                pa.array([task << 32 | number], pa.int64()),
                pa.array([tuning]),
                pa.array([sum(counts)], pa.int64()),
                pa.array([int(np.array(counts)[train].sum())], pa.int64()),
                pa.array([int(train.sum())], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays(ids)),
                pa.array([np.array(folds, np.uint8).tobytes()], pa.binary()),
                pa.array([np.array([len(t) for t in texts], "<u8").tobytes()], pa.binary()),
                pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(texts))], pa.binary()),
            ]
            held[tuning] = ([], [], [], [])
            names = ["block", "tuning", "tokens", "train_tokens", "train_documents", "ids", "folds", "sizes", "texts"]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            ids, folds = batch.column("doc_id"), batch.column("__fold").to_pylist()
            for i, t in enumerate(common.text_bytes(batch.column("text"))):
                tuning = folds[i] == config.tuning
                own = held[tuning]
                own[0].append(ids.slice(i, 1)), own[1].append(folds[i]), own[2].append(t or b"")
                own[3].append(len((t or b"").split()) + 1)
                full[tuning] += own[3][-1]
                if full[tuning] >= block_tokens:
                    full[tuning] = 0
                    yield row(tuning)
        for tuning in (True, False):
            if held[tuning][1]:
                yield row(tuning)

    return base.mapInArrow(cut, schema)


def _texts(row: dict) -> tuple[list[bytes], np.ndarray]:
    sizes = np.frombuffer(row["sizes"], "<u8").astype(np.int64)
    joined = zstandard.ZstdDecompressor().decompress(row["texts"]) if sizes.sum() else b""
    ends = sizes.cumsum().tolist()
    return [joined[e - s : e] for s, e in zip(sizes.tolist(), ends)], np.frombuffer(row["folds"], np.uint8)


def requests(block_rows: DataFrame, config: Config, sizes: Sizes) -> DataFrame:
    """(range, block, keys, counts): what each block asks of each range, and what it counted there itself."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("block", "folds", "sizes", "texts")}
                texts, folds = _texts(row)
                tokens = Tokens(texts, sizes.bits)
                train = tokens.of(folds != config.held_out)
                out: list[tuple[int, bytes, bytes]] = []
                for keys, learnt, bits, count, first in (
                    (np.concatenate([tokens.two, tokens.three]), np.concatenate([train, train]), sizes.bits, sizes.longer, 0),
                    (tokens.one, train, 64, sizes.words, sizes.longer),
                ):
                    distinct, counts = _counted(keys, learnt)
                    at = _ranges(distinct, bits, count)
                    out += [
                        (first + k, pack_sorted(distinct[a:b]), pack(counts[a:b])) for k, (a, b) in enumerate(zip(at, at[1:])) if a < b
                    ]
                ranges, packed, counted = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ranges, pa.int32()), pa.array([row["block"]] * len(out), pa.int64()), pa.array(packed, pa.binary()), pa.array(counted, pa.binary())],
                    names=["range", "block", "keys", "counts"],
                )

    return block_rows.select("block", "folds", "sizes", "texts").mapInArrow(asked, "range int, block long, keys binary, counts binary")


def answers(asked: DataFrame, sizes: Sizes) -> DataFrame:
    """(block, range, counts, known): the counts of all blocks in the order of the request; known: its learnt words."""
    parts = max(1, (sizes.longer + sizes.words) // RANGES_PER_TASK)

    def summed(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(b) for b in table.column("keys").to_pylist()]
        counts = [unpack(b) for b in table.column("counts").to_pylist()]
        own = np.concatenate([k[c > 0] for k, c in zip(keys, counts)])
        weight = np.concatenate([c[c > 0] for c in counts])
        del counts
        order = np.argsort(own)
        own, weight = own[order], weight[order]
        del order
        first = _firsts(own)
        distinct = own[first]
        total = np.add.reduceat(weight, first) if len(own) else np.zeros(0, np.uint64)
        replies = []
        for k in keys:
            at = np.minimum(np.searchsorted(distinct, k), max(0, len(distinct) - 1))
            replies.append(pack(np.where(distinct[at] == k, total[at], 0)) if len(distinct) else pack(np.zeros(len(k), np.uint64)))
        known = [len(distinct)] + [0] * (len(keys) - 1)
        return pa.table(
            {"block": table.column("block"), "range": table.column("range"), "counts": pa.array(replies, pa.binary()), "known": pa.array(known, pa.int64())}
        )

    return asked.repartition(parts, "range").groupBy("range").applyInArrow(summed, "block long, range int, counts binary, known long")


def _gathered(row: dict, replies: pa.Table, sizes: Sizes) -> tuple[Tokens, np.ndarray, list[np.ndarray]]:
    """A block's tokens and folds, and the counts of orders 1 to 3 at every token."""
    texts, folds = _texts(row)
    tokens = Tokens(texts, sizes.bits)
    ranges = replies.column("range").to_numpy()
    blobs = replies.column("counts").to_pylist()
    order = np.argsort(ranges, kind="stable")
    many = [unpack(blobs[i]) for i in order if ranges[i] < sizes.longer]
    few = [unpack(blobs[i]) for i in order if ranges[i] >= sizes.longer]
    n = len(tokens.one)
    longer_counts = _spread(np.concatenate([tokens.two, tokens.three]), np.concatenate(many))
    return tokens, folds, [_spread(tokens.one, np.concatenate(few)), longer_counts[:n], longer_counts[n:]]


@dataclass(frozen=True)
class Totals:
    tokens: int
    documents: int
    words: int


def estimates(counts: list[np.ndarray], begin: np.ndarray, total: np.ndarray | float, documents: np.ndarray | float) -> tuple:
    """(bucket, p3, p2, p1) at every token. Counts of contexts are those of the n-grams that end one token before."""
    c1, c2, c3 = counts
    seen1, seen2 = np.empty_like(c1), np.empty_like(c1)
    seen1[1:], seen2[1:] = c1[:-1], c2[:-1]
    seen1[begin] = seen2[begin] = documents
    p1 = c1 / np.maximum(total, 1)
    p2 = np.divide(c2, seen1, out=np.zeros_like(c2), where=seen1 > 0)
    p3 = np.divide(c3, seen2, out=np.zeros_like(c3), where=seen2 > 0)
    # Counts up to 3 have a bucket each, as deletion matters most there; larger ones share one by their logarithm.
    seen = np.maximum(np.where(seen2 > 0, seen2, seen1), 0)
    level = np.where(seen < 4, seen, np.minimum(np.log2(np.maximum(seen, 1)) + 2, 15)).astype(np.int64)
    return level + np.where(seen2 > 0, 16, 0), np.minimum(p3, 1), np.minimum(p2, 1), np.minimum(p1, 1)


def _less_own(tokens: Tokens, document: int, counts: list[np.ndarray]) -> list[np.ndarray]:
    """Counts at a document's tokens without the document's own occurrences."""
    a, b = int(tokens.begin[document]), int(tokens.end[document])
    out = []
    for keys, c in zip((tokens.one, tokens.two, tokens.three), counts):
        _, back, n = np.unique(keys[a:b], return_inverse=True, return_counts=True)
        out.append(np.maximum(c[a:b] - n[back], 0))
    return out


def _cells(bucket: np.ndarray, p3: np.ndarray, p2: np.ndarray, p1: np.ndarray) -> np.ndarray:
    """Tokens on the grid: the bucket and each estimate's logarithm to base 2, rounded to halves (63: zero)."""
    cell = bucket.astype(np.int64)
    for p in (p3, p2, p1):
        with np.errstate(divide="ignore"):
            step = np.where(p > 0, np.minimum(np.rint(-2 * np.log2(np.maximum(p, 1e-300))), 62), 63).astype(np.int64)
        cell = cell * 64 + step
    return cell


def learn_weights(cells: np.ndarray, tokens: np.ndarray, words: int, config: Config = Config()) -> np.ndarray:
    """Weights (bucket, estimate of order 3, 2, 1, 0), by expectation-maximisation over the grid."""
    steps = [(cells // 64**k) % 64 for k in (2, 1, 0)]
    p = np.stack([np.where(s == 63, 0.0, 2.0 ** (-s / 2)) for s in steps] + [np.full(len(cells), 1.0 / (words + 1))], axis=1)
    bucket = cells // 64**3
    weights = np.tile(np.array([0.3, 0.3, 0.3, 0.1]), (BUCKETS, 1))
    whole = np.bincount(bucket, tokens, BUCKETS)
    for _ in range(config.rounds):
        share = weights[bucket] * p
        share *= (tokens / share.sum(axis=1))[:, None]
        grown = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(4)], axis=1)
        weights = np.where(whole[:, None] > 0, grown / np.maximum(whole, 1e-9)[:, None], weights)
    # Buckets without a held-out token learn from all of them; the uniform estimate keeps a little everywhere.
    pooled = (weights * whole[:, None]).sum(axis=0) / max(whole.sum(), 1e-9) if whole.sum() else weights[0]
    weights = np.where(whole[:, None] >= 50, weights, pooled[None, :])
    weights[:, 3] = np.maximum(weights[:, 3], config.least_uniform)
    return weights / weights.sum(axis=1, keepdims=True)


def score(documents: DataFrame, config: Config = Config(), weights: np.ndarray | None = None) -> DataFrame:
    """(doc_id, fold, n_tokens, n_known, train_tokens, base_score, score) for every document.

    ``weights`` (bucket, estimate of order 3, 2, 1, 0) are learned unless they are given.
    """
    spark: SparkSession = documents.sparkSession
    scratch = Scratch(spark, "language-model")
    measure = documents.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    sizes = Sizes.of(measure.b // 6 + measure.n, config)  # a word and its space take about six bytes
    rows = scratch.write(blocks(documents, config, sizes.block_tokens), compression="none")
    size = rows.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)), F.coalesce(F.sum("train_documents"), F.lit(0)), F.count("*")).first()
    longer = sizes.longer
    replies = scratch.write(answers(requests(rows, config, sizes), sizes), compression="none")
    known = replies.where(F.col("range") >= longer).agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    totals = Totals(int(size[0]), int(size[1]), int(known))

    def held_out_cells(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        for row in left.to_pylist():
            tokens, _, counts = _gathered(row, right, sizes)
            for d in range(len(tokens.length)):
                own = _less_own(tokens, d, counts)
                n = int(tokens.length[d])
                found.append(_cells(*estimates(own, np.array([0]), totals.tokens - n, totals.documents - 1)))
        cells, count = np.unique(np.concatenate(found), return_counts=True)
        return pa.table({"cell": cells, "n": count.astype(np.int64)})

    names = ["block", "folds", "sizes", "texts"]
    if weights is None:
        chosen = replies.join(rows.where("tuning").select("block"), "block", "left_semi")
        grid = (
            rows.where("tuning")
            .select(*names)
            .groupBy("block")
            .cogroup(chosen.groupBy("block"))
            .applyInArrow(held_out_cells, "cell long, n long")
            .groupBy("cell")
            .agg(F.sum("n").alias("n"))
            .toPandas()  # no more rows than the grid has cells, however large the corpus
        )
        weights = learn_weights(grid["cell"].to_numpy(np.int64), grid["n"].to_numpy(float), totals.words, config)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i, row in enumerate(left.select(names).to_pylist()):
            tokens, folds, counts = _gathered(row, right, sizes)
            bucket, *p = estimates(counts, tokens.begin, totals.tokens, totals.documents)
            w = weights[bucket]
            mixed = w[:, 0] * p[0] + w[:, 1] * p[1] + w[:, 2] * p[2] + w[:, 3] / (totals.words + 1)
            base = (counts[0] + 0.1) / (totals.tokens + 0.1 * (totals.words + 1))
            begin = tokens.begin
            out.append(
                pa.table(
                    {
                        "doc_id": left.column("ids")[i].values,
                        "fold": pa.array(folds, pa.int32()),
                        "n_tokens": tokens.length,
                        "n_known": np.add.reduceat((counts[0] > 0).astype(np.int64), begin),
                        "train_tokens": np.full(len(begin), totals.tokens, np.int64),
                        "base_score": np.add.reduceat(np.log10(base), begin),
                        "score": np.add.reduceat(np.log10(mixed), begin),
                    }
                )
            )
        return pa.concat_tables(out)

    parts = max(1, size[2] // BLOCKS_PER_TASK)
    return (
        rows.select("ids", *names)
        .repartition(parts, "block")
        .groupBy("block")
        .cogroup(replies.repartition(parts, "block").groupBy("block"))
        .applyInArrow(
            scored, f"doc_id {kind}, fold int, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        )
    )


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", (F.col("fold") == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
