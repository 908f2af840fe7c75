"""Best-fit packing of documents into token sequences, improved by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens. Full pieces are sequences already. The others are dealt by a
hash to blocks of bounded size; each block is packed by several islands, which evolve populations of packings: a
crossover injects whole well-filled bins of one parent into the other, removes the bins that hold duplicates, and
best-fits the displaced pieces in order of decreasing length. Populations begin with best fit by decreasing length and
with orders near it. After each round the best packing of an island migrates to the next island of its block. An island
that meets the lower bound (tokens over capacity) rests, and rounds end when all do.

What blocks waste between them is won back level by level: the pieces of each block's emptiest bins are opened again,
dealt to fewer blocks, and packed by the same islands, until one block is left or no fewer pieces would be.

Only lengths and keys travel between rounds and levels. A block is one row of at most a few thousand pieces however
large the input is, since the number of blocks follows the number of pieces. ``report`` tells for each level what best
fit gave, what the search made of it, the bound, and how many crossovers it took.

Defined cases: a null text is empty; an empty document is one piece holding the end id alone; repeated rows are
packed once each; pieces of equal length are told apart by their place in the input; rows without doc_id are packed
like any other; an empty table gives no piece; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, tokens
from tessera.llm.common import Scratch


@dataclass(frozen=True)
class Config:
    capacity: int = 2048
    end_id: int = 0
    block: int = 2000
    islands: int = 2
    rounds: int = 2
    population: int = 6
    generations: int = 12
    reopened: int = 8  # one of so many bins of a block, the emptiest, is opened again
    seed: int = 5


class Bins:
    """Bins with a given capacity, and best fit in constant time: a bit for each remaining room that some bin has."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.items, self.room = capacity, [], []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0

    def add(self, items: list[int], room: int) -> None:
        self.by_room[room].append(len(self.items))
        self.bits |= 1 << room
        self.items.append(items)
        self.room.append(room)

    def fit(self, item: int, length: int) -> None:
        open_ = self.bits >> length
        if not open_:
            self.add([item], self.capacity - length)
            return
        room = length + (open_ & -open_).bit_length() - 1
        at = self.by_room[room].pop()
        if not self.by_room[room]:
            self.bits &= ~(1 << room)
        self.items[at].append(item)
        room -= length
        self.room[at] = room
        self.by_room[room].append(at)
        self.bits |= 1 << room


def best_fit(order: list[int], lengths: list[int], capacity: int) -> Bins:
    bins = Bins(capacity)
    for i in order:
        bins.fit(i, lengths[i])
    return bins


def fitness(bins: Bins) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (mean square of the fill); smaller is better."""
    c = bins.capacity
    return len(bins.items), -sum((c - r) ** 2 for r in bins.room) / (c * c * max(1, len(bins.items)))


def crossover(a: Bins, b: Bins, lengths: list[int], rng: random.Random) -> Bins:
    """Inject the fuller of some bins of ``b`` into ``a``; bins of ``a`` that share a piece go, their rest is refitted."""
    full = [i for i, r in enumerate(b.room) if r * 50 <= b.capacity]
    chosen = [i for i in full if rng.random() < 0.5] or [min(range(len(b.room)), key=b.room.__getitem__)]
    child, injected = Bins(a.capacity), set()
    for i in chosen:
        child.add(list(b.items[i]), b.room[i])
        injected.update(b.items[i])
    displaced = []
    for own, room in zip(a.items, a.room):
        if injected.isdisjoint(own):
            child.add(list(own), room)
        else:
            displaced += [x for x in own if x not in injected]
    for x in sorted(displaced, key=lambda x: (-lengths[x], x)):
        child.fit(x, lengths[x])
    return child


def mutate(bins: Bins, lengths: list[int], rng: random.Random) -> Bins:
    """Break up the emptiest bins and a few others, then best-fit their pieces."""
    order = sorted(range(len(bins.room)), key=lambda i: (-bins.room[i], i))
    broken = set(order[:3]) | {rng.randrange(len(order)) for _ in range(max(2, len(order) // 25))}
    out, loose = Bins(bins.capacity), []
    for i, (own, room) in enumerate(zip(bins.items, bins.room)):
        if i in broken:
            loose += own
        else:
            out.add(list(own), room)
    for x in sorted(loose, key=lambda x: (-lengths[x] * rng.uniform(0.9, 1.1), x)):
        out.fit(x, lengths[x])
    return out


def _labels(bins: Bins, n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for b, own in enumerate(bins.items):
        out[own] = b
    return out


def _bins(labels: np.ndarray, lengths: list[int], capacity: int) -> Bins:
    own: list[list[int]] = [[] for _ in range(int(labels.max()) + 1 if len(labels) else 0)]
    for i, b in enumerate(labels.tolist()):
        own[b].append(i)
    out = Bins(capacity)
    for items in own:
        out.add(items, capacity - sum(lengths[i] for i in items))
    return out


def founders(lengths: list[int], config: Config, rng: random.Random) -> Iterator[Bins]:
    """Best fit by decreasing length, then by orders near it and by breaking up some bins."""
    n, c = len(lengths), config.capacity
    first = best_fit(sorted(range(n), key=lambda i: (-lengths[i], i)), lengths, c)
    yield first
    while True:
        yield best_fit(sorted(range(n), key=lambda i: -lengths[i] * rng.uniform(0.8, 1.2)), lengths, c)
        yield mutate(first, lengths, rng)


def evolve(lengths: list[int], population: list[np.ndarray], config: Config, seed: int) -> tuple[list[np.ndarray], int]:
    """One round of an island: its population of packings (bin of each piece), best first, and how many crossovers it took."""
    c, n = config.capacity, len(lengths)
    rng = random.Random(seed)
    least, crossed = -(-sum(lengths) // c), 0
    pool = [_bins(p, lengths, c) for p in population]
    if not pool:
        for bins in founders(lengths, config, rng):
            pool.append(bins)
            if len(pool) == config.population or len(pool[0].items) <= least:
                break
    ranked = sorted(((fitness(p), k, p) for k, p in enumerate(pool)), key=lambda x: x[:2])
    born = len(ranked)
    for _ in range(config.generations):
        if ranked[0][0][0] <= least:
            break
        children = []
        for _ in range(config.population // 2):
            a, b = (min(rng.sample(ranked, min(2, len(ranked))), key=lambda x: x[:2])[2] for _ in range(2))
            crossed += a is not b
            child = crossover(a, b, lengths, rng) if a is not b else mutate(a, lengths, rng)
            if rng.random() < 0.4:
                child = mutate(child, lengths, rng)
            children.append((fitness(child), born, child))
            born += 1
        ranked = sorted([*ranked, *children], key=lambda x: x[:2])[: config.population]
    return [_labels(x[2], n) for x in ranked], crossed


def _slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of about ``limit`` bytes of text, or one row; only a part's texts become Python objects."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64) + 1
        begin, ends = 0, size.cumsum()
        while begin < len(size):
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - size[begin] + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def pieces(documents: DataFrame, config: Config = Config(), path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the token pieces of every document, with their ids as asked for."""
    path = path or tokens.default_path()
    base = documents.select("doc_id", "text")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    end = np.array([config.end_id], "<u4").tobytes()
    kind = base.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = tokens.load(path), 4 * config.capacity
        for part in _slices(batches, 4_000_000):
            of, number, start, length, crc, held = [], [], [], [], [], []
            texts = [t or b"" for t in common.text_bytes(part.column("text"))]
            for i, ids in enumerate(encoder.encode_all(texts)):
                ids += end
                for k, at in enumerate(range(0, len(ids), size)):
                    own = ids[at : at + size]
                    of.append(i), number.append(k), start.append(at // 4), length.append(len(own) // 4), crc.append(zlib.crc32(own))
                    held.append(own)
            arrays = [
                part.column("doc_id").take(pa.array(of, pa.int64())),
                pa.array(number, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(held, pa.binary())] * with_ids], names=names)

    return base.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


_STATE = {
    "block": "long", "island": "int", "lengths": "binary", "population": "array<binary>", "bins": "int", "bound": "int", "founded": "int", "crossovers": "long",
}
_ARROW = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.int32(), pa.int32(), pa.int32(), pa.int64()]


def _round(states: DataFrame, config: Config, number: int) -> DataFrame:
    """Evolve each island once; ``migrant`` is null or a packing that came from another island of the block."""

    def evolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<i4").tolist()
                members = [np.frombuffer(p, "<i4") for p in row["population"]]
                if not members:
                    row["bound"] = -(-sum(lengths) // config.capacity)
                    row["founded"] = len(next(founders(lengths, config, random.Random(0))).items)
                if (migrant := row.pop("migrant")) is not None:
                    members.append(np.frombuffer(migrant, "<i4"))
                best, crossed = evolve(lengths, members, config, hash((config.seed, row["block"], row["island"], number)))
                row["population"] = [x.astype("<i4").tobytes() for x in best]
                row["bins"], row["crossovers"] = int(best[0].max()) + 1, row["crossovers"] + crossed
                yield pa.RecordBatch.from_pylist([row], pa.schema(list(zip(_STATE, _ARROW))))

    return states.mapInArrow(evolved, ", ".join(f"{n} {k}" for n, k in _STATE.items()))


def _search(dealt: DataFrame, config: Config, scratch: Scratch) -> DataFrame:
    """(block, island, population, bins, bound, founded, crossovers) of each island after its last round."""
    parts = common.partitions(dealt.sparkSession)
    none = {"population": "array<binary>", "bins": "int", "bound": "int", "founded": "int", "migrant": "binary"}
    state = dealt.select("block", F.explode(F.array(*[F.lit(i) for i in range(config.islands)])).alias("island"), "lengths").withColumns(
        {n: (F.array() if n == "population" else F.lit(None)).cast(k) for n, k in none.items()} | {"crossovers": F.lit(0).cast("long")}
    )
    for number in range(config.rounds):
        if number:
            if state.where("bins > bound").isEmpty():
                break
            migrants = state.select(
                "block", ((F.col("island") + 1) % config.islands).alias("island"), F.col("population")[0].alias("migrant")
            )
            state = state.join(migrants, ["block", "island"]).select(*state.columns, "migrant")
        state = scratch.write(_round(state.repartition(parts, "block", "island"), config, number))
    return state


def _deal(rest: DataFrame, blocks: int, level: int) -> DataFrame:
    """(block, keys, lengths): pieces (__key, length) dealt to blocks by a hash, in order of length."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[np.array(x, k).tobytes() for x in batch.column(n).to_pylist()] for n, k in (("keys", "<i8"), ("lengths", "<i4"))]
            yield pa.RecordBatch.from_arrays([batch.column("block"), *(pa.array(x, pa.binary()) for x in found)], names=["block", "keys", "lengths"])

    own = rest.groupBy(F.pmod(F.xxhash64("__key", F.lit(level)), F.lit(blocks)).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("length", "__key"))).alias("items")  # about ``block`` pieces
    )
    return own.select("block", F.col("items.__key").alias("keys"), F.col("items.length").alias("lengths")).mapInArrow(
        packed, "block long, keys binary, lengths binary"
    )


def _place(found: DataFrame, config: Config, level: int, last: bool) -> DataFrame:
    """(__key, length, sequence_id, offset, open) of each piece; open ones are in the emptiest bins, of which the last level has none."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, lengths, bins = (np.frombuffer(row[n], k) for n, k in (("keys", "<i8"), ("lengths", "<i4"), ("best", "<i4")))
                order = np.lexsort((keys, -lengths, bins))
                lengths, bins = lengths[order].astype(np.int64), bins[order].astype(np.int64)
                fill = np.bincount(bins, lengths).astype(np.int64)
                ahead = lengths.cumsum() - lengths
                first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
                emptiest = np.argsort(fill, kind="stable")[: 0 if last else -(-len(fill) // config.reopened)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[order]),
                        pa.array(lengths),
                        pa.array((row["block"] << 6 | level) << 16 | bins),
                        pa.array(ahead - np.repeat(ahead[first], np.diff(np.append(first, len(bins))))),
                        pa.array(np.isin(bins, emptiest)),
                    ],
                    names=["__key", "length", "sequence_id", "offset", "open"],
                )

    return found.mapInArrow(placed, "__key long, length long, sequence_id long, offset long, open boolean")


def _packings(rest: DataFrame, config: Config, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(__key, sequence_id, offset) of pieces (__key, length), and the report."""
    spark, kept, reports = rest.sparkSession, [], []
    left, level = rest.count(), 0
    while left:
        blocks = -(-left // config.block)
        dealt = scratch.write(_deal(rest, blocks, level))
        state = _search(dealt, config, scratch)
        best = state.groupBy("block").agg(F.min_by(F.col("population")[0], F.struct("bins", "island")).alias("best"))
        found = dealt.join(best, "block")
        each = state.groupBy("block").agg(F.min("bins").alias("bins"), F.min("founded").alias("founded"), F.min("bound").alias("bound"), F.sum("crossovers").alias("crossovers"))
        row = each.agg(
            F.count("*").alias("blocks"), F.count_if(F.col("founded") > F.col("bound")).alias("above"), F.sum("bound"), F.sum("founded"), F.sum("bins"), F.sum("crossovers")
        ).first()
        placed = scratch.write(_place(found, config, level, blocks == 1 or level == 63))
        again = placed.where("open").count()
        shrinks = 0 < again and -(-again // config.block) < blocks
        reports.append((level, left, *row, again if shrinks else 0))
        kept.append((placed.where("not open") if shrinks else placed).select("__key", "sequence_id", "offset"))
        rest, left, level = placed.where("open").select("__key", "length"), again if shrinks else 0, level + 1
    names = "level int, pieces long, blocks long, above_bound long, bound long, best_fit long, bins long, crossovers long, reopened long"
    none = spark.createDataFrame([], "__key long, sequence_id long, offset long")
    return reduce(DataFrame.unionByName, kept, none), spark.createDataFrame(reports, names)


def pack(documents: DataFrame, config: Config = Config(), path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset; the offsets of a sequence's pieces leave no gap."""
    return pack_and_report(documents, config, path, with_ids)[0]


def pack_and_report(
    documents: DataFrame, config: Config = Config(), path: str | None = None, with_ids: bool = False
) -> tuple[DataFrame, DataFrame]:
    """What ``pack`` gives, and a row for each level: the blocks, how many best fit left above the bound, the sums over blocks
    of the bound, of best fit's bins and of the bins after the search, the crossovers, and the pieces opened again."""
    spark: SparkSession = documents.sparkSession
    scratch = Scratch(spark, "packing")
    cut = scratch.write(
        pieces(documents, config, path, with_ids).withColumn("__key", F.monotonically_increasing_id())
    )
    names = [n for n in cut.columns if n != "__key"]
    full = cut.where(F.col("length") == config.capacity).select(
        *names, (-F.col("__key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = cut.where(F.col("length") < config.capacity)
    placed, report = _packings(rest.select("__key", "length"), config, scratch)
    return full.unionByName(rest.join(placed, "__key").select(*names, "sequence_id", "offset")), report


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
