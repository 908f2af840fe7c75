"""SimHash near-duplicates, found by meeting in the middle of the Hamming ball.

Every distinct fingerprint emits variants of itself with up to half the radius of bits flipped; two fingerprints
within the radius meet at a common variant. For radius 3, one of two fingerprints at an odd distance has even parity
and the other odd, so it is enough that even ones flip up to two bits and odd ones one. Of three differing bits two
lie in the same half of the word, so even ones flip pairs within one half only: 1057 and 65 variants, instead of 2081
each, and no link within the radius is lost.

Variants are dealt to buckets by a hash. In the shuffle a fingerprint takes its own eight bytes and two bytes for each
variant in the bucket; many fingerprints are dealt at once, so that a row holds many variants. Buckets number in
proportion to the fingerprints, and a task of the shuffle has one or two of them; once rows would hold fewer than
``LEAST_VARIANTS``, both what is dealt at once and a bucket grow with the root of the fingerprints. A bucket sorts its
variants; a run of equal ones is tied to one member that lies within the radius of all others by its distance from
the variant, every pair is verified by its differing bits, and a spanning forest of the bucket's links is emitted.
Exact copies share a fingerprint and were folded before, so no group of copies is expanded.

``near_duplicates`` takes shingles of words and links by differing bits alone. ``near_copies`` takes fingerprints of
single words, which few edits move by few bits, and several of them, each with balls of radius 2 (65 variants): texts
whose balls meet, directly or through others, are compared by sketches of their shingles of five words, and linked at a
similarity of 0.8 or more. A
sketch has the least hash in each of 256 parts of the hash's range; the share of equal ones estimates the resemblance of
the shingles with a standard error of 0.025 at 0.8. Estimates down to 0.8 less that count, so that few pairs at the
threshold are lost (``SLACK``); some pairs between 0.75 and 0.8 are linked for it. So that a large group is not compared pair by pair, the texts of a
candidate group that agree in one of 32 bands of eight parts are compared with one of them, another for each band. At a
resemblance of 0.8 a pair shares a band with probability 0.997.

Defined cases: a null text and one without words have fingerprint zero and link like any other; fewer words than a
shingle hash as one sequence; rows without doc_id have a fingerprint and join components but never name one; repeated
rows are in one component; extra columns are ignored by ``fingerprints`` unless asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm.common import Scratch
from tessera.llm.components import components

SINGLE = [1 << i for i in range(64)]
PAIRS = [(1 << i) | (1 << j) for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]
MASKS = np.array([0, *SINGLE, *PAIRS], np.uint64)
ODD_MASKS = 65
RADIUS = 3
LEAST_VARIANTS = 16
PARTS, BANDS = 256, 32
PRINTS = 6
SLACK = 0.025
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64 majority bits of the shingles' hashes."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.fromiter(map(len, words), np.int64, n)
    ends = (ends + 1).cumsum() - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], "<u8")
    return _majority(hashes)


class _Words(dict):
    """Word to 64-bit hash; forgets everything when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


_word_hashes = _Words()


def profile(text: bytes | None, shingle: int = 5) -> tuple[np.ndarray, int, bytes]:
    """(fingerprints of the single words, hash of the sequence of words, sketch of the shingles)."""
    words = (text or b"").lower().split()
    key = xxhash.xxh64_intdigest(b" ".join(words), 7)
    if not words:
        return np.zeros(PRINTS, np.uint64), key, bytes(2 * PARTS)
    hashes = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(hashes) - shingle + 1)
    rolled = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(shingle, len(hashes))):
            rolled = (rolled ^ hashes[k : k + n]) * _SPREAD
            rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0xD6E8FEB86659FD93)
        rolled ^= rolled >> np.uint64(32)
        rolled.sort()
        part = (rolled >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        sketch = np.zeros(PARTS, "<u2")
        sketch[part[first]] = np.maximum((rolled[first] * _SPREAD) >> np.uint64(48), 1)  # 0: no shingle in this part
    return _word_prints(hashes), key, sketch.tobytes()


def _word_prints(hashes: np.ndarray) -> np.ndarray:
    """For each of several hashes of the words, the bits that are set in over half of them."""
    words, count = np.unique(hashes, return_counts=True)
    out = np.empty(PRINTS, np.uint64)
    for k in range(PRINTS):
        ones = np.zeros(64)
        with np.errstate(over="ignore"):
            mixed = (words ^ np.uint64(k)) * _SPREAD
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
        for at in range(0, len(words), 16384):
            bits = np.unpackbits(mixed[at : at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += count[at : at + 16384].astype(np.float32) @ bits.astype(np.float32)
        out[k] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def _majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def similarity(a: bytes, b: bytes) -> float:
    """The estimated resemblance of two texts' shingles, from their sketches; 1 for two without words."""
    x, y = np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2")
    used = np.count_nonzero((x > 0) | (y > 0))
    return np.count_nonzero((x == y) & (x > 0)) / used if used else 1.0


def bands(sketch: bytes) -> np.ndarray:
    """A hash of each band of the sketch, whose empty parts borrow from the next that has a shingle."""
    own = np.frombuffer(sketch, "<u2").astype(np.uint64)
    held = np.flatnonzero(own)
    if len(held):
        at = np.searchsorted(held, np.arange(PARTS)) % len(held)
        own = own[held[at]]
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in own.reshape(BANDS, -1).T:
            out = (out ^ column) * _SPREAD
            out ^= out >> np.uint64(31)
    return out.view(np.int64)


def fingerprints(documents: DataFrame, shingle: int = 3, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with fingerprint (a signed long of the 64 bits)."""
    base = documents.select(*keep, F.col("text").alias("__text"))
    kept = [f for f in base.schema.fields if f.name != "__text"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle, seed) for t in common.text_bytes(batch.column("__text"))]
            values = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), values], names=[*keep, "fingerprint"])

    return base.mapInArrow(hashed, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", fingerprint long")


def _bucket_of(variants: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((variants * _SPREAD) >> np.uint64(33)) % np.uint64(buckets)


def _deal(values: np.ndarray, buckets: int, radius: int = RADIUS) -> Iterator[tuple[int, bytes]]:
    """For each bucket met, packed (fingerprint, number of variants, variants' mask numbers)."""
    near = np.bitwise_count(values) % 2 == 1 if radius == RADIUS else np.ones(len(values), bool)
    for own, masks in ((values[near], MASKS[:ODD_MASKS]), (values[~near], MASKS)):
        if not len(own):
            continue
        bucket = _bucket_of(own[:, None] ^ masks[None, :], buckets)
        order = np.argsort(bucket.ravel().astype(np.uint32), kind="stable")  # within a bucket by fingerprint, then mask
        which = bucket.ravel()[order]
        rows, mask = np.divmod(order, len(masks))
        cuts = np.flatnonzero(np.diff(which)) + 1
        for at, r, m in zip(which[np.append(0, cuts)].tolist(), np.split(rows, cuts), np.split(mask, cuts)):
            first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            count = np.diff(np.append(first, len(r)))
            head = np.uint32(len(first)).tobytes()
            yield int(at), head + own[r[first]].tobytes() + count.astype(np.uint16).tobytes() + m.astype(np.uint16).tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    own = np.frombuffer(blob, np.uint64, n, 4)
    count = np.frombuffer(blob, np.uint16, n, 4 + 8 * n)
    mask = np.frombuffer(blob, np.uint16, -1, 4 + 10 * n)
    own = np.repeat(own, count)
    return own ^ MASKS[mask], own


def _meet(blobs: list[bytes], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints that meet in one bucket."""
    parts = [_unpack(b) for b in blobs]
    variant, own = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(variant, kind="stable")
    variant, own = variant[order], own[order]
    twin = np.zeros(len(variant), bool)
    twin[1:] = variant[1:] == variant[:-1]
    twin[:-1] |= twin[1:]
    variant, own = variant[twin], own[twin]
    if not len(variant):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    # An even fingerprint two flips away may be four bits from another such one: it is no centre. Others are.
    far = np.bitwise_count(variant ^ own) == 2
    order = np.lexsort((own, far, variant))
    variant, own, far = variant[order], own[order], far[order]
    first = np.append(True, variant[1:] != variant[:-1])
    centre_at = np.flatnonzero(first)[np.cumsum(first) - 1]
    centre = own[centre_at]
    good = ~far[centre_at] & (own != centre) & (np.bitwise_count(own ^ centre) <= radius)
    pairs = np.unique(np.stack([own[good], centre[good]], axis=1), axis=0)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = up = parent.get(up, up)
            x = up
        return x

    kept = []
    for a, b in pairs.tolist():
        p, q = root(a), root(b)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((a, b))
    found = np.array(kept, np.uint64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def ball_links(
    distinct: DataFrame, count: int, radius: int = RADIUS, variants_per_bucket: int = 1_500_000, deal_at_once: int = 2048
) -> DataFrame:
    """Links (u, v) that connect all fingerprints within ``radius`` (2 or 3) bits of each other, given each once as column fp."""
    each = (len(MASKS) + ODD_MASKS) // 2 if radius == RADIUS else ODD_MASKS
    deal_at_once = deal_at_once * ((len(MASKS) + ODD_MASKS) // 2) // each
    # A row holds deal_at_once * variants_per_bucket / count of the variants.
    grown = max(1.0, (LEAST_VARIANTS * count / (deal_at_once * variants_per_bucket)) ** 0.5)
    variants_per_bucket, deal_at_once = int(variants_per_bucket * grown), int(deal_at_once * grown)
    buckets = max(1, -(-count * each // variants_per_bucket))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(values), deal_at_once):
                found = list(_deal(values[at : at + deal_at_once], buckets, radius))
                for i in range(0, len(found), 64):
                    keys, blobs = zip(*found[i : i + 64])
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "packed"])

    def met(table: pa.Table) -> pa.Table:
        u, v = _meet(table.column("packed").to_pylist(), radius)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    spread = distinct.select("fp").repartition(common.partitions(distinct.sparkSession))
    packed = spread.mapInArrow(dealt, "bucket long, packed binary")
    return packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(met, "u long, v long")


def near_duplicates(documents: DataFrame, shingle: int = 3, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns (doc_id among them) with fingerprint (long), component_id and component (a long).

    component_id is the smallest doc_id of the component; component names it also where no row has an id.
    """
    spark: SparkSession = documents.sparkSession
    scratch = Scratch(spark, "simhash")
    rows = scratch.write(fingerprints(documents, shingle, seed, keep))
    distinct = scratch.write(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")))
    links = components(ball_links(distinct, distinct.count()), scratch)
    named = distinct.join(links.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("component"), "least"
    )
    # Written first, so that the join deals both sides itself and can split a component of very many fingerprints.
    least = scratch.write(named.groupBy("component").agg(F.min("least").alias("component_id")))
    names = named.select("fp", "component").join(least, "component").select(F.col("fp").alias("fingerprint"), "component_id", "component")
    return rows.join(names, "fingerprint").select(*keep, "fingerprint", "component_id", "component")


def _profiles(documents: DataFrame, shingle: int, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns with prints (fingerprints), key (a hash of the words in order) and sketch."""
    base = documents.select(*keep, F.col("text").alias("__text"))
    kept = [f for f in base.schema.fields if f.name != "__text"]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.chunks(batches, "__text", 4_000_000):
            prints, keys, sketches = zip(*(profile(t, shingle) for t in texts))
            own = pa.array(np.concatenate(prints).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(range(0, len(own) + 1, PRINTS), pa.int32()), own)
            signed = pa.array(np.array(keys, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(f.name) for f in kept), lists, signed, pa.array(sketches, pa.binary())], names=[*keep, "prints", "key", "sketch"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return base.mapInArrow(measured, f"{schema}, prints array<long>, key long, sketch binary")


def _similar(texts: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Links (u, v) of texts (key, component, sketch) of one component whose sketches are similar, through one text for each band."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bands(x) for x in batch.column("sketch").to_pylist()]
            at = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            values = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(at), batch.column("component").take(at), pa.array(values)], names=["key", "component", "band"]
            )

    own = texts.select("key", "component", "sketch").mapInArrow(banded, "key long, component long, band long")
    # Another text leads in each band: the one with the least hash of key and band.
    rank = F.struct(F.xxhash64("key", "band").alias("rank"), F.col("key"))
    leaders = own.groupBy("component", "band").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Written first, as wherever a side is aggregated: the join deals both sides itself and can split a large group.
    leaders = scratch.write(leaders.select("component", "band", F.col("first.key").alias("leader")))
    pairs = own.join(leaders, ["component", "band"]).where("key <> leader")
    pairs = scratch.write(pairs.select("key", "leader").distinct())

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(n).to_pylist() for n in ("a", "b"))
            near = pa.array([similarity(x, y) >= least - SLACK for x, y in zip(a, b)], pa.bool_())
            yield batch.select(["u", "v"]).filter(near)

    first = texts.select(F.col("key").alias("u"), F.col("sketch").alias("a"))
    second = texts.select(F.col("key").alias("v"), F.col("sketch").alias("b"))
    both = pairs.toDF("u", "v").join(first, "u").join(second, "v").select("u", "v", "a", "b")
    return both.mapInArrow(compared, "u long, v long")


def near_copies(documents: DataFrame, shingle: int = 5, least: float = 0.8, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns (doc_id among them) with component_id (its smallest doc_id) and component (a long).

    A component holds texts whose shingles resemble each other by ``least`` or more, directly or through others. Texts of
    the same words in the same order are one text; those without any word are one component.
    """
    scratch = Scratch(documents.sparkSession, "near-copies")
    rows = scratch.write(_profiles(documents, shingle, keep))
    # Prints and sketch are functions of the words, so any row of a text has them.
    texts = scratch.write(
        rows.groupBy("key").agg(F.first("prints").alias("prints"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least"))
    )
    own = texts.select("key", F.explode("prints").alias("fp"))
    # Fingerprints of one kind and another are near each other by chance as rarely as those of unlike texts.
    balls = scratch.write(own.groupBy("fp").agg(F.count("*").alias("n")))
    near = scratch.write(ball_links(balls, balls.count(), 2))
    linked = scratch.write(near.select(F.col("u").alias("fp")).union(near.select("v")).union(balls.where("n > 1").select("fp")).distinct())
    ties = own.join(linked, "fp").select(F.col("key").alias("u"), F.col("fp").alias("v"))
    groups = components(ties.union(near), scratch).select(F.col("u").alias("key"), F.col("v").alias("root"))
    met = scratch.write(texts.select("key").join(groups, "key", "left").select("key", F.coalesce("root", "key").alias("component")))
    several = scratch.write(met.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"))
    sketches = texts.select("key", "sketch").join(met.join(several, "component", "left_semi"), "key")
    links = components(_similar(scratch.write(sketches), least, scratch), scratch)
    named = texts.join(links.select(F.col("u").alias("key"), F.col("v").alias("root")), "key", "left").select(
        "key", F.coalesce("root", "key").alias("component"), "least"
    )
    least_of = scratch.write(named.groupBy("component").agg(F.min("least").alias("component_id")))
    names = named.join(least_of, "component").select("key", "component_id", "component")
    return rows.join(names, "key").select(*keep, "component_id", "component")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(documents).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
