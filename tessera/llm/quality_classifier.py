"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each text is reduced to a row of statistics (lengths, character classes, repetition, line shape) on the executors.
Trees are grown level by level on quantile histograms in numpy, on the driver, over a bounded sample of labelled
rows (``Config.max_rows`` rows of statistics in the order of a hash of the id, one for each id). The forest is flattened into complete
binary trees held in three arrays, so that a batch of documents walks every tree with one gather for each level.

Defined cases: a null or empty text has the statistics of an empty document; repeated rows each get a score; extra
columns pass through ``score``, but for ones named like an output column, which the output replaces; without labels,
or with one class only, every score is the smoothed share of label 1; null labels are not learned from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common


@dataclass(frozen=True)
class Config:
    max_rows: int = 20_000
    trees: int = 80
    depth: int = 4
    bins: int = 48
    rate: float = 0.15
    ridge: float = 3.0
    least_hessian: float = 2.0
    keep_at: float = 0.3


FEATURES = (
    "words", "characters", "word_length", "space_share", "upper_share", "digit_share", "symbol_share", "bang_share",
    "pipe_share", "other_punctuation", "wide_share", "stop_share", "line_words", "unpunctuated_lines", "repeated_lines",
    "distinct_words", "top_word", "repeated_pairs", "short_words", "long_words", "capital_words", "symbol_words",
)

_STOPS = frozenset("the of and to in is for on that with der die und das le la les de et des el los las que y en".encode().split())
_SYMBOLS = np.frombuffer(b"#*$%&<>@^~_=+/\\{}[]", np.uint8)
_OTHER = np.frombuffer(b"?;:'\"()-,.", np.uint8)


def statistics(text: bytes | None) -> np.ndarray:
    """One row of ``FEATURES`` for a text in UTF-8."""
    text = text or b""
    out = np.zeros(len(FEATURES))
    words = text.split()
    if not words:
        return out
    n = len(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    characters = float(len(text) - counts[0x80:0xC0].sum())
    lowered = text.lower().split()
    seen = Counter(lowered)
    pairs = Counter(zip(lowered, lowered[1:]))
    lines = [x for x in (y.strip() for y in text.split(b"\n")) if x]
    lengths = np.fromiter(map(len, words), np.int64, n)
    capitals = text.upper().split()
    out[:] = (
        np.log1p(n),
        np.log1p(characters),
        characters / n,
        counts[32] / characters,
        counts[65:91].sum() / characters,
        counts[48:58].sum() / characters,
        counts[_SYMBOLS].sum() / characters,
        counts[33] / n,
        counts[124] / n,
        counts[_OTHER].sum() / n,
        counts[0xC0:].sum() / characters,
        sum(seen[w] for w in _STOPS if w in seen) / n,
        np.log1p(n / len(lines)),
        sum(x[-1:] not in b".!?:;" for x in lines) / len(lines),
        1 - len(set(lines)) / len(lines),
        len(seen) / n,
        max(seen.values()) / n,
        sum(c for c in pairs.values() if c > 1) / n,
        (lengths <= 2).mean(),
        (lengths >= 12).mean(),
        sum(map(bytes.__eq__, words, capitals)) / n,
        sum(w[-1:] in b"#*$%&|" for w in words) / n,
    )
    return out


@dataclass
class Forest:
    """Complete trees: node k has children 2k+1 and 2k+2; a leaf's path goes left by an infinite threshold."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    value: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        total = np.full(len(x), self.base)
        if not trees or not len(x):
            return total
        node = np.zeros((len(x), trees), np.int64)
        rows, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        while node[0, 0] < inner:
            right = x[rows, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        return total + self.value[tree, node - inner].sum(axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def train(x: np.ndarray, y: np.ndarray, config: Config = Config()) -> Forest:
    """Boost the log loss; each level's best cuts come from one histogram over (node, feature, bin)."""
    n, d = x.shape if len(x) else (0, len(FEATURES))
    share = (y.sum() + 0.5) / (n + 1)
    base, inner = float(np.log(share / (1 - share))), 2**config.depth - 1
    feature, threshold, value = [], [], []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, config.bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        cells = binned + np.arange(d)[None, :] * config.bins  # in 0 .. d * bins
        margin, width = np.full(n, base), d * config.bins
        for _ in range(config.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            f, t, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
            for level in range(config.depth):
                first, many = 2**level - 1, 2**level
                keys = ((node - first)[:, None] * width + cells).ravel()
                sums = [
                    np.bincount(keys, weights=np.repeat(v, d), minlength=many * width).reshape(many, d, config.bins)
                    for v in (g, h)
                ]
                left_g, left_h = sums[0].cumsum(axis=2), sums[1].cumsum(axis=2)
                all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
                gain = left_g**2 / (left_h + config.ridge) + (all_g - left_g) ** 2 / (all_h - left_h + config.ridge)
                gain -= all_g**2 / (all_h + config.ridge)
                gain[(left_h < config.least_hessian) | (all_h - left_h < config.least_hessian)] = 0
                flat = gain.reshape(many, -1)
                best = flat.argmax(axis=1)
                for k in range(many):
                    j, cut = divmod(int(best[k]), config.bins)
                    if flat[k, best[k]] > 1e-6 and cut < len(edges[j]):
                        f[first + k], t[first + k] = j, edges[j][cut]
                node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
            leaf = node - inner
            up, down = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            v = -config.rate * up / (down + config.ridge)
            margin += v[leaf]
            feature.append(f), threshold.append(t), value.append(v)
    shape = (len(feature), inner)
    return Forest(
        base,
        np.array(feature, np.int64).reshape(shape),
        np.array(threshold, float).reshape(shape),
        np.array(value, float).reshape(len(feature), inner + 1),
    )


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(t).tobytes() for t in common.text_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("__rank"), batch.column("quality"), pa.array(found, pa.binary())], names=["rank", "quality", "x"]
        )


def fit(documents: DataFrame, labels: DataFrame, config: Config = Config()) -> Forest:
    """Train on the labelled documents; callers leave held-out rows out of ``labels``."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col("quality").cast("int")).alias("quality"))
        .withColumn("__rank", F.xxhash64(common.id_text()))
        .orderBy("__rank")
        .limit(config.max_rows)
    )
    joined = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows ids
    # Of rows that share an id one counts, so at most max_rows rows come back.
    each = joined.mapInArrow(_statistics_of, "rank long, quality int, x binary").groupBy("rank").agg(F.min(F.struct("quality", "x")).alias("x"))
    rows = sorted(((r.rank, r.quality, bytes(r.x)) for r in each.select("rank", "x.*").collect()))
    x = np.array([np.frombuffer(r[2]) for r in rows]).reshape(len(rows), len(FEATURES))
    return train(x, np.array([float(r[1] > 0) for r in rows]), config)


def score(documents: DataFrame, forest: Forest, keep_at: float = 0.3, chunk_bytes: int = 4_000_000) -> DataFrame:
    """``documents`` with quality_score and quality_kept; ``text`` is needed."""
    added = ["quality_score", "quality_kept"]
    base = documents.drop(*added)
    shared = documents.sparkSession.sparkContext.broadcast(forest)
    schema = T.StructType(
        [*base.schema.fields, T.StructField(added[0], T.DoubleType()), T.StructField(added[1], T.BooleanType())]
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for part, texts in common.chunks(batches, "text", chunk_bytes):
            found = forest.predict(np.array([statistics(t) for t in texts]))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(found), pa.array(found >= keep_at)], names=[*part.schema.names, *added]
            )

    return base.mapInArrow(scored, schema)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    forest = fit(documents, labels.where(common.fold(5) != 0))
    return score(documents.select("doc_id", "text"), forest).select(
        "doc_id",
        (common.fold(5) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.col("quality_kept").cast("int").alias("predicted"),
    )
