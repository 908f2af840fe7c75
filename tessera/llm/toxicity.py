"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words are hashed to 32 bits. Hashes seen in enough training documents own an embedding row, all others share a
zero row, so that a very long text does not meet a trained row by chance. Filters of several widths slide over the
whole text, each is max-pooled, and a dense layer turns the pooled values into a score from 0 to 1.

Training runs on the driver over a bounded sample of labelled documents (``Config.max_documents`` in the order of a
hash of the id, one for each id, ``Config.max_tokens`` words in all, documents of more than ``Config.max_document_tokens``
words left out). The driver never holds more than that. Scoring reads every whole text on the executors and moves no text between them. ``calibrate`` chooses a
threshold for each language on all labelled documents that training did not use: they are scored on the executors, and
counts of scores in ``Config.bins`` bins come back for each language and label. The language is used for that alone and
never for the score.

Defined cases: a null or empty text has no words and gets the score of an empty document; repeated rows each get a
score; extra columns pass through ``score`` untouched, but for ones named like an output column, which the output
replaces; without labelled rows, or with labels of one class only, every score is the smoothed share of label 1.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import common
from tessera.llm.common import Scratch


@dataclass(frozen=True)
class Config:
    max_documents: int = 6000
    max_tokens: int = 6_000_000
    max_document_tokens: int = 60_000
    min_documents: int = 2
    max_rows: int = 32768
    dimension: int = 8
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    epochs: int = 8
    batch: int = 48
    rate: float = 0.02
    decay: float = 3e-4
    validation_share: float = 0.2
    max_clean_rejected: float = 0.005
    min_language: int = 150
    bins: int = 10_000
    default_threshold: float = 0.7
    seed: int = 11


@dataclass
class Model:
    """hashes: sorted 32-bit word hashes; row i + 1 of the embedding belongs to hashes[i], row 0 is all zeros."""

    hashes: np.ndarray
    embedding: np.ndarray
    kernels: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    dense: np.ndarray
    dense_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.7

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width, what each word adds to each filter at each place of the window."""
        return {w: [self.embedding @ k[j] for j in range(w)] for w, k in self.kernels.items()}


def hash_words(text: bytes | None) -> np.ndarray:
    return np.fromiter(map(_hash_of.__getitem__, common.alnum_words(text or b"")), np.uint32)


class _Hashes(dict):
    """Word to hash; forgets everything when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = zlib.crc32(word)
        return h


_hash_of = _Hashes()


def _rows(model: Model, hashes: np.ndarray) -> np.ndarray:
    if not len(model.hashes):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(model.hashes, hashes), len(model.hashes) - 1)
    return np.where(model.hashes[at] == hashes, at + 1, 0)


def _padded(documents: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents in one array, each followed by ``pad`` zero rows, and where each begins."""
    lengths = np.array([len(d) + pad for d in documents])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = np.zeros(int(lengths.sum()) + pad, np.int64)
    for s, d in zip(starts, documents):
        flat[s : s + len(d)] = d
    return flat, starts


def _pool(tables: list[np.ndarray], bias: np.ndarray, flat: np.ndarray, starts: np.ndarray, pad: int) -> np.ndarray:
    """Max over each document of the filters of one width; before the rectifier. No window reaches into the next document."""
    n = len(flat) - len(tables) + 1
    out = tables[0][flat[:n]]
    for j in range(1, len(tables)):
        out += tables[j][flat[j : j + n]]
    ends = np.append(starts[1:], len(flat) - pad) - len(tables) + 1
    return np.maximum.reduceat(out, np.stack([starts, ends], axis=1).ravel(), axis=0)[::2] + bias


def predict(model: Model, tables: dict[int, list[np.ndarray]], documents: list[np.ndarray]) -> np.ndarray:
    """Scores of documents given as embedding rows."""
    if not documents:
        return np.zeros(0)
    flat, starts = _padded(documents, max(tables))
    pooled = np.concatenate([_pool(tables[w], model.bias[w], flat, starts, max(tables)) for w in sorted(tables)], axis=1)
    z = np.maximum(pooled, 0) @ model.dense + model.dense_bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _evidence(documents: list[np.ndarray], labels: np.ndarray, config: Config) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in at least ``min_documents`` documents, and how surely each goes with label 1.

    The evidence of a word is its log-odds less 1.5 standard errors toward zero: words of a few documents get none.
    """
    each = [np.unique(d) for d in documents]
    every = np.concatenate(each) if each else np.zeros(0, np.uint32)
    of = np.repeat(labels, [len(e) for e in each])
    words, back, count = np.unique(every, return_inverse=True, return_counts=True)
    positive = np.bincount(back, weights=of, minlength=len(words))
    seen = count >= config.min_documents
    words, count, positive = words[seen], count[seen].astype(float), positive[seen]
    n, p = float(len(labels)), float(labels.sum())
    a, b, c, d = positive + 0.5, count - positive + 0.5, p - positive + 0.5, (n - p) - (count - positive) + 0.5
    odds, error = np.log(a * d / (b * c)), np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    sure = np.sign(odds) * np.maximum(np.abs(odds) - 1.5 * error, 0)
    if len(words) > config.max_rows:
        best = np.sort(np.argsort(-np.abs(sure), kind="stable")[: config.max_rows])
        words, sure = words[best], sure[best]
    return words, sure


def gradient(slots: dict[str, np.ndarray], rows: list[np.ndarray], labels: np.ndarray, widths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Of the mean log loss of documents given as embedding rows, with regard to every slot.

    Slots: e (embedding, its row 0 being no word), kW and bW (filters and their bias of width W), d and db (dense layer).
    """
    f, d = slots[f"b{widths[0]}"].shape[0], slots["e"].shape[1]
    flat, starts = _padded(rows, max(widths))
    ends = np.append(starts[1:], len(flat) - max(widths))
    pooled, places = [], {}
    for w in widths:
        tables = [slots["e"] @ slots[f"k{w}"][j] for j in range(w)]
        n = len(flat) - w + 1
        out = tables[0][flat[:n]]
        for j in range(1, w):
            out += tables[j][flat[j : j + n]]
        places[w] = np.stack([s + out[s : e - w + 1].argmax(axis=0) for s, e in zip(starts, ends)])
        pooled.append(out[places[w], np.arange(f)] + slots[f"b{w}"])
    pre = np.concatenate(pooled, axis=1)
    hidden = np.maximum(pre, 0)
    z = hidden @ slots["d"] + slots["db"][0]
    wrong = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / len(rows)
    grad = {k: np.zeros_like(v) for k, v in slots.items()}
    grad["d"] = hidden.T @ wrong
    grad["db"] = np.array([wrong.sum()])
    back = (wrong[:, None] * slots["d"][None, :]) * (pre > 0)
    for i, w in enumerate(widths):
        g = back[:, i * f : (i + 1) * f]
        grad[f"b{w}"] = g.sum(axis=0)
        for j in range(w):
            at = flat[places[w] + j]
            grad[f"k{w}"][j] = np.einsum("nfd,nf->df", slots["e"][at], g)
            np.add.at(grad["e"], at.ravel(), (g[:, :, None] * slots[f"k{w}"][j].T[None]).reshape(-1, d))
    return grad


def train(documents: list[np.ndarray], labels: np.ndarray, config: Config = Config()) -> Model:
    """Fit on documents given as word hashes; Adam on the log loss, the gradient flowing through each pooled window."""
    rng = np.random.default_rng(config.seed)
    labels = np.asarray(labels, float)
    words, sure = _evidence(documents, labels, config)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    d, f = config.dimension, config.filters
    embedding = np.zeros((len(words) + 1, d), np.float32)
    embedding[1:] = rng.normal(0, 0.05, (len(words), d))
    embedding[1:, 0] = sure
    kernels = {w: rng.normal(0, 0.3 / math.sqrt(d * w), (w, d, f)).astype(np.float32) for w in config.widths}
    for k in kernels.values():
        k[0, 0, 0] = 1.0  # one filter of each width starts as the detector of the surest word
    bias = {w: np.zeros(f, np.float32) for w in config.widths}
    dense = rng.normal(0, 0.05, f * len(config.widths)).astype(np.float32)
    dense[::f] = 1.0 / len(config.widths)
    model = Model(words, embedding, kernels, bias, dense, float(np.log(share / (1 - share))), {}, config.default_threshold)
    if not 0 < labels.sum() < len(labels):
        model.dense = np.zeros_like(dense)
        return model

    rows = [_rows(model, x) for x in documents]
    slots: dict[str, np.ndarray] = {"e": embedding, "d": dense, "db": np.array([model.dense_bias], np.float32)}
    slots |= {f"k{w}": kernels[w] for w in config.widths} | {f"b{w}": bias[w] for w in config.widths}
    first = {k: np.zeros_like(v) for k, v in slots.items()}
    second = {k: np.zeros_like(v) for k, v in slots.items()}
    step = 0
    for epoch in range(config.epochs):
        rate = config.rate * (1 - epoch / config.epochs)
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), config.batch):
            chosen = order[begin : begin + config.batch]
            grad = gradient(slots, [rows[i] for i in chosen], labels[chosen], config.widths)
            step += 1
            for k, v in slots.items():
                g = grad[k] + (config.decay * v if k not in ("db", "e") else 0)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                v -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
            embedding[0] = 0
        model.dense_bias = float(slots["db"][0])
    return model


def calibrate(
    model: Model,
    scores: np.ndarray,
    labels: np.ndarray,
    languages: list[str | None],
    config: Config,
    counts: np.ndarray | None = None,
) -> None:
    """Set the threshold of each language with enough clean documents: the lowest that rejects few of them.

    Each score counts as often as ``counts`` says, once by default. Thresholds stay within 0.5 and 0.95; a language with
    fewer clean documents gets the one for all of them.
    """
    labels = np.asarray(labels)
    counts = np.ones(len(labels), np.int64) if counts is None else np.asarray(counts)

    def lowest(clean: np.ndarray, fallback: float) -> float:
        if counts[clean].sum() < config.min_language:
            return fallback
        share = 1 - config.max_clean_rejected
        found = np.quantile(scores[clean], share, weights=counts[clean], method="inverted_cdf")
        return float(np.clip(found, 0.5, 0.95))

    model.default_threshold = lowest(labels == 0, config.default_threshold)
    for name in sorted({x for x in languages if x is not None}):
        own = np.array([x == name for x in languages]) & (labels == 0)
        model.thresholds[name] = lowest(own, model.default_threshold)


def _by_id(labels: DataFrame) -> DataFrame:
    """One row for each labelled id, with the label and the hash of the id."""
    return (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .withColumn("__rank", F.xxhash64(common.id_text()))
    )


def _texts(documents: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    return documents.select("doc_id", "text", lang.alias("lang"))


def score_counts(documents: DataFrame, labels: DataFrame, model: Model, trained: list[int], config: Config) -> DataFrame:
    """(lang, toxic, bin, n): scores of the labelled documents whose hashed id is not in ``trained``.

    Only ids and bins are joined with the labels, so no text is moved.
    """
    used = documents.sparkSession.createDataFrame([(r,) for r in trained], "__rank long")  # at most max_documents rows
    rest = _texts(documents).where(F.col("doc_id").isNotNull()).withColumn("__rank", F.xxhash64(common.id_text()))
    rest = rest.join(F.broadcast(used), "__rank", "left_anti")
    at = F.least(F.floor(F.col("toxicity") * config.bins), F.lit(config.bins - 1)).cast("int")
    # Repeated ids fall together before they are dealt.
    scored = score(rest, model).groupBy("doc_id", "lang", at.alias("bin")).agg(F.count("*").alias("n"))
    joined = scored.join(_by_id(labels).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")), "doc_id")
    return joined.groupBy("lang", "toxic", "bin").agg(F.sum("n").alias("n"))


def _sample(documents: DataFrame, labels: DataFrame, config: Config) -> list:
    """Rows (toxic, hashes, rank) of the bounded sample, in the order of a hash of the id."""
    chosen = _by_id(labels).orderBy("__rank").limit(config.max_documents)
    joined = _texts(documents).join(F.broadcast(chosen), "doc_id")  # at most max_documents rows
    limit = config.max_document_tokens

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hash_words(t) for t in common.text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_pydict(
                {
                    "rank": batch.column("__rank"),
                    "toxic": batch.column("toxic"),
                    "n": pa.array([len(x) for x in found], pa.int32()),
                    "hashes": pa.array([x.tobytes() if len(x) <= limit else None for x in found], pa.binary()),
                }
            )

    # Of rows that share an id one counts. Sizes come first, and then only what the bound on the words lets in.
    each = joined.mapInArrow(hashed, "rank long, toxic int, n int, hashes binary").where("hashes is not null")
    each = each.groupBy("rank").agg(F.min(F.struct("toxic", "n", "hashes")).alias("x")).select("rank", "x.*")
    each = Scratch(documents.sparkSession, "toxicity").write(each)
    sizes = each.select("rank", "n").orderBy("rank").collect()  # at most max_documents pairs of numbers
    words = np.cumsum([r.n for r in sizes])
    within = int(np.searchsorted(words, config.max_tokens, side="right"))
    if not within:
        return []
    rows = each.where(F.col("rank") <= sizes[within - 1].rank).collect()  # at most max_tokens words
    return [(int(r.toxic > 0), np.frombuffer(bytes(r.hashes), np.uint32), r.rank) for r in sorted(rows, key=lambda r: r.rank)]


def fit(documents: DataFrame, labels: DataFrame, config: Config = Config()) -> Model:
    """Train and calibrate on the labelled documents; callers leave held-out rows out of ``labels``."""
    rows = _sample(documents, labels, config)
    cut = int(len(rows) * (1 - config.validation_share))
    learn = rows[:cut] if len(rows) - cut >= 30 else rows
    model = train([x[1] for x in learn], np.array([x[0] for x in learn]), config)
    if learn:
        counts = score_counts(documents, labels, model, sorted({x[2] for x in learn}), config).collect()  # bins, not rows
        above = np.array([(r.bin + 1) / config.bins for r in counts])  # the upper end: a bin is never rejected in part
        calibrate(model, above, np.array([r.toxic for r in counts]), [r.lang for r in counts], config, np.array([r.n for r in counts]))
    return model


def score(documents: DataFrame, model: Model, chunk_bytes: int = 2_000_000) -> DataFrame:
    """``documents`` with toxicity, toxicity_threshold (of the row's language) and toxic_rejected; ``text`` is needed."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most max_rows embedding rows
    added = ["toxicity", "toxicity_threshold", "toxic_rejected"]
    base = documents.drop(*added)
    schema = T.StructType(
        [*base.schema.fields, *(T.StructField(n, T.DoubleType()) for n in added[:2]), T.StructField(added[2], T.BooleanType())]
    )
    by_language = "lang" in base.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables()
        for part, texts in common.chunks(batches, "text", chunk_bytes):
            found = predict(model, tables, [_rows(model, hash_words(t)) for t in texts])
            names = part.column("lang").to_pylist() if by_language else [None] * len(texts)
            limits = np.array([model.thresholds.get(n, model.default_threshold) for n in names], float)
            arrays = [*part.columns, pa.array(found, pa.float64()), pa.array(limits), pa.array(found >= limits)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, *added])

    return base.mapInArrow(scored, schema)


def learnable(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.where(common.fold(3) != 1)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(documents, learnable(labels))
    return score(documents.select("doc_id", "lang", "text"), model).select(
        "doc_id",
        (common.fold(3) == 1).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.7).cast("int").alias("predicted"),
        "toxicity_threshold",
        "toxic_rejected",
    )
