"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed features of a text's distinct words (the word,
and its first 4 and 5 bytes) is trained in numpy from texts confirmed as toxic and
from texts without a label. The risk is that of Kiryo et al. (2017): with the
class prior p, p R+(toxic) + max(0, R-(unlabelled) - p R-(toxic)); where the
part in the maximum is negative, a step climbs it instead.

Features are chosen by their counts over all texts given, and over all confirmed ones
among them. The gradient steps are taken on at most MAX_TOXIC and MAX_UNLABELLED texts, chosen
by a hash of the id without regard to labels, one text an id; every text is scored whole. The prior is the share of toxic
texts among those labelled, unless it is given.

Null and empty texts score by the bias alone. Without any toxic label every score
is 0. Null labels and labels without a text count as none. Repeated rows each
get the same score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, releasing, small_side

MAX_TOXIC = 4_000
MAX_UNLABELLED = 12_000
#: Features are hashed into so many places.
WIDTH = 1 << 18
#: A feature is used if so many texts have it and its share among toxic texts is LIFT times its share among the others, or the reverse.
MIN_TEXTS = 6
LIFT = 3.0
CACHE_WORDS = 400_000
#: Counts of so many tasks that read texts are added up in one; what that leaves, in ADDERS tasks.
TOGETHER, ADDERS = 64, 6

_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words_of(text: str | None) -> set[bytes]:
    """The distinct lower-cased words of a whole text; ASCII other than letters stands between words."""
    return set((text or "").lower().encode("utf-8", "replace").translate(_LETTERS).split())


def features_of(word: bytes) -> list[int]:
    found = [zlib.crc32(b"w" + word) % WIDTH]
    if len(word) > 4:
        found.append(zlib.crc32(b"4" + word[:4]) % WIDTH)
    if len(word) > 5:
        found.append(zlib.crc32(b"5" + word[:5]) % WIDTH)
    return found


@dataclass
class Model:
    bias: float
    places: np.ndarray
    weights: np.ndarray

    def table(self) -> dict[int, float]:
        return dict(zip(self.places.tolist(), self.weights.tolist()))


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)


def train_nnpu(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, toxic: np.ndarray, width: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier under the non-negative risk; (rows, cols, values) is the sparse matrix."""
    n = len(toxic)
    n_p, n_u = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = b + _sums(rows, w[cols] * values, n)
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        minus = np.logaddexp(0, z)  # the loss of calling a text clean
        inner = minus[~toxic].mean() - prior * minus[toxic].mean() if n_u else 0.0
        g = np.zeros(n)
        if inner >= 0:
            g[toxic] = prior * (p[toxic] - 1.0) / n_p - prior * p[toxic] / n_p
            g[~toxic] = p[~toxic] / n_u
        else:
            g[toxic] = prior * p[toxic] / n_p
            g[~toxic] = -p[~toxic] / n_u
        grad = np.append(_sums(cols, g[rows] * values, width) + decay * w, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return w, b


def _partial(counts: np.ndarray, n: list[int], together: int) -> Iterator[pa.RecordBatch]:
    for toxic in (0, 1):
        if n[toxic]:
            yield pa.RecordBatch.from_arrays([pa.array([together], pa.int32()), pa.array([toxic], pa.int32()), pa.array([n[toxic]], pa.int64()), pa.array([zlib.compress(counts[toxic].tobytes(), 1)], pa.binary())], names=["together", "toxic", "n", "counts"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts have each feature: of all texts (0) and of the toxic ones (1)."""
    counts, n, known = np.zeros((2, WIDTH), np.int64), [0, 0], {}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = features_of(w)
            found = np.array(list({f for w in words for f in known[w]}), np.int64)
            for side in range(toxic + 1):
                counts[side, found] += 1
                n[side] += 1
    yield from _partial(counts, n, TaskContext.get().partitionId() // TOGETHER)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, n = np.zeros((2, WIDTH), np.int64), [0, 0]
    for batch in batches:
        for toxic, texts, packed in zip(*(c.to_pylist() for c in batch.columns[1:])):
            counts[toxic] += np.frombuffer(zlib.decompress(packed), np.int64)
            n[toxic] += texts
    yield from _partial(counts, n, 0)


def _matrix(chosen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {f: i for i, f in enumerate(chosen.value.tolist())}
        for batch in batches:
            out, toxic = [], []
            for text, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.append([place[f] for w in words_of(text) for f in features_of(w) if f in place])
                toxic.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(out, pa.list_(pa.int32()))], names=["toxic", "features"])

    return run


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, max_toxic: int = MAX_TOXIC, max_unlabelled: int = MAX_UNLABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the documents that ``labels`` marks toxic (1) and from others, without use of their labels."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    order = [F.xxhash64(F.lit(9), "id"), "id"]
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    known = marks.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    if not known:
        return Model(-np.inf, np.zeros(0, np.int64), np.zeros(0))
    prior = min(0.99, max(0.001, prior or known))
    ids = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    toxic = marks.where("y = 1").select("id").distinct()
    toxic = scratch.save(toxic.join(ids, "id", "left_semi"), "toxic")
    some = toxic.orderBy(*order).limit(max_toxic).select("id", F.lit(1).alias("toxic"))
    rest = ids.orderBy(*order).limit(max_unlabelled).select("id", F.lit(0).alias("toxic"))
    sample = F.broadcast(scratch.save(some.unionByName(rest), "ids"))  # at most max_toxic + max_unlabelled ids
    least = F.min(F.struct(F.xxhash64("text"), "text")).alias("x")  # of the texts of one id, however many
    texts = scratch.save(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id").groupBy("id", "toxic").agg(least).select("x.text", "toxic").repartition(12), "texts")
    every = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    every = every.join(small_side(toxic.withColumn("toxic", F.lit(1)), 64), "id", "left").select("text", F.coalesce("toxic", F.lit(0)).alias("toxic"))
    kind = "together int, toxic int, n long, counts binary"
    n, counts = np.zeros(2), np.zeros((2, WIDTH))
    parts = every.mapInArrow(releasing(_counts), kind).repartition("together").mapInArrow(releasing(_added), kind)
    for r in parts.repartition(ADDERS).mapInArrow(releasing(_added), kind).collect():  # 2 rows a task at most
        n[r.toxic] += r.n
        counts[r.toxic] += np.frombuffer(zlib.decompress(r.counts), np.int64)
    if not n.all():
        return Model(-np.inf, np.zeros(0, np.int64), np.zeros(0))
    share = (counts + 0.5) / (n[:, None] + 1.0)
    lift = share[1] / share[0]
    chosen = np.flatnonzero((counts.sum(0) >= MIN_TEXTS) & ((lift >= LIFT) | (lift <= 1 / LIFT)))
    sent = spark.sparkContext.broadcast(chosen)
    y, rows, cols = [], [], []
    for i, r in enumerate(texts.mapInArrow(releasing(_matrix(sent)), "toxic int, features array<int>").toLocalIterator()):
        y.append(r.toxic)
        rows.append(np.full(len(r.features), i, np.int64))
        cols.append(np.array(r.features, np.int64))
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    w, b = train_nnpu(rows, cols, np.ones(len(rows)), np.array(y, bool), max(1, len(chosen)), prior)
    scratch.drop("texts", "ids", "toxic")
    return Model(b, chosen, w[: len(chosen)])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of docs with ``score``, 0 to 1."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias, known = sent.value.table(), sent.value.bias, {}
        for batch in batches:
            z = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                if len(known) > CACHE_WORDS:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = sum(table.get(f, 0.0) for f in features_of(w))
                z[i] = bias + sum(sorted(filter(None, map(known.__getitem__, words))))
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(releasing(run), f"`{id_col}` {id_type}, score double")
