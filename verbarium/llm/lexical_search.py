"""Ranked lexical search: the k best documents of every query by Fagin's threshold algorithm.

Scores are sums of integer impacts of a query's terms: w * ((10^9 tf) div (1000 tf + 8 m)), where w falls with the
documents that hold a term and m rises with a document's length.

1. The queries' terms are the vocabulary. They come in blocks of about BLOCK_TERMS terms, which bounds what is
   sent to tasks; one pass over all documents a block writes their forward index: length, terms, occurrences.
2. The numbers of documents and of terms, and of documents with each term, are summed over that table.
3. Each task takes its documents in chunks of at most CHUNK postings (one document at least). A chunk has, for each term, a list
   of documents by falling impact, and the forward index for random lookups. For a query its lists are read in turn,
   in rounds that grow in length; documents met for the first time are scored through the forward index. No document still
   unmet can score more than the threshold, the sum of the impacts at which the lists stand. Reading stops
   when the threshold falls strictly below the k-th best score that the task knows, so that ties are met as well.
4. The best of all chunks are cut to k in two steps, so that no task gathers a query's rows of all tasks.

Every document is indexed and can be found; nothing is sampled. Texts are whole; null and empty texts have no terms and
are not counted. Equal scores stand in the order of ids, null ids first; repeated rows are documents of their own. Queries with equal or null ids are
answered each; queries without terms, or whose terms no document holds, have no rows. Empty tables give an
empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, releasing, small_side

TOP = 10
#: Terms of the queries of one pass over the documents, about.
BLOCK_TERMS = 400_000
#: Postings of a chunk, in which a task builds lists.
CHUNK = 1_500_000
#: Entries of each list in a first round, and in the longest.
ROUND, LONGEST = 8, 8192
#: Parts in which a query's best rows are cut first.
PARTS = 64
#: A-Z to a-z; digits, letters and all beyond ASCII stay; the rest separates terms.
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TERM_BYTES).split()


@dataclass
class Queries:
    """A block of queries: their terms by number, and for each query the numbers of its terms."""

    numbers: dict[bytes, int]
    queries: list[tuple[int, np.ndarray]]


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sorted(set(terms_of(t))) for t in batch.column(2).to_pylist()], pa.list_(pa.binary()))], names=["no", "item", "terms"])


def _forward(asked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = asked.value.numbers
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lengths, ends, terms, times = [], [0], [], []
                for text in part.column(1).to_pylist():
                    words = terms_of(text)
                    found = sorted((numbers[w], n) for w, n in Counter(words).items() if w in numbers)
                    lengths.append(len(words))
                    terms += [t for t, _ in found]
                    times += [n for _, n in found]
                    ends.append(len(terms))
                cut = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (times, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths, pa.int64()), *lists], names=["id", "n", "terms", "times"])

    return run


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def length_measure(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents of n terms."""
    if 90 * int(n.max(initial=0)) * documents < 1 << 63:
        return 10 + (90 * n * documents) // max(total, 1)
    return np.array([10 + (90 * int(x) * documents) // total for x in n], np.int64)


class Chunk:
    """Lists by falling impact and the forward index of some documents."""

    def __init__(self, ids: pa.Array, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, documents: int, total: int):
        of = np.repeat(np.arange(len(n)), np.diff(ends))
        m = length_measure(n, documents, total)[of]
        impact = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m))
        some = impact > 0
        of, terms, self.impact = of[some], terms[some].astype(np.int64), impact[some]
        order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
        self.place = np.empty(len(n), np.int64)  # of ids in their order, for ties
        self.place[order] = np.arange(len(n))
        self.width = len(weights)
        self.keys = of * self.width + terms  # rising: documents in turn, the terms of each in order
        by = np.lexsort((-self.impact, terms))
        self.docs, self.falling = of[by], self.impact[by]
        self.starts = np.searchsorted(terms[by], np.arange(self.width + 1))
        self.seen = np.zeros(len(n), bool)

    def scores(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Whole scores of documents, by random lookups."""
        keys = docs[:, None] * self.width + terms[None, :]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.impact[at], 0).sum(1)

    def best(self, terms: np.ndarray, known: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): the k best of a query in this chunk, best first; those below ``known``, a score that k documents reach elsewhere, may be missing."""
        lists = [(a, b) for a, b in zip(self.starts[terms], self.starts[terms + 1]) if a < b]
        docs, scores, met = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        depth, step = 0, ROUND
        while lists:
            new = np.unique(np.concatenate([self.docs[a + depth : min(b, a + depth + step)] for a, b in lists]))
            new = new[~self.seen[new]]
            self.seen[new] = True
            met.append(new)
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, self.scores(new, terms)])
            best = np.lexsort((self.place[docs], -scores))[:k]
            docs, scores = docs[best], scores[best]
            depth += step
            step = min(2 * step, LONGEST)
            threshold = sum(int(self.falling[a + depth - 1]) for a, b in lists if a + depth <= b)
            lists = [(a, b) for a, b in lists if a + depth < b]
            if threshold < max(known, int(scores[-1]) if len(scores) == k else 0):
                break
        for one in met:
            self.seen[one] = False
        return docs, scores


def _search(asked, facts, id_type, k: int):
    names = ["no", "id", "score"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held, size = [], 0
        for batch in batches:
            at = 0
            ends = batch.column(2).offsets.to_numpy()  # offsets of a slice begin where the slice does
            while at < batch.num_rows:
                room = int(np.searchsorted(ends, ends[at] + CHUNK - size, side="right")) - 1
                to = max(room, at + (not held))
                if to > at:
                    held.append(batch.slice(at, to - at))
                    size += int(ends[to] - ends[at])
                    at = to
                if at < batch.num_rows:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, documents, total = facts.value
        reached: dict[int, list[int]] = {}
        for held in chunks(batches):
            one = pa.Table.from_batches(held).combine_chunks()
            ids, n, terms, times = (c.chunk(0) if c.num_chunks else c.combine_chunks() for c in one.columns)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy())])
            if not ends[-1]:
                continue
            chunk = Chunk(ids, n.to_numpy(), ends, terms.flatten().to_numpy(), times.flatten().to_numpy(), weights, documents, total)
            if not len(chunk.keys):
                continue
            out: list[tuple[int, np.ndarray, np.ndarray]] = []
            for no, of in asked.value.queries:
                top = reached.get(no, [])
                known = top[-1] if len(top) == k else 0
                docs, scores = chunk.best(of, known, k)
                enough = scores >= max(known, 1)
                if enough.any():
                    out.append((no, docs[enough], scores[enough]))
                    reached[no] = sorted([*top, *scores[enough].tolist()], reverse=True)[:k]
            if out:
                rows = np.concatenate([d for _, d, _ in out])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([no for no, _, _ in out], [len(d) for _, d, _ in out]), pa.int64()), ids.take(pa.array(rows)).cast(id_type), pa.array(np.concatenate([s for _, _, s in out]), pa.int64())], names=names)

    return run


def _cut(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy("no", *by).orderBy(F.desc("score"), F.col("id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Per query of items its k best documents: item id, ``rank`` (from 1), document id, ``score``."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    id_kind, item_kind = docs.schema[id_col].dataType, items.schema[item_col].dataType
    numbered = items.select(F.monotonically_increasing_id().alias("no"), F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    asked = scratch.save(numbered.mapInArrow(releasing(_asked), f"no long, item {item_kind.simpleString()}, terms array<binary>"), "asked")
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / block_terms))
    found = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("no"), F.lit(blocks)) == b).select("no", "terms").collect()  # about block_terms terms
        numbers: dict[bytes, int] = {}
        queries = [(r.no, np.array([numbers.setdefault(bytes(t), len(numbers)) for t in r.terms], np.int64)) for r in rows if r.terms]
        sent = spark.sparkContext.broadcast(Queries(numbers, queries))
        kind = id_kind.simpleString()
        index = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(releasing(_forward(sent)), f"id {kind}, n long, terms array<int>, times array<long>")
        index = scratch.save(index, f"forward{b}")
        whole = index.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        weights = np.full(len(numbers), term_weight(whole.documents, 0), np.int64)
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # a row a term of the block
            weights[r.t] = term_weight(whole.documents, r.n)
        facts = spark.sparkContext.broadcast((weights, whole.documents, whole.total))
        hits = index.mapInArrow(releasing(_search(sent, facts, to_arrow_type(id_kind), k)), f"no long, id {kind}, score long")
        hits = _cut(hits.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS))), k, "_part").drop("rank", "_part")
        block = scratch.save(_cut(hits, k), f"found{b}")
        scratch.drop(f"forward{b}")
        found = block if found is None else found.unionByName(block)
    named = found.join(small_side(asked.select("no", "item"), 64), "no")
    return named.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
