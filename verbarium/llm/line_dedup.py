"""Line dedup: winnowing over line hashes, matches extended both ways, later repeated runs deleted.

A text's sequence is its lines that have a word, edge blanks stripped, hashed. The gram
at a line is the shortest run of lines from there on with K words; the window at a line
is the grams that start in that same run. Each window selects its least gram, so a run of
2 * K - 1 words or more that two places share gives both a fingerprint in common
(all windows inside it are the same), and no run below K words is matched.

A fingerprint's later positions are joined with its first one, by ascending id, then line,
and each match is extended line by line in both directions. Lines of extended
matches are deleted from the later place; the first occurrence of a run stays.

The first position of a fingerprint need not be where the longest match is. So runs of
2 * K - 1 words are also looked up whole: the shortest such run from each line on and the
shortest up to each line, if a repeated fingerprint starts in it. Each run of so many
words is made up of these, so its lines go from every place but the first that holds it,
whatever other texts share its fingerprints. A run is known by its hash, without pairs.

Null and empty texts have no lines and stay as they are. Null ids come last in order; rows
that share an id are ordered by a hash of their text. Rows that agree in id and text are
one document here: they lose the same lines. A document may lose all lines. An empty table
gives an empty one. Columns other than the text pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, releasing, row_key, spread_join

#: Words of a gram; repeated runs of 2 * K - 1 words are always found.
K = 25


def line_hashes(text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of the lines with a word: their places in the text, their hashes and their numbers of words."""
    places, hashes, words = [], [], []
    for i, line in enumerate((text or "").encode("utf-8", "replace").split(b"\n")):
        if n := len(line.split()):
            places.append(i)
            hashes.append(xxhash.xxh3_64_intdigest(line.strip()))
            words.append(n)
    return places, np.array(hashes, np.uint64), np.array(words, np.int64)


def fingerprints(hashes: np.ndarray, words: np.ndarray, k: int = K) -> list[tuple[int, int]]:
    """(line, gram hash) of the grams that windows select."""
    n = len(words)
    if not n or words.sum() < k:
        return []
    total = np.cumsum(words)
    ends = np.searchsorted(total, total - words + k)
    valid = int(np.count_nonzero(ends < n))  # ends rise, so that these lead
    grams = [xxhash.xxh3_64_intdigest(hashes[i : ends[i] + 1].tobytes()) for i in range(valid)]
    chosen = set()
    for i in range(valid):
        stop = min(int(ends[i]) + 1, valid)
        least = min(grams[i:stop])
        chosen.add(max(j for j in range(i, stop) if grams[j] == least))
    return [(i, int(np.uint64(grams[i]).view(np.int64))) for i in sorted(chosen)]


def extend(a: np.ndarray, b: np.ndarray, matches: list[tuple[int, int]]) -> set[int]:
    """The lines of a that the matches (line of a, line of b), extended both ways, cover."""
    gone: set[int] = set()
    reached: dict[int, int] = {}
    for i, j in sorted(matches):
        if i <= reached.get(i - j, -1):
            continue
        n = min(len(a) - i, len(b) - j)
        same = a[i : i + n] == b[j : j + n]
        ahead = n if same.all() else int(np.argmin(same))
        m = min(i, j)
        back_same = a[i - m : i][::-1] == b[j - m : j][::-1]
        back = m if back_same.all() else int(np.argmin(back_same))
        gone.update(range(i - back, i + ahead))
        reached[i - j] = i + ahead - 1
    return gone


def long_runs(hashes: np.ndarray, words: np.ndarray, marks: list[int], k: int = K) -> list[tuple[int, int, bytes]]:
    """(first line, last line, 128-bit hash) of the shortest runs of 2 * k - 1 words from and up to each line, of those that hold a line of marks."""
    least, n = 2 * k - 1, len(words)
    total = np.cumsum(words)
    before = total - words
    ends = np.searchsorted(total, before + least)
    starts = np.searchsorted(before, total - least, side="right") - 1
    spans = np.concatenate([np.stack([np.arange(n), ends], 1)[ends < n], np.stack([starts, np.arange(n)], 1)[starts >= 0]])
    marks = np.append(np.sort(np.array(marks, np.int64)), n)
    spans = spans[marks[np.searchsorted(marks, spans[:, 0])] <= spans[:, 1]]
    return [(i, j, xxhash.xxh3_128_digest(hashes[i : j + 1].tobytes())) for i, j in sorted(set(map(tuple, spans.tolist())))]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            hashed, counts, places, starts, grams = [], [], [], [], []
            for text in part.column(1).to_pylist():
                where, h, w = line_hashes(text)
                found = fingerprints(h, w)
                hashed.append(h.tobytes())
                counts.append(w.astype(np.int32).tobytes())
                places.append(np.array(where, np.int32).tobytes())
                starts.append([i for i, _ in found])
                grams.append([g for _, g in found])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hashed, pa.binary()), pa.array(counts, pa.binary()), pa.array(places, pa.binary()), pa.array(starts, pa.list_(pa.int32())), pa.array(grams, pa.list_(pa.int64()))], names=["k", "hashes", "words", "places", "line", "gram"])


def _gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for a, places, b, lines, others in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
            gone = extend(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), list(zip(lines, others)))
            where = np.frombuffer(places, np.int32)
            out.append(where[sorted(gone)].tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["k", "gone"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        starts, ends, runs = [], [], []
        for h, w, marks in zip(*(batch.column(i).to_pylist() for i in range(2, 5))):
            found = long_runs(np.frombuffer(h, np.uint64), np.frombuffer(w, np.int32).astype(np.int64), marks)
            starts.append([i for i, _, _ in found])
            ends.append([j for _, j, _ in found])
            runs.append([r for _, _, r in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.list_(pa.int32())) for x in (starts, ends)), pa.array(runs, pa.list_(pa.binary()))], names=["k", "id", "line", "last", "run"])


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for places, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(1, 4))):
            where = np.frombuffer(places, np.int32)
            out.append(where[sorted({x for i, j in zip(starts, ends) for x in range(i, j + 1)})].tolist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["k", "gone"])


def _firsts(at: DataFrame, key: str) -> DataFrame:
    """The first position (k0, line0) of each key that has another."""
    first = at.groupBy(key).agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "k", "line")).alias("first"), F.count("*").alias("n"))
    return first.where("n > 1").select(key, F.col("first.k").alias("k0"), F.col("first.line").alias("line0"), "n")


def _met(at: DataFrame, first: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """The positions of a key with its first one."""
    return spread_join(at, first.drop("n"), [key], scratch, f"hot_{key}", first.select(key, "n"))


def _long_repeats(lines: DataFrame, at: DataFrame, first: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, gone): the places of lines in runs of 2 * K - 1 words or more that an earlier place holds."""
    marks = _met(at, first, "gram", scratch).groupBy("k").agg(F.first("id").alias("id"), F.collect_list("line").alias("marks"))
    marked = marks.join(lines.select("k", "hashes", "words"), "k").select("k", "id", "hashes", "words", "marks")
    found = marked.mapInArrow(releasing(_runs), f"k binary, id {at.schema['id'].dataType.simpleString()}, line array<int>, last array<int>, run array<binary>")
    runs = found.select("k", "id", F.explode(F.arrays_zip("line", "last", "run")).alias("x")).select("k", "id", "x.line", "x.last", "x.run")
    runs = scratch.save(runs, "runs")
    later = _met(runs, scratch.save(_firsts(runs, "run"), "first_runs"), "run", scratch).where("k <> k0 OR line <> line0")
    spans = later.groupBy("k").agg(F.collect_list(F.struct("line", "last")).alias("x"))
    spans = spans.join(lines.select("k", "places"), "k").select("k", "places", "x.line", "x.last")
    return spans.mapInArrow(releasing(_covered), "k binary, gone array<int>")


def repeated_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, gone): the places of lines to delete, for each row key that loses lines."""
    keyed = docs.select(row_key(id_col, text_col).alias("k"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    lines = scratch.save(keyed.select("k", "text").mapInArrow(releasing(_lines), "k binary, hashes binary, words binary, places binary, line array<int>, gram array<long>").dropDuplicates(["k"]), "lines")
    ids = keyed.select("k", "id").distinct()
    at = lines.select("k", F.explode(F.arrays_zip("line", "gram")).alias("x")).select("k", "x.line", "x.gram").join(ids, "k")
    at = scratch.save(at, "positions")
    first = scratch.save(_firsts(at, "gram"), "first")
    later = _met(at, first, "gram", scratch).where("k <> k0 OR line <> line0")
    met = later.groupBy("k", "k0").agg(F.collect_list(F.struct("line", "line0")).alias("m"))
    met = scratch.save(met.select("k", "k0", F.col("m.line").alias("line"), F.col("m.line0").alias("line0")), "met")
    a = lines.select("k", "hashes", "places")
    b = lines.select(F.col("k").alias("k0"), F.col("hashes").alias("hashes0"))
    per_first = met.groupBy("k0").agg(F.count("*").alias("n"))  # a text that many copy
    pairs = spread_join(met, b, ["k0"], scratch, "hot_first", per_first).join(a, "k").select("k", "hashes", "places", "hashes0", "line", "line0")
    gone = pairs.mapInArrow(releasing(_gone), "k binary, gone array<int>")
    gone = gone.unionByName(_long_repeats(lines, at, first, scratch))
    gone = gone.groupBy("k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
    return scratch.save(gone, "gone")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the later repeated runs of lines, with ``deleted_lines``: the places (from 0) of those deleted."""
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.drop("deleted_lines")
    gone = repeated_lines(docs, scratch, id_col, text_col)
    size = gone.agg(F.count("*").alias("n"), F.sum(F.size("gone")).alias("lines")).first()
    fits = size.n * 64 + (size.lines or 0) * 4 <= BROADCAST_BYTES
    side = gone.select(F.col("k").alias("__vb_k"), F.col("gone").alias("__vb_gone"))
    out = docs.withColumn("__vb_k", row_key(id_col, text_col)).join(F.broadcast(side) if fits else side, "__vb_k", "left")
    left = F.filter(F.split(F.col(text_col), "\n", -1), lambda _, i: ~F.array_contains(F.col("__vb_gone"), i))
    text = F.when(F.col("__vb_gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    none = F.array().cast("array<int>")
    return out.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns), F.coalesce("__vb_gone", none).alias("deleted_lines"))
