"""Packing token pieces into sequences: shortest-pack-first over the length histogram.

Documents become token ids and are cut into pieces of at most MAX_LEN. Only the
histogram of piece lengths (at most MAX_LEN rows) reaches the driver: lengths
are placed longest first, each into the shortest packs that it fits, and
packing patterns carry the number of sequences that follow them. Each piece
then has a rank among the pieces of its length, and the rank leads to a pattern,
a sequence and an offset by binary search in the pattern table, a table that
the histogram bounds too.

A null text is empty: its one piece is the final id. Repeated rows and null ids
are documents of their own, of any number: pieces are dealt by all that they hold, and
those that agree in everything by their place. An empty table packs into nothing.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import Counter
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, releasing

MAX_LEN = 4096
END_ID = 2
#: Words whose ids a worker remembers before it begins anew.
CACHE_WORDS = 800_000
_KEY_BITS = 48


#: How a vocabulary must normalize and split texts for its ids to be those of words in turn.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class TextEncoder:
    """Ids of whole texts as little-endian bytes, of any vocabulary that the tokenizers library reads."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [(t or "").encode("utf-8", "replace").decode() for t in texts]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encoder_for(path: str) -> TextEncoder | WordEncoder:
    """The word encoder for a vocabulary that normalizes and splits as it assumes; for others one that takes texts whole."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model = told.get("model", {})
    fits = all(told.get(k) == v for k, v in WORDWISE.items()) and model.get("type") == "BPE" and not model.get("dropout")
    return (WordEncoder if fits else TextEncoder)(path)


class WordEncoder:
    """Ids of whole texts as little-endian bytes.

    The vocabulary splits at blanks, and letters from marks, before anything else, so
    that a text's ids are those of its words and runs of marks in turn. Those repeat, and
    what was found is remembered. A plain text (composed letters, digits, blanks and
    ASCII marks other than ' and _) is lower-cased and blanks are set around its marks
    first; words of letters or marks only then go to the BPE model as they are. All
    others pass through the whole tokenizer, split at blanks alone.
    """

    MARKS = re.compile(r"([!-&(-/:-@\[-^`{-~]+)")
    EASY = bytes(b for b in range(128) if (b > 31 or 9 <= b <= 13) and b != 127 and chr(b) not in "'_")

    HIGH = bytes(range(128, 256))

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain: dict[bytes, bytes] = {}
        self.other: dict[bytes, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies show as themselves
        hidden = [b for b in range(256) if b not in shown]
        self.bytes = {b: 256 + i for i, b in enumerate(hidden)}
        self.ids = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def _easy(self, text: str) -> bool:
        """Whether a text is plain: what is left of it without easy ASCII is composed letters and digits."""
        left = text.encode("utf-8", "replace").translate(None, self.EASY)
        if "<|" in text or left.translate(None, self.HIGH):
            return False
        rest = left.decode()
        return not left or (rest.isalnum() and "\u0130" not in rest and "\u03a3" not in rest and is_normalized("NFC", text))

    def _whole(self, words: list[bytes]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        bpe, known, ids, digits = self.tokenizer.model.tokenize, self.plain, self.ids, []
        for word in words:
            text = word.decode()
            if text.isascii():  # letters, or a run of marks: shown as themselves
                if not text.isalpha() and any(map(str.isalnum, text)):
                    digits.append(word)
                    continue
            elif text.isalpha():
                text = word.decode("latin-1").translate(self.bytes)
            else:
                digits.append(word)
                continue
            known[word] = b"".join([ids[t.id] for t in bpe(text)])
        known.update(zip(digits, self._whole(digits)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split, plain = [], []
        for text in texts:
            text = text or ""
            easy = self._easy(text)
            if easy:
                text = self.MARKS.sub(r" \1 ", text.lower())
            plain.append(easy)
            split.append(text.encode("utf-8", "replace").split())
        for known, kind, learn in ((self.plain, True, self._learn), (self.other, False, lambda ws: self.other.update(zip(ws, self._whole(ws))))):
            if len(known) > CACHE_WORDS:
                known.clear()
            new: set[bytes] = set()
            for words, easy in zip(split, plain):
                if easy is kind:
                    new.update(words)
            learn([w for w in new if w not in known])
        return [b"".join(map((self.plain if easy else self.other).__getitem__, words)) for words, easy in zip(split, plain)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, vocabulary: str | None = None, max_len: int = MAX_LEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, ``start``, ``length``, ``doc_tokens`` and ``ids`` (binary, unsigned 32-bit little-endian)."""
    vocabulary = vocabulary or default_vocabulary()
    id_type = docs.schema[id_col].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_for(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, start, length, total, ids = [], [], [], [], []
                for i, raw in enumerate(encoder.encode(part.column(1).to_pylist())):
                    raw += end
                    n = len(raw) // 4
                    for a in range(0, n, max_len):
                        row.append(i)
                        start.append(a)
                        length.append(min(max_len, n - a))
                        total.append(n)
                        ids.append(raw[4 * a : 4 * (a + max_len)])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], names=[id_col, "start", "length", "doc_tokens", "ids"])

    return docs.select(id_col, text_col).mapInArrow(releasing(run), f"`{id_col}` {id_type}, start long, length long, doc_tokens long, ids binary")


def shortest_pack_first(histogram: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) and the number of sequences that follow each."""
    by_used: dict[int, Counter] = {}
    heap: list[int] = []

    def add(used: int, pattern: tuple[int, ...], count: int) -> None:
        if used not in by_used:
            by_used[used] = Counter()
            heapq.heappush(heap, used)
        by_used[used][pattern] += count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not heap or heap[0] + length > max_len:
                add(length, (length,), left)
                break
            used = heap[0]
            packs = by_used[used]
            pattern, count = packs.popitem()
            if not packs:
                del by_used[used]
                heapq.heappop(heap)
            placed = min(count, left)
            left -= placed
            if count > placed:
                add(used, pattern, count - placed)
            add(used + length, (*pattern, length), placed)
    return sorted((p, n) for packs in by_used.values() for p, n in packs.items())


def pattern_table(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For every length of every pattern the ranks that go there: sorted keys (length, first rank) and where they lead."""
    rows, ranks, base = [], Counter(), 0
    for pattern, count in patterns:
        at = 0
        for length, times in sorted(Counter(pattern).items(), reverse=True):
            rows.append(((length << _KEY_BITS) | ranks[length], times, base, at))
            ranks[length] += times * count
            at += times * length
        base += count
    rows.sort()
    names = ("key", "times", "base", "at")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def pack(pieces: DataFrame, max_len: int = MAX_LEN, carry: tuple[str, ...] = ("ids",), id_col: str = "doc_id", rows_per_chunk: int = 20_000) -> DataFrame:
    """pieces (id, start, length, doc_tokens and ``carry``) with ``sequence_id`` and ``offset``.

    Pieces are written once, so that texts are encoded once. Ranks are counted in
    chunks of a length, and chunks set off by the sums before them. Of pieces that agree in all, more than a few chunks' worth
    are dealt by their place in the table written.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "pack")
    saved = scratch.save(pieces.select(id_col, "start", "length", "doc_tokens", *carry).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in saved.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = spark.sparkContext.broadcast(pattern_table(shortest_pack_first(histogram, max_len)))
    chunks = max(1, sum(histogram.values()) // rows_per_chunk)
    saved = saved.withColumn("_chunk", F.pmod(F.xxhash64(id_col, "start", *carry), F.lit(chunks))).withColumn("_part", F.lit(0))
    counts = scratch.save(saved.groupBy("length", "_chunk", "_part").agg(F.count("*").alias("_n")), "counts")
    large = scratch.save(counts.where(F.col("_n") > 4 * rows_per_chunk).select("length", "_chunk", F.ceil(F.col("_n") / rows_per_chunk).cast("int").alias("_parts")), "large")
    if large.limit(1).count():
        # A row of large stands for 4 * rows_per_chunk pieces, so that the table stays small.
        saved = saved.join(F.broadcast(large), ["length", "_chunk"], "left").withColumn("_part", F.pmod("_row", F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
        counts = scratch.save(saved.groupBy("length", "_chunk", "_part").agg(F.count("*").alias("_n")), "parted")
    before = counts.select("length", "_chunk", "_part", (F.sum("_n").over(Window.partitionBy("length").orderBy("_chunk", "_part")) - F.col("_n")).alias("_before"))
    ranked = saved.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_chunk", "_part").orderBy(id_col, "start", "_row")) - 1)
    ranked = ranked.join(before, ["length", "_chunk", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    names = [id_col, "start", "length", "doc_tokens", *carry]
    ranked = ranked.select(*names, F.col("_rank").cast("long").alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for batch in batches:
            length = batch.column(2).to_numpy(zero_copy_only=False)
            rank = batch.column(len(names)).to_numpy(zero_copy_only=False)
            i = np.searchsorted(t["key"], (length << _KEY_BITS) | rank, side="right") - 1
            gone = rank - (t["key"][i] & ((1 << _KEY_BITS) - 1))
            sequence = t["base"][i] + gone // t["times"][i]
            offset = t["at"][i] + gone % t["times"][i] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(len(names))), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(releasing(run), f"{kinds}, sequence_id long, offset long")
