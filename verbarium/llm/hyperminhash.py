"""Near duplicates by HyperMinHash: compressed registers, bands, corrected estimates, verification on whole sets.

A text's set holds the hashes of its five-word shingles. Two sets link when 100 * intersection >= PERCENT * union.

1. Equal sets become one, known by a 128-bit name.
2. A set's sketch (Yu and Weber, 2017) has BUCKETS registers: the first bits of a hash choose the bucket, and of the least
   rest in a bucket the register keeps the number of leading zeros and RANK bits of mantissa. An empty register is 0.
3. Bands of ROWS registers are hashed; sets that agree in a band are candidates. In short texts empty registers are
   filled from others in an order drawn for each (Shrivastava, 2017), so that a band is never made of one shingle by
   itself: with 42 bands of 6, linked sets miss each other in all of them once in 10^8.
4. Of candidates the share of agreeing registers, corrected for registers that agree by chance, estimates the similarity; a pair that
   is MARGIN standard errors below the threshold is dropped (a linked pair is, about once in three million). The error falls to nothing as
   the registers hold all of a set.
5. What is left is verified on the full sets, made again of the texts that pairs name.

Pairs come in rounds, so that a group of copies is not expanded into all of its pairs: each set meets the hub of
the bands that it shares most; then, of the sets of each band that are in other components yet, the one with the highest
estimate; at last all of these whose estimates are promising. The last two compare the sketches of a band in memory, in blocks of BLOCK sets, and
a pair in the first band alone that it shares. Bands, hubs and sets that very many meet are dealt over many tasks. Components are those of verified links.

Null texts and texts without words have empty sets, link with nothing and are components of their own. Rows with a null id take part;
a component of such rows only has a null id. Repeated rows are equal sets. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, releasing, row_key, small_side, spread_join
from .components import components
from .jaccard_join import second_id, set_id, shingle_set

#: Links have a similarity of so many hundredths or more.
PERCENT = 85
#: Registers of a sketch; bits of a hash that choose one; bits of mantissa in it.
BUCKETS, CHOOSING, RANK = 256, 8, 10
#: Registers of a band, and bands.
ROWS = 6
BANDS = BUCKETS // ROWS
#: Standard errors by which an estimate may fall short, and what it may besides.
MARGIN, SLACK = 5.0, 0.01
#: Sets of one band that are paired in one task.
BLOCK = 2_000


def sketch(members: np.ndarray) -> np.ndarray:
    """The registers of a sorted set of signed 64-bit hashes: (leading zeros + 1) << RANK | mantissa, 0 if empty."""
    out = np.zeros(BUCKETS, np.uint16)
    if not len(members):
        return out
    turn = int(np.searchsorted(members, 0))
    h = np.concatenate([members[turn:], members[:turn]]).view(np.uint64)  # in unsigned order
    bucket = h >> np.uint64(64 - CHOOSING)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rest = (h[first] << np.uint64(CHOOSING)) >> np.uint64(11)  # 53 bits, which a double holds
    _, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.minimum(53 - exponent, 52).astype(np.uint64)
    mantissa = ((rest << (zeros + np.uint64(1))) & np.uint64((1 << 53) - 1)) >> np.uint64(53 - RANK)
    out[bucket[first].astype(np.int64)] = ((zeros + np.uint64(1)) << np.uint64(RANK)) | mantissa
    return out


@cache
def _order() -> np.ndarray:
    """For every bucket the places of all buckets in an order drawn for it."""
    draw = np.random.default_rng(11)
    return np.stack([draw.permutation(BUCKETS) for _ in range(BUCKETS)]).astype(np.uint16)


def filled(registers: np.ndarray) -> np.ndarray:
    """The registers of a set that is not empty, empty ones filled with the first filled one in their own order."""
    there = np.flatnonzero(registers)
    if len(there) == BUCKETS:
        return registers
    empty = np.flatnonzero(registers == 0)
    out = registers.copy()
    out[empty] = registers[there[np.argmin(_order()[np.ix_(empty, there)], axis=1)]]
    return out


def band_keys(registers: np.ndarray) -> list[int]:
    """A signed 64-bit key for every band."""
    raw, width = filled(registers).tobytes(), 2 * ROWS
    keys = [xxhash.xxh3_64_intdigest(raw[i * width : (i + 1) * width], i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


@cache
def _chance(a: int, b: int) -> float:
    """How often registers of sets of about 2 ** (a / 2) and 2 ** (b / 2) members agree, though their least members differ.

    The least rests of a bucket fall like the least of n / BUCKETS draws; a register is a cell of the unit interval.
    """
    zeros = np.arange(40)[:, None]
    low = 2.0 ** -(zeros + 1) * (1 + np.arange(1 << RANK)[None, :] / (1 << RANK))
    high = low + 2.0 ** -(zeros + 1 + RANK)

    def cells(size: int) -> np.ndarray:
        rate = max(1.0, 2 ** (size / 2) / BUCKETS)
        return np.exp(-rate * low) - np.exp(-rate * np.minimum(high, 1.0))

    p, q = cells(a), cells(b)
    return float((p * q).sum() / (p.sum() * q.sum()))


def estimate(x: np.ndarray, y: np.ndarray, n: int, m: int) -> tuple[float, int]:
    """The corrected estimate of the similarity of two sets of n and m members, and the registers that it rests on."""
    either = int(np.count_nonzero(x | y))
    if not either:
        return 0.0, 0
    agree = int(np.count_nonzero((x == y) & (x > 0)))
    chance = _chance(round(2 * math.log2(max(n, 1))), round(2 * math.log2(max(m, 1))))
    return max(0.0, (agree / either - chance) / (1 - chance)), either


def least_estimate(n: np.ndarray, m: np.ndarray, rests: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The estimate below which sets of n and m members are dropped: rests registers are a sample without replacement of the union (Li, Owen, Zhang 2012)."""
    j = percent / 100
    union = (n + m) / (1 + j)
    spread = j * (1 - j) / np.maximum(rests, 1) * np.clip((union - rests) / np.maximum(union - 1, 1), 0, 1)
    return j - MARGIN * np.sqrt(spread) - SLACK


def promising(x: np.ndarray, y: np.ndarray, n: int, m: int, percent: int = PERCENT) -> bool:
    """Whether two sets may link, by their estimate."""
    value, rests = estimate(x, y, n, m)
    return rests > 0 and value >= float(least_estimate(np.float64(n), np.float64(m), np.float64(rests), percent))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets link."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _name(members: np.ndarray) -> bytes:
    return b"".join(h.to_bytes(8, "big", signed=True) for h in (set_id(members), second_id(members)))


def _sketches(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, names, made = [], [], []
            for text, key in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                members = shingle_set(text)
                ns.append(len(members))
                names.append(_name(members) if len(members) else key)
                made.append(sketch(members).tobytes() if len(members) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), batch.column(1), pa.array(ns, pa.int64()), pa.array(names, pa.binary()), pa.array(made, pa.binary())], names=["id", "k", "n", "s", "sketch"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            keys = [k for raw in part.column(2).to_pylist() for k in band_keys(np.frombuffer(raw, np.uint16))]
            of = pa.array(np.repeat(np.arange(part.num_rows), BANDS))
            band = np.tile(np.arange(BANDS, dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(band), part.column(0).take(of), part.column(1).take(of)], names=["key", "band", "s", "n"])


def _estimated(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            keep = [promising(np.frombuffer(x[i], np.uint16), np.frombuffer(y[i], np.uint16), n[i], m[i], percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def compared(band: int, names: list[bytes], roots: list[bytes], n: np.ndarray, side: np.ndarray, registers: np.ndarray, keys: np.ndarray, best: bool, percent: int = PERCENT) -> list[tuple[bytes, bytes]]:
    """Promising pairs of the sets of a band, of different components and, where side tells two blocks apart, of different blocks.

    Pairs that agree in an earlier band are left to that. ``best``: for each set only the pair with the highest estimate.
    """
    number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    root, order = np.array([number[r] for r in roots]), np.arange(len(names))
    size = np.round(2 * np.log2(np.maximum(n, 1))).astype(int)
    crossing = len(set(side.tolist())) > 1
    value, partner, out = np.full(len(names), -1.0), np.full(len(names), -1), []
    for r in range(len(names) - 1):
        fit = (root[r + 1 :] != root[r]) & (100 * n[r + 1 :] >= percent * n[r]) & (100 * n[r] >= percent * n[r + 1 :])
        if crossing:
            fit &= side[r + 1 :] != side[r]
        of = order[r + 1 :][fit]
        if band and len(of):
            of = of[~(keys[of, :band] == keys[r, :band]).any(1)]
        if not len(of):
            continue
        there = registers[of]
        rests = np.count_nonzero(there | registers[r], axis=1)
        agree = np.count_nonzero((there == registers[r]) & (there > 0), axis=1)
        kinds, at = np.unique(size[of], return_inverse=True)
        chance = np.array([_chance(int(size[r]), int(k)) for k in kinds])[at]
        told = (agree / np.maximum(rests, 1) - chance) / (1 - chance)
        good = told >= least_estimate(n[r], n[of], rests, percent)
        of, told = of[good], told[good]
        if not best:
            out += [(min(names[r], names[i]), max(names[r], names[i])) for i in of.tolist()]
        elif len(of):
            better = told > value[of]
            value[of[better]], partner[of[better]] = told[better], r
            top = int(np.argmax(told))
            if told[top] > value[r]:
                value[r], partner[r] = told[top], of[top]
    if best:
        out = list({(min(names[i], names[j]), max(names[i], names[j])) for i, j in enumerate(partner.tolist()) if j >= 0})
    return out


def _in_blocks(best: bool, percent: int):
    """Of rows (key, x, y, band, side, s, n, root, sketch, keys), sorted by the first three, the pairs of each block."""
    def of(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        band, side, names, n, roots, sketches, keys = (list(c) for c in zip(*(r[3:] for r in rows)))
        return compared(band[0], names, roots, np.array(n, np.int64), np.array(side), np.stack([np.frombuffer(x, np.uint16) for x in sketches]), np.stack([np.frombuffer(x, np.int64) for x in keys]), best, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    out += of(held) if len(held) > 1 else []
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.binary()) for i in (0, 1)], names=["a", "b"])
        if len(held) > 1 and (out := of(held)):
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            keys = [np.array(band_keys(np.frombuffer(raw, np.uint16)), np.int64).tobytes() for raw in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary())], names=["s", "sketch", "keys"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            made = [shingle_set(t) for t in batch.slice(at, 1000).column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_name(x) for x in made], pa.binary()), pa.array([x.tobytes() for x in made], pa.binary())], names=["s", "members"])


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                of_a, of_b = part.column(2).to_pylist(), part.column(3).to_pylist()
                keep = [linked(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), percent) for x, y in zip(of_a, of_b)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class NearDuplicates:
    """Links over one table of documents; ``components()`` gives a row for each of them."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT):
        self.spark, self.percent, self.id_col, self.id_type = docs.sparkSession, percent, id_col, docs.schema[id_col].dataType
        self.scratch = Scratch(self.spark, "minhash")
        self.docs = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("k"), F.col(text_col).alias("text"))

    def _prepare(self) -> None:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = f"id {self.id_type.simpleString()}, k binary, n long, s binary, sketch binary"
        self.rows = self.scratch.save(self.docs.mapInArrow(releasing(_sketches(to_arrow_type(self.id_type))), kind), "rows")
        least = F.min(F.struct(F.col("id").isNull().alias("no"), F.col("id"), F.col("k")))
        sets = self.rows.groupBy("s").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), least.alias("first"), F.count("*").alias("rows"))
        self.sets = self.scratch.save(sets, "sets")
        self.repeated = bool(self.rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").limit(1).count())

    def _banded(self) -> DataFrame:
        """(key, band, s, n) of the bands that two sets or more share, and self.hubs (key, b, n): the first set by name of each, and how many."""
        bands = self.scratch.save(self.sets.where("n > 0").select("s", "n", "sketch").mapInArrow(releasing(_bands), "key long, band int, s binary, n long"), "bands")
        hubs = bands.groupBy("key").agg(F.min("s").alias("b"), F.count("*").alias("n")).where("n > 1")
        self.hubs = self.scratch.save(hubs, "hubs")
        shared = self.scratch.save(spread_join(bands, self.hubs.select("key", "b"), ["key"], self.scratch, "hot_bands", self.hubs.select("key", "n")), "shared")
        self.scratch.drop("bands")
        return shared

    def _ends(self, pairs: DataFrame, of_a: DataFrame, of_b: DataFrame, name: str) -> DataFrame:
        """pairs, a scratch table, with what of_a and of_b tell of their ends."""
        one = spread_join(pairs, of_a, ["a"], self.scratch, f"{name}_a")
        return spread_join(one, of_b, ["b"], self.scratch, f"{name}_b", pairs.groupBy("b").agg(F.count("*").alias("n")), pairs.count())

    def _estimated(self, pairs: DataFrame, name: str) -> DataFrame:
        """The promising ones of pairs (a, b)."""
        pairs = self.scratch.save(pairs, f"{name}_pairs")
        a = self.sets.select(F.col("s").alias("a"), "n", F.col("sketch").alias("x"))
        b = self.sets.select(F.col("s").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
        met = self._ends(pairs, a, b, f"{name}_met").select("a", "b", "n", "m", "x", "y")
        return met.mapInArrow(releasing(_estimated(self.percent)), "a binary, b binary")

    def _links(self, near: DataFrame, name: str) -> DataFrame:
        """The linked ones of pairs (a, b), on full sets."""
        near = self.scratch.save(near, f"{name}_near")
        named = near.select(F.col("a").alias("s")).union(near.select("b")).distinct()
        keys = self.scratch.save(self.sets.join(named, "s", "left_semi").select(F.col("first.k").alias("k")), f"{name}_keys")
        some = self.docs.join(small_side(keys, 24), "k", "left_semi")
        some = some.dropDuplicates(["k"]) if self.repeated else some
        full = self.scratch.save(some.select("text").mapInArrow(releasing(_members), "s binary, members binary"), f"{name}_full")
        of_a, of_b = full.select(F.col("s").alias("a"), F.col("members").alias("of_a")), full.select(F.col("s").alias("b"), F.col("members").alias("of_b"))
        both = self._ends(near, of_a, of_b, f"{name}_whole").select("a", "b", "of_a", "of_b")
        links = self.scratch.save(both.mapInArrow(releasing(_verified(self.percent)), "a binary, b binary"), f"{name}_links")
        self.scratch.drop(f"{name}_full", f"{name}_keys")
        return links

    def _hub_pairs(self, shared: DataFrame) -> DataFrame:
        """Each set with the hub of most of its bands."""
        met = shared.where("s <> b").groupBy(F.col("s").alias("a"), "b").agg(F.count("*").alias("c"))
        return met.groupBy("a").agg(F.max(F.struct("c", "b"))["b"].alias("b"))

    def _open(self, shared: DataFrame, roots: DataFrame | None, name: str) -> DataFrame:
        """(key, band, s, n, root) of bands whose sets are not all in one component."""
        rows = shared.select("key", "band", "s", "n")
        if roots is None:
            return rows.withColumn("root", F.col("s"))
        told = rows.join(roots.select(F.col("id").alias("s"), F.col("root").alias("r")), "s", "left").select("key", "band", "s", "n", F.coalesce("r", "s").alias("root"))
        told = self.scratch.save(told, f"{name}_told")
        split = told.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n")
        split = self.scratch.save(split, f"{name}_split")
        out = self.scratch.save(spread_join(told, split.select("key"), ["key"], self.scratch, f"{name}_hot", split), f"{name}_open")
        self.scratch.drop(f"{name}_told")
        return out

    def _block_pairs(self, rows: DataFrame, best: bool, name: str) -> DataFrame:
        """Promising pairs of the sets of each band; a band of more than BLOCK sets is dealt into blocks, and every two of them meet in a task of their own."""
        rows = self.scratch.save(rows, f"{name}_rows")
        least = max(BLOCK, rows.count() * 64 // BROADCAST_BYTES)  # so that the table of long bands can be broadcast
        long = rows.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > least)
        long = self.scratch.save(long.select("key", F.ceil(F.col("many") / least).cast("int").alias("blocks")), f"{name}_long")
        dealt = rows.join(F.broadcast(long), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("side", F.pmod(F.xxhash64("s"), "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("key", F.least("side", "o").alias("x"), F.greatest("side", "o").alias("y"), "band", "side", "s", "n", "root")
        named = self.scratch.save(rows.select("s").distinct().join(self.sets.select("s", "sketch"), "s").select("s", "sketch").mapInArrow(releasing(_keyed), "s binary, sketch binary, keys binary"), f"{name}_named")
        met = dealt.join(named, "s").select(*dealt.columns, "sketch", "keys")  # a set is in BANDS bands at most
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // 8_000)
        met = met.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y")
        return met.mapInArrow(releasing(_in_blocks(best, self.percent)), "a binary, b binary").distinct()

    def _roots(self) -> DataFrame | None:
        """(id, root) of all sets that link with another; None if there are none."""
        shared = self._banded()
        links = roots = None
        for name in ("hub", "near", "rest"):
            near = self._estimated(self._hub_pairs(shared), name) if name == "hub" else self._block_pairs(self._open(shared, roots, name), name != "rest", name)
            new = self._links(near, name)
            if new.limit(1).count():
                links = new if links is None else links.unionByName(new)
                roots = components(links, self.scratch, f"{name}_roots")
        self.scratch.drop("shared")
        return roots

    def components(self) -> DataFrame:
        """Per row: id, ``n_shingles`` and ``component_id`` (the smallest id that links lead to). Sets and components with many rows are dealt over tasks."""
        self._prepare()
        roots = self._roots()
        sets = self.sets.select("s", "first", "rows")
        if roots is not None:
            sets = sets.join(roots.select(F.col("id").alias("s"), F.col("root").alias("r")), "s", "left")
        sets = self.scratch.save(sets.select("s", F.coalesce("r", "s").alias("root") if roots is not None else F.col("s").alias("root"), "first", "rows"), "named")
        firsts = self.scratch.save(sets.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("n")), "firsts")
        told = spread_join(sets.select("s", "root", "rows"), firsts.select("root", F.col("first.id").alias("component_id")), ["root"], self.scratch, "hot_roots", firsts.select("root", "n"))
        told = self.scratch.save(told.select("s", "rows", "component_id"), "tops")
        total = sets.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        out = spread_join(self.rows.select("id", "k", "n", "s"), told.select("s", "component_id"), ["s"], self.scratch, "hot_sets", told.select("s", F.col("rows").alias("n")), total)
        return out.select(F.col("id").alias(self.id_col), F.col("n").alias("n_shingles"), "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id and ``kept``, whether it is its component's smallest id (a null id is, of nulls)."""
    found = NearDuplicates(docs, id_col, text_col, percent).components()
    return found.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
