"""N-gram Jaccard join: all links between texts whose shingle sets reach a similarity, as components.

A text's set holds the hashes of its five-word shingles. Two sets link when
intersection over union is at least 0.8, which asks for an overlap of
T = ceil(4 (n + m) / 9); sets that link share one of the first n - ceil(4 n / 5) + 1
members of each in any order common to all. Orders put frequent shingles last.

1. Equal sets become one. While sets are made, shingles frequent in a stretch of
   texts are counted; at most HOT of them, the most frequent, form the end of the order.
2. The first members of each set make inverted lists; a member that only one set
   has is dropped where it arrives.
3. Each set is searched with the hub of the lists it shares most; a list whose sets are
   all in one component then is done, so that a group of near copies is joined without its
   pairs. What is left between components is searched pair by pair, bounded by the
   place of the first common member. No link between components is lost.
4. A search is T-occurrence with DivideSkip (Li, Lu, Lu 2008): the query's inverted
   lists over a batch of records are split; short ones are merged on a heap, candidates
   that can still reach T are probed in the long ones by binary search.

A list, a hub or a set that very many meet is dealt over many tasks. Sets have 64-bit names; a
second hash shows which names two different sets share, and such sets are named by it.

Null texts and texts without words have empty sets, link with nothing and are
components of their own. Rows with a null id take part; a component of such rows only
has a null id. Repeated rows are equal sets. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, releasing, row_key, small_side, spread_join
from .components import components

SHINGLE = 5
#: Similarity 4/5: an overlap of at least 4/9 of both sizes.
#: Shingles at the end of the order, and so in a broadcast table: at most so many.
HOT = 1_000_000
#: Frequent shingles are looked for in stretches of so many shingles; seen so often, they are counted.
STRETCH, OFTEN = 3_000_000, 2
LIST_ROWS = 400_000
#: Sets of one list that are paired in one task.
BLOCK = 2_000
#: Sets whose 64-bit names clash with another one's, at most; of 2 ** 35 sets about 32 do.
CLASHES = 100_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a whole text, sorted, as signed integers."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), n)], np.uint64).view(np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    m = n - SHINGLE + 1
    s = h[:m].copy()
    for j in range(1, SHINGLE):
        s = s * _M1 + h[j : j + m]
    s ^= s >> np.uint64(31)
    s *= _M2
    s ^= s >> np.uint64(29)
    return np.unique(s.view(np.int64))


def set_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), len(s) & 0xFFFF)).view(np.int64))


def second_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), 0xA5A5A5)).view(np.int64))


def name_of(s: np.ndarray, clashing: frozenset) -> int:
    """The name of a set: its first hash, unless another set has the same one."""
    me = set_id(s)
    return second_id(s) if me in clashing else me


def required(n: int, m: int) -> int:
    """The least overlap of linked sets of these sizes."""
    return -(-4 * (n + m) // 9)


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def divide_skip(query: np.ndarray, records: list[np.ndarray], needs: list[int]) -> list[int]:
    """The places of the records that share at least ``needs`` members with the query; all are sorted."""
    lists: dict[int, list[int]] = {}
    for r, record in enumerate(records):
        at = np.searchsorted(query, record)
        at[at == len(query)] = 0
        for q in at[query[at] == record].tolist():
            lists.setdefault(q, []).append(r)
    least = min(needs, default=0)
    if not lists or least <= 0:
        return [r for r, need in enumerate(needs) if need <= 0]
    order = sorted(lists.values(), key=len)
    skip = min(int(least / (0.0085 * math.log(max(2, len(order[-1]))) + 1)), least - 1, len(order))
    short, long = order[: len(order) - skip], order[len(order) - skip :]
    found = []
    for r, run in groupby(heapq.merge(*short)):
        count, need = sum(1 for _ in run), needs[r]
        if count + len(long) < need:
            continue
        for i, one in enumerate(long):
            if count >= need or count + len(long) - i < need:
                break
            place = bisect_left(one, r)
            count += place < len(one) and one[place] == r
        if count >= need:
            found.append(r)
    return found


def _members(id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("k", pa.binary()), ("n", pa.int64()), ("set_id", pa.int64()), ("second", pa.int64()), ("hot", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])

    def frequent(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        s = np.sort(np.concatenate([*sets.values(), np.zeros(0, np.int64)]))
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        times = np.diff(np.append(starts, len(s)))
        often = times >= OFTEN
        row = {"id": None, "k": None, "n": None, "set_id": None, "second": None, "hot": s[starts[often]].tolist(), "times": times[often].tolist()}
        return pa.RecordBatch.from_pylist([row], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        total = 0
        for batch in batches:
            ns, ids, seconds = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text)
                ns.append(len(s))
                ids.append(set_id(s))
                seconds.append(second_id(s))
                if ids[-1] not in held:
                    held[ids[-1]] = s
                    total += len(s)
                if total >= STRETCH:
                    yield frequent(held)
                    held, total = {}, 0
            empty = pa.nulls(len(ns), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), batch.column(1), *(pa.array(x, pa.int64()) for x in (ns, ids, seconds)), empty, empty], schema=schema)
        yield frequent(held)

    return run


def _lists(hot, clashing):
    """Rows (h, set_id, n, pos, hot) of the first members of each set."""
    schema = pa.schema([("h", pa.int64()), ("set_id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("hot", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = hot.value
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > 200_000:  # copies farther apart meet in the list
                seen.clear()
            hs, ids, ns, ps, hots, size = [], [], [], [], [], 0
            for text in batch.column(0).to_pylist():
                s = shingle_set(text)
                me = name_of(s, clashing)
                if not len(s) or me in seen:
                    continue
                seen.add(me)
                p = prefix_length(len(s))
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    is_hot = known[at] == s
                else:
                    is_hot = np.zeros(len(s), bool)
                first = s[~is_hot][:p]
                if len(first) < p:
                    late = np.flatnonzero(is_hot)
                    late = late[np.lexsort((s[late], times[at[late]]))][: p - len(first)]
                    first, last = np.concatenate([first, s[late]]), len(first)
                else:
                    last = p
                hs.append(first)
                ids.append(np.full(p, me, np.int64))
                ns.append(np.full(p, len(s), np.int32))
                ps.append(np.arange(p, dtype=np.int32))
                hots.append(np.arange(p) >= last)
                size += p
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, ids, ns, ps, hots)], schema=schema)
                    hs, ids, ns, ps, hots, size = [], [], [], [], [], 0
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, ids, ns, ps, hots)], schema=schema)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition that holds lists whole: the rows of lists of two sets or more, each once."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    h, me = (table.column(i).to_numpy() for i in (0, 1))
    order = np.lexsort((me, h))
    h, me = h[order], me[order]
    new_list = np.concatenate([[True], h[1:] != h[:-1]])
    new_row = new_list | np.concatenate([[True], me[1:] != me[:-1]])
    starts = np.flatnonzero(new_list)
    sets = np.add.reduceat(new_row.astype(np.int64), starts)
    keep = new_row & np.repeat(sets > 1, np.diff(np.append(starts, len(h))))
    out = table.take(pa.array(order[keep])).combine_chunks()
    yield from out.to_batches(max_chunksize=200_000)


def _sets(clashing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                made = [shingle_set(t) for t in batch.slice(at, 1000).column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([name_of(s, clashing) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], names=["set_id", "members"])

    return run


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, a's members, b's members) those that link; b is the query, and the a of a batch its records."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            a, b, of_a, of_b = (part.column(i).to_pylist() for i in range(4))
            by_query: dict[int, list[int]] = {}
            for i, q in enumerate(b):
                by_query.setdefault(q, []).append(i)
            out = []
            for rows in by_query.values():
                query = np.frombuffer(of_b[rows[0]], np.int64)
                records = [np.frombuffer(of_a[i], np.int64) for i in rows]
                found = divide_skip(query, records, [required(len(query), len(r)) for r in records])
                out += [rows[r] for r in found]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in out], pa.int64()), pa.array([b[i] for i in out], pa.int64())], names=["a", "b"])


class JaccardJoin:
    """The join over one table of documents; ``components()`` gives a row for each of them."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "jaccard")
        self.id_col, self.id_type = id_col, docs.schema[id_col].dataType
        self.docs = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("k"), F.col(text_col).alias("text"))

    def members(self) -> DataFrame:
        """(id, k, n, set_id) of every row; keeps the broadcast order of frequent shingles."""
        from pyspark.sql.pandas.types import to_arrow_type

        kind = self.id_type.simpleString()
        made = self.scratch.save(self.docs.mapInArrow(releasing(_members(to_arrow_type(self.id_type))), f"id {kind}, k binary, n long, set_id long, second long, hot array<long>, times array<long>"), "made")
        hot = made.where("hot IS NOT NULL").select(F.explode(F.arrays_zip("hot", "times")).alias("x")).groupBy(F.col("x.hot").alias("h")).agg(F.sum("x.times").alias("times"))
        rows = hot.orderBy(F.desc("times"), "h").limit(HOT).toArrow()
        h, times = (rows.column(i).to_numpy().astype(np.int64) for i in (0, 1))
        order = np.argsort(h)
        self.hot = self.spark.sparkContext.broadcast((h[order], times[order]))
        members = made.where("hot IS NULL").select("id", "k", "n", "set_id", "second")
        same = members.groupBy("set_id").agg(F.min("second").alias("low"), F.max("second").alias("high")).where("low <> high")
        self.clashing = frozenset(r.set_id for r in same.select("set_id").limit(CLASHES + 1).collect())
        if len(self.clashing) > CLASHES:
            raise ValueError("too many sets for 64-bit names")
        if self.clashing:
            members = members.withColumn("set_id", F.when(F.col("set_id").isin(*self.clashing), F.col("second")).otherwise(F.col("set_id")))
        return members.drop("second")

    def lists(self, members: DataFrame) -> DataFrame:
        """The inverted lists of first members that two sets or more share: (h, set_id, n, pos)."""
        total = members.agg(F.sum(F.col("n") - F.ceil(F.col("n") * 0.8) + 1)).first()[0] or 0
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), int(total) // LIST_ROWS)
        rows = self.docs.select("text").mapInArrow(releasing(_lists(self.hot, self.clashing)), "h long, set_id long, n int, pos int, hot boolean")
        # A frequent list is known to be shared and is dealt by set too, so that no task gets one whole.
        salt = F.when(F.col("hot"), F.pmod("set_id", F.lit(64))).otherwise(F.lit(-1))
        dealt = rows.select("h", "set_id", "n", "pos", "hot").repartition(parts, "h", salt)
        kind = "h long, set_id long, n int, pos int, hot boolean"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rare = []
            for batch in batches:
                mask = batch.column(4)
                rare.append(batch.filter(pa.compute.invert(mask)))
                if (often := batch.filter(mask)).num_rows:
                    yield often
            yield from _shared(iter(rare))

        return self.scratch.save(dealt.mapInArrow(releasing(run), kind).select("h", "set_id", "n", "pos"), "lists")

    def reps(self, members: DataFrame) -> DataFrame:
        """(set_id, k): one row's key for every set."""
        self.repeated = bool(members.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").limit(1).count())
        return self.scratch.save(members.where("n > 0").groupBy("set_id").agg(F.min("k").alias("k")), "reps")

    def search(self, pairs: DataFrame, reps: DataFrame, name: str) -> DataFrame:
        """The linked ones of pairs (a, b). Only sets that pairs name are made, each from one row."""
        named = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
        keys = self.scratch.save(reps.join(named, "set_id", "left_semi").select("k"), f"{name}_keys")
        some = self.docs.join(small_side(keys, 24), "k", "left_semi")
        some = some.dropDuplicates(["k"]) if self.repeated else some
        sets = self.scratch.save(some.select("text").mapInArrow(releasing(_sets(self.clashing)), "set_id long, members binary"), f"{name}_sets")
        a, b = sets.select(F.col("set_id").alias("a"), F.col("members").alias("of_a")), sets.select(F.col("set_id").alias("b"), F.col("members").alias("of_b"))
        found = self.ends(pairs, a, b, f"{name}_hot").select("a", "b", "of_a", "of_b").mapInArrow(releasing(_search), "a long, b long")
        found = self.scratch.save(found, f"{name}_links")
        self.scratch.drop(f"{name}_keys", f"{name}_sets")
        return found

    def ends(self, pairs: DataFrame, of_a: DataFrame, of_b: DataFrame, name: str) -> DataFrame:
        """pairs, a scratch table, with what of_a and of_b tell of their ends; a set that is in many pairs is dealt over tasks."""
        counts = pairs.groupBy("b").agg(F.count("*").alias("n"))
        one = pairs.join(of_a, "a") if name.startswith("hub") else spread_join(pairs, of_a, ["a"], self.scratch, f"{name}_a")  # a set has one hub
        return spread_join(one, of_b, ["b"], self.scratch, f"{name}_b", counts, pairs.count())

    def plausible(self, pairs: DataFrame, lists: DataFrame, name: str) -> DataFrame:
        """Of pairs (a, b) those whose count of shared lists lets them link.

        Of two sets, all that the one whose last first member comes earlier shares among its
        first members is in lists of both; so they share at most as many members as
        lists, and what lies behind the first members of either.
        """
        pairs = self.scratch.save(pairs, f"{name}_met")
        of = self.scratch.save(lists.groupBy("set_id").agg(F.first("n").alias("n"), F.collect_set("h").alias("hs")), f"{name}_of")  # at most the first members of one set
        of_a, of_b = of.select(F.col("set_id").alias("a"), "n", F.col("hs").alias("of_a")), of.select(F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("hs").alias("of_b"))
        met = self.ends(pairs, of_a, of_b, f"{name}_many")
        return self._enough(met.select("a", "b", "n", "m", F.size(F.array_intersect("of_a", "of_b")).alias("c")))

    @staticmethod
    def _enough(counted: DataFrame) -> DataFrame:
        """Of (a, b, n, m, c) those of sizes and a count c of shared lists that let them link."""
        behind = lambda n: F.ceil(F.col(n) * 4 / 5) - 1
        sizes = (F.col("n") * 5 >= F.col("m") * 4) & (F.col("m") * 5 >= F.col("n") * 4)
        return counted.where(sizes & (F.col("c") + F.greatest(behind("n"), behind("m")) >= F.ceil((F.col("n") + F.col("m")) * 4 / 9))).select("a", "b")

    def hub_pairs(self, lists: DataFrame) -> DataFrame:
        """For each set of the lists (h, set_id, n, root, class) the hub with which it shares most lists.

        A list's hub, one for each class of sizes, is the set in which it comes earliest: what comes before are rarer
        members, so among near copies that is the one with the least of its own.
        """
        hubs = lists.groupBy("h", "class").agg(F.min(F.struct("pos", F.xxhash64("set_id").alias("c"), "set_id")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("h", "class", F.col("hub.set_id").alias("b"), "n")
        hubs = self.scratch.save(hubs, "hubs")
        met = spread_join(lists, hubs.drop("n"), ["h", "class"], self.scratch, "hot_lists", hubs.select("h", "class", "n")).where("set_id <> b")
        return met.groupBy(F.col("set_id").alias("a"), "b").agg(F.count("*").alias("n")).groupBy("a").agg(F.max(F.struct("n", "b"))["b"].alias("b"))

    def open_lists(self, lists: DataFrame, roots: DataFrame) -> DataFrame:
        """The rows, with their roots, of lists whose sets are not all in one component."""
        named = lists.drop("root").join(roots.select(F.col("id").alias("set_id"), F.col("root").alias("r")), "set_id", "left").withColumn("root", F.coalesce("r", "set_id")).drop("r")
        named = self.scratch.save(named, "named")
        split = named.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("h", "n")
        split = self.scratch.save(split, "split")
        out = self.scratch.save(spread_join(named, split.select("h"), ["h"], self.scratch, "hot_split", split), "open")
        self.scratch.drop("named")
        return out

    def all_pairs(self, lists: DataFrame) -> DataFrame:
        """Pairs of sets of different components that share a list, as far as sizes and places let them link.

        A list of more than BLOCK sets is dealt into blocks, and every two of them meet in a task of their own.
        """
        counts = lists.groupBy("h").agg(F.count("*").alias("many"))
        least = max(BLOCK, lists.count() * 64 // BROADCAST_BYTES)  # so that the table of long lists can be broadcast
        long = self.scratch.save(counts.where(F.col("many") > least).select("h", F.ceil(F.col("many") / least).cast("int").alias("blocks")), "long")
        dealt = lists.join(F.broadcast(long), "h", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("set_id"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        a = dealt.select("h", F.col("mine").alias("x"), F.col("other").alias("y"), F.col("set_id").alias("a"), F.col("n").alias("n"), F.col("pos").alias("i"), F.col("root").alias("ra"))
        b = dealt.select("h", F.col("other").alias("x"), F.col("mine").alias("y"), F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("pos").alias("j"), F.col("root").alias("rb"))
        fits = (F.col("ra") != F.col("rb")) & (F.col("a") < F.col("b")) & (F.col("n") * 5 >= F.col("m") * 4) & (F.col("m") * 5 >= F.col("n") * 4)
        # Linked sets share one of the first n - T + 1 members of a, which is one of the first m - T + 1 of b. Before a
        # common member lie at most min(i, j) others, behind it at most min(n - i, m - j) - 1.
        need = F.ceil((F.col("n") + F.col("m")) * 4 / 9)
        fits &= (F.col("i") <= F.col("n") - need) & (F.col("j") <= F.col("m") - need)
        fits &= F.least("i", "j") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= need
        return self.plausible(a.join(b, ["h", "x", "y"]).where(fits).select("a", "b").distinct(), lists, "rest")

    def roots(self, lists: DataFrame, reps: DataFrame) -> DataFrame | None:
        """(id, root) of all sets that link with another; None if there are none."""
        lists = lists.withColumn("root", F.col("set_id")).withColumn("class", F.floor(F.log(F.col("n").cast("double")) * 4.0))
        pairs = self.scratch.save(self.plausible(self.hub_pairs(lists), lists, "hub"), "hub_pairs")
        links = self.search(pairs, reps, "hub")
        if not links.limit(1).count():
            roots, todo = None, lists
        else:
            roots = components(links, self.scratch, "hub_roots")
            todo = self.open_lists(lists, roots)
        rest = self.search(self.scratch.save(self.all_pairs(todo), "rest_pairs"), reps, "rest")
        return self.joined(roots, rest, "rest_roots") if rest.limit(1).count() else roots

    def joined(self, roots: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
        """The roots after more links: components of the old components that links join."""
        if roots is None:
            return components(links, self.scratch, name)
        at = lambda end: roots.select(F.col("id").alias(end), F.col("root").alias(f"r{end}"))
        ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        tops = components(ends, self.scratch, name).select(F.col("id").alias("root"), F.col("root").alias("top"))
        old = roots.join(tops, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
        new = tops.select(F.col("root").alias("id"), F.col("top").alias("root")).join(roots, "id", "left_anti")
        return self.scratch.save(old.union(new), f"{name}_all")

    def components(self) -> DataFrame:
        """Per row: id, k, ``n_shingles``, ``component_id`` (the smallest id that links lead to) and ``keeper`` (the k of the row to keep).

        A set is named by 8 bytes, a row without words by the 16 of its key. Rows meet what their set tells once; sets with
        many rows and components with many sets are dealt over tasks.
        """
        members = self.members()
        lists = self.lists(members)
        self.hot.destroy()
        roots = self.roots(lists, self.reps(members))
        named = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
        members = members.withColumn("s", F.when(F.col("n") == 0, F.col("k")).otherwise(named("set_id"))).select("id", "k", "n", "s")
        sets = members.groupBy("s").agg(F.min(F.struct(F.col("id").isNull().alias("no"), F.col("id"), F.col("k"))).alias("first"), F.count("*").alias("rows"))
        if roots is not None:
            sets = sets.join(roots.select(named("id").alias("s"), named("root").alias("r")), "s", "left")
        sets = self.scratch.save(sets.select("s", F.coalesce("r", "s").alias("root") if roots is not None else F.col("s").alias("root"), "first", "rows"), "sets")
        firsts = self.scratch.save(sets.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("n")), "firsts")
        tops = firsts.select("root", F.col("first.id").alias("component_id"), F.col("first.k").alias("keeper"))
        told = spread_join(sets.select("s", "root"), tops, ["root"], self.scratch, "hot_roots", firsts.select("root", "n"))
        told = self.scratch.save(told.select("s", "component_id", "keeper"), "told")
        total = sets.agg(F.sum("rows")).first()[0] or 0
        out = spread_join(members, told, ["s"], self.scratch, "hot_sets", sets.select("s", F.col("rows").alias("n")), total)
        return out.select(F.col("id").alias(self.id_col), "k", F.col("n").alias("n_shingles"), "component_id", "keeper")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_shingles and component_id."""
    return JaccardJoin(docs, id_col, text_col).components().select(id_col, "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest id."""
    join = JaccardJoin(docs, id_col, text_col)
    found = join.scratch.save(join.components(), "found")
    losers = join.scratch.save(found.where("k <> keeper").select(F.col("k").alias("__vb_k")).distinct(), "losers")
    kept = docs.withColumn("__vb_k", row_key(id_col, text_col)).join(small_side(losers, 24), "__vb_k", "left_anti")
    repeated = found.where("k = keeper").groupBy("k").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return (kept.dropDuplicates(["__vb_k"]) if repeated else kept).drop("__vb_k").select(*docs.columns)
