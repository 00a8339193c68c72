"""A Merkle manifest of a dataset: leaves, parents' preimages, proofs and folding.

A row's leaf is the hash of its fields, each ``-`` if null, else its length in UTF-8 bytes, a colon and the value.
Leaves of a group (a language) are ordered by id; every ``arity`` nodes in a row have a parent, the hash of
their hashes written one behind the other: its preimage. The last parent of a level may have fewer children, even one.
What remains of a group is its subroot; subroots, in the order of the groups, have a tree of their own.

Parents are kept in blocks, each with the preimages of SPAN levels above 64 nodes, so that a block is a
row of bounded size and a tier of blocks one shuffle. Blocks take the preimages above them
from the tier above, and a leaf joins its block alone: it has the preimage of every ancestor then. In each it
cuts out its own 64 characters, which leaves its siblings, or puts others in their place, which folds another
leaf to the root. Groups of any size are dealt by (group, block), and places are counted in sorted ranges.

Null ids come first in their group, a null group before the others. Rows with the same id are ordered by
leaf; repeated rows are leaves of their own. Null and empty texts are different leaves. An empty table has no root and gives no rows.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.measure import number_within
from .common import Scratch, small_side

#: Children of a parent; levels that one block holds (at most 64 nodes at its foot).
ARITY, NODES = 2, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGITS = 64
_PLACES = (1 << 33) - 1


def digest(s: Column) -> Column:
    return F.sha2(s.cast("binary"), 256)


def leaf_hash(*fields: Column) -> Column:
    """The leaf of a row's fields; integers are written in decimal."""
    said = [f.cast("string") for f in fields]
    return digest(F.concat(*(F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in said)))


def _power(arity: int) -> tuple[int, int]:
    """Levels of a block and the nodes at its foot."""
    span = 1
    while arity ** (span + 1) <= NODES:
        span += 1
    return span, arity**span


@dataclass
class Tree:
    """Blocks of one or more trees: tiers of (g, block, n, pres), and the top of each tree (g, top)."""

    tiers: list[DataFrame]
    tops: DataFrame
    arity: int

    def above(self, tops: DataFrame) -> DataFrame:
        """The lowest blocks with ``above``: the (pre, slot) of all that lies above the block; tops has that of each tree's top."""
        span, foot = _power(self.arity)
        known = None
        for tier in reversed(self.tiers):
            if known is None:
                known = tier.join(tops, "g")
            else:
                high = known.select("g", F.col("block").alias("_up"), F.col("pres").alias("_pres"), F.col("n").alias("_n"), *(c for c in known.columns if c not in ("g", "block", "n", "pres")))
                low = tier.withColumn("_up", F.floor(F.col("block") / foot))
                path = own_path(F.col("block"), F.col("_pres"), self.arity)
                met = low.join(high, ["g", "_up"])
                known = met.withColumn("above", F.concat(path, F.col("above"))).drop("_up", "_pres", "_n")
        return known


def own_path(i: Column, pres: Column, arity: int) -> Column:
    """(pre, slot) of the ancestors of node i that its block holds, from below."""
    _, foot = _power(arity)
    at = lambda level: F.floor(F.pmod(i, F.lit(foot)) / F.pow(F.lit(float(arity)), level)).cast("int")
    return F.transform(pres, lambda level, x: F.struct(F.get(level, at(x + 1)).alias("pre"), F.pmod(at(x), F.lit(arity)).alias("slot")))


def build_tree(nodes: DataFrame, scratch: Scratch, name: str, arity: int = ARITY) -> Tree:
    """The tree of nodes (g, i, h, n): group, place from 0, hash and number of nodes in the group."""
    span, foot = _power(arity)
    tiers, step = [], 0
    while True:
        levels = F.size(F.filter(F.array(*(F.lit(arity**x) for x in range(span))), lambda p: F.col("n") > p))
        blocks = nodes.groupBy("g", "n", F.floor(F.col("i") / foot).alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("hs"))  # at most 64
        hashes = F.transform("hs", lambda x: x["h"])
        parents = lambda kids: F.transform(F.sequence(F.lit(0), F.floor((F.size(kids) - 1) / arity).cast("int")), lambda j: F.slice(kids, j * arity + 1, arity))
        first = F.transform(parents(hashes), lambda kids: F.array_join(kids, ""))
        above = lambda pres: F.transform(parents(pres), lambda kids: F.array_join(F.transform(kids, digest), ""))
        begin = F.when(levels > 0, F.array(first)).otherwise(F.array().cast("array<array<string>>"))
        pres = F.aggregate(F.slice(F.array(*map(F.lit, range(span))), 1, F.greatest(levels - 1, F.lit(0))), begin, lambda acc, _: F.array_append(acc, above(F.element_at(acc, -1))))
        top = F.when(F.size("pres") > 0, digest(F.get(F.element_at("pres", -1), F.lit(0)))).otherwise(F.get("hs", F.lit(0))["h"])
        tier = scratch.save(blocks.withColumn("pres", pres).withColumn("top", top).select("g", "block", "n", "pres", "top"), f"{name}_tier{step}")
        tiers.append(tier.drop("top"))
        nodes = tier.select("g", F.col("block").alias("i"), F.col("top").alias("h"), F.ceil(F.col("n") / foot).alias("n"))
        step += 1
        if not nodes.where("n > 1").limit(1).count():
            return Tree(tiers, nodes.select("g", F.col("h").alias("top")), arity)


def place_leaves(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """leaves (id, grp, leaf, ...) with g (the group's place), i (the leaf's place in it) and n (the group's leaves).

    Rows are sorted in ranges; a row's place is that within its range and what ranges before it hold of its group.
    """
    own = leaves.columns
    slim = scratch.save(leaves.withColumn("_tie", F.monotonically_increasing_id()), "slim")
    sorted_ = slim.orderBy("grp", "id", "leaf", "_tie").drop("_tie").withColumn("_m", F.monotonically_increasing_id())
    placed = scratch.save(sorted_.select(*own, F.shiftright("_m", 33).alias("part"), F.col("_m").bitwiseAND(F.lit(_PLACES)).alias("pos")), "sorted")
    scratch.drop("slim")
    runs = scratch.save(placed.groupBy("part", "grp").agg(F.min("pos").alias("first"), F.count("*").alias("rows")), "runs")
    groups = runs.groupBy("grp").agg(F.min(F.struct("part", "first")).alias("at"), F.sum("rows").alias("n"))
    groups = number_within(groups.select("grp", "n", "at.part", "at.first"), [], "first", F.col("part"), "g").select(F.col("grp").alias("_g"), "n", (F.col("g") - 1).alias("g"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("offset", before - F.col("first")).join(groups, F.col("grp").eqNullSafe(F.col("_g")))
    runs = scratch.save(runs.select(F.col("part").alias("_p"), F.col("grp").alias("_g"), "offset", "g", "n"), "placed_runs")
    met = placed.join(small_side(runs, 128), (F.col("part") == F.col("_p")) & F.col("grp").eqNullSafe(F.col("_g")))
    out = scratch.save(met.select(*own, "g", (F.col("pos") + F.col("offset")).alias("i"), "n"), "leaves")
    scratch.drop("sorted", "runs")
    return out


def without_own(step: Column) -> Column:
    """A parent's preimage without the 64 characters of one's own slot: the siblings, left to right."""
    return F.concat(F.substr(step["pre"], F.lit(1), step["slot"] * DIGITS), F.substr(step["pre"], (step["slot"] + 1) * DIGITS + 1))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path: its hash takes the place of the slot in each preimage."""
    put = lambda h, step: digest(F.concat(F.substr(step["pre"], F.lit(1), step["slot"] * DIGITS), h, F.substr(step["pre"], (step["slot"] + 1) * DIGITS + 1)))
    return F.aggregate(path, leaf, put)


class Manifest:
    """The manifest of docs: ``root``, ``leaves`` (id, grp, leaf, carried columns, g, i, n), ``subroots`` (g, subroot), and proofs."""

    def __init__(self, docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", carry: dict[str, Column] | None = None, arity: int = ARITY):
        """``carry``: columns of docs that proofs are to have too, by names that the manifest leaves free."""
        self.scratch, self.arity, self.id_col = Scratch(docs.sparkSession, "merkle"), arity, id_col
        self.carried = list(carry or {})
        rows = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf_hash(*(F.col(f) for f in fields)).alias("leaf"), *(c.alias(name) for name, c in (carry or {}).items()))
        self.leaves = place_leaves(rows, self.scratch)
        self.root, self.tree = None, None
        if not self.leaves.limit(1).count():
            return
        self.tree = build_tree(self.leaves.select("g", "i", F.col("leaf").alias("h"), "n"), self.scratch, "leaf", arity)
        self.subroots = self.scratch.save(self.tree.tops.select("g", F.col("top").alias("subroot")), "subroots")
        n = self.subroots.count()
        self.crown = build_tree(self.subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.col("subroot").alias("h"), F.lit(n).cast("long").alias("n")), self.scratch, "crown", arity)
        self.root = self.crown.tops.first().top  # one row

    def proofs(self) -> DataFrame:
        """The leaves with subroot, root and ``path``: (pre, slot) of each ancestor, from the leaf's parent to the root."""
        kind = "array<struct<pre:string,slot:int>>"
        none = F.array().cast(kind)
        if self.tree is None:
            return self.leaves.select("*", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"), none.alias("path"))
        _, foot = _power(self.arity)
        over = self.crown.above(self.crown.tops.select("g", none.alias("above")))
        crown = self.subroots.withColumn("_b", F.floor(F.col("g") / foot)).join(over.select(F.col("block").alias("_b"), F.col("pres").alias("_pres"), F.col("above").alias("_above")), "_b")
        tops = crown.select("g", "subroot", F.concat(own_path(F.col("g"), F.col("_pres"), self.arity), F.col("_above")).alias("above"))
        blocks = self.tree.above(tops).select("g", "block", "pres", "above", "subroot")
        met = self.leaves.withColumn("block", F.floor(F.col("i") / foot)).join(blocks, ["g", "block"])
        path = F.concat(own_path(F.col("i"), F.col("pres"), self.arity), F.col("above"))
        return met.select(*self.leaves.columns, "subroot", F.lit(self.root).alias("root"), path.alias("path"))

    def verify(self, leaf: Column) -> DataFrame:
        """Per row: id, leaf, subroot, root, ``proof_sha256``, ``folded_root`` and ``verified`` of another leaf, a column of the carried ones."""
        proof = digest(F.array_join(F.transform("path", without_own), ""))
        made = self.proofs().select(F.col("id").alias(self.id_col), "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(leaf, F.col("path")).alias("folded_root"))
        return made.withColumn("verified", F.col("folded_root") == F.col("root"))
