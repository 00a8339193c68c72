"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key ``-ln(u) / weight`` from a hash of its id
and text, so that reruns agree. A source whose target is above its size is
taken in complete epochs first; the rest of its target is filled along the order
of the keys up to the first document that does not fit. What is left of the budget, less than that
document, is filled from the counts of the sizes not taken, the largest size first and of each
size as many documents as fit, in the order of their keys; less is left than any document not taken. At
last comes the smallest of these, if that brings the source closer to its target.

No source is gathered in one task: sums over parts of a range of keys tell in
which part a budget ends, that part is divided again, and only when it holds at most ROWS rows
(or one key only) are they put in order. The documents of one size are a range of their own. Of a source a task sees the counts
of sizes that are less than one document.

The plan of a mix is one row for each source: target, epochs, the last key
taken, and the last key of each size that fills up. Applying it is a join on the source and a comparison; no text moves.

Null sources are one source, the last in order. Null texts have size 0 and are
taken only in epochs. Rows that agree in id and text share a key and are
taken alike, as are such rows with null ids: all of them, if they fit together, so that such a source may stay below its target by
as much as they hold. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.measure import number_within
from .common import WORD_SPLIT, Scratch, small_side

#: A target is at most so many times its source's size.
MAX_EPOCHS = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
SEED = 8
#: Parts into which a range of keys is divided; rows that one task puts in order.
PARTS, ROWS = 1024, 4096
SYMBOLS = r"[#*$%&|<>]+"


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT, -1), "")).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for texts without symbols, less with each one of a hundred characters."""
    n = F.char_length(text)
    symbols = n - F.char_length(F.regexp_replace(text, SYMBOLS, ""))
    return F.when(n > 0, 1.0 / (1.0 + 100.0 * symbols / n)).otherwise(F.lit(1.0))


def keyed(docs: DataFrame, weight: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with ``__vb_source``, ``__vb_size``, ``__vb_hash`` and ``__vb_key``."""
    text = F.col(text_col)
    weight = quality_weight(text) if weight is None else weight
    df = docs.withColumn("__vb_source", F.col(source_col)).withColumn("__vb_size", n_words(text)).withColumn("__vb_hash", F.xxhash64(F.lit(SEED), F.col(id_col), text))
    u = (F.shiftrightunsigned("__vb_hash", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return df.withColumn("__vb_key", -F.ln(u) / F.greatest(weight, F.lit(1e-6)))


def _ranged(df: DataFrame, scratch: Scratch, name: str, *order: Column) -> DataFrame:
    """df in ranges of an order, written, with ``__vb_part``: the range's place."""
    return scratch.save(df.orderBy(*order).withColumn("__vb_part", F.spark_partition_id()), name)


def mix_targets(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """(__vb_source, source_size, ...) with ``target``: weighted shares of the whole, none above MAX_EPOCHS times its source.

    Sources sorted by cap over weight: the first one whose share is within its cap
    fixes the share of all that follow; those before it stop at their caps. Places and sums along an order
    are counted in ranges of it, which the sums of the ranges before set off, so that no task sorts all sources.
    """
    by_name = F.col("__vb_source").asc_nulls_last()
    named = number_within(_ranged(sizes, scratch, "by_name", by_name), [], by_name, F.col("__vb_part"), "__vb_place").drop("__vb_part")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("__vb_place") - 1) % len(WEIGHTS) + 1).cast("int"))
    caps = named.withColumn("__vb_w", weight).drop("__vb_place").withColumn("__vb_cap", F.col("source_size") * float(MAX_EPOCHS)).withColumn("__vb_ratio", F.col("__vb_cap") / F.col("__vb_w"))
    rising = (F.col("__vb_ratio"), by_name)
    caps = _ranged(caps, scratch, "by_ratio", *rising)
    parts = caps.groupBy("__vb_part").agg(F.sum("__vb_cap").alias("c"), F.sum("__vb_w").alias("w"))
    upto = Window.orderBy("__vb_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = parts.select("__vb_part", F.coalesce(F.sum("c").over(upto), F.lit(0.0)).alias("__vb_c0"), F.coalesce(F.sum("w").over(upto), F.lit(0.0)).alias("__vb_w0"))
    whole = caps.agg(F.sum("source_size").alias("words"), F.sum("__vb_w").alias("weights")).first()
    inside = Window.partitionBy("__vb_part").orderBy(*rising).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(inside), F.lit(0.0))
    share = (F.lit(float(whole.words or 0)) - F.col("__vb_c0") - before("__vb_cap")) / (F.lit(float(whole.weights or 0)) - F.col("__vb_w0") - before("__vb_w"))
    fits = caps.join(parts, "__vb_part").select("__vb_ratio", share.alias("__vb_share")).where("__vb_share <= __vb_ratio")
    level = F.lit(fits.agg(F.max("__vb_share")).first()[0]).cast("double")  # shares fall from the first that fits on, also among equal ratios
    return caps.select(*sizes.columns, F.coalesce(F.least(level * F.col("__vb_w"), F.col("__vb_cap")), F.col("__vb_cap")).alias("target"))


def _of(slim: DataFrame, side: DataFrame, n: int) -> DataFrame:
    """The rows of the sources of side, which has a row for each (``__vb_s2``)."""
    return slim.join(small_side(side, 256, n), F.col("__vb_source").eqNullSafe(F.col("__vb_s2")))


def _ends(slim: DataFrame, ends: DataFrame, scratch: Scratch, name: str, n: int) -> DataFrame:
    """ends (__vb_s2, rest, before, low, high, rows) with the range of keys narrowed to few rows around the place where rest ends."""
    step = 0
    while ends.where(f"rows > {ROWS} AND low < high").limit(1).count():
        share = F.expm1(F.col("low") - F.col("__vb_key")) / F.expm1(F.col("low") - F.col("high"))  # keys are exponential: about even parts
        part = F.when(F.col("low") < F.col("high"), F.least(F.floor(share * PARTS), F.lit(PARTS - 1))).otherwise(0).cast("int")
        parts = _of(slim, ends, n).where("__vb_key BETWEEN low AND high").groupBy("__vb_s2", "rest", "before", part.alias("part"))
        parts = parts.agg(F.sum("__vb_size").alias("words"), F.min("__vb_key").alias("low"), F.max("__vb_key").alias("high"), F.count("*").alias("rows"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("__vb_s2").orderBy("part"))
        hit = parts.withColumn("upto", upto).where("upto >= rest AND upto - words < rest")
        ends = scratch.save(hit.select("__vb_s2", "rest", (F.col("upto") - F.col("words")).alias("before"), "low", "high", "rows"), f"{name}_ends{step}")
        step += 1
    return ends


_FILL = "array<struct<__vb_size:bigint,low:double,cut:struct<__vb_key:double,__vb_hash:bigint>>>"


def _upto(low: Column, cut: Column) -> Column:
    """Whether a row is below a range of keys, or in it up to a cut."""
    return F.coalesce((F.col("__vb_key") < low) | (F.struct("__vb_key", "__vb_hash") <= cut), F.lit(False))


def _taken() -> Column:
    """Whether a row is taken in the last pass of its source."""
    filled = F.exists("fills", lambda f: (f["__vb_size"] == F.col("__vb_size")) & _upto(f["low"], f["cut"]))
    return _upto(F.col("low"), F.col("cut")) | F.coalesce(filled, F.lit(False)) | F.coalesce(F.struct("__vb_key", "__vb_hash") == F.col("over"), F.lit(False))


def _cuts(slim: DataFrame, ends: DataFrame, n: int) -> DataFrame:
    """(__vb_s2, low, cut, words): of narrow ends the last row that fits, and what is taken up to it."""
    last = _of(slim, ends, n).where("__vb_key BETWEEN low AND high").groupBy("__vb_s2", "rest", "before", "low", "__vb_key", "__vb_hash").agg(F.sum("__vb_size").alias("size"))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("__vb_s2").orderBy("__vb_key", "__vb_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = F.col("upto") <= F.col("rest")
    cut = F.max(F.when(fits, F.struct("__vb_key", "__vb_hash")))
    return last.withColumn("upto", upto).groupBy("__vb_s2", "low").agg(cut.alias("cut"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.first("before")).alias("words"))


def _filled(slim: DataFrame, state: DataFrame, scratch: Scratch, name: str, n: int) -> DataFrame:
    """state with what fills up the budgets left, by the counts of sizes; ``planned`` is what should be left then."""
    free = _of(slim, state.where("left > 0"), n).where(~_taken() & (F.col("__vb_size") > 0) & (F.col("__vb_size") <= F.col("left")))
    sizes = free.groupBy("__vb_s2", "left", "__vb_size").agg(F.count("*").alias("rows"), F.min("__vb_key").alias("low"), F.max("__vb_key").alias("high"))
    largest = F.sort_array(F.collect_list(F.struct("__vb_size", "rows", "low", "high")), asc=False)  # sizes of less than one document

    def pick(acc: Column, x: Column) -> Column:
        times = F.least(x["rows"], F.floor(acc["left"] / x["__vb_size"]))
        more = F.when(times > 0, F.array_append(acc["picks"], x.withField("times", times))).otherwise(acc["picks"])
        return F.struct((acc["left"] - times * x["__vb_size"]).alias("left"), more.alias("picks"))

    none = F.array().cast("array<struct<__vb_size:bigint,rows:bigint,low:double,high:double,times:bigint>>")
    picked = sizes.groupBy("__vb_s2", "left").agg(largest.alias("sizes")).withColumn("x", F.aggregate("sizes", F.struct(F.col("left"), none.alias("picks")), pick))
    picked = scratch.save(picked.select(F.col("__vb_s2").alias("_s"), F.col("x.left").alias("planned"), "x.picks"), f"{name}_picked")
    picks = picked.select("_s", F.explode("picks").alias("p"))
    picks = scratch.save(picks.select(F.struct(F.col("_s").alias("s"), F.col("p.__vb_size").alias("size")).alias("__vb_s2"), (F.col("p.times") * F.col("p.__vb_size")).cast("double").alias("rest"), F.lit(0).cast("long").alias("before"), "p.low", "p.high", "p.rows"), f"{name}_picks")
    many = picks.count()
    by_size = free.select(F.struct(F.col("__vb_s2").alias("s"), F.col("__vb_size").alias("size")).alias("__vb_source"), "__vb_size", "__vb_key", "__vb_hash")
    cuts = _cuts(by_size, _ends(by_size, picks, scratch, name, many), many)
    entry = F.struct(F.col("__vb_s2.size").alias("__vb_size"), "low", "cut")
    cuts = cuts.groupBy(F.col("__vb_s2.s").alias("_c")).agg(F.collect_list(entry).alias("more"), F.sum("words").alias("words"))
    new = state.drop("planned").join(picked.drop("picks"), F.col("__vb_s2").eqNullSafe(F.col("_s")), "left").join(cuts, F.col("__vb_s2").eqNullSafe(F.col("_c")), "left")
    fills = F.concat("fills", F.coalesce("more", F.array().cast(_FILL)))
    return scratch.save(new.withColumn("fills", fills).withColumn("left", F.col("left") - F.coalesce("words", F.lit(0))).select(*state.drop("planned").columns, F.coalesce("planned", "left").alias("planned")), f"{name}_filled")


def _nearest(slim: DataFrame, state: DataFrame, scratch: Scratch, name: str, n: int) -> DataFrame:
    """state with ``over``: the smallest document not taken, where its source comes closer to the target with it than without."""
    free = _of(slim, state.where("left > 0"), n).where(~_taken() & (F.col("__vb_size") > 0) & (F.col("__vb_size") < 2 * F.col("left")))
    least = free.groupBy("__vb_s2", "left").agg(F.min(F.struct("__vb_size", "__vb_key", "__vb_hash")).alias("x"))
    least = scratch.save(least.select("__vb_s2", "left", F.struct("x.__vb_key", "x.__vb_hash").alias("found")), f"{name}_least")
    whole = _of(slim, least, n).where(F.struct("__vb_key", "__vb_hash") == F.col("found")).groupBy(F.col("__vb_s2").alias("_s"), "left", "found").agg(F.sum("__vb_size").alias("size"))  # repeated rows go together
    whole = whole.where(F.col("size") < 2 * F.col("left")).select("_s", "found")
    return state.drop("over").join(whole, F.col("__vb_s2").eqNullSafe(F.col("_s")), "left").withColumnRenamed("found", "over").drop("_s")


def mix_plan(slim: DataFrame, scratch: Scratch, name: str = "plan") -> DataFrame:
    """One row for each source of a keyed table: source_size, target, epochs, and low, cut, fills and over, which tell what its last pass takes."""
    sizes = slim.groupBy("__vb_source").agg(F.sum("__vb_size").alias("source_size"), F.min("__vb_key").alias("low"), F.max("__vb_key").alias("high"), F.count("*").alias("rows"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = mix_targets(sizes, scratch).withColumn("epochs", full).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = scratch.save(plan.withColumnRenamed("__vb_source", "__vb_s2"), f"{name}_targets")
    n = plan.count()
    ends = _ends(slim, plan.where("rest > 0").select("__vb_s2", "rest", F.lit(0).cast("long").alias("before"), "low", "high", "rows"), scratch, name, n)
    cuts = _cuts(slim, ends, n)
    state = plan.drop("low", "high", "rows").join(cuts.withColumnRenamed("__vb_s2", "_s"), F.col("__vb_s2").eqNullSafe(F.col("_s")), "left").drop("_s")
    state = state.withColumn("left", F.when(F.col("low").isNotNull(), F.col("rest") - F.col("words"))).withColumn("fills", F.array().cast(_FILL))
    state = state.withColumn("over", F.lit(None).cast("struct<__vb_key:double,__vb_hash:bigint>"))
    state = scratch.save(state.drop("rest", "words"), f"{name}_0")
    step, before = 1, None
    while before is None or state.where("left > planned").limit(1).count():  # again only where a cut met rows that share a key
        state = _filled(slim, state, scratch, f"{name}_{step}", n)
        left = state.agg(F.sum("left")).first()[0]
        if left == before:
            break
        step, before = step + 1, left
    state = scratch.save(_nearest(slim, state, scratch, name, n), f"{name}_last")
    return state.select("__vb_s2", "source_size", "target", "epochs", "low", "cut", "fills", "over")


def copies(df: DataFrame, plan: DataFrame) -> DataFrame:
    """A keyed table with source_size, target and ``copies``: how often the mix takes each row."""
    out = df.join(small_side(plan, 256), F.col("__vb_source").eqNullSafe(F.col("__vb_s2")), "left")
    return out.withColumn("copies", F.col("epochs") + _taken().cast("long")).drop("__vb_s2", "epochs", "low", "cut", "fills", "over")


def mix(docs: DataFrame, weight: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_text: bool = True) -> DataFrame:
    """docs with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (size times copies).

    Without the text only id and source remain of docs, and texts are read once.
    Columns of docs by these names are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    own = docs.columns if with_text else [id_col, source_col]
    names = [f"__vb_own{i}" for i in range(len(own))]  # names of docs cannot clash with those of the plan
    plain = docs.select(*(F.col(c).alias(x) for c, x in zip(own, names)), F.col(id_col).alias("__vb_id"), F.col(text_col).alias("__vb_text"), F.col(source_col).alias("__vb_from"))
    table = keyed(plain, weight, "__vb_id", "__vb_text", "__vb_from")
    slim = scratch.save(table.select(*([] if with_text else names), "__vb_source", "__vb_size", "__vb_hash", "__vb_key"), "slim")
    made = copies(table if with_text else slim, mix_plan(slim.select("__vb_source", "__vb_size", "__vb_hash", "__vb_key"), scratch))
    return made.select(*(F.col(x).alias(c) for c, x in zip(own, names)), F.col("__vb_size").alias("size"), "source_size", "target", "copies", (F.col("__vb_size") * F.col("copies")).alias("taken"))
