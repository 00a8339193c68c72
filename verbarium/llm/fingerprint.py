"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A text's words are lower-cased and split at blanks; its shingles are five words
in a row (a shorter text is one shingle, a text without words has none). The
sketch is the k smallest distinct 48-bit shingle hashes, in order. Sketches of
parts merge into the sketch of the whole, and estimate the number of distinct
shingles, resemblance (Jaccard) and containment; below k shingles they are exact.

Null texts are empty. Two empty sketches resemble each other fully, an empty and
another one not at all. Repeated rows get equal sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPLIT

K = 128
SHINGLE = 5
BITS = 48
#: Buckets of neighbouring ids, at most; cuts between them in a group; ids drawn for a cut; characters that split rows of one id.
BUCKETS, GROUP, DRAWN, PREFIX = 1 << 17, 256, 8, 64


def shingle_hashes(text: Column) -> Column:
    """The 48-bit hashes of a text's shingles, in order, not distinct."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_SPLIT, -1), "")

    def of_words(h: Column) -> Column:
        rolled = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (SHINGLE - 1), F.lit(0))), lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *(F.get(h, i + j) for j in range(1, SHINGLE))), 64 - BITS))
        whole = F.transform(h, lambda _: F.shiftrightunsigned(F.xxhash64(h), 64 - BITS))
        return F.when(F.size(h) >= SHINGLE, rolled).otherwise(whole)

    return F.element_at(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), of_words), 1)


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    """The bottom-k sketch of a whole text."""
    return bottom_k(shingle_hashes(text), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of what two sketched parts hold together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_estimate(a: Column, k: int = K) -> Column:
    """The number of distinct shingles: exact below k, else (k - 1) over the largest hash as a fraction."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * float(1 << BITS) / (F.array_max(a) + 1.0))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The share of the union's k smallest hashes that both sketches hold, 0 to 1."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's shingles that b holds, 0 to 1."""
    common = resemblance(a, b, k) * distinct_estimate(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_estimate(a, k)))


def to_text(a: Column) -> Column:
    """A sketch as text: 12 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), "")


def _place(cuts: Column, at: Column) -> Column:
    """How many of the cuts are at most ``at``."""
    return F.size(F.filter(cuts, lambda c: c <= at))


def with_next(docs: DataFrame, derive: dict[str, Column], id_col: str, carry: list[str], rows_per_bucket: int = 1000) -> DataFrame:
    """docs with the columns ``derive`` and ``next``: a struct of all of them in the next row by ascending id, after the last the first.

    Ids, of any type that has an order, are cut into buckets at every DRAWN-th of the ids that a hash draws, so that rows move
    once. The row at which a bucket begins is also dealt to the bucket before it; so each
    bucket knows its successor. Where an id (or null) has more rows than a bucket should, cuts take
    the start of the first carried column along, so that these rows are split as well; only rows that agree
    in both stay together. Up to BUCKETS * rows_per_bucket rows a bucket has about rows_per_bucket of them, beyond in
    proportion; buckets are sorted, and spill, as any sort does. Null ids come first; rows that share an id are ordered by
    the values carried.
    """
    at = F.col(id_col)
    facts = docs.groupBy(at).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("top")).first()
    tie = F.substring(F.col(carry[0]), 1, PREFIX) if (facts.top or 0) > rows_per_bucket else F.lit("")
    keyed = docs.withColumn("_key", F.struct(at.isNotNull().alias("has"), at.alias("id"), tie.alias("tie")))
    low = keyed.agg(F.min("_key").alias("low")).first().low
    rows = facts.n or 0
    step = max(1, rows // max(1, min(BUCKETS, rows // rows_per_bucket)) // DRAWN)
    drawn = keyed.select("_key").where(F.pmod(F.xxhash64("_key"), F.lit(step)) == 0).distinct()
    kind = docs.schema[id_col].dataType
    literal = lambda k: F.struct(F.lit(k.has).alias("has"), F.lit(k.id).cast(kind).alias("id"), F.lit(k.tie).alias("tie"))
    heads = [literal(r["_key"]) for r in drawn.where(F.pmod(F.xxhash64(F.lit(1), "_key"), F.lit(GROUP * DRAWN)) == 0).orderBy("_key").collect()]  # about BUCKETS / GROUP
    group = _place(F.array(*heads), F.col("_key")) if heads else F.lit(0)
    groups = drawn.groupBy(group.alias("_group")).agg(F.filter(F.sort_array(F.collect_list("_key")), lambda _, i: i % DRAWN == 0).alias("_cuts"))
    sizes = {r["_group"]: r["n"] for r in groups.select("_group", F.size("_cuts").alias("n")).collect()}
    before = F.array(*(F.lit(sum(sizes.get(g, 0) for g in range(i))) for i in range(len(heads) + 1)))
    placed = keyed.withColumn("_group", group).join(F.broadcast(groups), "_group", "left")  # about BUCKETS keys
    placed = placed.withColumn("_cuts", F.coalesce("_cuts", F.array().cast(groups.schema["_cuts"].dataType)))
    bucket = F.element_at(before, F.col("_group") + 1) + _place(F.col("_cuts"), F.col("_key"))
    begins = F.array_contains("_cuts", F.col("_key"))
    head = F.col("_key") == literal(low) if low else F.lit(False)
    homes = [F.struct(bucket.alias("b"), F.lit(0).alias("tail")), F.when(begins, F.struct((bucket - 1).alias("b"), F.lit(1).alias("tail"))), F.when(head, F.struct(F.lit(sum(sizes.values())).alias("b"), F.lit(2).alias("tail")))]
    dealt = placed.select(at, *carry, F.explode(F.array_compact(F.array(*homes))).alias("_home"))
    dealt = dealt.select(at, *carry, F.col("_home.b").alias("_b"), F.col("_home.tail").alias("_tail")).repartition("_b")
    dealt = dealt.withColumns(derive)
    order = Window.partitionBy("_b").orderBy("_tail", at.asc_nulls_first(), *carry)
    return dealt.withColumn("next", F.lead(F.struct(*carry, *derive)).over(order)).where("_tail = 0").drop("_b", "_tail")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Per row: id, n_chars, ``edited`` (the text, its last half replaced from the next one's start), the sketches of both, and the next text's."""
    df = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    df = with_next(df, {"_sketch": sketch(F.col("_text"), k)}, "_id", ["_text"])
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("_text", F.lit(1), n - half), F.substr("next._text", F.lit(1), half))
    df = df.select(F.col("_id").alias(id_col), n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("_sketch").alias("sketch"), F.col("next._sketch").alias("next_sketch"))
    return df.withColumn("edited_sketch", sketch(F.col("edited"), k))
