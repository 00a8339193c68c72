r"""License scans: ordered signature rules with priority and interval containment.

Only DataFrame functions run here, row by row, without a shuffle:

1. a text without any STEM is done (its words are only counted);
2. else its words are joined by one blank, and a keyword gates its rules;
3. every rule that matches gives spans of words: marks set around its matches
   show, in the split text, where they start and end;
4. spans are sorted by start, longer first; one that lies within a span of
   the same or a prior tier is suppressed, which a running maximum of ends
   for each tier shows in n * log(n) steps; spans that only overlap both stay.

A null or empty text has no words and no spans. Repeated rows each get their
result; ids of any type and null ids pass through.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower
from .license_rules import STEMS, rules

#: What stands between words; A-Z, not lower-cased yet, belongs to words. (Splitting reads a
#: text once, where the regexp_extract_all family copies it at every match.)
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: How sure a kept span of each tier makes a license.
TIER_SCORE = (1.0, 0.9, 0.6, 0.6)


def _gate(low: Column) -> Column:
    hit = F.lit(False)
    for stem in STEMS:
        for word in stem.split(" ")[:1]:
            hit = hit | F.contains(low, F.lit(word))
    return hit


def _rule_table() -> Column:
    """array of struct(keyword, rules): a constant, folded once for a plan."""
    by_key: dict[str, list[dict]] = {}
    for i, r in enumerate(rules()):
        by_key.setdefault(r.keyword, []).append({"rule": i, "tier": r.tier, "label": r.label, "base": r.base, "pattern": f"(?<= )(?:{r.pattern})(?= )"})
    table = json.dumps([{"keyword": k, "rules": v} for k, v in by_key.items()])
    return F.from_json(F.lit(table), "array<struct<keyword:string,rules:array<struct<rule:int,tier:int,label:string,base:boolean,pattern:string>>>>")


def _let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spans(norm: Column, rule: Column) -> Column:
    marked = F.split(F.trim(F.regexp_replace(norm, rule["pattern"], F.lit("\x01$0\x02"))), " ", -1)

    def of(words: Column) -> Column:
        at = lambda mark, where, plus: F.filter(F.transform(words, lambda w, i: F.when(where(w, F.lit(mark)), i + plus)), lambda x: x.isNotNull())
        pairs = F.arrays_zip(at("\x01", F.startswith, 0).alias("s"), at("\x02", F.endswith, 1).alias("e"))
        return F.transform(pairs, lambda p: F.struct(p["s"].cast("long").alias("start"), p["e"].cast("long").alias("end"), rule["tier"].alias("tier"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["base"].alias("base")))

    return _let(marked, of)


def prefix_max(values: Column) -> Column:
    """For each place of an array the maximum before it (null at the first): reach doubles with each step, n * log(n) in all."""

    def of(v: Column) -> Column:
        reaches = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(v) + 1)).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
        before = F.transform(v, lambda _, i: F.get(v, i - 1))
        return F.aggregate(reaches, before, lambda found, reach: F.transform(found, lambda x, i: F.greatest(x, F.get(found, i - reach))))

    return _let(values, of)


def _resolved(spans: Column) -> Column:
    """The spans that none of the same or a prior tier contains; spans come sorted."""
    tiers = range(len(TIER_SCORE))

    def ends(t: int) -> Column:
        return F.transform(spans, lambda s: F.when(s["tier"] <= t, s["end"]))

    before = [prefix_max(ends(t)) for t in tiers]
    with_max = F.arrays_zip(spans.alias("s"), *(b.alias(f"m{t}") for t, b in zip(tiers, before)))

    def stays(x: Column) -> Column:
        top = F.lit(None).cast("long")
        for t in tiers:
            top = F.when(x["s"]["tier"] == t, x[f"m{t}"]).otherwise(top)
        return top.isNull() | (top < x["s"]["end"])

    return F.transform(F.filter(with_max, stays), lambda x: x["s"])


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``n_words``, ``spans`` (every rule's matches) and ``kept`` (after suppression).

    Spans are struct(start, end, tier, rule, label, base) over words from 0, the end exclusive.
    """
    text = F.col("_t")
    words = lambda t: F.array_remove(F.split(t, BETWEEN, -1), "")
    df = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    df = df.withColumn("_low", F.lower("_t"))  # a column of its own: computed once for all stems
    df = df.select(*df.columns[: len(keep)], F.size(words(text)).cast("long").alias("n_words"), F.when(_gate(F.col("_low")), F.concat(F.lit(" "), F.array_join(words(ascii_lower(text)), " "), F.lit(" "))).alias("_norm"))
    norm = F.col("_norm")
    gated = F.flatten(F.transform(F.filter(_rule_table(), lambda k: F.contains(norm, k["keyword"])), lambda k: k["rules"]))
    found = F.flatten(F.transform(F.filter(gated, lambda r: F.rlike(norm, r["pattern"])), lambda r: _spans(norm, r)))
    order = F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["tier"].alias("tier"), s["rule"].alias("rule"), s["label"].alias("label"), s["base"].alias("base")))
    again = F.transform(F.sort_array(order), lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["tier"].alias("tier"), s["rule"].alias("rule"), s["label"].alias("label"), s["base"].alias("base")))
    df = df.withColumn("spans", F.when(norm.isNotNull(), again)).drop("_norm")
    df = df.withColumn("kept", F.when(F.size("spans") > 0, _resolved(F.col("spans"))))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,tier:int,rule:int,label:string,base:boolean>>")
    return df.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "n_words", F.coalesce("spans", empty).alias("spans"), F.coalesce("kept", empty).alias("kept"))


def license_score(kept: Column) -> Column:
    """0 without kept spans, else the score of the best tier among them."""
    best = F.array_min(F.transform(kept, lambda s: s["tier"]))
    score = F.lit(0.0)
    for t, x in enumerate(TIER_SCORE):
        score = F.when(best == t, F.lit(x)).otherwise(score)
    return score
