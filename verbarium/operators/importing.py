"""Raw dump records and authored entries as normalized entries: one narrow select, then ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.normalize import trim
from ..functions.text import relation_word
from ..sources.scratch import Scratch
from .measure import number_within


def _or_empty(c: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(c, F.array().cast(kind))


def related(items: Column) -> Column:
    """The words of relations, each with its romanization where that says more."""
    def one(x: Column) -> Column:
        word, roman = x["word"], x["roman"]
        return F.when(roman.isNotNull() & (roman != "") & (roman != word), F.concat(word, F.lit(" ("), roman, F.lit(")"))).otherwise(word)

    kept = F.filter(items, lambda x: x["word"].isNotNull() & (trim(x["word"]) != ""))
    told = F.transform(kept, lambda x: F.struct(relation_word(trim(x["word"])).alias("word"), trim(x["roman"]).alias("roman")))
    return _or_empty(F.transform(told, one))


def translations(items: Column, source_id: str) -> Column:
    """Translations that have a word and a language code."""
    target = lambda x: trim(F.coalesce(x["code"], x["lang_code"]))
    kept = F.filter(items, lambda x: (F.coalesce(trim(x["word"]), F.lit("")) != "") & (F.coalesce(target(x), F.lit("")) != ""))
    made = F.transform(kept, lambda x: F.struct(target(x).alias("target_lang"), trim(x["word"]).alias("text"), F.lit(source_id).alias("source_id")))
    return _or_empty(made, "array<struct<target_lang:string,text:string,source_id:string>>")


def pronunciations(sounds: Column, language: Column, source_id: str) -> Column:
    """Spoken forms, romanizations and recordings; for English those tagged American first, otherwise in order."""
    def of(x: Column) -> Column:
        tags, audio = _or_empty(x["tags"]), F.coalesce(x["mp3_url"], x["ogg_url"], x["audio"])
        ipa = trim(x["ipa"])
        roman = F.nullif(trim(F.coalesce(x["zh-pron"], x["zh_pron"], x["roman"])), F.lit(""))
        row = lambda text, kind: F.struct(text.alias("ipa"), F.lit(kind).alias("type"), tags.alias("tags"), audio.alias("audio"), F.lit(source_id).alias("source_id"))
        rows = F.array(
            F.when(F.coalesce(ipa, F.lit("")) != "", row(ipa, "ipa")),
            F.when(roman.isNotNull(), row(roman, "transcription")),
            F.when(x["ipa"].isNull() & roman.isNull() & audio.isNotNull(), row(F.lit(""), "audio")),
        )
        return F.array_compact(rows)

    all_rows = _or_empty(F.flatten(F.transform(sounds, of)), "array<struct<ipa:string,type:string,tags:array<string>,audio:string,source_id:string>>")
    american = lambda p: F.coalesce(F.exists(p["tags"], lambda t: F.lower(t).rlike("us|american|ga")), F.lit(False))
    return F.when(language == "en", F.concat(F.filter(all_rows, american), F.filter(all_rows, lambda p: ~american(p)))).otherwise(all_rows)


def dump_to_entries(records: DataFrame, source_id: str) -> DataFrame:
    """(line_no, base_id, entry columns) of records that have a lemma and a sense."""
    df = records.withColumn("lemma", trim(F.col("word"))).where("lemma <> ''")
    code = F.coalesce("lang_code", F.lit("und"))
    df = df.withColumn("language", F.when(code == "cmn", F.lit("zh")).otherwise(code))
    kind = F.schema_of_variant("etymology_number")
    number = F.when(kind.isin("STRING", "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.variant_get("etymology_number", "$", "string"))
    suffix = F.when(number.isNotNull(), F.concat(F.lit(":e"), number)).otherwise("")
    df = df.withColumn("base_id", F.concat("language", F.when(F.col("pos").isNull(), ":").otherwise(F.concat(F.lit(":"), F.col("pos"), F.lit(":"))), "lemma", suffix))
    above = F.array_distinct(F.concat(*(related(F.col(c)) for c in ("related", "derived", "coordinate_terms"))))
    df = df.where(F.exists("senses", lambda s: F.coalesce(trim(F.array_join(s["glosses"], "; ")), F.lit("")) != ""))  # before the costly part, which a filter on its result would double
    df = df.withColumns({"_coll": above, "_syn": related(F.col("synonyms")), "_trans": translations(F.col("translations"), source_id)})

    def sense(s: Column, i: Column) -> Column:
        first = i == 0
        text = F.array_join(s["glosses"], "; ")
        examples = F.filter(s["examples"], lambda e: F.coalesce(trim(e["text"]), F.lit("")) != "")
        examples = F.transform(examples, lambda e: F.struct(e["text"].alias("text"), F.coalesce(e["translation"], e["english"]).alias("translation"), e["roman"].alias("roman"), F.lit(source_id).alias("source_id")))
        extra = lambda c, kind="array<string>": F.when(first, F.col(c)).otherwise(F.array().cast(kind))
        own = F.concat(*(related(s[c]) for c in ("related", "derived", "coordinate_terms")))
        trans = "array<struct<target_lang:string,text:string,source_id:string>>"
        made = F.struct(
            F.coalesce(s["id"], F.concat(F.col("base_id"), F.lit(":s"), (i + 1).cast("string"))).alias("id"),
            text.alias("definition"),
            _or_empty(examples, "array<struct<text:string,translation:string,roman:string,source_id:string>>").alias("examples"),
            F.concat(translations(s["translations"], source_id), extra("_trans", trans)).alias("translations"),
            F.array_distinct(F.concat(related(s["synonyms"]), extra("_syn"))).alias("synonyms"),
            F.array_distinct(F.concat(own, extra("_coll"))).alias("collocations"),
            F.array_distinct(F.concat(_or_empty(s["tags"]), _or_empty(s["raw_tags"]))).alias("tags"),
            F.lit(source_id).alias("source_id"),
        )
        return F.when(F.coalesce(trim(text), F.lit("")) != "", made)

    senses = F.array_compact(F.transform("senses", sense))
    form = lambda x: F.struct(x["form"].alias("form"), F.coalesce(F.array_join(x["tags"], ", "), F.lit("form")).alias("type"), F.lit(source_id).alias("source_id"))
    forms = F.transform(F.filter("forms", lambda x: x["form"].isNotNull()), form)
    out = df.select("line_no", "base_id", "language", "lemma", "pos", pronunciations(F.col("sounds"), F.col("language"), source_id).alias("pronunciations"), senses.alias("senses"), _or_empty(forms, "array<struct<form:string,type:string,source_id:string>>").alias("forms"))
    return out


def stretch(rows: DataFrame) -> Column:
    """A rising function of line_no, of which each value has a bounded number of rows: the split of a file, or the upper bits of a number that holds the reading partition there."""
    if isinstance(rows.schema["line_no"].dataType, StructType):
        return F.struct("line_no.file", "line_no.block")
    return F.shiftright("line_no", 33)


def disambiguate(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries with ``id``: in input order the base id, or the first of ``~2``, ``~3``, ... that no earlier entry has; at most ``limit`` entries in that order.

    ``copy`` is the number of names tried.
    """
    if limit is not None:
        rows = rows.orderBy("line_no").limit(limit)
    out = number_within(rows, ["base_id"], "line_no", stretch(rows), "copy")
    if (met := _meeting(rows, out)) is not None:
        tried = F.aggregate(F.coalesce("_held", F.array().cast("array<bigint>")), F.col("copy") + F.coalesce("_late", F.lit(0)), lambda n, k: F.when(k <= n, n + 1).otherwise(n))
        out = out.join(met, "base_id", "left").withColumn("copy", tried.cast("long")).select(*out.columns)
    n = F.col("copy")
    return out.withColumn("id", F.when(n > 1, F.concat("base_id", F.lit("~"), n.cast("string"))).otherwise(F.col("base_id")))


def _meeting(rows: DataFrame, numbered: DataFrame) -> DataFrame | None:
    """(base_id, _late, _held) of the bases whose names meet; None if there are none.

    A base ``x~k`` is the k-th name of the base ``x``, and no other two bases share a name. Whichever comes first has it: then ``x`` passes over k (``_held``),
    or ``x~k`` begins with its second name (``_late`` is 1). Who comes first depends on the smaller numbers that ``x`` passes over and on whether
    ``x`` begins late itself; passes over the names that meet repeat until nothing changes.
    """
    parts = [F.regexp_extract("base_id", r"(?s)^(.*)~([1-9][0-9]{0,17})$", i) for i in (1, 2)]
    named = rows.groupBy("base_id").agg(F.min("line_no").alias("first")).select("base_id", "first", parts[0].alias("parent"), parts[1].try_cast("long").alias("k")).where("k > 1")
    if not named.limit(1).count():
        return None
    work = Scratch(rows.sparkSession, "ids")
    named = named.join(rows.select(F.col("base_id").alias("parent")).distinct(), "parent", "left_semi")
    state = work.save(named.withColumn("taken", F.lit(False)), "0")
    if not state.limit(1).count():
        return None
    parents = state.select(F.col("parent").alias("base_id")).distinct()
    lines = work.save(numbered.join(parents, "base_id", "left_semi").select(F.col("base_id").alias("parent"), F.col("copy").alias("at"), "line_no"), "lines")
    step = 0
    while True:
        late = state.where("taken").select(F.col("base_id").alias("parent"), F.lit(1).alias("late"))
        before = F.coalesce(F.sum((~F.col("taken")).cast("long")).over(Window.partitionBy("parent").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = state.withColumn("before", before).join(late, "parent", "left").withColumn("at", F.col("k") - F.coalesce("late", F.lit(0)) - F.col("before"))
        now = at.join(lines, ["parent", "at"], "left").select("base_id", "first", "parent", "k", F.coalesce(F.col("line_no") < F.col("first"), F.lit(False)).alias("now"), "taken")
        now = work.save(now, str(step + 1))
        changed = now.where("now <> taken").limit(1).count()
        state, step = now.select("base_id", "first", "parent", "k", F.col("now").alias("taken")), step + 1
        if not changed:
            break
    held = state.where("NOT taken").groupBy(F.col("parent").alias("base_id")).agg(F.sort_array(F.collect_list("k")).alias("_held"))  # names that stand in the input
    late = state.where("taken").select("base_id", F.lit(1).alias("_late"))
    return held.join(late, "base_id", "full")


def with_defaults(entries: DataFrame) -> DataFrame:
    """Authored entries with empty arrays where those are left out, in the entry schema."""
    out = entries
    for c in ("pronunciations", "senses", "forms"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast(out.schema[c].dataType)))
    strings = F.array().cast("array<string>")
    def filled(s: Column) -> Column:
        for c in ("synonyms", "collocations", "tags"):
            s = s.withField(c, F.coalesce(s[c], strings))
        for c, kind in (("examples", "array<struct<text:string,translation:string,roman:string,source_id:string>>"), ("translations", "array<struct<target_lang:string,text:string,source_id:string>>")):
            s = s.withField(c, F.coalesce(s[c], F.array().cast(kind)))
        return s

    out = out.withColumn("senses", F.transform("senses", filled))
    return out.withColumn("pronunciations", F.transform("pronunciations", lambda p: p.withField("tags", F.coalesce(p["tags"], strings))))


def map_sources(entries: DataFrame, f) -> DataFrame:
    """entries with f applied to every source id, nested ones too."""
    one = lambda x: x.withField("source_id", f(x["source_id"]))
    sense = lambda s: one(s).withField("examples", F.transform(s["examples"], one)).withField("translations", F.transform(s["translations"], one))
    return entries.withColumns({"pronunciations": F.transform("pronunciations", one), "forms": F.transform("forms", one), "senses": F.transform("senses", sense)})


def strip_default_source(entries: DataFrame, default: str) -> DataFrame:
    return map_sources(entries, lambda s: F.when(s == default, "").otherwise(s))


def fill_default_source(entries: DataFrame, default: str) -> DataFrame:
    return map_sources(entries, lambda s: F.when(F.coalesce(s, F.lit("")) == "", default).otherwise(s))
