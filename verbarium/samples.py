"""Packs and files made of the driver's tables, once for a session and folder of tables.

``lex-<language>``: the words of documents, with capitalized ones as names; ``parts``: names of parts, of
several words; ``texts-en`` and ``texts-rest``: documents as entries (these texts are in NFC); ``orders``: built from a raw dump, a record for each order
with its line items as senses. Each has the same entries and terms with ``-plain``, which leaves the text index out. All lie in the shared scratch folder and go with the session.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .functions.schemas import ENTRY
from .operators import measure, packs
from .operators.search import SearchEngine
from .sources import files
from .sources.scratch import Scratch

#: The tables hold Latin letters only, for which these split as the engine's own letter class does.
LETTERS = r"\p{L}\p{N}"
LANGUAGES = ("de", "en", "es", "fr")
SOURCE = {"id": "tables", "name": "Tables", "url": "", "license": "CC0", "attribution": ""}
#: Lines of a file of the dump, which is compressed, so that one task reads it.
DUMP_LINES = 100_000
#: Line items whose orders are shuffled at a time for the dump.
DUMP_ITEMS = 12_000_000
_made: dict[tuple[str, str], Samples] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def of(spark: SparkSession, sf: str) -> Samples:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _made:
        _made[key] = Samples(spark, sf)
    return _made[key]


def _rows(kind: str, *rows: Column) -> Column:
    """An array of those rows that are not null."""
    return F.array_compact(F.array(*(r.cast(kind) for r in rows))) if rows else F.array().cast(f"array<{kind}>")


_FORM = "struct<form:string,type:string,source_id:string>"
_SOUND = "struct<ipa:string,type:string,tags:array<string>,audio:string,source_id:string>"
_EXAMPLE = "struct<text:string,translation:string,roman:string,source_id:string>"


def _form(form: Column, kind: str) -> Column:
    return F.struct(form.alias("form"), F.lit(kind).alias("type"), F.lit("").alias("source_id"))


def _entries(df: DataFrame, **columns: Column) -> DataFrame:
    """df as entries: id, language, lemma, pos, definition and line_no are columns of it; forms, sounds, examples and synonyms may be given."""
    none = F.array()
    strings = lambda c: columns.get(c, none).cast("array<string>").alias(c)
    sense = F.struct(
        F.concat("id", F.lit(":s1")).alias("id"), F.col("definition"), columns.get("examples", none).cast(f"array<{_EXAMPLE}>").alias("examples"),
        none.cast("array<struct<target_lang:string,text:string,source_id:string>>").alias("translations"),
        strings("synonyms"), strings("collocations"), strings("tags"), F.lit("").alias("source_id"),
    )
    made = df.select("line_no", "id", "language", "lemma", "pos", columns.get("sounds", none).cast(f"array<{_SOUND}>").alias("pronunciations"), F.array(sense).alias("senses"), columns.get("forms", none).cast(f"array<{_FORM}>").alias("forms"))
    return made.select("line_no", *(f.split(" ")[0] for f in ENTRY.split(", ") if f.split(" ")[0] in made.columns))


def words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", F.explode(text.tokenize(F.col("text"), LETTERS)).alias("term"))


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf).groupBy("lang", "term").agg(F.count("*").alias("n"))


class Samples:
    """The packs and files of one folder of tables; each is made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf, self.scratch, self.known = spark, sf, Scratch(spark, "samples"), {}

    def _once(self, name: str, make) -> str:
        path = self.scratch.path(name)
        if name not in self.known:
            self.known[name] = make(path)
        return path

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf, name)

    def read(self, pack: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.pack(pack)}/{name}")

    def pack(self, name: str) -> str:
        kind, _, rest = name.partition("-")
        return self._once(f"packs/{name}", lambda path: getattr(self, f"_{kind}")(path, name, rest))

    def either(self, name: str) -> str:
        """A pack for what reads no text index: the one that has it if that is there, else the same entries and terms without."""
        return name if f"packs/{name}" in self.known else f"{name}-plain"

    def engine(self, *names: str, scan_payloads: bool = False) -> SearchEngine:
        found = SearchEngine(self.spark, scan_payloads)
        for name in names:
            found.add_pack(self.pack(name))
        return found

    def every_lexicon(self) -> SearchEngine:
        """An engine over the lexicons, opened once: callers leave its order and toggles alone."""
        if "engine" not in self.known:
            self.known["engine"] = self.engine(*(f"lex-{x}" for x in LANGUAGES))
        return self.known["engine"]

    def _manifest(self, name: str, languages: list[str]) -> dict:
        return {"id": name, "name": name, "version": "1", "schema_version": 2, "languages": languages, "sources": [SOURCE]}

    def _lex(self, path: str, name: str, rest: str) -> packs.BuildStats:
        lang, _, plain = rest.partition("-")
        lex = self._once("lexicon", lambda p: lexicon(self.spark, self.sf).write.parquet(p))
        rows = self.spark.read.parquet(lex).where(F.col("lang") == lang)
        term, n = F.col("term"), F.char_length("term")
        name_of = F.concat(F.upper(F.substring(term, 1, 1)), F.substr(term, F.lit(2)))
        both = F.array(F.struct(term.alias("lemma"), F.lit("word").alias("pos")), F.when(term.rlike("^[a-z]") & (n % 3 == 0), F.struct(name_of.alias("lemma"), F.lit("name").alias("pos"))))
        rows = rows.select("lang", "term", "n", F.explode(F.array_compact(both)).alias("x")).select(F.col("lang").alias("language"), "term", "x.*", F.concat(F.lit("seen "), "n").alias("definition"))
        rows = rows.withColumn("id", F.concat_ws(":", "language", "pos", "lemma"))
        rows = measure.number_within(rows, [], "lemma", F.ascii("lemma"), "line_no")
        forms = _rows(_FORM, F.when(n % 5 == 0, _form(F.concat(term, F.lit("s")), "plural")), F.when(n % 7 == 0, _form(F.reverse(term), "romanization")))
        said = F.struct(F.concat(F.lit("/"), term, F.lit("/")).alias("ipa"), F.lit("transcription").alias("type"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("audio"), F.lit("").alias("source_id"))
        return packs.write_pack(_entries(rows, forms=forms, sounds=_rows(_SOUND, F.when(n % 11 == 0, said))), self._manifest(name, [lang]), path, composed=True, indexed=not plain)

    def _parts(self, path: str, name: str, rest: str) -> packs.BuildStats:
        rows = self.table("part").select(F.col("p_partkey").alias("line_no"), F.concat(F.lit("part:"), "p_partkey").alias("id"), F.lit("en").alias("language"), F.col("p_name").alias("lemma"), F.lit("phrase").alias("pos"), F.concat_ws(" ", "p_brand", "p_type").alias("definition"))
        forms = F.transform(F.split("lemma", " "), lambda w: _form(w, "word"))
        return packs.write_pack(_entries(rows, forms=forms), self._manifest(name, ["en"]), path, composed=True, indexed=rest != "plain")

    def _texts(self, path: str, name: str, rest: str) -> packs.BuildStats:
        rest, _, plain = rest.partition("-")
        docs = self.table("documents").where("lang = 'en'" if rest == "en" else "lang <> 'en'")
        rows = docs.select(F.col("doc_id").alias("line_no"), F.concat(F.lit("doc:"), "doc_id").alias("id"), F.col("lang").alias("language"), F.concat(F.lit("text "), "doc_id").alias("lemma"), F.lit("text").alias("pos"), F.col("text").alias("definition"), "source")
        example = F.struct(F.substring("definition", 1, 60).alias("text"), *(F.lit(None).cast("string").alias(c) for c in ("translation", "roman")), F.lit("").alias("source_id"))
        made = _entries(rows.withColumn("definition", F.coalesce("definition", F.lit(""))), examples=F.array(example), synonyms=F.array("source", "language"))
        return packs.write_pack(made, self._manifest(name, [x for x in LANGUAGES if (x == "en") == (rest == "en")]), path, composed=True, indexed=not plain)

    def _orders(self, path: str, name: str, rest: str) -> packs.BuildStats:
        """The dump goes when it is read, unless another query has made it for itself."""
        kept, dump = "dump" in self.known, self.scratch.path(f"{name}.dump")
        if not kept:
            self._write_dump(dump)
        return packs.build_from_dump(self.spark, self.manifest(name, ["en", "zh", "und"]), self.dump() if kept else dump, path, "dump", indexed=rest != "plain", drop=not kept)

    def stats(self, pack: str) -> packs.BuildStats:
        self.pack(pack)
        return self.known[f"packs/{pack}"]

    def manifest(self, name: str, languages: list[str]) -> str:
        path = self.scratch.path(f"{name}.json")
        files.write_text(path, json.dumps(self._manifest(name, languages)))
        return path

    def dump(self) -> str:
        """Raw records, a line for each order; some are blank, some do not parse, some have no word."""
        return self._once("dump", self._write_dump)

    def _write_dump(self, path: str) -> None:
        """Orders come in stretches of their keys: of one alone the shuffle files lie on the disk."""
        with packs.lean(self.spark):
            for i, (low, high) in enumerate(self._order_stretches()):
                lines = self._dump(low, high).write.mode("append" if i else "overwrite")
                lines.option("maxRecordsPerFile", DUMP_LINES).text(path, compression="gzip")

    def _order_stretches(self) -> list[tuple[int | None, int | None]]:
        """Stretches (low, high] of the keys of orders, of about DUMP_ITEMS line items each."""
        n = -(-self.table("lineitem").count() // DUMP_ITEMS)
        ends = self.table("orders").select(F.percentile_approx("o_orderkey", [i / n for i in range(1, n)])).first()[0] if n > 1 else None
        ends = sorted(set(ends or []))
        return list(zip([None, *ends], [*ends, None]))

    def _dump(self, low: int | None = None, high: int | None = None) -> DataFrame:
        text_ = lambda s, c: F.concat(F.lit(s), F.col(c).cast("string"))

        def some(name: str, key: str) -> DataFrame:
            rows, k = self.table(name), F.col(key)
            if high is not None:
                rows = rows.where((k <= high) | k.isNull() if low is None else k <= high)  # orders without a key are in the first stretch
            return rows if low is None else rows.where(k > low)

        lines = some("lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"))).alias("x"))  # the lines of one order; their texts are made after the shuffle

        def item(r: Column) -> Column:
            said = lambda s, c: F.concat(F.lit(s), r[c].cast("string"))
            return F.struct(
                F.array(F.struct(said("part ", "l_partkey").alias("text"), said("line ", "l_linenumber").alias("english")), F.struct(F.lit(" ").alias("text"), F.lit(None).cast("string").alias("english"))).alias("examples"),
                F.when(r["l_linenumber"] % 4 == 0, F.array(F.lit(" "))).otherwise(F.array(r["l_returnflag"], r["l_linestatus"])).alias("glosses"),
                F.array(r["l_returnflag"]).alias("tags"), F.array(r["l_returnflag"], r["l_linestatus"]).alias("raw_tags"),
                F.array(F.struct(F.lit("de").alias("code"), said("Teil ", "l_partkey").alias("word")), F.struct(F.lit(None).cast("string").alias("code"), F.lit("x").alias("word"))).alias("translations"),
                F.array(F.struct(said("supplier ", "l_suppkey").alias("word"), said("s", "l_suppkey").alias("roman"))).alias("synonyms"),
                F.array(F.struct(F.concat(said("part ", "l_partkey"), F.lit(" (,")).alias("word"))).alias("related"),
            )

        rows = some("orders", "o_orderkey").select("o_orderkey", "o_orderstatus", "o_orderpriority").join(lines, "o_orderkey", "left")
        key = F.col("o_orderkey")
        sound = lambda **c: F.struct(*(c.get(n, F.lit(None).cast("string")).alias(n) for n in ("ipa", "roman", "audio", "mp3_url")), F.array_compact(F.array(c.get("tag", F.lit(None).cast("string")))).alias("tags"))
        sounds = F.array(sound(ipa=text_("/", "o_orderkey"), tag=F.lit("UK")), F.when(key % 2 == 0, sound(ipa=F.lit("/us/"), tag=F.lit("US"))), F.when(key % 3 == 0, sound(audio=F.lit("a.ogg"), mp3_url=F.lit("m.mp3"))), F.when(key % 5 == 0, sound(roman=text_("r", "o_orderkey"))))
        record = F.struct(
            F.when(key % 50 == 7, F.lit("  ")).otherwise(F.concat(F.lit(" order "), F.floor(key / 2).cast("string"))).alias("word"),
            F.when(F.col("o_orderstatus") == "F", "cmn").when(F.col("o_orderstatus") == "O", "en").alias("lang_code"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.lower(F.split("o_orderpriority", "-")[1])).alias("pos"),
            F.when(F.floor(key / 2) % 3 != 2, (F.floor(key / 2) % 3).cast("string")).alias("etymology_number"),
            F.array_compact(sounds).alias("sounds"),
            F.transform(F.coalesce("x", F.array().cast(rows.schema["x"].dataType)), item).alias("senses"),
            F.array(F.struct(F.col("o_orderstatus").alias("word"))).alias("synonyms"),
            F.array(F.struct(F.col("o_orderpriority").alias("word"))).alias("derived"),
            F.array(F.struct(F.lit("fr").alias("lang_code"), text_("commande ", "o_orderkey").alias("word"))).alias("translations"),
            F.array(F.struct(text_("orders ", "o_orderkey").alias("form"), F.array(F.lit("plural"), F.lit("x")).alias("tags")), F.struct(F.lit(" f ").alias("form"), F.lit(None).cast("array<string>").alias("tags"))).alias("forms"),
        )
        good = F.to_json(record)
        line = F.when(key % 97 == 5, F.concat(F.lit('{"word": "broken '), key.cast("string"))).when(key % 97 == 6, F.concat(F.lit('{"word": '), key.cast("string"), F.lit(', "senses": []}'))).otherwise(good)
        return rows.select(line.alias("value"))

    def sentences(self) -> tuple[str, str]:
        """Tables of sentences and links made of conversations: turns of users are French, the others English; each French one has links to the turns after it."""
        said = self.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("role") == "user", "fra").otherwise("eng").alias("lang"), F.regexp_replace("text", r"[\n\t\r]", " ").alias("text"))
        s = self._once("sentences", lambda p: said.select(F.concat_ws("\t", F.col("id").cast("string"), "lang", "text")).write.text(p))
        links = said.where("lang = 'fra'").select("id", F.explode(F.array(F.lit(1), F.lit(3))).alias("d"))
        links = links.repartitionByRange(1, "id").sortWithinPartitions("id", "d").select(F.concat_ws("\t", F.col("id").cast("string"), (F.col("id") + F.col("d")).cast("string")))
        return s, self._once("links", lambda p: links.write.text(p))  # one file: the first link is that which comes first in it

    def merged(self) -> str:
        s, k = self.sentences()
        return self._once("merged", lambda path: packs.merge_sentences(self.spark, self.pack("lex-fr"), s, k, "fr", path))

    def old_layout(self) -> str:
        """The parts as an old pack: no text index, terms name entries by id."""
        def make(path: str) -> None:
            for t in packs.PLAIN:
                df = self.read("parts-plain", t)
                if t == "terms":
                    df = df.select(F.col("id").alias("entry_id"), "term", "term_type", "loose_key", "term_rev")
                df.drop("files").write.mode("overwrite").parquet(f"{path}/{t}")

        return self._once("old_layout", make)

    def sentence_json(self) -> str:
        """Conversations as sentence records: the first turn, with groups of later ones as its translations; a JSON array in each file."""
        told = F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.when(F.col("role") == "user", "fra").otherwise("eng").alias("lang"), F.when(F.col("turn") % 2 == 0, "CC0").alias("license"))
        by = self.table("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", told.alias("t")))).alias("x"))  # the turns of one conversation
        later = F.transform(F.slice("x", 2, 1000), lambda r: r["t"])
        first = F.get("x", F.lit(0))["t"]
        groups = F.array(F.filter(later, lambda t: t["lang"] == "eng"), F.filter(later, lambda t: t["lang"] != "eng"))
        record = F.to_json(F.struct(first["id"].alias("id"), first["text"].alias("text"), first["lang"].alias("lang"), F.when(F.col("conv_id") % 2 == 0, "PD").alias("license"), groups.alias("translations")))
        return self._once("sentence_json", lambda p: by.select(record.alias("value")).mapInArrow(_json_array, "value string").write.text(p))

    def prepare(self) -> None:
        """What the queries of the benchmark read, made before they are timed."""
        for name in (*(f"lex-{x}" for x in LANGUAGES), "parts", "texts-en", "texts-rest"):
            self.pack(name)
        self.every_lexicon()
        self.dump()


def _json_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, a line each, as one JSON array."""
    first = True
    for batch in batches:
        lines = [("[" if first and not i else ",") + x for i, x in enumerate(batch.column(0).to_pylist())]
        first = first and not lines
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"], pa.string())], names=["value"])
