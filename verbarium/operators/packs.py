"""Packs: directories of Parquet tables built by DataFrame ETL.

``entries``, ``ids`` (the row of an id), ``sources`` and ``pack`` (one row, which also lists the files of the sorted tables with their least and largest
keys); ``terms``, and copies of it in the order of the loose key and of the reversed term, each with all that ranking needs; the text index is ``postings``, ``lengths`` (tokens of
an entry), ``frequencies`` (entries with a token), ``totals`` (one row: entries with tokens, their mean length) and ``blocks`` (of each BLOCK_ROWS entries
in a row those that have a token, and the largest share that one of them has of what the token can add to a score).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import normalize
from ..functions.schemas import PACK, SCHEMA_VERSION
from ..functions.text import fts_tokens, has_han, tokenize
from ..sources import files, readers
from ..sources.scratch import ship
from . import importing
from .measure import number_within

INDEX = ("postings", "lengths", "frequencies", "totals")
#: The terms, by the column whose order they are in.
PROJECTIONS = {"term": "terms", "loose_key": "terms_loose", "term_rev": "terms_rev"}
TABLES = ("entries", "ids", *PROJECTIONS.values(), *INDEX, "blocks", "sources", "pack")
#: Tables that packs of an old layout have.
PLAIN = ("entries", "terms", "sources", "pack")
#: What terms hold of their entry, so that ranking reads no entries.
COVER = ("id", "lemma", "language", "pos")
#: The columns by which a table's files are ranges. Frequent tokens are split by entry.
SORTED = {"entries": ("entry_rowid",), "ids": ("id",), "postings": ("token", "entry_rowid"), "lengths": ("entry_rowid",), "frequencies": ("token",), "blocks": ("token", "block")}
SORTED |= {t: (key, "term_type", "entry_rowid") for key, t in PROJECTIONS.items()}
#: Entries of a block of the text index; blocks that a ranked search scores first; ranges of entries that a scan is given.
BLOCK_ROWS, FIRST_BLOCKS, RANGES = 512, 8, 64
#: A pack of more files than this does not list them.
LISTED = 100_000
#: The compression of a pack's tables.
CODEC = "zstd"
#: Tables of a pack that are written at once, those of fewer rows than LARGE; others one by one, which shuffle less at a time.
AT_ONCE, LARGE = 4, 2_000_000
#: Rows of a stretch of keys that a table is shuffled by: terms, postings.
TERM_ROWS, POSTING_ROWS = 4_000_000, 24_000_000
#: Copies' names are broadcast below this, counted first; entries of a batch that Python groups.
BROADCAST_BYTES, BATCH_ROWS = 24 << 20, 2_000
#: What must hold of a pack before it takes its place.
INTEGRITY = ("count", "lemmas", "orphans", "indexed", "unique_ids")
WEIGHTS = (20.0, 10.0, 3.0, 1.0)
FIELDS = ("headwords", "definitions", "examples", "relations")
#: The source of merged sentences.
CREDIT = ("tatoeba", "Sentence corpus", "https://tatoeba.org", readers.SENTENCE_LICENSE, "Written and translated by contributors to Tatoeba; every example keeps the number of its sentence as its source")


def search_terms(entries: DataFrame, composed: bool = False) -> DataFrame:
    """(entry_rowid, term, term_type, loose_key, term_rev and COVER): lemma, forms other than it, romanizations."""
    lemma = normalize.trim(F.col("lemma"))
    forms = F.filter("forms", lambda f: normalize.trim(f["form"]) != lemma)
    roman = F.filter("forms", lambda f: F.lower(f["type"]).rlike("romanization|pinyin|transliteration"))
    spoken = F.filter("pronunciations", lambda p: p["type"].isin("transcription", "pinyin"))
    row = lambda text, kind: F.struct(text.alias("text"), F.lit(kind).alias("term_type"))
    every = F.concat(
        F.array(row(F.col("lemma"), "lemma")),
        F.transform(forms, lambda f: row(f["form"], "form")),
        F.transform(spoken, lambda p: row(p["ipa"], "transcription")),
        F.transform(roman, lambda f: row(f["form"], "transcription")),
    )
    rows = entries.select("entry_rowid", *COVER, every.alias("x")).withColumn("keys", normalize.exact_keys(F.transform("x", lambda x: x["text"]), composed))
    said = F.filter(F.zip_with("x", "keys", lambda x, k: F.struct(k.alias("term"), x["term_type"].alias("term_type"))), lambda t: t["term"] != "")
    rows = rows.select("entry_rowid", *COVER, F.explode(F.array_distinct(said)).alias("t")).select("entry_rowid", *COVER, "t.*")  # an entry's terms repeat within its row alone
    rows = rows.withColumn("loose_key", normalize.loose_key(F.col("term"), F.col("language"))).withColumn("term_rev", F.reverse("term"))
    return rows.select("entry_rowid", "term", "term_type", "loose_key", "term_rev", *COVER)


def _indexed(entries: DataFrame) -> DataFrame:
    """(entry_rowid, tokens, len): of an entry its four columns with their tokens in order, and how many those are."""
    every_form = F.transform(F.filter("forms", lambda f: f["form"] != F.col("lemma")), lambda f: f["form"])
    texts = {
        "headwords": F.concat(F.array("lemma"), every_form),
        "definitions": F.transform("senses", lambda s: s["definition"]),
        "examples": F.flatten(F.transform("senses", lambda s: F.flatten(F.transform(s["examples"], lambda e: F.array_compact(F.array(e["text"], e["translation"])))))),
        "relations": F.flatten(F.transform("senses", lambda s: F.concat(s["synonyms"], s["collocations"]))),
    }
    cols = F.array(*(F.struct(F.lit(n).alias("col"), fts_tokens(F.array_join(c, "\n")).alias("ts")) for n, c in texts.items()))
    size = F.aggregate("tokens", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.size(x["ts"]), F.lit(0)))
    return entries.select("entry_rowid", cols.alias("tokens")).withColumn("len", size)


def postings(words: DataFrame) -> DataFrame:
    """(token, entry_rowid, col, positions, len, tf, first, lead): the text of an entry's four indexed columns, with the entry's length; lines keep phrases apart by a gap only at columns.

    ``tf`` is the token's weighted count in all columns of the entry; one row of an entry's token is its ``first``, one of the entry its ``lead``. An entry's rows come of its own row, so that nothing is shuffled.
    """
    return words.select("entry_rowid", "len", "tokens").mapInArrow(_grouped, "token string, entry_rowid long, col string, positions array<int>, len long, tf double, first boolean, lead boolean")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of each token in each column of an entry, by sorting the tokens of a batch."""
    for batch in batches:
        cols = batch.column(2)
        of_row, each = pc.list_parent_indices(cols).to_numpy(), cols.flatten()
        name, ts = each.field("col"), each.field("ts")
        parent, flat = pc.list_parent_indices(ts).to_numpy(), ts.flatten()
        if not len(flat):
            continue
        sizes = np.bincount(parent, minlength=len(ts))
        at = (np.arange(len(flat)) - (np.cumsum(sizes) - sizes)[parent]).astype(np.int32)
        coded = flat.dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.lexsort((parent, code))  # places stay in order within a token and column
        code, parent = code[order], parent[order]
        begin = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (parent[1:] != parent[:-1])])
        ends = np.r_[begin, len(code)].astype(np.int32)
        code, parent = code[begin], parent[begin]
        row = of_row[parent]
        first = np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])]
        weight = np.array(WEIGHTS)[pc.index_in(name, pa.array(FIELDS)).to_numpy()]
        tf = np.add.reduceat(weight[parent] * np.diff(ends), np.flatnonzero(first))[np.cumsum(first) - 1]
        lead = np.zeros(len(row), bool)
        lead[np.unique(row, return_index=True)[1]] = True
        made = [coded.dictionary.take(pa.array(code)), batch.column(0).take(pa.array(row)), name.take(pa.array(parent)), pa.ListArray.from_arrays(pa.array(ends), pa.array(at[order])), batch.column(1).take(pa.array(row)), *map(pa.array, (tf, first, lead))]
        yield pa.RecordBatch.from_arrays(made, names=["token", "entry_rowid", "col", "positions", "len", "tf", "first", "lead"])


def _block() -> Column:
    return F.floor(F.col("entry_rowid") / BLOCK_ROWS)


def blocks(spark: SparkSession, folder: str, mean: float, rows: int = 1 << 16) -> DataFrame:
    """(token, block, n, top) of a pack's postings, a task for each of their files: those are in order and part no block, so that nothing is shuffled or sorted again."""
    names, size = files.parquets(f"{folder}/postings"), BLOCK_ROWS

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for batch in batches for i in batch.column(0).to_pylist()):
            held = None  # the rows of the last block, which may go on
            for batch in files.batches(f"{folder}/postings/{names[i]}", ["token", "entry_rowid", "col", "positions", "len"], rows):
                weight = np.array(WEIGHTS)[pc.index_in(batch.column("col"), pa.array(FIELDS)).to_numpy()]
                tf = weight * pc.list_value_length(batch.column("positions")).to_numpy()
                mine = pa.RecordBatch.from_arrays([batch.column("token"), batch.column("entry_rowid"), pa.array(tf), batch.column("len")], names=["token", "entry_rowid", "tf", "len"])
                mine = pa.Table.from_batches([mine] if held is None else [held, mine]).combine_chunks().to_batches()[0]
                token, at = mine.column(0), mine.column(1).to_numpy()
                new = np.r_[True, pc.not_equal(token[1:], token[:-1]).to_numpy(zero_copy_only=False) | (at[1:] // size != at[:-1] // size)]
                last = int(np.flatnonzero(new)[-1])
                if last:
                    yield _tops(mine.slice(0, last), new[:last], mean, size)
                held = mine.slice(last)
            if held is not None:
                yield _tops(held, np.arange(len(held)) == 0, mean, size)

    return spark.range(0, len(names), 1, max(1, len(names))).mapInArrow(of, "token string, block long, n long, top double")


def _tops(rows: pa.RecordBatch, new: np.ndarray, mean: float, size: int) -> pa.RecordBatch:
    """Of each block in rows, which begins where it is new: its entries and the largest share of one."""
    at, tf, length = (rows.column(i).to_numpy() for i in (1, 2, 3))
    entry = np.flatnonzero(new | np.r_[True, at[1:] != at[:-1]])
    share = bm25_share(np.add.reduceat(tf, entry), length[entry], mean)
    begin = np.flatnonzero(new)
    of_block = np.searchsorted(entry, begin)
    n = np.diff(np.r_[of_block, len(entry)])
    made = [rows.column(0).take(pa.array(begin)), *map(pa.array, (at[begin] // size, n, np.maximum.reduceat(share, of_block)))]
    return pa.RecordBatch.from_arrays(made, names=["token", "block", "n", "top"])


@contextmanager
def _with_conf(spark: SparkSession, values: dict[str, object]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def lean(spark: SparkSession):
    """Within it the shuffle files of a job go when the job ends; they stay until the driver's JVM collects garbage otherwise, and those of a whole build lie beside each other."""
    return _with_conf(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def _one_by_one(spark: SparkSession, folder: str):
    """Within it a task reads one file of a folder, or a part of one, so that rows in order are written in order."""
    part = max(1 << 20, min(128 << 20, files.size(folder) // spark.sparkContext.defaultParallelism))
    return _with_conf(spark, {"spark.sql.files.maxPartitionBytes": part, "spark.sql.files.openCostInBytes": part})


def _write(df: DataFrame, folder: str, table: str, counts: Observation | None = None, *what: Column, parts: int | None = None, in_order: bool = False, mode: str = "overwrite") -> None:
    """Write a table in its order, in which rows may come already; ``counts`` observes what is written."""
    if in_order:
        pass
    elif keys := SORTED.get(table):
        ends = ("token", _block()) if table == "postings" else keys  # no block is in two files
        df = (df.repartitionByRange(parts, *ends) if parts else df.repartitionByRange(*ends)).sortWithinPartitions(*keys)
    elif parts:
        df = df.coalesce(parts)
    if counts is not None:
        df = df.observe(counts, *what)
    writer = df.write.mode(mode).option("compression", CODEC).option("maxRecordsPerFile", 0)
    if table == "ids":
        writer = writer.option("parquet.bloom.filter.enabled#id", "true")
    writer.parquet(f"{folder}/{table}")


def _stretches(df: DataFrame, key: str, n: int, most: int) -> list[tuple[str | None, str | None]]:
    """Stretches [low, high) of a key of n rows, of about ``most`` rows each; they end between beginnings of two characters, which are counted, and one beginning is never cut."""
    ends, held = [], 0
    heads = df.groupBy(F.substring(key, 1, 2).alias("head")).agg(F.count("*").alias("n")).limit(LISTED + 1).collect() if n > most else []
    for r in sorted(heads) if len(heads) <= LISTED else []:
        if held and held + r.n > most:
            ends.append(r["head"])
            held = 0
        held += r.n
    return list(zip([None, *ends], [*ends, None]))


def _write_stretches(df: DataFrame, folder: str, table: str, stretches: list[tuple[str | None, str | None]]) -> None:
    """Write a table in its order, a stretch of its first key after the other: the rows of one alone are shuffled at a time."""
    key = F.col(SORTED[table][0])
    for i, (low, high) in enumerate(stretches):
        some = df if low is None else df.where(key >= low)
        _write(some if high is None else some.where(key < high), folder, table, mode="append" if i else "overwrite")


def _all(*jobs: Callable[[], None], at_once: int = AT_ONCE) -> None:
    """Run jobs that do not need each other, a few at once."""
    with ThreadPoolExecutor(at_once) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()


def tables_of(folder: str) -> list[str]:
    """The tables that a pack has: one may lack the text index, one of an old layout more."""
    return [t for t in TABLES if t in PLAIN or files.is_dir(f"{folder}/{t}")]


def listing(spark: SparkSession, folder: str) -> list[tuple] | None:
    """(table, name, low, high) of the files of a pack's sorted tables, keys as strings (numbers of twenty digits); None if there are too many. Tables whose files do not tell their ends are read."""
    found, names = [], {t: files.parquets(f"{folder}/{t}") for t in tables_of(folder) if t in SORTED}
    if sum(map(len, names.values())) > LISTED:
        return None
    for t in names:
        with ThreadPoolExecutor(2 * AT_ONCE) as pool:
            ends = list(pool.map(lambda name, t=t: files.ends(f"{folder}/{t}/{name}", SORTED[t][0]), names[t]))
        if None in ends:
            found += map(tuple, _read_ends(spark, folder, t).collect())
        else:
            said = lambda x: f"{x:020d}" if isinstance(x, int) else x
            found += [(t, name, *map(said, e)) for name, e in zip(names[t], ends) if e]
    return sorted(found)


def _read_ends(spark: SparkSession, folder: str, t: str) -> DataFrame:
    """(table, name, low, high) of a table's files by its rows."""
    rows, key = spark.read.parquet(f"{folder}/{t}"), SORTED[t][0]
    some = rows.select(F.lit(t).alias("table"), F.col("_metadata.file_name").alias("name"), F.col(key).alias("key"))
    ends = (some.distinct() if key == "token" else some).groupBy("table", "name").agg(F.min("key").alias("low"), F.max("key").alias("high"))  # ends of strings are found by sorting: of a token once
    said = lambda c: F.col(c) if rows.schema[key].dataType.simpleString() == "string" else F.lpad(F.col(c).cast("string"), 20, "0").alias(c)
    return ends.select("table", "name", said("low"), said("high"))


def _write_pack_row(spark: SparkSession, folder: str, pack_id: str, name: str | None, version: str | None, schema_version: int, languages: list[str], n: int, manifest: str) -> None:
    """The one row about a pack, written when its other tables are; a pack of an old layout lists no files."""
    listed = listing(spark, folder) if files.is_dir(f"{folder}/ids") else None
    _write(spark.createDataFrame([(pack_id, name, version, schema_version, languages, n, manifest, listed)], PACK).coalesce(1), folder, "pack")


def _rewrite_pack_row(spark: SparkSession, old: str, folder: str) -> None:
    m = spark.read.schema(PACK).parquet(f"{old}/pack").first()
    _write_pack_row(spark, folder, m.pack_id, m["name"], m.version, m.schema_version, list(m.languages), m.entry_count, m.manifest)


def number_rows(entries: DataFrame) -> DataFrame:
    """entries with ``entry_rowid`` for ``line_no``: 1, 2, ... in that order."""
    return number_within(entries, [], "line_no", importing.stretch(entries), "entry_rowid").drop("line_no")


@dataclass
class BuildStats:
    lines: int = 0
    bad_lines: int = 0
    skipped: int = 0
    entries: int = 0
    terms: int = 0
    id_collisions: int = 0
    transcription_terms: int = 0
    indexed: int = 0


def _numbered(entries: DataFrame, folder: str) -> DataFrame:
    """entries, stored in a folder, with ``entry_rowid`` for ``line_no``: 1, 2, ... in that order; read again they are in it file by file.

    What a reader has numbered is stored as it comes: rows of a split lie in a row, and the counts of the splits before one set it off. Other rows are sorted by ranges first, and so are those of
    splits that something has dealt anew.
    """
    spark, kind = entries.sparkSession, StructType([*entries.schema.fields, StructField("_at", LongType())])

    def store(df: DataFrame, to: str) -> DataFrame:
        df.select("*", F.monotonically_increasing_id().alias("_at")).write.mode("overwrite").parquet(to, compression=CODEC)
        return spark.read.schema(kind).parquet(to)

    def chunked(raw: DataFrame, chunk: Column) -> tuple[DataFrame, DataFrame]:
        rows, at = raw.withColumn("_chunk", chunk), F.col("_at")
        return rows, rows.groupBy("_chunk").agg(F.count("*").alias("_n"), F.min(at).alias("_low"), F.max(at).alias("_high"), F.min_by(at, "line_no").alias("_first"), F.max_by(at, "line_no").alias("_last"))

    raw, counts, to = None, None, folder
    if isinstance(entries.schema["line_no"].dataType, StructType):
        raw, counts = chunked(store(entries, folder), importing.stretch(entries))
        if counts.where("_high - _low + 1 <> _n OR _first <> _low OR _last <> _high").limit(1).count():
            entries, raw, to = raw.drop("_at", "_chunk"), None, f"{folder}_sorted"
    if raw is None:
        raw, counts = chunked(store(entries.repartitionByRange("line_no").sortWithinPartitions("line_no"), to), F.shiftright("_at", 33))
    so_far = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_chunk", "_low", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))  # a row a split or a partition
    return raw.join(F.broadcast(before), "_chunk").withColumn("entry_rowid", F.col("_before") + F.col("_at") - F.col("_low") + 1).select(*(c for c in entries.columns if c != "line_no"), "entry_rowid")


def write_pack(entries: DataFrame, manifest: dict, out: str, composed: bool = False, indexed: bool = True) -> BuildStats:
    """Write the tables of a pack and put them in place of what is there; entries come with id and line_no.

    All is written and checked beside its place first: a build that fails leaves an old pack as it was.
    Each table is computed once and counted as it is written.
    """
    return _build(entries.sparkSession, manifest, out, lambda raw: (_numbered(entries, raw), True), composed, indexed)


def _build(spark: SparkSession, manifest: dict, out: str, make: Callable[[str], tuple[DataFrame, bool]], composed: bool, indexed: bool) -> BuildStats:
    """``make`` stores entries in a folder and returns them numbered, and whether in order."""
    if manifest["schema_version"] > SCHEMA_VERSION:
        raise ValueError(f"pack format {manifest['schema_version']} is newer than {SCHEMA_VERSION}")
    part = f"{out}.part"
    files.delete(part)
    try:
        with lean(spark):
            entries, in_order = make(f"{part}/_raw")
            return _write_tables(spark, entries, in_order, manifest, out, part, composed, indexed)
    finally:
        files.delete(part)


def _write_tables(spark: SparkSession, entries: DataFrame, in_order: bool, manifest: dict, out: str, part: str, composed: bool, indexed: bool) -> BuildStats:
    """What a later table is made of lies on the disk only until that is written."""
    of_entries, of_terms, of_lengths = Observation(), Observation(), Observation()
    with _one_by_one(spark, f"{part}/_raw"):
        _write(entries, part, "entries", of_entries, F.count(F.lit(1)).alias("n"), F.max("entry_rowid").alias("top"), in_order=in_order)
    for made_of in ("_raw", "_raw_sorted", "_raw_names"):
        files.delete(f"{part}/{made_of}")
    stored = spark.read.parquet(f"{part}/entries")
    if indexed:
        _write_index(spark, stored, part, of_lengths)
    made = search_terms(stored, composed).observe(of_terms, F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("term_type") == "transcription", 1)).alias("spoken"))
    made.write.mode("overwrite").parquet(f"{part}/_terms", compression=CODEC)
    terms, n_terms = spark.read.parquet(f"{part}/_terms"), of_terms.get["n"]
    sources = spark.createDataFrame([(s["id"], s.get("name"), s.get("url"), s.get("license"), s.get("attribution")) for s in {s["id"]: s for s in manifest["sources"]}.values()], "id STRING, name STRING, url STRING, license STRING, attribution STRING")
    jobs = [lambda k=k, t=t: _write_stretches(terms, part, t, _stretches(terms, k, n_terms, TERM_ROWS)) for k, t in PROJECTIONS.items()]
    _all(*jobs, lambda: _write(stored.select("id", "entry_rowid"), part, "ids"), lambda: _write(sources, part, "sources"), at_once=AT_ONCE if n_terms < LARGE else 1)
    files.delete(f"{part}/_terms")
    n = of_entries.get["n"]
    if n != (of_entries.get["top"] or 0):  # rows were numbered by counts taken before
        raise ValueError(f"{n} entries stored of {of_entries.get['top']} counted")
    _write_pack_row(spark, part, manifest["id"], manifest.get("name"), manifest.get("version"), manifest["schema_version"], manifest["languages"], n, json.dumps(manifest))
    if n:
        check_pack(spark, part, INTEGRITY)
    files.replace(part, out)
    return BuildStats(entries=n, terms=n_terms, transcription_terms=of_terms.get["spoken"], indexed=of_lengths.get["n"] if indexed else 0)


def _write_index(spark: SparkSession, stored: DataFrame, folder: str, counts: Observation) -> None:
    """Texts are split once, into postings in the order of entries, of which all else is made."""
    ship(spark)
    of_posts = Observation()
    with _with_conf(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS}):
        postings(_indexed(stored)).drop("tf", "first").observe(of_posts, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/_posts", compression=CODEC)
    posts = spark.read.parquet(f"{folder}/_posts")
    _write(posts.where("lead").select("entry_rowid", "len"), folder, "lengths", counts, F.count(F.lit(1)).alias("n"))
    _write(spark.read.parquet(f"{folder}/lengths").agg(F.count("*").alias("n"), F.avg("len").alias("mean")), folder, "totals")
    mean = spark.read.parquet(f"{folder}/totals").first()["mean"] or 1.0
    _write_stretches(posts.drop("lead"), folder, "postings", _stretches(posts, "token", of_posts.get["n"], POSTING_ROWS))
    files.delete(f"{folder}/_posts")
    _write(blocks(spark, folder, mean), folder, "blocks", in_order=True)
    _write(spark.read.parquet(f"{folder}/blocks").groupBy("token").agg(F.sum("n").alias("df")), folder, "frequencies")


def check_pack(spark: SparkSession, folder: str, checks: tuple[str, ...] | None = None) -> None:
    """ValueError if the pack fails one of the checks, or any."""
    bad = sorted(k for k, ok in _checked(spark, folder, checks).items() if not ok)
    if bad:
        raise ValueError(f"not a valid pack: {bad[0]}")


def compact(spark: SparkSession, folder: str, file_mb: int = 128) -> None:
    """Rewrite a pack's tables in files of about so many megabytes, ranges of the same keys as before."""
    part = f"{folder}.part"
    files.delete(part)
    for t in tables_of(folder):
        if t != "pack":
            _write(spark.read.parquet(f"{folder}/{t}"), part, t, parts=max(1, files.size(f"{folder}/{t}") // (file_mb << 20)))
    _rewrite_pack_row(spark, folder, part)
    files.replace(part, folder)


def load_manifest(path: str) -> dict:
    found = json.loads(files.read_text(path))
    missing = [k for k in ("id", "schema_version", "languages") if k not in found]
    if missing or not found["languages"]:
        raise ValueError(f"manifest lacks {missing or 'languages'}")
    found.setdefault("sources", [])
    return found


def build_from_entries(spark: SparkSession, manifest_path: str, entries_path: str, out: str) -> BuildStats:
    """Strict: a bad line or a repeated id aborts the build before anything is written."""
    manifest = load_manifest(manifest_path)
    entries = importing.with_defaults(readers.read_entries(spark, entries_path))
    again = entries.groupBy("id").count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"repeated entry id {again[0]['id']}")
    if manifest["sources"]:
        entries = importing.strip_default_source(entries, manifest["sources"][0]["id"])
    return write_pack(entries, manifest, out)


def build_from_dump(spark: SparkSession, manifest_path: str, dump_path: str, out: str, source_id: str, max_entries: int | None = None, indexed: bool = True, drop: bool = False) -> BuildStats:
    """Lenient: bad lines are counted, repeated ids told apart. The dump is read once; with ``drop`` it goes when it is read."""
    manifest = load_manifest(manifest_path)
    if len({x["id"] for x in manifest["sources"]}) < len(manifest["sources"]):
        raise ValueError("repeated source id")
    lines, met = Observation(), []
    good, count = F.col("good"), F.count(F.lit(1))
    read = readers.parse_dump(spark, dump_path).observe(lines, count.alias("n"), F.count(F.when(~good, 1)).alias("bad")).where(good).drop("good", "value")

    def make(raw: str) -> tuple[DataFrame, bool]:
        entries = _numbered(importing.strip_default_source(importing.dump_to_entries(read, source_id), source_id), raw)
        if drop:
            files.delete(dump_path)
        if max_entries is not None:
            entries = entries.where(F.col("entry_rowid") <= max_entries)
        named, n, small = _named(entries, f"{raw}_names")
        met.append(n)
        return named, small

    stats = _build(spark, manifest | {"default_source_id": source_id}, out, make, False, indexed)
    stats.lines, stats.bad_lines, stats.id_collisions = lines.get["n"], lines.get["bad"], met[0]
    stats.skipped = stats.lines - stats.bad_lines - stats.entries if max_entries is None else 0
    return stats


def _named(entries: DataFrame, folder: str) -> tuple[DataFrame, int, bool]:
    """Numbered entries with ``id`` for ``base_id``, how many names were tried in vain, and whether they are in order still. Copies alone are stored and joined."""
    spark = entries.sparkSession
    rows = entries.select(F.shiftleft("entry_rowid", 16).alias("line_no"), "base_id")  # stretches of 131,072 entries
    copies = importing.disambiguate(rows).where("copy > 1").select(F.shiftright("line_no", 16).alias("entry_rowid"), "copy")
    copies.write.mode("overwrite").parquet(folder, compression=CODEC)
    copies = spark.read.parquet(folder)
    n, met = copies.agg(F.count("*"), F.coalesce(F.sum(F.col("copy") - 1), F.lit(0))).first()
    small = n * 16 <= BROADCAST_BYTES
    told = entries.join(F.broadcast(copies) if small else copies, "entry_rowid", "left")
    name = F.when(F.col("copy").isNull(), F.col("base_id")).otherwise(F.concat("base_id", F.lit("~"), F.col("copy").cast("string")))
    return told.withColumn("id", name).select("id", *(c for c in entries.columns if c != "base_id")), int(met), small


def merge_sentences(spark: SparkSession, pack: str, sentences_path: str, links_path: str, lang: str, out: str, max_per_entry: int = 3, prefer_english: bool = False) -> int:
    """A pack with example sentences added to the first sense of entries whose terms occur in them; returns how many."""
    target = readers.read_sentences(spark, sentences_path, readers.SENTENCE_LANGS.get(lang, lang))
    if not target.limit(1).count():
        raise ValueError(f"no sentence in {lang}")
    english = readers.read_sentences(spark, sentences_path, "eng").select(F.col("id").alias("b"), F.col("text").alias("translation")).dropDuplicates(["b"])
    links = readers.read_links(spark, links_path).join(target.select(F.col("id").alias("a")), "a", "left_semi")
    if prefer_english:
        links = links.join(english.select("b"), "b", "left_semi")
    told = target.join(first_links(links), target.id == F.col("a"), "left").join(english, "b", "left").select("id", "text", "translation")
    entries, terms = spark.read.parquet(f"{pack}/entries"), spark.read.parquet(f"{pack}/terms")
    ranked = sentence_hits(told.select("id", "text"), terms, max_per_entry).join(told, "id")
    example = F.struct("text", "translation", F.lit(None).cast("string").alias("roman"), F.concat(F.lit("tatoeba:"), F.col("id").cast("string")).alias("source_id"))
    new = ranked.groupBy("entry_rowid").agg(F.sort_array(F.collect_list(F.struct("id", example.alias("e")))).alias("new")).select("entry_rowid", F.transform("new", lambda x: x["e"]).alias("new"))
    joined = entries.join(new, "entry_rowid", "left")
    first_sense = F.get("senses", F.lit(0))
    known = F.transform(first_sense["examples"], lambda e: e["text"])
    fresh = F.filter("new", lambda e: ~F.array_contains(known, e["text"]))
    added = F.when(F.col("new").isNull() | (F.size("senses") == 0), F.array().cast("array<struct<text:string,translation:string,roman:string,source_id:string>>")).otherwise(fresh)
    senses = F.transform("senses", lambda s, i: F.when(i == 0, s.withField("examples", F.concat(s["examples"], F.col("added")))).otherwise(s))
    made = joined.withColumn("added", added).withColumn("senses", senses)
    part = f"{out}.part"
    files.delete(part)
    made.drop("new").write.mode("overwrite").parquet(f"{part}/entries_added")
    stored = spark.read.parquet(f"{part}/entries_added")
    credit = spark.createDataFrame([CREDIT], "id STRING, name STRING, url STRING, license STRING, attribution STRING")
    old = spark.read.parquet(f"{pack}/sources").join(credit.select("id"), "id", "left_anti")
    kept = [t for t in tables_of(pack) if t not in ("entries", "sources", "pack")]
    _all(lambda: _write(stored.drop("added"), part, "entries"), lambda: _write(old.unionByName(credit), part, "sources"), *(lambda t=t: _write(spark.read.parquet(f"{pack}/{t}"), part, t) for t in kept))
    _rewrite_pack_row(spark, pack, part)
    total = int(stored.agg(F.coalesce(F.sum(F.size("added")), F.lit(0))).first()[0])
    files.delete(f"{part}/entries_added")
    files.replace(part, out)
    return total


def first_links(links: DataFrame) -> DataFrame:
    """(a, b): of each sentence's links (a, b, line_no) the first one."""
    return links.groupBy("a").agg(F.min_by("b", "line_no").alias("b"))


def sentence_hits(sentences: DataFrame, terms: DataFrame, most: int, letters: str | None = None) -> DataFrame:
    """(entry_rowid, id): for each entry the first sentences (id, text) that hold its lemma or one of its forms, at most so many.

    The first of a word's sentences are enough: an entry's first ones are among those of its terms.
    """
    words = sentences.select("id", F.explode(F.array_distinct(tokenize(F.col("text"), letters) if letters else tokenize(F.col("text")))).alias("term"))
    first = F.row_number().over(Window.partitionBy("term").orderBy("id"))
    words = words.withColumn("rn", first).where(F.col("rn") <= most).drop("rn")  # ranked and cut before the shuffle too
    heads = terms.where("term_type IN ('lemma', 'form')").select("term", "entry_rowid").distinct()
    hits = words.join(heads, "term").select("entry_rowid", "id").distinct()
    return hits.withColumn("rn", F.row_number().over(Window.partitionBy("entry_rowid").orderBy("id"))).where(F.col("rn") <= most).drop("rn")


def payload(entries: DataFrame) -> Column:
    """An entry's record as JSON, names of fields included."""
    return F.to_json(F.struct(*(c for c in entries.columns if c != "entry_rowid")))


def orphans(terms: DataFrame, entries: DataFrame) -> DataFrame:
    """Terms whose entry is missing."""
    return terms.join(entries.select("entry_rowid").distinct(), "entry_rowid", "left_anti")


def undeclared(entries: DataFrame, languages: list[str]) -> DataFrame:
    """(language): languages of entries that a pack does not declare."""
    return entries.select("language").distinct().where(~F.col("language").isin(*languages))


def _checked(spark: SparkSession, pack: str, wanted: tuple[str, ...] | None = None) -> dict[str, bool]:
    """Whether a pack keeps each invariant, or each of those wanted; what is read for that is read a few tables at once."""
    entries, terms = (spark.read.parquet(f"{pack}/{t}") for t in ("entries", "terms"))
    m = spark.read.schema(PACK).parquet(f"{pack}/pack").first()
    by_entry = terms.groupBy("entry_rowid").agg(F.bool_or(F.col("term_type") == "lemma").alias("lemma"), F.bool_or(F.col("term_type") == "transcription").alias("spoken"))
    some = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    reads = {
        "entries": lambda: entries.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first(),
        "terms": lambda: by_entry.join(entries.select("entry_rowid", F.lit(True).alias("there")), "entry_rowid", "left").agg(some(F.col("lemma")).alias("lemmas"), some(F.col("spoken")).alias("spoken"), some(F.col("there").isNull()).alias("orphans")).first(),
        "lengths": lambda: spark.read.parquet(f"{pack}/lengths").count() if "lengths" in tables_of(pack) else None,
        "languages": lambda: wanted is not None and "languages" not in wanted or undeclared(entries, m.languages).limit(1).count(),
    }
    with ThreadPoolExecutor(AT_ONCE) as pool:
        got = {k: pool.submit(f) for k, f in reads.items()}
        of, in_terms, indexed, strange = (got[k].result() for k in ("entries", "terms", "lengths", "languages"))
    checks = {"entries": of.n > 0, "count": of.n == m.entry_count, "lemmas": in_terms.lemmas == of.n, "orphans": not in_terms.orphans, "languages": not strange, "indexed": indexed is None or 0 < indexed <= of.n, "transcriptions": "zh" not in m.languages or in_terms.spoken > 0, "unique_ids": of.ids == of.n}
    return {k: bool(v) for k, v in checks.items() if wanted is None or k in wanted}


def validate_pack(spark: SparkSession, pack: str) -> DataFrame:
    """(check, ok): the invariants that every built pack keeps."""
    return spark.createDataFrame(list(_checked(spark, pack).items()), "check STRING, ok BOOLEAN")


def coverage(entries: DataFrame) -> DataFrame:
    """One row: entries, how many have each feature, and the share of Han lemmas, in one pass."""
    some = lambda c: F.sum(F.when(c, 1).otherwise(0))
    has = lambda f: F.exists("senses", lambda s: F.size(s[f]) > 0)
    return entries.agg(
        F.count("*").alias("entries"),
        some(F.exists("pronunciations", lambda p: p["ipa"] != "")).alias("ipa"),
        *(some(has(f)).alias(f) for f in ("examples", "translations", "synonyms", "collocations")),
        F.avg(F.when(has_han(F.col("lemma")), 1.0).otherwise(0.0)).alias("han_share"),
    )


def coverage_warnings(spark: SparkSession, pack: str) -> DataFrame:
    """(warning): what a pack of its languages should have and lacks. Warnings never fail a build; a pack without entries does."""
    entries, terms = spark.read.parquet(f"{pack}/entries"), spark.read.parquet(f"{pack}/terms")
    row = coverage(entries).first()
    if not row.entries:
        raise ValueError(f"{pack} has no entries")
    languages, found = spark.read.parquet(f"{pack}/pack").first().languages, []
    if "en" in languages and not row.translations:
        found.append("no entry has a translation")
    if "zh" in languages and row.han_share < 0.5:
        found.append("fewer than half of the lemmas are Han")
    if "zh" in languages and not terms.where("term_type = 'transcription'").limit(1).count():
        found.append("no transcriptions")
    return spark.createDataFrame([(x,) for x in found], "warning STRING")


def inspect(spark: SparkSession, pack: str) -> tuple[int, dict, dict[str, int]]:
    """Entries, manifest and terms of each type of a pack."""
    meta = spark.read.parquet(f"{pack}/pack").first()
    kinds = {r.term_type: r.n for r in term_counts(spark.read.parquet(f"{pack}/terms")).orderBy("term_type").collect()}
    return spark.read.parquet(f"{pack}/entries").count(), json.loads(meta.manifest), kinds


def term_counts(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term_type").agg(F.count("*").alias("n"))


def bm25_idf(df: Column, n: Column) -> Column:
    return F.greatest(F.ln((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))


def bm25_share(tf, length, mean, k1: float = 1.2, b: float = 0.75):
    """Of columns, or of numbers in tasks."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def bm25_gain(tf: Column, df: Column, length: Column, n: Column, mean: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return bm25_idf(df, n) * bm25_share(tf, length, mean, k1, b)


def _weighted(positions: Column) -> Column:
    """The sum over an entry's columns of a token's occurrences, by the column's weight."""
    w = F.element_at(F.create_map(*(x for f, v in zip(FIELDS, WEIGHTS) for x in (F.lit(f), F.lit(v)))), F.col("col"))
    return F.sum(w * F.size(positions))


def weighted_tf(post: DataFrame, *keys: str) -> DataFrame:
    """(keys, token, entry_rowid, tf): how often an entry has a token, columns weighted."""
    return post.groupBy(*keys, "token", "entry_rowid").agg(_weighted(F.col("positions")).alias("tf"))


def bm25(spark: SparkSession, pack: str, tokens: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(entry_rowid, score): Okapi BM25 with column weights over a pack's index, for entries that have every token.

    Reads the rows of the tokens alone; the lengths of the entries found, and two tables of a row or a few, which
    are broadcast: ``totals`` has one row, ``frequencies`` one for each token asked.
    """
    of = {t: spark.read.parquet(f"{pack}/{t}") for t in INDEX}
    tokens = sorted(set(tokens))
    wanted = F.col("token").isin(*tokens)
    tf = weighted_tf(of["postings"].where(wanted))
    x = tf.join(F.broadcast(of["frequencies"].where(wanted)), "token").join(of["lengths"], "entry_rowid").withColumn("_one", F.lit(1))
    x = x.join(F.broadcast(of["totals"].withColumn("_one", F.lit(1))), "_one")
    gain = bm25_gain(F.col("tf"), F.col("df"), F.col("len"), F.col("n"), F.col("mean"), k1, b)
    scored = x.groupBy("entry_rowid").agg(F.sum(gain).alias("score"), F.count("*").alias("found"))
    return scored.where(F.col("found") == len(tokens)).select("entry_rowid", "score")


def _scored(post: DataFrame, known: dict, tokens: list[str], in_a_row: bool) -> DataFrame:
    """(entry_rowid, score): BM25 of the entries that have every token, or in one column of which the tokens stand in a row. One shuffle brings an entry's rows together."""
    one = post.groupBy("entry_rowid").agg(F.collect_list(F.struct("token", "col", "positions")).alias("ps"), F.first("len").alias("len"))  # a row for each token and column at most
    of = lambda t, c: F.flatten(F.transform(F.filter("ps", lambda p: (p["token"] == t) & (p["col"] == c)), lambda p: p["positions"]))

    def starts(i: int, c: str) -> Column:
        return F.transform(of(tokens[i], c), lambda p: p - i)

    def together(c: str) -> Column:
        return F.size(reduce(F.array_intersect, (starts(i, c) for i in range(len(tokens))))) > 0

    def tf(t: str) -> Column:
        return reduce(Column.__add__, (F.lit(w) * F.size(of(t, f)) for f, w in zip(FIELDS, WEIGHTS)))

    distinct = sorted(set(tokens))
    wanted = reduce(Column.__or__, map(together, FIELDS)) if in_a_row else F.size(F.array_distinct(F.transform("ps", lambda p: p["token"]))) == len(distinct)
    gains = (bm25_gain(tf(t), F.lit(known[t].df), F.col("len"), F.lit(known[t].n), F.lit(known[t]["mean"])) for t in distinct)
    return one.where(wanted).select("entry_rowid", reduce(Column.__add__, gains).alias("score"))


def best_scores(post: DataFrame, facts: DataFrame, blocks: DataFrame | None, tokens: list[str], most: int, in_a_row: bool = False) -> DataFrame:
    """(entry_rowid, score): at most so many entries with the highest BM25, of those that have every token, or the tokens in a row.

    ``post`` has the rows of the tokens with ``len``, facts a row for each token (token, df, n, mean). With ``blocks``, a block's entries can score
    no more than the sum of its largest shares: the FIRST_BLOCKS blocks of the highest sums are scored, and of the others those whose sums reach the last score
    that these leave among the best.
    """
    known = {r.token: r for r in facts.collect()}  # a row a token
    best = lambda df: df.orderBy(F.desc("score"), "entry_rowid").limit(most)
    if not set(tokens) <= set(known):
        return post.select("entry_rowid", F.lit(0.0).alias("score")).limit(0)
    if blocks is None:
        return best(_scored(post, known, tokens, in_a_row))
    gain = reduce(lambda c, t: c.when(F.col("token") == t, bm25_idf(F.lit(known[t].df), F.lit(known[t].n)) * F.col("top")), sorted(set(tokens)), F)
    sums = blocks.where(F.col("token").isin(*set(tokens))).groupBy("block").agg(F.sum(gain).alias("most"), F.count("*").alias("found")).where(F.col("found") == len(set(tokens)))
    first = [r.block for r in sums.orderBy(F.desc("most"), "block").limit(FIRST_BLOCKS).collect()]
    if not first:
        return post.select("entry_rowid", F.lit(0.0).alias("score")).limit(0)
    spark = post.sparkSession
    rows = [tuple(r) for r in best(_scored(_within(post, first), known, tokens, in_a_row)).collect()]
    made = spark.createDataFrame(rows, "entry_rowid LONG, score DOUBLE")
    least = rows[-1][1] * (1 - 1e-9) if len(rows) == most else 0.0
    rest = sums.where((F.col("most") >= least) & ~F.col("block").isin(*first)).select("block")
    some = [r.block for r in rest.limit(RANGES + 1).collect()]
    if not some:
        return best(made)
    more = _within(post, some) if len(some) <= RANGES else post.withColumn("block", F.floor(F.col("entry_rowid") / BLOCK_ROWS)).join(rest, "block", "left_semi").drop("block")
    return best(made.unionByName(_scored(more, known, tokens, in_a_row)))


def _within(post: DataFrame, blocks: list[int]) -> DataFrame:
    """The postings of some blocks: ranges of entries that a scan can prune by."""
    row = F.col("entry_rowid")
    return post.where(reduce(Column.__or__, ((row >= b * BLOCK_ROWS) & (row < (b + 1) * BLOCK_ROWS) for b in sorted(blocks))))


def bm25_top(spark: SparkSession, pack: str, tokens: list[str], most: int) -> DataFrame:
    """The best of ``bm25``, by the blocks of a pack that has them."""
    of = {t: spark.read.parquet(f"{pack}/{t}") for t in INDEX}
    wanted = F.col("token").isin(*set(tokens))
    facts = of["frequencies"].where(wanted).withColumn("_one", F.lit(1)).join(F.broadcast(of["totals"].withColumn("_one", F.lit(1))), "_one")  # one row
    post = of["postings"] if "len" in of["postings"].columns else of["postings"].join(of["lengths"], "entry_rowid")
    blocks = spark.read.parquet(f"{pack}/blocks") if files.is_dir(f"{pack}/blocks") else None
    return best_scores(post.where(wanted), facts, blocks, tokens, most)


def phrase(post: DataFrame, tokens: list[str]) -> DataFrame:
    """Entries in one column of which the tokens stand in a row."""
    def starts(i: int) -> Column:
        return F.transform("positions", lambda p: p - i)

    hits = None
    for i, token in enumerate(tokens):
        one = post.where(F.col("token") == token).select("entry_rowid", "col", starts(i).alias("at"))
        hits = one if hits is None else hits.join(one.withColumnRenamed("at", "next"), ["entry_rowid", "col"]).select("entry_rowid", "col", F.array_intersect("at", "next").alias("at")).where(F.size("at") > 0)
    return hits.select("entry_rowid").distinct()
