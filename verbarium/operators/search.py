"""Ranked lookup over prioritized packs: single and batched."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize
from ..functions.schemas import ID, PACK, SCHEMA_VERSION, TERM
from ..functions.text import fts_tokens
from ..plans import lookup as plan
from ..sources import files
from ..sources.scratch import Scratch
from . import importing, packs

#: Beginnings of terms of these lengths are join keys of a batch; a longer prefix has the longest one that it holds.
LENGTHS = (*range(1, 13), 16, 24, 32, 48, 64, 96, 128)
#: Marks at the ends of a term in its grams.
BEGIN, END = "\x02", "\x03"
RESULT = ("entry_id", "lemma", "language", "pos", "matched_term", "match_type")
#: Tiers of terms that are hit as a whole; the list of a prefix holds them once more.
WHOLE = (plan.EXACT, plan.LOOSE_EXACT)


@dataclass
class Pack:
    pack_id: str
    path: str
    languages: list[str]
    entry_count: int
    default_source: str
    indexed: bool = True
    priority: int = 0
    enabled: bool = True
    #: Of each sorted table its files with their least and largest keys; None in packs of an old layout.
    listed: dict[str, list[tuple[str, str, str]]] | None = None
    stamp: tuple = ()


@dataclass
class Probe:
    """What a lookup asks of the terms: rows of which a column starts with a prefix and that a condition holds for, in the order of the column."""

    column: str
    prefix: str
    where: Column
    base: Column
    plain: bool = False  # of packs without a text index alone


@dataclass
class Settings:
    """Preferences of packs: priority and enabled, kept as a JSON file written in one step."""

    packs: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Settings:
        try:
            with open(path, encoding="utf-8") as f:
                return cls({k: {"priority": int(v["priority"]), "enabled": bool(v["enabled"])} for k, v in json.load(f)["packs"].items()})
        except (OSError, ValueError, KeyError, TypeError, AttributeError):
            return cls()

    def save(self, path: str) -> None:
        if not path:
            return
        with open(f"{path}.tmp", "w", encoding="utf-8") as f:
            json.dump({"packs": dict(sorted(self.packs.items()))}, f, indent=2)
        os.replace(f"{path}.tmp", path)

    def set_enabled(self, pack_id: str, enabled: bool) -> None:
        self.packs.setdefault(pack_id, {"priority": (1 << 63) - 1, "enabled": True})["enabled"] = enabled

    def set_order(self, ids: list[str]) -> None:
        for i, p in enumerate(ids):
            self.packs.setdefault(p, {"priority": i, "enabled": True})["priority"] = i


class SearchEngine:
    """Ranked lookup over packs. With ``scan_payloads`` single lookups also read whole entries, as JSON, of packs that have no text index."""

    def __init__(self, spark: SparkSession, scan_payloads: bool = False):
        self.spark, self.packs, self.load_errors, self.scan_payloads = spark, [], [], scan_payloads
        self._opened: dict[tuple[str, str], DataFrame] = {}  # tables of packs, listed once

    def add_pack(self, path: str, enabled: bool = True) -> None:
        path = files.canonical(path)
        if any(p.path == path for p in self.packs):
            return
        pack = self._open(path)
        pack.priority, pack.enabled = len(self.packs), enabled
        self.packs.append(pack)
        self._sort()

    def _open(self, path: str) -> Pack:
        files.settle(path)
        meta = self.spark.read.schema(PACK).parquet(f"{path}/pack").first()
        if meta.schema_version > SCHEMA_VERSION:
            raise ValueError(f"{meta.pack_id}: format {meta.schema_version} is newer than this engine reads ({SCHEMA_VERSION})")
        manifest = json.loads(meta.manifest)
        default = manifest.get("default_source_id") or next((s["id"] for s in manifest.get("sources", [])), "")
        listed: dict[str, list[tuple[str, str, str]]] | None = None
        if meta.files is not None:
            listed = {}
            for t, *f in meta.files:
                listed.setdefault(t, []).append(tuple(f))
            if any({name for name, *_ in fs} - {name for name, *_ in files.stamp(f"{path}/{t}")} for t, fs in listed.items()):
                listed = None  # a table was put there by other means: it is read as a whole
        return Pack(meta.pack_id, path, list(meta.languages), meta.entry_count, default, files.is_dir(f"{path}/postings"), listed=listed, stamp=files.stamp(f"{path}/pack"))

    def refresh(self) -> None:
        """Open packs again that have been written anew since; lookups do so before they read."""
        for i, p in enumerate(self.packs):
            if files.stamp(f"{p.path}/pack") not in (p.stamp, ()):
                self.packs[i] = new = self._open(p.path)
                new.priority, new.enabled = p.priority, p.enabled
                self._opened = {k: v for k, v in self._opened.items() if k[0] not in (p.path, "terms")}

    def load_directory(self, folder: str) -> int:
        if not files.is_dir(folder):
            self.load_errors.append((folder, "pack directory not found"))
            return 0
        before = len(self.packs)
        names = dict.fromkeys(n.removesuffix(files.OLD) for n in files.folders(folder) if not n.endswith(files.NEW))
        for path in (f"{folder}/{name}" for name in names):
            files.settle(path)
            if not files.is_dir(f"{path}/pack"):
                continue
            try:
                self.add_pack(path)
            except Exception as e:  # noqa: BLE001  a bad pack is reported, and the others load
                self.load_errors.append((path, str(e)))
        return len(self.packs) - before

    def load_directories(self, folders: list[str]) -> dict:
        """Packs of every folder that exists, most specific first; what was searched, how many loaded, and what failed."""
        there = [f for f in folders if files.is_dir(f)]
        loaded = sum(self.load_directory(f) for f in there)
        return {"searched": list(folders), "loaded": loaded, "errors": [e for e in self.load_errors if e[1] != "pack directory not found"]}

    def _sort(self) -> None:
        self.packs.sort(key=lambda p: (p.priority, p.pack_id))

    def apply_preferences(self, settings: Settings) -> None:
        n = len(self.packs)
        for i, p in enumerate(self.packs):
            found = settings.packs.get(p.pack_id, {"priority": n + i, "enabled": p.enabled})
            p.priority, p.enabled = found["priority"], found["enabled"]
        self._sort()

    def set_pack_order(self, ids: list[str]) -> None:
        for i, p in enumerate(self.packs):
            p.priority = ids.index(p.pack_id) if p.pack_id in ids else len(ids) + i
        self._sort()

    def set_pack_enabled(self, pack_id: str, enabled: bool) -> bool:
        hit = [p for p in self.packs if p.pack_id == pack_id]
        for p in hit:
            p.enabled = enabled
        return bool(hit)

    def save_preferences(self, path: str) -> None:
        """Write the order and toggles of all packs; nothing without a path."""
        Settings({p.pack_id: {"priority": i, "enabled": p.enabled} for i, p in enumerate(self.packs)}).save(path)

    def entry_total(self) -> int:
        return sum(p.entry_count for p in self.packs)

    def list_packs(self) -> list[tuple[str, int, bool]]:
        return [(p.pack_id, p.priority, p.enabled) for p in self.packs]

    def _live(self) -> list[tuple[int, Pack]]:
        return [(i, p) for i, p in enumerate(self.packs) if p.enabled]

    def _table(self, name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._one_table(p, name).withColumn("pack_idx", F.lit(i)) for i, p in self._live()])

    def _read(self, pack: Pack, name: str) -> DataFrame:
        key = (pack.path, name)
        if key not in self._opened:
            self._opened[key] = self.spark.read.parquet(f"{pack.path}/{name}")
        return self._opened[key]

    def _holding(self, pack: Pack, name: str, schema: str, holds: Callable[[str, str], bool]) -> DataFrame | None:
        """The files of a pack's table that may hold some keys, by the least and largest key of each; None if no file does."""
        names = tuple(f for f, low, high in pack.listed.get(name, []) if holds(low, high))
        if not names:
            return None
        if (key := (pack.path, name, names)) not in self._opened:
            self._opened[key] = self.spark.read.schema(schema).parquet(*(f"{pack.path}/{name}/{f}" for f in names))
        return self._opened[key]

    def _listed_rows(self, pack: Pack, name: str, rowids: list[int], *columns: str) -> DataFrame:
        """Columns of some rows of a table in the order of entries."""
        table = self._read(pack, name)
        if pack.listed is not None:
            low, high = min(rowids), max(rowids)
            table = self._holding(pack, name, table.schema, lambda a, b: int(a) <= high and int(b) >= low) or table.limit(0)
        return table.where(F.col("entry_rowid").isin(*rowids)).select(*(columns or ["*"]))

    def _one_table(self, pack: Pack, name: str) -> DataFrame:
        found = self._read(pack, name)
        if name == "terms":
            if "entry_rowid" not in found.columns:  # an old layout names entries by id
                entries = self._read(pack, "entries").select("entry_rowid", F.col("id").alias("entry_id"))
                found = found.join(entries, "entry_id")
            found = found.select("entry_rowid", "term", "term_type", "loose_key", "term_rev")
        return found

    def terms(self) -> DataFrame:
        """The terms of the enabled packs, with pack_idx."""
        self.refresh()
        return self._table("terms")

    def entries(self) -> DataFrame:
        """The entries of the enabled packs, with pack_idx."""
        self.refresh()
        return self._table("entries")

    def _told(self, *columns: Column) -> tuple:
        """Expressions of literals: the optimizer folds them, and no job runs."""
        return tuple(self.spark.sql("VALUES (1)").select(*columns).first())

    def loose_patterns(self, q: str) -> list[str]:
        langs = list(dict.fromkeys(x for p in self.packs if p.enabled for x in p.languages)) or ["generic"]
        langs = ["es"] if q.isascii() else langs  # without marks all languages fold alike
        row = self._told(*(normalize.loose_key(F.lit(q), x).alias(f"l{i}") for i, x in enumerate(langs)))
        return list(dict.fromkeys(x for x in row if x))

    def _probes(self, p: plan.Query) -> list[Probe]:
        """Exact hits begin the list of a prefix, so that one probe finds both."""
        def starting(column: str, key: str, exact: int, longer: int) -> Probe:
            c = F.col(column)
            return Probe(column, key, c.startswith(key), F.when(c == key, exact).otherwise(longer))

        if p.has_wildcard:
            tail = plan.literal_suffix(p.q)
            found = [Probe("term_rev" if tail else "term", tail[::-1] if tail else plan.literal_prefix(p.q), plan.glob(p.q), F.lit(plan.WILDCARD))]
        else:
            found = [starting("term", p.q, plan.EXACT, plan.PREFIX)]
        found += [starting("loose_key", key, plan.LOOSE_EXACT, plan.LOOSE_PREFIX) for key in self.loose_patterns(p.q)]
        if p.has_space:
            found.append(Probe("term", "", F.col("term").contains(p.q), F.lit(plan.TERM_CONTAINS), plain=True))
        return found

    def _projection(self, column: str, packs_: list[tuple[int, Pack]], probes: list[Probe]) -> list[DataFrame]:
        """The terms in the order of a column, with pack_idx, of the files that may hold what the probes ask for: packs that list their files are one scan."""
        name, paths, of, out = packs.PROJECTIONS[column], [], [], []
        for i, pack in packs_:
            if pack.listed is None or not re.fullmatch(r"[\w.:/-]+", pack.path):  # files are told by their paths, which must read alike everywhere
                rows = self._one_table(pack, "terms").join(self._read(pack, "entries").select("entry_rowid", *packs.COVER), "entry_rowid")
                out.append(rows.select("*", F.lit(i).alias("pack_idx")))
                continue
            mine = [f"{pack.path}/{name}/{f}" for f, low, high in pack.listed.get(name, []) if any(high >= x.prefix and low[: len(x.prefix)] <= x.prefix for x in probes)]
            if mine:
                paths += mine
                of.append((i, re.sub("^file:/+", "/", pack.path)))
        if paths:
            if (key := ("terms", name, tuple(of), tuple(paths))) not in self._opened:
                path = F.regexp_replace("_metadata.file_path", "^file:/+", "/")
                idx = reduce(lambda c, x: c.when(F.startswith(path, F.lit(f"{x[1]}/")), x[0]), of, F)
                self._opened[key] = self.spark.read.schema(TERM).parquet(*paths).select("*", idx.alias("pack_idx"))
            out.append(self._opened[key])
        return out

    def probe_terms(self, query: str, over: int) -> DataFrame | None:
        """The first ``over`` terms that each probe of a query finds in each pack, with what ranking needs; None if nothing can be found."""
        probes, parts = list(enumerate(self._probes(plan.Query(query)))), []
        plain = [i for i, p in self._live() if not p.indexed]
        for column in packs.PROJECTIONS:
            mine = [(n, x) for n, x in probes if x.column == column and (plain or not x.plain)]
            live = self._live() if any(not x.plain for _, x in mine) else [(i, p) for i, p in self._live() if i in plain]
            for rows in self._projection(column, live, [x for _, x in mine]) if mine else []:
                where = [x.where & F.col("pack_idx").isin(plain) if x.plain else x.where for _, x in mine]
                hits = F.array_compact(F.array(*(F.when(w, F.struct(F.lit(n).alias("probe"), x.base.alias("base"))) for w, (n, x) in zip(where, mine))))
                some = rows.where(reduce(Column.__or__, where))
                parts.append(some.select("pack_idx", "entry_rowid", "term", "term_type", *packs.COVER, F.col(column).alias("key"), F.explode(hits).alias("x")))
        if not parts:
            return None
        first = Window.partitionBy("pack_idx", "x.probe").orderBy("key", "term_type", "entry_rowid")
        found = reduce(DataFrame.unionByName, parts).select("*", F.row_number().over(first).alias("_rn")).where(F.col("_rn") <= over)
        return found.select("pack_idx", "entry_rowid", "term", "term_type", *packs.COVER, F.col("x.base").alias("base"))

    def suggest(self, query: str, limit: int = 10) -> DataFrame:
        """At most ``limit`` entries, best first: each probe over-fetches, then all hits are ranked and told apart by id.

        The hits are at most 4 * limit (20 at least) for each pack and probe; they come to the driver and are ranked there by one small plan.
        """
        p = plan.Query(query)
        self.refresh()
        empty = self.spark.createDataFrame([], ", ".join(f"{c} STRING" for c in RESULT))
        if not p.q or not self._live():
            return empty
        over = max(4 * limit, 20)
        found = self.probe_terms(query, over)
        rows = [r.asDict() for r in found.collect()] if found is not None else []
        if p.has_space and (tokens := self._told(fts_tokens(F.lit(query.strip())))[0]):
            rows += self._content(rows, tokens, p.q, over, limit)
        if not rows:
            return empty
        kind = pa.schema([("pack_idx", pa.int32()), ("term", pa.string()), ("term_type", pa.string()), *((c, pa.string()) for c in packs.COVER), ("base", pa.int32())])
        return _ranked(self.spark.createDataFrame(pa.Table.from_pylist(rows, kind)).coalesce(1), query.strip(), p.q, limit)

    def _content(self, found: list[dict], tokens: list[str], q: str, over: int, limit: int) -> list[dict]:
        """Phrase hits of packs in order, as long as the hits before them are under the limit; a term that is hit as a whole counts as its beginning too."""
        count, out = sum(2 if r["base"] in WHOLE else 1 for r in found), []
        for i, p in self._live():
            if not (p.indexed or self.scan_payloads) or count >= limit:
                continue
            if p.indexed:
                order = [r.entry_rowid for r in self._phrases(p, tokens, over).collect()]
                rows = self._listed_rows(p, "entries", order, *packs.COVER).collect() if order else []
            else:
                entries = self._read(p, "entries")
                rows = entries.where(packs.payload(entries).contains(q)).orderBy("entry_rowid").limit(over).select(*packs.COVER).collect()
            out += [{"pack_idx": i, "term": r.lemma, "term_type": "content", "base": plan.CONTENT, **r.asDict()} for r in rows]
            count += len(rows)
        return out

    def _phrases(self, pack: Pack, tokens: list[str], most: int) -> DataFrame:
        within = lambda low, high: any(low <= t <= high for t in tokens)
        wanted, read = F.col("token").isin(*set(tokens)), lambda name: self._read(pack, name)
        post = read("postings")
        if pack.listed is not None:
            post = self._holding(pack, "postings", post.schema, within) or post.limit(0)
        if "len" not in post.columns:
            post = post.join(read("lengths"), "entry_rowid")
        facts = read("frequencies").where(wanted).withColumn("_one", F.lit(1)).join(F.broadcast(read("totals").withColumn("_one", F.lit(1))), "_one")  # one row
        many = pack.entry_count > packs.FIRST_BLOCKS * packs.BLOCK_ROWS and pack.listed is not None and "blocks" in pack.listed
        return packs.best_scores(post.where(wanted), facts, read("blocks") if many else None, tokens, most, in_a_row=True)

    def get_entry(self, entry_id: str) -> dict | None:
        """The record of the first enabled pack that has the id, its default source filled in."""
        self.refresh()
        rowids: dict[int, int] = {}
        ids = [(i, self._holding(p, "ids", ID, lambda low, high: low <= entry_id <= high)) for i, p in self._live() if p.listed is not None]
        if some := [df.where(F.col("id") == entry_id).select(F.lit(i).alias("pack_idx"), "entry_rowid") for i, df in ids if df is not None]:
            rowids = {r.pack_idx: r.entry_rowid for r in reduce(DataFrame.unionByName, some).collect()}  # a row a pack
        for i, p in self._live():
            row = None
            if i in rowids:
                row = importing.fill_default_source(self._listed_rows(p, "entries", [rowids[i]]), p.default_source).first()
            elif p.listed is None:
                row = importing.fill_default_source(self._read(p, "entries").where(F.col("id") == entry_id), p.default_source).first()
            if row:
                return row.asDict(recursive=True)
        return None

    def suggest_batch(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """``suggest`` for many queries (query_id, raw) at once: (query_id, rank, result columns). Texts that repeat are looked up once.

        Every probe is an equi-join. Prefixes join the beginnings of terms, of which each pack's first ones are cut before any query is
        joined; patterns join terms by the rarest gram of their literal parts and are verified; those without a
        literal part are a list for each length. Phrases join the postings of their tokens.
        """
        self.refresh()
        asked = queries.select("query_id", normalize.trim(F.col("raw")).alias("_raw"))
        texts = asked.select(F.col("_raw").alias("query_id"), F.col("_raw").alias("raw")).distinct()
        found = self._suggest_texts(texts, limit)
        return asked.join(found.withColumnRenamed("query_id", "_raw"), "_raw").select("query_id", *found.columns[1:])

    def _suggest_texts(self, queries: DataFrame, limit: int) -> DataFrame:
        over = max(4 * limit, 20)
        if not self._live():
            return self.spark.createDataFrame([], "rank INT, " + ", ".join(f"{c} STRING" for c in RESULT)).select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "*")
        work = Scratch(self.spark, "batch")
        asked = work.save(queries.where("raw <> ''").select("query_id", "raw", F.lower("raw").alias("q")).withColumn("wild", F.col("q").rlike("[?*]")), "asked")
        terms = self._table("terms")
        plain, wild = asked.where("NOT wild").drop("wild"), asked.where("wild").drop("wild")
        langs = list(dict.fromkeys(x for _, p in self._live() for x in p.languages)) or ["generic"]
        keys = F.array_distinct(F.array(*(normalize.loose_key(F.col("q"), x) for x in langs)))
        loose = work.save(asked.drop("wild").withColumn("want", F.explode(keys)).where("want <> ''"), "loose")
        hits = [_starting(terms, plain.withColumn("want", F.col("q")), "term", plan.EXACT, plan.PREFIX, over), _starting(terms, loose, "loose_key", plan.LOOSE_EXACT, plan.LOOSE_PREFIX, over)]
        like = F.replace(F.replace(F.regexp_replace("q", r"([%_\\])", r"\\$1"), F.lit("*"), F.lit("%")), F.lit("?"), F.lit("_"))
        runs = F.filter(F.split(F.concat(F.lit(BEGIN), F.col("q"), F.lit(END)), r"[?*]+"), lambda r: ~r.isin("", BEGIN, END))
        shaped = work.save(wild.withColumns({"_like": like, "_runs": runs, "_rev": F.col("q").rlike(r"^[?*].*[^?*]{2}$")}), "shaped")
        hits.append(_by_grams(terms, shaped.where(F.size("_runs") > 0), F.like(F.col("term"), F.col("_like")), plan.WILDCARD, over))
        hits.append(_by_length(terms, shaped.where(F.size("_runs") == 0), over))
        if unindexed := [i for i, p in self._live() if not p.indexed]:
            inside = asked.where("q LIKE '% %'").withColumns({"_runs": F.array("q"), "_rev": F.lit(False)})
            hits.append(_by_grams(terms.where(F.col("pack_idx").isin(unindexed)), inside, F.contains("term", "q"), plan.TERM_CONTAINS, over))
        found = work.save(reduce(DataFrame.unionByName, hits), "found")  # at most ``over`` rows a query, probe and pack
        found = found.unionByName(self._batch_content(asked, found, over, limit))
        rows = found.join(self._table("entries").select("pack_idx", "entry_rowid", "id", "lemma", "language", "pos"), ["pack_idx", "entry_rowid"])
        order = rank_keys(F.col("raw"), F.col("q"))
        rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("query_id", "id").orderBy(*order))).where("_rn = 1")
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit)
        return rows.select("query_id", "rank", F.col("id").alias("entry_id"), "lemma", "language", "pos", F.col("term").alias("matched_term"), F.col("term_type").alias("match_type"))

    def _batch_content(self, asked: DataFrame, found: DataFrame, over: int, limit: int) -> DataFrame:
        """Phrase hits of all queries with a blank, of the packs that ``suggest`` would visit."""
        tokens = asked.where("q LIKE '% %'").select("query_id", "raw", "q", fts_tokens(F.col("raw")).alias("ts")).where(F.size("ts") > 0)
        words = tokens.select("query_id", F.size("ts").alias("len"), F.posexplode("ts").alias("i", "token"))
        live = [(i, p) for i, p in enumerate(self.packs) if p.enabled and p.indexed]
        shape = found.select("query_id", "raw", "q", "pack_idx", "entry_rowid", "term", "term_type", "base")
        if not live:
            return shape.limit(0)
        post = reduce(DataFrame.unionByName, [self._read(p, "postings").select("token", "entry_rowid", "col", "positions", F.lit(i).alias("pack_idx")) for i, p in live])
        at = post.join(words, "token").select("query_id", "pack_idx", "entry_rowid", "col", "len", "i", F.transform("positions", lambda p: p - F.col("i")).alias("at"))
        one = at.groupBy("query_id", "pack_idx", "entry_rowid", "col", "len").agg(F.collect_list("at").alias("ats"))  # of one entry's column: a list for each token
        common = F.aggregate("ats", F.get("ats", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        phrase = one.where((F.size("ats") == F.col("len")) & (F.size(common) > 0)).select("query_id", "pack_idx", "entry_rowid").distinct()
        index = {t: reduce(DataFrame.unionByName, [self._read(p, t).withColumn("pack_idx", F.lit(i)) for i, p in live]) for t in packs.INDEX[1:]}
        used = packs.weighted_tf(post.join(words.select("token").distinct(), "token"), "pack_idx")
        df, lengths = index["frequencies"], index["lengths"]
        scored = phrase.join(words.select("query_id", "token").distinct(), "query_id").join(used, ["pack_idx", "token", "entry_rowid"]).join(df, ["pack_idx", "token"]).join(lengths, ["pack_idx", "entry_rowid"]).join(F.broadcast(index["totals"]), "pack_idx")  # a row for each pack
        scored = scored.groupBy("query_id", "pack_idx", "entry_rowid").agg(F.sum(packs.bm25_gain(F.col("tf"), F.col("df"), F.col("len"), F.col("n"), F.col("mean"))).alias("score"))
        best = Window.partitionBy("query_id", "pack_idx").orderBy(F.desc("score"), "entry_rowid")
        scored = scored.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= over).select("query_id", "pack_idx", "entry_rowid")
        # A pack is visited while the hits before it, repeated ones too, are fewer than the limit.
        times = F.when(F.col("base").isin(*WHOLE), 2).otherwise(1)
        counts = scored.groupBy("query_id", "pack_idx").agg(F.count("*").alias("c")).join(found.groupBy("query_id").agg(F.sum(times).alias("h")), "query_id", "left")
        before = F.coalesce(F.sum("c").over(Window.partitionBy("query_id").orderBy("pack_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        visited = counts.withColumn("_b", before + F.coalesce("h", F.lit(0))).where(F.col("_b") < limit)
        kept = scored.join(visited.select("query_id", "pack_idx"), ["query_id", "pack_idx"], "left_semi").join(tokens.select("query_id", "raw", "q"), "query_id")
        lemmas = self._table("entries").select("pack_idx", "entry_rowid", F.col("lemma").alias("term"))
        return kept.join(lemmas, ["pack_idx", "entry_rowid"]).select("query_id", "raw", "q", "pack_idx", "entry_rowid", "term", F.lit("content").alias("term_type"), F.lit(plan.CONTENT).alias("base"))


HIT = ("query_id", "raw", "q", "pack_idx", "entry_rowid", "term", "term_type")


def _first(hits: DataFrame, over: int, key: str | Column, *within: str) -> DataFrame:
    order = Window.partitionBy(*within, "pack_idx").orderBy(key, "term_type", "entry_rowid")
    return hits.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= over).drop("_rn")


def _starting(terms: DataFrame, some: DataFrame, column: str, exact: int, longer: int, over: int) -> DataFrame:
    """The first terms whose column starts with what a query wants, exact ones told apart.

    A beginning that some query wants as a whole leaves a bounded list in each pack before queries join; only longer
    wants, which are told by more than their beginning, meet all terms under it.
    """
    steps = F.array(*map(F.lit, LENGTHS))
    step = lambda n: F.array_max(F.filter(steps, lambda k: k <= n))
    some = some.withColumn("_k", step(F.char_length("want"))).withColumn("_head", F.substr("want", F.lit(1), F.col("_k")))
    whole = F.char_length("want") == F.col("_k")
    starts = terms.withColumn("_k", F.explode(F.filter(steps, lambda k: k <= F.char_length(column)))).withColumn("_head", F.substr(F.col(column), F.lit(1), F.col("_k")))
    lists = _first(starts.join(some.where(whole).select("_k", "_head").distinct(), ["_k", "_head"]), over, column, "_k", "_head")
    short = lists.join(some.where(whole), ["_k", "_head"])
    long = starts.join(some.where(~whole), ["_k", "_head"]).where(F.col(column).startswith(F.col("want")))
    hits = short.unionByName(_first(long, over, column, "query_id", "want"))
    return hits.select(*HIT, F.when(F.col(column) == F.col("want"), exact).otherwise(longer).alias("base"))


def _grams(marked: Column) -> Column:
    """The distinct strings of one to three characters in a term with its marks."""
    each = F.transform(F.sequence(F.lit(1), F.char_length(marked)), lambda i: F.array(*(F.substr(marked, i, F.lit(n)) for n in (1, 2, 3))))
    return F.array_distinct(F.flatten(each))


def _by_grams(terms: DataFrame, some: DataFrame, test: Column, base: int, over: int) -> DataFrame:
    """The first terms that pass a test with a query of some (query_id, raw, q, _runs, _rev), which asks that they hold its runs."""
    cut = lambda r: F.when(F.char_length(r) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(r) - 2, F.lit(1))), lambda i: F.substr(r, i, F.lit(3)))).otherwise(F.array(r))
    wanted = some.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform("_runs", cut)))).alias("gram"))
    marked = F.concat(F.lit(BEGIN), F.col("term"), F.lit(END))
    held = terms.withColumn("gram", F.explode(_grams(marked))).join(wanted.select("gram").distinct(), "gram", "left_semi")
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).where("x.n > 0")
    chosen = some.join(rarest.select("query_id", F.col("x.gram").alias("gram")), "query_id")
    hits = held.join(chosen, "gram").where(test)
    key = F.when(F.col("_rev"), F.col("term_rev")).otherwise(F.col("term"))
    return _first(hits, over, key, "query_id").select(*HIT, F.lit(base).alias("base"))


def _by_length(terms: DataFrame, some: DataFrame, over: int) -> DataFrame:
    """The first terms of patterns of ? and * alone, which ask for a length: a list for each."""
    some = some.withColumn("_least", F.char_length(F.replace("q", F.lit("*")))).withColumn("_any", F.contains("q", F.lit("*")))
    n = F.char_length("term")
    fits = F.concat(F.array(F.struct(n.alias("_least"), F.lit(False).alias("_any"))), F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(k.alias("_least"), F.lit(True).alias("_any"))))
    met = terms.withColumn("_x", F.explode(fits)).select(*terms.columns, "_x.*").join(some.select("_least", "_any").distinct(), ["_least", "_any"])
    return _first(met, over, "term", "_least", "_any").join(some, ["_least", "_any"]).select(*HIT, F.lit(plan.WILDCARD).alias("base"))


def _ranked(rows: DataFrame, raw: str, q: str, limit: int) -> DataFrame:
    keys = rank_keys(F.lit(raw), F.lit(q))
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy(*keys))).where("_rn = 1")
    return rows.orderBy(*keys).limit(limit).select(F.col("id").alias("entry_id"), "lemma", "language", "pos", F.col("term").alias("matched_term"), F.col("term_type").alias("match_type"))


def rank_keys(raw: Column, q: Column) -> list[Column]:
    """Tier, case, part of speech, length, pack, lemma; then id and term, so that the order is total."""
    kind = F.when(F.col("term_type") == "lemma", 0).when(F.col("term_type") == "transcription", 1).when(F.col("term_type") == "form", 2).otherwise(3)
    tier = F.col("base") * 10 + kind
    case = F.when(F.col("lemma") == raw, 0).when(F.lower("lemma") == q, F.when(F.col("lemma").rlike(r"\p{IsUppercase}"), 2).otherwise(1)).otherwise(3)
    affix = F.when(F.col("pos").isin("name", "prefix", "suffix", "infix", "circumfix", "abbrev"), 1).otherwise(0)
    return [tier, case, affix, F.char_length("term"), F.col("pack_idx"), F.col("lemma"), F.col("id"), F.col("term")]


def opens(hits: DataFrame, raw: Column | str) -> DataFrame:
    """hits with ``opens``: whether the first one is a lemma that a query matches as a whole, so that it opens by itself."""
    raw = F.lit(raw) if isinstance(raw, str) else raw
    return hits.withColumn("opens", (F.col("rank") == 1) & (F.col("match_type") == "lemma") & (F.col("matched_term") == F.lower(raw)))


def preferred_hit(hits: DataFrame, language: str, order: str = "rank") -> DataFrame:
    """The first hit in a language (of at most a lookup's limit of rows, which one task orders) among the leading hits that tie with the first in match type and term; else the first."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    tied = (F.first("match_type").over(w) == F.col("match_type")) & (F.first("matched_term").over(w) == F.col("matched_term"))
    run = F.min(tied.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return hits.withColumn("_run", run).orderBy(F.when((F.col("_run") == 1) & (F.col("language") == language), 0).otherwise(1), order).limit(1).drop("_run")
