"""Queries of the lexical operators over the driver's tables, each with the same query in SQL.

Packs, dumps and sentence files are made of the tables by the library itself (``samples``), and queries ask the
engine; the SQL starts from the tables again.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import samples
from .functions import normalize, text
from .operators import importing, measure, packaging, packs, search
from .operators.packs import number_rows
from .operators.search import SearchEngine, Settings
from .plans import lookup
from .samples import LANGUAGES, LETTERS, lexicon, table
from .sources import files, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL of the sample packs

_TOKENS = r"list_filter(list_transform(list_filter(regexp_split_to_array({0}, '[^\p{{L}}\p{{N}}''-]+'), lambda w: length(w) > 1), lambda w: lower(trim(w, '''-'))), lambda w: w <> '')"
_WORDS = f"words AS (SELECT doc_id, lang, unnest({_TOKENS.format('text')}) AS term FROM documents)"
_LEX = f"WITH {_WORDS}, lex AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL)"
_DROP = r"regexp_replace({0}, '[!-/:-@\[-`{{-~\s]', '', 'g')"


def _fold(lang: str, x: str) -> str:
    """A loose key in SQL."""
    if lang == "de":
        return _DROP.format(f"translate(replace({x}, 'ß', 'ss'), 'äöü', 'aou')")
    if lang == "fr":
        return _DROP.format(f"translate(replace(replace({x}, 'œ', 'oe'), 'æ', 'ae'), 'éèêëàâîïôùûüç', 'eeeeaaiiouuuc')")
    if lang == "es":
        return _DROP.format(f"translate({x}, 'áéíóúü', 'aeiouu')")
    return _DROP.format(f"translate(replace(replace(replace(replace(strip_accents({x}), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss'), 'þ', 'th'), 'øðđłı', 'oddli')")


def _loose(x: str, by: str) -> str:
    return f"CASE {by} " + " ".join(f"WHEN '{k}' THEN {_fold(k, x)}" for k in ("de", "fr", "es")) + f" ELSE {_fold('en', x)} END"


def _lex_pack(order: tuple[str, ...] = LANGUAGES) -> str:
    """CTEs: entries and terms of the lexicon packs, those of an order alone, which numbers them from 0."""
    return _LEX + f""", lexent AS (
  SELECT lang, term AS base, term AS lemma, 'word' AS pos, n FROM lex
  UNION ALL SELECT lang, term, upper(term[1]) || substr(term, 2), 'name', n FROM lex WHERE regexp_matches(term, '^[a-z]') AND length(term) % 3 = 0),
entries AS (SELECT list_position({list(order)}, lang) - 1 AS pack_idx, lang AS language, base, lemma, pos, n, lang || ':' || pos || ':' || lemma AS id,
  row_number() OVER (PARTITION BY lang ORDER BY lemma) AS entry_rowid FROM lexent WHERE lang IN {order}),
said AS (SELECT DISTINCT * FROM (
  SELECT pack_idx, language, entry_rowid, lower(lemma) AS term, 'lemma' AS term_type FROM entries
  UNION ALL SELECT pack_idx, language, entry_rowid, base || 's', 'form' FROM entries WHERE length(base) % 5 = 0 AND base || 's' <> lemma
  UNION ALL SELECT pack_idx, language, entry_rowid, reverse(base), 'form' FROM entries WHERE length(base) % 7 = 0 AND reverse(base) <> lemma
  UNION ALL SELECT pack_idx, language, entry_rowid, reverse(base), 'transcription' FROM entries WHERE length(base) % 7 = 0
  UNION ALL SELECT pack_idx, language, entry_rowid, '/' || base || '/', 'transcription' FROM entries WHERE length(base) % 11 = 0)),
terms AS (SELECT pack_idx, entry_rowid, term, term_type, {_loose('term', 'language')} AS loose_key, reverse(term) AS term_rev FROM said)"""


_PARTS = f"""WITH entries AS (SELECT 0 AS pack_idx, 'en' AS language, p_name AS lemma, 'phrase' AS pos, 'part:' || p_partkey AS id, p_brand || ' ' || p_type AS definition,
  row_number() OVER (ORDER BY p_partkey) AS entry_rowid FROM part),
said AS (SELECT DISTINCT * FROM (SELECT pack_idx, entry_rowid, lower(lemma) AS term, 'lemma' AS term_type FROM entries
  UNION ALL SELECT pack_idx, entry_rowid, lower(w), 'form' FROM (SELECT *, unnest(string_split(lemma, ' ')) AS w FROM entries) WHERE w <> lemma)),
terms AS (SELECT *, {_fold('en', 'term')} AS loose_key, reverse(term) AS term_rev FROM said)"""


def _suggest(packs_sql: str, asked: str, langs: tuple[str, ...], limit: int, end: str = "SELECT * FROM answers") -> str:
    """Ranked lookup in SQL: asked gives (query_id, raw)."""
    over = max(4 * limit, 20)
    keys = "tier, case_rank, affix, size, pack_idx, lemma, id, term"
    return packs_sql + rf""", asked AS ({asked}),
q AS (SELECT query_id, trim(raw) AS raw, lower(trim(raw)) AS q FROM asked WHERE trim(raw) <> ''),
shaped AS (SELECT *, regexp_matches(q, '[?*]') AS wild, regexp_matches(q, '^[?*]') AND length(regexp_extract(q, '([^?*]*)$', 1)) >= 2 AS tailed FROM q),
folded AS (SELECT DISTINCT * FROM (SELECT query_id, raw, q, unnest([{", ".join(_fold(x, 'q') for x in langs)}]) AS lp FROM q) WHERE lp <> ''),
hits AS (
  SELECT query_id, raw, q, '' AS lp, 0 AS base, term AS key, t.* FROM shaped JOIN terms t ON t.term = q WHERE NOT wild
  UNION ALL SELECT query_id, raw, q, '', 2, term, t.* FROM shaped JOIN terms t ON starts_with(t.term, q) WHERE NOT wild
  UNION ALL SELECT query_id, raw, q, '', 1, CASE WHEN tailed THEN term_rev ELSE term END, t.* FROM (SELECT * FROM shaped WHERE wild) JOIN terms t ON t.term GLOB q
  UNION ALL SELECT query_id, raw, q, lp, 3, loose_key, t.* FROM folded JOIN terms t ON t.loose_key = lp
  UNION ALL SELECT query_id, raw, q, lp, 4, loose_key, t.* FROM folded JOIN terms t ON starts_with(t.loose_key, lp)),
cut AS (SELECT *, row_number() OVER (PARTITION BY query_id, base, lp, pack_idx ORDER BY key, term_type, entry_rowid) AS rn FROM hits),
ranked AS (SELECT query_id, cut.pack_idx, id, e.lemma, e.language, e.pos, term, term_type, base_tier * 10 + kind AS tier, length(term) AS size,
    CASE WHEN e.lemma = raw THEN 0 WHEN lower(e.lemma) = q THEN CASE WHEN regexp_matches(e.lemma, '\p{{Lu}}') THEN 2 ELSE 1 END ELSE 3 END AS case_rank,
    CASE WHEN e.pos IN ('name', 'prefix', 'suffix', 'infix', 'circumfix', 'abbrev') THEN 1 ELSE 0 END AS affix
  FROM (SELECT *, base AS base_tier, CASE term_type WHEN 'lemma' THEN 0 WHEN 'transcription' THEN 1 WHEN 'form' THEN 2 ELSE 3 END AS kind FROM cut WHERE rn <= {over}) cut
  JOIN entries e ON cut.pack_idx = e.pack_idx AND cut.entry_rowid = e.entry_rowid),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY {keys}) AS b FROM ranked),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {keys}) AS rank FROM best WHERE b = 1),
answers AS (SELECT query_id, rank, id AS entry_id, lemma, language, pos, term AS matched_term, term_type AS match_type FROM top WHERE rank <= {limit})
{end}"""


def _ordered(hits: DataFrame) -> DataFrame:
    """suggest's rows with their places, from 1; at most a few."""
    rows = hits.collect()
    return hits.sparkSession.createDataFrame([(1, i, *r) for i, r in enumerate(rows, 1)], "query_id INT, rank LONG, " + ", ".join(f"{c} STRING" for c in search.RESULT))


# --- lookup


@query(_lex_pack() + " SELECT language, lemma, term_type FROM terms JOIN entries USING (pack_idx, entry_rowid) WHERE term = 'the'")
def exact_lookup(spark, sf):
    engine = samples.of(spark, sf).every_lexicon()
    hits = engine.terms().where(F.col("term") == lookup.Query(" The ").q)
    return hits.join(engine.entries(), ["pack_idx", "entry_rowid"]).select("language", "lemma", "term_type")


@query(_lex_pack() + " SELECT term, term_type, pack_idx, entry_rowid FROM terms WHERE starts_with(term, 'th') ORDER BY term, term_type, pack_idx, entry_rowid LIMIT 40")
def prefix_topk(spark, sf):
    terms = samples.of(spark, sf).every_lexicon().terms().where(lookup.glob("th*"))
    return terms.select("term", "term_type", F.col("pack_idx").cast("long").alias("pack_idx"), F.col("entry_rowid").cast("long").alias("entry_rowid")).orderBy("term", "term_type", "pack_idx", "entry_rowid").limit(40)


@query(_lex_pack() + " SELECT term, term_type, entry_rowid FROM terms WHERE term >= 'th' AND term < 'ti'")
def prefix_range_equiv(spark, sf):
    terms = samples.of(spark, sf).every_lexicon().terms()
    return terms.where((F.col("term") >= "th") & (F.col("term") < lookup.prefix_upper_bound("th"))).select("term", "term_type", F.col("entry_rowid").cast("long").alias("entry_rowid"))


def _glob(pattern):
    def run(spark, sf):
        terms = samples.of(spark, sf).every_lexicon().terms().where(lookup.glob(pattern))
        return terms.select("term", "term_type", F.col("entry_rowid").cast("long").alias("entry_rowid"))

    return run


for _name, _pattern in (("wildcard_inner", "t*e"), ("wildcard_single", "t?e"), ("wildcard_suffix_reversed", "*tion")):
    QUERIES[_name] = _glob(_pattern)
    SQL[_name] = _lex_pack() + f" SELECT term, term_type, entry_rowid FROM terms WHERE term GLOB '{_pattern}'"


@query(_LEX + f" SELECT lang, term, {_loose('term', 'lang')} AS loose FROM lex")
def loose_keys(spark, sf):
    return lexicon(spark, sf).select("lang", "term", normalize.loose_key(F.col("term"), F.col("lang")).alias("loose"))


@query(_lex_pack() + " SELECT term, term_type, loose_key, entry_rowid FROM terms WHERE loose_key = 'uber' OR starts_with(loose_key, 'recei')")
def loose_lookup(spark, sf):
    terms = samples.of(spark, sf).every_lexicon().terms()
    return terms.where((F.col("loose_key") == "uber") | F.col("loose_key").startswith("recei")).select("term", "term_type", "loose_key", F.col("entry_rowid").cast("long").alias("entry_rowid"))


@query(_PARTS + " SELECT id, term, term_type, loose_key, term_rev FROM terms JOIN entries USING (entry_rowid)")
def search_terms_build(spark, sf):
    entries = samples.of(spark, sf).read("parts", "entries")
    return packs.search_terms(entries).select("id", "term", "term_type", "loose_key", "term_rev")


_TWO = _lex_pack(("en",)) + ", part_entries AS (" + _PARTS.replace("WITH entries", "WITH pe").replace("FROM entries", "FROM pe") + " SELECT 1 AS pack_idx, language, lemma, pos, id, entry_rowid FROM pe), part_terms AS (" + _PARTS.replace("WITH entries", "WITH pe").replace("FROM entries", "FROM pe") + " SELECT 1 AS pack_idx, entry_rowid, term, term_type, loose_key, term_rev FROM terms)"
_TWO = _TWO.replace("\nentries AS (", "\nlex_entries AS (").replace("FROM entries", "FROM lex_entries").replace("\nterms AS (SELECT pack_idx", "\nlex_terms AS (SELECT pack_idx") + ", entries AS (SELECT pack_idx, language, lemma, pos, id, entry_rowid FROM lex_entries UNION ALL SELECT * FROM part_entries), terms AS (SELECT * FROM lex_terms UNION ALL SELECT * FROM part_terms)"


@query(_suggest(_TWO, "SELECT 1 AS query_id, 'Re' AS raw", ("en",), 10))
def tier_rank_suggest(spark, sf):
    return _ordered(samples.of(spark, sf).engine("lex-en", "parts").suggest("Re", 10))


_ASKED = f"SELECT item_id * 1000 + i AS query_id, [w, w[1:2] || '*' || w[-1], '*' || w[-3:]][1 + (i % 3)] AS raw FROM (SELECT item_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT item_id, {_TOKENS.format('text')} AS ws FROM benchmark))"


def _asked(spark, sf):
    """Every word of the benchmark's texts: as it is, as a pattern around its ends, as a pattern of its end."""
    w = F.col("w")
    words = table(spark, sf, "benchmark").select("item_id", F.posexplode(text.tokenize(F.col("text"), LETTERS)).alias("i", "w"))
    raw = F.when(F.col("i") % 3 == 0, w).when(F.col("i") % 3 == 1, F.concat(F.substring(w, 1, 2), F.lit("*"), F.substring(w, -1, 1))).otherwise(F.concat(F.lit("*"), F.substring(w, -3, 3)))
    return words.select((F.col("item_id") * 1000 + F.col("i")).alias("query_id"), raw.alias("raw"))


@query(_suggest(_lex_pack(), _ASKED, LANGUAGES, 5))
def batch_suggest(spark, sf):
    found = samples.of(spark, sf).every_lexicon().suggest_batch(_asked(spark, sf), 5)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(_suggest(_lex_pack(), _ASKED, LANGUAGES, 1, "SELECT query_id, entry_id, match_type = 'lemma' AND matched_term = lower(raw) AS opens FROM answers JOIN asked USING (query_id)"))
def opens_itself(spark, sf):
    asked = _asked(spark, sf)
    found = samples.of(spark, sf).every_lexicon().suggest_batch(asked, 1).join(asked, "query_id")
    return search.opens(found, F.col("raw")).select("query_id", "entry_id", "opens")


@query(_suggest(_lex_pack(), "SELECT 1 AS query_id, 'la' AS raw", LANGUAGES, 10, "SELECT entry_id, language FROM (SELECT *, bool_and(match_type = first_type AND matched_term = first_term) OVER (ORDER BY rank) AS tied FROM (SELECT *, first(match_type) OVER (ORDER BY rank) AS first_type, first(matched_term) OVER (ORDER BY rank) AS first_term FROM answers)) ORDER BY CASE WHEN tied AND language = 'fr' THEN 0 ELSE 1 END, rank LIMIT 1"))
def preferred_hit(spark, sf):
    return search.preferred_hit(_ordered(samples.of(spark, sf).every_lexicon().suggest("la", 10)), "fr").select("entry_id", "language")


def _preferred(spark, sf):
    """An engine whose order and toggles went through a file of settings."""
    s = samples.of(spark, sf)
    names = [f"lex-{x}" for x in LANGUAGES]
    engine = s.engine(*names)
    engine.set_pack_order(["lex-fr", "none", "lex-es"])
    engine.set_pack_enabled("lex-en", False)
    path = s.scratch.path("settings.json")
    engine.save_preferences(path)
    again = s.engine(*names)
    again.apply_preferences(Settings.load(path))
    return again


@query(_suggest(_lex_pack(("fr", "es", "de")), "SELECT 1 AS query_id, 'de' AS raw", ("fr", "es", "de"), 10))
def pack_priority_tie(spark, sf):
    return _ordered(_preferred(spark, sf).suggest("de", 10))


@query("SELECT * FROM (VALUES ('lex-fr', 0, true), ('lex-es', 1, true), ('lex-de', 2, true), ('lex-en', 3, false)) t(pack_id, priority, enabled)")
def preferences_roundtrip(spark, sf):
    return spark.createDataFrame(_preferred(spark, sf).list_packs(), "pack_id STRING, priority INT, enabled BOOLEAN")


@query(_lex_pack(("en",)) + " SELECT 'en:word:the' AS asked, id, lemma, pos, 'seen ' || n AS definition, 'tables' AS source FROM entries WHERE id = 'en:word:the' UNION ALL SELECT 'part:0', 'part:' || p_partkey, p_name, 'phrase', p_brand || ' ' || p_type, 'tables' FROM part WHERE p_partkey = 0 UNION ALL SELECT 'none', NULL, NULL, NULL, NULL, NULL")
def entry_lookup(spark, sf):
    engine = samples.of(spark, sf).engine("lex-en", "parts")
    rows = []
    for asked in ("en:word:the", "part:0", "none"):
        e = engine.get_entry(asked)
        rows.append((asked, e["id"], e["lemma"], e["pos"], e["senses"][0]["definition"], e["senses"][0]["source_id"]) if e else (asked, *[None] * 5))
    return spark.createDataFrame(rows, "asked STRING, id STRING, lemma STRING, pos STRING, definition STRING, source STRING")


@query(_PARTS + " SELECT 1 AS query_id, row_number() OVER (ORDER BY length(term), lemma, id) AS rank, id AS entry_id, lemma, language, pos, term AS matched_term, term_type AS match_type FROM (SELECT * FROM terms JOIN entries USING (entry_rowid) WHERE contains(term, 'l r') ORDER BY term, term_type, entry_rowid LIMIT 40) ORDER BY rank LIMIT 10")
def term_contains(spark, sf):
    return _ordered(samples.of(spark, sf).engine("parts-plain").suggest("l r", 10))


@query(_lex_pack(("fr",)) + """ SELECT 1 AS query_id, row_number() OVER (ORDER BY pos = 'name', length(lemma), lemma) AS rank, id AS entry_id, lemma, language, pos, lemma AS matched_term, 'content' AS match_type
FROM (SELECT * FROM entries WHERE contains('seen ' || n, 'seen 2') ORDER BY entry_rowid LIMIT 40) ORDER BY rank LIMIT 10""")
def payload_scan(spark, sf):
    return _ordered(samples.of(spark, sf).engine("lex-fr-plain", scan_payloads=True).suggest("seen 2", 10))


@query(_suggest(_PARTS, "SELECT 1 AS query_id, 'small' AS raw", ("en",), 10))
def old_layout(spark, sf):
    engine = SearchEngine(spark)
    engine.add_pack(samples.of(spark, sf).old_layout())
    return _ordered(engine.suggest("small", 10))


@query("SELECT page_id, url FROM pages WHERE contains(url, '?page=') OR contains(url, '%') OR contains(url, '_')")
def like_literal_escape(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").where(url.contains("?page=") | url.like(f"%{lookup.to_like('%')}%") | url.like(f"%{lookup.to_like('_')}%")).select("page_id", "url")



# --- full text

_FTS = r"""WITH cols AS (SELECT doc_id, lang, 20.0 AS w, 'text ' || doc_id AS t FROM documents UNION ALL SELECT doc_id, lang, 10.0, coalesce(text, '') FROM documents
  UNION ALL SELECT doc_id, lang, 3.0, left(coalesce(text, ''), 60) FROM documents UNION ALL SELECT doc_id, lang, 1.0, source || chr(10) || lang FROM documents),
toks AS (SELECT doc_id, lang <> 'en' AS pack, w, list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM cols),
len AS (SELECT doc_id, pack, sum(len(ws)) AS l FROM toks GROUP BY ALL), tot AS (SELECT pack, count(*) AS n, avg(l) AS m FROM len GROUP BY pack),
tf AS (SELECT doc_id, pack, tok, sum(w) AS tf FROM (SELECT doc_id, pack, w, unnest(ws) AS tok FROM toks) GROUP BY ALL), df AS (SELECT pack, tok, count(*) AS df FROM tf GROUP BY ALL),
gain AS (SELECT doc_id, pack, tok, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / m)) AS gain FROM tf JOIN df USING (pack, tok) JOIN len USING (doc_id, pack) JOIN tot USING (pack)),
places AS (SELECT doc_id, pack, ws, unnest(range(1, len(ws))) AS i FROM toks)"""


@query(_FTS + " SELECT DISTINCT doc_id FROM places WHERE ws[i] = 'of' AND ws[i + 1] = 'the'")
def phrase_match(spark, sf):
    s, found = samples.of(spark, sf), None
    for pack in ("texts-en", "texts-rest"):
        hits = packs.phrase(s.read(pack, "postings"), ["of", "the"]).join(s.read(pack, "entries"), "entry_rowid")
        hits = hits.select(F.regexp_extract("id", r"(\d+)", 1).cast("long").alias("doc_id"))
        found = hits if found is None else found.unionByName(hits)
    return found


@query(_FTS + " SELECT 'doc:' || doc_id AS id, round(sum(gain), 6) AS score FROM gain WHERE NOT pack AND tok IN ('the', 'src1') GROUP BY doc_id HAVING count(*) = 2 ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf):
    s = samples.of(spark, sf)
    scored = packs.bm25_top(spark, s.pack("texts-en"), ["src1", "the"], 40).join(s.read("texts-en", "entries").select("entry_rowid", "id"), "entry_rowid")
    return scored.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "entry_rowid").limit(20).select("id", "score")


@query(_FTS + """, asked(query_id, a, b) AS (VALUES (1, 'of', 'the'), (2, 'de', 'la'), (3, 'by', 'thing')),
phrase AS (SELECT DISTINCT query_id, doc_id, pack FROM places JOIN asked ON ws[i] = a AND ws[i + 1] = b),
scored AS (SELECT query_id, doc_id, pack, sum(gain) AS score FROM phrase JOIN gain USING (doc_id, pack) JOIN asked USING (query_id) WHERE tok IN (a, b) GROUP BY ALL HAVING count(*) = 2),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, pack ORDER BY score DESC, doc_id) AS rn FROM scored) WHERE rn <= 40),
open AS (SELECT query_id, pack FROM (SELECT query_id, pack, coalesce(sum(c) OVER (PARTITION BY query_id ORDER BY pack ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT query_id, pack, count(*) AS c FROM cut GROUP BY ALL)) WHERE before < 10)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY length('text ' || doc_id), pack, 'text ' || doc_id) AS rank, 'doc:' || doc_id AS entry_id, 'content' AS match_type FROM cut JOIN open USING (query_id, pack)) WHERE rank <= 10""")
def content_gate(spark, sf):
    engine = samples.of(spark, sf).engine("texts-en", "texts-rest")
    found = None
    for i, raw in enumerate(("of the", "de la", "by thing"), 1):
        one = _ordered(engine.suggest(raw, 10)).select(F.lit(i).alias("query_id"), "rank", "entry_id", "match_type")
        found = one if found is None else found.unionByName(one)
    return found


# --- import

_ORDERS = """WITH o AS (SELECT o_orderkey AS k, o_orderstatus, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'zh' WHEN 'O' THEN 'en' ELSE 'und' END AS language,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN lower(string_split(o_orderpriority, '-')[2]) END AS pos, 'order ' || (o_orderkey // 2) AS lemma FROM orders WHERE o_orderkey % 97 NOT IN (5, 6)),
b AS (SELECT *, language || CASE WHEN pos IS NULL THEN ':' ELSE ':' || pos || ':' END || lemma || CASE WHEN (k // 2) % 3 <> 2 THEN ':e' || ((k // 2) % 3) ELSE '' END AS base_id FROM o WHERE k % 50 <> 7),
items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS i FROM lineitem),
s AS (SELECT b.*, items.* FROM b JOIN items ON k = l_orderkey WHERE l_linenumber % 4 <> 0),
kept AS (SELECT * FROM b WHERE k IN (SELECT k FROM s))"""


def _dump(spark, sf):
    records, _ = readers.read_dump(spark, samples.of(spark, sf).dump())
    return importing.dump_to_entries(records, "dump")


@query(_ORDERS + """ SELECT base_id, count(*) AS senses, string_agg(concat_ws('|', base_id || ':s' || i, l_returnflag || '; ' || l_linestatus, 'part ' || l_partkey || '~line ' || l_linenumber,
  'de:Teil ' || l_partkey || CASE WHEN i = 1 THEN ',fr:commande ' || k ELSE '' END, 'supplier ' || l_suppkey || ' (s' || l_suppkey || ')' || CASE WHEN i = 1 THEN ',' || o_orderstatus ELSE '' END,
  'part ' || l_partkey || CASE WHEN i = 1 THEN ',' || o_orderpriority ELSE '' END, l_returnflag || ',' || l_linestatus), ';' ORDER BY i) AS body FROM s GROUP BY k, base_id""")
def nested_entry_build(spark, sf):
    joined = lambda c, one, sep=",": F.array_join(F.transform(c, one), sep)
    sense = lambda s: F.concat_ws("|", s["id"], s["definition"], joined(s["examples"], lambda e: F.concat_ws("~", e["text"], e["translation"])), joined(s["translations"], lambda t: F.concat_ws(":", t["target_lang"], t["text"])), F.array_join(s["synonyms"], ","), F.array_join(s["collocations"], ","), F.array_join(s["tags"], ","))
    return _dump(spark, sf).select("base_id", F.size("senses").cast("long").alias("senses"), joined("senses", sense, ";").alias("body"))


_SOUNDS = """CASE WHEN language = 'en' AND k % 2 = 0 THEN '/us/|ipa|US;/' || k || '|ipa|UK' ELSE '/' || k || '|ipa|UK' || CASE WHEN k % 2 = 0 THEN ';/us/|ipa|US' ELSE '' END END
  || CASE WHEN k % 3 = 0 THEN ';|audio||m.mp3' ELSE '' END || CASE WHEN k % 5 = 0 THEN ';r' || k || '|transcription|' ELSE '' END"""


@query(_ORDERS + f" SELECT base_id, language, lemma, pos, {_SOUNDS} AS sounds, 'orders ' || k || '|plural, x; f |form' AS forms FROM kept")
def entry_mapping(spark, sf):
    sound = lambda p: F.concat_ws("|", p["ipa"], p["type"], F.array_join(p["tags"], "+"), p["audio"])
    return _dump(spark, sf).select("base_id", "language", "lemma", "pos", F.array_join(F.transform("pronunciations", sound), ";").alias("sounds"), F.array_join(F.transform("forms", lambda f: F.concat_ws("|", f["form"], f["type"])), ";").alias("forms"))


@query(_ORDERS + " SELECT base_id, 'orders ' || k AS forms, 1 + (k % 2 = 0)::INT + (k % 5 = 0)::INT AS spoken, (k % 3 = 0)::INT AS recordings FROM kept")
def entry_view(spark, sf):
    entries = _dump(spark, sf)
    shown = F.transform(text.display_forms(F.col("forms"), F.col("lemma")), lambda f: f["form"])
    return entries.select("base_id", F.array_join(shown, ",").alias("forms"), F.size(text.spoken(F.col("pronunciations"))).alias("spoken"), F.size(text.recordings(F.col("pronunciations"))).alias("recordings"))


@query(_ORDERS + """, counted AS (SELECT base_id, count(*) AS n FROM kept GROUP BY base_id)
SELECT (SELECT count(*) FROM orders) AS lines, (SELECT count(*) FROM orders WHERE o_orderkey % 97 IN (5, 6)) AS bad_lines, (SELECT count(*) FROM o) - (SELECT count(*) FROM kept) AS skipped,
  (SELECT count(*) FROM kept) AS entries, (SELECT 3 * count(*) + sum((k % 5 = 0)::INT) FROM kept)::BIGINT AS terms, (SELECT sum(n * (n - 1) // 2) FROM counted)::BIGINT AS id_collisions,
  (SELECT sum((k % 5 = 0)::INT) FROM kept)::BIGINT AS transcription_terms, (SELECT count(*) FROM kept) AS indexed""")
def build_stats(spark, sf):
    stats = asdict(samples.of(spark, sf).stats("orders"))
    return spark.createDataFrame([tuple(stats.values())], ", ".join(f"{k} LONG" for k in stats))


_LINE = """CASE event_id % 7 WHEN 0 THEN '{"word": ' || event_id WHEN 1 THEN '{"word": ' || event_id || '}' WHEN 2 THEN props WHEN 3 THEN '{"word": null, "pos": "x"}' ELSE '{"word": "' || event_type || ' ' || event_id || '", "pos": "event"}' END"""


@query(f"SELECT coalesce(event_type || ' ' || event_id, '') AS word, true AS good FROM events WHERE event_id % 7 > 3 UNION ALL SELECT {_LINE}, false FROM events WHERE event_id % 7 <= 3")
def json_lenient_parse(spark, sf):
    s = samples.of(spark, sf)
    path = s.scratch.path("events")
    table(spark, sf, "events").select(F.expr(_LINE).alias("value")).write.mode("overwrite").text(path)
    records, bad = readers.read_dump(spark, path)
    return records.select("word", F.lit(True).alias("good")).unionByName(bad.select(F.col("value").alias("word"), F.lit(False).alias("good")))


def _based(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("line_no"), F.concat_ws(":", "lang", "source").alias("base_id"))


@query("SELECT doc_id, CASE WHEN rn > 1 THEN b || '~' || rn ELSE b END AS id FROM (SELECT doc_id, lang || ':' || source AS b, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents)")
def id_disambiguation(spark, sf):
    return importing.disambiguate(_based(spark, sf)).select(F.col("line_no").alias("doc_id"), "id")


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 400 = 7 THEN lang || '~' || (2 + doc_id % 9) ELSE lang END AS base FROM documents),
own AS (SELECT base, min(doc_id) AS first FROM b WHERE base LIKE '%~%' GROUP BY base),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS rn FROM b),
-- In a lang's own order the names that stand in the input are told apart one by one, smallest first.
r AS (SELECT split_part(base, '~', 1) AS lang, split_part(base, '~', 2)::BIGINT AS k, base, first, row_number() OVER (PARTITION BY split_part(base, '~', 1) ORDER BY split_part(base, '~', 2)::BIGINT) AS i FROM own),
w AS (WITH RECURSIVE w(lang, i, held) AS (SELECT DISTINCT lang, 0::BIGINT, CAST([] AS BIGINT[]) FROM r
  UNION ALL SELECT w.lang, r.i, CASE WHEN coalesce((SELECT doc_id FROM n WHERE n.base = w.lang AND n.rn = r.k - len(w.held)) < r.first, false) THEN w.held ELSE list_append(w.held, r.k) END FROM w JOIN r ON r.lang = w.lang AND r.i = w.i + 1)
  SELECT lang, arg_max(held, i) AS held FROM w GROUP BY lang),
t AS (SELECT doc_id, n.base, list_reduce(list_prepend(rn + CASE WHEN r.base IS NOT NULL AND NOT list_contains(x.held, r.k) THEN 1 ELSE 0 END, coalesce(w.held, [])), lambda a, k: CASE WHEN k <= a THEN a + 1 ELSE a END) AS copy
  FROM n LEFT JOIN w ON n.base = w.lang LEFT JOIN r ON n.base = r.base LEFT JOIN w x ON x.lang = r.lang)
SELECT doc_id, CASE WHEN copy > 1 THEN base || '~' || copy ELSE base END AS id, copy FROM t""")
def id_collisions(spark, sf):
    """Records that bring the name that another one's copy would have."""
    own = F.concat("lang", F.lit("~"), (F.lit(2) + F.col("doc_id") % 9).cast("string"))
    place = F.shiftleft("doc_id", 20)  # stretches of 8,192 documents
    rows = table(spark, sf, "documents").select(place.alias("line_no"), F.when(F.col("doc_id") % 400 == 7, own).otherwise(F.col("lang")).alias("base_id"))
    return importing.disambiguate(rows).select(F.shiftright("line_no", 20).alias("doc_id"), "id", "copy")


@query("SELECT doc_id, CASE WHEN rn > 1 THEN b || '~' || rn ELSE b END AS id FROM (SELECT doc_id, lang || ':' || source AS b, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 150))")
def entry_limit(spark, sf):
    return importing.disambiguate(_based(spark, sf), 150).select(F.col("line_no").alias("doc_id"), "id")


@query(_ORDERS + " SELECT '' AS stored, 'dump' AS shown, count(*) AS n FROM kept")
def default_source_roundtrip(spark, sf):
    s = samples.of(spark, sf)
    stored = s.read(s.either("orders"), "entries")
    ids = lambda df, name: df.select("entry_rowid", F.array_join(F.array_distinct(F.concat(F.transform("forms", lambda x: x["source_id"]), F.transform("senses", lambda x: x["source_id"]))), ",").alias(name))
    shown = importing.fill_default_source(stored, "dump")
    return ids(stored, "stored").join(ids(shown, "shown"), "entry_rowid").groupBy("stored", "shown").agg(F.count("*").alias("n"))


@query(_LEX + r""" SELECT lang, term, lower(nfc_normalize(replace(term, 'e', 'E' || chr(769)))) AS composed,
  regexp_replace(translate(replace(translate(term, 'aeiou', 'àèíòú') || 'l·lç', 'l·l', 'll'), 'àéèíïóòúüç', 'aeeiioouuc'), '[!-/:-@\[-`{-~\s]', '', 'g') AS ca,
  regexp_replace(translate(strip_accents(translate(term, 'abcdef', 'أإآةىب') || chr(1614)), 'أإآٱةى', 'ااااهي'), '[!-/:-@\[-`{-~\s]', '', 'g') AS ary,
  regexp_replace(translate(translate(term, 'aeiou', 'āéǐòǚ') || '¹', 'āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜü', 'aaaaeeeeiiiioooouuuuuuuuu'), '[!-/:-@\[-`{-~\s]', '', 'g') AS zh FROM lex""")
def search_keys(spark, sf):
    term = F.col("term")
    return lexicon(spark, sf).select(
        "lang", "term",
        normalize.exact_key(F.concat(F.lit("\u2003"), F.replace(term, F.lit("e"), F.lit("E\u0301")), F.lit(" "))).alias("composed"),
        normalize.loose_key(F.concat(F.translate(term, "aeiou", "àèíòú"), F.lit("l·lç")), "ca").alias("ca"),
        normalize.loose_key(F.concat(F.translate(term, "abcdef", "أإآةىب"), F.lit("َ")), "ary").alias("ary"),
        normalize.loose_key(F.concat(F.translate(term, "aeiou", "āéǐòǚ"), F.lit("¹")), "zh").alias("zh"),
    )


# --- sentences

_SAID = "spoken AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN role = 'user' THEN 'fra' ELSE 'eng' END AS lang, regexp_replace(text, '[\\n\\t\\r]', ' ', 'g') AS text FROM conversations)"


@query(f"WITH {_SAID} SELECT id AS a, id + 1 AS b FROM spoken WHERE lang = 'fra'")
def first_link(spark, sf):
    return packs.first_links(readers.read_links(spark, samples.of(spark, sf).sentences()[1]))


@query(_LEX + f", heads AS (SELECT DISTINCT term FROM lex), s AS (SELECT DISTINCT conv_id * 1000 + turn AS id, unnest({_TOKENS.format('text')}) AS term FROM conversations), r AS (SELECT term, id, row_number() OVER (PARTITION BY term ORDER BY id) AS rn FROM s JOIN heads USING (term)) SELECT term, id FROM r WHERE rn <= 3")
def sentence_headword_match(spark, sf):
    heads = lexicon(spark, sf).select(F.col("term").alias("entry_rowid"), "term", F.lit("lemma").alias("term_type"))
    said = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return packs.sentence_hits(said, heads, 3, LETTERS).select(F.col("entry_rowid").alias("term"), "id")


@query(_lex_pack(("fr",)) + f""", {_SAID}, w AS (SELECT DISTINCT id AS sid, unnest({_TOKENS.format('text')}) AS term FROM spoken WHERE lang = 'fra'),
hit AS (SELECT DISTINCT entry_rowid, sid FROM w JOIN terms USING (term) WHERE term_type IN ('lemma', 'form')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_rowid ORDER BY sid) AS rn FROM hit) WHERE rn <= 3)
SELECT e.id, s.text, t.text AS translation, 'tatoeba:' || sid AS source_id FROM best JOIN entries e USING (entry_rowid) JOIN spoken s ON s.id = sid LEFT JOIN spoken t ON t.id = sid + 1 AND t.lang = 'eng'""")
def sentence_merge(spark, sf):
    entries = spark.read.parquet(samples.of(spark, sf).merged() + "/entries")
    return entries.select("id", F.explode(F.get("senses", F.lit(0))["examples"]).alias("e")).select("id", "e.text", "e.translation", "e.source_id")


@query(_lex_pack(("fr",)) + f""", {_SAID}, w AS (SELECT DISTINCT id AS sid, unnest({_TOKENS.format('text')}) AS term FROM spoken WHERE lang = 'fra'),
hit AS (SELECT DISTINCT entry_rowid, sid FROM w JOIN terms USING (term) WHERE term_type IN ('lemma', 'form')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_rowid ORDER BY sid) AS rn FROM hit) WHERE rn <= 3)
SELECT 'tables' AS id, 'CC0' AS license, false AS credited, 0::BIGINT AS examples UNION ALL SELECT 'tatoeba', 'CC BY 2.0 FR', true, count(*) FROM best""")
def sentence_credit(spark, sf):
    merged = samples.of(spark, sf).merged()
    sources = spark.read.parquet(f"{merged}/sources")
    said = spark.read.parquet(f"{merged}/entries").select(F.explode(F.get("senses", F.lit(0))["examples"]).alias("e"))
    counts = said.select(F.split("e.source_id", ":")[0].alias("id")).groupBy("id").agg(F.count("*").alias("examples"))
    return sources.join(counts, "id", "left").select("id", "license", (F.coalesce("attribution", F.lit("")) != "").alias("credited"), F.coalesce("examples", F.lit(0)).cast("long").alias("examples"))


_TOLD = "c AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, text, CASE WHEN role = 'user' THEN 'fra' ELSE 'eng' END AS lang, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)"


@query(f"WITH {_TOLD} SELECT a.id AS source_id, a.text AS source_text, a.lang AS source_lang, b.id AS target_id, b.text AS target_text, b.lang AS target_lang, CASE WHEN b.turn % 2 = 0 THEN 'CC0' WHEN a.conv_id % 2 = 0 THEN 'PD' ELSE 'CC BY 2.0 FR' END AS license, 'Tatoeba.org #' || a.id || ' -> #' || b.id AS attribution FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.i = 1 AND b.i > 1")
def sentence_pairs(spark, sf):
    return readers.sentence_pairs(readers.read_sentence_json(spark, samples.of(spark, sf).sentence_json()))


@query(f"WITH {_TOLD} SELECT a.text, 'tatoeba:' || a.id AS source_id, arg_min(b.text, b.i) FILTER (b.lang = 'eng') AS translation FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND b.i > 1 WHERE a.i = 1 GROUP BY a.text, a.id")
def sentence_examples(spark, sf):
    records = readers.read_sentence_json(spark, samples.of(spark, sf).sentence_json())
    return readers.sentence_examples(records, "eng").select("text", "source_id", "translation")


# --- packs


@query(_PARTS + " SELECT term_type, count(*) AS n, (SELECT count(*) FROM entries) AS entries FROM terms GROUP BY term_type")
def inspect_pack(spark, sf):
    n, _, kinds = packs.inspect(spark, samples.of(spark, sf).pack("parts"))
    return spark.createDataFrame([(k, c, n) for k, c in kinds.items()], "term_type STRING, n LONG, entries LONG")


@query("WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS term, 'form' AS term_type FROM part UNION ALL SELECT p_partkey, p_name, 'lemma' FROM part) SELECT term_type, count(*) AS n FROM t GROUP BY term_type")
def term_type_counts(spark, sf):
    part = table(spark, sf, "part")
    forms = part.select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("term"), F.lit("form").alias("term_type"))
    return packs.term_counts(forms.union(part.select("p_partkey", "p_name", F.lit("lemma"))))


_COVER = _ORDERS + """ SELECT 'orders' AS pack, count(*) AS entries, count(*) AS ipa, count(*) AS examples, count(*) AS translations, count(*) AS synonyms, count(*) AS collocations, 0.0::DOUBLE AS han_share FROM kept
UNION ALL SELECT 'parts', count(*), 0, 0, 0, 0, 0, 0.0 FROM part UNION ALL SELECT 'texts-en', count(*), 0, count(*), 0, count(*), 0, 0.0 FROM documents WHERE lang = 'en'"""


@query(_COVER)
def coverage_report(spark, sf):
    s, found = samples.of(spark, sf), None
    for pack in ("orders", "parts", "texts-en"):
        one = packs.coverage(s.read(s.either(pack), "entries")).select(F.lit(pack).alias("pack"), "*")
        found = one if found is None else found.unionByName(one)
    return found


@query("SELECT * FROM (VALUES ('orders', 'fewer than half of the lemmas are Han'), ('parts', 'no entry has a translation')) t(pack, warning)")
def coverage_warnings(spark, sf):
    s = samples.of(spark, sf)
    of = lambda pack: packs.coverage_warnings(spark, s.pack(s.either(pack))).select(F.lit(pack).alias("pack"), "warning")
    return of("orders").unionByName(of("parts"))


@query("SELECT pack, \"check\", true AS ok FROM (VALUES ('orders'), ('parts'), ('lex-en')) p(pack), (VALUES ('entries'), ('count'), ('lemmas'), ('orphans'), ('languages'), ('indexed'), ('transcriptions'), ('unique_ids')) c(\"check\")")
def pack_validation(spark, sf):
    s, found = samples.of(spark, sf), None
    for pack in ("orders", "parts", "lex-en"):
        one = packs.validate_pack(spark, s.pack(pack)).select(F.lit(pack).alias("pack"), "check", "ok")
        found = one if found is None else found.unionByName(one)
    return found


@query("SELECT doc_id, lang FROM documents d ANTI JOIN labels l USING (doc_id)")
def orphans_anti(spark, sf):
    terms = table(spark, sf, "documents").select(F.col("doc_id").alias("entry_rowid"), "lang")
    return packs.orphans(terms, table(spark, sf, "labels").select(F.col("doc_id").alias("entry_rowid"))).select(F.col("entry_rowid").alias("doc_id"), "lang")


@query("SELECT DISTINCT lang AS language FROM documents WHERE lang NOT IN ('en', 'de', 'es')")
def lang_subset(spark, sf):
    return packs.undeclared(table(spark, sf, "documents").select(F.col("lang").alias("language")), ["en", "de", "es"])


@query(_lex_pack(("es",)) + " SELECT 'lex-es' AS pack_id, 0 AS priority, count(*) AS entries, true AS verified, true AS smaller FROM entries UNION ALL SELECT 'parts', 1, count(*), true, true FROM part")
def package_install(spark, sf):
    s = samples.of(spark, sf)
    made, here = s.scratch.path("release"), s.scratch.path("installed")
    rows = {r.pack_id: r for r in packaging.package(spark, [s.pack("parts"), s.pack("lex-es")], made).collect()}
    sure = {name: packaging.install(spark, f"{made}/{name}", f"{here}/{name}", f"{made}/{packaging.SUMS}") for name in rows}
    engine = SearchEngine(spark)
    found = engine.load_directories([f"{here}-none", here])
    if found["loaded"] != 2 or found["errors"] or engine.entry_total() != sum(r.entries for r in rows.values()):
        raise ValueError(found)
    return spark.createDataFrame([(p.pack_id, p.priority, p.entry_count, sure[p.pack_id], rows[p.pack_id].archive_bytes > 0) for p in engine.packs], "pack_id STRING, priority INT, entries LONG, verified BOOLEAN, smaller BOOLEAN")


@query(_PARTS + " SELECT 'entries' AS \"table\", count(*) AS n FROM entries UNION ALL SELECT 'terms', count(*) FROM terms")
def compaction(spark, sf):
    s = samples.of(spark, sf)
    path = s.scratch.path("compact")
    for t in packs.tables_of(s.pack("parts")):
        s.read("parts", t).write.mode("overwrite").parquet(f"{path}/{t}")
    packs.compact(spark, path)
    of = lambda t: spark.read.parquet(f"{path}/{t}").agg(F.lit(t).alias("table"), F.count("*").alias("n"))
    return of("entries").unionByName(of("terms"))


@query("SELECT 'edition-' || lang AS id, 'Edition: ' || upper(lang) AS name, 2 AS schema_version, lang AS languages, 'CC0' AS license, 'edition' AS source_id, upper(lang) || ' (Edition)' AS source, 'https://example.org/' || count(*) AS url FROM documents GROUP BY lang")
def manifest_roundtrip(spark, sf):
    """A manifest for each language of the documents, written and read again."""
    s, found = samples.of(spark, sf), None
    folder = s.scratch.path("manifests")
    for r in table(spark, sf, "documents").groupBy("lang").count().collect():  # a row a language
        path = f"{folder}-{r.lang}.json"
        files.write_text(path, json.dumps(packaging.make_manifest(r.lang, r.lang.upper(), "Edition", f"https://example.org/{r['count']}", s.manifest("any", [r.lang]), "CC0", "edition")))
        packs.load_manifest(path)
        one = readers.read_manifest(spark, path)
        found = one if found is None else found.unionByName(one)
    return found.select("id", "name", "schema_version", F.array_join("languages", ",").alias("languages"), "license", F.col("sources")[0]["id"].alias("source_id"), F.col("sources")[0]["name"].alias("source"), F.col("sources")[0]["url"].alias("url"))


@query("SELECT doc_id // 250 AS part, sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS digest, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes FROM documents GROUP BY part")
def checksum(spark, sf):
    """Files of 250 documents each, and their digests taken by tasks."""
    path = samples.of(spark, sf).scratch.path("texts")
    rows = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 250).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "doc_id").drop("doc_id").write.mode("overwrite").partitionBy("part").text(path)
    return packaging.sums(spark, path, "*.txt").select(F.regexp_extract("name", r"part=(\d+)", 1).cast("long").alias("part"), "digest", "bytes")


_ENTRY_LINES = "SELECT 'part:' || p_partkey AS id, 'en' AS language, p_name AS lemma, p_partkey % 7 = 0 AS bare FROM part"


@query(f"SELECT 'good' AS file, id, language, lemma, row_number() OVER (ORDER BY id) AS place FROM ({_ENTRY_LINES}) UNION ALL SELECT kind, NULL, NULL, NULL, 0 FROM (VALUES ('broken: aborted'), ('lacking: aborted')) t(kind)")
def strict_entries(spark, sf):
    """Authored entries of all parts, in files of any size; a line that does not parse, or one that lacks a field, aborts the read."""
    s = samples.of(spark, sf)
    lines = table(spark, sf, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.lit("en").alias("language"), F.col("p_name").alias("lemma"), (F.col("p_partkey") % 7 == 0).alias("bare"))
    said = F.when(F.col("bare"), F.to_json(F.struct("id", "language", "lemma"))).otherwise(F.to_json(F.struct("id", "language", "lemma", F.array().cast("array<string>").alias("senses"))))
    found = None
    for kind, last in (("good", "' '"), ("broken", "'{'"), ("lacking", "'{\"id\": \"x\", \"language\": \"en\"}'")):
        path = s.scratch.path(f"authored-{kind}")
        lines.repartitionByRange(5, "id").sortWithinPartitions("id").select(said.alias("value")).write.mode("overwrite").text(path)
        spark.range(1).select(F.expr(last).alias("value")).write.mode("append").text(path)
        read = readers.read_entries(spark, path)
        if kind == "good":
            found = number_rows(importing.with_defaults(read)).select(F.lit("good").alias("file"), "id", "language", "lemma", F.col("entry_rowid").alias("place"))
            continue
        try:
            read.write.format("noop").mode("overwrite").save()
            end = "read"
        except Exception as e:  # noqa: BLE001  what aborts is the point
            end = "aborted" if "MALFORMED_RECORD" in str(e) or "lacks a required field" in str(e) else "failed otherwise"
        found = found.unionByName(spark.range(1).select(F.lit(f"{kind}: {end}").alias("file"), *(F.lit(None).cast("string").alias(c) for c in ("id", "language", "lemma")), F.lit(0).cast("long").alias("place")))
    return found


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(avg(value), 6) AS mean, max(CASE WHEN rn = CAST(floor((n - 1) * 0.5 + 0.5) AS BIGINT) + 1 THEN value END) AS p50, max(CASE WHEN rn = CAST(floor((n - 1) * 0.95 + 0.5) AS BIGINT) + 1 THEN value END) AS p95 FROM r GROUP BY event_type")
def latency_percentiles(spark, sf):
    found = measure.nearest_rank(table(spark, sf, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return found.withColumn("mean", F.round("mean", 6))


# --- text


@query(f"SELECT conv_id, turn, array_to_string({_TOKENS.format('text')}, ' ') AS words FROM conversations")
def tokenize_words(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(text.tokenize(F.col("text"), LETTERS), " ").alias("words"))


@query(r"SELECT item_id, regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^[!-,./:-@\[-`{-~\s]+', ''), '[!-,./:-@\[-`{-~\s]+$', ''), 1, 200), '\s+$', '') AS stripped FROM benchmark")
def edge_strip(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.edge_strip(F.col("text")).alias("stripped"))


@query(r"SELECT item_id, regexp_replace(text || ' (, ', '[(（,\s]+$', '') AS word FROM benchmark")
def relation_cleanup(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.relation_word(F.concat("text", F.lit(" (, "))).alias("word"))


@query("SELECT conv_id, turn, 'Look up “' || CASE WHEN length(text) > 40 THEN substr(text, 1, 39) || '…' ELSE text END || '”' AS label, replace(text, '&', '&&') AS menu FROM conversations")
def lookup_labels(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.lookup_label(F.col("text")).alias("label"), text.escape_menu_label(F.col("text")).alias("menu"))


@query("""SELECT conv_id, turn, replace(replace(replace(replace(replace(substr(text, 1, 600), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;') AS spoken FROM conversations""")
def speech_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.speech_text(F.col("text")).alias("spoken"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'en-US-JennyNeural' WHEN 'de' THEN 'de-DE-KatjaNeural' WHEN 'es' THEN 'es-ES-AlvaroNeural' WHEN 'fr' THEN 'fr-FR-DeniseNeural' END AS voice FROM documents")
def voices(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.voice_for(F.col("lang")).alias("voice"))


@query(r"SELECT conv_id, turn, nullif(regexp_extract(left(text, 25), '([\p{L}\p{M}\p{N}''’·]*)$', 1) || regexp_extract(substr(text, 26), '^([\p{L}\p{M}\p{N}''’·]*)', 1), '') AS word FROM conversations")
def word_at(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.word_at(F.col("text"), F.lit(25)).alias("word"))


@query("SELECT event_id, strftime(make_timestamp(epoch_us(date_trunc('second', ts))), '%a %b %d %Y %H:%M:%S GMT+0000 (Coordinated Universal Time)') AS said, upper(sha256(((epoch_us(ts) // 1000000 + 11644473600) // 300 * 300 * 10000000) || 'key')) AS token FROM events")
def speech_request(spark, sf):
    seconds = F.floor(F.unix_micros("ts") / 1_000_000) if dict(table(spark, sf, "events").dtypes)["ts"] == "timestamp" else F.unix_timestamp("ts")
    return table(spark, sf, "events").select("event_id", text.speech_time(seconds).alias("said"), text.speech_token(seconds, "key").alias("token"))


@query(r"SELECT doc_id, doc_id % 3 = 0 AS han FROM documents WHERE text IS NOT NULL")
def han_texts(spark, sf):
    mixed = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("你好"))).otherwise(F.concat("text", F.lit("ñß")))
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", text.has_han(mixed).alias("han"))
