"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, hyperminhash, jaccard_join, lexical_search, license_scan, line_dedup, merkle, mixing, packing, quality_rules, secret_scan, toxicity, warc
from .common import read_table, ship


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.transform(spans, lambda s: s["label"])
    join = lambda names: F.array_join(F.sort_array(F.array_distinct(names)), ",")
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        join(labels(base)).alias("base_labels"),
        join(F.concat(labels(base), labels(F.col("kept")))).alias("labels"),
        license_scan.license_score(F.col("kept")).alias("score"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.rule_ledger(read_table(spark, sf_dir, "documents"))
    return quality_rules.apply_policy(ledger).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    base = F.filter("secrets", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in secret_scan.BASE_KINDS),
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("secrets")).alias("spans"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", F.size("deleted_lines").cast("long").alias("n_deleted"), F.array_join("deleted_lines", ",").alias("deleted"), "text")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    archive = warc.write_pages(pages)
    return warc.read_records(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(read_table(spark, sf_dir, "documents"))
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), carry=("ids_crc32",)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fingerprint.fingerprint_edits(read_table(spark, sf_dir, "documents"))
    near = lambda other: fingerprint.resemblance(F.col("sketch"), F.col(other))
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.to_text(F.col("sketch")).alias("fingerprint"),
        fingerprint.to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        near("edited_sketch").alias("near_edited"),
        near("next_sketch").alias("near_next"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "size", "source_size", "target", "taken")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs.where(~held), labels.where(~held))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    tampered = merkle.leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    manifest = merkle.Manifest(docs, carry={"tampered": F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, tampered)})
    return manifest.verify(F.coalesce("tampered", "leaf"))


def _with_package(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    named = (op1_license_scan, op2_line_dedup, op3_warc, op4_quality_rules, op5_packing, op6_secret_scan, op7_fingerprints, op8_mixing, op9_toxicity, op10_jaccard_join, op11_minhash, op12_ranked_search, op13_merkle_manifest)
    return {f.__name__: _with_package(f) for f in named}


#: Base32 takes five bits of the digest at a time: twenty, five hexadecimal digits, give four characters.
_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, strlen(t) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p),
r AS (SELECT rid, count(DISTINCT pos) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM g WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.rid, doc_id, len(ws) AS n_words, length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_bangs
      FROM d JOIN w USING (rid) LEFT JOIN r USING (rid) LEFT JOIN l USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed, NOT (({base}) OR ({all})) AS kept,
       CAST({bits} AS BIGINT) AS fail_bits
FROM m
"""


_OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, y FROM r JOIN both_ways ON reached = x)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


_OP11 = _OP10.replace("100 * c >= 80", "100 * c >= 85").replace("min(reached) AS component_id", "min(reached) AS component_id, doc_id = min(reached) AS kept")


_OP12 = r"""
WITH t AS (SELECT 'd' AS side, row_number() OVER () AS rid, doc_id AS id, text FROM documents UNION ALL SELECT 'q', row_number() OVER (), item_id, text FROM benchmark),
w AS (SELECT side, rid, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM t),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM w WHERE side = 'd' AND len(ws) > 0),
m AS (SELECT rid, id, 10 + (90 * CAST(len(ws) AS BIGINT) * n_docs) // n_terms AS m FROM w, s WHERE side = 'd' AND len(ws) > 0),
f AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM w WHERE side = 'd') GROUP BY ALL),
q AS (SELECT DISTINCT rid AS item, id AS item_id, term FROM (SELECT rid, id, unnest(ws) AS term FROM w WHERE side = 'q')),
df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
g AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM df, s),
r AS (SELECT item, item_id, rid, m.id AS doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN g USING (term) JOIN m USING (rid) GROUP BY ALL),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM o WHERE rank <= 10
"""


#: Lists of hashes halve until one is left. A crc32 is taken bit by bit of the decimal digits.
_OP13 = """
WITH RECURSIVE d AS (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, c: list_reduce(list_prepend(xor(a, c), list_transform(range(8), lambda i: 0::BIGINT)), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))) AS crc FROM documents),
f AS (SELECT *, n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS n_bad FROM d),
s AS (SELECT doc_id, lang, {doc_id} || {source} || {lang} AS head, {n_chars} AS said, {n_bad} AS bad, {text} AS body FROM f),
h AS (SELECT doc_id, lang, sha256(head || said || body) AS leaf, sha256(head || bad || body) AS tampered, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i FROM s),
t(lang, level, hs) AS (SELECT lang, 0, list(leaf ORDER BY i) FROM h GROUP BY lang
  UNION ALL SELECT lang, level + 1, list_transform(range(0, len(hs), 2), lambda j: sha256(hs[j + 1] || coalesce(hs[j + 2], ''))) FROM t WHERE len(hs) > 1),
subs AS (SELECT lang, hs[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM t WHERE len(hs) = 1),
c(level, hs) AS (SELECT 0, list(subroot ORDER BY g) FROM subs UNION ALL SELECT level + 1, list_transform(range(0, len(hs), 2), lambda j: sha256(hs[j + 1] || coalesce(hs[j + 2], ''))) FROM c WHERE len(hs) > 1),
top AS (SELECT hs[1] AS root FROM c WHERE len(hs) = 1),
steps AS (SELECT h.lang, h.i, t.level, t.hs[xor(h.i >> t.level, 1) + 1] AS sibling, (h.i >> t.level) % 2 AS slot FROM h JOIN t ON h.lang IS NOT DISTINCT FROM t.lang AND len(t.hs) > 1
  UNION ALL SELECT h.lang, h.i, 1000 + c.level, c.hs[xor(g >> c.level, 1) + 1], (g >> c.level) % 2 FROM h JOIN subs ON h.lang IS NOT DISTINCT FROM subs.lang, c WHERE len(c.hs) > 1),
paths AS (SELECT lang, i, list({'sibling': coalesce(sibling, ''), 'slot': slot} ORDER BY level) AS path FROM steps GROUP BY lang, i),
folded(lang, i, step, now, path) AS (SELECT h.lang, h.i, 1, tampered, coalesce(path, []) FROM h LEFT JOIN paths p ON h.lang IS NOT DISTINCT FROM p.lang AND h.i = p.i
  UNION ALL SELECT lang, i, step + 1, sha256(CASE WHEN path[step].slot = 0 THEN now || path[step].sibling ELSE path[step].sibling || now END), path FROM folded WHERE step <= len(path))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.sibling), '')) AS proof_sha256, now AS folded_root, now = root AS verified
FROM h JOIN subs ON h.lang IS NOT DISTINCT FROM subs.lang JOIN folded f ON h.lang IS NOT DISTINCT FROM f.lang AND h.i = f.i AND step = len(path) + 1, top
"""
for _c in ("doc_id", "source", "lang", "n_chars", "n_bad", "text"):
    _OP13 = _OP13.replace(f"{{{_c}}}", f"CASE WHEN {_c} IS NULL THEN '-' ELSE strlen({_c}::VARCHAR) || ':' || {_c} END")


def oracle_sql() -> dict[str, str]:
    by = {r.name: r.fails for r in quality_rules.RULES}
    either = lambda policy: " OR ".join(f"({by[n]})" for n in quality_rules.POLICIES[policy])
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(quality_rules.RULES))
    return {"op3_warc": _OP3, "op4_quality_rules": _OP4.replace("{base}", either("base")).replace("{all}", either("v2")).replace("{bits}", bits), "op10_jaccard_join": _OP10, "op11_minhash": _OP11, "op12_ranked_search": _OP12, "op13_merkle_manifest": _OP13}
