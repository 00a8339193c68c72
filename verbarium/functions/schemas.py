"""Schemas of lexical entries, manifests and raw dumps."""

ENTRY = (
    "id STRING, language STRING, lemma STRING, pos STRING, "
    "pronunciations ARRAY<STRUCT<ipa STRING, type STRING, tags ARRAY<STRING>, audio STRING, source_id STRING>>, "
    "senses ARRAY<STRUCT<id STRING, definition STRING, "
    "examples ARRAY<STRUCT<text STRING, translation STRING, roman STRING, source_id STRING>>, "
    "translations ARRAY<STRUCT<target_lang STRING, text STRING, source_id STRING>>, "
    "synonyms ARRAY<STRING>, collocations ARRAY<STRING>, tags ARRAY<STRING>, source_id STRING>>, "
    "forms ARRAY<STRUCT<form STRING, type STRING, source_id STRING>>"
)
MANIFEST = "id STRING, name STRING, version STRING, schema_version INT, languages ARRAY<STRING>, created_at STRING, license STRING, sources ARRAY<STRUCT<id STRING, name STRING, url STRING, license STRING, attribution STRING>>"
_RELATED = "ARRAY<STRUCT<word STRING, roman STRING>>"
_TRANSLATED = "ARRAY<STRUCT<lang STRING, code STRING, lang_code STRING, word STRING>>"
DUMP = (
    "word VARIANT, lang STRING, lang_code STRING, pos STRING, etymology_number VARIANT, "
    "sounds ARRAY<STRUCT<ipa STRING, tags ARRAY<STRING>, audio STRING, ogg_url STRING, mp3_url STRING, `zh-pron` STRING, zh_pron STRING, roman STRING>>, "
    "senses ARRAY<STRUCT<id STRING, glosses ARRAY<STRING>, examples ARRAY<STRUCT<text STRING, translation STRING, english STRING, roman STRING>>, "
    f"translations {_TRANSLATED}, synonyms {_RELATED}, related {_RELATED}, derived {_RELATED}, coordinate_terms {_RELATED}, tags ARRAY<STRING>, raw_tags ARRAY<STRING>>>, "
    f"forms ARRAY<STRUCT<form STRING, tags ARRAY<STRING>>>, related {_RELATED}, derived {_RELATED}, coordinate_terms {_RELATED}, synonyms {_RELATED}, translations {_TRANSLATED}, _corrupt_record STRING"
)
SENTENCES_JSON = "id LONG, text STRING, lang STRING, license STRING, translations ARRAY<ARRAY<STRUCT<id LONG, text STRING, lang STRING, license STRING>>>"
#: The row about a pack; ``files`` has those of its sorted tables, with their least and largest keys.
PACK = "pack_id STRING, name STRING, version STRING, schema_version INT, languages ARRAY<STRING>, entry_count LONG, manifest STRING, files ARRAY<STRUCT<table STRING, name STRING, low STRING, high STRING>>"
TERM = "entry_rowid LONG, term STRING, term_type STRING, loose_key STRING, term_rev STRING, id STRING, lemma STRING, language STRING, pos STRING"
ID = "id STRING, entry_rowid LONG"
SCHEMA_VERSION = 2
