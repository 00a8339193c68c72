import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from verbarium.functions import normalize, text
from verbarium.__main__ import main
from verbarium.operators import importing, measure, packaging, packs, search
from verbarium.operators.search import SearchEngine, Settings
from verbarium.plans import lookup
from verbarium.sources import files, readers

SOURCES = [{"id": "t", "name": "Test", "url": "", "license": "CC0", "attribution": ""}]


def made(id, language, lemma, forms=(), pos="noun", definition="test sense", example=None, pron=()):
    sense = {"id": f"{id}-s1", "definition": definition, "source_id": "t"}
    if example:
        sense["examples"] = [{"text": example, "translation": None, "source_id": "t"}]
    return {"id": id, "language": language, "lemma": lemma, "pos": pos, "pronunciations": [{"ipa": i, "type": k, "source_id": "t"} for i, k in pron], "senses": [sense], "forms": [{"form": f, "type": k, "source_id": "t"} for f, k in forms]}


@pytest.fixture
def build(spark, tmp_path):
    def run(name, entries, languages=("en",), version=2):
        m, e, out = tmp_path / f"{name}.json", tmp_path / f"{name}.jsonl", str(tmp_path / "packs" / name)
        m.write_text(json.dumps({"id": name, "name": name, "version": "1", "schema_version": version, "languages": list(languages), "sources": SOURCES}))
        e.write_text("\n".join(json.dumps(x) for x in entries) + "\n\n")
        packs.build_from_entries(spark, str(m), str(e), out)
        return out

    return run


@pytest.fixture
def engine(spark, build):
    def run(*given):
        found = SearchEngine(spark)
        for name, entries, *more in given:
            found.add_pack(build(name, entries, *more))
        return found

    return run


def ids(df):
    return [r.entry_id for r in df.collect()]


@pytest.mark.parametrize("word, lang, loose", [("año", "es", "año"), ("ano", "es", "ano"), ("col·lecció", "ca", "colleccio"), ("col.lecció", "ca", "colleccio"), ("straße", "de", "strasse"), ("cœur", "fr", "coeur"), ("أَنَا", "ary", "انا"), ("nǐhǎo", "zh", "nihao"), ("fiancée", "en", "fiancee"), ("ñu", "en", "nu"), ("łódź’s", "pl", "lodz’s")])
def test_loose_keys(spark, word, lang, loose):
    row = spark.range(1).select(normalize.loose_key(F.lit(word), lang).alias("a"), normalize.loose_key(F.lit(word), F.lit(lang)).alias("b")).first()
    assert (row.a, row.b) == (loose, loose)


def test_exact_key_composes_and_trims(spark):
    assert spark.range(1).select(normalize.exact_key(F.lit(" Café "))).first()[0] == "café"


def test_plan_functions():
    assert lookup.literal_suffix("*ight") == "ight" and lookup.literal_suffix("*t") is None and lookup.literal_suffix("l*ght") is None
    assert lookup.to_like("a_b%*?") == "a\\_b\\%%_"
    assert lookup.prefix_upper_bound("li") == "lj" and lookup.prefix_upper_bound("a\U0010ffff") == "b" and lookup.prefix_upper_bound("\U0010ffff") is None
    assert lookup.prefix_upper_bound("퟿") == ""


def test_rank_forms_wildcards_and_dedupe(engine):
    e = engine(("a", [made("l", "en", "light", [("lights", "plural"), ("lighting", "plural")]), made("n", "en", "night"), made("m", "en", "morning light")]))
    assert ids(e.suggest("light"))[0] == "l"
    assert e.suggest("lights").first().match_type == "form"
    assert "l" in ids(e.suggest("l?ght")) and set(ids(e.suggest("*ight"))) >= {"l", "n"}
    for q in ("morning l*t", "mornin* light"):
        assert "m" in ids(e.suggest(q))
    for q in ("light", "l*", "ligh"):
        assert len(ids(e.suggest(q))) == len(set(ids(e.suggest(q))))
    assert ids(e.suggest("")) == [] and ids(e.suggest("  ")) == []


def test_like_characters_are_literal(engine):
    e = engine(("a", [made("1", "en", "code"), made("2", "en", "c_de")]))
    assert ids(e.suggest("c_de"))[0] == "2" and ids(e.suggest("%")) == []


def test_accents_fold_and_loose_always_runs(engine):
    e = engine(("a", [made("f", "en", "fiancée"), made("s", "en", "strasser")]), ("b", [made("d", "de", "Straße")], ("de",)))
    assert "f" in ids(e.suggest("fiancee"))
    assert {"s", "d"} <= set(ids(e.suggest("strasse")))


def test_order_preferences_and_toggle(engine, tmp_path):
    e = engine(("zz", [made("z", "zh", "man")], ("zh",)), ("aa", [made("a", "en", "man", [("men", "plural")])]))
    e.set_pack_order(["zz"])
    assert ids(e.suggest("man"))[:2] == ["z", "a"]
    e.set_pack_order(["aa", "zz"])
    assert ids(e.suggest("man"))[:2] == ["a", "z"]
    assert e.set_pack_enabled("aa", False) and not e.set_pack_enabled("none", False)
    assert ids(e.suggest("man")) == ["z"] and e.get_entry("a") is None
    s = Settings()
    s.set_order(["zz", "aa"])
    s.set_enabled("aa", True)
    s.set_enabled("new", False)
    s.save(str(tmp_path / "s.json"))
    again = Settings.load(str(tmp_path / "s.json"))
    assert again.packs == s.packs and again.packs["new"]["priority"] == (1 << 63) - 1
    e.apply_preferences(again)
    assert e.list_packs()[0][0] == "zz" and e.list_packs()[1][2]
    (tmp_path / "bad.json").write_text("{")
    assert Settings.load(str(tmp_path / "bad.json")).packs == {} and Settings.load("/none").packs == {}


def test_phrase_search_and_hostile_input(engine):
    e = engine(("a", [made("dawn", "en", "dawn", definition="the first appearance of light", example="at the crack of dawn")]))
    assert e.suggest("appearance of light").first().match_type == "content"
    assert ids(e.suggest("crack of dawn")) == ["dawn"] and ids(e.suggest("dawn of crack")) == []
    for q in ('a "b', "' OR 1", "* *", "( )", "- -"):
        e.suggest(q).collect()


def test_get_entry_restores_default_source(spark, engine, build):
    e = engine(("a", [made("l", "en", "light")]))
    stored = spark.read.parquet(e.packs[0].path + "/entries").first()
    assert stored.senses[0].source_id == ""
    assert e.get_entry("l")["senses"][0]["source_id"] == "t" and e.get_entry("none") is None


def test_newer_format_and_bad_lines(spark, build, tmp_path):
    with pytest.raises(ValueError, match="newer"):
        build("new", [made("l", "en", "light")], ("en",), 3)
    with pytest.raises(ValueError, match="repeated"):
        build("twice", [made("l", "en", "a"), made("l", "en", "b")])
    with pytest.raises(Exception):
        build("bad", [{"id": "x"}])
    e = SearchEngine(spark)
    assert e.load_directory(str(tmp_path / "none")) == 0 and e.load_errors


def test_batch_agrees_with_single(spark, engine):
    e = engine(
        ("a", [made("l", "en", "light", [("lights", "plural")]), made("g", "en", "lightning"), made("x", "en", "Li"), made("d", "en", "dawn", definition="the first appearance of light", example="at the crack of dawn"), made("c", "en", "c_de"), made("f", "en", "fiancée")]),
        ("b", [made("s", "de", "Straße", definition="appearance of light in a street"), made("o", "de", "light")], ("de",)),
    )
    texts = ["light", "li", "l", "", "l?ght", "*ight", "l*t", "*", "?i*", "*n*", "c_*", "fiancee", "STRASSE", "appearance of light", "crack of dawn", "of of", "* *", "- -", "%", "x y"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id INT, raw STRING")
    for limit in (10, 1):
        got = {}
        for r in e.suggest_batch(asked, limit).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.entry_id, r.matched_term, r.match_type))
        want = {i: [(r.entry_id, r.matched_term, r.match_type) for r in e.suggest(q, limit).collect()] for i, q in enumerate(texts)}
        assert got == {i: x for i, x in want.items() if x}


def test_pack_invariants_and_coverage(spark, build):
    out = build("zh", [made("n", "zh", "你好", [("nihao", "transcription")], pron=[("nǐhǎo", "pinyin")]), made("s", "ary", "سلام", [("salam", "romanization")])], ("zh", "ary"))
    assert packs.validate_pack(spark, out).where("NOT ok").count() == 0
    assert sorted((r.term, r.term_type) for r in spark.read.parquet(out + "/terms").collect()) == sorted([("你好", "lemma"), ("nihao", "form"), ("nǐhǎo", "transcription"), ("سلام", "lemma"), ("salam", "form"), ("salam", "transcription")])
    row = packs.coverage(spark.read.parquet(out + "/entries")).first()
    assert (row.entries, row.ipa, row.examples, row.han_share) == (2, 1, 0, 0.5)


def test_dump_import(spark, tmp_path):
    lines = [
        {"word": " bank ", "lang_code": "en", "pos": "noun", "etymology_number": 1, "sounds": [{"ipa": "/uk/", "tags": ["UK"]}, {"ipa": "/us/", "tags": ["US"]}, {"mp3_url": "a.mp3"}], "senses": [{"glosses": ["a", "b"], "examples": [{"text": "x", "english": "y"}, {"text": " "}], "related": [{"word": "teller ("}]}, {"glosses": []}], "synonyms": [{"word": "shore", "roman": "r"}], "translations": [{"code": "de", "word": "Ufer"}, {"code": "", "lang_code": "fr", "word": "rive"}], "forms": [{"form": "banks", "tags": ["plural"]}, {"form": "b"}, {"form": "c", "tags": []}]},
        {"word": "bank", "lang_code": "en", "pos": "noun", "etymology_number": "1", "senses": [{"glosses": ["c"]}]},
        {"word": "hao", "lang_code": "cmn", "senses": [{"glosses": ["good"]}], "sounds": [{"zh-pron": "", "roman": "h"}]},
        {"word": 7, "senses": []},
        {"lang_code": "en"},
        {"word": "empty", "senses": []},
    ]
    m, d, out = tmp_path / "m.json", tmp_path / "d.jsonl", str(tmp_path / "pack")
    m.write_text(json.dumps({"id": "en", "schema_version": 2, "languages": ["en", "zh"], "sources": SOURCES}))
    d.write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n\n")
    stats = packs.build_from_dump(spark, str(m), str(d), out, "t")
    assert (stats.lines, stats.bad_lines, stats.entries, stats.id_collisions) == (7, 3, 3, 1)
    rows = {r.id: r for r in spark.read.parquet(out + "/entries").collect()}
    assert set(rows) == {"en:noun:bank:e1", "en:noun:bank:e1~2", "zh:hao"}
    one = rows["en:noun:bank:e1"]
    assert [p.ipa for p in one.pronunciations] == ["/us/", "/uk/", ""] and one.pronunciations[2].type == "audio"
    s = one.senses[0]
    assert (s.definition, s.id, s.collocations, s.synonyms) == ("a; b", "en:noun:bank:e1:s1", ["teller"], ["shore (r)"])
    assert [(t.target_lang, t.text) for t in s.translations] == [("de", "Ufer")] and s.examples[0].translation == "y"
    assert [(f.form, f.type) for f in one.forms] == [("banks", "plural"), ("b", "form"), ("c", "")]
    assert rows["zh:hao"].pronunciations == [] and len(one.senses) == 1


def test_sentence_merge(spark, build, tmp_path):
    pack = build("ca", [made("l", "ca", "llum", [("llums", "plural")]), made("n", "ca", "nit")], ("ca",))
    s, k = tmp_path / "s.tsv", tmp_path / "k.tsv"
    s.write_text("".join(f"{i}\tcat\tLa llum {i} i llums.\n" for i in range(1, 6)) + "9\teng\tThe light.\nx\tcat\tllum\n8\tdeu\tLicht\nshort\n")
    k.write_text("1\t9\n1\t8\n2\t8\n2\t9\n")
    out = str(tmp_path / "merged")
    assert packs.merge_sentences(spark, pack, str(s), str(k), "ca", out) == 3
    rows = {r.id: r for r in spark.read.parquet(out + "/entries").collect()}
    assert [(e.source_id, e.translation) for e in rows["l"].senses[0].examples] == [("tatoeba:1", "The light."), ("tatoeba:2", None), ("tatoeba:3", None)]
    assert not rows["n"].senses[0].examples and spark.read.parquet(out + "/sources").count() == 2
    credit = spark.read.parquet(out + "/sources").where("id = 'tatoeba'").first()
    assert credit.license == readers.SENTENCE_LICENSE and "contributors" in credit.attribution
    with pytest.raises(ValueError):
        packs.merge_sentences(spark, pack, str(s), str(k), "fr", out)


def test_text_functions(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    assert f(text.edge_strip(F.lit("  “Hello,  world!” "))) == "Hello, world" and f(text.edge_strip(F.lit("-a"))) == "-a"
    assert f(text.lookup_label(F.lit("a" * 41))) == "Look up “" + "a" * 39 + "…”"
    assert f(text.word_at(F.lit("una col·lecció d'art"), F.lit(6))) == "col·lecció"
    assert f(text.tokenize(F.lit("Don't 'x' a-b I —"))) == ["don't", "x", "a-b"]


def test_package_and_install(spark, build, tmp_path):
    pack, out = build("a", [made("l", "en", "light")]), str(tmp_path / "release")
    row = packaging.package(spark, [pack], out).first()
    assert (row.pack_id, row.languages, row.entries) == ("a", "en", 1) and row.raw_bytes > 0
    listed = {r["name"] for r in packaging.read_sums(spark, f"{out}/SHA256SUMS").collect()}
    assert listed and all(n.startswith("a/") and n.endswith(".gz.parquet") for n in listed)
    to = str(tmp_path / "to")
    assert packaging.install(spark, f"{out}/a", to, f"{out}/SHA256SUMS") and not packaging.install(spark, f"{out}/a", to)
    assert spark.read.parquet(f"{to}/entries").count() == 1
    bad = tmp_path / "bad"
    bad.write_text("".join(f"{'0' * 64}  {n}\n" for n in listed) + "not a sum line\n")
    with pytest.raises(ValueError, match="checksum"):
        packaging.install(spark, f"{out}/a", to, str(bad))
    with pytest.raises(ValueError, match="not a valid"):
        packaging.install(spark, build("e", []), to)
    assert spark.read.parquet(f"{to}/entries").count() == 1


def test_manifest_warnings_and_command_line(spark, build, tmp_path, capsys):
    dump = tmp_path / "dump"
    dump.write_bytes(b"x" * (1 << 20) + b"rest")
    assert files.sha256(str(dump), 1) == hashlib.sha256(b"x" * (1 << 20)).hexdigest() and files.sha256(str(dump)) != files.sha256(str(dump), 1)
    made_ = packaging.make_manifest("de", "Deutsch", "Edition", "", str(dump), "CC0", "src", "today")
    assert made_["id"] == "src-de" and "today" in made_["sources"][0]["attribution"]
    pack = build("zh", [made("n", "zh", "nihao")], ("zh", "en"))
    assert packs.coverage_warnings(spark, pack).count() == 3
    assert main(["unknown"]) == 2 and main(["lookup"]) == 2
    assert main(["inspect", pack]) == 0 and "lemma: 1" in capsys.readouterr().out
    assert main(["lookup", "nih", "5", str(tmp_path / "packs")]) == 0 and "nihao" in capsys.readouterr().out
    assert main(["coverage", pack]) == 0 and "warning" in capsys.readouterr().out
    found = SearchEngine(spark).load_directories([str(tmp_path / "none"), str(tmp_path / "packs")])
    assert found["loaded"] == 1 and found["errors"] == []


def test_numbers_and_percentiles(spark):
    rows = [("a", float(i % 7)) for i in range(50)] + [("b", 3.0)] * 9 + [("c", float(i)) for i in range(1000)] + [("d", None)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    got = {r.k: (round(r["mean"], 6), r.p50, r.p95) for r in measure.nearest_rank(df, "k", "v", {"p50": 0.5, "p95": 0.95}).collect()}
    want = {}
    for k in "abc":
        vs = sorted(v for x, v in rows if x == k)
        want[k] = (round(sum(vs) / len(vs), 6), *(vs[int((len(vs) - 1) * p + 0.5)] for p in (0.5, 0.95)))
    assert got == want
    keyed = spark.createDataFrame([(None if i % 3 == 0 else i % 3, i) for i in range(40)], "k INT, at LONG")
    numbered = measure.number_within(keyed, ["k"], "at", F.shiftright("at", 3), "n").collect()
    assert {r.at: r.n for r in numbered} == {i: i // 3 + (i % 3 == 0) + (i % 3 != 0) for i in range(40)}


def test_sentence_records(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps([{"id": 1, "text": "hola", "lang": "spa", "translations": [[{"id": 2, "text": "salut", "lang": "fra", "license": "X"}], [{"id": 3, "text": "hi", "lang": "eng"}]]}, {"id": 4, "text": "solo", "lang": "spa", "translations": []}]))
    records = readers.read_sentence_json(spark, str(p))
    pairs = {r.target_id: (r.license, r.attribution) for r in readers.sentence_pairs(records).collect()}
    assert pairs[2][0] == "X" and pairs[3][0] == readers.SENTENCE_LICENSE and pairs[3][1].endswith("#1 -> #3")
    of = lambda lang: {r.source_id: r.translation for r in readers.sentence_examples(records, lang).collect()}
    assert of("eng") == {"tatoeba:1": "hi", "tatoeba:4": None} and of(None)["tatoeba:1"] == "salut" and of("deu")["tatoeba:1"] is None


def test_entry_view_and_speech(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    forms = F.from_json(F.lit(json.dumps([{"form": "a", "type": "plural"}, {"form": "b", "type": ""}, {"form": "c", "type": "Canonical"}, {"form": "d", "type": "plural"}, {"form": "d", "type": "dual"}])), "array<struct<form:string,type:string>>")
    assert [(x.form, x.type) for x in f(text.display_forms(forms, F.lit("a")))] == [("d", "plural")]
    said = F.from_json(F.lit('[{"ipa": "x", "audio": null}, {"ipa": "", "audio": "m.mp3"}]'), "array<struct<ipa:string,audio:string>>")
    assert [x.ipa for x in f(text.spoken(said))] == ["x"] and [x.audio for x in f(text.recordings(said))] == ["m.mp3"]
    assert f(text.voice_for(F.lit("ary"))) == "ar-MA-MounaNeural" and f(text.voice_for(F.lit("xx"))) is None
    assert f(text.speech_time(F.lit(1789324820))) == "Sun Sep 13 2026 18:40:20 GMT+0000 (Coordinated Universal Time)"
    ticks = (1789324820 + 11_644_473_600) // 300 * 300 * 10_000_000
    assert f(text.speech_token(F.lit(1789324820), "k")) == hashlib.sha256(f"{ticks}k".encode()).hexdigest().upper()
    assert f(text.speech_text(F.lit("<" * 601))) == "&lt;" * 600


def test_packs_without_an_index_search_inside_terms(spark, engine):
    e = engine(("a", [made("m", "en", "early morning light")]))
    assert [r.match_type for r in e.suggest("morning light").collect()] == ["content"]
    files.delete(e.packs[0].path + "/postings")
    again = SearchEngine(spark)
    again.add_pack(e.packs[0].path)
    assert [r.matched_term for r in again.suggest("morning light").collect()] == ["early morning light"]
    asked = spark.createDataFrame([(1, "morning light")], "query_id INT, raw STRING")
    assert [r.entry_id for r in again.suggest_batch(asked).collect()] == ["m"]


def test_lookups_push_down(spark, build):
    terms = spark.read.parquet(build("a", [made("l", "en", "light")]) + "/terms")
    plan = lambda c: terms.where(c)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,l)" in plan(lookup.glob("l*t"))
    assert "StringStartsWith(term_rev,thgi)" in plan(lookup.glob("*ight"))
    assert "EqualTo(term,light)" in plan(F.col("term") == "light")


def test_forms_are_kept_as_they_stand(spark, tmp_path):
    d = tmp_path / "d.jsonl"
    d.write_text(json.dumps({"word": "x", "senses": [{"glosses": ["a"]}], "forms": [{"form": " f "}, {"form": ""}, {"form": None}], "sounds": [{"ipa": "/i/", "tags": [None]}], "lang_code": "en"}))
    records, _ = readers.read_dump(spark, str(d))
    row = importing.dump_to_entries(records, "s").first()
    assert [f.form for f in row.forms] == [" f ", ""] and [p.ipa for p in row.pronunciations] == ["/i/"]


def test_a_build_that_fails_leaves_the_old_pack(spark, build, monkeypatch):
    out = build("a", [made("l", "en", "light")])
    tables = packs.tables_of(out)
    assert set(tables) == set(packs.TABLES) and spark.read.parquet(f"{out}/totals").count() == 1
    monkeypatch.setattr(packs, "postings", lambda entries: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        build("a", [made("n", "en", "night")])
    assert [r.id for r in spark.read.parquet(f"{out}/entries").collect()] == ["l"] and not files.is_dir(f"{out}.part")
    monkeypatch.undo()
    monkeypatch.setattr(packs, "search_terms", lambda entries, composed: entries.select((F.col("entry_rowid") + 7).alias("entry_rowid"), F.lit("x").alias("term"), F.lit("lemma").alias("term_type"), F.lit("x").alias("loose_key"), F.lit("x").alias("term_rev")))
    with pytest.raises(ValueError, match="orphans"):
        build("a", [made("n", "en", "night")])
    assert [r.id for r in spark.read.parquet(f"{out}/entries").collect()] == ["l"]


def test_repeated_sources(spark, tmp_path):
    m, d = tmp_path / "m.json", tmp_path / "d.jsonl"
    m.write_text(json.dumps({"id": "en", "schema_version": 2, "languages": ["en"], "sources": SOURCES * 2}))
    d.write_text(json.dumps({"word": "x", "senses": [{"glosses": ["a"]}]}))
    with pytest.raises(ValueError, match="source"):
        packs.build_from_dump(spark, str(m), str(d), str(tmp_path / "p"), "t")


def test_compaction_old_layout_and_preferences(spark, build, engine, tmp_path):
    e = engine(("a", [made(f"w{i}", "en", f"word{i}") for i in range(30)]), ("b", [made("l", "en", "light")]))
    path = e.packs[0].path
    before = sorted(map(tuple, spark.read.parquet(f"{path}/terms").collect()))
    packs.compact(spark, path)
    assert sorted(map(tuple, spark.read.parquet(f"{path}/terms").collect())) == before and packs.validate_pack(spark, path).where("NOT ok").count() == 0
    ids_ = spark.read.parquet(f"{path}/entries").select("entry_rowid", F.col("id").alias("entry_id"))
    spark.read.parquet(f"{path}/terms").join(ids_, "entry_rowid").drop("entry_rowid").write.parquet(str(tmp_path / "old_terms"))
    files.replace(str(tmp_path / "old_terms"), f"{path}/terms")
    assert ids(e.suggest("word7")) == ["w7"] and e.entry_total() == 31
    e.set_pack_order(["b"])
    e.set_pack_enabled("a", False)
    e.save_preferences("")
    e.save_preferences(str(tmp_path / "s.json"))
    assert Settings.load(str(tmp_path / "s.json")).packs == {"b": {"priority": 0, "enabled": True}, "a": {"priority": 1, "enabled": False}}


def test_top_hit_opens_itself(spark, engine):
    e = engine(("a", [made("l", "en", "Light", [("lights", "plural")])]))
    asked = spark.createDataFrame([(1, "LIGHT"), (2, "lights"), (3, "ligh")], "query_id INT, raw STRING")
    found = search.opens(e.suggest_batch(asked).join(asked, "query_id"), F.col("raw"))
    assert {r.query_id: r.opens for r in found.collect()} == {1: True, 2: False, 3: False}


def test_long_prefixes_in_a_batch(spark, engine):
    e = engine(("a", [made("l", "en", "incomprehensibility"), made("m", "en", "incomprehensible")]))
    asked = spark.createDataFrame([(1, "incomprehensib"), (2, "incomprehensibi"), (3, "*hensibility"), (4, "i")], "query_id INT, raw STRING")
    got = {}
    for r in e.suggest_batch(asked).collect():
        got.setdefault(r.query_id, set()).add(r.entry_id)
    assert got == {1: {"l", "m"}, 2: {"l"}, 3: {"l"}, 4: {"l", "m"}}


def one_by_one(bases):
    """Ids as they come: each base, or the first of its copies' names that is free."""
    have, out = set(), []
    for b in bases:
        k = 1
        while (name := b if k == 1 else f"{b}~{k}") in have:
            k += 1
        have.add(name)
        out.append((name, k))
    return out


def test_ids_that_meet(spark):
    rng = random.Random(4)
    tables = [["x", "x", "x~2"], ["x~2", "x", "x"], ["x", "x~2", "x~2", "x", "x"], ["x~2~2", "x~2", "x", "x", "x~2"], ["x~02", "x~1", "x", "x", "x", "~2", "", ""]]
    for _ in range(6):
        tables.append([rng.choice(["x", "x", "x", "x~2", "x~3", "x~4", "x~5", "x~2~2", "x~3~2", "x~2~2~3", "y", "y~7", "x\n", "x\n~2"]) for _ in range(60)])
    rows = [(i * 1000 + j, f"{i}{b}") for i, t in enumerate(tables) for j, b in enumerate(t)]
    got = {r.line_no: (r.id, r.copy) for r in importing.disambiguate(spark.createDataFrame(rows, "line_no LONG, base_id STRING").repartition(3)).collect()}
    want = {i * 1000 + j: x for i, t in enumerate(tables) for j, x in enumerate(one_by_one([f"{i}{b}" for b in t]))}
    assert got == want and len({name for name, _ in got.values()}) == len(got)


def test_a_dump_with_ids_that_meet_builds(spark, tmp_path):
    words = ["x", "x", "x~2", "x", "x~2"]
    m, d, out = tmp_path / "m.json", tmp_path / "d.jsonl", str(tmp_path / "pack")
    m.write_text(json.dumps({"id": "en", "schema_version": 2, "languages": ["en"], "sources": SOURCES}))
    d.write_text("".join(json.dumps({"word": w, "lang_code": "en", "senses": [{"glosses": ["g"]}]}) + "\n" for w in words))
    stats = packs.build_from_dump(spark, str(m), str(d), out, "t")
    made_ = one_by_one([f"en:{w}" for w in words])
    assert [r.id for r in spark.read.parquet(f"{out}/entries").orderBy("entry_rowid").collect()] == [name for name, _ in made_]
    assert stats.id_collisions == sum(k - 1 for _, k in made_) and (stats.lines, stats.entries, stats.terms, stats.indexed, stats.transcription_terms) == (5, 5, 5, 5, 0)
    assert not files.is_dir(f"{out}.read") and not files.is_dir(f"{out}.part")


def test_a_dump_in_files_of_different_sizes_builds_as_one(spark, tmp_path):
    """Order is by name and place in a file, not by how files are dealt to tasks."""
    lines = [json.dumps({"word": f"w{i % 40}", "lang_code": "en", "senses": [{"glosses": [f"g{i} " + "x" * (i // 10)]}]}) for i in range(900)]
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"id": "en", "schema_version": 2, "languages": ["en"], "sources": SOURCES}))
    (tmp_path / "one").mkdir()
    (tmp_path / "many").mkdir()
    (tmp_path / "one" / "all.jsonl").write_text("\n".join(lines))
    for name, part in (("a", lines[:50]), ("b", lines[50:300]), ("c", lines[300:])):
        (tmp_path / "many" / f"{name}.jsonl").write_text("\n".join(part) + "\n")
    found = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        for kind in ("one", "many"):
            packs.build_from_dump(spark, str(m), str(tmp_path / kind), str(tmp_path / f"pack-{kind}"), "t", 700)
            found.append([(r.entry_rowid, r.id, r.d) for r in spark.read.parquet(str(tmp_path / f"pack-{kind}" / "entries")).selectExpr("entry_rowid", "id", "senses[0].definition AS d").orderBy("entry_rowid").collect()])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] and [d.split()[0] for *_, d in found[0]] == [f"g{i}" for i in range(700)]
    for i, text_ in (("s1", "5\t8\n"), ("s2", "5\t7\n5\t6\n" + "9\t9\n" * 5000)):
        (tmp_path / "links").mkdir(exist_ok=True)
        (tmp_path / "links" / i).write_text(text_)
    assert {r.a: r.b for r in packs.first_links(readers.read_links(spark, str(tmp_path / "links"))).collect()} == {5: 8, 9: 9}


def test_lookups_read_the_files_of_their_keys_alone(spark, tmp_path):
    """A pack in many files: a lookup names few of them, pushes its keys into the scan, and finds what a whole scan finds."""
    entries = [made(f"w{i:04d}", "en", f"{'abcdefgh'[i % 8]}word{i:04d}tion" if i % 3 else f"{'äbcdefgh'[i % 8]}ord {i:04d}", [(f"f{i}x", "form")]) for i in range(400)]
    m, e, out = tmp_path / "m.json", tmp_path / "e.jsonl", str(tmp_path / "pack")
    m.write_text(json.dumps({"id": "big", "schema_version": 2, "languages": ["en"], "sources": SOURCES}))
    e.write_text("\n".join(map(json.dumps, entries)))
    packs.build_from_entries(spark, str(m), str(e), out)
    for t in packs.tables_of(out):
        if t != "pack":
            packs._write(spark.read.parquet(f"{out}/{t}"), f"{out}.more", t, parts=12 if t in packs.SORTED else 1)
    packs._rewrite_pack_row(spark, out, f"{out}.more")
    files.replace(f"{out}.more", out)
    engine_ = SearchEngine(spark)
    engine_.add_pack(out)
    listed = engine_.packs[0].listed
    assert all(len(listed[t]) > 6 for t in packs.PROJECTIONS.values()) and len(listed["ids"]) > 6 and len(listed["entries"]) > 6
    opened = lambda: {key[1]: len(key[-1]) for key in engine_._opened}
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    engine_._opened.clear()
    found = engine_.probe_terms("bword0001", 40)
    assert {r.pack_idx for r in found.collect()} == {0} and "StringStartsWith(term,bword0001)" in plan_of(found) and "StringStartsWith(loose_key,bword0001)" in plan_of(found) and max(opened().values()) <= 2
    engine_._opened.clear()
    tail = engine_.probe_terms("*0001tion", 40)
    assert "StringStartsWith(term_rev,noit1000)" in plan_of(tail) and opened()["terms_rev"] <= 2 and ids(engine_.suggest("*0001tion")) == ["w0001"]
    engine_._opened.clear()
    assert engine_.get_entry("w0123")["lemma"] == entries[123]["lemma"] and engine_.get_entry("w012") is None and engine_.get_entry("zz") is None
    assert {k: n for k, n in opened().items() if k in ("ids",)} == {"ids": 1} and opened()["entries"] <= 2
    rows = engine_._listed_rows(engine_.packs[0], "entries", [5, 6], "id")
    assert "In(entry_rowid, [5,6])" in plan_of(rows)
    plain = SearchEngine(spark)
    plain.add_pack(out)
    plain.packs[0].listed = None
    for q in ("b", "bword0001", "aord", "*tion", "?w*9tion", "f12x", "ord 00", "ÄORD"):
        assert [tuple(r) for r in engine_.suggest(q).collect()] == [tuple(r) for r in plain.suggest(q).collect()], q


def test_batch_of_many_shapes_agrees_with_single(spark, engine):
    """Prefixes beyond the longest beginning, patterns of every shape, hot beginnings, packs with and without an index."""
    rng = random.Random(8)
    long = "incomprehensib" * 12
    words = [long + x for x in ("a", "ab", "b")] + [rng.choice("ab") + "".join(rng.choice("abc") for _ in range(rng.randrange(0, 9))) for _ in range(150)] + ["a b", "b ab a", "ab%c", "a_c", "a\\b"]
    entries = [made(f"i{k}", "en", w) for k, w in enumerate(dict.fromkeys(words))]
    e = engine(("a", entries[::2]), ("b", entries[1::2] + [made("q", "de", "Straße")], ("de",)))
    files.delete(e.packs[1].path + "/postings")
    e.packs[1].indexed = False
    texts = [long, long + "a", long[:100], "*" + long[-90:] + "b", "a", "b", "ab", "abc", "*", "**", "?", "??", "?*", "*???", "????????????*", "a*", "*a", "*b*", "a*c", "?b*", "*ab*c", "a?b", "*aa*bb*", "%", "ab%*", "a_*", "a\\*", "a b", "*a b*", "ab a", "zz*", "STRASSE", "str*e"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id INT, raw STRING")
    got = {}
    for r in e.suggest_batch(asked, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.entry_id, r.matched_term, r.match_type))
    want = {i: [(r.entry_id, r.matched_term, r.match_type) for r in e.suggest(q, 6).collect()] for i, q in enumerate(texts)}
    assert got == {i: x for i, x in want.items() if x}


def test_a_replacement_that_breaks_off_leaves_the_old_pack(spark, build, monkeypatch):
    out = build("a", [made("l", "en", "light")])
    move, moved = files._move, []

    def lost(store, at, to):
        if at.endswith(files.NEW):
            raise RuntimeError("lost")  # after the old pack was set aside
        move(store, at, to)

    monkeypatch.setattr(files, "_move", lost)
    with pytest.raises(RuntimeError):
        build("a", [made("n", "en", "night")])
    monkeypatch.undo()
    assert not files.is_dir(out) and files.is_dir(out + files.OLD)
    e = SearchEngine(spark)
    assert e.load_directory(out.rsplit("/", 1)[0]) == 1 and ids(e.suggest("light")) == ["l"] and not files.is_dir(out + files.OLD)
    assert build("a", [made("n", "en", "night")]) == out and ids(e.suggest("night")) == ["n"] and ids(e.suggest("light")) == [] and not moved


def test_a_store_that_cannot_move_folders(spark, build, monkeypatch):
    out = build("a", [made("l", "en", "light")])
    e = SearchEngine(spark)
    e.add_pack(out)

    def refuse(store, at, to):
        raise OSError("no folders here")

    monkeypatch.setattr(files, "_move", refuse)
    build("a", [made("n", "en", "night"), made("o", "en", "night owl")])
    assert ids(e.suggest("night")) == ["n", "o"] and ids(e.suggest("light")) == [] and e.entry_total() == 2
    assert spark.read.parquet(f"{out}/entries").count() == 2 and spark.read.parquet(f"{out}/pack").count() == 1 and not files.is_dir(f"{out}{files.NEW}")


def test_ranked_search_by_blocks(spark, build, monkeypatch):
    """The best by blocks are the best of all; blocks that cannot reach them are not scored."""
    monkeypatch.setattr(packs, "BLOCK_ROWS", 16)
    monkeypatch.setattr(packs, "FIRST_BLOCKS", 2)
    rng = random.Random(6)
    text_ = lambda i: " ".join(["the"] * rng.randrange(1, 4) + ["of the"] * (rng.random() < (0.9 if i < 40 else 0.1)) + ["x"] * rng.randrange(0, 60) + [rng.choice(["rare", "y"])])
    out = build("a", [made(f"i{i:03d}", "en", f"w{i}", definition=text_(i)) for i in range(400)])
    read = {t: spark.read.parquet(f"{out}/{t}") for t in (*packs.INDEX, "blocks")}
    counts = {r.token: r.df for r in read["frequencies"].collect()}
    assert counts == {r.token: r.n for r in read["postings"].groupBy("token").agg(F.count_distinct("entry_rowid").alias("n")).collect()}
    scored, real = [], packs._within
    monkeypatch.setattr(packs, "_within", lambda post, blocks: scored.extend(blocks) or real(post, blocks))
    for tokens in (["the"], ["rare", "the"], ["of", "the"], ["none", "the"], ["w7"]):
        every = packs.bm25(spark, out, tokens).orderBy(F.desc("score"), "entry_rowid").limit(10).collect()
        got = packs.bm25_top(spark, out, tokens, 10).collect()
        assert [r.entry_rowid for r in got] == [r.entry_rowid for r in every] and all(abs(a.score - b.score) < 1e-9 for a, b in zip(got, every)), tokens
    assert 0 < len(scored) < 5 * 25
    e = SearchEngine(spark)
    e.add_pack(out)
    by_blocks = [tuple(r) for r in e.suggest("of the", 5).collect()]
    monkeypatch.setattr(packs, "FIRST_BLOCKS", 10_000)
    assert by_blocks and by_blocks == [tuple(r) for r in e.suggest("of the", 5).collect()]
