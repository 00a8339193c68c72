"""What queries keep on disk besides their results."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from verbarium import samples
from verbarium.operators import importing, measure, packs
from verbarium.sources import files, readers

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_the_dump_is_no_larger_than_a_few_times_its_tables(spark, monkeypatch):
    """Files of a bounded number of lines, compressed; entries do not depend on how many there are."""
    monkeypatch.setattr(samples, "DUMP_LINES", 400)
    few, many = samples.of(spark, SF), samples.Samples(spark, SF)
    assert files.size(many.dump()) < 3 * sum(os.path.getsize(f"{SF}/{t}.parquet") for t in ("orders", "lineitem"))
    assert spark.read.text(many.dump()).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 400
    lines = lambda s: spark.read.text(s.dump()).agg(F.count("*"), F.sum(F.crc32("value"))).first()
    assert lines(few) == lines(many)
    got = entry.queries()["nested_entry_build"](spark, SF)
    monkeypatch.setitem(samples._made, (spark.sparkContext.applicationId, SF), many)
    again = entry.queries()["nested_entry_build"](spark, SF)
    assert got.count() == again.count() > 0 and got.exceptAll(again).isEmpty()


def test_entry_view_reads_a_compressed_dump(spark):
    made = samples.of(spark, SF)
    assert entry.queries()["entry_view"](spark, SF).count() > 0
    names = [f for f in os.listdir(made.dump().removeprefix("file://")) if f.startswith("part-")]
    assert names and all(n.endswith(".gz") for n in names)


def test_numbering_shuffles_rows_once(spark):
    """A key may be null; ranks and the join that sets them off share a shuffle."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    rows = spark.range(1000).select(F.col("id").alias("line"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("key"), F.repeat(F.lit("x"), 50).alias("wide"))
    out = measure.number_within(rows, ["key"], "line", F.shiftright("line", 7), "n")
    plan = out._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sum("Exchange hash" in x for x in plan.split("\n")) == 4  # of rows, of counts, of counts by key, of those by key and chunk
    assert {(r.line, r.n) for r in out.collect()} == {(x, x // 3 + 1) for x in range(1000)}


def test_a_build_leaves_no_shuffle_files(spark, monkeypatch):
    """They go with each job, and what a later table is made of goes when that is written."""
    key, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    before = spark.conf.get(key)
    write = packs._write

    def watched(df, folder, table, *args, **kwargs):
        seen.append((table, spark.conf.get(key), files.is_dir(f"{folder}/_raw"), files.is_dir(f"{folder}/_terms")))
        write(df, folder, table, *args, **kwargs)

    monkeypatch.setattr(packs, "_write", watched)
    fresh = samples.Samples(spark, SF)
    assert fresh.stats("orders").entries > 0 and spark.conf.get(key) == before
    assert seen and all(on == "true" for _, on, _, _ in seen) and not files.is_dir(fresh.scratch.path("packs/orders.read"))
    assert {t for t, _, raw, _ in seen if raw} == {"entries"} and not any(terms for t, _, _, terms in seen if t in ("lengths", "postings", "blocks", "pack"))


def test_entries_are_numbered_where_they_lie(spark, tmp_path):
    """Lines of a dump become entries without a shuffle of them; rows in any other order are sorted first, those of a reader that were dealt anew too."""
    dump = tmp_path / "dump"
    for name, n in (("b", 300), ("a", 50), ("c", 700)):
        spark.range(n).select(F.format_string('{"word": "%s%d", "senses": [{"glosses": ["' + "x" * 200 + '"]}]}', F.lit(name), "id").alias("value")).coalesce(1).write.text(str(dump / name))
    records, _ = readers.read_dump(spark, str(dump / "*"))
    entries = importing.dump_to_entries(records, "t")
    want = [f"{n}{i}" for n, k in (("a", 50), ("b", 300), ("c", 700)) for i in range(k)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30k")
    try:
        numbered = packs._numbered(entries, str(tmp_path / "raw"))
        assert not (tmp_path / "raw_sorted").exists()
        dealt = packs._numbered(entries.repartition(3), str(tmp_path / "dealt"))
        assert (tmp_path / "dealt_sorted").exists()
        longs = packs._numbered(entries.select(F.xxhash64("lemma").alias("line_no"), "lemma"), str(tmp_path / "longs"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for rows in (numbered, dealt):
        assert [(r.entry_rowid, r.lemma) for r in rows.orderBy("entry_rowid").collect()] == list(enumerate(want, 1))
    hashes = [r[0] for r in longs.orderBy("entry_rowid").select(F.xxhash64("lemma")).collect()]
    assert hashes == sorted(hashes) and [r[0] for r in longs.select("entry_rowid").orderBy("entry_rowid").collect()] == list(range(1, 1051))


def test_stretches_leave_the_same_table(spark, tmp_path, monkeypatch):
    """A large table is shuffled stretch by stretch; its files are ranges of the key as before."""
    rows = spark.range(3000).select(F.concat(F.substring(F.md5(F.col("id").cast("string")), 1, 6), F.when(F.col("id") % 50 == 0, "é").otherwise("")).alias("token"), F.col("id").alias("entry_rowid"), F.lit("x").alias("col"))
    cut = packs._stretches(rows, "token", 3000, 400)
    assert len(cut) > 5 and cut[0][0] is None and cut[-1][1] is None and packs._stretches(rows, "token", 3000, 3000) == [(None, None)]
    packs._write_stretches(rows, str(tmp_path), "postings", cut)
    got = spark.read.parquet(f"{tmp_path}/postings")
    assert got.count() == 3000 and got.exceptAll(rows).isEmpty()
    ranges = sorted((r.low, r.high) for r in got.groupBy(F.input_file_name()).agg(F.min("token").alias("low"), F.max("token").alias("high")).collect())
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
    monkeypatch.setattr(packs, "TERM_ROWS", 500)
    monkeypatch.setattr(packs, "POSTING_ROWS", 3000)
    parts = samples.Samples(spark, SF)
    for t in packs.TABLES:
        if t != "pack":
            assert spark.read.parquet(f"{parts.pack('orders')}/{t}").exceptAll(samples.of(spark, SF).read("orders", t)).isEmpty(), t


def test_what_reads_no_text_index_builds_none(spark, monkeypatch):
    fresh = samples.Samples(spark, SF)
    monkeypatch.setitem(samples._made, (spark.sparkContext.applicationId, SF), fresh)
    for name in ("coverage_report", "coverage_warnings", "default_source_roundtrip"):
        assert entry.queries()[name](spark, SF).count() > 0
    assert {k for k in fresh.known if k.startswith("packs/")} == {"packs/orders-plain", "packs/parts-plain", "packs/texts-en-plain"}
    assert not files.is_dir(fresh.scratch.path("orders-plain.dump")) and not any(files.is_dir(f"{fresh.pack(p)}/postings") for p in ("orders-plain", "texts-en-plain"))


def test_postings_hold_every_place(spark):
    """Grouped within a row, against places counted one by one."""
    texts = {1: ["a b a", "b a", None, "c a"], 2: ["", "", "", ""], 3: ["x", "é é x é", "x y", ""], 4: [None] * 4}
    words = spark.createDataFrame([(k, sum(len((t or "").split()) for t in ts), [(f, (t or "").split() if t is not None else None) for f, t in zip(packs.FIELDS, ts)]) for k, ts in texts.items()], "entry_rowid LONG, len LONG, tokens ARRAY<STRUCT<col STRING, ts ARRAY<STRING>>>")
    want = {}
    for k, ts in texts.items():
        for f, t in zip(packs.FIELDS, ts):
            for i, w in enumerate((t or "").split()):
                want.setdefault((w, k, f), []).append(i)
    weight = dict(zip(packs.FIELDS, packs.WEIGHTS))
    got = packs.postings(words).collect()
    assert {(r.token, r.entry_rowid, r.col): r.positions for r in got} == want and len(got) == len(want)
    assert all(r.tf == sum(weight[f] * len(at) for (w, k, f), at in want.items() if (w, k) == (r.token, r.entry_rowid)) for r in got)
    assert len([r for r in got if r["first"]]) == len({(w, k) for w, k, _ in want}) and sorted(r.entry_rowid for r in got if r.lead) == [1, 3]


def test_the_dump_is_made_in_stretches_of_orders(spark, tmp_path, monkeypatch):
    """Of a few line items' orders at a time, with those that have no key or no items; the lines are the same."""
    for t, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        rows = samples.table(spark, SF, t)
        rows.unionByName(rows.limit(3).withColumn(key, F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/{t}.parquet")
    lines = lambda s: spark.read.text(s.dump()).agg(F.count("*"), F.sum(F.crc32("value"))).first()
    whole = samples.Samples(spark, str(tmp_path))
    assert len(whole._order_stretches()) == 1 and lines(whole)[0] == spark.read.parquet(f"{tmp_path}/orders.parquet").count()
    monkeypatch.setattr(samples, "DUMP_ITEMS", 1000)
    cut = samples.Samples(spark, str(tmp_path))
    stretches = cut._order_stretches()
    assert len(stretches) == -(-spark.read.parquet(f"{tmp_path}/lineitem.parquet").count() // 1000) > 4
    items = [cut._dump(*s).select(F.explode(F.from_json("value", "senses ARRAY<STRING>")["senses"])).count() for s in stretches]
    assert all(0 < n < 2000 for n in items) and lines(cut) == lines(whole)


def test_lines_of_a_dump_are_parsed_once(spark):
    """Filters on a record's fields stay above the one place that parses its line."""
    for name in ("entry_view", "nested_entry_build"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1, name


def test_blocks_are_made_of_sorted_postings(spark, tmp_path, monkeypatch):
    """In one pass over each file of postings, whichever batches the rows come in; against groups of all rows."""
    monkeypatch.setattr(packs, "BLOCK_ROWS", 16)
    rows = spark.range(4000).select(F.concat(F.lit("t"), F.floor(F.sqrt(F.col("id") % 50)).cast("string")).alias("token"), F.floor(F.col("id") / 3).alias("entry_rowid"), F.element_at(F.array(*map(F.lit, packs.FIELDS)), (F.col("id") % 3 + 1).cast("int")).alias("col"))
    rows = rows.select("*", F.sequence(F.lit(1), (F.col("entry_rowid") % 4 + 1).cast("int")).alias("positions"), (F.col("entry_rowid") % 9 + 3).alias("len"))
    packs._write(rows, str(tmp_path), "postings", parts=5)
    assert len(files.parquets(f"{tmp_path}/postings")) > 1
    large, small = packs.blocks(spark, str(tmp_path), 5.0), packs.blocks(spark, str(tmp_path), 5.0, 7)
    assert "Exchange" not in large._jdf.queryExecution().executedPlan().toString()
    large, small = large.collect(), small.collect()
    share = packs.bm25_share(F.col("tf"), F.col("len"), F.lit(5.0))
    want = packs.weighted_tf(rows, "len").groupBy("token", F.floor(F.col("entry_rowid") / 16).alias("block")).agg(F.count("*").alias("n"), F.max(share).alias("top"))
    as_told = lambda rs: sorted((r.token, r.block, r.n, r.top) for r in rs)
    assert as_told(large) == as_told(small) == as_told(want.collect())


def test_files_are_listed_by_their_footers(spark, tmp_path, monkeypatch):
    """Ends of files are those of their rows; rows are read only where a footer does not tell."""
    made = samples.of(spark, SF).pack("parts")
    by_rows = [tuple(r) for t in packs.tables_of(made) if t in packs.SORTED for r in packs._read_ends(spark, made, t).collect()]
    read = []
    monkeypatch.setattr(packs, "_read_ends", lambda s, f, t, real=packs._read_ends: read.append(t) or real(s, f, t))
    assert packs.listing(spark, made) == sorted(by_rows) and not read
    long = spark.createDataFrame([("é" * 3000, 1), ("a", 2)], "token STRING, df LONG")  # no footer tells ends so long
    for t in packs.PLAIN[:2]:
        spark.read.parquet(f"{made}/{t}").limit(0).write.parquet(f"{tmp_path}/{t}")
    packs._write(long, str(tmp_path), "frequencies")
    got = packs.listing(spark, str(tmp_path))
    assert read == ["frequencies"] and {x for _, _, *ends in got for x in ends} >= {"é" * 3000, "a"}
