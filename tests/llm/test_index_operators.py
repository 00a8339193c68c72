"""Operators 11 to 13 against brute-force versions: sketches and links, ranked search, manifests; and op5 and op9 with many rows of one id."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_contracts import tables  # noqa: F401  a fixture
from test_operators import docs_of, prose
from verbarium.llm import hyperminhash, jaccard_join, lexical_search, merkle, packing, queries, toxicity


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# --- op11


def brute_links(rows, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(rows))]
    return Counter((rows[i][0], len(sets[i]), least[i], rows[i][0] == least[i]) for i in range(len(rows)))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def test_op11_tables(spark, tables):  # noqa: F811
    got = queries.queries()["op11_minhash"](spark, tables[0]).select("doc_id", "n_shingles", "component_id", "kept")
    assert rows_of(got) == brute_links(tables[1], 85)


@pytest.mark.parametrize("block", [2000, 5])
def test_op11_groups_near_the_threshold(spark, monkeypatch, block):
    """Chains, stars and groups whose members lie just above and below 0.85; short texts with common shingles; ties, nulls, copies."""
    monkeypatch.setattr(hyperminhash, "BLOCK", block)
    rng = random.Random(31 + block)
    rows = [(None, "a null id with some words here"), (None, "a null id with some words here"), (1, None), (2, ""), (3, "\t\n"), (4, "One Two"), (5, "one two"), (6, "éa b")]
    for g in range(14):
        n = rng.choice([5, 7, 9, 14, 60, 200, 700])
        base = [f"g{g}w{rng.randrange(5000)}" for _ in range(n)]
        for k in range(rng.choice([2, 9, 40])):
            at = edited(rng, base, rng.randrange(0, max(2, n // 60)))
            base = at if g % 3 == 0 else base  # chains
            rows.append((1000 * (g + 1) + k, " ".join(at)))
    rows += [(50_000 + i, "all rights reserved by us " + " ".join(f"x{i}y{j}" for j in range(i % 4))) for i in range(60)]
    rng.shuffle(rows)
    assert rows_of(hyperminhash.near_duplicates(docs_of(spark, rows).repartition(3))) == brute_links(rows, 85)


def test_op11_sketches(spark):
    rng = np.random.default_rng(7)
    for n, odd in ((6, 1), (13, 1), (300, 26), (4000, 350)):
        off, met = [], 0
        for _ in range(60):
            u = rng.permutation(np.unique(rng.integers(-(2**63), 2**63 - 1, n + 2 * odd, dtype=np.int64)))
            a, b = np.sort(u[: n + odd]), np.sort(np.concatenate([u[:n], u[n + odd :]]))
            x, y = hyperminhash.sketch(a), hyperminhash.sketch(b)
            met += any(p == q for p, q in zip(hyperminhash.band_keys(x), hyperminhash.band_keys(y)))
            off.append(hyperminhash.estimate(x, y, len(a), len(b))[0] - n / (n + 2 * odd))
            assert hyperminhash.promising(x, y, len(a), len(b)) or n / (n + 2 * odd) < 0.85
        assert met == 60 and abs(np.mean(off)) < 0.02 and np.std(off) < 0.05
    one = [hyperminhash.sketch(np.sort(rng.integers(-(2**63), 2**63 - 1, 3000, dtype=np.int64))) for _ in range(120)]
    chance = np.mean([(one[i] == one[j]).mean() for i in range(120) for j in range(i)])
    assert chance == pytest.approx(hyperminhash._chance(23, 23), rel=0.25) and not hyperminhash.sketch(np.zeros(0, np.int64)).any()


def test_op11_empty_and_large_group(spark):
    assert hyperminhash.near_duplicates(docs_of(spark, [])).count() == 0
    rng = random.Random(5)
    base = [f"w{rng.randrange(9000)}" for _ in range(400)]
    rows = [(i, " ".join(edited(rng, base, 2))) for i in range(5000)]
    got = hyperminhash.near_duplicates(docs_of(spark, rows)).groupBy("component_id").count().collect()
    assert [(r.component_id, r["count"]) for r in got] == [(0, 5000)]


# --- op12


def brute_search(docs, items, k=10):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    words = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    words = [x for x in words if x[2]]
    n_docs, total = len(words), sum(n for *_, n in words)
    df = Counter(w for _, c, _ in words for w in c)
    found = Counter()
    for item, t in items:
        scored = []
        for i, c, n in words:
            m = 100 - 90 + (90 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(terms(t)) if c[w])
            if score > 0:
                scored.append((-score, i is not None, i if i is not None else 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1):
            found[item, rank, i, -s] += 1
    return found


@pytest.mark.parametrize("chunk, block_terms", [(1_500_000, 400_000), (60, 9), (1, 400_000)])
def test_op12_against_brute_force(spark, monkeypatch, chunk, block_terms):
    monkeypatch.setattr(lexical_search, "CHUNK", chunk)
    monkeypatch.setattr(lexical_search, "ROUND", 2)
    rng = random.Random(41)
    docs = [(None, "w1 W2 w3"), (None, "w1 w2 w3"), (1, None), (2, ""), (3, "-- \x7f !"), (4, "É é w1" * 300), (7, "w5 w6")]
    docs += [(i, prose(rng, rng.choice([1, 8, 40]), 60)) for i in range(10, 200)] + [(500 + i, "w1 w2 w3 w4") for i in range(40)]
    items = [(1, prose(rng, 12, 60)), (1, "W1, w2; w1"), (None, "w3 É"), (2, None), (3, "none such"), (4, ""), (5, prose(rng, 70, 60))]
    rng.shuffle(docs)
    asked = spark.createDataFrame([(i, t, "mine", 3) for i, t in items], "item_id INT, text STRING, rank STRING, no INT")
    got = lexical_search.rank_documents(docs_of(spark, docs).withColumn("score", F.lit(1)).repartition(3), asked, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and rows_of(got) == brute_search(docs, items)


def test_op12_tables_and_empty_ones(spark):
    docs, items = docs_of(spark, [(1, "a b"), (2, None)]), spark.createDataFrame([(1, "b")], "item_id INT, text STRING")
    assert rows_of(lexical_search.rank_documents(docs, items)) == brute_search([(1, "a b")], [(1, "b")])
    for d, q in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id = 2"), items)):
        assert lexical_search.rank_documents(d, q).count() == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert lexical_search.rank_documents(named, items).first().doc_id == "d1"


def test_op12_stops_early():
    """Lists are read until nothing unmet can score more; of many documents few are looked up."""
    rng = np.random.default_rng(3)
    n = 20_000
    terms = [np.unique(rng.integers(0, 40, 6)) for _ in range(n)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
    times = rng.zipf(2.0, ends[-1]).clip(1, 500)
    import pyarrow as pa

    chunk = lexical_search.Chunk(pa.array(np.arange(n)), rng.integers(5, 400, n), ends, np.concatenate(terms), times, np.full(40, 3000), n, 200 * n)
    looked, real = [], chunk.scores
    chunk.scores = lambda docs, of: looked.append(len(docs)) or real(docs, of)
    docs, scores = chunk.best(np.array([3, 9, 17]), 0, 10)
    every = real(np.arange(n), np.array([3, 9, 17]))
    want = np.lexsort((np.arange(n), -every))[:10]
    assert docs.tolist() == want.tolist() and scores.tolist() == every[want].tolist() and sum(looked) < 3 * n // 10 and not chunk.seen.any()


# --- op13


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows, arity=2):
    """rows: (doc_id, source, lang, n_chars, text)."""
    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
        return out

    def steps(tree, i):
        for level in tree[:-1]:
            first = i // arity * arity
            yield level[first:i], level[i + 1 : first + arity]
            i //= arity

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, sha(*map(field, r)), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = [levels([leaf for *_, leaf, _ in sorted(by[k], key=lambda x: x[:3])]) for k in langs]
    crown = levels([t[-1][0] for t in trees])
    found = Counter()
    for g, k in enumerate(langs):
        for i, (*_, leaf, r) in enumerate(sorted(by[k], key=lambda x: x[:3])):
            path = [*steps(trees[g], i), *steps(crown, g)]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            now = sha(*map(field, (*r[:3], r[3] + 1 if bad and r[3] is not None else r[3], r[4])))
            for left, right in path:
                now = sha(*left, now, *right)
            found[r[0], leaf, trees[g][-1][0], crown[-1][0], sha(*(h for left, right in path for h in left + right)), now, now == crown[-1][0]] += 1
    return found


def manifest_rows():
    rng = random.Random(51)
    rows, i = [], 0
    for lang, n in (("en", 201), (None, 65), ("é", 64), ("de", 1), ("fr", 2), ("a", 3), ("z", 129)):
        for _ in range(n):
            i += rng.randrange(1, 4)
            rows.append((i, rng.choice([None, "s", "é"]), lang, rng.choice([None, 0, 7, -1]), rng.choice([None, "", "ünï " * rng.randrange(9), prose(rng, 300)])))
    rows += [(None, None, "en", 1, "x"), (None, None, "en", 1, "y"), rows[0], rows[0], (rows[0][0], "other", "en", 3, None), (-5, "-", "-", 2, "-")]
    rng.shuffle(rows)
    return rows


def test_op13_against_brute_force(spark, tmp_path):
    rows = manifest_rows()
    docs = spark.createDataFrame(rows, "doc_id LONG, source STRING, lang STRING, n_chars LONG, text STRING")
    clash = [F.lit("mine").alias(c) for c in ("leaf", "root", "id", "grp", "g", "i", "n", "block", "pres", "above", "path", "_tie", "tampered")]
    docs.select("*", *clash).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op13_merkle_manifest"](spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert rows_of(got) == brute_manifest(rows)


@pytest.mark.parametrize("arity, nodes", [(3, 64), (2, 4), (5, 30)])
def test_op13_other_runs_and_blocks(spark, monkeypatch, arity, nodes):
    monkeypatch.setattr(merkle, "NODES", nodes)
    rows = manifest_rows()
    docs = spark.createDataFrame(rows, "doc_id LONG, source STRING, lang STRING, n_chars LONG, text STRING").repartition(4)
    bad = merkle.leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    made = merkle.Manifest(docs, carry={"bad": F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, bad)}, arity=arity)
    assert rows_of(made.verify(F.coalesce("bad", "leaf"))) == brute_manifest(rows, arity)


def test_op13_empty_and_single(spark):
    schema = "doc_id LONG, source STRING, lang STRING, n_chars LONG, text STRING"
    none = merkle.Manifest(spark.createDataFrame([], schema))
    assert none.root is None and none.verify(F.col("leaf")).count() == 0
    row = (1, "s", None, 2, "ab")
    one = merkle.Manifest(spark.createDataFrame([row], schema)).verify(F.col("leaf")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha("") and one.verified


# --- many rows of one id


def test_op5_other_vocabularies(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [None, "", " a  b\n", "Don't stop 42 times, naïve café!", "x" * 300, "<|endoftext|> é"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.token_pieces(docs_of(spark, list(enumerate(texts))), vocabulary=public_tokenizers.path(name)).collect()}
        assert got == {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in enumerate(texts)}


def test_op5_and_op9_many_rows_of_one_id(spark):
    n = 200_000
    text = F.when(F.col("id") % 2 == 0, "one and the same").otherwise(F.concat(F.lit("number "), F.col("id").cast("string")))
    docs = spark.range(n).select(F.when(F.col("id") % 3 != 0, F.lit(7)).cast("long").alias("doc_id"), text.alias("text"))
    packed = packing.pack(packing.token_pieces(docs), rows_per_chunk=2000)
    held = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.countDistinct("offset").alias("places"), F.count("*").alias("pieces")).collect()
    assert sum(r.pieces for r in held) == n and all(r.n == r.end <= packing.MAX_LEN and r.places == r.pieces for r in held)
    toxic = docs.where("doc_id = 7").withColumn("text", F.concat(F.lit("scum "), "text"))
    some = toxic.unionByName(docs_of(spark, [(100 + i, f"plain words {i}") for i in range(50)]).select("doc_id", "text"))
    labels = spark.createDataFrame([(7, 1), (101, 0), (102, 0)], "doc_id LONG, toxic INT")
    scored = toxicity.score(some, toxicity.fit(some, labels))
    assert scored.count() == some.count() and scored.agg(F.min("score"), F.max("score")).first()[1] <= 1


def test_op10_names_that_clash_in_a_join(spark, monkeypatch):
    """Different sets with one 64-bit name are told apart through the whole join: workers see the module as it is, so the clash is told to the plan."""
    rng = random.Random(19)
    rows = [(i, prose(rng, 40, 3000)) for i in range(30)]
    rows += [(200 + i, rows[i][1] + " x") for i in range(8)] + [(300 + i, rows[i][1]) for i in range(4)]
    join = jaccard_join.JaccardJoin(docs_of(spark, rows))
    real = join.members
    named = {jaccard_join.set_id(s): jaccard_join.second_id(s) for s in (jaccard_join.shingle_set(t) for i, t in rows if i < 5)}

    def members():
        out = real()
        join.clashing = frozenset(named)  # as members() does of sets that share a name
        second = F.create_map(*(F.lit(x) for kv in named.items() for x in kv))
        return out.withColumn("set_id", F.coalesce(F.try_element_at(second, F.col("set_id")), F.col("set_id")))

    monkeypatch.setattr(join, "members", members)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in join.components().collect()) == brute_links(rows, 80)


def test_op3_columns_with_clashing_names(spark, tmp_path):
    import base64

    rows = [(i, f"http://h/{i}", None if i % 11 == 0 else "" if i % 13 == 0 else f"<p>page {i % 20} é</p>" * (1 + i % 3)) for i in range(1, 120)]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")
    clash = [F.lit("mine").alias(c) for c in ("payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest", "id", "k", "n", "first", "offset", "path", "uri", "date", "part", "h")]
    pages.select("*", *clash).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    first = {}
    for i, _, t in sorted(rows):
        first.setdefault(t or "", i)
    want = Counter()
    for i, _, t in rows:
        data = (t or "").encode()
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want[i, len(data), sha, "response" if first[t or ""] == i else "revisit", None if first[t or ""] == i else first[t or ""]] += 1
    got = queries.queries()["op3_warc"](spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows_of(got) == want
