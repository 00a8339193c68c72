"""Command line: build, inspect and search packs.

python -m verbarium entries MANIFEST ENTRIES OUT
python -m verbarium dump MANIFEST DUMP OUT SOURCE_ID [MAX_ENTRIES]
python -m verbarium sentences PACK SENTENCES LINKS LANGUAGE OUT [MAX_PER_ENTRY]
python -m verbarium inspect PACK
python -m verbarium coverage PACK
python -m verbarium lookup QUERY [LIMIT] [FOLDER]
python -m verbarium package OUT PACK...
python -m verbarium install ARCHIVE OUT [CHECKSUMS]
python -m verbarium bench [FOLDER] [RUNS]
"""

from __future__ import annotations

import json
import sys
import time

from pyspark.sql import SparkSession

from .operators import measure, packaging, packs
from .operators.search import SearchEngine

#: Queries of the latency benchmark.
BENCH = ("h", "lig", "light", "l?ght", "l*t", "*ight", "morning light")


def bench(spark: SparkSession, engine: SearchEngine, runs: int):
    """(packs and query, mean, p50, p95) in milliseconds over repeated lookups of ten results: in each pack, then in all."""
    took = []
    for p in engine.packs:
        alone = SearchEngine(spark)
        alone.add_pack(p.path)
        took += [(f"{p.pack_id}: {q}", ms) for q, ms in _timed(alone, runs)]
    took += [(f"all {len(engine.packs)} packs, {engine.entry_total()} entries: {q}", ms) for q, ms in _timed(engine, runs)]
    return measure.nearest_rank(spark.createDataFrame(took, "query STRING, ms DOUBLE"), "query", "ms", {"p50": 0.5, "p95": 0.95})


def _timed(engine: SearchEngine, runs: int):
    for query in BENCH:
        for _ in range(runs):
            began = time.perf_counter()
            engine.suggest(query, 10).collect()
            yield query, (time.perf_counter() - began) * 1000


def _engine(spark: SparkSession, folder: str) -> SearchEngine:
    engine = SearchEngine(spark)
    print(f"{engine.load_directory(folder)} pack(s) from {folder}")
    for path, message in engine.load_errors:
        print(f"warning: {path}: {message}", file=sys.stderr)
    return engine


def main(argv: list[str]) -> int:
    mode, args = (argv[0], argv[1:]) if argv else ("", [])
    least = {"entries": 3, "dump": 4, "sentences": 5, "inspect": 1, "coverage": 1, "lookup": 1, "package": 2, "install": 2, "bench": 0}
    if len(args) < least.get(mode, sys.maxsize):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    if mode == "entries":
        print(packs.build_from_entries(spark, *args[:3]))
    elif mode == "dump":
        print(packs.build_from_dump(spark, *args[:4], int(args[4]) if len(args) > 4 else None))
    elif mode == "sentences":
        print(packs.merge_sentences(spark, *args[:5], int(args[5]) if len(args) > 5 else 3), "example(s) added")
    elif mode == "inspect":
        n, manifest, kinds = packs.inspect(spark, args[0])
        print(f"{args[0]}: {n} entries\n{json.dumps(manifest, ensure_ascii=False, indent=2)}")
        for kind, count in kinds.items():
            print(f"  {kind}: {count}")
    elif mode == "coverage":
        row = packs.coverage(spark.read.parquet(f"{args[0]}/entries")).first()
        for k, v in row.asDict().items():
            print(f"{k:13s} {v}" + (f"  {100 * v / row.entries:.1f}%" if row.entries and k not in ("entries", "han_share") else ""))
        for w in packs.coverage_warnings(spark, args[0]).collect():
            print(f"warning: {w.warning}")
    elif mode == "lookup":
        engine = _engine(spark, args[2] if len(args) > 2 else "packs")
        for i, r in enumerate(engine.suggest(args[0], int(args[1]) if len(args) > 1 else 10).collect(), 1):
            print(f"{i:>2}. {r.lemma:<24} {r.language:<5} {r.pos or '-':<10} matched {r.matched_term!r} as {r.match_type}")
    elif mode == "package":
        packaging.package(spark, args[1:], args[0]).show(truncate=False)
    elif mode == "install":
        print("verified" if packaging.install(spark, args[0], args[1], args[2] if len(args) > 2 else None) else "installed without checksums")
    else:
        bench(spark, _engine(spark, args[0] if args else "packs"), int(args[1]) if len(args) > 1 else 5).orderBy("query").show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
