"""Packs as archives: gzip Parquet with checksums, installed after they agree and validate."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from . import packs

#: Rows of a file in an archive: checksums are taken of files as a whole.
FILE_ROWS = 1_000_000
SUMS = "SHA256SUMS"


def sums(spark: SparkSession, folder: str, kind: str = "*.parquet") -> DataFrame:
    """(digest, name, bytes) of the files of a kind under a folder, named from there; each is read by a task."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", kind).load(folder)
    # One folder above its tables: names are table/file, or pack/table/file where the folder holds packs.
    root = found.select(F.regexp_replace("path", r"^\w+:/*", "/").alias("name"), "content", "length")
    base = files.canonical(folder).split(":", 1)[-1].lstrip("/")
    return root.select(F.sha2("content", 256).alias("digest"), F.substr("name", F.lit(len(base) + 3)).alias("name"), F.col("length").alias("bytes"))


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """(digest, name) of lines of two fields; others are passed over."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("x")).where(F.size("x") == 2)
    return rows.select(F.col("x")[0].alias("digest"), F.col("x")[1].alias("name"))


def package(spark: SparkSession, paths: list[str], out: str) -> DataFrame:
    """Archives of packs in ``out``, with SHA256SUMS and README.md; a row for each with its sizes."""
    rows = []
    for path in paths:
        n, manifest, _ = packs.inspect(spark, path)
        to = f"{out}/{manifest['id']}"
        for t in packs.tables_of(path):
            spark.read.parquet(f"{path}/{t}").write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{to}/{t}")
        rows.append((manifest["id"], ",".join(manifest["languages"]), n, files.size(path), files.size(to)))
    if not rows:
        raise ValueError("no packs to archive")
    sums(spark, out).orderBy("name").select(F.concat_ws("  ", "digest", "name")).coalesce(1).write.mode("overwrite").text(f"{out}/{SUMS}")
    mb = lambda x: f"{x / 2**20:,.1f} MB"
    lines = ["| Pack | Languages | Entries | Unpacked | Archive |", "| --- | --- | ---: | ---: | ---: |"]
    lines += [f"| {i} | {langs} | {n:,} | {mb(raw)} | {mb(packed)} |" for i, langs, n, raw, packed in rows]
    lines.append(f"| **total** | | {sum(r[2] for r in rows):,} | {mb(sum(r[3] for r in rows))} | {mb(sum(r[4] for r in rows))} |")
    files.write_text(f"{out}/README.md", "# Packs\n\n" + "\n".join(lines) + "\n")
    return spark.createDataFrame([(*r, r[3] / max(1, r[4])) for r in rows], "pack_id STRING, languages STRING, entries LONG, raw_bytes LONG, archive_bytes LONG, ratio DOUBLE")


def install(spark: SparkSession, archive: str, out: str, checksums: str | None = None) -> bool:
    """Put an archived pack in place of ``out``; True if checksums vouched for it.

    A file that differs from its checksum fails the install, as does one that a list of
    checksums leaves out while it names others of the pack; without any the pack installs
    unverified. The pack is unpacked and validated beside its place first.
    """
    verified = False
    if checksums is not None:
        name = files.canonical(archive).rsplit("/", 1)[-1]
        listed = read_sums(spark, checksums).select("digest", F.regexp_replace("name", f"^{name}/", "").alias("name"))
        both = sums(spark, archive).withColumnRenamed("digest", "got").join(listed, "name", "left")
        tally = both.agg(F.count("digest").alias("known"), F.count("*").alias("all"), F.min(F.when(~F.coalesce(F.col("digest") == F.col("got"), F.lit(False)), F.col("name"))).alias("bad")).first()
        if tally.known and tally.bad is not None:
            raise ValueError(f"checksum differs: {tally.bad}")
        verified = bool(tally.known)
    part = f"{out}.part"
    files.delete(part)
    try:
        for t in packs.tables_of(archive):
            spark.read.parquet(f"{archive}/{t}").write.mode("overwrite").parquet(f"{part}/{t}")
        packs.check_pack(spark, part)
        files.replace(part, out)
    finally:
        files.delete(part)
    return verified


def make_manifest(language: str, name: str, edition: str, url: str, dump: str, license: str, source_id: str, retrieved: str | None = None) -> dict:
    """The manifest of a pack built from a dump, with the digest of the dump's first 64 MB."""
    now = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    note = f"By those who wrote {edition}; taken {retrieved or now} from a dump whose first 64 MB have the SHA-256 digest {files.sha256(dump, 64)}"
    source = {"id": source_id, "name": f"{name} ({edition})", "url": url, "license": license, "attribution": note}
    return {"id": f"{source_id}-{language}", "name": f"{edition}: {name}", "version": now[:10].replace("-", "."), "schema_version": packs.SCHEMA_VERSION, "languages": [language], "created_at": now, "license": license, "sources": [source]}
