"""Helpers shared by the training-data operators: scratch tables, row keys, joins on keys that repeat."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.scratch import ship

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table is broadcast only if its counted rows times its row width stay under this.
BROADCAST_BYTES = 24 << 20

#: Rows of one key that a join leaves together.
KEY_ROWS = 4_000
#: Bytes of a batch of texts on its way to Python, where the session sets no bound.
ARROW_BYTES = 4 << 20

def bound_batches(spark: SparkSession) -> None:
    """Have Python find this package, and bound Arrow batches by bytes too, unless the session does.

    Ten thousand long texts are too much for a task. The bound stays set in the session: a plan
    takes it when it runs, which is after an operator has returned it.
    """
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(ARROW_BYTES))


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, after which a worker gives back the memory that it no longer needs: workers live on between tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
                trim(0)

    return wrapped


class Scratch(scratch.Scratch):
    """Scratch tables of operators that send texts to Python."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, name)
        bound_batches(spark)


def small_side(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted size is under BROADCAST_BYTES, else as it is.

    df should be cheap to count: a scratch table. Beyond the bound the join shuffles.
    """
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def spread_join(rows: DataFrame, side: DataFrame, on: list[str], tables: scratch.Scratch, name: str, counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """The inner join of rows with side, in which a key ``on`` stands once; no task gets all rows of a frequent key.

    ``counts`` (the keys and ``n``) tells how many rows a key has, ``total`` how many there are; without them rows, a scratch table, is counted.
    Keys with more than KEY_ROWS rows get salts, over which their rows are dealt by a hash, and side's row is
    copied for each. The table of these keys is broadcast: as each stands for so many rows, it stays
    under BROADCAST_BYTES.
    """
    least = max(KEY_ROWS, (rows.count() if total is None else total) * 64 // BROADCAST_BYTES)
    counts = rows.groupBy(*on).agg(F.count("*").alias("n")) if counts is None else counts
    hot = tables.save(counts.where(F.col("n") > least).select(*on, F.ceil(F.col("n") / least).cast("int").alias("_salts")), name)
    if not hot.limit(1).count():
        return rows.join(side, on)
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copied = side.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copied, [*on, "_salt"]).drop("_salt")


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(col, UPPER, LOWER)


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A 128-bit key of a row's id and text; rows that agree in both share it."""
    of = (F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))
    half = lambda seed: F.lpad(F.hex(F.xxhash64(F.lit(seed), *of)), 16, "0")
    return F.unhex(F.concat(half(1), half(2)))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
