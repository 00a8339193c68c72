"""Quality rules as a bitmask ledger.

``rule_ledger`` evaluates every rule once and keeps what it measured and one
failure bit per rule. ``apply_policy`` turns a ledger into verdicts by a mask,
so that policies can change without reading texts again. ``ablation`` counts,
by bitwise aggregation over the distinct bit patterns, what each rule of a
policy rejects, and what it alone rejects.

Null and empty texts have no words: their measures are 0 and they fail
``few_words``. Repeated rows each get their own row. Null ids pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, releasing

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """A rule fails a document where ``fails`` holds; ``fails`` is SQL over the measures."""

    name: str
    fails: str


#: The place of a rule in this tuple is its bit; new rules go at the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "2 * word_chars < 5 * n_words OR word_chars > 14 * n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("shouting", "2 * n_upper > word_chars"),
    Rule("exclamations", "10 * n_bangs > 3 * n_words"),
)
#: Versioned policies: names of the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "word_length"),
    "v2": tuple(r.name for r in RULES if r.name != "duplicate_lines"),  # those are left to line dedup
    "strict": tuple(r.name for r in RULES),
}


def mask_of(policy: str) -> int:
    names = [r.name for r in RULES]
    return sum(1 << names.index(n) for n in POLICIES[policy])


def _repeat_words(words: list[bytes]) -> int:
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    k = np.uint64(0x9E3779B97F4A7C15)
    t = (h[:-2] * k + h[1:-1]) * k + h[2:]
    s = np.sort(t)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return 0
    hit = np.isin(t, again)
    cover = np.zeros(n, bool)
    cover[:-2] |= hit
    cover[1:-1] |= hit
    cover[2:] |= hit
    return int(cover.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of one whole text."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the blanks of the word definition
    seen: set[str] = set()
    n_lines = dup = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            n_lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        dup,
        _repeat_words(words),
        n_lines,
        len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        text.count("!"),
    )


def _measured(text_at: int, n_keep: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = np.array([measure(t) for t in part.column(text_at).to_pylist()], np.int64).reshape(-1, len(MEASURES))
                kept = [part.column(i) for i in range(n_keep)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(rows[:, i]) for i in range(len(MEASURES)))], schema=schema)

    return run


def _bits() -> Column:
    return sum((F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)), F.lit(0)).cast("long")


def rule_ledger(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, the MEASURES and ``fail_bits``, a row for each row of docs."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    bound_batches(docs.sparkSession)
    own = text_col in keep
    slim = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), *([] if own else [F.col(text_col).alias("_text")]))
    out = StructType([*slim.schema.fields[: len(keep)], *(StructField(m, LongType()) for m in MEASURES)])
    at = keep.index(text_col) if own else len(keep)
    made = slim.mapInArrow(releasing(_measured(at, len(keep), to_arrow_schema(out))), out)
    made = made.withColumn("fail_bits", _bits())
    return made.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), *MEASURES, "fail_bits")


def apply_policy(ledger: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``; no text is read."""
    bits = F.col("fail_bits")
    base = bits.bitwiseAND(F.lit(mask_of("base"))) != 0
    return ledger.withColumn("base_failed", base).withColumn("kept", ~base & (bits.bitwiseAND(F.lit(mask_of(policy))) == 0))


def ablation(ledger: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of the policy: documents failing it, failing only it, and kept if it is left out.

    Counts are over distinct bit patterns, at most 2 to the number of rules.
    """
    mask = mask_of(policy)
    bit_of = {r.name: 1 << i for i, r in enumerate(RULES)}
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(bit_of[n]).cast("long").alias("bit")) for n in POLICIES[policy])))
    x = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    failed = x.bits.bitwiseAND(x.bit) != 0
    n_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return x.groupBy("rule").agg(
        n_if(failed).alias("n_failed"),
        n_if(failed & (F.bit_count("bits") == 1)).alias("n_only"),
        n_if(x.bits.bitwiseAND(F.bitwise_not(x.bit)) == 0).alias("n_kept_without"),
    )


def keep_good(docs: DataFrame, policy: str = "v2", text_col: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with their own columns."""
    names = docs.columns
    plain = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    ledger = rule_ledger(plain, f"_c{names.index(text_col)}", tuple(plain.columns))
    return apply_policy(ledger, policy).where("kept").select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))
