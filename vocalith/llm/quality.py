"""Quality rules kept in a bitmask ledger.

``ledger`` evaluates every rule once for a document and stores the measurements and one
``fail_bits`` number, bit i set where rule i fails.  A policy is a version name and a mask
of rules; applying another version, or asking what a rule contributes, only takes bitwise
work on the stored bits and never looks at the text again.  All of it is built-in
functions on one row at a time: no shuffle, no Python.

Words repeated in three-word windows are found inside the row.  Each window's hash is
packed with its position into a long, the longs are sorted, and neighbours with the same
hash part are candidates; their whole 64-bit hashes then decide.

Defined cases: a null text has no words and fails for want of words; a null doc_id is
kept as it is; repeated rows each get their own ledger row; texts of any length are read
whole; an empty table gives an empty ledger; other columns are not read by ``ledger`` and
are all kept by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalith.llm.common import WHITE, WHITE_CLASS

WINDOW = 3
SYMBOLS = "[#*$%&|<>]"
LOW_BITS = 24
MEASURES = ("n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` is a predicate on the measurements."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A version of what is refused: documents that fail any of ``rules``."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        at = {r.name: i for i, r in enumerate(RULES)}
        return sum(1 << at[name] for name in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
FULL = Policy("full-1", tuple(r.name for r in RULES))


def _measured(docs: DataFrame, keep: list[Column]) -> DataFrame:
    text = F.coalesce(F.col("_text"), F.lit(""))
    bare = F.btrim(text, F.lit(WHITE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_CLASS))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*keep, F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), words.alias("_words"), lines.alias("_lines"))

    w = F.col("_words")
    gram = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))
    places = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW)).otherwise(F.array().cast("array<int>"))
    packed = F.transform(places, lambda i: F.shiftleft(gram(i), LOW_BITS).bitwiseOR(i.cast("long")))
    df = df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_sorted": F.sort_array(packed),
        }
    )
    s = F.col("_sorted")
    same = lambda x, y: F.shiftrightunsigned(x, LOW_BITS) == F.shiftrightunsigned(y, LOW_BITS)
    near = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
    at = F.transform(near, lambda x: x.bitwiseAND((1 << LOW_BITS) - 1).cast("int"))
    # A text with more windows than the low bits can number has every window as a candidate.
    at = F.when(F.size(w) < 1 << LOW_BITS, at).otherwise(places)
    df = df.withColumn("_whole", F.sort_array(F.transform(at, lambda i: F.struct(gram(i).alias("h"), i.alias("i")))))
    t = F.col("_whole")
    twice = F.filter(t, lambda x, i: (x.h == F.get(t, i - 1).h) | (x.h == F.get(t, i + 1).h))
    df = df.withColumn("_twice", F.transform(twice, lambda x: x.i))
    q = F.col("_twice")
    covered = q
    for k in range(1, WINDOW):
        covered = F.array_union(covered, F.transform(q, lambda i: i + k))  # noqa: B023
    made = F.struct(*MEASURES[:-1], F.size(covered).cast("long").alias(MEASURES[-1]))
    # A filter on the measurements stays above this explode of one row.  Were it pushed
    # further down, it would repeat the work of every step inside itself.
    below = [c for c in df.columns if c not in MEASURES and c not in ("_words", "_lines", "_sorted", "_whole", "_twice")]
    return df.select(*below, F.explode(F.array(made)).alias("_m")).select(*below, "_m.*")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and fail_bits with bit i set where RULES[i] fails."""
    df = _measured(docs.select("doc_id", F.col("text").alias("_text")), [F.col("doc_id")])
    return df.withColumn("fail_bits", _bits())


def _bits() -> Column:
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return bits


def refused(policy: Policy, bits: Column | None = None) -> Column:
    bits = F.col("fail_bits") if bits is None else bits
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def keep(docs: DataFrame, policy: Policy = FULL) -> DataFrame:
    """The rows of ``docs`` that ``policy`` does not refuse, with their columns as they were."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    df = _measured(docs.select(row, F.col("text").alias("_text")), [F.col("_row")])
    return df.where(~refused(policy, _bits())).select("_row.*")


def ablation(kept_ledger: DataFrame, policy: Policy = FULL) -> DataFrame:
    """For each rule of the policy: how many documents fail it, fail it alone, and would be refused without it.

    Documents are first counted by their masked bits, of which there are at most
    2 to the number of rules.
    """
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    counts = kept_ledger.groupBy(masked.alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if r.name in policy.rules]
    each = counts.select("bits", "n", F.explode(F.array(*rules)).alias("r")).select("bits", "n", "r.*")
    some = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    return each.groupBy("rule").agg(
        some(F.col("bits").bitwiseAND(F.col("bit")) != 0)("n_failed"),
        some(F.col("bits") == F.col("bit"))("n_failed_alone"),
        some(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) != 0)("n_refused_without"),
    )
