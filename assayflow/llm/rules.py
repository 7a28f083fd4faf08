"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger row holds what was measured and one bit per rule that
failed. Policies are masks over those bits, so a new policy version, and what each rule costs, is a bitwise
aggregate over the ledger and never reads a text again.

Nulls and odd input: a null text is an empty one (no words; it fails ``few_words``); a null doc_id stays null;
repeated rows give repeated ledger rows; very long texts are measured whole, inside the row; there are no ties, as each
rule is met or not at its bound; other columns of the input are not looked at; an empty table gives an empty ledger and
ablations of no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, text_of, words_of

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks")
#: A rule's bit is its place here; the condition is true where the rule fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "word_length": "word_chars > 15 * n_words OR 2 * word_chars < 3 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "marks": "2 * n_marks > n_words",
}
BIT = {name: 1 << place for place, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named version: a document is rejected if one of these rules fails."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
FULL = Policy("full", 1, tuple(RULES))


def measured(docs: DataFrame, text: str = "text", into: str = "ledger") -> DataFrame:
    """``docs`` with one more column ``into``: struct of the measures and ``failed``, the bits of failed rules.

    All work stays inside the row. Windows of five words become 64-bit hashes; only where hashes repeat are they
    sorted with their places, and the words that repeated windows cover are counted from the sorted places.
    """
    own = docs.columns
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"),
        text_of(docs[text]).alias("text"),
    )
    held = held.select(
        "row",
        "text",
        words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike("[^ \\t-\\r]")).alias("lines"),
    )
    hashes = F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)]),
    )
    none = F.array().cast("array<bigint>")
    held = held.withColumn("seen", F.when(F.size("words") >= WINDOW, hashes).otherwise(none))
    placed = F.sort_array(F.transform("seen", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    held = held.withColumn(
        "placed",
        F.when(F.size(F.array_distinct("seen")) < F.size("seen"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    again = F.filter(
        "placed",
        lambda x, k: (F.get(F.col("placed"), k - 1)["h"] == x["h"]) | (F.get(F.col("placed"), k + 1)["h"] == x["h"]),
    )
    held = held.withColumn("again", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        "again",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")),
    )["n"]
    values = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count(F.col("text"), F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": covered,
        "n_lines": F.size("lines"),
        "n_marks": F.length("text") - F.length(F.replace(F.col("text"), F.lit("!"), F.lit(""))),
    }
    held = held.select("row", *[values[m].cast("long").alias(m) for m in MEASURES])
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()), F.lit(0))
    return held.select(
        *[F.col("row").getField(c).alias(c) for c in own],
        F.struct(*MEASURES, bits.cast("long").alias("failed")).alias(into),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measures, and the bits of the rules that failed."""
    return measured(docs.select("doc_id", "text")).select("doc_id", "ledger.*")


def stored(docs: DataFrame) -> DataFrame:
    """The ledger as a written table, from which policies and ablations are computed without the texts."""
    return Written(docs.sparkSession, "rules").keep(ledger(docs), "ledger")


def passes(failed: Column, policy: Policy) -> Column:
    return failed.bitwiseAND(F.lit(policy.mask)) == 0


def judged(rows: DataFrame, policy: Policy = FULL, base: Policy = BASE) -> DataFrame:
    """Ledger rows with ``base_failed`` and ``kept`` under a policy; what fails the base is never kept."""
    failed = F.col("failed")
    return rows.select(
        *rows.columns,
        (~passes(failed, base)).alias("base_failed"),
        (passes(failed, base) & passes(failed, policy)).alias("kept"),
    )


def ablations(rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """Per policy and rule: how many documents fail the rule, fail it alone, and stay kept without it.

    The ledger is first counted by its bits, of which there are at most 2 to the number of rules.
    """
    counted = rows.groupBy("failed").agg(F.count("*").alias("docs"))
    wanted = [
        F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit"), F.lit(p.mask).alias("mask"))
        for p in policies
        for r in p.rules
    ]
    each = counted.select("failed", "docs", F.explode(F.array(*wanted)).alias("w")).select("failed", "docs", "w.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("docs"))), F.lit(0))
    return each.groupBy("policy", "version", "rule").agg(
        count(hit.bitwiseAND(F.col("bit")) != 0).alias("fail"),
        count(hit == F.col("bit")).alias("fail_alone"),
        count(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("kept_without"),
    )


def keep_good(docs: DataFrame, policy: Policy = FULL) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    spare = "ledger_" + "_".join(docs.columns)[:200]
    own = [F.col(f"`{c}`") for c in docs.columns]
    # exploding keeps the filter above the measures; moved below them it would repeat every measure's expression
    rows = measured(docs, into=spare).select(*own, F.explode(F.array(F.col(f"`{spare}`.failed"))).alias(spare))
    failed = F.col(f"`{spare}`")
    return rows.filter(passes(failed, policy) & passes(failed, BASE)).select(*own)
