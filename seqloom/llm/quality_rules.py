"""Quality rules as a ledger: every rule is evaluated once, its failure is one bit of a mask.

Measurements and the mask are stored per document; a policy is a versioned mask of the rules it
enforces. Applying another policy, or asking what a rule alone costs, reads masks and no text.
Everything is DataFrame functions.

Repeated windows are looked for by hashes first; in texts that have some, windows are then told apart by their words, so the count is exact.
The limits fit languages that put spaces between words; those on capitals and word length fit Latin letters.

Defined results: a null or empty text has no words, so all measurements are zero and the rule on
few words fails. Texts of any length are measured whole. Repeated rows are measured alike, whatever their doc_id. An empty table
gives an empty ledger. Input columns named like a result column are replaced, columns of other names pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import SPACES, unused

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


@dataclass(frozen=True)
class QualityRule:
    """bit: the rule's place in the mask, never used again for another rule."""

    bit: int
    name: str
    fails: Callable[[], Column]


#: Limits are products of whole numbers, so no rounding can tell engines apart.
RULES = (
    QualityRule(0, "few_words", lambda: F.col("n_words") < 20),
    QualityRule(1, "repeated_windows", lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    QualityRule(2, "symbols", lambda: 100 * F.col("n_symbols") > 25 * F.col("n_words")),
    QualityRule(3, "shouting", lambda: 100 * F.col("n_upper") > 30 * F.col("word_chars")),
    QualityRule(4, "marks", lambda: 100 * F.col("n_marks") > 25 * F.col("n_words")),
    QualityRule(5, "repeated_lines", lambda: 100 * F.col("n_dup_lines") > 60 * F.col("n_lines")),
    QualityRule(6, "word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
)
#: Version: the names of the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "2026-1": ("few_words", "repeated_windows", "symbols", "shouting", "marks", "repeated_lines", "word_length"),
}


def policy_mask(policy: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in POLICIES[policy])


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """The measurements; each stage's columns are used twice or more by the next, so none is inlined."""
    out = docs.drop(*[m for m in (*MEASURES, "failed") if m != text])
    words, lines, hashes, windows, placed, at = unused(out, "_words", "_lines", "_hashes", "_windows", "_placed", "_at")
    t = F.coalesce(F.col(text), F.lit(""))
    out = out.withColumns(
        {
            words: F.array_remove(F.split(t, f"[{SPACES}]+"), ""),
            lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACES}]")),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_upper": F.regexp_count(t, F.lit("[A-Z]")).cast("long"),
            "n_marks": F.regexp_count(t, F.lit("[!?]")).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            hashes: F.transform(words, lambda w: F.xxhash64(w)),
        }
    ).drop(lines)
    # Hashes of 2, 4 and 8 words, each made of two shorter ones.
    out = out.withColumn(windows, F.when(F.size(hashes) >= WINDOW, F.col(hashes)).otherwise(F.array().cast("array<bigint>")))
    for width in (1, 2, 4):
        n = F.size(windows) - width
        joined = F.zip_with(F.slice(windows, 1, n), F.slice(windows, width + 1, n), lambda a, b: F.xxhash64(a, b))
        out = out.withColumn(windows, F.when(F.size(windows) > 0, joined).otherwise(F.col(windows)))
    again = F.size(windows) > F.size(F.array_distinct(windows))
    out = out.withColumn(placed, F.when(again, F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = out.withColumn(at, _repeated(placed))
    # The windows found are told apart by their words.
    spelled = F.transform(at, lambda i: F.struct(F.array_join(F.slice(F.col(words), i + 1, WINDOW), " ").alias("h"), i.alias("i")))
    out = out.withColumn(placed, F.when(F.col(at).isNotNull(), F.sort_array(spelled)))
    out = out.withColumn(at, _repeated(placed))
    n = F.size(at)
    steps = F.zip_with(F.slice(at, 1, n - 1), F.slice(at, 2, n - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(n > 0, F.aggregate(steps, F.lit(WINDOW), lambda x, y: x + y))
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return out.drop(words, hashes, windows, placed, at)


def _repeated(placed: str) -> Column:
    """Places of the entries that equal a neighbour, of an array of struct<h, i> sorted by h; null for null."""
    n = F.size(placed)
    pairs = F.zip_with(
        F.slice(placed, 1, n - 1), F.slice(placed, 2, n - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    some = F.when(n > 1, F.sort_array(F.array_distinct(F.flatten(pairs)))).otherwise(F.array().cast("array<int>"))
    return F.when(F.col(placed).isNotNull(), some)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements and the mask of failed rules."""
    mask = F.lit(0).cast("long")
    for r in RULES:
        mask = mask.bitwiseOR(F.when(r.fails(), F.lit(1 << r.bit)).otherwise(0).cast("long"))
    return _measured(docs, text).withColumn("failed", mask)


def apply_policy(book: DataFrame, policy: str = "2026-1", name: str = "kept") -> DataFrame:
    return book.withColumn(name, F.col("failed").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablation(book: DataFrame, *policies: str) -> DataFrame:
    """For each rule of each policy (all if none is named): documents that fail it, and documents that only it rejects.

    Masks are counted first, so what is moved is bounded by the number of masks; all policies are applied to the counts.
    """
    bits = {r.name: 1 << r.bit for r in RULES}
    entries = [(p, policy_mask(p), name, bits[name]) for p in policies or POLICIES for name in POLICIES[p]]
    masks = book.groupBy("failed").agg(F.count("*").alias("n"))
    each = F.array(
        *[
            F.struct(F.lit(p).alias("policy"), F.lit(m).cast("long").alias("all"), F.lit(name).alias("rule"), F.lit(b).cast("long").alias("bit"))
            for p, m, name, b in entries
        ]
    )
    failed, bit = F.col("failed"), F.col("r.bit")
    return (
        masks.select("failed", "n", F.explode(each).alias("r"))
        .groupBy(F.col("r.policy").alias("policy"), F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(failed.bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(failed.bitwiseAND(F.col("r.all")) == bit, F.col("n")).otherwise(0)).alias("n_only"),
        )
    )
