"""Quality rules: one threshold table compiled into one Spark projection.

Statistics are array expressions over the words and lines of a text; each
row of ``RULES`` becomes a predicate on them.  No user function runs.

Defined results: a null or empty text has no words, so its counts are 0, its
ratios 0 and it fails the base rule; repeated rows are judged alike; an empty
table gives an empty result; other input columns are ignored, whatever their
names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import apart, pick, words_of

SYMBOLS = "[#*$%&|<>]"

# Common function words of the languages served, lower case.
STOP_WORDS = (
    "the be to of and that have with is in it for on as at by this are was an from "
    "der die das und den von zu mit des dem nicht ein eine ist im auf "
    "le la les de des du et un une que qui en pour dans par sur pas est "
    "el los las del que y en un una por con para su se no al"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("length_words", "n_words", 50, None),
    Rule("mean_word_chars", "mean_word_chars", 2, 12),
    Rule("symbols_per_word", "symbol_ratio", None, 0.25),
    Rule("stop_words_per_word", "stop_ratio", 0.02, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
)


def _repeat_words(words: str) -> Column:
    """Words covered by a 3-word window that occurs at least twice, from the sorted windows.

    Equal windows are neighbours after sorting, so each one is compared with
    the one before and the one after: n log n, and no pairs.
    """
    w = F.col(words)
    starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(
        w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("i"))))

    def same(x: Column, y: Column) -> Column:
        return (x["c"] == y["c"]) & (x["b"] == y["b"]) & (x["a"] == y["a"])

    # bound once: the sorted array is read several times per element
    found = F.transform(F.array(windows), lambda s: F.filter(
        s, lambda x, j: F.coalesce(same(x, F.get(s, j - 1)), F.lit(False))
        | F.coalesce(same(x, F.get(s, j + 1)), F.lit(False))))[0]
    covered = F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.size(F.array_distinct(covered)).cast("bigint")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the counts and ratios that the rules read."""
    d = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "text", words_of(F.col("text")).alias("w"),
                 F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\f\r", "    "))) > 0)
                 .alias("lines"))
    stop = sorted(set(STOP_WORDS))
    counts = d.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words("w").alias("n_repeat_words"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(stop))).alias("n_stop"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter("lines", lambda x: F.ltrim(x).rlike("^[-*•]"))).alias("n_bullets"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$"))).alias("n_ellipses"),
    )
    n, lines = F.col("n_words"), F.col("n_lines")
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _ratio(F.col("word_chars"), n).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), n).alias("symbol_ratio"),
        _ratio(F.col("n_stop"), n).alias("stop_ratio"),
        _ratio(F.col("n_dup_lines"), lines).alias("dup_line_ratio"),
        _ratio(F.col("n_bullets"), lines).alias("bullet_line_ratio"),
        _ratio(F.col("n_ellipses"), lines).alias("ellipsis_line_ratio"),
    )


def passes(rule: Rule) -> Column:
    m, ok = F.col(rule.measure), F.lit(True)
    if rule.low is not None:
        ok = ok & (m >= F.lit(rule.low))
    if rule.high is not None:
        ok = ok & (m <= F.lit(rule.high))
    return ok


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Measures plus ``base_failed``, ``failed_rules`` (names, table order) and ``kept``."""
    failed = F.filter(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    m = measure(docs, id_col, text_col)
    m = m.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    return m.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the rules reject.

    The rows to keep are generated from the verdict.  A plain filter on it
    would be pushed below the projection and compute every measure again.
    """
    d, new, old = apart(docs)
    judged = judge(d.withColumn("row", F.struct(*new)), rules, "row", new[old.index(text_col)])
    return judged.select(F.explode(F.when(F.col("kept"), F.array("doc_id"))).alias("row")).select("row.*").toDF(*old)
