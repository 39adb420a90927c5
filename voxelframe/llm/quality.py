"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Counts come from built-in string and array functions, so the whole rule set is a narrow projection over the
text: no shuffle, no Python. A rule names a ratio of the counts and the closed range in which it must lie.

Defined cases: a null text has no words and counts as empty; empty and wordless texts fail the base rule; a
null doc_id stays null; other columns of the input are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

#: Frequent function words of the four corpus languages, whole lower-case words.
STOP_WORDS = (
    "the of and to in a is that for it on as with was by are be this from at or an have not which "
    "de la le et les des en un une du que est pour qui dans par sur au plus ne pas ce il se avec "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden "
    "el que y los se del las un por con no una su para es al lo como más o pero sus le ha me si sin"
).split()

#: rule, ratio as an expression over the counts, least, most (None: open). The percentages apply to words or lines.
THRESHOLDS: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("length", "n_words", 20, None),
    ("repetition", "100.0 * n_repeat_words / n_words", None, 30),
    ("word_length", "1.0 * word_chars / n_words", 2, 15),
    ("symbols", "100.0 * n_symbols / n_words", None, 10),
    ("stutter", "100.0 * n_stutter / n_words", None, 20),
    ("exclamations", "100.0 * n_marks / n_words", None, 20),
    ("stop_words", "100.0 * n_stop_words / n_words", 1, None),
    ("dup_lines", "100.0 * n_dup_lines / n_lines", None, 50),
    ("letters", "100.0 * n_letters / word_chars", 60, None),
)

WINDOW = 8


def count_columns(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select("doc_id", text.alias("_text"), words.alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    # A window's hash stands for its words; one select per level keeps each array computed once.
    hashed = base.select(
        "*",
        F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_hashes"),
    )
    repeats = hashed.select(
        "*",
        F.when(
            F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
            F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        )
        .otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        .alias("_sorted"),
    )
    starts = repeats.select("*", _repeated_starts(F.col("_sorted")).alias("_starts"))
    return starts.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length("_text") - F.length(F.translate("_text", "!?", ""))).cast("long").alias("n_marks"),
        F.length(F.regexp_replace("_text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_starts")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w, i: w == F.get("_words", i - 1))).cast("long").alias("n_stutter"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


def _repeated_starts(pairs: Column) -> Column:
    """Positions of the windows whose hash a neighbour in hash order shares, in order."""
    same = F.filter(
        pairs,
        lambda x, k: F.coalesce(F.get(pairs, k - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False)),
    )
    return F.sort_array(F.transform(same, lambda x: x["i"]))


def _covered(starts: Column) -> Column:
    """Number of words in the union of the windows that begin at the sorted ``starts``."""
    return F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total")),
        lambda acc, x: F.struct(
            x.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), x - acc["last"])).alias("total")
        ),
        lambda acc: acc["total"],
    )


def compile_rules(thresholds=THRESHOLDS) -> Column:
    """One boolean expression: every ratio is defined and within its range."""
    verdict = F.lit(True)
    for _, ratio, least, most in thresholds:
        # A zero denominator fails the rule.
        numerator, _, denominator = ratio.partition(" / ")
        value = F.try_divide(F.expr(numerator), F.expr(denominator)) if denominator else F.expr(ratio)
        if least is not None:
            verdict = verdict & F.coalesce(value >= least, F.lit(False))
        if most is not None:
            verdict = verdict & F.coalesce(value <= most, F.lit(False))
    return verdict


def quality(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """doc_id, the counts, base_failed and kept: a document is kept if it passes the base rule and the table."""
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return count_columns(docs).select(
        "*", base_failed.alias("base_failed"), (~base_failed & compile_rules(thresholds)).alias("kept")
    )
