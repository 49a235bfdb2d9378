"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a row (name, low, high) over a named measure; the verdict is one boolean column. There is no user
function, no shuffle and no second pass: text is split once per document and everything else derives from that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ortholens.llm.common import BLANK, let, settled, words_of

#: Frequent function words of the languages the corpus is written in.
STOP_WORDS = (
    "a about all also an and are as at be been but by can for from had has have he her his i if in is it its more no not of on or "
    "our she so that the their there they this to was we were what when which who will with would you "
    "aber als am auch auf aus bei bin bis das dass dem den der des die dies doch durch ein eine einem einen einer es für hat ich ihr "
    "im ist ja kann mit nach nicht noch nur oder sein sich sie sind über um und uns von vor war was wie wir wird zu zum zur "
    "au aux avec ce ces cette d dans de des du elle en est et eux il ils je la le les leur lui mais me ne nous on ou où par pas pour "
    "qu que qui sa se ses son sur te tu un une vous "
    "al algo como con cuando del desde donde el ella ellos entre era es esta este fue ha han hasta hay la las lo los más me mi muy ni "
    "nos o otro para pero por porque que se ser si sin sobre son su sus también te tiene todo un una uno y ya"
)

#: Threshold table: measure, least and greatest allowed value (None: open).
THRESHOLDS = (
    ("n_words", 50, None),  # length
    ("mean_word_chars", 2.0, 14.0),  # length
    ("symbol_ratio", None, 0.04),  # symbols per character of words
    ("stop_word_ratio", 0.04, None),
    ("dup_line_ratio", None, 0.5),  # lines that repeat an earlier one
    ("words_per_line", 3.0, None),
)

SYMBOLS = "#*$%&|<>"


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    return let(words, _repeat_words)


def _repeat_words(words: Column) -> Column:
    """Windows are sorted beside their equals; then the union of the repeated ones' spans is measured."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("t"), i.alias("p")),
    )

    def repeated(s: Column) -> Column:
        return F.transform(
            F.filter(s, lambda x, i: (F.get(s, i - 1)["t"] == x["t"]) | (F.get(s, i + 1)["t"] == x["t"])), lambda x: x["p"]
        )

    def covered(p: Column) -> Column:
        each = F.transform(p, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, i - 1))))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    found = let(F.sort_array(windows), lambda s: F.sort_array(F.coalesce(repeated(s), F.array().cast("array<int>"))))
    return F.when(F.size(words) >= 3, let(found, covered)).otherwise(0).cast("long")


def verdict(thresholds=THRESHOLDS) -> Column:
    """The threshold table as one boolean expression over the measures' columns."""
    out = F.lit(True)
    for name, low, high in thresholds:
        if low is not None:
            out = out & (F.col(name) >= F.lit(low))
        if high is not None:
            out = out & (F.col(name) <= F.lit(high))
    return out


def quality_rules(docs: DataFrame, text_col: str = "text", thresholds=THRESHOLDS, keep_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: keep_cols and the measures, base_failed and kept.

    Null and empty texts have no words: every count is 0, base_failed is true, kept is false. Repeated rows are judged
    each on its own; further columns are ignored unless named in keep_cols.
    """
    text = F.coalesce(F.col("__text"), F.lit(""))
    stop = list(dict.fromkeys(STOP_WORDS.split()))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^" + BLANK[1:]))
    first = docs.select(*keep_cols, F.col(text_col).alias("__text")).select(
        *keep_cols, "__text", words_of(F.col("__text")).alias("__words"), lines.alias("__lines")
    )
    n = F.size("__words").cast("long")
    counted = first.select(
        *keep_cols,
        n.alias("n_words"),
        F.length(F.regexp_replace(text, BLANK, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("__words")).alias("n_repeat_words"),
        F.size(F.filter("__words", lambda w: w.isin(stop))).cast("long").alias("n_stop_words"),
        F.size("__lines").cast("long").alias("n_lines"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    measured = counted.select(
        "*",
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "word_chars").alias("symbol_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_words", "n_lines").alias("words_per_line"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured.select(
        *keep_cols, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(thresholds)).alias("kept"),
        "n_stop_words", "n_lines", "mean_word_chars", "symbol_ratio", "stop_word_ratio", "dup_line_ratio", "words_per_line",
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents that the rules keep, with their own columns.

    The verdict is computed beside the row itself, so repeated doc_ids and clashing column names need no join.
    """
    names = docs.columns
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"), F.col("text").alias("text"))
    return settled(quality_rules(own, keep_cols=("__row",)), F.col("kept")).select("__row.*")
