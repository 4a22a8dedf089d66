"""Line-first quality rules, as DataFrame expressions only.

A text is split at newlines and each line that has a word is judged:

* punctuation: a long line must hold the end of a sentence; shouting and symbol runs fail;
* navigation: menus, breadcrumbs and cell rows, seen by their separators;
* boilerplate: stock phrases of sites and scripts.

Failing lines are removed. A document whose failing lines hold more than `max_loss` of its word
characters is rejected, and so is one that fails the base rules. Nothing is shuffled: every rule
is an expression over one row, with time n log n in the length of the text.

Defined cases: null and empty texts have no words, fail the base and are not kept; lines that
are equal count as repeated from the second on; rows that repeat an id are judged each by its text;
an empty table gives an empty result; very long texts are judged whole. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgraph.llm.common import WORD

SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MAX_LOSS = 0.5
MIN_WORDS = 10
MAX_REPEAT = 20
WINDOW = 5

#: Separators of menus, breadcrumbs and cell rows; a line with three of one kind is navigation.
CELLS = ("|", "»", " > ", " › ")
#: Four words in a row that end in shouting or in symbols, or one longer run of either.
SHOUT = r"(?:[!?]{2,}[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){4}|[!?]{4,}"
SYMBOL_WORDS = r"(?:[#*$%&|<>]{2,}[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){4}|[#*$%&|<>]{6,}"
#: Stock phrases of sites and scripts, in lower case.
STOCK = (
    "accept cookies", "accept all cookies", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "all rights reserved", "enable javascript", "lorem ipsum", "subscribe to our newsletter", "click here to",
    "skip to content", "skip to main content",
)
#: Each stock phrase holds one of these.
STOCK_PARTS = ("cookie", "privacy policy", "terms of", "rights reserved", "javascript", "lorem ipsum", "newsletter", "click here", "skip to")
#: A line this long, in characters, must hold the end of a sentence.
LONG_LINE = 200
STOPS = (".", "!", "?", "…", ":", ";")


def _count(text: Column, part: str) -> Column:
    """How often part occurs; the search for a part that is absent is one fast pass."""
    return F.when(text.contains(part), ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")).otherwise(0)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _long(line: Column) -> Column:
    return F.when((F.length(line) >= LONG_LINE) & ~_any([line.contains(c) for c in STOPS]), "punctuation")


def line_fails(line: Column) -> Column:
    """The first rule a line breaks: navigation, symbols, shouting, boilerplate, punctuation; else null."""
    return (
        F.when(F.greatest(*[_count(line, cell) for cell in CELLS]) >= 3, "navigation")
        .when(line.rlike(SYMBOL_WORDS), "symbols")
        .when(line.rlike(SHOUT), "shouting")
        .when(_any([F.lower(line).contains(p) for p in STOCK]), "boilerplate")
        .otherwise(_long(line))
    )


def may_fail(text: Column, low: Column, n_symbols: Column) -> Column:
    """False only if no line of the text can break a rule other than the one for long lines."""
    marks = [text.contains(m) for m in ("!!", "??", "!?", "?!", "»", "›")]
    return _any([n_symbols >= 3, *marks, *[low.contains(p) for p in STOCK_PARTS]])


def repeated_words(docs: DataFrame, words: str, out: str) -> DataFrame:
    """Adds out: the words inside word windows of five that occur twice or more in the row."""
    n = F.size(words)
    tail = lambda c, k: F.slice(c, k + 1, F.greatest(n - k, F.lit(0)))
    both = lambda x, y: F.xxhash64(x, y)
    # A window's hash from those of its parts: two words, two pairs, four words and the fifth.
    rows = docs.withColumn("hash_", F.transform(words, lambda w: F.xxhash64(w)))
    rows = rows.withColumn("two_", F.zip_with("hash_", tail("hash_", 1), both))
    rows = rows.withColumn("four_", F.zip_with("two_", tail("two_", 2), both)).drop("two_")
    windows = F.slice(F.zip_with("four_", tail("hash_", 4), both), 1, F.greatest(n - WINDOW + 1, F.lit(0)))
    rows = rows.withColumn("window_", windows).drop("four_", "hash_")
    # Sorting is for the rows with a repeat only; array_distinct is one pass over a hash set.
    rows = rows.withColumn(
        "sorted_",
        F.when(
            F.size(F.array_distinct("window_")) < F.size("window_"),
            F.array_sort(F.transform("window_", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("window_")

    def twice(x: Column, k: Column) -> Column:
        near = [F.coalesce(F.get(F.col("sorted_"), k + d)["h"] == x["h"], F.lit(False)) for d in (-1, 1)]
        return near[0] | near[1]

    rows = rows.withColumn("starts_", F.array_sort(F.transform(F.filter("sorted_", twice), lambda x: x["i"]))).drop("sorted_")
    covered = F.aggregate(
        F.transform("starts_", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("starts_"), k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda s, x: s + x,
    )
    return rows.withColumn(out, F.coalesce(covered, F.lit(0).cast("long"))).drop("starts_")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """One row per document: id, the base counts, base_failed, the lines removed by rule, clean_text, kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("text_"))
    rows = rows.withColumn("words_", F.array_remove(F.split("text_", SPACE_RUN), ""))
    rows = repeated_words(rows, "words_", "n_repeat_words")
    rows = rows.withColumn("n_words", F.size("words_").cast("long"))
    rows = rows.withColumn("word_chars", F.length(F.array_join("words_", "")).cast("long")).drop("words_")
    rows = rows.withColumn("lines_", F.filter(F.split("text_", "\n"), lambda x: x.rlike(WORD)))
    n_symbols = F.lit(0).cast("long")
    for c in SYMBOLS:
        n_symbols = n_symbols + _count(F.col("text_"), c)
    rows = rows.withColumn("n_symbols", n_symbols).withColumn("low_", F.lower("text_"))
    judged = lambda rule: F.transform("lines_", lambda x: F.struct(x.alias("line"), rule(x).alias("rule")))
    judge = F.when(may_fail(F.col("text_"), F.col("low_"), F.col("n_symbols")), judged(line_fails)).otherwise(judged(_long))
    rows = rows.withColumn("judged_", judge).drop("low_")
    lost = F.aggregate(
        F.filter("judged_", lambda x: x["rule"].isNotNull()),
        F.lit(0).cast("long"),
        lambda s, x: s + F.length(F.regexp_replace(x["line"], SPACE_RUN, "")),
    )
    rows = rows.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        lost.alias("lost_chars"),
        F.filter(F.transform("judged_", lambda x: x["rule"]), lambda r: r.isNotNull()).alias("failed_rules"),
        F.array_join(F.transform(F.filter("judged_", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost_chars") <= max_loss * F.col("word_chars")))
