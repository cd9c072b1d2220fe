"""Quality rules, line first: bad lines are removed, then documents that lost too much are rejected.

Every rule is a built-in expression over one row, so the operator is a single
scan without a shuffle and its cost grows with the text alone.

Line rules (a line without a word is neither good nor bad and stays):

* ``symbols``: more than a tenth of its characters are markup symbols;
* ``shouting``: at least a third of its words, and three or more, end in ``!!``;
* ``navigation``: two or more menu separators, one for every four words or more;
* ``punctuation``: four words or more, no closing mark at the end and no mark of
  a sentence, a list or a heading anywhere in it;
* ``boilerplate``: a fixed phrase of web furniture in a line of at most twelve words.

A document is rejected if the base counts say so (too few words, or too many
words in repeated eight-word windows) or if its failed lines hold more than
``MAX_LOST_PERCENT`` of its word characters.

Null and empty texts have no words, and the cleaned text of a null stays null.
Repeated rows are judged one by one, and columns of any name are carried along
unchanged. A very long text is one row like any other; of equal lines or windows every
one counts. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.exprs import SPACE, let, occurrences, words

#: Fixed values of the base counts.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

MAX_LOST_PERCENT = 50
MARKUP = r"[#*$%&|<>{}\\^~_=]"
SEPARATORS = r"[|»›•]"
#: Marks that may close a line.
CLOSING = [*".!?…:;\"'”’»)]。！？"]
INNER_MARK = r"[.,:;?!…#*`(){}=]"
#: Phrases of web furniture.
BOILERPLATE = (
    r"(?i)(cookie policy|accept cookies|enable javascript|javascript is disabled|sign up for our newsletter|"
    r"skip to content|click here to|share on facebook|follow us on|back to top|add to cart|lorem ipsum)"
)


def _failed_line(line: Column) -> Column:
    """Whether a line, trimmed and with at least one word, breaks a line rule; cheap tests guard the costly ones."""
    n_words = F.size(words(line))
    shouts = F.size(F.split(line, r"!!+(?:[\x20\x09-\x0D]|$)")) - 1
    separators = occurrences(line, SEPARATORS)
    unclosed = ~F.right(line, F.lit(1)).isin(CLOSING)
    return (
        (line.rlike(MARKUP) & (occurrences(line, MARKUP) * 10 > F.length(line)))
        | (line.contains("!!") & (shouts >= 3) & (shouts * 3 >= n_words))
        | (line.rlike(SEPARATORS) & (separators >= 2) & (separators * 4 >= n_words))
        | (unclosed & ~line.rlike(INNER_MARK) & (n_words >= 4))
        | ((F.length(line) <= 200) & line.rlike(BOILERPLATE) & (n_words <= 12))
    )


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE))


def _good(line: Column) -> Column:
    return let(_bare(line), lambda t: F.when(t == "", F.lit(True)).otherwise(~_failed_line(t)))


def repeated_words(tokens: Column) -> Column:
    """Words covered by the windows of WINDOW words that occur twice or more in ``tokens``.

    Windows are compared by a 64-bit hash; only where two hashes of a text agree
    are the windows sorted by hash, and neighbours compared word by word.
    """

    def covered(starts: Column) -> Column:
        gaps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

    def with_hashes(hashes: Column) -> Column:
        def doubled(span: int) -> Callable[[Column], Column]:
            ahead = lambda h: F.slice(h, span + 1, F.size(h) - span)
            return lambda h: F.zip_with(F.slice(h, 1, F.size(h) - span), ahead(h), lambda a, b: F.xxhash64(a, b))

        windows = let(let(doubled(1)(hashes), doubled(2)), doubled(4))

        def same(a: Column, b: Column) -> Column:
            return (a.h == b.h) & (F.slice(tokens, a.i, F.lit(WINDOW)) == F.slice(tokens, b.i, F.lit(WINDOW)))

        def flagged(placed: Column) -> Column:
            twin = lambda x, j: (
                F.coalesce(same(x, F.get(placed, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(placed, j + 1)), F.lit(False))
            )
            return let(F.array_sort(F.transform(F.filter(placed, twin), lambda x: x.i)), covered)

        def places(w: Column) -> Column:
            placed = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))
            return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(placed, flagged))

        return let(windows, places)

    hashes = F.transform(tokens, lambda w: F.xxhash64(w))  # of 1 word; doubled three times to WINDOW words
    return F.when(F.size(tokens) < WINDOW + 1, F.lit(0)).otherwise(let(hashes, with_hashes))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``quality`` (one of that name is replaced): base counts, verdicts and ``cleaned``, the text without failed lines."""
    body = F.coalesce(F.col(text), F.lit(""))

    def facts(tokens: Column) -> Column:
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
            repeated_words(tokens).cast("long").alias("n_repeat_words"),
        )

    def about_lines(lines: Column) -> Column:
        spoken = F.filter(lines, lambda x: _bare(x) != "")
        repeats = let(spoken, lambda s: F.size(s) - F.size(F.array_distinct(s)))
        return let(
            F.filter(lines, _good),
            lambda kept: F.struct(
                repeats.cast("long").alias("n_dup_lines"),
                (F.size(lines) - F.size(kept)).alias("n_failed"),
                F.array_join(kept, "\n").alias("cleaned"),
            ),
        )

    counted = docs.withColumn("__f", let(words(F.col(text)), facts)).withColumn("__l", let(F.split(body, "\n", -1), about_lines))
    lasting = F.when(F.col("__l.n_failed") == 0, F.col("__f.word_chars")).otherwise(
        F.length(F.regexp_replace(F.col("__l.cleaned"), r"[\x20\x09-\x0D]+", "")).cast("long")
    )
    counted = counted.withColumn("__k", lasting).withColumn("__s", occurrences(body, SYMBOLS).cast("long"))
    base_failed = (F.col("__f.n_words") < MIN_WORDS) | (F.col("__f.n_repeat_words") * 100 > F.col("__f.n_words") * MAX_REPEAT_PERCENT)
    lost = (F.col("__f.word_chars") - F.col("__k")) * 100 > F.col("__f.word_chars") * MAX_LOST_PERCENT
    quality = F.struct(
        F.col("__f.n_words").alias("n_words"),
        F.col("__f.word_chars").alias("word_chars"),
        F.col("__s").alias("n_symbols"),
        F.col("__l.n_dup_lines").alias("n_dup_lines"),
        F.col("__f.n_repeat_words").alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        (~base_failed & ~lost).alias("kept"),
        F.when(F.col(text).isNotNull(), F.col("__l.cleaned")).alias("cleaned"),
    )
    return counted.withColumn("quality", quality).drop("__f", "__l", "__k", "__s")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their failed lines; same columns, ``n_chars`` brought up to date."""
    judged = measure(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    # a filter would be pushed below and measure every text a second time
    kept = judged.select("row", F.explode(F.filter(F.array("quality"), lambda q: q.kept)).alias("quality"))
    made = {"text": F.col("quality.cleaned").alias("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("quality.cleaned").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return kept.select(*(made.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return measure(docs.select("doc_id", "text")).select("doc_id", *(F.col(f"quality.{f}") for f in fields))
