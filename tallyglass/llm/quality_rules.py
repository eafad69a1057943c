"""Line-first quality rules: bad lines go, then documents that lose too much text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, at, let, words

#: Marks that end a sentence, separators of menus, phrases of site furniture.
SENTENCE_END = r"[.!?…。！？][\"'”’»)\]]*([\x20\x09-\x0D]|$)"
SEPARATORS = "|»›•·→"
BOILERPLATE = (
    "all rights reserved|cookie policy|cookies policy|use of cookies|uses cookies|accept cookies|privacy policy|"
    "terms of use|terms of service|terms and conditions|enable javascript|javascript is disabled|lorem ipsum|"
    "click here|read more|sign in|log in|sign up|subscribe to our|skip to content|back to top|powered by"
)
SYMBOLS = "[^#*$%&|<>]+"

OK, PUNCTUATION, NAVIGATION, BOILER, NOISE = range(5)


@dataclass(frozen=True)
class Rules:
    """Thresholds; shares are in hundredths so that all arithmetic stays in integers.

    With ``phrase_share`` 0 one phrase of site furniture fails its line, also as the start of longer
    words, as in OP2_SQL. Above 0 only whole phrases count, and a line fails when they make up that
    share of its words.
    """

    min_words: int = 50
    max_repeat_share: int = 50
    max_lost_share: int = 30
    max_symbol_share: int = 10
    shout_words: int = 5
    phrase_share: int = 0


#: Rules of ``clean``: a phrase in a long line does not fail it.
CLEANING = Rules(phrase_share=20)


def visible(text: Column) -> Column:
    """Code points that are in words."""
    return F.length(F.regexp_replace(text, SPACE, "")).cast("long")


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long")


def boilerplate(line: Column, n: Column, rules: Rules) -> Column:
    """Whether a line of n words is site furniture by its phrases."""
    pattern = rf"(^|[\x20\x09-\x0D])({BOILERPLATE})"
    low = F.lower(line)
    if not rules.phrase_share:
        return low.rlike(pattern)
    phrases = F.regexp_extract_all(low, F.lit(pattern + r"(?![\p{L}\p{M}\p{N}_])"), F.lit(2))
    in_phrases = F.aggregate(phrases, F.lit(0), lambda a, x: a + F.size(F.split(x, " ")))
    return low.rlike(pattern) & (in_phrases > 0) & (in_phrases * 100 >= n * rules.phrase_share)


def line_code(line: Column, items: Column, rules: Rules) -> Column:
    """Which rule a line with these words fails: the first of noise, navigation, boilerplate and punctuation.

    A line without a word fails none. Noise is a line of symbols or of one shouted case. Navigation is a run of items between separators. A line fails the
    punctuation rule if no sentence ends in it.
    """

    def separators() -> Column:
        return F.length(F.regexp_replace(line, f"[^{SEPARATORS}]+", ""))

    n = F.size(items)
    many_symbols = line.rlike("[#*$%&|<>]") & (symbols(line) * 100 > visible(line) * rules.max_symbol_share)
    return (
        F.when(n == 0, OK)
        .when(many_symbols, F.when(separators() * 3 >= n, NAVIGATION).otherwise(NOISE))
        .when((n >= rules.shout_words) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}"), NOISE)
        .when(line.rlike(f"[{SEPARATORS}]") & (separators() >= 2) & (separators() * 4 >= n), NAVIGATION)
        .when(boilerplate(line, n, rules), BOILER)
        .when(~line.rlike(SENTENCE_END), PUNCTUATION)
        .otherwise(OK)
    )


def with_repeats(rows: DataFrame, items: str, out: str) -> DataFrame:
    """Adds the number of words that lie in a three-word window which the text holds twice or more.

    The windows of one text are sorted as 64-bit numbers, hash above position, so that equal
    windows become neighbours; neighbours with one hash are then compared word by word. Texts of
    2^20 words or more give the position 31 bits.
    """
    n, w, p = F.size(items), F.col(items), F.col("_packed")

    def packed(bits: int) -> Column:
        def one(x: Column, i: Column) -> Column:
            return F.shiftleft(F.xxhash64(x, at(w, i + 1), at(w, i + 2)), bits).bitwiseOR(i)

        return F.sort_array(F.slice(F.transform(w, one), F.lit(1), n - 2))

    def repeated(bits: int) -> Column:
        """Places of the windows that a neighbour equals."""

        def place(x: Column) -> Column:
            return x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

        def near(i: Column, by: int) -> Column:
            return F.shiftright(at(p, i).bitwiseXOR(at(p, i + by)), bits) == 0

        none = F.array().cast("array<int>")

        def pair(i: Column, by: int) -> Column:
            return let(
                F.struct(place(at(p, i)).alias("q"), place(at(p, i + by)).alias("r")),
                lambda x: F.when(
                    (at(w, x["q"]) == at(w, x["r"])) & (at(w, x["q"] + 1) == at(w, x["r"] + 1)) & (at(w, x["q"] + 2) == at(w, x["r"] + 2)),
                    F.array(x["q"], x["r"]),
                ).otherwise(none),
            )

        equal = F.filter(F.transform(p, lambda x, i: F.when(F.shiftright(x.bitwiseXOR(at(p, i + 1)), bits) == 0, i)), lambda i: i.isNotNull())
        pairs = F.flatten(F.transform(equal, lambda i: F.concat(pair(i, 1), F.when(near(i, 2), pair(i, 2)).otherwise(none))))
        return F.sort_array(F.array_distinct(pairs))

    long_text = n >= (1 << 20)
    step = rows.withColumn("_packed", F.when(n < 3, F.array().cast("array<bigint>")).when(long_text, packed(31)).otherwise(packed(20)))
    step = step.withColumn("_places", F.when(n < 4, F.array().cast("array<int>")).when(long_text, repeated(31)).otherwise(repeated(20)))
    s = F.col("_places")
    spans = F.transform(s, lambda x, i: F.least(F.lit(3), F.coalesce(at(s, i + 1) - x, F.lit(3))))
    total = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)
    return step.withColumn(out, F.when(F.size(s) > 0, total).otherwise(F.lit(0).cast("long"))).drop("_packed", "_places")


def measure(docs: DataFrame, text: str = "text", rules: Rules = Rules(), prefix: str = "") -> DataFrame:
    """Adds the base measures, the verdicts of the lines and ``kept`` to every document.

    A null text counts as empty: no words, not kept. Repeated rows are judged alike. Extra columns
    stay; a column that has the name of a measure is replaced.
    """
    rows = docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_lines", F.split(F.col("_text"), "\n"))
    rows = rows.withColumn("_items", F.transform("_lines", words)).withColumn("_words", F.flatten("_items"))
    rows = rows.withColumn("_full", F.filter("_lines", lambda x, i: F.size(at(F.col("_items"), i)) > 0))
    rows = rows.withColumn("_codes", F.zip_with("_lines", "_items", lambda x, y: line_code(x, y, rules)))
    rows = with_repeats(rows, "_words", "_repeats")
    t, lines, codes = F.col("_text"), F.col("_lines"), F.col("_codes")

    def failed(code: int) -> Column:
        return F.size(F.filter(codes, lambda c: c == code)).cast("long")

    lost = F.aggregate(
        F.zip_with(lines, codes, lambda x, c: F.when(c > OK, visible(x)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    n_words = F.size("_words").cast("long")
    rows = rows.withColumns(
        {
            "n_words": n_words,
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": symbols(t),
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "n_repeat_words": F.col("_repeats"),
            "lines_punctuation": failed(PUNCTUATION),
            "lines_navigation": failed(NAVIGATION),
            "lines_boilerplate": failed(BOILER),
            "lines_noise": failed(NOISE),
            "lost_chars": lost,
            "_row": F.monotonically_increasing_id(),
        }
    )
    base_failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_share)
    rows = rows.withColumn("base_failed", base_failed)
    kept = ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * rules.max_lost_share)
    # a number that depends on the row: filters on the verdict stay above the measures, which they would repeat
    return rows.withColumn("kept", kept & (F.col("_row") >= 0)).drop("_row")


def verdicts(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The measures of every document without the texts."""
    return measure(docs, text, rules).drop("_text", "_items", "_words", "_lines", "_full", "_codes", "_repeats")


def clean(docs: DataFrame, text: str = "text", rules: Rules = CLEANING) -> DataFrame:
    """Documents that are kept by ``rules``, without their failed lines; ``n_chars`` follows where the table has it."""
    whole_row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_doc"), F.col(text).alias("_raw"))
    rows = measure(whole_row, "_raw", rules).where("kept")
    lines = F.filter("_lines", lambda x, i: at(F.col("_codes"), i) == OK)
    whole = F.col("lost_chars") == 0
    rows = rows.withColumn("_out", F.when(whole, F.col("_raw")).otherwise(F.array_join(lines, "\n")))
    out = []
    for c in docs.columns:
        own = F.col("_doc")[c]
        if c == text:
            own = F.col("_out")
        elif c == "n_chars":
            own = F.when(whole, own).otherwise(F.length("_out").cast(docs.schema[c].dataType))
        out.append(own.alias(c))
    return rows.select(out)
