"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are maximal runs of characters other than space and tab to carriage return. All measures come from the whole text:
lengths, symbols, stop words, repeated lines and repeated runs of eight words. A null text counts as a text without words.
No rule bounds the length above, and vocabulary is the mean share of distinct words in consecutive blocks of ``BLOCK`` words,
weighted by their words: the share in the whole text would fall with length for any clean text.

Defined results: a text without words fails the base rule and every ratio of it is null, which no threshold accepts.
Rows are judged one by one, so repeated ids and rows each get their own verdict, in any order, with ties impossible.
Extra columns are left out by ``measured`` and kept by ``accepted``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.functions.once import once
from snapdelta.llm.common import BLANKS, without, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
BLOCK = 500

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it was as on be are with by this an at from "
    "der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch "
    "le la les de et en un une du est que dans qui pour par sur au pas "
    "el y los se del las por con para es una su al lo como no"
).split()

# measure, least, most; None leaves a side open. All must hold.
THRESHOLDS = (
    ("n_words", 20, None),
    ("word_length", 2.0, 14.0),
    ("symbol_ratio", None, 0.1),
    ("stop_ratio", 0.03, None),
    ("distinct_ratio", 0.28, None),
    ("dup_line_ratio", None, 0.3),
    ("repeat_ratio", None, 0.3),
)
# The same with the words in repeated lines instead of the lines: one short line said twice costs a short text little.
BY_WORDS = tuple(("dup_word_ratio", *rule[1:]) if rule[0] == "dup_line_ratio" else rule for rule in THRESHOLDS)


def _repeated(words: Column, hashes: Column) -> Column:
    """Words inside windows of eight that occur at least twice in the text.

    Windows are first compared by hash: a text without equal hashes has no equal windows. For the others the windows
    themselves are sorted and compared, and the words that their starts cover are counted.
    """

    def wider(step: int):
        return lambda a: F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + step)))

    def of_hashes(hashes: Column, all_words: Column) -> Column:
        """Hashes of windows by doubling: pairs, then fours, then eights."""
        eights = once(once(once(hashes, wider(1)), wider(2)), wider(4))
        marks = F.slice(eights, 1, F.size(hashes) - (WINDOW - 1))
        return once(marks, lambda m: F.when(F.size(F.array_distinct(m)) == F.size(m), F.lit(0)).otherwise(exact(m, all_words)))

    def twins(ordered: Column, key: str, start: str) -> Column:
        """Starts whose key equals that of a neighbour in the sorted array."""
        def alike(x, k):
            before = (k > 0) & (F.get(ordered, F.greatest(k - 1, F.lit(0)))[key] == x[key])
            return before | F.coalesce(F.get(ordered, k + 1)[key] == x[key], F.lit(False))

        return F.transform(F.filter(ordered, alike), lambda x: x[start])

    def exact(marks: Column, all_words: Column) -> Column:
        by_hash = F.sort_array(F.transform(marks, lambda m, i: F.struct(m.alias("k"), (i + 1).alias("i"))))
        maybe = once(by_hash, lambda o: twins(o, "k", "i"))
        windows = F.transform(maybe, lambda i: F.struct(F.array_join(F.slice(all_words, i, WINDOW), " ").alias("k"), i.alias("i")))
        found = once(F.sort_array(windows), lambda o: F.sort_array(twins(o, "k", "i")))
        return once(found, covered)

    def covered(starts: Column) -> Column:
        each = F.transform(starts, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(each, F.lit(0), lambda a, b: a + b)

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(of_hashes(hashes, words))


def _distinct(hashes: Column) -> Column:
    """Distinct words of each block, added up."""
    blocks = F.sequence(F.lit(0), (F.size(hashes) / BLOCK).cast("int"))
    return F.aggregate(blocks, F.lit(0), lambda n, k: n + F.size(F.array_distinct(F.slice(hashes, k * BLOCK + 1, BLOCK))))


def _measures(text: Column, thresholds) -> Column:
    """A struct of all counts; the words are split once, and those of distinct lines again where a threshold asks."""
    by_words = any(rule[0] == "dup_word_ratio" for rule in thresholds)
    gap_bytes = F.octet_length(text) - F.octet_length(without(text, BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def line_counts(x: Column, words: Column) -> Column:
        fields = [F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")]
        if by_words:
            once_each = F.size(words_of(F.array_join(F.array_distinct(x), "\n")))
            repeated = F.when(F.size(x) == F.size(F.array_distinct(x)), F.lit(0)).otherwise(F.size(words) - once_each)
            fields.append(repeated.alias("w"))
        return F.struct(*fields)

    def of_words(words: Column) -> Column:
        hashed = F.transform(words, lambda w: F.xxhash64(w))
        return once(hashed, lambda hashes: counts(words, hashes))

    def counts(words: Column, hashes: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            (F.char_length(text) - gap_bytes).cast("bigint").alias("word_chars"),
            (F.octet_length(text) - F.octet_length(without(text, SYMBOLS))).cast("bigint").alias("n_symbols"),
            once(lines, lambda x: line_counts(x, words)).alias("lines"),
            _distinct(hashes).cast("bigint").alias("n_distinct"),
            _repeated(words, hashes).cast("bigint").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        )

    return once(words_of(text), of_words)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=BY_WORDS) -> DataFrame:
    """Counts and verdict of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), _measures(text, thresholds).alias("m"))
    return rows.select("doc_id", *_columns(F.col("m"), thresholds))


def _columns(m: Column, thresholds) -> list[Column]:
    words = F.nullif(m["n_words"], F.lit(0))
    ratios = {
        "n_words": m["n_words"],
        "word_length": m["word_chars"] / words,
        "symbol_ratio": m["n_symbols"] / words,
        "stop_ratio": m["n_stop_words"] / words,
        "distinct_ratio": m["n_distinct"] / words,
        "dup_line_ratio": m["lines"]["d"] / F.nullif(m["lines"]["n"], F.lit(0)),
        "repeat_ratio": m["n_repeat_words"] / words,
    }
    if any(rule[0] == "dup_word_ratio" for rule in thresholds):
        ratios["dup_word_ratio"] = m["lines"]["w"] / words
    base_failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    passes = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            passes = passes & F.coalesce(ratios[name] >= F.lit(least), F.lit(False))
        if most is not None:
            passes = passes & F.coalesce(ratios[name] <= F.lit(most), F.lit(False))
    return [
        m["n_words"].alias("n_words"),
        m["word_chars"].alias("word_chars"),
        m["n_symbols"].alias("n_symbols"),
        m["lines"]["d"].cast("bigint").alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        (~base_failed & passes).alias("kept"),
        m["n_stop_words"].alias("n_stop_words"),
    ]


def accepted(docs: DataFrame, text_col: str = "text", thresholds=BY_WORDS) -> DataFrame:
    """The rows that pass, with their columns as they are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    judged = docs.withColumn("__m", _measures(text, thresholds))
    kept = _columns(F.col("__m"), thresholds)[6]
    return judged.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
