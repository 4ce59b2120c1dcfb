"""What several operators share: reading the table, words, and sizes for partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters that separate words: space, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def without(text: Column, characters: str, instead: str = "") -> Column:
    """The text with each of some ASCII characters replaced; plain byte searches, cheaper than a translation map."""
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(instead))
    return text


def words_of(text: Column) -> Column:
    """The words of a text; an empty array for a null, empty or blank text."""
    spaced = without(F.coalesce(text, F.lit("")), BLANKS[1:], " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts; one narrow pass, used only to size partitions."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("bigint"))).first()[0]
    return int(total or 0)


def pieces(total: int, each: int) -> int:
    """Number of parts of about ``each`` that ``total`` makes, at least one."""
    return max(1, -(-total // each))


def tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path of a public rank file and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN
