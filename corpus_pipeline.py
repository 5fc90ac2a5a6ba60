"""A training corpus from the documents table: quality, near duplicates, repeated strings, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each to the shared folder and reads it
back for the next.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.llm import jaccard, mixing, pieces, quality, suffix_dedup
from trellis.llm.shared import materialize

#: Near duplicates: five-word shingles, similarity 0.8.
NEAR = jaccard.Join(size=5, percent=80)

#: The mixture is sampled and pieces are not SQL: no oracle, tests compare with a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; null, empty and very short texts go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the smallest id; rows that repeat an id stay together."""
    return jaccard.one_per_group(docs, join=NEAR)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a smaller document has; n_chars follows the text."""
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it (0, 1 or 2 times)."""
    key = ("hash", "src")
    # rows that are equal in id, text and source are told apart by a number
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("n"))
    left = docs.select(F.struct(*docs.columns).alias("row"), mixing.row_hash(docs).alias("hash"), F.col("source").alias("src"), F.lit(0).alias("n")).withColumn("turn", turn)
    mixed = mixing.mix_sources(docs, hash_col="hash")
    right = mixed.select("hash", F.col("source").alias("src"), F.col("copies").alias("n"), "copies").withColumn("turn", turn)
    same = (left["hash"] == right["hash"]) & left["src"].eqNullSafe(right["src"]) & (left["turn"] == right["turn"])
    joined = left.join(right, same).filter("copies > 0")
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces in place of the text."""
    encoded = pieces.encode(docs.select("doc_id", "text", "lang", "source", "n_chars"), out_col="piece_ids")
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("mixing sources", source_mix),
    ("SentencePiece", sentence_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
