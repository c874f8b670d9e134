"""From raw documents to packed training sequences: language, line dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder and reads it again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import language_id, line_dedup, mixing, near, packing
from rasterloom.session import materialize, table

#: A text whose best language still needs more bits a symbol than this fits no learned language.
MAX_BITS = 6.5

# All stages: further columns are returned as they came, whatever their names; an empty table gives an empty result.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (und; so null and empty texts go) and those that no learned language codes well.

    Rows are judged one by one: repeated rows and rows with a null doc_id, lang or source stay or go like any other.
    """
    learned = language_id.sample(docs, language_id.training_rows())
    found = language_id.identify(docs, learned)
    return found.filter((F.col("lang_pred") != "und") & (F.col("bits_per_symbol") <= MAX_BITS)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs. A document of which no line is left goes; n_chars follows the text.

    Documents are told apart by doc_id and text, null ids coming first; rows that repeat both are one document, and all
    stay. Null and empty texts stay as they are. Ties cannot occur: places are unique.
    """
    found = line_dedup.dedup(docs)
    found = found.filter((F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars.cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id stays.

    Of equal texts one row stays, so repeated rows are one; a null doc_id comes last; rows that share a doc_id are told apart
    by their texts, and ties go to the smaller text hash. Null and empty texts count as copies of each other.
    """
    return near.survivors(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents as the mix takes them: as many whole copies as their taken words fill, and one more for a
    part of at least half. A document that the mix takes less than half of goes; one without words (or a null text) stays.

    A null source is a source of its own. Rows that share a doc_id, null or not, get the greatest number of copies that one
    of them has; reruns agree, for the mix's order hangs on doc_id alone.
    """
    rows, pieces = mixing.mix(docs)
    counts = mixing.taken(rows, pieces).withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)))
    counts = counts.groupBy("key").agg(F.max("copies").cast("int").alias("copies"))
    counts = materialize(counts.filter("copies > 0").withColumnRenamed("key", "__mix_key"), "pipeline-copies")
    # counts grow with the documents: a shuffle at every size, no broadcast
    joined = docs.join(counts.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__mix_key")))
    return joined.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of at most 2048 tokens: a null or empty text is one piece of the
    end id, and repeated rows and rows with a null doc_id are packed each."""
    pieces = packing.cut(docs).withColumn("ids_crc32", F.crc32("ids"))
    return packing.place(materialize(pieces.drop("ids"), "pipeline-pieces"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("pack", pack)]

#: Suffix automata, MinHash and subset sums are no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
