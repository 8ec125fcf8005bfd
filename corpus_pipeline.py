"""A corpus pipeline: quality, near duplicates, secrets, source mix, piece ids. Each stage is one operator's decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import mixing, pieces, quality, secrets, shingles
from strandlake.llm.common import maybe_among, written

#: A document goes only if the classifier is sure that it is bad.
REJECT_BELOW = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject.

    A null text is scored as an empty one; repeated rows, null doc_ids and rows of equal text are judged each by the text
    alone; all columns pass through. Without labelled documents, or rows at all, nothing is rejected.
    """
    judged = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filtered(docs, judged, REJECT_BELOW)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates (five-word shingles, similarity 0.8 or more).

    Rows of one doc_id with different texts are judged each by its own text; rows of a null doc_id all stay.
    """
    groups = shingles.near_duplicate_groups(docs)
    gone = written(groups.filter("doc_id <> group").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")).distinct(), "duplicates")
    # the row travels as one column, so that its own names can't clash with those used here
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("__id"), shingles.text_key("text").alias("__text"))
    rows = maybe_among(rows, gone, ["__id", "__text"], "__maybe")
    # rows that surely stay are not shuffled
    stay = rows.filter("NOT __maybe").select("__row.*")
    return stay.union(rows.filter("__maybe").join(gone, ["__id", "__text"], "left_anti").select("__row.*"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced; n_chars follows the text.

    Null and empty texts stay; repeated rows are changed alike; a text of any length is searched as a whole.
    """
    clean = secrets.redact_secrets(docs, secrets.grow(secrets.example_findings(spark)))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it; rows without or with shared doc_ids are units of their own."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row and the digest of what they decode to; a null or empty text has the end id only."""
    import public_tokenizers

    return pieces.piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("source mix", mix_sources),
    ("piece encoding", encode),
]

#: A forest, a random field and merge rounds are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
