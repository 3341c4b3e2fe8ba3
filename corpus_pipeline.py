"""A corpus pipeline: from documents to the token ids of those that are fit to train on.

Each stage takes all that the one before kept, as written Parquet, and its decisions take effect: toxic documents
go, then exact copies, then all but one document of every group of near duplicates, then documents that hold
benchmark passages. The last stage encodes what is left. Until then the columns are those of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.llm.common import read_table
from coursemill.llm.dart_minhash import near_duplicates
from coursemill.llm.exact import without_duplicates
from coursemill.llm.piece_codec import encode
from coursemill.llm.queries import piece_model
from coursemill.llm.toxicity import TOXIC_FROM, learn, toxicity
from coursemill.llm.winnow import contamination
from coursemill.session import apply_settings
from coursemill.store import Store

#: Whole documents are large rows: with fewer of them in a batch, workers and executors hold less text at once.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2500"}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a score below the threshold. The network learns from the labelled rows of ``docs``."""
    apply_settings(spark, BATCHES)
    scored = toxicity(docs, learn(docs, read_table(spark, folder, "labels")), carry=True)
    return scored.filter(F.col("score") < TOXIC_FROM).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of equal texts the document with the smallest id; null and empty texts are equal, null ids come last."""
    return without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id; a null id comes after all others.

    Rows are told apart by id and text, so near copies that share an id, or have none, are one class like any
    other, of which the smallest digest among the equal ids stays. Rows that repeat an id with its text stay
    together; the stage before has removed them. Null, empty and wordless texts are alone and stay. Other columns
    come through, whatever they are called.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    key = F.struct(
        docs["doc_id"].isNull().alias("none"),
        F.coalesce(docs["doc_id"].cast("bigint"), F.lit(0)).alias("id"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    )
    found = near_duplicates(docs.select(key.alias("key"), docs["text"]), Store(spark), id_column="key")
    stay = found.filter("key = class_id").select("key").distinct()
    return docs.select(F.struct("*").alias("row"), key.alias("key")).join(stay, "key", "left_semi").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without any window of a benchmark item; a null or empty text has none and stays."""
    found = contamination(docs, read_table(spark, folder, "benchmark"), Store(spark), carry=True)
    return found.filter("n_hit = 0").select("row.*")


def encode_texts(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document: doc_id, ``ids``, ``n_tokens``. A null or empty text has no ids."""
    apply_settings(spark, BATCHES)
    return encode(docs, piece_model()).withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece encoding", encode_texts),
]

#: SQL cannot express the toxicity network; the pipeline is tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again before the next."""
    store = Store(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
