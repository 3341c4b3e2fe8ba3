"""The registered queries: each applies one operator to its whole table, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coursemill.store import Store

from .common import read_table
from .dart_minhash import near_duplicates
from .exact import duplicate_groups
from .langid import identify, learn_dictionaries
from .lm import lm_scores
from .merkle import folded, leaf, manifest, proofs
from .phrases import collocations
from .piece_codec import round_trip
from .repeats import without_repeats
from .token_counts import token_counts
from .token_files import read_token_files, write_token_files
from .toxicity import TOXIC_FROM, learn, toxicity
from .warc import normalise, read_records, write_archives
from .winnow import contamination

Query = Callable[[SparkSession, str], DataFrame]


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_groups(read_table(spark, folder, "documents"))


def token_binary(spark: SparkSession, folder: str) -> DataFrame:
    docs, store = read_table(spark, folder, "documents"), Store(spark)
    out = store.fresh_path("token-files")
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = write_token_files(docs, out, store, path, end_id=1, shards=_tasks(spark))
    found = read_token_files(out, manifest, _tasks(spark), docs.schema["doc_id"].dataType.simpleString())
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")
    return contamination(docs, items, Store(spark)).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    scored = toxicity(docs, learn(docs, read_table(spark, folder, "labels")))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def piece_model() -> bytes:
    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def sentencepiece_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(read_table(spark, folder, "documents"), piece_model())


def token_count(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts(read_table(spark, folder, "documents"), piece_model())
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return identify(docs, learn_dictionaries(docs)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = without_repeats(read_table(spark, folder, "documents"), Store(spark))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read_table(spark, folder, "documents"), Store(spark))


def warc(spark: SparkSession, folder: str) -> DataFrame:
    pages, store = read_table(spark, folder, "pages"), Store(spark)
    streams, members = store.fresh_path("warc-streams"), store.fresh_path("warc-members")
    files = write_archives(pages, streams, store)
    index = normalise(files, streams, members, store, _tasks(spark))
    kind = pages.schema["page_id"].dataType
    return read_records(index, members, _tasks(spark), with_html=False).select(
        F.col("page_id").try_cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").try_cast(kind).alias("refers_to"),
    )


def lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(read_table(spark, folder, "documents"), piece_model(), Store(spark))


def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")

    def digest(n_chars: Column) -> Column:
        return leaf(docs["doc_id"], docs["source"], docs["lang"], n_chars, docs["text"])

    tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    rows = docs.select(
        docs["lang"].alias("tree"),
        docs["doc_id"].alias("id"),
        digest(docs["n_chars"]).alias("digest"),
        F.when(tampered, digest(docs["n_chars"] + 1)).alias("changed"),
    )
    proved = proofs(manifest(rows, Store(spark)))
    checked = folded(proved.withColumn("found", F.coalesce("changed", "digest")), "found")
    texts = {"leaf": "digest", "subroot": "subroot", "root": "root", "folded_root": "folded"}
    return checked.select(
        F.col("id").alias("doc_id"),
        *(F.lower(F.hex(c)).alias(name) for name, c in texts.items()),
        "proof_sha256",
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(read_table(spark, folder, "documents"), Store(spark))


def llm_queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": exact_dedup,
        "op2_decontamination": decontamination,
        "op3_toxicity": toxicity_scores,
        "op4_sentencepiece": sentencepiece_round_trip,
        "op5_token_counts": token_count,
        "op6_language_id": language_id,
        "op7_suffix_dedup": suffix_dedup,
        "op8_minhash_near_dedup": minhash_near_dedup,
        "op9_warc": warc,
        "op10_token_binary": token_binary,
        "op11_lm_scoring": lm_scoring,
        "op12_merkle_manifest": merkle_manifest,
        "op13_collocations": phrase_collocations,
    }
