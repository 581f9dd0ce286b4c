"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
stage's docs. All but the last return the columns of documents. Ties fall by doc_id; extra columns are carried along,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.llm import exactdedup, mixing, packing, quality, setjoin
from zonecast.llm.common import drop, keep, lower_ascii, settle

#: SQL has no tokenizer, so the last stage is tested against a brute-force version.
ORACLE_SQL = None


def _rows(docs: DataFrame, **keys: Column) -> DataFrame:
    """(row, keys): each row as a struct beside its keys, so that no column of it can clash."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in keys.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, each row by its own text: null, empty and short texts go, repeated rows go alike."""
    return quality.kept(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (null counts as empty, A-Z as a-z): that of the largest doc_id.

    Of rows that repeat it with the same text, the one least as JSON stays, whatever the order of rows. A row without a doc_id stays only where no row of its group has one.
    """
    kept = exactdedup.groups(docs).where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    rows = _rows(docs, id=docs["doc_id"], sha=F.sha2(lower_ascii(F.coalesce(docs["text"], F.lit(""))), 256))
    found = rows.join(kept, rows["id"].eqNullSafe(kept["doc_id"]) & (rows["sha"] == kept["text_sha256"])).select("row", "id", "sha", "times")
    again = found.where("times > 1").groupBy("id", "sha").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return found.where("times = 1").select("row").union(again.select("row")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group of near duplicates: five-word shingles, Jaccard 0.8 and more.

    Rows that share a doc_id stay or go together. Rows without one, and those without words, are near to none and stay.
    """
    least = setjoin.join_components(docs, words=5, percent=80).where("doc_id = component_id").select("doc_id")
    rows = _rows(docs, id=docs["doc_id"])
    return rows.join(least, rows["id"] == least["doc_id"], "left_semi").select("row.*").union(rows.where("id IS NULL").select("row.*"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those that it takes no time, and those without words, go.

    Copies share their doc_id. Rows that share a doc_id, or have none, are all taken as often as the most taken of them.
    """
    copies = mixing.mix(docs).groupBy(F.col("doc_id").alias("of")).agg(F.max("copies").cast("int").alias("times")).where("times > 0")
    rows = _rows(docs, id=docs["doc_id"])
    return rows.join(copies, rows["id"].eqNullSafe(copies["of"])).select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 4,096 tokens. Null and empty texts are an end token; each row is packed."""
    import public_tokenizers

    items = keep(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return packing.pack(items)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each is written to the shared folder and read again. What came before it is deleted then, the last one when the process ends."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = settle(partial(stage, spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return docs
