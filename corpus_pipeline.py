"""From raw documents to token ids: five stages, each over all that the one before kept.

Toxic documents go, one document of each group of near-duplicates stays, personal data is
masked, sources are mixed to their target weights (a document that the mix takes k times has k
rows) and texts are encoded. Every stage is written as Parquet and read again.
"""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgraph.llm import bpe, minhash, mixing, ordinal, personal
from corpusgraph.session import checkpoint_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least share of two documents' shingles that makes them near copies, as a fraction.
NEAR = (80, 100)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = ordinal.train(docs.select("doc_id", "text"), labels)
    return ordinal.without_toxic(docs.select(*COLUMNS), model)


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with keys that tell texts, and ids and sources, apart; nulls included."""
    tkey = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    dkey = F.to_json(F.struct("doc_id", "source"))
    return docs.select(*COLUMNS, tkey.alias("_tkey"), dkey.alias("_dkey"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least id. Documents without words stay.

    Links are Jaccard similarities of 0.8 or more of the full sets of five-word shingles. With 24
    bands of four slots a pair at 0.8 shares no bucket with a chance of 3 in a million.
    """
    groups = minhash.near_duplicates(docs.select("doc_id", "text"), threshold=NEAR, slots=96, bands=24)
    one = groups.filter("component_key IS NOT NULL").groupBy("component_key").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "tkey")).alias("one")).select(
        F.col("one.tkey").alias("_tkey"), F.to_json(F.struct(F.col("one.id").alias("doc_id"))).alias("_ikey"))
    rows = docs.select(*COLUMNS, F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("_tkey"),
                       F.to_json(F.struct("doc_id")).alias("_ikey"))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(mixing.WORD)
    kept = rows.filter(~wordless).join(one, ["_tkey", "_ikey"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("_tkey", "_ikey").orderBy("source"))
    once = kept.withColumn("_rank", rank).filter("_rank = 1")
    return once.select(*COLUMNS).unionByName(rows.filter(wordless).select(*COLUMNS))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the new text."""
    return personal.redact_personal(docs.select(*COLUMNS)).withColumn(
        "n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents that it does not take go."""
    rows = _keyed(docs)
    taken = mixing.mix(rows, mixing.word_count(F.col("text")), keep=["_tkey", "_dkey"]).groupBy("_tkey", "_dkey").agg(
        F.sum("repeats").alias("repeats"), F.count("*").alias("rows")).filter("repeats > 0")
    # rows alike in text, id and source share their repeats
    rank = F.row_number().over(Window.partitionBy("_tkey", "_dkey").orderBy("lang"))
    met = rows.join(taken, ["_tkey", "_dkey"]).withColumn("_rank", rank)
    times = (F.floor(F.col("repeats") / F.col("rows")) + (F.col("_rank") <= F.col("repeats") % F.col("rows")).cast("int")).cast("int")
    return met.withColumn("_times", times).filter("_times > 0").withColumn(
        "_turn", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row (little-endian, 32 bits) and the SHA-256 of what they decode to: ``doc_id, n_tokens, ids, decoded_sha256``."""
    coded = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest_decoded=True)
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", "ids", F.col("decoded").alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("personal data", mask_personal),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL cannot express the trained models; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark).rstrip('/')}/corpusgraph/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
