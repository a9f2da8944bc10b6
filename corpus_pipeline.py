"""A pipeline over documents: toxic ones go, copies and near copies go, domains are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read
again before the next. Toxicity decides by the text of each row, copies go by id and
text, near copies and rates by id alone; a null id passes all of these but the first.
Repeated rows (of one id and one text) stay or go together. Empty texts, null among them,
are copies of each other. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.llm import byte_bpe, exact_dedup, mixing, ngram_join, toxicity
from ridelens.llm.shared import prepare, stored, table, unused


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    prepare(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scored(model, F.col("text"))["score"] < toxicity.THRESHOLD)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id; another text under the id of one that goes stays."""
    prepare(spark)
    digest = unused("text_sha256", docs)
    copies = exact_dedup.exact_duplicates(docs).where("not kept").select("doc_id", F.col("text_sha256").alias(digest)).distinct()
    lowered = F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase)
    marked = docs.withColumn(digest, F.sha2(lowered.cast("binary"), 256))
    return marked.join(copies, ["doc_id", digest], "left_anti").select(docs.columns)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the one with the largest id."""
    prepare(spark)
    others = ngram_join.near_duplicates(docs).where("doc_id != class_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says; small domains gain, large ones lose."""
    prepare(spark)
    n, copy = unused("copies", docs), unused("copy", docs)
    mixed = mixing.mixture(docs, table(spark, sf_dir, "labels"))
    rates = mixed.groupBy("doc_id").agg(F.max("copies").alias(n))
    times = F.coalesce(n, F.lit(1))
    repeated = docs.join(rates, "doc_id", "left").where(times > 0)
    return repeated.withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their tokens, and whether these decode to the text; columns of these names are replaced."""
    prepare(spark)
    text = F.coalesce("text", F.lit("")).cast("binary")
    made = {"ids": F.col("ids"), "n_tokens": (F.octet_length("ids") / 4).cast("long"), "decodes": F.col("decoded") == text}
    kept = [c for c in docs.columns if c not in (*made, "decoded")]
    return byte_bpe.coded(docs.select(kept)).select(*kept, *(value.alias(name) for name, value in made.items()))


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("ngram_join", remove_near_copies),
    ("mixing", mix),
    ("byte_bpe", encode),
]

ORACLE_SQL = None  # learned scores, MinHash and merges are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage makes is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
