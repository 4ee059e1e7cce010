"""A training corpus from raw documents, in five stages.

Each stage gets what its predecessor kept, decides with one of the operators in
``basketry.llm``, and returns the documents' own columns; the last returns the
packed sequences.  Between stages the documents are written and read again, so
a lost executor costs the stage at hand only.

The first three stages name every row by a hash of its id and text, and what they
decide is joined to the documents by that.  Ids may be null or repeated: only rows
equal in id and text share their fate, and are one document to the near-duplicate
stage.  Copies that the mix takes are packed one by one.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import jaccard_join, mixture, packing, perplexity, weak_quality
from basketry.llm.queries import VOCABULARY
from basketry.session import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key of their own; nulls count, as a hash would pass over them."""
    parts = [part for c in ("doc_id", "text") for part in (F.col(c), F.col(c).isNull())]
    return docs.select(*COLUMNS, F.xxhash64(*parts).alias("row_key"))


def by_key(docs: DataFrame) -> DataFrame:
    """What an operator reads: the key stands for the id."""
    return keyed(docs).withColumn("doc_id", F.col("row_key")).drop("row_key")


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The documents whose key is not among the rejected."""
    out = staged(rejected.select(F.col("doc_id").alias("out")).distinct(), "rejected")
    return keyed(docs).join(out, F.col("row_key") == F.col("out"), "left_anti").select(*COLUMNS)


def once_each(docs: DataFrame) -> DataFrame:
    """One row a key; only texts whose key repeats are shuffled."""
    docs = keyed(docs)
    repeated = docs.groupBy(F.col("row_key").alias("again")).count().filter("count > 1").select("again")
    repeated = staged(repeated, "repeated")
    if repeated.isEmpty():
        return docs.select(*COLUMNS)
    same = F.col("row_key") == F.col("again")
    rest = docs.join(repeated, same, "left_semi").dropDuplicates(["row_key"])
    return docs.join(repeated, same, "left_anti").union(rest).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie inside their language's perplexity band."""
    return without(docs, perplexity.quality(by_key(docs)).filter("not kept"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier holds for good."""
    return without(docs, weak_quality.quality(by_key(docs)).filter("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group over links of five-word shingles with a similarity of 0.8 or more: the least id.

    A null id comes after all others; the key decides between equal ids.
    """
    settings = jaccard_join.Settings(words=5, percent=80)
    found = jaccard_join.linked_components(by_key(docs), settings)
    found = found.select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    ids = keyed(docs).select("row_key", "doc_id")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    least = ids.join(found, "row_key").groupBy("component_id").agg(F.min(place).alias("least"))
    least = staged(least.select(F.col("least.row_key").alias("chosen")), "chosen")
    chosen = keyed(docs).join(least, F.col("row_key") == F.col("chosen"), "left_semi")
    return once_each(chosen)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at its target weights: a row for each copy that it takes."""
    return mixture.mixed_documents(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: every piece of every copy with its place."""
    return packing.pack(docs, VOCABULARY)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing_to_weights", mixing),
    ("best_fit_packing", packed),
]

# Perplexities, learned labels, random draws and token ids have no SQL; tests hold
# the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
