"""The operators applied to whole tables, with production parameters, and SQL for those that have it."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import hashing_ann, html_blocks, jaccard_join, line_dedup, mixture, packing, perplexity, range_shards, spelling_variants, token_alignment, toxicity, url_templates, weak_quality
from basketry.llm.url_templates import Rule

Query = Callable[[SparkSession, str], DataFrame]
URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARIES = token_alignment.Vocabularies(VOCABULARY, public_tokenizers.path("piece_bpe_32k.model"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), VOCABULARY)


def op2_path_templates(spark: SparkSession, folder: str) -> DataFrame:
    return url_templates.judge(table(spark, folder, "pages"), URL_RULES)


def op3_lexicon_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_ngram_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    return perplexity.quality(table(spark, folder, "documents"))


def op5_weak_label_quality(spark: SparkSession, folder: str) -> DataFrame:
    return weak_quality.quality(table(spark, folder, "documents"))


def op6_multi_index_hashing(spark: SparkSession, folder: str) -> DataFrame:
    return hashing_ann.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.linked_components(table(spark, folder, "documents"))


def op8_splitting_tree_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(table(spark, folder, "documents"))


def op9_sampled_splitter_shards(spark: SparkSession, folder: str) -> DataFrame:
    return range_shards.shard(table(spark, folder, "documents"))


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_blocks.extract(table(spark, folder, "pages"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.variants(table(spark, folder, "documents"))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = token_alignment.align(table(spark, folder, "documents"), VOCABULARIES)
    return found.withColumnRenamed("groups", "groups_sha256")


def op13_range_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = line_dedup.deduplicated(table(spark, folder, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_path_templates,
        op3_lexicon_toxicity,
        op4_ngram_perplexity,
        op5_weak_label_quality,
        op6_multi_index_hashing,
        op7_ngram_jaccard_join,
        op8_splitting_tree_mix,
        op9_sampled_splitter_shards,
        op10_html_extraction,
        op11_spelling_variants,
        op12_token_alignment,
        op13_range_line_dedup,
    )
}

# Sets of three-word shingles, their links, and what every document reaches over links.
JACCARD_COMPONENTS = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE
        WHEN len(w) >= 3 THEN list_distinct(list_transform(
            range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')]
        ELSE [] END AS s
    FROM words
), flat AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION
    SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(y) FROM reach WHERE reach.x = sets.doc_id) AS component_id
FROM sets
"""

# Every line with its key, the keys that go, and the lines that are left.
REPEATED_LINES = r"""
WITH texts AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), flat AS (
    SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS place FROM texts
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
    FROM flat
), repeated AS (
    SELECT line_key, max(doc_id) AS largest
    FROM keyed
    WHERE length(line_key) >= 40
    GROUP BY line_key
    HAVING count(DISTINCT doc_id) >= 5
), judged AS (
    SELECT keyed.*, repeated.largest IS NOT NULL AND doc_id <> repeated.largest AS gone
    FROM keyed LEFT JOIN repeated USING (line_key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged
GROUP BY doc_id
"""

ORACLES: dict[str, str] = {"op7_ngram_jaccard_join": JACCARD_COMPONENTS, "op13_range_line_dedup": REPEATED_LINES}
