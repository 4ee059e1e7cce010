"""The registered queries: SQL where there is some, stable columns elsewhere."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from basketry.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op2": ["page_id", "host", "path", "rule", "verdict"],
    "op3": ["doc_id", "held_out", "score", "predicted"],
    "op4": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5": ["doc_id", "posterior", "score", "kept"],
    "op6": ["query_id", "rank", "vec_id", "score"],
    "op7": ["doc_id", "n_shingles", "component_id"],
    "op8": ["doc_id", "size", "source_size", "target", "taken"],
    "op9": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op10": ["page_id", "url", "text", "n_chars"],
    "op11": ["word", "form", "root", "n", "n_near", "form_n"],
    "op12": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op13": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = driver.queries()[name](spark, FOLDER)
    assert set(COLUMNS[name.split("_")[0]]) <= set(df.columns)
    rows = df.collect()
    assert rows
    if name in queries.ORACLES:
        db = duckdb.connect()
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
        cursor = db.execute(queries.ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(cursor.fetchall())


def test_pipeline(spark):
    rows = driver.queries()["pipeline"](spark, FOLDER).collect()
    assert rows and max(r["length"] for r in rows) <= 1024
