"""Every operator on the rows that break things: nulls, empty and very long texts, ties, repeats, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basketry.llm import (
    hashing_ann, html_blocks, jaccard_join, line_dedup, mixture, packing, perplexity, range_shards, spelling_variants,
    token_alignment, toxicity, url_templates, weak_quality,
)
from basketry.llm.queries import URL_RULES, VOCABULARIES, VOCABULARY

PROSE = "the old man went to the house by the sea and he saw that it was good for all of them on that day. "
DOCS = [
    (1, PROSE, "en", "a", 100),
    (1, PROSE, "en", "a", 100),
    (2, PROSE, "en", "b", 100),
    (3, None, None, None, None),
    (None, "a text without id", "en", "a", 1),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "en", None, 4),
    (6, "word", "de", "c", 4),
    (7, "two words", None, "a", 9),
    (8, "x" * 100_000, "en", "a", 100_000),
    (9, "\n".join(f"{PROSE} {i}" for i in range(2000)), "en", "a", 1),
    (10, "<|endoftext|> \x85 \x1c 数据 😀 \u00a0 é", "zh", "d", 5),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ("size", "n", "node", "token", "score", "model", "shard", "group", "label", "component", "kept", "prefix",
            "word", "hash", "range", "block", "pattern", "host", "path", "rule", "target", "number", "name")
OPERATORS = {
    "packing": lambda d, labels: packing.pack(d, VOCABULARY),
    "toxicity": toxicity.score,
    "perplexity": lambda d, labels: perplexity.quality(d),
    "weak_quality": lambda d, labels: weak_quality.quality(d),
    "jaccard_join": lambda d, labels: jaccard_join.linked_components(d),
    "mixture": lambda d, labels: mixture.mix(d),
    "mixed_documents": lambda d, labels: mixture.mixed_documents(d.select(*corpus_pipeline.COLUMNS)),
    "range_shards": lambda d, labels: range_shards.shard(d),
    "token_alignment": lambda d, labels: token_alignment.align(d, VOCABULARIES),
    "line_dedup": lambda d, labels: line_dedup.deduplicated(d),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (3, None, 1), (None, 1, 1), (6, 0, 1), (7, 0, None), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edge_rows(name, docs, labels):
    rows = OPERATORS[name](docs, labels).collect()
    ids = sorted({r["doc_id"] for r in rows}, key=str)
    if name == "mixed_documents":
        assert set(ids) <= {d[0] for d in DOCS}
    else:
        assert ids == sorted({d[0] for d in DOCS}, key=str)
    if name not in ("packing", "mixed_documents"):
        assert len(rows) == len(DOCS)
        twice = [r for r in rows if r["doc_id"] == 1]
        if name != "range_shards":
            assert twice[0] == twice[1]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(name, spark, docs, labels):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).collect() == []


def test_words_on_edge_rows(spark, docs):
    rows = {r["word"]: r for r in spelling_variants.variants(docs).collect()}
    # The runs of letters that repeat and are long enough; those of one sign a hundred thousand times occur once.
    assert set(rows) == set() and spelling_variants.variants(docs.limit(0)).collect() == []
    texts = [(None, "overlook " * 30), (1, "overlook overlooks overlooks"), (1, "overlook overlooks overlooks"), (2, None), (3, "")]
    table = spark.createDataFrame(texts, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in CLASHING})
    found = {r["word"]: tuple(r)[1:] for r in spelling_variants.variants(table, spelling_variants.Settings(every=1 << 40)).collect()}
    assert found == {"overlook": (None, "overlook", 32, 1, None), "overlooks": (None, "overlooks", 4, 1, None)}


def test_rows_without_or_with_one_id_have_their_own_fate(spark, monkeypatch):
    texts = ["".join(f" {c}{k}" for k in range(40)) for c in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (None, texts[2]), (9, texts[2]), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id", "text").collect()
    want = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, None)]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)
    for module, stage in ((perplexity, corpus_pipeline.quality_rules), (weak_quality, corpus_pipeline.quality_classifier)):
        bad = F.coalesce(F.col("text").isin(texts[1], texts[2]), F.lit(True))
        monkeypatch.setattr(module, "quality", lambda d: d.select("doc_id", (~bad).alias("kept")))
        kept = stage(spark, docs, "").select("doc_id", "text").collect()
        want = [r for r in rows if r[1] in (texts[0], texts[3])]
        assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_edge_rows_and_nothing(stage, spark, docs):
    function = dict(corpus_pipeline.STAGES)[stage]
    rows = function(spark, docs, "")
    if stage != "best_fit_packing":
        assert rows.columns == corpus_pipeline.COLUMNS
    assert {r["doc_id"] for r in rows.collect()} <= {d[0] for d in DOCS}
    assert function(spark, docs.limit(0), "").count() == 0


def test_pages_on_edge_rows(spark):
    rows = [
        (1, "https://A.example.com/x/1?q", "<article><p>a &amp; b"),
        (1, "https://A.example.com/x/1?q", "<article><p>a &amp; b"),
        (2, None, None),
        (None, "no scheme", ""),
        (3, "://", "<" * 50_000),
        (4, "https://h/" + "s/" * 5_000, "<div>" * 5_000 + "<p a='" * 200),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    pages = pages.withColumns({c: F.lit("clash") for c in CLASHING})
    texts = html_blocks.extract(pages).collect()
    assert len(texts) == len(rows) and [r["text"] for r in texts if r["page_id"] == 1] == ["a & b"] * 2
    verdicts = url_templates.judge(pages, URL_RULES).collect()
    assert len(verdicts) == len(rows) and all(r["verdict"] in ("allow", "block") for r in verdicts)
    assert {(r["host"], r["path"]) for r in verdicts if r["page_id"] in (2, None)} == {("", "")}
    for operator in (html_blocks.extract, lambda p: url_templates.judge(p, URL_RULES)):
        assert operator(pages.limit(0)).collect() == []


def test_vectors_on_edge_rows(spark):
    sound = [[float((i * j) % 7 - 3) for j in range(1, 9)] for i in range(1, 30)]
    rows = [(i, v) for i, v in enumerate(sound)] + [(0, sound[0])]
    rows += [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8), (103, [float("inf")] + [1.0] * 7), (104, [None] * 8)]
    rows += [(105, [1.0]), (None, [1.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({c: F.lit("clash") for c in CLASHING})
    found = hashing_ann.search(table, F.col("vec_id") % 20 == 0).collect()
    assert {r["query_id"] for r in found} == {0, 20}
    assert all(r["vec_id"] < 100 and r["vec_id"] != r["query_id"] for r in found)
    assert hashing_ann.search(table.limit(0), F.lit(True)).collect() == []
    assert hashing_ann.search(table.filter("vec_id = 100"), F.lit(True)).collect() == []
