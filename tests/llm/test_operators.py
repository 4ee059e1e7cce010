"""Each operator against a plain version of what it has to compute."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from basketry.llm import (
    hashing_ann, html_blocks, jaccard_join, mixture, packing, perplexity, range_shards, toxicity, url_templates,
    weak_quality,
)
from basketry.llm.queries import URL_RULES, VOCABULARY
from basketry import session

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def prose(rng, words, known=300):
    names = ["".join(rng.choice(LETTERS) for _ in range(2 + i % 7)) for i in range(known)]
    return [" ".join(rng.choice(names) for _ in range(n)) for n in words]


def make(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# Packing


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)


@given(st.text(st.sampled_from("ab'sTé 1\n\t.!?  \u00a0\u0085\u3000數😀ß"), max_size=60) | st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_vocabularys_own_library(encoder, text):
    fast, whole = encoder
    ids = np.frombuffer(fast.encode(text), "<u4").tolist()
    assert ids == whole.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark, encoder):
    rng = random.Random(1)
    texts = prose(rng, [rng.randint(0, 60) for _ in range(80)] + [3000, 900, 1200]) + [None, ""]
    rows = packing.pack(make(spark, texts), VOCABULARY, group_pieces=40).toPandas()
    for i, text in enumerate(texts):
        ids = np.array([*encoder[1].encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = rows[rows.doc_id == i].sort_values("piece")
        assert pieces.piece.tolist() == list(range(-(-len(ids) // 1024))) and pieces.length.sum() == len(ids)
        assert (pieces.length.iloc[1:] == 1024).all()
        for p in pieces.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    for _, sequence in rows.sort_values("offset").groupby("sequence_id"):
        assert sequence.offset.tolist() == [0, *np.cumsum(sequence.length)[:-1]] and sequence.length.sum() <= 1024


def test_rows_without_an_id_are_dealt_to_many_groups(spark):
    rows = [(None, "the same few words", "en", "s", 1)] * 600 + [(i, f"words {i}", "en", "s", 1) for i in range(1200)]
    packed = packing.pack(spark.createDataFrame(rows, DOCS), VOCABULARY, group_pieces=100).toPandas()
    sizes = (packed.sequence_id // 2**40).value_counts()
    assert len(packed) == 1800 and len(sizes) == 18 and sizes.max() < 200


@pytest.mark.parametrize("measure", ["norm", "dot"])
def test_best_fit_holds_every_capacity(measure):
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 200, 500))[::-1]
    bins, offsets = packing.best_fit(lengths, (256, 3, 40_000), measure=measure)
    for b in set(bins):
        mine = bins == b
        assert lengths[mine].sum() <= 256 and mine.sum() <= 3 and (lengths[mine] ** 2).sum() <= 40_000
        assert sorted(offsets[mine]) == [0, *np.cumsum(lengths[mine][np.argsort(offsets[mine])])[:-1]]


def test_best_fit_is_tight_for_tokens_alone():
    lengths = np.sort(np.random.default_rng(3).integers(1, 1024, 2000))[::-1]
    bins, _ = packing.best_fit(lengths, (1024, 1024, 1024**2))
    assert len(set(bins)) <= 1.02 * math.ceil(lengths.sum() / 1024)


# Url templates


def plain_rule(host, path):
    fitting = [
        r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    return max(fitting, key=lambda r: len(r.name), default=None)


def test_urls_against_plain_rules(spark):
    urls = [
        None, "", "x", "://", "https://", "http://ORG/", "https://a.ORG/x?y#z", "https://example.org/es/1",
        "https://m.example.org/en/12", "https://m.example.org/en/2", "http://b.com/de/x://y", "http://b.com#/de/",
        "http://b.com?/de/", "ftp://b.com/fr/", "http://borg/", "http://É.com/de/", "a://b://c.org/",
    ]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    for r in url_templates.judge(table, URL_RULES).collect():
        m = re.search(r"://([^/?#]*)([^?#]*)", urls[r["page_id"]] or "", re.S)
        host = "".join(c.lower() if c.isascii() else c for c in m[1]) if m else ""
        rule = plain_rule(host, m[2] if m else "")
        assert (r["host"], r["path"]) == ((host, m[2]) if m else ("", ""))
        assert r["rule"] == (rule.name if rule else None)
        assert rule is None or r["verdict"] == rule.verdict


def test_templates_learn_from_ruled_urls(spark):
    rules = [url_templates.Rule("block", "h.com", "/shop/1"), url_templates.Rule("allow", "h.com", "/news/1")]
    urls = [f"http://h.com/{part}/{n}" for part in ("shop", "news") for n in range(1, 400)]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rows = url_templates.judge(table, rules).collect()
    by_part = collections.Counter((r["path"].split("/")[1], r["template"], r["verdict"]) for r in rows)
    assert set(by_part) == {("shop", "/shop/*", "block"), ("news", "/news/*", "allow")}


# Toxicity


def plain_distance(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@given(st.sets(st.text("abc", min_size=5, max_size=8), min_size=1, max_size=8), st.text("abc", min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_automaton_finds_the_nearest_term(terms, word):
    terms = sorted(terms)
    matcher = toxicity.Matcher(terms, [1.0] * len(terms), [True] * len(terms), {}, 1, 5)
    nearest = min(plain_distance(t, word) for t in terms)
    found = matcher.match(word)
    assert (found is None) == (nearest > 1)
    assert found is None or (found[1] == nearest and plain_distance(terms[found[0]], word) == nearest)


def test_toxicity_learns_terms_spellings_and_quotation(spark):
    rng = random.Random(4)
    plain = prose(rng, [40] * 900)
    texts, labels = [], []
    for i, text in enumerate(plain):
        words, toxic = text.split(), i % 3 == 0
        if toxic:
            words.insert(10, rng.choice(["vermin", "lowlife"]))
        elif i % 45 == 1:
            words[10:10] = ["he", "said", '"vermin"', "and", "wrote"]
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    texts += ["some words then vermni here with others", "some words then here with others"]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.score(make(spark, texts), table).collect()}
    tested = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in rows)
    assert np.mean([rows[i]["predicted"] == labels[i][2] for i in tested]) > 0.97
    assert rows[900]["predicted"] == 1 and rows[901]["predicted"] == 0


def test_misspellings_are_found_with_few_labels(spark):
    rng = random.Random(14)
    plain = prose(rng, [40] * 160)
    texts = [f"{t} lowlife" if i % 4 == 0 else t for i, t in enumerate(plain)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(160)]
    texts += ["some words then lowlive here with others", "some words then here with others"]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.score(make(spark, texts), table).collect()}
    assert rows[160]["any"] == 1 and rows[161]["any"] == 0
    assert rows[160]["score"] > 10 * rows[161]["score"]


# Perplexity


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
    )


def test_base_counts_against_plain_code(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n\t#|é\u00a0\x1f") for _ in range(rng.randint(0, 200))) for _ in range(200)] + [None, "a a a a"]
    for r in perplexity.quality(make(spark, texts)).collect():
        base = plain_base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r["base_failed"] and r["kept"])


def test_model_is_a_distribution(spark):
    texts = prose(random.Random(6), [120] * 60, known=25)
    known, models = perplexity.train(make(spark, texts))
    model, size = models[0], len(known.words[0][0]) + perplexity.FIRST_WORD
    for a, b in [(0, 0), (2, 3), (5, 1), (7, 7), (3, 12)]:
        ids = np.array([[a, b, c] for c in range(size)]).ravel()
        log_p = model.log_probabilities(ids, np.arange(2, len(ids), 3))
        assert math.isclose(np.exp(log_p).sum(), 1.0, rel_tol=1e-3)


def plain_discounts(counts):
    n = collections.Counter(counts.values())
    out = []
    for k, default in ((1, 0.5), (2, 1.0), (3, 1.5)):
        value = k - (k + 1) * n[1] / (n[1] + 2 * n[2]) * n[k + 1] / n[k] if n[1] and n[2] and n[k] else default
        out.append(value if 0 < value < k else default)
    return lambda c: min(out[min(c, 3) - 1], c)


def plain_perplexities(texts, least_words=5, least=4):
    """Kneser-Ney by its formulas: counts are numbers of different words before, a context's total its own count."""
    rows = [t.split() for t in texts]
    often = collections.Counter(w for row in rows for w in row)
    ids = [["<s>"] * 3 + [w if often[w] >= least_words else "<unk>" for w in row] for row in rows]
    size = 2 + sum(n >= least_words for n in often.values())
    fours = {tuple(row[i - 3 : i + 1]) for row in ids for i in range(3, len(row)) if "<unk>" not in row[i - 2 : i]}
    three = collections.Counter(g[1:] for g in fours)
    two = collections.Counter(g[1:] for g in three)
    one = collections.Counter(g[1:] for g in two)
    kept = {1: one, 2: {g: n for g, n in two.items() if n >= least}, 3: {g: n for g, n in three.items() if n >= least}}
    share, left = {}, {}
    for order, counts, lower in ((1, one, None), (2, two, one), (3, three, kept[2])):
        discount, sums = plain_discounts(counts), collections.Counter()
        for g, n in kept[order].items():
            sums[g[:-1]] += n
        for g, n in kept[order].items():
            total = max(sums[g[:-1]], lower.get(g[:-1], 0) if lower is not None else 0)
            share[g] = (n - discount(n)) / total
            left[g[:-1]] = left.get(g[:-1], 1.0) - share[g]

    def probability(g):
        lower = probability(g[1:]) if len(g) > 1 else 1 / size
        return share.get(g, 0.0) + max(left.get(g[:-1], 1.0), 1e-6) * lower

    return [
        -sum(math.log(probability(tuple(row[i - 2 : i + 1]))) for i in range(3, len(row))) / (len(row) - 3) if len(row) > 3 else None
        for row in ids
    ]


@pytest.mark.parametrize("part_words,broadcast", [(2_000_000, 8_000_000), (150, 8_000_000), (150, 0)])
def test_perplexities_against_plain_kneser_ney(spark, part_words, broadcast):
    rng = random.Random(26)
    texts = prose(rng, [rng.randint(0, 90) for _ in range(150)], known=30)
    texts = [t if i % 3 else t + " rare" + str(i) for i, t in enumerate(texts)] + [texts[0], texts[1], ""]
    setting = perplexity.Settings(part_words=part_words, broadcast_ngrams=broadcast)
    rows = {r["doc_id"]: r["log_perplexity"] for r in perplexity.quality(make(spark, texts), setting).collect()}
    for i, want in enumerate(plain_perplexities(texts)):
        assert (rows[i] is None) == (want is None) and (want is None or abs(rows[i] - want) < 1e-5)


def test_no_frequent_word_is_left_out_of_a_large_vocabulary(spark):
    rng = random.Random(28)
    texts = prose(rng, [rng.randint(0, 90) for _ in range(150)], known=30)
    texts = [t if i % 3 else t + " rare" + str(i) for i, t in enumerate(texts)] + [texts[0], texts[0], "", None]
    rows = {r["doc_id"]: r for r in perplexity.quality(make(spark, texts), perplexity.Settings(max_words=10)).collect()}
    few = {r["doc_id"]: r for r in perplexity.quality(make(spark, texts)).collect()}
    assert set(rows) == set(few) == set(range(len(texts)))
    for i, want in enumerate(plain_perplexities([t or "" for t in texts])):
        assert (rows[i]["log_perplexity"] is None) == (want is None)
        assert want is None or abs(rows[i]["log_perplexity"] - want) < 1e-8
        assert rows[i]["kept"] == few[i]["kept"]
    docs = make(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en"))
    both = [perplexity.quality(docs, perplexity.Settings(max_words=n, language_bytes=2000)).collect() for n in (10, 10_000)]
    wide, few = ({r["doc_id"]: r for r in found} for found in both)
    for i, r in few.items():
        assert (r["log_perplexity"] is None) == (wide[i]["log_perplexity"] is None) and r["kept"] == wide[i]["kept"]
        assert r["log_perplexity"] is None or abs(r["log_perplexity"] - wide[i]["log_perplexity"]) < 1e-5


def test_models_are_fetched_without_a_shuffle_and_have_sparks_shares(spark, plan_of):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    settings = perplexity.Settings(part_words=100, least_ngrams=2)
    docs = make(spark, texts)
    known = perplexity.vocabulary(perplexity.frequent(docs, settings))
    grams = perplexity.count_grams(docs, known, settings)
    orders, lower = (grams.one, grams.two, grams.three), None
    for counts, shares, d in zip(orders, perplexity.all_shares(grams), perplexity.all_discounts(grams)):
        assert "Exchange" not in plan_of(counts, "simple")
        rows = sorted((r["gram"], r["n"]) for r in counts.collect())
        gram, n = (np.array(c) for c in zip(*rows))
        found = perplexity.array_shares(gram, n, d.get(0, perplexity.FIXED_DISCOUNTS), lower)
        want = {r["gram"]: np.float32(r["share"]) for r in shares.collect()}
        assert len(rows) > 7 and dict(zip(gram.tolist(), found)) == want
        lower = gram, n
    assert len(perplexity.array_shares(gram[:0], n[:0], perplexity.FIXED_DISCOUNTS, (gram[:0], n[:0]))) == 0
    shipped = perplexity.shipped_models(known, grams)
    assert sorted(shipped) == sorted(known.words)  # a broadcast for each, of plain arrays
    assert isinstance(shipped[0].value["trigrams"]["hashes"], np.ndarray)
    assert (perplexity.opened_model(shipped[0]).trigrams.find(gram) >= 0).all()


@given(st.lists(st.integers(1, 5000), min_size=1, max_size=40), st.integers(1, 3000))
@settings(max_examples=100, deadline=None)
def test_ranges_follow_the_order_of_trigrams(occurrences, part_words):
    ranges = perplexity.Ranges(np.array([1, 1, *sorted(occurrences, reverse=True)]), part_words)
    n = len(occurrences) + 2
    middle, last, first = (x.ravel() for x in np.meshgrid(*[np.arange(min(n, 12))] * 3, indexing="ij"))
    middle, last = last, middle  # the last word comes first in their order
    parts = ranges.of(first, middle, last)
    assert (np.diff(parts) >= 0).all() and parts.min() >= 0 and parts.max() < ranges.parts
    split = ranges.split(middle, last)
    for m, w in {(m, w) for m, w in zip(middle[~split].tolist(), last[~split].tolist())}:
        assert len(set(parts[(middle == m) & (last == w)])) == 1


def test_blocks_come_back_as_they_were():
    rng = np.random.default_rng(27)
    for most in (2, 50, 1 << 21):
        columns = rng.integers(0, most, (4, 1000))
        columns = columns[:, np.lexsort(columns[::-1])]
        for found, want in zip(perplexity.opened_block(perplexity.packed_block(list(columns))), columns):
            assert (found == want).all()
    words, n = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2)), np.arange(1, 501)
    found = perplexity.opened_counts(perplexity.packed_counts(words, n[: len(words)]))
    assert (found[0] == words).all() and (found[1] == n[: len(words)]).all()


def test_sorted_hash_array():
    rng = np.random.default_rng(7)
    keys = np.unique(rng.integers(0, 2**60, 5000))
    stored = perplexity.SortedHashArray(keys[::2], keys[::2] * 2)
    assert (stored.value_or(keys, np.full(len(keys), -1)) == np.where(np.arange(len(keys)) % 2 == 0, keys * 2, -1)).all()
    assert (perplexity.SortedHashArray(keys[:0], keys[:0]).find(keys) == -1).all()


def test_copies_are_kept_and_junk_is_not(spark):
    rng = random.Random(8)
    texts = prose(rng, [150] * 300)
    texts += [texts[0]] * 200 + [" | ".join(t.split()[:60]) for t in texts[:8]]
    rows = {r["doc_id"]: r for r in perplexity.quality(make(spark, texts)).collect()}
    assert np.mean([rows[i]["kept"] for i in range(500)]) > 0.97 and all(rows[i]["kept"] for i in range(300, 500))
    assert not any(rows[i]["kept"] for i in range(500, 508))


def test_model_grows_with_the_corpus(spark):
    few, many = (make(spark, [" ".join(f"w{(i * 37 + k) % n}" for k in range(40)) for i in range(n)]) for n in (40, 4000))
    sizes = []
    for docs in (few, many):
        known, models = perplexity.train(docs)
        sizes.append((len(known.words[0][0]), len(models[0].bigrams.hashes)))
    assert sizes[0][0] == 40 and sizes[1][0] == 4000  # every word occurs 40 times, whatever the size
    blown = make(spark, [" ".join(t) for t in (["a b", *(f"{c} a b" for c in "cdef")] * 5, ["z" * 40_000_000])])
    known, models = perplexity.train(blown)
    assert len(known.words[0][0]) == 6 and len(models[0].bigrams.hashes)  # 40 MB of bytes leave words and bigrams in


def test_joined_model_scores_as_the_broadcast_one(spark):
    texts = prose(random.Random(16), [120] * 80 + [1, 2, 0], known=40)
    texts += [texts[0], texts[0], None]
    docs = make(spark, texts)
    whole = {r["doc_id"]: r for r in perplexity.quality(docs).collect()}
    joined = {r["doc_id"]: r for r in perplexity.quality(docs, perplexity.Settings(broadcast_ngrams=0)).collect()}
    assert set(whole) == set(joined) == set(range(len(texts)))
    for i, r in whole.items():
        assert r["kept"] == joined[i]["kept"] and r["n_words"] == joined[i]["n_words"]
        assert (r["log_perplexity"] is None) == (joined[i]["log_perplexity"] is None)
        assert r["log_perplexity"] is None or abs(r["log_perplexity"] - joined[i]["log_perplexity"]) < 1e-5


def test_a_large_model_is_held_in_pieces_and_moves_no_row_a_word(spark, monkeypatch):
    rng = random.Random(31)
    texts = prose(rng, [rng.randint(0, 90) for _ in range(150)], known=60) + ["", None]
    docs = make(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, "en").when(F.col("doc_id") % 2 == 0, "de"))
    small = {r["doc_id"]: r for r in perplexity.quality(docs, perplexity.Settings(language_bytes=4000, least_ngrams=2)).collect()}
    written, write = {}, session.staged

    def counted(df, name):
        out = write(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(perplexity, "staged", counted)
    monkeypatch.setattr(session, "staged", counted)
    # Many words; many n-grams.
    for limits in ({"whole_words": 10}, {"broadcast_ngrams": 0}):
        written.clear()
        tiny = perplexity.Settings(language_bytes=4000, least_ngrams=2, piece_words=7, piece_ngrams=300, part_words=900, **limits)
        rows = {r["doc_id"]: r for r in perplexity.quality(docs, tiny).collect()}
        assert set(rows) == set(small) and max(written.values()) < sum(len((t or "").split()) for t in texts) / 2
        assert written["pieces"] > 3
        for i, r in small.items():
            assert (r["log_perplexity"] is None) == (rows[i]["log_perplexity"] is None) and r["kept"] == rows[i]["kept"]
            assert r["log_perplexity"] is None or abs(r["log_perplexity"] - rows[i]["log_perplexity"]) < 1e-5


def test_wide_blocks_come_back_as_they_were():
    rng = np.random.default_rng(29)
    for most, width in ((1 << 24, 3), (1 << 30, 4)):
        columns = rng.integers(0, most, (4, 500))
        columns = columns[:, np.lexsort(columns[::-1])]
        for found, want in zip(perplexity.opened_block(perplexity.packed_block(list(columns), width), width), columns):
            assert (found == want).all()


def test_a_staged_tables_shuffle_files_go(spark, monkeypatch):
    seen = []
    write = type(spark.range(0).write).parquet
    monkeypatch.setattr(type(spark.range(0).write), "parquet", lambda *a, **b: (seen.append(spark.conf.get(session.CLEANUP_KEY)), write(*a, **b))[1])
    before = spark.conf.get(session.CLEANUP_KEY)
    assert session.staged(spark.range(9).groupBy((F.col("id") % 2).alias("k")).count(), "few").count() == 2
    assert seen == ["true"] and spark.conf.get(session.CLEANUP_KEY) == before


# Weak labels


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(9)
    truth = rng.random(40_000) < 0.8
    rates = [0.95, 0.9, 0.9, 0.85, 0.8, 0.9, 0.75, 0.85, 0.8]
    cast = np.stack([np.where(rng.random(len(truth)) < 0.3, weak_quality.ABSTAIN, np.where(rng.random(len(truth)) < r, truth, ~truth)) for r in rates], 1)
    codes = (cast * 3 ** np.arange(8, -1, -1)).sum(1)
    patterns, counts = np.unique(codes, return_counts=True)
    posterior, accuracy = weak_quality.label_model(patterns, counts.astype(float), 200)
    of = dict(zip(patterns, posterior))
    assert np.mean((np.array([of[c] for c in codes]) > 0.5) == truth) > 0.95
    assert np.abs(accuracy - rates).max() < 0.03


def test_classifier_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(10)
    clean = [" ".join(w for t in text.split() for w in (t, rng.choice(["the", "of", "and", "to"]))) + "." for text in prose(rng, [80] * 300)]
    junk = [t.upper().replace(" ", "!! ") for t in clean[:30]] + [" ".join([t.split()[0]] * 80) for t in clean[:30]]
    rows = {r["doc_id"]: r for r in weak_quality.quality(make(spark, clean + junk)).collect()}
    assert np.mean([rows[i]["kept"] for i in range(300)]) > 0.98
    assert np.mean([rows[i]["kept"] for i in range(300, 360)]) < 0.05


# Nearest neighbours


def test_multi_index_finds_every_code_within_a_radius():
    rng = np.random.default_rng(11)
    codes = rng.integers(0, 256, (3000, 4), dtype=np.uint8)
    index = hashing_ann.MultiIndex(codes)
    for radius in (0, 3, 7, 9, 12, 32):
        for code in codes[:20]:
            plain = np.flatnonzero(np.bitwise_count(codes ^ code).sum(1) <= radius)
            assert (index.within(code, radius) == plain).all()


def test_recall_and_scores(spark):
    rng = np.random.default_rng(12)
    vectors = rng.standard_normal((1200, 32)).astype(np.float32)
    table = spark.createDataFrame(pd.DataFrame({"vec_id": range(1200), "embedding": [v.tolist() for v in vectors]}))
    table = table.selectExpr("vec_id", "cast(embedding as array<float>) embedding")
    settings_ = hashing_ann.Settings(block_rows=500, query_rows=25)
    rows = hashing_ann.search(table, F.col("vec_id") % 20 == 0, settings_).toPandas()
    exact, hits = vectors.astype(float), 0
    for query, found in rows.groupby("query_id"):
        scores = exact @ exact[query]
        scores[query] = -np.inf
        best = np.lexsort((np.arange(1200), -scores))[:20]
        hits += len(set(best) & set(found.vec_id))
        found = found.sort_values("rank")
        assert found["rank"].tolist() == list(range(1, 21))
        assert np.allclose(found.score, scores[found.vec_id], rtol=1e-12) and (np.diff(found.score) <= 0).all()
    assert hits / (60 * 20) >= 0.9


# N-gram Jaccard join


def plain_components(texts, words, percent):
    def shingles(text):
        found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return {tuple(found[i : i + words]) for i in range(max(len(found) - words + 1, min(len(found), 1)))}

    sets = [shingles(t) for t in texts]
    of = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        shared = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * shared >= percent * len(sets[i] | sets[j]):
            old, new = max(of[i], of[j]), min(of[i], of[j])
            of = [new if x == old else x for x in of]
    return [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, of))]


@pytest.mark.parametrize("words,percent,small", [(3, 90, 16), (3, 90, 1), (5, 80, 4), (1, 50, 2)])
def test_components_against_all_pairs(spark, words, percent, small):
    rng = random.Random(words * small)
    base = prose(rng, [rng.randint(0, 70) for _ in range(40)], known=60)
    texts = list(base) + [None, "", "a b", "A B", "b a"]
    for text in base[:15]:
        for _ in range(rng.randint(1, 6)):
            changed = text.split()
            for _ in range(rng.randint(0, 3)):
                if changed:
                    changed[rng.randrange(len(changed))] = rng.choice(["new", "other", "x"])
            texts.append("  ".join(changed).upper() if rng.random() < 0.3 else " ".join(changed))
    texts += [base[0]] * 10
    setting = jaccard_join.Settings(words=words, percent=percent, small=small, block=4, sketch_bits=(12, 10, 10))
    rows = jaccard_join.linked_components(make(spark, texts), setting).collect()
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)
    assert found == plain_components(texts, words, percent)


# Mixing


def plain_targets(sizes, weights, share, most):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, rest = {}, set(order), share * sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        for s in full or open_:
            target[s] = most * sizes[s] if full else level * weight[s]
        rest -= sum(most * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    return target


def test_mix_meets_targets_and_repeats(spark):
    rng = random.Random(13)
    names = ["b", "a", "Z", None, "é", "c"]
    sources = [names[min(int(rng.expovariate(0.6)), 5)] for _ in range(3000)]
    texts = prose(rng, [rng.randint(0, 30) for _ in sources])
    docs = make(spark, texts, sources)
    rows = mixture.mix(docs).toPandas()
    assert (rows["size"] == rows.doc_id.map(lambda i: len(texts[i].split()))).all()
    source = rows.doc_id.map(lambda i: sources[i] or "~null")
    sizes = rows.groupby(source)["size"].sum().to_dict()
    wanted = plain_targets({None if s == "~null" else s: n for s, n in sizes.items()}, (3, 1, 2), 1.5, 2)
    for name, mine in rows.groupby(source):
        target = wanted[None if name == "~null" else name]
        assert math.isclose(mine.target.iloc[0], target, rel_tol=1e-9)
        assert abs(mine.taken.sum() - target) <= 30 and (mine.taken <= 2 * mine["size"]).all()
    again = mixture.mix(docs.repartition(7)).toPandas().sort_values("doc_id")
    assert again.taken.tolist() == rows.sort_values("doc_id").taken.tolist()
    assert (rows.shards.map(len) == rows.copies).all()
    copies = collections.Counter(r["doc_id"] for r in mixture.mixed_documents(docs).collect())
    assert copies == collections.Counter({r.doc_id: r.copies for r in rows.itertuples() if r.copies})


def test_splitting_tree_meets_quotas(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 0), (2, 37), (3, 5)], "number bigint, quota bigint")
    rows = mixture.splitting_tree(quotas, 4, seed=3).toPandas()
    assert rows.groupby("number").until.max().to_dict() == {0: 1000, 1: 0, 2: 37, 3: 5}
    parts = rows.sort_values("shard").groupby("number").until.diff().fillna(rows.until)
    of_shard = parts.groupby(rows.shard).sum()
    assert len(of_shard) == 16 and of_shard.max() - of_shard.min() <= 1 and (parts >= 0).all()


# Sharding


def test_shards_are_even_and_slots_gapless(spark):
    rng = random.Random(14)
    texts = prose(rng, [rng.randint(0, 40) for _ in range(3000)]) + ["copied over and over"] * 1500 + [None] * 5
    rows = range_shards.shard(make(spark, texts), fan_out=4, per_part=8).toPandas()
    sizes = rows.doc_id.map(lambda i: len((texts[i] or "").encode()) + 16)
    assert (rows["size"] == sizes).all()
    assert (rows.text_crc32 == rows.doc_id.map(lambda i: zlib.crc32((texts[i] or "").encode()))).all()
    of_shard = rows.groupby("shard")["size"].sum()
    assert len(of_shard) == 40 and of_shard.max() - of_shard.min() <= 2 * sizes.max()
    assert all(sorted(mine.slot) == list(range(len(mine))) for _, mine in rows.groupby("shard"))
    first = rows[rows.doc_id < 3000].groupby("text_crc32").shard.nunique()
    assert (first <= 2).all()


# Html


def test_two_passes_decide_short_blocks():
    long = "<p>It was the best of times and it was the worst of times, as he had known in the old house by the sea with them and the others of that time.</p>"
    page = f"<div class=menu>Menu</div>{long}<p>Short one.</p>{long}<p><a href=x>Link</a></p><div>End</div><footer>foot</footer>"
    text, _, kept = html_blocks.main_text(page)
    assert kept == 3 and text.split("\n")[1] == "Short one."


def plain_passes(found, known_language, rules):
    """Both passes with neighbours looked for one by one."""
    labels = []
    for b in found:
        density = html_blocks.stop_word_density(b.text) if known_language else 1.0
        if b.place == "aside" or b.link_chars > rules.max_link_density * len(b.text):
            labels.append("bad")
        elif len(b.text) >= rules.short:
            labels.append("good" if density >= rules.high_density and len(b.text) > rules.long else "near")
        else:
            labels.append("bad" if b.link_chars or "©" in b.text else "short")
    for kind in ("near", "short"):
        new = list(labels)
        for i, b in enumerate(found):
            if labels[i] != kind or b.place == "aside":
                continue
            sides, steps = [], []
            for way in (-1, 1):
                j, step = i + way, 1
                while 0 <= j < len(found) and (found[j].place == "aside" or labels[j] not in ("good", "bad")):
                    step += found[j].place != "aside"
                    j += way
                sides.append(labels[j] if 0 <= j < len(found) else None)
                steps.append(step)
            told = [x for x in sides if x]
            if len(set(told)) < 2 or len(told) < 2:
                new[i] = told[0] if told else "good"
            elif kind == "near":
                new[i] = "good"
            elif b.heading:
                new[i] = sides[1]
            else:
                new[i] = "good" if steps[0] == steps[1] else sides[steps.index(min(steps))]
        labels = new
    return [b.place != "aside" and x == "good" for b, x in zip(found, labels)]


WORDS = st.sampled_from(["the of and to", "stone river cloud", "x", "© 2020"])
BLOCKS = st.builds(
    lambda text, times, links, place, heading: html_blocks.Block(" ".join([text] * times), links, place, heading),
    WORDS, st.integers(1, 15), st.sampled_from([0, 0, 0, 3, 60]), st.sampled_from(["", "", "main", "aside"]), st.booleans(),
)


@given(st.lists(BLOCKS, max_size=14), st.booleans())
@settings(max_examples=300, deadline=None)
def test_both_passes_against_plain_ones(found, known_language):
    rules = html_blocks.Rules()
    labels = [html_blocks.first_pass(b, rules, known_language) for b in found]
    assert html_blocks.second_pass(found, labels) == plain_passes(found, known_language, rules)


def test_rules_need_no_article_element(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    same = 0
    for r in pages:
        plain = re.sub(r"(</?)(article|main)\b", r"\1div", r["html"], flags=re.I)
        same += html_blocks.main_text(r["html"])[0] == html_blocks.main_text(plain)[0] != ""
    assert same >= 0.95 * len(pages)


def test_other_languages_and_signs_keep_their_text():
    italian = "<p>Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, che la diritta via era smarrita e non sapeva dire quanto.</p>"
    page = f"<div><a href=/>Home</a> <a href=/x>Altro</a></div><h1>Titolo</h1>{italian}<p>Breve.</p>{italian}<div>© 2020 x</div>"
    assert html_blocks.main_text(page)[0].split("\n")[:3] == ["Titolo", re.sub("</?p>", "", italian), "Breve."]
    sign = "<p>The sign © was in the middle of the long line that they had read to us, and it is the one of which he said that it was not his.</p>"
    assert "©" in html_blocks.main_text(f"<div><a href=/>Home</a></div>{sign}<p>End</p>")[0]


def test_markup_inside_the_article():
    page = (
        "<title>T</title><header>H</header><article><h1>Head&nbsp;&amp;\n line</h1><script>var a='</p>'</script><p>One <b>two</b><br>three"
        "<p>Four<div class='ad box'>Buy</div><aside>Side<p>more</aside><ul><li>Item</ul><!-- no --><section id=comments><p>First!</p></section>"
        "</article><nav>x</nav>"
    )
    assert html_blocks.main_text(page)[0] == "Head & line\nOne two three\nFour\nItem"
    assert html_blocks.main_text("")[0] == ""
    page = "<body class='no-sidebar'><div class='with-sidebar'><article><div class='post-header'><h1>T</h1></div><p>a</div></article>"
    assert html_blocks.main_text(page)[0] == "T\na"
    assert html_blocks.main_text("<main><p>a<div id='comments'><article><p>b</article></div></main>")[0] == "a"


# What tasks hold of texts


def test_tasks_get_texts_in_small_batches(spark):
    docs = make(spark, ["a word"] * (2 * session.BATCH_TEXTS)).coalesce(1)

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": [batch.num_rows]})

    def sizes():
        return docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint")

    before = spark.conf.get(session.BATCH_KEY)
    assert max(r[0] for r in session.staged_texts(sizes(), "sizes").collect()) <= session.BATCH_TEXTS
    assert spark.conf.get(session.BATCH_KEY) == before
    spark.conf.set(session.BATCH_KEY, "70")
    try:
        assert max(r[0] for r in session.staged_texts(sizes(), "sizes").collect()) <= 70
        with pytest.raises(ZeroDivisionError), session.small_batches(spark):
            raise ZeroDivisionError
        assert spark.conf.get(session.BATCH_KEY) == "70"
    finally:
        spark.conf.set(session.BATCH_KEY, before)


@pytest.mark.parametrize(
    "operator, module, steps",
    [
        (perplexity.quality, perplexity, {"words", "ngrams", "scored"}),
        (jaccard_join.linked_components, jaccard_join, {"nodes", "sets"}),
        (weak_quality.quality, weak_quality, {"described"}),
    ],
)
def test_steps_over_texts_use_small_batches(spark, monkeypatch, operator, module, steps):
    seen, write = {}, session.staged

    def noted(df, name):
        seen.setdefault(name, set()).add(int(spark.conf.get(session.BATCH_KEY)))
        return write(df, name)

    monkeypatch.setattr(session, "staged", noted)
    monkeypatch.setattr(module, "staged", noted, raising=False)
    operator(make(spark, prose(random.Random(4), [60] * 20))).collect()
    assert all(max(seen[name]) <= session.BATCH_TEXTS for name in steps)
