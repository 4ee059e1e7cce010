"""Spelling variants, token alignment and line deduplication against plain versions."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.llm import line_dedup, spelling_variants, token_alignment, toxicity
from basketry.llm.queries import VOCABULARIES

DOCS = "doc_id bigint, text string"


# Spelling variants


def differ_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_words(rows, every):
    found = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def plain_variants(words):
    near = collections.defaultdict(list)
    for a, b in itertools.combinations(words, 2):
        if differ_by_one(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def misspelt_texts(rng):
    """Words in chains of ever rarer spellings, in a small alphabet so that halves are shared by many."""
    names = ["".join(rng.choice("abÀÿ") for _ in range(rng.randint(7, 9))) for _ in range(60)]
    words = []
    for name in names:
        for times in (250, 22, 2):
            words += [name] * times
            place = rng.randrange(len(name))
            name = rng.choice([name[:place] + name[place + 1 :] + "b", name[:place] + "d" + name[place:], name[:place] + "A" + name[place + 1 :]])
    rng.shuffle(words)
    return [(i if i % 5 else None, " ".join(words[i::40]) + " xµĀy, 7") for i in range(40)]


@pytest.mark.parametrize("room,block", [(20_000, 60_000), (3, 40)])
def test_variants_against_all_pairs(spark, room, block):
    rows = misspelt_texts(random.Random(21)) + [(None, None), (3, ""), (4, "Z" * 5000 + " " + "z" * 5000 + " " + ("z" * 4999 + " ") * 2)]
    setting = spelling_variants.Settings(room=room, block=block, every=5)
    found = spelling_variants.variants(spark.createDataFrame(rows, DOCS), setting).collect()
    want = plain_variants(plain_words(rows, 5))
    assert sorted(map(tuple, found), key=lambda r: r[0]) == want
    assert any(w[1] and w[1] != w[2] for w in want)  # a chain of two steps


def test_parts_grow_until_few_words_share_them(spark):
    words = [("same" + "".join(x) + "tail", 5) for x in itertools.product("abcd", repeat=4)]
    vocabulary = spark.createDataFrame(words, "word string, n bigint")
    setting = spelling_variants.Settings(room=20, block=100)
    entries = spelling_variants.dealt(vocabulary, setting)
    assert max(r["count"] for r in entries.filter("not searches").groupBy("part").count().collect()) <= 20
    pairs = {(r["word"], r["near"]) for r in spelling_variants.near_words(vocabulary, setting).collect()}
    assert pairs == {(a, b) for (a, _), (b, _) in itertools.permutations(words, 2) if differ_by_one(a, b)}


@given(st.sets(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=25), st.data())
@settings(max_examples=150, deadline=None)
def test_index_finds_every_word_with_one_error_behind_the_exact_part(words, data):
    words = sorted(words)
    symbols = [np.array([ord(c) - 95 for c in w]) for w in words]
    index = spelling_variants.Index(symbols, 6)
    pattern = data.draw(st.sampled_from(words))
    exact = data.draw(st.integers(0, len(pattern)))
    rows = spelling_variants.padded([symbols[words.index(pattern)][::-1]])
    found = index.search(rows, np.array([len(pattern)]), np.array([exact]), np.array([0]))[1]
    # Matched from the right: the last letters as they are, one replaced or one more in front of them.
    end, free = pattern[len(pattern) - exact :], pattern[: len(pattern) - exact]
    want = [
        i for i, w in enumerate(words)
        if w.endswith(end) and w != pattern and len(w) >= len(pattern) and differ_by_one(w[: len(w) - exact], free)
    ]
    assert sorted(found.tolist()) == want


# Token alignment


@pytest.fixture(scope="module")
def aligner():
    """The vocabularies' own libraries, and what their tokens spell."""
    a, b = token_alignment.ByteTokens(VOCABULARIES.bytes_file), token_alignment.PieceTokens(VOCABULARIES.pieces_file)
    return a, b


@pytest.fixture(scope="module")
def both():
    return token_alignment.BothTokens(VOCABULARIES)


@pytest.fixture(scope="module")
def spelling():
    return token_alignment.Spelling(VOCABULARIES)


def plain_alignment(aligner, text):
    """(ids of both, cuts, links) over the whole text at once, or None."""
    whole = " " + (text or "")
    ids = aligner[0].encoder.whole.encode(whole, add_special_tokens=False).ids, aligner[1].pieces.encode(text or "")
    spelt = [[v.spelt[i] for i in x] for v, x in zip(aligner, ids)]
    if not text or any(b"".join(x) != whole.encode() for x in spelt):
        return None
    spans = [list(itertools.pairwise([0, *itertools.accumulate(map(len, x))])) for x in spelt]
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    links = []
    for i, (start, end) in zip(ids[0], spans[0]):
        links += [(i, j) for j, (s, e) in zip(ids[1], spans[1]) if s < end and start < e]
    groups = []
    for first, last in itertools.pairwise([0, *cuts]):
        sides = [",".join(str(i) for i, (s, _) in zip(x, span) if first <= s < last) for x, span in zip(ids, spans)]
        groups.append("|".join(sides))
    return len(ids[0]), len(ids[1]), len(cuts), links, ";".join(groups)


SIGNS = "ab cd  \n\t\r\x0b\x1c\x85\xa0é日本.,'s!012▁{}(); 　\x00"


@given(st.lists(st.sampled_from([*SIGNS, "<|endoftext|>", "<s>", "<0x41>", " the", "ing"]), max_size=30).map("".join) | st.text(max_size=30))
@settings(max_examples=400, deadline=None)
def test_tokens_are_those_of_the_whole_text(aligner, both, spelling, text):
    want = plain_alignment(aligner, text)
    ids = both.encode(text)
    assert (ids is None) == (want is None)
    if want is None:
        return
    batch = pa.RecordBatch.from_pydict({k: [np.frombuffer(x, "<u4").astype("<u2").tobytes()] * 2 for k, x in zip("ab", ids)})
    found = spelling.line_up(batch)
    assert found.groups() == [hashlib.sha256(want[4].encode()).hexdigest()] * 2
    assert [(k >> 20, k & token_alignment.LOW) for k in found.pairs.tolist()] == want[3] * 2
    assert found.n_a.tolist() == [want[0]] * 2 and found.per_row(found.row_of_group).tolist() == [want[2]] * 2


@pytest.mark.parametrize("way", [{}, {"broadcast_pairs": 3}, {"block_size": 64}])
def test_alignment_against_plain_counts(spark, aligner, way):
    rng = random.Random(22)
    words = ["the", "Überraschung", "naïve", "tokenization", "x_y", "12,345", "日本語", "\n", "\t-", "  ", "don't", "<|endoftext|>"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(60)]
    texts += [None, "", " ", "a▁b", texts[1], texts[1]]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    of = [plain_alignment(aligner, t) for _, t in rows]
    counts = collections.Counter(link for x in of if x for link in x[3])
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = []
    for (doc_id, _), x in zip(rows, of):
        if x is None:
            want.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        sums = len(x[3]), sum(counts[k] == best[k[1]] for k in x[3]), sum(counts[k] for k in x[3])
        want.append((doc_id, *x[:3], *sums, hashlib.sha256(x[4].encode()).hexdigest()))
    found = token_alignment.align(spark.createDataFrame(rows, DOCS).repartition(11), VOCABULARIES, **way)
    assert sorted((tuple(r[c] for c in token_alignment.NAMES) for r in found.collect()), key=str) == sorted(want, key=str)


def test_pair_counts_are_a_table_of_their_own(spark, aligner):
    docs = spark.createDataFrame([(1, "the cat"), (2, "the cat"), (3, None)], DOCS)
    rows = token_alignment.pair_counts(token_alignment.partial_counts(token_alignment.tokenised(docs, VOCABULARIES), VOCABULARIES)).collect()
    want = collections.Counter(plain_alignment(aligner, "the cat")[3] * 2)
    assert {(r["a_id"], r["b_id"]): r["n"] for r in rows} == want


def test_perfect_hash_is_minimal_and_verified():
    rng = np.random.default_rng(23)
    keys = np.unique(rng.integers(0, 1 << 40, 20_000))
    block = (token_alignment.mixed(keys, token_alignment.BLOCK_SEED) % np.uint64(7)).astype(int)
    built = [token_alignment.levels_of(keys[block == k]) for k in range(7)]
    hashed = token_alignment.PerfectHash([(sizes, bits.tobytes()) for sizes, bits, _ in built])
    slots = hashed.slots(keys)
    assert hashed.n_keys == len(keys) and sorted(slots.tolist()) == list(range(len(keys)))
    stored = np.concatenate([order for _, _, order in built])
    assert (stored[slots] == keys).all()
    counts = token_alignment.Counts(hashed, stored, np.ones(len(keys), np.int64), np.zeros(1, np.int64))
    assert (counts.look_up(keys) == 1).all() and not counts.look_up(keys + (1 << 41)).any()


def test_vectors_of_many_tasks_are_added_up(spark):
    keys = np.arange(1, 40_001, 2)
    sizes, bits, order = token_alignment.levels_of(keys)
    hashed = token_alignment.PerfectHash([(sizes, bits.tobytes())])
    n = 70
    partial = spark.range(0, 40_000 * n, numPartitions=n).selectExpr("id % 20000 * 2 + 1 AS pair", "id % 3 AS n")
    rows = token_alignment.vectors(partial, token_alignment.ship(spark, hashed)).collect()
    total = np.concatenate([np.frombuffer(r["counts"], "<i8") for r in sorted(rows, key=lambda r: r["slice"])])
    want = np.zeros(len(total), np.int64)
    ids = np.arange(40_000 * n)
    np.add.at(want, hashed.slots(ids % 20_000 * 2 + 1), ids % 3)
    assert len(rows) == -(-20_000 // token_alignment.SLICE) and (total == want).all()


# Line deduplication


def plain_lines(rows, least_chars, least_docs):
    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\v\f\r"))

    def order(doc_id):
        return -(1 << 63) if doc_id is None else doc_id

    holders = collections.defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(order(doc_id))
    gone = {k: max(ids) for k, ids in holders.items() if len(ids) >= least_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if gone.get(key(line), order(doc_id)) == order(doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def repeated_lines(rng, n):
    common = [f"  A line that Many documents hold, number {i} Äé " for i in range(12)]
    weights = [400, 40, 40, 10] + [3] * 8
    rows = []
    for i in range(n):
        lines = [f"own line {i} {k} of this document and no other one" if rng.random() < 0.4 else rng.choices(common, weights)[0] for k in range(rng.randint(0, 9))]
        lines = [rng.choice([str.lower, str.upper, str.strip, str])(x) if x.isascii() else x.strip() if rng.random() < 0.3 else x for x in lines]
        rows.append((i, "\n".join(lines + ["short"] * rng.randint(0, 2))))
    return rows


@pytest.mark.parametrize("partitions,room", [(1, 200_000), (3, 200_000), (40, 200_000), (5, 3)])
def test_lines_against_plain_code(spark, monkeypatch, partitions, room):
    monkeypatch.setattr(line_dedup.Group, "ROOM", room)
    rng = random.Random(24)
    rows = repeated_lines(rng, 300)
    rows += [(None, rows[5][1]), (None, rows[6][1]), (7, rows[8][1]), rows[9], rows[9], (400, None), (401, ""), (402, "\n\n"), (403, "x" * 50_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = line_dedup.deduplicated(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, found), key=str) == plain_lines(rows, 40, 5)


def test_bitmaps_hold_what_stays(spark):
    line = "this very line stands in six documents of the corpus"
    rows = [(i, f"{line}\nfirst {i}\n{line}") for i in range(6)]
    docs = spark.createDataFrame(rows, DOCS)
    bitmaps = {r["doc"]: np.unpackbits(np.frombuffer(zlib.decompress(r["keep"]), np.uint8)).tolist() for r in line_dedup.keep_bitmaps(docs).collect()}
    assert bitmaps == {i: [0, 1, 0, 1, 1, 1, 1, 1] for i in range(5)}


def test_a_frequent_line_is_dealt_to_many_tasks(spark):
    line = "a line that every one of these documents begins with"
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{line}\nand then "), F.col("id").cast("string")).alias("text"))
    places = line_dedup.hashed_lines(docs, 40)
    order = ["h1", "h2", F.desc("doc"), "row", "line"]
    sizes = [r["count"] for r in places.repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    assert line_dedup.dropped_lines(docs).count() == 19_999


# Toxicity's lexicon


def test_terms_are_beyond_chance(spark):
    assert abs(toxicity.chance(2, 0, 3, 7) - 3 / 45) < 1e-12 and abs(toxicity.chance(0, 4, 3, 7) - 1.0) < 1e-9
    sizes = {0: 900, 1: 100}
    # Words of one to three toxic documents are many and happen by chance; one word is in 30 toxic ones.
    counts = {(1, 0): 50_000, (2, 0): 900, (3, 1): 40, (30, 2): 1}
    assert toxicity.beyond_chance(counts, 100_000, sizes, 0.01) == [(30, 2)]
    assert toxicity.beyond_chance({}, 0, sizes, 0.01) == []


def test_repeated_ids_leave_the_sample_bounded(spark):
    labels = spark.createDataFrame([(1, 1, 0)] * 50 + [(2, 1, 1)] * 50 + [(3, 0, 0), (3, 0, 1)], "doc_id bigint, quality int, toxic int")
    rows = toxicity.training_rows(labels, "toxic", F.lit(True), 20).collect()
    assert sorted(map(tuple, rows)) == [(1, 0), (2, 1), (3, 1)]
