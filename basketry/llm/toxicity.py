"""Toxicity scores from a learned lexicon, matched with misspellings, weighed in context.

The lexicon is learned from labelled documents: words that occur in many more
toxic than clean ones, by a hypergeometric test whose false-discovery rate over
all words of the sample is limited.  Its terms form a trie, and a Levenshtein automaton of
every text word, run along the trie, finds the terms within a small distance:
the automaton's states are rows of the edit-distance table, and a branch is left
once no state can still accept.  Each hit counts by how sure its spelling is and
by the words around it: words near hits have log-odds of standing in abuse
rather than in quotation or report, learned from the same documents, and quotation
marks are words of their own.  A logistic model turns a document's hits into a
score.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import WordHashes, opened, ship, utf8
from basketry.session import staged

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”«»„]")
QUOTES = frozenset("\"“”«»„")
FEATURES = ("weight", "close_share", "context", "quoted", "clustered", "density", "any")
# Digits and signs that stand for letters in disguised words.
LOOKALIKES = str.maketrans("013457@$", "oieastas")


@dataclass(frozen=True)
class Settings:
    training_rows: int = 20_000  # labelled rows that are read, at most a quarter of them toxic
    false_terms: float = 0.01  # expected share of terms that are there by chance
    min_odds: float = 2.0  # log-odds of toxic against clean, smoothed
    distance: int = 1
    min_length: int = 5  # shorter terms match exactly only
    window: int = 4
    ridge: float = 1.0


class Trie:
    def __init__(self, terms: dict[str, int]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        for term, number in terms.items():
            at = 0
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                at = self.children[at][c]
            self.term[at] = number

    def within(self, word: str, distance: int) -> tuple[int, int] | None:
        """(term, distance) of the nearest term, the first of equals; None beyond ``distance``.

        A state is a trie node, a place in the word and the edits spent so far:
        the word's Levenshtein automaton and the trie read the same letters, and
        a state without edits left moves by equal letters only.
        """
        size, children, term = len(word), self.children, self.term
        best: tuple[int, int] | None = None
        seen = set()
        states = [(0, 0, 0)]
        while states:
            state = states.pop()
            if state in seen:
                continue
            seen.add(state)
            node, at, edits = state
            if term[node] >= 0 and edits + size - at <= distance:
                found = (edits + size - at, term[node])
                best = found if best is None else min(best, found)
            next_ = children[node]
            if at < size and word[at] in next_:
                states.append((next_[word[at]], at + 1, edits))
            if edits == distance:
                continue
            if at < size:
                states.append((node, at + 1, edits + 1))  # a letter too many
            for letter, child in next_.items():
                states.append((child, at, edits + 1))  # a letter left out
                if at < size and letter != word[at]:
                    states.append((child, at + 1, edits + 1))  # another letter
            if at + 1 < size and word[at + 1] in next_:  # neighbours swapped
                after = children[next_[word[at + 1]]].get(word[at])
                if after is not None:
                    states.append((after, at + 2, edits + 1))
        return (best[1], best[0]) if best else None


@dataclass
class Matcher:
    """Terms of a lexicon with their log-odds, and of spellings that training saw near them."""

    terms: list[str]
    odds: list[float]
    certain: list[bool]  # terms that are looked for in other spellings; every learned term is
    spellings: dict[str, float]
    distance: int
    min_length: int

    def __post_init__(self):
        self.exact = {t: i for i, t in enumerate(self.terms)}
        near = {t: i for t, i in self.exact.items() if self.certain[i] and len(t) >= self.min_length}
        self.trie = Trie(near)
        # With one edit, a word keeps the first or the last half of a term; neighbours swapped across
        # the middle leave what stands on both sides of them.
        halves = [(t, len(t) // 2) for t in near]
        self.halves = {(len(t), t[:m], "") for t, m in halves} | {(len(t), "", t[m:]) for t, m in halves}
        self.halves |= {(len(t), t[: m - 1], t[m + 1 :]) for t, m in halves}
        self.lengths = {len(t) for t in near}

    def may_match(self, word: str) -> bool:
        """False only if no term can be within the distance; exact for distance 1."""
        size = len(word)
        if self.distance > 1:
            return any(abs(size - n) <= self.distance for n in self.lengths)
        m = size // 2
        if (size, word[: m - 1], word[m + 1 :]) in self.halves:
            return True
        for n in (size - 1, size, size + 1):
            if n in self.lengths and ((n, word[: n // 2], "") in self.halves or (n, "", word[size - (n - n // 2) :]) in self.halves):
                return True
        return False

    def match(self, word: str) -> tuple[int, int, float] | None:
        """(term, distance, weight) for a lower-case word."""
        at = self.exact.get(word)
        if at is not None:
            return at, 0, self.odds[at]
        plain = word if word.isalpha() else word.translate(LOOKALIKES)
        if plain != word and (at := self.exact.get(plain)) is not None:
            return at, 1, self.odds[at]
        if not self.may_match(word):
            return None
        found = self.trie.within(word, self.distance)
        if found is None:
            return None
        return found[0], found[1], self.spellings.get(word, 0.7 * self.odds[found[0]])


class Memory(dict):
    """What a matcher says of a raw word, remembered."""

    ROOM = 1_000_000

    def __init__(self, matcher: Matcher):
        super().__init__()
        self.matcher = matcher

    def __missing__(self, raw: bytes):
        if len(self) >= self.ROOM:
            self.clear()
        if raw.isalpha():  # ASCII letters alone
            hit = self.matcher.match(raw.lower().decode())
            value = self[raw] = [hit] if hit else []
            return value
        found = []
        for m in WORD.finditer(raw.decode("utf-8", "replace").lower()):
            found.append((m.group(), None if m.group() in QUOTES else self.matcher.match(m.group())))
        if not any(hit for _, hit in found):
            whole = re.sub(r"[\W_]+$|^[\W_]+", "", raw.decode("utf-8", "replace").lower())
            hit = self.matcher.match(whole) if len(found) != 1 or whole != found[0][0] else None
            if hit:
                found = [(whole, hit)]
        value = self[raw] = [hit for _, hit in found if hit]
        return value


def context_words(raw: list[bytes], at: int, window: int) -> list[str]:
    """The words around a hit, quotation marks included."""
    around = raw[max(0, at - window) : at] + raw[at + 1 : at + 1 + window]
    return [m.group() for x in around for m in WORD.finditer(x.decode("utf-8", "replace").lower())]


def is_quoted(raw: list[bytes], at: int, window: int) -> bool:
    before = b" ".join(raw[max(0, at - window) : at + 1]).decode("utf-8", "replace")
    after = b" ".join(raw[at : at + window + 1]).decode("utf-8", "replace")
    return any(c in QUOTES for c in before) and any(c in QUOTES for c in after)


def features(raw: list[bytes], memory: Memory, context: dict[str, float], window: int) -> list[float]:
    hits = [(i, hit) for i, found in enumerate(map(memory.__getitem__, raw)) if found for hit in found]
    if not hits:
        return [0.0] * len(FEATURES)
    close = sum(max(w, 0.0) for _, (_, d, w) in hits if d > 0)
    weight = max(sum(w for _, (_, _, w) in hits), 0.0)
    around = [sum(context.get(c, 0.0) for c in context_words(raw, i, window)) for i, _ in hits]
    quoted = sum(is_quoted(raw, i, window) for i, _ in hits) / len(hits)
    places = [i for i, _ in hits]
    clustered = sum(b - a <= window for a, b in zip(places, places[1:]))
    return [
        np.log1p(weight),
        min(close / weight, 1.0) if weight else 0.0,
        float(np.mean(around)),
        quoted,
        np.log1p(clustered),
        np.log1p(100.0 * weight / len(raw)),
        1.0,
    ]


def training_rows(labels: DataFrame, label: str, usable: Column, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids, at most a quarter labelled 1, chosen by a hash of the id; an id with both labels counts as 1."""
    rows = labels.filter(usable & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    rows = rows.agg(F.max(F.col(label).cast("int")).alias("label"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    parts = [rows.filter(F.col("label") == k).orderBy(order, "doc_id").limit(n) for k, n in ((0, limit - limit // 4), (1, limit // 4))]
    return parts[0].union(parts[1])


def thinned(sample: DataFrame, signs: int = 4) -> DataFrame:
    """The sample without near copies, whose common words would all pass for terms.

    Each text has ``signs`` min-hashes of its five-word shingles.  It stays if no document with a smaller id has one
    of them in the same place; of texts with a similarity of 0.8, one in 600 is overlooked.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            found = np.zeros((batch.num_rows, signs), np.uint64)
            for row, text in zip(found, utf8(batch, "text"), strict=True):
                words = text.lower().split()
                hashes = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
                n = max(len(hashes) - 4, min(len(hashes), 1))
                shingles = np.zeros(n, np.uint64)
                for k in range(min(5, len(hashes))):
                    shingles = (shingles ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
                for k in range(signs if n else 0):
                    mixed = (shingles ^ np.uint64(k * 0x5851F42D4C957F2D & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
                    row[k] = (mixed ^ (mixed >> np.uint64(29))).min()
            columns = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in found.T]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    names = [f"sign{k}" for k in range(signs)]
    found = sample.select("doc_id", "text").mapInArrow(sign, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names))
    found = staged(found, "signs")
    for name in names:
        # Ids of a bounded sample, without texts; many copies come as one row from each task.
        least = found.groupBy(name).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
        sample = sample.join(F.broadcast(least), "doc_id", "left_semi")
    return sample


def document_words(docs: DataFrame) -> DataFrame:
    """(label, word, n): in how many documents of the label a word occurs."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def out() -> Iterator[pa.RecordBatch]:
            for label, counter in counts.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([label] * len(counter), pa.int32()),
                        pa.array(list(counter), pa.string()),
                        pa.array(list(counter.values()), pa.int64()),
                    ],
                    ["label", "word", "n"],
                )
                counter.clear()

        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), utf8(batch, "text"), strict=True):
                found = set(WORD.findall(text.decode("utf-8", "replace").lower()))
                counts[label].update(found)
                if sum(map(len, counts.values())) > 500_000:
                    yield from out()
        yield from out()

    found = docs.select("label", "text").mapInArrow(words, "label int, word string, n bigint")
    return found.groupBy("word").agg(
        *[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(name) for k, name in ((0, "clean"), (1, "toxic"))]
    )


def log_odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    return F.log((toxic + 0.5) / (n_toxic + 1.0)) - F.log((clean + 0.5) / (n_clean + 1.0))


def chance(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Probability that so many of a word's documents are toxic if they are drawn without regard to it."""
    drawn, most = toxic + clean, min(toxic + clean, n_toxic)

    def log_ways(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    total = 0.0
    for k in range(toxic, most + 1):
        term = math.exp(log_ways(n_toxic, k) + log_ways(n_clean, drawn - k) - log_ways(n_toxic + n_clean, drawn))
        total += term
        if term < total * 1e-12:
            break
    return min(total, 1.0)


def beyond_chance(counts: dict[tuple[int, int], int], tested: int, sizes: dict[int, int], limit: float) -> list[tuple[int, int]]:
    """The (toxic, clean) counts of words that pass Benjamini and Hochberg's procedure among ``tested`` words."""
    by_p = sorted((chance(*pair, sizes[1], sizes[0]), pair) for pair in counts)
    rank, passed = 0, 0
    for i, (p, pair) in enumerate(by_p):
        rank += counts[pair]
        if p <= limit * rank / tested:
            passed = i + 1
    return [pair for _, pair in by_p[:passed]]


def learn_matcher(sample: DataFrame, sizes: dict[int, int], settings: Settings) -> Matcher:
    words = staged(document_words(sample), "words")
    odds = log_odds(F.col("toxic"), F.col("clean"), sizes[1], sizes[0])
    likely = words.withColumn("odds", odds).filter((F.col("odds") >= settings.min_odds) & (F.length("word") > 2))
    # Pairs of document counts of a bounded sample.
    pairs = {(r["toxic"], r["clean"]): r["count"] for r in likely.groupBy("toxic", "clean").count().collect()}
    passed = beyond_chance(pairs, words.count(), sizes, settings.false_terms)
    chosen = sample.sparkSession.createDataFrame(passed, "toxic bigint, clean bigint")
    terms = likely.join(F.broadcast(chosen), ["toxic", "clean"]).orderBy("word").select("word", "odds")
    terms = terms.collect()  # words of a bounded sample
    matcher = Matcher(
        [r["word"] for r in terms],
        [r["odds"] for r in terms],
        [True] * len(terms),
        {},
        settings.distance,
        settings.min_length,
    )
    shipped = ship(sample.sparkSession, matcher)

    # Words of the sample that lie near a term without being one: what training says of them.
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(shipped)
        for batch in batches:
            found = [known.match(w) for w in batch.column("word").to_pylist()]
            chosen = [i for i, hit in enumerate(found) if hit and hit[1] > 0]
            yield batch.take(pa.array(chosen, pa.int64()))

    close = words.mapInArrow(near, words.schema)
    # Bounded by the words of the bounded sample.
    spellings = close.withColumn("odds", odds).filter("clean + toxic >= 2").select("word", "odds").collect()
    matcher.spellings = {r["word"]: r["odds"] for r in spellings}
    return matcher


def learn_context(sample: DataFrame, matcher: Matcher, settings: Settings) -> dict[str, float]:
    """Log-odds of words near exact hits, abuse against other mention."""
    shipped = ship(sample.sparkSession, matcher)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(opened(shipped))
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), utf8(batch, "text"), strict=True):
                raw = text.split()
                places = [i for i, hit in enumerate(map(memory.__getitem__, raw)) if hit]
                counts[label].update({w for i in places for w in context_words(raw, i, settings.window)})
                counts[label][""] += bool(places)
        for label, counter in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(counter), pa.int32()), pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())],
                ["label", "word", "n"],
            )

    found = sample.select("label", "text").mapInArrow(near, "label int, word string, n bigint")
    rows = found.groupBy("word").pivot("label", [0, 1]).agg(F.sum("n")).fillna(0)
    rows = {r["word"]: (r["0"], r["1"]) for r in rows.filter(F.expr("`0` + `1` >= 5")).collect()}  # of a bounded sample
    clean, toxic = rows.pop("", (0, 0))
    return {
        w: float(np.log((t + 2) / (toxic + 4)) - np.log((c + 2 * (clean + 4) / (toxic + 4)) / (clean + 4)))
        for w, (c, t) in rows.items()
    }


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a logistic model (the constant last) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def document_features(docs: DataFrame, matcher: Matcher, context: dict[str, float], settings: Settings, *keep: str) -> DataFrame:
    shipped = ship(docs.sparkSession, (matcher, context))
    names = [*keep, *FEATURES]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, around = opened(shipped)
        memory = Memory(known)
        for batch in batches:
            found = np.array([features(t.split(), memory, around, settings.window) for t in utf8(batch, "text")])
            found = found.reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep] + [pa.array(found[:, i]) for i in range(len(FEATURES))], names
            )

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keep] + [f"{f} double" for f in FEATURES])
    return docs.select(*keep, "text").mapInArrow(read, schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: held_out, score, predicted, and the hits' features.

    Documents need ``doc_id`` and ``text``, labels ``doc_id`` and ``toxic``.
    Labels are learned from ids whose crc32 is not divisible by five; a null id
    is never learned from and not held out.  Scores use the text alone: null and
    empty texts have no hits and get the score of that.  Repeated rows get equal
    scores.  Without labels of both kinds all scores are the share of toxic ones
    learned (0 if there are none).  An empty table gives no rows; other columns
    are not read.
    """
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = training_rows(labels, "toxic", ~held_out(F.col("doc_id")), settings.training_rows)
    # The labels are bounded by training_rows; the join needs no shuffle of the texts.
    found = chosen.join(F.broadcast(staged(rows, "labels")), "doc_id")
    # One text an id, so that repeated ids leave the sample's bound alone.
    one = F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text")
    sample = staged(found.groupBy("doc_id").agg(F.first("label").alias("label"), one), "labelled")
    sample = staged(thinned(sample), "sample")
    sizes = {0: 0, 1: 0} | {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    matcher = learn_matcher(sample, sizes, settings)
    context = learn_context(sample, matcher, settings)
    weights = np.zeros(len(FEATURES) + 1)
    weights[-1] = -30.0 if not sizes[1] else np.log(sizes[1] / max(sizes[0], 1e-9))
    if all(sizes.values()):
        found = document_features(sample, matcher, context, settings, "label").toArrow()  # bounded by training_rows
        x = np.column_stack([found[f].to_numpy() for f in FEATURES])
        weights = fit_logistic(x, found["label"].to_numpy(), settings.ridge)
    of_text = document_features(chosen, matcher, context, settings, "doc_id")
    linear = sum((F.col(f) * float(w) for f, w in zip(FEATURES, weights)), F.lit(float(weights[-1])))
    value = 1 / (1 + F.exp(-linear))
    return of_text.withColumn("score", value).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        *FEATURES,
    )
