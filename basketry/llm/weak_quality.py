"""Quality classifier from weak labels.

Several heuristic labellers look at every document and vote good, bad or
abstain.  Nobody says how good they are: expectation-maximisation over the vote
patterns of all documents estimates each labeller's rates of every vote for good
and for bad documents, as if votes were independent given the class.  The
posterior of a document's pattern is its label, and a linear model over hashed
features of the text's word shapes learns these labels from a bounded sample, so
that it also judges what the labellers abstain on.

There are at most 3 to the power of the number of labellers patterns, and
counting them is the only shuffle.  Features are few per document (kinds of word
shapes, not words) and are written once with the votes.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import opened, ship, utf8
from basketry.llm.html_blocks import STOP_WORDS
from basketry.session import staged_texts

GOOD, BAD, ABSTAIN = 1, 0, 2
SHORT = 5  # words, below which nothing can be said
# (statistic, bad from here on, good up to there): where bad is the lower number, more is better.
# Those that look for one fault have no second number: they vote bad or abstain.
LABELLERS = (
    ("function_words", 0.04, 0.12),
    ("symbols", 0.10, None),
    ("repeats_last", 0.10, None),
    ("capitals", 0.40, None),
    ("variety", 0.15, 0.30),
    ("no_letters", 0.15, None),
    ("marks", 0.30, None),
    ("long_words", 0.30, 0.10),
    ("same_lines", 0.40, None),
)
FUNCTION_WORDS = frozenset(w.encode() for listed in STOP_WORDS.values() for w in listed)
RUNS = re.compile(r"(.)\1+")


@dataclass(frozen=True)
class Settings:
    bits: int = 16
    training_rows: int = 20_000
    iterations: int = 200
    steps: int = 300
    rate: float = 0.5
    ridge: float = 1e-4
    min_score: float = 0.5


def shape(word: str) -> str:
    """A word's letters as a or A, digits as 0, other characters as they are, runs as one."""
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word[:64])
    return RUNS.sub(r"\1", out)[:12]


class Shapes(dict):
    """(hash of the shape, letters, capitals, marks, function word) of a raw word, remembered."""

    ROOM = 500_000

    def __missing__(self, raw: bytes) -> int:
        if len(self) >= self.ROOM:
            self.clear()
        word = raw.decode("utf-8", "replace")
        letters = sum(map(str.isalpha, word))
        capitals = sum(map(str.isupper, word))
        facts = (
            (xxhash.xxh3_64_intdigest(shape(word).encode()) & 0xFFFFFFFF)
            | min(letters, 255) << 32
            | min(capitals, 255) << 40
            | min(word.count("!") + word.count("?"), 15) << 48
            | (raw.lower() in FUNCTION_WORDS) << 52
            | min(len(word), 255) << 53
        )
        self[raw] = facts
        return facts


def statistics(text: str, words: list[bytes], facts: np.ndarray) -> dict[str, float]:
    n = max(len(words), 1)
    letters, capitals = (facts >> 32) & 255, (facts >> 40) & 255
    lines = [line for line in text.split("\n") if line.strip()]
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return {
        "function_words": float(((facts >> 52) & 1).sum()) / n,
        "symbols": sum(map(text.count, "#*$%&|<>{}\\^~")) / n,
        "repeats_last": repeats / n,
        "capitals": float(capitals.sum()) / max(float(letters.sum()), 1.0),
        # Different words fall off with length, so they are counted against its square root beyond 100 words.
        "variety": len(set(words)) / min(n, 10 * n**0.5),
        "no_letters": float((letters == 0).sum()) / n,
        "marks": float(((facts >> 48) & 15).sum()) / n,
        "long_words": float(((facts >> 53) > 25).sum()) / n,
        "same_lines": (len(lines) - len(set(lines))) / max(len(lines), 1),
    }


def votes(found: dict[str, float], n_words: int) -> list[int]:
    out = []
    for name, bad, good in LABELLERS:
        value = found[name]
        if n_words < SHORT or (name == "function_words" and n_words < 20 and value <= bad):
            out.append(ABSTAIN)
        elif good is not None and bad < good:
            out.append(BAD if value <= bad else GOOD if value >= good else ABSTAIN)
        else:
            out.append(BAD if value >= bad else GOOD if good is not None and value <= good else ABSTAIN)
    return out


def hashed_features(facts: np.ndarray, found: dict[str, float], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): square roots of the shares of word shapes and pairs of them, and steps of the statistics."""
    mask = np.int64((1 << bits) - 1)
    ids = facts & 0xFFFFFFFF
    pairs = (ids[:-1] * 0x9E3779B1 + ids[1:] * 0x85EBCA77) >> 13
    slots, counts = np.unique(np.concatenate([ids & mask, pairs & mask]), return_counts=True)
    steps = [xxhash.xxh3_64_intdigest(f"{name}:{min(int(value * 20), 40)}".encode()) & int(mask) for name, value in found.items()]
    values = np.sqrt(counts / max(len(facts), 1))
    return np.concatenate([slots, steps]).astype(np.int32), np.concatenate([values, np.ones(len(steps))]).astype(np.float32)


def described(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, pattern (the votes as one number), short (too short to judge), and the hashed features."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            patterns, short, slots, values = [], [], [], []
            for raw in utf8(batch, "text"):
                words = raw.split()
                facts = np.fromiter(map(shapes.__getitem__, words), np.int64, len(words))
                found = statistics(raw.decode("utf-8", "replace"), words, facts)
                pattern = 0
                for vote in votes(found, len(words)):
                    pattern = 3 * pattern + vote
                patterns.append(pattern)
                short.append(len(words) < SHORT)
                at, value = hashed_features(facts, found, settings.bits)
                slots.append(at)
                values.append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(patterns, pa.int32()),
                    pa.array(short, pa.bool_()),
                    pa.array(slots, pa.list_(pa.int32())),
                    pa.array(values, pa.list_(pa.float32())),
                ],
                ["doc_id", "pattern", "short", "slots", "values"],
            )

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return chosen.mapInArrow(read, "doc_id bigint, pattern int, short boolean, slots array<int>, values array<float>")


def unpacked(patterns: np.ndarray) -> np.ndarray:
    """Votes by pattern and labeller."""
    places = 3 ** np.arange(len(LABELLERS) - 1, -1, -1)
    return patterns[:, None] // places % 3


def label_model(patterns: np.ndarray, counts: np.ndarray, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good by pattern, accuracy by labeller), by expectation-maximisation.

    It starts from the share of good votes; pseudo-counts keep rates off 0 and 1.
    Documents on which all abstain say nothing of the rates; their posterior is
    the share of good documents.
    """
    if not len(patterns):
        return np.zeros(0), np.zeros(len(LABELLERS))
    cast = unpacked(patterns)
    silent = (cast == ABSTAIN).all(1)
    counts = np.where(silent, 0.0, counts)
    good, bad = (cast == GOOD).sum(1), (cast == BAD).sum(1)
    # One bad vote weighs several good ones to begin with: labellers look for faults.
    posterior = (good + 1.0) / (good + 4.0 * bad + 2.0)
    outcomes = np.stack([cast == k for k in (BAD, GOOD, ABSTAIN)], 2).astype(float)
    for _ in range(iterations):
        log_odds = np.log((posterior @ counts + 1) / ((1 - posterior) @ counts + 1))
        rates = []
        for weight in (posterior * counts, (1 - posterior) * counts):
            seen = np.einsum("p,plk->lk", weight, outcomes) + 0.5
            rates.append(seen / seen.sum(1, keepdims=True))
        scores = log_odds + np.einsum("plk,lk->p", outcomes, np.log(rates[0]) - np.log(rates[1]))
        updated = 1 / (1 + np.exp(-np.clip(scores, -50, 50)))
        if np.abs(updated - posterior).max() < 1e-9:
            break
        posterior = updated
    posterior = np.where(silent, (posterior @ counts + 1) / (counts.sum() + 2), posterior)
    right = np.einsum("p,pl->l", posterior * counts, cast == GOOD) + np.einsum("p,pl->l", (1 - posterior) * counts, cast == BAD)
    return posterior, right / np.maximum((counts[:, None] * (cast != ABSTAIN)).sum(0), 1)


def fit_linear(lengths, slots, values, target: np.ndarray, settings: Settings) -> np.ndarray:
    """Weights (the constant last) of a logistic model on soft labels, by gradient steps scaled per weight."""
    size = 1 << settings.bits
    row = np.repeat(np.arange(len(lengths)), lengths)
    w, seen = np.zeros(size + 1), np.full(size + 1, 1e-8)
    for _ in range(settings.steps if len(lengths) else 0):
        linear = np.bincount(row, values * w[slots], len(lengths)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(linear, -30, 30))) - target) / len(lengths)
        gradient = np.append(np.bincount(slots, values * error[row], size), error.sum()) + settings.ridge * w
        seen += gradient**2
        w -= settings.rate * gradient / np.sqrt(seen)
    return w


def quality(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: the labellers' posterior, the classifier's score, and whether it is kept.

    Needs ``doc_id`` and ``text``.  Null, empty and very short texts get no votes;
    their posterior and score are the share of good documents.  Repeated rows get equal scores; an empty table gives no
    rows; other columns are not read.  Nothing but the text enters a score.
    """
    found = staged_texts(described(docs, settings), "described")
    counted = found.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toArrow()
    patterns, counts = counted["pattern"].to_numpy(), counted["n"].to_numpy().astype(float)
    posterior, _ = label_model(patterns, counts, settings.iterations)
    of_pattern = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))

    rows = int(counts.sum())
    share = min(1.0, settings.training_rows / max(rows, 1))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(2**32)) / F.lit(float(2**32))
    silent = 3 ** len(LABELLERS) - 1  # all abstain: no label to learn from
    sample = found.filter(F.col("pattern") != silent).filter((chance < 1.2 * share) | F.lit(share >= 1)).orderBy(chance, "doc_id").limit(settings.training_rows)
    sample = sample.select("pattern", "slots", "values").toArrow()  # bounded by training_rows
    lengths = sample["slots"].combine_chunks().value_lengths().to_numpy() if len(sample) else np.zeros(0, int)
    slots = sample["slots"].combine_chunks().flatten().to_numpy() if len(sample) else np.zeros(0, int)
    values = sample["values"].combine_chunks().flatten().to_numpy() if len(sample) else np.zeros(0)
    target = np.array([of_pattern[p] for p in sample["pattern"].to_pylist()])
    weights = fit_linear(lengths, slots, values.astype(float), target, settings)
    shipped = ship(docs.sparkSession, (weights, of_pattern))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = opened(shipped)
        for batch in batches:
            of_row = batch.column("slots").value_lengths().to_numpy()
            row = np.repeat(np.arange(len(of_row)), of_row)
            at, value = batch.column("slots").flatten().to_numpy(), batch.column("values").flatten().to_numpy()
            linear = np.bincount(row, value * w[at], len(of_row)) + w[-1]
            label = np.array([known[p] for p in batch.column("pattern").to_pylist()], float)
            short = batch.column("short").to_numpy(zero_copy_only=False).astype(bool)
            value = np.where(short, label, 1 / (1 + np.exp(-np.clip(linear, -30, 30))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("pattern"), pa.array(label), pa.array(value)],
                ["doc_id", "pattern", "posterior", "score"],
            )

    scored = found.mapInArrow(rate, "doc_id bigint, pattern int, posterior double, score double")
    return scored.select("doc_id", "pattern", "posterior", "score", (F.col("score") >= settings.min_score).alias("kept"))
