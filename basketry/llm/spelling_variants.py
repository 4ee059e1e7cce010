"""Spelling variants of words, grouped under their most frequent form.

Two words are near if one inserted, deleted or replaced code point turns one into the
other.  The vocabulary is searched by full-text indexes of its delimited words, one of
the text and one of its reverse: a search matches one half of a word exactly, from the
word's end inwards, and extends the interval of suffix ranks across the other half,
allowing one error there.  A single error leaves one half intact, so the two searches
find every near word.

Spark deals the vocabulary out by those halves: a word is sent, as one to be found, to
the blocks of its own halves and of those it would share with a word one shorter, and
as one that searches to the blocks of its own two.  Each block is indexed and searched
by itself.  Where a half is shared by more than ``room`` words, the exact part grows: a
search goes on in two, with half of what was free to differ now exact, until its words
are few.  So no block grows with a frequent half and no pair is lost.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import utf8
from basketry.session import staged

END, DELIMITER, FIRST_LETTER = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    least_chars: int = 7
    least_count: int = 2
    ratio: int = 10  # of a form's occurrences to those of its variant
    every: int = 31  # one run in so many loses a code point
    room: int = 20_000  # words that share the exact part of a search
    block: int = 60_000  # words to be found in a block, on average


def words(docs: DataFrame, settings: Settings) -> DataFrame:
    """(word, n): the runs of letters of all documents, some of them with a code point deleted.

    A run's fate depends on its document's id (null: empty) and its letters, so each text's runs are counted first.
    """
    room = 500_000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        from collections import Counter

        # A-Z are lower-cased before; U+00C0 to U+00FF take two bytes.
        runs = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+").findall
        held: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                found = pa.array(held.keys(), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([found, pa.array(held.values(), pa.int64())], ["word", "n"])
                held.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), strict=True):
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
                for run, n in Counter(runs(text.lower())).items():
                    h = zlib.crc32(run, start)
                    if h % settings.every == 0:
                        letters = run.decode()
                        gone = h % len(letters)
                        run = (letters[:gone] + letters[gone + 1 :]).encode()
                    if len(run) >= settings.least_chars:
                        held[run] += n
                if len(held) > room:
                    yield from out()
        yield from out()

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counted = chosen.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter((F.col("n") >= settings.least_count) & (F.length("word") >= settings.least_chars))


class Index:
    """Full-text index of delimited words that extends a match one symbol to the left.

    Occurrences of every symbol are kept as bits, with their number before each run of 64.
    """

    def __init__(self, texts: list[np.ndarray], n_symbols: int):
        sizes = np.array([len(t) + 1 for t in texts])
        starts = np.cumsum(sizes) - sizes
        text = np.full(int(sizes.sum()) + 2, DELIMITER, np.int64)
        text[-1] = END
        inside = np.ones(len(text), bool)
        inside[starts] = inside[-2:] = False
        text[inside] = np.concatenate(texts)
        suffixes = self._sorted_suffixes(text)
        self.last = text[suffixes - 1].astype(np.int16)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        # Which word begins with the delimiter that a suffix begins with.
        word_of = np.full(len(text), -1, np.int64)
        word_of[starts] = np.arange(len(texts))
        self.word = word_of[suffixes]
        n_bits = -(-(len(text) + 1) // 64) * 64
        self.bits = np.zeros((n_symbols, n_bits // 64), np.uint64)
        for symbol in range(n_symbols):
            held = np.zeros(n_bits, bool)
            held[: len(text)] = self.last == symbol
            self.bits[symbol] = np.packbits(held, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(ones, axis=1) - ones
        self.n_symbols = n_symbols

    @staticmethod
    def _sorted_suffixes(text: np.ndarray) -> np.ndarray:
        """By prefix doubling: ranks of twice as many symbols from two ranks each."""
        rank, reach = text, 1
        while True:
            second = np.zeros_like(rank)
            second[:-reach] = rank[reach:] + 1
            key = rank * (int(rank.max()) + 2) + second
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty_like(new)
            rank[order] = new
            if new[-1] == len(text) - 1:
                return order
            reach *= 2

    def _count(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol ends the rows before these."""
        word, bit = row >> 6, (row & 63).astype(np.uint64)
        below = self.bits[symbol, word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[symbol, word] + np.bitwise_count(below)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals with each symbol put in front."""
        first = self.begin[symbol]
        return first + self._count(symbol, low), first + self._count(symbol, high)

    def letters_before(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of interval, letter) for each letter that stands before a row of an interval."""
        size = high - low
        wide = size > self.n_symbols
        places, letters = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        narrow = np.flatnonzero(~wide)
        if len(narrow):
            of = np.repeat(narrow, size[narrow])
            first = np.cumsum(size[narrow]) - size[narrow]
            rows = np.arange(len(of)) - np.repeat(first, size[narrow]) + low[of]
            found = np.unique(of * self.n_symbols + self.last[rows])
            places.append(found // self.n_symbols)
            letters.append(found % self.n_symbols)
        some = np.flatnonzero(wide)
        places.append(np.repeat(some, self.n_symbols - FIRST_LETTER))
        letters.append(np.tile(np.arange(FIRST_LETTER, self.n_symbols), len(some)))
        place, letter = np.concatenate(places), np.concatenate(letters)
        real = letter >= FIRST_LETTER
        return place[real], letter[real]

    def search(self, patterns: np.ndarray, sizes: np.ndarray, exact: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word) with one symbol of the pattern replaced or one more in the word.

        Patterns are rows in the order in which they are matched; their first ``exact`` and last ``tail`` symbols
        match as they are.
        """
        e = np.arange(len(sizes))
        e_low = np.full(len(e), self.begin[DELIMITER])
        e_high = np.full(len(e), self.begin[DELIMITER + 1])
        p, p_low, p_high = (np.zeros(0, np.int64) for _ in range(3))
        out_pattern, out_word = [p], [p]
        for t in range(int(sizes.max(initial=0)) + 1):
            ready = np.flatnonzero((exact[e] <= t) & (t <= sizes[e] - tail[e]))
            place, letter = self.letters_before(e_low[ready], e_high[ready])
            at = ready[place]
            child, (c_low, c_high) = e[at], self.extend(letter, e_low[at], e_high[at])
            one_more = (np.concatenate([p, child]), np.concatenate([p_low, c_low]), np.concatenate([p_high, c_high]))
            p, p_low, p_high, done = self._match(patterns, sizes, t, *one_more)
            out_pattern.append(done[0])
            out_word.append(self.word[done[1]])
            other = t < sizes[child] - tail[child]
            other[other] = letter[other] != patterns[child[other], t]
            p = np.concatenate([p, child[other]])
            p_low, p_high = np.concatenate([p_low, c_low[other]]), np.concatenate([p_high, c_high[other]])
            e, e_low, e_high, _ = self._match(patterns, sizes, t, e, e_low, e_high)
            if not len(e) and not len(p):
                break
        pattern, word = np.concatenate(out_pattern), np.concatenate(out_word)
        pairs = np.unique(pattern * max(1, len(self.word)) + word)
        return pairs // max(1, len(self.word)), pairs % max(1, len(self.word))

    def _match(self, patterns, sizes, t, of, low, high):
        """Intervals that go on with the pattern's symbol at ``t``, and (pattern, row) of those that end there."""
        goes_on = sizes[of] > t
        symbol = np.full(len(of), DELIMITER)
        symbol[goes_on] = patterns[of[goes_on], t]
        low, high = self.extend(symbol, low, high)
        alive = low < high
        on, ended = goes_on & alive, ~goes_on & alive
        return of[on], low[on], high[on], (of[ended], low[ended])


def padded(texts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(texts), max(map(len, texts), default=0) + 1), np.int16)
    for row, text in zip(out, texts, strict=True):
        row[: len(text)] = text
    return out


def near_in_block(block: pd.DataFrame) -> pd.DataFrame:
    """(word, near, near_n) among the words of a block; a pair may come up in several blocks."""
    by_word = block.drop_duplicates("word").set_index("word")["n"]
    names = by_word.index.to_numpy()
    points = [np.frombuffer(w.encode("utf-32-le"), "<u4").astype(np.int64) for w in names]
    alphabet = np.unique(np.concatenate(points))
    symbols = [np.searchsorted(alphabet, x) + FIRST_LETTER for x in points]
    number = dict(zip(names, range(len(names)), strict=True))
    to_find = np.array([number[w] for w in block.loc[~block["searches"], "word"].drop_duplicates()], np.int64)
    searches = block[block["searches"]]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(to_find) and len(searches):
        of = np.array([number[w] for w in searches["word"]], np.int64)
        head, tail = searches["head"].to_numpy(), searches["tail"].to_numpy()
        for forward in (False, True):
            # From the longer exact end inwards; the index of the reversed words is read from the left.
            mine = np.flatnonzero((head > tail) == forward)
            if not len(mine):
                continue
            turn = -1 if forward else 1
            index = Index([symbols[i][::turn] for i in to_find], len(alphabet) + FIRST_LETTER)
            exact, rest = (head, tail) if forward else (tail, head)
            mine = mine[np.argsort([len(symbols[i]) for i in of[mine]], kind="stable")]
            for part in chunks(mine, [len(symbols[i]) for i in of[mine]]):
                rows = [symbols[i][::-turn] for i in of[part]]
                sizes = np.array([len(r) for r in rows])
                pattern, word = index.search(padded(rows), sizes, exact[part], rest[part])
                found.append((of[part][pattern], to_find[word]))
    if not found:
        return pd.DataFrame({"word": [], "near": [], "near_n": []}).astype({"word": str, "near": str, "near_n": "int64"})
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    # A longer word does not search shorter ones, so those pairs are told both ways.
    lengths = np.array([len(x) for x in points])
    longer = lengths[b] > lengths[a]
    a, b = np.concatenate([a, b[longer]]), np.concatenate([b, a[longer]])
    return pd.DataFrame({"word": names[a], "near": names[b], "near_n": by_word.to_numpy()[b]}).drop_duplicates()


def chunks(rows: np.ndarray, sizes: list[int], room: int = 4_000_000) -> Iterator[np.ndarray]:
    """Runs of rows, in ascending size, whose padded table stays small."""
    start = 0
    for i, size in enumerate(sizes):
        if i > start and (i + 1 - start) * (size + 1) > room:
            yield rows[start:i]
            start = i
    yield rows[start:]


def exact_part(word: Column, head: Column, tail: Column, length: Column) -> Column:
    """A number for the letters that must match at either end of a pattern of that length."""
    return F.xxhash64(length, head, tail, F.left(word, head), F.right(word, tail)).alias("part")


def parts(vocabulary: DataFrame, settings: Settings) -> DataFrame:
    """(word, n, searches, length, head, tail): the halves under which words search and are found."""
    size = F.length("word")
    own = [(True, size), (False, size)]
    shorter = F.when(size > settings.least_chars, size - 1)
    entries = []
    for searches, length in [*own, (False, shorter)]:
        half = F.floor(length / 2).cast("int")
        for head, tail in ((half, F.lit(0)), (F.lit(0), length - half)):
            entry = [F.lit(searches).alias("searches"), length.alias("length"), head.alias("head"), tail.alias("tail")]
            entries.append(F.struct(*entry))
    found = vocabulary.select("word", "n", F.explode(F.array(*entries)).alias("as"))
    return found.select("word", "n", "as.*").filter(F.col("length").isNotNull())


def refined(entries: DataFrame) -> DataFrame:
    """Two parts for each: half of what was free to differ joins the head, or the tail."""
    free = F.col("length") - F.col("head") - F.col("tail")
    half = F.floor(free / 2).cast("int")
    more_head = F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"))
    more_tail = F.struct(F.col("head").alias("head"), (F.col("tail") + free - half).alias("tail"))
    return entries.select("word", "n", "searches", "length", F.explode(F.array(more_head, more_tail)).alias("as")).select(
        "word", "n", "searches", "length", "as.*"
    )


def with_part(entries: DataFrame) -> DataFrame:
    return entries.withColumn("part", exact_part(*(F.col(c) for c in ("word", "head", "tail", "length"))))


def dealt(vocabulary: DataFrame, settings: Settings) -> DataFrame:
    """All entries, with parts that few words share."""
    open_ = with_part(parts(vocabulary, settings))
    done = None
    while True:
        can_grow = F.col("length") - F.col("head") - F.col("tail") > 1
        many = open_.filter(~F.col("searches") & can_grow).groupBy("part").count()
        many = staged(many.filter(F.col("count") > settings.room).select("part"), "many")
        if many.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        few = open_.join(many, "part", "left_anti")
        done = few if done is None else done.unionByName(few)
        open_ = staged(with_part(refined(open_.join(many, "part", "left_semi"))), "refined")


def near_words(vocabulary: DataFrame, settings: Settings) -> DataFrame:
    """(word, near, near_n): every ordered pair of near words, once."""
    entries = dealt(vocabulary, settings)
    # Four parts a word at least, those of the shortest words are two.
    blocks = max(1, -(-4 * vocabulary.count() // settings.block))
    block = F.pmod("part", F.lit(blocks)).cast("int").alias("block")
    found = entries.select(block, "word", "n", "searches", "head", "tail").groupBy("block")
    pairs = found.applyInPandas(near_in_block, "word string, near string, near_n bigint")
    # By the word alone, which the count of near words needs again.
    return pairs.repartition("word").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last; each round doubles the steps.

    A form has several times its variant's occurrences, so there are few steps.
    """
    step = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if onward.join(step, "root", "left_semi").isEmpty():
            return step
        followed = step.join(onward, "root", "left")
        step = staged(followed.select("word", F.coalesce("further", "root").alias("root")), "roots")


def variants(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per word: its occurrences, near words, form and root.

    Needs ``doc_id`` (null counts as empty) and ``text`` (null has no words); other columns are not read.  Repeated
    rows count as often as they are there.  An empty table, or one without words that repeat, gives no rows.
    """
    vocabulary = staged(words(docs, settings), "vocabulary")
    # The most frequent; of those the first in code-point order, which is that of UTF-8 bytes.
    first = F.min(F.struct((-F.col("near_n")).alias("less_n"), "near"))
    best = near_words(vocabulary, settings).groupBy("word").agg(F.count("*").alias("n_near"), first.alias("first"))
    found = vocabulary.join(best, "word", "left")
    near, near_n = F.col("first.near"), -F.col("first.less_n")
    is_form = near_n >= settings.ratio * F.col("n")
    found = found.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, near).alias("form"),
        F.when(is_form, near_n).alias("form_n"),
    )
    found = staged(found, "forms")
    ends = roots(found.filter(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
