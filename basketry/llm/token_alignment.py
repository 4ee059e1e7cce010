"""How the tokens of two vocabularies line up over the same texts.

Both vocabularies spell out the same bytes, so the tokens of a text have byte ranges
in common.  Two tokens whose ranges overlap are linked; places where tokens of both
end cut the text into groups.  A pair of ids counts as many links as hold it over the
whole corpus.

Texts are tokenised once; their ids are written as a table.  First pass: tasks align
their documents and add up pairs; the distinct pairs get a minimal perfect hash (every
key has one slot, no slot is empty), built block by block.  Each task's counts become a dense vector indexed by that hash, cut into slices, and
the vectors are added up in a tree of fixed fan-in.  Every slot also stores its key,
so that a pair the hash has never seen is recognised.  Second pass: documents are
aligned again and look their links' counts up.

The table of counts is broadcast up to ``broadcast_pairs`` pairs, a bound that is
checked; the vocabularies bound it too (50,257 x 32,000).  A larger table stays a
table: documents' pairs are joined to it.  Both ways give the same rows.

Documents are aligned many at a time: the ends of both vocabularies' tokens, merged,
cut the bytes into stretches that lie in one token of each, and each stretch is a link.
"""

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import packing
from basketry.llm.common import opened, ship, utf8
from basketry.session import staged

# A pair of ids in one number: the second id takes the lower bits.
ID_BITS = 20
LOW = (1 << ID_BITS) - 1
SLICE = 8192
FAN_IN = 8
ROOM = 150_000  # pieces of text whose ids a task remembers, and as many that it has met before them
COLUMNS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint"
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@dataclass(frozen=True)
class Vocabularies:
    """Files of a byte-level vocabulary and of a piece vocabulary; executors read them under these paths."""

    bytes_file: str
    pieces_file: str


class ByteTokens:
    """Ids of a byte-level vocabulary, for a text with a blank before it."""

    def __init__(self, file: str):
        self.encoder = packing.Encoder(file)
        self.encoder.ROOM = ROOM // 10
        self.encoder.whole.encode_special_tokens = True
        letters = packing._byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        vocabulary = self.encoder.whole.get_vocab(with_added_tokens=False)
        self.spelt = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in byte_of for c in token):
                self.spelt[i] = bytes(byte_of[c] for c in token)

    def encode(self, text: str) -> bytes:
        return self.encoder.encode(" " + text)


class PieceTokens:
    """Ids of a piece vocabulary, which puts a blank before the text by itself.

    If no piece goes on from a character into a blank, what stands between blanks may be encoded ``one_by_one``.
    """

    def __init__(self, file: str):
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_file=file)
        self.spelt = [self._spell(i) for i in range(self.pieces.get_piece_size())]
        kinds = (self.pieces.is_byte, self.pieces.is_control, self.pieces.is_unknown)
        plain = [i for i in range(len(self.spelt)) if not any(kind(i) for kind in kinds)]
        self.one_by_one = not any(re.search(rb"[^ ] ", self.spelt[i]) for i in plain)

    def _spell(self, i: int) -> bytes:
        if self.pieces.is_byte(i):
            return bytes([int(self.pieces.id_to_piece(i)[3:5], 16)])
        return self.pieces.id_to_piece(i).replace("▁", " ").encode()

    def encode(self, text: str) -> bytes | None:
        """None if the tokens do not spell the text."""
        ids = self.pieces.encode(text, num_threads=1)
        if b"".join([self.spelt[i] for i in ids]) != b" " + text.encode():
            return None
        return array("I", ids).tobytes()


class BothTokens:
    """Ids of both vocabularies, as unsigned 32-bit numbers; None where one does not spell the text.

    What stands between single blanks is encoded by itself and remembered, unless white space or unusual characters
    make that unsafe.  When there are too many, those not met since the last time are forgotten.
    """

    def __init__(self, files: Vocabularies):
        self.a, self.b = ByteTokens(files.bytes_file), PieceTokens(files.pieces_file)
        self.sizes = np.array([len(x) for x in self.a.spelt])
        self.fast = self.a.encoder.fast.encode_ordinary
        self.recent: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        marks = [re.escape(s) for s in self.a.encoder.special]
        self.unsafe = re.compile("|".join(["  ", "(?: |^)[\\t\\n\\r]", "^ | $", *marks])).search

    def _remembered(self, chunk: str) -> tuple[bytes, bytes | None]:
        found = self.older.get(chunk)
        if found is None:
            found = array("I", self.fast(" " + chunk)).tobytes(), self.b.encode(chunk)
        if len(self.recent) >= ROOM:
            self.recent, self.older = {}, self.recent
        self.recent[chunk] = found
        return found

    def encode(self, text: str) -> tuple[bytes, bytes] | None:
        if not text:
            return None
        if not self.b.one_by_one or self.unsafe(text) or self.a.encoder.unusual(text):
            second = self.b.encode(text)
            first = self.a.encode(text) if second else b""
        else:
            found = [self.recent.get(c) or self._remembered(c) for c in text.split(" ")]
            seconds = [x[1] for x in found]
            second = None if None in seconds else b"".join(seconds)
            first = b"".join([x[0] for x in found])
        if not second or self.sizes[np.frombuffer(first, "<u4")].sum() != len(text.encode()) + 1:
            return None
        return first, second


def tokenised(docs: DataFrame, files: Vocabularies) -> DataFrame:
    """doc_id, a hash of the text, and the ids of both vocabularies, empty where a text has no tokens."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = BothTokens(files)
        widths = _width(both.a.spelt), _width(both.b.spelt)
        for batch in batches:
            rows = []
            for raw in utf8(batch, "text"):
                found = both.encode(raw.decode("utf-8", "replace")) or (b"", b"")
                rows.append([np.frombuffer(ids, "<u4").astype(width).tobytes() for ids, width in zip(found, widths, strict=True)])
            columns = [pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *columns], ["doc_id", "key", "a", "b"])

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("key"), "text")
    return chosen.mapInArrow(encode, "doc_id bigint, key string, a binary, b binary")


def _width(vocabulary) -> str:
    return "<u2" if len(vocabulary) <= 1 << 16 else "<u4"


class Spelling:
    """Both vocabularies' token lengths, and the ids as text."""

    def __init__(self, files: Vocabularies):
        a, b = ByteTokens(files.bytes_file), PieceTokens(files.pieces_file)
        self.sizes = [np.array([len(x) for x in v.spelt]) for v in (a, b)]
        self.widths = [_width(v.spelt) for v in (a, b)]
        # An id with what follows it: within its side of a group, or at the side's end.
        count = max(map(len, self.sizes))
        texts = [f"{i}{sign}".encode() for sign in ",|;" for i in range(count)]
        self.text = np.array(texts).view(np.uint8).reshape(len(texts), -1)
        self.text_size = np.array([len(t) for t in texts])
        self.inner, self.bar, self.end = 0, count, 2 * count

    def line_up(self, batch: pa.RecordBatch) -> "Links":
        sides = []
        for name, width, sizes in zip("ab", self.widths, self.sizes, strict=True):
            rows = [np.frombuffer(x, width) for x in batch.column(name).to_pylist()]
            ids = np.concatenate(rows or [np.zeros(0, width)]).astype(np.int64)
            sides.append((ids, np.cumsum(sizes[ids]), np.array([len(r) for r in rows], np.int64)))
        return Links(self, *sides)


class Links:
    """The links of some documents, one after the other as if they were one text."""

    def __init__(self, spelling: Spelling, a: tuple, b: tuple):
        self.spelling = spelling
        (self.a, a_ends, self.n_a), (self.b, b_ends, self.n_b) = a, b
        merged = np.concatenate([a_ends, b_ends])
        order = np.argsort(merged, kind="stable")
        merged, from_a = merged[order], order < len(a_ends)
        first = np.ones(len(merged), bool)
        first[1:] = merged[1:] != merged[:-1]
        starts = np.flatnonzero(first)
        # The tokens that ended before a stretch are so many, and the next one of each side holds it.
        a_before = np.cumsum(from_a) - from_a
        at_a, at_b = a_before[starts], (np.arange(len(merged)) - a_before)[starts]
        self.pairs = self.a[at_a] << ID_BITS | self.b[at_b] if len(starts) else np.zeros(0, np.int64)
        both = np.diff(starts, append=len(merged)) == 2
        # At the end of a group both of its last tokens end.
        self.a_last, self.b_last = at_a[both], at_b[both]
        row_of_token = np.repeat(np.arange(len(self.n_a)), self.n_a)
        self.row_of_link, self.row_of_group = row_of_token[at_a], row_of_token[self.a_last]

    def per_row(self, rows: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        """How many of these ascending row numbers there are for each row, or the sum of their values."""
        ends = np.searchsorted(rows, np.arange(len(self.n_a)), side="right")
        if values is None:
            return np.diff(ends, prepend=0)
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return np.diff(sums[ends], prepend=0)

    def groups(self) -> list[str]:
        """Every row's groups as text, hashed; empty without tokens."""
        spelling = self.spelling
        a_ends, b_ends = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        a_ends[self.a_last] = b_ends[self.b_last] = 1
        group_of_a, group_of_b = np.cumsum(a_ends) - a_ends, np.cumsum(b_ends) - b_ends
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        b_before = np.concatenate([[0], self.b_last + 1])
        codes[np.arange(len(self.a)) + b_before[group_of_a]] = self.a + np.where(a_ends, spelling.bar, spelling.inner)
        codes[np.arange(len(self.b)) + self.a_last[group_of_b] + 1] = self.b + np.where(b_ends, spelling.end, spelling.inner)
        sizes = spelling.text_size[codes]
        shown = np.arange(spelling.text.shape[1]) < sizes[:, None]
        text = spelling.text[codes][shown].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(self.n_a + self.n_b)].tolist()
        out = []
        for start, end in zip([0, *ends], ends):
            # The last group is not followed by another.
            out.append(hashlib.sha256(text[start : end - 1]).hexdigest() if end > start else "")
        return out


def parts(batches: Iterator[pa.RecordBatch], room: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose ids take so many bytes together, or of one row."""
    for batch in batches:
        start = size = 0
        lengths = [len(x) for x in batch.column("a").to_pylist()]
        for i, n in enumerate(lengths):
            if i > start and size + n > room:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def added_up(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[starts], np.add.reduceat(n, starts) if len(starts) else n


def partial_counts(tokens: DataFrame, files: Vocabularies) -> DataFrame:
    """(pair, n): the links of all documents, added up within parts of a task."""
    room = 2_000_000

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = Spelling(files)
        pairs = n = np.zeros(0, np.int64)
        for batch in parts(batches):
            found = np.sort(spelling.line_up(batch).pairs)
            starts = np.flatnonzero(np.diff(found, prepend=-1))
            more = np.diff(starts, append=len(found))
            pairs, n = added_up(np.concatenate([pairs, found[starts]]), np.concatenate([n, more]))
            if len(pairs) > room:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
                pairs = n = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    return tokens.select("a", "b").mapInArrow(collect, "pair bigint, n bigint")


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of the keys, another for each seed."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BLOCK_SEED = 1000


def levels_of(keys: np.ndarray, load: float = 1.5) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(level sizes in bits, bits, keys in slot order) of a minimal perfect hash of distinct keys.

    Level by level, each remaining key falls on a bit; bits hit once are set and their keys done, the others go on
    to the next level.  A key's slot is the number of set bits before its own.
    """
    sizes, bits, order = [], [], []
    while len(keys):
        size = int(-(-max(64, int(load * len(keys))) // 64) * 64)
        at = (mixed(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
        once = np.bincount(at, minlength=size) == 1
        alone = once[at]
        sizes.append(size)
        bits.append(np.packbits(once, bitorder="little"))
        order.append(keys[alone][np.argsort(at[alone])])
        keys = keys[~alone]
    empty = np.zeros(0, np.int64)
    return sizes, np.concatenate(bits or [empty.astype(np.uint8)]), np.concatenate(order or [empty])


class PerfectHash:
    """The slots of all blocks' keys, one block after the other."""

    def __init__(self, blocks: list[tuple[list[int], bytes]]):
        depth = max((len(sizes) for sizes, _ in blocks), default=0)
        self.blocks = len(blocks)
        self.sizes = np.zeros((depth, len(blocks)), np.int64)
        self.begin = np.zeros((depth, len(blocks)), np.int64)
        place = 0
        for k, (sizes, _) in enumerate(blocks):
            for level, size in enumerate(sizes):
                self.sizes[level, k], self.begin[level, k] = size, place
                place += size
        self.bits = np.frombuffer(b"".join(bits for _, bits in blocks), "<u8")
        set_bits = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(set_bits) - set_bits
        self.n_keys = int(set_bits.sum())

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; a key that was not hashed gets any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        if not self.blocks:
            return out
        block = (mixed(keys, BLOCK_SEED) % np.uint64(self.blocks)).astype(np.int64)
        for level in range(len(self.sizes)):
            size = self.sizes[level, block[rest]]
            rest, size = rest[size > 0], size[size > 0]
            if not len(rest):
                break
            at = self.begin[level, block[rest]] + (mixed(keys[rest], level) % size.astype(np.uint64)).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[rest[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(below[hit])
            rest = rest[~hit]
        return out


def perfect_hash(pairs: DataFrame, n_pairs: int, block_size: int) -> tuple[PerfectHash, DataFrame]:
    """The hash of distinct pairs, and (block, keys in slot order) as a table."""
    blocks = max(1, -(-n_pairs // block_size))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("pair").to_numpy()
            block = (mixed(keys, BLOCK_SEED) % np.uint64(blocks)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(block), batch.column("pair")], ["block", "pair"])

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        sizes, bits, order = levels_of(frame["pair"].to_numpy())
        row = {"block": frame["block"].iloc[0], "sizes": sizes, "bits": bits.tobytes(), "keys": order.astype("<i8").tobytes()}
        return pd.DataFrame([row])

    dealt = pairs.mapInArrow(deal, "block int, pair bigint").groupBy("block")
    built = staged(dealt.applyInPandas(build, "block int, sizes array<bigint>, bits binary, keys binary"), "hash")
    # Three bits and a half for each pair.
    rows = {row["block"]: row for row in built.select("block", "sizes", "bits").toLocalIterator()}
    found = [(rows[k]["sizes"], bytes(rows[k]["bits"])) if k in rows else ([], b"") for k in range(blocks)]
    return PerfectHash(found), built.select("block", "keys")


def vectors(partial: DataFrame, shipped: Broadcast) -> DataFrame:
    """(slice, counts): the dense count vector of all partial counts, in slices, added up in a tree.

    Only slices that a task has counts in leave it.
    """

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, node = opened(shipped), TaskContext.get().partitionId()
        size = -(-hashed.n_keys // SLICE) * SLICE
        vector = np.zeros(size, np.int64)
        for batch in batches:
            np.add.at(vector, hashed.slots(batch.column("pair").to_numpy()), batch.column("n").to_numpy())
        table = vector.reshape(-1, SLICE)
        used = np.flatnonzero(table.any(axis=1))
        for start in range(0, len(used), 64):
            some = used[start : start + 64]
            counts = [row.astype("<i8").tobytes() for row in table[some]]
            columns = [pa.array(some.astype(np.int32)), pa.array(np.full(len(some), node, np.int32)), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["slice", "node", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SLICE, np.int64)
        for counts in frame["counts"]:
            total += np.frombuffer(counts, "<i8")
        return pd.DataFrame([{"slice": frame["slice"].iloc[0], "node": frame["node"].iloc[0], "counts": total.tobytes()}])

    schema = "slice int, node int, counts binary"
    nodes = (partial.select(F.spark_partition_id().alias("node")).agg(F.max("node")).first()[0] or 0) + 1
    tree = partial.mapInArrow(slices, schema)
    while True:
        nodes = -(-nodes // FAN_IN)
        parent = (F.col("node") / FAN_IN).cast("int").alias("node")
        tree = tree.select("slice", parent, "counts").groupBy("slice", "node").applyInPandas(add, schema)
        if nodes == 1:
            return tree.select("slice", "counts")


@dataclass
class Counts:
    """Every pair's count by its slot, and the largest count of any pair with a given second id."""

    hashed: PerfectHash
    keys: np.ndarray
    counts: np.ndarray
    best: np.ndarray

    def look_up(self, pairs: np.ndarray) -> np.ndarray:
        """The count of each pair, 0 where the slot's key is another."""
        slots = self.hashed.slots(pairs)
        if not len(self.keys):
            return np.zeros(len(pairs), np.int64)
        return np.where((slots >= 0) & (self.keys[slots] == pairs), self.counts[slots], 0)

    def of(self, pairs: np.ndarray) -> tuple[int, int]:
        """(links that are the best of their second id, sum of the links' counts)."""
        n = self.look_up(pairs)
        return int((n == self.best[pairs & LOW]).sum()), int(n.sum())


def dense_counts(partial: DataFrame, n_pairs: int, block_size: int) -> Counts:
    spark = partial.sparkSession
    hashed, keys = perfect_hash(partial.select("pair").distinct(), n_pairs, block_size)
    summed = staged(vectors(partial, ship(spark, hashed)), "vectors")
    # Eight bytes a pair each, of at most ``broadcast_pairs`` pairs.
    in_order = {row["block"]: row["keys"] for row in keys.toLocalIterator()}
    stored = np.concatenate([np.frombuffer(in_order[k], "<i8") for k in sorted(in_order)] or [np.zeros(0, np.int64)])
    counts = np.zeros(-(-hashed.n_keys // SLICE) * SLICE, np.int64)
    for row in summed.toLocalIterator():
        counts[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["counts"], "<i8")
    best = np.zeros(LOW + 1, np.int64)
    np.maximum.at(best, stored & LOW, counts[: len(stored)])
    return Counts(hashed, stored, counts[: len(stored)], best)


def pair_counts(partial: DataFrame) -> DataFrame:
    """(a_id, b_id, n): the alignment table itself."""
    summed = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    return summed.select(F.shiftright("pair", ID_BITS).alias("a_id"), F.col("pair").bitwiseAND(LOW).alias("b_id"), "n")


def aligned(tokens: DataFrame, files: Vocabularies, counts: Counts | None) -> DataFrame:
    """The documents' rows with a ``key`` that equal texts share; without ``counts`` the columns that need them are null."""
    shipped = ship(tokens.sparkSession, counts)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, spelling = opened(shipped), Spelling(files)
        for batch in parts(batches):
            found = spelling.line_up(batch)
            columns = [found.n_a, found.n_b, found.per_row(found.row_of_group), found.per_row(found.row_of_link)]
            if known:
                n = known.look_up(found.pairs)
                best = n == known.best[found.pairs & LOW]
                columns += [found.per_row(found.row_of_link, best), found.per_row(found.row_of_link, n)]
                columns = [pa.array(c) for c in columns]
            else:
                columns = [pa.array(c) for c in columns] + [pa.nulls(batch.num_rows, pa.int64())] * 2
            columns = [batch.column("doc_id"), *columns, pa.array(found.groups(), pa.string()), batch.column("key")]
            yield pa.RecordBatch.from_arrays(columns, [*NAMES, "key"])

    return tokens.select("doc_id", "key", "a", "b").mapInArrow(align, COLUMNS + ", groups string, key string")


def aligned_by_join(tokens: DataFrame, files: Vocabularies, partial: DataFrame) -> DataFrame:
    """As ``aligned``, with a table of counts of any size.

    Every row sends its distinct pairs, and one mark for itself: equal texts share a key, and their sums are divided
    by the number of marks.
    """
    table = staged(partial.groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    b_id = F.col("pair").bitwiseAND(LOW).alias("b_id")
    best = table.groupBy(b_id).agg(F.max("n").alias("best"))
    rated = table.withColumn("b_id", F.col("pair").bitwiseAND(LOW)).join(best, "b_id")
    rated = rated.select("pair", "n", (F.col("n") == F.col("best")).cast("bigint").alias("is_best"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = Spelling(files)
        for batch in parts(batches):
            found = spelling.line_up(batch)
            keys, row_of = batch.column("key").to_pylist(), found.row_of_link
            marks = np.flatnonzero(found.n_a)
            order = np.lexsort((found.pairs, row_of))
            rows, pairs = row_of[order], found.pairs[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (pairs[1:] != pairs[:-1])
            starts = np.flatnonzero(new)
            times = np.concatenate([np.diff(starts, append=len(rows)), np.ones(len(marks), np.int64)])
            rows = np.concatenate([rows[starts], marks])
            columns = [pa.array([keys[r] for r in rows], pa.string()), pa.array(np.concatenate([pairs[starts], np.full(len(marks), -1)]))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(times)], ["key", "pair", "times"])

    found = tokens.select("key", "a", "b").mapInArrow(collect, "key string, pair bigint, times bigint")
    once = found.groupBy("key", "pair").agg(F.sum("times").alias("times"))
    sums = once.join(rated, "pair", "left").groupBy("key").agg(
        F.expr("sum(times * is_best) div sum(if(pair = -1, times, 0))").alias("best_links"),
        F.expr("sum(times * n) div sum(if(pair = -1, times, 0))").alias("sum_of_counts"),
    )
    return aligned(tokens, files, None).join(sums, "key", "left").select(
        *NAMES[:5],
        F.coalesce("best_links", F.lit(0)).cast("bigint").alias("n_best"),
        F.coalesce("sum_of_counts", F.lit(0)).cast("bigint").alias("count_sum"),
        "groups",
    )


def align(
    docs: DataFrame, files: Vocabularies, broadcast_pairs: int = 16_000_000, block_size: int = 65_536
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and a hash of its groups.

    Needs ``doc_id`` and ``text``; other columns are not read.  Texts that are null or empty, or that a vocabulary
    does not spell byte for byte, have zeros and an empty hash.  Repeated rows are documents of their own: each
    counts.  An empty table gives no rows.
    """
    tokens = staged(tokenised(docs, files), "tokens")
    partial = staged(partial_counts(tokens, files), "partial")
    n_pairs = partial.select("pair").distinct().count()
    if n_pairs > broadcast_pairs:
        return aligned_by_join(tokens, files, partial)
    return aligned(tokens, files, dense_counts(partial, n_pairs, block_size)).drop("key")
