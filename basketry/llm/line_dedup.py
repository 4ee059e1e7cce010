"""Lines that repeat across documents, dropped from all documents but one.

Every line of some length is hashed to 128 bits where its text is read.  The hashes
are range-partitioned and sorted by hash, then by document (largest first) and
place, so that each partition can be streamed: the first document of a hash is the
one that keeps its lines, and once enough different documents have passed, all
later lines of that hash are dropped.  Texts do not travel: what comes back is a
compressed bitmap of lines for each document that loses any.

The range boundaries fall inside a frequent line too, so no task holds all of a
line's places.  What a partition can't decide alone, the hashes at its two ends and
those with too many undecided places to remember, it passes on as undecided, with
one summary row per hash; summaries of neighbouring partitions are added up and
decide the rest by a join.

Documents are told apart by ``doc_id``; a null id is one document, smaller than
all others (and so is the id -2**63).  Rows equal in id and text share one bitmap.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import utf8
from basketry.session import staged

NO_ID = -(1 << 63)
DROPPED, UNDECIDED, SUMMARY = 0, 1, 2
PLACE = ["h1", "h2", "doc", "row", "line"]
PLACES = "h1 bigint, h2 bigint, doc bigint, row bigint, line int"
FOUND = PLACES + ", kind int, part int, n_docs bigint, least_doc bigint"
FOUND_NAMES = [*PLACE, "kind", "part", "n_docs", "least_doc"]


@dataclass(frozen=True)
class Settings:
    least_chars: int = 40
    least_docs: int = 5


def line_key(line: bytes) -> bytes:
    """Without the white space around it and with A-Z lower-cased; bytes know no other blanks and letters."""
    return line.strip().lower()


def keyed(docs: DataFrame) -> DataFrame:
    """The id as given, the document's number, a hash that tells apart texts of one document, and the text."""
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("row"), "text"
    )


def hashed_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """The place of every line whose key has so many code points.

    Rows equal in id and text are taken once a batch, so copies of a row are few before they are shuffled.
    """

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes, lines, docs_, rows, seen = [], [], [], [], [], set()
            for doc, row, text in zip(
                batch.column("doc").to_pylist(), batch.column("row").to_pylist(), utf8(batch, "text"), strict=True
            ):
                if (doc, row) in seen or len(text) < least_chars:
                    continue
                seen.add((doc, row))
                before = len(lines)
                for place, line in enumerate(text.split(b"\n")):
                    if len(line) < least_chars:
                        continue
                    key = line_key(line)
                    if (len(key) if key.isascii() else len(key.decode("utf-8", "replace"))) >= least_chars:
                        hashes.append(xxhash.xxh3_128_digest(key))
                        lines.append(place)
                docs_.append(doc)
                rows.append(row)
                sizes.append(len(lines) - before)
            pairs = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            columns = [pairs[:, 0], pairs[:, 1], np.repeat(np.array(docs_, np.int64), sizes)]
            columns += [np.repeat(np.array(rows, np.int64), sizes), np.array(lines, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], PLACE)

    return keyed(docs).drop("doc_id").mapInArrow(collect, PLACES)


class Group:
    """What is known of the hash that the stream is at; ``unsure`` if it may have begun in an earlier partition."""

    ROOM = 200_000

    def __init__(self, first: np.ndarray, unsure: bool):
        self.h1, self.h2, self.largest = first[:3].tolist()
        self.unsure, self.open = unsure, unsure
        self.n_docs, self.least = 0, None
        self.held: list[np.ndarray] = []

    def feed(self, rows: np.ndarray, enough: int) -> Iterator[tuple[np.ndarray, int]]:
        """(places, kind) that can be passed on after these rows; columns are h1, h2, doc, row, line."""
        self.n_docs += int(np.count_nonzero(np.diff(rows[:, 2]))) + (rows[0, 2] != self.least)
        self.least = int(rows[-1, 2])
        later = rows if self.unsure else rows[rows[:, 2] != self.largest]
        if not len(later):
            return
        if self.open:
            yield later, UNDECIDED
            return
        self.held.append(later)
        if self.n_docs >= enough:
            yield self.release(), DROPPED
        elif sum(map(len, self.held)) > self.ROOM:
            self.open = True
            yield self.release(), UNDECIDED

    def release(self) -> np.ndarray:
        held, self.held = np.concatenate(self.held), []
        return held

    def end(self, of_partition: bool) -> Iterator[tuple[np.ndarray, int]]:
        """What is left once the hash, or the partition, has ended."""
        if of_partition and self.held:
            yield self.release(), UNDECIDED
        if of_partition or self.open:
            yield np.array([[self.h1, self.h2, self.largest, self.n_docs, self.least]], np.int64), SUMMARY


def decided(places: DataFrame, least_docs: int) -> DataFrame:
    """Dropped and undecided places, and summaries, from one pass over the sorted places."""

    def out(rows: np.ndarray, kind: int, part: int) -> pa.RecordBatch:
        n, summary = len(rows), kind == SUMMARY
        rest = np.zeros(n, np.int64)
        columns = [rows[:, 0], rows[:, 1], rows[:, 2], rest if summary else rows[:, 3]]
        columns += [(rest if summary else rows[:, 4]).astype(np.int32), np.full(n, kind, np.int32), np.full(n, part, np.int32)]
        columns += [rows[:, 3] if summary else rest, rows[:, 4] if summary else rest]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], FOUND_NAMES)

    def whole_groups(rows: np.ndarray, new: np.ndarray) -> np.ndarray:
        """The dropped among groups that begin and end in these rows."""
        group = np.cumsum(new) - 1
        new_doc = new.copy()
        new_doc[1:] |= rows[1:, 2] != rows[:-1, 2]
        n_docs = np.bincount(group, new_doc)
        largest = rows[new, 2][group]
        return rows[(n_docs[group] >= least_docs) & (rows[:, 2] != largest)]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            starts = np.flatnonzero(new)
            first, last = rows[: starts[1] if len(starts) > 1 else len(rows)], rows[starts[-1] :]
            if group is None or (group.h1, group.h2) != tuple(first[0, :2].tolist()):
                if group:
                    for found in group.end(False):
                        yield out(*found, part)
                group = Group(first[0], unsure=group is None)
            for found in group.feed(first, least_docs):
                yield out(*found, part)
            if len(starts) > 1:
                for found in group.end(False):
                    yield out(*found, part)
                middle = slice(starts[1], starts[-1])
                if starts[1] < starts[-1]:
                    yield out(whole_groups(rows[middle], new[middle]), DROPPED, part)
                group = Group(last[0], unsure=False)
                for found in group.feed(last, least_docs):
                    yield out(*found, part)
        if group:
            for found in group.end(True):
                yield out(*found, part)

    order = ["h1", "h2", F.desc("doc"), "row", "line"]
    return places.repartitionByRange(*order).sortWithinPartitions(*order).select(PLACE).mapInArrow(stream, FOUND)


def verdicts(summaries: DataFrame, least_docs: int) -> DataFrame:
    """(h1, h2, largest) of undecided hashes that enough documents hold.

    A document that lies on a boundary is counted on both of its sides.  There are at most two summaries a
    partition, and those of hashes that overran a partition's memory.
    """
    in_order = Window.partitionBy("h1", "h2").orderBy("part")
    again = (F.lag("least_doc").over(in_order) == F.col("doc")).cast("bigint")
    counted = summaries.withColumn("again", F.coalesce(again, F.lit(0))).groupBy("h1", "h2")
    counted = counted.agg(F.sum(F.col("n_docs") - F.col("again")).alias("n_docs"), F.max("doc").alias("largest"))
    return counted.filter(F.col("n_docs") >= least_docs).drop("n_docs")


def dropped_lines(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc, row, line) of every line that goes."""
    places = staged(hashed_lines(docs, settings.least_chars), "lines")
    found = staged(decided(places, settings.least_docs), "found")
    # Two hashes a partition at most, and one for each time that a partition's memory was overrun.
    sure_of = F.broadcast(verdicts(found.filter(F.col("kind") == SUMMARY), settings.least_docs))
    rest = found.filter(F.col("kind") == UNDECIDED).join(sure_of, ["h1", "h2"])
    columns = ["doc", "row", "line"]
    sure = found.filter(F.col("kind") == DROPPED).select(columns)
    return sure.union(rest.filter(F.col("doc") != F.col("largest")).select(columns))


def packed(lines: list[int]) -> bytes:
    keep = np.ones(max(lines) // 8 * 8 + 8, bool)
    keep[lines] = False
    return zlib.compress(np.packbits(keep).tobytes())


def keep_bitmaps(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc, row, keep) for each document that loses lines.

    ``keep`` is a zlib-compressed bitmap, a bit for each line from the first on, set if the line stays, up to the
    byte of the last that goes; all lines beyond it stay.  A document's list of lines is no longer than its text.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(map(packed, batch.column("lines").to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), keep], ["doc", "row", "keep"])

    lines = dropped_lines(docs, settings).groupBy("doc", "row").agg(F.collect_set("line").alias("lines"))
    return lines.mapInArrow(pack, "doc bigint, row bigint, keep binary")


def deduplicated(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped and the text that is left.

    Needs ``doc_id`` and ``text``; other columns are not read.  A null or empty text is one empty line.  An empty
    table gives no rows.  Repeated rows are dealt with as one document and all returned.
    """
    bitmaps = staged(keep_bitmaps(docs, settings), "bitmaps")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, texts = [], [], []
            for text, keep in zip(utf8(batch, "text"), batch.column("keep").to_pylist(), strict=True):
                if keep is None:
                    n_lines.append(text.count(b"\n") + 1)
                    n_dropped.append(0)
                    texts.append(text)
                    continue
                lines = text.split(b"\n")
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
                gone = set(np.flatnonzero(bits == 0).tolist())
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
                texts.append(b"\n".join(line for i, line in enumerate(lines) if i not in gone))
            columns = [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "text"])

    joined = keyed(docs).join(bitmaps, ["doc", "row"], "left").select("doc_id", "text", "keep")
    return joined.mapInArrow(apply, "doc_id bigint, n_lines bigint, n_dropped bigint, text string")
