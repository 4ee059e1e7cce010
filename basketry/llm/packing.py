"""Best-fit packing of tokenised documents into sequences of fixed length.

Every piece of a document demands three things of a sequence: its tokens, one
document slot, and attention cost (the square of its length, as attention stays
inside a document).  Pieces come longest first; each goes to the open sequence
that can hold it under all three capacities and is best by the chosen measure:

* ``norm``: the smallest weighted norm of what would remain free;
* ``dot``: the largest weighted dot product of demand and free room.

If none can hold it, a new sequence opens.  Tokenising happens where the text
is read; only the pieces' few numbers are shuffled, into groups of bounded size
that are packed apart, so a group's last sequences are the only loss.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import utf8
from basketry.session import staged

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


class Encoder:
    """Token ids of a byte-level BPE vocabulary, as little-endian unsigned 32-bit bytes.

    A blank in front of anything but white space always starts a new token, so a
    text is encoded chunk by chunk and chunks that were seen before are looked
    up.  Texts with characters on which the two libraries' patterns might
    differ, or with the end marker's own string, take the vocabulary file's own
    library as they are.
    """

    ROOM = 500_000

    def __init__(self, vocabulary: str):
        import json
        import os
        import re

        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in _byte_letters().items()}
        special = {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {
            bytes(byte_of[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in special
        }
        self.special = [s for s in special if s]
        # Fixed value: the pattern of this vocabulary's pre-tokeniser.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.unusual = re.compile("[^\t\n\r -~¡-ɏ]").search
        self.first: dict[str, bytes] = {}
        self.after_blank: dict[str, bytes] = {}

    def _look_up(self, known: dict[str, bytes], blank: str, chunk: str) -> bytes:
        if len(known) >= self.ROOM:
            known.clear()
        ids = known[chunk] = np.asarray(self.fast.encode_ordinary(blank + chunk), "<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if self.unusual(text) or any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return np.asarray(ids, "<u4").tobytes()
        head, *chunks = text.split(" ")
        if "" in chunks or any(c[0] in "\t\n\r" for c in chunks):
            return np.asarray(self.fast.encode_ordinary(text), "<u4").tobytes()
        parts = [self.first.get(head) or self._look_up(self.first, "", head)] if head else []
        get, known = self.after_blank.get, self.after_blank
        parts += [get(c) or self._look_up(known, " ", c) for c in chunks]
        return b"".join(parts)


def _byte_letters() -> dict[int, str]:
    """The printable letter by which a byte-level vocabulary file writes each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def cut(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of each piece: whole pieces of the capacity, the first one takes the rest."""
    end = len(ids) % capacity or min(capacity, len(ids))
    yield 0, ids[:end]
    for start in range(end, len(ids), capacity):
        yield start, ids[start : start + capacity]


def tokenised_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece of every row of ``docs``: place in the document, length, checksum of its ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), strict=True):
                ids = np.frombuffer(encoder.encode(text.decode("utf-8", "replace")) + end, "<u4")
                for k, (start, piece) in enumerate(cut(ids, capacity)):
                    out.append((doc_id, k, start, len(piece), zlib.crc32(piece.tobytes())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(encode, PIECES)


def best_fit(
    lengths: np.ndarray,
    capacities: tuple[int, int, int],
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    measure: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, in the order given; longest first gives the fewest bins.

    Items must fit an empty bin.  Bins without room for the shortest item that
    is still to come are closed.
    """
    cap = np.array(capacities, float)
    scale = np.array(weights, float)[:, None] / cap[:, None] ** 2
    shortest = np.minimum.accumulate(lengths[::-1])[::-1]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free, name = np.zeros((3, len(lengths))), np.zeros(len(lengths), np.int64)
    n_open = n_bins = 0
    for i, length in enumerate(lengths):
        demand = np.array([length, 1.0, float(length) ** 2])
        if i % 256 == 0 and n_open:
            least = float(shortest[i])
            live = (free[:, :n_open] >= np.array([least, 1.0, least**2])[:, None]).all(0)
            kept = int(live.sum())
            free[:, :kept], name[:kept], n_open = free[:, :n_open][:, live], name[:n_open][live], kept
        room = free[:, :n_open]
        found = np.flatnonzero((room[0] >= length) & (room[1] >= 1) & (room[2] >= demand[2]))
        if len(found):
            room = room[:, found]
            if measure == "norm":
                best = found[np.argmin((scale * (room - demand[:, None]) ** 2).sum(0))]
            else:
                best = found[np.argmax((scale * room * demand[:, None]).sum(0))]
        else:
            best, name[n_open], free[:, n_open] = n_open, n_bins, cap
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[i], offsets[i] = name[best], cap[0] - free[0, best]
        free[:, best] -= demand
    return bins, offsets


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 1024,
    max_documents: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    measure: str = "norm",
    end_id: int = 2,
    group_pieces: int = 16384,
) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    A null or empty text is the end token alone.  Each input row is a document
    of its own, so repeated rows are packed each.  A piece takes its whole ids;
    nothing is dropped or padded.  An empty table gives no rows.  Input columns
    other than ``doc_id`` and ``text`` are not read.  ``max_attention`` must
    leave room for one full piece; by default the document and attention
    capacities follow from the token capacity and never bind.
    """
    capacities = (capacity, max_documents or capacity, max_attention or capacity**2)
    if capacities[2] < capacity**2:
        raise ValueError("max_attention must hold one full piece")
    found = staged(tokenised_pieces(docs, vocabulary, capacity, end_id), "pieces")
    groups = -(-found.filter(F.col("length") < capacity).count() // group_pieces) or 1

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        lengths = rows["length"].to_numpy()
        full = int((lengths == capacity).sum())  # these come first and have a sequence each
        bins, offsets = best_fit(lengths[full:], capacities, weights, measure)
        rows["sequence_id"] = rows["group"].to_numpy() * 2**40 + np.concatenate([np.arange(full), full + bins])
        rows["offset"] = np.concatenate([np.zeros(full, np.int64), offsets])
        return rows.drop(columns="group")

    # A place in the staged table tells apart rows of one id, or of none, and rows that are equal in all.
    key = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    dealt = found.withColumn("group", F.pmod(key, F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(place, PACKED)
