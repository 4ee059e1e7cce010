"""Small helpers that several operators share."""

import pickle
from typing import Any

import pyarrow as pa
import xxhash
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# A word is a run of anything but ASCII white space: bytes.split() with no
# argument splits at exactly these characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered: words repeat, so most lookups are hits."""

    ROOM = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.ROOM:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class SomeHashes(WordHashes):
    """Two tasks of an executor remember words beside the arrays that they sort."""

    ROOM = 400_000


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("bigint")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character left alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ship(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast an object of this subpackage's classes, as bytes that need no import to open."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shipped: Broadcast) -> Any:
    return pickle.loads(shipped.value)
