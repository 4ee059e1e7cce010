"""Nearest neighbours by multi-index hashing of learned binary codes.

Vectors are normalised and turned by learned rotations (iterative quantisation,
fitted on a bounded sample); the signs are their codes.  Codes split into
substrings of eight bits, and each substring position has an index from value
to codes.  If two codes differ in at most r bits, some substring differs in at
most r / substrings of them, so probing the values within that distance of a
query's substrings finds every code within r.  The codes found are compared in
full, and those within r are ranked by the inner product of the original
vectors.

The radius is learned too: on the sample it holds the wanted share of true
neighbours.  A query that finds fewer than k codes in a block widens its radius
there until it has k or has seen all, so every query gets its k.

Vectors are dealt into blocks of bounded size and each block builds its own index
in a task; blocks of queries visit all blocks of vectors.  Only the k best of a
block leave it.
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import opened, ship
from basketry.session import staged


@dataclass(frozen=True)
class Settings:
    k: int = 20
    rotations: int = 2  # codes have so many bits for each dimension
    sample_rows: int = 20_000
    sample_queries: int = 200
    rounds: int = 25
    recall: float = 0.97  # share of true neighbours that the radius shall hold
    block_rows: int = 16_384
    query_rows: int = 2_048
    seed: int = 7


@dataclass
class Coder:
    mean: np.ndarray
    turn: np.ndarray  # dimensions x bits
    radius: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as bytes, a row a vector."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return np.packbits((unit - self.mean) @ self.turn > 0, axis=1)


def fit(vectors: np.ndarray, settings: Settings) -> Coder:
    """Rotations of the sample's principal axes that bring vectors near the corners of a cube."""
    dimensions = vectors.shape[1]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    mean = unit.mean(0)
    axes = np.linalg.eigh((unit - mean).T @ (unit - mean))[1]
    turned, turns = (unit - mean) @ axes, []
    bits = -(-dimensions * settings.rotations // 8) * 8  # whole substrings; the last rotation is cut
    random = np.random.default_rng(settings.seed)
    while sum(t.shape[1] for t in turns) < bits:
        rotation = np.linalg.qr(random.standard_normal((dimensions, dimensions)))[0]
        for _ in range(settings.rounds):
            left, _, right = np.linalg.svd(np.sign(turned @ rotation).T @ turned)
            rotation = (left @ right).T
        turns.append(axes @ rotation)
    coder = Coder(mean, np.hstack(turns)[:, :bits], bits)
    codes = coder.codes(vectors)
    chosen = random.choice(len(vectors), min(settings.sample_queries, len(vectors)), replace=False)
    near = vectors[chosen] @ vectors.T
    near[np.arange(len(chosen)), chosen] = -np.inf
    k = min(settings.k, len(vectors) - 1)
    if k > 0:
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        apart = np.bitwise_count(codes[chosen][:, None, :] ^ codes[best]).sum(2)
        coder.radius = int(np.quantile(apart, settings.recall, method="higher"))
    return coder


class MultiIndex:
    """The codes of a block under each of their bytes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(column, kind="stable") for column in codes.T]
        self.begin = [np.searchsorted(column[o], np.arange(257)) for column, o in zip(codes.T, self.order, strict=True)]
        values = np.arange(256, dtype=np.uint8)
        self.apart = np.bitwise_count(values[:, None] ^ values[None, :])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of all codes at most ``radius`` bits away."""
        reach = radius // len(code)
        hit = np.zeros(len(self.codes), bool)
        for at, value in enumerate(code):
            for probe in np.flatnonzero(self.apart[value] <= reach):
                hit[self.order[at][self.begin[at][probe] : self.begin[at][probe + 1]]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part, a vector's id taken once or more."""
    numbers = F.col("embedding").cast("array<double>")
    sound = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(numbers, lambda x: x != 0)
    chosen = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), numbers.alias("vector"), (sound & some).alias("sound"))
    return chosen.filter("sound and vec_id is not null").drop("sound")


def matrix(column, dimensions: int) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in column]).reshape(-1, dimensions)


def search(embeddings: DataFrame, is_query, settings: Settings = Settings()) -> DataFrame:
    """The k nearest found of every query row: query_id, rank, vec_id, score (inner product in double precision).

    Needs ``vec_id`` and ``embedding``; ``is_query`` is a condition on
    ``vec_id``.  A query's own id is no candidate.  Vectors that are null, zero
    or hold null or non-finite components, rows without id, and vectors of
    another length than the table's first take no part.  Ties go to the smaller
    id; rows with one id are candidates each.  Fewer candidates than k are all
    returned.  An empty table gives no rows; other columns are not read.
    """
    spark = embeddings.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    sound = staged(usable(embeddings), "vectors")
    first = sound.orderBy("vec_id", "vector").limit(1).collect()
    if not first:
        return spark.createDataFrame([], schema)
    dimensions = len(first[0]["vector"])
    sound = sound.filter(F.size("vector") == dimensions)
    order = F.xxhash64("vec_id", F.lit(settings.seed))
    sample = sound.orderBy(order, "vec_id", "vector").limit(settings.sample_rows).select("vector").toPandas()
    shipped = ship(spark, fit(matrix(sample["vector"], dimensions), settings))  # bounded by sample_rows
    rows = sound.count()
    blocks = max(1, math.ceil(rows / settings.block_rows))
    queries = sound.filter(is_query)
    query_blocks = max(1, math.ceil(queries.count() / settings.query_rows))

    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks))
    part = F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(query_blocks))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    stored = sound.select("vec_id", "vector", block.cast("int").alias("block"), everywhere.alias("part"), F.lit(False).alias("query"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = queries.select("vec_id", "vector", everywhere.alias("block"), part.cast("int").alias("part"), F.lit(True).alias("query"))

    def find(group: pd.DataFrame) -> pd.DataFrame:
        coder, out = opened(shipped), []
        mine, theirs = group[~group["query"]].sort_values("vec_id"), group[group["query"]].sort_values("vec_id")
        if len(mine) and len(theirs):
            names, vectors = mine["vec_id"].to_numpy(), matrix(mine["vector"], dimensions)
            index = MultiIndex(coder.codes(vectors))
            asked_vectors = matrix(theirs["vector"], dimensions)
            for name, vector, code in zip(theirs["vec_id"], asked_vectors, coder.codes(asked_vectors), strict=True):
                radius = coder.radius
                while True:
                    found = index.within(code, radius)
                    found = found[names[found] != name]
                    if len(found) >= settings.k or radius >= 8 * len(code):
                        break
                    radius += len(code)
                # Products are rounded one by one, so that a vector's score does not hang on its block.
                scores = np.array([math.fsum(x) for x in vectors[found] * vector]) if len(found) <= settings.k else None
                if scores is None:
                    rough = vectors[found] @ vector
                    least = np.partition(rough, -settings.k)[-settings.k]
                    found = found[rough >= least - 1e-9 * max(1.0, abs(least))]
                    scores = np.array([math.fsum(x) for x in vectors[found] * vector])
                best = np.lexsort((names[found], -scores))[: settings.k]
                out += [(name, names[found[i]], scores[i]) for i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        )

    found = stored.union(asked).groupBy("block", "part").applyInPandas(find, "query_id bigint, vec_id bigint, score double")
    nearest = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", nearest).filter(F.col("rank") <= settings.k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
