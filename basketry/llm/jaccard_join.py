"""Exact n-gram Jaccard join by prefixes under several global token orders.

Two sets that link share a token among their first few under *any* order of all
tokens.  The steps:

1.  Every order puts rare tokens first, by a count sketch of its own over all
    texts, and breaks ties by a hash of its own.  Documents with equal sets become one
    node, so exact copies cost nothing further.
2.  Nodes meet in buckets, one for each token of a prefix that is longer by
    ``share`` - 1 tokens than sharing one would need, so linked nodes share at
    least ``share`` of them.  Buckets of up to ``small`` nodes give pairs of
    fitting size, and pairs that share enough tokens are candidates; a larger
    bucket's nodes all stay candidates if they meet others in enough buckets.
3.  The candidates' sets are read once.  A candidate must also share prefix
    tokens under every other order, which is asked of nodes before their sets
    are shuffled and of pairs before they are compared.
4.  Candidate pairs of small buckets are compared node by node.  In large ones
    each node is first compared inside one bucket per order, which joins nearly
    all of a group of near copies; buckets whose nodes of fitting size are not
    all one component by then are compared in full, in pairs of blocks of bounded
    size, so no link is lost.  Only links that join two components are written,
    never all pairs of a group.

Components are found by joins over written tables; nothing is collected.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import SomeHashes, WordHashes, opened, ship, utf8
from basketry.session import small_batches, staged, staged_texts

MIX_A, MIX_B, MIX_C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
CLASS_BITS = np.uint64(56)
BITMAP_BITS = 2**23


@dataclass(frozen=True)
class Settings:
    words: int = 3
    percent: int = 90  # link when 100 * intersection >= percent * union
    sketch_bits: tuple[int, ...] = (22, 19, 19)  # for each order
    share: int = 3
    small: int = 16
    block: int = 1024

    @property
    def orders(self) -> int:
        return len(self.sketch_bits)


def mixed(hashes: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (hashes ^ np.uint64(seed * 0x632BE59BD9B4E019 & (2**64 - 1))) * MIX_A
    x = (x ^ (x >> np.uint64(29))) * MIX_B
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, words: int, memory: WordHashes) -> np.ndarray:
    """Hash of every window of so many words (A-Z lower-cased), in text order; a shorter text is one window."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(memory.__getitem__, found), np.uint64, len(found))
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], np.uint64)
    out = np.zeros(len(found) - words + 1, np.uint64)
    for k in range(words):
        out = (out ^ hashes[k : k + len(out)]) * MIX_A + MIX_C
        out ^= out >> np.uint64(31)
    return out


def prefix(tokens: np.ndarray, classes: list[np.ndarray], order: int, percent: int, share: int = 1) -> np.ndarray:
    """The first tokens of a set under an order: rarer class first, then the order's own hash.

    Long enough to hold ``share`` tokens in common with any linked set, or all
    that such a set must have in common if that is less.
    """
    rank = classes[order][cell_of(tokens, order, len(classes[order]).bit_length() - 1)]
    keys = (rank.astype(np.uint64) << CLASS_BITS) | (mixed(tokens, order) >> np.uint64(8))
    p = len(keys) - (percent * len(keys) + 99) // 100 + share
    return (np.partition(keys, p - 1)[:p] if p < len(keys) else keys).view(np.int64)


def cell_of(tokens: np.ndarray, order: int, bits: int) -> np.ndarray:
    return (mixed(tokens, order + 100) >> np.uint64(64 - bits)).astype(np.int64)


def token_classes(docs: DataFrame, settings: Settings) -> list[np.ndarray]:
    """Per order, a class (0 to 255, rare to frequent) for each cell of a sketch of all texts' shingles.

    A cell's class is its rank by load.  Loads of cells without frequent
    shingles differ little, so a shingle is put behind the prefixes once its
    count exceeds a few times the square root of the mean load.  Tasks send their
    counts in blocks of cells, one byte each (a heuristic's counts may stop at
    255 a task; every order is valid for the join); blocks are added up as they
    arrive.
    """
    bits = settings.sketch_bits
    width = 1 << min(12, *bits)
    ends = np.cumsum([0] + [1 << b for b in bits])
    cells = int(ends[-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, total = SomeHashes(), np.zeros(cells, np.int32)
        held: list[np.ndarray] = []
        size = 0

        def add() -> None:
            tokens = np.concatenate(held) if held else np.zeros(0, np.uint64)
            for k in range(settings.orders):
                total[ends[k] : ends[k + 1]] += np.bincount(cell_of(tokens, k, bits[k]), minlength=1 << bits[k])
            held.clear()

        for batch in batches:
            for text in utf8(batch, "text"):
                held.append(shingles(text, settings.words, memory))
                size += len(held[-1])
                if size > 2_000_000:
                    add()
                    size = 0
        add()
        blocks = np.minimum(total, 255).astype(np.uint8).reshape(-1, width)
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array([blocks[i].tobytes() for i in used], pa.binary())], ["block", "counts"]
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums.setdefault(block, np.zeros(width, np.int64))
                sums[block] += np.frombuffer(counts, np.uint8)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums), pa.int64()),
                pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in sums.values()], pa.binary()),
            ],
            ["block", "counts"],
        )

    schema = "block bigint, counts binary"
    found = docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(merge, schema)
    loads = np.zeros((cells // width, width), np.int32)
    with small_batches(docs.sparkSession):
        for row in found.toLocalIterator():  # one row a block
            loads[row["block"]] = np.frombuffer(row["counts"], np.int32)
    classes = []
    for k in range(settings.orders):
        of_order = loads.reshape(-1)[ends[k] : ends[k + 1]]
        steps = np.sort(of_order)[len(of_order) // 256 :: len(of_order) // 256][:255]
        rank = np.zeros(len(of_order), np.uint8)
        for begin in range(0, len(rank), 2**18):
            rank[begin : begin + 2**18] = np.searchsorted(steps, of_order[begin : begin + 2**18], "right")
        classes.append(rank)
    return classes


def nodes_of(docs: DataFrame, classes, settings: Settings) -> DataFrame:
    """doc_id, node (hash of the set, null if empty), n, and the set's prefix under the first order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, table = SomeHashes(), opened(classes)
        for batch in batches:
            nodes, sizes, prefixes = [], [], []
            for text in utf8(batch, "text"):
                tokens = np.unique(shingles(text, settings.words, memory))
                sizes.append(len(tokens))
                if len(tokens):
                    nodes.append(xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63)
                    prefixes.append(prefix(tokens, table, 0, settings.percent, settings.share))
                else:
                    nodes.append(None)
                    prefixes.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(nodes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                ],
                ["doc_id", "node", "n", "prefix"],
            )

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return chosen.mapInArrow(read, "doc_id bigint, node bigint, n bigint, prefix array<bigint>")


def near_sizes(settings: Settings):
    """Window over a bucket's nodes whose sizes allow a link, sizes being compared by logarithm in millionths."""
    reach = math.ceil(-math.log(settings.percent / 100) * 1e6) + 1
    return Window.partitionBy("token").orderBy(F.floor(F.ln("n") * 1e6)).rangeBetween(-reach, reach)


def postings(nodes: DataFrame) -> DataFrame:
    """(token, node, n) once for every token of a node's prefix, dealt out by token."""
    return nodes.select(F.explode("prefix").alias("token"), "node", "n").repartition("token").distinct()


def meeting(posted: DataFrame, settings: Settings) -> DataFrame:
    """Adds the size of the token's bucket, for nodes that meet another one of fitting size there."""
    posted = posted.select("token", "node", "n").withColumns({
        "fitting": F.count("*").over(near_sizes(settings)),
        "size": F.count("*").over(Window.partitionBy("token")),
    })
    return posted.filter("fitting > 1").drop("fitting")


def meeting_often(posted: DataFrame, settings: Settings) -> DataFrame:
    """Postings of the nodes that meet others in as many buckets as linked nodes must."""
    least = F.least(F.lit(settings.share), F.expr(f"({settings.percent} * n + 99) div 100"))
    often = posted.groupBy("node", "n").count().filter(F.col("count") >= least).select("node")
    return meeting(posted.join(often, "node", "left_semi"), settings)


def small_bucket_pairs(posted: DataFrame, settings: Settings) -> DataFrame:
    """(a, b): nodes of fitting size that share as many tokens as linked nodes must, all counted in small buckets.

    Nodes that also meet in a large bucket are compared there.
    """
    percent = settings.percent
    rows = posted.filter(F.col("size") <= settings.small)
    one, other = rows.alias("x"), rows.alias("y")
    fitting = F.expr(f"x.token = y.token and x.node < y.node and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
    met = one.join(other, fitting).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    met = met.agg(F.count("*").alias("shared"), F.first(F.least("x.n", "y.n")).alias("n"))
    return met.filter(F.expr(f"shared >= least({settings.share}, ({percent} * n + 99) div 100)")).select("a", "b")


def sets_of(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """(node, n, tokens) for the wanted (doc_id, node).

    A bitmap of fixed size over the wanted ids keeps nearly all other texts from
    being shuffled; what it lets through wrongly, the join removes.
    """
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS))
    maps = wanted.groupBy(F.bitmap_bucket_number(spot + 1).alias("bucket")).agg(  # both count from 1
        F.bitmap_construct_agg(F.bitmap_bit_position(spot + 1)).alias("bits")
    )
    bits = np.zeros(BITMAP_BITS // 8 + 8192, np.uint8)
    for row in maps.collect():  # at most BITMAP_BITS / 32768 rows
        begin = (row["bucket"] - 1) * 4096
        bits[begin : begin + 4096] = np.frombuffer(row["bits"], np.uint8)
    shipped = ship(docs.sparkSession, bits)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, allowed = SomeHashes(), opened(shipped)
        for batch in batches:
            at = batch.column("spot").to_numpy()
            chosen = np.flatnonzero(allowed[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            batch = batch.take(pa.array(chosen))
            sets = [np.unique(shingles(t, settings.words, memory)) for t in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "node", "n", "tokens"],
            )

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # A null id is as good a place in the bitmap as any other.
    found = chosen.withColumn("spot", spot).mapInArrow(read, "doc_id bigint, node bigint, n bigint, tokens array<bigint>")
    same = wanted.select(F.col("doc_id").alias("of"), F.col("node").alias("stands_for"))
    same_document = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("node") == F.col("stands_for"))
    # One row per node: repeated rows of a document hold the same set.
    return found.join(same, same_document, "left_semi").dropDuplicates(["node"]).drop("doc_id")


def with_prefix(sets: DataFrame, classes, order: int, settings: Settings) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = opened(classes)
        for batch in batches:
            lists = batch.column("tokens")
            found = [
                prefix(x.values.to_numpy(zero_copy_only=False).view(np.uint64), table, order, settings.percent)
                for x in lists
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("n"), pa.array(found, pa.list_(pa.int64()))],
                ["node", "n", "prefix"],
            )

    return sets.select("node", "n", "tokens").mapInArrow(read, "node bigint, n bigint, prefix array<bigint>")


def joining_links(group: pd.DataFrame, percent: int, prefixes) -> pd.DataFrame:
    """Links of a group's sets that join two components, found with an index of the group's tokens.

    ``prefixes`` gives a set's prefix under each further order; a pair without a
    common token under one of them is not compared.
    """
    group = group.drop_duplicates("node").sort_values("node")
    sizes, names = group["n"].to_numpy(), group["node"].to_numpy()
    root = list(np.unique(group["component"].to_numpy(), return_inverse=True)[1])
    parent = list(range(len(names)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = {}
    for i, r in enumerate(root):
        parent[i] = first.setdefault(r, i)
    lists = [np.asarray(x, np.int64) for x in group["tokens"]]
    sets = TokenIndex(lists)
    filters = [TokenIndex(list(x)) for x in zip(*[prefixes(tokens.view(np.uint64)) for tokens in lists], strict=True)]
    links = []
    for i in range(len(names) - 1):
        fits = 100 * np.minimum(sizes[i], sizes) >= percent * np.maximum(sizes[i], sizes)
        fits[: i + 1] = False
        for index in filters:
            fits &= index.shared_with(i) > 0
        if not fits.any():
            continue
        shared = sets.shared_with(i)
        for j in np.flatnonzero(fits & (100 * shared >= percent * (sizes[i] + sizes - shared))):
            a, b = top(i), top(int(j))
            if a != b:
                parent[a] = b
                links.append((names[i], names[j]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


class TokenIndex:
    """Which of a group's sets hold a token."""

    def __init__(self, lists: list[np.ndarray]):
        sizes = np.array([len(x) for x in lists])
        self.tokens = np.unique(np.concatenate(lists), return_inverse=True)[1]
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(self.tokens))])
        self.holders = np.repeat(np.arange(len(lists)), sizes)[np.argsort(self.tokens, kind="stable")]
        self.sets = len(lists)

    def shared_with(self, i: int) -> np.ndarray:
        """Number of tokens that each set has in common with set ``i``."""
        mine = self.tokens[self.at[i] : self.at[i + 1]]
        begin, end = self.begin[mine], self.begin[mine + 1]
        common = end - begin > 1
        if not common.any():
            return np.zeros(self.sets, np.int64)
        found = [self.holders[b:e] for b, e in zip(begin[common], end[common], strict=True)]
        return np.bincount(np.concatenate(found), minlength=self.sets)


def compare(groups: DataFrame, sets: DataFrame, classes, settings: Settings) -> DataFrame:
    """Links (a, b) among the nodes of each group; ``groups`` has group, node and component."""

    table: list = []  # opened once in a task, for all its groups

    def find(group: pd.DataFrame) -> pd.DataFrame:
        if not table:
            table.append(opened(classes))

        def prefixes(tokens: np.ndarray) -> list[np.ndarray]:
            return [prefix(tokens, table[0], k, settings.percent) for k in range(1, settings.orders)]

        return joining_links(group, settings.percent, prefixes)

    rows = groups.join(sets, "node").select("group", "node", "n", "component", "tokens")
    return rows.groupBy("group").applyInPandas(find, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link: the least node that it reaches."""
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = staged(both, "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    labels = labels.select("node", F.least("node", "least").alias("component"))
    while True:
        of_neighbour = labels.select(F.col("node").alias("b"), F.col("component").alias("theirs"))
        nearby = both.join(of_neighbour, "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        joined = labels.join(nearby, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "theirs").alias("component")
        )
        # Jump to the label's own label: chains shorten by half each time.
        of_label = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = joined.join(of_label, "component", "left").select(
            "node", "before", F.least("component", F.coalesce("further", "component")).alias("component")
        )
        jumped = staged(jumped, "labels")
        if jumped.filter("component != before").isEmpty():
            return jumped.drop("before")
        labels = jumped.drop("before")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their node's component; a node without links is its own."""
    found = rows.drop("component").join(labels, "node", "left")
    return found.withColumn("component", F.coalesce("component", "node"))


def first_buckets(posted: DataFrame, order: int, block: int) -> DataFrame:
    """One group per node: the first bucket in which it meets others, dealt into groups of about ``block``."""
    chosen = posted.groupBy("node").agg(F.min("token").alias("token"))
    sizes = chosen.groupBy("token").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("node", F.lit(order)), F.ceil(F.col("size") / block))
    group = F.xxhash64(F.lit(order), "token", part)  # groups that fall together by chance do no harm
    return chosen.join(sizes.filter("size > 1"), "token").select(group.alias("group"), "node", F.col("node").alias("component"))


def pair_groups(pairs: DataFrame, survivors: DataFrame) -> DataFrame:
    """One group per node that comes first in a pair, with all its partners; few, as its buckets are small."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(survivors.select(F.col("node").alias(side)), side, "left_semi")
    first = both.select(F.col("a").alias("group"), F.col("a").alias("node")).distinct()
    rows = first.union(both.select(F.col("a").alias("group"), F.col("b").alias("node")))
    return rows.withColumn("component", F.col("node"))


def open_buckets(posted: DataFrame, settings: Settings) -> DataFrame:
    """Groups for buckets where nodes of fitting size belong to different components.

    A large bucket is cut into blocks by component, and each pair of blocks is a
    group, unless both are of one and the same component.
    """
    window = near_sizes(settings)
    unsettled = posted.withColumns({"low": F.min("component").over(window), "high": F.max("component").over(window)})
    unsettled = unsettled.filter("low != high").select("token", "node", "component")
    place = F.row_number().over(Window.partitionBy("token").orderBy("component", "node")) - 1
    dealt = staged(unsettled.withColumn("part", F.floor(place / settings.block)), "buckets")
    parts = dealt.groupBy("token", "part").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    left, right = parts.alias("l"), parts.alias("r")
    pairs = left.join(right, F.expr("l.token = r.token and l.part <= r.part")).filter(
        "least(l.low, r.low) != greatest(l.high, r.high)"
    )
    group = F.xxhash64("l.token", "l.part", "r.part")
    of_part = pairs.select(
        group.alias("group"), F.col("l.token").alias("token"), F.explode(F.array_distinct(F.array("l.part", "r.part"))).alias("part")
    )
    return dealt.join(of_part, ["token", "part"]).select("group", "node", "component")


def linked_components(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles and component_id: the least doc_id reachable over links, its own included.

    Needs ``doc_id`` and ``text``.  A null or empty text has an empty set and
    links with nothing, so its component is itself; a text shorter than a
    shingle is one shingle.  Rows with equal sets are linked (repeated rows give
    repeated results).  Ids may be null: a component of such rows alone has a
    null id.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    classes = ship(spark, token_classes(docs, settings))
    known = staged_texts(nodes_of(docs, classes, settings), "nodes")
    # One document stands for all with the same set.
    stand_in = known.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    posted = staged(meeting(postings(known.filter("node is not null")), settings), "posted")
    posted = staged(meeting_often(posted, settings), "posted")
    pairs = staged(small_bucket_pairs(posted, settings), "pairs")
    large = posted.filter(F.col("size") > settings.small)
    candidates = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(large.select("node")).distinct()
    wanted = staged(stand_in.join(candidates, "node", "left_semi"), "wanted")
    sets = staged_texts(sets_of(docs, wanted, settings), "sets")
    others, left = [], sets
    for order in range(1, settings.orders):
        others.append(staged_texts(meeting(postings(with_prefix(left, classes, order, settings)), settings), "posted"))
        left = left.join(others[-1].select("node").distinct(), "node", "left_semi")
    survivors = others[-1].select("node").distinct() if others else sets.select("node")
    large = staged(large.join(survivors, "node", "left_semi"), "large")
    meets_many = large.select("node").distinct()

    once = first_buckets(large, 0, settings.block)
    for k, more in enumerate(others):
        once = once.union(first_buckets(more.join(meets_many, "node", "left_semi"), k + 1, settings.block))
    links = staged(compare(once, sets, classes, settings), "links")
    still_open = open_buckets(labelled(large, components(links)), settings)
    links = links.union(staged(compare(still_open, sets, classes, settings), "links"))
    links = links.union(staged(compare(pair_groups(pairs, survivors), sets, classes, settings), "links"))

    members = labelled(known.select("doc_id", "n", "node"), components(links))
    names = members.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return members.join(names, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
