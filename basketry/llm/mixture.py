"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Every source's documents fall into blocks by a hash, which is also the blocks'
random order.  A source's target says how many whole passes over its blocks the
mix takes and how many further blocks; within the last block, documents are
taken in hash order up to the target.  The block quotas of all sources are split
among the output shards by a binary tree: each node gives its left half a draw
without replacement from the node's quotas, source by source, so quotas are met
exactly and shards differ as a random deal of blocks would.  Each shard takes
the next blocks of a source's order, so draws are disjoint; inside a shard,
documents are put in the order of another hash.

All of it is SQL on tables of sources, shards and blocks.  What a document
needs is joined by its source, so texts are never shuffled to find their share.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import n_words
from basketry.session import staged

WEIGHTS = (3, 1, 2)


def sized(docs: DataFrame, seed: int) -> DataFrame:
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(
        doc_id.alias("doc_id"),
        "source",
        n_words(F.col("text")).alias("size"),
        F.xxhash64(doc_id, F.lit(seed)).alias("hash"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, number, docs, source_size, target), a row a source.

    Sources in code point order, null last, take the weights in turn.  Targets
    are proportional to weight and together ``share`` of all sizes, but none is
    above ``most`` times its source; with sources in order of the level at which
    they reach that bound, the level of the others follows from running sums.
    """
    by_source = rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    of = staged(by_source.withColumns({"number": number.cast("bigint"), "weight": weight}), "sources")
    bound = (most * F.col("source_size")).cast("double")
    by_level = Window.orderBy(F.col("bound") / F.col("weight"), "number")
    everything = Window.partitionBy()
    levels = of.withColumn("bound", bound).select(
        "*",
        (F.lit(share) * F.sum("source_size").over(everything)).alias("budget"),
        F.coalesce(F.sum("bound").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("bounded"),
        F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("others"),
    )
    level = (F.col("budget") - F.col("bounded")) / F.col("others")
    reach = F.col("bound") / F.col("weight")
    # The first source in that order that the level of the rest does not lift above its bound.
    first = F.min(F.when(level <= reach, F.struct(reach.alias("reach"), "number", level.alias("level")))).over(everything)
    target = F.least(F.col("bound"), F.coalesce(first["level"], F.lit(float("inf"))) * F.col("weight"))
    return staged(levels.select("source", "number", "docs", "source_size", target.alias("target")), "targets")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def block_quotas(rows: DataFrame, sources: DataFrame, block_docs: int, super_blocks: int = 1024) -> DataFrame:
    """Per source: blocks, whole passes, further whole blocks, and where the last block is cut.

    Words are summed up over blocks in two levels, so no window holds more
    than ``super_blocks`` blocks or a level's sums.
    """
    plan = sources.withColumns({
        "blocks": F.ceil(F.col("docs") / block_docs),
        "passes": F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)),
    }).withColumn("wanted", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    dealt = rows.join(plan.withColumnRenamed("source", "name"), same(F.col("source"), F.col("name"))).select(
        "number", "wanted", F.pmod("hash", "blocks").alias("block"), "hash", "doc_id", "size"
    )
    sums = staged(dealt.groupBy("number", "wanted", "block").agg(F.sum("size").alias("words")), "blocks")
    upper = F.floor(F.col("block") / super_blocks)
    above = sums.groupBy("number", upper.alias("upper")).agg(F.sum("words").alias("words"))
    before = Window.partitionBy("number").orderBy("upper").rowsBetween(Window.unboundedPreceding, -1)
    above = above.select("number", "upper", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("above"))
    inside = Window.partitionBy("number", "upper").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    running = sums.withColumn("upper", upper).join(above, ["number", "upper"]).withColumn(
        "words_before", F.col("above") + F.coalesce(F.sum("words").over(inside), F.lit(0))
    )
    # The block in which the running sum passes what is wanted.
    last = running.filter((F.col("words_before") + F.col("words") > F.col("wanted")) & (F.col("words_before") <= F.col("wanted")))
    last = staged(last.select("number", "block", (F.col("wanted") - F.col("words_before")).alias("rest")), "last")
    upto = F.sum("size").over(Window.partitionBy("number").orderBy("hash", F.asc_nulls_first("doc_id")))
    cut = dealt.join(last, ["number", "block"]).withColumn("upto", upto).filter("upto <= rest")
    cut = cut.groupBy("number").agg(F.max("hash").alias("cut_hash"), F.max_by("doc_id", F.struct("hash", "doc_id")).alias("cut_id"))
    return staged(
        plan.join(last.select("number", F.col("block").alias("last_block")), "number", "left")
        .join(cut, "number", "left")
        .withColumn("last_block", F.coalesce("last_block", F.when(F.col("wanted") > 0, F.col("blocks")).otherwise(0))),
        "quotas",
    )


def hypergeometric(uniform: str, total: str, marked: str, drawn: str) -> str:
    """SQL for the number of marked items among ``drawn`` of ``total``, by inverting the distribution at ``uniform``.

    Weights follow from one to the next by their ratio, over eight standard
    deviations on each side of the mean; beyond that, less than 1e-14 is left.
    """
    mean = f"({drawn} * {marked} / cast(greatest({total}, 1) AS double))"
    spread = f"(8 * sqrt({mean} * (1 - {marked} / cast(greatest({total}, 1) AS double))) + 2)"
    low = f"cast(greatest(0, {drawn} - ({total} - {marked}), floor({mean} - {spread})) AS bigint)"
    high = f"cast(least({marked}, {drawn}, ceil({mean} + {spread})) AS bigint)"
    values = f"sequence({low}, greatest({low}, {high}))"
    ratio = f"(({marked} - k) * cast({drawn} - k AS double) / ((k + 1) * cast(greatest({total} - {marked} - {drawn} + k + 1, 1) AS double)))"
    start = "named_struct('w', 1D, 'sum', 0D)"
    all_ = f"aggregate({values}, {start}, (h, k) -> named_struct('w', h.w * {ratio}, 'sum', h.sum + h.w), h -> h.sum)"
    first = "named_struct('w', 1D, 'sum', 0D, 'at', cast(-1 AS bigint))"
    step = (
        f"named_struct('w', h.w * {ratio}, 'sum', h.sum + h.w,"
        " 'at', if(h.at < 0 AND h.sum + h.w >= goal, k, h.at))"
    )
    found = f"aggregate({values}, {first}, (h, k) -> {step}, h -> if(h.at < 0, greatest({low}, {high}), h.at))"
    return f"element_at(transform(array({uniform} * {all_}), goal -> {found}), 1)"


def splitting_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(shard, number, first, until): which places of each source's block order a shard takes."""
    # One row a node: what is left of each source, sources in order of their number.
    node = quotas.groupBy().agg(
        F.transform(F.array_sort(F.collect_list(F.struct("number", "quota"))), lambda x: x["quota"]).alias("left"),
    ).withColumn("shard", F.lit(0).cast("bigint"))
    total = "aggregate(left, cast(0 AS bigint), (s, q) -> s + q)"
    for level in range(levels):
        uniform = f"((pmod(xxhash64({seed}, {level}, shard, size(s.out)), 9007199254740992) + 0.5D) / 9007199254740992D)"
        draw = hypergeometric(uniform, "s.total", "q", "s.draws")
        step = (
            f"transform(array({draw}), x -> named_struct('total', s.total - q, 'draws', s.draws - x,"
            " 'out', array_append(s.out, x)))[0]"
        )
        start = "named_struct('total', total, 'draws', cast((total + pmod(shard, 2)) div 2 AS bigint), 'out', cast(array() AS array<bigint>))"
        node = node.withColumn("total", F.expr(total)).withColumn(
            "half", F.expr(f"aggregate(left, {start}, (s, q) -> {step}, s -> s.out)")
        )
        other = F.zip_with("left", "half", lambda q, x: q - x)
        child = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("half").alias("left")), F.struct(F.lit(1).alias("side"), other.alias("left"))))
        node = node.select("shard", child.alias("child")).select(
            (F.col("shard") * 2 + F.col("child.side")).alias("shard"), "child.left"
        )
        node = staged(node, "tree")
    taken = node.select("shard", F.posexplode("left").alias("place", "quota"))
    in_order = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    until = F.sum("quota").over(in_order)
    return taken.select("shard", F.col("place").cast("bigint").alias("number"), until.alias("until"))


def plan(docs: DataFrame, weights, share, most, block_docs, levels, seed) -> DataFrame:
    """One row a source with all that a document needs to know its share; sources are few beside documents."""
    rows = staged(sized(docs, seed), "sizes")
    quotas = block_quotas(rows, targets(rows, weights, share, most), block_docs)
    cut = F.col("cut_hash").isNotNull().cast("bigint")
    quotas = quotas.withColumn("quota", F.col("passes") * F.col("blocks") + F.least(F.col("last_block") + cut, "blocks"))
    tree = splitting_tree(quotas.withColumn("quota", F.col("quota").cast("bigint")), levels, seed)
    ends = tree.groupBy("number").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("shard", "until"))), lambda x: x["until"]).alias("ends")
    )
    return staged(quotas.join(ends, "number").withColumnRenamed("source", "name"), "plan")


def copies() -> Column:
    """How often the mix takes a document: whole passes, and once more from the blocks in front."""
    block = F.pmod("hash", "blocks")
    doc_id = F.col("doc_id")
    up_to_cut = (F.col("hash") < F.col("cut_hash")) | (
        (F.col("hash") == F.col("cut_hash"))
        & F.coalesce(doc_id <= F.col("cut_id"), doc_id.isNull() | (doc_id.isNull() & F.col("cut_id").isNull()))
    )
    once_more = (block < F.col("last_block")) | ((block == F.col("last_block")) & F.coalesce(up_to_cut, F.lit(False)))
    return F.col("passes") + once_more.cast("bigint")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    block_docs: int = 128,
    levels: int = 5,
    seed: int = 20260,
) -> DataFrame:
    """Every document with the words that the mix takes of it and the shards that get them.

    Needs ``doc_id``, ``source`` and ``text``.  A null or empty text has size 0.
    All rows of a null source are one source, the last.  ``taken`` is ``size``
    times the copies taken; a source's sum misses its target by less than one
    document (rows with one id share their fate).  The draw hangs on ids and
    ``seed`` alone, so reruns agree.  An empty table gives no rows; other
    columns are not read.
    """
    of = plan(docs, weights, share, most, block_docs, levels, seed)
    found = sized(docs, seed).join(of, same(F.col("source"), F.col("name")))
    found = found.withColumn("copies", copies())
    place = "pmod(hash, blocks) + c * blocks"
    shards = F.expr(
        "transform(if(copies > 0, sequence(0L, copies - 1), cast(array() AS array<bigint>)),"
        f" c -> size(filter(ends, e -> e <= {place})))"
    )
    return found.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
        shards.alias("shards"),
    )


def mixed_documents(docs: DataFrame, levels: int = 5, seed: int = 20260, **settings) -> DataFrame:
    """The mix itself: the documents' own columns, a row for each copy, by shard and in random order there."""
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    of = plan(docs, **({"weights": WEIGHTS, "share": 1.5, "most": 2, "block_docs": 128} | settings), levels=levels, seed=seed)
    doc_id = F.col("d.doc_id").cast("bigint")
    keyed = docs.alias("d").select(F.struct(*columns).alias("d"), doc_id.alias("doc_id"), F.col("d.source").alias("source"),
                                   F.xxhash64(doc_id, F.lit(seed)).alias("hash"))
    found = keyed.join(of, same(F.col("source"), F.col("name"))).withColumn("copies", copies()).filter("copies > 0")
    copy = F.explode(F.expr("sequence(0L, copies - 1)")).alias("c")
    found = found.select("*", copy).withColumn("shard", F.expr("size(filter(ends, e -> e <= pmod(hash, blocks) + c * blocks))"))
    local = F.xxhash64("doc_id", "c", F.lit(seed + 1))
    dealt = found.repartition(2**levels, "shard").sortWithinPartitions("shard", local)
    return dealt.select("d.*")
