"""What follows a load instead of being rebuilt, and stored tables laid out anew."""

import collections
import datetime
import itertools
import json
import random

import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from basketry.operators import (
    analytics, containment, customer_state, distinct_cube, features, heavy_hitters, itemsets, prepare, rules, silhouette, summary,
)
from basketry.plans import bucketed, compaction, increments
from basketry.plans.ingest import Store
from basketry.schemas import BASKETS, LINES
from basketry.sources import readers, writers
from basketry.streaming import incremental
from conftest import as_dicts

BASKET_ROWS = "date date, store_id bigint, customer_id bigint, categories array<bigint>"


def random_rows(rng, n, categories=7, customers=40):
    """Baskets in which some categories go together."""
    rows = {}
    for _ in range(n):
        held = {rng.randint(1, categories) for _ in range(rng.randint(1, 4))}
        if 1 in held and rng.random() < 0.7:
            held.add(2)
        day = datetime.date(2021, 1, 1) + datetime.timedelta(days=rng.randint(0, 120))
        rows[day, rng.randint(1, 3), rng.randint(1, customers)] = sorted(held)
    return [(*key, held) for key, held in rows.items()]


def baskets_of(spark, rows):
    frame = spark.createDataFrame(rows, BASKET_ROWS).withColumn("basket_size", F.size("categories").cast("bigint"))
    return prepare.with_transaction(frame).select(*BASKETS.fieldNames())


def plain_itemsets(rows, min_support):
    """Counts of the frequent sets and of the sets of which all parts are frequent."""
    counts = collections.Counter()
    items = sorted({c for r in rows for c in r[3]})
    for *_, held in rows:
        for size in range(1, len(held) + 1):
            counts.update(itertools.combinations(sorted(held), size))
    least = -(-min_support * len(rows) // 1)
    frequent = {s for s, n in counts.items() if n >= least}
    border = {(i,) for i in items} - frequent
    for size in range(2, len(items) + 1):
        for s in itertools.combinations(items, size):
            if s not in frequent and all(p in frequent for p in itertools.combinations(s, size - 1)):
                border.add(s)
    return {s: counts[s] for s in frequent | border}


def as_counts(state):
    return {tuple(r["items"]): r["freq"] for r in state.counts.collect()}


def test_itemsets_follow_added_and_removed_baskets(spark):
    rng = random.Random(31)
    rows = random_rows(rng, 400)
    old, new = rows[:150], rows[150:]
    state = itemsets.mined(baskets_of(spark, old), 0.08)
    assert as_counts(state) == plain_itemsets(old, 0.08)
    # Ten baskets change, ten go, the others come.
    changed = [(*r[:3], sorted({*r[3], 5, 6, 7})) for r in old[:10]]
    now = changed + old[20:] + new
    state = itemsets.updated(state, baskets_of(spark, changed + new), baskets_of(spark, now), baskets_of(spark, old[:20]))
    assert state.transactions == len(now) and as_counts(state) == plain_itemsets(now, 0.08)
    mined = rules.association_rules(rules.mine_rules(baskets_of(spark, now), 0.08, 0.2))
    assert {str(r[:2]) for r in mined.collect()} == {str(r[:2]) for r in itemsets.rules_of(state, 0.2).collect()}


def test_old_baskets_are_left_alone_while_no_set_crosses_the_border(spark):
    rows = [(datetime.date(2021, 1, 1), 1, i, [1, 2] if i % 2 else [3]) for i in range(60)]
    state = itemsets.mined(baskets_of(spark, rows), 0.2)
    unreadable = baskets_of(spark, rows).filter(F.raise_error(F.lit("read again")).isNull())
    more = [(datetime.date(2021, 1, 2), 1, i, [1, 2]) for i in range(10)]
    state = itemsets.updated(state, baskets_of(spark, more), unreadable)
    assert as_counts(state)[1, 2] == 40
    new = [(datetime.date(2021, 1, 3), 1, i, [2, 3]) for i in range(40)]
    with pytest.raises(Exception, match="read again"):
        itemsets.updated(state, baskets_of(spark, [(*r[:3], [2, 3, 4]) for r in new]), unreadable)


def test_border_of_nothing(spark):
    empty = baskets_of(spark, []).limit(0)
    rows = [(datetime.date(2021, 1, 1), 1, i, [1, 2, 3]) for i in range(4)]
    state = itemsets.updated(itemsets.mined(baskets_of(spark, rows[:1]), 0.5), empty, baskets_of(spark, rows[:1]))
    assert as_counts(state) == plain_itemsets(rows[:1], 0.5)
    gone = itemsets.updated(state, baskets_of(spark, rows[1:]), baskets_of(spark, rows[1:]), baskets_of(spark, rows[:1]))
    assert as_counts(gone) == plain_itemsets(rows[1:], 0.5)


def test_sets_are_met_at_their_rarest_item(spark):
    rng = random.Random(32)
    held = {h: sorted({1, 2, *(rng.randint(3, 60) for _ in range(6))}) for h in range(300)}
    sets = {n: sorted({1, rng.randint(3, 60), *([2] if n % 2 else [])}) for n in range(200)} | {900: [1], 901: [99]}
    holders = spark.createDataFrame(list(held.items()), "holder bigint, held array<bigint>")
    table = spark.createDataFrame(list(sets.items()), "number bigint, items array<bigint>")
    found = {tuple(r) for r in containment.held_sets(holders, table).collect()}
    assert found == {(h, n) for h, has in held.items() for n, s in sets.items() if set(s) <= set(has)}
    met = containment.met_sets(holders, table).count()
    by_every_item = sum(len(set(s) & set(has)) for has in held.values() for s in sets.values())
    assert len(found) <= met < by_every_item / 10


def test_customer_state_adds_up_to_all_that_baskets_say(spark):
    rows = [(d, s, c, [x * 40 - 50 for x in held]) for d, s, c, held in random_rows(random.Random(33), 500)]
    baskets = baskets_of(spark, rows)
    state = customer_state.monthly_state(baskets)
    assert state.count() == len({(c, d.strftime("%Y-%m")) for d, _, c, _ in rows})
    for ours, theirs in (
        (customer_state.features_of(state), features.customer_features(baskets)),
        (customer_state.metrics_of(state), analytics.customer_metrics(baskets)),
        (customer_state.top_customers_of(state), summary.top_customers(baskets)),
    ):
        assert ours.columns == theirs.columns and sorted(map(tuple, ours.collect())) == sorted(map(tuple, theirs.collect()))


def test_cube_counts_any_range(spark):
    rows = [(d, s, c * 20_000, held) for d, s, c, held in random_rows(random.Random(34), 500)]
    cube = distinct_cube.customer_cube(baskets_of(spark, rows))
    day = datetime.date
    wanted = [(0, day(2021, 1, 10), day(2021, 2, 20), 2), (1, day(2021, 1, 1), day(2021, 12, 31), None), (2, day(2022, 1, 1), day(2022, 2, 1), None)]
    ranges = spark.createDataFrame(wanted, "range_id int, start_date date, end_date date, store_id bigint")
    found = {r["range_id"]: (r["unique_customers"], r["transactions"], r["category_lines"]) for r in distinct_cube.counted_ranges(cube, ranges).collect()}
    for number, start, end, store in wanted:
        inside = [r for r in rows if start <= r[0] <= end and store in (None, r[1])]
        assert found[number] == (len({r[2] for r in inside}), len(inside), sum(len(r[3]) for r in inside))
    assert tuple(distinct_cube.counted(cube.filter("store_id = 9")).first()) == (0, 0, 0)


@pytest.mark.parametrize("tracked", [100_000, 600])
def test_heavy_hitters_are_exact_whatever_the_sketch_holds(spark, tracked):
    rows = spark.range(40_000).selectExpr("if(id % 3 = 0, id % 11, id % 9973) AS c").union(spark.createDataFrame([(None,)] * 500, "c bigint"))
    exact = collections.Counter(r["c"] for r in rows.collect() if r["c"] is not None)
    want = sorted(exact.items(), key=lambda x: (-x[1], x[0]))[:15]
    assert [tuple(r) for r in heavy_hitters.most_frequent(rows, "c", 15, tracked=tracked).collect()] == want
    named = heavy_hitters.candidates(rows, "c", 150, tracked)
    assert all(n <= named.others_at_most for c, n in exact.items() if c not in named.values)
    assert heavy_hitters.most_frequent(rows.limit(0), "c", 15).collect() == []


def test_silhouettes_are_those_of_the_evaluator(spark):
    rng = random.Random(35)
    rows = [([rng.gauss(k, 1.0), rng.gauss(-k, 0.5), rng.random()], k % 2, k % 3, 0, 7 if i == 0 else k % 2) for i in range(90) for k in (i % 4,)]
    points = spark.createDataFrame(rows, "at array<double>, a int, b int, one int, alone int")
    found = {r["clustering"]: r for r in silhouette.scores(points, ["a", "b", "one", "alone"], 3).collect()}
    vectors = VectorAssembler(inputCols=["x", "y", "z"], outputCol="v").transform(
        points.selectExpr("at[0] AS x", "at[1] AS y", "at[2] AS z", "a", "b", "alone")
    )
    for name in ("a", "b", "alone"):
        evaluator = ClusteringEvaluator(featuresCol="v", predictionCol=name, metricName="silhouette")
        assert abs(evaluator.evaluate(vectors) - found[name]["silhouette"]) < 1e-9
    assert found["one"]["silhouette"] == 0.0 and found["alone"]["clusters"] == 3


def batch_of(spark, records):
    return spark.createDataFrame(records, BASKET_ROWS)


def test_loads_are_followed_and_finished(spark, categories, tmp_path, monkeypatch):
    store, rng = Store(str(tmp_path / "store")), random.Random(36)
    rows = random_rows(rng, 120)
    first, second = rows[:60], rows[60:] + [(*r[:3], [1, 2, 3]) for r in rows[:10]]
    increments.load_and_follow(spark, batch_of(spark, first), categories, store, "one", 0.2)
    increments.mine_from_stored(spark, store, 0.08, "one")
    assert increments.load_and_follow(spark, batch_of(spark, first), categories, store, "one", 0.2) == []

    def lost(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(increments, "refresh_customer_cube", lost)
    with pytest.raises(RuntimeError):
        increments.load_and_follow(spark, batch_of(spark, second), categories, store, "two", 0.2)
    monkeypatch.undo()
    assert increments.load_and_follow(spark, batch_of(spark, second), categories, store, "two", 0.2)
    baskets = readers.read_baskets(spark, store.baskets)
    held = [(r["date"], r["store_id"], r["customer_id"], r["categories"]) for r in baskets.collect()]
    state, loads, load = increments.read_itemsets(spark, store)
    assert (loads, load) == (1, "two") and as_counts(state) == plain_itemsets(held, 0.08)
    of_months = customer_state.features_of(spark.read.parquet(store.customer_months))
    assert sorted(map(tuple, of_months.collect())) == sorted(map(tuple, features.customer_features(baskets).collect()))
    cells = distinct_cube.counted(spark.read.parquet(store.customer_cube)).first()
    assert cells["unique_customers"] == len({r[2] for r in held}) and cells["transactions"] == len(held)
    mined = rules.association_rules(rules.mine_rules(baskets, 0.08, 0.2))
    assert mined.count() == readers.read_rules(spark, store.rules).count()


def test_a_load_reads_its_own_months_only(spark, tmp_path, plan_of):
    store = Store(str(tmp_path / "store"))
    writers.write_partitioned(baskets_of(spark, random_rows(random.Random(37), 100)), store.baskets)
    plan = plan_of(increments._of_months(spark, store, ["2021-02"]))
    assert "PartitionFilters" in plan and "year_month" in plan.split("PartitionFilters")[1].split("\n")[0]


def test_compaction_leaves_rows_and_few_files(spark, categories, tmp_path):
    path = str(tmp_path / "lines")
    lines = prepare.lines_of(baskets_of(spark, random_rows(random.Random(38), 300)), categories)
    for k in range(6):
        writers.write_partitioned(lines.filter(F.col("customer_id") % 6 == k), path, mode="append")
    before = sorted(map(tuple, readers.read_lines(spark, path).collect()))
    stats = {(r["store_id"], r["year_month"]): r for r in compaction.partition_files(spark, path, LINES).collect()}
    assert max(r["files"] for r in stats.values()) > 3
    picked = compaction.compact(spark, path, LINES)
    assert picked.count() == sum(r["files"] > 1 for r in stats.values())
    assert sorted(map(tuple, readers.read_lines(spark, path).collect())) == before
    after = compaction.partition_files(spark, path, LINES).collect()
    assert {r["files"] for r in after} == {1} and sum(r["rows"] for r in after) == len(before)
    assert compaction.compact(spark, path, LINES).count() == 0
    # Smaller files: as many as the bytes ask for, at most.
    least = min(r["bytes"] for r in after)
    writers.write_partitioned(readers.read_lines(spark, path).limit(5), path, mode="append")
    compaction.compact(spark, path, LINES, file_bytes=least // 2)
    assert len(readers.read_lines(spark, path).collect()) == len(before) + 5


def test_late_lines_are_kept_apart(spark, categories, tmp_path):
    folder = tmp_path / "incoming"
    folder.mkdir()
    paths = [str(tmp_path / name) for name in ("timely", "late")]
    checkpoint = str(tmp_path / "checkpoint")

    def send(name, *records):
        text = [json.dumps({"date": d, "store_id": 1, "customer_id": c, "categories": held}) for d, c, held in records]
        (folder / name).write_text("\n".join(text))
        stream = readers.stream_incoming_json(spark, str(folder))
        incremental.start_parted_lines(stream, categories, *paths, checkpoint).awaitTermination()

    def rows(path):
        if not readers.table_exists(spark, path):
            return []
        return sorted((str(r["date"]), r["customer_id"], r["category_id"]) for r in readers.read_batches(spark, path).collect())

    send("a.json", ("2021-03-01", 1, [1, 2]), ("2021-03-20", 2, [3]))
    assert rows(paths[0]) == [("2021-03-01", 1, 1), ("2021-03-01", 1, 2), ("2021-03-20", 2, 3)] and rows(paths[1]) == []
    # Seven days before the newest is in time, eight are not; what was written does not come again.
    send("b.json", ("2021-03-13", 3, [4]), ("2021-03-12", 4, [5]), ("2021-03-01", 1, [2, 3]))
    assert rows(paths[0])[-2:] == [("2021-03-13", 3, 4), ("2021-03-20", 2, 3)]
    assert rows(paths[1]) == [("2021-03-01", 1, 3), ("2021-03-12", 4, 5)]
    send("c.json", ("2021-03-12", 4, [5]), ("2021-03-14", 5, [1]))
    assert len(rows(paths[0])) == 5 and len(rows(paths[1])) == 2


def test_tables_by_customer_need_no_shuffle(spark, plan_of):
    baskets = baskets_of(spark, random_rows(random.Random(39), 300))
    stored = bucketed.write_by_customer(baskets, "baskets_by_customer_test", 4)
    clusters = bucketed.write_by_customer(
        baskets.select("customer_id").distinct().withColumn("cluster", F.lit(1)), "clusters_by_customer_test", 4
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for report in (features.customer_features(stored), analytics.customer_metrics(stored), features.customer_features(stored).join(clusters, "customer_id")):
            assert "Exchange hashpartitioning(customer_id" not in plan_of(report, "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(tuple, features.customer_features(stored).collect())) == sorted(map(tuple, features.customer_features(baskets).collect()))


def test_naming_lines_starts_no_job(spark, categories):
    lines = baskets_of(spark, random_rows(random.Random(40), 20))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("naming", "plans only")
    try:
        prepare.lines_of(lines, categories)
        assert not tracker.getJobIdsForGroup("naming")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_box_plots_explode_numbers_only(spark, categories, plan_of):
    baskets = baskets_of(spark, random_rows(random.Random(41), 50))
    plan = plan_of(analytics.boxplot_category(baskets, categories), "formatted")
    outputs = [part for part in plan.split("\n\n") if "Generate" in part.split("\n")[0]]
    assert outputs and all("categories" not in part.split("Arguments:")[1].split("[", 1)[1].split("]")[0] for part in outputs)
