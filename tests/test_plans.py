"""What the physical plans must show for the jobs to scale."""

import re

import pytest
from pyspark.sql import functions as F

from basketry.operators import analytics, features, filters, prepare, rules, summary
from basketry.sources import readers, writers


@pytest.fixture(scope="module")
def stored(spark, categories, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stored")
    rows = [
        (f"2013-{m:02d}-{d:02d}", store, customer, category)
        for m in (1, 2, 3) for d in (1, 15) for store in (1, 2)
        for customer in range(4) for category in (1, 2, 1 + customer)
    ]
    df = spark.createDataFrame(
        rows, "date string, store_id bigint, customer_id bigint, category_id bigint"
    )
    baskets = prepare.build_baskets(df.withColumn("date", df.date.cast("date")))
    writers.write_partitioned(baskets, f"{folder}/baskets")
    stored_baskets = readers.read_baskets(spark, f"{folder}/baskets")
    writers.write_partitioned(prepare.lines_of(stored_baskets, categories), f"{folder}/lines")
    return readers.read_lines(spark, f"{folder}/lines"), stored_baskets


def exchanges(plan):
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)


def test_filters_skip_partitions(stored, plan_of):
    lines, _ = stored
    plan = plan_of(filters.between(lines, "2013-02-01", "2013-02-28", 2))
    scan = re.search(r"PartitionFilters: \[(.*)\]", plan).group(1)
    assert "store_id" in scan and "year_month" in scan
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan).group(1)
    assert "GreaterThanOrEqual(date" in pushed and "LessThanOrEqual(date" in pushed


def test_reports_read_only_their_columns(stored, plan_of):
    lines, baskets = stored
    schema = re.compile(r"ReadSchema: (struct<.*?>+)")
    counted = plan_of(summary.transaction_count(baskets), "simple")
    assert schema.search(counted).group(1) == "struct<>"
    series = plan_of(analytics.time_series(baskets, "month"), "simple")
    assert schema.search(series).group(1) == "struct<date:date,basket_size:bigint>"
    shares = plan_of(summary.category_share(lines), "simple")
    assert schema.search(shares).group(1) == "struct<category_id:bigint,category_name:string>"


def test_nothing_is_shuffled_by_transaction(stored, categories, plan_of):
    lines, baskets = stored
    reports = [
        summary.top_categories(lines),
        summary.category_share(lines),
        summary.peak_days(baskets),
        analytics.time_series(baskets, "day"),
        analytics.boxplot_category(baskets, categories),
        analytics.boxplot_customer(baskets),
        features.customer_features(baskets),
    ]
    for report in reports:
        assert not any("transaction_id" in e or "store_id" in e for e in exchanges(plan_of(report, "simple")))


def test_baskets_are_combined_before_the_shuffle(spark, plan_of):
    items = spark.createDataFrame(
        [], "date date, store_id bigint, customer_id bigint, product_code bigint"
    )
    catalog = spark.createDataFrame([], "product_code bigint, category_id bigint")
    plan = plan_of(prepare.build_baskets(prepare.categorise(items, catalog)), "simple")
    assert "partial_collect_set" in plan
    assert sum("customer_id" in e for e in exchanges(plan)) == 1


def test_lines_of_baskets_do_not_shuffle_baskets(stored, categories, plan_of):
    plan = plan_of(prepare.lines_of(stored[1], categories), "simple")
    assert not any("transaction_id" in e or "customer_id" in e for e in exchanges(plan))


def test_names_reach_lines_without_a_shuffle_by_category(spark, stored, categories, plan_of):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(prepare.lines_of(stored[1], F.broadcast(categories)), "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and not any("category_id" in e for e in exchanges(plan))


def test_group_limits_come_before_the_shuffle(spark, plan_of):
    catalog = spark.range(1000).selectExpr("id AS product_code", "id % 7 AS category_id")
    plan = plan_of(rules.products_by_category(catalog), "simple")
    assert re.search(r"WindowGroupLimit.*Final[\s\S]*Exchange[\s\S]*WindowGroupLimit.*Partial", plan)


def test_customers_are_shuffled_once_for_all_rules(spark, plan_of, tmp_path):
    path, history = str(tmp_path / "rules"), str(tmp_path / "baskets")
    spark.range(50000).selectExpr(
        "id % 9973 AS customer_id", "array(id % 7, 10 + id % 31) AS categories"
    ).write.parquet(history)
    spark.createDataFrame(
        [([1], [2], 0.5, 1.2, 0.1), ([1, 2], [3], 0.5, 1.1, 0.1)],
        "antecedent array<bigint>, consequent array<bigint>, confidence double, lift double, support double",
    ).write.parquet(path)
    bought = rules.bought_categories(spark.read.parquet(history))
    plan = plan_of(rules.rules_for_customers(bought, readers.read_rules(spark, path)), "simple")
    by_customer = {re.sub(r"#\d+L?", "", e) for e in exchanges(plan) if e.startswith("customer_id")}
    # One for the distinct (customer, category) pairs, one for the list per customer; equal ones are run once.
    assert by_customer == {"customer_id", "customer_id, category_id"}
    # Nothing but antecedents is limited by a window: a history's rules are cut inside its own row.
    assert not re.search(r"Window(GroupLimit)? .*(history|holder)#", plan)


def test_histories_stay_where_they_are_whatever_spark_broadcasts(spark, plan_of, monkeypatch):
    bought = spark.createDataFrame([(1, [1, 2]), (2, [1]), (None, [1]), (3, [3])], "customer_id bigint, bought array<bigint>")
    found = spark.createDataFrame(
        [([1], [2], 0.5, 1.2, 0.1), ([1, 2], [3], 0.5, 1.1, 0.1)],
        "antecedent array<bigint>, consequent array<bigint>, confidence double, lift double, support double",
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        used = rules.rules_for_customers(bought, found)
        assert not [e for e in exchanges(plan_of(used, "simple")) if "position" in e]
        few = {(r["customer_id"], r["rank"], *r["antecedent"]) for r in used.collect()}
        monkeypatch.setattr(rules, "BROADCAST_RULES", 0)
        many = rules.rules_for_customers(bought, found)
        assert [e for e in exchanges(plan_of(many, "simple")) if "position" in e]
        assert few == {(r["customer_id"], r["rank"], *r["antecedent"]) for r in many.collect()}
        assert few == {(1, 1, 1), (1, 2, 1, 2), (2, 1, 1), (None, 1, 1)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_python_and_no_cartesian_product(stored, categories, plan_of, spark):
    lines, baskets = stored
    table = spark.createDataFrame(
        [], "antecedent array<bigint>, consequent array<bigint>, confidence double, lift double, support double"
    )
    for report in (
        summary.top_customers(baskets),
        summary.peak_days_grid(baskets),
        summary.category_share_rollup(lines),
        analytics.correlation_matrix(analytics.customer_metrics(baskets)),
        features.customer_features(baskets),
        rules.recommend(baskets, table),
    ):
        plan = plan_of(report, "simple")
        assert not re.search(r"Python|ArrowEval|CartesianProduct|BroadcastNestedLoopJoin", plan)
