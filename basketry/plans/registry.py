"""Every operator as a query over the order tables."""

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.clustering import KMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions.labels import id_list
from basketry.functions.stats import rounded
from basketry.operators import (
    analytics, customer_state, distinct_cube, features, filters, heavy_hitters, itemsets, prepare, rules, segments,
    silhouette, summary,
)
from basketry.plans import bucketed, compaction, increments
from basketry.plans.ingest import Store, bulk_load
from basketry.plans.refresh import refresh_models
from basketry.plans.tables import RetailTables
from basketry.schemas import BASKETS, FEATURE_COLUMNS, LINES
from basketry.session import fresh_path, staged
from basketry.sources import readers, writers
from basketry.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]

# Filter of the *_filtered queries, and the thresholds for the two item columns.
SAMPLE_FILTER = {"start_date": "1997-01-01", "end_date": "1997-12-31", "store_id": 3}
SIZE_SUPPORT, SIZE_CONFIDENCE = 0.004, 0.05
# Key of the queries for one category or customer; what turns a category's id into an unknown one.
SAMPLE_KEY, UNKNOWN_FROM = 7, 1000
# Files of one micro-batch in the query over a stream.
FILES_A_BATCH = 8
# Loads of the queries over increments: what is there at first, and the years that follow.
FIRST_YEARS_UNTIL, LATER_YEARS = 1998, (1999, 2000, 2001)
# Order in which years arrive where some are late, and the points of a scatter plot.
ARRIVING_YEARS = (1995, 1996, 1998, 1997, 2000, 1999, 2001)
SCATTER_POINTS = 500
# Appends of the query over small files, and stores of the queries over stored tables.
SMALL_APPENDS, FEW_STORES = 10, 2

# Reports that accept the date and store filter, each from a RetailTables.
FILTERED_REPORTS: dict[str, Callable[..., DataFrame]] = {
    "kpi_total_lines": lambda t, **f: summary.total_lines(t.lines, **f),
    "kpi_transactions": lambda t, **f: summary.transaction_count(t.baskets, **f),
    "kpi_customers": lambda t, **f: summary.unique_customers(t.baskets, **f),
    "top_categories": lambda t, **f: summary.top_categories(t.lines, **f),
    "top_customers": lambda t, **f: summary.top_customers(t.baskets, **f),
    "peak_days": lambda t, **f: summary.peak_days(t.baskets, **f),
    "peak_days_grid": lambda t, **f: summary.peak_days_grid(t.baskets, **f),
    "category_share": lambda t, **f: summary.category_share(t.lines, **f),
    "category_share_rollup": lambda t, **f: summary.category_share_rollup(t.lines, **f),
    "time_series_day": lambda t, **f: analytics.time_series(t.baskets, "day", **f),
    "time_series_week": lambda t, **f: analytics.time_series(t.baskets, "week", **f),
    "time_series_month": lambda t, **f: analytics.time_series(t.baskets, "month", **f),
    "basket_sizes": lambda t, **f: analytics.basket_sizes(t.baskets, **f),
    "boxplot_category": lambda t, **f: analytics.boxplot_category(t.baskets, t.categories, **f),
    "boxplot_customer": lambda t, **f: analytics.boxplot_customer(t.baskets, **f),
}


def catalog_clean(t: RetailTables) -> DataFrame:
    code, category = readers.CATALOG_HEADER
    raw = t.table("part").select(
        F.col("p_partkey").cast("string").alias(code),
        F.when(F.col("p_brand") != "Brand#7", F.col("p_size").cast("string"))
        .otherwise("no category")
        .alias(category),
    )
    return readers.clean_catalog(raw)


def parsed_products(t: RetailTables) -> DataFrame:
    return prepare.parse_receipts(t.raw_receipts).withColumn("products", id_list(F.col("products")))


def lines_from_text(t: RetailTables) -> DataFrame:
    items = prepare.receipt_items(t.raw_receipts)
    return prepare.build_lines(prepare.categorise(items, t.catalog), t.categories)


def baskets_as_text(t: RetailTables) -> DataFrame:
    return t.baskets.withColumn("categories", id_list(F.col("categories")))


def scaled(t: RetailTables) -> DataFrame:
    stored = staged(features.customer_features(t.baskets), "features")
    z = vector_to_array("scaled_features")
    return features.scaled_features(stored).select(
        "customer_id",
        *[F.round(z[i], 6).alias(f"z_{name}") for i, name in enumerate(FEATURE_COLUMNS)],
    )


def segmentation(t: RetailTables) -> segments.Segmentation:
    return segments.train_segments(features.customer_features(t.baskets))


def labels(t: RetailTables) -> DataFrame:
    return segments.cluster_labels(segments.cluster_profiles(segmentation(t).clusters))


def projection(t: RetailTables) -> DataFrame:
    stored = staged(features.customer_features(t.baskets), "features")
    return segments.pca_projection(stored)


def type_rules(t: RetailTables) -> rules.MinedRules:
    return rules.mine_rules(staged(t.type_baskets, "baskets"))


def size_rules(baskets: DataFrame) -> rules.MinedRules:
    return rules.mine_rules(baskets, SIZE_SUPPORT, SIZE_CONFIDENCE)


def itemset_texts(model: rules.MinedRules) -> DataFrame:
    return rules.frequent_itemsets(model).withColumn("items", id_list(F.col("items")))


def stored_rules(model: rules.MinedRules) -> DataFrame:
    return staged(rules.association_rules(model), "rules")


def rule_texts(df: DataFrame) -> DataFrame:
    """Sides as text; the measures rounded where two engines may differ in the last bit."""
    return df.withColumns({
        "antecedent": id_list(F.col("antecedent")),
        "consequent": id_list(F.col("consequent")),
        "confidence": rounded(F.col("confidence"), 9),
        "lift": rounded(F.col("lift"), 9),
        "support": rounded(F.col("support"), 9),
    })


def rules_of_customers(t: RetailTables) -> DataFrame:
    baskets = staged(t.baskets, "baskets")
    bought = rules.bought_categories(baskets)
    used = rules.rules_for_customers(bought, stored_rules(size_rules(baskets)))
    return rule_texts(used.drop("bought"))


def recommendations(t: RetailTables) -> DataFrame:
    baskets = staged(t.baskets, "baskets")
    sides = F.transform(
        "rules_used",
        lambda r: F.concat(id_list(r["antecedent"]), F.lit(">"), id_list(r["consequent"])),
    )
    return rules.recommend(baskets, stored_rules(size_rules(baskets))).select(
        "customer_id",
        id_list(F.col("recommended_categories")).alias("recommended_categories"),
        F.array_join(sides, ";").alias("rules_used"),
    )


def recommendations_with_cluster(t: RetailTables) -> DataFrame:
    baskets = staged(t.baskets, "baskets")
    clusters = segments.train_segments(features.customer_features(baskets)).clusters
    found = rules.recommend(baskets, stored_rules(size_rules(baskets)), clusters)
    return found.select(
        "customer_id",
        "cluster",
        id_list(F.col("recommended_categories")).alias("recommended_categories"),
        F.size("rules_used").cast("bigint").alias("rules_used"),
    )


def ruled_clusters(t: RetailTables) -> DataFrame:
    """Customers in clusters that a rule deals out, so that what follows training has exact results."""
    cluster = F.pmod(F.col("customer_id"), F.lit(5)).cast("int")
    return features.customer_features(t.baskets).withColumn("cluster", cluster)


def ruled_labels(t: RetailTables) -> DataFrame:
    labels_ = segments.cluster_labels(segments.cluster_profiles(ruled_clusters(t)))
    return labels_.withColumn("score", F.round("score", 6))


def ruled_recommendations(t: RetailTables) -> DataFrame:
    baskets = staged(t.baskets, "baskets")
    found = rules.recommend(baskets, stored_rules(size_rules(baskets)), ruled_clusters(t))
    return found.select(
        "customer_id",
        "cluster",
        id_list(F.col("recommended_categories")).alias("recommended_categories"),
        F.size("rules_used").cast("bigint").alias("rules_used"),
    )


def training_invariants(t: RetailTables) -> DataFrame:
    """What must hold of any training: every customer has a cluster, the nearest one, and k is the first best."""
    of_customers = staged(features.customer_features(staged(t.baskets, "baskets")), "features")
    result = segments.train_segments(of_customers)
    scaled = features.scaled_features(of_customers)
    vectors = scaled.select("customer_id", vector_to_array("scaled_features").alias("at"))

    def distance(centre) -> Column:
        parts = [(F.col("at")[i] - float(c)) * (F.col("at")[i] - float(c)) for i, c in enumerate(centre)]
        return sum(parts[1:], parts[0])

    distances = F.array(*[distance(c) for c in result.model.clusterCenters()])
    farther = F.element_at(distances, F.col("cluster") + 1) > F.array_min(distances) + 1e-9
    placed = vectors.join(result.clusters.select("customer_id", "cluster"), "customer_id", "left").agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("cluster").isNull()).alias("without_cluster"),
        F.count_if(farther).alias("not_nearest"),
    )
    tried = result.selection.orderBy("k").collect()  # a row for each k
    best = max((r for r in tried if r["silhouette"] is not None), key=lambda r: r["silhouette"])
    return placed.withColumns({
        "tried": F.lit(len(tried)).cast("bigint"),
        "first_best_selected": F.lit([r["k"] for r in tried if r["selected"]] == [best["k"]]),
    })


def one_category_rules(t: RetailTables) -> DataFrame:
    found = stored_rules(size_rules(staged(t.baskets, "baskets")))
    return rule_texts(rules.rules_for_category(found, SAMPLE_KEY))


def one_customer_recommendations(t: RetailTables) -> DataFrame:
    baskets = staged(t.baskets, "baskets")
    found = rules.recommend(baskets, stored_rules(size_rules(baskets)), customer_id=SAMPLE_KEY)
    return found.select(
        "customer_id", id_list(F.col("recommended_categories")).alias("recommended_categories")
    )


def bulk_loaded(t: RetailTables) -> Store:
    store = Store(fresh_path(t.spark, "store"))
    bulk_load(t.spark, t.raw_receipts, t.catalog, t.categories, store)
    return store


def bulk_loaded_report(t: RetailTables) -> DataFrame:
    """A report read from stored tables: lines of the sample store and year."""
    return summary.top_categories(readers.read_lines(t.spark, bulk_loaded(t).lines), **SAMPLE_FILTER)


def bulk_loaded_baskets(t: RetailTables) -> DataFrame:
    baskets = readers.read_baskets(t.spark, bulk_loaded(t).baskets)
    return baskets.withColumn("categories", id_list(F.col("categories")))


def incoming(t: RetailTables) -> DataFrame:
    """Every receipt as an incoming record, its categories listed with repetitions."""
    return t.baskets.select(
        "date", "store_id", "customer_id", F.concat("categories", "categories").alias("categories")
    )


def ingest_lines(t: RetailTables) -> DataFrame:
    """Every record also names a category that the dimension does not know, to show the fallback name."""
    unknown = F.array(F.element_at("categories", 1) + UNKNOWN_FROM)
    records = incoming(t).withColumn("categories", F.concat("categories", unknown))
    return incremental.incoming_lines(records, t.categories)


def streamed_lines(t: RetailTables) -> DataFrame:
    """All receipts sent through the incremental load twice, as a stream of files."""
    folder = fresh_path(t.spark, "incoming")
    for _ in range(2):
        incoming(t).write.mode("append").json(folder)
    store = Store(fresh_path(t.spark, "store"))
    stream = readers.stream_incoming_json(t.spark, folder)
    checkpoint = fresh_path(t.spark, "load")
    query = incremental.start_incremental_load(stream, t.categories, store, checkpoint)
    query.awaitTermination()
    return readers.read_lines(t.spark, store.lines)


def deduplicated_stream(t: RetailTables) -> DataFrame:
    """All receipts through the append-only stream with bounded state, year by year, each sent twice.

    A year's files are one micro-batch, so the watermark moves on, state expires
    and what is sent again comes too late for all but the year's last week.
    """
    folder = fresh_path(t.spark, "incoming")
    records = staged(incoming(t), "records")
    years = [r["year"] for r in records.select(F.year("date").alias("year")).distinct().orderBy("year").collect()]
    for year in years:
        for _ in range(2):
            of_year = records.filter(F.year("date") == year)
            of_year.repartition(FILES_A_BATCH).write.mode("append").json(folder)
    path, checkpoint = fresh_path(t.spark, "lines"), fresh_path(t.spark, "dedup")
    stream = readers.stream_incoming_json(t.spark, folder, FILES_A_BATCH)
    query = incremental.start_deduplicated_lines(stream, t.categories, path, checkpoint)
    query.awaitTermination()
    return readers.read_batches(t.spark, path)


def few_stores(t: RetailTables) -> RetailTables:
    """All receipts, in few stores: what queries over stored tables cost is their partitions, not their rows."""
    return replace(t, stores=FEW_STORES)


def late_lines_apart(t: RetailTables) -> DataFrame:
    """All receipts as a stream in which two years come late, each year sent twice; both tables, told apart."""
    t = few_stores(t)
    folder = fresh_path(t.spark, "incoming")
    records = staged(incoming(t), "records")
    for year in ARRIVING_YEARS:
        for _ in range(2):
            of_year = records.filter(F.year("date") == year)
            of_year.repartition(FILES_A_BATCH).write.mode("append").json(folder)
    stream = readers.stream_incoming_json(t.spark, folder, FILES_A_BATCH)
    paths = [fresh_path(t.spark, name) for name in ("timely", "late")]
    query = incremental.start_parted_lines(stream, t.categories, *paths, fresh_path(t.spark, "parted"))
    query.awaitTermination()
    both = [readers.read_batches(t.spark, p).withColumn("late", F.lit(k == 1)) for k, p in enumerate(paths)]
    return both[0].unionByName(both[1])


def incremental_itemsets(t: RetailTables) -> list[tuple[int, itemsets.Itemsets]]:
    """The counts after each yearly load, brought up to date by that year's baskets."""
    baskets = staged(t.baskets, "baskets")
    year = F.year("date")
    state = itemsets.mined(baskets.filter(year <= FIRST_YEARS_UNTIL), SIZE_SUPPORT)
    found = []
    for later in LATER_YEARS:
        state = itemsets.updated(state, baskets.filter(year == later), baskets.filter(year <= later))
        found.append((later, state))
    return found


def _by_load(tables: list[tuple[int, DataFrame]]) -> DataFrame:
    both = [df.withColumn("until", F.lit(year).cast("bigint")) for year, df in tables]
    total = both[0]
    for more in both[1:]:
        total = total.unionByName(more)
    return total


def itemsets_after_loads(t: RetailTables) -> DataFrame:
    states = incremental_itemsets(t)
    return _by_load([(y, s.frequent().withColumn("items", id_list(F.col("items")))) for y, s in states])


def rules_after_loads(t: RetailTables) -> DataFrame:
    states = incremental_itemsets(t)
    return _by_load([(y, rule_texts(itemsets.rules_of(s, SIZE_CONFIDENCE))) for y, s in states])


def customer_months(t: RetailTables) -> DataFrame:
    """The stored state after two loads, the second of which computes only the months that it brings."""
    t, store = few_stores(t), Store(fresh_path(t.spark, "store"))
    baskets = staged(t.baskets, "baskets")
    late = F.year("date") == LATER_YEARS[-1]
    for of_load in (baskets.filter(~late), baskets.filter(late)):
        writers.write_partitioned(of_load, store.baskets)
        months = [r[0] for r in of_load.select("year_month").distinct().collect()]  # a row for each month
        increments.refresh_customer_months(t.spark, store, months)
    return t.spark.read.parquet(store.customer_months)


def stored_cube(t: RetailTables) -> DataFrame:
    path = fresh_path(t.spark, "cube")
    distinct_cube.customer_cube(t.baskets).write.partitionBy("year_month").parquet(path)
    return t.spark.read.parquet(path)


def distinct_counts(t: RetailTables) -> DataFrame:
    """Customers, transactions and lines of every store and year, of every year, of the sample filter and in all."""
    cube = stored_cube(t)
    first, last = F.lit("1995-01-01").cast("date"), F.lit("2001-12-31").cast("date")
    begins = cube.select(F.trunc("date", "year").alias("start_date"), "store_id").distinct()
    ends = F.add_months("start_date", 12)
    yearly = begins.select("start_date", F.date_sub(ends, 1).alias("end_date"), "store_id")
    everyone = F.lit(None).cast("bigint").alias("store_id")
    sample = [F.lit(SAMPLE_FILTER[c]).cast("date").alias(c) for c in ("start_date", "end_date")]
    one = t.spark.range(1)
    ranges = (
        yearly.union(yearly.select("start_date", "end_date", everyone).distinct())
        .union(one.select(first, last, everyone))
        .union(one.select(F.date_add(sample[0], 14), F.date_sub(sample[1], 14), everyone))
    )
    number = F.concat_ws("|", "start_date", "end_date", "store_id").alias("range_id")
    return distinct_cube.counted_ranges(cube, staged(ranges.select(number, "*"), "ranges"))


def sample_counts(t: RetailTables) -> DataFrame:
    return distinct_cube.counted(filters.between(stored_cube(t), **SAMPLE_FILTER))


def heavy_customers(t: RetailTables) -> DataFrame:
    found = heavy_hitters.most_frequent(t.baskets.select("customer_id"), "customer_id", analytics.LABELS_CONSIDERED)
    return found.withColumnRenamed("count", "transaction_count")


def ruled_silhouettes(t: RetailTables) -> DataFrame:
    """Scores of clusterings that rules deal out, one for each k that training tries."""
    stored = staged(features.customer_features(t.baskets), "features")
    scaled_ = features.scaled_features(stored).select("customer_id", vector_to_array("scaled_features").alias("at"))
    names = [f"k{k}" for k in segments.K_RANGE]
    ruled = [F.pmod("customer_id", F.lit(k)).alias(f"k{k}") for k in segments.K_RANGE]
    found = silhouette.scores(scaled_.select("at", *ruled), names, len(FEATURE_COLUMNS))
    return found.withColumns({"silhouette": F.round("silhouette", 6), "cost": F.round("cost", 3)})


def small_appends(t: RetailTables) -> str:
    """Lines as ten loads of a few days each leave them, compacted."""
    t = few_stores(t)
    path = fresh_path(t.spark, "lines")
    lines = staged(t.lines, "lines")
    for k in range(SMALL_APPENDS):
        writers.write_partitioned(lines.filter(F.dayofmonth("date") % SMALL_APPENDS == k), path, mode="append")
    compaction.compact(t.spark, path, LINES)
    return path


def compacted_partitions(t: RetailTables) -> DataFrame:
    found = compaction.partition_files(t.spark, small_appends(t), LINES)
    return found.select("store_id", "year_month", "files", "rows")


def by_customer(t: RetailTables) -> DataFrame:
    baskets = staged(t.baskets, "baskets")
    return bucketed.write_by_customer(baskets, table_name(t, "baskets"), bucketed.buckets_for(baskets.count()))


def table_name(t: RetailTables, name: str) -> str:
    return fresh_path(t.spark, name).rsplit("/", 1)[1].replace("-", "_")


def bucketed_segments(t: RetailTables) -> DataFrame:
    """Features of customers joined with a table of clusters that is laid out alike."""
    baskets = by_customer(t)
    buckets = bucketed.buckets_for(baskets.count())
    ruled = baskets.select("customer_id").distinct().withColumn("cluster", F.pmod("customer_id", F.lit(5)).cast("int"))
    clusters = bucketed.write_by_customer(ruled, table_name(t, "clusters"), buckets)
    return features.customer_features(baskets).join(clusters, "customer_id")


def csv_files(t: RetailTables) -> str:
    """The order tables as the raw files: categories, catalog, and a folder of receipts for each store."""
    folder = fresh_path(t.spark, "raw")
    text = {"sep": readers.SEPARATOR, "encoding": readers.ENCODING}
    t.categories.write.csv(f"{folder}/Categories.csv", **text)
    code, category = readers.CATALOG_HEADER
    catalog = t.catalog.select(F.col("product_code").alias(code), F.col("category_id").alias(category))
    bad = t.spark.createDataFrame([("no code", "1"), ("7", None)], catalog.schema.fieldNames())
    catalog = catalog.select([F.col(f"`{c}`").cast("string") for c in catalog.columns]).union(bad)
    catalog.write.csv(f"{folder}/ProductCategory.csv", header=True, **text)
    receipts = t.raw_receipts.withColumn("store", F.col("store_id"))
    columns = ["date", "store_id", "customer_id", "products_raw", "store"]
    whole = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    receipts.select(columns).write.partitionBy("store").csv(f"{folder}/Transactions", sep=readers.SEPARATOR, **whole)
    return folder


def lines_from_csv(t: RetailTables) -> DataFrame:
    """Lines of the raw files, all stores in one scan of their folders."""
    folder = csv_files(t)
    stores = [r[0] for r in t.receipts.select("store_id").distinct().collect()]  # a row for each store
    written = [f"{folder}/Transactions/store={s}" for s in sorted(stores)]
    present = [p for p in written if readers.path_exists(t.spark, p)]
    raw = readers.read_receipts_csv(t.spark, present)
    catalog = readers.read_catalog_csv(t.spark, f"{folder}/ProductCategory.csv")
    categories = readers.read_categories(t.spark, f"{folder}/Categories.csv")
    return prepare.build_lines(prepare.categorise(prepare.receipt_items(raw), catalog), categories)


def mixed_width_baskets(t: RetailTables) -> DataFrame:
    """Baskets read back from files of which some have 32-bit numbers."""
    path = fresh_path(t.spark, "baskets")
    narrow = F.year("date") % 2 == 0
    baskets = staged(t.baskets, "baskets")
    as_int = {"customer_id": "int", "store_id": "int", "basket_size": "int", "categories": "array<int>"}
    chosen = baskets.filter(narrow).withColumns({c: F.col(c).cast(kind) for c, kind in as_int.items()})
    for rows in (chosen, baskets.filter(~narrow)):
        rows.write.mode("append").parquet(path)
    return readers.read_baskets(t.spark, path).withColumn("categories", id_list(F.col("categories")))


def refreshed(t: RetailTables) -> Store:
    """A store after a load in batches and the refresh of both models."""
    t, store = few_stores(t), Store(fresh_path(t.spark, "store"))
    incremental.ensure_tables(t.spark, store)
    records = staged(incoming(t), "records")
    late = F.year("date") >= LATER_YEARS[0]
    for batch in (records.filter(~late), records.filter(late)):
        incremental.merge_batch(t.spark, batch, t.categories, store)
    refresh_models(t.spark, store, min_support=SIZE_SUPPORT, min_confidence=SIZE_CONFIDENCE)
    return store


def refreshed_rules(t: RetailTables) -> DataFrame:
    return rule_texts(readers.read_rules(t.spark, refreshed(t).rules))


def refreshed_clusters(t: RetailTables) -> DataFrame:
    """Stored clusters read back, and whether the stored model, read back too, gives every customer the same one."""
    store = refreshed(t)
    clusters = readers.read_clusters(t.spark, store.clusters)
    model = KMeansModel.load(store.kmeans)
    scaled_ = features.scaled_features(clusters.drop("cluster"))
    again = segments.assign_segments(model, scaled_).select("customer_id", F.col("cluster").alias("again"))
    return clusters.join(again, "customer_id").select(
        "customer_id",
        *FEATURE_COLUMNS,
        (F.col("cluster") == F.col("again")).alias("reloaded_agrees"),
        F.col("cluster").between(0, len(model.clusterCenters()) - 1).alias("known_cluster"),
    )


def followed_loads(t: RetailTables) -> Store:
    """A store that three loads went through, with everything that follows a load brought up to date by each."""
    t, store = few_stores(t), Store(fresh_path(t.spark, "store"))
    records = staged(incoming(t), "records")
    first = F.year("date") <= FIRST_YEARS_UNTIL
    increments.load_and_follow(t.spark, records.filter(first), t.categories, store, "first")
    increments.mine_from_stored(t.spark, store, SIZE_SUPPORT, "first")
    # The second load brings half of the lines of its receipts, the third all of them again.
    half = F.filter("categories", lambda c: c % 2 == 0)
    rest = records.filter(~first)
    for load, batch in (("second", rest.withColumn("categories", half)), ("third", rest)):
        increments.load_and_follow(t.spark, batch, t.categories, store, load, SIZE_CONFIDENCE)
    return store


REPORTS: dict[str, Callable[[RetailTables], DataFrame]] = {
    "catalog_clean": catalog_clean,
    "parsed_products": parsed_products,
    "lines": lines_from_text,
    "baskets": baskets_as_text,
    "ingest_report": lambda t: prepare.ingest_report(t.baskets),
    "category_map": lambda t: summary.category_map(t.lines),
    "filtered_lines": lambda t: filters.between(t.lines, **SAMPLE_FILTER),
    "customer_metrics": lambda t: analytics.customer_metrics(t.baskets),
    "correlation_matrix": lambda t: analytics.correlation_matrix(
        analytics.customer_metrics(t.baskets)
    ),
    "customer_features": lambda t: features.customer_features(t.baskets),
    "scaled_features": scaled,
    "k_selection": lambda t: segmentation(t).selection,
    "customer_clusters": lambda t: segmentation(t).clusters,
    "cluster_profiles": lambda t: segments.labelled_profiles(segmentation(t).clusters),
    "cluster_labels": labels,
    "customer_cluster": lambda t: segments.customer_segments(segmentation(t).clusters),
    "pca_projection": projection,
    "pca_scatter": lambda t: segments.pca_scatter(segmentation(t).clusters),
    "cluster_profiles_by_rule": lambda t: segments.labelled_profiles(ruled_clusters(t)),
    "cluster_labels_by_rule": ruled_labels,
    "customer_cluster_by_rule": lambda t: segments.customer_segments(ruled_clusters(t)),
    "one_customer_cluster": lambda t: segments.customer_segments(ruled_clusters(t), SAMPLE_KEY),
    "recommend_with_cluster_by_rule": ruled_recommendations,
    "training_invariants": training_invariants,
    "one_category_rules": one_category_rules,
    "one_category_products": lambda t: rules.products_in_category(t.catalog, SAMPLE_KEY, 20),
    "one_customer_recommendations": one_customer_recommendations,
    "bulk_loaded_report": bulk_loaded_report,
    "bulk_loaded_baskets": bulk_loaded_baskets,
    "frequent_itemsets": lambda t: itemset_texts(type_rules(t)),
    "frequent_itemsets_by_size": lambda t: itemset_texts(size_rules(staged(t.baskets, "baskets"))),
    "association_rules": lambda t: rule_texts(rules.association_rules(type_rules(t))),
    "association_rules_by_size": lambda t: rule_texts(
        rules.association_rules(size_rules(staged(t.baskets, "baskets")))
    ),
    "top_rules": lambda t: rule_texts(rules.top_rules(stored_rules(type_rules(t)))),
    "rules_for_category": lambda t: rule_texts(
        rules.rules_by_category(stored_rules(size_rules(staged(t.baskets, "baskets"))))
    ),
    "rules_for_customer": rules_of_customers,
    "recommend_all": recommendations,
    "recommend_with_cluster": recommendations_with_cluster,
    "products_by_category": lambda t: rules.products_by_category(t.catalog),
    "ingest_lines": ingest_lines,
    "streamed_lines": streamed_lines,
    "deduplicated_stream": deduplicated_stream,
    "late_lines_apart": late_lines_apart,
    "itemsets_after_loads": itemsets_after_loads,
    "rules_after_loads": rules_after_loads,
    "followed_rules": lambda t: rule_texts(readers.read_rules(t.spark, followed_loads(t).rules)),
    "customer_state_features": lambda t: customer_state.features_of(customer_months(t)),
    "customer_state_metrics": lambda t: customer_state.metrics_of(customer_months(t)),
    "customer_state_top": lambda t: customer_state.top_customers_of(customer_months(t)),
    "distinct_counts": distinct_counts,
    "distinct_counts_filtered": sample_counts,
    "heavy_customers": heavy_customers,
    "silhouettes_by_rule": ruled_silhouettes,
    "pca_scatter_by_rule": lambda t: segments.pca_scatter(staged(ruled_clusters(t), "clusters"), SCATTER_POINTS),
    "compacted_lines": lambda t: readers.read_lines(t.spark, small_appends(t)),
    "compacted_partitions": compacted_partitions,
    "bucketed_features": lambda t: features.customer_features(by_customer(t)),
    "bucketed_metrics": lambda t: analytics.customer_metrics(by_customer(t)),
    "bucketed_segments": bucketed_segments,
    "lines_from_csv": lines_from_csv,
    "mixed_width_baskets": mixed_width_baskets,
    "refreshed_rules": refreshed_rules,
    "refreshed_clusters": refreshed_clusters,
}


def all_queries() -> dict[str, Query]:
    """Name of every query, each a function of a session and a data folder."""

    def bound(report: Callable[..., DataFrame], **filter_args) -> Query:
        return lambda spark, folder: report(RetailTables(spark, folder), **filter_args)

    found = {name: bound(report) for name, report in REPORTS.items()}
    for name, report in FILTERED_REPORTS.items():
        found[name] = bound(report)
        found[f"{name}_filtered"] = bound(report, **SAMPLE_FILTER)
    return found
