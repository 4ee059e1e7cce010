"""Frequent category sets, association rules and recommendations."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.arrays import is_subset
from basketry.functions.labels import lift_tier
from basketry.functions.stats import rounded
from basketry.operators import containment, growth
from basketry.session import staged

# Mining thresholds and list lengths.
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.3
RULES_PER_KEY = 10
TOP_RULES = 20
PRODUCTS_SHOWN = 50
# Rules up to this number are broadcast.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class MinedRules:
    """The frequent sets (items, freq) of so many baskets; the rules follow from them."""

    freqItemsets: DataFrame
    transactions: int
    min_confidence: float

    @property
    def associationRules(self) -> DataFrame:
        return rules_of_counts(self.freqItemsets, self.transactions, self.min_confidence)


def mine_rules(
    baskets: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE
) -> MinedRules:
    """The frequent sets of the baskets' categories, by growth of prefixes.

    ``baskets`` is read once.  Spark ML's FP-Growth gives the same sets and rules; it ships trees between tasks, and
    where hardly two baskets are alike these hold as many nodes as the baskets have categories.
    """
    counts, transactions, least = growth.mined(baskets, min_support)
    return MinedRules(counts.filter(F.col("freq") >= least), transactions, min_confidence)


def rules_of_counts(frequent: DataFrame, transactions: int, min_confidence: float) -> DataFrame:
    """Association rules with one consequent each, from the counts (items, freq) of all frequent sets."""
    whole = frequent.filter(F.size("items") > 1).select("items", "freq", F.explode("items").alias("item"))
    sides = whole.select("freq", F.array_except("items", F.array("item")).alias("antecedent"), F.array("item").alias("consequent"))
    of_antecedent = frequent.select(F.col("items").alias("antecedent"), F.col("freq").alias("antecedent_freq"))
    of_consequent = frequent.select(F.col("items").alias("consequent"), F.col("freq").alias("consequent_freq"))
    confidence = F.col("freq") / F.col("antecedent_freq")
    share = F.col("consequent_freq") / F.lit(float(transactions))
    return (
        sides.join(of_antecedent, "antecedent")
        .join(of_consequent, "consequent")
        .select(
            "antecedent",
            "consequent",
            confidence.alias("confidence"),
            (confidence / share).alias("lift"),
            (F.col("freq") / F.lit(float(transactions))).alias("support"),
        )
        .filter(F.col("confidence") >= min_confidence)
    )


def frequent_itemsets(model: MinedRules) -> DataFrame:
    return model.freqItemsets.select(F.sort_array("items").alias("items"), "freq")


def association_rules(model: MinedRules) -> DataFrame:
    return model.associationRules.select(
        F.sort_array("antecedent").alias("antecedent"),
        F.sort_array("consequent").alias("consequent"),
        "confidence",
        "lift",
        "support",
    )


def by_lift() -> list:
    """Highest lift first.

    A => B and B => A have the same lift up to the last bit, so lift is rounded
    before it is compared and ties are settled by the sides of the rule.
    """
    return [
        F.desc(rounded(F.col("lift"), 9)),
        F.array_join(F.col("antecedent").cast("array<string>"), ","),
        F.array_join(F.col("consequent").cast("array<string>"), ","),
    ]


def displayed(rules: DataFrame) -> DataFrame:
    """Rules rounded for display, with confidence in percent and the lift tier."""
    return rules.withColumns({
        "confidence_pct": rounded(F.col("confidence") * 100, 1),
        "lift_tier": lift_tier(F.col("lift")),
        "support": rounded(F.col("support"), 4),
        "confidence": rounded(F.col("confidence"), 4),
        "lift": rounded(F.col("lift"), 4),
    })


def top_rules(rules: DataFrame, limit: int = TOP_RULES) -> DataFrame:
    return displayed(rules.orderBy(*by_lift()).limit(limit))


def rules_for_category(rules: DataFrame, category_id, limit: int = RULES_PER_KEY) -> DataFrame:
    """Best rules whose antecedent holds the category."""
    matching = rules.filter(F.array_contains("antecedent", category_id))
    return displayed(matching.orderBy(*by_lift()).limit(limit))


def rules_by_category(rules: DataFrame, limit: int = RULES_PER_KEY) -> DataFrame:
    """``rules_for_category`` for every category at once, with the rank of each rule."""
    ranking = Window.partitionBy("category_id").orderBy(*by_lift())
    ranked = (
        rules.withColumn("category_id", F.explode("antecedent"))
        .withColumn("rank", F.row_number().over(ranking).cast("bigint"))
        .filter(F.col("rank") <= limit)
    )
    return displayed(ranked)


def rules_for_bought(rules: DataFrame, category_ids: list, limit: int = RULES_PER_KEY) -> DataFrame:
    """Best rules whose whole antecedent is among the given categories."""
    if not category_ids:
        return displayed(rules.limit(0))
    bought = F.array(*[F.lit(c) for c in category_ids])
    return displayed(
        rules.filter(is_subset(F.col("antecedent"), bought)).orderBy(*by_lift()).limit(limit)
    )


def bought_categories(baskets: DataFrame, since=None) -> DataFrame:
    """Distinct categories of every customer, of all time unless ``since`` is given.

    Pairs are made distinct before they are gathered, so a customer with most of
    the baskets arrives as one short list.
    """
    recent = baskets if since is None else baskets.filter(F.col("date") >= F.lit(since))
    return (
        recent.select("customer_id", F.explode("categories").alias("category_id"))
        .distinct()
        .groupBy("customer_id")
        .agg(F.sort_array(F.collect_list("category_id")).alias("bought"))
    )


def rules_for_customers(
    bought: DataFrame, rules: DataFrame, limit: int = RULES_PER_KEY
) -> DataFrame:
    """The best ``limit`` rules of every customer whose antecedent they bought whole.

    The order of rules is the same for everybody, so rules are numbered once, and
    an antecedent stands for all its rules' numbers.  Customers with the same
    history share one; a history meets an antecedent at its rarest item only.
    The numbers of what a history holds whole are put in order and cut inside
    its row, and a rule's sides are fetched for the few that remain.
    """
    keyed = with_history(bought)
    return keyed.join(rules_for_histories(keyed, rules, limit), "history").drop("history")


def with_history(bought: DataFrame) -> DataFrame:
    """``bought`` (customer_id, bought) with a hash that customers with the same history share."""
    return bought.withColumn("history", F.sha2(F.array_join("bought", ","), 256))


def rules_for_histories(keyed: DataFrame, rules: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` rules of every history, with their rank.

    Rules of up to ``BROADCAST_RULES`` are broadcast, whatever Spark's own threshold is: then nothing but the
    histories is shuffled.
    """
    histories = keyed.groupBy("history").agg(F.first("bought").alias("bought"))
    numbered = best_per_antecedent(rules, limit).withColumn(
        "position", F.row_number().over(Window.orderBy(*by_lift()))
    )
    numbered = staged(numbered, "numbered")
    few = numbered.count() <= BROADCAST_RULES
    sent = F.broadcast if few else lambda table: table
    antecedents = numbered.groupBy("antecedent").agg(
        F.min("position").alias("number"), F.collect_list("position").alias("positions")
    )
    applying = containment.held_sets(
        histories.select(F.col("history").alias("holder"), F.col("bought").alias("held")),
        antecedents.select("number", F.col("antecedent").alias("items")),
        few=few,
    )
    in_order = F.array_sort(F.flatten(F.collect_list("positions")))
    return (
        applying.join(sent(antecedents.select("number", "positions")), "number")
        .groupBy(F.col("holder").alias("history"))
        .agg(F.slice(in_order, 1, limit).alias("positions"))
        .select("history", F.posexplode("positions").alias("rank", "position"))
        .withColumn("rank", (F.col("rank") + 1).cast("bigint"))
        .join(sent(numbered), "position")
        .drop("position")
    )


def best_per_antecedent(rules: DataFrame, limit: int) -> DataFrame:
    """The rules that can be among somebody's best ``limit``.

    Rules with the same antecedent apply to the same customers and stand in the
    same order for all of them, so past the first ``limit`` none is ever used.
    """
    ranking = Window.partitionBy("antecedent").orderBy(*by_lift())
    return (
        rules.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= limit).drop("rank")
    )


def recommend(
    baskets: DataFrame,
    rules: DataFrame,
    clusters: DataFrame | None = None,
    limit: int = RULES_PER_KEY,
    since=None,
    customer_id: int | None = None,
) -> DataFrame:
    """Recommendations for every customer, or one, to whom at least one rule applies.

    The rules are cut to the best ``limit`` before what the customer already
    bought is taken out, so the list may be empty although rules were used.
    """
    if customer_id is not None:
        baskets = baskets.filter(F.col("customer_id") == customer_id)
    used = F.sort_array(
        F.collect_list(
            F.struct("rank", "antecedent", "consequent", "support", "confidence", "lift")
        )
    )
    suggested = F.array_sort(F.array_distinct(F.flatten(F.collect_list("consequent"))))
    keyed = with_history(bought_categories(baskets, since))
    # A history's list is made once, before customers are joined to it.
    lists = rules_for_histories(keyed, rules, limit).groupBy("history")
    result = keyed.join(lists.agg(suggested.alias("suggested"), used.alias("rules_used")), "history").select(
        "customer_id", F.array_except("suggested", "bought").alias("recommended_categories"), "rules_used"
    )
    if clusters is None:
        return result
    return result.join(clusters.select("customer_id", "cluster"), "customer_id", "left").select(
        "customer_id", "cluster", "recommended_categories", "rules_used"
    )


def products_in_category(catalog: DataFrame, category_id, limit: int = PRODUCTS_SHOWN) -> DataFrame:
    """First products of a category by code."""
    return (
        catalog.filter(F.col("category_id") == category_id)
        .select("product_code", "category_id")
        .orderBy("product_code")
        .limit(limit)
    )


def products_by_category(catalog: DataFrame, limit: int = PRODUCTS_SHOWN) -> DataFrame:
    """``products_in_category`` for every category at once.

    The row-number limit is also applied before the shuffle, so a category that
    holds most of the catalog sends no more rows than any other.
    """
    ranking = Window.partitionBy("category_id").orderBy("product_code")
    return (
        catalog.select("product_code", "category_id")
        .withColumn("rank", F.row_number().over(ranking).cast("bigint"))
        .filter(F.col("rank") <= limit)
        .drop("rank")
    )
