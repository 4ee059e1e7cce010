"""Customer behaviour features and their scaling."""

from pyspark.ml.feature import StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.summary import unique_categories
from basketry.schemas import FEATURE_COLUMNS


def customer_features(baskets: DataFrame) -> DataFrame:
    """Frequency, volume, diversity, basket size, recency and active days per customer.

    Days are combined first, so the customer step adds up one short row per
    customer and day; both sides of the join are already placed by customer.
    Recency counts from the newest date of the whole table, a scalar subquery.
    """
    reference_date = baskets.agg(F.max("date")).scalar()
    per_day = baskets.groupBy("customer_id", "date").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("basket_size").alias("lines")
    )
    activity = per_day.groupBy("customer_id").agg(
        F.sum("transactions").alias("frequency"),
        F.sum("lines").alias("total_categories_bought"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("active_days"),
    )
    return (
        activity.join(unique_categories(baskets), "customer_id", "left")
        .withColumns({
            "avg_basket_size": F.col("total_categories_bought") / F.col("frequency"),
            "recency_days": F.datediff(reference_date, F.col("last_date")).cast("bigint"),
        })
        .select("customer_id", *FEATURE_COLUMNS)
        .fillna(0, FEATURE_COLUMNS)
    )


def fit_scaler(features: DataFrame) -> StandardScalerModel:
    """Mean and sample deviation of every feature."""
    scaler = StandardScaler(
        inputCol="raw_features", outputCol="scaled_features", withMean=True, withStd=True
    )
    return scaler.fit(assembled(features))


def assembled(features: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol="raw_features").transform(features)


def scaled_features(features: DataFrame) -> DataFrame:
    """Features with their z-scores in the vector column ``scaled_features``."""
    return fit_scaler(features).transform(assembled(features)).drop("raw_features")
