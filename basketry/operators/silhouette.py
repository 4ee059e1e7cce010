"""Silhouettes and costs of several clusterings of the same points, in closed form.

The mean squared distance of a point to a cluster follows from the cluster's number of
points, their sum and the sum of their squares.  So one aggregation over all points
serves every clustering, and a second one adds up the points' silhouettes.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum_of(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)


def _dot(x: Column, y: Column) -> Column:
    return _sum_of(F.zip_with(x, y, lambda a, b: a * b))


def _each(points: DataFrame, clusterings: list[str]) -> DataFrame:
    """A row for every point and clustering; ``points`` holds ``at``, an array of doubles, and the cluster columns."""
    found = F.array(*[F.struct(F.lit(c).alias("clustering"), F.col(c).cast("bigint").alias("cluster")) for c in clusterings])
    rows = points.select("at", _dot(F.col("at"), F.col("at")).alias("square"), F.inline(found))
    return rows.filter(F.col("cluster").isNotNull())


def cluster_sums(points: DataFrame, clusterings: list[str], dimensions: int) -> DataFrame:
    """(clustering, clusters): number, mean, mean square and spread of every cluster; a row for each clustering."""
    sums = [F.sum(F.col("at")[i]).alias(f"s{i}") for i in range(dimensions)]
    counted = _each(points, clusterings).groupBy("clustering", "cluster")
    counted = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("square").alias("squares"), *sums)
    mean = F.array(*[F.col(f"s{i}") / F.col("n") for i in range(dimensions)])
    of_cluster = counted.select("clustering", "cluster", "n", mean.alias("mean"), "squares").withColumns({
        "mean_square": F.col("squares") / F.col("n"),
        "spread": F.greatest(F.col("squares") - F.col("n") * _dot(F.col("mean"), F.col("mean")), F.lit(0.0)),
    })
    parts = F.struct("cluster", "n", "mean", "mean_square", "spread")
    return of_cluster.groupBy("clustering").agg(F.sort_array(F.collect_list(parts)).alias("clusters"))


def scores(points: DataFrame, clusterings: list[str], dimensions: int) -> DataFrame:
    """(clustering, clusters, silhouette, cost) with squared Euclidean distances.

    A point alone in its cluster has silhouette 0, and so have all where there is one cluster.  The cost is the sum of
    squared distances to the clusters' means.
    """
    # One row for each clustering, with a few numbers for each cluster.
    sums = F.broadcast(cluster_sums(points, clusterings, dimensions))
    rows = _each(points, clusterings).join(sums, "clustering")

    def distance(c: Column) -> Column:
        """Mean squared distance to the cluster's points; rounding may take it below 0."""
        return F.greatest(F.col("square") + c["mean_square"] - 2 * _dot(F.col("at"), c["mean"]), F.lit(0.0))

    own = F.filter("clusters", lambda c: c["cluster"] == F.col("cluster"))[0]
    others = F.filter("clusters", lambda c: c["cluster"] != F.col("cluster"))
    rows = rows.select(
        "clustering",
        own["n"].alias("n"),
        # The point itself is no neighbour of its own.
        (distance(own) * F.try_divide(own["n"], own["n"] - 1)).alias("inside"),
        F.array_min(F.transform(others, distance)).alias("outside"),
    )
    inside, outside = F.col("inside"), F.col("outside")
    value = F.when(
        (F.col("n") > 1) & outside.isNotNull() & (F.greatest(inside, outside) > 0),
        (outside - inside) / F.greatest(inside, outside),
    ).otherwise(0.0)
    silhouettes = rows.groupBy("clustering").agg(F.avg(value).alias("silhouette"))
    costs = sums.select(
        "clustering",
        F.size("clusters").cast("bigint").alias("clusters"),
        _sum_of(F.transform("clusters", lambda c: c["spread"])).alias("cost"),
    )
    return costs.join(silhouettes, "clustering").select("clustering", "clusters", "silhouette", "cost")
