import itertools
import random
from collections import Counter

from basketry.operators import growth, rules


def plain(held):
    return Counter(s for h in held for n in range(1, len(set(h)) + 1) for s in itertools.combinations(sorted(set(h)), n))


def as_counts(df):
    return {tuple(r["items"]): r["freq"] for r in df.collect()}


def test_mining_counts_frequent_sets_and_their_border(spark):
    rng = random.Random(5)
    held = [[rng.randrange(9) for _ in range(rng.randrange(7))] for _ in range(400)] + [[7, 8], [8, 7, 7]] * 30
    baskets = spark.createDataFrame([(h,) for h in held] + [(None,)], "categories array<bigint>")
    counts, transactions, least = growth.mined(baskets, 0.06)
    every, found = plain(held), as_counts(counts)
    assert (transactions, least) == (len(held), 28)
    assert {s: n for s, n in found.items() if n >= least} == {s: n for s, n in every.items() if n >= least}
    assert all(every[s] == n for s, n in found.items())
    assert as_counts(rules.mine_rules(baskets, 0.06).freqItemsets) == {s: n for s, n in found.items() if n >= least}


def test_only_wanted_sets_are_counted(spark):
    held = [["a", "b", "c", "d"]] * 3 + [["b", "d"], ["d"], []]
    baskets = growth.weighted(spark.createDataFrame([(h,) for h in held], "categories array<string>"))
    sets = spark.createDataFrame([(["b", "d"],), (["a", "c", "d"],), (["d", "e"],), (["c"],)], "items array<string>")
    assert as_counts(growth.counted(baskets, sets)) == {("b", "d"): 4, ("a", "c", "d"): 3, ("c",): 3}
    assert growth.counted(baskets, sets.limit(0)).collect() == []


def test_no_basket_is_shuffled_to_be_counted(spark, plan_of):
    baskets = spark.createDataFrame([([1, 2],), ([2, 3],)], "held array<bigint>").selectExpr("held", "1L AS weight")
    sets = spark.createDataFrame([([1, 2],)], "items array<bigint>")
    sent = [line for line in plan_of(growth.counted(baskets, sets)).split("\n") if "hashpartitioning" in line]
    assert sent and not any("held" in line or "rest" in line for line in sent)


def test_sets_of_one_length_are_counted_in_one_pass(spark, plan_of):
    baskets = spark.createDataFrame([([1, 2, 3],)], "held array<bigint>").selectExpr("held", "1L AS weight")
    sets = spark.createDataFrame([([1, 2, 3],)], "items array<bigint>")
    found = growth.counted(baskets, sets)
    assert len([line for line in plan_of(found, "simple").split("\n") if "Generate posexplode" in line]) == 3
    assert as_counts(found) == {(1, 2, 3): 1}


def test_baskets_stay_where_they_are_whatever_spark_broadcasts(spark, plan_of):
    baskets = spark.createDataFrame([([1, 2, 3],), ([2, 3],)], "held array<bigint>").selectExpr("held", "1L AS weight")
    sets = spark.createDataFrame([([1, 2, 3],), ([2, 3],), ([1, 4],)], "items array<bigint>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = growth.counted(baskets, sets)
        assert "SortMergeJoin" not in plan_of(found, "simple")
        assert as_counts(found) == {(1, 2, 3): 1, (2, 3): 2}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
