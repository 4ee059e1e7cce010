import itertools
import random
from collections import Counter, defaultdict

import pytest

from basketry.operators import prepare, rules
from basketry.session import staged
from conftest import as_dicts

SUPPORT, CONFIDENCE = 0.05, 0.2


@pytest.fixture(scope="module")
def history():
    """Baskets of 30 customers, customer 0 with a third of them."""
    rng = random.Random(11)
    found = {}
    for day in range(1, 29):
        for _ in range(12):
            customer = 0 if rng.random() < 0.35 else rng.randrange(1, 30)
            held = {rng.randrange(1, 8) for _ in range(rng.randrange(1, 5))}
            if 1 in held and rng.random() < 0.8:
                held.add(2)
            found.setdefault((f"2013-01-{day:02d}", rng.randrange(1, 40), customer), set()).update(held)
    return found


@pytest.fixture(scope="module")
def baskets(spark, history):
    flat = [(*key, category) for key, held in history.items() for category in held]
    lines = spark.createDataFrame(
        flat, "date string, store_id bigint, customer_id bigint, category_id bigint"
    )
    return staged(prepare.build_baskets(lines.withColumn("date", lines.date.cast("date"))), "baskets")


@pytest.fixture(scope="module")
def model(baskets):
    return rules.mine_rules(baskets, SUPPORT, CONFIDENCE)


@pytest.fixture(scope="module")
def mined(model):
    return staged(rules.association_rules(model), "rules")


@pytest.fixture(scope="module")
def expected(history):
    """All rules, counted over every subset."""
    counts = Counter()
    for held in history.values():
        for size in range(1, len(held) + 1):
            counts.update(itertools.combinations(sorted(held), size))
    n = len(history)
    frequent = {s: c for s, c in counts.items() if c >= SUPPORT * n}
    found = {}
    for items, count in frequent.items():
        for item in items:
            rest = tuple(i for i in items if i != item)
            if rest and count / frequent[rest] >= CONFIDENCE:
                confidence = count / frequent[rest]
                found[rest, (item,)] = (confidence, confidence / (frequent[item,] / n), count / n)
    return frequent, found


def best_first(found):
    return sorted(
        found,
        key=lambda r: (-round(found[r][1], 9), ",".join(map(str, r[0])), ",".join(map(str, r[1]))),
    )


def test_itemsets(model, expected):
    got = {tuple(r["items"]): r["freq"] for r in as_dicts(rules.frequent_itemsets(model))}
    assert got == expected[0]
    assert max(map(len, got)) >= 3


def test_rules(mined, expected):
    got = {
        (tuple(r["antecedent"]), tuple(r["consequent"])): (r["confidence"], r["lift"], r["support"])
        for r in as_dicts(mined)
    }
    assert set(got) == set(expected[1])
    for rule, values in got.items():
        assert values == pytest.approx(expected[1][rule])


def sides(rows):
    return [(tuple(r["antecedent"]), tuple(r["consequent"])) for r in rows]


def test_top_rules(mined, expected):
    rows = as_dicts(rules.top_rules(mined, 7))
    order = best_first(expected[1])
    assert sides(rows) == order[:7]
    for row, rule in zip(rows, order):
        confidence, lift, _ = expected[1][rule]
        assert row["confidence_pct"] == pytest.approx(confidence * 100, abs=0.06)
        assert row["lift_tier"] == ("strong" if lift >= 3 else "medium" if lift >= 1.5 else "weak")


def test_rules_for_category(mined, expected):
    order = best_first(expected[1])
    every = defaultdict(list)
    for row in as_dicts(rules.rules_by_category(mined).orderBy("category_id", "rank")):
        every[row["category_id"]].append(row)
    for category in range(1, 8):
        best = [r for r in order if category in r[0]][:10]
        assert sides(as_dicts(rules.rules_for_category(mined, category))) == best
        assert sides(every[category]) == best


def test_rules_for_bought(mined, expected):
    order = best_first(expected[1])
    for bought in ([1, 3], [2], [1, 2, 3, 4, 5, 6, 7]):
        best = [r for r in order if set(r[0]) <= set(bought)][:10]
        assert sides(as_dicts(rules.rules_for_bought(mined, bought))) == best
    assert as_dicts(rules.rules_for_bought(mined, [])) == []


def reference_recommendations(bought, found, limit):
    order = best_first(found)
    result = {}
    for customer, held in bought.items():
        used = [r for r in order if set(r[0]) <= held][:limit]
        if used:
            result[customer] = (sorted({c for r in used for c in r[1]} - held), used)
    return result


@pytest.mark.parametrize("limit", [1, 3, 10])
def test_recommendations(baskets, mined, history, expected, limit):
    bought = defaultdict(set)
    for key, held in history.items():
        bought[key[2]] |= held
    wanted = reference_recommendations(bought, expected[1], limit)
    got = {r["customer_id"]: r for r in as_dicts(rules.recommend(baskets, mined, limit=limit))}
    assert set(got) == set(wanted)
    for customer, (categories, used) in wanted.items():
        assert got[customer]["recommended_categories"] == categories
        assert sides(got[customer]["rules_used"]) == used


def test_recommendations_with_cluster_and_since(spark, baskets, mined, history, expected):
    clusters = spark.createDataFrame([(0, 3)], "customer_id bigint, cluster int")
    got = {r["customer_id"]: r for r in as_dicts(rules.recommend(baskets, mined, clusters))}
    assert got[0]["cluster"] == 3 and {r["cluster"] for c, r in got.items() if c} == {None}
    bought = defaultdict(set)
    for key, held in history.items():
        if key[0] >= "2013-01-27":
            bought[key[2]] |= held
    wanted = reference_recommendations(bought, expected[1], 10)
    recent = as_dicts(rules.recommend(baskets, mined, since="2013-01-27"))
    assert {r["customer_id"]: r["recommended_categories"] for r in recent} == {
        c: categories for c, (categories, _) in wanted.items()
    }


def test_recommendations_for_one_customer(baskets, mined):
    every = {r["customer_id"]: r for r in as_dicts(rules.recommend(baskets, mined))}
    assert as_dicts(rules.recommend(baskets, mined, customer_id=0)) == [every[0]]
    assert as_dicts(rules.recommend(baskets, mined, customer_id=999)) == []


def test_cut_comes_before_bought_is_removed(spark, make_baskets):
    table = spark.createDataFrame(
        [([1], [2], 0.9, 5.0, 0.1), ([1], [3], 0.9, 4.0, 0.1)],
        "antecedent array<bigint>, consequent array<bigint>, confidence double, lift double, support double",
    )
    baskets = make_baskets([("2013-01-01", 1, 1, [1, 2])])
    (row,) = as_dicts(rules.recommend(baskets, table, limit=1))
    assert row["recommended_categories"] == [] and len(row["rules_used"]) == 1


def test_repeated_items_do_not_stop_mining(spark):
    baskets = spark.createDataFrame([([1, 1, 2],), ([1, 2, 2],)], "categories array<bigint>")
    found = rules.frequent_itemsets(rules.mine_rules(baskets, 0.5, 0.5))
    assert {tuple(r["items"]): r["freq"] for r in as_dicts(found)} == {(1,): 2, (2,): 2, (1, 2): 2}


def test_products(spark):
    catalog = spark.createDataFrame(
        [(code, 1 if code % 3 else 2) for code in range(1, 91)], "product_code bigint, category_id bigint"
    )
    ones = sorted(c for c in range(1, 91) if c % 3)[:20]
    assert [r.product_code for r in rules.products_in_category(catalog, 1, 20).collect()] == ones
    every = as_dicts(rules.products_by_category(catalog, 20))
    assert sorted(r["product_code"] for r in every if r["category_id"] == 1) == ones
    assert len(every) == 40
