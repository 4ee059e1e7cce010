"""Summary and analytics reports against plain Python on a small skewed table."""

import datetime
import random
import statistics
from collections import Counter, defaultdict

import pytest

from basketry.operators import analytics, filters, prepare, summary
from conftest import CATEGORIES, as_dicts

NAMES = dict(CATEGORIES)
START, END, STORE = "2013-02-01", "2013-03-15", 2


@pytest.fixture(scope="module")
def receipts():
    """Distinct receipts; customer 0 and category 1 hold far more than their share."""
    rng = random.Random(7)
    found = {}
    for _ in range(400):
        day = datetime.date(2013, 1, 1) + datetime.timedelta(days=rng.randrange(120))
        customer = 0 if rng.random() < 0.4 else rng.randrange(1, 20)
        held = {1} if rng.random() < 0.4 else set()
        held |= {rng.randrange(1, 7) for _ in range(rng.randrange(1, 5))}
        found.setdefault((day, rng.randrange(1, 4), customer), set()).update(held)
    return found


@pytest.fixture(scope="module")
def baskets(spark, receipts):
    flat = [(*key, category) for key, held in receipts.items() for category in held]
    return prepare.build_baskets(
        spark.createDataFrame(
            flat, "date date, store_id bigint, customer_id bigint, category_id bigint"
        )
    ).cache()


@pytest.fixture(scope="module")
def lines(baskets, categories):
    return prepare.lines_of(baskets, categories).cache()


def chosen(receipts, filtered):
    if not filtered:
        return receipts
    low, high = datetime.date.fromisoformat(START), datetime.date.fromisoformat(END)
    return {k: v for k, v in receipts.items() if low <= k[0] <= high and k[1] == STORE}


FILTERS = {False: {}, True: {"start_date": START, "end_date": END, "store_id": STORE}}


@pytest.mark.parametrize("filtered", [False, True])
def test_kpis(lines, baskets, receipts, filtered):
    kept = chosen(receipts, filtered)
    args = FILTERS[filtered]
    assert summary.total_lines(lines, **args).first().value == sum(map(len, kept.values()))
    assert summary.transaction_count(baskets, **args).first().value == len(kept)
    assert summary.unique_customers(baskets, **args).first().value == len({k[2] for k in kept})


@pytest.mark.parametrize("filtered", [False, True])
def test_top_categories(lines, receipts, filtered):
    kept = chosen(receipts, filtered)
    volume = Counter(c for held in kept.values() for c in held)
    best = sorted(volume.items(), key=lambda item: (-item[1], item[0]))[:3]
    got = as_dicts(summary.top_categories(lines, limit=3, **FILTERS[filtered]).orderBy("rank_by_volume"))
    assert [(r["category_id"], r["volume"]) for r in got] == best
    assert [r["category_name"] for r in got] == [NAMES.get(c) for c, _ in best]
    assert all(r["frequency"] == r["volume"] for r in got)


@pytest.mark.parametrize("filtered", [False, True])
def test_top_customers(baskets, receipts, filtered):
    kept = chosen(receipts, filtered)
    count, held = Counter(), defaultdict(set)
    for (_, _, customer), categories in kept.items():
        count[customer] += 1
        held[customer] |= categories
    best = sorted(count, key=lambda c: (-count[c], c))[:5]
    got = as_dicts(summary.top_customers(baskets, limit=5, **FILTERS[filtered]))
    by_transactions = sorted(got, key=lambda r: r["rank_by_transactions"])
    assert [(r["customer_id"], r["transaction_count"], r["unique_categories"]) for r in by_transactions] == [
        (c, count[c], len(held[c])) for c in best
    ]
    by_diversity = sorted(got, key=lambda r: r["rank_by_diversity"])
    assert [r["customer_id"] for r in by_diversity] == sorted(
        best, key=lambda c: (-len(held[c]), -count[c], c)
    )


def test_peak_days(baskets, receipts):
    expected = Counter(((k[0].weekday() + 1) % 7, k[0].day) for k in receipts)
    cells = {
        (r["day_of_week"], r["day_of_month"]): r for r in as_dicts(summary.peak_days_grid(baskets))
    }
    assert len(cells) == 217
    busiest = max(expected.values())
    for cell, row in cells.items():
        assert row["transaction_count"] == expected.get(cell, 0)
        assert row["intensity"] == expected.get(cell, 0) / busiest
    assert {(r["day_of_week"], r["day_of_month"]): r["transaction_count"]
            for r in as_dicts(summary.peak_days(baskets))} == expected


def test_empty_grid_has_no_intensity(baskets):
    rows = as_dicts(summary.peak_days_grid(baskets, start_date="2030-01-01"))
    assert len(rows) == 217 and {r["intensity"] for r in rows} == {0.0}


def test_shares(lines, receipts):
    rows = as_dicts(summary.category_share(lines))
    assert sum(r["volume"] for r in rows) == sum(map(len, receipts.values()))
    assert abs(sum(r["share_pct"] for r in rows) - 100) < 0.1
    rollup = as_dicts(summary.category_share_rollup(lines, top=2).orderBy("position"))
    assert [r["share_pct"] for r in rollup[:2]] == [r["share_pct"] for r in rows[:2]]
    assert rollup[2]["label"] == "Otros"
    assert rollup[2]["share_pct"] == round(sum(r["share_pct"] for r in rows[2:]), 2)
    assert len(as_dicts(summary.category_share_rollup(lines, top=10))) == len(rows)


def test_category_map(lines):
    labels = {r["category_id"]: r["display_label"] for r in as_dicts(summary.category_map(lines))}
    assert labels[1] == "Frutas" and labels[6] == "Cat. 6"
    assert {r.category_id: r.category_name for r in summary.category_names(lines).collect()}[6] is None


@pytest.mark.parametrize("granularity", ["day", "week", "month"])
@pytest.mark.parametrize("filtered", [False, True])
def test_time_series(baskets, receipts, granularity, filtered):
    def period(day):
        if granularity == "week":
            return day - datetime.timedelta(days=day.weekday())
        return day.replace(day=1) if granularity == "month" else day

    transactions, volume = Counter(), Counter()
    for key, held in chosen(receipts, filtered).items():
        transactions[period(key[0])] += 1
        volume[period(key[0])] += len(held)
    got = as_dicts(analytics.time_series(baskets, granularity, **FILTERS[filtered]))
    assert [(r["period"], r["transactions"], r["category_lines"]) for r in got] == [
        (p, transactions[p], volume[p]) for p in sorted(transactions)
    ]


def quartiles(values):
    if len(values) == 1:
        return values * 3
    return statistics.quantiles(values, n=4, method="inclusive")


@pytest.mark.parametrize("dimension", ["category", "customer"])
@pytest.mark.parametrize("filtered", [False, True])
def test_boxplot(baskets, categories, receipts, dimension, filtered):
    sizes = defaultdict(list)
    for key, held in chosen(receipts, filtered).items():
        # Categories 3 and 5 share a name; 6 has none.
        labels = {NAMES[c] for c in held if c in NAMES} if dimension == "category" else {str(key[2])}
        for label in labels:
            sizes[label].append(len(held))
    got = as_dicts(analytics.boxplot(baskets, categories, dimension, 50, **FILTERS[filtered]))
    assert {r["label"] for r in got} == set(sizes)
    for row in got:
        values = sorted(sizes[row["label"]])
        assert [row["min_val"], row["max_val"]] == [values[0], values[-1]]
        assert [row["q1"], row["median"], row["q3"]] == pytest.approx(quartiles(values))
        assert row["min_val"] <= row["q1"] <= row["median"] <= row["q3"] <= row["max_val"]
    assert [(-r["median"], r["label"]) for r in got] == sorted((-r["median"], r["label"]) for r in got)
    assert len(as_dicts(analytics.boxplot(baskets, categories, dimension, 2))) == 2


def test_customer_metrics(baskets, receipts):
    sizes, held = defaultdict(list), defaultdict(set)
    for key, categories in receipts.items():
        sizes[key[2]].append(len(categories))
        held[key[2]] |= categories
    got = {r["customer_id"]: r for r in as_dicts(analytics.customer_metrics(baskets))}
    assert set(got) == set(sizes)
    for customer, row in got.items():
        assert row["frequency"] == len(sizes[customer])
        assert row["unique_categories"] == len(held[customer])
        assert row["avg_basket_size_line_weighted"] == pytest.approx(
            sum(s * s for s in sizes[customer]) / sum(sizes[customer])
        )


def test_correlations(baskets):
    metrics = analytics.customer_metrics(baskets)
    rows = as_dicts(metrics)
    got = {(r["feature_x"], r["feature_y"]): r["correlation"]
           for r in as_dicts(analytics.correlation_matrix(metrics))}
    assert len(got) == 9
    for (x, y), value in got.items():
        expected = statistics.correlation([r[x] for r in rows], [r[y] for r in rows])
        assert value == pytest.approx(expected, abs=6e-4)


def test_correlation_of_a_constant_is_null(make_baskets):
    one = analytics.customer_metrics(make_baskets([("2013-01-01", 1, 1, [1, 2])]))
    assert {r["correlation"] for r in as_dicts(analytics.correlation_matrix(one))} == {None}


def test_argument_checks(baskets, lines, categories):
    for limit in (0, 51):
        with pytest.raises(ValueError):
            summary.top_categories(lines, limit=limit)
        with pytest.raises(ValueError):
            summary.top_customers(baskets, limit=limit)
        with pytest.raises(ValueError):
            analytics.boxplot(baskets, categories, limit=limit)
    with pytest.raises(ValueError):
        analytics.time_series(baskets, "year")
    with pytest.raises(ValueError):
        analytics.boxplot(baskets, categories, "store")


def test_filter_accepts_dates_and_texts(lines):
    by_text = filters.between(lines, START, END).count()
    by_date = filters.between(
        lines, datetime.date.fromisoformat(START), datetime.date.fromisoformat(END)
    ).count()
    assert 0 < by_text == by_date < filters.between(lines).count()
