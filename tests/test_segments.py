import datetime
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.ml.clustering import KMeansModel

from basketry.operators import features, segments
from basketry.schemas import FEATURE_COLUMNS
from basketry.session import staged
from conftest import as_dicts


@pytest.fixture(scope="module")
def receipts():
    """Two kinds of customers: frequent and recent, rare and long gone."""
    rng = random.Random(3)
    found = {}
    for customer in range(1, 41):
        frequent = customer <= 20
        for _ in range(rng.randrange(12, 18) if frequent else rng.randrange(1, 4)):
            day = rng.randrange(150, 181) if frequent else rng.randrange(0, 40)
            date = datetime.date(2013, 1, 1) + datetime.timedelta(days=day)
            held = {rng.randrange(1, 30) for _ in range(rng.randrange(1, 6))}
            found.setdefault((date, rng.randrange(1, 3), customer), set()).update(held)
    return found


@pytest.fixture(scope="module")
def table(spark, receipts):
    from basketry.operators import prepare

    flat = [(*key, category) for key, held in receipts.items() for category in held]
    lines = spark.createDataFrame(
        flat, "date date, store_id bigint, customer_id bigint, category_id bigint"
    )
    return staged(features.customer_features(prepare.build_baskets(lines)), "features")


@pytest.fixture(scope="module")
def trained(table):
    return segments.train_segments(table)


def test_features(table, receipts):
    newest = max(key[0] for key in receipts)
    per_customer = defaultdict(list)
    for key, held in receipts.items():
        per_customer[key[2]].append((key[0], held))
    got = {r["customer_id"]: r for r in as_dicts(table)}
    assert set(got) == set(per_customer)
    for customer, visits in per_customer.items():
        lines = sum(len(held) for _, held in visits)
        assert got[customer] == {
            "customer_id": customer,
            "frequency": len(visits),
            "total_categories_bought": lines,
            "unique_categories": len(set().union(*(held for _, held in visits))),
            "avg_basket_size": lines / len(visits),
            "recency_days": (newest - max(day for day, _ in visits)).days,
            "active_days": len({day for day, _ in visits}),
        }


def test_scaled_features_have_unit_deviation(table):
    vectors = [r.scaled_features.toArray() for r in features.scaled_features(table).collect()]
    for i in range(len(FEATURE_COLUMNS)):
        column = [v[i] for v in vectors]
        assert statistics.mean(column) == pytest.approx(0, abs=1e-9)
        assert statistics.stdev(column) == pytest.approx(1)


def test_selection_keeps_the_best_silhouette(trained):
    rows = as_dicts(trained.selection.orderBy("k"))
    assert [r["k"] for r in rows] == [2, 3, 4, 5, 6]
    assert [r["k"] for r in rows if r["selected"]] == [2]
    assert max(rows, key=lambda r: r["silhouette"])["k"] == 2
    assert trained.model.getK() == 2


def test_every_customer_has_one_cluster(trained, table):
    rows = as_dicts(trained.clusters)
    assert len({r["customer_id"] for r in rows}) == len(rows) == table.count()
    kinds = {(r["customer_id"] <= 20, r["cluster"]) for r in rows}
    assert len(kinds) == 2


def test_profiles_and_labels(trained, table):
    rows = as_dicts(segments.labelled_profiles(trained.clusters))
    assert sum(r["customer_count"] for r in rows) == table.count()
    by_label = {r["label"]: r for r in rows}
    assert set(by_label) == set(segments.SEGMENT_LABELS[:2])
    best, second = (by_label[label] for label in segments.SEGMENT_LABELS[:2])
    assert best["avg_frequency"] > second["avg_frequency"]
    assert best["avg_recency_days"] < second["avg_recency_days"]


def test_labels_of_many_clusters(spark):
    profiles = spark.createDataFrame(
        [(i, 10.0 - i, float(i)) for i in range(9)] + [(9, 2.0, 8.0)],
        "cluster_id int, avg_frequency double, avg_recency_days double",
    )
    rows = as_dicts(segments.cluster_labels(profiles).orderBy("rank"))
    # Clusters 8 and 9 score alike: the higher id comes first; the pool's last name repeats.
    assert [r["cluster_id"] for r in rows] == [0, 1, 2, 3, 4, 5, 6, 7, 9, 8]
    assert [r["label"] for r in rows] == segments.SEGMENT_LABELS + [segments.SEGMENT_LABELS[-1]] * 2


def test_customer_lookup(trained):
    one = as_dicts(segments.customer_segments(trained.clusters, 5))
    assert len(one) == 1 and one[0]["label"] == segments.SEGMENT_LABELS[0]
    assert as_dicts(segments.customer_segments(trained.clusters, 999)) == []
    assert segments.customer_segments(trained.clusters).count() == trained.clusters.count()


def test_training_is_repeatable(trained, table):
    again = segments.train_segments(table)
    assert sorted(map(str, as_dicts(again.clusters))) == sorted(map(str, as_dicts(trained.clusters)))


def test_model_survives_saving(trained, table, tmp_path):
    path = str(tmp_path / "kmeans")
    trained.model.write().overwrite().save(path)
    loaded = segments.assign_segments(KMeansModel.load(path), features.scaled_features(table))
    assert sorted(map(str, as_dicts(loaded))) == sorted(map(str, as_dicts(trained.clusters)))


def test_projection_matches_numpy(trained, table):
    import numpy as np

    rows = as_dicts(table.orderBy("customer_id"))
    x = np.array([[float(r[c]) for c in segments.PCA_COLUMNS] for r in rows])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    _, axes = np.linalg.eigh(z.T @ z)
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(2)])
    got = as_dicts(segments.pca_projection(table).orderBy("customer_id"))
    np.testing.assert_allclose([[r["pca_x"], r["pca_y"]] for r in got], z @ axes, atol=1e-4)


def test_scatter_samples_the_same_customers_again(trained):
    first = as_dicts(segments.pca_scatter(trained.clusters, max_points=10))
    again = as_dicts(segments.pca_scatter(trained.clusters, max_points=10))
    assert len(first) == 10
    assert sorted(r["customer_id"] for r in first) == sorted(r["customer_id"] for r in again)
    everyone = {r["customer_id"]: r for r in as_dicts(segments.pca_scatter(trained.clusters))}
    assert len(everyone) == trained.clusters.count()
    assert all(everyone[r["customer_id"]] == r for r in first)


def test_customers_must_differ(make_baskets):
    for customers in (1, 3):
        baskets = make_baskets([("2013-01-01", 1, c, [1, 2]) for c in range(customers)])
        with pytest.raises(ValueError):
            segments.train_segments(features.customer_features(baskets))


def test_two_kinds_of_customers(make_baskets):
    """Fewer different customers than clusters asked for."""
    rows = [("2013-01-01", 1, c, [1, 2]) for c in range(3)] + [("2013-03-01", 1, 9, [1, 2, 3])]
    result = segments.train_segments(features.customer_features(make_baskets(rows)))
    assert sorted(r["customer_count"] for r in as_dicts(segments.labelled_profiles(result.clusters))) == [1, 3]
    tried = {r["k"]: r for r in as_dicts(result.selection)}
    assert sorted(tried) == [2, 3, 4, 5, 6] and tried[2]["selected"] and tried[2]["skipped"] is None
    assert all(tried[k]["silhouette"] is None and tried[k]["skipped"] for k in range(3, 7))
