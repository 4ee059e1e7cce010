import datetime

import pytest
from pyspark.ml.clustering import KMeansModel

from basketry.operators import summary
from basketry.plans import ingest, refresh
from basketry.sources import readers
from basketry.streaming import incremental
from conftest import as_dicts


def write_inputs(folder):
    (folder / "categories.csv").write_text("1|FRUTAS\n2|QUESO\n3|PAN\n")
    (folder / "catalog.csv").write_text(
        "v.Code_pr|v.code\n" + "".join(f"{code}|{code % 4 + 1}\n" for code in range(40))
    )
    for store in (102, 103):
        rows = [
            f"2013-{1 + i % 3:02d}-{1 + i % 28:02d}|{store}|{i % 17}|{i % 40} {(i * 7) % 40}  x"
            for i in range(200)
        ]
        (folder / f"{store}_Tran.csv").write_text("\n".join(rows))


def test_bulk_load_then_models(spark, tmp_path):
    write_inputs(tmp_path)
    store = ingest.Store(str(tmp_path / "store"))
    categories = readers.read_categories(spark, str(tmp_path / "categories.csv"))
    catalog = readers.read_catalog_csv(spark, str(tmp_path / "catalog.csv"))

    def load(*stores):
        raw = readers.read_receipts_csv(spark, [str(tmp_path / f"{s}_Tran.csv") for s in stores])
        return as_dicts(ingest.bulk_load(spark, raw, catalog, categories, store))[0]

    report = load(102, 103)
    assert report["stores"] == "102,103"
    lines = readers.read_lines(spark, store.lines)
    baskets = readers.read_baskets(spark, store.baskets)
    assert lines.count() == report["category_lines"]
    assert baskets.count() == report["transactions"]
    assert readers.read_catalog(spark, store.catalog).count() == 40
    names = {r.category_id: r.category_name for r in summary.category_names(lines).collect()}
    assert names == {1: "FRUTAS", 2: "QUESO", 3: "PAN", 4: None}

    assert readers.register_views(spark, store) == [
        "transactions_long", "transactions_basket", "catalog",
    ]
    (counted,) = spark.sql(
        "SELECT count(*) AS n, count(DISTINCT transaction_id) AS t FROM transactions_long"
        " WHERE store_id = 103"
    ).collect()
    assert 0 < counted.t == baskets.filter("store_id = 103").count() < counted.n

    before = sorted(map(str, as_dicts(lines)))
    again = load(103)
    assert again["stores"] == "103"
    assert sorted(map(str, as_dicts(readers.read_lines(spark, store.lines)))) == before

    empty = ingest.Store(str(tmp_path / "nowhere"))
    assert readers.register_views(spark, empty) == []
    assert refresh.refresh_models(spark, store) == {"segments": True, "rules": True}
    clusters = readers.read_clusters(spark, store.clusters)
    assert clusters.count() == 17
    assert readers.read_rules(spark, store.rules).columns == [
        "antecedent", "consequent", "confidence", "lift", "support",
    ]
    assert KMeansModel.load(store.kmeans).getK() in range(2, 7)
    assert refresh.refresh_models(spark, store) == {"segments": False, "rules": False}
    assert refresh.refresh_models(spark, store, force=True) == {"segments": True, "rules": True}


def test_bulk_load_of_nothing(spark, categories, tmp_path):
    store = ingest.Store(str(tmp_path / "store"))
    raw = spark.createDataFrame(
        [("2013-01-01", 1, 1, "x")],
        "date string, store_id bigint, customer_id bigint, products_raw string",
    )
    catalog = spark.createDataFrame([(1, 1)], "product_code bigint, category_id bigint")
    report = as_dicts(ingest.bulk_load(spark, raw, catalog, categories, store))
    assert report[0]["transactions"] == 0


def receipts(spark, *rows):
    return spark.createDataFrame(list(rows), "date string, store_id bigint, customer_id bigint, products_raw string")


def test_reload_leaves_partitions_in_between_alone(spark, categories, tmp_path):
    store = ingest.Store(str(tmp_path / "store"))
    catalog = spark.createDataFrame([(1, 1), (2, 2)], "product_code bigint, category_id bigint")
    first = receipts(spark, *[("2021-03-01", s, 1, "1 2") for s in (5, 6, 7)])
    ingest.bulk_load(spark, first, catalog, categories, store)
    late = spark.createDataFrame(
        [(datetime.date(2021, 3, 2), 6, 9, [77])], "date date, store_id bigint, customer_id bigint, categories array<bigint>"
    )
    incremental.merge_batch(spark, late, categories, store)

    def files():
        return {str(f): f.read_bytes() for f in tmp_path.glob("store/processed/*/store_id=6/**/*.parquet")}

    before = files()
    again = receipts(spark, ("2021-03-05", 5, 2, "1"), ("2021-03-06", 7, 3, "2"))
    report = as_dicts(ingest.bulk_load(spark, again, catalog, categories, store))[0]
    assert (report["transactions"], report["category_lines"], report["stores"]) == (2, 2, "5,7")
    assert files() == before
    named = readers.read_lines(spark, store.lines).filter("store_id = 6 and category_id = 77")
    assert [r.category_name for r in named.collect()] == ["Cat 77"]


def test_bulk_load_that_broke_off_between_its_tables(spark, categories, tmp_path, monkeypatch):
    store = ingest.Store(str(tmp_path / "store"))
    catalog = spark.createDataFrame([(1, 1), (2, 2)], "product_code bigint, category_id bigint")
    raw = receipts(spark, ("2021-03-01", 5, 1, "1 2"), ("2021-03-02", 5, 2, "1"))
    write = ingest.writers.write_partitioned

    def breaks(df, path, **options):
        if path == store.baskets:
            raise RuntimeError("lost")
        return write(df, path, **options)

    monkeypatch.setattr(ingest.writers, "write_partitioned", breaks)
    with pytest.raises(RuntimeError):
        ingest.bulk_load(spark, raw, catalog, categories, store)
    monkeypatch.undo()
    late = spark.createDataFrame(
        [(datetime.date(2021, 3, 3), 5, 3, [2])], "date date, store_id bigint, customer_id bigint, categories array<bigint>"
    )
    incremental.ensure_tables(spark, store)
    incremental.merge_batch(spark, late, categories, store)
    held = readers.read_baskets(spark, store.baskets).collect()
    assert sorted((r.customer_id, r.categories) for r in held) == [(1, [1, 2]), (2, [1]), (3, [2])]


def test_dates_are_dates(spark, tmp_path):
    write_inputs(tmp_path)
    raw = readers.read_receipts_csv(spark, str(tmp_path / "*_Tran.csv"))
    assert raw.count() == 400
    assert datetime.date.fromisoformat(raw.first().date)


def test_command_line(spark, tmp_path, capsys):
    from basketry.__main__ import main

    data, store = tmp_path / "DataSet", str(tmp_path / "store")
    (data / "Products").mkdir(parents=True)
    (data / "Transactions").mkdir()
    write_inputs(tmp_path)
    (data / "Products" / "Categories.csv").write_text((tmp_path / "categories.csv").read_text())
    (data / "Products" / "ProductCategory.csv").write_text((tmp_path / "catalog.csv").read_text())
    (data / "Transactions" / "102_Tran.csv").write_text((tmp_path / "102_Tran.csv").read_text())
    main(["ingest", "--data", str(data), "--store", store])
    assert "avg_basket_size" in capsys.readouterr().out
    before = readers.read_lines(spark, ingest.Store(store).lines).count()

    (tmp_path / "drop").mkdir()
    (tmp_path / "drop" / "a.json").write_text(
        '{"date": "2013-09-01", "store_id": 102, "customer_id": 99, "categories": [1, 2]}'
    )
    main([
        "load", "--incoming", str(tmp_path / "drop"), "--store", store,
        "--categories", str(data / "Products" / "Categories.csv"),
        "--checkpoint", str(tmp_path / "checkpoint"),
    ])
    assert readers.read_lines(spark, ingest.Store(store).lines).count() == before + 2
    clusters = readers.read_clusters(spark, ingest.Store(store).clusters)
    assert clusters.filter("customer_id = 99").count() == 1
    main(["refresh", "--store", store])
    assert "{'segments': False, 'rules': False}" in capsys.readouterr().out
