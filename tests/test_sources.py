import datetime
import json

import pytest

from basketry import schemas
from basketry.operators import prepare
from basketry.session import shared_folder
from basketry.sources import readers, writers
from conftest import as_dicts


def test_categories_are_latin1_without_header(spark, tmp_path):
    path = tmp_path / "categories.csv"
    path.write_bytes("1|LIMÓN\n2|PIÑA\n".encode("iso-8859-1"))
    assert as_dicts(readers.read_categories(spark, str(path)).orderBy("category_id")) == [
        {"category_id": 1, "category_name": "LIMÓN"}, {"category_id": 2, "category_name": "PIÑA"},
    ]


def test_catalog_with_dotted_header(spark, tmp_path):
    path = tmp_path / "catalog.csv"
    path.write_text("v.Code_pr|v.code\n10|1\nx|2\n11|\n12|3\n")
    assert as_dicts(readers.read_catalog_csv(spark, str(path)).orderBy("product_code")) == [
        {"product_code": 10, "category_id": 1}, {"product_code": 12, "category_id": 3},
    ]


def test_receipts_of_several_stores(spark, tmp_path):
    for store in (32, 33):
        (tmp_path / f"{store}.csv").write_text(f"2013-01-01|{store}|7|1 2 3\n2013-01-02|{store}|8|\n")
    paths = [str(tmp_path / "32.csv"), str(tmp_path / "33.csv")]
    rows = as_dicts(readers.read_receipts_csv(spark, paths).orderBy("store_id", "date"))
    assert [r["store_id"] for r in rows] == [32, 32, 33, 33]
    assert rows[0]["products_raw"] == "1 2 3" and rows[1]["products_raw"] is None


def test_incoming_json_is_validated(spark, tmp_path):
    path = tmp_path / "batch.json"
    records = [
        {"date": "2021-03-14", "store_id": 31, "customer_id": 1, "categories": [2, 5]},
        {"date": "2021-03-14", "store_id": 31, "customer_id": 2, "categories": []},
        {"date": "2021-03-14", "store_id": 31, "categories": [1]},
        {"date": "not a date", "store_id": 31, "customer_id": 4, "categories": [1]},
    ]
    path.write_text("\n".join(json.dumps(r) for r in records) + "\nno json at all\n")
    incoming = readers.read_incoming_json(spark, str(path))
    assert as_dicts(readers.valid_incoming(incoming)) == [{
        "date": datetime.date(2021, 3, 14), "store_id": 31, "customer_id": 1, "categories": [2, 5],
    }]
    assert readers.rejected_incoming(incoming).count() == 4


def test_incoming_json_array(spark, tmp_path):
    path = tmp_path / "batch.json"
    path.write_text(json.dumps([
        {"date": "2021-03-14", "store_id": 1, "customer_id": c, "categories": [c]} for c in (1, 2)
    ], indent=1))
    incoming = readers.read_incoming_json(spark, str(path), multi_line=True)
    assert readers.valid_incoming(incoming).count() == 2


def test_wrapped_batch(spark, tmp_path):
    record = {"date": "2021-03-14", "store_id": 1, "customer_id": 7, "categories": [1, 2]}
    (tmp_path / "a.json").write_text(json.dumps({"transactions": [record, record]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"transactions": []}))
    rows = as_dicts(readers.valid_incoming(readers.read_transaction_batch(spark, str(tmp_path))))
    assert rows == [{**record, "date": datetime.date(2021, 3, 14)}] * 2


def test_partitioned_round_trip_and_dynamic_overwrite(spark, make_baskets, categories, tmp_path):
    path = str(tmp_path / "baskets")
    first = make_baskets([("2013-01-05", 1, 1, [1, 2]), ("2013-02-05", 1, 1, [3])])
    writers.write_partitioned(first, path)
    # Only the January partition is replaced.
    second = make_baskets([("2013-01-06", 1, 2, [4])])
    seen = writers.write_partitioned(second, path, measures={"n": prepare.F.count("*")})
    assert seen == {"n": 1}
    rows = as_dicts(readers.read_baskets(spark, path).orderBy("date"))
    assert [(r["customer_id"], r["categories"], r["year_month"]) for r in rows] == [
        (2, [4], "2013-01"), (1, [3], "2013-02"),
    ]


def test_files_of_both_integer_widths(spark, tmp_path):
    path = str(tmp_path / "mixed")
    narrow = "transaction_id string, date date, customer_id int, categories array<int>, basket_size int"
    row = [("a", datetime.date(2013, 1, 1), 1, [1, 2], 2)]
    spark.createDataFrame(row, narrow).write.parquet(f"{path}/store_id=1/year_month=2013-01")
    spark.createDataFrame(row, narrow.replace("int", "bigint")).write.parquet(
        f"{path}/store_id=2/year_month=2013-01"
    )
    rows = as_dicts(readers.read_baskets(spark, path).orderBy("store_id"))
    assert [(r["store_id"], r["customer_id"], r["categories"]) for r in rows] == [
        (1, 1, [1, 2]), (2, 1, [1, 2]),
    ]


def test_read_partitions(spark, make_baskets, tmp_path):
    path = str(tmp_path / "baskets")
    writers.write_partitioned(
        make_baskets([("2013-01-05", s, 1, [1]) for s in (1, 2)] + [("2013-02-05", 1, 1, [3])]), path
    )
    found = readers.read_partitions(spark, path, schemas.BASKETS, [(1, "2013-01"), (7, "2013-09")])
    assert [(r.store_id, r.year_month) for r in found.collect()] == [(1, "2013-01")]
    assert readers.read_partitions(spark, path, schemas.BASKETS, [(7, "2013-01")]).count() == 0


class Conf(dict):
    def set(self, key, value):
        self[key] = value


class Session:
    def __init__(self, **conf):
        self.conf = Conf({key.replace("_", "."): value for key, value in conf.items()})


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(ValueError):
        shared_folder(Session(spark_master="yarn"))
    with pytest.raises(ValueError):
        shared_folder(Session(spark_master="local-cluster[2,1,1024]"))
    configured = Session(spark_master="yarn", spark_checkpoint_dir="hdfs:///shared/")
    assert shared_folder(configured) == "hdfs:///shared"


def test_busy_month_is_written_by_several_tasks(spark, tmp_path):
    """One store's month holds nearly all rows; other partitions get one file each."""
    path = str(tmp_path / "lines")
    hot = spark.range(40000).selectExpr(
        "sha2(cast(id AS string), 256) AS transaction_id", "date'2013-01-05' AS date",
        "id AS customer_id", "id % 50 AS category_id", "sha2(cast(id AS string), 256) AS category_name",
        "1L AS store_id", "'2013-01' AS year_month",
    )
    cold = hot.limit(20).selectExpr(
        "transaction_id", "date", "customer_id", "category_id", "category_name",
        "customer_id % 5 + 2 AS store_id", "year_month",
    )
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(advisory)
    spark.conf.set(advisory, "500KB")
    try:
        writers.write_partitioned(hot.unionByName(cold), path)
    finally:
        spark.conf.set(advisory, before)
    files = readers.read_lines(spark, path).inputFiles()
    per_store = {}
    for file in files:
        store = file.split("store_id=")[1].split("/")[0]
        per_store[store] = per_store.get(store, 0) + 1
    assert per_store.pop("1") > 2
    assert set(per_store.values()) == {1}
    assert readers.read_lines(spark, path).count() == 40020
