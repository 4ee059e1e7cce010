import datetime
import hashlib

import pytest

from basketry.operators import prepare
from conftest import as_dicts

D = datetime.date


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(
        [
            ("2013-01-01", 102, 1, "10 11  x 10"),   # double blank, bad token, repeated code
            ("2013-01-01", 102, 1, "12"),            # same day, store and customer: merges
            ("2013-01-02", 103, 2, "99 11"),         # 99 is not in the catalog
            ("2013-01-02", 103, 3, "x y"),           # no numeric token
            ("2013-01-02", 103, 4, None),
            ("2013-01-02", 103, 5, "99"),            # only unknown products
            ("no date", 103, 6, "10"),
            ("2013-02-03", 102, 7, " 13 99999999999999999999 1.5 "),
        ],
        "date string, store_id bigint, customer_id bigint, products_raw string",
    )


@pytest.fixture
def catalog(spark):
    # 11 is in two categories; category 9 is outside the dimension.
    return spark.createDataFrame(
        [(10, 1), (11, 2), (11, 3), (12, 1), (13, 9)], "product_code bigint, category_id bigint"
    )


def test_parse_receipts(raw):
    parsed = {r["customer_id"]: r for r in as_dicts(prepare.parse_receipts(raw).orderBy("products"))}
    assert sorted(parsed) == [1, 2, 5, 7]
    assert parsed[2]["products"] == [99, 11]
    assert parsed[7]["products"] == [13]
    assert parsed[7]["year_month"] == "2013-02"
    expected = hashlib.sha256(b"2013-02-03|102|7").hexdigest()[:16]
    assert parsed[7]["transaction_id"] == expected


def test_items_are_the_parsed_products(raw):
    items = [
        (r["date"], r["customer_id"], r["product_code"]) for r in as_dicts(prepare.receipt_items(raw))
    ]
    parsed = [
        (r["date"], r["customer_id"], code)
        for r in as_dicts(prepare.parse_receipts(raw))
        for code in r["products"]
    ]
    assert sorted(items) == sorted(parsed)


def test_lines_and_baskets(raw, catalog, categories):
    categorised = prepare.categorise(prepare.receipt_items(raw), catalog)
    lines = as_dicts(prepare.build_lines(categorised, categories))
    assert sorted((r["customer_id"], r["category_id"], r["category_name"]) for r in lines) == [
        (1, 1, "FRUTAS"), (1, 2, "QUESO"), (1, 3, "PAN"),
        (2, 2, "QUESO"), (2, 3, "PAN"),
        (7, 9, None),
    ]
    baskets = {r["customer_id"]: r for r in as_dicts(prepare.build_baskets(categorised))}
    assert baskets[1]["categories"] == [1, 2, 3]
    assert baskets[1]["basket_size"] == 3
    assert set(baskets) == {1, 2, 7}


def test_lines_of_baskets_equal_lines(raw, catalog, categories):
    categorised = prepare.categorise(prepare.receipt_items(raw), catalog)
    direct = prepare.build_lines(categorised, categories)
    again = prepare.lines_of(prepare.build_baskets(categorised), categories)
    assert sorted(map(str, as_dicts(direct))) == sorted(map(str, as_dicts(again)))
    rebuilt = prepare.build_baskets(direct)
    assert sorted(map(str, as_dicts(rebuilt))) == sorted(
        map(str, as_dicts(prepare.build_baskets(categorised)))
    )


def test_ingest_report(make_baskets):
    baskets = make_baskets([
        ("2013-01-05", 3, 1, [1, 2]), ("2013-01-01", 1, 1, [1]), ("2013-02-01", 3, 2, [1, 2, 3, 3]),
    ])
    assert as_dicts(prepare.ingest_report(baskets)) == [{
        "transactions": 3, "category_lines": 6, "min_date": D(2013, 1, 1),
        "max_date": D(2013, 2, 1), "stores": "1,3", "avg_basket_size": 2.0,
    }]


def test_ingest_report_of_nothing(make_baskets):
    report = as_dicts(prepare.ingest_report(make_baskets([("2013-01-01", 1, 1, [1])]).limit(0)))
    assert report[0]["transactions"] == 0 and report[0]["avg_basket_size"] is None
