import math

import pytest
from pyspark.sql import functions as F

from basketry.functions import arrays, labels, receipts, stats


def evaluate(spark, **columns):
    return spark.range(1).select(*[c.alias(name) for name, c in columns.items()]).first()


@pytest.mark.parametrize("value, digits", [(1.005, 2), (40.675, 2), (0.125, 2), (3.0, 1), (0.0, 4)])
def test_rounding_follows_the_double(spark, value, digits):
    expected = math.floor(value * 10**digits + 0.5) / 10**digits
    assert evaluate(spark, r=stats.rounded(F.lit(value), digits)).r == expected


@pytest.mark.parametrize(
    "text, codes",
    [
        ("1 2 3", [1, 2, 3]),
        ("  7   8 ", [7, 8]),
        ("+5 -6 1.5 1e3 0x1 ١", [5, -6]),
        ("\t9 10", [9, 10]),
        ("99999999999999999999 4", [4]),
        ("", []),
    ],
)
def test_product_codes(spark, text, codes):
    assert evaluate(spark, c=receipts.product_codes(F.lit(text))).c == codes


def test_labels(spark):
    got = evaluate(
        spark,
        name=labels.display_label(F.lit("PAN BLANCO"), F.lit(3)),
        empty=labels.display_label(F.lit(""), F.lit(3)),
        none=labels.display_label(F.lit(None).cast("string"), F.lit(3)),
        stored=labels.name_or_id(F.lit("PAN"), F.lit(3)),
        fallback=labels.name_or_id(F.lit(None).cast("string"), F.lit(3)),
        tiers=F.concat_ws(",", *[labels.lift_tier(F.lit(x)) for x in (3.0, 2.9, 1.5, 1.4)]),
        ids=labels.id_list(F.array(F.lit(10), F.lit(9), F.lit(1))),
    )
    assert got.asDict() == {
        "name": "Pan blanco", "empty": "Cat. 3", "none": "Cat. 3", "stored": "PAN",
        "fallback": "Cat 3", "tiers": "strong,medium,medium,weak", "ids": "1,9,10",
    }


def test_subset(spark):
    whole, none = F.array(F.lit(1), F.lit(2)), F.array().cast("array<int>")
    got = evaluate(
        spark,
        inside=arrays.is_subset(F.array(F.lit(2)), whole),
        outside=arrays.is_subset(F.array(F.lit(2), F.lit(3)), whole),
        empty=arrays.is_subset(none, whole),
    )
    assert got.asDict() == {"inside": True, "outside": False, "empty": False}


def test_dates(spark):
    got = evaluate(
        spark,
        good=receipts.iso_date(F.lit("2013-01-05")).cast("string"),
        loose=receipts.iso_date(F.lit("2013-1-5")).cast("string"),
        bad=receipts.iso_date(F.lit("05/01/2013")).cast("string"),
    )
    assert got.asDict() == {"good": "2013-01-05", "loose": "2013-01-05", "bad": None}
