"""What must not grow with the tables."""

import datetime

from basketry.operators import distinct_cube
from basketry.plans import bucketed, registry


def test_buckets_hold_about_as_many_rows_whatever_the_table():
    for rows in (0, 1, 150_000, 1_500_000, 9_000_000, 90_000_000):
        buckets = bucketed.buckets_for(rows)
        assert buckets >= 8 and rows / buckets <= bucketed.BUCKET_ROWS


def test_a_cell_of_few_customers_is_small(make_baskets):
    cube = distinct_cube.customer_cube(make_baskets([("2021-01-01", 1, 40_000 * c, [1]) for c in range(5)]))
    assert dict(cube.dtypes)["customers"] == "bigint"
    cells = cube.groupBy("date").agg({"transactions": "sum"}).first()
    assert tuple(cells) == (datetime.date(2021, 1, 1), 5) and distinct_cube.counted(cube).first()[0] == 5


def test_baskets_are_built_once_for_the_invariants(make_baskets):
    class Tables:
        built = 0

        @property
        def baskets(self):
            self.built += 1
            return make_baskets([(f"2021-01-{1 + c % 28:02d}", 1, c % 17, list(range(1 + c % 5))) for c in range(60)])

    tables = Tables()
    found = registry.training_invariants(tables).first()
    assert tables.built == 1
    assert (found["customers"], found["without_cluster"], found["not_nearest"]) == (17, 0, 0)
