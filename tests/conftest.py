import contextlib
import datetime
import io
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

CATEGORIES = [(1, "FRUTAS"), (2, "QUESO"), (3, "PAN"), (4, "CAFE"), (5, "PAN")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("basketry-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def categories(spark):
    """Five categories; two of them share a name."""
    return spark.createDataFrame(CATEGORIES, "category_id bigint, category_name string")


@pytest.fixture
def make_baskets(spark):
    """Baskets from (date, store, customer, [category, ...]) rows, as the loader builds them."""
    from basketry.operators import prepare

    def make(rows):
        flat = [
            (datetime.date.fromisoformat(d), s, c, category)
            for d, s, c, held in rows
            for category in held
        ]
        df = spark.createDataFrame(
            flat, "date date, store_id bigint, customer_id bigint, category_id bigint"
        )
        return prepare.build_baskets(df)

    return make


@pytest.fixture
def plan_of():
    def text(df, mode="formatted"):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain(mode)
        return out.getvalue()

    return text


def as_dicts(df):
    return [row.asDict(recursive=True) for row in df.collect()]
