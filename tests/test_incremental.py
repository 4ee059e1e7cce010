import datetime
import glob
import json
import uuid

import pytest

from basketry.operators import prepare
from basketry.plans.ingest import Store
from basketry.sources import readers, writers
from basketry.streaming import incremental
from conftest import as_dicts

RECORDS = [
    {"date": "2021-03-14", "store_id": 31, "customer_id": 1, "categories": [2, 5, 5]},
    {"date": "2021-03-14", "store_id": 31, "customer_id": 1, "categories": [1]},
    {"date": "2021-03-15", "store_id": 32, "customer_id": 2, "categories": [3, 60]},
    {"date": "2021-04-01", "store_id": 31, "customer_id": 3, "categories": [4]},
    {"date": "2021-04-02", "store_id": 31, "customer_id": 4, "categories": []},
]


@pytest.fixture
def store(tmp_path):
    return Store(str(tmp_path / "store"))


@pytest.fixture
def drop(tmp_path):
    folder = tmp_path / "incoming"
    folder.mkdir()

    def write(name, records):
        (folder / name).write_text("\n".join(json.dumps(r) for r in records))
        return str(folder)

    write.folder = str(folder)
    return write


def load(spark, folder, categories, store, checkpoint=None, **reader):
    stream = readers.stream_incoming_json(spark, folder, **reader)
    checkpoint = checkpoint or f"{store.base}/checkpoint-{uuid.uuid4().hex}"
    query = incremental.start_incremental_load(stream, categories, store, checkpoint)
    query.awaitTermination()


def content(spark, store):
    lines = sorted(map(str, as_dicts(readers.read_lines(spark, store.lines))))
    baskets = sorted(map(str, as_dicts(readers.read_baskets(spark, store.baskets))))
    return lines, baskets


def batch_build(spark, categories, records, store):
    incoming = spark.createDataFrame(
        [
            (datetime.date.fromisoformat(r["date"]), r["store_id"], r["customer_id"], r["categories"])
            for r in records
        ],
        "date date, store_id bigint, customer_id bigint, categories array<bigint>",
    )
    lines = incremental.incoming_lines(incoming, categories)
    writers.write_partitioned(lines, store.lines)
    writers.write_partitioned(prepare.build_baskets(lines), store.baskets)
    return content(spark, store)


@pytest.fixture
def wanted(spark, categories, tmp_path):
    return batch_build(spark, categories, RECORDS, Store(str(tmp_path / "bulk")))


def test_incoming_lines(spark, categories, drop):
    folder = drop("a.json", RECORDS)
    rows = as_dicts(
        incremental.incoming_lines(readers.read_incoming_json(spark, folder), categories)
    )
    assert sorted((r["customer_id"], r["category_id"], r["category_name"]) for r in rows) == [
        (1, 1, "FRUTAS"), (1, 2, "QUESO"), (1, 5, "PAN"),
        (2, 3, "PAN"), (2, 60, "Cat 60"), (3, 4, "CAFE"),
    ]


def test_replay_and_two_drops_equal_one_build(spark, categories, store, drop, tmp_path, wanted):
    checkpoint = str(tmp_path / "checkpoint")
    load(spark, drop("a.json", RECORDS[:2]), categories, store, checkpoint)
    load(spark, drop("b.json", RECORDS[2:]), categories, store, checkpoint)
    assert content(spark, store) == wanted
    # The same files again, without memory of having seen them, one per batch.
    load(spark, drop.folder, categories, store, max_files=1)
    assert content(spark, store) == wanted


def test_extra_category_of_a_stored_receipt(spark, categories, store, drop):
    load(spark, drop("a.json", RECORDS[:2]), categories, store)
    more = {**RECORDS[0], "categories": [2, 4]}
    load(spark, drop("b.json", [more]), categories, store)
    (basket,) = as_dicts(readers.read_baskets(spark, store.baskets))
    assert basket["categories"] == [1, 2, 4, 5] and basket["basket_size"] == 4
    assert readers.read_lines(spark, store.lines).count() == 4


def test_crash_between_the_two_writes(spark, categories, store, drop, monkeypatch, wanted):
    folder = drop("a.json", RECORDS)
    batch = readers.read_incoming_json(spark, folder)
    incremental.ensure_tables(spark, store)
    real = writers.write_partitioned

    def failing(df, path, **kwargs):
        if path == store.baskets:
            raise RuntimeError("lost")
        return real(df, path, **kwargs)

    monkeypatch.setattr(writers, "write_partitioned", failing)
    with pytest.raises(RuntimeError):
        incremental.merge_batch(spark, batch, categories, store)
    monkeypatch.undo()
    assert readers.read_lines(spark, store.lines).count() == 6
    assert incremental.merge_batch(spark, batch, categories, store) == 0
    assert content(spark, store) == wanted


def test_merge_counts_new_lines_and_leaves_other_partitions(spark, categories, store, drop):
    batch = readers.read_incoming_json(spark, drop("a.json", RECORDS))
    incremental.ensure_tables(spark, store)
    assert incremental.merge_batch(spark, batch, categories, store) == 6
    # A batch of July must not touch August's files.

    def august_files():
        files = readers.read_baskets(spark, store.baskets).inputFiles()
        return sorted(f for f in files if "year_month=2021-04" in f)

    before = august_files()
    extra = spark.createDataFrame(
        [(datetime.date(2021, 3, 14), 31, 9, [1, 2])],
        "date date, store_id bigint, customer_id bigint, categories array<bigint>",
    )
    assert incremental.merge_batch(spark, extra, categories, store) == 2
    assert before == august_files() and len(before) == 1
    assert incremental.merge_batch(spark, extra.limit(0), categories, store) == 0


def test_deduplicated_stream(spark, categories, drop, tmp_path, wanted):
    path, checkpoint = str(tmp_path / "lines"), str(tmp_path / "checkpoint")

    def run():
        stream = readers.stream_incoming_json(spark, drop.folder)
        incremental.start_deduplicated_lines(stream, categories, path, checkpoint).awaitTermination()
        return sorted(map(str, as_dicts(readers.read_batches(spark, path))))

    drop("a.json", RECORDS + RECORDS[:2])
    assert run() == wanted[0]
    # Resent while still inside the watermark delay of the newest record.
    drop("b.json", [RECORDS[3]])
    assert run() == wanted[0]


def test_invalid_records_are_kept_apart(spark, categories, store, drop):
    load(spark, drop("a.json", RECORDS), categories, store)
    rejected = as_dicts(spark.read.json(f"{store.rejected}/*"))
    assert [r["customer_id"] for r in rejected] == [4]


def test_box_plot_names_categories_as_stored(spark, categories, store, drop):
    from basketry.operators import analytics, summary

    load(spark, drop("a.json", RECORDS[:3]), categories, store)
    names = summary.category_names(readers.read_lines(spark, store.lines))
    boxes = analytics.boxplot(readers.read_baskets(spark, store.baskets), names, dimension="category")
    assert "Cat 60" in {r["label"] for r in as_dicts(boxes)}


def test_stream_with_state_writes_one_file_for_a_small_partition(spark, categories, drop, tmp_path):
    # Forty customers, so that every shuffle partition holds some of the month's lines.
    drop("a.json", [
        {"date": f"2013-08-{1 + c % 28:02d}", "store_id": 1, "customer_id": c, "categories": [1, 2]} for c in range(40)
    ])
    stream = readers.stream_incoming_json(spark, drop.folder)
    path = str(tmp_path / "lines")
    incremental.start_deduplicated_lines(stream, categories, path, str(tmp_path / "checkpoint")).awaitTermination()
    assert len(glob.glob(f"{path}/**/store_id=1/year_month=2013-08/*.parquet", recursive=True)) == 1


def test_months_of_the_same_stores_are_one_scan(spark, tmp_path, plan_of):
    path, schema = str(tmp_path / "table"), "n bigint, store_id bigint, year_month string"
    rows = [(k, store, month) for k, (store, month) in enumerate((s, f"2020-0{m}") for s in (1, 2, 3) for m in range(1, 7))]
    spark.createDataFrame(rows, schema).write.partitionBy("store_id", "year_month").parquet(path)
    struct = spark.createDataFrame([], schema).schema
    named = [(s, f"2020-0{m}") for s in (1, 3) for m in range(1, 6)] + [(2, "2020-06"), (1, "2021-01"), (9, "2020-02")]
    found = readers.read_partitions(spark, path, struct, named)
    assert sorted(tuple(r) for r in found.collect()) == [r for r in rows if r[1:] in named]
    whole = readers.read_partitions(spark, path, struct, [(s, f"2020-0{m}") for s in (1, 3) for m in range(1, 7)])
    assert len([line for line in plan_of(whole, "simple").split("\n") if "FileScan" in line]) == 1
    assert readers.read_partitions(spark, path, struct, [(7, "2020-01")]).collect() == []
