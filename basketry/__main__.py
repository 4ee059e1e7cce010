"""Run the jobs from the command line, with python -m or spark-submit.

    python -m basketry ingest --data DataSet --store s3a://bucket/retail
    python -m basketry load --incoming drop/ --categories Categories.csv --store ... --checkpoint ...
    python -m basketry refresh --store s3a://bucket/retail --force
"""

import argparse

from pyspark.sql import SparkSession

from basketry.plans.ingest import Store, bulk_load
from basketry.plans.refresh import refresh_models
from basketry.sources import readers
from basketry.streaming.incremental import start_incremental_load


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="basketry", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)

    ingest = jobs.add_parser("ingest", help="bulk load of the raw CSV files")
    ingest.add_argument("--data", required=True, help="folder with Products/ and Transactions/")

    load = jobs.add_parser("load", help="load what has arrived as JSON, then rebuild the models")
    load.add_argument("--incoming", required=True, help="folder of JSON-lines files")
    load.add_argument("--categories", required=True)
    load.add_argument("--checkpoint", required=True)

    refresh = jobs.add_parser("refresh", help="rebuild missing models, or all of them")
    refresh.add_argument("--force", action="store_true")

    for job in (ingest, load, refresh):
        job.add_argument("--store", required=True, help="base folder of the stored tables")
    return parser


def main(argv: list[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    spark = SparkSession.builder.appName(f"basketry-{args.job}").getOrCreate()
    store = Store(args.store)
    if args.job == "ingest":
        bulk_load(
            spark,
            readers.read_receipts_csv(spark, f"{args.data}/Transactions/*.csv"),
            readers.read_catalog_csv(spark, f"{args.data}/Products/ProductCategory.csv"),
            readers.read_categories(spark, f"{args.data}/Products/Categories.csv"),
            store,
        ).show(truncate=False)
    elif args.job == "load":
        start_incremental_load(
            readers.stream_incoming_json(spark, args.incoming),
            readers.read_categories(spark, args.categories),
            store,
            args.checkpoint,
        ).awaitTermination()
        refresh_models(spark, store, force=True)
    else:
        print(refresh_models(spark, store, force=args.force))


if __name__ == "__main__":
    main()
