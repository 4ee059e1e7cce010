"""Raw CSV and JSON inputs, and the stored Parquet tables."""

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from basketry import schemas
from basketry.functions.receipts import whole_number

# Separator, encoding and the header of the product catalog.
SEPARATOR = "|"
ENCODING = "iso-8859-1"
CATALOG_HEADER = ("v.Code_pr", "v.code")
CORRUPT = "_corrupt_record"


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=schemas.CATEGORIES, sep=SEPARATOR, encoding=ENCODING)


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, sep=SEPARATOR, encoding=ENCODING)
    return clean_catalog(raw)


def clean_catalog(raw: DataFrame) -> DataFrame:
    """Rename the dotted header, read both columns as numbers, drop rows that are none."""
    code, category = (F.col(f"`{name}`") for name in CATALOG_HEADER)
    return raw.select(
        whole_number(code).alias("product_code"),
        whole_number(category).alias("category_id"),
    ).dropna()


def read_receipts_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Receipts of any number of stores in one scan; folders and globs work too."""
    paths = paths if isinstance(paths, str) else list(paths)
    return spark.read.csv(paths, schema=schemas.RAW_RECEIPTS, sep=SEPARATOR)


def incoming_schema() -> StructType:
    return StructType([*schemas.INCOMING.fields, StructField(CORRUPT, StringType())])


def read_incoming_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Incoming transactions as JSON lines, or as one JSON array with ``multi_line``."""
    return spark.read.schema(incoming_schema()).option(
        "columnNameOfCorruptRecord", CORRUPT
    ).json(path, multiLine=multi_line)


def read_transaction_batch(spark: SparkSession, path: str) -> DataFrame:
    """Incoming transactions wrapped as ``{"transactions": [...]}``, one or more such files.

    A batch without a single transaction contributes nothing.
    """
    wrapped = StructType([StructField("transactions", ArrayType(schemas.INCOMING))])
    return spark.read.schema(wrapped).json(path, multiLine=True).select(F.inline("transactions"))


def stream_incoming_json(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Incoming JSON-lines files as a stream."""
    reader = spark.readStream.schema(incoming_schema()).option("columnNameOfCorruptRecord", CORRUPT)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(folder)


def valid_incoming(incoming: DataFrame) -> DataFrame:
    """Records with every field present and at least one category."""
    valid = F.col("date").isNotNull() & F.col("store_id").isNotNull()
    valid &= F.col("customer_id").isNotNull() & (F.size("categories") > 0)
    if CORRUPT in incoming.columns:
        valid &= F.col(CORRUPT).isNull()
    return incoming.filter(valid).select(*schemas.INCOMING.fieldNames())


def rejected_incoming(incoming: DataFrame) -> DataFrame:
    """What ``valid_incoming`` leaves out, for a quarantine table."""
    complete = F.col("date").isNotNull() & F.col("store_id").isNotNull()
    complete &= F.col("customer_id").isNotNull() & (F.coalesce(F.size("categories"), F.lit(0)) > 0)
    if CORRUPT in incoming.columns:
        complete &= F.col(CORRUPT).isNull()
    return incoming.filter(~complete)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return read_stored(spark, path, schemas.LINES)


def read_baskets(spark: SparkSession, path: str) -> DataFrame:
    return read_stored(spark, path, schemas.BASKETS)


def read_stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Stored table with the given types, whatever integer width each file was written in.

    Parquet is read with 64-bit integers; the vectorised reader widens 32-bit
    files as it goes, so files of both widths may lie side by side.
    """
    return spark.read.schema(schema).parquet(path)


def read_batches(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Lines written in a folder for each micro-batch, of all of them or of those before one."""
    schema = StructType([*schemas.LINES.fields, StructField("batch", LongType())])
    stored = read_stored(spark, path, schema)
    return (stored if before is None else stored.filter(F.col("batch") < before)).drop("batch")


def read_partitions(
    spark: SparkSession, path: str, schema: StructType, partitions: list[tuple[int, str]]
) -> DataFrame:
    """The given (store, month) partitions; empty when none of them exists.

    Only their folders are listed, so the cost of a small batch does not grow with the
    number of partitions the table has gathered.  Months that name the same stores are one
    scan: a plan with a scan for each month takes longer to make than to run.
    """
    stores_of: dict[str, list[str]] = {}
    for store, month in partitions:
        stores_of.setdefault(month, []).append(str(store))
    months_of: dict[tuple[str, ...], list[str]] = {}
    for month, stores in sorted(stores_of.items()):
        months_of.setdefault(tuple(sorted(set(stores))), []).append(month)
    found = spark.createDataFrame([], schema)
    for stores, months in months_of.items():
        folders = f"{path}/store_id={{{','.join(stores)}}}/year_month={{{','.join(months)}}}"
        try:
            of_months = spark.read.schema(schema).option("basePath", path).parquet(folders)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            found = found.unionByName(of_months)
    return found


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return read_stored(spark, path, schemas.CATALOG)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return read_stored(spark, path, schemas.RULES)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return read_stored(spark, path, schemas.CLUSTERS)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder at the path; any other trouble is raised."""
    try:
        spark.read.schema("nothing int").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether files or folders match the path, of whatever format."""
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


# Names under which the stored tables can be queried with SQL.
VIEWS = {
    "transactions_long": ("lines", schemas.LINES),
    "transactions_basket": ("baskets", schemas.BASKETS),
    "catalog": ("catalog", schemas.CATALOG),
}


def register_views(spark: SparkSession, store) -> list[str]:
    """Make the stored tables that exist available to ``spark.sql``; returns their names."""
    found = []
    for name, (table, schema) in VIEWS.items():
        path = getattr(store, table)
        if table_exists(spark, path):
            read_stored(spark, path, schema).createOrReplaceTempView(name)
            found.append(name)
    return found
