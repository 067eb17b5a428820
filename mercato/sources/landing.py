"""CSV landing: explicit-schema reads of the nine source files.

The source export is CSV with a header row, doubled quotes inside quoted text,
unquoted empty fields meaning NULL and quoted empty fields meaning the empty
string. Any malformed value aborts the load (FAILFAST), as the source
database's COPY does. The review file has quoted newlines, which Spark's own
reader only handles with a whole file in one task; here its lines are read by
many tasks and put together to records by counting quotes (see
:func:`multiline_records`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.schemas import MULTILINE_TABLES, RAW_FILES, RAW_SCHEMAS

# A quoted empty field comes back as this marker and is turned into ''.
EMPTY_MARKER = "\u0001EMPTY\u0001"


class MissingInputError(FileNotFoundError):
    def __init__(self, missing: list[str]):
        super().__init__("missing CSV(s): " + ", ".join(missing))
        self.missing = missing


def check_inputs(spark: SparkSession, directory: str,
                 files: dict[str, str] = RAW_FILES) -> None:
    """Raise MissingInputError naming every expected input that is absent.

    An input may be a single file or a folder of CSV parts (large tables
    arrive split so that every part is read by its own task).
    """
    from mercato.sources.fs import exists

    missing = [f for f in files.values() if not exists(spark, f"{directory.rstrip('/')}/{f}")]
    if missing:
        raise MissingInputError(missing)


_FORMAT = {"quote": '"', "escape": '"', "nullValue": "", "emptyValue": EMPTY_MARKER, "mode": "FAILFAST"}


def multiline_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, first) for every CSV record of the files under ``path``.

    A line begins a record if an even number of quotes stands before it in its
    file (an escaped quote is two). Quotes are counted per split; the splits'
    totals (one row per split) give every split its starting parity and the
    record that its first lines may continue. ``first`` marks a file's header.

    A record of one line, whose next line in the split begins another, stays
    where its split was counted; only the lines of longer records and the last
    line of a split are shuffled by record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.withColumn("quotes", quotes)
    here = Window.partitionBy("file", "split").orderBy("at")
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    parity = (lines.groupBy("file", "split").agg(F.sum("quotes").alias("q"))
              .select("file", "split", F.coalesce(F.sum("q").over(earlier), F.lit(0)).alias("q_before")))
    before = F.coalesce(F.sum("quotes").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = (lines.join(parity, ["file", "split"])
              .withColumn("starts", F.when((F.col("q_before") + before) % 2 == 0, 1).otherwise(0))
              .withColumn("nth", F.sum("starts").over(here))
              .withColumn("single", (F.col("starts") == 1)
                          & F.coalesce(F.lead("starts").over(here) == 1, F.lit(False))))
    opened = marked.groupBy("file", "split").agg(F.max("nth").alias("n")).select(
        "file", "split", F.last(F.when(F.col("n") > 0, F.struct("split", F.col("n").alias("nth"))),
                                ignorenulls=True).over(earlier).alias("open"))
    own = F.struct("split", "nth")
    keyed = marked.where(~F.col("single")).join(opened, ["file", "split"]).withColumn(
        "key", F.when(F.col("nth") > 0, own).otherwise(F.col("open")))
    records = keyed.groupBy("file", "key").agg(
        F.array_sort(F.collect_list(F.struct("split", "at", "value"))).alias("parts"))

    def record(text, at_split, nth):
        return ["file", F.rtrim(text, F.lit("\r")).alias("record"),
                ((F.col(at_split) == 0) & (F.col(nth) == 1)).alias("first")]

    return (marked.where("single").select(*record(F.col("value"), "split", "nth"))
            .unionByName(records.select(*record(F.array_join("parts.value", "\n"), "key.split", "key.nth"))))


def _read_multiline(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    header = ",".join(schema.names)
    records = multiline_records(spark, path).where("record <> ''")
    # The header must name the schema's columns.
    plain = F.replace("record", F.lit('"'), F.lit(""))
    kept = records.where(~F.col("first") | F.when(plain == header, F.lit(False)).otherwise(
        F.raise_error(F.concat(F.lit("unexpected CSV header in "), "file"))))
    options = {**_FORMAT, "multiLine": "true"}
    return kept.select(F.from_csv("record", schema.simpleString().removeprefix("struct<")[:-1]
                                  .replace(":", " "), options).alias("r")).select("r.*")


def read_csv_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    schema = RAW_SCHEMAS[table]
    if table in MULTILINE_TABLES:
        df = _read_multiline(spark, path, schema)
    else:
        # enforceSchema off: the header must name the schema's columns
        df = spark.read.schema(schema).options(**_FORMAT, header="true", enforceSchema="false").csv(path)
    cols = [F.when(F.col(f.name) == EMPTY_MARKER, F.lit("")).otherwise(F.col(f.name))
            .alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in schema.fields]
    return df.select(*cols)


# A compressed part is read by one task, so its rows are bounded.
PART_ROWS = 500_000


def write_csv_table(df: DataFrame, directory: str, table: str) -> None:
    """Export one landing table as a folder of CSV parts in the source's format.

    Parts are gzip files of at most PART_ROWS rows: a large table becomes many
    parts, which are read side by side.
    """
    columns = [f.name for f in RAW_SCHEMAS[table].fields]
    (df.select(*columns).write.option("header", True).option("quote", '"').option("escape", '"')
       .option("nullValue", "").option("emptyValue", '""')
       .option("compression", "gzip").option("maxRecordsPerFile", PART_ROWS)
       .csv(f"{directory.rstrip('/')}/{RAW_FILES[table]}"))


def read_raw_csv(spark: SparkSession, directory: str,
                 files: dict[str, str] = RAW_FILES) -> dict[str, DataFrame]:
    """The nine landing tables from ``directory`` after the presence check."""
    check_inputs(spark, directory, files)
    return {table: read_csv_table(spark, f"{directory.rstrip('/')}/{name}", table)
            for table, name in files.items()}
