"""Tables of a directory: one file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.sources.csv_records import read_records

FORMATS = ("parquet", "csv", "json")


def load_table(
    spark: SparkSession,
    directory: str,
    name: str,
    fmt: str = "parquet",
    schema: T.StructType | str | None = None,
    line_breaks: bool = True,
    loose_quotes: bool = False,
) -> DataFrame:
    """Load ``directory/name.fmt``; the schema is read or inferred unless given.

    Inferring the schema of CSV or JSON reads the whole table once more, so
    large ones should come with a schema. CSV cells keep their blanks, quotes
    are doubled and may hold line breaks, as ``write_csv`` writes them; many tasks
    share a large file all the same, after a scan that counts its quotes.
    ``line_breaks=False`` saves that scan where no cell holds a line break.
    ``loose_quotes=True`` is for files with quotes inside unquoted cells or with lone
    carriage returns as line ends: one task reads such a file.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    path = f"{directory.rstrip('/')}/{name}.{fmt}"
    if fmt == "csv" and line_breaks and not loose_quotes:
        return _csv_with_breaks(spark, path, schema)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        return (
            reader.option("header", True)
            .option("inferSchema", schema is None)
            .option("multiLine", line_breaks)
            .option("escape", '"')
            .csv(path)
        )
    return reader.format(fmt).load(path)


def _csv_with_breaks(
    spark: SparkSession, path: str, schema: T.StructType | str | None
) -> DataFrame:
    """The records of all files, less each one's header, parsed by the schema."""
    records = read_records(spark, path)
    reader = spark.read.option("escape", '"').option("multiLine", True)
    if schema is None:
        header = records.where("first").orderBy("file").limit(1)
        names = _parsed(reader.option("header", True), header).columns
        reader = spark.read.option("escape", '"').option("inferSchema", True)
        found = _parsed(reader, records.where("NOT first")).schema.fields
        types = [f.dataType for f in found] + [T.StringType()] * (len(names) - len(found))
        schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types)])
    elif isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    cells = F.from_csv("text", F.lit(_ddl(spark, schema)), {"escape": '"'})
    return records.where("NOT first").select(cells.alias("row")).select("row.*")


def _parsed(reader: DataFrameReader, records: DataFrame) -> DataFrame:
    """Spark's CSV reader over records at hand instead of a path."""
    texts = getattr(records.select("text")._jdf, "as")(
        records.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING()
    )
    return DataFrame(reader._jreader.csv(texts), records.sparkSession)


def _ddl(spark: SparkSession, schema: T.StructType) -> str:
    return spark.createDataFrame([], schema)._jdf.schema().toDDL()


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """UTF-8 CSV part files with a header and no index column."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
