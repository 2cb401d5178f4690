"""Missing values, column roles and the lexical class of a text cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Lexical classes of a text cell, tested in this order; anything else is text.
CELL_PATTERNS = {
    "integer": r"\A[+-]?[0-9]+\z",
    "floating": r"\A[+-]?[0-9]*\.[0-9]+([eE][+-]?[0-9]+)?\z",
    "boolean": r"\A(?i:true|false)\z",
    "datetime": (
        r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}"
        r"([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?\z"
    ),
}
CELL_CLASSES = ("integer", "floating", "boolean", "datetime", "string")
# --- end of fixed values ----------------------------------------------------

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_BINARY_FLOAT = (T.FloatType, T.DoubleType)


def _field(df: DataFrame, name: str) -> T.StructField:
    return df.schema[name]


def name(column: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def present(df: DataFrame, column: str) -> Column:
    """The column with NaN turned into NULL, so that aggregates skip both."""
    value = name(column)
    if isinstance(_field(df, column).dataType, _BINARY_FLOAT):
        return F.when(~F.isnan(value), value)
    return value


def is_missing(df: DataFrame, column: str) -> Column:
    value = name(column)
    if isinstance(_field(df, column).dataType, _BINARY_FLOAT):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def declared_kind(data_type: T.DataType) -> str | None:
    """Kind of a typed column; None for text, whose cells have to be read."""
    if isinstance(data_type, T.StringType):
        return None
    if isinstance(data_type, _INTEGRAL):
        return "integer"
    if isinstance(data_type, _BINARY_FLOAT):
        return "floating"
    if isinstance(data_type, T.DecimalType):
        return "decimal"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "datetime64"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, T.BinaryType):
        return "bytes"
    if isinstance(data_type, T.NullType):
        return "empty"
    return "mixed"


def _by_class(text: Column, results: dict[str, Column]) -> Column:
    """The result for a text cell's lexical class, NULL for a missing cell.

    Patterns, not casts: a cast also accepts '1d', ' 12 ', 'NaN' as numbers.
    A look at single characters leaves one pattern to try for most cells.
    """
    first = F.ascii(text)
    numeral = first.between(ord("0"), ord("9")) | first.isin(*map(ord, "+-."))
    letter = first.isin(*map(ord, "tTfF"))

    def tried(*kinds: str) -> Column:
        chain = F
        for kind in kinds:
            chain = chain.when(text.rlike(CELL_PATTERNS[kind]), results[kind])
        return chain.otherwise(results["string"])

    return (
        F.when(numeral & (F.substring(text, 5, 1) == "-"), tried("datetime", "floating"))
        .when(numeral & F.contains(text, F.lit(".")), tried("floating"))
        .when(numeral, tried("integer"))
        .when(letter, tried("boolean"))
        .when(text.isNotNull(), results["string"])
    )


def cell_class(text: Column) -> Column:
    """Name of a text cell's lexical class, NULL for a missing cell."""
    return _by_class(text, {cls: F.lit(cls) for cls in CELL_CLASSES})


def cell_class_bit(text: Column) -> Column:
    """One bit per lexical class, so that a column's classes can be or-ed."""
    return _by_class(text, {c: F.lit(1 << i) for i, c in enumerate(CELL_CLASSES)})


def kind_of_classes(bits: Column) -> Column:
    """Kind of a text column from the or-ed bits of its cells' classes."""
    place = {cls: 1 << i for i, cls in enumerate(CELL_CLASSES)}
    kind = F.when(bits.isNull(), F.lit("empty"))
    for cls, bit in place.items():
        kind = kind.when(bits == bit, F.lit(cls))
    numbers = place["integer"] | place["floating"]
    return (
        kind.when(bits == numbers, F.lit("mixed-integer-float"))
        .when(bits.bitwiseAND(place["integer"]) != 0, F.lit("mixed-integer"))
        .otherwise(F.lit("mixed"))
    )
