"""Result exports: CSV cells safe to open in a spreadsheet, JSON rows, row caps that refuse instead of cutting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the characters a spreadsheet takes as the start of a formula.
FORMULA_START = r"^[=+\-@\t\r]"
PAGE_ROWS = 1_000
EXPORT_ROWS = 100_000


class TooManyRows(RuntimeError):
    """The result is larger than the export cap."""


def _guarded(text: Column) -> Column:
    return F.when(text.rlike(FORMULA_START), F.concat(F.lit("'"), text)).otherwise(text)


def csv_cell(column: Column, kind: T.DataType) -> Column:
    """One CSV cell: nothing for null, lower-case booleans, JSON for nested values, no text that starts a formula."""
    if isinstance(kind, T.StringType):
        cell = _guarded(column)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        cell = _guarded(F.to_json(column))
    else:
        cell = column.cast("string")
    return F.coalesce(cell, F.lit(""))


def csv_cells(df: DataFrame) -> DataFrame:
    return df.select(*[csv_cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def export_csv(df: DataFrame, folder: str) -> None:
    """Cells are escaped in the plan, so the files are written by as many tasks as the result has."""
    cells = csv_cells(df)
    names = [f"'{n}" if n[:1] in "=+-@\t\r" and n else n for n in cells.columns]
    cells.toDF(*names).write.mode("overwrite").option("header", True).option("escape", '"').option(
        "emptyValue", ""
    ).csv(folder)


def _json_value(column: Column) -> Column:
    wrapped = F.to_json(F.array(column))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON array of its values, unchanged, in column order."""
    values = [_json_value(F.col(f"`{name}`")) for name in df.columns]
    return df.select(F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]")).alias("row"))


def json_keys(columns: Sequence[str]) -> list[str]:
    """Object keys for the columns: a repeated name gets `_2`, `_3`, so no value is lost."""
    taken: set[str] = set()
    keys = []
    for name in columns:
        key, n = name, 1
        while key in taken:
            n += 1
            key = f"{name}_{n}"
        taken.add(key)
        keys.append(key)
    return keys


def ndjson(df: DataFrame) -> DataFrame:
    """Each row as a JSON object."""
    named = df.toDF(*json_keys(df.columns))
    return named.select(F.to_json(F.struct(*[f"`{c}`" for c in named.columns]), {"ignoreNullFields": "false"}).alias("row"))


def bounded_export(df: DataFrame, max_rows: int = EXPORT_ROWS) -> DataFrame:
    """The whole result, or an error when it has more rows than the cap. Nothing is cut silently."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise TooManyRows(f"the result has more than {max_rows} rows; narrow the query")
    return df


def page(df: DataFrame, order: Sequence[Column], rows: int = PAGE_ROWS) -> tuple[DataFrame, bool]:
    """The first rows in order, and whether there were more."""
    return df.orderBy(*order).limit(rows), df.limit(rows + 1).count() > rows
