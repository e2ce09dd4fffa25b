"""Column profiles, gated by what a table's classification allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exact

# Classifications that allow counts and values, or counts alone. Any other allows no profile.
WITH_VALUES = ("Public", "Internal")
COUNTS_ONLY = ("Confidential",)
PROFILED_ROLES = ("Fact", "Dimension")


def allowed(classification: str | None, role: str | None = "Fact") -> str | None:
    """`values`, `counts`, or None when the table may not be profiled."""
    if role not in PROFILED_ROLES:
        return None
    if classification in WITH_VALUES:
        return "values"
    return "counts" if classification in COUNTS_ONLY else None


def profile(df: DataFrame, classification: str | None, role: str = "Fact") -> DataFrame | None:
    """One row per column: rows, values, nulls, share of nulls, distinct values, and min, max, mean where allowed.

    Counts, least and greatest values and sums of whole numbers are one aggregate of the scan, which ends as one row. All exact
    distinct counts share one shuffle, a grouping set per column: values keep their types, fold map-side, and one that many
    rows hold reaches it once per task. A map, which has no order, is counted by its JSON text. Means of doubles are
    added exactly apart (`exact.sums`), so none depends on the order of the rows, and neither tiny nor huge values are cut.
    """
    gate = allowed(classification, role)
    if gate is None:
        return None
    fields, measures = df.schema.fields, {}
    if gate == "values":
        measures = {i: m for i, f in enumerate(fields) if (m := _measure(f)) is not None}
    doubles = {i for i in measures if _summed_apart(fields[i].dataType)}

    totals: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        totals.append(F.count(_column(f)).alias(f"n{i}"))
        if i in measures:
            whole = F.lit(None) if i in doubles else F.sum(_decimal(fields[i], measures[i]))
            totals += [F.min(measures[i]).alias(f"low{i}"), F.max(measures[i]).alias(f"high{i}"), whole.cast("double").alias(f"sum{i}")]
    row_of = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.col("rows").alias("row_count"),
            F.col(f"n{i}").alias("values_count"),
            *[F.col(f"{part}{i}" if i in measures else "_none").cast("double").alias(name) for part, name in _VALUES if gate == "values"],
        )
        for i, f in enumerate(fields)
    ]
    found = df.agg(*totals).withColumn("_none", F.lit(None)).where("rows > 0").select(F.inline(F.array(*row_of)))

    distinct = df.agg(*[F.count_distinct(_comparable(f)).alias(f"d{i}") for i, f in enumerate(fields)])
    counted = [F.struct(F.lit(f.name).alias("column_name"), F.col(f"d{i}").alias("distinct_count")) for i, f in enumerate(fields)]
    found = found.join(distinct.select(F.inline(F.array(*counted))), "column_name")
    nulls = F.col("row_count") - F.col("values_count")
    found = found.withColumns({"null_count": nulls, "null_proportion": nulls / F.col("row_count")})
    if gate != "values":
        return found
    if doubles:
        named = df.select(*[measures[i].alias(f"x{i}") for i in sorted(doubles)])
        added = exact.sums(named, [], named.columns)
        exactly = [F.struct(F.lit(fields[i].name).alias("column_name"), F.col(f"x{i}").alias("_exact")) for i in sorted(doubles)]
        found = found.join(added.select(F.inline(F.array(*exactly))), "column_name", "left")
        found = found.withColumn("_sum", F.coalesce("_sum", "_exact")).drop("_exact")
    return found.withColumn("mean_value", F.col("_sum") / F.nullif(F.col("values_count"), F.lit(0))).drop("_sum")


_VALUES = (("low", "min_value"), ("high", "max_value"), ("sum", "_sum"))


def _column(f: T.StructField) -> Column:
    return F.col("`" + f.name.replace("`", "``") + "`")


def _comparable(f: T.StructField) -> Column:
    """The value, or a map's text: maps cannot be grouped by."""
    return F.to_json(F.struct(_column(f).alias("m"))) if "map<" in f.dataType.simpleString() else _column(f)


def _summed_apart(kind: T.DataType) -> bool:
    """Doubles, and decimals whose sum could outgrow 38 digits."""
    return isinstance(kind, (T.FloatType, T.DoubleType)) or (isinstance(kind, T.DecimalType) and kind.precision > 28)


def _decimal(f: T.StructField, measure: Column) -> Column:
    """Whole numbers as decimals, which add up exactly; decimals as they are. Their sums are ten digits longer."""
    return measure if isinstance(f.dataType, T.DecimalType) else measure.cast("decimal(28,0)")


def _measure(f: T.StructField) -> Column | None:
    """The number min, max and mean speak about: the value, the length of a text, the day number of a date."""
    column = _column(f)
    if isinstance(f.dataType, T.StringType):
        return F.length(column)
    if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_date(column.cast("date"))
    return column if isinstance(f.dataType, T.NumericType) else None
