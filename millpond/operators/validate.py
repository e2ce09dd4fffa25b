"""Contract validation: typed rows, the reasons a row is refused, accepted and rejected tables, one report.

The rows are read twice: once to count keys, once to mark the rows of repeated keys, find every row's errors and write both. The
report's counts are observed on that write. Only rows of repeated keys are looked at again, and neither a hot key nor a
group of identical copies meets in one task: keys are counted with map-side combine, and what must be removed is found by
adding and subtracting row counts over all columns, never by ranking a key's rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..contracts import Contract

# The check names, in the order they are always reported.
CHECKS = ("cast_error", "not_null", "unique", "schema_mismatch", "file_status")

# What text counts as a value of each type. Narrower than Spark's own casts, which read 'yes' as true and '2026' as a
# date; the cast after it still refuses what only looks right, such as a 31st of February or an integer too large.
_SHAPE = {
    "integer": r"^[+-]?\d+$",
    "number": r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "boolean": r"^(?i:true|false)$",
}
_SPARK_TYPE = {"integer": "int", "number": "double", "date": "date", "boolean": "boolean"}

FILE = "_file"
ERRORS = "_errors"
COPIES = "_copies"
REPEATED = "_repeated"

# Writes a table, apart by the values of the columns `by`, and reads it back.
Keep = Callable[..., DataFrame]


def _as_is(df: DataFrame, label: str = "", by: Sequence[str] = ()) -> DataFrame:
    return df


class RunAborted(RuntimeError):
    """The contract stops the run: its policy is abort, or too large a share of the rows was rejected."""


def snake_case(name: str) -> str:
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", spaced)
    return re.sub(r"[^0-9a-zA-Z]+", "_", spaced).strip("_").lower()


def normalize_columns(df: DataFrame) -> DataFrame:
    """Column names in snake_case; two names that meet are refused, as one would hide the other."""
    names = [snake_case(c) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"column names collide in snake_case: {df.columns}")
    return df.toDF(*names)


def given(raw: Column) -> Column:
    """The source text, with an empty field read as missing, as CSV cannot tell them apart."""
    return F.when(raw != "", raw)


def typed(raw: Column, kind: str) -> Column:
    """The value the text states in the declared type, or null."""
    text = given(raw.cast("string"))
    if kind == "string":
        return text
    return F.when(text.rlike(_SHAPE[kind]), text.try_cast(_SPARK_TYPE[kind]))


def schema_mismatch(df: DataFrame, contract: Contract) -> tuple[list[str], list[str]]:
    """Declared columns the rows lack, and columns the contract does not declare."""
    held = [c for c in df.columns if not c.startswith("_")]
    return [n for n in contract.names if n not in held], [c for c in held if c not in contract.names]


def row_errors(contract: Contract) -> Column:
    """The failed casts, then the missing values, of one row: `array<struct<check, column>>`."""
    raw = {f.name: F.col(f"`{f.name}`").cast("string") for f in contract.fields}
    found = [
        F.when(given(raw[f.name]).isNotNull() & typed(raw[f.name], f.type).isNull(), _error("cast_error", f.name))
        for f in contract.fields
        if f.type != "string"
    ]
    found += [
        F.when(given(raw[f.name]).isNull(), _error("not_null", f.name)) for f in contract.fields if not f.nullable
    ]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<check:string,column:string>>")


def _error(check: str, column: str) -> Column:
    return F.struct(F.lit(check).alias("check"), F.lit(column).alias("column"))


def repeated_keys(rows: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """The keys held by more than one row, with how many hold them. A key with a missing part is no key."""
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    complete = rows.select(*named).dropna()
    return complete.groupBy(*complete.columns).agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1")


def split_copies(
    several: DataFrame, keys: Sequence[str], columns: Sequence[str], newest: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Of rows with repeated keys the one copy of every key that counts, and its other copies folded with their number in `_copies`.

    The one that counts is the smallest row: by file where `columns` have a `_file`, then by the row's own columns. With
    `newest` it comes from the last file instead, as a merge takes it.
    """
    order = [c for c in columns if c == FILE] + [c for c in columns if c != FILE]
    names = [f"`{c}`" for c in order]
    rows = several.select(*names, *[k for k in keys if k not in order])
    smallest = F.min(F.struct(*names)).alias("first")
    if newest:
        per_file = rows.groupBy(*keys, FILE).agg(smallest)
        first = per_file.groupBy(*keys).agg(F.max_by("first", FILE).alias("first")).select("first.*")
    else:
        first = rows.groupBy(*keys).agg(smallest).select("first.*")
    later = (
        rows.select(*names, F.lit(1).alias(COPIES))
        .union(first.select(*names, F.lit(-1)))
        .groupBy(*names)
        .agg(F.sum(COPIES).alias(COPIES))
        .where(F.col(COPIES) > 0)
    )
    return first, later


def _counts(copies: Column, filed: bool) -> list[Column]:
    """What a report needs of rows with `_errors`: rows, those with an error, the violations of each check, and the files hit."""
    bad = F.size(ERRORS) > 0

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias(name)

    bad = bad & (copies > 0)
    def hits(check: str) -> Column:
        return F.size(F.filter(ERRORS, lambda e: e["check"] == check))

    checks = ("cast_error", "not_null", "unique")
    found = [total(copies, "rows"), total(F.when(bad, copies), "bad"), *[total(hits(c) * copies, c) for c in checks]]
    # Files are as many as the batch landed.
    return [*found, F.collect_set(F.when(bad, F.col(FILE))).alias("files")] if filed else found


@dataclass(frozen=True)
class Checked:
    """`rows` holds the source text, `_errors` and `_copies`, the number of identical source rows it stands for;
    `source` is the same rows, none folded. `counted` are the counts of the rows whose key is not repeated, if they were observed
    while the rows were written, and `few` the other rows of `rows`; `singles` are those whose key is not repeated."""

    contract: Contract
    source: DataFrame
    rows: DataFrame
    counted: dict | None = None
    few: DataFrame | None = None
    singles: DataFrame | None = None

    def _totals(self) -> DataFrame:
        """One row of `_counts` over all rows, reading no more of them than was not counted yet."""
        filed = FILE in self.rows.columns
        if self.counted is None:
            return self.rows.agg(*_counts(F.col(COPIES), filed))
        found = self.few.agg(*_counts(F.col(COPIES), filed))
        added = {c: F.col(c) + F.lit(self.counted[c]).cast("bigint") for c in ("rows", "bad", "cast_error", "not_null", "unique")}
        if filed:
            added["files"] = F.array_union("files", F.array(*map(F.lit, self.counted["files"])).cast("array<string>"))
        return found.withColumns(added)

    @property
    def accepted(self) -> DataFrame:
        """The typed rows the policy lets through: all under `warn`, else those without an error."""
        return self.accepted_from().drop(FILE)

    def accepted_from(self) -> DataFrame:
        """The accepted rows, each with the file it came from where the source names one."""
        warn = self.contract.policy.severity == "warn"
        # Under `warn` every source row is accepted as it came: folded copies are never expanded again.
        kept = self.source if warn else self.rows.where(F.size(ERRORS) == 0)
        origin = [FILE] if FILE in kept.columns else []
        return kept.select(*[typed(F.col(f"`{f.name}`"), f.type).alias(f.name) for f in self.contract.fields], *origin)

    @property
    def rejected(self) -> DataFrame:
        """The refused source rows with their reasons; identical refused copies are one row with a count."""
        if self.contract.policy.severity == "warn":
            return self.rows.where(F.lit(False))
        return self.rows.where(F.size(ERRORS) > 0)

    def folded(self, *columns: str, rejected: bool = False) -> DataFrame:
        """All rows, or the `rejected` ones, as one per value of the declared columns, the further `columns` and the `errors` as
        text, with its number of `copies`.

        A row whose key is complete and not repeated has no equal, so it is not sent to be grouped.
        """
        contract = self.contract
        types = {f.name: f.type for f in contract.fields}
        names = [*contract.names, *columns]

        def shown(df: DataFrame) -> DataFrame:
            kept = df.where((F.size(ERRORS) > 0) & F.lit(contract.policy.severity != "warn")) if rejected else df
            return kept.select(*[f"`{c}`" for c in names], error_text().alias("errors"), F.col(COPIES).alias("copies"))

        def grouped(df: DataFrame) -> DataFrame:
            return df.groupBy(*[f"`{c}`" for c in names], "errors").agg(F.sum("copies").alias("copies"))

        by_file = contract.write_mode == "merge_scd2" and FILE in self.rows.columns and FILE not in columns
        if not contract.primary_key or by_file:
            return grouped(shown(self.rows))
        complete = F.lit(True)
        for key in contract.primary_key:
            complete = complete & typed(F.col(f"`{key}`"), types[key]).isNotNull()
        rest = self.few
        if not self.counted or self.counted["keyless"]:
            keyless = self.singles.where(~complete)
            rest = keyless if rest is None else rest.unionByName(keyless)
        return shown(self.singles.where(complete)).unionByName(grouped(shown(rest)))

    def rejection(self) -> DataFrame:
        """One row: rows, rejected, the rejected share and whether the limit is exceeded. At the limit passes."""
        limit = self.contract.policy.max_rejection_rate
        totals = self._totals().select("rows", F.col("bad").alias("rejected"))
        rate = F.when(F.col("rows") > 0, F.col("rejected") / F.col("rows")).otherwise(F.lit(0.0))
        exceeded = (rate > F.lit(limit)) if limit is not None else F.lit(False)
        return totals.withColumns({"rejection_rate": rate, "exceeded": exceeded})

    def report(self) -> DataFrame:
        """One row of counts for the entity."""
        warn = self.contract.policy.severity == "warn"
        none, bad = F.lit(0).cast("bigint"), F.col("bad")
        columns = [
            F.col("rows"),
            (F.col("rows") - (none if warn else bad)).alias("accepted"),
            (none if warn else bad).alias("rejected"),
            (bad if warn else none).alias("warnings"),
            (none if warn else bad).alias("errors"),
            *[F.col(c).alias(f"{c}_violations") for c in ("cast_error", "not_null", "unique")],
        ]
        if FILE in self.rows.columns:
            columns.append(F.size("files").cast("bigint").alias("files_impacted"))
        return self._totals().select(F.lit(self.contract.name).alias("entity"), *columns)

    def file_status(self) -> DataFrame:
        """Per source file: rows, accepted, rejected, and the status its rows give it."""
        bad = F.size(ERRORS) > 0
        copies = F.col(COPIES)
        severity = self.contract.policy.severity
        word = {"warn": "warn", "reject": "rejected", "abort": "failed"}[severity]
        return (
            self.rows.groupBy(FILE)
            .agg(
                F.sum(copies).cast("bigint").alias("rows"),
                F.coalesce(F.sum(F.when(bad, copies)), F.lit(0)).cast("bigint").alias("violating_rows"),
            )
            .withColumn("status", F.when(F.col("violating_rows") > 0, word).otherwise("accepted"))
        )

    def enforce(self) -> None:
        """Raise when the policy stops the run. Call it after the accepted and rejected rows are written: past a
        rejection limit both are kept, and only what is built on them is blocked."""
        policy = self.contract.policy
        if policy.severity == "warn" or (policy.severity == "reject" and policy.max_rejection_rate is None):
            return
        found = self.rejection().first()
        if policy.severity == "abort" and found["rejected"] > 0:
            raise RunAborted(f"{self.contract.name}: {found['rejected']} of {found['rows']} rows violate the contract")
        if found["exceeded"]:
            raise RunAborted(
                f"{self.contract.name}: rejected share {found['rejection_rate']:.6f} exceeds "
                f"{policy.max_rejection_rate}"
            )


def check(raw: DataFrame, contract: Contract, keep: Keep = _as_is, keep_rows: bool = True) -> Checked:
    """Check source rows against their contract. A missing column is an entity failure, an extra one is left out.

    A key repeated over files is a duplicate whose first file counts; a `merge_scd1` entity takes the last file's row, and a
    `merge_scd2` entity keeps one version per file, so only copies inside a file are duplicates.

    Pass `session.cut` as `keep` on large data: the checked rows are then written once, rows of repeated keys apart from the others, and
    the counts of the report are taken while they are. Without `keep_rows` only the repeated keys and their rows are written, which is
    enough for a report alone.
    """
    missing, _ = schema_mismatch(raw, contract)
    if missing:
        raise RunAborted(f"{contract.name}: columns {missing} are missing")
    filed = FILE in raw.columns
    columns = [*contract.names, *([FILE] if filed else [])]
    rows = raw.select(*[F.col(f"`{n}`").cast("string").alias(n) for n in contract.names], *columns[len(contract.names) :])
    keys = list(contract.primary_key)
    types = {f.name: f.type for f in contract.fields}
    # The key is compared by value, so '07' and '7' are one integer key; the source text stays as it was.
    slots = [f"_key{i}" for i in range(len(keys))]
    keyed = rows.withColumns({slot: typed(F.col(f"`{k}`"), types[k]) for slot, k in zip(slots, keys)})
    per_file = [FILE] if filed and contract.write_mode == "merge_scd2" else []
    one = F.lit(1).cast("bigint").alias(COPIES)
    repeated = keep(repeated_keys(keyed, [*slots, *per_file]).drop("n_records")) if keys else None
    unique = not keys or (keep is not _as_is and repeated.isEmpty())
    if unique:
        marked = rows.withColumn(REPEATED, F.lit(False))
    else:
        marked = keyed.join(repeated.withColumn("_hit", F.lit(True)), [*slots, *per_file], "left")
        marked = marked.withColumn(REPEATED, F.col("_hit").isNotNull())
    # The typed key is found again where it is needed: a unique key written twice would be most of many a table.
    marked = marked.select(*[f"`{c}`" for c in columns], row_errors(contract).alias(ERRORS), REPEATED)
    typed_keys = {slot: typed(F.col(f"`{k}`"), types[k]) for slot, k in zip(slots, keys)}
    seen, counted = Observation(), None
    if keep is not _as_is and keep_rows:
        keyless = F.lit(False)
        for value in typed_keys.values():
            keyless = keyless | value.isNull()
        alone = F.when(F.col(REPEATED), 0).otherwise(1).cast("bigint")
        marked = keep(marked.observe(seen, *_counts(alone, filed), F.count_if(keyless).alias("keyless")), "checked", [REPEATED])
        counted = seen.get
    singles = marked.where(~F.col(REPEATED)).select(*[f"`{c}`" for c in columns], ERRORS, one)
    if unique:
        return Checked(contract, marked, singles, counted, singles.where(F.lit(False)), singles)
    first, later = split_copies(marked.where(REPEATED).withColumns(typed_keys), [*slots, *per_file], columns, filed and contract.write_mode == "merge_scd1")
    duplicate = F.array(_error("unique", ",".join(keys)))
    few = keep(
        first.select(*[f"`{c}`" for c in columns], row_errors(contract).alias(ERRORS), one).unionByName(
            later.select(*[f"`{c}`" for c in columns], F.concat(row_errors(contract), duplicate).alias(ERRORS), COPIES)
        )
    )
    return Checked(contract, marked, singles.unionByName(few), counted, few, singles)


def error_text(errors: str | Column = ERRORS) -> Column:
    """The reasons as `check:column` words."""
    return F.concat_ws(",", F.transform(errors, lambda e: F.concat(e["check"], F.lit(":"), e["column"])))


def infer_columns(raw: DataFrame) -> DataFrame:
    """The declared type each text column could take: one aggregate, whatever the number of rows.

    Empty fields say nothing; a column without a value is text.
    """
    integer, decimal, date = r"^-?\d+$", r"^-?\d+\.\d+$", r"^\d{4}-\d{2}-\d{2}$"
    probes: list[Column] = []
    for name in raw.columns:
        value = given(F.col(f"`{name}`").cast("string"))
        probes.append(
            F.struct(
                F.count(value).alias("given"),
                F.count_if(value.rlike(integer)).alias("integers"),
                F.count_if(value.rlike(decimal)).alias("decimals"),
                F.count_if(value.rlike(date)).alias("dates"),
            ).alias(name)
        )
    one = raw.agg(*probes)
    listed = F.array(
        *[F.struct(F.lit(name.strip()).alias("name"), F.col(f"`{name}`").alias("seen")) for name in raw.columns]
    )
    kind = (
        F.when(F.col("seen.given") == 0, "string")
        .when(F.col("seen.integers") == F.col("seen.given"), "integer")
        .when(F.col("seen.integers") + F.col("seen.decimals") == F.col("seen.given"), "number")
        .when(F.col("seen.dates") == F.col("seen.given"), "date")
        .otherwise("string")
    )
    return one.select(F.inline(listed)).select("name", kind.alias("type"), F.lit(False).alias("nullable"))


def classify_check(
    passed: Column,
    severity: Column,
    policy: Column,
    run_status: Column,
    rate_exceeded: Column,
    evidenced: Column,
    rejected_rows: Column,
) -> tuple[Column, Column]:
    """What a check's result means: its outcome, and what happened to the run. The first rule that holds decides."""
    rules = [
        (passed & evidenced, "passed", "continued"),
        (passed, "unknown", "unknown"),
        # The run states that end a run.
        (F.lower(run_status).isin("aborted", "failed") | (policy == "abort") | rate_exceeded, "error", "blocked"),
        (severity == "WARN", "warn", "continued"),
        ((policy == "reject") | (rejected_rows > 0), "error", "quarantined"),
    ]
    outcome, effect = None, None
    for condition, result, consequence in rules:
        met = F.coalesce(condition, F.lit(False))
        outcome = F.when(met, result) if outcome is None else outcome.when(met, result)
        effect = F.when(met, consequence) if effect is None else effect.when(met, consequence)
    return outcome.otherwise("error"), effect.otherwise("unknown")


def expand_missing_checks(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every entity with all five checks. A check nobody reported is `not_run` where a sibling reported and `unknown`
    where none did. `results` holds the keys, `check_id` and `outcome`; an entity without checks has a null check."""
    reported = results.groupBy(*keys, "check_id").agg(F.min("outcome").alias("outcome"))
    entities = reported.groupBy(*keys).agg(F.count_if(F.col("check_id").isin(*CHECKS)).alias("siblings"))
    grid = entities.withColumn("check_id", F.explode(F.array(*[F.lit(c) for c in CHECKS])))
    return grid.join(reported, [*keys, "check_id"], "left").select(
        *keys,
        "check_id",
        F.coalesce("outcome", F.when(F.col("siblings") > 0, "not_run").otherwise("unknown")).alias("outcome"),
    )
