"""Search over an archive of log lines in two layouts.

Layout v2 holds parsed records; the older v1 holds lines that open with their time. Both become one table of
`ns, layout, day, file_digest, line_index` (the position) beside the fields, and every search is a filter, a dedup and a
top-k over it (`sources/archive.py` keeps that table). Nanoseconds are whole numbers, as Spark's own times stop at microseconds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.loglines import SEVERITIES, event_ns, holds_text, instant, level_of, plain, split_stamp

SCHEMA_V1 = "k8s_log.v1"
SCHEMA_V2 = "k8s_log.v2"
POSITION = ("ns", "layout", "day", "file_digest", "line_index")
V2_FIELDS = (
    "schema", "time", "stage", "namespace", "pod", "container", "component", "domain", "product", "run_id", "stream",
    "message", "dedup_key",
)
V1_FIELDS = ("schema", "archived_at", "namespace", "pod", "container", "line", "archive_error")
RECORD = ", ".join(f"{name} string" for name in dict.fromkeys((*V2_FIELDS, *V1_FIELDS))) + ", missing array<string>"


def parse_records(lines: DataFrame) -> DataFrame:
    """JSON records as columns, with the position parts their file gives. A line that is no object is left out."""
    parsed = lines.withColumn("r", F.from_json("record", RECORD)).where(
        F.col("r").isNotNull() & F.trim("record").startswith("{")
    )
    return parsed.select(
        "r.*",
        F.col("date").cast("string").alias("day"),
        F.substring(F.sha2(F.col("_file"), 256), 1, 16).alias("file_digest"),
        "line_index",
    )


def with_line_index(lines: DataFrame, file: str = "_file") -> DataFrame:
    """The place of a record in its file. A gzipped file is read by one task from start to end, so ids rise within it."""
    numbered = lines.withColumn("_id", F.monotonically_increasing_id())
    first = numbered.groupBy(file).agg(F.min("_id").alias("_first"))
    return numbered.join(first, file).withColumn("line_index", F.col("_id") - F.col("_first")).drop("_id", "_first")


def structured(lines: Column) -> tuple[Column, Column]:
    """A structured application record: its known fields, and the rest as a map."""
    return F.from_json(lines, "ts string, level string, message string"), F.from_json(lines, "map<string, string>")


@dataclass(frozen=True)
class Search:
    """What a reader asks for. Empty filters keep everything; `since` is inclusive, `until` exclusive."""

    namespace: str
    pod: str = ""
    container: str = ""
    component: str = ""
    product: str = ""
    run_id: str = ""
    since: str | None = None
    until: str | None = None
    severity: str = ""
    text: str = ""

    def __post_init__(self) -> None:
        if self.severity and self.severity not in SEVERITIES:
            raise ValueError(f"not a severity: {self.severity!r}")

    @property
    def v2_only(self) -> bool:
        """A filter on a field v1 never held leaves every v1 line out."""
        return bool(self.component or self.product or self.run_id)

    def wanted(self) -> Column:
        """Plain comparisons of stored columns: those on the folders prune them, the others reach the Parquet scan."""
        kept = F.col("namespace") == self.namespace
        for name in ("pod", "container", "component", "product", "run_id"):
            if getattr(self, name):
                kept = kept & (F.col(name) == getattr(self, name))
        for bound, since in ((self.since, True), (self.until, False)):
            if bound:
                ns = F.unix_micros(F.lit(bound).cast("timestamp")) * 1000
                # A line without a readable time has no day, so no window holds it.
                kept = kept & ((F.col("ns") >= ns) & (F.col(DAY) >= _day(ns)) if since else (F.col("ns") < ns) & (F.col(DAY) <= _day(ns)))
        if self.severity:
            kept = kept & F.col("level").isin(*SEVERITIES[SEVERITIES.index(self.severity) :])
        if self.text:
            kept = kept & holds_text(F.col("message"), self.text)
        return kept


DAY = "event_day"
COLUMNS = (*POSITION, "namespace", "pod", "container", "stage", "component", "domain", "product", "run_id", "stream",
           "stamp", "message", "level", "dedup_key", "rest", DAY)


def _day(ns: Column) -> Column:
    """The day of a time, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(ns / F.lit(86_400_000_000_000)).cast("int"))


def event_day(at: Column, ns: Column) -> Column:
    """The day a line belongs to. Copies of a line agree in it, as their key holds the line's time."""
    return F.when(at.isNotNull(), _day(ns))


def v2_lines(records: DataFrame) -> DataFrame:
    clean = records.where(F.col("schema") == SCHEMA_V2).withColumns(
        {"message": plain(F.col("message")), "stamp": F.col("time"), "ns": event_ns(F.col("time"))}
    )
    return clean.withColumns(
        {
            "level": level_of(F.col("message")),
            "layout": F.lit(0),
            "rest": F.lit(None).cast("string"),
            DAY: event_day(instant(F.col("time")), F.col("ns")),
        }
    ).select(*COLUMNS)


def v1_lines(records: DataFrame) -> DataFrame:
    """Older lines, cut into time and text. Without a readable time the archive time places the line. A run that left no
    pods wrote a marker that names none; it is no line."""
    text = plain(F.col("line"))
    stamp, rest = split_stamp(F.coalesce(text, F.lit("")))
    cut = records.where((F.col("schema") == SCHEMA_V1) & F.col("pod").isNotNull()).withColumns(
        {"text": text, "stamp": stamp, "rest": rest}
    )
    written = instant(F.col("stamp"))
    absent = ("stage", "component", "domain", "product", "run_id", "stream", "dedup_key")
    placed = cut.withColumns(
        {
            "message": F.when(written.isNotNull(), F.col("rest")).otherwise(F.col("text")),
            "ns": event_ns(F.col("stamp"), F.col("archived_at")),
            "layout": F.lit(1),
            **{name: F.lit(None).cast("string") for name in absent},
        }
    )
    at = F.coalesce(written, instant(F.col("archived_at")))
    return placed.withColumns({"level": level_of(F.col("message")), DAY: event_day(at, F.col("ns"))}).select(*COLUMNS)


def parsed(records: DataFrame) -> DataFrame:
    """Records of both layouts as lines: the times and levels are read from their text here, and by no search again."""
    return v2_lines(records).unionByName(v1_lines(records))


def first_copies(lines: DataFrame) -> DataFrame:
    """Replays removed: of the lines with one dedup key the first by position stays. Lines without a key all stay.

    The first copy is a minimum, so copies fold map-side and a line replayed very often never meets in one task.
    """
    others = [c for c in lines.columns if c not in (*POSITION, "dedup_key")]
    keyed = (
        lines.where("dedup_key is not null")
        .groupBy("dedup_key")
        .agg(F.min(F.struct(*POSITION, *others)).alias("first"))
        .select("first.*", "dedup_key")
    )
    return keyed.select(*lines.columns).unionByName(lines.where("dedup_key is null"))


def drop_overlap(older: DataFrame, newer: DataFrame) -> DataFrame:
    """v1 lines less those v2 holds: same pod, container, stamp and text, missing parts being equal."""
    key = ["pod", "container", "stamp"]
    held = newer.select(*key, F.col("message").alias("rest")).distinct()
    match = [older[k].eqNullSafe(held[k]) for k in (*key, "rest")]
    return older.join(held, match, "left_anti")


def merged(lines: DataFrame, search: Search) -> DataFrame:
    """Every line the search wants, both layouts, each line once."""
    found = lines.where(search.wanted())
    newer = first_copies(found.where("layout = 0"))
    if search.v2_only:
        return newer
    # The overlap is with every v2 line of the archive: a v2 copy the search's text or level leaves out has a v1 copy
    # that it leaves out too.
    return newer.unionByName(drop_overlap(found.where("layout = 1"), newer))


def after(cursor: Sequence) -> Column:
    """Lines past a position, ties included: positions are compared part by part."""
    names = list(POSITION)
    past = F.lit(False)
    for index in reversed(range(len(names))):
        here = F.col(names[index])
        past = (here > F.lit(cursor[index])) | ((here == F.lit(cursor[index])) & past)
    return past


def page(lines: DataFrame, limit: int, cursor: Sequence | None = None) -> DataFrame:
    """The first `limit` lines in order, past the cursor if there is one. Each task keeps its own first `limit`."""
    rows = lines if cursor is None else lines.where(after(cursor))
    return rows.orderBy(*POSITION).limit(limit)


def last_position(lines: DataFrame) -> tuple | None:
    """The cursor of the next page: the position of a page's last line. A page is bounded by its limit."""
    row = lines.agg(F.max(F.struct(*POSITION)).alias("p")).first()["p"]
    return tuple(row) if row else None
