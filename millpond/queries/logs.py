"""Log search over archived lines made from the events."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import loglines
from ..plans import logs
from ..registry import register
from ..session import scratch, table
from ..shapes import ctes, view
from ..sources import files
from ..sources.archive import Archive
from ..sources.loads import exists

LEVEL = "case word when 'INFO' then 'info' when 'DEBUG' then 'debug' when 'WARN' then 'warning' when 'FATAL' " \
    "then 'critical' else 'error' end"
STATED = f"case when event_id % 8 in (5, 7) then null else {LEVEL} end"
NS = "epoch_us(cast(replace(time[1:26], 'T', ' ') as timestamp)) * 1000 + cast(time[27:29] as bigint)"
RANK = "case %s when 'debug' then 0 when 'info' then 1 when 'warning' then 2 when 'error' then 3 when 'critical' then 4 " \
    "else -1 end"
NEWER = f"""select {NS} as ns, 0 as layout, day, sha256(file_name)[1:16] as file_digest, line_index, pod, container,
time as stamp, regexp_replace(message, '\\x1b\\[[0-?]*[ -/]*[@-~]', '', 'g') as message, {STATED} as level, dedup_key,
component, namespace from log_v2_v"""
FIRST = """select * exclude (n) from (select *, case when dedup_key is null then 1 else row_number() over
(partition by dedup_key order by ns, layout, day, file_digest, line_index) end as n from newer) where n = 1"""
OLDER = """select epoch_us(cast(replace(archived_at[1:26], 'T', ' ') as timestamp)) * 1000
+ case when event_id % 6 = 5 then 0 else event_id % 1000 end as ns, 1 as layout, day, sha256(file_name)[1:16] as file_digest,
line_index, pod, container, split_part(line, ' ', 1) as stamp, line[strpos(line, ' ') + 1:] as rest,
case when event_id % 6 = 5 then line else line[strpos(line, ' ') + 1:] end as message,
case when event_id % 6 <> 5 and event_id % 8 <> 5 then 'warning' end as level, null::varchar as dedup_key, namespace
from log_v1_v"""
ALONE = """select * from older o where not exists (select 1 from firsts f where f.pod is not distinct from o.pod
and f.container is not distinct from o.container and f.stamp is not distinct from o.stamp
and f.message is not distinct from o.rest)"""
SHOWN = "ns, layout, day, file_digest, line_index, pod, container, stamp, message, level"


_LANDED: dict[tuple[str, str], Archive] = {}


def _landed(spark: SparkSession, sf_dir: str) -> Archive:
    """The archive of a data folder, landed by the first search of an application and read by all of them."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _LANDED or not exists(spark, _LANDED[known].root):
        _LANDED[known] = _land(spark, sf_dir)
    return _LANDED[known]


def _land(spark: SparkSession, sf_dir: str) -> Archive:
    archive = Archive(spark, scratch(spark, "log-archive"))
    digest = F.substring(F.sha2(F.col("file_name"), 256), 1, 16)
    for name in ("log_v2_v", "log_v1_v"):
        rows = view(spark, sf_dir, name).withColumn("file_digest", digest)
        absent = [n for n in (*logs.V2_FIELDS, *logs.V1_FIELDS) if n not in rows.columns]
        archive.land(rows.withColumns({n: F.lit(None).cast("string") for n in absent}), name)
    return archive


@register(
    "log_archive_landing",
    "S4",
    "S6",
    "I1",
    sql=ctes("log_v2_v", "log_v1_v", newer=NEWER, older=OLDER) + """select namespace, layout, cast(date '1970-01-01'
    + cast(ns // 86400000000000 as integer) as varchar) as event_day, count(*) as n, count(level) as levels,
    min(ns) as first_ns, max(ns) as last_ns from (select namespace, layout, ns, level from newer
    union all select namespace, layout, ns, level from older) group by all""",
)
def _landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fresh landing of both layouts, which the searches below share one of, and what each of its folders holds."""
    return _land(spark, sf_dir).lines().groupBy("namespace", "layout", "event_day").agg(
        F.count(F.lit(1)).alias("n"), F.count("level").alias("levels"), F.min("ns").alias("first_ns"), F.max("ns").alias("last_ns")
    )


def _shown(lines: DataFrame) -> DataFrame:
    return lines.select(*[c.strip() for c in SHOWN.split(",")])


@register(
    "log_levels",
    "S6",
    "J10",
    "J11",
    "J12",
    "J13",
    "J14",
    sql=ctes("log_v2_v") + f"select line_index, file_name, {STATED} as level, "
    f"{RANK % f'({STATED})'} as rank from log_v2_v",
)
def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "log_v2_v").withColumn("level", loglines.level_of(F.col("message")))
    return lines.select("line_index", "file_name", "level", loglines.rank(F.col("level")).alias("rank"))


@register(
    "document_levels",
    "S6",
    "J13",
    sql=r"""select doc_id, case when regexp_matches(trim(text, e' \n\t\r'), '^(\[?\d{2,4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|\s?[+-]\d{2}:?\d{2}|\s?UTC)?\]?\s*([-|]\s*)?)?((DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|FATAL)|\[\s*((?i:DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|FATAL))\s*\])([\s:|\]-]|$)')
    then true else false end as opens_with_level from documents""",
)
def _document_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole prose texts, some of them very long: none is logfmt, and the matcher must get through all of them."""
    texts = table(spark, sf_dir, "documents")
    return texts.select("doc_id", loglines.level_of(F.col("text")).isNotNull().alias("opens_with_level"))


@register(
    "event_nanoseconds",
    "J15",
    "J16",
    "S11",
    sql=ctes("log_v1_v", older=OLDER) + "select line_index, ns, message, rest from older",
)
def _ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    older = view(spark, sf_dir, "log_v1_v")
    stamp, rest = loglines.split_stamp(F.col("line"))
    written = loglines.instant(stamp).isNotNull()
    return older.select(
        "line_index",
        loglines.event_ns(stamp, F.col("archived_at")).alias("ns"),
        F.when(written, rest).otherwise(F.col("line")).alias("message"),
        rest.alias("rest"),
    )


def _search(name: str, covers: tuple[str, ...], filters: dict, where: str, older: bool = True) -> None:
    body = f"select {SHOWN} from firsts where {where}"
    if older:
        body += f" union all select {SHOWN} from ({ALONE}) where {where}"

    @register(name, *covers, sql=ctes("log_v2_v", "log_v1_v", newer=NEWER, firsts=FIRST, older=OLDER) + body)
    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(_landed(spark, sf_dir).search(logs.Search(**filters)))


_search("log_merged", ("S9", "S10", "S4", "E7", "G2", "I1"), {"namespace": "dev"}, "namespace = 'dev'")
_search(
    "log_window",
    ("S5",),
    {"namespace": "prod", "pod": "pod-3", "since": "2024-01-05 12:00:00", "until": "2024-01-20 00:00:00"},
    "namespace = 'prod' and pod = 'pod-3' and ns >= 1704456000000000000 and ns < 1705708800000000000",
)
_search(
    "log_component",
    ("S5", "S10"),
    {"namespace": "prod", "component": "component_1"},
    "namespace = 'prod' and component = 'component_1'",
    older=False,
)
_search(
    "log_severity_floor",
    ("S7",),
    {"namespace": "dev", "severity": "warning"},
    f"namespace = 'dev' and {RANK % 'level'} >= 2",
)
_search(
    "log_text_search",
    ("S8", "J9"),
    {"namespace": "dev", "text": "only IN v1 1"},
    "namespace = 'dev' and contains(lower(message), 'only in v1 1')",
)

ORDER = "ns, layout, day, file_digest, line_index"
PAGED = ctes("log_v2_v", "log_v1_v", newer=NEWER, firsts=FIRST, older=OLDER) + f"""select {SHOWN} from
(select {SHOWN} from firsts where namespace = 'dev' union all select {SHOWN} from ({ALONE}) where namespace = 'dev')
order by {ORDER} limit 200"""


@register("log_first_page", "S12", "H2", sql=PAGED)
def _first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(logs.page(_landed(spark, sf_dir).search(logs.Search("dev")), 200))


@register("log_second_page", "S12", "H3", sql=PAGED + " offset 200")
def _second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _landed(spark, sf_dir).search(logs.Search("dev"))
    cursor = logs.last_position(logs.page(lines, 200))
    return _shown(logs.page(lines, 200, cursor))


@register(
    "structured_records",
    "S13",
    sql="""select event_id, 'info' as level, event_type as message, cast(user_id as varchar) as user_id from events""",
)
def _structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.to_json(
            F.struct(
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.lit("info").alias("level"),
                F.col("event_type").alias("message"), "user_id",
            )
        ).alias("line"),
    )
    known, rest = logs.structured(F.col("line"))
    return events.select("event_id", known.alias("k"), rest.alias("rest")).select(
        "event_id", "k.level", "k.message", F.col("rest")["user_id"].alias("user_id")
    )


SINCE, UNTIL = datetime(2024, 1, 5, 22, tzinfo=UTC), datetime(2024, 1, 7, 3, tzinfo=UTC)


def _archive(spark: SparkSession, sf_dir: str, mixed: bool = False) -> str:
    """The newer records as gzipped NDJSON under namespace, date and hour; if `mixed`, some days without their hours."""
    folder = scratch(spark, "archive")
    rows = view(spark, sf_dir, "log_v2_v")
    fields = [c for c in logs.V2_FIELDS if c in rows.columns]
    lines = rows.select(
        "namespace",
        F.col("day").alias("date"),
        F.substring("time", 12, 2).alias("hour"),
        F.concat(
            F.to_json(F.struct(*fields)),
            # Blank lines and lines that are no object are not records; a lone carriage return ends none.
            F.when(F.col("event_id") % 50 == 0, "\n\n[1]\n \r").otherwise(""),
        ).alias("value"),
    ).repartition("date")
    flat = F.col("date").isin("2024-01-06", "2024-01-07", "2024-01-20") if mixed else F.lit(False)
    lines.where(~flat).write.partitionBy("namespace", "date", "hour").option("compression", "gzip").text(folder)
    if mixed:
        lines.where(flat).drop("hour").write.mode("append").partitionBy("namespace", "date").option("compression", "gzip").text(folder)
    return folder


@register(
    "archive_scan",
    "A4",
    "S4",
    sql=ctes("log_v2_v") + """select namespace, day, count(*) as n, count(distinct dedup_key) as keys from log_v2_v
    group by 1, 2""",
)
def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = logs.parse_records(logs.with_line_index(files.ndjson_lines(spark, _archive(spark, sf_dir), "*.txt.gz")))
    return records.groupBy("namespace", "day").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("dedup_key").alias("keys")
    )


WINDOWED = ctes("log_v2_v") + f"""select time[12:13] as hour, count(*) as n from log_v2_v where namespace = 'dev'
and {NS} >= 1704492000000000000 and {NS} < 1704596400000000000 group by 1"""


def _in_window(spark: SparkSession, folder: str) -> DataFrame:
    lines = files.ndjson_lines(spark, folder, "*.txt.gz").where(F.col("namespace") == "dev")
    pruned = lines.where(files.window_partitions(SINCE, UNTIL, timedelta(hours=1))).where(
        files.uploaded_since(SINCE)
    )
    records = pruned.withColumn("r", F.from_json("record", logs.RECORD)).where(F.trim("record").startswith("{"))
    at = loglines.instant(F.col("r.time"))
    inside = records.where((at >= F.lit(SINCE)) & (at < F.lit(UNTIL)))
    return inside.groupBy(F.substring("r.time", 12, 2).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@register("archive_window", "S1", "S2", "S3", sql=WINDOWED)
def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the window's partitions are read, files uploaded too early are skipped, and event time still decides."""
    return _in_window(spark, _archive(spark, sf_dir))


@register("archive_window_mixed_depth", "A4", "S1", "S3", sql=WINDOWED)
def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same window over an archive that keeps some days by the hour and others whole."""
    return _in_window(spark, _archive(spark, sf_dir, mixed=True))
