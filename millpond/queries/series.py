"""Run series and metric series over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import series
from ..registry import register
from ..shapes import ctes, view

END = 1706659200000000  # 2024-01-31 00:00 UTC
WEEK = series.Grid(END, series.MAX_RANGE, series.HOUR)
START, STEP = WEEK.start, WEEK.step
POINT = f"cast({START} + ceil((%s - {START}) / {STEP}::double) * {STEP} as bigint)"
GRID = f"select unnest(generate_series({START + STEP}::bigint, {END}::bigint, {STEP}::bigint)) as t"
STATUS = """case status when 'SUCCESS' then 'succeeded' when 'FAILURE' then 'failed' when 'CANCELED' then 'canceled'
when 'CANCELING' then 'canceled' else 'running' end"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "runs_v")


def _counts_sql(runs: str) -> str:
    return f"""select j.stage, j.job_name, s.status, g.t, cast(count(r.run_id) as bigint) as value
    from (select distinct stage, job_name from {runs} where created_us > {START} and created_us <= {END}) j
    cross join (select unnest(['succeeded', 'failed', 'canceled', 'running']) as status) s cross join ({GRID}) g
    left join (select *, {STATUS} as word, {POINT % 'created_us'} as t from {runs} where created_us > {START}
    and created_us <= {END}) r on r.stage = j.stage and r.job_name = j.job_name and r.word = s.status and r.t = g.t
    group by all"""


@register("run_counts", "P1", "J19", sql=ctes("runs_v") + _counts_sql("runs_v"))
def _run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.run_counts(_runs(spark, sf_dir), WEEK)


@register(
    "run_durations",
    "P2",
    sql=ctes("runs_v") + f"""select j.stage, j.job_name, g.t, max(r.duration_s) as value
    from (select distinct stage, job_name from runs_v where created_us > {START} and created_us <= {END}) j
    cross join ({GRID}) g left join (select *, {POINT % 'created_us'} as t from runs_v where created_us > {START}
    and created_us <= {END}) r on r.stage = j.stage and r.job_name = j.job_name and r.t = g.t group by all""",
)
def _run_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.run_durations(_runs(spark, sf_dir), WEEK)


CAP = 60


@register(
    "capped_run_counts",
    "P3",
    "H5",
    sql=ctes(
        "runs_v",
        newest=f"""select * from (select *, row_number() over (partition by stage order by created_us desc, run_id desc)
        as n from runs_v where created_us > {START}) where n <= {CAP}""",
        bound=f"""select stage, count(*) < {CAP} as complete, case when count(*) >= {CAP} then min(created_us) end
        as covered_from from newest group by 1""",
        counted=_counts_sql("newest"),
    ) + f"""select c.stage, c.job_name, c.status, c.t, case when b.covered_from is null or c.t - {STEP} >= b.covered_from
    then c.value end as value, b.complete from counted c join bound b on c.stage = b.stage""",
)
def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.capped_counts(_runs(spark, sf_dir), WEEK, CAP)


@register(
    "job_set",
    "P4",
    "I2",
    sql=ctes("runs_v") + """select distinct stage, job_name from (select stage, job_name from runs_v union all
    select stage, concat(case when job_name = 'job_0' then '__' else 'declared_' end, job_name) from runs_v)
    where job_name not like '\\_\\_%' escape '\\'""",
)
def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    prefix = F.when(F.col("job_name") == "job_0", "__").otherwise("declared_")
    return series.job_set(runs, runs.withColumn("job_name", F.concat(prefix, "job_name")))


SINCE = END - 2 * series.DAY


@register(
    "failed_runs",
    "P5",
    "H5",
    sql=ctes(
        "runs_v",
        own="""select * from (select *, row_number() over (partition by stage, job_name order by created_us desc,
        run_id desc) as n from runs_v) where n <= 25""",
        reach=f"""select stage, job_name, count(*) < 25 or min(created_us) <= {SINCE} as reaches,
        min(created_us) as oldest from own group by 1, 2""",
        staged=f"""select * from (select *, row_number() over (partition by stage order by created_us desc, run_id desc)
        as n from runs_v where created_us > {SINCE}) where n <= 90""",
        seen=f"""select stage, job_name, run_id, true as mine from own where status = 'FAILURE' and created_us > {SINCE}
        union select stage, job_name, run_id, false from staged where status = 'FAILURE'""",
    ) + f"""select r.stage, r.job_name, case when r.reaches then (select count(*) from seen s where s.stage = r.stage
    and s.job_name = r.job_name and s.mine) else (select count(distinct run_id) from seen s where s.stage = r.stage
    and s.job_name = r.job_name) end as failed, case when not r.reaches and b.n >= 90
    and least(r.oldest, b.oldest) > {SINCE} then least(r.oldest, b.oldest) end as covered_from from reach r
    left join (select stage, count(*) as n, min(created_us) as oldest from staged group by 1) b on r.stage = b.stage""",
)
def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.failed_runs(_runs(spark, sf_dir), SINCE, cap=90)


@register(
    "due_times",
    "P6",
    sql=ctes("schedules_v") + f"""select stage, job_name, count(*) as dues, max(due) as latest,
    {END} - ({END} - any_value(anchor_us)) % any_value(interval_us) as computed from (select *,
    unnest(generate_series(anchor_us, {END}::bigint, interval_us)) as due from schedules_v) group by 1, 2""",
)
def _dues(spark: SparkSession, sf_dir: str) -> DataFrame:
    dues = series.due_times(view(spark, sf_dir, "schedules_v"), END)
    computed = series.latest_due(F.col("anchor_us"), F.col("interval_us"), F.lit(END).cast("bigint"))
    return dues.groupBy("stage", "job_name").agg(
        F.count(F.lit(1)).alias("dues"), F.max("due").alias("latest"), F.max(computed).alias("computed")
    )


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "samples_v")


INSIDE = f"select *, {POINT % 'ts_us'} as t from samples_v where ts_us > {START} and ts_us <= {END}"


@register(
    "gauge_on_grid",
    "P7",
    "P12",
    "J20",
    sql=ctes("samples_v", inside=INSIDE) + f"""select s.series, g.t, l.value from (select distinct series from inside) s
    cross join ({GRID}) g left join (select series, t, arg_max(gauge, ts_us) as value from inside group by 1, 2) l
    on l.series = s.series and l.t = g.t""",
)
def _gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.gauge(_samples(spark, sf_dir), WEEK, ["series"])


@register(
    "sum_over_time",
    "P8",
    "F15",
    sql=ctes("samples_v", inside=INSIDE) + """select series, t, cast(sum(counter) as bigint) as value from inside
    group by 1, 2""",
)
def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.sum_over_time(_samples(spark, sf_dir), WEEK, ["series"], "counter")


def _stretched(source: str, width: int) -> dict[str, str]:
    """The steps of an extrapolated increase over the windows (t - width, t] of `source`."""
    return {
        "stepped": f"select *, lag(v) over (partition by series, t order by ts_us) as before from {source}",
        "folded": """select series, t, count(*) as n, min(ts_us) as first_us, max(ts_us) as last_us,
        arg_min(v, ts_us) as first, arg_max(v, ts_us) as last, sum(case when v < before then before else 0 end)
        as restarts from stepped group by 1, 2 having count(*) >= 2""",
        "spans": f"""select *, cast(last - first + restarts as double) as gain, (last_us - first_us) / 1e6::double as sampled,
        (first_us - (t - {width})) / 1e6::double as head0, (t - last_us) / 1e6::double as tail0 from folded""",
        "heads": """select *, case when head0 >= sampled / (n - 1) * 1.1::double then sampled / (n - 1) / 2 else head0 end
        as head1, case when tail0 >= sampled / (n - 1) * 1.1::double then sampled / (n - 1) / 2 else tail0 end as tail
        from spans""",
        "gains": """select series, t, gain * ((sampled + case when gain > 0 and first >= 0 and sampled * (first / gain) < head1
        then sampled * (first / gain) else head1 end + tail) / sampled) as gained from heads""",
    }


@register(
    "counter_increase",
    "P9",
    "F15",
    sql=ctes("samples_v", inside=INSIDE, own="select series, t, ts_us, counter as v from inside", **_stretched("own", WEEK.step))
    + "select series, t, gained as value from gains",
)
def _increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.increase(_samples(spark, sf_dir), WEEK, ["series"])


HOURLY = f"cast(ceil(ts_us / {series.HOUR}::double) * {series.HOUR} as bigint)"


@register(
    "counter_increments",
    "P10",
    "G5",
    sql=ctes(
        "samples_v",
        hourly=f"""select series, {HOURLY} as t, max(counter) as high, arg_max(counter, ts_us) as last_value,
        max(created_us) as born from samples_v group by 1, 2""",
    ) + f"""select h.series, h.t, cast(case when b.series is not null then greatest(h.high - b.last_value, 0)
    when h.t - h.born < {2 * series.HOUR} then h.high else 0 end as bigint) as value from hourly h
    left join hourly b on b.series = h.series and b.t = h.t - {series.HOUR}""",
)
def _increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.increments(
        _samples(spark, sf_dir), ["series"], series.HOUR, created="created_us", new_within=2 * series.HOUR
    )


@register(
    "counter_rate_by_component",
    "P11",
    sql=ctes(
        "samples_v",
        spread=f"""select series, ts_us, counter as v, {HOURLY} + i * {series.HOUR} as t from samples_v
        cross join (select unnest([0, 1]) as i)""",
        **_stretched("spread", 2 * series.HOUR),
        rates=f"select series, t, gained / {2 * series.HOUR / 1e6}::double as rate from gains",
        labels="select distinct series, stage, component from samples_v",
    ) + """select stage, component, t, round(fsum(rate), 9) as value from rates
    join labels using (series) where stage is not null group by 1, 2, 3""",
)
def _rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir)
    points = series.rate(samples, ["series"], series.HOUR, 2)
    labels = samples.select("series", "stage", "component").distinct()
    reduced = series.sum_by(points, labels, ["stage", "component"])
    # DuckDB's sum is compensated, not exact.
    return reduced.withColumn("value", F.round("value", 9))


@register(
    "newest_labels",
    "E12",
    sql=ctes("samples_v") + f"""select series, component, ts_us from (select series, case when up = 0 then 'unlabelled'
    else component end as component, ts_us, row_number() over (partition by series order by ts_us desc, component) as n
    from samples_v where ts_us > {END - 2 * series.DAY} and ts_us <= {END}) where n = 1""",
)
def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _samples(spark, sf_dir).select(
        "series", F.when(F.col("up") == 0, "").otherwise(F.col("component")).alias("component"), "ts_us"
    )
    return series.newest_labels(labels, ["series"], END, 2 * series.DAY)


@register(
    "available_lines",
    "P13",
    sql=ctes("samples_v", inside=INSIDE) + """select series, t, arg_max(gauge, ts_us) as value from inside
    where series in (select series from inside where up = 1 and series <> 'series_2') group by 1, 2""",
)
def _available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target of one series was down throughout: it has no line."""
    samples = _samples(spark, sf_dir)
    up = samples.withColumn("up", F.when(F.col("series") == "series_2", 0).otherwise(F.col("up")))
    points = series.gauge(samples, WEEK, ["series"]).where("value is not null")
    return series.available(points, up, WEEK, ["series"])
