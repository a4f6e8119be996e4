"""Behaviour analytics: funnels, cohorts, anomalies, weekly movements, campaigns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.panels import _is_view, _shares, period
from trailmark.operators.sessions import VISITOR, session_table

DAY_SECONDS = 86_400
SLICE_SECONDS = 600


def funnel_levels(
    events: DataFrame,
    steps: Sequence[str],
    window_seconds: int = DAY_SECONDS,
    keys: Sequence[str] = VISITOR,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Deepest funnel step per visitor (visitors without step 1 are absent).

    A visitor reaches step i when events of steps 1..i follow each other in time order
    and the last is at most `window_seconds` after the first.

    Events are searched within short time slices of their visitor and each slice is
    summarized: the latest start of a chain of steps 1..j, and for each i <= j the earliest
    end of a chain of steps i..j. Summaries are then combined in time order: a chain left
    open by earlier slices is carried on by the steps a slice holds. So a task holds one
    slice of events of a visitor, or the summaries of a visitor, never a visitor's events.
    """
    step_of = F.lit(None).cast("int")
    for i, step in enumerate(steps, start=1):
        step_of = F.when(F.col("event_type") == step, F.lit(i)).otherwise(step_of)
    if len(set(steps)) != len(steps):
        raise ValueError("funnel steps must differ")

    width, n = window_seconds * 1_000_000, len(steps)
    at, step = F.col("at"), F.col("step")
    rows = (
        events.filter(F.col("event_type").isin(*steps))
        .select(*keys, F.unix_micros("timestamp").alias("at"), "event_id", step_of.alias("step"))
        .withColumn("slice", F.floor(at / F.lit(slice_seconds * 1_000_000)).cast("long"))
    )
    before = Window.partitionBy(*keys, "slice").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    # start_j: latest start of steps 1..j ending here; end_i_j: this row, if steps i..j end here
    rows = rows.withColumns({
        "start_1": F.when(step == 1, at), **{f"end_{i}_{i}": F.when(step == i, at) for i in range(2, n + 1)},
    })
    for j in range(2, n + 1):
        rows = rows.withColumns({
            f"start_{j}": F.when(step == j, F.max(f"start_{j - 1}").over(before)),
            **{f"end_{i}_{j}": F.when((step == j) & F.min(f"end_{i}_{j - 1}").over(before).isNotNull(), at)
               for i in range(2, j)},
        })
    whole = F.max(F.coalesce(*[F.when(at - F.col(f"start_{j}") <= width, F.lit(j)) for j in range(n, 0, -1)]))
    spans = [(i, j) for j in range(2, n + 1) for i in range(2, j + 1)]
    slices = rows.groupBy(*keys, "slice").agg(
        whole.alias("reached"),
        *[F.max(f"start_{j}").alias(f"start_{j}") for j in range(1, n + 1)],
        *[F.min(f"end_{i}_{j}").alias(f"end_{i}_{j}") for i, j in spans],
    )
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    for j in range(1, n + 1):
        # open_j: latest start of steps 1..j that ended in an earlier slice
        carried = [F.when(F.col(f"end_{i}_{j}").isNotNull(), F.col(f"open_{i - 1}")) for i in range(2, j + 1)]
        latest = F.greatest(F.col(f"start_{j}"), *carried) if carried else F.col(f"start_{j}")
        slices = slices.withColumn(f"latest_{j}", latest).withColumn(f"open_{j}", F.max(f"latest_{j}").over(earlier))
    joined = [
        F.when(F.col(f"end_{i}_{j}") - F.col(f"open_{i - 1}") <= width, F.lit(j)) for i, j in sorted(spans, key=lambda s: -s[1])
    ]
    level = F.greatest(F.col("reached"), F.coalesce(*joined)) if joined else F.col("reached")
    return slices.groupBy(*keys).agg(F.max(level).alias("level")).filter(F.col("level").isNotNull())


def funnel(
    events: DataFrame,
    steps: Sequence[str],
    window_seconds: int = DAY_SECONDS,
    by: Sequence[str] = ("website_id",),
) -> DataFrame:
    """Visitors reaching each step, with the rate against step 1 and the step before."""
    levels = funnel_levels(events, steps, window_seconds, tuple(dict.fromkeys([*by, *VISITOR])))
    numbers = range(1, len(steps) + 1)
    wide = levels.groupBy(*by).agg(
        *[F.count_if(F.col("level") >= i).alias(f"n_{i}") for i in numbers]
    )
    rows = [
        F.struct(
            F.lit(i).alias("step"),
            F.lit(name).alias("event_type"),
            F.col(f"n_{i}").alias("visitors"),
            F.try_divide(f"n_{i}", "n_1").alias("rate"),
            F.try_divide(f"n_{i}", f"n_{max(i - 1, 1)}").alias("step_rate"),
        )
        for i, name in zip(numbers, steps)
    ]
    return wide.select(*by, F.explode(F.array(*rows)).alias("row")).select(*by, "row.*")


def _offset(grain: str, start: Column, current: Column) -> Column:
    if grain == "month":
        months = (F.year(current) - F.year(start)) * 12 + F.month(current) - F.month(start)
        return months.cast("long")
    days = F.date_diff(current, start)
    return (F.floor(days / 7) if grain == "week" else days).cast("long")


def retention(events: DataFrame, grain: str = "week") -> DataFrame:
    """Cohorts by first-seen period: clients active n periods later and their rate.

    Activity is reduced to distinct client periods first, so the window that finds the
    first one runs over at most one row per client and period.
    """
    active = events.select(*VISITOR, period(grain).alias("period")).distinct()
    first = F.min("period").over(Window.partitionBy(*VISITOR))
    cells = (
        active.withColumn("cohort", first)
        .groupBy("website_id", "cohort", "period")
        .agg(F.count("*").alias("clients"))
    )
    size = F.max(F.when(F.col("period") == F.col("cohort"), F.col("clients"))).over(
        Window.partitionBy("website_id", "cohort")
    )
    return cells.select(
        "website_id",
        "cohort",
        _offset(grain, F.col("cohort"), F.col("period")).alias("offset"),
        "clients",
        (F.col("clients") / size).alias("rate"),
    )


def retention_matrix(events: DataFrame, grain: str = "week", periods: int | None = None) -> DataFrame:
    """Retention rates with one column per offset: `p0, p1, ...`.

    Without `periods` there is a column for every offset between the first and the last
    period of the data, which are looked up first; a number limits the report to that many.
    """
    if periods is None:
        ends = events.agg(F.min(period(grain)).alias("a"), F.max(period(grain)).alias("b"))
        last = ends.select(_offset(grain, F.col("a"), F.col("b")).alias("n")).first()["n"]
        periods = 1 + (last or 0)
    cells = retention(events, grain)
    return cells.groupBy("website_id", "cohort").agg(*[
        F.max(F.when(F.col("offset") == i, F.col("rate"))).alias(f"p{i}") for i in range(periods)
    ])


def anomalies(
    daily: DataFrame,
    metric: str = "pageviews",
    mode: str = "weekday",
    history: int = 8,
    min_history: int = 2,
    threshold: float = 2.0,
) -> DataFrame:
    """Daily metric with its z-score against earlier days, flagged at |z| >= threshold.

    `daily` holds `date, website_id` and the metric, e.g. a stored `daily_stats`.
    `mode="weekday"` compares with the same weekday, `mode="trailing"` with the days just
    before. Days with too little history or no spread get no score.
    """
    if mode not in ("weekday", "trailing"):
        raise ValueError("mode is 'weekday' or 'trailing'")
    keys = ["website_id"] + ([F.dayofweek("date")] if mode == "weekday" else [])
    past = Window.partitionBy(*keys).orderBy("date").rowsBetween(-history, -1)
    value = F.col(metric).cast("double")
    spread = F.stddev_samp(value).over(past)
    enough = F.count(value).over(past) >= min_history
    return daily.select(
        "date",
        "website_id",
        F.col(metric),
        F.avg(value).over(past).alias("expected"),
        F.when(enough & (spread > 0), (value - F.avg(value).over(past)) / spread).alias("z_score"),
    ).withColumn("is_anomaly", F.coalesce(F.abs("z_score") >= threshold, F.lit(False)))


def pct_change(daily: DataFrame, metric: str = "pageviews") -> DataFrame:
    """Daily metric with its percent change against the row before."""
    order = Window.partitionBy("website_id").orderBy("date")
    return daily.select(
        "date", "website_id", F.col(metric), F.lag(metric).over(order).alias("previous")
    ).withColumn(
        "pct_change", F.try_divide((F.col(metric) - F.col("previous")) * 100.0, F.col("previous"))
    )


def _with_last_week(weekly: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Each week's metric next to that of the week before, 0 where a side is missing.

    Every row is counted once as "this week" and once as "last week" of the week after,
    so appearing and vanishing keys come out of one aggregation, without a full join.
    The week after the newest one is left out.
    """
    newest = weekly.groupBy("website_id").agg(F.max("week").alias("newest"))
    zero = F.lit(0).cast(weekly.schema[metric].dataType)
    now = weekly.select(*keys, "week", F.col(metric).alias("current"), zero.alias("previous"))
    then = weekly.select(
        *keys, F.date_add("week", 7).alias("week"), zero.alias("current"), F.col(metric).alias("previous")
    )
    return (
        now.unionByName(then)
        .groupBy(*keys, "week")
        .agg(F.sum("current").alias("current"), F.sum("previous").alias("previous"))
        .join(newest, "website_id")
        .filter(F.col("week") <= F.col("newest"))
        .drop("newest")
    )


def page_movers(events: DataFrame, n: int = 5) -> DataFrame:
    """Pages that gained or lost most page views against the week before.

    `direction` is `up` or `down`; the `n` strongest of each per website and week.
    """
    weekly = events.filter(_is_view()).groupBy(
        "website_id", "url_path", period("week").alias("week")
    ).agg(F.count("*").alias("pageviews"))
    change = _with_last_week(weekly, ["website_id", "url_path"], "pageviews").withColumn(
        "change", F.col("current") - F.col("previous")
    )
    direction = F.when(F.col("change") > 0, F.lit("up")).otherwise(F.lit("down"))
    order = Window.partitionBy("website_id", "week", "direction").orderBy(
        F.desc(F.abs("change")), "url_path"
    )
    return (
        change.filter(F.col("change") != 0)
        .withColumn("direction", direction)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )


def new_sources(events: DataFrame) -> DataFrame:
    """Traffic sources first seen in the newest week of their website.

    The first week of a source is a mergeable minimum, so no join against earlier weeks
    is needed.
    """
    sources = events.filter(_is_view()).groupBy("website_id", "referrer_domain", "utm_source").agg(
        F.min("timestamp").alias("first_seen"), F.count("*").alias("pageviews")
    )
    newest = events.groupBy("website_id").agg(
        F.date_trunc("week", F.max("timestamp")).alias("newest_week")
    )
    return (
        sources.join(newest, "website_id")
        .filter(F.col("first_seen") >= F.col("newest_week"))
        .drop("newest_week")
    )


def device_shift(events: DataFrame) -> DataFrame:
    """Share of each device type per week and its move against the week before."""
    weekly = _shares(
        events.withColumn("week", period("week")), ["device_type"], ["website_id", "week"]
    ).select("website_id", "device_type", "week", "share")
    moved = _with_last_week(weekly, ["website_id", "device_type"], "share")
    return moved.select(
        "website_id", "device_type", "week",
        F.col("current").alias("share"),
        F.col("previous").alias("previous_share"),
        (F.col("current") - F.col("previous")).alias("shift"),
    )


def campaign_performance(events: DataFrame) -> DataFrame:
    """Sessions, converting sessions, purchases and revenue by first-touch campaign."""
    sessions = session_table(events)
    return sessions.groupBy(
        "website_id",
        F.col("first_utm_source").alias("utm_source"),
        F.col("first_utm_medium").alias("utm_medium"),
        F.col("first_utm_campaign").alias("utm_campaign"),
    ).agg(
        F.count("*").alias("sessions"),
        F.count_if(F.col("purchases") > 0).alias("converting_sessions"),
        F.sum("purchases").alias("purchases"),
        F.sum("revenue").alias("revenue"),
    )
