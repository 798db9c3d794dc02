"""Calendar and event features per trading day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.functions.scalars import last_weekday_of_month
from barlab.functions.windows import one_series

# The date weekly expiry moved from Thursday to Tuesday.
EXPIRY_CHANGE = "2025-09-02"
# Order of impact levels, strongest first.
IMPACT_ORDER = ("high", "medium", "low")


def calendar_features(dates: DataFrame, expiry_change: str = EXPIRY_CHANGE) -> DataFrame:
    """Day name, week of month, month and the weekly expiry (a no-trade day)."""
    d = F.col("date")
    expiry_day = F.when(d < F.lit(expiry_change).cast("date"), 3).otherwise(1)
    return dates.select("date").distinct().select(
        "date",
        F.date_format(d, "EEEE").alias("day_of_week"),
        (F.floor((F.dayofmonth(d) - 1) / 7) + 1).cast("int").alias("week_of_month"),
        F.month(d).alias("month"),
        (F.weekday(d) == expiry_day).alias("is_expiry_day"),
        (F.weekday(d) == expiry_day).alias("is_no_trade_day"),
    )


def one_event_per_date(events: DataFrame) -> DataFrame:
    """The strongest event of each date; equal impact goes to the first type in text order."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(i) for i in IMPACT_ORDER]), F.col("impact_level")), F.lit(0))
    strength = F.when(rank == 0, len(IMPACT_ORDER) + 1).otherwise(rank)
    first = F.min(F.struct(strength.alias("s"), F.col("event_type"), F.col("impact_level")))
    return events.groupBy("date").agg(first.alias("_e")).select(
        "date", F.col("_e.event_type").alias("event_type"), F.col("_e.impact_level").alias("event_impact")
    )


def event_flags(dates: DataFrame, events: DataFrame) -> DataFrame:
    single = one_event_per_date(events).withColumn("_hit", F.lit(True))
    out = dates.join(F.broadcast(single), "date", "left")
    return out.withColumns({
        "is_event_day": F.coalesce("_hit", F.lit(False)),
        "event_type": F.coalesce("event_type", F.lit("")),
        "event_impact": F.coalesce("event_impact", F.lit("")),
    }).drop("_hit")


def pre_post_event(flagged: DataFrame) -> DataFrame:
    """Whether the next or the previous trading day is an event day."""
    w = one_series("date")
    return flagged.withColumns({
        "is_pre_event": F.lead("is_event_day", 1, False).over(w),
        "is_post_event": F.lag("is_event_day", 1, False).over(w),
    })


def day_calendar(dates: DataFrame, events: DataFrame, expiry_change: str = EXPIRY_CHANGE) -> DataFrame:
    return pre_post_event(event_flags(calendar_features(dates, expiry_change), events))


def panel_calendar(panel: DataFrame) -> DataFrame:
    """Weekday, position in the month and distance to the monthly expiry (last Thursday)."""
    d = F.col("date")
    to_expiry = F.datediff(last_weekday_of_month(d, 3), d)
    return panel.withColumns({
        "day_of_week": F.weekday(d).cast("double"),
        "day_of_month": F.dayofmonth(d).cast("double"),
        "month": F.month(d).cast("double"),
        "days_to_month_end": F.datediff(F.last_day(d), d).cast("double"),
        "days_to_expiry": to_expiry.cast("double"),
        "is_expiry_week": to_expiry.between(0, 4).cast("double"),
    })
