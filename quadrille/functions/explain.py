"""Words for what a forecast rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import timeutil

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def time_of_week(local: Column, holiday: Column, minutes: int = 15) -> Column:
    """Weekday, clock and season of the bin after `local`, with the labels of `local` itself."""
    ahead = local + F.expr(f"interval {minutes} minutes")
    marks = timeutil.calendar(local)
    labels = [F.when(c, F.lit(word)) for c, word in ((marks["is_morning_rush"], "morning rush"), (marks["is_evening_rush"], "evening rush"), (marks["is_weekend"], "weekend"), (holiday, "public holiday"))]
    day = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.extract(F.lit("dayofweek_iso"), ahead))
    return F.concat_ws(", ", F.concat_ws(" ", day, F.date_format(ahead, "HH:mm")), *labels, timeutil.season_of(F.month(ahead)))


def drivers(rows: DataFrame, holidays: DataFrame) -> DataFrame:
    """rows(local, recent, typical, last_week, ...) with the deviation from the usual level in per cent, its direction (both null
    where there is no usual level) and the time of the week; holidays(holiday_date, ...) are local dates."""
    known = F.col("typical") > 0
    out = rows.join(holidays.select("holiday_date"), F.to_date("local") == F.col("holiday_date"), "left")
    return out.withColumns({
        "percent_off": F.when(known, 100 * F.abs(F.col("recent") / F.col("typical") - 1)), "direction": F.when(known, F.when(F.col("recent") >= F.col("typical"), "above").otherwise("below")),
        "time_of_week": time_of_week(F.col("local"), F.col("holiday_date").isNotNull())}).drop("holiday_date")
