"""Schedules, reminders, symptom and mood logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careline.functions.core import let, nz
from careline.functions.text import clamp, mood_text
from careline.rules import care

DAY = 1440


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def minutes_until(target: Column, now: Column) -> Column:
    """Minutes to the next time the clock shows ``target``; wraps over midnight."""
    return F.pmod(target - now, F.lit(DAY))


def parse_clock(c: Column) -> Column:
    """``HH:MM`` as minute of the day."""
    part = F.split(c, ":")
    return F.get(part, F.lit(0)).cast("int") * 60 + F.get(part, F.lit(1)).cast("int")


def default_routine() -> Column:
    """The default day as an array in schedule order."""
    return F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(a).alias("activity"), F.lit(s).alias("start_min"),
                 F.lit(m).alias("duration_min"), F.lit(d).alias("description"),
                 F.lit(r).alias("is_required"))
        for i, a, s, m, d, r in care.ROUTINE])


def pack_routines(items: DataFrame, user: str = "nickname") -> DataFrame:
    """Per user the routine as an array; a routine is a day plan, so it is short."""
    return items.groupBy(user).agg(F.array_sort(F.collect_list(F.struct(
        F.col("start_min").alias("i"), "activity", "start_min", "duration_min", "description",
        "is_required"))).alias("routine"))


def current_activity(now: Column, routine: Column | None = None) -> Column:
    """First item running at the minute (both ends count), with the minutes left.

    An item that ends after midnight is also found after midnight.
    """
    items = default_routine() if routine is None else routine
    return let(now, lambda n: let(F.get(F.filter(
        items, lambda x: F.pmod(n - x["start_min"], F.lit(DAY)) <= x["duration_min"]),
        F.lit(0)), lambda x: F.when(x.isNotNull(), F.struct(
            x["activity"].alias("activity"), x["description"].alias("description"),
            minutes_until(F.pmod(x["start_min"] + x["duration_min"], F.lit(DAY)), n)
            .alias("minutes_remaining")))))


def next_activity(now: Column, routine: Column | None = None) -> Column:
    """First item that starts later today, else the first of tomorrow."""
    items = default_routine() if routine is None else routine
    return let(now, lambda n: let(
        F.struct(F.get(F.filter(items, lambda x: x["start_min"] > n), F.lit(0)).alias("a"),
                 F.get(items, F.lit(0)).alias("b")),
        lambda s: let(F.coalesce(s["a"], s["b"]), lambda x: F.struct(
            x["activity"].alias("activity"), x["description"].alias("description"),
            s["a"].isNull().alias("is_tomorrow"),
            minutes_until(x["start_min"], n).alias("minutes_until")))))


def due_medications(nows: DataFrame, meds: DataFrame, user: str = "nickname",
                    minute: str = "now_min", before: int = care.DUE_BEFORE,
                    within: int = care.DUE_WITHIN) -> DataFrame:
    """Active medication times from ``before`` minutes ago to ``within`` minutes ahead.

    The difference is taken around the clock, so a time just after midnight is due just
    before it. A plan is packed to one row per user first: the join then matches each
    moment with one row, and a user with very many moments only splits the larger side.
    """
    times = meds.filter("is_active").select(user, F.col("name").alias("medication"),
                                            F.explode("times").alias("t"))
    plans = times.groupBy(user).agg(F.array_sort(F.collect_set(F.struct(
        parse_clock(F.col("t")).alias("m"), "medication"))).alias("_plan"))

    def distance(m: Column) -> Column:
        return F.pmod(m - F.col(minute) + before, F.lit(DAY)) - before

    due = F.filter("_plan", lambda x: distance(x["m"]) <= within)
    return nows.join(plans, user).select(
        *nows.columns, F.explode(due).alias("_d")).select(
        *nows.columns, F.col("_d.medication").alias("medication"),
        F.col("_d.m").alias("scheduled_min"),
        (distance(F.col("_d.m")) < 0).alias("is_overdue"))


def daily_summary(log: DataFrame, keys: Sequence[str], required: Column | int,
                  activity: str = "activity", status: str = "status") -> DataFrame:
    """Per user and day: activities by status, completion rate and total.

    Equal activities are counted first, so no task gathers the raw log of a busy user.
    """
    counted = log.groupBy(*keys, status, activity).agg(F.count("*").cast("int").alias("_n"))

    def lists(of: Column) -> Column:
        packed = F.array_sort(F.collect_list(F.when(of, F.struct(activity, "_n"))))
        return F.flatten(F.transform(packed, lambda x: F.array_repeat(x[activity], x["_n"])))

    done, skip = F.col(status) == "completed", F.col(status) == "skipped"
    need = F.lit(required) if isinstance(required, int) else required
    out = counted.groupBy(*keys).agg(
        lists(done).alias("completed"), lists(skip).alias("skipped"),
        lists(~done & ~skip).alias("pending"))
    return out.withColumn(
        "completion_rate",
        F.when(need > 0, F.size("completed") / need).otherwise(F.lit(0.0)),
    ).withColumn("total_activities", F.size("completed") + F.size("skipped"))


def adherence(log: DataFrame, users: DataFrame, until: Column, days: int = 7,
              user: str = "nickname", at: str = "scheduled_time",
              taken: str = "was_taken") -> DataFrame:
    """Share of doses taken in the last days, 0 for a user without any."""
    recent = log.filter((F.col(at) > until - F.expr(f"INTERVAL {days} DAYS"))
                        & (F.col(at) <= until))
    rates = recent.groupBy(user).agg(
        F.count("*").alias("doses"), F.avg(F.col(taken).cast("int")).alias("rate"))
    return users.select(user).distinct().join(rates, user, "left").select(
        user, F.coalesce("doses", F.lit(0)).alias("doses"),
        F.coalesce("rate", F.lit(0.0)).alias("adherence_rate"))


def activity_rollup(log: DataFrame, keys: Sequence[str], at: str, now: Column) -> DataFrame:
    """Count and last time per activity, with the age in words."""
    hours = F.floor((F.unix_timestamp(now) - F.unix_timestamp("last_time")) / 3600)
    age = (
        F.when(hours < 1, care.AGE_NOW)
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(care.AGE_HOURS)))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit(care.AGE_DAYS)))
    )
    return log.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(at).alias("last_time")).withColumn("age", age)


def mood_log(rows: DataFrame) -> DataFrame:
    """Mood rows with the energy held to 1..10 and a readable text (of the raw value)."""
    return rows.select(
        "nickname", F.lit("mood_record").alias("type"), "mood",
        clamp(F.col("energy_level"), 1, 10).alias("energy_level"),
        mood_text(F.col("mood"), F.col("energy_level"), nz("notes")).alias("text"), "timestamp")


def symptom_history(symptoms: DataFrame, moods: DataFrame, last: int = 50,
                    days: int | None = None, until: Column | None = None,
                    user: str = "nickname") -> DataFrame:
    """Symptom rows, then mood rows of each user, the last ``last`` of them in that order;
    with ``days`` only recent ones. Rows of one time are ordered by their other columns, so the cut is
    repeatable. The row limit is pushed below the exchange."""
    both = symptoms.withColumn("_part", F.lit(0)).unionByName(
        moods.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    if days is not None:
        both = both.filter(F.col("timestamp") > until - F.expr(f"INTERVAL {days} DAYS"))
    ties = [F.col(c).desc() for c in sorted(both.columns) if c not in (user, "_part", "timestamp")]
    w = Window.partitionBy(user).orderBy(F.col("_part").desc(), F.col("timestamp").desc(), *ties)
    return both.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last).drop(
        "_r", "_part")
