"""Interview calendars and the assignment of slots to ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenloom.dims.stages import INTERVIEW_DAYS_AHEAD, INTERVIEW_TIMES

SUNDAY = 1
SLOT_FORMAT = "yyyy-MM-dd HH:mm"


def slot_calendar(
    calendars: DataFrame,
    days_ahead: int = INTERVIEW_DAYS_AHEAD,
    times: list[str] = INTERVIEW_TIMES,
    skip_sunday: bool = True,
) -> DataFrame:
    """(calendar_id, slot) for the days after each calendar's ``as_of`` date."""
    days = F.sequence(F.date_add("as_of", 1), F.date_add("as_of", days_ahead))
    by_day = calendars.where(F.lit(days_ahead) > 0).select("calendar_id", F.explode(days).alias("day"))
    if skip_sunday:
        by_day = by_day.where(F.dayofweek("day") != SUNDAY)
    slots = by_day.select("calendar_id", "day", F.explode(F.array(*[F.lit(t) for t in times])).alias("time"))
    slot = F.to_timestamp(F.concat_ws(" ", F.date_format("day", "yyyy-MM-dd"), "time"), SLOT_FORMAT)
    return slots.select("calendar_id", slot.alias("slot"))


def free_slots(slots: DataFrame, booked: DataFrame) -> DataFrame:
    return slots.join(booked, ["calendar_id", "slot"], "left_anti")


def number_slots(slots: DataFrame) -> DataFrame:
    """Order of the slots of a calendar; a calendar holds at most days x times of them."""
    window = Window.partitionBy("calendar_id").orderBy("slot")
    return slots.withColumn("slot_number", F.row_number().over(window).cast("long"))


def schedule(requests: DataFrame, slots: DataFrame) -> DataFrame:
    """The i-th request of a calendar takes its i-th free slot; the rest get none.

    ``requests`` carry (calendar_id, position, candidate_id). The position joins the slot number, so no
    request list is gathered anywhere.
    """
    numbered = number_slots(slots).withColumnRenamed("slot_number", "position")
    assigned = requests.join(numbered, ["calendar_id", "position"], "left")
    free = F.col("slot").isNotNull()
    return assigned.select(
        "calendar_id",
        "candidate_id",
        "position",
        "slot",
        F.when(free, "scheduled").otherwise("no_slots_available").alias("status"),
        (~free).alias("conflict"),
    )


def slot_text(slot: Column) -> Column:
    return F.date_format(slot, SLOT_FORMAT)


def schedule_report(scheduled: DataFrame, names: DataFrame) -> DataFrame:
    """Scheduled interviews with candidate names; an unknown name shows as a dash."""
    named = scheduled.where(~F.col("conflict")).join(names.select("candidate_id", "name"), "candidate_id", "left")
    return named.select(
        "calendar_id",
        "candidate_id",
        F.coalesce("name", F.lit("—")).alias("name"),
        slot_text(F.col("slot")).alias("slot"),
        "status",
    )
