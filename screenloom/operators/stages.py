"""The hiring process: stage changes one at a time, folds of long histories, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.dims.stages import NOT_IN_PROCESS, STAGES, TRANSITIONS
from screenloom.operators.positions import same_keys_join, with_position
from screenloom.session import stage as stage_table

EARLY = ["applied", "shortlisted"]
ABSENT = ""  # not in the process yet
STATES = [*STAGES, ABSENT]
CHUNK = 128  # events, and then chunks, folded at once
DEPTH = 2  # levels of chunks of chunks above the first
BLOCK = 1 << 16


def _states() -> Column:
    return F.array(*[F.lit(s) for s in STATES])


def allowed_from(state: Column) -> Column:
    """Stages that may follow; none for a final or unknown stage."""
    pairs: list[Column] = []
    for name, following in TRANSITIONS.items():
        pairs += [F.lit(name), F.array(*[F.lit(s) for s in following]).cast("array<string>")]
    return F.coalesce(F.element_at(F.create_map(*pairs), state), F.array().cast("array<string>"))


def next_state(state: Column, requested: Column, forced: Column) -> Column:
    """One step: forced requests always apply, others only where allowed."""
    return F.when(forced | F.array_contains(allowed_from(state), requested), requested).otherwise(state)


# ---- single requests -------------------------------------------------------------------------------------------


def register(arrivals: DataFrame, current: DataFrame) -> DataFrame:
    """Add arrivals (candidate_id, ord) as applied; who is already present keeps the stage."""
    first = arrivals.groupBy("candidate_id").agg(F.min("ord").alias("ord"))
    present = current.where(F.col("state").isNotNull()).select("candidate_id", "state")
    joined = first.join(present, "candidate_id", "left")
    return joined.select(
        "candidate_id",
        "ord",
        F.coalesce("state", F.lit("applied")).alias("state"),
        F.col("state").isNull().alias("added"),
    )


def request_results(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Outcome of single transition requests (candidate_id, new_state)."""
    joined = requests.join(current.select("candidate_id", "state"), "candidate_id", "left")
    allowed = allowed_from(F.col("state"))
    known = F.col("state").isNotNull()
    success = known & F.array_contains(allowed, F.col("new_state"))
    listed = F.concat(
        F.lit("["), F.array_join(F.transform(allowed, lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", "), F.lit("]")
    )
    not_found = F.concat(F.lit("Candidate "), "candidate_id", F.lit(" not found in pipeline."))
    invalid = F.concat(
        F.lit("Invalid transition: "), "state", F.lit(" → "), "new_state", F.lit(". Allowed: "), listed
    )
    return joined.select(
        "candidate_id",
        "new_state",
        success.alias("success"),
        F.when(success, F.col("state")).alias("previous"),
        F.when(success, F.col("new_state")).otherwise(F.col("state")).alias("current_state"),
        F.when(~known, not_found).when(~success, invalid).alias("error"),
    )


def sync_after_scheduling(
    ranked: DataFrame, scheduled: DataFrame, current: DataFrame, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Scheduled candidates move to interview_scheduled, early or new ones to rejected, later stages stay.

    ``carry`` names further columns of ``ranked`` to pass on."""
    taken = scheduled.where(~F.col("conflict")).select("jd_id", "candidate_id", F.lit(True).alias("taken"))
    joined = ranked.join(taken, ["jd_id", "candidate_id"], "left").join(
        current.select("candidate_id", "state"), "candidate_id", "left"
    )
    early = F.col("state").isNull() | F.col("state").isin(*EARLY)
    synced = F.when(F.col("taken"), "interview_scheduled").when(early, "rejected").otherwise(F.col("state"))
    return joined.select("jd_id", "candidate_id", *carry, F.col("state").alias("before"), synced.alias("state"))


def promote_past_interviews(states: DataFrame, scheduled: DataFrame, as_of: Column, keys: list[str]) -> DataFrame:
    """interview_scheduled becomes interviewed once the slot lies before ``as_of``. Slots that are no time stay."""
    slots = scheduled.select(*keys, F.try_to_timestamp(F.col("slot").cast("string")).alias("slot"))
    joined = states.join(slots, keys, "left")
    past = (F.col("state") == "interview_scheduled") & (F.col("slot") < as_of)
    return joined.withColumn("state", F.when(past, "interviewed").otherwise(F.col("state"))).drop("slot")


# ---- folds of event histories ----------------------------------------------------------------------------------
#
# An event is a function from stage to stage, so a run of events is one as well, stored as the array of its results
# for each of STATES. Such arrays compose in any grouping, which lets a long history be folded in chunks.


def with_sequence(events: DataFrame) -> DataFrame:
    """Number each candidate's events in time order; days and minutes keep every numbered group short."""
    minute = F.floor(F.unix_micros("ts") / 60_000_000)
    timed = events.withColumn("_day", F.floor(minute / 1440)).withColumn("_minute", minute)
    levels = [("_day", True), ("_minute", True)]
    return with_position(timed, ["candidate_id"], levels, [F.col("ts"), F.col("event_id")], "seq").drop(
        "_day", "_minute"
    )


def _chunks(sequenced: DataFrame) -> DataFrame:
    """(candidate_id, idx, events): up to CHUNK events in order."""
    event = F.struct("seq", "event_id", "ts", "new_state", "forced")
    idx = F.floor((F.col("seq") - 1) / CHUNK).alias("idx")
    return sequenced.groupBy("candidate_id", idx).agg(F.array_sort(F.collect_list(event)).alias("events"))


def _chunk_maps(chunks: DataFrame) -> DataFrame:
    folded = F.aggregate(
        "events",
        _states(),
        lambda acc, e: F.transform(acc, lambda s: next_state(s, e["new_state"], e["forced"])),
    )
    return chunks.select("candidate_id", "idx", folded.alias("map"))


def _apply(mapping: Column, state: Column) -> Column:
    return F.element_at(mapping, F.array_position(_states(), state).cast("int"))


def _grouped(maps: DataFrame, outer: Column) -> DataFrame:
    group = F.array_sort(F.collect_list(F.struct("idx", "map"))).alias("group")
    return maps.groupBy("candidate_id", outer.alias("outer")).agg(group)


def _compose(grouped: DataFrame) -> DataFrame:
    composed = F.aggregate(
        "group", _states(), lambda acc, m: F.transform(acc, lambda s: _apply(m["map"], s))
    )
    return grouped.select("candidate_id", F.col("outer").alias("idx"), composed.alias("map"))


def _entry_states(maps: DataFrame, start: str, depth: int = DEPTH) -> DataFrame:
    """(candidate_id, idx, entry): the stage in which each chunk begins."""
    if depth:
        grouped = _grouped(maps, F.floor(F.col("idx") / CHUNK))
        outer = _entry_states(_compose(grouped), start, depth - 1)
        grouped = same_keys_join(grouped, outer.withColumnRenamed("idx", "outer"), ["candidate_id", "outer"])
    else:
        grouped = _grouped(maps, F.lit(0)).withColumn("entry", F.lit(start))
    none = F.array().cast("array<struct<idx:bigint,entry:string>>")
    walked = F.aggregate(
        "group",
        F.struct(none.alias("seen"), F.col("entry").alias("state")),
        lambda acc, m: F.struct(
            F.concat(acc["seen"], F.array(F.struct(m["idx"].alias("idx"), acc["state"].alias("entry")))).alias("seen"),
            _apply(m["map"], acc["state"]).alias("state"),
        ),
    )
    return grouped.select("candidate_id", F.inline(walked["seen"]))


def fold_states(events: DataFrame, start: str = "applied") -> DataFrame:
    """Final stage of each candidate after all events (candidate_id, event_id, ts, new_state, forced)."""
    maps = _chunk_maps(_chunks(with_sequence(events)))
    for outer in [F.floor(F.col("idx") / CHUNK)] * DEPTH + [F.lit(0)]:
        maps = _compose(_grouped(maps, outer))
    return maps.select("candidate_id", _apply(F.col("map"), F.lit(start)).alias("state"))


def transition_log(events: DataFrame, start: str = "applied") -> DataFrame:
    """Every event with the stage before and after it and whether it was accepted."""
    sequenced = stage_table(with_sequence(events), "sequenced")
    chunks = _chunks(sequenced)
    entered = same_keys_join(chunks, _entry_states(_chunk_maps(chunks), start), ["candidate_id", "idx"])
    record_type = "event_id:bigint,ts:timestamp,previous:string,requested:string,state:string,success:boolean"
    none = F.array().cast(f"array<struct<{record_type}>>")

    def step(acc: Column, e: Column) -> Column:
        after = next_state(acc["state"], e["new_state"], e["forced"])
        # No stage may follow itself, so an accepted request changes the stage unless it was forced.
        success = e["forced"] | (after != acc["state"])
        record = F.struct(
            e["event_id"].alias("event_id"),
            e["ts"].alias("ts"),
            acc["state"].alias("previous"),
            e["new_state"].alias("requested"),
            after.alias("state"),
            success.alias("success"),
        )
        return F.struct(F.concat(acc["seen"], F.array(record)).alias("seen"), after.alias("state"))

    walked = F.aggregate("events", F.struct(none.alias("seen"), F.col("entry").alias("state")), step)
    return entered.select("candidate_id", F.inline(walked["seen"]))


# ---- reports ---------------------------------------------------------------------------------------------------


def stage_summary(states: DataFrame, total_screened: Column | None = None) -> DataFrame:
    """Counts per stage in process order; ``applied`` shows how many were screened at all."""
    screened = F.count("*") if total_screened is None else total_screened
    counts = [screened.alias("applied")] + [F.count_if(F.col("state") == s).alias(s) for s in STAGES[1:]]
    row = states.agg(*counts)
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(s).alias("stage"), F.col(s).alias("candidates"))
            for i, s in enumerate(STAGES, start=1)
        ]
    )
    return row.select(F.inline(entries))


def status_board(states: DataFrame) -> DataFrame:
    """Members of each stage in input order, one row each; a missing name shows as the id."""
    blocked = states.where(F.col("state").isNotNull()).withColumn("_block", F.floor(F.col("ord") / BLOCK))
    placed = with_position(blocked, ["state"], [("_block", True)], [F.col("ord")], "position")
    return placed.select("state", "position", "candidate_id", F.coalesce("name", "candidate_id").alias("name"))


def status_breakdown(exported: DataFrame) -> DataFrame:
    return exported.groupBy("status").agg(F.count("*").alias("candidates")).orderBy(F.desc("candidates"), "status")


def with_status(df: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    known = states.select(*keys, "state")
    return df.join(known, keys, "left").withColumn("status", F.coalesce("state", F.lit(NOT_IN_PROCESS))).drop("state")
