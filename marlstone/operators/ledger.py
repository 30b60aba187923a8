"""Run ledgers: partial records of runs, in any order and from several writers, folded to one row a run.

Records: seq (their order), collection, runId, job, trigger, variant, startedAt, finishedAt, status, source, stage,
documentCount, chunkCount, error, phases. All rules are aggregates and higher-order functions; a run's records are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phase states, the worst first.
WORST_FIRST = ["failed", "degraded", "unknown", "skipped", "succeeded"]
#: Seconds after which a run without its end counts as incomplete, and the least such time for a known cadence.
INCOMPLETE_AFTER, LEAST_INCOMPLETE = 6 * 3600, 2 * 3600


def parse_time(c: Column) -> Column:
    """A time as written by any writer: `T` or blank, with `Z`, an offset or none (UTC)."""
    t = F.regexp_replace(F.trim(c), r"^(\d{4}-\d{2}-\d{2})T", "$1 ")
    zoned = F.when(t.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def plain_status(c: Column) -> Column:
    """`ok` and `success` are other spellings of `succeeded`."""
    return F.when(F.lower(c).isin("ok", "success"), "succeeded").otherwise(c)


def rollup(phases: Column) -> Column:
    """The state of a run by its phases: failed if a fatal phase failed, degraded if anything else went wrong or has no known
    state, skipped if all were skipped, else succeeded; unknown without phases."""
    s = lambda p: plain_status(p["status"])
    return (
        F.when(F.coalesce(F.size(phases), F.lit(0)) <= 0, "unknown")
        .when(F.exists(phases, lambda p: (s(p) == "failed") & F.coalesce(p["fatal"], F.lit(False))), "failed")
        .when(F.exists(phases, lambda p: ~F.coalesce(s(p).isin("skipped", "succeeded"), F.lit(False))), "degraded")
        .when(F.forall(phases, lambda p: s(p) == "skipped"), "skipped")
        .otherwise("succeeded")
    )


def worst(states: Column, order: list[str] = WORST_FIRST) -> Column:
    """The first state of `order` that is among `states`."""
    out = F.try_element_at(F.filter(states, lambda x: x.isNotNull()), F.lit(1))
    for s in reversed(order):
        out = F.when(F.array_contains(states, s), s).otherwise(out)
    return out


def run_key(records: DataFrame) -> Column:
    """Records without a run id are runs of their own."""
    return F.coalesce(F.nullif(F.col("runId"), F.lit("")), F.concat(F.lit("anonymous-"), F.col("seq").cast("string")))


def merge_phases(records: DataFrame) -> DataFrame:
    """One phase per run and name: run, phases (in order of first arrival, those with a start time sorted among the places
    such phases hold). A non-script writer's copy wins; the state is the worse one; missing duration and start are inherited.
    Phases without a name stay apart. records: run, seq, source, phases."""
    p = records.select("run", "seq", (F.col("source") == "script").alias("script"), F.posexplode("phases").alias("i", "p")).filter("p is not null")
    p = p.withColumn("key", F.coalesce("p.name", F.concat_ws("#", F.lit(""), "seq", "i"))).withColumn("script", F.coalesce("script", F.lit(False)))
    first, win = F.struct("seq", "i"), F.struct("script", "seq", "i")
    inherit = lambda c: F.coalesce(F.min_by(f"p.{c}", win), F.min_by(F.col(f"p.{c}"), F.when(F.col(f"p.{c}").isNotNull(), win)))
    one = p.groupBy("run", "key").agg(
        F.min(first).alias("first"), F.min_by("p.name", win).alias("name"), worst(F.collect_set(plain_status(F.col("p.status")))).alias("status"),
        F.min_by("p.fatal", win).alias("fatal"), inherit("startedAt").alias("startedAt"), inherit("durationSeconds").alias("durationSeconds"),
    )
    by = Window.partitionBy("run")
    timed = F.col("startedAt").isNotNull()
    one = one.withColumn("place", F.row_number().over(by.orderBy("first"))).withColumn("nth", F.when(timed, F.row_number().over(Window.partitionBy("run", timed).orderBy("first")))).withColumn("sorted", F.when(timed, F.row_number().over(Window.partitionBy("run", timed).orderBy("startedAt", "first"))))
    slots = one.filter(timed).select("run", F.col("nth").alias("sorted"), F.col("place").alias("slot"))
    one = one.join(slots, ["run", "sorted"], "left").withColumn("place", F.coalesce("slot", "place"))
    item = F.struct("place", F.struct("name", "status", "fatal", "startedAt", "durationSeconds").alias("p"))
    return one.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["p"]).alias("phases"))


def fold_runs(records: DataFrame, now: Column | str, incomplete_after: Column | int = INCOMPLETE_AFTER) -> DataFrame:
    """One row a run: collection, run, job, trigger, variant, started, finished, duration_s, status, document_count,
    chunk_count, error, phases, unclosed, records.

    Job and trigger come from the script, counts from another writer where there is one (else the last that has them); a
    script's closing variant beats its opening one, and either beats another writer's, later ones winning ties. A writer that
    began and didn't end leaves the run `running`, or `incomplete` once older than `incomplete_after` seconds at `now`, and
    without a duration. Exact repeats of a record change nothing but its count.
    """
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    after = F.lit(incomplete_after) if isinstance(incomplete_after, int) else incomplete_after
    r = records.withColumn("run", run_key(records)).withColumns({"_start": parse_time(F.col("startedAt")), "_end": parse_time(F.col("finishedAt")), "_script": F.coalesce(F.col("source") == "script", F.lit(False))})
    seq = F.col("seq")
    def pick(c: str, script_first: bool) -> Column:
        # the first of the preferred writer, else the last of the others
        own = F.col("_script") if script_first else ~F.col("_script")
        return F.coalesce(F.min_by(c, F.when(own & F.col(c).isNotNull(), seq)), F.max_by(c, F.when(~own & F.col(c).isNotNull(), seq)))

    rank = F.when(~F.col("_script"), 0).when(F.col("stage") == "begin", 1).otherwise(2)
    sources = lambda stage: F.collect_set(F.when(F.col("stage") == stage, F.col("source")))
    g = r.groupBy("run").agg(
        F.min_by("collection", seq).alias("collection"), pick("job", True).alias("job"), pick("trigger", True).alias("trigger"),
        F.max_by("variant", F.when(F.col("variant").isNotNull(), F.struct(rank.alias("r"), seq.alias("s")))).alias("variant"),
        F.min("_start").alias("started"), F.max("_end").alias("finished"), pick("documentCount", False).alias("document_count"), pick("chunkCount", False).alias("chunk_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("error", F.lit("")) != "", F.struct("seq", "error")))), lambda x: x["error"]), "; ").alias("error"),
        F.collect_set(plain_status(F.col("status"))).alias("_states"), F.array_sort(F.array_except(sources("begin"), sources("end"))).alias("unclosed"), F.count("*").alias("records"),
    )
    g = g.join(merge_phases(r), "run", "left")
    open_ = F.size("unclosed") > 0
    age = F.unix_timestamp(now) - F.unix_timestamp("started")
    status = F.when(F.size("phases") > 0, rollup(F.col("phases"))).when(F.size("_states") == 0, "unknown").otherwise(worst(F.col("_states"), ["failed", "degraded", "unknown"]))
    duration = F.greatest(F.lit(0), F.unix_timestamp("finished") - F.unix_timestamp("started"))
    return g.select(
        "collection", "run", "job", "trigger", "variant", "started", "finished", F.when(~open_, duration).alias("duration_s"),
        F.when(open_, F.when(age < after, "running").otherwise("incomplete")).otherwise(status).alias("status"),
        "document_count", "chunk_count", F.nullif(F.col("error"), F.lit("")).alias("error"), "phases", "unclosed", "records",
    )


def last_runs(runs: DataFrame, n: int) -> DataFrame:
    """The last n runs of each collection."""
    w = Window.partitionBy("collection").orderBy(F.desc_nulls_last("started"), F.desc("run"))
    return runs.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def median_durations(runs: DataFrame, n: int = 50) -> DataFrame:
    """The median duration per collection and variant over the last n runs that ended: collection, variant, median_s, runs."""
    done = runs.filter("duration_s is not null")
    w = Window.partitionBy("collection", "variant").orderBy(F.desc("started"), F.desc("run"))
    return done.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).groupBy("collection", "variant").agg(F.floor(F.median("duration_s")).cast("long").alias("median_s"), F.count("*").alias("runs"))


def script_records(events: DataFrame) -> DataFrame:
    """The records that a script's run writes: one when it begins, one when it ends.

    events: seq, run, at (ISO time), kind (run_begin, run_variant, phase_begin, phase_end, run_end), name (of the run: the
    collection; of a phase; of a variant), fatal, code (a phase's exit code or `skipped`), job, trigger. Phases without an end
    have no state; a run without an end has its first record only. The last variant named holds for the ending record; without
    phases the run's state is that of its own code. Result: rows for `fold_runs`.
    """
    from marlstone.functions.text import phase_status

    first = lambda c, kind: F.min_by(c, F.when(F.col("kind") == kind, F.col("seq")))
    p = events.filter("kind in ('phase_begin', 'phase_end')")
    one = p.groupBy("run", "name").agg(
        F.min(F.when(F.col("kind") == "phase_begin", F.col("seq"))).alias("_o"), first("at", "phase_begin").alias("startedAt"), first("fatal", "phase_begin").alias("fatal"), first("code", "phase_end").alias("_code"), first("at", "phase_end").alias("_end"),
    )
    seconds = F.unix_timestamp(parse_time(F.col("_end"))) - F.unix_timestamp(parse_time(F.col("startedAt")))
    phase = F.struct("_o", F.struct("name", phase_status(F.col("_code")).alias("status"), "fatal", "startedAt", seconds.cast("int").alias("durationSeconds")).alias("p"))
    phases = one.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(phase)), lambda x: x["p"]).alias("phases"))
    g = events.groupBy("run").agg(
        first("name", "run_begin").alias("collection"), first("job", "run_begin").alias("job"), F.coalesce(first("trigger", "run_begin"), F.lit("scheduled")).alias("trigger"), first("at", "run_begin").alias("startedAt"), first("at", "run_end").alias("finishedAt"), first("code", "run_end").alias("_code"),
        F.max_by("name", F.when((F.col("kind") == "run_variant") & F.col("name").isin("incremental", "rebuild"), F.col("seq"))).alias("_variant"), F.min("seq").alias("_a"), F.max("seq").alias("_z"), F.bool_or(F.col("kind") == "run_end").alias("_ended"),
    )
    j = g.join(phases, "run", "left").filter("startedAt is not null")
    none = lambda t: F.lit(None).cast(t)
    common = lambda seq, variant, end, status, stage, ph: j.select(seq.alias("seq"), "collection", F.col("run").alias("runId"), "job", "trigger", variant.alias("variant"), "startedAt", end.alias("finishedAt"), status.alias("status"), F.lit("script").alias("source"), F.lit(stage).alias("stage"), none("long").alias("documentCount"), none("long").alias("chunkCount"), none("string").alias("error"), ph.alias("phases"), F.col("_ended").alias("_e"))
    begin = common(F.col("_a"), F.lit("incremental"), none("string"), none("string"), "begin", F.when(F.lit(False), F.col("phases")))
    status = F.when(F.size("phases") > 0, rollup(F.col("phases"))).otherwise(phase_status(F.coalesce("_code", F.lit("0"))))
    end = common(F.col("_z"), F.coalesce("_variant", F.lit("incremental")), F.col("finishedAt"), status, "end", F.col("phases")).filter("_e")
    return begin.unionByName(end).drop("_e")


def incomplete_threshold(cadence_s: Column) -> Column:
    """Twice the cadence, at least two hours; six hours without a cadence."""
    return F.when(cadence_s.isNull(), F.lit(INCOMPLETE_AFTER)).otherwise(F.greatest(cadence_s * 2, F.lit(LEAST_INCOMPLETE)))


def job_overview(runs: DataFrame, collections: DataFrame, schedules: DataFrame) -> DataFrame:
    """Collections that have runs, are loaded, or are scheduled, with their last run: name, loaded, cadence_s, run, status, started.
    collections: name; schedules: name, cadence_s."""
    last = last_runs(runs, 1).select(F.col("collection").alias("name"), "run", "status", "started")
    return last.join(collections.select("name", F.lit(True).alias("loaded")), "name", "full_outer").join(schedules, "name", "full_outer").select("name", F.coalesce("loaded", F.lit(False)).alias("loaded"), "cadence_s", "run", "status", "started")


def next_fire(now: Column, hour: Column, minute: Column, weekday: Column, interval_s: Column) -> Column:
    """The next time of a schedule after `now`: every interval, or at hour:minute (a null hour: every hour) on a weekday (1 Monday to
    7 Sunday, 0 Sunday too; null: daily)."""
    day = F.date_trunc("day", now)
    hourly = F.date_trunc("hour", now) + F.make_dt_interval(mins=minute)
    at = day + F.make_dt_interval(hours=F.coalesce(hour, F.lit(0)), mins=F.coalesce(minute, F.lit(0)))
    wd = F.when(weekday == 0, 7).otherwise(weekday)
    ahead = F.when(wd.isNull(), 0).otherwise(F.pmod(wd - (F.weekday(now) + 1), F.lit(7)))
    due = at + F.make_dt_interval(days=ahead)
    later = due + F.make_dt_interval(days=F.when(wd.isNull(), 1).otherwise(7))
    return (
        F.when(interval_s.isNotNull(), now + F.make_dt_interval(secs=interval_s))
        .when(hour.isNull() & wd.isNull(), F.when(hourly > now, hourly).otherwise(hourly + F.make_dt_interval(hours=F.lit(1))))
        .otherwise(F.when(due > now, due).otherwise(later))
    )
