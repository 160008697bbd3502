"""Table rewrites: a new version of a table from the old one and the changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlatlas.operators.listing import literal_of, value_at
from crawlatlas.operators.projection import field_at
from crawlatlas.operators.skew import look_up
from crawlatlas.schemas import COUNTERS, RUNNING_STATES, TERMINAL_STATES

# Kinds that have a spec of their own.
SPEC_KINDS = ["crawlEntity", "seed", "crawlJob", "crawlConfig", "crawlScheduleConfig", "browserConfig",
              "politenessConfig", "browserScript", "crawlHostGroupConfig", "roleMapping", "collection"]
READ_ONLY = {"id", "kind", "apiVersion", "meta.created", "meta.createdBy", "meta.lastModified", "meta.lastModifiedBy"}


def append_set(column: Column, added: Column) -> Column:
    """Union without duplicates; an absent array is empty."""
    return F.array_union(F.coalesce(column, F.slice(added, 1, 0)), added)


def remove_set(column: Column, removed: Column) -> Column:
    """Set difference; an absent array stays empty."""
    return F.array_except(F.coalesce(column, F.slice(removed, 1, 0)), removed)


def upsert_config(stored: DataFrame, incoming: DataFrame, user: str, now: Column) -> DataFrame:
    """Insert or replace objects; creation stamps stay, and the name stays where the new one has none."""
    new = incoming.select(F.col("id"), *[F.col(c).alias("_n_" + c) for c in incoming.columns if c != "id"],
                          F.lit(True).alias("_new"))
    both = stored.withColumn("_old", F.lit(True)).join(new, "id", "full_outer")
    given = F.col("_n_meta")
    blank_free = F.nullif(given["name"], F.lit(""))
    meta_type = stored.schema["meta"].dataType
    fields = {f.name: given[f.name] if f.name in incoming.schema["meta"].dataType.fieldNames()
              else F.lit(None).cast(f.dataType) for f in meta_type.fields}
    fields["name"] = F.coalesce(blank_free, F.col("meta.name"))
    fields["created"] = F.when(F.col("_old"), F.col("meta.created")).otherwise(F.coalesce(fields["created"], now))
    fields["createdBy"] = F.when(F.col("_old"), F.col("meta.createdBy")).otherwise(
        F.coalesce(fields["createdBy"], F.lit(user)))
    fields["lastModified"], fields["lastModifiedBy"] = now, F.lit(user)
    meta = F.struct(*[fields[f.name].cast(f.dataType).alias(f.name) for f in meta_type.fields])
    is_new = F.coalesce(F.col("_new"), F.lit(False))
    columns = []
    for c in stored.columns:
        if c == "id":
            columns.append(F.col("id"))
        elif c == "meta":
            columns.append(F.when(is_new, meta).otherwise(F.col("meta")).alias("meta"))
        else:
            columns.append(F.when(is_new, F.col("_n_" + c)).otherwise(F.col(c)).alias(c))
    return both.select(*columns)


def derive_kind(objects: DataFrame) -> DataFrame:
    """Fill a missing kind from the spec; ``reason`` says why an object is rejected, '' if it is not."""
    specs = [k for k in SPEC_KINDS if k in objects.columns]
    spec = F.coalesce(F.lit(None).cast("string"), *[F.when(F.col(k).isNotNull(), F.lit(k)) for k in specs])
    kind = F.coalesce(F.nullif("kind", F.lit("")), spec)
    return objects.withColumn("_spec", spec).withColumn("kind", kind).withColumn(
        "reason",
        F.when(F.coalesce("apiVersion", F.lit("")) == "", "missing apiVersion")
         .when(F.col("kind").isNull(), "missing kind")
         .when(F.col("_spec").isNotNull() & (F.col("_spec") != F.col("kind")), "kind mismatch")
         .otherwise("")).drop("_spec")


def _rebuilt(column: Column, data_type: T.StructType, values: dict[str, Column], prefix: str) -> Column:
    """A struct with some of its leaves replaced, built in one expression."""
    fields = []
    for f in data_type.fields:
        path = prefix + f.name
        if path in values:
            fields.append(values[path].alias(f.name))
        elif any(p.startswith(path + ".") for p in values):
            fields.append(_rebuilt(column[f.name], f.dataType, values, path + ".").alias(f.name))
        else:
            fields.append(column[f.name].alias(f.name))
    # An absent parent is built when there is something to put below it.
    below = [v for p, v in values.items() if p.startswith(prefix)]
    given = reduce(lambda a, b: a | b, [v.isNotNull() for v in below], F.lit(False))
    return F.when(column.isNotNull() | given, F.struct(*fields))


def masked_update(objects: DataFrame, selected: Column, template: dict, mask: list[str], user: str,
                  now: Column) -> DataFrame:
    """Set the masked fields of selected rows from a template.

    ``path+`` and ``path-`` add to and take from an array; a field unset in the template
    becomes NULL; read-only paths are skipped. ``updated`` marks rows that really
    changed, and only those get new modification stamps.
    """
    new_values: dict[str, Column] = {}
    for entry in mask:
        path = entry.rstrip("+-")
        if path in READ_ONLY:
            continue
        data_type = field_at(objects.schema, path)
        given = literal_of(value_at(template, path), data_type)
        if entry.endswith("+"):
            new_values[path] = append_set(F.col(path), given)
        elif entry.endswith("-"):
            new_values[path] = remove_set(F.col(path), given)
        else:
            new_values[path] = given
    changed = reduce(lambda a, b: a | b, [~F.col(p).eqNullSafe(v) for p, v in new_values.items()], F.lit(False))
    stamps = {"meta.lastModified": now, "meta.lastModifiedBy": F.lit(user)}
    known = objects.schema["meta"].dataType.fieldNames()
    values = {**new_values, **{p: v for p, v in stamps.items() if p.split(".")[1] in known}}
    heads = {p.split(".")[0] for p in values}
    columns = []
    for f in objects.schema.fields:
        if f.name not in heads:
            columns.append(F.col(f.name))
            continue
        new = values[f.name] if f.name in values else _rebuilt(F.col(f.name), f.dataType, values, f.name + ".")
        columns.append(F.when(F.col("updated"), new).otherwise(F.col(f.name)).alias(f.name))
    return objects.withColumn("updated", selected & changed).select(*columns, "updated")


def apply_counters(executions: DataFrame, changes: DataFrame) -> DataFrame:
    """Add summed deltas to the counters; an absent counter is 0."""
    deltas = changes.groupBy(F.col("execution_id").alias("id")).agg(*[F.sum("add_" + c).alias("_" + c) for c in COUNTERS])
    joined = executions.join(deltas, "id", "left")
    for c in COUNTERS:
        joined = joined.withColumn(c, F.coalesce(c, F.lit(0)) + F.coalesce("_" + c, F.lit(0))).drop("_" + c)
    return joined


def merge_job_status(stored: DataFrame, saved: DataFrame) -> DataFrame:
    """Save job status; state and end time stick once a job has ended."""
    ended = stored.select("id", F.col("state").alias("_state"), F.col("end_time").alias("_end"))
    joined = saved.join(ended, "id", "left")
    over = F.col("_end").isNotNull()
    return (joined.withColumn("state", F.when(over, F.col("_state")).otherwise(F.col("state")))
            .withColumn("end_time", F.when(over, F.col("_end")).otherwise(F.col("end_time")))
            .drop("_state", "_end"))


def want_aborted(rows: DataFrame, mine: Column) -> DataFrame:
    """Ask for ABORTED_MANUAL on rows that have not ended."""
    return rows.withColumn("desired_state", F.when(mine & F.col("end_time").isNull(), "ABORTED_MANUAL")
                           .otherwise(F.col("desired_state")))


def abort_job(jobs: DataFrame, executions: DataFrame, job_execution_id: str) -> tuple[DataFrame, DataFrame]:
    """Ask a job execution and all its executions to abort; those that have ended stay as they are."""
    return (want_aborted(jobs, F.col("id") == job_execution_id),
            want_aborted(executions, F.col("job_execution_id") == job_execution_id))


def fail_if_empty(jobs: DataFrame, executions: DataFrame, message: str, now: Column) -> DataFrame:
    """Running, unended jobs without executions fail with an error."""
    used = executions.select(F.col("job_execution_id").alias("id")).distinct().withColumn("_used", F.lit(True))
    joined = jobs.join(used, "id", "left")
    empty = (F.col("state") == "RUNNING") & F.col("end_time").isNull() & F.col("_used").isNull()
    return (joined.withColumn("_empty", empty)
            .withColumn("error_msg", F.when(F.col("_empty"), F.lit(message)).otherwise(
                F.col("error_msg") if "error_msg" in jobs.columns else F.lit(None).cast("string")))
            .withColumn("state", F.when(F.col("_empty"), "FAILED").otherwise(F.col("state")))
            .withColumn("end_time", F.when(F.col("_empty"), now).otherwise(F.col("end_time"))).drop("_used", "_empty"))


def new_executions(seeds: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """New executions for (job execution, seed) pairs; an abort already wanted on the job is inherited."""
    wanted = jobs.select("id", "job_id", F.col("desired_state").alias("_wanted"))
    inherited = F.when(F.col("_wanted").isin("ABORTED_MANUAL", "ABORTED_TIMEOUT", "ABORTED_SIZE"), F.col("_wanted"))
    # A broad crawl has one job execution for all of its seeds.
    return look_up(seeds.drop("job_id"), wanted, {"job_execution_id": "id"}, ["job_id", "_wanted"]).select(
        F.concat_ws("-", "job_execution_id", "seed_id").alias("id"), F.lit("CREATED").alias("state"),
        "job_id", "seed_id", "job_execution_id", inherited.alias("desired_state"), now.alias("created_time"))


def purge_queue(queue: DataFrame, executions: DataFrame, keep_active: bool) -> tuple[DataFrame, DataFrame]:
    """Remove the queued URIs of executions; the report has deleted and kept rows per execution."""
    gone = executions.select("id").distinct().withColumn("_purge", F.lit(True))
    marked = look_up(queue, gone, {"execution_id": "id"}, ["_purge"])
    keep = F.col("_purge").isNull() | (F.lit(keep_active) & F.col("fetch_started"))
    left = marked.where(keep).drop("_purge")
    report = marked.where("_purge").groupBy("execution_id").agg(
        F.count_if(~keep).alias("deleted"), F.count_if(keep).alias("kept"))
    return left, report


def move_host_group(queue: DataFrame, regrouped: DataFrame) -> DataFrame:
    """Queue rows under the host group their address gives; ``moved`` marks the changed ones."""
    new = regrouped.select("id", F.col("host_group_id").alias("_new"))
    joined = queue.join(new, "id", "left")
    moved = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("crawl_host_group_id"))
    return joined.withColumn("moved", moved).withColumn(
        "crawl_host_group_id", F.coalesce("_new", "crawl_host_group_id")).drop("_new")


def clear_reached_desired(executions: DataFrame) -> DataFrame:
    """Drop a desired state that has been reached."""
    return executions.withColumn("desired_state", F.when(F.col("state") != F.col("desired_state"), F.col("desired_state")))


def roll_into_open_jobs(jobs: DataFrame, totals: DataFrame) -> DataFrame:
    """Totals replace a job's only while the job has not ended."""
    new = totals.select(F.col("job_execution_id").alias("id"), *[F.col(c).alias("_" + c) for c in COUNTERS])
    joined = look_up(jobs, new, {"id": "id"}, ["_" + c for c in COUNTERS])
    open_job = ~F.col("state").isin([s for s in TERMINAL_STATES])
    for c in COUNTERS:
        joined = joined.withColumn(c, F.when(open_job, F.coalesce("_" + c, c)).otherwise(F.col(c))).drop("_" + c)
    return joined


def _leaves(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out += _leaves(f.dataType, path + ".") if isinstance(f.dataType, T.StructType) else [(path, f.dataType)]
    return out


def event_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Audit rows between two versions: created, changed, and array values added or deleted."""
    both = old.select("id", F.struct(*old.columns).alias("o")).join(
        new.select("id", F.struct(*new.columns).alias("n")), "id", "full_outer")
    changes = [F.when(F.col("o").isNull(), F.array(F.struct(
        F.lit("CREATED").alias("type"), F.lit("").alias("field"), F.lit(None).cast("string").alias("old_value"),
        F.lit(None).cast("string").alias("new_value"))))]

    def text(column: Column, data_type: T.DataType) -> Column:
        return F.to_json(column) if isinstance(data_type, (T.StructType, T.MapType)) else column.cast("string")

    def change(kind: str, path: str, before: Column, after: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(path).alias("field"),
                        before.alias("old_value"), after.alias("new_value"))

    none = F.lit(None).cast("string")
    both_there = F.col("o").isNotNull() & F.col("n").isNotNull()
    for path, data_type in _leaves(old.schema):
        a, b = F.col("o." + path), F.col("n." + path)
        if isinstance(data_type, T.ArrayType):
            empty = F.array().cast(data_type)
            a, b, element = F.coalesce(a, empty), F.coalesce(b, empty), data_type.elementType
            added = F.transform(F.array_except(b, a), lambda v: change("ARRAY_ADD", path, none, text(v, element)))
            gone = F.transform(F.array_except(a, b), lambda v: change("ARRAY_DELETE", path, text(v, element), none))
            changes += [F.when(both_there, added), F.when(both_there, gone)]
        else:
            changes.append(F.when(both_there & ~a.eqNullSafe(b), F.array(
                change("CHANGED", path, text(a, data_type), text(b, data_type)))))
    rows = both.select("id", F.explode(F.flatten(F.array_compact(F.array(*changes)))).alias("c"))
    return rows.select("id", "c.*")


def reconcile_executions(executions: DataFrame, queue: DataFrame) -> DataFrame:
    """Action per execution from its state, the state wanted of it, and what it has queued."""
    counts = queue.groupBy(F.col("execution_id").alias("id")).agg(
        F.count(F.lit(1)).alias("queued"), F.count_if("fetch_started").alias("active"))
    joined = executions.join(counts, "id", "left").withColumn(
        "queued", F.coalesce("queued", F.lit(0))).withColumn("active", F.coalesce("active", F.lit(0)))
    wants_abort = F.col("desired_state").isin("ABORTED_TIMEOUT", "ABORTED_SIZE", "ABORTED_MANUAL")
    action = (F.when(F.col("state").isin(TERMINAL_STATES), "PURGE_AND_REPAIR_JOB")
              .when(F.coalesce(wants_abort, F.lit(False)) & (F.col("active") > 0), "PURGE_PENDING_AND_WAIT")
              .when(F.coalesce(wants_abort, F.lit(False)), "PURGE_AND_END")
              .when(F.col("queued") == 0, "FINISH").otherwise("NONE"))
    end = (F.when(action == "PURGE_AND_END", F.col("desired_state")).when(action == "FINISH", "FINISHED"))
    return joined.withColumn("action", action).withColumn("end_state", end)


def anti_entropy(executions: DataFrame, queue: DataFrame) -> DataFrame:
    """Executions that still have queue rows although they ended or somebody wants them aborted."""
    wants_abort = F.col("desired_state").isin("ABORTED_TIMEOUT", "ABORTED_SIZE", "ABORTED_MANUAL")
    suspect = executions.where(F.col("state").isin(TERMINAL_STATES) | F.coalesce(wants_abort, F.lit(False)))
    counts = queue.groupBy(F.col("execution_id").alias("id")).agg(F.count(F.lit(1)).alias("queued"))
    return suspect.join(counts, "id")


def due_items(items: DataFrame, now_ms: int, due: str = "due_ms") -> DataFrame:
    """Items whose due time has passed."""
    return items.where(F.col(due) <= now_ms)


def execution_timeouts(executions: DataFrame, limits: DataFrame, now: Column) -> DataFrame:
    """Unended executions past their longest duration, now wanted ABORTED_TIMEOUT."""
    limit = limits.select(F.col("id").alias("_job"), "max_duration_s")
    due = F.col("created_time") + F.make_interval(secs=F.col("max_duration_s"))
    late = (F.col("max_duration_s") > 0) & (due <= now) & F.col("end_time").isNull() & F.col("state").isin(RUNNING_STATES)
    limited = look_up(executions, limit, {"job_id": "_job"}, ["max_duration_s"])
    return limited.where(late).withColumn("desired_state", F.lit("ABORTED_TIMEOUT"))
