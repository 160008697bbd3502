"""Folding execution changes to the state they lead to.

The rules of the state machine come down to first and last values by sequence number,
so a fold is two aggregations that combine map-side, whatever an execution's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlatlas.operators.skew import annotate
from crawlatlas.schemas import ABORT_STATES, COUNTERS, TERMINAL_STATES


def fold_changes(changes: DataFrame) -> DataFrame:
    """State of every execution after its changes, in order of ``seq``.

    A change back to CREATED is rejected. The first terminal state sticks, with the last
    end time given up to it, or else the first given after it. The first FETCHING or
    terminal change stamps the start. UNDEFINED leaves the state alone; counters add up.
    """
    valid = changes.where(F.col("state") != "CREATED")
    terminal = F.col("state").isin(TERMINAL_STATES)
    marked = annotate(valid, ["execution_id"], {"_ended": F.min(F.when(terminal, F.col("seq")))})
    moves = F.col("state").isin("FETCHING", "SLEEPING")
    has_end = F.col("end_time").isNotNull()
    in_time = F.col("_ended").isNull() | (F.col("seq") <= F.col("_ended"))
    seq = F.col("seq")
    return marked.groupBy("execution_id").agg(
        F.coalesce(F.min_by("state", F.when(terminal, seq)), F.max_by("state", F.when(moves, seq)),
                   F.lit("CREATED")).alias("state"),
        F.min_by("change_time", F.when(terminal | (F.col("state") == "FETCHING"), seq)).alias("start_time"),
        F.coalesce(F.max_by("end_time", F.when(has_end & in_time, seq)),
                   F.min_by("end_time", F.when(has_end & ~in_time, seq))).alias("end_time"),
        F.max_by("change_time", seq).alias("last_change_time"),
        F.max_by("error_code", F.when(F.col("error_code").isNotNull(), seq)).alias("error_code"),
        F.coalesce(F.bool_or(F.col("state").isin(ABORT_STATES)), F.lit(False)).alias("desired_cleared"),
        *[F.sum("add_" + c).alias(c) for c in COUNTERS])
