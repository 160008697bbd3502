"""Import records, line files, shard files and JSON export."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlatlas.functions.urls import oos_shard
from crawlatlas.operators import ordered
from crawlatlas.schemas import SEED_IMPORT

# The field names of an import record.
IMPORT_FIELDS = ["entityId", "entityName", "entityDescription", "entityLabel", "uri", "seedDescription",
                 "seedLabel", "description", "crawlJobRef"]


_JSON = json.JSONDecoder()
_BLANK, _MARK, _IDLE = re.compile(r"\s*"), re.compile(r"(---|\.\.\.)(\s|$)"), re.compile(r"\s*(#|%|$)")


def json_values(text: str) -> tuple[list[tuple[int, int]], int | None, bool]:
    """Places of the JSON values at the start of a text, and where it goes wrong, if it does, and whether only for its end."""
    found, at = [], _BLANK.match(text).end()
    while at < len(text):
        try:
            end = _JSON.raw_decode(text, at)[1]
        except json.JSONDecodeError as e:
            open_ended = e.pos >= len(text.rstrip()) and not e.msg.startswith("Unterminated")
            return found, e.pos, open_ended
        except RecursionError:
            return found, at, False
        found.append((at, end))
        at = _BLANK.match(text, end).end()
    return found, None, False


def json_records(lines: Iterator[str]) -> Iterator[tuple[int, str]]:
    """(number of its first line, text) of every value; a line that breaks a value ends it, and is read anew."""
    kept: list[str] = []
    first = tries = 0

    def settle(last: bool) -> Iterator[tuple[int, str]]:
        nonlocal first, tries
        while kept:
            text = "\n".join(kept)
            found, wrong, open_ended = json_values(text)
            yield from ((first + text.count("\n", 0, a), text[a:b]) for a, b in found)
            if wrong is None:
                first += len(kept)
                kept.clear()
                return
            start = _BLANK.match(text, found[-1][1] if found else 0).end()
            line, bad = text.count("\n", 0, start), text.count("\n", 0, wrong)
            if open_ended and not last:
                # What is still open is tried again when a quarter has come to it.
                kept[:] = text[start:].split("\n")
                first, tries = first + line, len(kept) + max(1, len(kept) // 4)
                return
            # Of a value that never ends, its first line is bad and the next ones are read anew.
            stop = line + 1 if open_ended else max(line + 1, bad)
            own = text[start:].split("\n")
            yield first + line, "\n".join(own[:stop - line])
            del kept[:stop]
            first += stop

    for n, value in enumerate(lines):
        if not kept:
            first, tries = n, 1
        kept.append(value)
        if len(kept) >= tries:
            yield from settle(False)
    yield from settle(True)


def yaml_records(lines: Iterator[str]) -> Iterator[tuple[int, str]]:
    """(number of its first line, JSON text) of every YAML document; texts that are no YAML stay as they are."""
    import yaml

    def convert(text: str) -> str:
        try:
            return json.dumps(yaml.safe_load(text), default=str)
        except (yaml.YAMLError, ValueError):
            return text  # fails as JSON too and is reported there

    kept, first, idle = [], 0, True
    for n, value in enumerate(lines):
        mark = _MARK.match(value)
        if mark and not idle:
            yield first, convert("\n".join(kept))
            kept, idle = [], True
        if mark and mark[1] == "...":
            kept = []
            continue
        if not kept:
            first = n
        kept.append(value)
        idle = idle and bool(_IDLE.match(value[3:] if mark else value))
    if not idle:
        yield first, convert("\n".join(kept))


@F.pandas_udf(T.BooleanType())
def _alone(lines: pd.Series) -> pd.Series:
    """Whether a line is one JSON value, or broken whatever follows."""
    def judge(line: str) -> bool:
        found, wrong, open_ended = json_values(line)
        return len(found) == 1 and wrong is None or not found and wrong is not None and not open_ended and line[:1] not in "\"}],: \t"

    return lines.map(judge)


def _framed(lines: DataFrame) -> DataFrame:
    """Records of whole files, whose lines are read in order; no more than a record is held at a time."""
    dealt = lines.repartition("file").sortWithinPartitions("file", "_block", "_row")

    def run(batches):
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("file", "_yaml", "value")), strict=True))
        out, row = [], next(rows, None)
        while row is not None:
            file, frame = row[0], yaml_records if row[1] else json_records

            def own():
                nonlocal row
                while row is not None and row[0] == file:
                    yield row[2]
                    row = next(rows, None)

            for n, (line, value) in enumerate(frame(own())):
                out.append((file, line, n, value))
                if len(out) >= 1000:
                    yield _batch(out)
                    out = []
        yield _batch(out)

    return dealt.mapInArrow(run, "file string, _block long, _row long, value string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                                      ["file", "_block", "_row", "value"])


def read_seed_import(spark: SparkSession, path: str, yaml: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Import records of JSON values or YAML documents, and the bad ones with file, number and reason.

    ``yaml`` says what all files are; without, files named .yaml or .yml are YAML and all others JSON. A file
    of one JSON value a line is read by lines anywhere; lines of another file go through one task in order.
    """
    named = F.lower("file").rlike(r"\.ya?ml(\.\w+)?$")
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), "value")
    lines = lines.withColumn("_yaml", named if yaml is None else F.lit(yaml))
    filled = lines.where(F.trim("value") != "")
    other = filled.where(~F.col("_yaml")).where(~_alone("value")).select("file").union(
        filled.where("_yaml").select("file")).distinct()
    raw = filled.join(other, "file", "left_anti").select("file", "_block", "_row", "value").unionByName(
        _framed(lines.join(other, "file", "left_semi")))
    numbered = ordered.row_numbers(raw, ["file"], [F.col("_block"), F.col("_row")], "record_no")
    parsed = numbered.withColumn("_keys", F.json_object_keys("value")).withColumn(
        "r", F.from_json("value", SEED_IMPORT, {"mode": "PERMISSIVE"}))
    unknown = F.array_except("_keys", F.array(*[F.lit(f) for f in IMPORT_FIELDS]))
    reason = (F.when(F.col("_keys").isNull(), F.lit("not a record"))
              .when(F.size(unknown) > 0, F.concat(F.lit("unknown field: "), F.concat_ws(",", unknown)))
              .otherwise(F.lit("")))
    checked = parsed.withColumn("reason", reason)
    good = checked.where("reason = ''").select("file", "record_no", "r.*")
    bad = checked.where("reason <> ''").select("file", "record_no", "reason", "value")
    return good, bad


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One trimmed text per line, blank ones dropped; a last line without a newline counts."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def write_oos_shards(hosts: DataFrame, path: str, mode: str = "append") -> None:
    """Write ``scheme://host`` lines below their shard."""
    lines = hosts.select(F.concat("scheme", F.lit("://"), "host").alias("value"), oos_shard(F.col("host")).alias("shard"))
    lines.hint("rebalance", "shard").write.mode(mode).partitionBy("shard").text(path)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


def labels_text(labels: Column) -> Column:
    return F.concat_ws(",", F.transform(labels, lambda e: F.concat_ws(":", e["key"], e["value"])))
