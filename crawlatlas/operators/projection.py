"""Projections over nested documents and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONFIG_MINIMUM = ("apiVersion", "kind", "id")
EXECUTION_MINIMUM = ("id",)


def field_at(schema: T.StructType, path: str) -> T.DataType:
    """Type of a dotted path; arrays of structs are entered. Unknown names list the valid ones."""
    current: T.DataType = schema
    for segment in path.split("."):
        if isinstance(current, T.ArrayType):
            current = current.elementType
        if not isinstance(current, T.StructType) or segment not in current.fieldNames():
            valid = ", ".join(current.fieldNames()) if isinstance(current, T.StructType) else "none"
            raise ValueError(f"no field with name '{segment}' in '{path}'. Valid field names: {valid}")
        current = current[segment].dataType
    return current


def _path_tree(paths: list[str]) -> dict:
    """Nested dict of path segments; a shorter path swallows the longer ones below it."""
    tree: dict = {}
    for path in sorted(paths, key=lambda p: p.count(".")):
        node, segments = tree, path.split(".")
        for i, segment in enumerate(segments):
            if segment in node and node[segment] is None:
                break
            if i == len(segments) - 1:
                node[segment] = None
            else:
                node = node.setdefault(segment, {})
    return tree


def _pick(column: Column, data_type: T.DataType, tree: dict | None) -> Column:
    if tree is None:
        return column
    if isinstance(data_type, T.ArrayType):
        return F.transform(column, lambda e: _pick(e, data_type.elementType, tree))
    fields = [_pick(column[f.name], f.dataType, tree[f.name]).alias(f.name)
              for f in data_type.fields if f.name in tree]
    return F.when(column.isNotNull(), F.struct(*fields))


def mask_project(df: DataFrame, mask: list[str], minimum: tuple[str, ...] = CONFIG_MINIMUM) -> DataFrame:
    """Keep the paths of a mask plus the minimum fields, nesting kept."""
    if not mask:
        return df
    for path in mask:
        field_at(df.schema, path)
    tree = _path_tree(list(mask) + [m for m in minimum if m in df.columns])
    return df.select(*[_pick(F.col(f.name), f.dataType, tree[f.name]).alias(f.name)
                       for f in df.schema.fields if f.name in tree])


def flatten_error(df: DataFrame, error: str = "error") -> DataFrame:
    """Error struct to three columns, 0 and '' where absent."""
    return df.select(
        *[c for c in df.columns if c != error],
        F.coalesce(F.col(f"{error}.code"), F.lit(0)).alias("error_code"),
        F.coalesce(F.col(f"{error}.msg"), F.lit("")).alias("error_msg"),
        F.coalesce(F.col(f"{error}.detail"), F.lit("")).alias("error_detail"))


def flatten_state_map(column: Column) -> Column:
    """Array of one-entry maps to one map."""
    return F.map_from_entries(F.flatten(F.transform(column, F.map_entries)))


def drop_field(df: DataFrame, path: str) -> DataFrame:
    """Remove a top-level or nested field."""
    field_at(df.schema, path)
    head, _, rest = path.partition(".")
    return df.withColumn(head, F.col(head).dropFields(rest)) if rest else df.drop(head)


def annotations_to_map(column: Column) -> Column:
    """Key/value list to map; of repeated keys the last wins."""
    keys = F.array_distinct(F.transform(column, lambda e: e["key"]))
    newest_first = F.reverse(column)
    return F.map_from_arrays(keys, F.transform(
        keys, lambda k: F.element_at(F.filter(newest_first, lambda e: e["key"] == k), 1)["value"]))


def crawl_log_rows(queue: DataFrame, now_ms: int) -> DataFrame:
    """Queue rows that failed before their fetch, as crawl-log rows; code 0 is an error."""
    code = F.when(F.col("error_code") == 0, F.raise_error(F.lit("queue row without an error")).cast("int")) \
            .otherwise(F.col("error_code"))
    return queue.select(
        F.col("id").alias("warc_id"), "execution_id", "job_execution_id",
        code.alias("status_code"), F.lit("response").alias("record_type"),
        F.col("uri").alias("requested_uri"), "discovery_path", "referrer", "retries",
        F.col("error_code"), F.lit(now_ms).cast("bigint").alias("time_stamp"))
