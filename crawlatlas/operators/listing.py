"""Listing nested documents by id, kind, state, template, labels, name and time."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlatlas.functions.labels import matches_all
from crawlatlas.operators.ordered import sorted_numbers
from crawlatlas.operators.projection import CONFIG_MINIMUM, field_at, mask_project


@dataclass
class ListRequest:
    """What to list. Every given part must hold; an empty part asks for nothing."""

    ids: list[str] = field(default_factory=list)
    kind: str | None = None
    states: list[str] = field(default_factory=list)
    name_regex: str = ""
    label_selectors: list[str] = field(default_factory=list)
    template: dict[str, Any] = field(default_factory=dict)
    template_mask: list[str] = field(default_factory=list)
    time_path: str = "start_time"
    time_from: str | None = None
    time_to: str | None = None
    has_error: bool = False
    error_column: str = "error"
    order_by: str = ""
    descending: bool = False
    page_size: int = 0
    offset: int = 0
    returned_mask: list[str] = field(default_factory=list)
    minimum: tuple[str, ...] = CONFIG_MINIMUM


def default_of(data_type: T.DataType) -> Any:
    """Value an unset scalar field stands for, or None for messages and times."""
    if isinstance(data_type, T.StringType):
        return ""
    if isinstance(data_type, T.BooleanType):
        return False
    if isinstance(data_type, T.NumericType):
        return 0
    return None


def literal_of(value: Any, data_type: T.DataType) -> Column:
    """Literal of a nested Python value in the type of its field."""
    if value is None:
        return F.lit(None).cast(data_type)
    if isinstance(data_type, T.StructType):
        return F.struct(*[literal_of(value.get(f.name), f.dataType).alias(f.name) for f in data_type.fields])
    if isinstance(data_type, T.ArrayType):
        return F.array(*[literal_of(v, data_type.elementType) for v in value]).cast(data_type)
    return F.lit(value).cast(data_type)


def value_at(template: dict[str, Any], path: str) -> Any:
    for segment in path.split("."):
        if not isinstance(template, dict):
            return None
        template = template.get(segment)
    return template


def set_at(template: dict[str, Any], path: str, value: Any) -> None:
    *parents, leaf = path.split(".")
    for segment in parents:
        template = template.setdefault(segment, {})
    template[leaf] = value


def path_matches(schema: T.StructType, path: str, value: Any) -> Column:
    """One masked path equals its template value.

    A repeated field has to contain every value, a message is compared as a whole,
    and a scalar takes its default where it is absent on either side.
    """
    data_type = field_at(schema, path)
    column = F.col(path)
    if isinstance(data_type, T.ArrayType):
        wanted = literal_of(value or [], data_type)
        return F.size(F.array_except(wanted, F.coalesce(column, F.array().cast(data_type)))) == 0
    if isinstance(data_type, T.StructType):
        return column.eqNullSafe(literal_of(value, data_type))
    default = default_of(data_type)
    if default is None:
        return column.eqNullSafe(literal_of(value, data_type))
    return F.coalesce(column, literal_of(default, data_type)) == literal_of(
        default if value is None else value, data_type)


def template_matches(schema: T.StructType, template: dict[str, Any], mask: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [path_matches(schema, p, value_at(template, p)) for p in mask], F.lit(True))


def time_between(column: Column, start: str | None, end: str | None) -> Column:
    """``start <= t < end``; an absent bound, or the epoch, is open."""
    def is_open(bound: str | None) -> bool:
        return not bound or bound.startswith("1970-01-01")

    tests = []
    if not is_open(start):
        tests.append(column >= F.lit(start).cast("timestamp_ntz"))
    if not is_open(end):
        tests.append(column < F.lit(end).cast("timestamp_ntz"))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def filtered(df: DataFrame, request: ListRequest) -> DataFrame:
    """Rows a request selects. Plain predicates, so they reach the scan."""
    if request.ids:
        df = df.where(F.col("id").isin(sorted(set(request.ids))))
    if request.kind:
        df = df.where(F.col("kind") == request.kind)
    if request.states:
        df = df.where(F.col("state").isin(request.states))
    if request.name_regex:
        df = df.where(F.col("meta.name").rlike("(?i)" + request.name_regex))
    if request.label_selectors:
        df = df.where(matches_all(F.col("meta.label"), request.label_selectors))
    if request.template_mask:
        df = df.where(template_matches(df.schema, request.template, request.template_mask))
    if request.time_from or request.time_to:
        df = df.where(time_between(F.col(request.time_path), request.time_from, request.time_to))
    if request.has_error:
        df = df.where(F.col(request.error_column).isNotNull())
    return df


def with_ids(df: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose key is in a table of ids of any length."""
    return df.join(ids.select(F.col("id").alias(column)), column, "left_semi")


CASE_INSENSITIVE_ORDER = {"meta.name", "meta.label.value"}


def order_by_path(df: DataFrame, path: str, descending: bool = False) -> list[Column]:
    """Sort columns for a dotted path with the id as tie-break; names compare lower-cased.

    A path through an array sorts by its values one after the other.
    """
    field_at(df.schema, path)
    column = F.col(path)
    if path in CASE_INSENSITIVE_ORDER:
        many = isinstance(df.select(path).schema[0].dataType, T.ArrayType)
        column = F.transform(column, F.lower) if many else F.lower(column)
    return [column.desc() if descending else column.asc(), F.col("id").asc()]


def page_slice(df: DataFrame, offset: int, page_size: int, order: list[Column]) -> DataFrame:
    """Skip and limit if either is positive; an offset with page size 0 gives no rows."""
    df = df.orderBy(*order) if order else df
    if offset > 0 or page_size > 0:
        return df.offset(offset).limit(page_size)
    return df


def list_rows(df: DataFrame, request: ListRequest) -> DataFrame:
    """Filter, order, page and project as one plan."""
    rows = filtered(df, request)
    order = order_by_path(df, request.order_by, request.descending) if request.order_by else []
    if not order and (request.page_size or request.offset):
        order = [F.col("id").asc()]
    rows = page_slice(rows, request.offset, request.page_size, order)
    return mask_project(rows, request.returned_mask, request.minimum)


def count_rows(df: DataFrame, request: ListRequest) -> DataFrame:
    """Number of matching objects; paging and projection do not matter."""
    return filtered(df, request).agg(F.count(F.lit(1)).alias("count"))


def _typed(value: str, data_type: T.DataType, path: str) -> Any:
    if isinstance(data_type, T.BooleanType):
        # The accepted spellings of a boolean.
        if value in ("1", "t", "T", "TRUE", "true", "True"):
            return True
        if value in ("0", "f", "F", "FALSE", "false", "False"):
            return False
        raise ValueError(f"error converting {value} to boolean")
    if isinstance(data_type, T.IntegralType):
        try:
            return int(value, 0)
        except ValueError:
            raise ValueError(f"error converting {value} to int") from None
    if isinstance(data_type, T.FractionalType):
        try:
            return float(value)
        except ValueError:
            raise ValueError(f"error converting {value} to float") from None
    if isinstance(data_type, T.StructType):
        left, separator, right = value.partition(":")
        names = data_type.fieldNames()
        if not (left and separator and right) or len(names) != 2:
            raise ValueError(f"not a valid {names[0]}:{names[-1]} value {value} for: {path}")
        return dict(zip(names, (left, right)))
    return value


def add_filter(schema: T.StructType, text: str, template: dict[str, Any], mask: list[str],
               enums: dict[str, list[str]] | None = None) -> None:
    """Parse ``field[.field]*[+-]=value`` into a template and mask, typed by the schema."""
    path, separator, value = text.partition("=")
    if not separator:
        raise ValueError(f"invalid filter: {text}")
    if path not in mask:
        mask.append(path)
    path = path.rstrip("+-")
    data_type = field_at(schema, path)
    if enums and path in enums and value not in enums[path]:
        raise ValueError(f"not a valid enum value '{value}' for '{path}'. Valid values: {', '.join(enums[path])}")
    if isinstance(data_type, T.ArrayType):
        values = list(value_at(template, path) or [])
        set_at(template, path, values + [_typed(value, data_type.elementType, path)])
    else:
        set_at(template, path, _typed(value, data_type, path))


def filter_string(df: DataFrame, *texts: str) -> DataFrame:
    """Rows matching filter strings, joined by AND."""
    template: dict[str, Any] = {}
    mask: list[str] = []
    for text in texts:
        add_filter(df.schema, text, template, mask)
    return df.where(template_matches(df.schema, template, [m.rstrip("+-") for m in mask]))


def nulls_last_order(column: str, kind: str = "text", descending: bool = False) -> list[Column]:
    """Case-insensitive text, number or date order; blank or invalid values last either way."""
    blank_free = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
    key = {"text": F.lower(blank_free), "number": blank_free.try_cast("double"),
           "date": blank_free.try_cast("timestamp_ntz")}[kind]
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("id").asc()]


def sort_nulls_last(df: DataFrame, column: str, kind: str = "text", descending: bool = False) -> DataFrame:
    return df.orderBy(*nulls_last_order(column, kind, descending))


def query_limit(df: DataFrame, limit: int) -> DataFrame:
    """Ad-hoc query limit: 0 means 50, -1 means all rows."""
    if limit == -1:
        return df
    return df.limit(50 if limit == 0 else limit)


def log_lookup(logs: DataFrame, warc_ids: list[str] | None = None, execution_id: str = "",
               other_filter: bool = False, page_size: int = 0, offset: int = 0,
               seq: str = "ingestion_seq") -> DataFrame:
    """Logs by warc ids, else by execution, else the newest; any other filter is an error."""
    if warc_ids:
        return logs.where(F.col("warc_id").isin(warc_ids))
    if execution_id:
        return newest_first(logs.where(F.col("execution_id") == execution_id), seq, offset, page_size)
    if other_filter:
        raise ValueError("logs can be listed by warc id or by execution id only")
    return newest_first(logs, seq, offset, page_size if page_size > 0 else 1)


def newest_first(rows: DataFrame, seq: str, offset: int, page_size: int) -> DataFrame:
    """A page of the newest rows; without a page size all from the offset on, sorted over many tasks."""
    newest = [F.col(seq).desc()]
    if page_size > 0:
        return rows.orderBy(*newest).offset(max(offset, 0)).limit(page_size)
    if offset > 0:
        numbered = sorted_numbers(rows, newest, "_place")
        rows = numbered.where(F.col("_place") > offset).drop("_place")
    return rows.orderBy(*newest)
