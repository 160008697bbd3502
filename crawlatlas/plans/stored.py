"""Named queries kept in files."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class StoredQuery:
    """SQL text with positional arguments, and a template for its rows."""

    sql: str
    template: str = ""


def find(name: str, query_dir: str) -> Path:
    """The file of a name: the path itself, then below the query directory, plain, .yml, .yaml."""
    below = Path(query_dir) / name
    for path in (Path(name), below, below.with_name(below.name + ".yml"), below.with_name(below.name + ".yaml")):
        if path.is_file():
            return path
    raise FileNotFoundError(f"query not found: {name}")


def read(path: Path) -> StoredQuery:
    text = path.read_text()
    if path.suffix not in (".yml", ".yaml"):
        return StoredQuery(text)
    import yaml

    fields = yaml.safe_load(text)
    return StoredQuery(fields["query"], fields.get("template", ""))


def run(spark: SparkSession, query: StoredQuery, args: list, tables: dict[str, DataFrame]) -> DataFrame:
    """Run SQL with its arguments bound as ``?``, never pasted into the text.

    With a template, each row becomes one text, ``{{.column}}`` standing for a value.
    """
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    rows = spark.sql(query.sql, args=list(args))
    if not query.template:
        return rows
    pieces = re.split(r"(\{\{\s*\.\w+\s*\}\})", query.template)
    parts = [F.coalesce(F.col(re.sub(r"[{}.\s]", "", p)).cast("string"), F.lit("")) if p.startswith("{{") else F.lit(p)
             for p in pieces if p]
    return rows.select(F.concat(*parts).alias("text"))
