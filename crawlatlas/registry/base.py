"""Registration of queries and expansion of derived tables in their SQL."""

from __future__ import annotations

import re

from crawlatlas.sources import derived

QUERIES: dict = {}
SQL: dict[str, str] = {}

TABLES = {**{n: derived.rowwise_sql(n) for n in derived.ROWWISE}, **derived.AGGREGATED_SQL}


def with_tables(sql: str) -> str:
    """Prefix the derived tables a query names as common table expressions."""
    wanted, queue = [], [sql]
    while queue:
        text = queue.pop()
        for name in TABLES:
            if name not in wanted and re.search(rf"(?i)\b(from|join)\s+{name}\b", text):
                wanted.append(name)
                queue.append(TABLES[name])
    body = sql.strip()
    ctes = [f"{n} AS ({TABLES[n]})" for n in reversed(wanted)]
    if not ctes:
        return body
    recursive = ""
    if re.match(r"(?i)with\s+recursive\b", body):
        recursive, body = "RECURSIVE ", re.sub(r"(?i)^with\s+recursive\s+", "", body)
        return f"WITH {recursive}{', '.join(ctes)}, {body}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {', '.join(ctes)}, " + re.sub(r"(?i)^with\s+", "", body)
    return f"WITH {', '.join(ctes)} {body}"


def query(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``key``, with the SQL that must give the same rows."""

    def register(fn):
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = with_tables(sql)
        return fn

    return register
