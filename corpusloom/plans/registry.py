"""Where queries register: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The long form of combined_data's label map, for the SQL side.
LONG = """WITH e AS (SELECT rec_id, text_input, unnest(map_entries(output)) AS e FROM combined_data),
s AS (SELECT rec_id, text_input, e.key AS etype, unnest(e.value) AS span, generate_subscripts(e.value, 1) AS ord FROM e)"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
