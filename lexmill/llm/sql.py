"""DuckDB SQL of the training-data queries that plain SQL can state."""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    return {
        "p6_found": """
            SELECT chunk_no, CASE WHEN list_max(list_transform(string_split_regex(regexp_replace(text, '([.;:?!]) ', '\\1' || chr(10), 'g'), chr(10)), lambda x: length(x))) <= 1200
              THEN 'natural' ELSE 'forced' END AS cut
            FROM chunks WHERE length(text) > 1200""",
    }
