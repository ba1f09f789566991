"""Small pieces of DuckDB SQL shared by the checks."""

from __future__ import annotations

# the log with its payload opened: blank -> {}, unparseable -> {"raw": text}
OPEN_LOG = """
lg AS (SELECT *, CASE WHEN payload IS NULL OR payload = '' THEN '{}'::JSON
       ELSE coalesce(TRY_CAST(payload AS JSON), json_object('raw', payload)) END AS j FROM v_log)
"""


def text(path: str, source: str = "j") -> str:
    """Non-empty JSON string at a path."""
    return (
        f"(CASE WHEN json_type({source}, '$.{path}') = 'VARCHAR' "
        f"THEN nullif(json_extract_string({source}, '$.{path}'), '') END)"
    )


def number(path: str, source: str = "j") -> str:
    """JSON number at a path."""
    return (
        f"(CASE WHEN json_type({source}, '$.{path}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') "
        f"THEN CAST(json_extract_string({source}, '$.{path}') AS DOUBLE) END)"
    )


def types(*names: str) -> str:
    return "event_type IN (" + ", ".join(f"'{name}'" for name in names) + ")"
