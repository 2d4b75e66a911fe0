"""Oracle SQL for the catalog runner: the row counts of its queries' own oracles."""

from __future__ import annotations

from subscope.plans.catalog import FIXED_LIST


def sql(others: dict[str, str]) -> dict[str, str]:
    rows = [f"SELECT '{name}' AS name, 'ok' AS status, count(*) AS row_count FROM ({others[name].rstrip().rstrip(';')}) q_{i}"
            if name in others else f"SELECT '{name}' AS name, 'error' AS status, CAST(NULL AS BIGINT) AS row_count"
            for i, name in enumerate(FIXED_LIST)]
    return {"catalog_report": "\nUNION ALL ".join(rows)}
