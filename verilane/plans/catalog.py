"""Every query over the driver tables and over inline rows, with its DuckDB twin."""

from __future__ import annotations

from . import cascade, extras, fixtures, joins, more, records, screens, spellings, tables


def queries() -> dict:
    return {**tables.QUERIES, **fixtures.QUERIES, **more.QUERIES, **screens.QUERIES, **extras.QUERIES, **records.QUERIES, **joins.QUERIES, **cascade.QUERIES, **spellings.QUERIES}


def oracle_sql() -> dict:
    return {**tables.SQL, **fixtures.SQL, **more.SQL, **screens.SQL, **extras.SQL, **records.SQL, **joins.SQL, **cascade.SQL, **spellings.SQL}
