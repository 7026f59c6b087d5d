"""Schemas of the news tables, additive evolution and back-fill of columns that a table lacks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW_NEWS_DDL = "id string, title string, raw_time string, standard_timestamp timestamp_ntz, source string, url string, true_order int, is_noise boolean"
EVENT_DDL = "event_timestamp timestamp_ntz, event_time_start timestamp_ntz, event_time_end timestamp_ntz, time_granularity string, parse_mode string"
PARSED_NEWS_DDL = f"{RAW_NEWS_DDL}, {EVENT_DDL}"
CHECKPOINT_DDL = "source string, next_start_time string, updated_at timestamp_ntz"
STAGED_DDL = "id string, title string, raw_time string, source string, true_order int, is_noise boolean, url string"

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def identifier(name: str) -> str:
    """A table name fit to stand in SQL text, or ValueError."""
    if not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def columns_of(ddl: str) -> dict[str, str]:
    return dict(part.strip().split(" ", 1) for part in ddl.split(","))


def with_optional_columns(df: DataFrame, ddl: str) -> DataFrame:
    """df with a null column of the given type for each named column that it lacks."""
    missing = {name: kind for name, kind in columns_of(ddl).items() if name not in df.columns}
    return df.withColumns({name: F.lit(None).cast(kind) for name, kind in missing.items()}) if missing else df


def evolve(df: DataFrame, ddl: str = PARSED_NEWS_DDL) -> DataFrame:
    """df with all columns of the schema, in its order and types; others follow."""
    wanted = columns_of(ddl)
    df = with_optional_columns(df, ddl)
    return df.select(*[F.col(n).cast(k).alias(n) for n, k in wanted.items()], *[c for c in df.columns if c not in wanted])


def backfill_events(df: DataFrame) -> DataFrame:
    """Range and mode of rows from tables that predate them: the range is the point, the mode is told by the times."""
    df = with_optional_columns(df, EVENT_DDL)
    told = (
        F.when(F.col("event_timestamp").isNull(), "missing_event")
        .when(F.col("event_timestamp").eqNullSafe(F.col("standard_timestamp")), "fallback_like")
        .otherwise("parsed_like")
    )
    return df.withColumns(
        {
            "event_time_start": F.coalesce("event_time_start", "event_timestamp"),
            "event_time_end": F.coalesce("event_time_end", "event_timestamp"),
            "parse_mode": F.coalesce(F.nullif("parse_mode", F.lit("")), told),
        }
    )
