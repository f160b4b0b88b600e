"""Row predicates and scalar helpers.

Filters are plain Column expressions so Catalyst pushes them into the scan
(``PushedFilters``) wherever the predicate shape allows it."""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Prefixes of pipeline-internal backing tables.
INTERNAL_TABLE_RE = r"^(__materialization_mat_|event_log_|__apply_changes)"
INTERNAL_NAME_RE = r"[.](__materialization_mat_|event_log_|__apply_changes)"

# Identifier and entity-id validation patterns.
IDENTIFIER_RE = r"^[A-Za-z0-9_]{1,255}$"
FULL_NAME_RE = r"^[A-Za-z0-9_]{1,255}\.[A-Za-z0-9_]{1,255}\.[A-Za-z0-9_]{1,255}$"
JOB_ID_RE = r"^[0-9]{1,32}$"
PIPELINE_ID_RE = r"^[a-fA-F0-9-]{8,64}$"
NOTEBOOK_ID_RE = r"^[A-Za-z0-9_./@ +-]{1,512}$"
OTHER_ID_RE = r"^[A-Za-z0-9_./@ +-]{1,256}$"
SAFE_ENTITY_ID_RE = r"^[A-Za-z0-9_./@ +:-]{1,512}$"

# Medallion tiers in display order.
MEDALLION_TIERS = ("bronze", "silver", "gold")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def window_start(as_of: str | _dt.date, days: int) -> _dt.date:
    d = _dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    return d - _dt.timedelta(days=days)


_EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def ntz_to_instant(c: Column | str) -> Column:
    """A wall-clock (NTZ) timestamp as the instant it denotes in UTC. Built
    from its fields with an explicit 'UTC' zone, so neither the session
    time zone nor its DST gaps can shift it (watermarks need instants)."""
    t = _c(c)
    return F.make_timestamp(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t),
                            F.date_part(F.lit("SECOND"), t), F.lit("UTC"))


def ntz_micros(c: Column | str) -> Column:
    """Microseconds since 1970-01-01 of an NTZ value (session-zone free)."""
    return F.unix_micros(ntz_to_instant(c))


def instant_to_ntz(c: Column | str) -> Column:
    """Inverse of ``ntz_to_instant``: the UTC wall clock of an instant, as
    the epoch plus a day-time interval (session-zone free)."""
    us = F.unix_micros(_c(c))
    days = F.floor(us / F.lit(86_400_000_000))
    secs = ((us - days * F.lit(86_400_000_000)).cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr(_EPOCH_NTZ) + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), secs)


def _ts_literal(df: DataFrame, col: str, d: _dt.date) -> Column:
    """Midnight of ``d`` as a literal of the column's own timestamp type, so
    the comparison needs no cast on the column and pushes into the scan.
    Zoned timestamps take the UTC instant (matching ``ntz_to_instant``)."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"TIMESTAMP_NTZ '{d.isoformat()} 00:00:00'")
    if isinstance(dtype, T.DateType):
        return F.expr(f"DATE '{d.isoformat()}'")
    micros = int((_dt.datetime(d.year, d.month, d.day) - _dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    return F.timestamp_micros(F.lit(micros))


def within_window(df: DataFrame, as_of: str | _dt.date, days: int, col: str = "event_time") -> DataFrame:
    """B1: keep rows with ``col > as_of - days`` (strict, day-truncated)."""
    return df.filter(F.col(col) > _ts_literal(df, col, window_start(as_of, days)))


def not_internal_name(col: Column | str) -> Column:
    c = _c(col)
    return c.isNull() | ~c.rlike(INTERNAL_NAME_RE)


def drop_internal(df: DataFrame, source: str = "source_table_full_name",
                  target: str = "target_table_full_name") -> DataFrame:
    """B2: drop rows whose source or target is a pipeline-internal table
    (NULL-safe, so path-only rows survive)."""
    return df.filter(not_internal_name(source) & not_internal_name(target))


def not_internal_table(table_name: Column | str) -> Column:
    c = _c(table_name)
    return c.isNull() | ~c.rlike(INTERNAL_TABLE_RE)


def _under(path: Column, prefix: str) -> Column:
    return path.startswith(prefix) | path.startswith(f"dbfs:{prefix}")


def scope_predicate(catalog: str, schema: str | None = None) -> Column:
    """A lineage row is in scope when either side's table is in the
    catalog (and schema), or either side's path is under the scope's volume
    prefix, with ``dbfs:`` before it or not. The prefix test is literal, so
    ``_`` in names is not a wildcard. For use in a filter: it is NULL, not
    false, for a row out of scope with missing sides. Only comparisons with
    literals, so all of it reaches the scan."""
    s_cat, s_sch = F.col("source_table_catalog"), F.col("source_table_schema")
    t_cat, t_sch = F.col("target_table_catalog"), F.col("target_table_schema")
    if schema is None:
        prefix = f"/Volumes/{catalog}/"
        tables = (t_cat == catalog) | (s_cat == catalog)
    else:
        prefix = f"/Volumes/{catalog}/{schema}/"
        tables = ((t_cat == catalog) & (t_sch == schema)) | ((s_cat == catalog) & (s_sch == schema))
    return tables | _under(F.col("source_path"), prefix) | _under(F.col("target_path"), prefix)


def scope_filter(df: DataFrame, catalog: str, schema: str | None = None) -> DataFrame:
    return df.filter(scope_predicate(catalog, schema))


def valid_entity_id(etype: Column | str, eid: Column | str) -> Column:
    """Per-type entity-id validity (trimmed id, upper-cased type)."""
    t = F.upper(_c(etype))
    i = F.trim(_c(eid))
    return F.coalesce(
        F.when(t == "JOB", i.rlike(JOB_ID_RE))
        .when(t == "PIPELINE", i.rlike(PIPELINE_ID_RE))
        .when(t == "NOTEBOOK", i.rlike(NOTEBOOK_ID_RE))
        .otherwise(i.rlike(OTHER_ID_RE)),
        F.lit(False))


def valid_identifier(c: Column | str) -> Column:
    return F.coalesce(F.trim(_c(c)).rlike(IDENTIFIER_RE), F.lit(False))


def valid_full_name(c: Column | str) -> Column:
    return F.coalesce(_c(c).rlike(FULL_NAME_RE), F.lit(False))


def flag_invalid_ids(df: DataFrame, etype: str = "entity_type", eid: str = "entity_id") -> tuple[DataFrame, DataFrame]:
    """B8 as a data-quality split: (rows with valid ids, quarantined rows)."""
    flagged = df.withColumn("_valid", valid_entity_id(etype, eid))
    return (flagged.filter("_valid").drop("_valid"), flagged.filter(~F.col("_valid")).drop("_valid"))


def medallion(schema: Column | str) -> Column:
    """Bronze / silver / gold tier of a schema name, else NULL."""
    low = F.lower(_c(schema))
    out = F.lit(None).cast("string")
    for tier in reversed(MEDALLION_TIERS):
        hit = (low == tier) | low.startswith(f"{tier}_") | low.endswith(f"_{tier}")
        out = F.when(hit, F.lit(tier)).otherwise(out)
    return out


def medallion_rank(tier: Column | str) -> Column:
    t = _c(tier)
    out = F.lit(len(MEDALLION_TIERS) + 1)
    for i, tier_name in reversed(list(enumerate(MEDALLION_TIERS, start=1))):
        out = F.when(t == tier_name, F.lit(i)).otherwise(out)
    return out


def freshness(last_run: Column | str, as_of_ts: str) -> tuple[Column, Column]:
    """(fresh = same calendar day as ``as_of_ts``, relative age label)."""
    lr = _c(last_run)
    now = F.expr(f"TIMESTAMP_NTZ '{as_of_ts}'")
    fresh = F.coalesce(F.to_date(lr) == F.to_date(now), F.lit(False))
    micros = ntz_micros(now) - ntz_micros(lr)  # wall-clock difference, no time zone involved
    mins = F.floor(micros / F.lit(60_000_000))
    hrs = F.floor(mins / 60)
    days = F.floor(hrs / 24)
    age = (F.when(lr.isNull(), F.lit(None).cast("string"))
           .when(mins < 1, F.lit("just now"))
           .when(mins < 60, F.concat(mins.cast("string"), F.lit("m ago")))
           .when(hrs < 24, F.concat(hrs.cast("string"), F.lit("h ago")))
           .otherwise(F.concat(days.cast("string"), F.lit("d ago"))))
    return fresh, age


def discounted(cost: Column | str, pct: float) -> Column:
    """Cost after a discount clamped to [0, 99] percent, 2 decimals."""
    p = max(0.0, min(99.0, float(pct)))
    return F.round(_c(cost) * F.lit(1.0 - p / 100.0), 2)


def filter_rows(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """Keep rows where any column's text contains ``text``
    (trimmed, case-insensitive; NULL reads as empty)."""
    q = text.strip().lower()
    if not q:
        return df
    cols = columns or df.columns
    hit = reduce(lambda a, b: a | b,
                 [F.coalesce(F.lower(F.col(c).cast("string")), F.lit("")).contains(q) for c in cols])
    return df.filter(hit)


def shared_as(schema_col: Column | str, alias_schema: Column | str, alias_table: Column | str) -> Column:
    """``{alias_schema or own schema}.{alias_table}``; NULL without a table alias."""
    at = _c(alias_table)
    has = at.isNotNull() & (at != "")
    sch = F.when(_c(alias_schema).isNotNull() & (_c(alias_schema) != ""), _c(alias_schema)).otherwise(_c(schema_col))
    return F.when(has, F.concat(sch, F.lit("."), at))


def cdf_flag(c: Column | str) -> Column:
    return F.coalesce(F.lower(_c(c).cast("string")) == "true", F.lit(False))
