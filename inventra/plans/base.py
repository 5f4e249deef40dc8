"""Registration of queries: a function over the tables, and the SQL that it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.bridge import Tables, common_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, plain: bool = False):
    """plain: the SQL needs none of the inventory's tables."""

    def put(function: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql if plain else (common_tables() + sql if not sql.startswith(",") else common_tables().rstrip() + sql)
        return function

    return put


# Expressions of the comparison SQL that several queries use.
AS_OF_SQL = "timestamp '2024-06-01 00:00:00'"


def _parsed(x: str, formats: tuple[str, ...], epoch: bool) -> str:
    tried = ", ".join(f"try_strptime({x}, '{f}')" for f in formats)
    return f"coalesce({tried}{f', make_timestamp(CAST(try_cast({x} AS DOUBLE) * 1000000 AS BIGINT))' if epoch else ''})"


# The forms that dates come in.
def parse_time(x: str) -> str:
    return _parsed(x, ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y"), True)


def parse_creation(x: str) -> str:
    return _parsed(x, ("%d/%m/%Y %H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d"), False)


def parse_flexible(x: str) -> str:
    return _parsed(x, ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%fZ"), True)


RELIABLE = f"coalesce({parse_time('last_modified')}, {parse_time('creation_time')})"


def share_sql(part: str, total: str, digits: int = 1) -> str:
    return f"CASE WHEN {total} > 0 THEN round(100.0::DOUBLE * {part} / {total}, {digits}) ELSE 0.0::DOUBLE END"


def gb_sql(x: str) -> str:
    return f"round(coalesce({x}, 0)::DOUBLE / 1073741824, 4)"


IGNORE = "CASE WHEN coalesce(file_size, 0) = 0 THEN 'zero_size_file' WHEN file_size > 281474976710656 THEN 'file_too_large' WHEN contains(upper(fast_hash), 'ERROR') THEN 'hash_error' WHEN regexp_matches(lower(path), '(\\.tmp|\\.temp|\\.~)$') THEN 'temporary_file' ELSE 'ok' END"
HASHED = "coalesce(trim(fast_hash), '') <> ''"
ELIGIBLE = f"({IGNORE}) = 'ok' AND {HASHED}"
FAMILIES = f"(SELECT fast_hash, file_size, count(*) AS n FROM active WHERE {ELIGIBLE} GROUP BY ALL HAVING count(*) > 1)"
ALERT2 = "CASE WHEN security_class = 'C3' AND rgpd_risk = 'critical' THEN 'super_critical' WHEN security_class = 'C3' OR rgpd_risk = 'critical' THEN 'critical' END"
ALERT3 = "CASE WHEN security_class = 'C3' AND rgpd_risk = 'critical' AND legal_type IN ('nda', 'litigation') THEN 'super_critical' WHEN security_class = 'C3' OR rgpd_risk = 'critical' OR legal_type IN ('nda', 'litigation') THEN 'critical' END"
EXT = "CASE WHEN regexp_replace(lower(coalesce(extension, '')), '^\\.+', '') = '' THEN '' ELSE '.' || regexp_replace(lower(extension), '^\\.+', '') END"
ATTRIBUTES = "regexp_split_to_array(trim(lower(replace(coalesce(file_attributes, ''), ',', ' '))), '\\s+')"
SIZE_BUCKET = "CASE WHEN file_size < 52428800 THEN '<50MB' WHEN file_size < 104857600 THEN '50-100MB' WHEN file_size < 157286400 THEN '100-150MB' WHEN file_size < 209715200 THEN '150-200MB' WHEN file_size < 314572800 THEN '200-300MB' WHEN file_size < 524288000 THEN '300-500MB' ELSE '>500MB' END"


def period_sql(x: str, closed_above: bool) -> str:
    parts = []
    for name, low, high in (("0_1y", 0, 365), ("1_2y", 365, 730), ("2_3y", 730, 1095), ("3_4y", 1095, 1460), ("4_5y", 1460, 1825), ("5_6y", 1825, 2190)):
        up, down = f"{AS_OF_SQL} - to_days({low})", f"{AS_OF_SQL} - to_days({high})"
        parts.append(f"WHEN {x} {'>' if closed_above else '>='} {down} AND {x} {'<=' if closed_above else '<'} {up} THEN '{name}'")
    return f"CASE {' '.join(parts)} WHEN {x} <= {AS_OF_SQL} - to_days(2190) THEN '6plus' END"


def human_sql(x: str, gap: str = " ") -> str:
    steps = "".join(f" WHEN {x} < {1024.0 ** (k + 1):.1f} THEN printf('%.1f{gap}{unit}', {x}::DOUBLE / {1024.0**k:.1f})" for k, unit in enumerate(("B", "KB", "MB", "GB")))
    return f"CASE{steps} ELSE printf('%.1f{gap}TB', {x}::DOUBLE / {1024.0**4:.1f}) END"


def confidence_sql(*columns: str) -> str:
    n = " + ".join(f"CASE WHEN coalesce({c}, 0) > 0 THEN 1 ELSE 0 END" for c in columns)
    s = " + ".join(f"CASE WHEN coalesce({c}, 0) > 0 THEN {c} ELSE 0 END" for c in columns)
    return f"CASE WHEN {n} > 0 THEN CAST(floor(({s})::DOUBLE / ({n})) AS INTEGER) ELSE 0 END"
