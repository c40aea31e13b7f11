"""Row-by-row comparison of a Spark query with its SQL on the same Parquet files."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

from recordloom.sources.files import SCHEMAS


def oracle_connection(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


DUCK_TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return f"{value:.12g}" if value else "0"
    if isinstance(value, Decimal):
        return f"decimal {value}"
    if isinstance(value, (list, tuple)):
        return str([_plain(v) for v in value])
    if isinstance(value, (datetime.datetime, datetime.date, bool)):
        return repr(value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(df, con, sql: str, show: int = 3) -> list[str]:
    """Empty when names, value types and all values agree."""
    spark_rows = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    duck_rows = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} / {sorted(names)}"]
    if len(spark_rows) != len(duck_rows):
        return [f"rows {len(spark_rows)} / {len(duck_rows)}", str(spark_rows[:show]), str(duck_rows[:show])]
    spark_types = {name: DUCK_TYPES.get(kind, kind) for name, kind in df.dtypes}
    found = [
        f"type of {d[0]}: {spark_types[d[0]]} / {d[1]}" for d in result.description if spark_types[d[0]] != str(d[1])
    ]
    a, b = _rows(df.columns, spark_rows), _rows(names, duck_rows)
    unequal = [(x, y) for x, y in zip(a, b) if x != y]
    if unequal:
        found.append(f"{len(unequal)} of {len(a)} rows differ, columns {sorted(names)}")
        found += [f"  {x} / {y}" for x, y in unequal[:show]]
    return found
