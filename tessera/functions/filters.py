"""The JSON query language: conjunctive filters, type, order, limit and offset."""

from __future__ import annotations

import base64
import binascii
import json
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DataType, NumericType, StringType

ORDERED = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def same_kind(kind: DataType, value: object) -> bool:
    if value is None:
        return True
    if isinstance(value, bool):
        return isinstance(kind, BooleanType)
    return isinstance(kind, NumericType) if isinstance(value, (int, float)) else isinstance(kind, StringType) and isinstance(value, str)


def condition(df: DataFrame, field: str, op: str, value: object) -> Column:
    """One filter; comparison is strict in type, and null equals null. An unknown operator is an error."""
    known = field in df.columns
    c, kind = (F.col(f"`{field}`"), df.schema[field].dataType) if known else (F.lit(None).cast("string"), StringType())
    if op in ("eq", "ne"):
        equal = c.eqNullSafe(F.lit(value)) if same_kind(kind, value) else F.lit(False)
        return equal if op == "eq" else ~equal
    if op in ORDERED:
        usable = known and isinstance(kind, NumericType) and isinstance(value, (int, float)) and not isinstance(value, bool)
        return F.coalesce(ORDERED[op](c, F.lit(value)), F.lit(False)) if usable else F.lit(False)
    if op == "in":
        values = [v for v in value if same_kind(kind, v)] if isinstance(value, (list, tuple)) else []
        return reduce(operator.or_, [c.eqNullSafe(F.lit(v)) for v in values], F.lit(False))
    if op in ("contains", "starts_with"):
        if not isinstance(value, str) or not isinstance(kind, StringType):
            return F.lit(False)
        test = F.contains if op == "contains" else F.startswith
        return F.coalesce(test(F.lower(c), F.lit(value.lower())), F.lit(False))
    raise ValueError(f"unknown operator {op}")


def run_query(df: DataFrame, filters: list[dict] = (), type: str | None = None, order_by: str | None = None, order_dir: str = "asc", limit: int = 20, offset: int = 0, tie: str = "id") -> DataFrame:  # noqa: A002
    """Filters are pushed to the scan; nulls come last in both directions, ties by ``tie``."""
    out = reduce(lambda d, f: d.where(condition(d, f["field"], f["operator"], f.get("value"))), filters, df)
    if type is not None:
        out = out.where(F.col("type") == type)
    keys = [F.col(f"`{order_by}`").desc_nulls_last() if order_dir == "desc" else F.col(f"`{order_by}`").asc_nulls_last()] if order_by in df.columns else []
    return out.orderBy(*keys, tie).offset(max(0, offset)).limit(limit if 1 <= limit <= 100 else 20)


def cursor(offset: int) -> str:
    return base64.b64encode(json.dumps({"offset": offset}, separators=(",", ":")).encode()).decode()


def offset_of(cursor: str) -> int:
    """A cursor that can't be read is the beginning."""
    try:
        found = json.loads(base64.b64decode(cursor, validate=True)).get("offset")
    except (binascii.Error, ValueError, AttributeError):
        return 0
    return found if isinstance(found, int) and found >= 0 else 0


def page_info(total: int, limit: int, offset: int) -> dict:
    """What stands beside a page of results."""
    more = offset + limit < total
    return {"total": total, "limit": limit, "offset": offset, "has_more": more, "next": cursor(offset + limit) if more else None}
