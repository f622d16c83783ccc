"""Public scalars of four families, as one struct that Spark can compare, join, group and order.

The struct is never null and has no NaN, so equality of families and values is plain equality of structs: 7 equals the
datetime 7, "x" equals the ref "x", 7 differs from "7", and null equals null. Joins on it are equi-joins.
"""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER, BOOLEAN, TEXT, NULL = 0, 1, 2, 3
#: Stored types and the family each shows as.
FAMILY = {"string": TEXT, "number": NUMBER, "boolean": BOOLEAN, "datetime": NUMBER, "ref": TEXT, "json": TEXT, "blob": TEXT, "sealed": NULL}
#: Order of stored types where one of several values of an attribute has to be picked.
TAG_ORDER = {"boolean": 1, "number": 2, "string": 3, "ref": 4, "datetime": 5, "json": 6, "blob": 7, "sealed": 8}
VALUE = T.StructType([T.StructField("fam", T.ByteType(), False), T.StructField("num", T.DoubleType()), T.StructField("bool", T.BooleanType()), T.StructField("txt", T.StringType())])
NATIVE = {NUMBER: "double", BOOLEAN: "boolean", TEXT: "string"}
_PART = {NUMBER: "num", BOOLEAN: "bool", TEXT: "txt"}


def struct(native: Column, family: int) -> Column:
    """The struct of a native column; a null becomes the null scalar."""
    none = {f: F.lit(None).cast(NATIVE[f]) for f in NATIVE}
    there = native.isNotNull()
    # 0.0 and -0.0 are one number to Spark's equality already; NaN can't be stored.
    parts = [(native.cast(NATIVE[f]) if f == family else none[f]).alias(_PART[f]) for f in NATIVE]
    fam = F.when(there, F.lit(family)).otherwise(F.lit(NULL)).cast("byte")
    return F.struct(fam.alias("fam"), *parts).cast(VALUE)


def family_of(value: Any) -> int:
    if value is None:
        return NULL
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, (int, float)):
        return NUMBER
    return TEXT


def literal(value: Any) -> Column:
    """The struct of a Python scalar."""
    family = family_of(value)
    parts = [F.lit((float(value) if f == NUMBER else value) if f == family else None).cast(NATIVE[f]).alias(_PART[f]) for f in NATIVE]
    return F.struct(F.lit(family).cast("byte").alias("fam"), *parts).cast(VALUE)


def part(value: Column, family: int) -> Column:
    """The native value of one family; null for the others."""
    return value[_PART[family]]


def canonical_json(value: Any) -> str:
    """Sorted keys, no spaces, finite numbers; whole numbers without a fraction."""

    def plain(x: Any) -> Any:
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return x
        if isinstance(x, (int, float)):
            if not math.isfinite(x):
                raise ValueError("JSON numbers are finite")
            return int(x) if float(x).is_integer() and abs(x) < 2**53 else x
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x]

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def order_columns(value: Column, descending: bool = False, family: int | None = None) -> list[Column]:
    """Sort keys of the total order: numbers, booleans, texts, then null; direction applies within a family only."""
    turn = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_last())
    if family is not None:
        return [turn(value)]
    return [value["fam"].asc(), *[turn(value[p]) for p in ("num", "bool", "txt")]]
