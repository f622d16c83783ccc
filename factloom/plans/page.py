"""Wrapped queries and snapshot-stable pages: filters on results, total order, keyset cursors, optional count."""

from __future__ import annotations

import base64
import hashlib
import json
import time
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.functions.basis import Basis
from factloom.plans import ast as A
from factloom.plans.compile import Bind, Rel, compiled, decoded, name, total_order
from factloom.plans.errors import CursorError

VERSION = 2
_PARTS = {V.NUMBER: "num", V.BOOLEAN: "bool", V.TEXT: "txt"}


def _operand(rel: Rel, v: A.Var) -> dict[int, Column]:
    """The native value of each family, null where the row's value has another."""
    b = rel.binds[v]
    c = F.col(f"`{name(v)}`")
    if b.family is not None:
        return {f: c if f == b.family else F.lit(None).cast(V.NATIVE[f]) for f in _PARTS}
    return {f: V.part(c, f) for f in _PARTS}


def condition(f: A.Filter, rel: Rel) -> Column:
    """Filters match within a family; null matches only is-null."""
    parts = _operand(rel, f.column)
    null = parts[V.NUMBER].isNull() & parts[V.BOOLEAN].isNull() & parts[V.TEXT].isNull()
    if f.op == "is-null":
        return null
    if f.op == "is-not-null":
        return ~null
    family = V.family_of(f.value)
    c = parts[family]
    x = F.lit(float(f.value) if family == V.NUMBER else f.value)
    if f.op.endswith("like"):
        escaped = f.value.replace("\\", "\\\\")  # the filter language has no escape
        hit = c.ilike(escaped) if "ilike" in f.op else c.like(escaped)
        return F.coalesce(~hit if f.op.startswith("not") else hit, F.lit(False))
    test = {"=": c == x, "!=": c != x, ">": c > x, ">=": c >= x, "<": c < x, "<=": c <= x}[f.op]
    return F.coalesce(test, F.lit(False))


def wrapped(base, w: dict | A.Wrapped, basis: Basis) -> tuple[Rel, tuple]:
    """The filtered rows, and their complete order as (variable, descending)."""
    w = w if isinstance(w, A.Wrapped) else A.parse_wrapped(w)
    rel = compiled(base, w.inner, basis)
    for f in w.filters:
        rel = Rel(rel.df.where(condition(f, rel)), rel.binds)
    order = w.order or w.inner.order
    asked = {o.variable for o in order}
    return rel, (*order, *[A.Order(v) for v in rel.binds if v not in asked])


def after(rel: Rel, order: tuple, values: list[Any]) -> Column:
    """True for rows behind a row with these values in the order."""
    tests, same = [], F.lit(True)
    for o, x in zip(order, values, strict=True):
        parts = _operand(rel, o.variable)
        family = V.family_of(x)
        fam = F.when(parts[V.NUMBER].isNotNull(), V.NUMBER).when(parts[V.BOOLEAN].isNotNull(), V.BOOLEAN).when(parts[V.TEXT].isNotNull(), V.TEXT).otherwise(V.NULL)
        behind = fam > family
        equal = fam == family
        if family != V.NULL:
            c, lit = parts[family], F.lit(float(x) if family == V.NUMBER else x)
            behind = behind | F.coalesce(c < lit if o.descending else c > lit, F.lit(False))
            equal = equal & F.coalesce(c == lit, F.lit(False))
        tests.append(same & behind)
        same = same & equal
    return reduce(lambda a, b: a | b, tests)


def _hash(x: Any) -> str:
    return hashlib.sha256(V.canonical_json(x).encode()).hexdigest()[:32]


@dataclass
class Page:
    rows: list[dict]
    cursor: str | None
    total: int | None = None
    basis: Basis | None = None


def _encode(x: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(x, separators=(",", ":")).encode()).decode().rstrip("=")


def _decode(cursor: str) -> dict:
    try:
        x = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        x["v"], x["query"], x["scope"], x["keys"], x["basis"]
    except Exception:
        raise CursorError("malformed", "cursor", "the cursor can't be read") from None
    if x["v"] != VERSION:
        raise CursorError("unsupported_version", "cursor", f"version {x['v']}")
    return x


def page(base, w: dict, basis: Basis | None = None, scope: str = "", head: int | None = None, now: int | None = None) -> Page:
    """One page. The first pins the basis: the head position (``head``) and, in point mode, the valid time."""
    q = A.parse_wrapped(w)
    asked = {k: v for k, v in q.raw.items() if k not in ("cursor", "includeCount")}
    print_ = _hash(asked)
    given = basis or Basis()
    if q.cursor:
        x = _decode(q.cursor)
        if x["scope"] != _hash(scope):
            raise CursorError("scope_mismatch", "cursor", "the cursor is of another database")
        if x["query"] != print_:
            raise CursorError("query_mismatch", "cursor", "the cursor is of another query")
        pinned = Basis(*x["basis"])
        for k in ("recorded_at", "position", "valid_at"):
            if getattr(given, k) is not None and getattr(given, k) != getattr(pinned, k):
                raise CursorError("basis_mismatch", "cursor", f"another {k}")
        at, keys = pinned, x["keys"]
    else:
        position = given.position
        if head is not None:
            position = head if position is None else min(position, head)
        valid_at = given.valid_at
        if valid_at is None and not q.inner.all_time:
            valid_at = now if now is not None else int(time.time() * 1000)
        at, keys = Basis(given.recorded_at, position, valid_at), None
    rel, order = wrapped(base, q, at)
    if not any(isinstance(t, A.Var) for t in q.inner.find):
        rows = [r.asDict() for r in decoded(rel).limit(1).collect()]
        return Page(rows, None, len(rows) if q.count else None, at)
    total = rel.df.count() if q.count else None
    out = rel
    if keys is not None:
        if len(keys) != len(order):
            raise CursorError("invalid_ordering", "cursor", "the cursor is of another order")
        out = Rel(rel.df.where(after(rel, order, keys)), rel.binds)
    got = out.df.orderBy(*total_order(out, order)).limit(q.limit + 1).collect()
    rows = [{v.column: _plain(r[name(v)], b) for v, b in rel.binds.items()} for r in got[: q.limit]]
    cursor = None
    if len(got) > q.limit:
        last = rows[-1]
        cursor = _encode({"v": VERSION, "query": print_, "scope": _hash(scope), "basis": [at.recorded_at, at.position, at.valid_at], "keys": [last[o.variable.column] for o in order]})
    return Page(rows, cursor, total, at)


def _plain(x: Any, b: Bind) -> Any:
    if b.family is None:
        return {V.NUMBER: x["num"], V.BOOLEAN: x["bool"], V.TEXT: x["txt"], V.NULL: None}[x["fam"]]
    return float(x) if b.family == V.NUMBER and x is not None else x


def keyset(base, w: dict, values: list[Any], basis: Basis | None = None) -> DataFrame:
    """The page behind a row with these values, as a DataFrame."""
    q = A.parse_wrapped(w)
    rel, order = wrapped(base, q, basis or Basis())
    out = Rel(rel.df.where(after(rel, order, values)), rel.binds)
    return decoded(Rel(out.df.orderBy(*total_order(out, order)).limit(q.limit), rel.binds))
