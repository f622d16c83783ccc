"""Attributes that a query names, held against those that are declared."""

from __future__ import annotations

from collections.abc import Iterator

from factloom.functions.basis import TX
from factloom.plans import ast as A
from factloom.plans.errors import UnknownAttribute

#: Attributes of the engine itself; always known.
BUILT_IN = (TX, ":_schema/", ":_sys/")


def named(q: A.Query) -> Iterator[tuple[str, str]]:
    """(attribute, path) of every place that names one."""
    for i, c in enumerate(q.where):
        for p in A._patterns(c):
            if isinstance(p.attribute, str):
                yield p.attribute, f"where[{i}]"
    for i, r in enumerate(q.rules):
        for p in r.body:
            if isinstance(p, A.Pattern) and isinstance(p.attribute, str):
                yield p.attribute, f"rules[{i}]"
    for i, (a, _) in enumerate(q.optional[1] if q.optional else ()):
        yield a, f"optionalProjection.fields[{i}]"


def distance(a: str, b: str, limit: int) -> int:
    """Edits (insert, delete, replace) between two texts, or ``limit`` if there are as many or more."""
    if abs(len(a) - len(b)) >= limit:
        return limit
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) >= limit:
            return limit
    return min(row[-1], limit)


def near(name: str, known: set[str]) -> str | None:
    """The known attribute of the fewest edits, the first of equals: three at most, and a quarter of the name's length."""
    limit = min(3, len(name) // 4) + 1
    found = [(distance(name, k, limit), k) for k in known]
    d, best = min(found, default=(limit, None))
    return best if d < limit else None


def check_attributes(q: A.Query, known: set[str]) -> None:
    """Raises on the first attribute that is neither known nor the engine's own; the error has a suggestion, if there is one."""
    for name, path in named(q):
        if name in known or name.startswith(BUILT_IN):
            continue
        hint = near(name, known)
        raise UnknownAttribute("unknown_attribute", path, f"{name!r} is not declared" + (f"; did you mean {hint!r}?" if hint else ""), suggestion=hint)
