"""Query documents (plain dicts and lists, as JSON has them) as dataclasses, with the checks that need no data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from factloom.plans.errors import UnboundVariable, ValidationError

VARIABLE = re.compile(r"\?[a-zA-Z_][a-zA-Z0-9_]*")
RULE_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_-]*")
COMPARE = ("=", "!=", ">", ">=", "<", "<=")
ORDERED = (">", ">=", "<", "<=")
AGGREGATES = ("count", "sum", "avg", "min", "max")
FILTERS = (*COMPARE, "like", "not-like", "ilike", "not-ilike", "is-null", "is-not-null")
MAX_NOT, MAX_DEPTH = 8, 100


@dataclass(frozen=True)
class Var:
    name: str

    @property
    def column(self) -> str:
        return self.name[1:]


@dataclass(frozen=True)
class Typed:
    """A constant of one stored type: ref, string, number, datetime, boolean, json, blob, or a sealed value's blind token."""

    type: str
    value: Any


@dataclass(frozen=True)
class Pattern:
    entity: Any
    attribute: Any
    value: Any
    tx: Any = None
    start: Any = None
    end: Any = None
    has_start: bool = False
    has_end: bool = False

    def variables(self) -> set[Var]:
        return {t for t in (self.entity, self.attribute, self.value, self.tx, self.start, self.end) if isinstance(t, Var)}


@dataclass(frozen=True)
class Predicate:
    op: str
    left: Any
    right: Any

    def variables(self) -> set[Var]:
        return {t for t in (self.left, self.right) if isinstance(t, Var)}


@dataclass(frozen=True)
class Not:
    clauses: tuple

    def variables(self) -> set[Var]:
        return set().union(*(c.variables() for c in self.clauses))


@dataclass(frozen=True)
class Or:
    alternatives: tuple

    def variables(self) -> set[Var]:
        return set().union(*(c.variables() for c in self.alternatives))


@dataclass(frozen=True)
class RuleCall:
    name: str
    left: Any
    right: Any

    def variables(self) -> set[Var]:
        return {t for t in (self.left, self.right) if isinstance(t, Var)}


@dataclass(frozen=True)
class Rule:
    name: str
    body: tuple
    max_depth: int = MAX_DEPTH


@dataclass(frozen=True)
class Order:
    variable: Var
    descending: bool = False


@dataclass(frozen=True)
class Query:
    find: tuple
    where: tuple
    aggregate: tuple = ()
    having: tuple = ()
    order: tuple = ()
    limit: int | None = None
    offset: int = 0
    rules: tuple = ()
    optional: tuple | None = None
    all_time: bool = False

    def of(self, kind: type) -> list:
        return [c for c in self.where if isinstance(c, kind)]

    def outputs(self) -> list[Var]:
        return [t for t in self.find if isinstance(t, Var)]


@dataclass(frozen=True)
class Filter:
    column: Var
    op: str
    value: Any = None


@dataclass(frozen=True)
class Wrapped:
    inner: Query
    filters: tuple = ()
    order: tuple = ()
    limit: int = 100
    cursor: str | None = None
    count: bool = False
    raw: dict = field(default_factory=dict, compare=False, hash=False)


def _fail(code: str, path: str, message: str):
    raise ValidationError(code, path, message)


def _int(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer()


def term(x: Any, path: str, typed: bool = True, null: bool = True) -> Any:
    if isinstance(x, str):
        if x.startswith("?"):
            if not VARIABLE.fullmatch(x):
                _fail("invalid_variable", path, f"{x!r} is not a variable")
            return Var(x)
        return x
    if isinstance(x, dict):
        if not typed or set(x) != {"type", "value"}:
            _fail("invalid_term", path, "a typed constant has type and value")
        return Typed(x["type"], x["value"])
    if x is None and not null or not (x is None or isinstance(x, (bool, int, float))):
        _fail("invalid_term", path, f"{x!r} is not a term")
    if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
        _fail("invalid_number", path, "numbers are finite")
    return x


def _identity(x: Any, path: str) -> Any:
    t = term(x, path, typed=False)
    if not isinstance(t, (str, Var)):
        _fail("invalid_identity", path, "identities are strings or variables")
    return t


def pattern(x: Any, path: str) -> Pattern:
    bounds: dict = {}
    if isinstance(x, dict):
        if set(x) != {"pattern", "valid"} or not isinstance(x["valid"], dict) or not x["valid"] or set(x["valid"]) - {"from", "to"}:
            _fail("invalid_interval", path, "an interval pattern has pattern and valid with from or to")
        for side in ("from", "to"):
            if side in x["valid"]:
                b = term(x["valid"][side], f"{path}.valid.{side}", typed=False, null=side == "to")
                if not isinstance(b, Var) and b is not None and (not _int(b) or b < 0):
                    _fail("invalid_interval", path, "bounds are variables or whole milliseconds from 0")
                name = "start" if side == "from" else "end"
                bounds |= {name: b, f"has_{name}": True}
        a, b = bounds.get("start"), bounds.get("end")
        if _int(a) and _int(b) and a >= b:
            _fail("empty_interval", path, "the interval is empty")
        x = x["pattern"]
    if not isinstance(x, (list, tuple)) or len(x) not in (3, 4):
        _fail("invalid_pattern", path, "a pattern is [entity, attribute, value] or with a transaction")
    p = Pattern(_identity(x[0], path), _identity(x[1], path), term(x[2], path), _identity(x[3], path) if len(x) == 4 else None, **bounds)
    names = {t for t in (p.entity, p.attribute, p.tx) if isinstance(t, Var)}
    if names & {t for t in (p.start, p.end) if isinstance(t, Var)}:
        _fail("identity_as_bound", path, "a bound can't be an identity")
    return p


def clause(x: Any, path: str, within: str = "where") -> Any:
    if isinstance(x, dict):
        return pattern(x, path)
    if not isinstance(x, (list, tuple)) or not x:
        _fail("invalid_clause", path, "a clause is a list")
    head = x[0]
    if head in COMPARE:
        if len(x) != 3:
            _fail("invalid_predicate", path, "a predicate is [op, left, right]")
        p = Predicate(head, term(x[1], path, typed=False), term(x[2], path, typed=False))
        if head in ORDERED:
            for t in (p.left, p.right):
                if not isinstance(t, Var) and (isinstance(t, bool) or not isinstance(t, (int, float))):
                    _fail("nonnumeric_comparison", path, "ordered predicates compare numbers")
        return p
    if head == "and":
        _fail("unsupported_and", path, "where is a conjunction already; give not several clauses")
    if head == "not":
        if within == "not":
            _fail("nested_not", path, "not can't stand in not")
        if not 1 <= len(x) - 1 <= MAX_NOT:
            _fail("invalid_not", path, f"not takes 1 to {MAX_NOT} clauses")
        inner = tuple(clause(c, f"{path}[{i}]", "not") for i, c in enumerate(x[1:], 1))
        if any(not isinstance(c, (Pattern, Predicate)) for c in inner):
            _fail("invalid_not", path, "not takes patterns and predicates")
        return Not(inner)
    if head == "or":
        if within != "where" or len(x) != 2 or not isinstance(x[1], (list, tuple)) or not x[1]:
            _fail("invalid_or", path, "or takes one list of alternatives, at the top level")
        for i, a in enumerate(x[1]):
            if isinstance(a, (list, tuple)) and a and isinstance(a[0], (list, tuple, dict)):
                _fail("multi_clause_or", f"{path}[1][{i}]", "an alternative is a single clause")
        inner = tuple(clause(c, f"{path}[1][{i}]", "or") for i, c in enumerate(x[1]))
        if any(isinstance(c, (Or, RuleCall)) for c in inner):
            _fail("invalid_or", path, "alternatives are patterns, predicates or not")
        return Or(inner)
    if isinstance(head, str) and RULE_NAME.fullmatch(head) and len(x) == 3 and not (isinstance(x[1], str) and x[1].startswith(":")):
        return RuleCall(head, _identity(x[1], path), _identity(x[2], path))
    return pattern(x, path)


def _order(xs: Any, path: str) -> tuple:
    out = []
    for i, o in enumerate(xs or ()):
        v = term(o.get("variable"), f"{path}[{i}]")
        if not isinstance(v, Var) or o.get("direction", "asc") not in ("asc", "desc"):
            _fail("invalid_order", f"{path}[{i}]", "order by a variable, asc or desc")
        out.append(Order(v, o.get("direction") == "desc"))
    return tuple(out)


def parse(q: dict | Query) -> Query:
    """A checked query; raises ValidationError or UnboundVariable."""
    if isinstance(q, Query):
        return q
    known = {"find", "where", "aggregate", "having", "orderBy", "limit", "offset", "rules", "optionalProjection", "validTime"}
    if not isinstance(q, dict) or set(q) - known:
        _fail("invalid_query", "", f"unknown fields {sorted(set(q) - known)}" if isinstance(q, dict) else "a query is a document")
    where = tuple(clause(c, f"where[{i}]") for i, c in enumerate(q.get("where", ())))
    aggregate = []
    for i, a in enumerate(q.get("aggregate") or ()):
        if len(a) != 3 or a[0] not in AGGREGATES:
            _fail("invalid_aggregate", f"aggregate[{i}]", "an aggregate is [op, source, target]")
        aggregate.append((a[0], term(a[1], f"aggregate[{i}]"), term(a[2], f"aggregate[{i}]")))
    having = tuple(clause(c, f"having[{i}]") for i, c in enumerate(q.get("having") or ()))
    rules = []
    for i, r in enumerate(q.get("rules") or ()):
        if not RULE_NAME.fullmatch(r.get("name", "")) or r["name"] in ("not", "or"):
            _fail("invalid_rule", f"rules[{i}]", "a rule needs a name")
        depth = r.get("maxDepth", MAX_DEPTH)
        if not _int(depth) or depth < 1:
            _fail("invalid_depth", f"rules[{i}]", "maxDepth is a whole number from 1")
        rules.append(Rule(r["name"], tuple(clause(c, f"rules[{i}].body[{k}]", "rule") for k, c in enumerate(r.get("body", ()))), int(depth)))
    optional = None
    if q.get("optionalProjection"):
        o = q["optionalProjection"]
        optional = (term(o["rowBinding"], "optionalProjection"), tuple((f["attribute"], term(f["variable"], "optionalProjection")) for f in o["fields"]))
    limit, offset = q.get("limit"), q.get("offset", 0)
    if limit is not None and (not _int(limit) or limit < 1) or not _int(offset) or offset < 0:
        _fail("invalid_limit", "limit", "limit is a whole number from 1, offset from 0")
    if q.get("validTime", "point") not in ("point", "all"):
        _fail("invalid_valid_time", "validTime", "point or all")
    out = Query(tuple(term(t, f"find[{i}]") for i, t in enumerate(q.get("find", ()))), where, tuple(aggregate), having, _order(q.get("orderBy"), "orderBy"), limit, int(offset), tuple(rules), optional, q.get("validTime") == "all")
    check(out)
    return out


def positive(q: Query) -> set[Var]:
    return set().union(*(c.variables() for c in q.where if isinstance(c, (Pattern, RuleCall))))


def check(q: Query) -> None:
    """What has to hold between the parts of a query."""
    if not q.find:
        _fail("empty_find", "find", "find needs a term")
    if any(isinstance(t, Typed) for t in q.find):
        _fail("invalid_find", "find", "find has variables and plain constants")
    bound = positive(q)
    need = lambda vs, path: [_unbound(v, path) for v in sorted(vs, key=lambda v: v.name) if v not in bound]
    for i, c in enumerate(q.where):
        path = f"where[{i}]"
        if isinstance(c, Predicate):
            need(c.variables(), path)
        for n in [c] if isinstance(c, Not) else c.alternatives if isinstance(c, Or) else ():
            _check_inner(n, bound, path)
    for i, c in enumerate(q.where):
        starts = {t for p in _patterns(c) for t in (p.start, p.end) if isinstance(t, Var)}
        ids = {t for d in q.where for p in _patterns(d) for t in (p.entity, p.attribute, p.tx) if isinstance(t, Var)}
        if starts & ids:
            _fail("identity_as_bound", f"where[{i}]", "a bound can't be an identity")
    targets = [t for _, _, t in q.aggregate]
    optional = [v for _, v in q.optional[1]] if q.optional else []
    for i, (_, source, target) in enumerate(q.aggregate):
        path = f"aggregate[{i}]"
        if not isinstance(source, Var) or not isinstance(target, Var):
            _fail("invalid_aggregate", path, "source and target are variables")
        need({source}, path)
        if target not in q.find:
            _fail("aggregate_target", path, "the target must be in find")
        if targets.count(target) > 1 or target in bound or target in optional:
            _fail("aggregate_collision", path, "the target must be new")
        if source in q.find:
            _fail("aggregate_source", path, "the source can't be in find")
    if q.optional:
        row, fields = q.optional
        if q.all_time:
            _fail("optional_all_time", "optionalProjection", "not in all-time mode")
        if not isinstance(row, Var):
            _fail("invalid_optional", "optionalProjection", "rowBinding is a variable")
        need({row}, "optionalProjection.rowBinding")
        for attribute, v in fields:
            if not isinstance(v, Var) or v not in q.find or v in bound or optional.count(v) > 1 or not isinstance(attribute, str):
                _fail("optional_target", "optionalProjection", "targets are new, distinct variables of find")
    known = bound | set(targets) | set(optional)
    for v in q.outputs():
        if v not in known:
            _unbound(v, "find")
    for i, h in enumerate(q.having):
        if not isinstance(h, Predicate):
            _fail("invalid_having", f"having[{i}]", "having takes predicates")
        if not q.aggregate:
            _fail("invalid_having", f"having[{i}]", "having needs an aggregate")
        for v in h.variables():
            if v not in q.find:
                _unbound(v, f"having[{i}]")
        against = [t for t in (h.left, h.right) if not isinstance(t, Var)]
        if h.variables() & set(targets) and any(isinstance(t, (str, bool)) for t in against):
            _fail("nonnumeric_having", f"having[{i}]", "aggregates are numbers")
    for i, o in enumerate(q.order):
        if o.variable not in q.find:
            _unbound(o.variable, f"orderBy[{i}]")
    names = {r.name for r in q.rules}
    for c in q.of(RuleCall):
        if c.name not in names:
            _fail("unknown_rule", "where", f"no rule {c.name}")
    for i, r in enumerate(q.rules):
        _check_rule(r, f"rules[{i}]")


def _patterns(c: Any) -> list[Pattern]:
    if isinstance(c, Pattern):
        return [c]
    return [p for x in (c.clauses if isinstance(c, Not) else c.alternatives if isinstance(c, Or) else ()) for p in _patterns(x)]


def _unbound(v: Var, path: str):
    raise UnboundVariable("unbound_variable", path, f"{v.name} is bound by no positive pattern", variable=v.name)


def _check_inner(n: Any, bound: set[Var], path: str) -> None:
    if isinstance(n, Predicate):
        for v in n.variables() - bound:
            _unbound(v, path)
    elif isinstance(n, Pattern):
        if n.variables() and not n.variables() & bound:
            _unbound(sorted(n.variables(), key=lambda v: v.name)[0], path)
    else:
        inner = set().union(*(p.variables() for p in n.clauses if isinstance(p, Pattern)))
        for p in n.clauses:
            if isinstance(p, Predicate):
                for v in p.variables() - bound - inner:
                    _unbound(v, path)
        if inner and not inner & bound and any(p.variables() for p in n.clauses):
            _unbound(sorted(inner, key=lambda v: v.name)[0], path)


def _check_rule(r: Rule, path: str) -> None:
    if not r.body:
        _fail("empty_rule", path, "a rule needs a body")
    calls = [c for c in r.body if isinstance(c, RuleCall)]
    for c in r.body:
        if not isinstance(c, (Pattern, RuleCall)):
            _fail("rule_body", path, "rule bodies have patterns and a call")
        if isinstance(c, Pattern) and (c.tx is not None or c.has_start or c.has_end):
            _fail("rule_body", path, "rule bodies have plain patterns")
        if isinstance(c, Pattern) and isinstance(c.attribute, Var):
            _fail("rule_body", path, "rule attributes are constant")
    if calls:
        if len(r.body) != 2 or not isinstance(r.body[0], Pattern) or not isinstance(r.body[1], RuleCall) or r.body[1].name != r.name:
            _fail("rule_shape", path, "a recursive body is a pattern, then a call of the same rule")
        p, c = r.body
        if not all(isinstance(t, Var) for t in (p.entity, p.value, c.left, c.right)) or p.value != c.left or len({p.entity, p.value, c.right}) != 3:
            _fail("rule_shape", path, "a recursive body is [h, attribute, n], [rule, n, t]")
    elif not isinstance(r.body[0].entity, Var) or not isinstance(r.body[-1].value, Var):
        _fail("rule_shape", path, "a body starts and ends with variables")


def parse_wrapped(w: dict) -> Wrapped:
    if "inner" not in w:
        w = {"inner": w}
    inner = parse(w["inner"])
    filters = []
    for i, f in enumerate(w.get("filters") or ()):
        v, op = term(f.get("column"), f"filters[{i}]"), f.get("op")
        if not isinstance(v, Var) or v not in inner.find:
            _unbound(v if isinstance(v, Var) else Var("?"), f"filters[{i}]")
        if op not in FILTERS:
            _fail("invalid_filter", f"filters[{i}]", f"no filter {op!r}")
        value = f.get("value")
        if not op.startswith("is-"):
            if "value" not in f or value is None:
                _fail("filter_value", f"filters[{i}]", "the filter needs a value")
            if "like" in op and not isinstance(value, str):
                _fail("filter_value", f"filters[{i}]", "patterns are texts")
            if op in ORDERED and isinstance(value, bool):
                _fail("filter_value", f"filters[{i}]", "ordered filters compare numbers or texts")
        filters.append(Filter(v, op, value))
    order = _order(w.get("orderBy"), "orderBy")
    for i, o in enumerate(order):
        if o.variable not in inner.find:
            _unbound(o.variable, f"orderBy[{i}]")
    limit = w.get("limit", 100)
    if not _int(limit) or not 1 <= limit <= 1000:
        _fail("invalid_page_size", "limit", "a page has 1 to 1000 rows")
    return Wrapped(inner, tuple(filters), order, int(limit), w.get("cursor"), bool(w.get("includeCount")), w)


def dependencies(q: Query | dict) -> dict:
    """What a query reads: attributes, subjects of each, fixed ids, rule names, and whether any attribute is open."""
    q = parse(q)
    found: dict = {"attributes": set(), "subjects": {}, "ids": set(), "rules": {r.name for r in q.rules}, "dynamic": False}
    patterns = [p for c in q.where for p in _patterns(c)] + [p for r in q.rules for p in r.body if isinstance(p, Pattern)]
    for p in patterns:
        if isinstance(p.attribute, Var):
            found["dynamic"] = True
            continue
        found["attributes"].add(p.attribute)
        fixed = p.entity if isinstance(p.entity, str) else None
        if fixed:
            found["ids"].add(fixed)
        old = found["subjects"].get(p.attribute, set())
        found["subjects"][p.attribute] = None if fixed is None or old is None else old | {fixed}
    for attribute, _ in q.optional[1] if q.optional else ():
        found["attributes"].add(attribute)
        found["subjects"][attribute] = None
    return found
