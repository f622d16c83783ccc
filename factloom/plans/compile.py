"""Query documents to DataFrames.

Order of work, whatever the order of the text: patterns (fused over lifted tables, joined along shared variables), rules,
predicates, negations, disjunctions, then projection or aggregation, having, order and slice. Everything stays lazy and
declarative; only recursion acts. Every comparison is two-valued.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.functions.basis import Basis
from factloom.plans import ast as A
from factloom.plans.attributes import check_attributes
from factloom.plans.errors import ValidationError
from factloom.sources.facts import FactBase, LiftedTable


#: Rows of the two sides of a cell; as few of the second as a merge join holds in an array (4096, with room for chance).
CELL = (16384, 2048)


@dataclass(frozen=True)
class Bind:
    """How a variable is held: natively in one family, or (None) as the struct. Native nulls are the null scalar."""

    family: int | None
    nullable: bool = False


@dataclass
class Rel:
    """``key``: variables whose values tell all rows apart, if that is known. None: rows may repeat. ``scan``: cheap to read twice."""

    df: DataFrame
    binds: dict[A.Var, Bind] = field(default_factory=dict)
    key: frozenset[A.Var] | None = None
    scan: bool = False

    def col(self, v: A.Var) -> Column:
        return F.col(name(v))

    def wide(self, v: A.Var) -> Column:
        b = self.binds[v]
        return self.col(v) if b.family is None else V.struct(self.col(v), b.family)

    def widen(self, v: A.Var) -> Rel:
        if self.binds[v].family is None:
            return self
        return Rel(self.df.withColumn(name(v), self.wide(v)), self.binds | {v: Bind(None)}, self.key)

    def where(self, test: Column) -> Rel:
        return Rel(self.df.where(test), self.binds, self.key)


def name(v: A.Var) -> str:
    return f"v_{v.column}"


@dataclass(frozen=True)
class Operand:
    column: Column
    family: int | None
    nullable: bool

    @property
    def wide(self) -> Column:
        return self.column if self.family is None else V.struct(self.column, self.family)

    @property
    def number(self) -> Column:
        if self.family is None:
            return V.part(self.column, V.NUMBER)
        return self.column.cast("double") if self.family == V.NUMBER else F.lit(None).cast("double")


def constant(x: Any) -> Operand:
    family = V.family_of(x)
    if family == V.NULL:
        return Operand(V.literal(None), None, False)
    return Operand(F.lit(float(x) if family == V.NUMBER else x), family, False)


def equal(a: Operand, b: Operand) -> Column:
    if a.family is not None and b.family is not None:
        if a.family == b.family:
            return a.column.eqNullSafe(b.column) if a.nullable or b.nullable else a.column == b.column
        if not (a.nullable and b.nullable):
            return F.lit(False)
        return a.column.isNull() & b.column.isNull()
    return a.wide == b.wide


def compare(op: str, a: Operand, b: Operand) -> Column:
    if op == "=":
        return equal(a, b)
    if op == "!=":
        return ~equal(a, b)
    x, y = a.number, b.number
    test = {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op]
    return F.coalesce(test, F.lit(False))


class Compiler:
    def __init__(self, base: FactBase, q: A.Query, basis: Basis):
        if q.all_time and basis.valid_at is not None:
            raise ValidationError("all_time_valid_at", "basis", "all-time queries take no valid_at")
        self.base, self.q, self.basis = base, q, basis

    # Patterns.

    def pattern(self, p: A.Pattern) -> Rel:
        scan = self.base.scan(None if isinstance(p.attribute, A.Var) else p.attribute, self.basis)
        df, keep = scan.df, []
        value = Operand(F.col("v"), scan.family, False)
        if self.base.sealing is not None and p.attribute in self.base.sealing.attributes and isinstance(p.value, A.Var):
            value = Operand(F.col("blind"), V.TEXT, False)  # sealed values meet by their tokens; an erased one meets none
        for t, column in ((p.entity, "entity"), (p.tx, "tx_id")):
            if isinstance(t, str):
                keep.append(F.col(column) == t)
        if isinstance(p.value, A.Typed):
            keep.append(self.typed(p.value, scan.family))
        elif not isinstance(p.value, A.Var):
            keep.append(equal(value, constant(p.value)))
        bound = lambda column: Operand(F.col(column).cast("double"), V.NUMBER, True)
        for has, t, column in ((p.has_start, p.start, "valid_from"), (p.has_end, p.end, "valid_to")):
            if has and not isinstance(t, A.Var):
                keep.append(F.col(column).isNull() if t is None else F.col(column) == int(t))
        places: list[tuple[A.Var, Operand]] = []
        for t, operand in ((p.entity, Operand(F.col("entity"), V.TEXT, False)), (p.attribute, Operand(F.col("attribute"), V.TEXT, False)), (p.value, value), (p.tx, Operand(F.col("tx_id"), V.TEXT, False)), (p.start, bound("valid_from")), (p.end, bound("valid_to"))):
            if isinstance(t, A.Var):
                places.append((t, operand))
        return self.project(df, keep, places)

    @staticmethod
    def project(df: DataFrame, keep: list[Column], places: list[tuple[A.Var, Operand]]) -> Rel:
        first: dict[A.Var, Operand] = {}
        for v, o in places:
            if v in first:
                keep.append(equal(first[v], o))
            else:
                first[v] = o
        for k in keep:
            df = df.where(k)
        binds = {v: Bind(o.family, o.nullable) for v, o in first.items()}
        return Rel(df.select(*[o.column.alias(name(v)) for v, o in first.items()]), binds)

    @staticmethod
    def typed(t: A.Typed, family: int | None) -> Column:
        if t.type == "blind":
            return (F.col("vtype") == "sealed") & (F.col("blind") == t.value)
        if t.type not in V.FAMILY or t.type == "sealed":
            raise ValidationError("invalid_type", "where", f"no constants of type {t.type}")
        of = V.FAMILY[t.type]
        x = V.canonical_json(t.value) if t.type == "json" else float(t.value) if of == V.NUMBER else t.value
        if family is None:
            return (F.col("vtype") == t.type) & (V.part(F.col("v"), of) == x)
        return (F.col("vtype") == t.type) & (F.col("v") == x) if family == of else F.lit(False)

    def fused(self, table: LiftedTable, group: list[A.Pattern]) -> Rel:
        """Patterns over one subject and one lifted table: a single scan of the columns they name."""
        df = table.base(self.basis)
        subject = group[0].entity
        keep, places = [], []
        entity = Operand(table.entity, V.TEXT, False)
        if isinstance(subject, A.Var):
            places.append((subject, entity))
        else:
            keep.append(table.entity == subject)
        for p in group:
            lift = table.columns[p.attribute]
            value = Operand(table.native(p.attribute), lift.family, False)
            keep.append(lift.column.isNotNull())
            if isinstance(p.value, A.Var):
                places.append((p.value, value))
            elif isinstance(p.value, A.Typed):
                x = A.Typed(p.value.type, p.value.value)
                keep.append(value.column == (float(x.value) if lift.family == V.NUMBER else x.value) if x.type == lift.kind else F.lit(False))
            else:
                keep.append(equal(value, constant(p.value)))
        rel = self.project(df, keep, places)
        # The table is unique by its entity; with a constant subject there is one row.
        return Rel(rel.df, rel.binds, frozenset({subject} if isinstance(subject, A.Var) else ()), True)

    def relations(self, patterns: list[A.Pattern]) -> list[Rel]:
        groups: dict[Any, list[A.Pattern]] = {}
        for i, p in enumerate(patterns):
            table = self.base.star(p.attribute) if isinstance(p.attribute, str) else None
            plain = table is not None and p.tx is None and not p.has_start and not p.has_end
            groups.setdefault((id(table), p.entity) if plain else i, []).append(p)
        return [self.fused(self.base.star(g[0].attribute), g) if isinstance(k, tuple) else self.pattern(g[0]) for k, g in groups.items()]

    # Joins.

    @staticmethod
    def join(a: Rel, b: Rel) -> Rel:
        shared = [v for v in b.binds if v in a.binds]
        for v in shared:
            if a.binds[v].family != b.binds[v].family:
                a, b = a.widen(v), b.widen(v)
        binds = a.binds | {v: x for v, x in b.binds.items() if v not in a.binds}
        key = joined_key(a.key, b.key, frozenset(shared))
        loose = [v for v in shared if a.binds[v].nullable or b.binds[v].nullable]
        if not shared:
            return Rel(a.df.crossJoin(b.df), binds, key)
        if not loose:
            many = a.scan and b.scan and not a.key <= set(shared) and not b.key <= set(shared)
            return Rel((dealt if many else DataFrame.join)(a.df, b.df, [name(v) for v in shared]), binds, key)
        right = b.df.select(*[F.col(name(v)).alias(f"_r_{v.column}" if v in shared else name(v)) for v in b.binds])
        on = reduce(lambda x, y: x & y, [F.col(name(v)).eqNullSafe(F.col(f"_r_{v.column}")) for v in shared])
        return Rel(a.df.join(right, on).drop(*[f"_r_{v.column}" for v in shared]), binds, key)

    def conjunction(self, rels: list[Rel]) -> Rel:
        """Along shared variables, so a product remains only where nothing is shared."""
        rest = list(rels)
        out = rest.pop(0)
        while rest:
            k = next((i for i, r in enumerate(rest) if set(r.binds) & set(out.binds)), 0)
            out = self.join(out, rest.pop(k))
        return out

    # Conditions.

    @staticmethod
    def operand(t: Any, rel: Rel, prefix: str = "v_") -> Operand:
        if isinstance(t, A.Var):
            b = rel.binds[t]
            return Operand(F.col(f"{prefix}{t.column}"), b.family, b.nullable)
        return constant(t)

    def test(self, p: A.Predicate, rel: Rel) -> Column:
        return compare(p.op, self.operand(p.left, rel), self.operand(p.right, rel))

    def inner(self, n: A.Not | A.Pattern, outer: Rel) -> tuple[Rel | None, list[A.Predicate]]:
        """What a negation or a pattern alternative joins, with its own predicates applied; and those that need the outer row."""
        clauses = [n] if isinstance(n, A.Pattern) else list(n.clauses)
        patterns = [c for c in clauses if isinstance(c, A.Pattern)]
        late = [c for c in clauses if isinstance(c, A.Predicate)]
        if not patterns:
            return None, late
        rel = self.conjunction(self.relations(patterns))
        own = [p for p in late if p.variables() <= set(rel.binds)]
        for p in own:
            rel = rel.where(self.test(p, rel))
        return rel, [p for p in late if p not in own]

    def correlated(self, outer: Rel, rel: Rel, late: list[A.Predicate]) -> tuple[DataFrame, Column]:
        """The inner side with renamed columns, and the condition that ties it to an outer row."""
        need = set().union(*(p.variables() for p in late)) if late else set()
        shared = [v for v in rel.binds if v in outer.binds]
        keep = [v for v in rel.binds if v in shared or v in need]
        inner = rel.df.select(*[F.col(name(v)).alias(f"_i_{v.column}") for v in keep]) if keep else rel.df.limit(1).select(F.lit(1).alias("_i_"))
        if keep and (rel.key is None or not rel.key <= set(keep)):
            inner = inner.distinct()
        on = [equal(self.operand(v, outer), self.operand(v, rel, "_i_")) for v in shared]
        for p in late:
            side = [self.operand(t, rel, "_i_") if isinstance(t, A.Var) and t not in outer.binds else self.operand(t, outer) for t in (p.left, p.right)]
            on.append(compare(p.op, *side))
        return inner, reduce(lambda x, y: x & y, on) if on else F.lit(True)

    def negate(self, outer: Rel, n: A.Not) -> Rel:
        rel, late = self.inner(n, outer)
        if rel is None:
            return outer.where(~reduce(lambda x, y: x & y, [self.test(p, outer) for p in late]))
        inner, on = self.correlated(outer, rel, late)
        return Rel(outer.df.join(inner, on, "left_anti"), outer.binds, outer.key)

    def either(self, outer: Rel, o: A.Or) -> Rel:
        """One pass: predicates are tested, patterns and negations leave a marker on distinct outer keys; never a union."""
        df, tests = outer.df, []
        for i, alt in enumerate(o.alternatives):
            if isinstance(alt, A.Predicate):
                tests.append(self.test(alt, outer))
                continue
            rel, late = self.inner(alt, outer)
            if rel is None:
                tests.append(~reduce(lambda x, y: x & y, [self.test(p, outer) for p in late]))
                continue
            mark = f"_mark{i}"
            keys = sorted((alt.variables() & set(outer.binds)), key=lambda v: v.name)
            inner, on = self.correlated(outer, rel, late)
            if keys:
                found = outer.df.select(*[name(v) for v in keys]).distinct().join(inner, on, "left_semi")
                found = found.select(*[F.col(name(v)).alias(f"_k_{v.column}") for v in keys], F.lit(True).alias(mark))
                match = reduce(lambda x, y: x & y, [F.col(name(v)).eqNullSafe(F.col(f"_k_{v.column}")) if outer.binds[v].nullable else F.col(name(v)) == F.col(f"_k_{v.column}") for v in keys])
                df = df.join(found, match, "left").drop(*[f"_k_{v.column}" for v in keys])
            else:
                df = df.join(inner.select(F.lit(True).alias(mark)).limit(1), F.lit(True), "left")
            hit = F.coalesce(F.col(mark), F.lit(False))
            tests.append(~hit if isinstance(alt, A.Not) else hit)
        df = df.where(reduce(lambda x, y: x | y, tests)).drop(*[c for c in df.columns if c.startswith("_mark")])
        return Rel(df, outer.binds, outer.key)

    # The whole.

    def bindings(self) -> Rel:
        from factloom.plans.rules import call

        rels = self.relations(self.q.of(A.Pattern))
        bound = self.conjunction(rels) if rels else None
        # A call whose argument the patterns bind derives only what starts (or ends) there.
        calls = [call(self, c, bound) for c in self.q.of(A.RuleCall)]
        rels = ([bound] if bound else []) + calls
        rel = self.conjunction(rels) if rels else Rel(self.base.spark.range(1).select(F.lit(1).alias("_one")), key=frozenset())
        for p in self.q.of(A.Predicate):
            rel = rel.where(self.test(p, rel))
        for n in self.q.of(A.Not):
            rel = self.negate(rel, n)
        for o in self.q.of(A.Or):
            rel = self.either(rel, o)
        return rel

    def optional(self, rel: Rel) -> Rel:
        """Left lookups of one value each: the least by stored type, value, transaction and id.

        The unique table that alone has an attribute has one value at most, read as it is; elsewhere only the values of
        the asked entities are aggregated.
        """
        row, fields = self.q.optional
        key = rel.col(row) if rel.binds[row].family == V.TEXT else V.part(rel.wide(row), V.TEXT)
        asked = rel.df.select(key.alias("entity")).distinct()
        for attribute, v in fields:
            table = self.base.star(attribute)
            if table is not None:
                family = table.columns[attribute].family
                one = table.base(self.basis).where(table.columns[attribute].column.isNotNull()).select(table.entity.alias("_e"), table.native(attribute).alias(name(v)))
            else:
                scan = self.base.scan(attribute, self.basis)
                family = scan.family
                tag = reduce(lambda c, kv: c.when(F.col("vtype") == kv[0], kv[1]), list(V.TAG_ORDER.items())[1:], F.when(F.col("vtype") == "boolean", 1))
                one = scan.df.join(asked, "entity", "left_semi").groupBy(F.col("entity").alias("_e")).agg(F.min_by("v", F.struct(tag, "v", "tx_id", "id")).alias(name(v)))
            df = rel.df.join(one, key == F.col("_e"), "left").drop("_e")
            if family is None:
                df = df.withColumn(name(v), F.coalesce(F.col(name(v)), V.literal(None)))
            rel = Rel(df, rel.binds | {v: Bind(family, True)}, rel.key)
        return rel

    def result(self) -> Rel:
        q, rel = self.q, self.bindings()
        if q.optional:
            rel = self.optional(rel)
        targets = {t for _, _, t in q.aggregate}
        groups = [v for v in dict.fromkeys(q.outputs()) if v not in targets]
        consts = [t for t in q.find if not isinstance(t, A.Var)]
        if q.aggregate:
            aggs, binds = [], {v: rel.binds[v] for v in groups}
            for op, source, target in q.aggregate:
                o = self.operand(source, rel)
                if op == "count":
                    # Nulls count once, as one value. Where the source alone tells rows apart, each row has a value of its own.
                    c = F.count("*") if rel.key is not None and rel.key <= {source} else F.count_distinct(o.wide) if o.nullable or o.family is None else F.count_distinct(o.column)
                    binds[target] = Bind(V.NUMBER)
                else:
                    c = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[op](o.number)
                    binds[target] = Bind(V.NUMBER, True)
                aggs.append(c.alias(name(target)))
            df = rel.df.groupBy(*[name(v) for v in groups]).agg(*aggs)
            rel = Rel(df, binds)
            for h in q.having:
                rel = rel.where(self.test(h, rel))
        elif groups:
            df = rel.df.select(*[name(v) for v in groups])
            unique = rel.key is not None and rel.key <= set(groups)
            rel = Rel(df if unique else df.distinct(), {v: rel.binds[v] for v in groups})
        else:
            rel = Rel(rel.df.limit(1).select(F.lit(1).alias("_one")), {})
        for c in consts:
            o = constant(c)
            rel = Rel(rel.df.withColumn(f"v_{c}", o.column), rel.binds | {A.Var(f"?{c}"): Bind(o.family, o.nullable)})
        order = [A.Var(t.name) if isinstance(t, A.Var) else A.Var(f"?{t}") for t in dict.fromkeys(q.find)]
        rel = Rel(rel.df.select(*[F.col(f"`{name(v)}`") for v in order]), {v: rel.binds[v] for v in order})
        if q.order or q.limit is not None or q.offset:
            df = rel.df.orderBy(*total_order(rel, q.order, q.limit is not None or q.offset > 0))
            df = df.offset(q.offset) if q.offset else df
            rel = Rel(df.limit(q.limit) if q.limit is not None else df, rel.binds)
        return rel


def dealt(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """The join of two sides whose keys may both have many rows: its work goes with their product, not with the bytes read.

    A key's pairs are cut into cells of some CELL rows of each side, and each row is sent to all cells of its stripe, so a
    pair meets in exactly one cell. Cells are dealt over all shuffle partitions, which are not coalesced by their bytes.
    """
    count = lambda df, c: df.groupBy(*on).agg(F.count("*").alias(c))
    stripes = [F.ceil(F.col(c) / n).cast("int").alias(c) for c, n in zip(("_i", "_j"), CELL, strict=True)]
    cells = count(a, "_i").join(count(b, "_j"), on).select(*on, *stripes).where("_i > 1 OR _j > 1")
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def deal(df: DataFrame, own: str, other: str) -> DataFrame:
        n = {c: F.coalesce(F.col(c), F.lit(1)) for c in (own, other)}
        place, all_ = F.pmod(F.xxhash64(*df.columns), n[own]).cast("int").alias(own), F.explode(F.sequence(F.lit(0), n[other] - 1)).alias(other)
        return df.join(cells, on, "left").select(*df.columns, place, all_).repartition(parts, *on, "_i", "_j")

    return deal(a, "_i", "_j").join(deal(b, "_j", "_i"), [*on, "_i", "_j"]).drop("_i", "_j")


def joined_key(a: frozenset | None, b: frozenset | None, shared: frozenset) -> frozenset | None:
    """The key of a join: one side's alone if the other's is among the shared variables, as then each row meets one at most."""
    if b is not None and b <= shared and a is not None:
        return a
    if a is not None and a <= shared and b is not None:
        return b
    return None if a is None or b is None else a | b


def total_order(rel: Rel, order: tuple, complete: bool = True) -> list[Column]:
    """The asked order, completed with all other columns where rows are cut."""
    asked = {o.variable for o in order}
    keys = [(o.variable, o.descending) for o in order] + [(v, False) for v in rel.binds if complete and v not in asked]
    return [c for v, down in keys for c in V.order_columns(F.col(f"`{name(v)}`"), down, rel.binds[v].family)]


def compiled(base: FactBase, q: dict | A.Query, basis: Basis) -> Rel:
    q = A.parse(q)
    if base.known is not None:
        check_attributes(q, base.known)
    if base.sealing is not None:
        q = base.sealing.rewrite(q)
    return Compiler(base, q, basis).result()


def decoded(rel: Rel, decode: dict[str, str] | None = None) -> DataFrame:
    out = []
    for v, b in rel.binds.items():
        c, want = F.col(f"`{name(v)}`"), (decode or {}).get(v.column)
        if want is not None and b.family is None:
            family = {"double": V.NUMBER, "long": V.NUMBER, "bigint": V.NUMBER, "int": V.NUMBER, "boolean": V.BOOLEAN, "string": V.TEXT}[want]
            c = V.part(c, family)
        out.append((c.cast(want) if want else c).alias(v.column))
    return rel.df.select(*out)


def run(base: FactBase, q: dict, basis: Basis, decode: dict[str, str] | None = None) -> DataFrame:
    return decoded(compiled(base, q, basis), decode)
