"""Declared types: subsumption, checks as Columns, normalisation, and entities decoded and validated against them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import values as V


@dataclass(frozen=True)
class Type:
    pass


@dataclass(frozen=True)
class AnyType(Type):
    pass


@dataclass(frozen=True)
class Prim(Type):
    """text, number, integer, boolean, date (ISO text) or instant (epoch milliseconds)."""

    name: str


@dataclass(frozen=True)
class Enum(Type):
    values: frozenset


@dataclass(frozen=True)
class Ref(Type):
    target: str | None = None


@dataclass(frozen=True)
class ListOf(Type):
    item: Type


@dataclass(frozen=True)
class Record(Type):
    """Fields as (name, type, required), or with a fallback for those that are absent as (name, type, required, fallback)."""

    fields: tuple


@dataclass(frozen=True)
class Union(Type):
    members: tuple


@dataclass(frozen=True)
class Bounded(Type):
    """A type with limits: pattern, min_length, max_length, min, max."""

    base: Type
    pattern: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    min: float | None = None
    max: float | None = None


#: Scalars that can stand where another is expected: every integer is a number.
_WIDER = {("integer", "number")}


def subsumes(wide: Type, narrow: Type) -> bool:
    """True if every value of ``narrow`` is one of ``wide``. Conservative on patterns: only equal ones imply each other."""
    if isinstance(wide, AnyType) or wide == narrow:
        return True
    if isinstance(narrow, Union):
        return all(subsumes(wide, m) for m in narrow.members)
    if isinstance(wide, Union):
        return any(subsumes(m, narrow) for m in wide.members)
    if isinstance(wide, Bounded):
        if not isinstance(narrow, Bounded):
            return isinstance(narrow, Enum) and subsumes(wide.base, narrow) and all(accepts(wide, v) for v in narrow.values)
        low = lambda w, n: w is None or n is not None and n >= w
        high = lambda w, n: w is None or n is not None and n <= w
        return subsumes(wide.base, narrow.base) and wide.pattern in (None, narrow.pattern) and low(wide.min, narrow.min) and low(wide.min_length, narrow.min_length) and high(wide.max, narrow.max) and high(wide.max_length, narrow.max_length)
    if isinstance(narrow, Bounded):
        return subsumes(wide, narrow.base)
    if isinstance(wide, Prim):
        return isinstance(narrow, Prim) and (narrow.name, wide.name) in _WIDER or isinstance(narrow, Enum) and wide.name == "text" and all(isinstance(v, str) for v in narrow.values)
    if isinstance(wide, Enum):
        return isinstance(narrow, Enum) and narrow.values <= wide.values
    if isinstance(wide, Ref):
        return isinstance(narrow, Ref) and wide.target in (None, narrow.target)
    if isinstance(wide, ListOf):
        return isinstance(narrow, ListOf) and subsumes(wide.item, narrow.item)
    if isinstance(wide, Record) and isinstance(narrow, Record):
        have = {n: (t, r) for n, t, r, *_ in narrow.fields}
        return all(subsumes(t, have[n][0]) and (have[n][1] or not r) if n in have else not r for n, t, r, *_ in wide.fields)
    return False


def relation(old: Type, new: Type) -> str:
    """equal, widens, narrows or incompatible, from an old type to a new one."""
    a, b = subsumes(new, old), subsumes(old, new)
    return "equal" if a and b else "widens" if a else "narrows" if b else "incompatible"


def accepts(t: Type, x: Any) -> bool:
    """A Python value against a type."""
    import re
    from datetime import date

    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    if isinstance(t, AnyType):
        return True
    if isinstance(t, Prim):
        if t.name == "date":
            try:
                return isinstance(x, str) and date.fromisoformat(x).isoformat() == x
            except ValueError:
                return False
        return {"text": isinstance(x, str), "number": number, "integer": number and float(x).is_integer(), "instant": number and float(x).is_integer(), "boolean": isinstance(x, bool)}[t.name]
    if isinstance(t, Enum):
        return x in t.values
    if isinstance(t, Ref):
        return isinstance(x, str)
    if isinstance(t, ListOf):
        return isinstance(x, list) and all(accepts(t.item, y) for y in x)
    if isinstance(t, Record):
        return isinstance(x, dict) and all(accepts(ft, x[n]) if n in x else not r for n, ft, r, *_ in t.fields) and set(x) <= {n for n, *_ in t.fields}
    if isinstance(t, Union):
        return any(accepts(m, x) for m in t.members)
    size = len(x) if isinstance(x, (str, list)) else None
    return accepts(t.base, x) and (t.pattern is None or re.search(t.pattern, x) is not None) and (t.min_length is None or size >= t.min_length) and (t.max_length is None or size <= t.max_length) and (t.min is None or x >= t.min) and (t.max is None or x <= t.max)


def normalize(t: Type, x: Any) -> Any:
    """The value as its type sees it: undeclared fields gone, fallbacks filled in, unions by the first member that fits, whole
    numbers of integers as such. Equal in meaning is then equal in content. Raises ValueError on what the type rejects."""
    if isinstance(t, Record) and isinstance(x, dict):
        out = {}
        for n, ft, required, *fallback in t.fields:
            if n in x:
                out[n] = normalize(ft, x[n])
            elif fallback:
                out[n] = normalize(ft, fallback[0])
            elif required:
                raise ValueError(f"field {n!r} is missing")
        return out
    if isinstance(t, ListOf) and isinstance(x, list):
        return [normalize(t.item, y) for y in x]
    if isinstance(t, Union):
        for m in t.members:
            try:
                return normalize(m, x)
            except ValueError:
                continue
        raise ValueError(f"{x!r} is of no member")
    inner = normalize(t.base, x) if isinstance(t, Bounded) else x
    if not accepts(t, inner):
        raise ValueError(f"{x!r} is not of the type")
    return int(inner) if isinstance(t, Prim) and t.name in ("integer", "instant") else inner


def check(t: Type, v: Column, vtype: Column) -> Column:
    """True for value structs of a type; lists and records are JSON facts and are only known to be such."""
    num, txt = V.part(v, V.NUMBER), V.part(v, V.TEXT)
    if isinstance(t, AnyType):
        return F.lit(True)
    if isinstance(t, Prim):
        whole = num == F.floor(num)
        c = {"text": txt.isNotNull() & (vtype == "string"), "number": num.isNotNull(), "integer": whole, "instant": whole, "boolean": V.part(v, V.BOOLEAN).isNotNull(), "date": txt.rlike(r"^\d{4}-\d{2}-\d{2}$") & txt.try_cast("date").isNotNull()}[t.name]
    elif isinstance(t, Enum):
        c = v.isin([V.literal(x) for x in sorted(t.values, key=str)]) if t.values else F.lit(False)
    elif isinstance(t, Ref):
        c = vtype == "ref"
    elif isinstance(t, (ListOf, Record)):
        c = vtype == "json"
    elif isinstance(t, Union):
        c = F.lit(False)
        for m in t.members:
            c = c | check(m, v, vtype)
    else:
        c = check(t.base, v, vtype)
        for test in ([txt.rlike(t.pattern)] if t.pattern is not None else []) + ([F.length(txt) >= t.min_length] if t.min_length is not None else []) + ([F.length(txt) <= t.max_length] if t.max_length is not None else []) + ([num >= t.min] if t.min is not None else []) + ([num <= t.max] if t.max is not None else []):
            c = c & test
    return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Attribute:
    name: str
    type: Type
    required: bool = False
    many: bool = False
    sealed: bool = False
    fallback: Any = None


@dataclass(frozen=True)
class EntityType:
    name: str
    attributes: tuple = field(default_factory=tuple)

    def where(self, **values: Any) -> list:
        """Clauses for entities of this type: constants as they are, variables bound."""
        return [["?self", f":{self.name}/{k}", v] for k, v in values.items()]

    def without(self, attribute: str) -> list:
        return ["not", ["?self", f":{self.name}/{attribute}", "?absent"]]


def decode(facts: DataFrame, t: EntityType) -> DataFrame:
    """(entity, a column for each attribute): the struct, a list of structs where many, the fallback where there is none."""
    own = facts.where(F.col("entity_type") == t.name)
    cols = []
    for a in t.attributes:
        mine = F.when(F.col("attribute") == a.name, F.col("v"))
        c = F.sort_array(F.collect_list(mine)) if a.many else F.first(mine, ignorenulls=True)
        cols.append((F.coalesce(c, V.literal(a.fallback)) if a.fallback is not None and not a.many else c).alias(a.name.rsplit("/", 1)[-1]))
    return own.groupBy("entity").agg(*cols)


def validate(facts: DataFrame, t: EntityType) -> DataFrame:
    """(entity, attribute, problem): missing, several, invalid, or unknown attributes of visible facts."""
    own = facts.where(F.col("entity_type") == t.name)
    entities = own.select("entity").distinct()
    spark = facts.sparkSession
    declared = spark.createDataFrame([(a.name, a.required, a.many) for a in t.attributes], "attribute string, required boolean, many boolean")
    counts = own.groupBy("entity", "attribute").agg(F.count("*").alias("n"))
    missing = entities.crossJoin(F.broadcast(declared.where("required"))).join(counts, ["entity", "attribute"], "left_anti").select("entity", "attribute", F.lit("missing").alias("problem"))  # as many rows as the type has attributes
    several = counts.join(F.broadcast(declared), "attribute").where("NOT many AND n > 1").select("entity", "attribute", F.lit("several").alias("problem"))
    ok = F.lit(None).cast("boolean")
    for a in reversed(t.attributes):
        good = (F.col("vtype") == "sealed") if a.sealed else check(a.type, F.col("v"), F.col("vtype"))
        ok = F.when(F.col("attribute") == a.name, good).otherwise(ok)
    judged = own.withColumn("_ok", ok)
    invalid = judged.where("NOT _ok").select("entity", "attribute", F.lit("invalid").alias("problem")).distinct()
    unknown = judged.where("_ok IS NULL").select("entity", "attribute", F.lit("unknown").alias("problem")).distinct()
    return missing.unionByName(several).unionByName(invalid).unionByName(unknown)


class ValidationRuns:
    """Validation of a type's entities at positions of a store, run after run. Each run is a table of its own under ``path``."""

    def __init__(self, store, t: EntityType, path: str):
        self.store, self.type, self.path = store, t, path

    def run(self, basis=None) -> int:
        """Validate what is visible; returns the run's number."""
        from factloom.functions.basis import visible

        at = self.store.pin(basis)
        facts = self.store.facts().where(visible(at))
        n = max(self._runs(), default=0) + 1
        found = validate(facts, self.type)
        seen = facts.where(F.col("entity_type") == self.type.name).select("entity").distinct()
        rows = seen.join(found, "entity", "left").select(F.lit(n).alias("run"), F.lit(at.position).cast("long").alias("position"), "entity", "attribute", "problem")
        rows.write.parquet(f"{self.path}/{n:08d}")
        return n

    def _runs(self) -> list[int]:
        p = self.store.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.store.spark._jsc.hadoopConfiguration())
        return [int(s.getPath().getName()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def rows(self, *runs: int) -> DataFrame:
        kind = "run int, position long, entity string, attribute string, problem string"
        paths = [f"{self.path}/{n:08d}" for n in (runs or sorted(self._runs()))]
        return self.store.spark.read.schema(kind).parquet(*paths) if paths else self.store.spark.createDataFrame([], kind)

    def violations(self, entity: str | None = None) -> DataFrame:
        """Problems of all runs, of one entity or of all."""
        rows = self.rows().where("problem IS NOT NULL")
        return rows if entity is None else rows.where(F.col("entity") == entity)

    def last_invalid(self) -> DataFrame:
        """Entities that the last run found invalid, whether or not they still are."""
        runs = self._runs()
        return (self.rows(max(runs)) if runs else self.rows()).where("problem IS NOT NULL").select("entity").distinct()

    def current_invalid(self) -> DataFrame:
        """The same, if the last run saw the head; else none is known."""
        runs = self._runs()
        rows = self.rows(max(runs)) if runs else self.rows()
        return rows.where((F.col("position") == self.store.head()) & F.col("problem").isNotNull()).select("entity").distinct()

    def ever_invalid(self) -> DataFrame:
        return self.violations().select("entity").distinct()
