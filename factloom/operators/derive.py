"""Derivations: facts that a query concludes, with the facts they rest on; reconciliation, materialisation, what-if, why."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.functions.basis import Basis
from factloom.operators.store import Store, dependency_state, typed, value_row
from factloom.plans import ast as A
from factloom.plans.compile import Bind, Compiler, Operand, Rel, constant, equal, name
from factloom.plans.errors import ValidationError
from factloom.sources.facts import FACTS, FactBase, LiftedTable, Overlay, StoredFacts


def content_id(domain: str, body: Any) -> str:
    """SHA-256 over the domain and the canonical text, each with its length."""
    text = V.canonical_json(body)
    return hashlib.sha256(f"{len(domain)}:{domain}:{len(text.encode())}:{text}".encode()).hexdigest()


@dataclass(frozen=True)
class Derivation:
    """``identity``: variables that tell candidates apart; ``result``: what each concludes."""

    name: str
    query: A.Query
    identity: tuple[A.Var, ...]
    result: tuple[A.Var, ...]
    id: str

    @staticmethod
    def make(name_: str, query: dict, identity: list[str], result: list[str] = ()) -> Derivation:
        q = A.parse(query)
        if q.aggregate or q.rules or q.of(A.Or) or q.of(A.RuleCall) or q.limit is not None or q.offset or q.optional or q.all_time:
            raise ValidationError("unsupported_derivation", "query", "derivations take patterns, predicates and negation")
        for p in q.of(A.Pattern):
            if isinstance(p.attribute, A.Var) or p.tx is not None or p.has_start or p.has_end:
                raise ValidationError("unsupported_derivation", "query", "fixed attributes only, without transactions and intervals")
        both = [A.Var(v) for v in (*identity, *result)]
        for v in both:
            if v not in A.positive(q):
                raise ValidationError("unbound_result", "query", v.name)
        body = {"name": name_, "query": query, "identity": list(identity), "result": list(result)}
        return Derivation(name_, q, tuple(both[: len(identity)]), tuple(both[len(identity) :]), content_id("derivation", body))


def candidates(base: FactBase, d: Derivation, basis: Basis | None = None) -> DataFrame:
    """(candidate, revision, identity, result, sources, valid_until, conflict): one pass, fact ids carried through the joins.

    ``sources`` are the distinct ids of the facts of all rows of a candidate; it holds until the first of them ends.
    Candidates whose rows disagree on the result are in conflict.
    """
    c = Compiler(base, d.query, basis or Basis())
    rels = []
    for i, p in enumerate(d.query.of(A.Pattern)):
        rels.append(_with_fact(c, p, base.scan(p.attribute, c.basis), i))
    rel = c.conjunction(rels)
    for p in d.query.of(A.Predicate):
        rel = Rel(rel.df.where(c.test(p, rel)), rel.binds)
    for n in d.query.of(A.Not):
        rel = c.negate(rel, n)
    k = len(rels)
    value = lambda vs: F.to_json(F.array(*[rel.wide(v) for v in vs])) if vs else F.lit("[]")
    rows = rel.df.select(value(d.identity).alias("identity"), value(d.result).alias("result"), F.array(*[F.col(f"_fact{i}") for i in range(k)]).alias("facts"), F.array_min(F.array_compact(F.array(*[F.col(f"_end{i}") for i in range(k)]))).alias("end"))
    out = rows.groupBy("identity").agg(F.min("result").alias("result"), (F.count_distinct("result") > 1).alias("conflict"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("facts")))).alias("sources"), F.min("end").alias("valid_until"))
    candidate = F.sha2(F.concat_ws("|", F.lit(d.id), "identity"), 256)
    return out.select(candidate.alias("candidate"), F.sha2(F.concat_ws("|", candidate, "result", F.array_join("sources", ",")), 256).alias("revision"), "identity", "result", "sources", "valid_until", "conflict")


def _with_fact(c: Compiler, p: A.Pattern, scan, i: int) -> Rel:
    """The pattern's rows with the fact's id and end beside the variables."""
    keep, places = [], []
    value = Operand(F.col("v"), scan.family, False)
    if isinstance(p.entity, A.Var):
        places.append((p.entity, Operand(F.col("entity"), V.TEXT, False)))
    else:
        keep.append(F.col("entity") == p.entity)
    if isinstance(p.value, A.Var):
        places.append((p.value, value))
    else:
        keep.append(c.typed(p.value, scan.family) if isinstance(p.value, A.Typed) else equal(value, constant(p.value)))
    first: dict = {}
    for v, o in places:
        if v in first:
            keep.append(equal(first[v], o))
        else:
            first[v] = o
    df = reduce(lambda x, k: x.where(k), keep, scan.df)
    cols = [o.column.alias(name(v)) for v, o in first.items()]
    return Rel(df.select(*cols, F.col("id").alias(f"_fact{i}"), F.col("valid_to").alias(f"_end{i}")), {v: Bind(o.family, o.nullable) for v, o in first.items()})


def reconcile(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(candidate, change): added, removed, changed or unchanged between two sets of candidates."""
    a, b = previous.select("candidate", F.col("revision").alias("_old")), current.select("candidate", F.col("revision").alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed").otherwise("unchanged")
    return a.join(b, "candidate", "full").select("candidate", change.alias("change"))


@dataclass
class Materialized:
    """Candidates kept as Parquet with the position and moment they were derived at."""

    store: Store
    derivation: Derivation
    path: str

    def run(self, valid_at: int | None = None) -> DataFrame:
        basis = self.store.pin(Basis(valid_at=valid_at))
        rows = candidates(self.store.base(), self.derivation, basis)
        facts = self.store.facts()
        state = dependency_state(facts, sorted(A.dependencies(self.derivation.query)["attributes"]), basis.valid_at)
        rows.select("*", F.lit(basis.position).alias("at_position"), F.lit(basis.valid_at).alias("at_valid"), F.lit(state["boundary"]).cast("long").alias("boundary")).write.mode("overwrite").parquet(f"{self.path}/{self.derivation.id}")
        run = self.store.spark.createDataFrame([(basis.position, basis.valid_at, state["boundary"])], "at_position long, at_valid long, boundary long")
        run.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{self.derivation.id}-run")
        return self.read()

    def read(self) -> DataFrame:
        return self.store.spark.read.parquet(f"{self.path}/{self.derivation.id}").drop("at_position", "at_valid", "boundary")

    def status(self, valid_at: int | None = None) -> str:
        """current, stale, or unmaterialized."""
        try:
            run = self.store.spark.read.parquet(f"{self.path}/{self.derivation.id}-run").first()
        except AnalysisException:
            return "unmaterialized"
        now = self.store.clock() if valid_at is None else valid_at
        state = self.store.dependency_state(sorted(A.dependencies(self.derivation.query)["attributes"]), now)
        late = run["boundary"] is not None and now >= run["boundary"] or now < run["at_valid"]
        return "stale" if state["position"] > run["at_position"] or late else "current"


def what_if(base: FactBase, asserts: list[dict] = (), retracts: list[str] = (), at: int = 0) -> FactBase:
    """The base with hypothetical changes; ids of added facts follow from their content."""
    rows = []
    for op in asserts:
        vtype, v, blob = value_row(typed(op["value"]))
        id = "h:" + content_id("hypothetical", {k: x for k, x in op.items() if k != "op"})
        rows.append((id, op["entity"], op["attribute"], op.get("entityType"), vtype, v, blob, None, None, op.get("validFrom", at), op.get("validTo"), 0, 0, None, None, "tx:hypothetical", None, None))
    added = base.spark.createDataFrame(rows, FACTS)
    removed = base.spark.createDataFrame([(i,) for i in retracts], "id string")
    sources = list(base.sources)
    k = next((i for i, s in enumerate(sources) if isinstance(s, StoredFacts)), None)
    if k is None:
        sources = [Overlay(s, added.limit(0), removed) for s in sources] + [StoredFacts(added)]
    else:
        sources = [Overlay(s, added if i == k else added.limit(0), removed) if i == k or isinstance(s, LiftedTable) else s for i, s in enumerate(sources)]
    return FactBase(base.spark, sources, base.sealing)


CHAIN = "step int, tx_id string, position long, actor string, command_id string, causation_id string, more boolean"


def why(store: Store, id: str, depth: int = 32) -> DataFrame:
    """The transaction of a fact, and the chain of commands that caused it: rows of CHAIN.

    ``more`` is true in the last row if the chain goes on behind ``depth`` steps.
    """
    tx = store.transactions()
    now = tx.join(store.assertion(id).select("tx_id"), "tx_id")
    steps: list[tuple] = []
    while rows := now.select("tx_id", "position", "actor", "command_id", "causation_id").limit(1).collect():
        if len(steps) == depth:
            steps[-1] = (*steps[-1][:-1], True)
            break
        r = rows[0]
        steps.append((len(steps), *r, False))
        if r["causation_id"] is None or r["causation_id"] in {s[4] for s in steps}:
            break
        now = tx.where(F.col("command_id") == r["causation_id"])
    return store.spark.createDataFrame(steps, CHAIN)


def why_attribute(store: Store, entity: str, attribute: str, basis: Basis | None = None) -> DataFrame:
    """The visible facts of an entity's attribute with the transactions that asserted them."""
    return why_entity(store, entity, basis).where(F.col("attribute") == attribute)


def why_entity(store: Store, entity: str, basis: Basis | None = None) -> DataFrame:
    """The visible facts of an entity with the transactions that asserted them: (id, attribute, vtype, v, tx_id, position, actor, command_id, causation_id)."""
    facts = store.entity(entity, basis).select("id", "attribute", "vtype", "v", "tx_id")
    return facts.join(store.transactions().select("tx_id", "position", "actor", "command_id", "causation_id"), "tx_id").select("id", "attribute", "vtype", "v", "tx_id", "position", "actor", "command_id", "causation_id")


def preview(store: Store, ops: list[dict], derivations: list[Derivation] = (), valid_at: int | None = None) -> dict:
    """What a commit would do, without it: ``changes``, ``violations`` (None without constraints) and, by the name of each
    derivation, ``derivations`` (candidate, change) where a candidate would come, go or change."""
    changes, broken = store.transact(ops, dry_run=True)
    gone = [r["triple_id"] for r in changes.where("op = 'retract'").select("triple_id").collect()]  # of one command
    position = store.head() + 1
    kept = [op for k, op in enumerate(ops) if op["op"] == "assert" and f"f:{position:012d}:{k:06d}" not in gone]
    basis = store.pin(Basis(valid_at=valid_at))
    base = store.base()
    then = what_if(base, kept, gone, at=store.clock())
    out = {d.name: reconcile(candidates(base, d, basis), candidates(then, d, basis)).where("change <> 'unchanged'") for d in derivations}
    return {"changes": changes, "violations": broken, "derivations": out}


def why_candidate(candidates_: DataFrame, facts: DataFrame, candidate: str) -> DataFrame:
    """The facts a candidate rests on."""
    ids = candidates_.where(F.col("candidate") == candidate).select(F.explode("sources").alias("id"))
    return facts.join(ids, "id")
