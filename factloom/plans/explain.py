"""How a query is planned, and what it took."""

from __future__ import annotations

import time

from factloom.functions.basis import Basis
from factloom.plans import ast as A
from factloom.plans.compile import compiled, decoded
from factloom.plans.page import wrapped


def _text(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def clauses(q: A.Query) -> dict[str, int]:
    """How many clauses of each kind a query has."""
    kinds = {"patterns": A.Pattern, "predicates": A.Predicate, "negations": A.Not, "disjunctions": A.Or, "rule_calls": A.RuleCall}
    return {k: len(q.of(t)) for k, t in kinds.items()} | {"rules": len(q.rules), "aggregates": len(q.aggregate)}


def explain(base, q: dict | A.Query, basis: Basis | None = None) -> dict:
    """{steps: [(label, plan)], clauses}: the physical plan as Spark would run it, without running it (recursion apart)."""
    q = A.parse(q)
    return {"steps": [("main", _text(decoded(compiled(base, q, basis or Basis()))))], "clauses": clauses(q)}


def explain_page(base, w: dict, basis: Basis | None = None) -> dict:
    """The same for a wrapped query: its rows and, if it asks for the total, its count."""
    q = A.parse_wrapped(w)
    rel, order = wrapped(base, q, basis or Basis())
    steps = [("main", _text(decoded(rel).limit(q.limit + 1)))]
    if q.count:
        steps.append(("count", _text(rel.df.groupBy().count())))
    return {"steps": steps, "clauses": clauses(q.inner), "order": [o.variable.name for o in order]}


def debug(base, q: dict | A.Query, basis: Basis | None = None) -> dict:
    """{rows, plan_ms, run_ms, clauses} of running a query once, its rows dropped."""
    q = A.parse(q)
    began = time.perf_counter()
    df = decoded(compiled(base, q, basis or Basis()))
    df._jdf.queryExecution().executedPlan()
    planned = time.perf_counter()
    n = df.count()
    return {"rows": n, "plan_ms": (planned - began) * 1000, "run_ms": (time.perf_counter() - planned) * 1000, "clauses": clauses(q)}
