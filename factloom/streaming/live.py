"""Live queries: complete results at exact cuts, again after commits that may touch them and when valid time passes an edge.

The journal's manifests are a file stream; each micro-batch re-evaluates the affected queries at its greatest position,
so several commits coalesce. Spark's checkpoint resumes a watch where it ended.
"""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.functions.basis import Basis
from factloom.operators.derive import content_id
from factloom.operators.kleene import attributes, evaluate
from factloom.operators.store import Store
from factloom.plans import ast as A


def affected(dependencies: dict, changes: DataFrame) -> bool:
    """Whether changes (entity, attribute) may touch a query; if in doubt, they do."""
    if dependencies["dynamic"]:
        return bool(changes.take(1))
    fixed = [(a, s) for a, s in dependencies["subjects"].items()]
    hit = F.lit(False)
    for attribute, subjects in fixed:
        one = F.col("attribute") == attribute
        hit = hit | (one if subjects is None else one & F.col("entity").isin(sorted(subjects)))
    if any(a.startswith(":_tx/") for a in dependencies["attributes"]):
        hit = F.lit(True)
    return bool(changes.where(hit).take(1))


@dataclass
class Registry:
    """Queries with their subscribers; equal queries are evaluated once. An index from attributes to queries narrows what a commit is held against."""

    queries: dict[str, dict] = field(default_factory=dict)
    subscribers: dict[str, set[str]] = field(default_factory=dict)
    index: dict[str, set[str]] = field(default_factory=dict)
    dynamic: set[str] = field(default_factory=set)

    def subscribe(self, subscriber: str, query: dict) -> str:
        key = content_id("query", query)
        needs = A.dependencies(A.parse(query))
        self.queries[key] = query
        self.subscribers.setdefault(key, set()).add(subscriber)
        if needs["dynamic"] or any(a.startswith(":_tx/") for a in needs["attributes"]):
            self.dynamic.add(key)
        for a in needs["attributes"]:
            self.index.setdefault(a, set()).add(key)
        return key

    def unsubscribe(self, subscriber: str, key: str) -> None:
        self.subscribers.get(key, set()).discard(subscriber)
        if not self.subscribers.get(key):
            self.subscribers.pop(key, None)
            self.queries.pop(key, None)
            self.dynamic.discard(key)
            for keys in self.index.values():
                keys.discard(key)

    def split(self, changes: DataFrame) -> tuple[list[str], list[str]]:
        """(affected, untouched) query keys. One pass over the changes finds the touched attributes that any query names."""
        named = sorted(a for a, keys in self.index.items() if keys)
        touched = {r["attribute"] for r in changes.where(F.col("attribute").isin(named)).select("attribute").distinct().collect()} if named else set()
        near = set(self.dynamic).union(*(self.index[a] for a in touched))
        hit = [k for k, q in self.queries.items() if k in near and affected(A.dependencies(q), changes)]
        return hit, [k for k in self.queries if k not in hit]


def watch(store: Store, query: dict, on_result: Callable[[DataFrame, dict], None], checkpoint: str, available_now: bool = False, interval: str = "1 second", max_rows: int | None = None) -> StreamingQuery:
    """Call ``on_result(rows, {position, valid_at, reason, boundary})`` at first, and after commits that may change the rows.

    ``reason``: initial, commit, coalesced (several commits at once). ``boundary``: when the rows change without a commit.
    """
    needs = A.dependencies(query)
    state: dict[str, Any] = {"position": None}

    def batch(df: DataFrame, epoch: int) -> None:
        positions = df.select(F.from_json("value", "position long")["position"].alias("p")).agg(F.max("p").alias("last"), F.count("*").alias("n")).first()
        if positions["last"] is None:
            return
        last, now = positions["last"], store.clock()
        before = state["position"]
        if before is not None and not affected(needs, store.changes().where((F.col("position") > before) & (F.col("position") <= last))):
            state["position"] = last
            return
        reason = "initial" if before is None else "coalesced" if positions["n"] > 1 else "commit"
        basis = Basis(position=last) if query.get("validTime") == "all" else Basis(position=last, valid_at=now)
        rows = store.base().query(query, basis)
        if max_rows is not None and rows.limit(max_rows + 1).count() > max_rows:
            raise ValueError(f"more than {max_rows} rows")
        attributes = None if needs["dynamic"] else sorted(needs["attributes"])
        on_result(rows, {"position": last, "valid_at": basis.valid_at, "reason": reason, "boundary": store.dependency_state(attributes, now)["boundary"]})
        state["position"] = last

    stream = store.spark.readStream.format("text").option("wholetext", True).load(f"{store.path}/manifest")
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def due(store: Store, query: dict, last: dict) -> bool:
    """Whether valid time has passed the boundary of the last result, or run backwards."""
    now = store.clock()
    return last["boundary"] is not None and now >= last["boundary"] or last["valid_at"] is not None and now < last["valid_at"]


@dataclass
class Watch:
    """A query's complete results at exact cuts, after commits and when valid time passes an edge or runs backwards.

    ``poll`` evaluates if there is a reason to; ``start`` polls at each beat of a stream. ``token`` resumes a watch where it
    ended. ``slots`` (a semaphore shared by watches) bounds how many evaluate at once; ``idle`` is called on beats without
    a result.
    """

    store: Store
    query: dict
    on_result: Callable[[DataFrame, dict], None]
    token: dict | None = None
    max_rows: int | None = None
    slots: threading.Semaphore | None = None
    idle: Callable[[], None] | None = None

    def __post_init__(self):
        self.needs = A.dependencies(A.parse(self.query))
        self.resumed = self.token is not None

    def reason(self, head: int, now: int) -> str | None:
        """initial, resume, commit, coalesced, time, or None if nothing can have changed."""
        last = self.token
        if last is None:
            return "initial"
        if self.resumed:
            return "resume"
        if head > last["position"]:
            changes = self.store.changes().where((F.col("position") > last["position"]) & (F.col("position") <= head))
            if affected(self.needs, changes):
                return "commit" if head == last["position"] + 1 else "coalesced"
        late = last["boundary"] is not None and now >= last["boundary"]
        back = last["valid_at"] is not None and now < last["valid_at"]
        return "time" if late or back else None

    def poll(self) -> str | None:
        head, now = self.store.head(), self.store.clock()
        why = self.reason(head, now)
        if why is None:
            self.token = self.token | {"position": max(head, self.token["position"])}
            if self.idle:
                self.idle()
            return None
        basis = Basis(position=head) if self.query.get("validTime") == "all" else Basis(position=head, valid_at=now)
        with self.slots or contextlib.nullcontext():
            rows = self.store.base().query(self.query, basis)
            if self.max_rows is not None and rows.limit(self.max_rows + 1).count() > self.max_rows:
                raise ValueError(f"more than {self.max_rows} rows")
            attributes = None if self.needs["dynamic"] else sorted(self.needs["attributes"])
            boundary = None if basis.valid_at is None else self.store.dependency_state(attributes, now)["boundary"]
            info = {"position": head, "valid_at": basis.valid_at, "boundary": boundary}
            self.on_result(rows, info | {"reason": why})
        self.token, self.resumed = info, False
        return why

    def start(self, checkpoint: str, interval: str = "1 second") -> StreamingQuery:
        """Poll at each beat, so edges of valid time wake the watch without a commit."""
        beats = self.store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return beats.writeStream.foreachBatch(lambda df, epoch: self.poll() and None).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


@dataclass
class Reactor:
    """Rules of three values that answer again only for what a commit touched: an index from attributes to the rules that read them."""

    rules: dict[str, tuple]

    def __post_init__(self):
        self.index: dict[str, set[str]] = {}
        for n in self.rules:
            for a in attributes(("rule", n), self.rules):
                self.index.setdefault(a, set()).add(n)

    def react(self, changes: DataFrame, before: DataFrame, after: DataFrame, now: int) -> DataFrame:
        """(entity, rule, before, after): answers that changes (entity, attribute) flipped, between the visible facts before and after."""
        mine = changes.where(F.col("attribute").isin(sorted(self.index)))
        hit = sorted(set().union(*(self.index[r["attribute"]] for r in mine.select("attribute").distinct().collect())))
        if not hit:
            return changes.sparkSession.createDataFrame([], "entity string, rule string, before boolean, after boolean")
        subjects = mine.select("entity").distinct()
        answer = lambda facts: evaluate(facts.join(subjects, "entity", "left_semi"), subjects, self.rules, now).select("entity", *hit)
        return flips(answer(before), answer(after))


def flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """(entity, rule, before, after): answers (entity, Boolean columns) that changed between two evaluations."""
    names = [c for c in before.columns if c != "entity"]
    rows = lambda df, c: df.select("entity", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias(c)) for n in names])).alias("r")).select("entity", "r.rule", f"r.{c}")
    both = rows(before, "before").join(rows(after, "after"), ["entity", "rule"], "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))
