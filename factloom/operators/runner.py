"""Delivery of derivation changes, at least once, with retries.

Each registration has a derivation and a function that takes a delivery. A tick evaluates what commits or passing time
may have changed, keeps the candidates as a run, and hands over the difference to the last acknowledged run. A delivery
that fails is kept and tried again after a growing delay, always with the same batch id; after ``max_attempts`` it is
paused, not dropped. The state of a registration is a sequence of files, each created once, so a second owner notices.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from factloom.functions.basis import Basis
from factloom.operators.derive import Derivation, candidates, content_id, reconcile
from factloom.operators.store import Store, _safe
from factloom.plans import ast as A
from factloom.plans.errors import QueryError

RUN = "candidate string, revision string, identity string, result string, sources array<string>, valid_until long, conflict boolean"


class RunnerError(QueryError):
    pass


@dataclass
class Runner:
    """``register`` names and functions, then ``tick`` now and then, or from a stream's foreachBatch."""

    store: Store
    id: str
    max_attempts: int = 8
    first_delay: int = 1_000
    longest_delay: int = 60_000
    max_candidates: int = 10_000

    def __post_init__(self):
        self.registered: dict[str, tuple[Derivation, Callable[[dict, DataFrame], None]]] = {}
        self._state: dict[str, tuple[int, dict]] = {}

    def register(self, key: str, derivation: Derivation, deliver: Callable[[dict, DataFrame], None]) -> None:
        """``deliver`` takes (batch_id, registration, run, previous, position, valid_at, reason, attempt) and the rows (candidate, change)."""
        if key in self.registered:
            raise RunnerError("duplicate_key", key, "the key is taken")
        self.registered[key] = derivation, deliver
        names = [n for n in self.store._names(self._folder(key)) if n.endswith(".json")]
        state = {"run": None, "position": 0, "valid_at": None, "boundary": None, "pending": None}
        if names:
            state = json.loads(self.store.spark.read.text(f"{self.store.path}/{self._folder(key)}/{max(names)}", wholetext=True).first()[0])
        self._state[key] = (len(names), state)

    def _folder(self, key: str) -> str:
        return f"runners/{_safe(self.id)}/{_safe(key)}"

    def _save(self, key: str, **changes) -> dict:
        n, state = self._state[key]
        state = state | changes
        if not self.store._create(self._folder(key), f"{n:012d}.json", state):
            raise RunnerError("already_running", key, f"another owner of {self.id!r} has moved on")
        self._state[key] = (n + 1, state)
        return state

    def _run(self, key: str, run: str | None) -> DataFrame:
        spark = self.store.spark
        return spark.createDataFrame([], RUN) if run is None else spark.read.schema(RUN).parquet(f"{self.store.path}/{self._folder(key)}/runs/{run}")

    def tick(self) -> list[str]:
        """Evaluate and deliver what is due; the keys that were delivered."""
        return [key for key in self.registered if self._one(key)]

    def _one(self, key: str) -> bool:
        derivation, deliver = self.registered[key]
        state, now, head = self._state[key][1], self.store.clock(), self.store.head()
        pending = state["pending"]
        if pending is None:
            needs = sorted(A.dependencies(derivation.query)["attributes"])
            deps = self.store.dependency_state(needs, now)
            first = state["run"] is None
            late = state["boundary"] is not None and now >= state["boundary"] or state["valid_at"] is not None and now < state["valid_at"]
            other = state.get("definition") not in (None, derivation.id)
            if not (first or late or other or deps["position"] > state["position"]):
                return False
            rows = candidates(self.store.base(), derivation, Basis(position=head, valid_at=now))
            run = content_id("run", [derivation.id, head, now, self._state[key][0]])[:32]
            rows.write.mode("overwrite").parquet(f"{self.store.path}/{self._folder(key)}/runs/{run}")
            if self._run(key, run).count() > self.max_candidates:
                raise RunnerError("payload_limit", key, f"more than {self.max_candidates} candidates")
            reason = "initial" if first else "definition" if other else "commit" if deps["position"] > state["position"] else "time"
            pending = {"batch_id": content_id("batch", [key, state["run"], run]), "run": run, "position": head, "valid_at": now, "boundary": deps["boundary"], "reason": reason, "attempt": 0, "retry_at": 0, "paused": False, "error": None, "definition": derivation.id}
        elif pending["paused"] or now < pending["retry_at"]:
            return False
        diff = reconcile(self._run(key, state["run"]), self._run(key, pending["run"])).where("change <> 'unchanged'")
        pending = pending | {"attempt": pending["attempt"] + 1}
        done = {"run": pending["run"], "position": pending["position"], "valid_at": pending["valid_at"], "boundary": pending["boundary"], "definition": pending["definition"], "pending": None}
        if not diff.take(1):
            self._save(key, **done)
            return False
        self._save(key, pending=pending)  # before the hand-over: a crash repeats it under the same batch id
        try:
            deliver({"registration": key, "previous": state["run"], **{k: pending[k] for k in ("batch_id", "run", "position", "valid_at", "reason", "attempt")}}, diff)
        except Exception as e:
            delay = min(self.first_delay * 2 ** (pending["attempt"] - 1), self.longest_delay)
            self._save(key, pending=pending | {"retry_at": now + delay, "paused": pending["attempt"] >= self.max_attempts, "error": str(e)[:500]})
            return False
        self._save(key, **done)
        return True

    def retry_paused(self, key: str) -> None:
        """Let a paused delivery start over."""
        pending = self._state[key][1]["pending"]
        if pending is not None and pending["paused"]:
            self._save(key, pending=pending | {"paused": False, "attempt": 0, "retry_at": 0})

    def status(self) -> dict[str, dict]:
        head = self.store.head()
        return {k: {"delivered": s["position"], "lag": head - s["position"], "run": s["run"], "pending": s["pending"], "next_deadline": s["boundary"]} for k, (_, s) in self._state.items()}
