"""Configuration as trees of content-addressed nodes, kept in releases of a store.

A node's content id covers its own attributes, its references and the ids of its children, so an unchanged subtree is
known by one comparison. Releases are facts of the engine's own namespace; a name points to one of them.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.operators import types as T
from factloom.operators.derive import content_id
from factloom.operators.store import Store
from factloom.plans.errors import ValidationError

_NS = ":_sys/config-"


@dataclass(frozen=True)
class Node:
    """``children``: (relation, node) in order; ``refs``: (relation, kind, key) of other objects."""

    kind: str
    key: str
    attrs: Any = None
    children: tuple = ()
    refs: tuple = ()

    def __post_init__(self):
        slots = [(rel, child.key) for rel, child in self.children]
        if len(set(slots)) < len(slots):
            raise ValidationError("duplicate_child", self.key, "children of one relation need keys of their own")

    @cached_property
    def body(self) -> dict:
        return {"kind": self.kind, "key": self.key, "attrs": self.attrs, "children": [[rel, child.id] for rel, child in self.children], "refs": sorted({tuple(r) for r in self.refs})}

    @cached_property
    def id(self) -> str:
        return content_id("config-node", self.body)

    def walk(self) -> Iterator[Node]:
        yield self
        for _, child in self.children:
            yield from child.walk()


def closure_id(node: Node, needed: Iterable[Node]) -> str:
    """An id that changes with the node or with anything it needs: ``needed`` are all nodes it depends on, directly or not."""
    ids: dict[tuple[str, str], str] = {}
    for n in needed:
        if ids.setdefault((n.kind, n.key), n.id) != n.id:
            raise ValidationError("conflicting_closure", n.key, f"two contents of {n.kind} {n.key}")
    return content_id("config-closure", {"root": node.id, "needs": [[*k, v] for k, v in sorted(ids.items())]})


def diff(before: Node, after: Node, path: str | None = None) -> list[dict]:
    """What changed, as (change, path, kind): added, removed, or changed with what of it did. Equal subtrees aren't entered."""
    if before.id == after.id:
        return []
    path = after.key if path is None else path
    old = {(rel, c.key): (i, c) for i, (rel, c) in enumerate(before.children)}
    new = {(rel, c.key): (i, c) for i, (rel, c) in enumerate(after.children)}
    at = lambda slot: f"{path}/{slot[0]}:{slot[1]}"
    same = V.canonical_json
    out = [{
        "change": "changed", "path": path, "kind": after.kind, "attrs": same(before.attrs) != same(after.attrs), "refs": before.body["refs"] != after.body["refs"],
        "reordered": [s for s in old if s in new] != [s for s in new if s in old],
    }]
    for slot, (_, child) in new.items():
        out += diff(old[slot][1], child, at(slot)) if slot in old else [{"change": "added", "path": at(slot), "kind": child.kind}]
    return out + [{"change": "removed", "path": at(slot), "kind": child.kind} for slot, (_, child) in old.items() if slot not in new]


class ConfigStore:
    """Releases of config objects. A release lists its objects' revisions; a revision is stored once, whatever releases hold it."""

    def __init__(self, store: Store):
        self.store = store

    def commit(self, label: str, objects: list[Node], ref: str | None = None) -> str:
        """Record a release and, with ``ref``, point a name to it, all in one transaction. Returns its id; the same content is the same release."""
        by_key = {(n.kind, n.key): n for n in objects}
        if len(by_key) < len(objects):
            raise ValidationError("duplicate_object", label, "objects need keys of their own")
        release = content_id("config-release", {"label": label, "objects": sorted(n.id for n in objects)})
        there = self._known([f"_sys:config/rev/{n.id}" for n in objects] + [f"_sys:config/release/{release}"])
        ops: list[dict] = []

        def say(entity: str, name: str, value: Any) -> None:
            ops.append({"op": "assert", "entity": entity, "attribute": _NS + name, "value": value, "validFrom": 0})

        for n in objects:
            entity = f"_sys:config/rev/{n.id}"
            if entity in there:
                continue
            say(entity, "kind", n.kind)
            say(entity, "key", n.key)
            say(entity, "body", {"type": "json", "value": n.body})
            for kind, key in sorted(self._needs(n, by_key)):
                say(entity, "needs", {"type": "ref", "value": _object(kind, key)})
        if f"_sys:config/release/{release}" not in there:
            say(f"_sys:config/release/{release}", "label", label)
            for n in objects:
                say(f"_sys:config/release/{release}", "member", {"type": "ref", "value": f"_sys:config/rev/{n.id}"})
        ops += self._point(ref, release) if ref else []
        if ops:
            self.store.transact(ops, actor="config", config_snapshot=release, internal=True)
        return release

    @staticmethod
    def _needs(n: Node, by_key: dict) -> set[tuple[str, str]]:
        """All objects that a node and its children refer to, and what these refer to in the same release."""
        seen: set[tuple[str, str]] = set()
        todo = [n]
        while todo:
            for node in todo.pop().walk():
                for _, kind, key in node.refs:
                    if (kind, key) not in seen:
                        seen.add((kind, key))
                        todo += [by_key[kind, key]] if (kind, key) in by_key else []
        return seen

    def _live(self) -> DataFrame:
        return self.store.facts().where(F.col("attribute").startswith(_NS) & F.col("retracted_position").isNull())

    def _known(self, entities: list[str]) -> set[str]:
        return {r["entity"] for r in self._live().where(F.col("entity").isin(entities)).select("entity").distinct().collect()}

    def _point(self, ref: str, release: str) -> list[dict]:
        name = f"_sys:config/ref/{ref}"
        old = self._live().where((F.col("entity") == name) & (F.col("attribute") == _NS + "target")).select("id").collect()
        return [{"op": "retract", "id": r["id"]} for r in old] + [{"op": "assert", "entity": name, "attribute": _NS + "target", "value": {"type": "ref", "value": f"_sys:config/release/{release}"}, "validFrom": 0}]

    def set_ref(self, ref: str, release: str) -> None:
        if not self._known([f"_sys:config/release/{release}"]):
            raise ValidationError("unknown_release", ref, release)
        self.store.transact(self._point(ref, release), actor="config", config_snapshot=release, internal=True)

    def resolve_ref(self, ref: str) -> str | None:
        r = self._live().where((F.col("entity") == f"_sys:config/ref/{ref}") & (F.col("attribute") == _NS + "target")).select("v.txt").first()
        return r["txt"].rsplit("/", 1)[-1] if r else None

    def revisions(self, release: str) -> DataFrame:
        """(id, kind, key, body) of the objects of a release."""
        live = self._live()
        members = live.where((F.col("entity") == f"_sys:config/release/{release}") & (F.col("attribute") == _NS + "member")).select(F.col("v.txt").alias("entity"))
        return self._described(live, members)

    @staticmethod
    def _described(live: DataFrame, entities: DataFrame) -> DataFrame:
        one = lambda name: F.first(F.when(F.col("attribute") == _NS + name, F.col("v.txt")), ignorenulls=True).alias(name)
        rows = live.join(entities.distinct(), "entity", "left_semi").groupBy("entity").agg(one("kind"), one("key"), one("body"))
        return rows.select(F.element_at(F.split("entity", "/"), -1).alias("id"), "kind", "key", "body")

    def reverse_dependencies(self, kind: str, key: str) -> DataFrame:
        """Revisions that need an object, directly or through others."""
        live = self._live()
        users = live.where((F.col("attribute") == _NS + "needs") & (F.col("v.txt") == _object(kind, key))).select("entity")
        return self._described(live, users)

    def recheck(self, release: str, kind: str, t: T.Type) -> list[str]:
        """Keys of the release's objects of a kind whose attributes another type would reject. A release is small; its bodies come to the driver."""
        rows = self.revisions(release).where(F.col("kind") == kind).select("key", "body").collect()
        return sorted(r["key"] for r in rows if not T.accepts(t, json.loads(r["body"])["attrs"]))


def _object(kind: str, key: str) -> str:
    return f"_sys:config/object/{kind}/{key}"
