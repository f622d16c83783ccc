"""Append-only facts in Parquet segments, with one writer and an ordered journal.

A commit stages its rows under a name of its own, writes the manifest of its position to a temporary file, and publishes
it by a rename that fails if the position is taken. Readers see only whole manifests and the segments these name, so a
broken commit leaves no trace. Nothing is deleted: retractions close recorded time, and rewriting segments publishes a
further generation of the head's manifest beside the old one.

Retractions are stored with the attribute and entity of their fact and joined on these as well, so a filter on either
reaches both sides' scans.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.functions.basis import TX, Basis, recorded, valid, visible
from factloom.functions.lineage import Folder
from factloom.operators.constraints import relevant, violations, worsened
from factloom.plans.errors import CommitError
from factloom.plans.page import Page, page
from factloom.sources.facts import CHANGES, FACTS, TRANSACTIONS, FactBase, JournalFacts, Source, StoredFacts

RESERVED = (TX, ":_schema/", ":_sys/")
_RETRACTED = "id string, entity string, attribute string, retracted_at long, retracted_position long, retract_tx_id string"
#: Rows of a load that a task sorts at once.
LOT = 500_000
_MANIFEST = re.compile(r"(\d{12})(?:\.(\d+))?\.json")
_ENTRIES = "scope string, key string, box string, payload string, position long, acknowledged boolean"


def typed(value: Any, kind: str | None = None) -> dict:
    """A stored value from a Python one: {"type", "value"}."""
    if isinstance(value, dict) and "type" in value:
        return value
    return {"type": kind or ("boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"), "value": value}


def value_row(value: dict) -> tuple[str, tuple, tuple | None]:
    """(stored type, struct, blob details) of a typed value; raises on what can't be stored."""
    kind, x = value["type"], value.get("value")
    if kind not in V.FAMILY:
        raise CommitError("invalid_type", "value", f"no type {kind!r}")
    family = V.FAMILY[kind]
    if kind == "sealed":
        return kind, (V.NULL, None, None, None), None
    if kind == "json":
        x = V.canonical_json(x)
    if family == V.NUMBER:
        x = float(x)
        if x != x or x in (float("inf"), float("-inf")):
            raise CommitError("nonfinite", "value", "numbers are finite")
    if family == V.TEXT and not isinstance(x, str) or family == V.BOOLEAN and not isinstance(x, bool):
        raise CommitError("invalid_value", "value", f"{x!r} is no {kind}")
    blob = (value.get("mime"), value.get("size"), value.get("filename")) if kind == "blob" else None
    return kind, (family, x if family == V.NUMBER else None, x if family == V.BOOLEAN else None, x if family == V.TEXT else None), blob


@dataclass
class Receipt:
    tx_id: str
    position: int
    instant: int
    ids: list[str] = field(default_factory=list)
    retracted: list[str] = field(default_factory=list)


@dataclass
class Store:
    spark: SparkSession
    path: str
    constraints: list = field(default_factory=list)
    validators: list[Callable[[FactBase, FactBase], str | None]] = field(default_factory=list)
    clock: Callable[[], int] = lambda: int(time.time() * 1000)

    # Files.

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, root = self._fs(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []

    def _create(self, folder: str, name: str, content: dict) -> bool:
        """Publish a file whole, or not at all: False if the name is taken."""
        fs, tmp = self._fs(f"{self.path}/{folder}/.{uuid.uuid4().hex}.tmp")
        to = self._fs(f"{self.path}/{folder}/{name}")[1]
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        jvm = self.spark._jvm
        options = jvm.org.apache.hadoop.fs.Options
        none = self.spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 0)
        try:  # a rename without the option to overwrite
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark._jsc.hadoopConfiguration()).rename(tmp, to, none)
        except Exception:
            fs.delete(tmp, False)
            if fs.exists(to):
                return False
            raise
        return True

    def _heads(self) -> dict[int, int]:
        """The latest generation of each position's manifest."""
        out: dict[int, int] = {}
        for n in self._names("manifest"):
            if m := _MANIFEST.fullmatch(n):
                out[int(m[1])] = max(out.get(int(m[1]), 0), int(m[2] or 0))
        return out

    def manifest(self, position: int | None = None) -> dict:
        heads = self._heads()
        position = max(heads, default=0) if position is None else position
        if position == 0:
            return {"position": 0, "instant": None, "segments": []}
        generation = heads.get(position, 0)
        name = f"{position:012d}.{generation}.json" if generation else f"{position:012d}.json"
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{name}", wholetext=True).first()[0]) | {"generation": generation}

    def _publish(self, m: dict) -> None:
        if not self._create("manifest", f"{m['position']:012d}.json", m):
            raise CommitError("stale_head", "", f"position {m['position']} is taken")

    def _regenerate(self, m: dict, segments: list) -> None:
        """Replace the head's segments. Fails if another has done so since ``m`` was read, or the head has moved on."""
        if self.head() != m["position"] or not self._create("manifest", f"{m['position']:012d}.{m.get('generation', 0) + 1}.json", {"position": m["position"], "instant": m["instant"], "segments": segments}):
            raise CommitError("stale_head", "", f"position {m['position']} has been rewritten")

    def _read(self, kind: str, schema, m: dict | None = None) -> DataFrame:
        paths = [f"{self.path}/{s}/{kind}" for s, kinds in (m or self.manifest())["segments"] if kind in kinds]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # Views.

    def facts(self, m: dict | None = None) -> DataFrame:
        m = m or self.manifest()
        gone = ("retracted_at", "retracted_position", "retract_tx_id")
        asserted = self._read("facts", FACTS, m)
        if not any("retracted" in kinds for _, kinds in m["segments"]):
            return asserted
        first = self._read("retracted", _RETRACTED, m).groupBy("id", "entity", "attribute").agg(*[F.min_by(c, "retracted_position").alias(c) for c in gone])
        return asserted.drop(*gone).join(first, ["attribute", "entity", "id"], "left").select(*FACTS.names)

    def transactions(self, m: dict | None = None) -> DataFrame:
        return self._read("transactions", TRANSACTIONS, m)

    def changes(self, m: dict | None = None) -> DataFrame:
        """The journal. A load's facts are its changes, so these are not written a second time."""
        m = m or self.manifest()
        written = self._read("changes", CHANGES, m)
        loads = [x for x in m["segments"] if "facts" in x[1] and "changes" not in x[1]]
        return written.unionByName(_asserted(self._read("facts", FACTS, {"segments": loads}))) if loads else written

    def base(self, *more: Source, sealing=None) -> FactBase:
        m = self.manifest()
        return FactBase(self.spark, [StoredFacts(self.facts(m)), JournalFacts(self.transactions(m), self.changes(m)), *more], sealing)

    def query(self, q: dict, basis: Basis | None = None, decode: dict | None = None) -> DataFrame:
        return self.base().query(q, self.pin(basis, q.get("validTime") == "all"), decode)

    def pin(self, basis: Basis | None = None, all_time: bool = False) -> Basis:
        b = basis or Basis()
        if b.position is None and b.recorded_at is None:
            b = b.at(position=self.head())
        return b if all_time or b.valid_at is not None else b.at(valid_at=self.clock())

    def page(self, q: dict, basis: Basis | None = None) -> Page:
        return page(self.base(), q, basis, self.path, self.head(), self.clock())

    def head(self) -> int:
        return self.manifest()["position"]

    def resolve_position(self, recorded_at: int) -> int:
        return self.transactions().where(F.col("instant") <= recorded_at).agg(F.max("position")).first()[0] or 0

    def get(self, id: str) -> DataFrame:
        return self.facts().where((F.col("id") == id) & F.col("retracted_position").isNull())

    def assertion(self, id: str) -> DataFrame:
        return self.facts().where(F.col("id") == id)

    def live_facts(self, entity: str) -> DataFrame:
        return self.facts().where((F.col("entity") == entity) & F.col("retracted_position").isNull())

    def history(self, entity: str) -> DataFrame:
        return self.facts().where(F.col("entity") == entity)

    def entity(self, entity: str, basis: Basis | None = None) -> DataFrame:
        return self.facts().where((F.col("entity") == entity) & visible(self.pin(basis)))

    def entities(self, ids: list[str], basis: Basis | None = None) -> DataFrame:
        """(place, entity, facts) in the order asked for, gaps included. Only the asked entities' facts are read and grouped."""
        asked = self.spark.createDataFrame(list(enumerate(ids)), "place int, entity string")
        rows = self.facts().where(F.col("entity").isin(ids) & visible(self.pin(basis))).groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("attribute", "id", "vtype", "v", "valid_from", "valid_to"))).alias("facts"))
        return asked.join(rows, "entity", "left").select("place", "entity", F.coalesce("facts", F.array()).alias("facts")).orderBy("place")

    def match(self, entity: str | None = None, attribute: str | None = None, value: Any = None, entity_type: str | None = None, basis: Basis | None = None) -> DataFrame:
        """Facts by any of their parts; a value matches with its stored type."""
        df = self.facts().where(visible(self.pin(basis)))
        for c, x in (("entity", entity), ("attribute", attribute), ("entity_type", entity_type)):
            df = df if x is None else df.where(F.col(c) == x)
        if value is not None:
            kind, parts, _ = value_row(typed(value))
            x = next(p for p in parts[1:] if p is not None)
            df = df.where((F.col("vtype") == kind) & (V.part(F.col("v"), V.FAMILY[kind]) == x))
        return df

    def entity_page(self, entity_type: str, limit: int = 100, after: str | None = None, basis: Basis | None = None) -> DataFrame:
        """Facts of the next ``limit`` (200 at most) entities of a type, by id."""
        b = self.pin(basis)
        rows = self.facts().where(visible(b))
        ids = rows.where(F.col("entity_type") == entity_type).select("entity").distinct()
        ids = ids if after is None else ids.where(F.col("entity") > after)
        return rows.join(ids.orderBy("entity").limit(min(limit, 200)), "entity").orderBy("entity", "attribute", "id")

    def feed(self, after: int = 0, limit: int = 1000, prefix: str | None = None) -> DataFrame:
        """Transactions behind a position, with ``n``, the number of their changes; with a prefix, those that touch such entities.

        A transaction may have any number of changes, so they are no column here: feed_changes() has them as rows.
        """
        counts = self.changes().where(F.col("position") > after).groupBy("position").agg(F.count("*").alias("n"))
        return self._fed(after, limit, prefix).join(counts, "position", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).orderBy("position")

    def feed_changes(self, after: int = 0, limit: int = 1000, prefix: str | None = None) -> DataFrame:
        """All changes of the transactions that feed() has, in order, a row each."""
        fed = self._fed(after, limit, prefix).select("position")
        return self.changes().where(F.col("position") > after).join(fed, "position", "left_semi").orderBy("position", "ord", "triple_id")

    def _fed(self, after: int, limit: int, prefix: str | None) -> DataFrame:
        tx = self.transactions().where(F.col("position") > after)
        if prefix is not None:
            tx = tx.join(self.changes().where((F.col("position") > after) & F.col("entity").startswith(prefix)).select("position").distinct(), "position", "left_semi")
        return tx.orderBy("position").limit(min(limit, 1000))

    def transactions_for_entity(self, entity: str, limit: int = 100, before: int | None = None, at: int | None = None) -> DataFrame:
        """Transactions that touch an entity, newest first, behind ``before``; ``at`` pins the pages to a position."""
        tx = self.transactions().join(self.changes().where(F.col("entity") == entity).select("position").distinct(), "position", "left_semi")
        tx = tx if at is None else tx.where(F.col("position") <= at)
        tx = tx if before is None else tx.where(F.col("position") < before)
        return tx.orderBy(F.desc("position")).limit(limit)

    def transaction(self, tx_id: str | None = None, command_id: str | None = None) -> DataFrame:
        key = F.col("tx_id") == tx_id if tx_id is not None else F.col("command_id") == command_id
        return self.transactions().where(key).join(self.changes(), "position").join(self.facts().withColumnRenamed("id", "triple_id").drop("entity", "attribute", "tx_id"), "triple_id", "left").orderBy("ord")

    def dependency_state(self, attributes: list[str] | None = None, valid_at: int | None = None) -> dict:
        """The last position that touched the attributes, and the next edge of valid time."""
        return dependency_state(self.facts(), attributes, self.clock() if valid_at is None else valid_at)

    # Writes.

    def _judge(self, m: dict, before: DataFrame, new: DataFrame, gone: DataFrame, tx: DataFrame, log: DataFrame, enforce: bool) -> DataFrame | None:
        """The violations that a state would add; raises on them if asked to, and on what a validator says.

        Only facts that can matter are judged: those of touched entities, of others with their values, and of those that
        refer to them or are referred to.
        """
        live = before.where("retracted_position IS NULL")
        after = live.unionByName(new).join(gone.select("id"), "id", "left_anti")
        broken = None
        if self.constraints:
            touched = new.select("entity").unionByName(gone.select("entity")).distinct()
            folder = Folder(self.spark, "judged")  # what matters is read many times: written, so that it is found once
            near, _ = folder.write(relevant(live.unionByName(new), touched, self.constraints), "near")
            was, now = (folder.write(df.join(near, "entity", "left_semi"), k)[0] for df, k in ((live, "before"), (after, "after")))
            broken, _ = folder.write(worsened(violations(was, self.constraints), violations(now, self.constraints)), "broken")
            if enforce and (found := broken.limit(20).collect()):
                raise CommitError("constraint", "", f"{len(found)} violations", violations=[r.asDict() for r in found])
        if self.validators and enforce:
            journal = JournalFacts(self.transactions(m).unionByName(tx), self.changes(m).unionByName(log))
            old, then = FactBase(self.spark, [StoredFacts(before), journal]), FactBase(self.spark, [StoredFacts(after), journal])
            for check in self.validators:
                if why := check(old, then):
                    raise CommitError("validator", "", why)
        return broken

    def transact(self, ops: list[dict], actor: str | None = None, command_id: str | None = None, correlation_id: str | None = None, causation_id: str | None = None, config_snapshot: str | None = None, preconditions: list[dict] = (), enforce: bool = True, dry_run: bool = False, internal: bool = False):
        """Apply ops in order, all or nothing. Returns a Receipt; with dry_run, (changes, violations) and nothing is kept."""
        m = self.manifest()
        position, instant = m["position"] + 1, max(self.clock(), m["instant"] or 0)
        tx_id = f"tx:{position:012d}"
        if command_id is not None and (old := self.transactions(m).where(F.col("command_id") == command_id).first()):
            raise CommitError("command_already_committed", "command_id", command_id, tx_id=old["tx_id"], position=old["position"])
        before = self.facts(m)
        self._preconditions(before, preconditions)
        asserted: dict[str, tuple] = {}
        retracted: dict[str, str] = {}
        changes, entries = [], []

        def retract(id: str, entity: str, attribute: str) -> None:
            if id not in retracted:
                retracted[id] = entity
                changes.append((position, len(changes), id, "retract", entity, attribute))

        for k, op in enumerate(ops):
            kind = op["op"]
            if kind == "assert":
                entity, attribute = op["entity"], op["attribute"]
                if not internal and (attribute.startswith(RESERVED) or entity.startswith(("tx:", "_sys:"))):
                    raise CommitError("reserved", f"ops[{k}]", f"{entity} {attribute}")
                a, b = op.get("validFrom"), op.get("validTo")
                for x in (a, b):
                    if x is not None and (isinstance(x, bool) or not isinstance(x, int)):
                        raise CommitError("invalid_interval", f"ops[{k}]", "bounds are whole milliseconds")
                a = instant if a is None else a
                if b is not None and b <= a:
                    raise CommitError("empty_interval", f"ops[{k}]", "validTo must lie after validFrom")
                value = typed(op["value"])
                vtype, v, blob = value_row(value)
                id = f"f:{position:012d}:{k:06d}"
                sealed = V.canonical_json({x: value[x] for x in ("valueType", "keyId", "ciphertext") if x in value}) if vtype == "sealed" else None
                asserted[id] = (id, entity, attribute, op.get("entityType"), vtype, v, blob, sealed, value.get("blind"), a, b, instant, position, None, None, tx_id, None, actor)
                changes.append((position, len(changes), id, "assert", entity, attribute))
            elif kind == "retract":
                row = asserted.get(op["id"])
                if row is not None:
                    retract(op["id"], row[1], row[2])
                elif found := before.where((F.col("id") == op["id"]) & F.col("retracted_position").isNull()).select("entity", "attribute").first():
                    if not internal and found["attribute"].startswith(RESERVED):
                        raise CommitError("reserved", f"ops[{k}]", op["id"])
                    retract(op["id"], *found)
            elif kind == "retract-pattern":
                p = op["pattern"]
                live = before.where("retracted_position IS NULL")
                for c in ("entity", "attribute"):
                    live = live.where(F.col(c) == p[c]) if c in p else live
                live = live.where(F.col("entity_type") == p["entityType"]) if "entityType" in p else live
                rows = [(r["id"], r["entity"], r["attribute"], r["vtype"], tuple(r["v"])) for r in live.select("id", "entity", "attribute", "vtype", "v").orderBy("id").collect()]
                rows += [(x[0], x[1], x[2], x[4], x[5]) for x in asserted.values() if all(x[i] == p[c] for i, c in ((1, "entity"), (2, "attribute"), (3, "entityType")) if c in p)]
                want = value_row(typed(p["value"]))[:2] if "value" in p else None
                for id, entity, attribute, vtype, v in rows:
                    if (want is None or want == (vtype, v)) and not attribute.startswith(RESERVED):
                        retract(id, entity, attribute)
            elif kind in ("append-entry", "acknowledge-entry"):
                entries.append((op["scope"], op["key"], op.get("box", "outbox"), None if op.get("payload") is None else V.canonical_json(op["payload"]), position, kind == "acknowledge-entry"))
            else:
                raise CommitError("unknown_op", f"ops[{k}]", kind)
        new = self.spark.createDataFrame(list(asserted.values()), FACTS)
        gone = self.spark.createDataFrame([(c[2], c[4], c[5], instant, position, tx_id) for c in changes if c[3] == "retract"], _RETRACTED)
        tx = self.spark.createDataFrame([(tx_id, position, instant, actor, command_id, correlation_id, causation_id, config_snapshot)], TRANSACTIONS)
        log = self.spark.createDataFrame(changes, CHANGES)
        broken = self._judge(m, before, new, gone, tx, log, enforce and not dry_run)
        if dry_run:
            return log, broken
        parts = {"facts": new if asserted else None, "retracted": gone if retracted else None, "transactions": tx, "changes": log if changes else None, "entries": self.spark.createDataFrame(entries, _ENTRIES) if entries else None}
        self._commit(m, position, instant, {k: v.coalesce(1) for k, v in parts.items() if v is not None})
        return Receipt(tx_id, position, instant, list(asserted), list(retracted))

    def _commit(self, m: dict, position: int, instant: int, parts: dict[str, DataFrame]) -> None:
        name = f"segments/{position:012d}-{uuid.uuid4().hex[:8]}"
        for kind, df in parts.items():
            df.write.parquet(f"{self.path}/{name}/{kind}")
        self._publish({"position": position, "instant": instant, "segments": [*m["segments"], [name, sorted(parts)]]})

    def load(self, rows: DataFrame, actor: str | None = None, enforce: bool = True) -> Receipt:
        """Assert many facts in one transaction: rows with entity, attribute, vtype, v, and any of entity_type, valid_from, valid_to.

        Stays distributed. Constraints, validators and reserved names hold as in transact(); they judge the staged rows
        before these are published. Facts are clustered by attribute and entity; what is the same for all of them, or
        follows from the rest, is added behind the sort. A partition has so few rows that its sort fits a task's memory.
        """
        m = self.manifest()
        position, instant = m["position"] + 1, max(self.clock(), m["instant"] or 0)
        tx_id = f"tx:{position:012d}"
        given = {c: F.col(c) for c in rows.columns}
        fixed = {"id": F.concat(F.lit(f"f:{position:012d}:"), F.sha2(F.concat_ws("|", "entity", "attribute", "vtype", F.to_json("v"), *[F.col(c).cast("string") for c in ("valid_from", "valid_to") if c in given]), 256)), "valid_from": F.coalesce(given.get("valid_from", F.lit(None).cast("long")), F.lit(instant)), "recorded_at": F.lit(instant), "recorded_position": F.lit(position), "tx_id": F.lit(tx_id), "created_by": F.lit(actor)}
        slim = rows.select(*[c for c in FACTS.names if c in given and (c not in fixed or c == "valid_from")])
        df = slim.repartitionByRange(-(-rows.count() // LOT) or 1, "attribute", "entity").sortWithinPartitions("attribute", "entity")
        df = df.select(*[fixed.get(f.name, given.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in FACTS.fields])
        name = f"segments/{position:012d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{name}/facts")
        kept = self.spark.read.schema(FACTS).parquet(f"{self.path}/{name}/facts")
        own = F.lit(False)
        for prefix in RESERVED:
            own = own | F.col("attribute").startswith(prefix)
        if bad := kept.where(own | F.col("entity").startswith("tx:") | F.col("entity").startswith("_sys:")).select("entity", "attribute").first():
            raise CommitError("reserved", "rows", f"{bad['entity']} {bad['attribute']}")
        tx = self.spark.createDataFrame([(tx_id, position, instant, actor, None, None, None, None)], TRANSACTIONS)
        self._judge(m, self.facts(m), kept, self.spark.createDataFrame([], _RETRACTED), tx, _asserted(kept), enforce)
        tx.coalesce(1).write.parquet(f"{self.path}/{name}/transactions")
        self._publish({"position": position, "instant": instant, "segments": [*m["segments"], [name, ["facts", "transactions"]]]})
        return Receipt(tx_id, position, instant)

    def _tables(self, m: dict) -> dict[str, DataFrame]:
        return {"facts": self._read("facts", FACTS, m), "retracted": self._read("retracted", _RETRACTED, m), "transactions": self.transactions(m), "changes": self.changes(m), "entries": self._read("entries", _ENTRIES, m)}

    def _rewrite(self, m: dict, tables: dict[str, DataFrame]) -> None:
        name = f"segments/{m['position']:012d}-{uuid.uuid4().hex[:8]}"
        for kind, df in tables.items():
            if "attribute" in df.columns and kind != "changes":
                df = df.repartitionByRange("attribute", "entity").sortWithinPartitions("attribute", "entity")
            df.write.parquet(f"{self.path}/{name}/{kind}")
        self._regenerate(m, [[name, sorted(tables)]])

    def compact(self) -> None:
        """Bring all segments into one, clustered by attribute; positions, ids and history stay. The old ones stay for readers that hold them."""
        m = self.manifest()
        self._rewrite(m, self._tables(m))

    # Sealed values.

    def sealed_facts(self, key_id: str | None = None) -> DataFrame:
        """(id, entity, attribute, value_type, key_id, ciphertext, blind) of all sealed facts, history included."""
        kind = "valueType string, keyId string, ciphertext string"
        rows = self._read("facts", FACTS).where("vtype = 'sealed' AND sealed IS NOT NULL").withColumn("s", F.from_json("sealed", kind))
        rows = rows.select("id", "entity", "attribute", F.col("s.valueType").alias("value_type"), F.col("s.keyId").alias("key_id"), F.col("s.ciphertext").alias("ciphertext"), "blind")
        return rows if key_id is None else rows.where(F.col("key_id") == key_id)

    def rewrite_values(self, changed: DataFrame) -> int:
        """Put new ciphertexts and tokens in the place of those of some sealed facts: (id, sealed, blind). Meaning, time and position stay; nothing is journaled."""
        m = self.manifest()
        tables = self._tables(m)
        new = changed.select("id", F.col("sealed").alias("_sealed"), F.col("blind").alias("_blind"), F.lit(True).alias("_hit"))
        facts = tables["facts"].join(new, "id", "left")
        hit = F.coalesce("_hit", F.lit(False))
        facts = facts.withColumn("sealed", F.when(hit, F.col("_sealed")).otherwise(F.col("sealed"))).withColumn("blind", F.when(hit, F.col("_blind")).otherwise(F.col("blind")))
        n = changed.count()
        self._rewrite(m, tables | {"facts": facts.select(*FACTS.names)})
        return n

    def scrub_blind_tokens(self, entity: str | None = None) -> int:
        """Erase tokens of sealed facts, of one entity or of all; ciphertexts stay."""
        rows = self._read("facts", FACTS).where("vtype = 'sealed' AND blind IS NOT NULL")
        rows = rows if entity is None else rows.where(F.col("entity") == entity)
        return self.rewrite_values(rows.select("id", "sealed", F.lit(None).cast("string").alias("blind")))

    # Consumers of the feed.

    def consumer(self, name: str) -> int:
        """The position up to which a named consumer has processed the feed; 0 for a new one."""
        folder = f"consumers/{_safe(name)}"
        moves = [n for n in self._names(folder) if n.endswith(".json")]
        return json.loads(self.spark.read.text(f"{self.path}/{folder}/{max(moves)}", wholetext=True).first()[0])["to"] if moves else 0

    def advance(self, name: str, expected: int, to: int) -> int:
        """Move a consumer from the position it read to another, if no other worker has moved it on from there. Repeating a move that was made is fine."""
        if to < expected or expected < 0:
            raise CommitError("invalid_checkpoint", "to", f"{to} lies before {expected}")
        if to > self.head():
            raise CommitError("invalid_checkpoint", "to", f"{to} lies behind the head {self.head()}")
        now = self.consumer(name)
        if now == to:
            return to
        # A move is named by where it starts, so one alone can be made from there.
        if now != expected or not self._create(f"consumers/{_safe(name)}", f"{expected:012d}.json", {"to": to}):
            raise CommitError("checkpoint_conflict", name, f"expected {expected}, found {self.consumer(name)}")
        return to

    def _preconditions(self, facts: DataFrame, asked: list[dict]) -> None:
        live = facts.where("retracted_position IS NULL")
        for i, p in enumerate(asked):
            kind = p["kind"]
            if kind == "TripleLive":
                ok = bool(live.where(F.col("id") == p["id"]).take(1))
            elif kind == "EntityAbsent":
                ok = not live.where(F.col("entity") == p["entity"]).take(1)
            elif kind == "EntityState":
                ok = {r[0] for r in live.where(F.col("entity") == p["entity"]).select("id").collect()} == set(p["ids"])
            elif kind in ("AttributeAbsent", "AttributeValue"):
                rows = live.where((F.col("entity") == p["entity"]) & (F.col("attribute") == p["attribute"])).select("vtype", "v").take(2)
                ok = not rows if kind == "AttributeAbsent" else len(rows) == 1 and (rows[0]["vtype"], tuple(rows[0]["v"])) == value_row(typed(p["value"]))[:2]
            else:
                raise CommitError("unknown_precondition", f"preconditions[{i}]", kind)
            if not ok:
                raise CommitError("precondition", f"preconditions[{i}]", kind)

    # Inbox and outbox.

    def pending(self, scope: str, box: str = "outbox", limit: int = 100, after: int = 0) -> DataFrame:
        """Entries not yet acknowledged, oldest first; an entry of the same scope and key counts once."""
        rows = self._read("entries", _ENTRIES).where((F.col("scope") == scope) & (F.col("box") == box))
        first = rows.where("NOT acknowledged").groupBy("key").agg(F.min("position").alias("position"), F.min_by("payload", "position").alias("payload"))
        return first.join(rows.where("acknowledged").select("key").distinct(), "key", "left_anti").where(F.col("position") > after).orderBy("position", "key").limit(limit)


def _asserted(facts: DataFrame) -> DataFrame:
    """The journal of loaded facts."""
    return facts.select(F.col("recorded_position").alias("position"), F.lit(0).alias("ord"), F.col("id").alias("triple_id"), F.lit("assert").alias("op"), "entity", "attribute")


def _safe(name: str) -> str:
    """A name of any characters as one of a folder."""
    return hashlib.sha256(name.encode()).hexdigest()[:40]


def dependency_state(facts: DataFrame, attributes: list[str] | None, valid_at: int) -> dict:
    df = facts if attributes is None else facts.where(F.col("attribute").isin(list(attributes)))
    edges = F.array_compact(F.array("valid_from", "valid_to"))
    future = F.array_min(F.filter(edges, lambda e: e > valid_at))
    r = df.agg(F.max(F.greatest("recorded_position", F.coalesce("retracted_position", F.lit(0)))).alias("position"), F.min(F.when(F.col("retracted_position").isNull(), future)).alias("boundary")).first()
    return {"position": r["position"] or 0, "boundary": r["boundary"]}


# Edits of intervals, as ops.


def end(fact: dict, at: int) -> list[dict]:
    """Close a fact at a moment: the same value until then."""
    return [{"op": "retract", "id": fact["id"]}, _again(fact, validTo=at)]


def replace(fact: dict, value: Any, at: int) -> list[dict]:
    """A new value from a moment on; the old one until then."""
    return [*end(fact, at), _again(fact, value=typed(value), validFrom=at)]


def correct(fact: dict, value: Any) -> list[dict]:
    """The fact never was so: another value over the same interval."""
    return [{"op": "retract", "id": fact["id"]}, _again(fact, value=typed(value))]


def combine(*edits: list[dict]) -> list[dict]:
    """Several edits as one list; a fact is retracted once."""
    out, seen = [], set()
    for op in [o for e in edits for o in e]:
        if op["op"] == "retract":
            if op["id"] in seen:
                continue
            seen.add(op["id"])
        out.append(op)
    return out


def _again(fact: dict, **changes) -> dict:
    op = {"op": "assert", "entity": fact["entity"], "attribute": fact["attribute"], "value": fact["value"], "validFrom": fact.get("validFrom"), "validTo": fact.get("validTo"), "entityType": fact.get("entityType")}
    return {k: v for k, v in (op | changes).items() if v is not None}


__all__ = ["Receipt", "Store", "combine", "correct", "dependency_state", "end", "recorded", "replace", "typed", "valid"]
