"""Fact sources. A scan yields the columns of ``SCAN``: id, entity, attribute, value, stored type, transaction, valid bounds, type, blind token."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import values as V
from factloom.functions.basis import TX, Basis, recorded, valid, visible

SCAN = ("id", "entity", "attribute", "v", "vtype", "tx_id", "valid_from", "valid_to", "entity_type", "blind")
FACTS = T.StructType(
    [T.StructField(n, t, n not in ("id", "entity", "attribute", "vtype", "v")) for n, t in (("id", T.StringType()), ("entity", T.StringType()), ("attribute", T.StringType()), ("entity_type", T.StringType()), ("vtype", T.StringType()), ("v", V.VALUE), ("blob", T.StructType([T.StructField("mime", T.StringType()), T.StructField("size", T.LongType()), T.StructField("filename", T.StringType())])), ("sealed", T.StringType()), ("blind", T.StringType()))]
    + [T.StructField(n, T.LongType()) for n in ("valid_from", "valid_to", "recorded_at", "recorded_position", "retracted_at", "retracted_position")]
    + [T.StructField(n, T.StringType()) for n in ("tx_id", "retract_tx_id", "created_by")]
)
TRANSACTIONS = T.StructType([T.StructField("tx_id", T.StringType()), T.StructField("position", T.LongType()), T.StructField("instant", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("actor", "command_id", "correlation_id", "causation_id", "config_snapshot")]])
CHANGES = T.StructType([T.StructField("position", T.LongType()), T.StructField("ord", T.IntegerType()), T.StructField("triple_id", T.StringType()), T.StructField("op", T.StringType()), T.StructField("entity", T.StringType()), T.StructField("attribute", T.StringType())])
#: Transaction metadata: attribute, column, family, stored type.
METADATA = ((":_tx/position", "position", V.NUMBER, "number"), (":_tx/instant", "instant", V.NUMBER, "datetime"), (":_tx/actor", "actor", V.TEXT, "string"), (":_tx/command-id", "command_id", V.TEXT, "string"), (":_tx/correlation-id", "correlation_id", V.TEXT, "string"), (":_tx/causation-id", "causation_id", V.TEXT, "string"), (":_tx/config-snapshot", "config_snapshot", V.TEXT, "string"))
CHANGED = ":_tx/changed-entity"


@dataclass
class Scan:
    """``family``: that of all values, natively typed in ``v``; None: ``v`` is the struct."""

    df: DataFrame
    family: int | None = None


class Source:
    def has(self, attribute: str) -> bool:
        raise NotImplementedError

    def scan(self, attribute: str | None, basis: Basis) -> Scan:
        """Visible facts of one attribute, or of all."""
        raise NotImplementedError


@dataclass
class Lift:
    """An ordinary column as an attribute. ``kind``: string, number, boolean, datetime or ref."""

    column: Column
    kind: str

    @property
    def family(self) -> int:
        return V.FAMILY[self.kind]


@dataclass
class LiftedTable(Source):
    """A wide table whose columns are attributes of one entity per row; nulls are no facts. Nothing is copied.

    ``entity`` must be unique: several patterns over one subject then need a single scan. Facts hold from ``valid_from``
    (null: ever) to ``valid_to`` (null: open), and are recorded before all commits.
    """

    df: DataFrame
    entity: Column
    columns: dict[str, Lift]
    valid_from: Column | None = None
    valid_to: Column | None = None
    entity_type: str | None = None
    unique: bool = True

    def has(self, attribute: str) -> bool:
        return attribute in self.columns

    def base(self, basis: Basis) -> DataFrame:
        df = self.df
        if basis.valid_at is not None and self.valid_from is not None:
            df = df.where(self.valid_from.isNull() | (self.valid_from <= basis.valid_at))
        if basis.valid_at is not None and self.valid_to is not None:
            df = df.where(self.valid_to.isNull() | (self.valid_to > basis.valid_at))
        return df

    def native(self, attribute: str) -> Column:
        lift = self.columns[attribute]
        return lift.column.cast(V.NATIVE[lift.family])

    def scan(self, attribute: str | None, basis: Basis) -> Scan:
        if attribute is None:
            parts = [self._facts(a, basis, True) for a in self.columns]
            return Scan(reduce(DataFrame.unionByName, parts))
        return Scan(self._facts(attribute, basis, False), self.columns[attribute].family)

    def _facts(self, attribute: str, basis: Basis, wide: bool) -> DataFrame:
        lift, none = self.columns[attribute], F.lit(None).cast("string")
        value = V.struct(self.native(attribute), lift.family) if wide else self.native(attribute)
        df = self.base(basis).where(lift.column.isNotNull())
        bounds = [(c if c is not None else F.lit(None)).cast("long") for c in (self.valid_from, self.valid_to)]
        return df.select(F.concat(self.entity, F.lit("|" + attribute)).alias("id"), self.entity.alias("entity"), F.lit(attribute).alias("attribute"), value.alias("v"), F.lit(lift.kind).alias("vtype"), none.alias("tx_id"), bounds[0].alias("valid_from"), bounds[1].alias("valid_to"), F.lit(self.entity_type).cast("string").alias("entity_type"), none.alias("blind"))


@dataclass
class StoredFacts(Source):
    """Rows of FACTS, history included."""

    facts: DataFrame

    def has(self, attribute: str) -> bool:
        return not attribute.startswith(TX)

    def scan(self, attribute: str | None, basis: Basis) -> Scan:
        df = self.facts if attribute is None else self.facts.where(F.col("attribute") == attribute)
        return Scan(df.where(visible(basis)).select(*SCAN))


@dataclass
class JournalFacts(Source):
    """Transactions as facts of the transaction entity. A fixed attribute reads one projection only."""

    transactions: DataFrame
    changes: DataFrame

    def has(self, attribute: str) -> bool:
        return attribute.startswith(TX)

    def _rows(self, basis: Basis) -> DataFrame:
        tx = self.transactions
        if basis.position is not None:
            tx = tx.where(F.col("position") <= basis.position)
        if basis.recorded_at is not None:
            tx = tx.where(F.col("instant") <= basis.recorded_at)
        return tx

    def scan(self, attribute: str | None, basis: Basis) -> Scan:
        tx, none = self._rows(basis), F.lit(None).cast("string")

        def facts(df: DataFrame, name: str, value: Column, family: int, kind: str, wide: bool) -> DataFrame:
            df = df.where(value.isNotNull())
            v = V.struct(value.cast(V.NATIVE[family]), family) if wide else value.cast(V.NATIVE[family])
            return df.select(F.concat_ws("|", "tx_id", F.lit(name), value.cast("string")).alias("id"), F.col("tx_id").alias("entity"), F.lit(name).alias("attribute"), v.alias("v"), F.lit(kind).alias("vtype"), "tx_id", F.col("instant").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), none.alias("entity_type"), none.alias("blind"))

        changed = tx.join(self.changes.select("position", "entity").distinct(), "position")
        if attribute == CHANGED:
            return Scan(facts(changed, CHANGED, F.col("entity"), V.TEXT, "ref", False), V.TEXT)
        if attribute is not None:
            for name, column, family, kind in METADATA:
                if name == attribute:
                    return Scan(facts(tx, name, F.col(column), family, kind, False), family)
            return Scan(facts(tx.where("false"), attribute, F.col("tx_id"), V.TEXT, "string", False), V.TEXT)
        parts = [facts(tx, name, F.col(column), family, kind, True) for name, column, family, kind in METADATA]
        return Scan(reduce(DataFrame.unionByName, [*parts, facts(changed, CHANGED, F.col("entity"), V.TEXT, "ref", True)]))


@dataclass
class Overlay(Source):
    """A source with hypothetical facts (rows of FACTS) added and some ids (DataFrame with ``id``) taken away."""

    below: Source
    added: DataFrame
    removed: DataFrame | None = None

    def has(self, attribute: str) -> bool:
        return True

    def scan(self, attribute: str | None, basis: Basis) -> Scan:
        more = self.added if attribute is None else self.added.where(F.col("attribute") == attribute)
        more = more.where(valid(basis)).select(*SCAN)
        if attribute is not None and not self.below.has(attribute):
            return Scan(more)
        below = self.below.scan(attribute, basis)
        df = below.df if self.removed is None else below.df.join(self.removed.select("id"), "id", "left_anti")
        if below.family is not None:
            df = df.withColumn("v", V.struct(F.col("v"), below.family))
        return Scan(df.unionByName(more))


@dataclass
class FactBase:
    """Sources queried together. ``sealing``: its attributes allow presence and blind equality only. ``known``: attributes
    that queries may name; None allows all."""

    spark: SparkSession
    sources: list[Source] = field(default_factory=list)
    sealing: object | None = None
    known: set[str] | None = None

    def scan(self, attribute: str | None, basis: Basis) -> Scan:
        scans = [s.scan(attribute, basis) for s in self.sources if attribute is None or s.has(attribute)]
        scans = scans or [StoredFacts(self.spark.createDataFrame([], FACTS)).scan(attribute, basis)]
        families = {s.family for s in scans}
        if len(families) == 1:
            return Scan(reduce(DataFrame.unionByName, [s.df for s in scans]), families.pop())
        wide = [s.df if s.family is None else s.df.withColumn("v", V.struct(F.col("v"), s.family)) for s in scans]
        return Scan(reduce(DataFrame.unionByName, wide))

    def star(self, attribute: str) -> LiftedTable | None:
        """The unique lifted table that alone has an attribute."""
        having = [s for s in self.sources if s.has(attribute)]
        return having[0] if len(having) == 1 and isinstance(having[0], LiftedTable) and having[0].unique else None

    def query(self, q: dict, basis: Basis | None = None, decode: dict[str, str] | None = None) -> DataFrame:
        """The complete result: a column for each find term, named without its question mark.

        A column whose family is known is a plain double, boolean or string (counts are long); otherwise it is the value
        struct, unless ``decode`` names a Spark type for it.
        """
        from factloom.plans.compile import run

        return run(self, q, basis or Basis(), decode)


def millis(df: DataFrame, column: str) -> Column:
    """Epoch milliseconds of a timestamp column; one without a zone is read as UTC, whatever the session's zone."""
    c = F.col(column).cast("timestamp")
    if dict(df.dtypes)[column] == "timestamp_ntz" and df.sparkSession.conf.get("spark.sql.session.timeZone") != "UTC":
        c = F.from_utc_timestamp(c, F.current_timezone())
    return F.unix_millis(c)


def lift(df: DataFrame, kind: str, key: Column, **columns: tuple[str, str] | str) -> LiftedTable:
    """``lift(orders, "order", col("o_orderkey"), total="o_totalprice:number", customer="o_custkey:ref:customer")``."""
    out = {}
    for name, spec in columns.items():
        column, type_, *target = spec.split(":")
        c = F.col(column)
        if type_ == "ref":
            c = F.concat(F.lit(f"{target[0]}:"), c.cast("string"))
        elif type_ == "datetime":
            c = millis(df, column)
        out[f":{kind}/{name}"] = Lift(c, type_)
    return LiftedTable(df, F.concat(F.lit(f"{kind}:"), key.cast("string")), out, entity_type=kind)


__all__ = ["CHANGES", "FACTS", "SCAN", "TRANSACTIONS", "FactBase", "JournalFacts", "Lift", "LiftedTable", "Overlay", "Scan", "Source", "StoredFacts", "lift", "millis", "recorded"]
