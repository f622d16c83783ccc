"""The point in recorded and valid time that a query sees."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.plans.errors import ValidationError

TX = ":_tx/"


@dataclass(frozen=True)
class Basis:
    """``recorded_at`` and ``valid_at`` in epoch milliseconds; ``position`` counts commits. None: the latest, or for ``valid_at`` all times."""

    recorded_at: int | None = None
    position: int | None = None
    valid_at: int | None = None

    @staticmethod
    def of(recorded_at: int | None = None, position: int | None = None, valid_at: int | None = None) -> Basis:
        if recorded_at is not None and position is not None:
            raise ValidationError("conflicting_basis", "basis", "give recorded_at or position, not both")
        if position is not None and (not isinstance(position, int) or position < 0):
            raise ValidationError("invalid_position", "basis.position", "a position is a whole number from 0")
        return Basis(recorded_at, position, valid_at)

    def at(self, **changes) -> Basis:
        return replace(self, **changes)


def recorded(b: Basis) -> Column:
    c = F.col
    if b.position is not None:
        seen = c("recorded_position") <= b.position
        gone = c("retracted_position").isNull() | (c("retracted_position") > b.position)
        if b.recorded_at is not None:
            seen = seen & (c("recorded_at") <= b.recorded_at)
            gone = gone | (c("retracted_at") > b.recorded_at)
        return seen & gone
    if b.recorded_at is not None:
        return (c("recorded_at") <= b.recorded_at) & (c("retracted_at").isNull() | (c("retracted_at") > b.recorded_at))
    return c("retracted_position").isNull()


def valid(b: Basis, metadata_exempt: bool = True) -> Column:
    """Half-open membership of ``valid_at``; transaction metadata ignores it."""
    if b.valid_at is None:
        return F.lit(True)
    point = (F.col("valid_from") <= b.valid_at) & (F.col("valid_to").isNull() | (F.col("valid_to") > b.valid_at))
    return F.col("attribute").startswith(TX) | point if metadata_exempt else point


def visible(b: Basis) -> Column:
    return recorded(b) & valid(b)
