"""Update modes, result kinds and the algebra of (previous, current) pairs."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class UpdateMode(Enum):
    """Whether a table takes read-modify-write operations; puts are never gated."""

    DISALLOW = "disallow"
    ALLOW = "allow"
    ALLOW_UNSAFE = "allow_unsafe"

    def check(self) -> None:
        if self is UpdateMode.DISALLOW:
            raise PermissionError("updates are disallowed on this table")


class Result(Enum):
    """What a write tells about the state before it."""

    VOID = "void"
    EXISTED = "existed"
    PREVIOUS = "previous"


class Returned(Enum):
    """What an update gives back."""

    NOTHING = "nothing"
    OLD = "old"
    NEW = "new"


def changed(previous: Column, current: Column) -> Column:
    """Null-safe inequality."""
    return ~previous.eqNullSafe(current)


def delta(previous: Column, current: Column) -> Column:
    return F.struct(previous.alias("previous"), current.alias("current"))


def is_changed(pair: Column) -> Column:
    return changed(pair["previous"], pair["current"])


def map_delta(pair: Column, fn) -> Column:
    """The delta with ``fn`` applied to both sides; null stays null."""
    side = lambda x: F.when(x.isNotNull(), fn(x))
    return delta(side(pair["previous"]), side(pair["current"]))


def resolve_delta(pair: Column, returned: Returned) -> Column:
    return {Returned.OLD: pair["previous"], Returned.NEW: pair["current"], Returned.NOTHING: F.lit(None)}[returned]
