"""Ranges of ordered keys.

A range is everything, half open (``min <= key < max`` with either bound
missing), or a single key.  Ranges become Column predicates, so Catalyst can
push them into the scan; prefixes become explicit bounds for the same reason.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyRange:
    """``min <= key < max``; a missing bound is None; ``exact`` makes it the single key ``min``."""

    min: Any = None
    max: Any = None
    exact: bool = False

    def __post_init__(self) -> None:
        if self.exact and self.min is None:
            raise ValueError("a single key is needed")
        if not self.exact and self.min is not None and self.max is not None and self.min > self.max:
            raise ValueError("min is greater than max")

    @classmethod
    def all(cls) -> KeyRange:
        return cls()

    @classmethod
    def since(cls, low: Any) -> KeyRange:
        return cls(min=low)

    @classmethod
    def until(cls, high: Any) -> KeyRange:
        return cls(max=high)

    @classmethod
    def single(cls, key: Any) -> KeyRange:
        return cls(min=key, exact=True)

    @classmethod
    def of(cls, low: Any, high: Any) -> KeyRange:
        return cls(low, high)

    @classmethod
    def prefix(cls, start: bytes) -> KeyRange:
        """All byte keys that start with ``start``; one that is all FF has no successor and gets no upper bound."""
        return cls(start or None, successor(start))

    @property
    def is_all(self) -> bool:
        return self.min is None and self.max is None

    def __contains__(self, key: Any) -> bool:
        if self.exact:
            return key == self.min
        return (self.min is None or key >= self.min) and (self.max is None or key < self.max)

    def encloses(self, other: KeyRange) -> bool:
        """Whether every key of ``other`` is in this range."""
        if self.is_all:
            return True
        if other.exact:
            return other.min in self
        if self.exact:
            return False
        low = self.min is None or (other.min is not None and other.min >= self.min)
        return low and (self.max is None or (other.max is not None and other.max <= self.max))

    def intersect(self, other: KeyRange) -> KeyRange | None:
        """The common keys, or None if there are none."""
        if self.exact or other.exact:
            one, both = (self, other) if self.exact else (other, self)
            return one if one.min in both else None
        lows = [r.min for r in (self, other) if r.min is not None]
        highs = [r.max for r in (self, other) if r.max is not None]
        low, high = max(lows, default=None), min(highs, default=None)
        if low is not None and high is not None and low >= high:
            return None
        return KeyRange(low, high)

    def predicate(self, key: Column | str) -> Column:
        """The range as a condition on a key column."""
        column = F.col(key) if isinstance(key, str) else key
        if self.exact:
            return column == F.lit(self.min)
        parts = []
        if self.min is not None:
            parts.append(column >= F.lit(self.min))
        if self.max is not None:
            parts.append(column < F.lit(self.max))
        return conjunction(parts)

    def split(self, parts: int, width: int) -> list[KeyRange]:
        """``parts`` consecutive ranges over byte keys read as unsigned numbers of ``width`` bytes."""
        low = int.from_bytes((self.min or b"").ljust(width, b"\0")[:width], "big")
        high = int.from_bytes(self.max.ljust(width, b"\0")[:width], "big") if self.max is not None else 256**width
        cuts = [low + (high - low) * i // parts for i in range(1, parts)]
        edges = [self.min, *[c.to_bytes(width, "big") for c in sorted(set(cuts)) if low < c < high], self.max]
        return [KeyRange(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def conjunction(parts: list[Column]) -> Column:
    """All of the conditions; true without any."""
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def disjunction(parts: list[Column]) -> Column:
    """Any of the conditions; false without any."""
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def successor(prefix: bytes) -> bytes | None:
    """The smallest byte string greater than every string with this prefix; None if there is none."""
    body = prefix.rstrip(b"\xff")
    return body[:-1] + bytes([body[-1] + 1]) if body else None


def first_key(prefix: bytes, width: int) -> bytes:
    """The prefix with zeros up to ``width``."""
    return prefix.ljust(width, b"\0")


def next_key(prefix: bytes, width: int) -> bytes:
    """The first key of ``width`` bytes after all keys with this prefix.

    A prefix of FF bytes has none of that width; the result is then FF bytes
    over the width and one zero byte.
    """
    number = int.from_bytes(prefix, "big") + 1
    if number == 256 ** len(prefix):
        return b"\xff" * width + b"\0"
    return first_key(number.to_bytes(len(prefix), "big"), width)


#: Text forms of what to read of a file.
_FORMS = {
    "offset": re.compile(r"offset-(\d*)-(\d*)"),
    "single-key": re.compile(r"single-key-([0-9a-f]*)"),
    "key": re.compile(r"key-([0-9a-f]*)-([0-9a-f]*)"),
}


@dataclass(frozen=True)
class FileRange:
    """Part of a file: ``none``, ``full``, a window of row numbers, a range of keys, or one key."""

    kind: str
    low: Any = None
    high: Any = None

    @classmethod
    def parse(cls, text: str) -> FileRange:
        if text in ("none", "full"):
            return cls(text)
        for kind, form in _FORMS.items():
            if found := form.fullmatch(text):
                read = int if kind == "offset" else bytes.fromhex
                return cls(kind, *[read(g) if g else (b"" if kind == "single-key" else None) for g in found.groups()])
        raise ValueError(f"not a file range: {text!r}")

    def __str__(self) -> str:
        if self.kind in ("none", "full"):
            return self.kind
        show = (lambda x: "" if x is None else str(x)) if self.kind == "offset" else (lambda x: "" if x is None else x.hex())
        parts = [self.low] if self.kind == "single-key" else [self.low, self.high]
        return "-".join([self.kind, *map(show, parts)])

    def keys(self) -> KeyRange | None:
        """The key range of the key forms and ``full``."""
        if self.kind == "single-key":
            return KeyRange.single(self.low)
        return KeyRange(self.low, self.high) if self.kind == "key" else KeyRange.all() if self.kind == "full" else None
