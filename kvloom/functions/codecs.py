"""Value codecs as Column expressions.

A codec is a pair of Column functions.  Integers are big-endian two's
complement, so byte order puts negative numbers after positive ones; typed key
columns have natural order instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Codec:
    """encode: typed to BINARY; decode: back; width in bytes if it is fixed."""

    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]
    width: int | None = None

    def mapped(self, forward: Callable[[Column], Column], back: Callable[[Column], Column]) -> Codec:
        """The codec of values that ``forward`` makes of this codec's values, and ``back`` undoes."""
        return Codec(lambda v: self.encode(back(v)), lambda b: forward(self.decode(b)), self.width)


def _hex_bytes(number: Column, width: int) -> Column:
    """The low ``width`` bytes of a bigint."""
    return F.unhex(F.right(F.lpad(F.hex(number.cast("bigint")), 16, "0"), F.lit(2 * width)))


def _number(raw: Column, width: int) -> Column:
    """A big-endian two's complement number of ``width`` bytes."""
    sign = F.when(F.conv(F.hex(F.substring(raw, 1, 1)), 16, 10).cast("int") >= 128, F.lit("F")).otherwise(F.lit("0"))
    return F.conv(F.concat(F.repeat(sign, F.lit(16 - 2 * width)), F.hex(raw)), 16, -10).cast("bigint")


def checked(raw: Column, width: int) -> Column:
    """``raw`` if it has ``width`` bytes, else an error."""
    message = F.concat(F.lit(f"expected {width} bytes, found "), F.octet_length(raw).cast("string"))
    return F.when(raw.isNull() | (F.octet_length(raw) == width), raw).otherwise(F.raise_error(message).cast("binary"))


RAW = Codec(lambda v: v, lambda b: b)
INT = Codec(lambda v: _hex_bytes(v, 4), lambda b: _number(checked(b, 4), 4).cast("int"), 4)
LONG = Codec(lambda v: _hex_bytes(v, 8), lambda b: _number(checked(b, 8), 8), 8)
SHORT = Codec(lambda v: _hex_bytes(v, 2), lambda b: _number(checked(b, 2), 2).cast("smallint"), 2)
#: Reads 8 bytes, and 4 bytes of an older form.
LONG_OR_INT = Codec(LONG.encode, lambda b: F.when(F.octet_length(b) == 4, _number(b, 4)).otherwise(_number(checked(b, 8), 8)))


def fixed(width: int) -> Codec:
    """Bytes of exactly this width."""
    return Codec(lambda v: checked(v, width), lambda b: checked(b, width), width)


def fixed_text(width: int) -> Codec:
    """UTF-8 text of exactly this many bytes."""
    return Codec(lambda v: checked(F.encode(v, "UTF-8"), width), lambda b: F.decode(checked(b, width), "UTF-8"), width)


def _text_encode(value: Column) -> Column:
    raw = F.encode(value, "UTF-8")
    return F.concat(_hex_bytes(F.octet_length(raw), 4), raw)


def _text_decode(raw: Column) -> Column:
    size = _number(F.substring(raw, 1, 4), 4).cast("int")
    whole = F.octet_length(raw) >= size + 4
    return F.decode(F.when(whole, F.substring(raw, F.lit(5), size)).otherwise(F.raise_error(F.lit("text is cut short")).cast("binary")), "UTF-8")


#: UTF-8 text behind its length in four bytes.
TEXT = Codec(_text_encode, _text_decode)
EMPTY = Codec(lambda v: F.unhex(F.lit("")), lambda b: F.lit(None).cast("void"), 0)


class Versioned:
    """Values behind the number of the codec that wrote them: one byte (``micro``) or four.

    Writes use the current codec, reads the one that the number names.  Numbers
    are checked here, an unknown number in the data is an error when read.
    """

    def __init__(self, codecs: dict[int, Codec], current: int, micro: bool = True):
        if current not in codecs:
            raise ValueError(f"no codec {current}")
        if micro and any(not 0 <= n <= 255 for n in codecs):
            raise ValueError("a micro codec number is 0 to 255")
        self.codecs, self.current, self.size = dict(codecs), current, 1 if micro else 4

    def register(self, number: int, codec: Codec) -> None:
        if number in self.codecs:
            raise ValueError(f"codec {number} exists")
        self.codecs[number] = codec

    def encode(self, value: Column) -> Column:
        return F.concat(_hex_bytes(F.lit(self.current), self.size), self.codecs[self.current].encode(value))

    def decode(self, raw: Column) -> Column:
        number = F.conv(F.hex(F.substring(raw, 1, self.size)), 16, 10).cast("bigint")
        body = F.substring(raw, F.lit(self.size + 1), F.octet_length(raw))
        out = None
        for n, codec in sorted(self.codecs.items()):
            out = F.when(number == n, codec.decode(body)) if out is None else out.when(number == n, codec.decode(body))
        return out.otherwise(F.raise_error(F.concat(F.lit("unknown codec "), number.cast("string"))))


def ascii_only(text: Column) -> Column:
    """Letters A-Z, a-z and digits of the text."""
    return F.regexp_replace(text, "[^0-9A-Za-z]", "")


def entry_set(entries: Column) -> Column:
    """An array of (key, value) entries as a set ordered by key; null as empty; the last of equal keys wins."""
    sound = F.coalesce(entries, F.array().cast("array<struct<key:string,value:string>>"))
    placed = F.array_sort(F.transform(sound, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value"))))
    last = F.filter(placed, lambda e, i: ~F.coalesce(F.get(placed, i + 1)["key"] == e["key"], F.lit(False)))
    return F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def updated(raw: Column, codec: Codec, fn: Callable[[Column], Column]) -> tuple[Column, Column, Column]:
    """An updater over encoded values: the new bytes, and the old and the new value; null for deleted or missing ones."""
    old = F.when(raw.isNotNull(), codec.decode(raw))
    new = fn(old)
    return F.when(new.isNotNull(), codec.encode(new)), old, new


def common_prefix(a: Column, b: Column, most: int) -> Column:
    """How many bytes, up to ``most``, the two have in common at their start."""
    same = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda n: (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)) & (F.octet_length(a) >= n) & (F.octet_length(b) >= n))
    return F.size(same)


def boolean_response(flag: Column) -> Column:
    """One byte, 1 or 0."""
    return F.unhex(F.when(flag, F.lit("01")).otherwise(F.lit("00")))


def response_boolean(raw: Column) -> Column:
    return F.hex(raw) == "01"


def int_set(text: Column) -> Column:
    """A JSON array of ints as a set."""
    return F.array_distinct(F.from_json(text, "array<int>"))
