"""The wire format as columns: packed runs, variable-length integers, 15-bit text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_RUN = 64  # a run's length takes six bits
BASE = 0x1000  # added to every 15 bits, which keeps clear of control characters and surrogates


def pack(index: Column, length: Column, color: Column) -> Column:
    """(index << 13) | (length - 1) << 7 | color as a long."""
    return F.shiftleft(index.cast("long"), 13).bitwiseOR(F.shiftleft((length - 1).cast("long"), 7)).bitwiseOR(color.cast("long").bitwiseAND(F.lit(127)))


def unpack(value: Column) -> tuple[Column, Column, Column]:
    """index, length, color."""
    return F.shiftrightunsigned(value, 13), F.shiftrightunsigned(value, 7).bitwiseAND(F.lit(63)) + 1, value.bitwiseAND(F.lit(127))


def header(frame: Column, is_keyframe: Column) -> Column:
    return F.shiftleft(frame.cast("long"), 1).bitwiseOR(is_keyframe.cast("long"))


def varint_bytes(value: Column) -> Column:
    """How many bytes a value up to 2^35 takes."""
    return F.when(value < 1 << 7, 1).when(value < 1 << 14, 2).when(value < 1 << 21, 3).when(value < 1 << 28, 4).otherwise(5)


def varint_hex(value: Column) -> Column:
    """Unsigned LEB128 as hex digits: seven bits a byte, low ones first, the high bit set on all but the last."""

    def byte(i: int, last: bool) -> Column:
        own = F.shiftrightunsigned(value.cast("long"), 7 * i).bitwiseAND(F.lit(127))
        return F.lpad(F.hex(own if last else own.bitwiseOR(F.lit(128))), 2, "0")

    def whole(n: int) -> Column:
        return F.concat(*[byte(i, i == n - 1) for i in range(n)])

    return F.when(value < 1 << 7, whole(1)).when(value < 1 << 14, whole(2)).when(value < 1 << 21, whole(3)).when(value < 1 << 28, whole(4)).otherwise(whole(5))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it, also inside its lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pieces(text: Column, size: int) -> Column:
    """A string cut into pieces of a size, in one pass."""
    return F.filter(F.split(text, rf"(?<=\G.{{{size}}})"), lambda p: F.length(p) > 0)


NUMBER = r"\G(?:[89A-F][0-9A-F]){0,7}[0-7][0-9A-F]"  # a LEB128 number in hex digits, right behind the one before


def varint_value(hexed: Column) -> Column:
    """The value of one LEB128 number of eight bytes at most: its bytes as one number, taken apart by shifts."""

    def of(whole: Column) -> Column:
        n = F.length(hexed) / 2
        parts = [F.when(n > i, F.shiftleft(F.call_function("shiftrightunsigned", whole, ((n - 1 - i) * 8).cast("int")).bitwiseAND(F.lit(127).cast("long")), 7 * i)).otherwise(F.lit(0).cast("long")) for i in range(8)]
        out = parts[0]
        for part in parts[1:]:
            out = out.bitwiseOR(part)
        return out

    short = F.conv(hexed, 16, 10).cast("long")
    return F.when(F.length(hexed) == 2, short).otherwise(let(F.conv(hexed, 16, -10).cast("long"), of))


def varints(hexed: Column) -> Column:
    """The values of a run of LEB128 numbers in hex digits, in time proportional to its length. A number that is cut off, and
    what is behind one of more than eight bytes, is left out."""
    return F.transform(F.regexp_extract_all(hexed, F.lit(NUMBER), 0), varint_value)


def text_units(hexed: Column) -> Column:
    """The code units of bytes as 15-bit text: padding bits, then the bits in fifteens, 4096 added to each. No bytes: no units."""

    def units(bits: Column) -> Column:
        pad = F.pmod(-F.length(bits), F.lit(15))
        body = F.transform(pieces(F.concat(bits, F.repeat(F.lit("0"), pad)), 15), lambda u: F.conv(u, 2, 10).cast("long") + BASE)
        return F.concat(F.array((pad + BASE).cast("long")), body)

    bits = F.array_join(F.transform(pieces(hexed, 2), lambda h: F.lpad(F.conv(h, 16, 2), 8, "0")), "")
    return F.when(F.length(hexed) == 0, F.array().cast("array<bigint>")).otherwise(let(bits, units))


def units_text(units: Column) -> Column:
    """Code units as a string, by way of UTF-16."""
    return F.decode(F.unhex(F.array_join(F.transform(units, lambda u: F.lpad(F.hex(u), 4, "0")), "")), "UTF-16BE")


def text_hex(text: Column) -> Column:
    """The bytes of 15-bit text as hex digits; a leading K: is dropped."""

    def of_units(units: Column) -> Column:
        bits = F.array_join(F.transform(F.slice(units, 2, 1 << 30), lambda u: F.lpad(F.bin(F.conv(u, 16, 10).cast("long") - BASE), 15, "0")), "")
        pad = F.conv(F.element_at(units, 1), 16, 10).cast("int") - BASE
        whole = let(bits, lambda b: F.substring(b, F.lit(1), F.length(b) - pad))
        return F.array_join(F.transform(pieces(whole, 8), lambda b: F.lpad(F.conv(b, 2, 16), 2, "0")), "")

    body = F.when(F.substring(text, 1, 2) == "K:", F.substring(text, 3, 1 << 30)).otherwise(text)
    return F.when(F.length(body) == 0, "").otherwise(let(pieces(F.hex(F.encode(body, "UTF-16BE")), 4), of_units))
