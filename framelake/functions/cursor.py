"""A cursor through bit fields that hang on one another, as one column expression.

A layout lists fields in order.  Reading it is a fold: its state is the place,
the values so far and whether the data ended too soon, so neither the plan nor
the code grows with the number of fields, and a frame's bytes are taken apart
once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """An unsigned field of ``bits``; ``signed`` ones have a sign after it.

    ``optional`` fields have a bit before them that tells whether they are
    there, ``when`` names an earlier field that must not be 0 for this one to be
    there at all; where it is not, its value is ``default``.
    """

    name: str
    bits: int
    signed: bool = False
    optional: bool = False
    when: str | None = None
    default: int = 0


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def first_bytes(data: Column, most: int) -> Column:
    """Array of the first ``most`` bytes as numbers, or of all if there are fewer."""
    n = F.least(F.octet_length(data), F.lit(most))
    whole = F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    return F.when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))


def field_at(raw: Column, at: Column, n: Column) -> Column:
    """Unsigned field of ``n`` bits (32 at most) of an array of bytes; null beyond its end."""
    first = F.floor(at / 8).cast("int")
    wide = sum((F.coalesce(F.get(raw, first + k), F.lit(0)) * (1 << 8 * (4 - k)) for k in range(5)), F.lit(0).cast("long"))
    moved = F.call_function("shiftright", wide, (F.lit(40) - n - at % 8).cast("int"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1
    return F.when((at >= 0) & (at + n <= 8 * F.size(raw)), moved.bitwiseAND(mask))


def read(raw: Column, start: Column, layout: list[Field], known: dict[str, Column]) -> Column:
    """Struct (at, values, short) after the fields of ``layout``: the place, their values in order, whether data ended before.

    ``known`` are values that fields may hang on; they stand before the others.
    """
    places = {name: k for k, name in enumerate([*known, *[f.name for f in layout]])}
    entry = lambda f: F.struct(
        F.lit(f.bits).alias("bits"), F.lit(f.signed).alias("signed"), F.lit(f.optional).alias("optional"), F.lit(-1 if f.when is None else places[f.when]).alias("when"), F.lit(f.default).cast("long").alias("missing")
    )
    values = F.array(*[x.cast("long") for x in known.values()]) if known else F.array().cast("array<bigint>")
    begin = F.struct(start.cast("long").alias("at"), values.alias("values"), F.lit(False).alias("short"))

    def step(s: Column, f: Column) -> Column:
        live = (f["when"] < 0) | (F.coalesce(F.get(s["values"], f["when"]), F.lit(0)) != 0)
        asked = live & f["optional"]
        flag = F.when(asked, field_at(raw, s["at"], F.lit(1))).otherwise(live.cast("long"))
        head = F.struct(flag.alias("flag"), (s["at"] + asked.cast("long")).alias("at"))

        def body(h: Column) -> Column:
            there = F.coalesce(h["flag"], F.lit(0)) == 1
            size = field_at(raw, h["at"], f["bits"])
            negative = F.when(f["signed"], field_at(raw, h["at"] + f["bits"], F.lit(1))).otherwise(0)
            return bind(F.struct(there.alias("there"), F.when(there, size).alias("size"), F.when(there, negative).alias("negative")), lambda v: F.struct(
                (h["at"] + F.when(v["there"], f["bits"] + f["signed"].cast("int")).otherwise(0)).alias("at"),
                F.array_append(s["values"], F.when(v["there"], v["size"] * (1 - 2 * v["negative"])).otherwise(f["missing"])).alias("values"),
                (s["short"] | h["flag"].isNull() | (v["there"] & (v["size"].isNull() | v["negative"].isNull()))).alias("short"),
            ))

        return bind(head, body)

    return F.aggregate(F.array(*[entry(f) for f in layout]), begin, step)


def ones(raw: Column, at: Column, most: Column) -> Column:
    """Struct (at, n, short) after up to ``most`` bits that are 1, and a 0 behind them if there are fewer."""
    begin = F.struct(at.cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("short"), F.lit(True).alias("open"))
    turns = F.when(most > 0, F.sequence(F.lit(1), most.cast("int"))).otherwise(F.array().cast("array<int>"))

    def step(s: Column, _: Column) -> Column:
        return bind(F.when(s["open"], field_at(raw, s["at"], F.lit(1))), lambda bit: F.struct(
            (s["at"] + s["open"].cast("long")).alias("at"), (s["n"] + F.coalesce(bit, F.lit(0))).alias("n"), (s["short"] | (s["open"] & bit.isNull())).alias("short"), (s["open"] & (F.coalesce(bit, F.lit(0)) == 1)).alias("open"),
        ))

    return F.aggregate(turns, begin, step)


class Values:
    """Values of a layout by name."""

    def __init__(self, state: Column, layout: list[Field], known: list[str] = []) -> None:  # noqa: B006
        self.state, self.places = state, {name: k for k, name in enumerate([*known, *[f.name for f in layout]])}

    def __getitem__(self, name: str) -> Column:
        return F.get(self.state["values"], F.lit(self.places[name]))

    def each(self, names: list[str]) -> Column:
        return F.array(*[self[name] for name in names])
