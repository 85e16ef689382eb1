"""Texts of values of any depth, for those that one unrolled expression can't reach.

The expressions of ``functions.scalars`` unroll six levels. A value that they leave null is taken apart here, inside its
row: a list of pieces, at first the value alone, is gone over once for each level, and each time a list or map gives way to
its opening, its items and its closing, and any other value to its text. Nothing is shuffled, stored or read twice, so
the work grows with the rows; a value's pieces are no more than its row has held.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspring.functions import scalars as S

Hold = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Shape:
    """How nodes read: the text of those without items; the kinds of nodes with items, their items, and what stands around and between these."""

    text: Callable[[Column], Column]
    kind: str
    kinds: tuple[str, ...]
    items: Callable[[Column, Column], Column]
    opening: Callable[[Column], Column]
    closing: Callable[[Column], Column]
    between: Callable[[Column, Column], Column]


def _sides(v: Column, kind: Column) -> Column:
    """The items of a list; keys and values of a map in turns."""
    get = F.try_variant_get
    items = get(v, "$.v", "array<variant>")
    sides = F.flatten(F.transform(items, lambda x: F.array(get(x, "$.key", "variant"), get(x, "$.val", "variant"))))
    return F.when(kind == "map", sides).otherwise(items)


VALUES = Shape(
    text=lambda v: S.display(v, 0),
    kind="$.type",
    kinds=("vec", "map"),
    items=_sides,
    opening=lambda kind: F.when(kind == "map", "{").otherwise("["),
    closing=lambda kind: F.when(kind == "map", "}").otherwise("]"),
    between=lambda kind, i: F.when((kind == "map") & (i % 2 == 1), ":").otherwise(","),
)
PREDICATES = Shape(
    text=lambda v: S.predicate(v, 0),
    kind="$.kind",
    kinds=("and", "or", "not"),
    items=lambda v, kind: F.try_variant_get(v, "$.of", "array<variant>"),
    opening=lambda kind: F.concat(F.lit('{"'), kind, F.when(kind == "not", '":').otherwise('":[')),
    closing=lambda kind: F.when(kind == "not", "}").otherwise("]}"),
    between=lambda kind, i: F.lit(","),
)


#: Levels that are gone over before a value is asked how many it can have.
STEPS = 16
#: What a value has come to: what stands before a piece, and its text or, while it is open, the value to be taken apart.
PIECES = "array<struct<before:string,text:string,v:variant,open:boolean>>"


def _closed(before: Column, text: Column) -> Column:
    return F.struct(before.alias("before"), text.alias("text"), F.lit(None).cast("variant").alias("v"), F.lit(False).alias("open"))


def _open(before: Column, v: Column) -> Column:
    return F.struct(before.alias("before"), F.lit(None).cast("string").alias("text"), v.alias("v"), F.lit(True).alias("open"))


def _apart(p: Column, shape: Shape) -> Column:
    """The pieces that one level of an open piece gives."""

    def node(kind: Column, items: Column) -> Column:
        inner = F.transform(items, lambda v, i: _open(F.when(i == 0, "").otherwise(shape.between(kind, i)), v))
        return F.concat(F.array(_closed(p["before"], shape.opening(kind))), inner, F.array(_closed(F.lit(""), shape.closing(kind))))

    def told(kind: Column) -> Column:
        whole = S.bound(F.when(kind.isin(*shape.kinds), shape.items(p["v"], kind)), lambda items: F.when(items.isNotNull(), node(kind, items)), PIECES)
        return F.coalesce(whole, F.array(_closed(p["before"], shape.text(p["v"]))))

    return S.bound(F.try_variant_get(p["v"], shape.kind, "string"), told, PIECES)


def whole_text(value: Column, shape: Shape) -> Column:
    """The text of a value of any depth; null where a part can't be shown at any depth.

    A value has no more levels than its JSON text has brackets, as each has a list of its own; once nothing is open, or
    a part can't be shown, the steps that are left pass.
    """

    def state(pieces: Column) -> Column:
        bad = F.exists(pieces, lambda p: ~p["open"] & p["text"].isNull())
        return F.struct(pieces.alias("pieces"), bad.alias("bad"), (~bad & F.exists(pieces, lambda p: p["open"])).alias("open"))

    def step(now: Column, _: Column) -> Column:
        pieces = F.flatten(F.transform(now["pieces"], lambda p: F.when(p["open"], _apart(p, shape)).otherwise(F.array(p))))
        return F.when(now["open"], S.bound(pieces, state, f"struct<pieces:{PIECES},bad:boolean,open:boolean>")).otherwise(now)

    def joined(now: Column) -> Column:
        return F.when(~now["bad"], F.array_join(F.transform(now["pieces"], lambda p: F.concat(p["before"], p["text"])), ""))

    # the JSON text of a variant is slow to write, so only what is still open after STEPS asks for it
    levels = F.length(F.to_json(value)) - F.length(F.replace(F.to_json(value), F.lit("["), F.lit(""))) + 1
    run = lambda now, steps: F.when(now["open"], F.aggregate(F.sequence(F.lit(1), F.when(steps > 0, steps).otherwise(levels)), now, step)).otherwise(now)
    return F.aggregate(F.array(F.lit(STEPS), F.lit(0)), state(F.array(_open(F.lit(""), value)).cast(PIECES)), run, joined)


def whole_texts(roots: DataFrame, shape: Shape, hold: Hold) -> DataFrame:
    """(key, text) of values (key, v) of any depth, held; null where a part can't be shown at any depth."""
    return hold(roots.select("key", whole_text(F.col("v"), shape).alias("text")))


def complete(rows: DataFrame, values: Column, shown: str, shape: Shape) -> DataFrame:
    """Rows whose column ``shown``, the texts of an array of values, has them for values of any depth as well.

    Only a value that is there and lacks its text is taken apart. Null values stay as they were, as do values with a
    part that can't be shown.
    """
    return rows.withColumn(shown, F.zip_with(values, F.col(shown), lambda v, text: F.when(v.isNotNull() & text.isNull(), whole_text(v, shape)).otherwise(text)))
