"""Spans of regular expressions in texts with DataFrame functions only: places of matches in code points, and what stands around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose places are summed in one go; sums of these blocks are summed apart, so that long texts take linear time.
BLOCK = 256
#: Characters before and after a match that are kept.
AROUND = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _place(block: Column, base: Column) -> Column:
    start = F.struct(base.alias("at"), F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        first = state["at"] + x["gap"]
        last = first + F.char_length(x["value"])
        span = F.struct(first.alias("start"), last.alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(last.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    return F.aggregate(block, start, step)["out"]


def find_spans(text: Column, pattern: str, around: int = AROUND) -> Column:
    """All matches of a pattern that never matches nothing, as an array of (start, end, value, before, after); empty without any.

    Matches are leftmost and don't overlap, as Java's regular expressions find them; places are in code points, end exclusive.
    text must not be null.
    """

    def rows(pieces: Column) -> Column:
        found = F.arrays_zip(
            F.slice(pieces, 1, F.size(pieces) - 1).alias("piece"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"),
            F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("next"),
        )
        row = lambda x: F.struct(F.char_length(x["piece"]).alias("gap"), x["value"].alias("value"), F.right(x["piece"], F.lit(around)).alias("before"), F.left(x["next"], F.lit(around)).alias("after"))
        return F.transform(found, row)

    def placed(found: Column) -> Column:
        count = F.ceil(F.size(found) / F.lit(BLOCK)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(found, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(found) > 0, let(blocks, summed))

    def summed(blocks: Column) -> Column:
        length = lambda block: F.aggregate(block, F.lit(0), lambda s, x: s + x["gap"] + F.char_length(x["value"]))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        bases = F.aggregate(blocks, start, lambda s, b: F.struct((s["at"] + length(b)).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(blocks, bases, _place))

    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    found = F.when(text.rlike(pattern), let(let(F.split(text, pattern, -1), rows), placed))
    return F.coalesce(found, none)


def labelled(spans: Column, kind: str, order: int) -> Column:
    """spans with their kind and its place in the list of kinds."""
    return F.transform(spans, lambda x: F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def written(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
