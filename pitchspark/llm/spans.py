"""Spans of a pattern in a text as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def find(text: Column, pattern: str, around: int = 48) -> Column:
    """array of (start, end, value, before, after), leftmost first: code points, end exclusive, and the text around.

    Splitting and extracting find the same matches, so places are running sums of the lengths of both.
    """

    total = lambda lens: F.aggregate(lens, F.lit(0), lambda at, x: at + x)

    def spans(parts: Column) -> Column:
        m, g = parts["m"], parts["g"]

        def step(state: Column, b: Column) -> Column:
            at = state["at"] + total(F.slice(parts["n"], b * BLOCK + 1, F.lit(BLOCK)))
            return F.struct(at.alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts"))

        # places of every BLOCK-th match first, so that a text with very many matches takes no square of them
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        blocks = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / BLOCK).cast("int")), zero, step, lambda s: s["starts"])

        def span(v: Column, i: Column, heads: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            start = F.get(heads, b) + total(F.slice(parts["n"], b * BLOCK + 1, i % BLOCK)) + F.length(F.get(g, i))
            return let(
                start,
                lambda at: F.struct(
                    at.alias("start"),
                    (at + F.length(v)).alias("end"),
                    v.alias("value"),
                    F.right(F.get(g, i), F.lit(around)).alias("before"),
                    F.left(F.get(g, i + 1), F.lit(around)).alias("after"),
                ),
            )

        return let(blocks, lambda heads: F.transform(m, lambda v, i: span(v, i, heads)))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    sized = lambda p: F.struct(p["m"].alias("m"), p["g"].alias("g"), F.transform(p["m"], lambda v, i: F.length(v) + F.length(F.get(p["g"], i))).alias("n"))
    return let(let(both, sized), lambda p: F.when(F.size(p["m"]) > 0, spans(p)).otherwise(none))
