"""Helpers for expressions over arrays: values computed once, and running results in place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, ``value`` being computed once, also where lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, op: Callable[[Column, Column], Column], zero: Column | None = None, kind: str = "int") -> Column:
    """For each of ``values`` (at least one) ``op`` over those before it, ``zero`` for none.

    ``op`` is associative and has ``zero`` as its neutral element. Appending to an array copies it,
    so blocks of about the root of their number are run over one by one, from where a run over the
    blocks' totals leaves them: n values cost about n to the power 1.5, with a small factor.
    """
    zero = F.lit(0) if zero is None else zero

    def run(block: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(block, F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out")), step, lambda acc: acc["out"])

    def of(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int")), lambda k: F.slice(v, k * w + 1, w))
        totals = lambda blocks: F.transform(blocks, lambda b: F.aggregate(b, zero, op))
        return let(let(width, cut), lambda blocks: F.flatten(F.zip_with(blocks, run(totals(blocks), zero), run)))

    return let(values, of)


def scanned(values: Column, zero: Column, step: Callable[[Column, Column], Column], told: Callable[[Column, Column], Column]) -> Column:
    """The places (from 1) of the ``values`` for which ``told(state, value)`` holds.

    The state is ``zero`` before the first and becomes ``step(state, value)``. Unlike ``running``
    this takes any step, and nothing is built up but the places: they are gathered in blocks, as
    appending to an array copies it.
    """
    none = F.array().cast("array<int>")
    state = lambda at, k, out: F.struct(at.alias("at"), k.alias("k"), out.alias("out"))

    def block(values: Column, at: Column, k: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            here = acc["k"] + 1
            return state(step(acc["at"], x), here, F.when(told(acc["at"], x), F.concat(acc["out"], F.array(here))).otherwise(acc["out"]))

        return F.aggregate(values, state(at, k, none), one)

    def of(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int")), lambda k: F.slice(v, k * w + 1, w))
        each = lambda acc, b: let(block(b, acc["at"], acc["k"]), lambda r: state(r["at"], r["k"], F.concat(acc["out"], F.array(r["out"]))))
        return F.aggregate(let(width, cut), state(zero, F.lit(0), F.array().cast("array<array<int>>")), each, lambda acc: F.flatten(acc["out"]))

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(none))


def cut_at(values: Column, starts: Column) -> Column:
    """``values`` cut into arrays, each from one of ``starts`` (places from 1, ascending) to before the next."""
    ends = lambda s: F.concat(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.size(values) + 1))
    return let(starts, lambda s: F.when(F.size(s) > 0, F.zip_with(s, ends(s), lambda a, b: F.slice(values, a, b - a))).otherwise(F.transform(s, lambda k: values)))
