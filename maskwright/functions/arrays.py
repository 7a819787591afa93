"""Array expressions in time proportional to their input: bindings, folds that emit, cuts of long texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a fold's inner array, which is copied for each element, and characters of a text's blocks.
CHUNK, BLOCK = 128, 2048


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also where it is used inside of other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def emit(items: Column, state: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Runs step(state, item) -> (state, array of out to emit) over items and gives all that was emitted.

    Folds append to an array by copying it; so they fill short arrays, which are joined at the end.
    """
    none, nones = F.array().cast(f"array<{out}>"), F.array().cast(f"array<array<{out}>>")

    def one(acc: Column, x: Column) -> Column:
        new, made = step(acc["s"], x)
        return F.struct(new.alias("s"), F.concat(acc["out"], made).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        last = F.aggregate(part, F.struct(acc["last"]["s"].alias("s"), none.alias("out")), one)
        return F.struct(last.alias("last"), F.concat(acc["done"], F.array(acc["last"]["out"])).alias("done"))

    def all_of(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda c: F.slice(xs, c * CHUNK + 1, F.lit(CHUNK)))
        begin = F.struct(F.struct(state.alias("s"), none.alias("out")).alias("last"), nones.alias("done"))
        return F.when(F.size(xs) == 0, none).otherwise(F.aggregate(parts, begin, chunk, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["last"]["out"])))))

    return let(items, all_of)


def blocks(text: Column) -> Column:
    """The text in pieces of BLOCK characters."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), 0)


def cut(pieces: Column, start: Column, stop: Column) -> Column:
    """Characters [start, stop) of a text given by its blocks, at the cost of the blocks that they touch."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor((stop - 1) / BLOCK).cast("int")
    block = lambda k: F.element_at(pieces, k + 1)
    at = F.pmod(start, F.lit(BLOCK)) + 1
    whole = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    several = F.concat(F.substr(block(first), at), whole, F.substr(block(last), F.lit(1), F.pmod(stop - 1, F.lit(BLOCK)) + 1))
    return F.when(stop <= start, "").when(first == last, F.substr(block(first), at, stop - start)).otherwise(several)


def splice(text: Column, edits: Column, start: str, stop: str, new: Callable[[Column], Column]) -> Column:
    """text with each of the edits (sorted, apart) put in place of the characters that it names."""

    def made(pieces: Column) -> Column:
        before = lambda i: F.when(i > 0, F.element_at(edits, F.greatest(i, F.lit(1)))[stop]).otherwise(0)
        each = F.flatten(F.transform(edits, lambda e, i: F.array(cut(pieces, before(i), e[start]), new(e))))
        tail = cut(pieces, F.element_at(edits, -1)[stop], F.char_length(text))
        return F.concat(F.array_join(each, ""), tail)

    return F.when(F.size(edits) > 0, let(blocks(text), made)).otherwise(text)
