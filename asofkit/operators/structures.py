"""Defined-risk option structures as arrays of legs (cp, strike, qty): builders, lookups, settlement and validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from asofkit.functions import scalars as fn

# fixed values: type, side of the anchored leg (long: debit, short: credit), and where the other strike lies
VERTICALS = {"call_debit": ("C", 1, 1), "put_debit": ("P", 1, -1), "call_credit": ("C", -1, 1), "put_credit": ("P", -1, -1)}
INDEX_STEP, LEAST_WIDTH, MOST_WIDTH = 5.0, 5.0, 50.0


def leg(cp: str, strike: Column, qty: int) -> Column:
    return F.struct(F.lit(cp).alias("cp"), strike.cast("double").alias("strike"), F.lit(qty).alias("qty"))


def vertical(helper: str, entry: Column, width: Column, offset: Column, step: float = 1.0) -> Column:
    """Two legs of one type: the anchor at the entry price moved out of the money by ``offset`` and snapped, the other ``width`` beyond."""
    cp, side, beyond = VERTICALS[helper]
    anchor = fn.snap(entry + beyond * offset, step)
    return F.array(leg(cp, anchor, side), leg(cp, anchor + beyond * width, -side))


def index_vertical(helper: str, entry: Column, width: Column, offset: Column) -> Column:
    return vertical(helper, entry, width, offset, INDEX_STEP)


def long_put(strike: Column) -> Column:
    return F.array(leg("P", strike, 1))


def short_strike(legs: Column, cp: str) -> Column:
    """Strike of the first short leg of a type; NULL without one."""
    return F.get(F.filter(legs, lambda g: (g["qty"] < 0) & (g["cp"] == cp)), F.lit(0))["strike"]


def width(legs: Column) -> Column:
    return F.array_max(legs["strike"]) - F.array_min(legs["strike"])


def settle(legs: Column, settlement: Column) -> Column:
    return F.aggregate(legs, F.lit(0.0), lambda s, g: s + g["qty"] * fn.settle(g["cp"], g["strike"], settlement))


def refusal(legs: Column) -> Column:
    """Why a structure is not an index vertical; NULL if it is one."""
    types, sides, w = F.array_distinct(legs["cp"]), F.array_sort(legs["qty"]), width(legs)
    off_grid = F.exists(legs, lambda g: g["strike"].isNull() | F.isnan(g["strike"]) | (g["strike"] <= 0) | (g["strike"] % INDEX_STEP != 0))
    return (
        F.when(F.size(legs) != 2, "not two legs").when((F.size(types) != 1) | ~F.array_contains(F.array(F.lit("C"), F.lit("P")), types[0]) | (sides != F.array(F.lit(-1), F.lit(1))), "no long and short of one type")
        .when(~F.coalesce(w.between(LEAST_WIDTH, MOST_WIDTH), F.lit(False)), "width").when(off_grid, "off the grid")
    )
