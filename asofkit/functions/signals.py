"""User functions: row signals, session signals and resampled aggregates, as vectorised Pandas functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_signal(rule: Callable[[pd.DataFrame], pd.Series], df: DataFrame, features: list[str]) -> Column:
    """-1, 0 or 1 per row by ``rule``; an unknown feature or another answer is an error. Rows that lack a feature get 0."""
    unknown = sorted(set(features) - set(df.columns))
    if unknown:
        raise ValueError(f"unknown features {unknown}; there are {sorted(df.columns)}")

    @F.pandas_udf("int")
    def run(x: pd.DataFrame) -> pd.Series:
        known = x.notna().all(axis=1)
        out = pd.Series(rule(x)).where(known, 0)
        if not out.isin([-1, 0, 1]).all():
            raise ValueError("a signal is -1, 0 or 1")
        return out.astype("int32")

    return run(F.struct(*features))


class SessionView:
    """The bars of a session up to the entry minute."""

    def __init__(self, bars: pd.DataFrame):
        self.bars = bars.sort_values("minute")
        self.open = float(self.bars["open"].iloc[0])

    def price_at(self, minute: int) -> float | None:
        at = self.bars.loc[self.bars["minute"] == minute, "open"]
        return float(at.iloc[0]) if len(at) else None

    def high_before(self, minute: int) -> float:
        return float(self.bars.loc[self.bars["minute"] < minute, "high"].max())


def session_signal(bars: DataFrame, rule: Callable[[SessionView], bool], *, entry: int, keys: tuple[str, str] = ("symbol", "session")) -> DataFrame:
    """``keys, fires`` per session with a bar up to the entry. The rule sees only those bars: they are filtered before it runs."""
    kinds = dict(bars.dtypes)

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), bool(rule(SessionView(pdf)))]], columns=[*keys, "fires"])

    return bars.filter(F.col("minute") <= entry).groupBy(*keys).applyInPandas(each, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", fires boolean")


def cluster_bound(*, alpha: float, resamples: int, seed: int):
    """An aggregate (x, cluster) -> alpha quantile of the pooled mean over resamples of whole clusters; NULL under two clusters."""

    @F.pandas_udf("double")
    def bound(x: pd.Series, cluster: pd.Series) -> float:
        g = pd.DataFrame({"x": x, "c": cluster}).dropna().groupby("c")["x"].agg(["sum", "count"])
        if len(g) < 2:
            return None
        drawn = np.random.default_rng(seed).integers(0, len(g), (resamples, len(g)))
        total, n = g["sum"].to_numpy()[drawn].sum(axis=1), g["count"].to_numpy()[drawn].sum(axis=1)
        return float(np.quantile(total / n, alpha))

    return bound
