"""User-level column functions: option pricing, intervals, growth, sizing, text normalisation, canonical hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The coefficients of Abramowitz-Stegun 7.1.26 for the error function.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _erf_tail(z: Column, t: Column) -> Column:
    """1 - erf(z) for z >= 0, with t = 1 / (1 + ERF_P * z)."""
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return poly * F.exp(-z * z)


def norm_cdf(x) -> Column:
    """Normal distribution function, right to 7e-8, from built-in arithmetic."""
    x = _c(x)
    upper = _let(F.abs(x) / 2**0.5, lambda z: _let(1 / (1 + ERF_P * z), lambda t: _erf_tail(z, t))) / 2
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def bs_price(cp, spot, strike, total_vol) -> Column:
    """Black-Scholes price without rates; ``total_vol`` is sigma * sqrt(T). Without volatility it is the intrinsic value; puts by parity."""
    spot, strike, v = _c(spot), _c(strike), _c(total_vol)
    d1 = F.try_divide(F.ln(F.try_divide(spot, strike)), v) + v / 2
    call = _let(F.struct(d1.alias("d1"), v.alias("v")), lambda b: spot * norm_cdf(b["d1"]) - strike * norm_cdf(b["d1"] - b["v"]))
    call = F.when(v > 0, call).otherwise(F.greatest(spot - strike, F.lit(0.0)))
    return call - F.when(_c(cp) == "C", 0.0).otherwise(spot - strike)


def with_option_price(df: DataFrame, name: str, cp, spot, strike, total_vol) -> DataFrame:
    """Adds the price of ``bs_price`` as a column, in steps, so that every intermediate value is worked out once in generated code."""
    own = {f"__{name}_{k}": _c(x) for k, x in (("cp", cp), ("s", spot), ("k", strike), ("v", total_vol))}
    c = lambda k: F.col(f"__{name}_{k}")
    step = lambda df, **columns: df.withColumns({f"__{name}_{k}": v for k, v in columns.items()})
    out = step(df.withColumns(own), d1=F.try_divide(F.ln(F.try_divide(c("s"), c("k"))), c("v")) + c("v") / 2)
    out = step(out, d2=c("d1") - c("v"), z1=F.abs(c("d1")) / 2**0.5, z2=F.abs(c("d1") - c("v")) / 2**0.5)
    out = step(out, t1=1 / (1 + ERF_P * c("z1")), t2=1 / (1 + ERF_P * c("z2")))
    out = step(out, u1=_erf_tail(c("z1"), c("t1")) / 2, u2=_erf_tail(c("z2"), c("t2")) / 2)
    n = lambda d, u: F.when(c(d) >= 0, 1 - c(u)).otherwise(c(u))
    call = F.when(c("v") > 0, c("s") * n("d1", "u1") - c("k") * n("d2", "u2")).otherwise(F.greatest(c("s") - c("k"), F.lit(0.0)))
    out = out.withColumn(name, call - F.when(c("cp") == "C", 0.0).otherwise(c("s") - c("k")))
    return out.drop(*[x for x in out.columns if x.startswith(f"__{name}_")])


def settle(cp, strike, settlement) -> Column:
    """Payoff of one long option at settlement."""
    k, s = _c(strike), _c(settlement)
    return F.when(_c(cp) == "C", F.greatest(s - k, F.lit(0.0))).otherwise(F.greatest(k - s, F.lit(0.0)))


def snap(x, step: float = 5.0) -> Column:
    """To the nearest grid strike; halves go to the even multiple."""
    return F.rint(_c(x) / step) * step


def wilson(wins, n, z: float = 1.96) -> tuple[Column, Column]:
    wins, n = _c(wins), _c(n)
    p = F.try_divide(wins, n)
    d = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)


def minimum_detectable_effect(p, n1, n2, z_alpha: float = 1.96, z_power: float = 0.84) -> Column:
    p, n1, n2 = _c(p), _c(n1), _c(n2)
    return F.when((n1 > 0) & (n2 > 0), (z_alpha + z_power) * F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))))


def implied_probability(debit, width) -> Column:
    """What the price says about a full win: debit / width, or 1 - credit / width."""
    d, w = _c(debit), _c(width)
    return F.when(d >= 0, F.try_divide(d, w)).otherwise(1 + F.try_divide(d, w))


def full_win(settlement, debit, width, eps: float = 1e-9) -> Column:
    s, d, w = _c(settlement), _c(debit), _c(width)
    return F.when(d >= 0, s >= w - eps).otherwise(s >= -eps)


def session_vol(daily_vol, entry_minute, close_minute: int = 960, session_minutes: int = 390, premium: float = 1.10) -> Column:
    """Volatility of the rest of the session."""
    return _c(daily_vol) * premium * F.sqrt(F.greatest(F.lit(close_minute) - _c(entry_minute), F.lit(0)) / float(session_minutes))


def kelly(p, b) -> Column:
    p, b = _c(p), _c(b)
    return F.when(b > 0, F.greatest(F.lit(0.0), p - (1 - p) / b)).otherwise(0.0)


def size_cap(p, b, entropy_, multiplier, fraction: float = 0.25) -> Column:
    return F.least(fraction * kelly(p, b), F.lit(1.0)) * _c(p) * (1 - _c(entropy_)) * _c(multiplier)


def entropy(probabilities) -> Column:
    """Entropy of a probability array divided by its maximum."""
    p = _c(probabilities)
    h = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    return F.when(F.size(p) > 1, h / F.ln(F.size(p).cast("double"))).otherwise(0.0)


def growth(current, base) -> Column:
    """current / base - 1, only from a positive base."""
    return F.when(_c(base) > 0, _c(current) / _c(base) - 1)


def log_growth(current, base) -> Column:
    return F.when((_c(base) > 0) & (_c(current) > 0), F.ln(_c(current) / _c(base)))


def sign_position(now, before) -> Column:
    """-1 or 1 by the direction of change; NULL when equal or unknown."""
    return F.nullif(F.signum(_c(now) - _c(before)), F.lit(0.0)).cast("int")


def bic(log_likelihood, k, d, n) -> Column:
    """Bayesian information criterion of a k-state Gaussian chain in d dimensions."""
    k, d = _c(k), _c(d)
    parameters = k - 1 + k * (k - 1) + k * d + k * d * (d + 1) / 2
    return -2 * _c(log_likelihood) + parameters * F.ln(_c(n).cast("double"))


def seed_of(*parts) -> Column:
    """The first eight bytes of a SHA-256 of the joined parts, as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(chr(31), *[_c(p).cast("string") for p in parts]), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def safe(x, fallback: float = 0.0) -> Column:
    """Numbers that are not finite become the fallback; the rest is rounded half-even to eight places."""
    x = _c(x).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(fallback)).otherwise(F.bround(x, 8))


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of the row as JSON with sorted member names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def symbol_name(x) -> Column:
    return F.replace(F.upper(F.trim(_c(x))), F.lit("/"), F.lit("-"))


def slug(x) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def is_metric_name(x) -> Column:
    return _c(x).rlike("^[a-z0-9_]{1,40}$")


def epoch_timestamp(x) -> Column:
    """Nanoseconds or milliseconds since 1970, told apart by size."""
    x = _c(x)
    return F.timestamp_micros(F.when(x >= 100_000_000_000_000_000, F.floor(x / 1000)).otherwise(x * 1000).cast("long"))


def utc_timestamp(x) -> Column:
    """ISO-8601 text with a mandatory offset; NULL without one."""
    x = _c(x)
    return F.when(x.rlike(r"(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(x))


def occ_symbol(root, day, cp, strike) -> Column:
    """Option symbol: root, yymmdd, side, strike in thousandths."""
    return F.concat(_c(root), F.date_format(_c(day), "yyMMdd"), _c(cp), F.lpad(F.rint(_c(strike) * 1000).cast("long").cast("string"), 8, "0"))


def occ_parts(symbol) -> tuple[Column, Column, Column, Column]:
    pattern = r"^([A-Z]+)(\d{6})([CP])(\d{8})$"
    g = lambda k: F.regexp_extract(_c(symbol), pattern, k)
    return g(1), F.to_date(g(2), "yyMMdd"), g(3), g(4).cast("double") / 1000


#: The same functions in SQL.
def sql_norm_cdf(x: str) -> str:
    poly = "0.0"
    for a in reversed(ERF_A):
        poly = f"(({poly} + {a!r}) * (1 / (1 + {ERF_P} * abs({x}) / {2**0.5!r})))"
    erf = f"(1 - {poly} * exp(-(abs({x}) / {2**0.5!r}) * (abs({x}) / {2**0.5!r})))"
    return f"(CASE WHEN {x} >= 0 THEN (1 + {erf}) / 2 ELSE (1 - {erf}) / 2 END)"


def sql_bs_call(spot: str, strike: str, v: str) -> str:
    d1 = f"(ln({spot} / {strike}) / {v} + {v} / 2)"
    return f"(CASE WHEN {v} > 0 THEN {spot} * {sql_norm_cdf(d1)} - {strike} * {sql_norm_cdf(f'({d1} - {v})')} ELSE greatest({spot} - {strike}, 0.0) END)"


def answer_multiplier(answer, least_confidence: float = 0.80) -> Column:
    """Size by a classifier's answers (confidence, chaotic, trending, clean, risk); without an answer, or in doubt, 0."""
    a = _c(answer)
    closed = a.isNull() | (a["confidence"] < least_confidence) | (a["chaotic"] >= 0.5) | (a["risk"] >= 2.5) | (a["clean"] < 0.40)
    return F.when(F.coalesce(closed, F.lit(True)), 0.0).when(a["trending"] >= 0.60, 1.0).otherwise(0.5)
