"""From rules to ledgers: many rules over many sessions in one job, and the trades they would have made, modelled or quoted.

A session is one row with its bars as an array, so a rule sees nothing but its session. All rules of a table are compiled together: every distinct observation is worked
out once, every distinct comparison once, and a rule is a Boolean expression over those; the result is an array that is stacked to rows. Neither
shuffles nor scans depend on the number of rules.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from asofkit.functions import scalars as fn
from asofkit.operators import rules, structures
from asofkit.operators.calendar import iso_week
from asofkit.operators.resampling import cluster_bootstrap
from asofkit.operators.windows import realized_vol

# fixed values
HELPERS = {"call_debit_spread": "call_debit", "put_credit_spread": "put_credit"}
REACHES, VOL_SESSIONS, CLOSE_MINUTE, SESSION_MINUTES, PREMIUM, FRESH_MINUTES = 945, 20, 960, 390, 1.10, 15
MOST_RULES = 5000
NO_MODEL, NO_TRADE, NO_BOUNDS = "modeled economics unavailable", "no leg trade within the quote freshness window before entry", "leg prints violate the structure's no-arbitrage bounds"
NO_QUOTE, TOO_OLD, CROSSED, DEGENERATE = "no price", "outside selection tolerance", "crossed quote", "degenerate entry"
LEAST_COVERAGE, LEAST_SESSIONS, LEAST_WEEKS = 0.70, 30, 12
BASE_COST, ELEVATED_COST = 0.03, 0.045
EPS = 1e-9


def sessions(bars: DataFrame, *, keys: tuple[str, str] = ("symbol", "session"), reaches: int = REACHES) -> DataFrame:
    """One row per session: ``bars`` (in order of their minutes), ``open, close, full_day`` and ``sigma``, the daily volatility known before the session."""
    g = bars.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("minute", "open", "high", "low", "close"))).alias("bars"))
    g = g.withColumns({"open": F.get("bars", F.lit(0))["open"], "close": F.element_at("bars", -1)["close"], "full_day": F.element_at("bars", -1)["minute"] >= reaches})
    w = W.partitionBy(keys[0]).orderBy(keys[1])
    g = g.withColumn("lr", F.ln(F.try_divide("close", F.lag("close").over(w)))).withColumn("vol", realized_vol("lr", VOL_SESSIONS, w))
    return g.withColumn("sigma", F.lag("vol").over(w)).drop("lr", "vol")


def price_at(minute: int | Column) -> Column:
    """The open of the bar that begins at a minute; NULL without one."""
    return F.get(F.filter("bars", lambda b: b["minute"] == minute), F.lit(0))["open"]


def observation(o: dict, entry: int) -> Column:
    """The column of an observation over a row of ``sessions``; NULL where it is unknown. Features come in a map ``features`` of ``family.metric``."""
    if o["obs"] == "return_from_open":
        return (F.try_divide(price_at(o["minute"]), F.col("open")) - 1) * 100
    if o["obs"] == "return_between":
        return (F.try_divide(price_at(o["end_minute"]), price_at(o["start_minute"])) - 1) * 100
    if o["obs"] == "feature":
        return F.try_element_at("features", F.lit(f"{o['family']}.{o['metric']}"))
    level = F.col("open") + float(o["open_offset"])
    touched = lambda b: b["high"] >= level if o["open_offset"] >= 0 else b["low"] <= level
    return F.exists("bars", lambda b: (b["minute"] > o["after_minute"]) & (b["minute"] < entry) & touched(b)).cast("double")


def frozen_rules(judged: DataFrame, most: int = MOST_RULES) -> list[tuple]:
    """``(attempt, canonical document)`` of the valid rules, in order of arrival. They are compiled on the driver, so their number is checked."""
    found = judged.filter("ok").select("attempt", "canonical").orderBy("attempt").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rules: sweep them in several jobs")
    return [(r["attempt"], json.loads(r["canonical"])) for r in found]


def sweep(days: DataFrame, frozen: list[tuple], *, keep: list[str]) -> DataFrame:
    """Columns ``keep``, ``entry_minute, helper, width, otm_offset`` and ``fired``: an array of (attempt, selected) per session and structure.

    Rules of one structure and entry minute share a row, as they share the trade.
    """
    seen: dict[str, int] = {}
    observed, compared = [], []
    comparisons: dict[str, int] = {}

    def observe(o: dict, entry: int) -> Column:
        key = json.dumps(o, sort_keys=True) + (f"@{entry}" if o["obs"] == "first_touch_before_entry" else "")
        if key not in seen:
            seen[key] = len(observed)
            observed.append(observation(o, entry))
        return F.get("observed", F.lit(seen[key]))

    def leaf(n: dict, entry: int) -> Column:
        key = f"{json.dumps(n, sort_keys=True)}@{entry}"
        if key not in comparisons:
            comparisons[key] = len(compared)
            compared.append(rules.compile_leaf(n, lambda o: observe(o, entry)))
        return F.get("compared", F.lit(comparisons[key]))

    attempt = "string" if frozen and isinstance(frozen[0][0], str) else "bigint"
    groups: dict[tuple, list[Column]] = {}
    for name, doc in frozen:
        s = doc["structure"]
        fired = F.struct(F.lit(name).cast(attempt).alias("attempt"), rules.compile_tree(doc["signal"], lambda n: leaf(n, doc["entry_minute"])).alias("selected"))  # noqa: B023
        groups.setdefault((doc["entry_minute"], s["helper"], float(s["width"]), float(s["otm_offset"])), []).append(fired)
    row = lambda spec, fired: F.struct(F.lit(spec[0]).alias("entry_minute"), F.lit(spec[1]).alias("helper"), F.lit(spec[2]).alias("width"), F.lit(spec[3]).alias("otm_offset"), fired.alias("fired"))
    empty = F.array().cast(f"array<struct<entry_minute:int,helper:string,width:double,otm_offset:double,fired:array<struct<attempt:{attempt},selected:boolean>>>>")
    trades = F.array(*[row(spec, F.array(*fired)) for spec, fired in groups.items()]) if groups else empty
    array = lambda columns, kind: F.array(*columns) if columns else F.array().cast(f"array<{kind}>")
    # lambdas are interpreted, so hundreds of expressions in a row do not make one method that is too long to compile
    plain = lambda a: F.transform(a, lambda v: v)
    x = days.withColumn("observed", array(observed, "double")).withColumn("compared", plain(array(compared, "boolean"))).withColumn("trades", plain(trades))
    # the outer form, as the plain one adds a filter on the array's size, into which every rule would be copied
    out = x.select(*keep, F.explode_outer("trades").alias("t")).select(*keep, "t.*")
    return out if groups else out.limit(0)


def fires(swept: DataFrame, keys: list[str]) -> DataFrame:
    """One row per rule and session: ``attempt, selected``."""
    return swept.select(*keys, F.explode("fired").alias("f")).select(*keys, "f.*")


# --- prices --------------------------------------------------------------------------------------------------------


def with_structures(swept: DataFrame, step: float = 1.0) -> DataFrame:
    """Trades at the entry price of full sessions: ``entry, legs, settled, best, worst``. Sessions without an entry price are no decision."""
    x = swept.withColumn("entry", price_at(F.col("entry_minute"))).filter("full_day and entry > 0")
    build = lambda helper: structures.vertical(HELPERS[helper], F.col("entry"), F.col("width"), F.col("otm_offset"), step)
    x = x.withColumn("legs", F.when(F.col("helper") == "call_debit_spread", build("call_debit_spread")).otherwise(build("put_credit_spread")))
    kinks = F.concat(F.array(F.lit(0.0)), F.col("legs.strike"), F.array(F.array_max("legs.strike") + F.col("width") + 1.0))
    x = x.withColumn("payoffs", F.transform(kinks, lambda at: structures.settle(F.col("legs"), at)))
    return x.withColumns({"best": F.array_max("payoffs"), "worst": F.array_min("payoffs"), "settled": structures.settle(F.col("legs"), F.col("close"))}).drop("payoffs")


def modelled(trades: DataFrame) -> DataFrame:
    """Adds ``debit, source, skip``: every leg by the frozen model; a trade without the volatility of 20 earlier sessions is no decision."""
    x = trades.filter("sigma is not null").withColumn("total_vol", fn.session_vol("sigma", "entry_minute", CLOSE_MINUTE, SESSION_MINUTES, PREMIUM))
    for k in (0, 1):
        leg = F.get("legs", F.lit(k))
        x = fn.with_option_price(x, f"price{k}", leg["cp"], "entry", leg["strike"], "total_vol")
    debit = sum((F.get("legs", F.lit(k))["qty"] * F.col(f"price{k}") for k in (0, 1)), F.lit(0.0))
    return x.withColumn("debit", debit).withColumns({"source": F.lit("modeled"), "skip": F.when(F.coalesce(F.isnan("debit"), F.lit(True)), NO_MODEL)}).drop("price0", "price1", "total_vol")


def _leg_rows(trades: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    own = [*keys, "entry_minute", "helper", "width", "otm_offset"]
    legs = trades.select(*own, F.posexplode("legs").alias("at", "leg"))
    return legs.select(*own, "at", "leg.cp", "leg.strike", "leg.qty"), own


def quoted(trades: DataFrame, prints: DataFrame, *, keys: list[str], fresh: int = FRESH_MINUTES) -> DataFrame:
    """Adds ``debit, source, skip``: every leg by its latest trade (``keys, cp, strike, minute, price``) of the last 15 minutes; all legs or none."""
    legs, own = _leg_rows(trades, keys)
    p = prints.select(*keys, "cp", "strike", F.col("minute").alias("printed"), "price")
    met = legs.join(p, [*keys, "cp", "strike"], "left").withColumn("ok", F.coalesce(F.col("printed").between(F.col("entry_minute") - fresh, F.col("entry_minute")), F.lit(False)))
    latest = met.groupBy(*own, "at", "qty").agg(F.max_by("price", F.when(F.col("ok") & F.col("price").isNotNull(), F.col("printed"))).alias("price"))
    debit = latest.groupBy(*own).agg(F.sum(F.col("qty") * F.col("price")).alias("debit"), F.count("price").alias("priced_legs"), F.count(F.lit(1)).alias("legs_in_all"))
    x = trades.join(debit, own)
    inside = F.col("debit").between(F.col("worst") - EPS, F.col("best") + EPS)
    skip = F.when(F.col("priced_legs") < F.col("legs_in_all"), NO_TRADE).when(~F.coalesce(inside, F.lit(False)), NO_BOUNDS)
    return x.withColumns({"source": F.lit("indicative"), "skip": skip}).drop("priced_legs", "legs_in_all")


def leg_evidence(trades: DataFrame, book: DataFrame, *, keys: list[str], tolerance: int = FRESH_MINUTES) -> DataFrame:
    """Per leg of a trade: ``bid, ask, quoted_at, chosen, skip`` from the latest quote (``keys, cp, strike, minute, bid, ask``) up to the entry.

    A long leg pays the ask, a short one gets the bid. No quote, one older than the tolerance, or one whose bid lies above its ask gives no price and says so.
    """
    legs, own = _leg_rows(trades, keys)
    b = book.select(*keys, "cp", "strike", F.col("minute").alias("quoted_at"), "bid", "ask")
    met = legs.join(b, [*keys, "cp", "strike"], "left").withColumn("known", F.coalesce(F.col("quoted_at") <= F.col("entry_minute"), F.lit(False)))
    latest = met.groupBy(*own, "at", "cp", "strike", "qty").agg(F.max(F.when(F.col("known"), F.struct("quoted_at", "bid", "ask"))).alias("q")).select(*own, "at", "cp", "strike", "qty", "q.*")
    bad = F.coalesce((F.col("bid") > F.col("ask")) | (F.col("bid") < 0) | F.isnan("bid") | F.isnan("ask"), F.lit(True))
    skip = F.when(F.col("quoted_at").isNull(), NO_QUOTE).when(F.col("entry_minute") - F.col("quoted_at") > tolerance, TOO_OLD).when(bad, CROSSED)
    x = latest.withColumn("skip", skip)
    side = F.when(F.col("qty") > 0, F.col("ask")).otherwise(F.col("bid"))
    only = {c: F.when(F.col("skip").isNull(), F.col(c)) for c in ("quoted_at", "bid", "ask")}
    return x.withColumn("chosen", F.when(F.col("skip").isNull(), side)).withColumns(only)


def executable(trades: DataFrame, evidence: DataFrame, *, keys: list[str]) -> DataFrame:
    """Adds ``debit, source, skip`` from the evidence of all legs; several reasons are joined by ``;``. A debit beyond the width either way is degenerate."""
    own = [*keys, "entry_minute", "helper", "width", "otm_offset"]
    g = evidence.groupBy(*own).agg(F.sum(F.col("qty") * F.col("chosen")).alias("debit"), F.array_join(F.array_sort(F.collect_set("skip")), ";").alias("missing"))
    x = trades.join(g, own, "left")
    skip = F.when(F.coalesce(F.col("missing"), F.lit(NO_QUOTE)) != "", F.coalesce("missing", F.lit(NO_QUOTE))).when(~F.coalesce(F.abs("debit") < F.col("width"), F.lit(False)), DEGENERATE)
    return x.withColumns({"source": F.lit("executable"), "skip": skip}).drop("missing")


# --- ledgers -------------------------------------------------------------------------------------------------------


def ledger(priced: DataFrame, keys: list[str]) -> DataFrame:
    """Signal and control rows: a row per rule and trade, with ``selected``. An unpriced trade has no figures but a reason, if it was selected.

    The control of a rule is its rows whatever ``selected`` says.
    """
    sound = (F.col("best") > F.col("worst")) & F.col("settled").between(F.col("worst") - EPS, F.col("best") + EPS)
    x = priced.withColumn("reason", F.coalesce("skip", F.when(~sound, NO_MODEL))).withColumn("priced", F.col("reason").isNull())
    figures = {"debit": "debit", "settlement": "settled", "best_settlement": "best", "worst_settlement": "worst", "trade_width": "width"}
    x = x.withColumns({name: F.when(F.col("priced"), F.col(c)) for name, c in figures.items()}).withColumn("pnl", F.col("settlement") - F.col("debit"))
    x = x.select(*keys, "helper", "source", "priced", "reason", *figures, "pnl", F.explode("fired").alias("f"))
    return x.select("f.attempt", *keys, F.col("f.selected").alias("selected"), "priced", "helper", "source", F.col("trade_width").alias("width"), "debit", "settlement", "best_settlement", "worst_settlement", "pnl", F.when(F.col("f.selected"), F.col("reason")).alias("skip_reason"), F.col("reason").alias("control_reason"))


def scores(rows: DataFrame, day: str = "session") -> DataFrame:
    """Per rule: selected and priced trades, coverage, means after costs in parts of the width, the edge over the implied odds, and the same edge of the control."""
    chosen = F.col("selected") & F.col("priced")
    mean = lambda cond, x: F.avg(F.when(cond, x)) * 100
    net = lambda cost: (F.col("pnl") - cost * F.col("width")) / F.col("width")
    spread = F.col("best_settlement") - F.col("worst_settlement")
    won = (F.col("settlement") >= F.col("best_settlement") - EPS).cast("double")
    edge = won - (F.least(F.greatest((F.col("debit") - F.col("worst_settlement")) / spread, F.lit(0.0)), F.lit(1.0)) + BASE_COST)
    g = rows.groupBy("attempt").agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if("selected").alias("selected"), F.count_if(chosen).alias("priced"), F.count_distinct(F.when(chosen, iso_week(day))).alias("weeks"),
        mean(chosen, net(BASE_COST)).alias("base_mean"), mean(chosen, net(ELEVATED_COST)).alias("elevated_mean"), mean(chosen, edge).alias("edge_pp"), mean(F.col("priced"), edge).alias("control_edge_pp"),
    )
    return g.withColumns({"coverage": F.try_divide("priced", "selected"), "lift_pp": F.col("edge_pp") - F.col("control_edge_pp")})


def evidence_block(rows: DataFrame, *, day: str = "session", entitled: Column | None = None, floors: tuple[float, int, int] = (LEAST_COVERAGE, LEAST_SESSIONS, LEAST_WEEKS), resamples: int = 2000, seed: str = "evidence") -> DataFrame:
    """Per rule the scores of its executable ledger, the weekly-cluster lower bound of its base outcomes, and ``state``.

    ``unavailable`` where the rule's prices may not be used (``entitled``, a column over its scores), ``insufficient`` below a floor of coverage, priced sessions or weeks; otherwise
    ``passed`` if the mean after base costs, its lower bound and the mean after elevated costs are all positive, else ``failed``. The bound is
    worked out only for rules above the floors.
    """
    scored = scores(rows, day)
    enough = (F.coalesce("coverage", F.lit(0.0)) >= floors[0]) & (F.col("priced") >= floors[1]) & (F.col("weeks") >= floors[2])
    scored = scored.withColumn("allowed", F.lit(True) if entitled is None else F.coalesce(entitled, F.lit(False))).withColumn("enough", enough)
    outcomes = rows.filter("selected and priced").join(scored.filter("allowed and enough").select("attempt"), "attempt").select("attempt", iso_week(day).alias("week"), ((F.col("pnl") - BASE_COST * F.col("width")) / F.col("width")).alias("x"))
    bound = cluster_bootstrap(outcomes, ["attempt"], "week", "x", resamples=resamples, seed=seed, alpha=0.05).select("attempt", (F.col("lower_bound") * 100).alias("base_lower_bound"))
    out = scored.join(bound, "attempt", "left")
    good = (F.col("base_mean") > 0) & (F.col("elevated_mean") > 0) & (F.col("base_lower_bound") > 0)
    state = F.when(~F.col("allowed"), "unavailable").when(~F.col("enough"), "insufficient").when(F.coalesce(good, F.lit(False)), "passed").otherwise("failed")
    return out.withColumn("state", state).drop("allowed", "enough")
