"""Filed facts as vintages: what was known when, discrete quarters, growth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

QUARTER = (80, 100)
YEAR = (350, 380)


def vintages(facts: DataFrame, keys: tuple[str, ...] = ("symbol", "end")) -> DataFrame:
    """A new vintage only where the value changes; later equal reports confirm it."""
    w = W.partitionBy(*keys).orderBy("filed", "accession")
    changed = F.when(F.lag("value").over(w).isNull() | (F.lag("value").over(w) != F.col("value")), 1).otherwise(0)
    numbered = facts.withColumn("__new", changed).withColumn("vintage", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = numbered.groupBy(*keys, "vintage").agg(F.min("filed").alias("filed"), F.max("value").alias("value"), F.array_sort(F.collect_list(F.struct("filed", "accession"))).alias("reports"))
    return g.withColumn("accession", F.element_at("reports", 1)["accession"]).withColumn("confirmed_by", F.transform(F.slice("reports", F.lit(2), F.greatest(F.size("reports") - 1, F.lit(0))), lambda r: r["accession"])).drop("reports")


def discrete_quarters(ytd: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Quarters out of year-to-date periods with one start: the first as filed, later ones by difference; gaps are not bridged."""
    w = W.partitionBy(*keys, "start").orderBy("end")
    x = ytd.withColumn("__pe", F.lag("end").over(w)).withColumn("__pv", F.lag("value").over(w))
    direct = F.col("__pe").isNull() & (F.datediff("end", "start") + 1).between(*QUARTER)
    step = F.datediff("end", "__pe").between(*QUARTER)
    method = F.when(direct, "direct").when(step, "ytd_diff")
    value = F.when(direct, F.round("value", 2)).when(step, F.round(F.col("value") - F.col("__pv"), 2))
    return x.select(*keys, "end", method.alias("method"), value.alias("value"))


def year_growth(periods: DataFrame, keys: tuple[str, ...] = ("symbol",), tolerance: int = 10) -> DataFrame:
    """Growth over the period of like length that ended a year before; the nearest end wins."""
    day = lambda c: F.datediff(F.col(c), F.to_date(F.lit("1970-01-01")))
    size = 400
    a = periods.withColumn("__b", F.explode(F.array_distinct(F.array(F.floor((day("end") - YEAR[1]) / size), F.floor((day("end") - YEAR[0]) / size)))))
    b = periods.select(*keys, F.floor(day("end") / size).alias("__b"), F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("value").alias("__v"))
    met = a.join(b, [*keys, "__b"]).filter(F.datediff("end", "__e").between(*YEAR) & (F.abs(F.datediff("end", "start") - F.datediff("__e", "__s")) <= tolerance))
    best = met.groupBy(*keys, "start", "end").agg(F.max_by("__v", "__e").alias("base"))
    out = periods.join(best, [*keys, "start", "end"], "left")
    return out.withColumn("yoy", F.when(F.col("base") > 0, F.col("value") / F.col("base") - 1))


def quarter_states(facts: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """What each quarter was worth, and from when to when: ``keys, end, known_from, known_until, method, value``.

    A quarter is a fact of a quarter's length, or else the year-to-date fact less that of the quarter before with the same start; of each period the
    latest filing counts (of one day the greatest accession). Among direct facts of one end the latest start wins, among differences the earliest.
    ``known_until`` is the day of the next filing that matters, NULL for the last state.
    """
    gap = lambda a, b: F.datediff(F.col(a), F.col(b)).between(*QUARTER)
    filed = facts.groupBy(*keys, "start", "end", "filed").agg(F.max_by("value", "accession").alias("value"))
    versions = filed.withColumn("until", F.lead("filed").over(W.partitionBy(*keys, "start", "end").orderBy("filed")))
    place = F.datediff("start", F.to_date(F.lit("1970-01-01")))
    direct = versions.filter(gap("end", "start")).select(*keys, "end", F.col("filed").alias("since"), "until", F.struct(F.lit(2).alias("a"), place.alias("b"), F.col("end").alias("c")).alias("rank"), F.lit("direct").alias("method"), "value")
    prior = versions.select(*keys, "start", F.col("end").alias("__e"), F.col("filed").alias("__f"), F.col("until").alias("__u"), F.col("value").alias("__v"))
    met = versions.filter(F.datediff("end", "start") > QUARTER[1]).join(prior, [*keys, "start"]).filter(gap("end", "__e"))  # the few quarters of one year
    met = met.withColumn("since", F.greatest("filed", "__f")).withColumn("until", F.least("until", "__u")).filter("until is null or since < until")
    by_difference = met.select(*keys, "end", "since", "until", F.struct(F.lit(1).alias("a"), (-place).alias("b"), F.col("__e").alias("c")).alias("rank"), F.lit("ytd_diff").alias("method"), (F.col("value") - F.col("__v")).alias("value"))
    known = direct.unionByName(by_difference)
    days = known.select(*keys, "end", F.col("since").alias("known_from")).distinct()
    on = days.join(known, [*keys, "end"]).filter("since <= known_from and (until is null or until > known_from)")
    best = on.groupBy(*keys, "end", "known_from").agg(F.max_by(F.struct("method", "value"), "rank").alias("s"))
    until = F.lead("known_from").over(W.partitionBy(*keys, "end").orderBy("known_from"))
    return best.select(*keys, "end", "known_from", until.alias("known_until"), "s.method", "s.value")


def next_quarter_acceleration(decisions: DataFrame, facts: DataFrame, keys: tuple[str, ...] = ("symbol",), match_days: int = 10) -> DataFrame:
    """For each ``keys, decision``: log growth over the year of the next quarter filed from the decision on, less that of the last one known before it.

    ``last_end`` is the latest quarter with growth among those filed before the decision; quarters after it that were known by then, but have no base, are passed.
    No outcome (NULL) where a quarter is missing in between, the next one never becomes computable, or its base was not known at the decision.
    The array of a decision holds the quarters of one company.
    """
    states = quarter_states(facts, keys)
    live = decisions.join(states, [*keys]).filter("known_from < decision and (known_until is null or known_until >= decision)")
    known = live.groupBy(*keys, "decision").agg(F.collect_list(F.struct("end", "value")).alias("q"))

    def base(end):
        off = lambda x: F.abs(F.datediff(end, x["end"]) - 365)
        near = F.filter("q", lambda x: off(x) <= match_days)
        return F.array_min(F.transform(near, lambda x: F.struct(off(x).alias("off"), x["end"].alias("end"), x["value"].alias("value"))))["value"]

    grown = F.filter(F.transform("q", lambda x: F.struct(x["end"].alias("end"), x["value"].alias("value"), base(x["end"]).alias("base"))), lambda x: (x["base"] > 0) & (x["value"] > 0))
    last = known.withColumn("l", F.array_max(grown)).filter("l is not null").select(*keys, "decision", "q", F.col("l.end").alias("last_end"), F.log(F.col("l.value") / F.col("l.base")).alias("last_growth"))
    step = F.datediff("end", F.lag("end").over(W.partitionBy(*keys).orderBy("end")))
    first = states.groupBy(*keys, "end").agg(F.min("known_from").alias("first_known"), F.min_by("value", "known_from").alias("first_value"))
    ends = facts.select(*keys, "end").distinct().withColumn("linked", step.between(*QUARTER)).join(first, [*keys, "end"], "left")
    later = last.join(ends, [*keys]).filter("end > last_end and (not linked or first_known is null or first_known >= decision)")
    stop = later.groupBy(*keys, "decision").agg(F.min_by(F.struct("end", "linked", "first_known", "first_value"), "end").alias("n"))
    out = decisions.join(last, [*keys, "decision"], "left").join(stop, [*keys, "decision"], "left").withColumn("base", base(F.col("n.end")))
    matured = F.col("n.linked") & F.col("n.first_known").isNotNull() & (F.col("base") > 0) & (F.col("n.first_value") > 0)
    return out.select(
        *keys, "decision", "last_end", F.when(matured, F.col("n.end")).alias("next_end"), F.when(matured, F.col("n.first_known")).alias("known_on"),
        F.when(matured, F.log(F.col("n.first_value") / F.col("base")) - F.col("last_growth")).alias("acceleration"),
    )


#: The forms of annual reports, which alone define a fiscal year.
ANNUAL_FORMS = ("10-K", "10-K/A", "10-KT", "20-F", "20-F/A", "40-F")


def fiscal_year_starts(facts: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``keys, fy_start``: the start of every year that an annual report carried, and the day after its end."""
    years = facts.filter(F.col("form").isin(*ANNUAL_FORMS) & (F.datediff("end", "start") + 1).between(*YEAR))
    return years.select(*keys, F.explode(F.array(F.col("start"), F.date_add("end", 1))).alias("fy_start")).distinct()


def quarter_plans(facts: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """How each quarter can be had: ``keys, start, end, long_start, short_end, fiscal_year, fiscal_quarter``.

    Quarters are the steps between the year-to-date ends of a fiscal year; a step of another length is left as a gap. ``long_start`` is the start of both
    legs (NULL where only a direct fact can tell: first quarters, and three-month facts outside of any chain), ``short_end`` the end of the shorter one.
    """
    periods = facts.filter("start is not null").select(*keys, "start", "end").distinct()
    starts = fiscal_year_starts(facts, keys)
    chain = periods.join(starts.withColumnRenamed("fy_start", "start"), [*keys, "start"]).filter(F.datediff("end", "start") + 1 <= YEAR[1])
    chain = chain.withColumn("before", F.coalesce(F.lag("end").over(W.partitionBy(*keys, "start").orderBy("end")), F.date_sub("start", 1))).filter(F.datediff("end", "before").between(*QUARTER))
    legs = F.when(F.date_add("before", 1) != F.col("start"), F.struct(F.col("start").alias("long_start"), F.col("before").alias("short_end")))
    steps = chain.select(*keys, F.date_add("before", 1).alias("q"), "end", legs.alias("legs"), F.col("start").alias("year")).withColumnRenamed("q", "start")
    alone = periods.filter((F.datediff("end", "start") + 1).between(*QUARTER))
    plans = steps.unionByName(alone, allowMissingColumns=True).groupBy(*keys, "start", "end").agg(F.max_by("legs", F.coalesce("year", F.to_date(F.lit("0001-01-01")))).alias("legs"))
    plans = plans.select(*keys, "start", "end", "legs.long_start", "legs.short_end")
    owner = plans.join(starts, [*keys]).filter((F.col("fy_start") <= F.col("start")) & (F.datediff("end", "fy_start") + 1 <= YEAR[1]))  # the few years of one company
    owner = owner.groupBy(*keys, "start", "end").agg(F.max("fy_start").alias("fy"))
    quarter = F.greatest(F.lit(1), F.bround((F.datediff("end", "fy") + 1) / 91.3).cast("int"))
    return plans.join(owner, [*keys, "start", "end"], "left").select(*keys, "start", "end", "long_start", "short_end", F.year(F.date_add("fy", 360)).alias("fiscal_year"), F.when(F.col("fy").isNotNull(), quarter).alias("fiscal_quarter"))


def quarterly_vintages(facts: DataFrame, keys: tuple[str, ...] = ("symbol",), tolerance: float = 0.01) -> DataFrame:
    """Every value that each quarter has had, one row a change: the columns of the plan and ``vintage`` (from 0), ``filed, method, value, form, accession, inputs, flag, confirmed_by``.

    Of one period and day the last report by (amendment, accession) counts. A direct fact wins; else the longer leg less the shorter one, both as of the same day.
    A quarter is read anew when its direct fact or its longer leg is filed; the shorter leg alone counts only for the first value. ``flag`` tells a direct
    fact that differs from the difference by more than ``tolerance``; ``confirmed_by`` lists the filings that gave the same value again.
    """
    plan, key = ["long_start", "short_end", "fiscal_year", "fiscal_quarter"], [*keys, "start", "end"]
    report = F.struct("filed", "accession", "form", "value")
    daily = facts.filter("start is not null").groupBy(*key, "filed").agg(F.max_by(report, F.struct(F.endswith("form", F.lit("/A")).alias("amended"), "accession")).alias("r"))
    legs = F.array(*[F.struct(F.lit(n).alias("leg"), F.col(a).alias("__s"), F.col(z).alias("__e")) for n, a, z in (("d", "start", "end"), ("l", "long_start", "end"), ("s", "long_start", "short_end"))])
    wanted = quarter_plans(facts, keys).select(*key, *plan, F.explode(legs).alias("w")).select(*key, *plan, "w.*").filter("__s is not null")
    events = wanted.join(daily.withColumnsRenamed({"start": "__s", "end": "__e"}), [*keys, "__s", "__e"])
    days = events.groupBy(*key, *plan, "filed").agg(*[F.max(F.when(F.col("leg") == x, F.col("r"))).alias(x) for x in "dls"])
    by_day = W.partitionBy(*key).orderBy("filed")
    seen = days.withColumn("asks", F.col("d").isNotNull() | F.col("l").isNotNull()).withColumns({x: F.last(x, ignorenulls=True).over(by_day.rowsBetween(W.unboundedPreceding, 0)) for x in "dls"})
    both = F.col("l").isNotNull() & F.col("s").isNotNull()
    seen = seen.filter(F.col("d").isNotNull() | both)
    difference = F.when(both, F.col("l.value") - F.col("s.value"))
    way = F.when((F.datediff("end", "long_start") + 1).between(*YEAR), "fy_minus_9m").otherwise("ytd_diff")
    newer = F.when(F.struct("s.filed", "s.accession") > F.struct("l.filed", "l.accession"), F.col("s")).otherwise(F.col("l"))
    gap = F.abs(F.col("d.value") - difference) / F.when(F.col("d.value") != 0, F.abs("d.value")).otherwise(1.0)
    direct = F.col("d").isNotNull()
    read = seen.withColumns({
        "value": F.when(direct, F.col("d.value")).otherwise(difference), "method": F.when(direct, "direct").otherwise(way), "source": F.when(direct, F.col("d")).otherwise(newer),
        "inputs": F.when(direct, F.array("d.accession")).otherwise(F.array("s.accession", "l.accession")),
        "flag": F.when(direct & (gap > tolerance), F.concat(F.lit("direct_vs_"), way, F.lit("_mismatch_"), F.format_string("%.3f", gap))),
    })
    read = read.withColumn("place", F.row_number().over(by_day)).filter("asks or place = 1")
    new = F.lag("value").over(by_day).isNull() | (F.lag("value").over(by_day) != F.col("value"))
    read = read.withColumn("new", new).withColumn("vintage", F.sum(F.col("new").cast("int")).over(by_day.rowsBetween(W.unboundedPreceding, 0)) - 1)
    kept = [*plan, "value", "method", "inputs", "flag"]
    first = F.min_by(F.struct("filed", *kept, F.col("source.form").alias("form"), F.col("source.accession").alias("accession")), "filed").alias("f")
    again = F.transform(F.array_sort(F.collect_list(F.struct("filed", "source.accession"))), lambda r: r["accession"])
    return read.groupBy(*key, "vintage").agg(first, F.array_distinct(again).alias("confirmed_by")).select(*key, "vintage", "f.*", "confirmed_by")


def annual_vintages(facts: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Every value that each year-long period has had: ``keys, start, end, vintage`` (from 0), ``filed, value, form, accession, fiscal_year, confirmed_by``."""
    key = [*keys, "start", "end"]
    years = facts.filter((F.datediff("end", "start") + 1).between(*YEAR))
    report = F.struct("value", "form", "accession")
    daily = years.groupBy(*key, "filed").agg(F.max_by(report, F.struct(F.endswith("form", F.lit("/A")).alias("amended"), "accession")).alias("r")).select(*key, "filed", "r.*")
    by_day = W.partitionBy(*key).orderBy("filed")
    new = F.lag("value").over(by_day).isNull() | (F.lag("value").over(by_day) != F.col("value"))
    numbered = daily.withColumn("new", new.cast("int")).withColumn("vintage", F.sum("new").over(by_day.rowsBetween(W.unboundedPreceding, 0)) - 1)
    again = F.transform(F.array_sort(F.collect_list(F.struct("filed", "accession"))), lambda r: r["accession"])
    g = numbered.groupBy(*key, "vintage").agg(F.min_by(F.struct("filed", "value", "form", "accession"), "filed").alias("f"), F.array_distinct(again).alias("confirmed_by"))
    return g.select(*key, "vintage", "f.*", F.year(F.date_add("start", 360)).alias("fiscal_year"), "confirmed_by")


def growth_rows(vintages: DataFrame, keys: tuple[str, ...] = ("symbol",), *, quarterly: bool = True, length_tolerance: int = 10) -> DataFrame:
    """Growth of each period anew on every day on which one of its inputs changed, from what was filed by then.

    ``vintages``: ``keys, start, end, vintage, filed, value, accession, confirmed_by``. Inputs are the period, the one a quarter before (of quarters), the one a year
    before, and the year before the former (of years: the latter). A prior period ends latest in the range and is of like length; growth over a base that
    is missing or not positive is NULL. ``same_filing``: the filing behind the value also reported the year-ago value.
    """
    key = [*keys, "start", "end"]
    periods = vintages.groupBy(*keys).agg(F.collect_set(F.struct("start", "end")).alias("all"))  # the periods of one company
    size = lambda p: F.datediff(p["end"], p["start"])

    def prior(p, low, high):
        gap = lambda x: F.datediff(p["end"], x["end"])
        fit = F.filter("all", lambda x: gap(x).between(low, high) & (F.abs(size(x) - size(p)) <= length_tolerance))
        best = F.array_max(F.transform(fit, lambda x: F.struct(x["end"].alias("e"), size(x).alias("size"), x["start"].alias("s"))))
        return F.when(best.isNotNull(), F.struct(best["s"].alias("start"), best["e"].alias("end")))

    linked = periods.withColumn("p", F.explode("all")).withColumn("py", prior(F.col("p"), *YEAR))
    linked = linked.withColumn("pq", prior(F.col("p"), *QUARTER) if quarterly else F.lit(None).cast(linked.schema["py"].dataType))
    linked = linked.withColumn("pqy", prior(F.col("pq" if quarterly else "py"), *YEAR)).select(*keys, "p.*", "pq", "py", "pqy")
    roles = F.array(*[F.struct(F.lit(r).alias("role"), s.alias("s"), e.alias("e")) for r, s, e in [("c", F.col("start"), F.col("end")), *((r, F.col(f"{r}.start"), F.col(f"{r}.end")) for r in ("pq", "py", "pqy"))]])
    wanted = linked.select(*key, F.explode(roles).alias("w")).filter("w.e is not null").select(*key, "w.*")
    row = F.struct("filed", "vintage", "value", "accession", "confirmed_by")
    events = wanted.join(vintages.select(*keys, F.col("start").alias("s"), F.col("end").alias("e"), "filed", "vintage", row.alias("v")), [*keys, "s", "e"])
    names = ("c", "pq", "py", "pqy")
    days = events.groupBy(*key, "filed").agg(*[F.max_by(F.when(F.col("role") == r, F.col("v")), F.when(F.col("role") == r, F.col("vintage"))).alias(r) for r in names])
    by_day = W.partitionBy(*key).orderBy("filed")
    known = days.withColumns({r: F.last(r, ignorenulls=True).over(by_day.rowsBetween(W.unboundedPreceding, 0)) for r in names}).filter("c is not null")
    known = known.withColumn("signature", F.struct(*[F.col(f"{r}.value").alias(r) for r in names]))
    changed = known.withColumn("same", F.lag("signature").over(by_day).eqNullSafe(F.col("signature"))).filter("not same")
    growth = lambda a, b: F.when(F.col(f"{b}.value") > 0, F.col(f"{a}.value") / F.col(f"{b}.value") - 1)
    used = F.array_compact(F.array(*[F.struct(F.col(f"{r}.filed").alias("filed"), F.col(f"{r}.accession").alias("accession")) for r in names]))
    newest = F.array_max(F.filter(used, lambda u: u["filed"].isNotNull()))
    out = changed.select(
        *key, "filed", newest["accession"].alias("accession"), F.col("c.value").alias("value"), F.col("pq.value").alias("prior_quarter_value"), F.col("py.value").alias("prior_year_value"), growth("c", "pq").alias("qoq"),
        growth("c", "py").alias("yoy"), growth("pq" if quarterly else "py", "pqy").alias("yoy_prev"), newest["filed"].alias("inputs_max_filed"), F.when(F.col("py").isNotNull(), F.array_contains("py.confirmed_by", F.col("c.accession"))).alias("same_filing"),
    )
    return out.withColumn("yoy_accel", F.col("yoy") - F.col("yoy_prev"))
