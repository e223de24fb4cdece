"""Operator 9: secret scans with a battery of randomness tests, in DataFrame operations only.

Base findings are pattern matches (``assign``, ``access``, ``hex``). The battery adds spans of kind ``random``: every
free-standing run of 20 or more characters of ``[A-Za-z0-9+/_-]`` that no base finding overlaps is a candidate. Its
encoding is inferred from its characters (hexadecimal, base32, letters of one or both cases with or without digits,
base64; an '=' before a run, as in NAME=value, does not belong to it), each symbol gets its value in
that alphabet, and three tests ask whether the symbols look drawn at random: chi-squared for uniform use of 8 equal
classes of the alphabet (single letters where there is one case and no digit), runs above and below the middle, and serial correlation of neighbours. Each test gives
a z value; the sum of squares gives one p value (chi-squared with 3 degrees of freedom, large when it looks random).

Random strings have uniform p values, words have p values near 0. Within a class of lengths and encoding the share of
random strings is read off the p values above one half. A cut-off is refused only if, by two standard errors, more than
``fdr`` of the candidates above it are false ones; so a class of few candidates, whose counts say little, keeps all with p
of 0.02 and more, and a dense one is cut by its counts (the length classes keep short strings,
whose tests are weak, from borrowing from long ones). The counts are a histogram of fixed size, so nothing is collected.

Defined cases: null texts count as empty and have no spans; overlapping base kinds are all kept; equal texts have equal
base spans; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.common import cut

#: The base patterns and the shortest match that counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: From frequent to rare in texts, so that words, which favour frequent letters, fill the first classes of the alphabet.
_OFTEN = "enitsrahulcodgmpbfvwkzyqxj"
#: In order of trial; what fits none is base64.
ENCODINGS = {
    "hex": "^([0-9a-f]+|[0-9A-F]+)$", "upper": "^[A-Z]+$", "base32": "^[A-Z2-7]+$", "upper36": "^[A-Z0-9]+$", "lower": "^[a-z]+$",
    "lower36": "^[a-z0-9]+$", "letters": "^[A-Za-z]+$", "alnum": "^[A-Za-z0-9]+$",
}
ALPHABETS = {
    "hex": _DIGITS + "abcdef", "upper": _OFTEN.upper(), "base32": _UPPER + "234567", "upper36": _OFTEN.upper() + _DIGITS, "lower": _OFTEN,
    "lower36": _OFTEN + _DIGITS, "letters": _UPPER + _LOWER, "alnum": _UPPER + _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + "+/",
}
BINS = 50
FDR = 0.2
#: Candidates below this bin (p < 0.02) are reported only where the counts show that nearly the whole class is random.
FLOOR = 1


def match_spans(text: Column, pattern: str, kind: str, order: int, long_enough=None) -> Column:
    """Spans (start, order, kind, end) in code points of the leftmost non-overlapping matches.

    The texts between matches and the matches themselves alternate, so adding up their lengths gives the places.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lengths = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(matches, F.length).alias("run"), matches.alias("match"))
    span = lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(order).alias("o"), F.lit(kind).alias("kind"), (at + x["gap"] + x["run"]).alias("end"), x["match"].alias("match"))
    kept = f"array<struct<start:int,o:int,kind:string,end:int,match:string>>"  # noqa: F541
    folded = F.aggregate(
        F.slice(lengths, F.lit(1), F.size(matches)),
        F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {kept})").alias("spans")),
        lambda acc, x: F.struct((acc["at"] + x["gap"] + x["run"]).alias("at"), F.concat(acc["spans"], F.array(span(acc["at"], x))).alias("spans")),
        lambda acc: acc["spans"],
    )
    found = folded if long_enough is None else F.filter(folded, lambda s: long_enough(s["match"]))
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as {kept})"))


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    assign = match_spans(text, ASSIGN, "assign", 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= SHORTEST["assign"])
    access = match_spans(text, ACCESS, "access", 1, lambda m: F.length(m) >= SHORTEST["access"])
    # a run of fewer than 24 characters would be dropped, so the run pattern asks for them at once
    hexes = match_spans(text, HEX[:-1] + "{%d,}" % SHORTEST["hex"], "hex", 2)
    return assign, access, hexes


def _let(value: Column, body) -> Column:
    """Bind a value once inside a larger expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def symbol_values(token: Column) -> Column:
    """struct(encoding, size of the alphabet, value of each symbol) of a token; the first alphabet that has all its symbols."""
    encoding, alphabet, plain = F.lit("base64"), F.lit(ALPHABETS["base64"]), F.translate(token, "-_", "+/")
    for name, pattern in reversed(ENCODINGS.items()):
        fits = token.rlike(pattern)
        encoding, alphabet = F.when(fits, name).otherwise(encoding), F.when(fits, ALPHABETS[name]).otherwise(alphabet)
        plain = F.when(fits, F.lower(token) if name == "hex" else token).otherwise(plain)
    values = _let(alphabet, lambda a: F.transform(F.split(plain, ""), lambda c: F.instr(a, c) - 1))
    return F.struct(encoding.alias("encoding"), F.length(alphabet).cast("double").alias("m"), values.alias("v"))


def _falls_in(m: Column, k: int):
    return lambda x: F.floor(x * 8 / m) == k


def battery(token: Column) -> Column:
    """struct(encoding, n, chi2, runs_z, serial_z, p) of a token of two or more symbols."""

    def tests(s: Column) -> Column:
        m, v = s["m"], s["v"]
        n, mid = F.size(v).cast("double"), (s["m"] - 1) / 2.0
        chi = F.lit(0.0)
        for k in range(8):  # class widths differ by a symbol where 8 does not divide the alphabet
            width = F.ceil((k + 1) * m / 8) - F.ceil(k * m / 8)
            expected = n * width / m
            seen = F.size(F.filter(v, _falls_in(m, k)))
            chi = chi + (seen - expected) * (seen - expected) / expected
        # 26 letters of one case: each letter is a class of its own, as words repeat their letters in any language
        squares = F.aggregate(F.sequence(F.lit(0), F.lit(25)), F.lit(0.0), lambda t, k: t + F.pow(F.size(F.filter(v, lambda x: x == k)).cast("double"), F.lit(2.0)))
        chi = F.when(m == 26, squares * 26 / n - n).otherwise(chi)
        pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        turns = F.size(F.filter(pairs, lambda x: (x["a"] > mid) != (x["b"] > mid))) + 1.0
        cross = F.aggregate(pairs, F.lit(0.0), lambda t, x: t + (x["a"] - mid) * (x["b"] - mid))
        high = F.size(F.filter(v, lambda x: x > mid)).cast("double")
        return F.struct(s["encoding"].alias("encoding"), n.alias("n"), m.alias("m"), chi.alias("chi2"), turns.alias("turns"), cross.alias("cross"), high.alias("high"), F.when(m == 26, 25.0).otherwise(7.0).alias("freedom"))

    def scores(t: Column) -> Column:
        mean = 1 + 2 * t["high"] * (t["n"] - t["high"]) / t["n"]
        var = (mean - 1) * (mean - 2) / (t["n"] - 1)
        runs_z = F.when(var > 1e-9, (t["turns"] - mean) / F.sqrt(var)).otherwise(6.0)
        serial_z = t["cross"] / ((t["m"] * t["m"] - 1) / 12.0 * F.sqrt(t["n"] - 1))
        return F.struct(t["encoding"].alias("encoding"), t["n"].cast("int").alias("n"), t["chi2"].alias("chi2"), t["freedom"].alias("freedom"), runs_z.alias("runs_z"), serial_z.alias("serial_z"))

    def combined(z: Column) -> Column:
        # Wilson-Hilferty turns a chi-squared value into a normal deviate; the last line is a logistic normal tail
        spread = 2 / (9 * z["freedom"])
        chi_z = (F.pow(z["chi2"] / z["freedom"], F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
        square = F.greatest(chi_z, F.lit(0.0)) * chi_z + z["runs_z"] * z["runs_z"] + z["serial_z"] * z["serial_z"]
        deviate = (F.pow(F.greatest(square, F.lit(1e-9)) / 3, F.lit(1 / 3)) - (1 - 2 / 27)) / (2 / 27) ** 0.5
        p = _let(deviate, lambda d: 1 / (1 + F.exp(F.least(1.5976 * d + 0.070566 * d * d * d, F.lit(600.0)))))
        return F.struct(z["encoding"].alias("encoding"), z["n"].alias("n"), z["chi2"].alias("chi2"), z["runs_z"].alias("runs_z"), z["serial_z"].alias("serial_z"), p.alias("p"))

    return _let(_let(_let(symbol_values(token), tests), scores), combined)


def _class(test: Column) -> tuple[Column, Column, Column]:
    length_class = F.least(F.floor(F.log2(test["n"] / 20.0) * 2), F.lit(12)).cast("int")
    return test["encoding"], length_class, F.least(F.floor(test["p"] * BINS), F.lit(BINS - 1)).cast("int")


def bin_limits(counts: DataFrame, fdr: float = FDR) -> DataFrame:
    """Per class the lowest bin from which on candidates are reported: ``encoding, length_class, lowest``.

    Every bin is a possible cut-off, also one that holds no candidate. ``high`` candidates with p of one half and more
    stand for twice as many random ones, with a standard error of at most the root of the candidates above the cut-off.
    """
    cutoffs = F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("cutoff")
    c = counts.select("encoding", "length_class", "bin", "count", cutoffs).groupBy("encoding", "length_class", "cutoff").agg(
        F.sum(F.when(F.col("bin") >= F.col("cutoff"), F.col("count")).otherwise(0)).alias("at_least"),
        F.sum(F.when(F.col("bin") >= BINS // 2, F.col("count")).otherwise(0)).alias("high"),
    )
    error = F.sqrt("at_least")
    margin = F.when(F.col("cutoff") < FLOOR, -error).otherwise(2 * error)
    expected = (2.0 * F.col("high") + margin) * (1 - F.col("cutoff") / BINS)
    # at one half and above all that is there counts as random
    passes = (F.col("at_least") > 0) & ((expected >= (1 - fdr) * F.col("at_least")) | (F.col("cutoff") >= BINS // 2))
    return c.filter(passes).groupBy("encoding", "length_class").agg(F.min("cutoff").alias("lowest"))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per document: ``doc_id, base, random``, arrays of spans (start, o, kind, end); ``random`` adds the tests."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign, access, hexes = base_spans(text)
    plain = lambda spans: F.transform(spans, lambda s: s.dropFields("match"))
    runs = match_spans(text, r"(?<![A-Za-z0-9+/_-])" + CANDIDATE + r"(?![A-Za-z0-9+/_-])", "random", 3)
    found = docs.select(F.col(id_col).alias("doc_id"), F.array_sort(F.concat(plain(assign), plain(access), plain(hexes))).alias("base"), runs.alias("runs"))
    free = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    tested = F.transform(free, lambda r: F.struct(r["start"].alias("start"), r["o"].alias("o"), r["kind"].alias("kind"), r["end"].alias("end"), battery(r["match"]).alias("test")))
    found = cut(found.select("doc_id", "base", tested.alias("random")))
    each = found.select(F.explode("random.test").alias("t"))
    encoding, length_class, bin_ = _class(F.col("t"))
    limits = bin_limits(each.groupBy(encoding.alias("encoding"), length_class.alias("length_class"), bin_.alias("bin")).count(), fdr)
    # at most 9 encodings x 13 length classes
    lowest = {(r["encoding"], r["length_class"]): r["lowest"] for r in limits.collect()}

    def passes(s: Column) -> Column:
        encoding, length_class, bin_ = _class(s["test"])
        ok = F.lit(False)
        for (e, k), b in sorted(lowest.items()):
            ok = ok | ((encoding == e) & (length_class == k) & (bin_ >= b))
        return ok

    return found.withColumn("random", F.filter("random", passes))


def secret_digest(docs: DataFrame, **options) -> DataFrame:
    """The columns of the query."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    found = scan_secrets(docs, **options)
    every = F.array_sort(F.concat("base", F.transform("random", lambda s: s.dropFields("test"))))
    return found.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"),
        F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(every).alias("spans"),
    )
