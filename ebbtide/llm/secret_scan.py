r"""Secrets in texts: fixed patterns first, then strings that look random.

Two first-order Markov models over characters, one of random strings and one of
ordinary identifiers, are counted over all texts: from the values that the
patterns find, and from plain words, each as often as it stands. A candidate is
added where the log-likelihood ratio per character transition is above a limit
that ordinary words almost never reach.

DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.ordering import running_totals, settle

# Kind, pattern, group that holds the value, least length of the value.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 4, 8),
    # a run that is too short holds no longer match, so the least length may stand in the pattern
    ("access", r"(AKIA[A-Z0-9]{12,})", 2, 16),
    ("hex", r"([0-9a-f]{32,})", 2, 32),
)
MODEL = "model"
CANDIDATE = r"([A-Za-z0-9+/_=-]{16,})"
ORDINARY = r"(?<![A-Za-z0-9+/_=.-])([A-Za-z][A-Za-z_]{5,})(?![A-Za-z0-9+/_=])"
#: Share of all ordinary words that may pass the limit, and the least limit, in nats per transition.
PASS, LEAST = 0.0005, 0.35
SMOOTHING = 0.5
RUN = 256
CODES = 128


def matches(text: Column, pattern: str, value_group: int) -> Column:
    """array<struct<start, stop, value>> of the leftmost, non-overlapping matches, in code points.

    Every match is read together with the gap before it; \\G keeps the search
    at the end of the last match, so a text is passed over once.
    """
    whole = F.lit(r"(?s)\G(.*?)(" + pattern + ")")
    rows = F.arrays_zip(
        F.regexp_extract_all(text, whole, F.lit(1)).alias("gap"),
        F.regexp_extract_all(text, whole, F.lit(2)).alias("all"),
        F.regexp_extract_all(text, whole, F.lit(value_group)).alias("value"),
    )
    kind = "array<struct<start:int,stop:int,value:string>>"

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + F.length(m["gap"])
        stop = start + F.length(m["all"])
        found = F.struct(start.alias("start"), stop.alias("stop"), m["value"].alias("value"))
        return F.struct(stop.alias("at"), F.array_append(state["found"], found).alias("found"))

    def run(state: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(state["at"].alias("at"), F.array().cast(kind).alias("found")), step)
        return F.struct(inner["at"].alias("at"), F.array_append(state["found"], inner["found"]).alias("found"))

    # appending copies, so matches are gathered in runs of RUN
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)), F.lit(RUN)), lambda i: F.slice(rows, i, RUN))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("found"))
    read = F.flatten(F.aggregate(parts, empty, run)["found"])
    return F.when(F.regexp_like(text, F.lit(pattern)), read).otherwise(F.array().cast(kind))


def _span(match: Column, place: int, kind: str) -> Column:
    return F.struct(
        match["start"].alias("start"), F.lit(place).alias("place"), match["stop"].alias("stop"), F.lit(kind).alias("kind"), match["value"].alias("value")
    )


def base_spans(text: Column) -> Column:
    """array<struct<start, place, stop, kind, value>> of the fixed kinds, by start, then kind as listed."""

    def of(place: int, kind: str, pattern: str, group: int, least: int) -> Column:
        found = matches(text, pattern, group)
        kept = F.filter(found, lambda m: F.length(m["value"]) >= least)
        return F.transform(kept, lambda m: _span(m, place, kind))

    return F.sort_array(F.concat(*(of(place, *kind) for place, kind in enumerate(KINDS))))


def _transitions(strings: DataFrame, weight: str) -> DataFrame:
    """(pair, weight): how often one character code follows another in (string, n), a string counting n times."""
    codes = F.transform(F.split("string", ""), F.ascii)
    seen = strings.select(codes.alias("codes"), "n").where("size(codes) > 1")
    pairs = F.arrays_zip(F.slice("codes", 1, F.size("codes") - 1).alias("a"), F.slice("codes", 2, F.size("codes") - 1).alias("b"))
    return (
        seen.select(F.explode(pairs).alias("p"), "n")
        .select((F.col("p.a") * CODES + F.col("p.b")).alias("pair"), "n")
        .where(F.col("pair").between(0, CODES * CODES - 1))
        .groupBy("pair")
        .agg(F.sum("n").alias(weight))
    )


def ratio_table(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) at a * CODES + b; CODES squared numbers, whatever the input."""
    both = _transitions(random, "r").join(_transitions(ordinary, "o"), "pair", "full").fillna(0, ["r", "o"]).collect()
    seen = {x["pair"]: (x["r"], x["o"]) for x in both}
    symbols = sorted(ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.")
    out = [0.0] * (CODES * CODES)
    for a in symbols:
        rows = [seen.get(a * CODES + b, (0, 0)) for b in symbols]
        r_all, o_all = (sum(x[i] for x in rows) + SMOOTHING * len(symbols) for i in (0, 1))
        for b, (r, o) in zip(symbols, rows, strict=True):
            out[a * CODES + b] = math.log((r + SMOOTHING) / r_all) - math.log((o + SMOOTHING) / o_all)
    return out


def mean_ratio(string: Column, table: list[float]) -> Column:
    """Log-likelihood ratio per transition of a string of ASCII characters."""
    numbers = F.split(F.lit(",".join(f"{x:.9g}" for x in table)), ",").cast("array<double>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(state: Column, code: Column) -> Column:
        more = F.when(state["last"] < 0, F.lit(0.0)).otherwise(F.coalesce(F.get(numbers, state["last"] * CODES + code), F.lit(0.0)))
        return F.struct(code.alias("last"), (state["sum"] + more).alias("sum"))

    total = F.aggregate(F.transform(F.split(string, ""), F.ascii), start, step)["sum"]
    return total / F.greatest(F.length(string) - 1, F.lit(1))


def ratio_limit(ordinary: DataFrame, table: list[float]) -> float:
    """The ratio that all but PASS of the words of (string, n) stay within, LEAST at least; exact, with one row per distinct ratio."""
    ranked = running_totals(ordinary.select(mean_ratio(F.col("string"), table).alias("ratio"), "n"), "ratio", {"n": F.col("n")})
    limit = ranked.where(F.col("cum_n") >= (1 - PASS) * F.col("total_n")).agg(F.min("ratio")).first()[0]
    return max(LEAST, limit if limit is not None else LEAST)


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, base and spans (array<struct<start, place, stop, kind, value>>) for every row.

    `base` are the fixed patterns' matches, `spans` those and the model's, which
    never overlap a base span. Null texts are empty; empty texts hold nothing.
    Without a random sample the model adds nothing. Offsets are code points,
    ends exclusive. Repeated rows are kept, extra columns ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"))
    apart = lambda spans: F.filter(
        spans, lambda c: ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
    )
    # one row per distinct string of either kind with its count
    found = rows.where("body != ''").select(base_spans(F.col("body")).alias("base"), "body")
    side = lambda values, plain: F.transform(values, lambda v: F.struct(F.lit(plain).alias("plain"), v.alias("string")))
    # places of words matter only where there are base spans
    words = F.when(F.size("base") == 0, F.regexp_extract_all("body", F.lit(ORDINARY), F.lit(1))).otherwise(
        apart(matches(F.col("body"), ORDINARY, 2))["value"]
    )
    strings = settle(found.select(F.explode(F.concat(side(F.col("base")["value"], False), side(words, True))).alias("s")).groupBy("s.plain", "s.string").agg(F.count("*").alias("n")))
    random = strings.where("not plain").select("string", F.lit(1).cast("bigint").alias("n"))
    ordinary = strings.where("plain").select("string", "n")
    added = F.array().cast("array<struct<start:int,place:int,stop:int,kind:string,value:string>>")
    if random.limit(1).count():
        table = ratio_table(random, ordinary)
        limit = ratio_limit(ordinary, table)
        picked = F.filter(apart("candidates"), lambda c: mean_ratio(c["value"], table) > limit)
        added = F.transform(picked, lambda c: _span(c, len(KINDS), MODEL))
    read = rows.select("doc_id", base_spans(F.col("body")).alias("base"), matches(F.col("body"), CANDIDATE, 2).alias("candidates"))
    return read.select("doc_id", "base", F.sort_array(F.concat("base", added)).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans as text."""
    line = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ","
    )
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.col("spans")).alias("spans")
    )
