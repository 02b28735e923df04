"""Claim outcomes: what became of assessed claim lines, from an unordered list of events.

An event moves a claim line from one state to another; an event that its state
doesn't allow is passed over.  Which events count therefore depends on all earlier
ones.  It is still worked out in parts: a block of events is a mapping of states
to states, mappings are composed, and so each block learns the state in which it
begins without waiting for the events before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricebench.functions.numeric import exact_sum

STATES = ("none", "open", "offered", "negotiated", "paid as quoted", "disputed")
CLOSED = ("negotiated", "paid as quoted")

#: From which states an event leads where; any other event changes nothing.
TRANSITIONS = {
    "saved": {"none": "open"},
    "offered": {"open": "offered", "offered": "offered", "disputed": "offered"},
    "negotiated": {"open": "negotiated", "offered": "negotiated", "disputed": "negotiated"},
    "paid": {"open": "paid as quoted", "offered": "paid as quoted"},
    "disputed": {"open": "disputed", "offered": "disputed", "negotiated": "disputed"},
    "reopened": {"negotiated": "open", "paid as quoted": "open"},
}
#: Closed cases below which a portfolio is advisory.
LEAST_CASES = 10
_BLOCK = 256
_LINE = ["claim_ref", "line_no"]


def _steps(kind: Column) -> Column:
    """For an event kind, where it leads from each state; -1 where it doesn't apply."""
    def row(name: str) -> Column:
        return F.array(*[F.lit(STATES.index(TRANSITIONS[name][s]) if s in TRANSITIONS[name] else -1) for s in STATES])

    table = F.create_map(*[x for name in TRANSITIONS for x in (F.lit(name), row(name))])
    return F.coalesce(F.try_element_at(table, kind), F.array(*[F.lit(-1)] * len(STATES)))


def _after(state: Column, steps: Column) -> Column:
    to = F.element_at(steps, state + 1)
    return F.when(to >= 0, to).otherwise(state)


def histories(events: DataFrame) -> DataFrame:
    """One row per event that counts or not: claim_ref, line_no, event_id, at, kind, amount, nth, state_before, state, accepted.

    ``events``: claim_ref, line_no, event_id, at, kind, amount, in any order.  An
    event_id that comes twice counts once, with the smallest of its times, kinds and
    amounts; events of one time go by event_id.  Events without line, id or time
    take no part; unknown kinds never apply.
    """
    keyed = events.where(F.col("claim_ref").isNotNull() & F.col("line_no").isNotNull() & F.col("event_id").isNotNull() & F.col("at").isNotNull())
    # Dealt out by line once, for repeats as well as for the order of a line's events.
    once = keyed.repartition(*_LINE).groupBy(*_LINE, "event_id").agg(F.min(F.struct("at", "kind", "amount")).alias("e")).select(*_LINE, "event_id", "e.*")
    order = Window.partitionBy(*_LINE).orderBy("at", "event_id")
    placed = once.withColumn("nth", F.row_number().over(order)).withColumn("block", F.floor((F.col("nth") - 1) / _BLOCK))
    event = F.struct("nth", "event_id", "at", "kind", "amount", _steps(F.col("kind")).alias("steps"))
    blocks = placed.groupBy(*_LINE, "block").agg(F.array_sort(F.collect_list(event)).alias("events"))  # at most _BLOCK events

    same = F.array(*[F.lit(i) for i in range(len(STATES))])
    mapped = F.aggregate("events", same, lambda m, e: F.transform(m, lambda s: _after(s, e["steps"])))
    earlier = Window.partitionBy(*_LINE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.aggregate(F.collect_list(mapped).over(earlier), F.lit(0), lambda s, m: F.element_at(m, s + 1))
    states = F.aggregate("events", F.array(F.col("begin")), lambda done, e: F.concat(done, F.array(_after(F.element_at(done, -1), e["steps"]))))
    told = blocks.withColumn("begin", begun).withColumn("states", states)
    rows = told.select(*_LINE, F.inline(F.arrays_zip("events", F.slice("states", 1, F.size("events")).alias("before"), F.slice("states", 2, F.size("events")).alias("after"))))
    name = F.array(*[F.lit(s) for s in STATES])
    return rows.select(*_LINE, "events.event_id", "events.at", "events.kind", "events.amount", "events.nth", F.element_at(name, F.col("before") + 1).alias("state_before"),
                       F.element_at(name, F.col("after") + 1).alias("state"), (F.element_at(F.col("events.steps"), F.col("before") + 1) >= 0).alias("accepted"))


def intervals(history: DataFrame) -> DataFrame:
    """(claim_ref, line_no, state, since, until): how long a claim line was in each state; the last one is open-ended."""
    order = Window.partitionBy(*_LINE).orderBy("nth")
    return history.where("accepted").select(*_LINE, "state", F.col("at").alias("since"), F.lead("at").over(order).alias("until"))


def outcomes(history: DataFrame) -> DataFrame:
    """One row per claim line: its state, since when, the last amount that counted, and how many events were passed over."""
    counts = F.col("accepted")
    last = F.max(F.when(counts, F.struct("nth", "state", "at")))
    amount = F.max(F.when(counts & F.col("amount").isNotNull(), F.struct("nth", "amount")))
    rows = history.groupBy(*_LINE).agg(last.alias("l"), amount.alias("a"), F.count_if(counts).alias("events"), F.count_if(~counts).alias("passed_over"))
    return rows.select(*_LINE, F.coalesce("l.state", F.lit(STATES[0])).alias("state"), F.col("l.at").alias("since"), F.col("a.amount").alias("amount"), "events", "passed_over")


def case_report(assessed: DataFrame, settled: DataFrame) -> DataFrame:
    """One row per claim: estimate, benchmark and final amounts of its closed lines, and what was saved.

    ``assessed``: claim_ref, line_no, quoted, bench, above_bound.  A line paid as
    quoted without an amount is final at its quote; closed lines without any amount
    count in ``unpriced`` only.  ``realised`` is what the final amount is below the
    estimate, never less than nothing; ``benchmark_error`` is the benchmark's
    distance from the final amount in per cent of it, over lines that have both.
    """
    lines = assessed.join(settled, _LINE).where(F.col("state").isin(*CLOSED))
    final = F.coalesce("amount", F.when(F.col("state") == "paid as quoted", F.col("quoted")))
    lines = lines.withColumn("final", final)
    both = F.col("final").isNotNull() & F.col("bench").isNotNull()
    rows = lines.groupBy("claim_ref").agg(
        F.count("*").alias("closed"), F.count_if(F.col("final").isNull()).alias("unpriced"),
        exact_sum(F.when(F.col("final").isNotNull(), F.col("quoted"))).alias("estimate"), exact_sum(F.col("bench")).alias("benchmark"), exact_sum(F.col("final")).alias("final"),
        exact_sum(F.when(F.col("final").isNotNull(), F.greatest(F.col("quoted") - F.col("final"), F.lit(0.0)))).alias("realised"),
        exact_sum(F.when(both, F.abs(F.col("bench") - F.col("final")))).alias("_off"), exact_sum(F.when(both, F.col("final"))).alias("_of"))
    return rows.select("claim_ref", "closed", "unpriced", "estimate", "benchmark", "final", "realised", F.try_divide(F.col("_off") * 100, F.col("_of")).alias("benchmark_error"))


def portfolio(assessed: DataFrame, settled: DataFrame, least_cases: int = LEAST_CASES) -> DataFrame:
    """One row over all claims: totals, measured inflation, and how lines that were flagged fared.

    ``potential`` is what the quotes of closed lines are above the benchmark,
    ``realised`` what was in fact saved; ``flagged_down`` is the share of lines above
    the bound that closed below their quote, ``others_down`` that of all others.
    """
    lines = assessed.join(settled, _LINE).where(F.col("state").isin(*CLOSED)).withColumn(
        "final", F.coalesce("amount", F.when(F.col("state") == "paid as quoted", F.col("quoted")))).where("final IS NOT NULL")
    above = F.coalesce("above_bound", F.lit(False))
    down = F.col("final") < F.col("quoted")
    counts = {"flagged": above, "flagged_lower": above & down, "others": ~above, "others_lower": ~above & down}
    money = {"estimate": F.col("quoted"), "final": F.col("final"), "realised": F.greatest(F.col("quoted") - F.col("final"), F.lit(0.0)),
             "potential": F.greatest(F.col("quoted") - F.col("bench"), F.lit(0.0))}
    cases = lines.groupBy("claim_ref").agg(F.count("*").alias("lines"), *[F.count_if(c).alias(n) for n, c in counts.items()], *[exact_sum(m).alias(n) for n, m in money.items()])
    rows = cases.agg(F.count("*").alias("cases"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("lines", *counts)], *[exact_sum(F.col(n)).alias(n) for n in money])
    return rows.select(
        "cases", "lines", "estimate", "final", "realised", "potential", F.try_divide((F.col("estimate") - F.col("final")) * 100, F.col("final")).alias("inflation"), "flagged",
        F.try_divide("flagged_lower", "flagged").alias("flagged_down"), F.try_divide("others_lower", "others").alias("others_down"), (F.col("cases") < least_cases).alias("advisory"))
