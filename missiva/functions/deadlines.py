"""Relative deadlines: finding them in text and resolving them against an anchor date.

The patterns of deadlines, recurrences and colloquial dates are fixed values, like the names of units and weekdays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of units and weekdays.
UNIT = r"(business day|working day|day|week|month)s?"
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _found(kind: Column, n: Column, unit: Column, direction: Column, anchor: Column, raw: Column) -> Column:
    low = F.lower(unit)
    name = F.when(low.rlike("business|working|工作日"), "businessdays").when(low.rlike("week|周"), "weeks").when(low.rlike("month|月"), "months").otherwise("days")
    return F.struct(raw.alias("raw"), kind.alias("kind"), n.cast("int").alias("n"), name.alias("unit"), direction.alias("direction"), F.trim(anchor).alias("anchor"))


def find_deadlines(text: Column) -> Column:
    """Array of ``{raw, kind, n, unit, direction, anchor}``: net N, within N, N units after or before, and Chinese forms."""
    t = F.coalesce(text, F.lit(""))
    every = lambda p: F.regexp_extract_all(t, F.lit(f"(?U){p}"), F.lit(0))
    g = lambda m, p, k: F.regexp_extract(m, f"(?U){p}", k)
    net = r"(?i)\bnet[\s-]?(\d{1,3})\b"
    within = rf"(?i)\bwithin\s+(\d{{1,3}})\s+{UNIT}(?:\s+(?:of|from|after)\s+([^.,;:\n]{{2,40}}))?\b"
    relative = rf"(?i)\b(\d{{1,3}})\s+{UNIT}\s+(after|before|from|prior to|following)\s+([^.,;:\n]{{2,40}})"
    cn_within, cn_after = r"(\d{1,3})\s*个?\s*(工作日|天|日|周|月)\s*内", r"(?:收到后|之后)\s*(\d{1,3})\s*个?\s*(工作日|天|日|周|月)"
    lit = F.lit

    def of_within(m: Column) -> Column:
        anchor = F.trim(g(m, within, 3))
        external = (anchor != "") & ~F.contains(F.lower(anchor), lit("receipt")) & ~F.lower(anchor).isin("now", "today")
        return _found(F.when(external, "relative").otherwise("within"), g(m, within, 1), g(m, within, 2), lit("after"), F.when(anchor == "", "now/receipt").otherwise(anchor), m)

    before = lambda m: F.when(F.lower(g(m, relative, 3)).isin("before", "prior to"), "before").otherwise("after")
    found = F.concat(
        F.transform(every(net), lambda m: _found(lit("net"), g(m, net, 1), lit("day"), lit("after"), lit("invoice/receipt"), m)),
        F.transform(every(within), of_within),
        F.transform(every(relative), lambda m: _found(lit("relative"), g(m, relative, 1), g(m, relative, 2), before(m), g(m, relative, 4), F.trim(m))),
        F.transform(every(cn_within), lambda m: _found(lit("within"), g(m, cn_within, 1), g(m, cn_within, 2), lit("after"), lit("现在/收到"), m)),
        F.transform(every(cn_after), lambda m: _found(lit("relative"), g(m, cn_after, 1), g(m, cn_after, 2), lit("after"), lit("收到"), m)),
    )
    kind = "array<struct<raw:string,kind:string,n:int,unit:string,direction:string,anchor:string>>"
    return F.aggregate(found, F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda y: y["raw"] == x["raw"]), acc).otherwise(F.array_append(acc, x)))


def add_business_days(day: Column, n: Column, holidays: Sequence[str] = ()) -> Column:
    """The n-th weekday after (before, for negative n) ``day`` that is no holiday; ``day`` itself for n = 0."""
    closed = F.array(*(F.lit(h).cast("date") for h in holidays)).cast("array<date>")
    step = F.when(n < 0, -1).otherwise(1)
    reach = (F.abs(n) * 7 / 5 + 9 + len(holidays)).cast("int")
    ahead = F.transform(F.sequence(F.lit(1), reach), lambda i: F.date_add(day, (i * step).cast("int")))
    open_days = F.filter(ahead, lambda d: (F.weekday(d) < 5) & ~F.coalesce(F.array_contains(closed, d), F.lit(False)))
    return F.when(n == 0, day).otherwise(F.try_element_at(open_days, F.abs(n).cast("int")))


def resolve(n: Column, unit: Column, direction: Column, anchor: Column, holidays: Sequence[str] = ()) -> Column:
    """Due date of a deadline, null without an anchor or with an unknown unit; months clamp to the month's end."""
    k = F.when(direction == "before", -n).otherwise(n)
    return (
        F.when(unit == "days", F.date_add(anchor, k))
        .when(unit == "weeks", F.date_add(anchor, k * 7))
        .when(unit == "months", F.add_months(anchor, k))
        .when(unit == "businessdays", add_business_days(anchor, k, holidays))
    )


def recurrence(text: Column) -> Column:
    """daily, weekly, monthly, quarterly or annual; empty if none is stated."""
    low = F.lower(F.coalesce(text, F.lit("")))
    first = F.regexp_extract(low, r"(?U)\b(daily|every day|weekly|every week|fortnightly|biweekly|monthly|every month|quarterly|every quarter|annually|yearly|every year)\b", 1)
    said = F.when(first != "", first).otherwise(F.regexp_extract(low, "(每天|每日|每周|每月|每季|每年|按月|按季)", 1))
    return (
        F.when(said == "", "").when(said.rlike("week|fortnight|每周"), "weekly").when(said.rlike("month|每月|按月"), "monthly")
        .when(said.rlike("quarter|每季|按季"), "quarterly").when(said.rlike("year|annual|每年"), "annual").otherwise("daily")
    )


def resolve_colloquial(text: Column, anchor: Column) -> Column:
    """Today's phrases, tomorrow, a weekday (next = the week after), or a day of the month; null if none applies."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pattern = r"(?U)\b(next\s+|this\s+|by\s+|on\s+)?(monday|mon|tuesday|tues|tue|wednesday|wed|thursday|thurs|thu|friday|fri|saturday|sat|sunday|sun)\b"
    name = F.regexp_extract(low, pattern, 2)
    target = F.coalesce(*(F.when(F.startswith(F.lit(d), name), i) for i, d in enumerate(WEEKDAYS)))
    ahead = F.pmod(target - F.weekday(anchor), F.lit(7)) + F.when(F.trim(F.regexp_extract(low, pattern, 1)) == "next", 7).otherwise(0)
    nth = F.regexp_extract(low, r"(?U)\b(?:by\s+|on\s+|the\s+)?(\d{1,2})(?:st|nd|rd|th)\b", 1).try_cast("int")
    month = F.when(nth < F.day(anchor), F.add_months(F.trunc(anchor, "month"), 1)).otherwise(F.trunc(anchor, "month"))
    return (
        F.when(low.rlike("eod|cob|end of day|by close|today|end of business"), anchor)
        .when(F.contains(low, F.lit("tomorrow")), F.date_add(anchor, 1))
        .when(name != "", F.date_add(anchor, ahead.cast("int")))
        .when(nth.between(1, 31), F.date_add(month, F.least(nth, F.day(F.last_day(month))) - 1))
    )
