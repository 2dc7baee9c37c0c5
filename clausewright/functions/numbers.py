"""Numeric and date expressions of the rule engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each result status means as a decision; any other status needs a human.
DECISIONS = {
    "PASS": "COMPLIANT",
    "PASS_WITH_CONDITIONS": "COMPLIANT",
    "BREACH": "NON_COMPLIANT",
    "BUFFER_SHORTFALL": "NON_COMPLIANT",
    "TARGET_SHORTFALL": "NON_COMPLIANT",
    "NOT_REPORTED": "INSUFFICIENT_DATA",
    "NOT_DISCLOSED": "INSUFFICIENT_DATA",
    "INSUFFICIENT_DATA": "INSUFFICIENT_DATA",
    "COVERED": "COMPLIANT",
    "PARTIAL": "AMBIGUOUS",
    "LIKELY_GAP": "NON_COMPLIANT",
    "NOT_DEMONSTRATED": "NON_COMPLIANT",
    "EVIDENCE_FOUND": "REQUIRES_HUMAN_REVIEW",
    "PRESENT": "COMPLIANT",
    "LIKELY_MISSING": "NON_COMPLIANT",
    "PROHIBITED": "NON_COMPLIANT",
    "POTENTIAL_BREACH": "AMBIGUOUS",
    "ASSESSMENT_REQUIRED": "INSUFFICIENT_DATA",
    "REPORTABLE": "COMPLIANT",
    "INFO": "COMPLIANT",
    "NEEDS_REVIEW": "REQUIRES_HUMAN_REVIEW",
    "CANDIDATE": "REQUIRES_HUMAN_REVIEW",
    "REQUIRES_HUMAN_REVIEW": "REQUIRES_HUMAN_REVIEW",
    "COMPLIANT": "COMPLIANT",
    "NON_COMPLIANT": "NON_COMPLIANT",
    "AMBIGUOUS": "AMBIGUOUS",
}
# Statuses from the worst to the mildest.
SEVERITY = ("PROHIBITED", "BREACH", "POTENTIAL_BREACH", "NEEDS_REVIEW", "ASSESSMENT_REQUIRED", "REPORTABLE", "PASS_WITH_CONDITIONS", "PASS", "INFO")


def round_half_up(x: Column, digits: int = 2) -> Column:
    """Rounds halves towards plus infinity, also below zero."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def chain(cases: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first case that holds."""
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), default)


def compare(value: Column, operator: Column, threshold: Column) -> Column:
    """value <operator> threshold, the operator being data; an unknown one never holds."""
    return chain(
        [
            (operator.isin("<=", "within_days"), value <= threshold),
            (operator == ">=", value >= threshold),
            (operator == "<", value < threshold),
            (operator == ">", value > threshold),
            (operator.isin("=", "=="), value == threshold),
        ],
        F.lit(False),
    )


def decision(status: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in DECISIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.upper(status)), F.lit("REQUIRES_HUMAN_REVIEW"))


def severity(status: Column) -> Column:
    """0 for the worst status; null for one that has no rank."""
    return F.when(status.isin(*SEVERITY), F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), status) - 1)


def fiscal_year(day: Column) -> Column:
    """The year in which the April-to-March year of a day began."""
    return F.year(day) - F.when(F.month(day) < 4, 1).otherwise(0)


def fiscal_quarter(day: Column) -> Column:
    return ((F.month(day) + 8) % 12 / 3).cast("int") + 1


def fiscal_label(year: Column, quarter: Column) -> Column:
    """Qn-FYyyyy-yy."""
    return F.format_string("Q%d-FY%d-%02d", quarter, year, (year + 1) % 100)


def period_end(year: Column, quarter: Column) -> Column:
    """The last day of a fiscal quarter."""
    return F.last_day(F.make_date(year + F.when(quarter == 4, 1).otherwise(0), (quarter * 3 + 2) % 12 + 1, F.lit(1)))


def hash_share(text: Column) -> Column:
    """The first four bytes of SHA-1 as a number in [0, 1): a split that a key alone decides."""
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def range_flags(value: Column, unit: Column) -> Column:
    """What is odd about a reported value, given its unit."""
    percent, days = unit == "%", unit.isin("days", "working_days")
    flags = F.array(
        F.when(percent & ((value < 0) | (value > 100)), "percent_out_of_range"),
        F.when(days & (value < 0), "negative_days"),
        F.when(days & (value > 3660), "days_over_ten_years"),
        F.when(~percent & ~days & (value < 0), "negative_value"),
    )
    return F.array_compact(flags)
