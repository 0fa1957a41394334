"""How a reader is told of records: a clause on a filing history, labels of metrics, numbers, dates and spans of years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what a metric's name holds if it counts filings that went through
VOLUME = ("approval", "certified", "positions")
# fixed values: labels of the metrics of the shipped registers
LABELS = {
    "initial_approvals": "H-1B initial approvals", "initial_denials": "H-1B initial denials", "continuing_approvals": "H-1B continuing approvals", "continuing_denials": "H-1B continuing denials",
    "perm_certified": "PERM certifications", "perm_denied": "PERM denials", "positions": "Positive LMIA positions", "assessments": "Approved LMIAs", "licensed_sponsor": "Licensed sponsor",
}
# fixed values: what is said where a resume has no match
NO_MATCH = {
    "no_resume": "Add your resume to see how closely it matches this posting. It stays on your device.",
    "no_description": "This posting does not have enough description text to compare against.",
    "disabled": "Resume matching is turned off in settings.",
    "embedding_failed": "The on-device model could not run here. Try reloading the page.",
}
NO_MATCH_ELSE = "Resume matching is unavailable for this posting."


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def metric_label(metric: Column) -> Column:
    """A metric's label; an unknown one's own name with spaces."""
    return F.coalesce(_looked_up(LABELS, metric), F.replace(metric, F.lit("_"), F.lit(" ")))


def no_match_copy(reason: Column) -> Column:
    return F.coalesce(_looked_up(NO_MATCH, reason), F.lit(NO_MATCH_ELSE))


def number(value: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(F.floor(value.cast("decimal(38,6)") + F.lit(0.5).cast("decimal(2,1)")), 0)


def day(date: Column) -> Column:
    return F.date_format(date, "MMM d, yyyy")


def span(years: Column) -> Column:
    """Ascending distinct years: `2021–2024` for a run, `2019, 2021` else, empty for none."""
    n = F.size(years)
    first, last = F.element_at(years, 1), F.element_at(years, -1)
    run = (n > 1) & (last - first + 1 == n)
    return F.when(n < 1, "").when(run, F.concat_ws("–", first, last)).otherwise(F.array_join(F.transform(years, lambda y: y.cast("string")), ", "))


def volume(metrics: Column) -> Column:
    """The sum of a map's metrics that count filings that went through: denials and flags are no volume."""
    counts = F.map_filter(metrics, lambda k, _: F.exists(F.array(*map(F.lit, VOLUME)), lambda part: F.contains(k, part)))
    zero = F.lit(0).cast("decimal(38,6)")
    return F.aggregate(F.map_values(counts), zero, lambda x, v: (x + F.coalesce(v.cast("decimal(38,6)"), zero)).cast("decimal(38,6)"))


def describe(records: Column) -> Column:
    """One clause on a company's records (country, metrics, years, sources): its last year and about how much it filed.

    Null records have none.
    """
    latest = F.array_max(F.flatten(F.transform(records, lambda r: r["years"])))
    zero = F.lit(0).cast("decimal(38,6)")
    total = F.aggregate(records, zero, lambda x, r: (x + volume(r["metrics"])).cast("decimal(38,6)"))
    return (
        F.when(records.isNull(), None)
        .when(latest.isNull(), "they hold a current sponsor licence")
        .when(total <= 0, F.concat(F.lit("they last appear in the data for "), latest.cast("string")))
        .otherwise(F.concat(F.lit("about "), number(total), F.lit(" approvals, most recently in "), latest.cast("string")))
    )
