"""DS6: up to five headline sentences from five top-1 rows.

The four ticket sentences come from one aggregate over the shared base, so
tickets are read once; only five short rows ever reach the driver (when the
caller collects).
Numbers are formatted with ``format_number`` (half-even, like Python's
format).  A top row whose number is null yields no sentence (N22, a
documented difference: the reference fails there); a null text prints as
``None`` as Python's f-strings do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeromart.functions import measures as M
from aeromart.functions.expressions import percent_text, safe_divide, thousands_text
from aeromart.operators import marts
from aeromart.operators.base import MONTHS, ROUTES, ticket_base

# The sentence templates, with {placeholders} filled in order.
ROUTE_SENTENCE = "Top revenue route is {route_label} ({route_code}) with {tickets} tickets and {revenue} total revenue."
CABIN_SENTENCE = "{cabin_class} is the largest cabin by revenue, contributing {revenue_share} of filtered ticket revenue."
YIELD_SENTENCE = "Highest yield route by revenue per distance is {route_label} at {revenue_per_distance} revenue units per distance unit."
AIRCRAFT_SENTENCE = "Most scheduled aircraft is {label} with {scheduled_flights} assigned flights."
TAX_SENTENCE = "Highest average tax share appears on {route_label}, where taxes average {avg_tax_share} of ticket value."


def text(c: str | Column) -> Column:
    value = F.col(c) if isinstance(c, str) else c
    return F.coalesce(value.cast("string"), F.lit("None"))


def thousands(c: str, decimals: int) -> Column:
    return thousands_text(c, decimals)


def percent(c: str) -> Column:
    return percent_text(c)


def fill(template: str, parts: dict[str, Column]) -> Column:
    """Concatenate literal pieces of ``template`` and the given columns."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if head:
            pieces.append(F.lit(head))
        pieces.append(parts[name])
    if rest:
        pieces.append(F.lit(rest))
    return F.concat(*pieces)


def _first(order: list[Column], keys: list[str], values: list[str], where: Column) -> Column:
    """The first row by ``order`` and then ``keys`` (ascending, nulls first)
    among those where ``where`` holds, as a struct: the least struct."""
    places = [c.alias(f"_{i}") for i, c in enumerate(order)]
    return F.min(F.when(where, F.struct(*places, *keys, *[v for v in values if v not in keys])))


def _descending(c: str) -> Column:
    """Sorts ascending as ``c`` does descending, nulls first; NaN counts as largest."""
    return F.struct(F.when(F.col(c).isNotNull(), ~F.isnan(F.col(c).cast("double"))), -F.col(c).cast("double"))


def _sentence(finding_id: int, template: str, parts: dict[str, Column], numbers: list[Column]) -> Column:
    """(finding_id, finding), null where a number is."""
    known = reduce(lambda a, b: a & b, [n.isNotNull() for n in numbers])
    return F.when(known, F.struct(F.lit(finding_id).alias("finding_id"), fill(template, parts).alias("finding")))


def _told(row: DataFrame, sentences: list[Column]) -> DataFrame:
    return row.select(F.explode(F.filter(F.array(*sentences), lambda s: s.isNotNull())).alias("s")).select("s.*")


def ticket_findings(tickets: DataFrame) -> DataFrame:
    """The four ticket sentences, from a tickets fact or its base.

    A fact is folded to its base first.  The base is small beside it; it is
    grouped by the keys of all four marts at once, and one aggregate over
    these groups picks the first row of each.
    """
    base = tickets if "key_set" in tickets.columns else ticket_base(tickets, (ROUTES, MONTHS))
    base = base.where(F.col("key_set").isin(ROUTES, MONTHS))
    sets = {"route": marts.ROUTE_KEYS, "yield": marts.EFFICIENCY_KEYS, "tax": marts.TAX_KEYS, "cabin": ["cabin_class"]}
    columns = list(dict.fromkeys(["key_set", *[k for own in sets.values() for k in own]]))
    ids = {s: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in ("key_set", *own)) for s, own in sets.items()}
    groups = base.groupingSets([[F.col("key_set"), *[F.col(c) for c in own]] for own in sets.values()], *columns).agg(
        F.grouping_id().alias("_set"), M.ticket_count(base), M.revenue(base), M.avg_tax_share(base)
    )
    groups = groups.withColumn("revenue_per_distance", safe_divide("revenue", "distance"))

    def of(name: str) -> Column:
        return (F.col("_set") == ids[name]) & (F.col("key_set") == (MONTHS if name == "cabin" else ROUTES))

    def last_if_null(c: str) -> list[Column]:
        return [F.col(c).isNull(), _descending(c)]

    row = groups.agg(
        _first([_descending("revenue")], marts.ROUTE_KEYS, ["tickets", "revenue"], of("route")).alias("route"),
        _first([_descending("revenue")], ["cabin_class"], ["revenue"], of("cabin")).alias("cabin"),
        F.sum(F.when(of("cabin"), F.col("revenue"))).alias("total"),
        _first(last_if_null("revenue_per_distance"), marts.EFFICIENCY_KEYS, ["revenue_per_distance"], of("yield")).alias("yield"),
        _first(last_if_null("avg_tax_share"), marts.TAX_KEYS, ["avg_tax_share"], of("tax")).alias("tax"),
    )
    share = safe_divide("cabin.revenue", "total")
    return _told(
        row,
        [
            _sentence(
                1,
                ROUTE_SENTENCE,
                {"route_label": text("route.route_label"), "route_code": text("route.route_code"), "tickets": thousands("route.tickets", 0), "revenue": thousands("route.revenue", 0)},
                [F.col("route.tickets"), F.col("route.revenue")],
            ),
            _sentence(2, CABIN_SENTENCE, {"cabin_class": text("cabin.cabin_class"), "revenue_share": percent_text(share)}, [share]),
            _sentence(
                3,
                YIELD_SENTENCE,
                {"route_label": text("yield.route_label"), "revenue_per_distance": thousands("yield.revenue_per_distance", 2)},
                [F.col("yield.revenue_per_distance")],
            ),
            _sentence(5, TAX_SENTENCE, {"route_label": text("tax.route_label"), "avg_tax_share": percent("tax.avg_tax_share")}, [F.col("tax.avg_tax_share")]),
        ],
    )


def fleet_finding(flights: DataFrame) -> DataFrame:
    """The aircraft sentence, from enriched flights or their base."""
    top = marts.fleet_utilization(flights, top=1)
    label = text("airplane")
    if "model" in top.columns:
        has_model = F.col("model").isNotNull() & (F.col("model") != "")
        label = F.when(has_model, F.concat(text("airplane"), F.lit(" ("), F.col("model").cast("string"), F.lit(")"))).otherwise(label)
    parts = {"label": label, "scheduled_flights": thousands("scheduled_flights", 0)}
    return _told(top, [_sentence(4, AIRCRAFT_SENTENCE, parts, [F.col("scheduled_flights")])])


def summarize_key_findings(tickets: DataFrame, flights: DataFrame) -> DataFrame:
    """Findings as ``(finding_id, finding)``; ids 1-5 in the reference's order.

    Takes facts or bases; tickets are read once for their four sentences.
    """
    return ticket_findings(tickets).unionByName(fleet_finding(flights))


def findings_markdown(findings: DataFrame) -> str:
    """SNK3 text: collect the at most five sentences as a bullet list."""
    rows = findings.orderBy("finding_id").collect()
    return "# Generated Findings\n\n" + "\n".join(f"- {r['finding']}" for r in rows) + "\n"
