"""Property-based checks (each example is one batched Spark job)."""

import math
import re

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from aeromart.functions.expressions import NUMBER_PATTERN
from aeromart.operators import marts
from aeromart.operators.cleaning import clean_table
from aeromart.operators.facts import build_ticket_summary_enriched, build_tickets_enriched
from aeromart.operators.summaries import ticket_summary
from aeromart.operators.dimensions import build_route_dimension
from aeromart.sources.naming import snake_case
from tests import reference_data as R

SETTINGS = settings(
    max_examples=6, deadline=None, suppress_health_check=list(HealthCheck),
    phases=[Phase.explicit, Phase.reuse, Phase.generate],  # no shrinking: every example is a Spark job
)


@given(st.text(max_size=30))
def test_snake_case_is_idempotent_and_clean(name):
    out = snake_case(name)
    assert snake_case(out) == out
    assert out == "" or re.fullmatch(r"[a-z0-9]+(_[a-z0-9]+)*", out)


number_text = st.one_of(
    st.from_regex(r"\A[+-]?[0-9]{1,8}(\.[0-9]{0,6})?([eE][+-]?[0-9]{1,2})?\Z"),
    st.from_regex(r"\A[+-]?\.[0-9]{1,6}\Z"),
    st.text(alphabet="0123456789.eE+-_xabc ", min_size=1, max_size=10),
)


@SETTINGS
@given(st.lists(number_text, min_size=1, max_size=200))
def test_lenient_double_agrees_with_python_on_plain_numbers(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, price string")
    got = {r["i"]: r["price"] for r in clean_table(df).collect()}
    # ASCII digits only, as Java's (and the reference's) number parsing
    rule = re.compile(NUMBER_PATTERN.replace("(?i)", "").replace(r"\z", r"\Z"), re.IGNORECASE | re.ASCII)
    for i, text in enumerate(texts):
        stripped = text.strip()
        if rule.search(stripped):
            expected = float(stripped)
            assert got[i] == expected or (math.isinf(expected) and got[i] == expected), (text, got[i])
        else:
            assert got[i] is None, (text, got[i])


amount = st.decimals(min_value=1, max_value=100000, places=2).map(float)
ticket_rows = st.lists(
    st.tuples(st.sampled_from(["R1", "R2", "R9"]), st.sampled_from(["2026-01-05 10:00:00", "2026-02-07 11:00:00"]),
              st.sampled_from(["E", "Business", " econ ", None]), amount, amount, amount),
    min_size=1, max_size=40,
)


@SETTINGS
@given(ticket_rows)
def test_cell_grain_equals_ticket_grain_on_random_tickets(spark, rows):
    data = [
        (f"T{i}", "P", "F", route, dep, cls, price, tax, local, price + tax + local)
        for i, (route, dep, cls, price, tax, local) in enumerate(rows)
    ]
    raw = spark.createDataFrame(data, R.tickets(spark).schema)
    dim = build_route_dimension(R.routes(spark), R.airports(spark))
    tickets = build_tickets_enriched(raw, dim)
    cells = build_ticket_summary_enriched(ticket_summary(raw), dim)
    checks = [
        (marts.revenue_by_route, ["route_code"], ["tickets", "revenue", "avg_ticket_value", "tax_amount"]),
        (marts.cabin_mix, ["cabin_class"], ["tickets", "revenue", "avg_ticket_value", "revenue_share"]),
        (marts.revenue_by_month, ["departure_month", "cabin_class"], ["tickets", "revenue"]),
    ]
    for mart, keys, measures in checks:
        a, b = (
            {tuple(r[k] for k in keys): tuple(round(float(r[m]), 9) for m in measures) for r in mart(df).collect()}
            for df in (tickets, cells)
        )
        assert a == b, mart.__name__


doubles = st.one_of(
    st.floats(min_value=-1e12, max_value=1e12, allow_nan=False, allow_infinity=False),
    st.integers(min_value=-10**9, max_value=10**9).map(lambda i: i / 2),      # exact .5 ties
    st.integers(min_value=-10**9, max_value=10**9).map(lambda i: i / 1000),   # decimal-looking values
)


@SETTINGS
@given(st.lists(doubles, min_size=1, max_size=300))
def test_number_text_matches_python_format(spark, values):
    from pyspark.sql import functions as F

    from aeromart.functions.expressions import percent_text, thousands_text

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    rows = df.select("i", thousands_text("x", 0).alias("t0"), thousands_text("x", 2).alias("t2"),
                     percent_text(F.col("x") / 1e6).alias("p")).collect()
    for r in rows:
        x = values[r["i"]]
        assert r["t0"] == f"{x:,.0f}", (x, r["t0"])
        assert r["t2"] == f"{x:,.2f}", (x, r["t2"])
        assert r["p"] == f"{x / 1e6:.1%}", (x, r["p"])


stamps = st.tuples(
    st.datetimes(min_value=__import__("datetime").datetime(1900, 1, 1), max_value=__import__("datetime").datetime(2100, 12, 31)),
    st.sampled_from(["date", "space", "T"]),
    st.integers(min_value=0, max_value=6),
    st.sampled_from(["", "Z", "+01:00", " 10", "x"]),
)


@SETTINGS
@given(st.lists(stamps, min_size=1, max_size=200))
def test_lenient_timestamps_parse_the_five_layouts(spark, items):
    import datetime as dt

    texts, expected = [], []
    for moment, layout, digits, junk in items:
        moment = moment.replace(microsecond=(moment.microsecond // 10 ** (6 - digits)) * 10 ** (6 - digits) if digits else 0)
        if layout == "date":
            text, want = moment.strftime("%Y-%m-%d"), dt.datetime(moment.year, moment.month, moment.day)
        else:
            sep = " " if layout == "space" else "T"
            text = moment.strftime(f"%Y-%m-%d{sep}%H:%M:%S")
            if digits:
                text += "." + f"{moment.microsecond:06d}"[:digits]
            want = moment
        texts.append(text + junk)
        expected.append(want if junk == "" else None)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, departure string")
    got = {r["i"]: r["departure"] for r in clean_table(df).collect()}
    for i, want in enumerate(expected):
        assert got[i] == want, (texts[i], got[i], want)
