"""Scalar functions against short oracles written from their definitions."""

from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.functions import scalars as fn
from emberline.plans.snapshot import score_factors


def values(spark, column, rows, schema):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in frame.orderBy("i").select(column.alias("v")).collect()]


def test_clean_text(spark):
    cases = [(None,), ("",), (" \t",), (" a b ",), (" x ",), ("\n名 前　",)]
    assert values(spark, fn.clean_text(F.col("v")), cases, "v string") == [None, None, None, "a b", "x", "名 前"]


def test_clean_number(spark):
    cases = [(None,), (math.nan,), (math.inf,), (-math.inf,), (1.23456789,), (-0.5,)]
    assert values(spark, fn.clean_number(F.col("v")), cases, "v double") == [None, None, None, None, 1.234568, -0.5]


def iso(value):
    if not value or not value.strip():
        return None
    s = value.strip().replace(" ", "T", 1).split(".", 1)[0]
    return s if s.endswith("Z") else s + "Z"


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789-: .TZ+", max_size=24), min_size=20, max_size=40))
def test_iso_public(spark, found):
    cases = [(None,), ("2024-01-02 03:04:05.678",), ("2024-01-02T03:04:05+00:00",), ("  ",), *((x,) for x in found)]
    assert values(spark, fn.iso_public(F.col("v")), cases, "v string") == [iso(v) for (v,) in cases]


@pytest.mark.parametrize(("name", "wanted"), [("AT2024abc", "2024abc"), ("sn2024A", "2024A"), ("2024abc\n", "2024abc"), ("ZTF1", None), ("AT2024", None), (None, None)])
def test_object_id(spark, name, wanted):
    assert values(spark, fn.object_id(F.col("v")), [(name,)], "v string") == [wanted]


def test_sexagesimal(spark):
    def oracle(ra, dec):
        def split(x):
            w = math.floor(x)
            m = math.floor((x - w) * 60)
            return w, m, ((x - w) * 60 - m) * 60

        h, m, s = split(ra / 15)
        d, e, f = split(abs(dec))
        return f"{h:02d}:{m:02d}:{s:.1f} {'-' if dec < 0 else '+'}{d:02d}:{e:02d}:{f:.0f}"

    cases = [(10.684, 41.269), (359.9987, -0.0123), (0.0, 90.0), (123.456, -89.99)]
    assert values(spark, fn.sexagesimal(F.col("a"), F.col("b")), cases, "a double, b double") == [oracle(*c) for c in cases]
    assert values(spark, fn.sexagesimal(F.col("a"), F.col("b")), [(None, 1.0)], "a double, b double") == [""]


def test_mollweide(spark):
    def oracle(ra, dec, w=960.0, h=480.0):
        lon, lat = math.radians(180 - ra), math.radians(dec)
        t = lat
        for _ in range(8):
            d = 2 + 2 * math.cos(2 * t)
            if abs(d) < 1e-7:
                break
            t -= (2 * t + math.sin(2 * t) - math.pi * math.sin(lat)) / d
        r = math.sqrt(2)
        return w / 2 + 2 * r / math.pi * lon * math.cos(t) * (w - 36) / (4 * r), h / 2 - r * math.sin(t) * (h - 36) / (2 * r)

    cases = [(float(a), float(d)) for a in range(0, 360, 37) for d in (-90, -89, -45, 0, 30, 89, 90)]
    for got, case in zip(values(spark, fn.mollweide(F.col("a"), F.col("b")), cases, "a double, b double"), cases, strict=True):
        assert (got["x"], got["y"]) == pytest.approx(oracle(*case), abs=1e-6)


def test_colours_and_texts(spark):
    assert values(spark, fn.magnitude_colour(F.col("v")), [(13.0,), (18.0,), (30.0,), (None,), (math.nan,)], "v double") == [
        "rgb(255,211,105)", "rgb(88,210,226)", "rgb(132,94,247)", "#a9b3c7", "#a9b3c7",
    ]
    assert values(spark, fn.escape_html(F.col("v")), [("<a href='x'>&\"",), (None,)], "v string") == ["&lt;a href=&#39;x&#39;&gt;&amp;&quot;", ""]
    counted = fn.counted({"obs": F.col("a"), "spec": F.col("b")}, "event only")
    assert values(spark, counted, [(2, 0), (0, None), (1, 3)], "a int, b int") == ["2 obs", "event only", "1 obs · 3 spec"]
    age = fn.relative_time(F.col("v"), F.lit("2024-01-10 00:00:00").cast("timestamp"))
    cases = [("2024-01-09 23:59:50",), ("2024-01-09 23:59:00",), ("2024-01-09 23:30:00",), ("2024-01-09 23:00:00",), ("2024-01-08 12:00:00",), ("2024-01-01 00:00:00",), ("x",)]
    assert values(spark, age, cases, "v string") == ["just now", "1 minute ago", "30 minutes ago", "1 hour ago", "36 hours ago", "9 days ago", ""]


def test_factors_are_computed_once(spark):
    texts = [
        ('{"recency_points": 5, "status": " held ", "secret": 1}', [("Recency points", "5.00"), ("Status override", "held")]),
        ('{"recency_points": "  ", "brightness_points": 1.23456789, "status": true}', [("Brightness points", "1.23"), ("Status override", "true")]),
        ('{"recency_points": null, "multimessenger_points": "abc", "status": [1]}', [("Multimessenger points", "abc")]),
        ('{"observation_gap_points": "1e3", "status": 2.5}', [("Observation-gap points", "1000.00"), ("Status override", "2.5")]),
        ("{broken", []), ("[]", []), ("", []), (None, []),
    ]
    shown = fn.shown_factors(score_factors(F.col("v")))
    plan = spark.createDataFrame([], "v string").select(shown.alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json(") == 1  # 18,144 when each use of a value named it in full
    assert len(plan) < 20_000
    got = values(spark, shown, [(t,) for t, _ in texts], "v string")
    assert [[tuple(row) for row in rows] for rows in got] == [rows for _, rows in texts]
