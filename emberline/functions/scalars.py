"""Scalar functions over columns. All are built from Spark expressions, so they stay in generated code."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it: through a one-element array."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def clean_text(value: Column) -> Column:
    """Trimmed of all Unicode white space; blank is null."""
    return F.nullif(F.regexp_replace(value, r"(?U)\A\s+|\s+\z", ""), F.lit(""))


def clean_number(value: Column, digits: int = 6) -> Column:
    """Rounded; not-a-number and infinities are null. Half-way cases round away from zero."""
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(math.inf))
    return F.when(finite, F.round(value, digits))


def iso_public(value: Column) -> Column:
    """Time text as published: first space to T, cut at the first point, a closing Z. Offsets are kept as they are."""
    trimmed = clean_text(value)
    cut = F.substring_index(F.regexp_replace(trimmed, r"\A([^ ]*) ", "$1T"), ".", 1)
    return F.when(cut.endswith("Z"), cut).otherwise(F.concat(cut, F.lit("Z")))


def object_id(value: Column) -> Column:
    """The identifier (year and letters) of a transient's name, with or without its two-letter prefix; else null."""
    return F.nullif(F.regexp_extract(clean_text(value), r"(?i)\A(?:AT|SN)?(\d{4}[a-z]+)\z", 1), F.lit(""))


def filled(template: Column, value: Column) -> Column:
    """template with {id} replaced by value."""
    return F.replace(template, F.lit("{id}"), value)


def fixed(value: Column, digits: int = 2) -> Column:
    """A number with a fixed number of decimals; empty for null and what isn't finite."""
    number = value.cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(math.inf))
    return F.when(finite, F.format_string(f"%.{digits}f", number)).otherwise("")


def first_truthy(*values: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v.cast("string"), F.lit("")) for v in values))


def parse_time(value: Column) -> Column:
    """Time text to a timestamp; null where it isn't one."""
    return F.try_to_timestamp(value)


def absolute_time(value: Column) -> Column:
    return F.coalesce(F.date_format(parse_time(value), "yyyy-MM-dd HH:mm:ss 'UTC'"), F.lit("unknown"))


def relative_time(value: Column, as_of: Column) -> Column:
    """Age in words: minutes under an hour, hours under two days, then days; halves round up."""
    half_up = lambda x: F.floor(x + 0.5)
    minutes = half_up((F.unix_micros(as_of) - F.unix_micros(parse_time(value))) / 60e6)
    hours = half_up(minutes / 60)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit} ago"))
    return (
        F.when(minutes.isNull(), "").when(minutes < 1, "just now").when(minutes == 1, "1 minute ago").when(minutes < 60, text(minutes, "minutes"))
        .when(hours == 1, "1 hour ago").when(hours < 48, text(hours, "hours")).otherwise(text(half_up(hours / 24), "days"))
    )


def sexagesimal(ra: Column, dec: Column) -> Column:
    """Right ascension in hours and declination in degrees, to 0.1 s and 1 arcsec, without carry."""
    two = lambda n: F.lpad(n.cast("string"), 2, "0")

    def split(x: Column) -> tuple[Column, Column, Column]:
        whole = F.floor(x)
        minutes = F.floor((x - whole) * 60)
        return whole, minutes, ((x - whole) * 60 - minutes) * 60

    h, m, s = split(ra / 15)
    d, dm, ds = split(F.abs(dec))
    sign = F.when(dec < 0, "-").otherwise("+")
    text = F.concat(two(h), F.lit(":"), two(m), F.lit(":"), F.format_string("%.1f", s), F.lit(" "), sign, two(d), F.lit(":"), two(dm), F.lit(":"), F.format_string("%.0f", ds))
    return F.coalesce(text, F.lit(""))


def escape_html(value: Column) -> Column:
    out = F.coalesce(value, F.lit(""))
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def mollweide(ra: Column, dec: Column, width: float = 960.0, height: float = 480.0, margin: float = 18.0, steps: int = 8) -> Column:
    """struct<x, y>: equal-area projection, its auxiliary angle by at most `steps` Newton steps (a fold, not nested columns)."""
    lat = F.radians(dec)

    def newton(theta: Column, _: Column) -> Column:
        slope = 2 + 2 * F.cos(2 * theta)
        return F.when(F.abs(slope) < 1e-7, theta).otherwise(theta - (2 * theta + F.sin(2 * theta) - math.pi * F.sin(lat)) / slope)

    theta = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), lat, newton)
    root = math.sqrt(2)
    place = lambda t: F.struct(
        (width / 2 + (2 * root / math.pi) * F.radians(180 - ra) * F.cos(t) * ((width - 2 * margin) / (4 * root))).alias("x"),
        (height / 2 - root * F.sin(t) * ((height - 2 * margin) / (2 * root))).alias("y"),
    )
    return bound(theta, place)


#: The colours at magnitudes 13, 18 and 23, and the colour for none.
MAGNITUDE_STOPS = ((255, 211, 105), (88, 210, 226), (132, 94, 247))
NO_MAGNITUDE = "#a9b3c7"


def magnitude_colour(magnitude: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (magnitude - 13) / 10))
    u = F.when(t < 0.5, t * 2).otherwise((t - 0.5) * 2)
    low, middle, high = MAGNITUDE_STOPS
    parts = [F.floor(F.when(t < 0.5, a + (b - a) * u).otherwise(b + (c - b) * u) + 0.5).cast("string") for a, b, c in zip(low, middle, high, strict=True)]
    known = magnitude.isNotNull() & ~F.isnan(magnitude) & (F.abs(magnitude) != F.lit(math.inf))
    return F.when(known, F.concat(F.lit("rgb("), F.concat_ws(",", *parts), F.lit(")"))).otherwise(NO_MAGNITUDE)


def measurement(magnitude: Column, error: Column, limit: Column, flux: Column, unit: Column) -> Column:
    """A magnitude with its error, else a limit, else a flux, else that there is an observation."""
    with_error = F.when(error.isNotNull(), F.concat(F.lit(" ± "), fixed(error, 3))).otherwise("")
    return (
        F.when(magnitude.isNotNull(), F.concat(fixed(magnitude, 3), with_error, F.lit(" mag")))
        .when(limit.isNotNull(), F.concat(F.lit("limit "), fixed(limit, 3), F.lit(" mag")))
        .when(flux.isNotNull(), F.concat(fixed(flux, 4), F.lit(" "), F.coalesce(unit, F.lit(""))))
        .otherwise("recorded observation")
    )


def dotted(*parts: Column) -> Column:
    """What isn't null or empty, with dots between."""
    return F.concat_ws(" · ", *(F.nullif(p.cast("string"), F.lit("")) for p in parts))


def counted(parts: dict[str, Column], fallback: str, between: str = " · ") -> Column:
    """Numbers with their labels; zero and null parts are left out; fallback if nothing is left."""
    shown = [F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {label}"))) for label, n in parts.items()]
    return F.coalesce(F.nullif(F.concat_ws(between, *shown), F.lit("")), F.lit(fallback))


def rationale(parts: dict[str, Column], start: str, end: str, fallback: str) -> Column:
    """A sentence of pluralised counts."""
    shown = [F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {label}"), F.when(n == 1, "").otherwise("s"))) for label, n in parts.items()]
    text = F.nullif(F.concat_ws(", ", *shown), F.lit(""))
    return F.coalesce(F.concat(F.lit(start), text, F.lit(end)), F.lit(fallback))


def percent(share: Column) -> Column:
    return F.when(share.isNotNull(), F.concat(fixed(share * 100, 1), F.lit("%"))).otherwise("")


#: Labels of the score's factors, in the order shown.
FACTOR_LABELS = (
    ("recency_points", "Recency points"), ("brightness_points", "Brightness points"), ("classification_gap_points", "Unclassified points"),
    ("classification_conflict_points", "Classification conflict"), ("spectroscopy_gap_points", "No-spectrum points"),
    ("coverage_reduction", "Observation-coverage reduction"), ("observation_gap_points", "Observation-gap points"),
    ("multimessenger_points", "Multimessenger points"), ("status", "Status override"),
)


def shown_factors(factors: Column) -> Column:
    """array<struct<label, value>> of a map of factors (variants), in the order of the labels; missing and empty ones left out.

    The map is computed once, and so is each value: named in full at each use, the text would be parsed thousands of times.
    """

    def rows(known: Column) -> Column:
        text = lambda key: F.try_variant_get(F.try_element_at(known, F.lit(key)), "$", "string")
        found = F.array(*(F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), text(key).alias("value")) for key, label in FACTOR_LABELS))
        shown = F.filter(found, lambda row: row["value"] != "")
        return F.transform(shown, lambda row: F.struct(row["label"].alias("label"), factor_text(row["key"], row["value"]).alias("value")))

    return bound(factors, rows)


def factor_text(key: Column, value: Column) -> Column:
    """Numbers with two decimals, but for the status override, which is text."""

    def shown(x: Column) -> Column:
        number = F.when(x["key"] != "status", x["value"].try_cast("double"))
        return bound(number, lambda n: F.when(n.isNotNull(), fixed(n, 2)).otherwise(x["value"]))

    return bound(F.struct(key.alias("key"), value.alias("value")), shown)


def source_indicator(state: Column) -> Column:
    """The light of a source: anything but ok, disabled and error counts as degraded."""
    return F.when(state == "ok", "ok").when(state == "disabled", "none").when(state == "error", "error").otherwise("degraded")


def pipeline_indicator(state: Column) -> Column:
    """The light of the pipeline: anything but ok, degraded and idle counts as an error."""
    return F.when(state == "ok", "ok").when(state == "degraded", "degraded").when(state == "idle", "none").otherwise("error")


def safe_link(url: Column, label: Column) -> Column:
    """url if it is https, and, for the transient name server's label, on its host with an object's path; else null."""
    https = F.lower(url).startswith("https://")
    object_page = url.rlike(r"(?i)\Ahttps://www\.wis-tns\.org/object/\d{4}[a-z]+\z")
    return F.when(https & ((label != "TNS") | object_page), url)
