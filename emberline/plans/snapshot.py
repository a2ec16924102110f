"""The public snapshot: candidates with their evidence, and statistics, as DataFrames until they are written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalars import bound, clean_number, clean_text, iso_public
from emberline.operators import rollups, selection
from emberline.operators.links import FEED_PROVIDERS, links, links_of
from emberline.operators.validate import Audit, observed
from emberline.sources.readers import json_strings
from emberline.sources.storage import shared_folder, stored

SCHEMA_VERSION = 2
FEED_VERSION = 1

#: Columns of events that may be published, with their published names.
PUBLISHED = (
    ("preferred_name", "name"), ("ra_deg", "ra_deg"), ("dec_deg", "dec_deg"), ("coordinate_error_arcsec", "coordinate_error_arcsec"),
    ("discovery_time", "discovery_time"), ("first_detection_time", "first_detection_time"), ("discovery_survey", "discovery_survey"),
    ("discovery_instrument", "discovery_instrument"), ("discovery_magnitude", "discovery_magnitude"), ("status", "status"), ("host_name", "host_name"),
    ("host_redshift", "host_redshift"), ("transient_redshift", "redshift"), ("distance_mpc", "distance_mpc"), ("consensus_class", "classification"),
    ("consensus_probability", "classification_probability"), ("priority_score", "score"), ("event_type", "event_type"),
    ("primary_messenger", "primary_messenger"), ("updated_at", "updated_at"),
)
FEED_PUBLISHED = (
    ("preferred_name", "name"), ("ra_deg", "ra_deg"), ("dec_deg", "dec_deg"), ("discovery_time", "discovery_time"), ("discovery_magnitude", "discovery_magnitude"),
    ("event_type", "event_type"), ("primary_messenger", "primary_messenger"), ("consensus_class", "classification"),
    ("consensus_probability", "classification_probability"), ("priority_score", "score"), ("observation_count", "observation_count"),
    ("spectrum_count", "spectrum_count"), ("signal_count", "signal_count"), ("latest_observation", "latest_observation"), ("updated_at", "updated_at"),
)
#: Factors of the score that may be published.
FACTORS = (
    "recency_points", "brightness_points", "classification_gap_points", "classification_conflict_points", "spectroscopy_gap_points", "coverage_reduction",
    "observation_gap_points", "multimessenger_points", "status",
)
#: The kinds of evidence, with table, time column, flags that must be unset, and columns that stay private.
EVIDENCE = (
    ("classifications", "classification_assertions", "asserted_at", ("superseded", "retracted")),
    ("observations", "observations", "observed_at", ("superseded",)),
    ("spectra", "spectra", "observed_at", ()),
    ("messenger_signals", "messenger_signals", "observed_at", ("simulation",)),
    ("publications", "publications", "published_at", ()),
)
KINDS = tuple(k for k, *_ in EVIDENCE)
_PRIVATE = ("id", "event_id", "data_rights", "superseded", "retracted", "simulation", "publication_id")
#: Up to this many ids of events are broadcast.
_BROADCAST = 100_000
_TIMES = ("discovery_time", "first_detection_time", "updated_at", "observed_at", "asserted_at", "published_at")


@dataclass(frozen=True)
class Snapshot:
    candidates: DataFrame
    statistics: DataFrame
    messengers: DataFrame
    bands: DataFrame
    recent: DataFrame
    sources: DataFrame
    providers: DataFrame
    surveys: DataFrame
    #: What was seen of the candidates while they were stored, if they were.
    audit: Audit | None = None


def cleaned(name: str, kind: str) -> Column:
    """A column as published: text trimmed, times in public form, numbers rounded, blanks and non-numbers null."""
    if name in _TIMES:
        return iso_public(F.col(name))
    if kind == "string":
        return clean_text(F.col(name))
    return clean_number(F.col(name)) if kind in ("double", "float") else F.col(name)


def score_factors(text: Column, cleaned_values: bool = True) -> Column:
    """map<string, variant> of the allowed factors with plain values; null if there are none.

    A value keeps its type: number, text or truth. Cleaned: text is trimmed and blank text left out, fractions are rounded. The text is parsed once, and each
    factor is taken once.
    """

    def plain(pair: Column) -> Column:
        value = pair["value"]
        kind = F.schema_of_variant(value)
        kept = F.when(kind.rlike(r"\A(?:STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT|LONG)\z"), value)
        if cleaned_values:
            string = clean_text(F.try_variant_get(value, "$", "string")).cast("variant")
            number = bound(F.try_variant_get(value, "$", "double"), clean_number).cast("variant")
            kept = F.when(kind == "STRING", string).when(kind.rlike(r"\A(?:DOUBLE|FLOAT|DECIMAL)"), number).otherwise(kept)
        return F.struct(pair["key"].alias("key"), kept.alias("value"))

    def pairs(parsed: Column) -> Column:
        taken = F.array(*(F.struct(F.lit(key).alias("key"), F.try_variant_get(parsed, f"$.{key}", "variant").alias("value")) for key in FACTORS))
        present = F.filter(taken, lambda pair: pair["value"].isNotNull())
        return F.filter(F.transform(present, plain), lambda pair: pair["value"].isNotNull())

    return bound(bound(F.try_parse_json(text), pairs), lambda found: F.when(F.size(found) > 0, F.map_from_entries(found)))


def evidence(tables: dict[str, DataFrame], kind: str, events: DataFrame | None = None) -> DataFrame:
    """The publishable rows of one kind, of these events (event_id) or whichever they belong to. A publication without a revision is none."""
    _, table, _, flags = next(e for e in EVIDENCE if e[0] == kind)
    of = lambda rows: rows if events is None else selection.of(rows, events, "event_id", "event_id")
    if kind != "publications":
        return of(selection.public(tables[table], *flags))
    newest = selection.latest_revision(tables["publication_revisions"], "publication_id", "retrieved_at", "id").drop("id", "retrieved_at")
    works = selection.public(tables["publications"]).join(newest, F.col("id") == F.col("publication_id")).drop("publication_id")
    return linked(of(tables["publication_event_links"]), works, "publication_id", "id")


def linked(links: DataFrame, works: DataFrame, key: str, work_key: str) -> DataFrame:
    """Links with the work that each names; links to no work are dropped."""
    return links.join(works, F.col(key) == F.col(work_key))


def roots(tables: dict[str, DataFrame], most: int = 5000) -> DataFrame:
    """The latest real events, with `_kept`: whether they may be published (not merged, and named)."""
    real = tables["events"].filter(selection.unset("simulation"))
    kept = selection.not_merged(F.col("status")) & clean_text(F.col("preferred_name")).isNotNull()
    return selection.latest(real, F.coalesce("updated_at", "discovery_time"), ["id"], most).withColumn("_kept", kept)


def candidates(tables: dict[str, DataFrame], most: int = 5000, store: str | None = None) -> DataFrame:
    """The latest real events with links and evidence. Merged and unnamed ones are dropped after the limit, not replaced.

    follow_up is null for a candidate without any evidence. The selected events are stored once, in `store` or a new shared folder, and each kind of evidence
    is joined with their ids (at most `most`, so they are broadcast).
    """
    chosen = roots(tables, most).filter("_kept")
    kinds = dict(chosen.dtypes)
    folder = store or shared_folder(chosen.sparkSession)
    shown = stored(
        chosen.select(F.col("id").alias("event_id"), *(cleaned(s, kinds[s]).alias(d) for s, d in PUBLISHED), score_factors(F.col("priority_factors")).alias("score_factors")), f"{folder}/roots"
    )
    ids = F.broadcast(shown.select("event_id")) if most <= _BROADCAST else shown
    lists = {}
    for kind, _, time, _ in EVIDENCE:
        rows = evidence(tables, kind, ids)
        types = dict(rows.dtypes)
        fields = [cleaned(c, types[c]).alias(c) for c in rows.columns if c not in _PRIVATE]
        lists[kind] = selection.gathered(rows, "event_id", time, "id", fields, kind)
    full = selection.counts(selection.attached(shown, "event_id", lists, "event_id"), list(KINDS))
    aliases = links(selection.of(tables["aliases"], ids, "event_id", "event_id"))
    follow_up = F.when(F.col("follow_up_total") > 0, F.struct(*KINDS))
    return full.join(aliases, "event_id", "left").withColumn("follow_up", follow_up).drop(*KINDS, "event_id")


def statistics(shown: DataFrame) -> DataFrame:
    """One row: the candidates, their records of each kind, and how many have any."""
    totals = [F.coalesce(F.sum(f"follow_up_counts.{k}"), F.lit(0)).alias(k) for k in KINDS]
    return shown.agg(F.count("*").alias("public_candidates"), *totals, F.count_if(F.col("follow_up_total") > 0).alias("candidates_with_follow_up"))


def recent_stream(shown: DataFrame, most: int = 20) -> DataFrame:
    """The latest candidates, by name where equal, with their place."""
    when = F.coalesce(F.nullif(F.col("updated_at"), F.lit("")), F.nullif(F.col("discovery_time"), F.lit("")), F.lit(""))
    top = shown.withColumn("_when", when).orderBy(F.desc("_when"), "name").limit(most)
    place = F.row_number().over(Window.orderBy(F.desc("_when"), "name"))  # of at most `most` rows
    return top.select(place.alias("place"), "name", "updated_at", "discovery_time", "classification", "primary_messenger", "score", "follow_up_counts")


def snapshot(tables: dict[str, DataFrame], most: int = 5000, recent: int = 20, store: str | None = None) -> Snapshot:
    """All sections. Provider counts and the number of real events cover all publishable rows, not only the candidates.

    With `store`, a folder that all executors share, the candidates are stored there once, audited as they are written, and all sections read them back.
    """
    shown, audit = candidates(tables, most, store), None
    if store is not None:
        watched, told = observed(shown)
        watched.write.parquet(f"{store}/candidates")
        audit = told()
        shown = shown.sparkSession.read.parquet(f"{store}/candidates")
    real = tables["events"].filter(selection.unset("simulation")).agg(F.count("*").alias("real_events"))
    skipped = roots(tables, most).agg(F.count_if("_kept").alias("published"), F.count_if(~F.col("_kept")).alias("skipped"))
    by_kind = {k: evidence(tables, k) for k in KINDS if k != "publications"}
    by_kind["publications"] = linked(tables["publication_event_links"], selection.public(tables["publications"]), "publication_id", "id")
    counted = rollups.by_provider(by_kind)
    return Snapshot(
        shown, statistics(shown).crossJoin(real).crossJoin(skipped), rollups.histogram(shown, F.col("primary_messenger"), "messenger"),
        rollups.bands(shown, F.col("score")), recent_stream(shown, recent), sources(tables["sources"], counted), rollups.ranked_providers(counted, list(KINDS)),
        rollups.surveys(tables["events"]), audit,
    )  # one-row frames are crossed


def sources(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """Sources by label and id, with defaults and record counts by kind."""
    text = lambda c: clean_text(F.col(c))
    shown = rows.orderBy("display_name", "id").select(
        text("id").alias("source"), text("display_name").alias("label"), text("facility").alias("facility"), json_strings(F.col("data_types")).alias("data_types"),
        text("mode").alias("mode"), text("public_scope").alias("public_scope"), F.coalesce(text("runtime_state"), F.lit("unknown")).alias("state"),
        text("runtime_detail").alias("detail"), iso_public(F.col("last_message_at")).alias("last_message_at"), clean_number(F.col("lag_seconds")).alias("lag_seconds"),
        text("documentation_url").alias("documentation_url"), F.coalesce(F.col("enabled") != 0, F.lit(False)).alias("enabled"),
    )
    counts = counted.select(F.col("provider").alias("source"), F.struct(*KINDS).alias("record_counts"))
    return shown.join(counts, "source", "left").orderBy("label", "source")


def feed(summaries: DataFrame, as_of: Column, hours: float = 72.0, most: int = 200) -> DataFrame:
    """The smaller feed: allowed fields of recent, real, named events, by score and name.

    summaries has the feed's source columns, `simulation`, `priority_factors` and `aliases` (array<struct<provider, external_id>>).
    """
    age = F.unix_micros(as_of) - F.unix_micros(F.try_to_timestamp("updated_at"))
    rows = summaries.filter(selection.unset("simulation") & (F.coalesce("preferred_name", F.lit("")) != "") & (age <= hours * 3.6e9))
    kinds = dict(rows.dtypes)
    known = lambda c: F.nullif(F.col(c), F.lit("")) if kinds[c] == "string" else F.when(~F.isnan(c), F.col(c)) if kinds[c] == "double" else F.col(c)
    named = links_of(F.col("aliases"), FEED_PROVIDERS, strict=True).alias("links")
    shown = rows.select(*(known(s).alias(d) for s, d in FEED_PUBLISHED), score_factors(F.col("priority_factors"), False).alias("score_factors"), named)
    return by_score(shown, ["name"], most)


def by_score(rows: DataFrame, tie: list[str], most: int) -> DataFrame:
    """The `most` rows of the highest score (null counts as 0)."""
    return rows.orderBy(F.coalesce("score", F.lit(0)).desc(), *tie).limit(most)
