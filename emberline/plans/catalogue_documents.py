"""Registered queries over a catalogue with evidence of all kinds, and over the documents that are published from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators import rollups
from emberline.plans import catalogue, documents, snapshot
from emberline.plans.registry import query
from emberline.sources import sinks
from emberline.sources.schemas import TABLES
from emberline.sources.storage import shared_folder

_RIGHTS = "case {0} % 4 when 0 then 'public' when 1 then 'open' when 2 then 'PUBLIC' else null end"
_KINDS_SQL = f"""k1 as (select event_id as id, 'c' || (event_id % 997 + 1) as event_id, 'k' || (event_id % 3) as provider, event_type as label, case when event_id % 9 > 0 then strftime(ts, '%Y-%m-%d %H:00:00') end as tm
 from events where {_RIGHTS.format("event_id")} in ('public', 'open') and coalesce(nullif(event_id % 5, 1), 0) in (0) and coalesce(nullif(event_id % 7, 2), 0) <> 3),
k3 as (select p_partkey as id, 'c' || (p_partkey % 500 + 1) as event_id, 's' || (p_size % 3) as provider, p_name as label, case when p_partkey % 6 > 0 then '2024-02-' || lpad(cast(1 + p_size % 28 as varchar), 2, '0') || ' 01:02:03' end as tm
 from part where {_RIGHTS.format("p_partkey")} in ('public', 'open')),
k4 as (select page_id as id, 'c' || (page_id % 300 + 1) as event_id, 'm' || (page_id % 4) as provider, 'neutrino' || (page_id % 2) as label, '2024-03-' || lpad(cast(1 + page_id % 9 as varchar), 2, '0') || ' 00:00:00' as tm
 from pages where {_RIGHTS.format("page_id")} in ('public', 'open') and coalesce(nullif(page_id % 3, 1), 0) = 0),
rv as (select page_id, arg_max(title, (retrieved_at, id)) as title from (select page_id, page_id * 2 + r as id, case when page_id % 7 = 0 then '2024-01-01' else '2024-01-0' || (1 + r) end as retrieved_at, url || '#' || r as title from pages, (values (0), (1)) as v(r) where page_id % 5 <> 0) group by 1),
wk as (select page_id as id, 'w' || (page_id % 2) as provider, case when page_id % 8 > 0 then '2024-04-' || lpad(cast(1 + page_id % 28 as varchar), 2, '0') end as tm from pages where {_RIGHTS.format("page_id")} in ('public', 'open')),
ln as (select 'c' || o_custkey as event_id, o_orderkey % 250 as publication_id from orders),
k5 as (select wk.id, ln.event_id, wk.provider, rv.title as label, wk.tm from ln join wk on wk.id = ln.publication_id join rv on rv.page_id = wk.id),
k2 as (select id, event_id, provider, '-' as label, observed_at as tm from {catalogue._OBSERVED}),
every as (select 'classifications' as kind, * from k1 union all select 'observations', * from k2 union all select 'spectra', * from k3 union all select 'messenger_signals', * from k4 union all select 'publications', * from k5),
shown as (select * from {catalogue._KEPT})"""


def _full(t) -> dict[str, DataFrame]:
    """The catalogue of the snapshot queries with the other kinds of evidence and all aliases: events as classifications, parts as spectra, pages as signals and publications."""
    tables = catalogue._tables(t)

    def made(name: str, rows: DataFrame, **columns) -> None:
        kinds = {f.name: f.dataType.simpleString() for f in TABLES[name].fields}
        tables[name] = rows.select(*((columns[c].cast(k) if c in columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()))

    text, two = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string")), lambda n: F.lpad(n.cast("string"), 2, "0")
    rights = lambda i: F.when(i % 4 == 0, "public").when(i % 4 == 1, "open").when(i % 4 == 2, "PUBLIC")
    i = F.col("event_id")
    made(
        "classification_assertions", t("events"), id=i, event_id=text("c", i % 997 + 1), provider=text("k", i % 3), classification=F.col("event_type"), data_rights=rights(i),
        asserted_at=F.when(i % 9 > 0, F.date_format("ts", "yyyy-MM-dd HH:00:00")), superseded=F.nullif(i % 5, F.lit(1)), retracted=F.when(i % 7 == 3, 1).when(i % 7 != 2, 0),
    )
    p = F.col("p_partkey")
    made(
        "spectra", t("part"), id=p, event_id=text("c", p % 500 + 1), provider=text("s", F.col("p_size") % 3), telescope=F.col("p_name"), data_rights=rights(p),
        observed_at=F.when(p % 6 > 0, F.concat(F.lit("2024-02-"), two(1 + F.col("p_size") % 28), F.lit(" 01:02:03"))),
    )
    g = F.col("page_id")
    made(
        "messenger_signals", t("pages"), id=g, event_id=text("c", g % 300 + 1), provider=text("m", g % 4), messenger=text("neutrino", g % 2), data_rights=rights(g),
        observed_at=F.concat(F.lit("2024-03-"), two(1 + g % 9), F.lit(" 00:00:00")), simulation=F.nullif(g % 3, F.lit(1)),
    )
    made("publications", t("pages"), id=g, provider=text("w", g % 2), published_at=F.when(g % 8 > 0, F.concat(F.lit("2024-04-"), two(1 + g % 28))), data_rights=rights(g))
    twice = t("pages").filter("page_id % 5 <> 0").withColumn("r", F.explode(F.array(F.lit(0), F.lit(1))))
    made(
        "publication_revisions", twice, id=g * 2 + F.col("r"), publication_id=g, title=F.concat("url", F.lit("#"), F.col("r").cast("string")),
        retrieved_at=F.when(g % 7 == 0, "2024-01-01").otherwise(F.concat(F.lit("2024-01-0"), (1 + F.col("r")).cast("string"))),
    )
    o = F.col("o_orderkey")
    made("publication_event_links", t("orders"), event_id=text("c", F.col("o_custkey")), publication_id=o % 250)
    made("aliases", t("orders"), event_id=text("c", F.col("o_custkey")), provider=F.lit("TNS"), external_id=F.concat(F.lit("AT"), (2000 + o % 3).cast("string"), F.lit("ab")))
    return tables


def _listed(kind: str, label: str):
    return F.array_join(F.transform(f"follow_up.{kind}", lambda x: F.concat_ws("/", x["provider"], F.coalesce(x[label], F.lit("-")) if label else F.lit("-"))), " ").alias(kind)


_LABELS = {"classifications": "classification", "observations": None, "spectra": "telescope", "messenger_signals": "messenger", "publications": "title"}
_LISTS = ", ".join(f"max(case when kind = '{k}' then listed end) as {k}" for k in _LABELS)


@query(f"""with {_KINDS_SQL},
l as (select event_id, kind, count(*) as n, string_agg(provider || '/' || label, ' ' order by tm desc nulls last, id) as listed from every group by 1, 2),
w as (select event_id, cast(sum(n) as bigint) as total, {_LISTS} from l group by 1)
select name, coalesce(total, 0) as total, {", ".join(f"case when total > 0 then coalesce({k}, '') end as {k}" for k in _LABELS)} from shown left join w on w.event_id = shown.id""")
def evidence_lists(t):
    shown = snapshot.candidates(_full(t), 1000)
    return shown.select("name", F.col("follow_up_total").alias("total"), *(_listed(k, label) for k, label in _LABELS.items()))


@query(f"""with {_KINDS_SQL}, c as (select kind, shown.id as event from every join shown on shown.id = every.event_id)
select count(distinct event) as candidates_with_follow_up, (select count(*) from shown) as public_candidates, {", ".join(f"count(*) filter (where kind = '{k}') as {k}" for k in _LABELS)} from c""")
def evidence_statistics(t):
    return snapshot.statistics(snapshot.candidates(_full(t), 1000))


_LINKED = "(select ln.event_id, wk.provider from ln join wk on wk.id = ln.publication_id)"
_COUNTED = f"""c as (select provider, {", ".join(f"nullif(count(*) filter (where kind = '{k}'), 0) as {k}" for k in _LABELS)} from
(select kind, provider from every where kind <> 'publications' union all select 'publications', provider from {_LINKED}) group by 1)"""
_TOTAL = " + ".join(f"coalesce({k}, 0)" for k in _LABELS)


@query(f"with {_KINDS_SQL}, {_COUNTED} select *, {_TOTAL} as total from c")
def evidence_providers(t):
    tables = _full(t)
    kinds = {k: snapshot.evidence(tables, k) for k in snapshot.KINDS if k != "publications"}
    works = tables["publications"].filter(F.col("data_rights").isin("public", "open"))
    kinds["publications"] = snapshot.linked(tables["publication_event_links"], works, "publication_id", "id")
    return rollups.ranked_providers(rollups.by_provider(kinds), list(_LABELS)).select("provider", *_LABELS, "total")


def _published(t) -> DataFrame:
    """The text of both documents of a snapshot, written, and read back: document, text."""
    folder = shared_folder(t.spark)
    sinks.publish(snapshot.snapshot(_full(t), 1000, store=f"{folder}/store"), f"{folder}/out", "2024-01-31T00:00:00Z")
    version = sinks.current(t.spark, f"{folder}/out")
    names = F.regexp_extract("_metadata.file_name", r"^(\w+)\.json$", 1)
    return t.spark.read.text([f"{version}/candidates.json", f"{version}/status.json"], wholetext=True).select(names.alias("document"), F.col("value").alias("text"))


_PLACE = "row_number() over (order by coalesce(updated_at, discovery_time) desc, name)"


@query(f"""with {_KINDS_SQL}, n as (select event_id, count(*) as n from every group by 1)
select cast(row_number() over (order by {"coalesce(updated_at, discovery_time) desc, name"}) as int) as place, name, score, updated_at, coalesce(n, 0) as total from shown left join n on n.event_id = shown.id""")
def document_candidates(t):
    """The candidates of the written document with their places in it."""
    rows = _published(t).filter("document = 'candidates'")
    parsed = F.from_json("text", "candidates array<struct<name string, score double, updated_at string, follow_up_total long>>")
    return rows.select(F.posexplode(parsed["candidates"]).alias("at", "c")).select((F.col("at") + 1).alias("place"), "c.name", "c.score", "c.updated_at", F.col("c.follow_up_total").alias("total"))


def _sections_sql() -> str:
    sizes = {
        "candidates": "(select count(*) from shown)", "recent_stream": "(select least(20, count(*)) from shown)", "sources": "(select count(*) from region)", "provider_statistics": "(select count(*) from c)",
        "surveys": f"(select count(distinct discovery_survey) from {catalogue._EVENTS} where (simulation is null or simulation = 0) and status <> 'merged' and discovery_survey is not null)",
    }
    rows = [(d, k, s, sizes[s] if listed else "null") for d, all_ in documents.SNAPSHOT_SECTIONS.items() for k, (s, listed) in enumerate(all_)]
    return " union all ".join(f"select '{d}' as document, {k} as place, '{s}' as section, cast({n} as bigint) as entries" for d, k, s, n in rows)


@query(f"with {_KINDS_SQL}, {_COUNTED} {_sections_sql()}")
def document_sections(t):
    """The sections of both written documents, in their order, and how many entries their lists have."""
    rows = _published(t).withColumn("keys", F.json_object_keys("text"))
    each = rows.select("document", "text", F.posexplode("keys").alias("place", "section"))
    body = F.expr("get_json_object(text, concat('$.', section))")
    return each.select("document", "place", "section", F.when(body.startswith("["), F.json_array_length(body).cast("long")).alias("entries"))


_PROVIDERS_PLACED = f"select cast(row_number() over (order by {_TOTAL} desc, provider) - 1 as int) as place, 'provider_statistics' as section, provider as entry, {_TOTAL} as n from c"
_SURVEYS_PLACED = f"""select cast(row_number() over (order by count(*) desc, discovery_survey) - 1 as int), 'surveys', discovery_survey, count(*) from {catalogue._EVENTS}
where (simulation is null or simulation = 0) and status <> 'merged' and discovery_survey is not null group by discovery_survey"""


@query(f"with {_KINDS_SQL}, {_COUNTED} {_PROVIDERS_PLACED} union all {_SURVEYS_PLACED}")
def document_places(t):
    """The written order of providers (by total) and surveys (by count)."""
    rows = _published(t).filter("document = 'candidates'")
    counts = ", ".join(f"{k} long" for k in _LABELS)
    parsed = rows.select(F.from_json("text", f"provider_statistics array<struct<provider string, {counts}>>, surveys array<struct<survey string, candidate_count long>>").alias("d"))
    providers = parsed.select(F.posexplode("d.provider_statistics").alias("place", "x")).select("place", F.lit("provider_statistics").alias("section"), F.col("x.provider").alias("entry"), sum((F.coalesce(F.col(f"x.{k}"), F.lit(0)) for k in _LABELS), F.lit(0).cast("long")).alias("n"))
    surveys = parsed.select(F.posexplode("d.surveys").alias("place", "x")).select("place", F.lit("surveys").alias("section"), F.col("x.survey").alias("entry"), F.col("x.candidate_count").alias("n"))
    return providers.unionByName(surveys)


@query(f"""with f as (select trim(preferred_name) as name, priority_score as score, row_number() over (order by coalesce(priority_score, 0) desc, trim(preferred_name)) as place from {catalogue._EVENTS}
where (simulation is null or simulation = 0) and trim(preferred_name) <> '' and cast(updated_at as timestamp) >= timestamp '2024-01-25 00:00:00')
select cast(place as int) as place, name, score, 'ok' as pipeline_status, (select least(200, count(*)) from f) as candidate_count from f where place <= 200""")
def document_feed(t):
    """The feed's two documents, published from polled sources of which one is ok, and read back."""
    from emberline.plans.catalogue_sources import _sources
    from emberline.sources.connectors import poll, states

    folder = shared_folder(t.spark)
    shown = snapshot.feed(catalogue._feed_summaries(t), F.lit("2024-01-28 00:00:00").cast("timestamp"))
    told = states(poll(t.spark, _sources(t)[2:] + _sources(t)[:1])).select("source", "state", "detail")
    sinks.publish_feed(shown, told, folder, "2024-01-28T00:00:00Z")
    version = sinks.current(t.spark, folder)
    whole = t.spark.read.schema("candidates array<struct<name string, score double>>").option("multiLine", True).json(f"{version}/candidates.json")
    status = t.spark.read.schema("pipeline_status string, candidate_count long").option("multiLine", True).json(f"{version}/status.json")
    rows = whole.select(F.posexplode("candidates").alias("at", "c")).select((F.col("at") + 1).alias("place"), "c.name", "c.score")
    return rows.crossJoin(status)  # one row
