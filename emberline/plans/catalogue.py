"""Registered queries over the relational tables, each with its SQL.

Each query runs an operator of the engine over a whole driver table; limits stand only where the operator is a
top-k. Decimal sums and unique tie-breakers make results exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import scalars as fn
from emberline.operators import browse, links, rollups, selection, sky, validate
from emberline.plans import catalogue_lookup, catalogue_sources, catalogue_streams, snapshot  # noqa: F401  the import registers queries
from emberline.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from emberline.sources.readers import empty_catalogue, json_object

_LINE_KEY = "l_shipdate desc, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def _lines(t) -> DataFrame:
    """Lines with one column that orders those of equal date."""
    tie = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return t("lineitem").withColumn("_order", tie)


def _line_lists(t) -> DataFrame:
    rows = selection.gathered(_lines(t), "l_orderkey", "l_shipdate", "_order", [F.col("l_partkey"), F.col("l_linenumber")], "lines")
    return rows.select("l_orderkey", "lines")


@query(f"""with r as (select * from orders order by o_orderdate desc, o_orderkey limit 100),
k as (select * from r where o_orderstatus <> 'F'),
c as (select l_orderkey, count(*) n, string_agg(l_partkey || '/' || l_linenumber, ' ' order by {_LINE_KEY}) s from lineitem where l_orderkey in (select o_orderkey from k) group by 1)
select o_orderkey, o_orderstatus, cast(coalesce(n, 0) as bigint) as n_lines, coalesce(s, '') as line_list,
case when coalesce(n, 0) * 15 >= 75 then 'urgent_75_100' when coalesce(n, 0) * 15 >= 50 then 'high_50_74' when coalesce(n, 0) * 15 >= 25 then 'routine_25_49' else 'low_0_24' end as band
from k left join c on l_orderkey = o_orderkey""")
def recent_with_children(t):
    recent = selection.latest(t("orders"), F.col("o_orderdate"), ["o_orderkey"], 100).filter("o_orderstatus != 'F'")
    lines = selection.of(_lines(t), recent, "l_orderkey", "o_orderkey")
    lists = selection.gathered(lines, "l_orderkey", "l_shipdate", "_order", [F.col("l_partkey"), F.col("l_linenumber")], "lines")
    out = selection.attached(recent, "o_orderkey", {"lines": lists}, "l_orderkey")
    n = F.size("lines").cast("long")
    text = F.array_join(F.transform("lines", lambda x: F.concat_ws("/", x["l_partkey"].cast("string"), x["l_linenumber"].cast("string"))), " ")
    return out.select("o_orderkey", "o_orderstatus", n.alias("n_lines"), text.alias("line_list"), rollups.band((n * 15).cast("double")).alias("band"))


@query("select o_orderkey, o_orderstatus, o_totalprice from orders order by o_orderdate desc, o_orderkey limit 100")
def candidates_recent(t):
    return selection.latest(t("orders"), F.col("o_orderdate"), ["o_orderkey"], 100).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("select o_orderkey, status from (select o_orderkey, case o_orderstatus when 'F' then 'MERGED' when 'P' then null else o_orderstatus end as status from orders order by o_orderdate desc, o_orderkey limit 200) where lower(coalesce(status, '')) <> 'merged'")
def limit_then_filter(t):
    rows = selection.latest(t("orders"), F.col("o_orderdate"), ["o_orderkey"], 200)
    named = rows.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "MERGED").when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_orderstatus")).alias("status"))
    return named.filter(selection.not_merged(F.col("status")))


@query("select o_orderstatus, count(*) as n from (select *, nullif(o_orderkey % 3, 1) as simulation from orders) where simulation is null or simulation = 0 group by 1")
def real_only(t):
    flagged = t("orders").withColumn("simulation", F.nullif(F.col("o_orderkey") % 3, F.lit(1).cast("long")))
    return flagged.filter(selection.unset("simulation")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("select doc_id, lang from (select *, case source when 'src0' then 'public' when 'src1' then 'open' when 'src2' then 'PUBLIC' when 'src3' then null else 'restricted' end as r from documents) where r in ('public', 'open')")
def rights_filter(t):
    s = F.col("source")
    rights = F.when(s == "src0", "public").when(s == "src1", "open").when(s == "src2", "PUBLIC").when(s == "src3", None).otherwise("restricted")
    return selection.public(t("documents").withColumn("data_rights", rights)).select("doc_id", "lang")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def latest_revision(t):
    return selection.latest_revision(t("events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("select o_orderpriority, count(*) as n_links, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as price from orders join lineitem on l_orderkey = o_orderkey group by 1")
def link_publications(t):
    met = snapshot.linked(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey")
    return met.groupBy("o_orderpriority").agg(F.count("*").alias("n_links"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"))


@query("select o_orderstatus, count(*) as n from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'AUTOMOBILE') group by 1")
def semi_children(t):
    roots = t("customer").filter("c_mktsegment = 'AUTOMOBILE'")
    return selection.of(t("orders"), roots, "o_custkey", "c_custkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(f"select l_orderkey, string_agg(l_partkey || '/' || l_linenumber, ' ' order by {_LINE_KEY}) as line_list from lineitem group by 1")
def children_sorted(t):
    text = F.array_join(F.transform("lines", lambda x: F.concat_ws("/", x["l_partkey"].cast("string"), x["l_linenumber"].cast("string"))), " ")
    return _line_lists(t).select("l_orderkey", text.alias("line_list"))


@query("select o_orderkey, count(l_orderkey) as n_lines from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def left_attach_counts(t):
    return selection.attached_counts(t("orders").select("o_orderkey"), "o_orderkey", {"n_lines": t("lineitem")}, "l_orderkey")


_ALIASES = """(select user_id, event_id, case event_type when 'view' then 'TNS' when 'click' then 'gcn' when 'error' then 'Tns-Astronotes' else event_type end as provider,
case when event_id % 5 = 0 then ' ' when event_id % 3 = 0 then 'AT' || (2020 + event_id % 4) || 'ab' else 'X' || (event_id % 4) end as external_id from events)"""
_NAMED = f"""(select user_id, event_id, lower(provider) as p, trim(external_id) as designation,
case lower(provider) when 'tns' then 'TNS' when 'gcn' then 'GCN' when 'tns-astronotes' then 'TNS AstroNote' when 'tns-public-reports' then 'TNS report' end as label,
case when lower(provider) = 'tns' then 'https://www.wis-tns.org/object/' || nullif(regexp_extract(trim(external_id), '^(?:AT|SN)?([0-9]{{4}}[a-z]+)$', 1), '') end as url from {_ALIASES} where trim(external_id) <> '')"""


def _aliases(t) -> DataFrame:
    e = F.col("event_type")
    provider = F.when(e == "view", "TNS").when(e == "click", "gcn").when(e == "error", "Tns-Astronotes").otherwise(e)
    i = F.col("event_id")
    external = F.when(i % 5 == 0, " ").when(i % 3 == 0, F.concat(F.lit("AT"), (2020 + i % 4).cast("string"), F.lit("ab"))).otherwise(F.concat(F.lit("X"), (i % 4).cast("string")))
    return t("events").select("user_id", "event_id", provider.alias("provider"), external.alias("external_id"))


@query(f"select event_id, label, designation, url from {_NAMED} where label is not null")
def lookup_links(t):
    found = links.link(F.col("provider"), F.col("external_id"))
    return _aliases(t).select("event_id", found.alias("l")).filter("l is not null").select("event_id", "l.label", "l.designation", "l.url")


@query(f"""select user_id, string_agg(label || ':' || designation, ' ' order by p, designation) as links from
(select *, row_number() over (partition by user_id order by p, designation) as k from (select distinct user_id, p, label, designation from {_NAMED} where label is not null)) where k <= 6 group by 1""")
def dedupe_links(t):
    found = links.links(_aliases(t), key="user_id")
    return found.select("user_id", F.array_join(F.transform("links", lambda x: F.concat_ws(":", x["label"], x["designation"])), " ").alias("links"))


_KINDS = {"every": "1=1", "open_lines": "l_linestatus = 'O'", "large": "l_quantity > 25"}
_PIVOT = "select l_returnflag as provider, " + ", ".join(f"nullif(count(*) filter (where {c}), 0) as {k}" for k, c in _KINDS.items()) + " from lineitem group by 1"


def _pivot(t) -> DataFrame:
    return rollups.by_provider({k: t("lineitem").filter(c) for k, c in _KINDS.items()}, "l_returnflag")


@query(_PIVOT)
def provider_pivot(t):
    return _pivot(t)


@query(f"select *, coalesce(every, 0) + coalesce(open_lines, 0) + coalesce(large, 0) as total from ({_PIVOT})")
def provider_ranked(t):
    return rollups.ranked_providers(_pivot(t), list(_KINDS))


@query("select *, coalesce(every, 0) + coalesce(open_lines, 0) as records from (select l_returnflag as provider, nullif(count(*) filter (where l_quantity > 49), 0) as every, nullif(count(*) filter (where l_linestatus = 'F' and l_returnflag = 'A'), 0) as open_lines from lineitem group by 1) where coalesce(every, 0) + coalesce(open_lines, 0) > 0")
def active_sources(t):
    kinds = {"every": "l_quantity > 49", "open_lines": "l_linestatus = 'F' and l_returnflag = 'A'"}
    return browse.active_sources(rollups.by_provider({k: t("lineitem").filter(c) for k, c in kinds.items()}, "l_returnflag"), list(kinds))


_SURVEYS = "select source as discovery_survey, case lang when 'fr' then 'merged' when 'de' then 'MERGED' when 'es' then null else 'new' end as status, nullif(doc_id % 4, 1) as simulation from documents"


@query(f"select discovery_survey as survey, count(*) as candidate_count from ({_SURVEYS}) where (simulation is null or simulation = 0) and status <> 'merged' and trim(discovery_survey) <> '' group by 1")
def survey_counts(t):
    lang = F.col("lang")
    status = F.when(lang == "fr", "merged").when(lang == "de", "MERGED").when(lang == "es", None).otherwise("new")
    rows = t("documents").select(F.col("source").alias("discovery_survey"), status.alias("status"), F.nullif(F.col("doc_id") % 4, F.lit(1).cast("long")).alias("simulation"))
    return rollups.surveys(rows)


@query("select coalesce(nullif(trim(case event_type when 'click' then '  ' when 'view' then null else event_type end), ''), 'unknown') as messenger, count(*) as n from events group by 1")
def messenger_hist(t):
    e = F.col("event_type")
    return rollups.histogram(t("events"), F.when(e == "click", "  ").when(e == "view", None).otherwise(e), "messenger")


@query("""select b.band, count(e.band) as n from (values ('urgent_75_100'), ('high_50_74'), ('routine_25_49'), ('low_0_24')) as b(band) left join
(select case when v >= 75 then 'urgent_75_100' when v >= 50 then 'high_50_74' when v >= 25 then 'routine_25_49' else 'low_0_24' end as band from (select coalesce(case when event_id % 10 = 0 then null else least(value, 74) end, 0) as v from events)) e on e.band = b.band group by 1""")
def priority_bands(t):
    return rollups.bands(t("events"), F.when(F.col("event_id") % 10 != 0, F.least("value", F.lit(74.0))))


@query("select count(*) as public_candidates, cast(coalesce(sum(n), 0) as bigint) as n_lines, count(*) filter (where n > 0) as with_follow_up, max(n) as most from (select o_orderkey, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by 1)")
def with_follow_up(t):
    each = selection.attached_counts(t("orders").select("o_orderkey"), "o_orderkey", {"n": t("lineitem")}, "l_orderkey")
    return each.agg(F.count("*").alias("public_candidates"), F.sum("n").alias("n_lines"), F.count_if(F.col("n") > 0).alias("with_follow_up"), F.max("n").alias("most"))


@query("select event_id, event_type, value from events order by ts desc, event_id limit 20")
def recent_stream(t):
    return selection.latest(t("events"), F.col("ts"), ["event_id"], 20).select("event_id", "event_type", "value")


@query("select c_custkey, score from (select c_custkey, c_name, nullif(c_custkey % 50, 7) as score from customer) order by coalesce(score, 0) desc, c_name, c_custkey limit 200")
def score_order(t):
    rows = t("customer").withColumn("score", F.nullif(F.col("c_custkey") % 50, F.lit(7).cast("long")))
    return snapshot.by_score(rows, ["c_name", "c_custkey"], 200).select("c_custkey", "score")


def _browsable(t) -> DataFrame:
    return t("events").select(
        F.col("event_id").cast("string").alias("name"), F.col("event_type").alias("classification"), F.lit(None).cast("string").alias("event_type"),
        F.concat(F.lit("k%"), (F.col("user_id") % 7).cast("string")).alias("primary_messenger"), F.when(F.col("event_id") % 3 == 0, "open").alias("status"),
        F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("score"),
    )


_BROWSE = "(select cast(event_id as varchar) as name, event_type as classification, 'k%' || (user_id % 7) as primary_messenger, case when event_id % 3 = 0 then 'open' end as status, case when event_id % 10 <> 0 then value end as score from events)"


@query(f"select name, score from {_BROWSE} order by score desc nulls last, name limit 150")
def null_last_sort(t):
    return browse.page(_browsable(t), browse.Request()).select("name", "score")


@query(f"select name, score from {_BROWSE} order by score asc nulls last, name limit 300")
def null_last_sort_ascending(t):
    return browse.page(_browsable(t), browse.Request().sorted_by("score").more()).select("name", "score")


@query(f"select name, score from {_BROWSE} where contains(lower(name || ' ' || classification || '  ' || primary_messenger), 'click  k%3')")
def search_text(t):
    return browse.matching(_browsable(t), browse.Request(search=" Click  K%3 ")).select("name", "score")


@query(f"select classification, count(*) as n from {_BROWSE} where status = 'open' and primary_messenger = 'k%2' group by 1")
def facet_filter(t):
    found = browse.matching(_browsable(t), browse.Request(status="open", messenger="k%2"))
    return found.groupBy("classification").agg(F.count("*").alias("n"))


@query(f"select distinct primary_messenger from {_BROWSE}")
def facet_values(t):
    return browse.options(_browsable(t), "primary_messenger")


@query(f"select least(150, count(*) filter (where classification = 'error')) as shown, count(*) filter (where classification = 'error') as matching, count(*) as total from {_BROWSE}")
def page_counts(t):
    return browse.shown_counts(_browsable(t), browse.Request(classification="error"))


@query("select messenger, n, 100.0 * n / max(n) over () as bar from (select o_orderpriority as messenger, count(*) as n from orders group by 1)")
def bar_scaling(t):
    return rollups.scaled(rollups.histogram(t("orders"), F.col("o_orderpriority"), "messenger"))


_SKY = "(select event_id, ts, value, cast(event_id * 7 % 380 as double) as ra_deg, cast(event_id * 3 % 190 as double) - 95 as dec_deg from events)"


def _sky(t) -> DataFrame:
    i = F.col("event_id")
    return t("events").select("event_id", "ts", "value", (i * 7 % 380).cast("double").alias("ra_deg"), ((i * 3 % 190).cast("double") - 95).alias("dec_deg"))


@query(f"select event_id, ra_deg, dec_deg from {_SKY} where ts >= (select max(ts) from events) - interval 7 days and ra_deg >= 0 and ra_deg < 360 and dec_deg between -90 and 90")
def age_window(t):
    rows = _sky(t)
    last = rows.agg(F.max("ts")).first()[0]
    return sky.window(rows, F.col("ts"), F.lit(last).cast("timestamp_ntz"), 7).select("event_id", "ra_deg", "dec_deg")


def _newton_sql() -> str:
    out = f"s0 as (select event_id, ra_deg, radians(dec_deg) as lat, radians(dec_deg) as th from {_SKY} where ra_deg < 360 and dec_deg between -90 and 90)"
    for k in range(1, 9):
        slope = "(2 + 2 * cos(2 * th))"
        out += f", s{k} as (select event_id, ra_deg, lat, case when abs({slope}) < 1e-7 then th else th - (2 * th + sin(2 * th) - pi() * sin(lat)) / {slope} end as th from s{k - 1})"
    return out


@query(f"with {_newton_sql()} select event_id, round(480.0 + (2 * sqrt(2) / pi()) * radians(180 - ra_deg) * cos(th) * (924.0 / (4 * sqrt(2))), 4) as x, round(240.0 - sqrt(2) * sin(th) * (444.0 / (2 * sqrt(2))), 4) as y from s8")
def mollweide(t):
    rows = sky.placed(_sky(t).filter("ra_deg < 360 and dec_deg between -90 and 90"), 960.0, 480.0)
    return rows.select("event_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("select line, count(*) as n, cast(min(ra) as double) as least_ra, cast(max(d) as double) as most_dec from (select 'dec ' || d as line, ra, d from unnest([-60, -30, 0, 30, 60]) a(d), range(0, 361, 4) b(ra) union all select 'ra ' || ra, ra, d from range(0, 331, 30) a(ra), range(-89, 90, 3) b(d)) group by 1")
def graticule(t):
    points = sky.graticule(t("nation").sparkSession, 960.0, 480.0)
    return points.groupBy("line").agg(F.count("x").alias("n"), F.min("ra_deg").alias("least_ra"), F.max("dec_deg").alias("most_dec"))


_T = "greatest(0.0, least(1.0, (m - 13) / 10))"


def _channel(a: int, b: int, c: int) -> str:
    return f"cast(floor(case when u < 0.5 then {a} + ({b} - {a}) * (u * 2) else {b} + ({c} - {b}) * ((u - 0.5) * 2) end + 0.5) as bigint)"


@query(f"select p_partkey, case when m is null then '#a9b3c7' else 'rgb(' || {_channel(255, 88, 132)} || ',' || {_channel(211, 210, 94)} || ',' || {_channel(105, 226, 247)} || ')' end as colour from (select *, {_T} as u from (select p_partkey, case when p_partkey % 9 <> 0 then cast(p_partkey % 15 as double) + 11 end as m from part))")
def mag_colour(t):
    m = F.when(F.col("p_partkey") % 9 != 0, (F.col("p_partkey") % 15).cast("double") + 11)
    return t("part").select("p_partkey", fn.magnitude_colour(m).alias("colour"))


@query("""select event_id, lpad(cast(h as varchar), 2, '0') || ':' || lpad(cast(m as varchar), 2, '0') || ':' || printf('%.1f', ((rh - h) * 60 - m) * 60) || ' ' || case when d < 0 then '-' else '+' end || lpad(cast(dd as varchar), 2, '0') || ':' || lpad(cast(dm as varchar), 2, '0') || ':' || printf('%.0f', ((ad - dd) * 60 - dm) * 60) as place
from (select *, cast(floor((rh - h) * 60) as bigint) as m, cast(floor((ad - dd) * 60) as bigint) as dm from (select *, cast(floor(rh) as bigint) as h, cast(floor(ad) as bigint) as dd from
(select event_id, d, ra / 15 as rh, abs(d) as ad from (select event_id, (event_id * 37 % 3599) * 0.1 + 0.0123 as ra, (event_id * 11 % 1790) * 0.1 - 89.4567 as d from (select event_id * 1.0::double as event_id_, event_id from events)))))""")
def sexagesimal(t):
    i = F.col("event_id")
    ra, dec = (i * 37 % 3599) * F.lit(0.1) + F.lit(0.0123), (i * 11 % 1790) * F.lit(0.1) - F.lit(89.4567)
    return t("events").select("event_id", fn.sexagesimal(ra, dec).alias("place"))


@query("""with q as (select s_suppkey as query_id, cast(s_suppkey * 7 % 101 as double) * 9.5 as qx, s_acctbal / 20 as qy from supplier), p as (select c_custkey as point_id, cast(c_custkey * 13 % 997 as double) as x, c_acctbal / 20 as y from customer),
m as (select query_id, point_id, (x - qx) * (x - qx) + (y - qy) * (y - qy) as d2 from q, p) select query_id, arg_min(point_id, (d2, point_id)) as point_id, min(d2) as d2 from m where d2 < 100 group by 1""")
def nearest_in_radius(t):
    queries = t("supplier").select(F.col("s_suppkey").alias("query_id"), ((F.col("s_suppkey") * 7 % 101).cast("double") * 9.5).alias("x"), (F.col("s_acctbal") / 20).alias("y"))
    points = t("customer").select(F.col("c_custkey").alias("point_id"), (F.col("c_custkey") * 13 % 997).cast("double").alias("x"), (F.col("c_acctbal") / 20).alias("y"))
    return sky.nearest(points, queries)


@query("""with q as (select c_custkey as query_id, cast(c_custkey % 13 as double) + c_acctbal / 1e5 as qx, cast(c_custkey * 7 % 1000 as double) / 90 as qy from customer),
p as (select event_id as point_id, (event_id % 23 * (event_id % 3)) * 0.4 + value / 300 as x, cast(event_id * 7919 % 10007 as double) / 2000 as y from events),
m as (select query_id, point_id, (x - qx) * (x - qx) + (y - qy) * (y - qy) as d2 from q, p) select query_id, arg_min(point_id, (d2, point_id)) as point_id, round(min(d2), 9) as d2 from m where d2 < 100 group by 1""")
def nearest_dense(t):
    """Thousands of points in one square of the radius, and squares with none."""
    k, i = F.col("c_custkey"), F.col("event_id")
    queries = t("customer").select(k.alias("query_id"), ((k % 13).cast("double") + F.col("c_acctbal") / 1e5).alias("x"), ((k * 7 % 1000).cast("double") / 90).alias("y"))
    points = t("events").select(i.alias("point_id"), ((i % 23 * (i % 3)) * F.lit(0.4) + F.col("value") / 300).alias("x"), ((i * 7919 % 10007).cast("double") / 2000).alias("y"))
    return sky.nearest(points, queries).withColumn("d2", F.round("d2", 9))


@query("select event_id, case event_id % 4 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') when 1 then strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00Z') when 2 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') else null end as published from events")
def iso_public(t):
    i, form = F.col("event_id"), lambda p: F.date_format("ts", p)
    text = F.when(i % 4 == 0, form("yyyy-MM-dd HH:mm:ss.SSSSSS")).when(i % 4 == 1, F.concat(form("yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))).when(i % 4 == 2, F.concat(F.lit(" "), form("yyyy-MM-dd'T'HH:mm:ss'Z'"))).otherwise("  ")
    return t("events").select("event_id", fn.iso_public(text).alias("published"))


_OBJECT = "(case event_id % 4 when 0 then 'AT' when 1 then ' sn' when 2 then '' else 'ZTF' end) || (2000 + event_id % 30) || chr(cast(97 + event_id % 26 as int)) || (case when event_id % 7 = 0 then '1' else 'B' end)"


@query(f"select event_id, nullif(regexp_extract(trim({_OBJECT}), '(?i)^(?:AT|SN)?([0-9]{{4}}[a-z]+)$', 1), '') as object_id from events")
def tns_regex(t):
    i = F.col("event_id")
    prefix = F.when(i % 4 == 0, "AT").when(i % 4 == 1, " sn").when(i % 4 == 2, "").otherwise("ZTF")
    text = F.concat(prefix, (2000 + i % 30).cast("string"), F.char(97 + i % 26), F.when(i % 7 == 0, "1").otherwise("B"))
    return t("events").select("event_id", fn.object_id(text).alias("object_id"))


@query("select item_id, case when item_id % 5 = 0 then null else trim(text) end as cleaned from benchmark")
def trim_clean(t):
    text = F.when(F.col("item_id") % 5 == 0, " \t ").otherwise(F.concat(F.lit("\t  "), F.col("text"), F.lit(" \n")))
    return t("benchmark").select("item_id", fn.clean_text(text).alias("cleaned"))


@query("select event_id, cast(json_extract_string(case when event_id % 6 = 0 then null else props end, '$.k') as bigint) as k from events")
def json_factor(t):
    text = F.when(F.col("event_id") % 6 == 0, "{broken").otherwise(F.col("props"))
    return t("events").select("event_id", F.try_variant_get(json_object(text), "$.k", "bigint").alias("k"))


@query("select event_id, case when event_id % 8 > 1 then round(value / 7, 6) end as rounded from events")
def round6(t):
    v = F.when(F.col("event_id") % 8 == 0, F.lit(float("nan"))).when(F.col("event_id") % 8 == 1, F.lit(float("inf"))).otherwise(F.col("value") / 7)
    return t("events").select("event_id", fn.clean_number(v).alias("rounded"))


@query("select user_id, ok, enabled, case when ok > 0 then 'ok' when enabled > 0 then 'degraded' else 'idle' end as status from (select user_id % 10 as user_id, count(*) filter (where event_type = 'view') as ok, count(*) filter (where event_type <> 'click') as enabled from events group by 1)")
def status_machine(t):
    e = F.col("event_type")
    rows = t("events").select((F.col("user_id") % 10).alias("user_id"), F.when(e == "view", "ok").when(e == "click", "disabled").otherwise("error").alias("state"))
    return validate.run_status(rows, "user_id")


@query("select problem, count(*) as n from (select case when c_custkey % 11 = 0 then 'no name' end as problem from customer union all select case when c_custkey % 17 = 0 then 'forbidden content: /Users/' end from customer union all select case when c_custkey % 19 = 0 then 'forbidden content: BEGIN PRIVATE KEY' end from customer) where problem is not null group by 1")
def leak_check(t):
    k = F.col("c_custkey")
    notes = F.concat(F.when(k % 17 == 0, "see /Users/x ").otherwise("fine "), F.when(k % 19 == 0, "BEGIN PRIVATE KEY").otherwise(""))
    rows = t("customer").select(F.when(k % 11 != 0, F.col("c_name")).alias("name"), notes.alias("note"))
    return validate.violations(rows).groupBy("problem").agg(F.count("*").alias("n"))


@query("select k, case when b is null then 'removed' when a is null then 'added' else 'changed' end as change from (select n_nationkey as k, n_name as a from nation where n_nationkey < 20) full join (select n_nationkey as k, case when n_nationkey % 4 = 0 then 'x' else n_name end as b from nation where n_nationkey > 4) using (k) where a is distinct from b")
def drift_diff(t):
    before = t("nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    after = t("nation").filter("n_nationkey > 4").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 4 == 0, "x").otherwise(F.col("n_name")).alias("v"))
    return validate.drift(before, after, "k", "v")


_DIGEST = ", ".join(f"coalesce(sum(('0x' || substr(d, {1 + 12 * i}, 12))::bigint::hugeint), 0) as w{i}" for i in range(4))


@query(f"select sha256(concat_ws(':', n, w0, w1, w2, w3)) as content_hash from (select count(*) as n, {_DIGEST} from (select sha256(json_object('p_partkey', p_partkey, 'p_name', p_name, 'p_size', p_size)) as d from part))")
def content_hash(t):
    rows = t("part").select("p_partkey", "p_name", "p_size", F.lit("now").alias("generated_at"))
    return validate.content_hash(rows)


_ESCAPES = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')"


@query(f"select item_id, '&lt;b title=&quot;' || item_id || '&quot;&gt;' || {_ESCAPES} || '&amp;&#39;' as escaped from benchmark")
def escape_html(t):
    text = F.concat(F.lit('<b title="'), F.col("item_id").cast("string"), F.lit('">'), F.col("text"), F.lit("&'"))
    return t("benchmark").select("item_id", fn.escape_html(text).alias("escaped"))


@query("""select event_id, case event_id % 4 when 0 then printf('%.3f', cast(event_id % 500 as double) / 8) || ' ± ' || printf('%.3f', 0.25) || ' mag' when 1 then 'limit ' || printf('%.3f', cast(event_id % 500 as double) / 8) || ' mag' when 2 then printf('%.4f', cast(event_id % 500 as double) / 8) || ' mJy' else 'recorded observation' end as measured from events""")
def measurement(t):
    i = F.col("event_id")
    when = lambda k: F.when(i % 4 == k, (i % 500).cast("double") / 8)
    return t("events").select("event_id", fn.measurement(when(0), F.lit(0.25), when(1), when(2), F.lit("mJy")).alias("measured"))


_COUNTS = "(select user_id, count(*) filter (where event_type = 'view') as a, count(*) filter (where event_type = 'click' and value > 60) as b from events group by 1)"


def _user_counts(t) -> DataFrame:
    e = F.col("event_type")
    return t("events").groupBy("user_id").agg(F.count_if(e == "view").alias("a"), F.count_if((e == "click") & (F.col("value") > 60)).alias("b"))


@query(f"select user_id, coalesce(nullif(concat_ws(' · ', case when a > 0 then a || ' obs' end, case when b > 0 then b || ' spec' end), ''), 'event record only') as evidence from {_COUNTS}")
def evidence_text(t):
    return _user_counts(t).select("user_id", fn.counted({"obs": F.col("a"), "spec": F.col("b")}, "event record only").alias("evidence"))


@query(f"select user_id, coalesce('Kept ' || nullif(concat_ws(', ', case when a > 0 then a || ' observation' || case when a = 1 then '' else 's' end end, case when b > 0 then b || ' report' || case when b = 1 then '' else 's' end end), '') || '.', 'Nothing kept.') as reason from {_COUNTS}")
def rationale(t):
    return _user_counts(t).select("user_id", fn.rationale({"observation": F.col("a"), "report": F.col("b")}, "Kept ", ".", "Nothing kept.").alias("reason"))


@query("select l_returnflag, l_linestatus, l_discount, count(*) as n, printf('%.1f', l_discount * 100) || '%' as share from lineitem group by 1, 2, 3")
def percent_text(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus", "l_discount").agg(F.count("*").alias("n")).withColumn("share", fn.percent(F.col("l_discount")))


@query("""select event_id, case when m < 1 then 'just now' when m = 1 then '1 minute ago' when m < 60 then m || ' minutes ago' when h = 1 then '1 hour ago' when h < 48 then h || ' hours ago' else cast(floor(h / 24 + 0.5) as bigint) || ' days ago' end as age, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') as moment
from (select *, cast(floor(m / 60 + 0.5) as bigint) as h from (select event_id, ts, cast(floor((epoch_us(timestamp '2024-01-31 00:00:00') - epoch_us(ts)) / 60e6 + 0.5) as bigint) as m from events))""")
def relative_times(t):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return t("events").select("event_id", fn.relative_time(text, F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("age"), fn.absolute_time(text).alias("moment"))


@query("select page_id, case when starts_with(u, 'https://') and (page_id % 3 <> 0 or regexp_matches(u, '^https://www\\.wis-tns\\.org/object/[0-9]{4}[a-z]+$')) then u end as safe from (select page_id, case page_id % 4 when 0 then url when 1 then replace(url, 'http:', 'https:') when 2 then 'https://www.wis-tns.org/object/2024abc' else 'https://www.wis-tns.org/object/x?y' end as u from pages)")
def safe_links(t):
    i = F.col("page_id")
    url = F.when(i % 4 == 0, F.col("url")).when(i % 4 == 1, F.replace("url", F.lit("http:"), F.lit("https:"))).when(i % 4 == 2, "https://www.wis-tns.org/object/2024abc").otherwise("https://www.wis-tns.org/object/x?y")
    return t("pages").select("page_id", fn.safe_link(url, F.when(i % 3 == 0, "TNS").otherwise("GCN")).alias("safe"))


@query("select state, count(*) as n, case state when 'view' then 'ok' when 'click' then 'none' when 'error' then 'error' else 'degraded' end as light, case state when 'view' then 'ok' when 'signup' then 'degraded' when 'click' then 'none' else 'error' end as pipeline_light from (select event_type as state from events) group by 1")
def state_lights(t):
    e = F.col("state")
    source = F.when(e == "view", "ok").when(e == "click", "disabled").otherwise(e)
    pipeline = F.when(e == "view", "ok").when(e == "signup", "degraded").when(e == "click", "idle").otherwise(e)
    rows = t("events").groupBy(F.col("event_type").alias("state")).agg(F.count("*").alias("n"))
    return rows.withColumn("light", fn.source_indicator(source)).withColumn("pipeline_light", fn.pipeline_indicator(pipeline))


@query("select event_id, coalesce(nullif(case when event_id % 3 = 0 then '' when event_id % 3 = 1 then event_type end, ''), nullif(props, ''), 'none') as shown, concat_ws(' · ', case when event_id % 3 > 0 then event_type end, cast(user_id as varchar)) as parts from events")
def first_truthy(t):
    i, e = F.col("event_id"), F.col("event_type")
    shown = fn.first_truthy(F.when(i % 3 == 0, "").when(i % 3 == 1, e), F.col("props"), F.lit("none"))
    return t("events").select("event_id", shown.alias("shown"), fn.dotted(F.when(i % 3 == 0, "").otherwise(e), F.col("user_id")).alias("parts"))


@query("select event_id, case when event_id % 5 > 1 then json_extract_string(props, '$.k') || '.00' end as recency, case when event_id % 5 = 0 then 'held' when event_id % 5 = 2 then 'true' end as status from events")
def score_factors(t):
    i, k = F.col("event_id"), F.get_json_object("props", "$.k")
    text = (
        F.when(i % 5 == 0, F.lit('{"status": " held ", "secret": 1, "recency_points": [1]}')).when(i % 5 == 1, "{broken")
        .when(i % 5 == 2, F.concat(F.lit('{"status": true, "recency_points": '), k, F.lit("}"))).otherwise(F.concat(F.lit('{"status": "", "recency_points": '), k, F.lit("}")))
    )
    factors = snapshot.score_factors(text)
    value = lambda key: fn.factor_text(F.lit(key), F.try_variant_get(F.try_element_at(factors, F.lit(key)), "$", "string"))
    return t("events").select("event_id", value("recency_points").alias("recency"), value("status").alias("status"))


@query("select p_type, string_agg(c, ',' order by c) as leaked from (select distinct p_type, c from (select p_type, case when p_partkey % 2 = 0 then 'token' else 'p_name' end as c from part) where c in ('token')) group by 1")
def key_intersection(t):
    keys = F.array(F.when(F.col("p_partkey") % 2 == 0, "token").otherwise("p_name"))
    return t("part").select("p_type", F.explode(validate.banned_among(keys)).alias("c")).groupBy("p_type").agg(F.array_join(F.sort_array(F.collect_set("c")), ",").alias("leaked"))


_K = "(select *, c_custkey as k from customer)"
_EVENTS = f"""(select 'c' || k as id, case k % 7 when 0 then 1 when 1 then 0 end as simulation, case when k % 11 = 0 then '  ' else ' ' || c_name || ' ' end as preferred_name,
case k % 13 when 0 then 'MERGED' when 1 then 'merged' when 2 then null else 'new' end as status, case when k % 17 > 0 then '2024-01-' || lpad(cast(1 + k % 28 as varchar), 2, '0') || ' ' || lpad(cast(k % 24 as varchar), 2, '0') || ':30:00.25' end as updated_at,
'2023-12-' || lpad(cast(1 + k % 30 as varchar), 2, '0') || 'T00:00:00Z' as discovery_time, case when k % 19 > 0 then cast(k % 101 as double) end as priority_score,
case k % 4 when 0 then ' optical ' when 1 then null else c_mktsegment end as primary_messenger, case when k % 5 > 0 then 'S' || (k % 6) end as discovery_survey from {_K})"""
_OBSERVED = """(select o_orderkey as id, 'c' || o_custkey as event_id, 'p' || (o_orderkey % 5) as provider, case when o_orderkey % 6 > 0 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') end as observed_at
from orders where o_orderstatus in ('F', 'O') and o_orderkey % 5 <> 0)"""
_ROOTS = f"(select * from {_EVENTS} where simulation is null or simulation = 0 order by coalesce(updated_at, discovery_time) desc nulls last, id limit 1000)"
_KEPT = f"""(select trim(preferred_name) as name, status, trim(primary_messenger) as primary_messenger, priority_score as score, left(replace(updated_at, ' ', 'T'), 19) || 'Z' as updated_at, discovery_time, id
from {_ROOTS} where lower(coalesce(status, '')) <> 'merged' and trim(preferred_name) <> '')"""
_SHOWN = f"""(select name, status, primary_messenger, score, updated_at, discovery_time, id, coalesce(n, 0) as n, observed from {_KEPT} left join
(select event_id, count(*) as n, string_agg(coalesce(observed_at, '-'), ' ' order by observed_at desc nulls last, id) as observed from {_OBSERVED} group by 1) on event_id = id)"""


def _tables(t) -> dict[str, DataFrame]:
    """A catalogue made of the driver's tables: customers as events, orders as observations and aliases, regions as sources."""
    tables = empty_catalogue(t("nation").sparkSession)
    k, two = F.col("c_custkey"), lambda c: F.lpad(c.cast("string"), 2, "0")

    def made(name: str, rows: DataFrame, **columns) -> None:
        shown = [(columns[c].cast(kind) if c in columns else F.lit(None).cast(kind)).alias(c) for c, kind in tables[name].dtypes]
        tables[name] = rows.select(*shown)

    made(
        "events", t("customer"), id=F.concat(F.lit("c"), k.cast("string")), simulation=F.when(k % 7 == 0, 1).when(k % 7 == 1, 0),
        preferred_name=F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" "))),
        status=F.when(k % 13 == 0, "MERGED").when(k % 13 == 1, "merged").when(k % 13 != 2, "new"),
        updated_at=F.when(k % 17 > 0, F.concat(F.lit("2024-01-"), two(1 + k % 28), F.lit(" "), two(k % 24), F.lit(":30:00.25"))),
        discovery_time=F.concat(F.lit("2023-12-"), two(1 + k % 30), F.lit("T00:00:00Z")), priority_score=F.when(k % 19 > 0, (k % 101).cast("double")),
        primary_messenger=F.when(k % 4 == 0, " optical ").when(k % 4 > 1, F.col("c_mktsegment")), discovery_survey=F.when(k % 5 > 0, F.concat(F.lit("S"), (k % 6).cast("string"))),
    )
    o, event = F.col("o_orderkey"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    made(
        "observations", t("orders"), id=o, event_id=event, provider=F.concat(F.lit("p"), (o % 5).cast("string")), observed_at=F.when(o % 6 > 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")),
        data_rights=F.when(F.col("o_orderstatus") == "F", "public").when(F.col("o_orderstatus") == "O", "open").otherwise("restricted"), superseded=F.when(o % 5 == 0, 1).when(o % 5 == 1, 0),
    )
    made("aliases", t("orders").filter("o_orderkey % 4 = 0"), event_id=event, provider=F.lit("TNS"), external_id=F.concat(F.lit("AT"), (2000 + o % 3).cast("string"), F.lit("ab")))
    r = F.col("r_regionkey")
    made(
        "sources", t("region"), id=F.concat(F.lit("p"), r.cast("string")), display_name=F.col("r_name"), data_types=F.lit('["a", "b"]'), runtime_state=F.when(r > 0, "ok"),
        lag_seconds=r / 3, enabled=r % 2,
    )
    return tables


_LINKED = "(select 'c' || o_custkey as event_id, string_agg(distinct 'TNS:AT' || (2000 + o_orderkey % 3) || 'ab', ' ' order by 'TNS:AT' || (2000 + o_orderkey % 3) || 'ab') as links from orders where o_orderkey % 4 = 0 group by 1)"


@query(f"select name, status, primary_messenger, score, updated_at, discovery_time, n as n_observations, observed, links from {_SHOWN} left join {_LINKED} on event_id = id")
def snapshot_candidates(t):
    shown = snapshot.candidates(_tables(t), 1000)
    times = F.array_join(F.transform("follow_up.observations", lambda x: F.coalesce(x["observed_at"], F.lit("-"))), " ")
    named = F.array_join(F.transform("links", lambda x: F.concat_ws(":", x["label"], x["designation"])), " ")
    return shown.select(
        "name", "status", "primary_messenger", "score", "updated_at", "discovery_time", F.col("follow_up_counts.observations").alias("n_observations"), times.alias("observed"), named.alias("links")
    )


@query(f"""select count(*) as public_candidates, 0 as classifications, cast(coalesce(sum(n), 0) as bigint) as observations, 0 as spectra, 0 as messenger_signals, 0 as publications, count(*) filter (where n > 0) as candidates_with_follow_up,
(select count(*) from {_EVENTS} where simulation is null or simulation = 0) as real_events, count(*) as published, (select count(*) from {_ROOTS}) - count(*) as skipped from {_SHOWN}""")
def snapshot_statistics(t):
    return snapshot.snapshot(_tables(t), 1000).statistics


@query(f"select coalesce(primary_messenger, 'unknown') as messenger, count(*) as n, 100.0 * count(*) / max(count(*)) over () as bar from {_SHOWN} group by 1")
def snapshot_messengers(t):
    return rollups.bars(snapshot.snapshot(_tables(t), 1000).messengers)


@query(f"""select b.band, count(e.band) as n from (values ('urgent_75_100'), ('high_50_74'), ('routine_25_49'), ('low_0_24')) as b(band) left join
(select case when coalesce(score, 0) >= 75 then 'urgent_75_100' when score >= 50 then 'high_50_74' when score >= 25 then 'routine_25_49' else 'low_0_24' end as band from {_SHOWN}) e on e.band = b.band group by 1""")
def snapshot_bands(t):
    return snapshot.snapshot(_tables(t), 1000).bands


@query(f"select row_number() over (order by coalesce(updated_at, discovery_time) desc, name) as place, name, updated_at, n as n_observations from {_SHOWN} order by 1 limit 20")
def snapshot_recent(t):
    return snapshot.snapshot(_tables(t), 1000).recent.select(F.col("place").cast("long").alias("place"), "name", "updated_at", F.col("follow_up_counts.observations").alias("n_observations"))


@query(f"select row_number() over (order by coalesce(updated_at, discovery_time) desc, name) as place, name from {_SHOWN} order by 1 limit 3")
def stream_top(t):
    return browse.stream_top(snapshot.recent_stream(snapshot.candidates(_tables(t), 1000))).select(F.col("place").cast("long").alias("place"), "name")


@query(f"select provider, count(*) as observations, count(*) as total from {_OBSERVED} group by 1")
def snapshot_providers(t):
    return snapshot.snapshot(_tables(t), 1000).providers.select("provider", "observations", "total")


@query(f"select discovery_survey as survey, count(*) as candidate_count from {_EVENTS} where (simulation is null or simulation = 0) and status <> 'merged' and discovery_survey is not null group by 1")
def snapshot_surveys(t):
    return snapshot.snapshot(_tables(t), 1000).surveys


@query(f"""select 'p' || r_regionkey as source, r_name as label, 'a,b' as data_types, case when r_regionkey > 0 then 'ok' else 'unknown' end as state, round(r_regionkey / 3, 6) as lag_seconds, r_regionkey % 2 = 1 as enabled, n as observations
from region left join (select provider, count(*) as n from {_OBSERVED} group by 1) on provider = 'p' || r_regionkey""")
def snapshot_sources(t):
    shown = snapshot.snapshot(_tables(t), 1000).sources
    return shown.select("source", "label", F.array_join("data_types", ",").alias("data_types"), "state", "lag_seconds", "enabled", F.col("record_counts.observations").alias("observations"))


@query(f"""select trim(preferred_name) as name, priority_score as score, updated_at, case when length(trim(preferred_name)) % 2 = 0 then 'TNS:AT2024ab' end as links from {_EVENTS}
where (simulation is null or simulation = 0) and trim(preferred_name) <> '' and cast(updated_at as timestamp) >= timestamp '2024-01-25 00:00:00' order by coalesce(priority_score, 0) desc, trim(preferred_name) limit 200""")
def feed_top(t):
    feed = snapshot.feed(_feed_summaries(t), F.lit("2024-01-28 00:00:00").cast("timestamp"))
    return feed.select("name", "score", "updated_at", F.array_join(F.transform("links", lambda x: F.concat_ws(":", x["label"], x["designation"])), " ").alias("links"))


def _feed_summaries(t) -> DataFrame:
    rows = _tables(t)["events"].withColumn("preferred_name", F.trim("preferred_name"))
    other = [c for c, _ in snapshot.FEED_PUBLISHED if c not in rows.columns]
    alias = lambda provider, external: F.struct(F.lit(provider).alias("provider"), external.alias("external_id"))
    designation = F.when(F.length("preferred_name") % 2 == 0, "AT2024ab").otherwise("none")
    return rows.withColumns({c: F.lit(None).cast("string") for c in other}).withColumn("aliases", F.array(alias("internal", F.lit("x")), alias("TNS", designation)))


@query("select problem, count(*) as n from (select case when c_custkey % 11 = 0 then 'no name' end as problem from customer union all select case when c_custkey % 17 = 0 then 'forbidden content: .codex' end from customer) where problem is not null group by 1")
def feed_check(t):
    k = F.col("c_custkey")
    notes = F.concat(F.when(k % 17 == 0, "in .codex ").otherwise("fine "), F.when(k % 19 == 0, "BEGIN PRIVATE KEY").otherwise(""))
    rows = t("customer").select(F.when(k % 11 != 0, F.col("c_name")).alias("name"), notes.alias("note"))
    return validate.violations(rows, validate.FORBIDDEN_TEXT_FEED).groupBy("problem").agg(F.count("*").alias("n"))


@query("select event_id, concat_ws('; ', case when event_id % 3 > 0 then 'Recency points=' || json_extract_string(props, '$.k') || '.00' end, case when event_id % 2 = 0 then 'Status override=held' end) as factors from events")
def factor_labels(t):
    i, k = F.col("event_id"), F.get_json_object("props", "$.k")
    parts = F.concat_ws(", ", F.when(i % 2 == 0, '"status": " held "').otherwise('"status": " "'), F.when(i % 3 > 0, F.concat(F.lit('"recency_points": '), k)))
    shown = fn.shown_factors(snapshot.score_factors(F.concat(F.lit("{"), parts, F.lit("}"))))
    text = F.array_join(F.transform(shown, lambda x: F.concat_ws("=", x["label"], x["value"])), "; ")
    return t("events").select("event_id", F.coalesce(text, F.lit("")).alias("factors"))


from emberline.plans import catalogue_documents  # noqa: E402, F401  the import registers queries over the tables above
