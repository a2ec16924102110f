"""Registered queries that look up stored ranges and postings instead of sorting or scanning a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.operators.digest import changes, stored_version
from emberline.operators.paging import Pages
from emberline.operators.search import SearchIndex
from emberline.plans.registry import query
from emberline.sources.storage import shared_folder

_ORDERED = "select event_id, score, row_number() over (order by score desc nulls last, event_id) - 1 as place from (select event_id, case when event_id % 4 > 0 then cast(floor(value) as bigint) end as score from events)"


@query(f"select event_id, score, place from ({_ORDERED}) where place between 450 and 599 or place >= (select count(*) from events) - 40")
def seek_pages(t):
    """The fourth page of 150, and the last 40 rows, of events by score (null last) and id: ties in plenty."""
    rows = t("events").select("event_id", F.when(F.col("event_id") % 4 > 0, F.floor("value").cast("long")).alias("score"))
    pages = Pages.of(rows, [F.col("score").desc_nulls_last(), F.col("event_id")], shared_folder(t.spark), per_range=2000)
    return pages.page(3, 150).unionByName(pages.rows(pages.total - 40, 40))


@query("select doc_id, 'licensed under' as wanted from documents where contains(lower(coalesce(text, '')), 'licensed under') union all select doc_id, 'é' from documents where contains(lower(coalesce(text, '')), 'é')")
def search_index(t):
    """Documents that hold a phrase, through their trigrams, and a short search, which scans."""
    index = SearchIndex.of(t("documents").select("doc_id", "text"), "doc_id", F.col("text"), shared_folder(t.spark))
    found = [index.find(wanted).select("doc_id", F.lit(wanted).alias("wanted")) for wanted in ("licensed under", "é")]
    return found[0].unionByName(found[1])


@query("""select k, case when b is null then 'removed' when a is null then 'added' else 'changed' end as change from (select o_orderkey as k, o_totalprice as a from orders where o_orderkey % 101 <> 7) full join
(select o_orderkey as k, case when o_orderkey % 97 = 0 then -1 else o_totalprice end as b from orders where o_orderkey % 103 <> 9) using (k) where a is distinct from b""")
def drift_by_digest(t):
    """Orders removed, added and changed between two stored versions, from the parts whose digests differ."""
    k, folder = F.col("o_orderkey"), shared_folder(t.spark)
    rows = t("orders").select(k.alias("k"), F.col("o_totalprice").alias("v"))
    before = stored_version(rows.filter("k % 101 <> 7"), "k", f"{folder}/before")
    after = stored_version(rows.filter("k % 103 <> 9").withColumn("v", F.when(F.col("k") % 97 == 0, F.lit(-1.0)).otherwise(F.col("v"))), "k", f"{folder}/after")
    return changes(before, after)
