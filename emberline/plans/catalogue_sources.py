"""Registered queries over connectors: tables of the driver polled as sources, beside sources that can't be."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.plans.registry import Tables, query
from emberline.sources.connectors import ParquetConnector, Source, items, poll, polled_stream, states
from emberline.sources.storage import shared_folder


def _sources(t: Tables) -> list[Source]:
    kind = f"{ParquetConnector.__module__}:ParquetConnector"
    return [
        Source("orders", kind, {"path": f"{t.folder}/orders.parquet", "columns": "o_orderkey,o_totalprice"}),
        Source("customer", kind, {"path": f"{t.folder}/customer.parquet", "columns": "c_custkey"}, ("KEY",)),
        Source("gone", kind, {"path": f"{t.folder}/no-such-table.parquet"}),
        Source("locked", kind, {"path": f"{t.folder}/nation.parquet"}, ("KEY", "SECRET")),
        Source("lost", "no.such.module:Connector"),
    ]


_STATES = """select 'orders' as source, 'ok' as state, count(*) as n from orders union all select 'customer', 'ok', count(*) from customer
union all select 'gone', 'unavailable', 0 union all select 'locked', 'disabled', 0 union all select 'lost', 'error', 0"""


@query(_STATES)
def connected_states(t):
    return states(poll(t.spark, _sources(t), ("KEY",))).select("source", "state", "n")


@query("""select 'orders' as source, count(*) as n, sum(o_orderkey) as keys, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as price from orders
union all select 'customer', count(*), sum(c_custkey), null from customer""")
def connected_items(t):
    body = F.from_json("body", "o_orderkey long, o_totalprice decimal(18,2), c_custkey long")
    read = items(poll(t.spark, _sources(t), ("KEY",), per_split=5000)).withColumn("row", body)
    return read.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.coalesce("row.o_orderkey", "row.c_custkey")).alias("keys"), F.sum("row.o_totalprice").cast("double").alias("price"))


@query(f"""with a as (select (select count(*) from orders) as o, (select count(*) from customer) as c),
b as (select *, least(c, greatest(1000, 2000 - o)) as c1 from a), d as (select *, least(o, 2000 - c1) as o1 from b),
e as (select *, least(c - c1, greatest(1000, 2000 - (o - o1))) as c2 from d), f as (select c1 + c2 as c, o1 + least(o - o1, 2000 - c2) as o from e)
select source, state, k as n, k as kept from (select source, state, cast(case source when 'orders' then (select o from f) when 'customer' then (select c from f) else 0 end as bigint) as k from ({_STATES}))""")
def connected_stream(t):
    """Two runs of a stream of at most 2,000 items each; the runs share their items evenly between the two sources that have any."""
    folder = shared_folder(t.spark)
    for _ in range(2):
        rows = polled_stream(t.spark, _sources(t), ("KEY",), most_items=2000, per_split=300)
        rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start().awaitTermination()
    read = t.spark.read.parquet(f"{folder}/rows")
    kept = items(read).groupBy("source").agg(F.countDistinct("item").alias("kept"))
    return states(read).join(kept, "source", "left").select("source", "state", "n", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))
