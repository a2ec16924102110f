"""Selecting root rows, and attaching their child rows as ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rights under which a row may be published.
PUBLIC_RIGHTS = ("public", "open")


def unset(flag: str) -> Column:
    """The flag is 0 or null, in a form that reaches the scan."""
    return F.col(flag).isNull() | (F.col(flag) == 0)


def public(rows: DataFrame, *flags: str, rights: str = "data_rights") -> DataFrame:
    """Rows with public rights (null isn't) whose flags are all unset."""
    kept = rows.filter(F.col(rights).isin(*PUBLIC_RIGHTS))
    for flag in flags:
        kept = kept.filter(unset(flag))
    return kept


def latest(rows: DataFrame, time: Column, tie: list[str], most: int) -> DataFrame:
    """The `most` rows with the latest time (null last). Later filters don't refill them."""
    return rows.orderBy(time.desc_nulls_last(), *tie).limit(most)


def not_merged(status: Column) -> Column:
    """Not merged, in any case; null counts as not merged."""
    return F.lower(F.coalesce(status, F.lit(""))) != "merged"


def latest_revision(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """One row for each key: the last by time, then by tie."""
    order = Window.partitionBy(key).orderBy(F.col(time).desc_nulls_last(), F.col(tie).desc())
    return rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def of(children: DataFrame, roots: DataFrame, key: str, root_key: str) -> DataFrame:
    """The children of the roots."""
    return children.join(roots.select(F.col(root_key).alias(key)), key, "left_semi")


def gathered(children: DataFrame, key: str, time: str, tie: str, fields: list[Column], name: str) -> DataFrame:
    """One row for each key with its children as an array, by time descending (null last), then tie ascending.

    The order is made within the array: a sort before grouping wouldn't be a guarantee.
    """
    item = F.struct(F.col(time).alias("_time"), F.col(tie).alias("_tie"), F.struct(*fields).alias("_row"))

    def order(a: Column, b: Column) -> Column:
        by_tie = F.when(a["_tie"] < b["_tie"], -1).when(a["_tie"] > b["_tie"], 1).otherwise(0)
        return (
            F.when(a["_time"].isNull() & b["_time"].isNull(), by_tie).when(a["_time"].isNull(), 1).when(b["_time"].isNull(), -1)
            .when(a["_time"] > b["_time"], -1).when(a["_time"] < b["_time"], 1).otherwise(by_tie)
        )

    return children.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item), order), lambda x: x["_row"]).alias(name))


def attached(roots: DataFrame, key: str, lists: dict[str, DataFrame], child_key: str) -> DataFrame:
    """roots with each list (one row for each key), empty where there is none."""
    out = roots
    for name, rows in lists.items():
        kind = rows.schema[name].dataType.simpleString()
        out = out.join(rows.withColumnRenamed(child_key, key), key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))
    return out


def counts(out: DataFrame, names: list[str]) -> DataFrame:
    """out with follow_up_counts and follow_up_total."""
    each = F.struct(*(F.size(n).cast("long").alias(n) for n in names))
    return out.withColumn("follow_up_counts", each).withColumn("follow_up_total", sum((F.size(n).cast("long") for n in names), F.lit(0).cast("long")))


def attached_counts(roots: DataFrame, key: str, tables: dict[str, DataFrame], child_key: str) -> DataFrame:
    """roots with the number of each table's rows, 0 where there are none: counted before the join, so no lists are made."""
    out = roots
    for name, rows in tables.items():
        counted = rows.groupBy(F.col(child_key).alias(key)).agg(F.count("*").alias(name))
        out = out.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out
