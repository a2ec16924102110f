"""Public links of a record, from its aliases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalars import clean_text, filled, object_id


@dataclass(frozen=True)
class Provider:
    name: str
    label: str
    template: str | None = None
    #: The alias must hold an object identifier for a url (or, in the strict profile, for a link at all).
    parsed: bool = False


#: Providers whose designations may be published, and how to link them.
SNAPSHOT_PROVIDERS = (
    Provider("tns", "TNS", "https://www.wis-tns.org/object/{id}", True),
    Provider("tns-astronotes", "TNS AstroNote"),
    Provider("tns-public-reports", "TNS report"),
    Provider("gcn", "GCN"),
)
FEED_PROVIDERS = (
    Provider("tns", "TNS", "https://www.wis-tns.org/object/{id}", True),
    Provider("fink", "Fink", "https://api.lsst.fink-portal.org/{id}"),
    Provider("fink-lsst", "Fink", "https://api.lsst.fink-portal.org/{id}"),
)
MOST = 6


def link(provider: Column, external_id: Column, providers: tuple[Provider, ...] = SNAPSHOT_PROVIDERS, strict: bool = False) -> Column:
    """struct<p, label, designation, url> of one alias; null for unknown providers and blank designations.

    strict: without the identifier a parsed provider's link is null, not just its url.
    """
    name, designation = F.lower(provider), clean_text(external_id)
    out = F.lit(None)
    for known in providers:
        target = object_id(designation) if known.parsed else designation
        url = filled(F.lit(known.template).cast("string"), target)
        found = F.struct(name.alias("p"), F.lit(known.label).alias("label"), designation.alias("designation"), url.alias("url"))
        kept = (name == known.name) & designation.isNotNull() & (url.isNotNull() if strict and known.parsed else F.lit(True))
        out = F.when(kept, found).otherwise(out)
    return out


def links_of(aliases: Column, providers: tuple[Provider, ...], strict: bool = False) -> Column:
    """At most six links of an array<struct<provider, external_id>>, in its order; null if there are none."""
    found = F.array_compact(F.transform(aliases, lambda a: link(a["provider"], a["external_id"], providers, strict)))
    shown = F.transform(F.slice(found, 1, MOST), lambda x: F.struct(x["label"].alias("label"), x["designation"].alias("designation"), x["url"].alias("url")))
    return F.when(F.size(found) > 0, shown)


def links(aliases: DataFrame, providers: tuple[Provider, ...] = SNAPSHOT_PROVIDERS, key: str = "event_id", strict: bool = False) -> DataFrame:
    """(key, links): at most six of array<struct<label, designation, url>>, each once, in order of provider and designation.

    Repeated aliases go first and each key keeps six before anything is gathered, so no key's aliases meet in one array.
    """
    found = aliases.select(key, link(F.col("provider"), F.col("external_id"), providers, strict).alias("_l")).filter("_l is not null").distinct()
    order = Window.partitionBy(key).orderBy("_l.p", "_l.designation")
    top = found.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= MOST)
    ordered = F.array_sort(F.collect_list(F.struct("_k", F.struct("_l.label", "_l.designation", "_l.url").alias("link"))))
    return top.groupBy(key).agg(F.transform(ordered, lambda x: x["link"]).alias("links"))
