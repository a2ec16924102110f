"""Interactive queries over published candidates: filter, search, sort, page."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 150


@dataclass(frozen=True)
class Request:
    search: str = ""
    classification: str = ""
    messenger: str = ""
    status: str = ""
    sort_by: str = "score"
    descending: bool = True
    shown: int = PAGE

    def sorted_by(self, column: str) -> Request:
        """The same column again turns round; another starts descending, but `name` ascending."""
        return replace(self, sort_by=column, descending=not self.descending if column == self.sort_by else column != "name")

    def more(self) -> Request:
        return replace(self, shown=self.shown + PAGE)


def text_of(*columns: str) -> Column:
    """The searchable text: columns with spaces between, null as empty, in lower case."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    spaced = [x for p in parts for x in (F.lit(" "), p)][1:]
    return F.lower(F.concat(*spaced))


def matching(rows: DataFrame, request: Request) -> DataFrame:
    """Rows that pass the exact filters and hold the search text as a plain substring."""
    out = rows
    for column, wanted in (("classification", request.classification), ("primary_messenger", request.messenger), ("status", request.status)):
        if wanted:
            out = out.filter(F.coalesce(F.col(column), F.lit("")) == wanted)
    wanted = request.search.strip().lower()
    return out.filter(text_of("name", "classification", "event_type", "primary_messenger").contains(wanted)) if wanted else out


def order(rows: DataFrame, request: Request, tie: str = "name") -> list[Column]:
    """Nulls last in both directions; text by Unicode collation; then by tie."""
    column = F.col(request.sort_by)
    if rows.schema[request.sort_by].dataType.simpleString() == "string":
        column = F.collate(column, "UNICODE")
    return [column.desc_nulls_last() if request.descending else column.asc_nulls_last(), F.col(tie)]


def page(rows: DataFrame, request: Request, tie: str = "name") -> DataFrame:
    """The rows shown so far: a bounded top of the whole filtered and sorted set."""
    found = matching(rows, request)
    return found.orderBy(*order(found, request, tie)).limit(request.shown)


def shown_counts(rows: DataFrame, request: Request) -> DataFrame:
    """shown, matching and total rows."""
    return matching(rows, request).agg(F.count("*").alias("matching")).crossJoin(rows.agg(F.count("*").alias("total"))).select(
        F.least(F.lit(request.shown), F.col("matching")).alias("shown"), "matching", "total"
    )  # two one-row frames


def options(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values that aren't null or empty, in binary order."""
    return rows.select(column).filter(F.col(column).isNotNull() & (F.col(column) != "")).distinct().orderBy(column)


def active_sources(sources: DataFrame, kinds: list[str]) -> DataFrame:
    """Sources with any records, and their total."""
    total = sum((F.coalesce(F.col(k), F.lit(0)) for k in kinds), F.lit(0))
    return sources.withColumn("records", total).filter("records > 0")


def stream_top(recent: DataFrame, most: int = 3) -> DataFrame:
    """The first rows of the recent stream, by their place in it."""
    return recent.orderBy("place").limit(most)
