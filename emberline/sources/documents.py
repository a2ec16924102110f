"""Writing JSON documents of ordered sections, as a Python Data Source with a commit and an abort.

Rows are (document, rank, section, place, body): body is the JSON of a value, or of one entry of a list; rank and place order a document's sections and
a section's entries. Tasks write their rows to part files; on commit the parts, in the order of the sorted rows, are joined into one file a
document, which then takes its name by a move. The driver streams the parts through and holds one line at a time. On abort the parts go and no document appears.

Which sections there are, whether they are lists and in what order is declared beforehand, so that a list without entries is [].

Cases: no rows give documents of empty lists and nulls. Rows that repeat are written as often as they come. A section that wasn't declared, a second
body of a value, and rows out of order fail the commit.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "document string, rank int, section string, place long, body string"


def _located(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    path: str | None
    first: tuple | None
    last: tuple | None


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self._folder = options["path"]
        self._sections: dict[str, list[list]] = json.loads(options["sections"])
        self._parts = f"{self._folder}/_parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Part:
        from pyspark import TaskContext

        context, stream, first, last = TaskContext.get(), None, None, None
        system, folder = _located(self._parts)
        path = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}"
        try:
            for row in iterator:
                if stream is None:
                    system.create_dir(folder, recursive=True)
                    stream = system.open_output_stream(path)
                last = (row["document"], row["rank"], row["place"])
                first = first or last
                stream.write(f"{row['document']}\t{row['section']}\t{row['body']}\n".encode())
        finally:
            if stream is not None:
                stream.close()
        return _Part(context.partitionId(), path if stream is not None else None, first, last)

    def _lines(self, messages: list[_Part]) -> Iterator[tuple[str, str, str]]:
        parts = [m for m in sorted(messages, key=lambda m: m.partition) if m.path is not None]
        for a, b in zip(parts, parts[1:]):
            if b.first < a.last:
                raise ValueError("rows of documents came out of order")
        system, _ = _located(self._folder)
        for part in parts:
            with system.open_input_stream(part.path) as stream:
                for line in io.TextIOWrapper(stream, "utf-8", newline="\n"):
                    yield tuple(line.rstrip("\n").split("\t", 2))

    def commit(self, messages: list[_Part]) -> None:
        system, folder = _located(self._folder)
        lines = self._lines([m for m in messages if m is not None])
        at = next(lines, None)
        for document in sorted(self._sections):
            staged = f"{folder}/_{document}.json-{uuid.uuid4().hex}"
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(staged) as out:
                say = lambda text: out.write(text.encode())  # noqa: B023, E731
                for k, (section, listed) in enumerate(self._sections[document]):
                    say(("{" if k == 0 else ",\n") + json.dumps(section) + ": " + ("[" if listed else ""))
                    n = 0
                    while at is not None and at[:2] == (document, section):
                        if n and not listed:
                            raise ValueError(f"{document} has {section} twice")
                        say((",\n" if n else "") + at[2])
                        at, n = next(lines, None), n + 1
                    say("]" if listed else "" if n else "null")
                say("}\n")
            system.move(staged, f"{folder}/{document}.json")
        if at is not None:
            raise ValueError(f"{at[0]} has the section {at[1]} where it wasn't declared")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, parts = _located(self._parts)
        if system.get_file_info(parts).type != fs.FileType.NotFound:
            system.delete_dir(parts)


class Documents(DataSource):
    """Options: path, a folder, and sections, as JSON: {document: [[section, whether it is a list], ...]}."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> _Writer:  # noqa: ANN001
        return _Writer(dict(self.options))


def write_documents(rows: DataFrame, folder: str, sections: dict[str, list[tuple[str, bool]]]) -> None:
    """Write folder/{document}.json of each declared document from rows (document, section, place, body)."""
    rows.sparkSession.dataSource.register(Documents)
    ranks = [(d, k, s) for d, all_ in sections.items() for k, (s, _) in enumerate(all_)]
    rank = F.broadcast(rows.sparkSession.createDataFrame(ranks, "document string, rank int, section string"))  # a few rows
    ordered = rows.join(rank, ["document", "section"], "left").select("document", F.coalesce("rank", F.lit(1 << 30)).alias("rank"), "section", "place", "body")
    ordered.orderBy("document", "rank", "place").write.format("documents").mode("append").option("path", folder).option("sections", json.dumps(sections)).save()


def entries(rows: DataFrame, document: str, section: str) -> DataFrame:
    """Each row as an entry of a list, in the order in which the rows stand (after a sort, that order)."""
    placed = rows.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("body"), F.monotonically_increasing_id().alias("place"))
    return placed.select(F.lit(document).alias("document"), F.lit(section).alias("section"), "place", "body")


def values(spark, document: str, **known: object) -> DataFrame:
    """Plain values, each a section."""
    rows = [(document, name, 0, json.dumps(value)) for name, value in known.items()]
    return spark.createDataFrame(rows, "document string, section string, place long, body string")
