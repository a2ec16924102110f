"""Connectors: sources named in a table, polled in parallel, whose failures are rows and not failed jobs.

A connector class says how many items its source has now and gives the items of a range, as text, in pages. The table of sources names each
source's class, its options and the settings it requires; a source without its settings is disabled, and one whose class can't be loaded or made is in error.

`Polled` is a Python Data Source: `spark.read.format("polled")` reads all sources at once, a partition for each range of `per_split` items.
`polled_stream` reads them as a stream. Its offsets are one number for each source, so a restart goes on where the last run ended; a run
takes `most_items` items at most, dealt evenly among the sources that have any. The stream's source itself plans ranges only (a few numbers pass the
driver); tasks read the items.

Every range gives its items and then one row with a state: `ok`, `timeout` if the source took longer than it may, or `unavailable` with the error if
it failed; items from before a failure are kept. `items` and `states` separate the two.

Cases: a source without items is ok with 0. A retried task polls its range again. Items may be null. The state of a source with several ranges is
its worst. A stream goes on behind a range that failed: the state's row stands where the items are missing.
"""

from __future__ import annotations

import json
import queue
import threading
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from importlib import import_module

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "source string, item long, body string, state string, detail string"
_RANGE = "spec string, start long, stop long, state string, detail string"
#: From best to worst.
STATES = ("ok", "disabled", "timeout", "unavailable", "error")
_PAGE = 1000
#: In the stream's offsets, beside the sources: how many runs there were.
_RUNS = ""


@dataclass(frozen=True)
class Source:
    """A row of the table of sources. connector is "module:Class"; requires names the settings it can't do without."""

    source: str
    connector: str
    options: dict[str, str] = field(default_factory=dict)
    requires: tuple[str, ...] = ()


class Connector:
    """One source. Items are numbered from 0 and stay what they are once counted."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def size(self) -> int:
        """How many items there are now."""
        raise NotImplementedError

    def pages(self, start: int, stop: int) -> Iterator[list[str | None]]:
        """The items from start until stop, in order."""
        raise NotImplementedError


class ParquetConnector(Connector):
    """The rows of one Parquet file, each as JSON. Row groups outside a range aren't read."""

    def _file(self):
        from pyarrow import fs, parquet

        system, path = fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (fs.LocalFileSystem(), self.options["path"])
        return parquet.ParquetFile(system.open_input_file(path))

    def size(self) -> int:
        with self._file() as file:
            return file.metadata.num_rows

    def pages(self, start: int, stop: int) -> Iterator[list[str | None]]:
        columns = self.options["columns"].split(",") if "columns" in self.options else None
        with self._file() as file:
            first = 0
            for group in range(file.metadata.num_row_groups):
                rows = file.metadata.row_group(group).num_rows
                if first < stop and first + rows > start:
                    at = first
                    for batch in file.iter_batches(_PAGE, row_groups=[group], columns=columns):
                        own = batch.slice(max(0, start - at), max(0, min(len(batch), stop - at) - max(0, start - at)))
                        if len(own):
                            yield [json.dumps(r, default=str) for r in own.to_pylist()]
                        at += len(batch)
                first += rows


class FolderConnector(Connector):
    """The lines of a folder's files in order of their names: a queue to which files are added."""

    def _files(self) -> list:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (fs.LocalFileSystem(), self.options["path"])
        return [(system, info.path) for info in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda i: i.path) if info.is_file and not info.base_name.startswith((".", "_"))]

    def _lines(self) -> Iterator[str]:
        for system, path in self._files():
            with system.open_input_stream(path) as stream:
                rest = b""
                while part := stream.read(1 << 20):
                    *lines, rest = (rest + part).split(b"\n")
                    yield from (line.decode() for line in lines)
                if rest:
                    yield rest.decode()

    def size(self) -> int:
        return sum(1 for _ in self._lines())

    def pages(self, start: int, stop: int) -> Iterator[list[str | None]]:
        page: list[str | None] = []
        for k, line in enumerate(self._lines()):
            if k >= stop:
                break
            if k >= start:
                page.append(line)
            if len(page) == _PAGE:
                yield page
                page = []
        if page:
            yield page


def _made(spec: dict) -> Connector:
    module, name = spec["connector"].split(":")
    return getattr(import_module(module), name)(spec["options"])


def _failure(error: BaseException) -> str:
    return f"{type(error).__name__}: {str(error)[:160]}"


def _within(pages: Iterator[list], seconds: float) -> Iterator[list]:
    """pages, from a thread of its own, or TimeoutError when the next one isn't there in time."""
    ready: queue.Queue = queue.Queue(maxsize=4)
    over = threading.Event()

    def put(kind: str, value: object) -> None:
        while not over.is_set():
            try:
                return ready.put((kind, value), timeout=0.2)
            except queue.Full:
                continue

    def work() -> None:
        try:
            for page in pages:
                put("page", page)
                if over.is_set():
                    return
            put("end", None)
        except BaseException as error:  # noqa: BLE001  the source's failure is what is reported
            put("failed", error)

    threading.Thread(target=work, daemon=True).start()
    last = time.monotonic() + seconds
    try:
        while True:
            try:
                kind, value = ready.get(timeout=max(0.0, last - time.monotonic()))
            except queue.Empty:
                raise TimeoutError(f"no response within {seconds:g}s") from None
            if kind == "end":
                return
            if kind == "failed":
                raise value
            yield value
    finally:
        over.set()


def _rows(source: str, start: int, page: list, state: str | None = None, detail: str | None = None) -> pa.RecordBatch:
    n = len(page)
    columns = ([source] * n, range(start, start + n), page, [None] * n, [None] * n) if state is None else ([source], [start], [None], [state], [detail])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["source", "item", "body", "state", "detail"])


def polled(spec: dict, start: int, stop: int, state: str | None, detail: str | None, seconds: float) -> Iterator[pa.RecordBatch]:
    """The items of a range and its state. The number in a state's row is how many items the range gave."""
    source, taken = spec["source"], 0
    if state is not None:
        yield _rows(source, 0, [], state, detail)
        return
    try:
        for page in _within(_made(spec).pages(start, stop), seconds):
            yield _rows(source, start + taken, page)
            taken += len(page)
    except TimeoutError as error:
        yield _rows(source, taken, [], "timeout", str(error)[:160])
    except Exception as error:  # noqa: BLE001  whatever a connector raises
        yield _rows(source, taken, [], "unavailable", _failure(error))
    else:
        yield _rows(source, taken, [], "ok", None)


def sized(spec: dict, known: set[str], seconds: float) -> tuple[int, str | None, str | None]:
    """(how many items, state, detail) of a source before it is read; the state is None if it can be read."""
    missing = [name for name in spec["requires"] if name not in known]
    if missing:
        return 0, "disabled", f"not configured, requires {', '.join(missing)}"
    try:
        connector = _made(spec)
    except Exception as error:  # noqa: BLE001
        return 0, "error", f"could not start: {type(error).__name__}"
    try:
        return next(_within(([connector.size()] for _ in range(1)), seconds))[0], None, None
    except TimeoutError as error:
        return 0, "timeout", str(error)
    except Exception as error:  # noqa: BLE001
        return 0, "unavailable", _failure(error)


@dataclass
class _Split(InputPartition):
    spec: dict
    start: int
    stop: int
    state: str | None
    detail: str | None


class _Settings:
    """The options of a poll."""

    def __init__(self, options: dict[str, str]):
        self.sources = json.loads(options["sources"])
        self.known = set(json.loads(options.get("settings", "[]")))
        self.seconds = float(options.get("seconds", 180))
        self.per_split = int(options.get("per_split", 10_000))
        self.most = int(options.get("most_items", 5000))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self._set = _Settings(options)

    def partitions(self) -> list[_Split]:
        out = []
        for spec in self._set.sources:
            n, state, detail = sized(spec, self._set.known, self._set.seconds)
            ranges = [(k, min(n, k + self._set.per_split)) for k in range(0, n, self._set.per_split)] or [(0, 0)]
            out += [_Split(spec, a, b, state, detail) for a, b in ranges]
        return out

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        return polled(partition.spec, partition.start, partition.stop, partition.state, partition.detail, self._set.seconds)


class _Ranges(SimpleDataSourceStreamReader):
    """The ranges of the next run, and where they end."""

    def __init__(self, options: dict[str, str]):
        self._set = _Settings(options)

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {_RUNS: 0} | {spec["source"]: 0 for spec in self._set.sources}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        seen = [(spec, start.get(spec["source"], 0), *sized(spec, self._set.known, self._set.seconds)) for spec in self._set.sources]
        waiting = {spec["source"]: max(0, n - at) for spec, at, n, *_ in seen}
        taken, left = dict.fromkeys(waiting, 0), self._set.most
        while left and (hungry := [s for s in waiting if waiting[s] > taken[s]]):  # an even share each, as long as there is anything to take
            share = max(1, left // len(hungry))
            for s in hungry:
                more = min(share, waiting[s] - taken[s], left)
                taken[s], left = taken[s] + more, left - more
        rows, end = [], {_RUNS: start.get(_RUNS, 0) + 1}  # a run without items has states to tell, too
        for spec, at, _, state, detail in seen:
            end[spec["source"]] = stop = at + taken[spec["source"]]
            for a in range(at, stop, self._set.per_split) if state is None and stop > at else [at]:
                rows.append((json.dumps(spec), a, min(stop, a + self._set.per_split), state, detail))
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802  Spark's name
        """The same ranges again after a restart."""
        rows = []
        for spec in self._set.sources:
            a, stop = start.get(spec["source"], 0), end.get(spec["source"], 0)
            _, state, detail = sized(spec, self._set.known, self._set.seconds)
            rows += [(json.dumps(spec), k, min(stop, k + self._set.per_split), None if stop > a else state, detail) for k in (range(a, stop, self._set.per_split) if stop > a else [a])]
        return iter(rows)


class Polled(DataSource):
    """All sources of a table of sources. Options: sources (JSON), settings (JSON list of the settings' names that are there), seconds, per_split, most_items."""

    @classmethod
    def name(cls) -> str:
        return "polled"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(dict(self.options))


class PolledRanges(DataSource):
    """The ranges that a stream of sources is to read."""

    @classmethod
    def name(cls) -> str:
        return "polled_ranges"

    def schema(self) -> str:
        return _RANGE

    def simpleStreamReader(self, schema) -> _Ranges:  # noqa: ANN001, N802  Spark's name
        return _Ranges(dict(self.options))


def _options(sources: list[Source], settings: tuple[str, ...], **more) -> dict[str, str]:
    return {"sources": json.dumps([asdict(s) for s in sources]), "settings": json.dumps(list(settings)), **{k: str(v) for k, v in more.items()}}


def poll(spark: SparkSession, sources: list[Source], settings: tuple[str, ...] = (), **options) -> DataFrame:
    """Items and states of all sources, once. settings: the names of the settings that are there."""
    spark.dataSource.register(Polled)
    return spark.read.format("polled").options(**_options(sources, settings, **options)).load()


def polled_stream(spark: SparkSession, sources: list[Source], settings: tuple[str, ...] = (), **options) -> DataFrame:
    """Items and states of all sources as a stream; with the trigger availableNow, one run of at most most_items items."""
    spark.dataSource.register(PolledRanges)
    ranges = spark.readStream.format("polled_ranges").options(**_options(sources, settings, **options)).load()
    seconds = _Settings(_options(sources, settings, **options)).seconds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from polled(json.loads(r["spec"]), r["start"], r["stop"], r["state"], r["detail"], seconds)

    return ranges.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, SCHEMA)


def items(rows: DataFrame) -> DataFrame:
    """source, item, body."""
    return rows.filter("state is null").select("source", "item", "body")


def states(rows: DataFrame) -> DataFrame:
    """source, state, detail, n: one row for each source with its worst state and how many items it gave."""
    rank = F.array_position(F.array(*(F.lit(s) for s in STATES)), F.col("state"))
    told = rows.filter("state is not null").groupBy("source").agg(F.max(F.struct(rank.alias("_rank"), "state", "detail")).alias("_worst"), F.sum("item").alias("n"))
    return told.select("source", "_worst.state", "_worst.detail", "n")
