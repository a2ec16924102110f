"""Connectors: items and states of sources that work, fail, hang, lack settings or can't be loaded."""

from __future__ import annotations

import json
import time

import pytest

from emberline.sources.connectors import Connector, FolderConnector, ParquetConnector, Source, items, poll, polled_stream, states


class Counting(Connector):
    def size(self):
        return int(self.options["n"])

    def pages(self, start, stop):
        for k in range(start, stop):
            if str(k) == self.options.get("fails_at"):
                raise ConnectionError("gone " + "x" * 500)
            if str(k) == self.options.get("hangs_at"):
                time.sleep(60)
            yield [json.dumps({"k": k})]


class Unsized(Connector):
    def size(self):
        raise OSError("no answer")


class Unmade(Connector):
    def __init__(self, options):
        raise KeyError("token")


def source(name, cls=Counting, requires=(), **options):
    return Source(name, f"{cls.__module__}:{cls.__name__}", {k: str(v) for k, v in options.items()}, requires)


ALL = [
    source("good", n=25), source("empty", n=0), source("fails", n=25, fails_at=7), source("hangs", n=3, hangs_at=1), source("down", Unsized), source("bad", Unmade),
    Source("lost", "no.such.module:Class"), source("locked", requires=("ID", "KEY"), n=5), source("open", requires=("ID",), n=5),
]
EXPECTED = {
    "good": ("ok", None, 25), "empty": ("ok", None, 0), "hangs": ("timeout", "no response within 3s", 1), "down": ("unavailable", "OSError: no answer", 0), "bad": ("error", "could not start: KeyError", 0),
    "lost": ("error", "could not start: ModuleNotFoundError", 0), "locked": ("disabled", "not configured, requires KEY", 0), "open": ("ok", None, 5),
}


def test_states_and_items_of_a_poll(spark):
    rows = poll(spark, ALL, ("ID",), seconds=3, per_split=10).cache()
    found = {r["source"]: (r["state"], r["detail"], r["n"]) for r in states(rows).collect()}
    fails = found.pop("fails")
    assert found == EXPECTED and set(found) == set(EXPECTED)
    assert fails[0] == "unavailable" and fails[1].startswith("ConnectionError: gone") and len(fails[1]) == len("ConnectionError: ") + 160 and fails[2] == 7 + 15  # its other ranges went well
    bodies = {}
    for r in items(rows).collect():
        assert json.loads(r["body"])["k"] == r["item"]
        bodies.setdefault(r["source"], []).append(r["item"])
    assert sorted(bodies["good"]) == list(range(25)) and sorted(bodies["fails"]) == [*range(7), *range(10, 25)] and bodies["hangs"] == [0]
    assert rows.rdd.getNumPartitions() >= 3
    rows.unpersist()


def test_parquet_ranges(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import parquet

    path = str(tmp_path / "t.parquet")
    parquet.write_table(pa.table({"a": list(range(5000)), "b": ["x"] * 5000}), path, row_group_size=1300)
    made = ParquetConnector({"path": path, "columns": "a"})
    assert made.size() == 5000
    for start, stop in ((0, 5000), (1299, 1301), (0, 0), (4999, 5000), (700, 3950)):
        assert [json.loads(x) for page in made.pages(start, stop) for x in page] == [{"a": k} for k in range(start, stop)]


def drained(spark, sources, table, mark, most):
    query = polled_stream(spark, sources, most_items=most, per_split=4).writeStream.format("parquet").option("path", table).option("checkpointLocation", mark).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return sorted((r["source"], r["item"]) for r in items(spark.read.parquet(table)).collect())


def test_a_stream_goes_on_where_it_ended_and_keeps_its_bound(spark, tmp_path):
    folder, table, mark = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "mark")
    folder.mkdir()
    (folder / "1").write_text("\n".join(f"line {k}" for k in range(6)))
    sources = [Source("folder", f"{FolderConnector.__module__}:FolderConnector", {"path": str(folder)}), source("good", n=25), source("fails", n=2, fails_at=0), source("locked", requires=("ID",), n=5)]
    first = drained(spark, sources, table, mark, 12)
    assert first == [*(("folder", k) for k in range(5)), *(("good", k) for k in range(5))]  # twelve were dealt: five each, and two that failed
    (folder / "2").write_text("more\nyet more\n")
    second = drained(spark, sources, table, mark, 12)
    assert second == [*(("folder", k) for k in range(8)), *(("good", k) for k in range(14))]
    third = drained(spark, sources, table, mark, 1000)
    assert third == [*(("folder", k) for k in range(8)), *(("good", k) for k in range(25))]
    assert drained(spark, sources, table, mark, 1000) == third
    last = {r["source"]: r["state"] for r in states(spark.read.parquet(table)).collect()}
    assert last == {"folder": "ok", "good": "ok", "fails": "unavailable", "locked": "disabled"}
    lines = [r["body"] for r in items(spark.read.parquet(table)).filter("source = 'folder'").orderBy("item").collect()]
    assert lines == [f"line {k}" for k in range(6)] + ["more", "yet more"]


@pytest.mark.parametrize("most", [1, 7, 100])
def test_shares_are_even_and_whole(most):
    from emberline.sources import connectors

    reader = connectors._Ranges(connectors._options([source("a", n=3), source("b", n=50), source("c", n=0)], (), most_items=most))
    at, total = reader.initialOffset(), 0
    for _ in range(60):
        rows, end = reader.read(at)
        step = sum(end.values()) - sum(at.values()) - 1
        assert step == min(most, 53 - total) and list(rows)
        total, at = total + step, end
    assert at == {"": 60, "a": 3, "b": 50, "c": 0}
