"""Substring search through a table of trigrams.

Trigrams are of the bytes (UTF-8) of the text in lower case, as the search is. Texts are taken in chunks; for each trigram of a chunk one row says which of the
chunk's texts hold it, as positions or as bits, whichever are fewer bytes, and one more row holds the chunk's ids. These rows are stored in `parts` folders by
trigram. A search of three bytes or more looks up the counts of its own trigrams, reads the rows of its rarest ones alone, and verifies the texts that hold all of
these by a plain `contains`; a shorter one scans. So a search reads a few folders of postings, and searches the texts of its candidates.

Null text is empty and holds nothing but the empty search, which finds all rows. Null ids take no part. Of rows with equal ids those that hold the search are found.
Empty tables find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.sources.storage import removed, stored

#: How many of a search's trigrams are looked up in the postings, by bytes in a character.
_RAREST = 3
#: Up to this many candidates are broadcast to the texts. With more, the texts are scanned: shuffling them would cost more than it saves.
_BROADCAST = 200_000
#: A chunk holds up to so many bytes of text, or one longer text, and so many texts (their positions are two bytes).
_BYTES, _TEXTS = 1 << 23, 1 << 16
#: The folder of the chunks' ids.
_IDS = -1


def trigrams(raw: bytes) -> list[int]:
    """The distinct trigrams of bytes, as numbers."""
    return sorted({int.from_bytes(raw[k : k + 3], "big") for k in range(len(raw) - 2)})


def _part(gram, parts: int):
    """The folder of a trigram, or of an array of them."""
    return (gram * 2_654_435_761 % (1 << 32) >> 16) % parts


def _chunks(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts, each a chunk. ends: where each text begins, and the end of the last."""
    first, n = 0, len(ends) - 1
    while first < n:
        stop = int(np.searchsorted(ends, ends[first] + _BYTES, "right")) - 1
        stop = min(max(stop, first + 1), first + _TEXTS, n)
        yield first, stop
        first = stop


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted in place, each once."""
    keys.sort()
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def _keys(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each trigram with each text that holds it (trigram << 16 | text), sorted. A long text is taken in pieces."""
    found = []
    for at in range(int(ends[0]), int(ends[-1]), _BYTES):
        piece = data[at : min(at + _BYTES + 2, int(ends[-1]))].astype(np.uint32)
        n = max(len(piece) - 2, 0)
        key = ((piece[:n] << 16) | (piece[1 : n + 1] << 8) | piece[2 : n + 2]).astype(np.uint64) << np.uint64(16)
        here = ends - at
        key |= np.repeat(np.arange(len(ends) - 1, dtype=np.uint64), np.diff(np.clip(here, 0, n)))
        within = np.ones(n, bool)  # not over the end of a text
        for k in (here[1:] - 1, here[1:] - 2):
            within[k[(k >= 0) & (k < n)]] = False
        found.append(_distinct(key[within]))
    if len(found) == 1:
        return found[0]
    return _distinct(np.concatenate(found)) if found else np.empty(0, np.uint64)


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Bytes of these sizes, one after the other, as a column."""
    at = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def _postings(keys: np.ndarray, n_texts: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(trigrams, how many texts hold each, which): positions where they take less than a bit for each text, then bits."""
    gram, text = (keys >> np.uint64(16)).astype(np.int64), (keys & np.uint64(0xFFFF)).astype("<u2")
    starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])
    counts, grams, width = np.diff(np.r_[starts, len(gram)]), gram[starts], (n_texts + 7) // 8
    sparse = 2 * counts < width
    listed = np.repeat(sparse, counts)
    if sparse.any():
        yield grams[sparse], counts[sparse], _binaries(text[listed], 2 * counts[sparse])
    if not sparse.all():
        dense = counts[~sparse]
        bits = np.zeros((len(dense), n_texts), bool)
        bits[np.repeat(np.arange(len(dense)), dense), text[~listed]] = True
        yield grams[~sparse], dense, _binaries(np.packbits(bits, axis=1), np.full(len(dense), width))


def _held(posting: bytes, n_texts: int) -> np.ndarray:
    """The positions of the texts in a posting."""
    if len(posting) == (n_texts + 7) // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(posting, np.uint8), count=n_texts))
    return np.frombuffer(posting, "<u2").astype(np.int64)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of the texts in all postings of each row (one chunk)."""
    for batch in batches:
        for held, ids in zip(batch.column(0), batch.column(1), strict=True):
            postings = sorted(held.as_py(), key=len)
            at = _held(postings[0], len(ids))
            for other in postings[1:]:
                at = np.intersect1d(at, _held(other, len(ids)), assume_unique=True)
            yield pa.RecordBatch.from_arrays([ids.values.take(pa.array(at))], ["id"])


class SearchIndex:
    def __init__(self, spark: SparkSession, folder: str, rows: DataFrame, key: str, text: Column, parts: int):
        self.spark, self.folder, self.rows, self.key, self.text, self.parts = spark, folder, rows, key, F.lower(F.coalesce(text, F.lit(""))), parts
        self.kind = dict(rows.dtypes)[key]

    @classmethod
    def of(cls, rows: DataFrame, key: str, text: Column, folder: str, parts: int = 64) -> SearchIndex:
        """Make and store the postings of rows."""
        made = cls(rows.sparkSession, folder, rows, key, text, parts)
        names = ["part", "gram", "chunk", "n", "texts", "ids"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk = TaskContext.get().partitionId() << 32
            for batch in batches:
                ids, raw = batch.column(0), batch.column(1).cast(pa.large_binary())
                _, at, data = raw.buffers()
                ends = np.frombuffer(at, np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
                data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
                for first, stop in _chunks(ends):
                    n, none = stop - first, pa.nulls(1, pa.binary())
                    listed = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids.slice(first, n))
                    of_ids = [pa.array([x], t) for x, t in ((_IDS, pa.int32()), (-1, pa.int32()), (chunk, pa.int64()), (n, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*of_ids, none, listed], names)
                    for grams, counts, texts in _postings(_keys(data, ends[first : stop + 1]), n):
                        numbers = [pa.array(x.astype(t)) for x, t in ((_part(grams, parts), np.int32), (grams, np.int32), (np.full(len(grams), chunk), np.int64), (counts, np.int32))]
                        yield pa.RecordBatch.from_arrays([*numbers, texts, pa.nulls(len(grams), listed.type)], names)
                    chunk += 1

        cut = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), made.text.cast("binary").alias("text"))
        # stored before they are dealt to the folders, so that all rows of a chunk come from one attempt of its task
        dealt = stored(cut.mapInArrow(run, made._schema()), f"{folder}/chunks").repartition("part").sortWithinPartitions("part", "gram")
        dealt.write.partitionBy("part").parquet(f"{folder}/postings")
        removed(made.spark, f"{folder}/chunks")
        return made

    def _schema(self) -> str:
        return f"part int, gram int, chunk long, n int, texts binary, ids array<{self.kind}>"

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self._schema()).parquet(f"{self.folder}/postings")

    def _of(self, grams: list[int]) -> DataFrame:
        """The postings of these trigrams: their folders alone are read."""
        return self._stored().filter(F.col("part").isin(sorted({_part(g, self.parts) for g in grams})) & F.col("gram").isin(grams))

    def candidates(self, wanted: str) -> DataFrame | None:
        """id of the rows that hold the rarest trigrams of a search, or None if it is too short to have any."""
        wanted = wanted.lower()
        raw = wanted.encode()
        grams = trigrams(raw)
        if not grams:
            return None
        known = {r["gram"]: r["n"] for r in self._of(grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # as many as the search has
        if len(known) < len(grams):
            return self.rows.filter("1 = 0").select(F.col(self.key).alias("id"))
        rare = sorted(grams, key=lambda g: (known[g], g))[: _RAREST * len(raw) // len(wanted)]
        held = self._of(rare).groupBy("chunk").agg(F.collect_list("texts").alias("held")).filter(F.size("held") == len(rare))
        ids = self._stored().filter(F.col("part") == _IDS).select("chunk", "ids")
        return held.join(ids, "chunk").select("held", "ids").mapInArrow(_meet, f"id {self.kind}").distinct()

    def find(self, wanted: str) -> DataFrame:
        """The rows whose text holds the search as a plain substring, in any case."""
        rows, found = self.rows.filter(F.col(self.key).isNotNull()), self.candidates(wanted)
        if found is None or found.limit(_BROADCAST + 1).count() > _BROADCAST:
            return rows.filter(self.text.contains(wanted.lower()))
        # the text of candidates alone is searched: a condition that names both sides isn't pushed below the join
        text = F.when(F.col("_found").isNotNull(), self.text)
        return rows.join(F.broadcast(found.toDF("_found")), (F.col(self.key) == F.col("_found")) & text.contains(wanted.lower()), "left_semi")
