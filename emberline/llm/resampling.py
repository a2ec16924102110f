"""Importance resampling towards a target distribution, by a vectorised byte automaton.

A text's words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters outside ASCII, so the automaton works
on the bytes of Arrow's UTF-8 buffers, many texts at once: a lookup table classifies every byte, word starts and ends are where
the class differs from the byte before or after (or a text begins or ends), and a table-driven CRC-32 advances over all words
together, one byte a step, longest words first so that the words still running are a prefix. Bytes of a word after the first
64 go through zlib, from the state reached. Features are runs of 1 to `longest` consecutive words joined by one space; the CRC of
a longer run goes on from that of the run without its last word. No Python code sees single words, and no text becomes a Python string.

A feature's bucket is its CRC modulo `buckets`. All texts of docs hold S features, s of them in a bucket, the target's texts T
and t; a bucket's gain is floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))). A document's weight is the sum of its features'
gains, its score the weight plus a Gumbel number from its id (so that the highest scores are a draw in proportion to the weights'
exponentials, without replacement). Of the N documents with at least `least_words` words floor(share N / 100) are drawn.

On Spark: texts are scanned twice, once for the counts (at most `buckets` rows from a task, summed by bucket; the driver and the tasks
hold `buckets` numbers) and once for the weights. Scores are stored, and dealt into ranges of (score, doc_id, row number), so that ties and
repeated rows are split too; a rank is the place within the range plus the rows of the ranges before it.

Cases: null and empty texts, and texts without words, have no features and weight 0. A row without doc_id has no score: it isn't
drawn and doesn't count for N. Repeated rows are documents of their own, each with a rank. Empty docs give no rows; an empty
target is one without features. Only doc_id and text are read, so other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import shared_folder, stored, texts

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Bytes that all words advance over together, and bytes of text that are done at once.
_TOGETHER, _BLOCK = 64, 4 << 20


def _crc_table() -> np.ndarray:
    """The CRC-32 of each single byte's low bits: eight shifts of the reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def advanced(states: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC states (before their last inversion) after the stretches of data that begin at starts: a byte of all of them a step."""
    capped = np.minimum(lengths, _TOGETHER).astype(np.uint8)
    order = np.argsort(capped, kind="stable")[::-1]
    running = len(capped) - np.cumsum(np.bincount(capped, minlength=_TOGETHER + 1))  # how many are longer than t
    at, state = starts[order], states[order]
    for t in range(_TOGETHER):
        m = int(running[t])
        if not m:
            break
        head = state[:m]
        state[:m] = _TABLE[(head ^ data[at[:m] + t]) & 0xFF] ^ (head >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state
    for i in np.flatnonzero(lengths > _TOGETHER).tolist():
        out[i] = zlib.crc32(data[starts[i] + _TOGETHER : starts[i] + lengths[i]], int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, first word of each text and the number of words) in lower-cased or raw UTF-8 bytes of texts end to end."""
    inside = _WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]  # a word ends with its text
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(starts, offsets)


def features_in(data: np.ndarray, offsets: np.ndarray, buckets: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to longest words: (buckets of the runs, first run of each text and the number of runs)."""
    data = _LOWER[data]
    starts, lengths, firsts = words_in(data, offsets)
    states = advanced(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, lengths)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    runs = np.arange(len(starts))
    for n in range(1, longest + 1):
        if n > 1:
            going = runs + n - 1 < len(starts)
            runs, states = runs[going], states[going]
            going = text[runs] == text[runs + n - 1]
            runs, states = runs[going], states[going]
            states = _TABLE[(states ^ np.uint32(0x20)) & 0xFF] ^ (states >> np.uint32(8))
            states = advanced(states, data, starts[runs + n - 1], lengths[runs + n - 1])
        yield (states ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets), np.searchsorted(runs, firsts)


def _blocks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets of texts) of a text column, whole texts of about _BLOCK bytes at once."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _BLOCK, "right")) - 1)
        yield data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def counted(rows: DataFrame, buckets: int = 10_000, longest: int = 1) -> np.ndarray:
    """How many features of all texts are in each bucket. rows has the column text, without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data, offsets in _blocks(batch.column(0)):
                for found, _ in features_in(data, offsets, buckets, longest):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["bucket", "n"])

    sums = rows.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in sums.collect():  # at most `buckets` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain in thousandths, from the counts of all documents and of the target."""
    s, t, k = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weighted(rows: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight of rows (doc_id, text without nulls)."""
    gain = gain.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weights = [], [], []
            for data, offsets in _blocks(batch.column(1)):
                own, each = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
                for n, (found, firsts) in enumerate(features_in(data, offsets, len(gain), longest)):
                    sums = np.concatenate([[0], np.cumsum(gain[found])])
                    own += sums[firsts[1:]] - sums[firsts[:-1]]
                    each += np.diff(firsts)
                    if n == 0:
                        words.append(np.diff(firsts))
                features.append(each)
                weights.append(own)
            made = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, features, weights)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(np.int64)) for x in made)], ["doc_id", "n_words", "n_features", "weight"])

    return rows.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, share: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank is null where it isn't drawn."""
    folder = shared_folder(docs.sparkSession)
    rows = texts(docs)
    wanted = target.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    gain = gains(counted(rows, buckets, longest), counted(wanted, buckets, longest))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = stored(weighted(rows, gain, longest).withColumn("score", F.col("weight") + gumbel).withColumn("_row", F.monotonically_increasing_id()), folder, "scored")
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    return ranked(scored, may, share, folder).drop("_row")


def ranked(scored: DataFrame, may: Column, share: int, folder: str) -> DataFrame:
    """scored with rank: 1, 2, 3... of the highest scores (ties: smaller doc_id) among the rows that may be drawn, null for the others."""
    spark = scored.sparkSession
    order = [F.col("score").desc(), F.col("doc_id"), F.col("_row")]
    dealt = scored.filter(may).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    dealt = stored(dealt, folder, "ranges")
    inside = F.lit((1 << 33) - 1)
    sizes = dict(dealt.groupBy(F.shiftright("_place", 33).alias("part")).count().collect())  # a row for each range
    before, n = [], 0
    for part in sorted(sizes):
        before.append((part, n))
        n += sizes[part]
    starts = spark.createDataFrame(before or [(0, 0)], "_part long, _before long")
    rank = F.col("_before") + F.col("_place").bitwiseAND(inside) + 1
    placed = dealt.withColumn("_part", F.shiftright("_place", 33)).join(F.broadcast(starts), "_part")
    drawn = placed.select(*scored.columns, F.when(rank <= share * n // 100, rank).alias("rank"))
    return drawn.unionByName(scored.filter(~F.coalesce(may, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))
