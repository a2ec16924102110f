"""Encoding texts through a table of their distinct words.

1. Texts are split into words, outside of which no token reaches. A chunk (texts of one task, up to `_CHUNK` characters
   or one longer text) numbers its distinct words. It is stored as one row with its texts' words as numbers, and one row with words for each of
   `buckets` hash buckets.
2. The rows of words are dealt by bucket, so that all mentions of a word meet in one task, which encodes it once. A chunk mentions a
   word once, so the commonest word of a language is as many mentions as there are chunks, next to all other words.
3. The ids go back to the chunks by a join on the chunk, and by position to its texts.

Words and ids travel as compressed arrays, since rows of single words would be several times the texts' size.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import shared_folder, stored, texts

#: Characters of a chunk, and words of it that are put in place at once.
_CHUNK, _AT_ONCE = 32 << 20, 1 << 18
#: Characters that a translated pattern splits: up to the end of Latin Extended-B (no compositions among them), dashes and quotes, and the euro.
PLAIN = (*range(0x250), *range(0x2010, 0x2028), 0x20AC)
#: Finds characters for which no pattern is translated.
NOT_PLAIN = re.compile("[^" + "".join(map(re.escape, map(chr, PLAIN))) + "]")


def plain_pattern(pattern: str) -> re.Pattern:
    """A tokenizer's pattern with its classes (letters, numbers, white space) spelled out for the plain characters and their lower case."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], "Z": []}
    for c in sorted({low for c in map(chr, PLAIN) for low in (c, *c.lower())}):
        kind = "Z" if c in "\t\n\v\f\r\x85" else unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind].append(re.escape(c))
    letters, numbers, space = ("".join(kinds[k]) for k in "LNZ")
    for known, spelled in (
        (r"[^\s\p{L}\p{N}]", f"[^{space}{letters}{numbers}]"), (r"[\p{L}]", f"[{letters}]"), (r"[\p{N}]", f"[{numbers}]"), (r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"),
        (r"\s", f"[{space}]"), (r"\S", f"[^{space}]"),
    ):
        pattern = pattern.replace(known, spelled)
    if re.search(r"\\[pPdDwW]", pattern):
        raise ValueError("this pattern has classes that aren't translated")
    return re.compile(pattern)


class Splitter(Protocol):
    def __call__(self, text: str) -> list[str]:
        """The words of a text, in order."""

    def encoded(self, words: list[str]) -> list[list[int]]:
        """The ids of each of these words."""


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _squeezed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, all their low bytes first, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _spread(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _listed(data: bytes, lengths: bytes) -> list[str]:
    """The words of a row."""
    whole, ends = zstandard.ZstdDecompressor().decompress(data), np.cumsum(_spread(lengths)).tolist()
    return [whole[a:b].decode() for a, b in zip([0, *ends], ends)]


def _coded(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers, mostly small: a byte of each, and in full those that aren't below 255."""
    small = np.minimum(numbers, 255).astype(np.uint8)
    return zstandard.ZstdCompressor(level=3).compress(small.tobytes()), _squeezed(numbers[small == 255])


def _decoded(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(zstandard.ZstdDecompressor().decompress(small), np.uint8).astype(np.uint32)
    out[out == 255] = _spread(large)
    return out


_CHUNK_ROW = "chunk long, bucket int, words binary, lengths binary, doc_ids array<{}>, sizes array<int>, codes binary, more binary, ranks binary"


def chunks(docs: DataFrame, make: Callable[[], Splitter], buckets: int = 256) -> DataFrame:
    """A row for each chunk (chunk, doc_ids, sizes, codes, more, ranks), and for each of its buckets with words (chunk, bucket, words, lengths).

    codes and more are the numbers of all words of the chunk's texts, in order; sizes says how many each text has. ranks are the numbers of the words
    as the buckets list them, each less the one before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, task, n = make(), TaskContext.get().partitionId(), 0
        held, sizes, codes, words, chars = [], [], array("I"), _Codes(), 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and chars + len(text) > _CHUNK:
                    yield _chunk((task << 32) + n, held, sizes, codes, words, buckets, ids)
                    held, sizes, codes, words, chars, n = [], [], array("I"), _Codes(), 0, n + 1
                found = split(text)
                held.append(doc)
                sizes.append(len(found))
                codes.extend(map(words.__getitem__, found))
                chars += len(text)
        if held:
            yield _chunk((task << 32) + n, held, sizes, codes, words, buckets, ids)

    from pyspark.sql.pandas.types import to_arrow_type

    plain = texts(docs)
    ids = to_arrow_type(plain.schema["doc_id"].dataType)
    return plain.mapInArrow(run, _CHUNK_ROW.format(dict(plain.dtypes)["doc_id"]))


def _chunk(chunk: int, held: list, sizes: list[int], codes: array, words: dict[str, int], buckets: int, ids: pa.DataType) -> pa.RecordBatch:
    known = [w.encode() for w in words]
    found = np.frombuffer(codes, np.uint32) if codes else np.zeros(0, np.uint32)
    often = np.argsort(-np.bincount(found, minlength=len(known)), kind="stable")
    rank = np.empty(len(known), np.uint32)
    rank[often] = np.arange(len(known), dtype=np.uint32)  # a word's number in the texts, so that common words are short
    lists: dict[int, list[int]] = {}
    for i in often.tolist():
        lists.setdefault(zlib.crc32(known[i]) % buckets, []).append(i)
    order = [i for b in sorted(lists) for i in lists[b]]
    each = [[known[i] for i in lists[b]] for b in sorted(lists)]
    pack = zstandard.ZstdCompressor(level=3)
    small, large = _coded(rank[found])
    m, columns = len(lists), {
        "chunk": [chunk] * (len(lists) + 1), "bucket": [None, *sorted(lists)], "words": [None, *(pack.compress(b"".join(ws)) for ws in each)],
        "lengths": [None, *(_squeezed(np.array([len(w) for w in ws])) for ws in each)], "doc_ids": [held], "sizes": [sizes], "codes": [small], "more": [large],
        "ranks": [_squeezed(np.diff(rank[order], prepend=np.uint32(0)))],
    }
    kinds = {"chunk": pa.int64(), "bucket": pa.int32(), "doc_ids": pa.list_(ids), "sizes": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array(x + [None] * (m + 1 - len(x)), kinds.get(c, pa.binary())) for c, x in columns.items()], list(columns))


def answered(asked: DataFrame, make: Callable[[], Splitter]) -> DataFrame:
    """chunk, bucket, sizes, ids of rows of words (chunk, bucket, words): how many ids each word has, and all of them in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, memo, bucket = make(), {}, None
        for batch in batches:
            sizes, ids = [], []
            for b, data, lengths in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                if b != bucket:
                    memo, bucket = {}, b
                words = _listed(data, lengths)
                new = [w for w in words if w not in memo]
                memo.update(zip(new, split.encoded(new), strict=True))
                each = [memo[w] for w in words]
                sizes.append(_squeezed(np.array([len(x) for x in each])))
                ids.append(_squeezed(np.array([i for x in each for i in x])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], ["chunk", "bucket", "n", "ids"])

    # in order of buckets, so that no more than one bucket's words are held
    return asked.select("chunk", "bucket", "words", "lengths").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "chunk long, bucket int, n binary, ids binary")


#: Makes from a chunk's table of ids by word a function of (doc ids, words' numbers end to end, where texts begin and end in them) to result rows.
Finish = Callable[[pa.ListArray], Callable[[pa.Array, pa.Array, np.ndarray], pa.RecordBatch]]


def encoded(docs: DataFrame, make: Callable[[], Splitter], finish: Finish, schema: str) -> DataFrame:
    """What finish makes of all documents (doc_id, text) and their ids."""
    split = stored(chunks(docs, make), shared_folder(docs.sparkSession), "chunks")
    held = split.filter("codes is not null").drop("words", "lengths").withColumns({"n": F.lit(None).cast("binary"), "ids": F.lit(None).cast("binary")})
    answers = answered(split.filter("words is not null"), make)
    met = held.unionByName(answers, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", F.col("bucket").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, ids = [], []
        for batch in batches:
            for row in range(len(batch)):
                if batch.column("codes")[row].is_valid:  # after the answers to its chunk
                    yield from in_place(batch.slice(row, 1), sizes, ids, finish)
                    sizes, ids = [], []
                else:
                    sizes.append(_spread(batch.column("n")[row].as_py()))
                    ids.append(_spread(batch.column("ids")[row].as_py()))

    return met.mapInArrow(run, schema)


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def in_place(chunk: pa.RecordBatch, sizes: list[np.ndarray], ids: list[np.ndarray], finish: Finish) -> Iterator[pa.RecordBatch]:
    """Results for a chunk's texts, from the ids of its words by their numbers."""
    sizes, ids = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (sizes, ids))
    listed = pa.ListArray.from_arrays(pa.array(_ends(sizes), pa.int32()), pa.array(ids.astype(np.int32)))
    place = np.empty(len(sizes), np.int64)
    place[np.cumsum(_spread(chunk.column("ranks")[0].as_py()), dtype=np.uint32)] = np.arange(len(sizes))
    each = finish(listed.take(pa.array(place)))
    codes, docs = _decoded(chunk.column("codes")[0].as_py(), chunk.column("more")[0].as_py()), chunk.column("doc_ids").flatten()
    at = _ends(chunk.column("sizes").flatten().to_numpy(zero_copy_only=False))
    first = 0
    while first < len(docs):
        end = max(first + 1, int(np.searchsorted(at, at[first] + _AT_ONCE, "right")) - 1)
        yield each(docs.slice(first, end - first), pa.array(codes[at[first] : at[end]].astype(np.int64)), at[first : end + 1] - at[first])
        first = end
