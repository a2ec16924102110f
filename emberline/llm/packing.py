"""Best-fit packing by linear grouping.

Documents become token pieces of at most `capacity` tokens. The plan is made from the histogram of
piece lengths alone (at most `capacity` numbers, whatever the corpus), on the driver:
1. pieces longer than capacity / 4 are large: sorted by length, they fall into groups of equal
   cardinality, and each counts as long as its group's longest (lengths are rounded up);
2. configurations over these few sizes are chosen, for coarse groups by a linear program over configurations, for fine ones
   the largest size left, filled up by subset sum over the sizes left, each as often as their counts allow;
3. actual lengths replace the rounded ones, which frees room;
4. the small pieces go, longest first, where they fit best, or into new sequences.
The plan is a list of runs (length, ranks from, ranks to, first sequence, offset). On Spark each
piece gets its rank among those of its length and a join with the runs places it; the runs are a
few thousand rows, bounded by lengths and configurations and not by the corpus.

Ids are those of the tokenizers library, each distinct pre-token encoded once (see `wordtable`).

Cases: null text is empty text (one token, the end id). Repeated rows are pieces of their own.
An empty table gives no rows. A document of over `capacity` tokens is cut from its end, so only its
first piece can be shorter. Nothing is truncated or dropped.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm import wordtable
from emberline.llm.common import shared_folder, stored
from emberline.llm.wordtable import NOT_PLAIN, plain_pattern

_SPECIAL = "<|endoftext|>"
_coders: dict = {}


class Words:
    """The pre-tokens of texts, and their ids by the tokenizers library.

    A text of plain characters is split by the pre-tokenizer's pattern; any other, and one with the special token's string, is one word.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._plain = plain_pattern(PATTERN)

    def __call__(self, text: str) -> list[str]:
        if _SPECIAL in text or not (text.isascii() or not NOT_PLAIN.search(text)):
            return [text]
        return self._plain.findall(text)

    def encoded(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def _words(vocabulary: str) -> Words:
    if vocabulary not in _coders:
        _coders[vocabulary] = Words(vocabulary)
    return _coders[vocabulary]


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of each document's tokens."""
    import public_tokenizers

    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    end = np.array([end_id], "<u4")

    def finish(of_words: pa.ListArray):
        def rows(docs: pa.Array, codes: pa.Array, at: np.ndarray) -> pa.RecordBatch:
            each = of_words.take(codes)
            ids, ends = each.values.to_numpy().astype("<u4"), each.offsets.to_numpy()[at].tolist()
            row, piece, start, length, crc = [], [], [], [], []
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                own = np.concatenate([ids[a:b], end])
                first, k = 0, 0
                while first < len(own):
                    size = (len(own) % capacity or capacity) if first == 0 else capacity
                    for column, value in ((row, i), (piece, k), (start, first), (length, size), (crc, zlib.crc32(own[first : first + size]))):
                        column.append(value)
                    first, k = first + size, k + 1
            return pa.RecordBatch.from_arrays(
                [docs.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

        return rows

    return wordtable.encoded(docs, lambda: _words(vocabulary), finish, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


@dataclass
class Run:
    """`count` sequences filled alike, with pieces of these lengths."""

    count: int
    sizes: list[int] = field(default_factory=list)

    @property
    def used(self) -> int:
        return sum(self.sizes)


def grouped(counts: np.ndarray, small: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes (descending) and counts after rounding lengths over `small` up within groups of equal cardinality."""
    sizes, numbers = [], []
    left = total = int(counts[small + 1 :].sum())
    share, taken = max(1, -(-total // groups)), 0
    for size in range(len(counts) - 1, small, -1):
        n = int(counts[size])
        while n:
            if taken == 0:
                sizes.append(size)
                numbers.append(0)
            k = min(n, share - taken)
            numbers[-1] += k
            n, taken, left = n - k, (taken + k) % share, left - k
    return np.array(sizes, int), np.array(numbers, int)


def _best_fill(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How often to take each size so that their worth is largest and they fit: an unbounded knapsack.

    Rooms are done in stretches of the least size, within which no room builds on another.
    """
    value, taken, least = np.zeros(capacity + 1), np.full(capacity + 1, -1), int(sizes.min())
    for first in range(least, capacity + 1, least):
        rooms = np.arange(first, min(first + least, capacity + 1))
        before = rooms[:, None] - sizes
        gains = np.where(before >= 0, value[np.maximum(before, 0)] + worth, 0.0)
        best = gains.argmax(1)
        gain = gains[np.arange(len(rooms)), best]
        grown = np.maximum.accumulate(np.maximum(gain, value[first - 1]))
        value[rooms] = grown
        taken[rooms] = np.where(gain >= grown, best, -1)
        taken[rooms[0]] = best[0] if gain[0] > value[first - 1] else -1
    use, room = np.zeros(len(sizes)), capacity
    while room >= least:
        if taken[room] < 0 or (room > least and value[room] == value[room - 1]):
            room -= 1
        else:
            use[taken[room]] += 1
            room -= int(sizes[taken[room]])
    return use


def best_mix(sizes: np.ndarray, numbers: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """(times, indices of sizes): the configurations of an optimal fractional covering of numbers, times rounded down.

    A linear program over configurations, solved by the simplex method: in each turn the configuration of most worth at the
    present prices comes in. Few sizes keep it small: it sees the groups and the capacity, whatever the corpus.
    """
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.linalg.inv(columns)
    for turn in range(20 * m):
        if turn % 64 == 63:
            inverse = np.linalg.inv(columns)
        prices = inverse.sum(0)
        use = _best_fill(sizes, prices, capacity)
        if prices @ use <= 1 + 1e-3:
            break
        step, amount = inverse @ use, inverse @ numbers
        can = step > 1e-9
        out = int(np.argmin(np.where(can, amount / np.where(can, step, 1.0), np.inf)))
        columns[:, out] = use
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    times = np.floor(np.linalg.solve(columns, numbers) + 1e-6).astype(int)
    left, found = numbers.astype(int).copy(), []
    for k in range(m):
        use = columns[:, k].astype(int)
        n = min(int(times[k]), int((left[use > 0] // use[use > 0]).min()))  # never more of a size than there is
        if n > 0:
            left -= n * use
            found.append((n, np.repeat(np.arange(m), use).tolist()))
    return found


def configurations(sizes: np.ndarray, numbers: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """(times, indices of sizes) that use up all numbers: the best mix, then what its rounding leaves."""
    out = best_mix(sizes, numbers, capacity) if len(sizes) else []
    left = numbers.astype(int).copy()
    for times, chosen in out:
        left -= times * np.bincount(chosen, minlength=len(sizes))
    return out + filled(sizes, left, capacity)


def filled(sizes: np.ndarray, numbers: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """(times, indices of sizes) that use up all numbers: the largest size left, best filled, as often as it lasts."""
    left, out = numbers.astype(int).copy(), []
    for top in range(len(sizes)):
        while left[top]:
            room = capacity - sizes[top]
            chosen = [top]
            left[top] -= 1
            # took[f]: the last size by which the fill f was reached, each size used at most as often as it is left
            took = np.full(room + 1, -1)
            reach = np.zeros(room + 1, bool)
            reach[0] = True
            for j in range(top, len(sizes)):
                size = int(sizes[j])
                if size > room or not left[j]:
                    continue
                for _ in range(min(int(left[j]), room // size, 3)):
                    fresh = np.zeros(room + 1, bool)
                    fresh[size:] = reach[: room + 1 - size] & (took[: room + 1 - size] <= j)
                    fresh &= ~reach
                    if not fresh.any():
                        break
                    took[fresh] = j
                    reach |= fresh
                if reach[room]:
                    break
            fill = int(np.flatnonzero(reach)[-1])
            while fill:
                chosen.append(int(took[fill]))
                fill -= int(sizes[took[fill]])
            left[top] += 1
            use = np.bincount(chosen, minlength=len(sizes))
            # a fill may be reached by one size more often than it is left: then only the largest is sure
            if (use > left).any():
                use = np.bincount([top], minlength=len(sizes))
                chosen = [top]
            times = int((left[use > 0] // use[use > 0]).min())
            left -= times * use
            out.append((times, chosen))
    return out


def plan(counts: np.ndarray, capacity: int = 1024, coarse: int = 48, fine: int = 768, large: int = 4) -> list[Run]:
    """Runs that hold counts[length] pieces of each length. Pieces of over capacity / `large` are large.

    Two groupings are planned and the one with fewer sequences is taken: coarse groups with an optimal mix of configurations, and
    fine ones, whose rounding costs less, with configurations by subset sums.
    """
    small = capacity // large
    part = counts.copy()
    part[capacity] = 0
    found = []
    for groups, optimise in ((coarse, configurations), (fine, filled)):
        runs = substituted(part, *grouped(part, small, groups), capacity, optimise)
        add_small(runs, part, small, capacity)
        found.append(runs)
    runs = min(found, key=lambda runs: sum(r.count for r in runs))
    return runs + ([Run(int(counts[capacity]), [capacity])] if counts[capacity] else [])


def substituted(part: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, capacity: int, optimise: Callable) -> list[Run]:
    """The configurations of the rounded sizes with actual lengths, each group's longest first."""
    queue: list[list[list[int]]] = [[] for _ in sizes]
    size, left = capacity, 0
    for g, n in enumerate(numbers.tolist()):
        while n:
            while not left:
                size -= 1
                left = int(part[size])
            k = min(n, left)
            queue[g].append([size, k])
            n, left = n - k, left - k
    runs = []
    for times, chosen in optimise(sizes, numbers, capacity):
        need = {g: chosen.count(g) for g in set(chosen)}
        while times:
            # as many sequences as the first lengths of the groups can serve alike, or one
            step = max(1, min(times, *(queue[g][0][1] // k for g, k in need.items())))
            run = Run(step)
            for g in chosen:
                run.sizes.append(queue[g][0][0])
                queue[g][0][1] -= step
                if not queue[g][0][1]:
                    queue[g].pop(0)
            runs.append(run)
            times -= step
    return runs


def add_small(runs: list[Run], part: np.ndarray, small: int, capacity: int) -> None:
    """Put the small pieces, longest first, where they fit best, or into new sequences."""
    free: dict[int, list[Run]] = {}
    rooms: list[int] = []

    def open_room(run: Run) -> None:
        room = capacity - run.used
        if not free.get(room):
            insort(rooms, room)
        free.setdefault(room, []).append(run)

    for run in runs:
        open_room(run)
    for size in range(small, 0, -1):
        left = int(part[size])
        while left:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                each = min(capacity // size, left)
                run = Run(left // each, [size] * each)
                left -= run.count * each
                runs.append(run)
            else:
                room = rooms[k]
                run = free[room].pop()
                if run.count > left:
                    free[room].append(Run(run.count - left, list(run.sizes)))
                    runs.append(free[room][-1])
                    run.count = left
                if not free[room]:
                    rooms.pop(k)
                run.sizes.append(size)
                left -= run.count
            open_room(run)


def placed(runs: list[Run], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, ranks from, ranks to, first sequence, offset) of all slots."""
    ranks, opened, out = np.zeros(capacity + 1, int), 0, []
    for run in runs:
        offset = 0
        for size in run.sizes:
            out.append((size, int(ranks[size]), int(ranks[size]) + run.count, opened, offset))
            ranks[size] += run.count
            offset += size
        opened += run.count
    return out


def pack(cut: DataFrame, capacity: int = 1024, coarse: int = 48, fine: int = 768, per_bucket: int = 20_000) -> DataFrame:
    """cut (of pieces(), stored, with a row number _row) with sequence_id and offset."""
    spark = cut.sparkSession
    counts = np.zeros(capacity + 1, int)
    for row in cut.groupBy("length").count().collect():  # at most `capacity` rows
        counts[row["length"]] = row["count"]
    runs = plan(counts, capacity, coarse, fine)
    # ranks among the pieces of a length: by buckets of bounded size and by row number, so that no length and no repeated row is one task's work
    buckets = F.array(*(F.lit(int(-(-n // per_bucket)) or 1) for n in counts.tolist()))
    keyed = cut.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.element_at(buckets, F.col("length").cast("int") + 1)))
    own = keyed.withColumn("_own", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_row")) - 1)
    before = (
        keyed.groupBy("length", "_bucket").count()
        .select("length", "_bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("_before"))
    )
    ranked = own.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_own") + F.col("_before"))
    slots = spark.createDataFrame(placed(runs, capacity) or [(0, 0, 0, 0, 0)], "length long, _from long, _to long, _first long, _offset long")
    joined = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return joined.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset")
    )


def packed(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of every document, with its place in a sequence of at most `capacity` tokens."""
    cut = pieces(docs, capacity, end_id, vocabulary).withColumn("_row", F.monotonically_increasing_id())
    return pack(stored(cut, shared_folder(docs.sparkSession), "pieces"), capacity)
