"""N-gram Jaccard join: a blocked sparse product of the document by shingle matrix.

Rows are the distinct shingle sets (exact copies of a set are one row), columns are shingles by 64-bit hash,
in blocks by hash. What its size rules out is discarded as soon as it is:

1. First block of columns, all rows: a set of n shingles that links with anything
   misses at most n - ceil(0.8 n) of its partner's. Shingles that only one set holds are misses with every
   partner, so a set with more of them is discarded. Counting them takes one aggregate by shingle.
2. All blocks, the rows left: one count of each shingle's sets gives the same bound again, and each remaining set's rarest shingles,
   as many as a partner can't all miss, open its pairs: only pairs that share one of them, so early in both orders that
   they can link, become entries of the product. All other entries are known to miss their bound.
3. Entries accumulate their overlap block by block. After each block an entry goes if what it has, plus the fewer of the
   two sets' shingles in the blocks to come, stays below the overlap that its sizes ask for. What is left after the last
   block are the links. Only the rows of sets that have an entry take part.

To lose no component without opening all pairs of a group, in a few rounds the sets of a column first meet in parties of
about sixteen, and each opens up to three entries, with those whose sketches are likest its own among a third each; then all entries are opened whose sets
aren't in one component yet, if their bounds allow it with all columns folded to 1024 slots: a slot that only one of two sets
fills holds a shingle that the other misses. Columns whose sets are all in one component have nothing left to tell. Sketches only choose
what is opened first, so they can't lose a link.

Components are found by stars over stored links. Every stage spreads by hash of shingle or set; the
only hot keys (frequent shingles) are met by partial aggregates or by joins that can be split.

Words are lower-cased in A-Z only; a text of 1 to width - 1 words is one shingle. Cases: null or
wordless text has an empty set and links with nothing. Repeated rows are copies and link. Null doc_id
rows take part; component_id is the least doc_id that isn't null. Hash collisions (two shingles or two sets
with equal 64-bit hashes) are the one source of error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import dropped, shared_folder, stored, texts
from emberline.llm.graph import components

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SEEDS = np.random.default_rng(17).integers(0, 2**63, 64, dtype=np.uint64)
#: Sets of a column that meet each other in a round, and how many of those it met a set is checked with.
_PARTY, _PICKS = 16, 3
#: Slots of the folded columns.
_SLOTS = 1024
#: Up to this many ids (8 bytes each) are broadcast to filter a scan; more are joined by shuffle.
_BROADCAST_IDS = 500_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str, width: int, memo: dict) -> np.ndarray:
    """Sorted distinct hashes of the shingles of text. bytes.lower() and bytes.split() treat ASCII alone."""
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return np.array([], np.int64)
    ids = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    short = len(ids) < width
    size = 1 if short else len(ids) - width + 1
    total = np.full(size, len(ids) if short else width, np.uint64)
    for k in range(len(ids) if short else width):
        total = total * _FACTOR + (ids[k : k + 1] if short else ids[k : k + size])
    total ^= total >> np.uint64(31)
    total *= _MIX
    total ^= total >> np.uint64(29)
    return np.unique(total.view(np.int64))


def _block(found: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each column."""
    return (found.view(np.uint64) >> np.uint64(32)) % np.uint64(blocks)


def _rows(docs: DataFrame, width: int, blocks: int) -> DataFrame:
    """doc_id, n, s (the set's own hash), head (its shingles in the first of `blocks` blocks of columns)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Words()
        for batch in batches:
            n, s, head = [], [], []
            for text in batch["text"]:
                found = shingles(text, width, memo)
                n.append(len(found))
                s.append(np.int64(xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63))
                head.append(found[_block(found, blocks) == 0])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": n, "s": s, "head": head})

    return docs.mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, s long, head array<long>")


def _most_missed(n: Column, percent: int) -> Column:
    """The most shingles that a set of n can miss of a linked set: n - ceil(n * percent / 100)."""
    return n - F.ceil(n * percent / 100)


def _lone(held: DataFrame) -> DataFrame:
    """(s, lone): how many shingles of each set no other set of `held` (s, t) holds."""
    return held.groupBy("t").agg(F.min("s").alias("s"), F.max("s").alias("_last")).filter("s = _last").groupBy("s").agg(F.count("*").alias("lone"))


def _least_overlap(n: Column, m: Column, percent: int) -> Column:
    """The least overlap o of sets of n and m that link: 100 o >= percent (n + m - o)."""
    return F.floor((percent * (n + m) + 99 + percent) / (100 + percent))


def _overlapping(pairs: DataFrame, matrix: DataFrame, percent: int, blocks: int) -> DataFrame:
    """The pairs (a, b) of pairs (a, b, n, m: sizes) with the wanted overlap, accumulated over the blocks of columns.

    Blocks start with a and b in turn, so that the sums of one block lie as the next one needs them.
    """
    now = pairs.select("a", "b", _least_overlap(F.col("n"), F.col("m"), percent).alias("_least"), F.lit(0).cast("long").alias("_o"), F.col("n").alias("_n"), F.col("m").alias("_m"))
    for k in range(blocks):
        sides = [matrix.select(F.col("s").alias("a"), F.col(f"x{k}").alias("_x")), matrix.select(F.col("s").alias("b"), F.col(f"x{k}").alias("_y"))]
        for key, side in list(zip("ab", sides, strict=True))[:: -1 if k % 2 else 1]:
            now = now.join(side, key)
        shared = (F.col("_o") + F.size(F.array_intersect("_x", "_y"))).alias("_o")
        now = now.select("a", "b", "_least", shared, (F.col("_n") - F.size("_x")).alias("_n"), (F.col("_m") - F.size("_y")).alias("_m"))
        now = now.filter(F.col("_o") + F.least("_n", "_m") >= F.col("_least"))
    return now.select("a", "b")


def _may_link(n: Column, r: Column, m: Column, q: Column, percent: int) -> Column:
    """Whether sets of n and m shingles can link if a common one stands at places r and q of their orders, and is the first.

    They need an overlap of percent * (n + m) / (100 + percent), so the first common shingle stands among the first n + 1
    - overlap of the one and the first m + 1 - overlap of the other.
    """
    least = _least_overlap(n, m, percent)
    return (F.least(n, m) >= least) & (r <= n + 1 - least) & (q <= m + 1 - least)


def _sketch(found: np.ndarray) -> int:
    """64 one-bit minima of the set under different mixes: sets agree on more bits, the more alike they are."""
    if not len(found):
        return 0
    mixed = (found.view(np.uint64)[None, :] ^ _SEEDS[:, None]) * _MIX
    bits = (mixed ^ (mixed >> np.uint64(32))).min(1) & np.uint64(1)
    return int(np.int64((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64)))


def _folded(found: np.ndarray) -> np.ndarray:
    """The set's columns folded to _SLOTS: a bit for each slot that holds any of its shingles, 64 to a number."""
    bits = np.zeros(_SLOTS, np.uint8)
    bits[(found.view(np.uint64) >> np.uint64(12)) % np.uint64(_SLOTS)] = 1
    return np.packbits(bits).view(np.int64)


def _can_overlap(n: Column, m: Column, x: Column, y: Column, percent: int) -> Column:
    """Whether sets of n and m with folded columns x and y can link: each slot of one alone is a shingle that the other misses."""
    alone = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda a, b: a + b)
    return F.least(n - alone(x, y), m - alone(y, x)) >= _least_overlap(n, m, percent)


def _restricted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in ids: a broadcast up to a checked size, a shuffled join beyond it."""
    known = ids.filter(F.col(key).isNotNull()).distinct()
    small = known.limit(_BROADCAST_IDS + 1).count() <= _BROADCAST_IDS
    return rows.join(F.broadcast(known) if small else known, key, "left_semi")


def linked_sets(docs: DataFrame, folder: str, percent: int = 80, width: int = 5, blocks: int = 4, rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rows, components): rows has doc_id, n, s; components has (node, root) over linked sets s."""
    plain = texts(docs)
    heads = stored(_rows(plain, width, blocks), folder, "heads")
    rows = stored(heads.select("doc_id", "n", "s"), folder, "rows")
    classes = rows.filter("n > 0").groupBy("s").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"))
    lone = _lone(heads.select("s", F.explode("head").alias("t")))
    live = stored(classes.join(lone, "s", "left").filter(F.coalesce("lone", F.lit(0)) <= _most_missed(F.col("n"), percent)).select("s", "n", "doc_id"), folder, "live")
    dropped(rows.sparkSession, f"{folder}/heads")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Words()
        for batch in batches:
            found = [shingles(t, width, memo) for t in batch["text"]]
            parts = [_block(f, blocks) for f in found]
            columns = {f"x{k}": [f[p == k] for f, p in zip(found, parts, strict=True)] for k in range(blocks)}
            yield pd.DataFrame({"s": [np.int64(xxhash.xxh3_64_intdigest(f.tobytes()) - 2**63) for f in found], "k": [_sketch(f) for f in found], "fold": [_folded(f) for f in found], **columns})

    names = [f"x{k}" for k in range(blocks)]

    # a class whose rows all lack a doc_id can't be found by it, so rows without one come along
    named = _restricted(plain, live.select("doc_id"), "doc_id").union(plain.filter("doc_id is null"))
    full = named.mapInPandas(whole, "s long, k long, fold array<long>, " + ", ".join(f"{x} array<long>" for x in names)).dropDuplicates(["s"])
    matrix = stored(live.select("s", "n").join(full, "s"), folder, "matrix")
    held = matrix.select("s", F.explode(F.concat(*names)).alias("t"))
    often = held.groupBy("t").agg(F.count("*").alias("f")).filter("f > 1")
    listed = held.join(often, "t").groupBy("s").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("_by"))
    shared = listed.join(matrix.select("s", "n", "k"), "s")
    alone = F.col("n") - F.size("_by")  # these come first in the set's order
    wanted = _most_missed(F.col("n"), percent) + 1 - alone  # none for a set with more lone shingles than it can miss
    taken = shared.withColumn("_a", alone).withColumn("_k", wanted.cast("int")).filter("_k > 0")
    taken = taken.withColumn("_early", F.slice("_by", F.lit(1), F.greatest("_k", F.lit(0)))["t"])
    early = stored(taken.select("s", "n", "k", "_a", "_early"), folder, "early")
    placed = early.select("s", "n", "k", "_a", F.posexplode("_early").alias("i", "t"))
    blocking = stored(placed.select("t", "s", "n", "k", (F.col("_a") + F.col("i") + 1).alias("r"), "i"), folder, "blocking")

    links, found = None, None

    def open_columns() -> DataFrame:
        """The blocking columns whose sets are in two components (c) or more, with the number of their sets (f)."""
        if found is None:
            placed = blocking.withColumn("c", F.col("s"))
        else:
            placed = blocking.join(found.select(F.col("node").alias("s"), "root"), "s", "left").withColumn("c", F.coalesce("root", "s")).drop("root")
        told = placed.groupBy("t").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.count("*").alias("f")).filter("_lo < _hi")
        return placed.join(told.select("t", "f"), "t")

    for turn in range(rounds + 1):
        columns = open_columns()
        if turn == rounds:
            before = F.slice("_early", F.lit(1), F.col("i"))  # the blocking shingles before this one
            whole_sets = matrix.select("s", "fold").join(early.select("s", "_early"), "s")
            columns = columns.join(whole_sets, "s").withColumn("p", before).drop("_early", "i")
        else:
            party = F.pmod(F.xxhash64("s", "t", F.lit(turn)), F.ceil(F.col("f") / _PARTY))
            columns = columns.withColumn("g", party).drop("i")
        columns = stored(columns.drop("f"), folder, f"open-{turn}")
        on = ["t", "g"] if turn < rounds else ["t"]
        other = columns.select(*on, F.col("s").alias("b"), F.col("n").alias("_n"), F.col("k").alias("_k"), F.col("r").alias("_r"), F.col("c").alias("_c"), *([] if turn < rounds else [F.col("p").alias("_p"), F.col("fold").alias("_fold")]))
        met = columns.withColumnRenamed("s", "a").join(other, on)
        met = met.filter((F.col("a") < F.col("b")) & (F.col("c") != F.col("_c")) & _may_link(F.col("n"), F.col("r"), F.col("_n"), F.col("_r"), percent))
        if turn < rounds:
            alike = (64 - F.bit_count(F.col("k").bitwiseXOR(F.col("_k")))).alias("alike")
            seen = met.select("a", "b", F.col("n"), F.col("_n").alias("m"), alike)
            back = seen.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("m").alias("n"), F.col("n").alias("m"), "alike")
            best = seen.union(back).groupBy("a", "n", F.pmod("b", F.lit(_PICKS))).agg(F.max(F.struct("alike", "b", "m")).alias("best")).select("a", "n", "best.b", "best.m")
            low = F.col("a") < F.col("b")
            sizes = (F.when(low, F.col("n")).otherwise(F.col("m")).alias("n"), F.when(low, F.col("m")).otherwise(F.col("n")).alias("m"))
            pairs = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *sizes).distinct()
        else:
            first = met.filter(~F.arrays_overlap("p", "_p"))  # each pair at its first common shingle
            pairs = first.filter(_can_overlap(F.col("n"), F.col("_n"), F.col("fold"), F.col("_fold"), percent)).select("a", "b", "n", F.col("_n").alias("m"))
        pairs = stored(pairs, folder, f"pairs-{turn}")
        dropped(rows.sparkSession, f"{folder}/open-{turn}")
        good = None
        if not pairs.isEmpty():
            ends = pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s")))
            met_sets = stored(_restricted(matrix.select("s", *names), ends, "s"), folder, f"met-{turn}")
            good = stored(_overlapping(pairs, met_sets, percent, blocks), folder, f"links-{turn}")
            dropped(rows.sparkSession, f"{folder}/met-{turn}")
        dropped(rows.sparkSession, f"{folder}/pairs-{turn}")
        if good is None or good.isEmpty():
            if turn < rounds:
                continue
            break
        links = good if links is None else links.union(good)
        found = stored(components(links, f"{folder}/stars-{turn}", "s"), folder, f"components-{turn}")
        dropped(rows.sparkSession, f"{folder}/stars-{turn}")
    if found is None:
        found = rows.sparkSession.createDataFrame([], "node long, root long")
    return rows, found


def joined(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id that links reach, itself included)."""
    rows, found = linked_sets(docs, shared_folder(docs.sparkSession), percent, width)
    sets = rows.filter("n > 0").groupBy("s").agg(F.min("doc_id").alias("_first"))
    rooted = sets.join(found.select(F.col("node").alias("s"), "root"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    least = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    by_set = rooted.join(least, "root").select("s", "component_id")
    return (
        rows.join(by_set, "s", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def _row_hash(docs: DataFrame) -> Column:
    """64-bit hash of all columns; those that hash functions don't take are hashed as JSON."""
    return F.xxhash64(*(F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes))


def one_each(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """docs, its columns alone, with one document of each component: that with the least doc_id (null last), set and row hash.

    Rows are told apart by a hash of all their columns, not by doc_id: rows with one doc_id whose texts don't link all stay,
    and of linked rows without a doc_id one stays. Rows without words link with nothing and stay, repeated ones too.
    """
    keyed = docs.select(_row_hash(docs).alias("_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    named = keyed.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text"))  # linked by row hash instead of doc_id
    folder = shared_folder(docs.sparkSession)
    rows, found = linked_sets(named, folder, percent, width)
    linked = rows.filter("n > 0").select(F.col("doc_id").alias("_key"), "s").distinct()
    rooted = linked.join(found.select(F.col("node").alias("s"), "root"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    ids = keyed.select("_key", F.col("_row.doc_id").alias("doc_id")).distinct()
    order = F.struct(F.col("doc_id").isNull().alias("_last"), "doc_id", "s", "_key")
    least = rooted.join(ids, "_key").groupBy("root").agg(F.min(order).alias("least")).select("root", F.col("least._key").alias("_stays"))
    gone = stored(rooted.join(least, "root").filter("_key != _stays").select("_key"), folder, "gone")
    small = gone.limit(_BROADCAST_IDS + 1).count() <= _BROADCAST_IDS
    kept = keyed.join(F.broadcast(gone) if small else gone, "_key", "left_anti")
    if rows.filter("n > 0").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept.select("_row.*")
    worded = F.coalesce(F.col("_row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return kept.filter(~worded).union(kept.filter(worded).dropDuplicates(["_key"])).select("_row.*")
