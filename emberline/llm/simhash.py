"""Document fingerprints: SimHash with permuted block tables.

A text's terms are its pairs of neighbouring lower-case words (a lone word is a term), each as often
as it occurs and weighing more if it is long. Every term's hash bits vote with that weight, for
the bit if set and against it if not; a fingerprint bit is set if the votes for it win. All votes of
a text are sums: 16 sums for each of three 62-bit hashes, four bits' votes side by side in a sum. They hold 10,000 terms,
so a longer text has such sums for each stretch of that many terms, and then sums of two bits over its stretches.

Likeness of two fingerprints is the share of equal bits. Block tables find all fingerprints within a Hamming
radius of given ones: the 186 bits are six blocks of 31, and there is a table for each, with that block in front as its key.
Fingerprints within the radius differ in at most radius // 6 bits of some block, so a query looks into each table
under its own key and those that few bits away; what it meets there is compared as a whole, and counts in the first table that
can find it. Keys that very many fingerprints share are split, and queries ask all their parts.
Everything is Spark expressions.

`next document` is the following one by descending doc_id, after the last the first. Documents are dealt into
ranges of doc_id, those of one doc_id that fills ranges alone by text hash, and many copies of one row over ranges of their own; the head of each range is also sent to
the range before it, so that one shuffle of the texts suffices. Ranges follow the number of rows.

Cases: null text is empty; a text without words has fingerprint zero. A single document is its own
next. Rows with equal doc_id follow each other by text hash; rows whose doc_id is null or no whole number come last. Votes hold up to
2^30 weight per text. Equal texts have equal fingerprints. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import shared_folder, stored, texts

_HASHES, _SHIFTS = 3, 31
BITS = _HASHES * 2 * _SHIFTS
#: Lanes of 16 bits (the votes of a stretch, up to 3 * _STRETCH) and of 32 bits (those of a text).
_FOUR, _TWO, _STRETCH = 1 + (1 << 16) + (1 << 32) + (1 << 48), 1 + (1 << 32), 10_000
_LEAST_KEY = -(2**63)
_BROADCAST_RANGES = 200_000
_PARTS = tuple(f"f{k}" for k in range(_HASHES))
#: Fingerprints under one key of a block table that stay together.
_TOGETHER = 5_000
RADIUS = 11


def terms(words: Column) -> Column:
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n == 0, F.array(F.lit(None).cast("string"))).when(n == 1, words).otherwise(pairs)


def _votes() -> list[Column]:
    """Sums over a stretch of terms: sum s of a hash has the votes for its bits s, s + 16, s + 32 and s + 48."""
    weight = F.when(F.col("term").isNull(), 0).when(F.length("term") >= 12, 3).when(F.length("term") >= 8, 2).otherwise(1).cast("long")
    out = [F.sum(weight).alias("w")]
    for k in range(_HASHES):
        out += [F.sum(F.shiftright(F.col(f"h{k}"), s).bitwiseAND(F.lit(_FOUR)) * weight).alias(f"v{k}_{s}") for s in range(16)]
    return out


def _totals() -> list[Column]:
    """Sums over a text's stretches: sum s of a hash has the votes for its bits s and s + 32."""
    out, low = [F.sum("w").alias("w")], F.lit(_TWO * 0xFFFF)
    for k in range(_HASHES):
        out += [F.sum(F.shiftrightunsigned(F.col(f"v{k}_{s % 16}"), s // 16 * 16).bitwiseAND(low)).alias(f"v{k}_{s}") for s in range(32)]
    return out


def _bits(k: int) -> Column:
    """62 bits from the sums: adding 2^30 - 1 - half of all votes to a lane carries into its bit 30 if the votes for it win."""
    lift = (F.lit((1 << 30) - 1) - F.floor(F.col("w") / 2)) * F.lit(_TWO)
    bits = F.lit(0).cast("long")
    for s in range(32):
        bits = bits.bitwiseOR(F.shiftleft(F.shiftright(F.col(f"v{k}_{s}") + lift, 30).bitwiseAND(F.lit(_TWO)), s))
    return bits.bitwiseAND(F.lit((1 << 2 * _SHIFTS) - 1))


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and f0, f1, f2 (62 bits each) from rows of keys and `words`; keys tell the rows apart."""
    exploded = rows.select(*keys, F.posexplode(terms(F.col("words"))).alias("_place", "term"))
    hashes = (F.xxhash64("term", F.lit(k)).alias(f"h{k}") for k in range(_HASHES))
    hashed = exploded.select(*keys, F.floor(F.col("_place") / _STRETCH).alias("_stretch"), "term", *hashes)
    sums = hashed.groupBy(*keys, "_stretch").agg(*_votes()).groupBy(*keys).agg(*_totals())
    return sums.select(*keys, *(_bits(k).alias(f"f{k}") for k in range(_HASHES)))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def written(parts: list[Column]) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(p)), 16, "0") for p in parts))


def likeness(a: list[Column], b: list[Column]) -> Column:
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))
    return 1.0 - apart / F.lit(float(BITS))


def _bucket(key: Column, cuts: list[int]) -> Column:
    """The number of cuts below key, by binary search."""
    table, n = F.array(*(F.lit(c).cast("long") for c in cuts)).cast("array<long>"), len(cuts)
    if not n:
        return F.lit(0)
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def half(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        open_ = acc["lo"] < acc["hi"]
        below = F.get(table, mid) < key
        return F.struct(F.when(open_ & below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), start, half, lambda acc: acc["lo"])


def _spread_copies(placed: DataFrame, per_range: int) -> DataFrame:
    """placed with its ranges parted around rows (_key, _h) that repeat more often than two ranges hold, and those rows dealt over ranges of their own.

    Copies are alike in doc_id and text, so it doesn't matter which follows which. Larger numbers still come first.
    """
    often = placed.groupBy("_bucket", "_key", "_h").count().filter(F.col("count") > 2 * per_range)
    item = F.struct(F.bitwise_not("_key").alias("nk"), F.col("_h").alias("h"), F.ceil(F.col("count") / per_range).alias("m"))  # in the order of rows
    # as many entries in all as the table has rows for each 2 * per_range
    hot = often.groupBy("_bucket").agg(F.array_sort(F.collect_list(item)).alias("_hot"))
    if hot.isEmpty():
        return placed.withColumn("_bucket", F.col("_bucket") * (1 << 20))
    own = F.struct(F.bitwise_not("_key").alias("nk"), F.col("_h").alias("h"))
    before = lambda x: (x["nk"] < own["nk"]) | ((x["nk"] == own["nk"]) & (x["h"] < own["h"]))
    here = lambda x: (x["nk"] == own["nk"]) & (x["h"] == own["h"])
    at = F.aggregate(F.col("_hot"), F.lit(0).cast("long"), lambda acc, x: acc + F.when(before(x), x["m"] + 1).when(here(x), 1 + F.pmod(F.col("_salt"), x["m"])).otherwise(0))
    parted = placed.withColumn("_salt", F.monotonically_increasing_id()).join(hot, "_bucket", "left")
    return parted.withColumn("_bucket", F.col("_bucket") * (1 << 20) - F.coalesce(at, F.lit(0))).drop("_salt", "_hot")


def with_next(docs: DataFrame, per_range: int = 1000, coarse: int = 4096) -> DataFrame:
    """doc_id, text, _next (the next document's text), _bucket, _at (place in the range), _guest (a copy for the range before).

    Up to `coarse` ranges are cut at quantiles of doc_id; beyond, there is one for each 20 * per_range rows, and the quantiles'
    ranges are cut further into equal widths. Larger _bucket numbers come first in the order.
    """
    keyed = texts(docs).withColumn("_key", F.coalesce(F.expr("try_cast(doc_id as long)"), F.lit(_LEAST_KEY))).withColumn("_h", F.xxhash64("text"))
    total = keyed.count()
    ranges = max(1, min(coarse, total // per_range), total // (20 * per_range))
    first, fine = min(ranges, coarse), -(-ranges // coarse)
    cuts, low, high = [], 0, 0
    if ranges > 1:
        shares = F.percentile_approx("_key", [k / first for k in range(1, first)], F.lit(100 * first))
        cuts, low, high = keyed.agg(shares, F.min("_key"), F.max("_key")).first()
    often = Counter(cuts)
    bounds = sorted(often)
    zone = _bucket(F.col("_key"), bounds)
    ends = F.array(*(F.lit(c).cast("long") for c in [low, *bounds, high])).cast("array<long>")
    times = F.array(*(F.lit(often[c]) for c in bounds), F.lit(1)).cast("array<int>")
    start, end = F.get(ends, F.col("_zone")).cast("double"), F.get(ends, F.col("_zone") + 1).cast("double")
    width = F.greatest(F.lit(0), F.least(F.lit(fine - 1), F.floor((F.col("_key").cast("double") - start) / F.greatest(end - start, F.lit(1.0)) * fine)))
    # a doc_id at two quantiles or more fills ranges alone: they follow each other by text hash
    parts = F.get(times, F.col("_zone")) * fine
    by_hash = F.greatest(F.lit(0), F.least(parts - 1, F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * parts)))
    alone = (F.get(times, F.col("_zone")) > 1) & (F.col("_key") == F.get(ends, F.col("_zone") + 1))
    within = F.when(alone, fine + parts - 1 - by_hash).otherwise(width)
    placed = keyed.withColumn("_zone", zone).withColumn("_bucket", (F.col("_zone").cast("long") * (fine * (first + 1)) + within).cast("long")).drop("_zone")
    placed = _spread_copies(placed, per_range)
    # the row that comes first in each range goes to the next larger number, the very first to the least
    heads = placed.groupBy("_bucket").agg(F.max(F.struct("_key", F.bitwise_not("_h").alias("_nh"))).alias("_head"))
    line = Window.partitionBy().orderBy("_bucket")  # one short row for each range
    to = F.coalesce(F.lead("_bucket").over(line), F.first("_bucket").over(line))
    guests = heads.select(F.col("_head._key").alias("_key"), F.bitwise_not(F.col("_head._nh")).alias("_h"), to.alias("_to"))
    if ranges <= _BROADCAST_RANGES:
        guests = F.broadcast(guests)
    own = placed.withColumn("_guest", F.lit(False))
    sent = keyed.join(guests, ["_key", "_h"]).select("doc_id", "text", "_key", "_h", F.col("_to").alias("_bucket"), F.lit(True).alias("_guest")).dropDuplicates(["_bucket"])  # one of copies
    order = Window.partitionBy("_bucket").orderBy("_guest", F.desc("_key"), "_h")
    return own.unionByName(sent).withColumn("_at", F.row_number().over(order)).withColumn("_next", F.lead("text").over(order)).drop("_key", "_h")


def printed(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, its fingerprint f0, f1, f2, its edited text's e0, e1, e2, the next document's g0, g1, g2."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("_next", F.lit(1), half))
    rows = with_next(docs).withColumn("_edited", F.when(~F.col("_guest"), edited))
    rows = rows.withColumn("_own", words_of(F.col("text"))).withColumn("_new", words_of(F.col("_edited")))
    both = rows.select(
        "_bucket", "_at", "_guest", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("_own").alias("words")), F.struct(F.lit(1).alias("which"), F.coalesce("_new", F.array().cast("array<string>")).alias("words")))).alias("e"),
    )
    keys = ["_bucket", "_at", "_guest", "doc_id", "n_chars", "edited_sha256"]
    each = fingerprints(both.select(*keys, "e.which", "e.words"), [*keys, "which"])
    pivot = [F.max(F.when(F.col("which") == w, F.col(p))).alias(f"{'fe'[w]}{k}") for w in (0, 1) for k, p in enumerate(_PARTS)]
    following = Window.partitionBy("_bucket").orderBy("_at")
    paired = each.groupBy(*keys).agg(*pivot).withColumns({f"g{k}": F.lead(p).over(following) for k, p in enumerate(_PARTS)})
    return paired.filter(~F.col("_guest")).drop("_bucket", "_at", "_guest")


def report(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, likenesses to that and to the next document's, and n_near.

    n_near is the number of other documents whose fingerprints lie within the radius, found by block tables, of each document
    whose doc_id 20 divides (the query set); null for others.
    """
    rows = stored(printed(docs), shared_folder(docs.sparkSession), "prints")
    asks = F.coalesce(F.expr("try_cast(doc_id as long)") % 20 == 0, F.lit(False))
    found = counted(rows.groupBy(*_PARTS).agg(F.count("*").alias("n")), rows.filter(asks).select(*_PARTS).distinct(), radius)
    own, new, following = ([F.col(f"{c}{k}") for k in range(_HASHES)] for c in "feg")
    shown = [
        "doc_id", "n_chars", "edited_sha256", written(own).alias("fingerprint"), written(new).alias("edited_fingerprint"),
        likeness(own, new).alias("near_edited"), likeness(own, following).alias("near_next"),
    ]
    asked = rows.filter(asks).join(found, list(_PARTS), "left").select(*shown, (F.coalesce("n", F.lit(1)) - 1).cast("long").alias("n_near"))
    return asked.union(rows.filter(~asks).select(*shown, F.lit(None).cast("long").alias("n_near")))


def _blocks(names: tuple[str, ...]) -> list[Column]:
    """The six blocks of a fingerprint."""
    return [F.shiftright(F.col(c), side * _SHIFTS).bitwiseAND(F.lit((1 << _SHIFTS) - 1)) for c in names for side in (0, 1)]


def _met(prints: DataFrame, queries: DataFrame, radius: int, together: int = _TOGETHER) -> DataFrame:
    """prints (f0, f1, f2, more columns) within the radius of queries (q0, q1, q2), each pair once, with `distance`."""
    flips = radius // (2 * _HASHES)
    masks = [sum(1 << b for b in some) for size in range(flips + 1) for some in combinations(range(_SHIFTS), size)]
    asked = tuple(f"q{k}" for k in range(_HASHES))
    table = lambda blocks: F.posexplode(F.array(*blocks)).alias("table", "key")
    index = prints.select(*prints.columns, table(_blocks(_PARTS)))
    probes = queries.select(*asked, table(_blocks(asked))).withColumn("_mask", F.explode(F.array(*map(F.lit, masks)).cast("array<long>")))
    probes = probes.select(*asked, "table", F.col("key").bitwiseXOR(F.col("_mask")).alias("key"))
    crowded = index.groupBy("table", "key").count().filter(F.col("count") > together).select("table", "key", F.ceil(F.col("count") / together).alias("_parts"))
    on = ["table", "key"]
    if not crowded.isEmpty():
        parts = F.coalesce("_parts", F.lit(1))
        index = index.join(crowded, on, "left").withColumn("part", F.pmod(F.xxhash64(*_PARTS), parts)).drop("_parts")
        probes = probes.join(crowded, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
        on = [*on, "part"]
    apart = [F.bit_count(F.col(p).bitwiseXOR(F.col(q))) for p, q in zip(_PARTS, asked, strict=True)]
    by_block = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(_blocks(_PARTS), _blocks(asked), strict=True)]
    # the first block in which they are close enough to meet is that of this table
    first = F.lit(2 * _HASHES)
    for k in reversed(range(2 * _HASHES)):
        first = F.when(by_block[k] <= flips, k).otherwise(first)
    # each query makes len(masks) probes for each table: merged, as their number isn't seen where a broadcast is chosen by the queries' size
    met = probes.join(index.hint("merge"), on).withColumn("distance", sum(apart, F.lit(0)))
    return met.filter((F.col("distance") <= radius) & (F.col("table") == first)).drop(*on)


def counted(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """queries (f0, f1, f2) with n: the sum of n of all prints (f0, f1, f2, n) within the radius, their own included."""
    asked = queries.select(*(F.col(p).alias(f"q{k}") for k, p in enumerate(_PARTS)))
    sums = _met(prints, asked, radius).groupBy("q0", "q1", "q2").agg(F.sum("n").alias("n"))
    return sums.select(*(F.col(f"q{k}").alias(p) for k, p in enumerate(_PARTS)), "n")


def near(docs: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): doc_id and fingerprint `p` of each document; pairs (a, b, distance) of different fingerprints within the radius.

    Copies share a fingerprint and are not expanded.
    """
    spread = texts(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("_row"), words_of(F.col("text")).alias("words"))
    members = stored(fingerprints(spread, ["doc_id", "_row"]).select("doc_id", *_PARTS), shared_folder(docs.sparkSession), "prints")
    unique = members.select(*_PARTS).distinct()
    met = _met(unique, unique.select(*(F.col(p).alias(f"q{k}") for k, p in enumerate(_PARTS))), radius)
    own, other = written([F.col(p) for p in _PARTS]), written([F.col(f"q{k}") for k in range(_HASHES)])
    pairs = met.select(own.alias("a"), other.alias("b"), "distance").filter("a < b")
    return members.select("doc_id", own.alias("p")), pairs
