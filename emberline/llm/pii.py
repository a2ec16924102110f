"""Personal data: fixed base patterns, wide candidate generators, and boosted trees that select.

Everything runs as Spark expressions. Spans count code points and end before `end`. The base kinds
(email, ip, card, phone) always stay. Generators then propose overlapping candidates of further
kinds; boosted trees score each from its format and its context; candidates over the kind's
calibrated threshold that don't overlap a base span are added.

Cases: null text is empty text, with no spans. Repeated rows give repeated results. Among
overlapping candidates the better score wins, then the earlier start, then the kind listed first.
Texts are read whole; no span or candidate is capped. Columns other than doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import random
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import packed_rows, texts
from emberline.llm.trees import Boosted, boost

BASE = ("email", "ip", "card", "phone")
ADDED = ("ssn", "iban", "phone_local", "email_spelled")

# The base patterns, written so that each is tried once per run of its characters: a look-behind
# (or the end of the last match) replaces later starts within a run, which fail like the first.
_LOCAL = r"[A-Za-z0-9._%+-]"
_PATTERN = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GENERATOR = {
    "ssn": r"(?<![0-9-])[0-9]{3}(?:[-\x20][0-9]{2}[-\x20][0-9]{4}|[0-9]{6})(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?:(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?|[a-z0-9]{11,31})(?![A-Za-z0-9])",
    "phone_local": r"(?<![0-9A-Za-z+.-])(?:(?:\([0-9]{2,5}\)[\x20.-]?|[0-9]{2,5}[\x20./-])[0-9]{3,4}[\x20.-]?[0-9]{3,4}|0[1-9](?:[\x20.-][0-9]{2}){4}|[0-9]{3}-[0-9]{4}|[0-9]{10,11})(?![0-9]|[.-][0-9])",
    "email_spelled": r"(?<![A-Za-z0-9._-])[A-Za-z0-9_.-]++(?:\x20?[\[({](?:at|AT|At)[\])}]\x20?[A-Za-z0-9-]++(?:\x20?[\[({](?:dot|DOT|Dot)[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)|\x20(?:at|AT)\x20[A-Za-z0-9-]++\x20(?:dot|DOT)\x20)[A-Za-z]{2,12}(?![A-Za-z0-9])",
}
#: Cheap tests that a text with any match passes.
_NEEDS = {"email": "@", "phone": "+", "card": None, "ip": ".", "email_spelled": None}
#: Context words, in several languages, before a candidate.
_HINTS = (
    r"(?i)\b(?:tel|tél|phone|call|mobile|cell|fax|contact|telefon|teléfono|téléphone|handy|whatsapp)\b",
    r"(?i)\b(?:ssn|social|security|sin|taxpayer|tin)\b",
    r"(?i)\b(?:iban|account|konto|bank|compte|cuenta|transfer|swift|bic)\b",
    r"(?i)\b(?:e-?mail|mail|write|reach|contact|correo|courriel)\b",
    r"(?i)\b(?:order|invoice|version|ref|isbn|issn|page|date|part|model|ticket|serial|no|nr|item|build|sku)\b",
)
_WINDOW = 32
FEATURES = ("kind", "length", "digits", "letters", "gaps", "first", "checks", "phone_hint", "ssn_hint", "bank_hint", "mail_hint", "other_hint", "near_letter")


_SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"
#: Ends of addresses that are common enough to tell.
_DOMAINS = "com|org|net|edu|gov|info|io|eu|de|fr|es|it|nl|uk|us|ch|at|be|pl"
#: Matches that are gathered at a time, so that long texts don't copy ever longer arrays.
_CHUNK = 256


def matches(text: Column, pattern: str, keep=None) -> Column:
    """All leftmost non-overlapping matches as array<struct<start, end, value, before, after>>: before and after are up to _WINDOW characters around.

    split() gives what lies between the matches, so adding up lengths gives places, and no place is looked up in the text again.
    """
    none = F.array().cast(f"array<{_SPAN}>")

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        before = F.substring(F.concat(acc["tail"], F.substring(part["gap"], -_WINDOW, _WINDOW)), -_WINDOW, _WINDOW)
        after = F.substring(F.coalesce(part["next"], F.lit("")), 1, _WINDOW)
        found = F.array(F.struct(start.alias("start"), end.alias("end"), part["hit"].alias("value"), before.alias("before"), after.alias("after")))
        wanted = part["hit"].isNotNull() if keep is None else part["hit"].isNotNull() & keep(part["hit"])
        tail = F.substring(F.concat(before, F.coalesce(part["hit"], F.lit(""))), -_WINDOW, _WINDOW)
        return F.struct(end.alias("at"), tail.alias("tail"), F.when(wanted, F.concat(acc["found"], found)).otherwise(acc["found"]).alias("found"))

    def chunked(all_parts: Column) -> Column:
        def chunk(acc: Column, first: Column) -> Column:
            own = F.aggregate(F.slice(all_parts, first, _CHUNK), F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), none.alias("found")), step)
            return F.struct(own["at"].alias("at"), own["tail"].alias("tail"), F.array_append(acc["found"], own["found"]).alias("found"))

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<array<{_SPAN}>>").alias("found"))
        return F.aggregate(F.sequence(F.lit(1), F.size(all_parts), F.lit(_CHUNK)), start, chunk, lambda acc: F.flatten(acc["found"]))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = lambda gaps: F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.slice(gaps, 2, F.size(gaps)).alias("next"))
    # lambdas' variables: the text is cut once, and zipped once
    return F.get(F.transform(F.transform(F.array(F.split(text, pattern, -1)), parts), chunked), 0)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Luhn's checksum over the digits of value."""
    back = F.reverse(_digits(value))
    return (
        F.aggregate(
            F.sequence(F.lit(1), F.length(back)),
            F.lit(0),
            lambda total, i: total + F.when(i % 2 == 1, _digit(back, i)).otherwise(_digit(back, i) * 2 - F.when(_digit(back, i) > 4, 9).otherwise(0)),
        )
        % 10
        == 0
    )


def _digit(text: Column, i: Column) -> Column:
    return F.ascii(F.substring(text, i, F.lit(1))) - 48


def _valid(kind: str):
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    if kind == "ip":
        return lambda v: v.rlike(rf"\A{part}(?:\.{part}){{3}}\z")
    if kind == "card":
        return _luhn
    if kind == "phone":
        return lambda v: F.length(_digits(v)).between(8, 15)
    return None


def _only_where(text: Column, kind: str, found: Column) -> Column:
    mark = _NEEDS.get(kind)
    if kind == "email_spelled":
        return F.when(text.rlike(r"[\[({](?:at|AT|At)[\])}]|\x20(?:at|AT)\x20[A-Za-z0-9-]+\x20(?:dot|DOT)\x20"), found)
    return found if mark is None else F.when(text.contains(mark), found)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> of the base kinds, in their order, then by start."""
    each = []
    for kind in BASE:
        found = _only_where(text, kind, matches(text, _PATTERN[kind], _valid(kind)))
        each.append(F.transform(_or_none(found), _tagged(kind)))
    return F.concat(*each)


def _or_none(found: Column) -> Column:
    return F.coalesce(found, F.array().cast(f"array<{_SPAN}>"))


def _tagged(kind: str, *more):
    """A function that puts the kind before a match's fields, and what `more` gives of the match after them."""
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), *(f(s) for f in more))


def candidates(text: Column) -> Column:
    """Overlapping candidates with their features: array<struct<kind, start, end, value, x:array<double>>>."""
    each = []
    for k, kind in enumerate(ADDED):
        found = _or_none(_only_where(text, kind, matches(text, _GENERATOR[kind])))
        each.append(F.transform(found, _tagged(kind, partial(_features, k))))
    return F.concat(*each)


def _mod97(value: Column) -> Column:
    """The check of account numbers: the first four characters last, letters as 10 to 35, remainder 1."""
    plain = F.upper(F.regexp_replace(value, r"\x20", ""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(turned, "(?!^)(?!$)"),
        F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )
    return (rest == 1).cast("double")


def _features(k: int, s: Column) -> Column:
    """The inputs of the trees, in the order of FEATURES."""
    value, before = s["value"], s["before"]
    digits, letters = F.length(_digits(value)), F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    checks = {
        "iban": lambda: _mod97(value), "ssn": lambda: (~value.rlike(r"\A(?:000|666|9[0-9]{2})|\A[0-9]{3}[-\x20]?00|0000\z")).cast("double"),
        "email_spelled": lambda: value.rlike(rf"(?i)[^A-Za-z](?:{_DOMAINS})\z").cast("double"), "phone_local": lambda: F.lit(0.0),
    }[ADDED[k]]()
    near = s["after"].rlike(r"\A[A-Za-z0-9]")
    return F.array(
        *(c.cast("double") for c in (
            F.lit(float(k)), F.length(value), digits, letters, F.length(value) - digits - letters,
            F.when(value.startswith("("), 2).when(value.rlike(r"\A[0-9]"), 1).otherwise(0),
            checks, *(before.rlike(h) for h in _HINTS), near,
        ))
    ).alias("x")


def synthetic(n: int = 1600, seed: int = 11) -> tuple[list[str], list[int]]:
    """Labelled training texts, each with one candidate: real formats in their contexts, and look-alikes."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    made, label = [], []
    sep = lambda: rng.choice(("-", " ", "-", ""))
    say = {
        "ssn": ["SSN ", "social security number: ", "my ssn is ", "taxpayer id (SSN): ", "Social Security no. ", "SIN: "],
        "iban": ["IBAN ", "IBAN: ", "pay to account ", "bank transfer: ", "Konto ", "compte ", "cuenta: "],
        "phone": ["call ", "tel: ", "phone ", "fax ", "mobile ", "contact me at ", "Telefon ", "téléphone : ", "WhatsApp ", "Handy: ", "tel. "],
        "mail": ["mail ", "e-mail: ", "write to ", "reach me at ", "contact ", "correo: ", "courriel "],
        "not": ["order ", "invoice no ", "part ", "ref ", "ticket ", "serial ", "item ", "model ", "version ", "build "],
        "plain": ["the ", "and then ", "values of ", "about ", "see "],
    }

    def iban(good: bool) -> str:
        land, size = rng.choice([("DE", 18), ("FR", 23), ("ES", 20), ("NL", 14), ("IT", 23), ("GB", 18), ("BE", 12), ("CH", 17), ("AT", 16), ("PL", 24)])
        letters = 4 if land in ("NL", "GB") else 0
        body = "".join(rng.choice("ABCDEFGHIKLMNOPRSTUVW") for _ in range(letters)) + d(size - letters)
        number = int("".join(str(int(c, 36)) for c in body + land) + "00")
        check = 98 - number % 97 if good else (98 - number % 97 + rng.randint(1, 90)) % 97
        whole = f"{land}{check:02d}{body}"
        shape = rng.random()
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if shape < 0.4 else whole.lower() if shape < 0.6 else whole

    def code() -> str:
        return rng.choice("ABCDX") + rng.choice("ABCDX") + d(2) + "".join(" " + "".join(rng.choice("ABCDEFGHIJKLMNOP") for _ in range(4)) for _ in range(rng.randint(3, 6)))

    def phone() -> str:
        return rng.choice(
            [f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"(0{d(2)}) {d(4)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}", f"0{d(3)}/{d(3)} {d(3)}",
             "0" + rng.choice("123456789") + "".join(rng.choice(" .") + d(2) for _ in range(4)), f"0{d(4)} {d(3)}{d(4)}", d(10), f"0{d(10)}", f"{d(3)}-{d(4)}"]
        )

    at, dot = [" [at] ", "(at)", "[at]", " (at) ", " {at} ", " [AT] "], [".com", " [dot] org", "(dot)net", " (dot) de", ".info", " [DOT] net", " dot fr"]

    def spelled() -> str:
        """An address in words or brackets."""
        who, where = rng.choice(["ann", "bo.li", "jdoe", "maria.k", "x_99", "info", "jonathan.maximilian.featherstonehaugh_worthington-smythe"]), rng.choice(["mail", "corp", "my-host", "uni"])
        return f"{who} at {where} dot {rng.choice(['com', 'org', 'de', 'fr', 'net'])}" if rng.random() < 0.3 else f"{who}{rng.choice(at)}{where}{rng.choice(dot)}"

    def unspelled() -> str:
        return rng.choice([f"{rng.choice(['look', 'meet us', 'stay'])} (at) {rng.choice(['home', 'noon'])}.{rng.choice(['Then', 'We', 'It'])}", f"{rng.choice(['look', 'stare', 'point'])} at {rng.choice(['the', 'each', 'every'])} dot {rng.choice(['matrix', 'now', 'again', 'here'])}"])
    for _ in range(n // 8):
        s = sep()
        made += [
            rng.choice(say["ssn"] + say["plain"][:1] * bool(s)) + f"{rng.randint(1, 665):03d}{s}{rng.randint(1, 99):02d}{s}{rng.randint(1, 9999):04d}",
            rng.choice(say["not"] + say["plain"]) + f"{d(3)}{s}{d(2)}{s}{d(4)}",
            rng.choice(say["iban"] + say["plain"]) + iban(True),
            rng.choice(say["not"] + say["plain"]) + (iban(False) if rng.random() < 0.7 else code()),
            rng.choice(say["phone"]) + phone(),
            rng.choice(say["not"] + say["plain"]) + rng.choice([f"{d(3)} {d(3)} {d(3)}", f"{d(4)}-{d(4)}-{d(4)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(4)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", d(10), f"{d(3)}-{d(4)}"]),
            rng.choice(say["mail"] + say["plain"][:2]) + spelled(),
            rng.choice(say["plain"]) + unspelled(),
        ]
        label += [1, 0] * 4
    return [f"{t} {rng.choice(['ok', '.', 'today', ', thanks'])}" for t in made], label


class Selector:
    """Boosted trees and a threshold for each added kind."""

    def __init__(self, model: Boosted, thresholds: list[float]):
        self.model, self.thresholds = model, thresholds

    def score(self, x: Column) -> Column:
        return self.model.column(lambda j: x[j])

    def selected(self, text: Column) -> Column:
        """Candidates over their threshold, with their score."""
        limit = lambda x: F.element_at(F.array(*(F.lit(t) for t in self.thresholds)), x[0].cast("int") + 1)
        scored = F.transform(
            candidates(text), lambda c: F.struct(c["kind"], c["start"], c["end"], c["value"], self.score(c["x"]).alias("score"), limit(c["x"]).alias("limit"))
        )
        return F.filter(scored, lambda c: c["score"] >= c["limit"])


def train(spark: SparkSession, precision: float = 0.95, seed: int = 11) -> Selector:
    """Fit the trees on synthetic labelled texts (a fixed number), through the same feature expressions.

    Half of the rows calibrates: a kind's threshold lies under the lowest score with at least `precision`.
    """
    made, label = synthetic(seed=seed)
    rows = [(i, t, y) for i, (t, y) in enumerate(zip(made, label, strict=True))]
    frame = spark.createDataFrame(rows, "i int, text string, y int").repartition(2, "i")
    got = frame.select("i", "y", F.explode(candidates(F.col("text"))).alias("c")).select("i", "y", "c.x").orderBy("i", F.col("x").cast("string")).collect()
    x, y, i = np.array([r.x for r in got]), np.array([r.y for r in got], float), np.array([r.i for r in got])
    fit = (i // 8) % 2 == 0
    model = boost(x[fit], y[fit])
    score, thresholds = model.log_odds(x[~fit]), []
    for k in range(len(ADDED)):
        own = x[~fit][:, 0] == k
        s, t = score[own], y[~fit][own]
        order = np.argsort(-s, kind="stable")
        good = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        last = np.append(s[order][1:] < s[order][:-1], True) if len(order) else np.array([], bool)
        fine = np.flatnonzero((good >= precision) & last)
        # halfway to the first score that is left out
        under = s[order][fine[-1] + 1 : fine[-1] + 2] if len(fine) else []
        thresholds.append(float((s[order][fine[-1]] + (under[0] if len(under) else s[order][fine[-1]] - 1)) / 2) if len(fine) else 1e9)
    return Selector(model, thresholds)


_ITEM = "struct<start:int,end:int,rank:int,score:double,kind:string,value:string>"


def _heaps(items: Column) -> Column:
    """Spans in order of start, parted where no span reaches over: array<array<span>>. Only spans of one heap can overlap."""
    none = F.array().cast(f"array<{_ITEM}>")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["reach"]
        return F.struct(
            F.greatest(acc["reach"], s["end"]).alias("reach"), F.when(fresh, F.array(s)).otherwise(F.array_append(acc["heap"], s)).alias("heap"),
            F.when(fresh & (F.size(acc["heap"]) > 0), F.array_append(acc["done"], acc["heap"])).otherwise(acc["done"]).alias("done"),
        )

    def chunked(all_: Column) -> Column:
        def chunk(acc: Column, first: Column) -> Column:
            start = F.struct(acc["reach"].alias("reach"), acc["heap"].alias("heap"), F.array().cast(f"array<array<{_ITEM}>>").alias("done"))
            own = F.aggregate(F.slice(all_, first, _CHUNK), start, step)
            return F.struct(own["reach"].alias("reach"), own["heap"].alias("heap"), F.array_append(acc["done"], own["done"]).alias("done"))

        start = F.struct(F.lit(0).alias("reach"), none.alias("heap"), F.array().cast(f"array<array<array<{_ITEM}>>>").alias("done"))
        firsts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(all_)), F.lit(_CHUNK))
        return F.aggregate(firsts, start, chunk, lambda acc: F.array_append(F.flatten(acc["done"]), acc["heap"]))

    return F.get(F.transform(F.array(F.array_sort(items)), chunked), 0)


def _won(heap: Column) -> Column:
    """The candidates of a heap that overlap no base span and no better candidate."""
    clash = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    better = lambda o, c: (o["score"] > c["score"]) | ((o["score"] == c["score"]) & ((o["start"] < c["start"]) | ((o["start"] == c["start"]) & (o["rank"] < c["rank"]))))
    free = F.filter(heap, lambda c: (c["rank"] >= 0) & ~F.exists(heap, lambda b: (b["rank"] < 0) & clash(b, c)))
    return F.flatten(F.transform(F.array(free), lambda own: F.filter(own, lambda c: ~F.exists(own, lambda o: clash(o, c) & better(o, c)))))


def find(docs: DataFrame, selector: Selector) -> DataFrame:
    """docs with `base` and `added`: arrays of struct<kind, start, end, value>.

    Spans are sorted and parted into heaps of overlapping ones, so the work grows with the spans of a text and not with their square.
    """
    rank = lambda c: F.array_position(F.array(*(F.lit(k) for k in ADDED)), c["kind"]).cast("int")
    item = lambda c, rank, score: F.struct(c["start"].alias("start"), c["end"].alias("end"), rank.alias("rank"), score.alias("score"), c["kind"].alias("kind"), c["value"].alias("value"))
    found = docs.withColumn("base", base_spans(F.col("text"))).withColumn("_some", selector.selected(F.col("text")))
    both = F.concat(F.transform("base", lambda b: item(b, F.lit(-1), F.lit(0.0))), F.transform("_some", lambda c: item(c, rank(c), c["score"])))
    won = F.flatten(F.transform(_heaps(both), _won))
    ordered = F.array_sort(F.transform(won, lambda c: F.struct(c["rank"].alias("r"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["value"].alias("value"))))
    added = F.transform(ordered, lambda c: F.struct(c["kind"], c["start"], c["end"], c["value"]))
    return found.withColumn("added", F.when(F.size("_some") > 0, added).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>"))).drop("_some")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; of overlapping spans the first to start stands, and all are covered."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        end = -s["back"]
        fresh = s["start"] >= acc["at"]
        piece = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(
            F.greatest(acc["at"], end).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(piece, mark))).otherwise(acc["out"]).alias("out")
        )

    return F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])),
    )


def redact(docs: DataFrame, selector: Selector) -> DataFrame:
    """docs, all columns kept, with personal data replaced in text (null stays null) and n_chars following where it exists."""
    found = find(packed_rows(docs, "text"), selector)
    new = F.when(F.size("base") + F.size("added") > 0, redacted(F.col("text"), F.concat("base", "added"))).otherwise(F.col("text"))
    found = found.select("_row", new.alias("_new"))
    changed = {"text": F.col("_new"), "n_chars": F.when(F.col("_new").isNull(), F.lit(None)).otherwise(F.length("_new"))}
    out = []
    for c in docs.columns:
        kept = F.col("_row")[c]
        out.append((F.coalesce(changed[c].cast(docs.schema[c].dataType), kept) if c in changed else kept).alias(c))
    return found.select(*out)


def report(docs: DataFrame, selector: Selector) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, all spans, and their number."""
    found = find(texts(docs), selector)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *(count(k) for k in BASE), F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
