"""Secrets: fixed base patterns, and values in a credential's context that would be costly to guess.

A value's guess cost is found by dynamic programming: the cheapest way to cut it into dictionary
words, dates, repeats, keyboard walks and brute-force spans, each with its own number of guesses, in
log10, plus the cost of arranging them. A value found after a credential word is a secret if its
cost reaches `least_cost`. The base kinds (assign, access, hex) always stay; added spans (kind
"guess") cover the value alone and never lie within a base span or another added one. A credential word
may follow a name and '_' or '-'; password, passwd, secret, token and api key may end any name.

A value in quotes reaches to the closing one; any other to white space, a quote or a tag, or the next name of a list. Ordinary words are
cheap: their guesses are their rank in a public vocabulary, which lists pieces of words by frequency. What reads like a word and follows after a bare space
(or "is") must cost 10^18 guesses instead of 10^10, since that is how prose looks.

Null text is empty text. Repeated rows repeat. An empty table gives no rows. Whole texts are scanned, and values of six characters or more, of every length, run
through the dynamic program, in linear time.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from emberline.llm.common import texts

BASE = ("assign", "access", "hex")
_either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_ASSIGN = re.compile(
    "(?:" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Credential words, and what stands between one and its value (group "plain": nothing but a space, or "is").
_CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z0-9])(?:pwd|pass|passphrase|passcode|credentials?|auth|authorization|bearer|(?:private|access|secret)[_-]?key|session[_-]?id|pin|login)"""
    r"""|password|passwd|secret|token|api[\x20_-]?key)\b"""
    r"""["']?\x20*(?:(?P<plain>is\x20+|\x20)|[:=]\x20*)(?:bearer\x20+|basic\x20+)?(?=(?P<value>[^\x20\x09-\x0D]))""",
    re.IGNORECASE | re.ASCII,
)
#: A value: up to its closing quote on the line, or up to white space, quotes and tags; a list's next name ends it too.
_QUOTED = {q: re.compile(rf"{q}([^{q}\n]*){q}") for q in "\"'`"}
_BARE = re.compile(r"""[^\x20\x09-\x0D"'`<>]+""")
_NEXT = re.compile(r"""[,;&](?=[A-Za-z_][A-Za-z0-9_.-]*["']?[=:])""")
#: Letters that read like words of a sentence.
_WORDY = re.compile(r"[A-Za-z]?[a-z]+(?:['’][a-z]+)?(?:[-/][A-Za-z]?[a-z]+)*|[A-Z]+")
_TRIGGER = re.compile("pwd|pass|credential|auth|bearer|key|secret|token|session|pin|login", re.IGNORECASE | re.ASCII)

#: Common passwords, most common first.
WORDS = (
    "password", "123456", "qwerty", "admin", "welcome", "letmein", "login", "master", "dragon", "monkey", "iloveyou", "sunshine",
    "princess", "football", "baseball", "shadow", "superman", "michael", "jordan", "hunter", "secret", "summer", "winter", "spring",
    "autumn", "changeme", "default", "test", "guest", "root", "user", "example", "token", "server", "database", "local", "change",
    "love", "hello", "world", "computer", "internet", "company", "freedom", "whatever", "trustno", "pass", "access", "system",
)
#: Endings of English words, which cost as one of so many.
ENDINGS = ("ing", "ings", "ness", "ment", "ments", "tion", "tions", "able", "ible", "ally", "fully", "less", "ers", "ors", "ies", "ied", "est", "ous", "ism", "ist")
_LONGEST = 20
_ranks: dict = {}


def ranks(vocabulary: str | None = None) -> dict[str, int]:
    """Words and their guesses: common passwords by rank, and after them the words of a public vocabulary, whose pieces stand in order of frequency.

    Pieces that continue a word count too, so that a word that isn't in the list is a few pieces, and endings have their own short list.
    """
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _ranks:
        with open(path) as file:
            pieces = json.load(file)["model"]["vocab"]
        found = {w: k for k, w in enumerate(WORDS, 1)} | dict.fromkeys(ENDINGS, len(ENDINGS))
        for piece, _ in sorted(pieces.items(), key=lambda p: p[1]):
            word = piece.removeprefix("\u0120").lower()
            if 3 <= len(word) <= _LONGEST and word.isascii() and word.isalpha():
                found.setdefault(word, len(found) + 1)
        _ranks[path] = found
    return _ranks[path]


_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_NEAR = {(a, b) for row in _ROWS for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))} | {
    (a, b) for r, s in zip(_ROWS, _ROWS[1:]) for i, x in enumerate(r) for y in s[max(0, i - 1) : i + 1] for a, b in ((x, y), (y, x))
}
_LEET = str.maketrans("4@310$57!", "aaeiossti")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)\d\d|\d\d)")


def _alphabet(c: str) -> float:
    """log10 guesses of one character by brute force within its class."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33) if c.isascii() else 2.0


def _arcs(value: str) -> Iterator[list[tuple[int, float]]]:
    """For each start, the (end, log10 guesses) of the words, dates, repeats, walks and runs found there.

    The end of a run holds for all starts within it, so each run is followed once.
    """
    n, low, known = len(value), value.lower(), ranks()
    plain = low.translate(_LEET)
    same = near = steps = 0
    unlike = {2: -1, 3: -1, 4: -1}  # the first place whose character isn't that a width further on
    for i in range(n):
        arcs = []
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            for form, extra in ((low, 0.0), (plain, 0.3)):
                if form[i:j] in known:
                    case = 0.0 if value[i:j] == low[i:j] else 0.3 if value[i].isupper() and value[i + 1 : j] == low[i + 1 : j] else 1.0
                    arcs.append((j, math.log10(known[form[i:j]] + 1) + extra + case))
        if m := _DATE.match(value, i):
            arcs.append((m.end(), 4.6 if m.end() - i > 4 else 2.1))
        if same <= i:
            same = i + 1
            while same < n and low[same] == low[i]:
                same += 1
        if same - i >= 3:
            arcs.append((same, _alphabet(value[i]) + math.log10(same - i)))
        for width in unlike:
            k = unlike[width]
            if k < i:
                k = i
                while k + width < n and low[k] == low[k + width]:
                    k += 1
                unlike[width] = k
            times = (k - i) // width + 1
            if times >= 2:
                arcs.append((i + times * width, sum(map(_alphabet, value[i : i + width])) + math.log10(times)))
        if near <= i:
            near = i + 1
            while near < n and (low[near - 1], low[near]) in _NEAR:
                near += 1
        if near - i >= 4:
            arcs.append((near, math.log10(47 * (near - i)) + 0.5))
        if steps <= i + 1:
            steps = i + 1
            step = ord(low[steps]) - ord(low[i]) if steps < n else 0
            while steps < n and abs(step) == 1 and ord(low[steps]) - ord(low[steps - 1]) == step and low[steps].isalnum():
                steps += 1
        if steps - i >= 3:
            arcs.append((steps, 1.2 + math.log10(steps - i)))
        yield arcs


def patterns(value: str) -> list[list[tuple[int, float]]]:
    """The patterns of all starts."""
    return list(_arcs(value))


def guess_cost(value: str, enough: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation of value needs; once none can stay below `enough`, that.

    The states are the characters used and the number of segments so far: the k-th segment also pays
    log10(k) for its place in the arrangement. Brute-force spans grow by a character at a time. Costs only
    grow, and a state is dropped when it is passed, so time is linear and memory holds the open ends alone.
    """
    most = 8  # segments told apart; further ones pay like the eighth
    inf = math.inf
    best = {0: [0.0] + [inf] * most}  # by the end of the last pattern
    brute = [inf] * (most + 1)  # ends within a brute-force span
    for i, arcs in enumerate(_arcs(value)):
        cut, on, grown = best.pop(i, None), brute, [inf] * (most + 1)
        one = _alphabet(value[i])
        for k in range(most + 1):
            begun = cut[k] if cut else inf
            at = min(begun, on[k])
            if at == inf:
                continue
            to, place = min(most, k + 1), math.log10(min(most, k + 1))
            grown[k] = min(grown[k], on[k] + one)
            grown[to] = min(grown[to], begun + one + place)
            for j, cost in arcs:
                row = best.setdefault(j, [inf] * (most + 1))
                row[to] = min(row[to], at + cost + place)
        brute = grown
        if min(brute) >= enough and all(min(row) >= enough for row in best.values()):
            return enough
    return min(*brute, *best.get(len(value), brute))


#: What looks like a word after a bare space must cost so many times the bound (in digits of guesses).
_PROSE = 1.8


def _value(text: str, at: int) -> tuple[int, int]:
    """Where the value that begins at a place starts and ends."""
    if text[at] in _QUOTED and (m := _QUOTED[text[at]].match(text, at)):
        return m.span(1)
    at += text[at] in _QUOTED
    m = _BARE.match(text, at)
    if m is None:
        return at, at
    value = m[0]
    if cut := _NEXT.search(value):
        value = value[: cut.start()]
    return at, at + len(value.rstrip(".)]}:!?,;"))


def find(text: str, least_cost: float = 10.0, least_length: int = 6) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, added spans) as (start, end, kind), in order."""
    base = []
    if ":" in text or "=" in text:
        base += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        base += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    base += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    base.sort(key=lambda s: (s[0], BASE.index(s[2])))
    added = []
    if _TRIGGER.search(text):
        for m in _CONTEXT.finditer(text):
            start, end = _value(text, m.start("value"))
            value = text[start:end]
            if len(value) < least_length or any(s <= start and end <= e for s, e, _ in base) or (added and start < added[-1][1]):
                continue
            prose = m["plain"] is not None and _WORDY.fullmatch(value)
            least = least_cost * _PROSE if prose else least_cost
            if guess_cost(value, least) >= least:
                added.append((start, end, "guess"))
    return base, added


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, least_cost: float = 10.0) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, all spans, and the added ones' number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                base, added = find(text, least_cost)
                counts = [sum(1 for s in base if s[2] == k) for k in BASE]
                every = sorted(base + added, key=lambda s: (s[0], (*BASE, "guess").index(s[2])))
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(added)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    plain = texts(docs)
    kind = dict(plain.dtypes)["doc_id"]
    return plain.mapInPandas(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")
