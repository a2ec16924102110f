"""Line-first cleaning: rules judge each line, failed lines go, and documents that lose too much go.

Rules for a line (a line without a word is neither kept nor counted as lost):
- navigation: separators (`|`, `»`, `>`, `/` or bullets standing alone) are at least 30 % of its words;
- punctuation: symbol runs end at least 30 % of its words, or exclamation marks end at least half;
- boilerplate: it is short and holds a phrase of the fixed list below;
- fragments: fewer than `least_line_words` words and no closing punctuation.
A document goes if more than `most_lost` of its word characters stand in failed lines, or if the base
limits fail (fewer than 50 words, or over half of its words in three-word windows that recur).

Arrow batches carry the texts through numpy and Python; each text is judged alone, so memory is
bounded by a batch. Null text counts as empty (no words, base failed). Repeated rows repeat. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from emberline.llm.common import WORD, texts

_SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "log in",
    "lorem ipsum", "privacy policy", "read more", "share this", "sign in", "sign up", "skip to content", "subscribe to our",
    "terms of service", "terms of use", "we use cookies",
)

_word = re.compile(WORD)
_phrases = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE)
_separator = re.compile(r"(?:[|»>/·•\-]+)\Z")
_noisy = re.compile(r"[#*$%&|<>=~^_]{2,}\Z")
_closing = (".", "!", "?", "…", ":", ";", '"', "'", "”", "»", ")", "。")


@dataclass(frozen=True)
class Limits:
    most_lost: float = 0.5
    navigation: float = 0.3
    noisy: float = 0.3
    shouting: float = 0.5
    least_line_words: int = 4
    boilerplate_words: int = 30


def repeated_words(found: list[str]) -> int:
    """Words that stand in a three-word window which the text holds twice or more."""
    n = len(found)
    if n < 4:
        return 0
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in found), np.int64, n)
    if len(codes) == n:
        return 0
    pairs = np.unique(ids[:-1] * len(codes) + ids[1:], return_inverse=True)[1]
    triples = pairs[:-1] * len(codes) + ids[2:]
    _, where, count = np.unique(triples, return_inverse=True, return_counts=True)
    again = count[where] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= again
    return int(hit.sum())


def line_fails(line: str, found: list[str], limits: Limits) -> bool:
    n = len(found)
    if n < limits.least_line_words and not line.rstrip().endswith(_closing):
        return True
    if sum(1 for w in found if _separator.match(w)) >= limits.navigation * n:
        return True
    if sum(1 for w in found if w[-1] in "#*$%&|<>=~^_" and _noisy.search(w)) >= limits.noisy * n:
        return True
    if n >= 4 and sum(1 for w in found if w.endswith("!!")) >= limits.shouting * n:
        return True
    return n <= limits.boilerplate_words and _phrases.search(line) is not None


def judge(text: str, limits: Limits) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, lines_failed, text of kept lines)."""
    all_words: list[str] = []
    seen: set[str] = set()
    duplicates = lost = chars = lines = failed = 0
    stay = []
    for line in text.split("\n"):
        found = _word.findall(line)
        if not found:
            stay.append(line)
            continue
        all_words += found
        size = sum(map(len, found))
        lines, chars = lines + 1, chars + size
        duplicates += line in seen
        seen.add(line)
        if line_fails(line, found, limits):
            lost, failed = lost + size, failed + 1
        else:
            stay.append(line)
    n = len(all_words)
    again = repeated_words(all_words)
    base_failed = n < 50 or 100 * again > 50 * n
    kept = not base_failed and lost <= limits.most_lost * chars
    return n, chars, sum(map(text.count, _SYMBOLS)), duplicates, again, base_failed, kept, lines, failed, "\n".join(stay)


_COLUMNS = (
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("base_failed", "boolean"), ("kept", "boolean"), ("n_lines", "long"), ("lines_failed", "long"), ("clean_text", "string"),
)


def clean(docs: DataFrame, limits: Limits = Limits(), with_text: bool = True) -> DataFrame:
    """doc_id, the counts, base_failed, kept and (with_text) the text without its failed lines."""
    columns = _COLUMNS if with_text else _COLUMNS[:-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [judge(t, limits)[: len(columns)] for t in batch["text"]]
            out = pd.DataFrame(rows, columns=[c for c, _ in columns])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    plain = texts(docs)
    kind = dict(plain.dtypes)["doc_id"]
    return plain.mapInPandas(run, f"doc_id {kind}, " + ", ".join(f"{c} {t}" for c, t in columns))
