"""BPE encoding and decoding against the tokenizers library."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from emberline.llm import bpe, packing, wordtable

from .helpers import AWKWARD, documents, every_row, prose

FILE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    *AWKWARD, "Don't we'll THEY'RE 's's ''s, 12345 x2y", "<|endoftext|>", "a<|endoftext|>B <|startoftext|><|startoftext|> <|END", "ΣΑΣ Ὀδυσσεύς İstanbul ǅ ﬁ Å é ẞ", "日本語 のテキスト。١٢٣ ½ Ⅷ",
    "tab\tnl\r\n\x0b\x0c\x1c\x1d\x85\xa0  x", "…“q” – — €5 ‰", "\x00\x01 \x7f", "😀👍🏽 👨‍👩‍👧", "a" * 3000 + "1" * 50 + "!" * 999, "don’t l'été aujourd'hui ça", "​zero‍width﻿", "x퟿yz",
    "Straße STRASSE ǰ ŉ ŧ", "<|<|endoftext|>|>",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def agrees(library, text, row):
    ids = library.encode(text or "", add_special_tokens=False).ids
    assert row["ids"] == ids, text
    assert row["decoded"] == library.decode(ids, skip_special_tokens=False), text


def test_encoding_matches_the_library(spark, library):
    rng = random.Random(5)
    alphabet = "aZé'’́ \n1,.ßΣİ中😀<|>Åẞ "
    texts = [*TEXTS, *(prose(i, 60) for i in range(20)), *("".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(150))]
    got = every_row(spark, bpe.encoded(documents(spark, texts).repartition(5)), len(texts))
    for i, text in enumerate(texts):
        agrees(library, text, got[i])


def test_chunks_and_buckets_hold_all_words_once(spark):
    texts = [prose(i % 5, 40) for i in range(30)] + ["", None]
    rows = wordtable.chunks(documents(spark, texts).repartition(4), lambda: bpe.Splitter(FILE), buckets=16).collect()
    held = [r for r in rows if r["codes"] is not None]
    assert sorted(d for r in held for d in r["doc_ids"]) == list(range(32)) and len({r["chunk"] for r in held}) == len(held)
    split = bpe.Splitter(FILE)
    for r in held:
        lists = sorted((x["bucket"], wordtable._listed(x["words"], x["lengths"])) for x in rows if x["chunk"] == r["chunk"] and x["words"])
        listed, at = [w for _, ws in lists for w in ws], 0
        assert len(set(listed)) == len(listed)
        words = dict(zip(np.cumsum(wordtable._spread(r["ranks"]), dtype=np.uint32).tolist(), listed, strict=True))
        codes = wordtable._decoded(r["codes"], r["more"])
        for d, n in zip(r["doc_ids"], r["sizes"], strict=True):
            assert [words[c] for c in codes[at : at + n]] == split(texts[d] or "")
            at += n


def test_texts_go_back_in_slices(monkeypatch):
    """Small chunks and slices, without Spark: the same ids as in one."""
    codes, sizes, ids = np.array([1, 0, 300, 300, 1, 0, 0]), [np.array([1, 2, 0]), np.zeros(298, np.uint32)], [np.array([7, 8, 9])]
    small, large = wordtable._coded(codes)
    ranks = wordtable._squeezed(np.diff(np.array([0, 300, 1, *range(2, 300)], np.uint32), prepend=np.uint32(0)))  # as the buckets list them
    columns = {"doc_ids": pa.array([[5, 6, 7, 8]]), "sizes": pa.array([[3, 0, 2, 2]], pa.list_(pa.int32())), "codes": pa.array([small]), "more": pa.array([large]), "ranks": pa.array([ranks])}
    chunk = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    def finish(of_words):
        return lambda docs, own, at: pa.RecordBatch.from_arrays([docs, pa.array([sum(of_words.take(own).to_pylist()[a:b], []) for a, b in zip(at, at[1:])], pa.list_(pa.int32()))], ["doc_id", "ids"])

    for at_once in (1, 2, 100):
        monkeypatch.setattr(wordtable, "_AT_ONCE", at_once)
        rows = [r for b in wordtable.in_place(chunk, sizes, ids, finish) for r in b.to_pylist()]
        assert [(r["doc_id"], r["ids"]) for r in rows] == [(5, [7, 8, 9]), (6, []), (7, [8, 9]), (8, [7, 7])]


def test_each_plain_character_splits_as_in_the_library(library):
    split = bpe.Splitter(FILE)
    for c in map(chr, wordtable.PLAIN):
        for text in (c, f"a{c}b", f"1{c}2", f".{c}!", f"'{c}", f"{c}'s"):
            shown = [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
            assert [w for x in split(text) for w, _ in split._bytes.pre_tokenize_str(x)] == shown, (hex(ord(c)), text)


def test_decoding_of_any_ids(spark, library):
    rng = random.Random(3)
    rows = [(k, [rng.randrange(49408) for _ in range(rng.randint(0, 30))]) for k in range(50)] + [(None, [5, 5, 5]), (99, None)]
    got = bpe.decoded(spark.createDataFrame(rows, "key long, ids array<int>"), "key").collect()
    assert sorted((r["key"] if r["key"] is not None else -1, r["decoded"]) for r in got) == sorted((k if k is not None else -1, library.decode(i or [], skip_special_tokens=False)) for k, i in rows)


def test_repeated_rows_null_ids_and_empty_tables(spark, library):
    docs = spark.createDataFrame([(1, "one two")] * 5 + [(None, "three"), (2, None), (2, "four")], "doc_id long, text string")
    got = bpe.encoded(docs).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in got) == sorted([*[(1, "one</w> two</w>")] * 5, (0, "three</w>"), (2, ""), (2, "four</w>")])
    assert bpe.encoded(docs.filter("1 = 0")).count() == 0
    assert bpe.encoded(docs.filter("doc_id = 2 and text is null")).collect()[0]["ids"] == []


def test_pre_tokens_of_packing_are_the_librarys():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    split, rng = packing.Words(public_tokenizers.path("byte_bpe_50k.json")), random.Random(9)
    texts = [t for c in map(chr, wordtable.PLAIN) for t in (c, f"a{c}b", f"1{c} 2", f". {c}!", f"'{c}", f" {c}  's", f"\n{c}\n")]
    texts += [t or "" for t in TEXTS] + ["".join(rng.choices("aZé'  \n\t1,.ß'sll\xa0", k=rng.randint(1, 30))) for _ in range(2000)]
    for text in texts:
        assert [i for ids in split.encoded(split(text)) for i in ids] == whole.encode(text, add_special_tokens=False).ids, repr(text)
