"""BPE encoding and decoding through a table of distinct words (see `wordtable`): words are split, each distinct one is encoded once,
and ids go back to the texts by position. Decoding joins ids with their pieces: the table of pieces has the vocabulary's size
and is broadcast. `decoded` does so for any table of ids, by a join of DataFrames.

The split agrees with the tokenizer's because a text of characters from tables that tests hold against it takes a regular expression, and any other text
the tokenizer's own normalizer and pre-tokenizer. Special tokens in a text are words of their own, as the library has them.
Pieces are joined by one space, which is what the library does for a vocabulary without a decoder; one with a decoder is refused.

Cases: null and empty texts have no ids and decode to empty text. Repeated rows and rows without doc_id are rows of their own. Long words and texts are
encoded whole. An empty table gives no rows. Only doc_id and text are read, so other columns don't matter.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import wordtable
from emberline.llm.wordtable import NOT_PLAIN, plain_pattern

_splitters: dict = {}


class Splitter:
    """Texts to words, as the tokenizer in a file splits them."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(vocabulary) as text:
            parts = json.load(text)
        pattern = parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if [n["type"] for n in parts["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or parts["decoder"] is not None:
            raise ValueError("this vocabulary has another normalizer or decoder than the split knows")
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self._own = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self._bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._plain = plain_pattern(pattern)

    def _words(self, text: str) -> list[str]:
        if text.isascii() or not NOT_PLAIN.search(text):
            return self._plain.findall(text.lower())
        return [w for w, _ in self._own.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def __call__(self, text: str) -> list[str]:
        if "<|" not in text:
            return self._words(text)
        return [w for part in self._cut.split(text) for w in ([part] if part in self.special else self._words(part))]

    def encoded(self, words: list[str]) -> list[list[int]]:
        """The ids of words of the split."""
        plain = [w for w in words if w not in self.special and not NOT_PLAIN.search(w)]
        known = dict(zip(plain, (e.ids for e in self.tokenizer.encode_batch(plain, add_special_tokens=False)), strict=True))
        return [known[w] if w in known else self._odd(w) for w in words]

    def _odd(self, word: str) -> list[int]:
        """Past the normalizer, which needn't leave its own result alone outside the plain characters."""
        if word in self.special:
            return [self.special[word]]
        return [t.id for shown, _ in self._bytes.pre_tokenize_str(word) for t in self.tokenizer.model.tokenize(shown)]


def _splitter(vocabulary: str) -> Splitter:
    if vocabulary not in _splitters:
        _splitters[vocabulary] = Splitter(vocabulary)
    return _splitters[vocabulary]


def _default() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """id, piece: the whole vocabulary."""
    table = _splitter(vocabulary or _default()).tokenizer.get_vocab(with_added_tokens=True)
    return spark.createDataFrame(sorted((i, p) for p, i in table.items()), "id int, piece string")


def decoded(rows: DataFrame, key: str, vocabulary: str | None = None) -> DataFrame:
    """key, decoded of rows (key, ids), key unique: the pieces of the ids in their order, joined by one space."""
    each = rows.select(key, F.posexplode("ids").alias("_at", "id"))
    known = F.broadcast(pieces(rows.sparkSession, vocabulary))  # as many rows as the vocabulary
    met = each.join(known, "id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "piece"))).alias("_all"))
    found = met.select(F.col(key).alias("_key"), F.array_join(F.transform("_all", lambda x: x["piece"]), " ").alias("decoded"))
    return rows.select(key).join(found, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.coalesce("decoded", F.lit("")).alias("decoded"))


def encoded(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>), decoded (string) of every document."""
    spark, vocabulary = docs.sparkSession, vocabulary or _default()
    table = spark.sparkContext.broadcast([r["piece"] for r in pieces(spark, vocabulary).orderBy("id").collect()])  # the vocabulary

    def finish(of_words: pa.ListArray):
        known = pa.array(table.value)
        shown = pc.binary_join(pa.ListArray.from_arrays(of_words.offsets, known.take(of_words.values)), " ")

        def rows(docs: pa.Array, codes: pa.Array, at: np.ndarray) -> pa.RecordBatch:
            each = of_words.take(codes)
            ids = pa.ListArray.from_arrays(pa.array(each.offsets.to_numpy()[at], pa.int32()), each.values)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), shown.take(codes)), " ")
            return pa.RecordBatch.from_arrays([docs, ids, text], ["doc_id", "ids", "decoded"])

        return rows

    return wordtable.encoded(docs, lambda: _splitter(vocabulary), finish, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, decoded string")
