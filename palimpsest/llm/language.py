"""Language identification by bit-sliced Bloom filters of character n-grams.

For each language the filter holds the n-grams (2 to 4 characters, word boundaries
included) that are common in it. The filters are bit-sliced: slot ``i`` holds bit ``i`` of
every language's filter side by side as a bitmask, so one AND over the slots of an n-gram
gives all languages whose filter contains it. Popcounts per language over a whole text,
corrected for each filter's false-positive rate, decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .charblocks import Block, blocks
from .common import crc_mod, fresh, materialize

SIZES = (2, 3, 4)
UNDETERMINED = "und"
#: Up to so many languages' counts (one row each) are sent to every executor; beyond that the join shuffles.
BROADCAST_LANGS = 10_000


def grams(block: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n: n, the places of n-grams and their hashes. Non-letters count as one kind of boundary; n-grams without a letter in second place or across two boundaries are no n-grams."""
    inside = block.letter
    shown = np.where(inside, block.cp, np.uint32(32))
    h = block.prefix_hash(shown)
    for n in SIZES:
        last = len(shown) - n
        if last < 0:
            continue
        good = inside[1 : last + 2].copy()
        for k in range(2, n - 1):
            good &= inside[k : last + k + 1]
        if n == 2:
            good = inside[:-1] | inside[1:]
            good = good[: last + 1]
        at = np.flatnonzero(good)
        yield n, at, block.hash_between(h, at, at + n) + np.uint64(n)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            texts = [t for t, x in zip(batch.column(1).to_pylist(), langs, strict=True) if x == lang]
            found = [g for b in blocks(texts) for *_, g in grams(b)]
            if found:
                values, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


class Filters:
    """Bit-sliced Bloom filters: ``slots[i, w]`` has bit ``l`` set if language ``64 * w + l`` has slot ``i``."""

    def __init__(self, langs: list[str], grams_of: list[np.ndarray], bits: int, hashes: int):
        self.langs, self.bits, self.hashes = langs, bits, hashes
        words = max(1, -(-len(langs) // 64))
        kind = np.uint8 if len(langs) <= 8 else np.uint64
        self.slots = np.zeros((words, 1 << bits), kind)
        fill = []
        for l, g in enumerate(grams_of):
            hit = np.zeros(1 << bits, bool)
            for place in self.places(g):
                hit[place] = True
            self.slots[l // 64][hit] |= kind(1 << (l % 64))
            fill.append(hit.mean())
        self.false = np.array(fill) ** hashes

    def places(self, g: np.ndarray) -> Iterator[np.ndarray]:
        a, b = g >> np.uint64(64 - self.bits), (g >> np.uint64(8)) & np.uint64((1 << self.bits) - 1)
        for k in range(self.hashes):
            yield ((a + np.uint64(k) * (b | np.uint64(1))) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def masks(self, word: int, g: np.ndarray) -> np.ndarray:
        """The bitmask of languages (of 64 at a time) that contain each n-gram."""
        out = None
        for place in self.places(g):
            found = self.slots[word][place]
            out = found if out is None else out & found
        return out

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: n-grams, popcounts by language, whether it has a letter."""
        total, hits, letters = np.zeros(len(texts)), np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), bool)
        for block in blocks(texts, overlap=max(SIZES) - 1):
            np.logical_or.at(letters, block.rows, block.sums(block.letter.astype(np.int64)) > 0)
            ends = np.append(block.starts[1:], len(block.cp))
            for n, at, g in grams(block):
                # none that reach into the next text
                lo, hi = np.searchsorted(at, block.starts), np.searchsorted(at, np.maximum(ends - n + 1, block.starts))
                np.add.at(total, block.rows, hi - lo)
                for word in range(len(self.slots)):
                    mask = self.masks(word, g)
                    for l in range(64 * word, min(len(self.langs), 64 * word + 64)):
                        run = np.zeros(len(mask) + 1, np.int64)
                        np.cumsum((mask >> mask.dtype.type(l % 64)) & mask.dtype.type(1), out=run[1:])
                        np.add.at(hits[:, l], block.rows, run[hi] - run[lo])
        return total, hits, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        total, hits, letters = self.count(texts)
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        share = np.clip((hits / np.maximum(total, 1)[:, None] - self.false) / (1 - self.false), 0, 1)
        best = share.argmax(1)
        whole = share.sum(1)
        score = np.where(letters & (whole > 0), share.max(1) / np.where(whole > 0, whole, 1), 0.0)
        return [self.langs[b] if x else UNDETERMINED for b, x in zip(best, letters, strict=True)], score


def learn(docs: DataFrame, max_docs: int = 2000, max_grams: int = 20_000, min_share: float = 1e-5, ratio: float = 0.3, bits: int = 19, hashes: int = 3) -> Filters:
    """Filters from ``docs`` (text, lang, perhaps doc_id; rows without text or lang are left out).

    At most ``max_docs`` documents of each language are read, the first by a hash of their
    doc_id and text; a threshold on it is applied where rows are read, so none but about
    three times that many a language move. An n-gram enters a language's filter if it makes up ``min_share`` of that
    language's n-grams and at least ``ratio`` of its share in any other; at most
    ``max_grams`` of each enter, the most frequent ones.
    """
    key = ["doc_id", "text"] if "doc_id" in docs.columns else ["text"]
    rows = docs.select("lang", *key).where("lang is not null and text is not null")
    rank = Window.partitionBy("lang").orderBy("_h", *key)
    sizes = materialize(rows.groupBy("lang").agg(F.count("*").alias("_n")))
    if sizes.count() <= BROADCAST_LANGS:
        sizes = F.broadcast(sizes)
    rows = rows.withColumn("_h", F.xxhash64(*key)).join(sizes, "lang").where(F.pmod("_h", F.lit(1_000_003)) * F.col("_n") <= F.lit(1_000_003 * 3 * max_docs))
    sample = rows.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= max_docs).select("lang", "text")
    counts = materialize(sample.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    by_lang = counts.groupBy("lang").agg(F.sum("n").alias("_all"))
    shares = counts.join(by_lang, "lang").withColumn("share", F.col("n") / F.col("_all"))
    most = shares.groupBy("gram").agg(F.max("share").alias("_most"))
    kept = shares.where(F.col("share") >= min_share).join(most, "gram").where(F.col("share") >= ratio * F.col("_most"))
    order = Window.partitionBy("lang").orderBy(F.desc("share"), "gram")
    kept = kept.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_grams).groupBy("lang").agg(F.sort_array(F.collect_list("gram")).alias("grams"))
    found = {r["lang"]: np.array(r["grams"], np.int64).view(np.uint64) for r in kept.collect()}  # at most max_grams a language
    langs = sorted(found)
    return Filters(langs, [found[x] for x in langs], bits, hashes)


def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of these names are replaced).

    ``lang_pred`` is a learned language, or ``und`` (score 0) for a null text and one without
    letters; a text none of whose n-grams is known gets the first language with score 0. Of
    equal languages it is the first by name. A text of over 2**19 characters is counted in
    pieces; what their ends share counts in both.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def predict(column: pa.Array) -> pa.Array:
        lang, score = shared.value.predict(column.to_pylist())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang_pred", "score"])

    [p] = fresh(docs, "_p")
    rest = docs.withColumn(p, predict(F.col(text))).drop("lang_pred", "score")
    return rest.select("*", f"{p}.lang_pred", f"{p}.score").drop(p)


def op2(spark, sf_dir: str) -> DataFrame:
    """The language of every document; learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = crc_mod(F.col("doc_id"), 4) == 2
    filters = learn(docs.where(~held))
    out = identify(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")), filters)
    return out.select("doc_id", "held_out", "lang_pred", "score")
