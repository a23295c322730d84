"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A linear model over hashed word features scores each
sentence, and noisy-or combines them: the document is toxic unless every sentence is not,
``P(doc) = 1 - prod(1 - P(sentence))``. Only document labels are needed to train it, and
afterwards the sentence scores say where the offence stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charblocks import Block, blocks
from .common import bounded_sample, crc_mod, fit_in_task, fresh, within

BITS = 18
#: A word is hashed whole and by its first four and five letters.
PREFIXES = (4, 5)
#: The bias of a model without labels: no number of sentences makes a text toxic.
UNTRAINED = -30.0
_ENDS = np.array([ord(c) for c in ".!?\n。！？"], np.uint32)


def sentences(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each sentence that has a word, and the piece it belongs to."""
    ends = np.flatnonzero(np.isin(block.cp, _ENDS)) + 1
    starts = np.concatenate([[0], ends[:-1]])
    words = np.zeros(len(block.cp) + 1, np.int64)
    np.cumsum(block.letter, out=words[1:])
    full = words[ends] > words[starts]
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(block.starts, starts, "right") - 1


def words(block: Block) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each word (run of letters; a repeat right after it counts once) starts, and its features below ``2**BITS``."""
    step = np.diff(block.letter.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    h = block.prefix_hash()
    shift = np.uint64(64 - BITS)
    whole = block.hash_between(h, starts, ends)
    new = np.append(True, whole[1:] != whole[:-1])[: len(whole)]
    starts, ends = starts[new], ends[new]
    found = [whole[new] >> shift]
    for k in PREFIXES:
        # a word shorter than the prefix is its own prefix
        found.append((block.hash_between(h, starts, np.minimum(starts + k, ends)) + np.uint64(k << 40)) * np.uint64(0x9E3779B97F4A7C15) >> shift)
    return starts, [x.astype(np.int32) for x in found]


def _fit(batches: Iterator[pa.RecordBatch], epochs: int, rate: float, decay: float, least: int) -> Iterator[pa.RecordBatch]:
    """Full-batch Adam on the noisy-or likelihood over the rows (text, label).

    Weights are never negative, so that ordinary words cannot hide an offence in a long
    sentence; ``decay`` (an L1 penalty) brings those without evidence to 0.
    """
    feats: list[np.ndarray] = []
    sent_of: list[np.ndarray] = []
    doc_of: list[np.ndarray] = []
    labels: list[int] = []
    n_sent, spread = 0, np.zeros(1 << BITS, np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for block in blocks(texts):
            s, e, piece = sentences(block)
            at, found = words(block)
            own = np.searchsorted(s, at, "right") - 1
            feats.append(np.stack(found, 1))
            # in how many documents each feature occurs: once for each piece here
            for f in found:
                spread += np.bincount(np.unique(f.astype(np.int64) * len(block.rows) + piece[own]) // len(block.rows), minlength=1 << BITS)
            sent_of.append(own + n_sent)
            doc_of.append(block.rows[piece] + len(labels))
            n_sent += len(s)
        labels += batch.column(1).to_pylist()
    weights, bias = np.zeros(1 << BITS, np.float32), UNTRAINED
    y = np.array(labels, np.float64)
    if n_sent and 0 < y.sum() < len(y):
        common = spread >= least  # the other features keep weight 0
        code = np.where(common, np.cumsum(common), 0).astype(np.int32)
        size = int(common.sum()) + 1
        kept = [(code[f] > 0).any(1) for f in feats]
        sent, doc = np.concatenate([x[k] for x, k in zip(sent_of, kept, strict=True)]), np.concatenate(doc_of)
        columns = [np.concatenate([code[f[k, c]] for f, k in zip(feats, kept, strict=True)]) for c in range(1 + len(PREFIXES))]
        del feats, sent_of, kept
        bias = -10.0
        w, m, v, mb, vb = np.zeros(size), np.zeros(size), np.zeros(size), 0.0, 0.0
        for t in range(1, epochs + 1):
            z = np.clip(bias + np.bincount(sent, weights=sum(w[c] for c in columns), minlength=n_sent), -30, 30)
            p = 1 / (1 + np.exp(-z))
            quiet = np.bincount(doc, weights=np.log1p(np.exp(z)), minlength=len(y))  # -log P(no toxic sentence)
            # d(-log likelihood)/dz of a sentence: p if the label is 0, -p * (1 - P) / P if it is 1
            slope = np.where(y > 0, -1 / np.expm1(np.clip(quiet, 1e-9, 700)), 1.0)
            g = p * slope[doc]
            each = g[sent]
            gw = sum(np.bincount(c, weights=each, minlength=size) for c in columns) / len(y) + decay
            gb = g.sum() / len(y)
            gw[0] = 0
            m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            np.maximum(w, 0, out=w)
            w[0] = 0
            bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
        weights = np.where(common, w[code], 0).astype(np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([float(bias)])], ["weights", "bias"])


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, texts: list[str | None], spans: bool = True) -> tuple[np.ndarray, list[list[dict]]]:
        """P(toxic) of each text and its sentences with P >= 0.5 as code-point spans."""
        quiet = np.zeros(len(texts))
        found: list[list[dict]] = [[] for _ in texts]
        for block in blocks(texts):
            s, e, piece = sentences(block)
            if not len(s):
                continue
            at, feats = words(block)
            total = self.weights[feats[0]].astype(np.float64)
            for f in feats[1:]:
                total += self.weights[f]
            z = self.bias + np.bincount(np.searchsorted(s, at, "right") - 1, weights=total, minlength=len(s))
            z = np.clip(z, -30, 30)
            np.add.at(quiet, block.rows[piece], np.log1p(np.exp(z)))
            if spans:
                for i in np.flatnonzero(z >= 0):
                    k = piece[i]
                    base = int(block.offsets[k] - block.starts[k])
                    start = int(s[i])
                    while block.raw[start] in (9, 10, 13, 32):
                        start += 1
                    found[block.rows[k]].append({"start": start + base, "end": int(e[i]) - (block.raw[e[i] - 1] == 10) + base, "p": float(1 / (1 + np.exp(-z[i])))})
        return -np.expm1(-quiet), found


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, epochs: int = 120, rate: float = 0.2, decay: float = 3e-4, least: int = 3, longest: int = 200_000, most: int = 50_000_000) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); rows with nulls are left out.

    At most ``max_docs`` documents of each label are read, the first by a hash of their id,
    no text longer than ``longest`` and at most ``most`` characters in all. Each row of a
    repeated doc_id counts, with each of its labels. Features of fewer than ``least`` of them are not used. Without both labels the model
    finds nothing toxic.
    """
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    picked = [bounded_sample(rows.where(F.col("y") == y), max_docs, F.col("doc_id")) for y in (0, 1)]
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked[0].union(picked[1])), "doc_id")
    sample = bounded_sample(sample.select("text", "y", "doc_id"), 2 * max_docs, F.col("doc_id"), F.col("text"), F.col("y"))
    fit = lambda batches: _fit(batches, epochs, rate, decay, least)
    sample = within(sample, "text", longest, most, F.col("doc_id"), F.col("text"), F.col("y"))
    row = fit_in_task(sample.select("text", "y"), fit, "weights binary, bias double").first()  # one row of 2**BITS weights
    if row is None:  # an empty sample
        return Model(np.zeros(1 << BITS, np.float32), UNTRAINED)
    return Model(np.frombuffer(row["weights"], np.float32), row["bias"])


def detect(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``predicted`` (1 if score >= 0.5) and ``offending`` (columns of these names are replaced).

    ``offending`` lists the sentences with a score of at least 0.5 by their code points
    (end exclusive). A null or empty text scores 0; a sentence of over 2**19 characters is
    scored in parts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score double, offending array<struct<start int, end int, p double>>>")
    def score(column: pa.Array) -> pa.Array:
        p, found = shared.value.score(column.to_pylist())
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(p, pa.float64()), pa.array(found, kind)], ["score", "offending"])

    [s] = fresh(docs, "_s")
    rest = docs.withColumn(s, score(F.col(text))).drop("score", "predicted", "offending")
    return rest.select("*", f"{s}.score", (F.col(f"{s}.score") >= 0.5).cast("int").alias("predicted"), f"{s}.offending").drop(s)


def op3(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from labels of those whose crc32(doc_id) mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = train(docs, labels.where(~held))
    out = detect(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", "predicted", "offending")
