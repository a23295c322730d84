"""Quality by co-training of two views.

One classifier sees a document's content (character pairs, and how often a word repeats the
one before), the other only what stands beside the text (source, language, how long it is
and in how many lines). Starting from the labelled documents they are trained in rounds;
each round, each view hands the other the unlabelled documents that it is surest about. On
labelled documents kept back from training each view's score is calibrated (Platt) by
itself; the calibrated views are then combined. The fit is on a bounded
sample in one task; scoring covers all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .charblocks import blocks
from .common import bounded_sample, crc_mod, fit_in_task, fresh, within

PAIRS, NAMES = 1024, 64
N_CONTENT, N_METADATA = PAIRS + 1, 2 * NAMES + 3
#: Calibration (factor and offset of the logit) of each view, and their combination, without labels.
UNTRAINED = (np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.array([0.0, 0.0, 10.0]))


def _bucket(name: str | None) -> int:
    return zlib.crc32((name or "").encode()) % NAMES


def views(texts: list[str | None], sources: list[str | None], langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Both views' features, a row for each document; null and empty texts have no content."""
    n = len(texts)
    pairs, sums = np.zeros((n, PAIRS), np.float32), np.zeros((n, 4))
    for b in blocks(texts):
        owner = np.repeat(b.rows, np.diff(np.append(b.starts, len(b.cp))))
        code = ((b.raw[:-1].astype(np.uint64) * np.uint64(0x9E3779B1) + b.raw[1:].astype(np.uint64) * np.uint64(0x85EBCA77)) >> np.uint64(12)) % np.uint64(PAIRS)
        rows, where = np.unique(b.rows, return_inverse=True)
        local = np.repeat(where, np.diff(np.append(b.starts, len(b.cp))))
        pairs[rows] += np.bincount(local[:-1] * PAIRS + code.astype(np.int64), minlength=len(rows) * PAIRS).reshape(len(rows), PAIRS)
        space = (b.raw == 32) | ((b.raw >= 9) & (b.raw <= 13))
        step = np.diff((~space).astype(np.int8), prepend=0, append=0)
        start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        words = b.hash_between(b.prefix_hash(), start, stop)
        again = np.flatnonzero(words[1:] == words[:-1]) + 1
        again = again[owner[start[again]] == owner[start[again - 1]]]
        for k, values in enumerate((np.ones(len(b.cp)), b.raw == 10)):
            np.add.at(sums[:, k], b.rows, b.sums(values.astype(np.float64)))
        np.add.at(sums[:, 2], owner[start], 1)
        np.add.at(sums[:, 3], owner[start[again]], 1)
    size, lines, count, repeats = sums.T
    whole, some = np.maximum(size, 1), np.maximum(count, 1)
    content = np.concatenate([np.sqrt(pairs / whole[:, None]), np.sqrt(repeats / some)[:, None]], 1)
    meta = np.zeros((n, N_METADATA))
    at = np.arange(n)
    meta[at, [_bucket(x) for x in sources]] = 1
    meta[at, [NAMES + _bucket(x) for x in langs]] = 1
    meta[:, 2 * NAMES :] = np.stack([np.log1p(size) / 5, np.log1p(lines), np.log1p(size / np.maximum(lines, 1)) / 5], 1)
    return content.astype(np.float32), meta.astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _regress(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150, decay: float = 1e-4, rate: float = 0.1) -> np.ndarray:
    """Logistic regression by full-batch Adam; the last weight is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        g = x.T @ ((_sigmoid(x @ w) - y) * weight).astype(x.dtype) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def _balance(y: np.ndarray) -> np.ndarray:
    """Weights by which both labels count the same."""
    return np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))


def cotrain(content: np.ndarray, meta: np.ndarray, label: np.ndarray, rounds: int, surest: float, sure: float) -> tuple[np.ndarray, ...]:
    """Weights of the content view and of the metadata view, their calibrations, and their combination; ``label`` is -1 where there is none.

    Every fifth labelled document of each label is kept back for calibration; if that leaves
    a label out, all labelled ones serve for it.
    """
    known = np.flatnonzero(label >= 0)
    back = np.concatenate([np.flatnonzero(label == y)[4::5] for y in (0, 1)])
    train = np.setdiff1d(known, back)
    pool = np.flatnonzero(label < 0)
    given = [dict(zip(train.tolist(), label[train].tolist(), strict=True)) for _ in range(2)]
    both = (content, meta)
    w = [np.zeros(N_CONTENT + 1), np.zeros(N_METADATA + 1)]
    for r in range(rounds + 1):
        for k in range(2):
            rows = np.array(sorted(given[k]))
            y = np.array([given[k][i] for i in rows], np.float64)
            w[k] = _regress(both[k][rows], y, _balance(y))
        if r == rounds:
            break
        for k in range(2):
            rest = np.array([i for i in pool if i not in given[1 - k]], np.int64)
            if not len(rest):
                continue
            p = _sigmoid(both[k][rest] @ w[k][:-1] + w[k][-1])
            take = max(1, int(surest * len(pool)))
            for value, chance in ((1, p), (0, 1 - p)):
                # by confidence, then by place: the same on every run
                for i in np.lexsort((rest, -chance))[:take]:
                    if chance[i] >= sure:
                        given[1 - k][int(rest[i])] = value
    if len(set(label[back].tolist())) < 2:
        back = known
    y = label[back].astype(np.float64)
    # calibrated to the labels as they are, not balanced
    scales, logits = [], []
    for k in range(2):
        z = both[k][back] @ w[k][:-1] + w[k][-1]
        scale = _regress(z[:, None] / 4, y, np.ones(len(y)), steps=400, decay=1e-3) / [4, 1]
        scales.append(scale)
        logits.append(z * scale[0] + scale[1])
    return w[0], w[1], scales[0], scales[1], _regress(np.stack(logits, 1) / 4, y, np.ones(len(y)), steps=400, decay=1e-3)


_PARTS = ["content", "metadata", "scale_content", "scale_metadata", "both"]


def _fit(rounds: int, surest: float, sure: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, labels = [], []
        for b in batches:
            parts.append(views(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
            labels += b.column(3).to_pylist()
        label = np.array(labels, np.int64)
        if len(set(label[label >= 0].tolist())) == 2 and (label >= 0).sum() >= 10:
            w = cotrain(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), label, rounds, surest, sure)
        else:
            w = (np.zeros(N_CONTENT + 1), np.zeros(N_METADATA + 1), *UNTRAINED)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64).tobytes()]) for x in w], _PARTS)

    return run


class Model:
    def __init__(self, content: np.ndarray, metadata: np.ndarray, scale_content: np.ndarray, scale_metadata: np.ndarray, both: np.ndarray):
        self.content, self.metadata, self.scales, self.both = content, metadata, (scale_content, scale_metadata), both

    def score(self, texts: list, sources: list, langs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        content, meta = views(texts, sources, langs)
        a, b = content @ self.content[:-1] + self.content[-1], meta @ self.metadata[:-1] + self.metadata[-1]
        a, b = (z * s[0] + s[1] for z, s in zip((a, b), self.scales, strict=True))
        return _sigmoid((a * self.both[0] + b * self.both[1]) / 4 + self.both[2]), _sigmoid(a), _sigmoid(b)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 4000, max_unlabelled: int = 6000, rounds: int = 4, surest: float = 0.03, sure: float = 0.9, longest: int = 200_000, most: int = 60_000_000) -> Model:
    """A model from ``docs`` (doc_id, text, source, lang) and ``labels`` (doc_id, quality).

    The sample has at most ``max_labelled`` documents with a label and ``max_unlabelled``
    without, the first of each by a hash of their id, no text longer than ``longest`` and at
    most ``most`` characters in all. Each of ``rounds`` rounds a view hands
    over at most the share ``surest`` of the unlabelled ones for each label, with a
    probability of at least ``sure``. With fewer than ten labels, or only one kind, the
    model takes every document for good.
    """
    y = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    picked = F.broadcast(bounded_sample(y, max_labelled, F.col("doc_id")))
    columns = ["text", "source", "lang"]
    rows = docs.select("doc_id", *columns).where("text is not null and doc_id is not null")
    known = bounded_sample(rows.join(picked, "doc_id").select(*columns, "y", "doc_id"), max_labelled, F.col("doc_id"), F.col("text"), F.col("y"))
    other = bounded_sample(rows, max_unlabelled + max_labelled, F.col("doc_id")).join(picked, "doc_id", "left_anti").limit(max_unlabelled)
    sample = known.select(*columns, "y").union(other.select(*columns, F.lit(-1).alias("y")))
    sample = within(sample, "text", longest, most, F.col("text"), F.col("y"))
    row = fit_in_task(sample.coalesce(1).sortWithinPartitions("y", "text", "source", "lang"), _fit(rounds, surest, sure), ", ".join(f"{x} binary" for x in _PARTS)).first()
    if row is None:  # an empty sample
        return Model(np.zeros(N_CONTENT + 1), np.zeros(N_METADATA + 1), *UNTRAINED)
    return Model(*(np.frombuffer(row[c], np.float64) for c in _PARTS))


def assess(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text, source, lang) with ``score`` (probability of good quality), ``p_content``, ``p_metadata`` and ``kept`` (score >= 0.5); columns of these names are replaced.

    A null text counts as empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score double, p_content double, p_metadata double>")
    def run(text: pa.Array, source: pa.Array, lang: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in shared.value.score(text.to_pylist(), source.to_pylist(), lang.to_pylist())], ["score", "p_content", "p_metadata"])

    [q] = fresh(docs, "_q")
    rest = docs.withColumn(q, run("text", "source", "lang")).drop("score", "p_content", "p_metadata", "kept")
    return rest.select("*", f"{q}.*").drop(q).withColumn("kept", F.col("score") >= 0.5)


def op4(spark, sf_dir: str) -> DataFrame:
    """Quality of every document; learned from labels of those whose crc32(doc_id) mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = train(docs, labels.where(~held))
    out = assess(docs.withColumn("held_out", F.coalesce(held, F.lit(False))), model)
    return out.select("doc_id", "held_out", "score", "kept", "p_content", "p_metadata")
