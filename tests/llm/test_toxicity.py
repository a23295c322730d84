import math
import re

import numpy as np

from palimpsest.llm import toxicity

BAD = ["vexwort", "grubling", "snarkel"]


def corpus(prose, n=240):
    rows, labels = [], []
    for i in range(n):
        text, bad = prose(i, 40 + i % 200), i % 3 == 0
        if bad:
            at = text.index(" ", len(text) // 2)
            text = text[:at] + " " + BAD[i % 9 // 3] + text[at:]
        rows.append((i, text))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_and_located(spark, docs_of, prose):
    rows, labels = corpus(prose)
    train = spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int")
    model = toxicity.train(docs_of(rows), train)
    found = {r.doc_id: r for r in toxicity.detect(docs_of(rows), model).collect()}
    held = [(found[i], bad) for i, bad in labels if i % 5 == 0]
    assert sum(r.predicted == bad for r, bad in held) >= 0.95 * len(held)
    for r, bad in held:
        if bad and r.offending:
            assert any(w in r.text[s.start : s.end] for s in r.offending for w in BAD)


def test_noisy_or_of_sentences():
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), -1.0)
    p = 1 / (1 + math.e)
    score, _ = model.score(["One two. Three!\nfour. ?!", "one", None, "", "..."])
    assert np.allclose(score, [1 - (1 - p) ** 3, p, 0, 0, 0])


def test_scores_against_brute_force():
    """Sentence by sentence and word by word: the sum of the weights of a word and its prefixes, noisy-or over sentences."""
    rng = np.random.default_rng(1)
    weights = rng.random(1 << toxicity.BITS).astype(np.float32)
    model = toxicity.Model(weights, -9.0)
    texts = ["One two two vexwort. A snarkel, grubling!\nagain again é", "abc", "", None, "x. y. z."]
    score, _ = model.score(texts)
    for text, got in zip(texts, score, strict=True):
        quiet = 1.0
        for sentence in re.split(r"[.!?\n]", (text or "").lower()):
            w = re.findall(r"[^\W\d_]+", sentence)
            w = [x for i, x in enumerate(w) if not i or w[i - 1] != x]
            z = -9.0
            for x in w:
                found = toxicity.words(next(toxicity.blocks([x])))[1]
                z += sum(float(weights[f[0]]) for f in found)
            quiet *= 1 - 1 / (1 + math.exp(-z)) if w else 1
        assert abs(got - (1 - quiet)) < 1e-6


def test_a_long_text_is_scored_whole(spark):
    weights = np.zeros(1 << toxicity.BITS, np.float32)
    model = toxicity.Model(weights, -20.0)
    at, feats = toxicity.words(next(toxicity.blocks(["vexwort"])))
    weights[feats[0]] = 40.0
    text = "calm words. " * 100_000 + "a vexwort \U0001f600 here. " + "calm words. " * 10
    score, spans = model.score([text])
    assert score[0] > 0.99 and [text[s["start"] : s["end"]] for s in spans[0]] == ["a vexwort \U0001f600 here."]


def test_odd_rows_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = toxicity.detect(odd.withColumnRenamed("source", "offending"), toxicity.train(odd, none)).collect()
    assert len(found) == 10 and all(r.predicted == 0 and 0 <= r.score <= 1 for r in found)


def test_labels_with_nulls_and_repeats(spark, docs_of, prose):
    rows, labels = corpus(prose, 60)
    extra = [(None, 1), (3, None), (5, 7), *labels[:5]]
    model = toxicity.train(docs_of(rows), spark.createDataFrame(labels + extra, "doc_id long, toxic int"))
    assert toxicity.detect(docs_of([]), model).count() == 0
