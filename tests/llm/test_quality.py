import re
from collections import defaultdict

import numpy as np

from palimpsest.llm import quality_classifier, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w, places, lines = WORD.findall(text), defaultdict(list), [x for x in text.split("\n") if WORD.search(x)]
    for k in range(len(w) - 4):
        places[tuple(w[k : k + 5])].append(k)
    covered = {j for v in places.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_statistics_against_brute_force(docs_of, odd, prose):
    texts = [prose(i, 80) for i in range(20)] + ["a b c d e " * 4, "a a a a a a", "x\ny\nx\n \n \nx", "a b c d e f a b c d e g # * | é<", "\x0b\x0c a b \x1f c"]
    rows = docs_of(list(enumerate(texts)))
    for r in [*quality_rules.statistics(rows).collect(), *quality_rules.statistics(odd).collect()]:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text), r.doc_id


def mcd(x, floors, rounded=True, share=quality_rules.SHARE):
    """Distances by concentration steps over one group held in memory: the best of three starts, each until its determinant stays."""
    bins = (lambda v: np.floor(np.abs(v) * quality_rules.BIN + 0.5) * np.sign(v) / quality_rules.BIN) if rounded else (lambda v: v)
    m = np.median(bins(x), 0)
    starts = [(m, np.diag((1.4826 * np.median(bins(np.abs(x - m)), 0)) ** 2 + floors**2)), (m, np.diag(floors**2)), (x.mean(0), np.cov(x.T, bias=True) + np.diag(floors**2))]
    for _ in range(quality_rules.STEPS):
        after = []
        for m, cov in starts:
            d = bins(np.log(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m) + 1e-6))
            near = x[d <= np.quantile(d, share)]
            m = near.mean(0)
            after.append((m, quality_rules.CONSISTENCY * (near.T @ near / len(near) - np.outer(m, m)) + np.diag(floors**2)))
        done = _ and all(np.linalg.slogdet(a[1])[1] >= np.linalg.slogdet(b[1])[1] - quality_rules.SETTLED for a, b in zip(after, starts, strict=True))
        starts = after
        if done:
            break
    m, cov = min(starts, key=lambda s: round(np.linalg.slogdet(s[1])[1], 9))
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)


def test_distances_against_brute_force(docs_of, prose):
    rows = [(i, prose(i, 60 + i % 150)) for i in range(300)] + [(1000 + i, " | ".join(prose(i, 40).split())) for i in range(5)]
    found = {r.doc_id: r for r in quality_rules.judge(docs_of(rows)).collect()}
    assert len(found) == len(rows)
    good = sorted(i for i, r in found.items() if not r.base_failed)
    s = np.array([[found[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] for i in good], float)
    x = np.stack([np.log1p(s[:, 0]), np.log(s[:, 1] / s[:, 0]), np.log1p(1000 * s[:, 2] / s[:, 1]), np.log1p(s[:, 3]), np.sqrt(s[:, 4] / s[:, 0])], 1)
    floors = np.array(list(quality_rules.FLOORS.values()))
    assert np.allclose([found[i].distance for i in good], mcd(x, floors), rtol=1e-6)
    # without rounding the distances differ by a few per cent
    assert np.allclose([found[i].distance for i in good], mcd(x, floors, False), rtol=0.1, atol=0.05)
    assert all(not found[1000 + i].kept for i in range(5)) and sum(found[i].kept for i in range(300)) >= 297


def test_odd_rows_and_small_groups(docs_of, odd):
    found = quality_rules.judge(odd.withColumnRenamed("n_chars", "kept")).collect()
    assert len(found) == 10 and all(r.kept is False for r in found if r.base_failed)
    assert quality_rules.judge(docs_of([])).count() == 0
    lone = quality_rules.judge(docs_of([(1, "one two three four five six seven eight nine ten eleven", None, None)])).collect()
    assert [r.kept for r in lone] == [True]


def test_groups_with_few_rows_are_pooled(docs_of, prose):
    rows = [(i, prose(i, 50), "en", f"src{i % 2}" if i < 220 else f"tiny{i}") for i in range(240)]
    keys = {r.source: r._g for r in quality_rules.scatter_groups(docs_of(rows), "lang", "source").collect()}
    assert keys["src0"] != keys["src1"] and {v for k, v in keys.items() if k.startswith("tiny")} == {"*"}


def test_small_groups_are_judged_at_every_size(docs_of, prose):
    """A lone source's odd document is rejected by what all rows say, however few such sources have."""
    for n in (50, 300):
        rows = [(i, prose(i, 60 + i % 90), "en", f"src{i % 2}") for i in range(n)] + [(1000, " | ".join(prose(7, 40).split()), "de", "lone"), (1001, prose(1001, 90), "fr", "other")]
        found = {r.doc_id: r.kept for r in quality_rules.judge(docs_of(rows)).collect()}
        assert not found[1000] and found[1001] and sum(found[i] for i in range(n)) >= 0.95 * n


def junk(text, i):
    return text.upper().replace(" ", "!! ") if i % 2 else " ".join(w for w in text.split() for _ in range(5))


def test_cotraining_held_out(spark, docs_of, prose):
    rows = [(i, junk(prose(i, 60), i // 4) if i % 4 == 0 else prose(i, 60), "en", f"s{i % 7}") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400) if i % 3 == 0], "doc_id long, quality int")
    model = quality_classifier.train(docs_of(rows), labels)
    found = quality_classifier.assess(docs_of(rows), model).collect()
    held = [r for r in found if r.doc_id % 3]
    assert sum(r.kept == (r.doc_id % 4 != 0) for r in held) >= 0.95 * len(held)


def test_views_against_brute_force():
    texts = ["one two two  three\nthree four", "", None, "AB ab", "x" * 50]
    content, meta = quality_classifier.views(texts, ["s"] * 5, ["en"] * 5)
    for i, text in enumerate(texts):
        t = text or ""
        pairs = np.zeros(quality_classifier.PAIRS)
        for a, b in zip(t + "\n", (t + "\n")[1:]):
            pairs[((ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA77) >> 12) % quality_classifier.PAIRS] += 1
        w = t.lower().split()
        again = sum(a == b for a, b in zip(w, w[1:]))
        if text is not None:
            rest = np.abs(content[i, :-1] ** 2 * max(len(t) + 1, 1) - pairs)
            assert rest.sum() <= 1.01  # the pair over the border to the next text may count
        assert np.isclose(content[i, -1], np.sqrt(again / max(len(w), 1)))
        size = 0 if text is None else len(t) + 1
        lines = 0 if text is None else t.count("\n") + 1
        assert np.allclose(meta[i, -3:], [np.log1p(size) / 5, np.log1p(lines), np.log1p(size / max(lines, 1)) / 5], atol=1e-5)


def test_few_of_a_label_are_trained_on_and_views_are_calibrated():
    rng = np.random.default_rng(3)
    y = np.array([0] * 10 + [1])
    content, meta = rng.normal(size=(11, quality_classifier.N_CONTENT)).astype(np.float32), rng.normal(size=(11, quality_classifier.N_METADATA)).astype(np.float32)
    content[:, 0] += 8 * y
    w = quality_classifier.cotrain(content, meta, y, 1, 0.03, 0.9)
    assert content[10] @ w[0][:-1] + w[0][-1] > 0
    y = (rng.random(4000) < 0.2).astype(int)
    content, meta = np.zeros((4000, quality_classifier.N_CONTENT), np.float32), np.zeros((4000, quality_classifier.N_METADATA), np.float32)
    content[:, 0], meta[:, 0] = y + rng.normal(size=4000), 0.5 * y + rng.normal(size=4000)
    w = quality_classifier.cotrain(content, meta, y, 1, 0.03, 0.9)
    for x, weights, scale in ((content, w[0], w[2]), (meta, w[1], w[3])):
        p = quality_classifier._sigmoid((x @ weights[:-1] + weights[-1]) * scale[0] + scale[1])
        for lo, hi in ((0, 0.2), (0.2, 0.5)):
            part = (p >= lo) & (p < hi)
            assert part.sum() < 100 or abs(p[part].mean() - y[part].mean()) < 0.06


def test_classifier_on_odd_rows(spark, docs_of, odd):
    none = spark.createDataFrame([(None, 1), (2, None)], "doc_id long, quality int")
    model = quality_classifier.train(odd, none)
    found = quality_classifier.assess(odd.withColumnRenamed("n_chars", "score"), model).collect()
    assert len(found) == 10 and all(r.kept and 0 <= r.score <= 1 for r in found)
    assert quality_classifier.assess(docs_of([]), quality_classifier.train(docs_of([]), none)).count() == 0
