import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "src1")), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


#: What every operator must take: null and empty texts, no letters, one character, very long, null columns, repeated rows.
ODD = [(1, None, None, None), (2, "", "en", "s"), (3, "!?! 12", None, "s"), (4, "x", "en", None), (5, "ab cd. " * 30_000, "en", "s"), (6, "same words here", "en", "s"), (6, "same words here", "en", "s"), (None, "no id at all", "en", "s"), (8, "é\U0001f600 ퟿\n\n", "fr", "s"), (9, "w" * 700_000, "en", "s")]


@pytest.fixture
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture
def prose():
    """Seeded prose: prose(seed, words, letters)."""

    def make(seed, n, letters="abcdefghij", size=400):
        rng = random.Random(seed)
        own = random.Random(letters)
        words = ["".join(own.choice(letters) for _ in range(own.randint(2, 8))) for _ in range(size)]
        out = []
        while n > 0:
            k = min(n, rng.randint(5, 14))
            out.append(" ".join(rng.choice(words) for _ in range(k)).capitalize() + ".")
            n -= k
        return " ".join(out)

    return make
