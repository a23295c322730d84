"""What every operator owes its input: columns of any name, odd rows, no rows."""

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, language, licenses, mixing, near_duplicates, packing, quality_classifier, quality_rules, secrets, toxicity

#: Names that operators could be tempted to use for columns of their own.
NAMES = ["_p", "_s", "_q", "_w", "_g", "_k", "_l", "_t", "_r", "_x", "_row", "_own", "_pool", "_lang", "_text", "_whole", "_cutoff", "_l_domain", "_l_lang", "node", "component", "key", "t", "h", "n", "total"]


def _models(spark, docs):
    labels = spark.createDataFrame([(6, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "same words here")], "item_id long, text string")
    return {
        "mixing": lambda d: mixing.mix_corpus(d),
        "language": lambda d: language.identify(d, language.learn(docs)),
        "toxicity": lambda d: toxicity.detect(d, toxicity.train(docs, labels)),
        "quality_classifier": lambda d: quality_classifier.assess(d, quality_classifier.train(docs, labels)),
        "quality_rules": lambda d: quality_rules.judge(d),
        "licenses": lambda d: licenses.scan(d),
        "secrets": lambda d: secrets.scan(d, [0.0] * (len(secrets.ALPHABET) + 1) ** 2),
        "near_duplicates": lambda d: near_duplicates.deduplicate(d),
        "decontamination": lambda d: decontamination.decontaminate(d, items),
    }


@pytest.mark.parametrize("name", ["mixing", "language", "toxicity", "quality_classifier", "quality_rules", "licenses", "secrets", "near_duplicates", "decontamination"])
def test_columns_of_any_name_come_through(spark, odd, name):
    docs = odd.where("doc_id <> 5 and doc_id <> 9")
    wide = docs.select("*", *[(F.col("doc_id") * 100 + i).alias(c) for i, c in enumerate(NAMES)])
    found = _models(spark, docs)[name](wide)
    assert [c for c in wide.columns if c not in ("text", "n_chars")] == [c for c in found.columns if c in wide.columns and c not in ("text", "n_chars")]
    rows = found.collect()
    assert rows and all(r[c] == r["doc_id"] * 100 + i for r in rows for i, c in enumerate(NAMES))


def test_packing_with_other_columns(odd):
    assert sum(s.doc_id == 6 for r in packing.pack(odd.withColumns({c: F.lit(1) for c in ("h", "shard", "ids", "_t")})).collect() for s in r.segments) == 2
