"""Operators over nulls, repeats, very long texts and columns whose names clash give what they give without those columns."""

import pytest
from helpers import DATA
from pyspark.sql import functions as F

from spandrel.llm import packing, quality_classifier, quality_rules, simhash

TEXTS = [None, "", " \n\t", "a", "the quick brown fox " * 30, "the quick brown fox " * 30, "Der Hund und die Katze. " * 20_000, "x" * 300_000, "#$% &|<> " * 60]
ROWS = [(i, t, "en", "s" if i % 2 else None, len(t or "")) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], None, None, None), (4, TEXTS[4], "en", "s", 5), (None, None, None, None, None)]
CLASHING = ["words", "n", "key", "node", "f0", "f1", "rows", "component_id", "weight", "log_weight", "kept", "pattern", "votes", "posterior", "size", "bin", "start", "piece", "cluster", "group", "u", "v", "label", "quality", "toxic", "draw", "value", "col1", "count"]
PLAIN = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("name", ["rules", "packing", "simhash", "classifier"])
def test_clashing_columns_change_nothing(spark, name):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (8, 0, 0), (8, 1, 1), (99, 1, 0), (None, 1, 0), (6, None, None)], LABELS)
    run = {"rules": quality_rules.judge, "packing": packing.pack_documents, "simhash": simhash.near_duplicates, "classifier": lambda d: quality_classifier.classify(d, labels)}[name]
    docs = spark.createDataFrame(ROWS, PLAIN)
    wide = docs.withColumns({c: F.lit("clash") for c in CLASHING})
    plain, other = (sorted(map(str, (r.asDict() for r in run(d).collect()))) for d in (docs, wide))
    assert plain == other and len(plain) >= len(ROWS)
    assert run(wide.limit(0)).count() == 0


def test_pipeline_keeps_its_columns_on_the_same_rows(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(ROWS, PLAIN)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{DATA}/sf0.001")
        assert out.columns == docs.columns and out.count() <= len(ROWS)
