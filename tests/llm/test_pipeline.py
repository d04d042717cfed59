"""The pipeline's stages on small tables."""

from collections import Counter

import corpus_pipeline
from loanbook.llm.common import staged, table

TABLES = "/root/testdata/sf0.01"  # the smallest ones have too few labels to learn from


def test_stages_take_effect_and_keep_the_columns(spark):
    docs = table(spark, TABLES, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, TABLES), f"test-{name}")
        seen[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = seen["toxicity"]
    assert 0 < after.count() < before.count()
    before, after = seen["minhash"]
    assert after.count() < before.count() and after.distinct().count() == after.count()
    before, after = seen["pii"]
    assert after.count() == before.count()
    assert after.filter("text RLIKE '[A-Za-z0-9]@[A-Za-z0-9-]+[.][A-Za-z]'").count() == 0
    before, after = seen["mixing"]
    assert set(Counter(r.doc_id for r in after.select("doc_id").collect()).values()) <= {1, 2}
    encoded = seen["bpe"][1]
    assert {"ids", "decoded"} <= set(encoded.columns) and encoded.count() == seen["mixing"][1].count()
