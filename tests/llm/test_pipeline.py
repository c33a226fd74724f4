"""The stages, each on what its predecessor kept, and the whole."""

import corpus_pipeline
from eodscan.llm import common

from . import brute


def test_stages(spark, odd):
    path, rows, items = odd
    docs = common.table(spark, path, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stored(stage(spark, docs, path), name)
        assert after.columns == columns and after.schema == docs.schema
        kept[name] = [(r.doc_id, r.text, r.source) for r in docs.collect()], [(r.doc_id, r.text, r.source) for r in after.collect()]
        docs = after
    before, after = kept["language_id"]
    gone = {i for i, _, _ in before} - {i for i, _, _ in after}
    assert gone == {i for i, t, _ in before if i is not None and not any(c.isalpha() for c in t or "")}
    before, after = kept["line_dedup"]
    assert sorted(str(i) for i, _, _ in before) == sorted(str(i) for i, _, _ in after)
    before, after = kept["jaccard_join"]
    known = brute.components(sorted({(i, t) for i, t, _ in before if i is not None}))
    assert {i for i, _, _ in after if i is not None} == {c for _, c in known.values()}
    before, after = kept["decontamination"]
    dirty = {i for i, _ in brute.contaminated([(i, t) for i, t, _ in before], items)}
    assert dirty and {i for i, _, _ in after} == {i for i, _, _ in before} - dirty
    packed = corpus_pipeline.run(spark, path)
    assert {r.doc_id for r in packed.collect()} == {i for i, _, _ in after}


def test_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
