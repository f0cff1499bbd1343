"""The corpus pipeline's stages keep what they should."""

import corpus_pipeline
from cellscape.llm import decontaminate, mixing
from cellscape.llm.common import stored, table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, seen = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, DATA, "labels").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, DATA))
        ids = [r[0] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen
        if name == "quality":
            assert all(labels.get(i, 1) == 1 for i in ids) and sum(labels[i] == 1 for i in ids if i in labels) == sum(labels.values())
        if name == "decontamination":
            left = decontaminate.decontaminate(out, table(spark, DATA, "benchmark"))
            assert left.filter("n_hit > 0").count() <= 1
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        docs, seen = out, set(ids)
    assert docs.count() == len(seen) > 100


def test_stages_equal_brute_force(spark):
    """Each stage against a plain version, on what the stage before it kept."""
    import duckdb
    from test_operators import brute_groups, brute_hits

    docs = table(spark, DATA, "documents")
    stages = dict(corpus_pipeline.STAGES)
    kept = stored(stages["quality"](spark, docs, DATA))
    before = {r.doc_id: r.text for r in kept.collect()}
    alone = stored(stages["near_dedup"](spark, kept, DATA))
    groups = brute_groups(before, 5, 80)
    assert {r.doc_id: r.text for r in alone.collect()} == {i: t for i, t in before.items() if groups[i][1] == i}
    clean = stored(stages["decontamination"](spark, alone, DATA))
    items = [(str(r.item_id), decontaminate.words_of((r.text or "").encode())) for r in table(spark, DATA, "benchmark").collect()]
    left = {r.doc_id: r for r in clean.collect()}
    for r in alone.collect():
        n, hit, _ = brute_hits(r.text or "", items)
        assert (r.doc_id in left) == (hit <= 0.5 * n)
        if r.doc_id in left:
            words = decontaminate.words_of((left[r.doc_id].text or "").encode())
            assert len(words) == n - hit and left[r.doc_id].n_chars == len(left[r.doc_id].text)
            assert hit or left[r.doc_id].text == r.text
    safe = stored(stages["secrets"](spark, clean, DATA))
    assert safe.count() == clean.count() and safe.filter("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
    mixed = stages["mixing"](spark, safe, DATA)
    con = duckdb.connect()
    con.register("documents", safe.toArrow())
    found = con.execute(mixing.SQL).fetchall()
    assert sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixed.collect()) == sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in found)


def test_empty(spark):
    docs = table(spark, DATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA))
        assert docs.count() == 0
        docs = docs if "text" in docs.columns else docs
