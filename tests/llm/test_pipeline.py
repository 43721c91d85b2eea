"""The pipeline against brute-force versions of its stages."""

import re

import pandas as pd

import corpus_pipeline
from corpusloom.llm import mixing, quality
from corpusloom.llm.common import read
from tests.llm.test_duplicates import plain_components, plain_sets


def test_stages_equal_brute_force(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    frame = docs.toPandas().set_index("doc_id")
    after = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, after[-1], sf_dir)
        after.append(made)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == docs.columns
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in after]
    judged = quality.report(docs, read(spark, sf_dir, "labels")).filter("predicted = 1")
    assert ids[1] == sorted(r.doc_id for r in judged.collect())
    squeezed = frame.loc[ids[1]].text.map(lambda t: re.sub("[\x20\x09-\x0d]", "", t or ""))
    best = {}
    for i, s in squeezed.items():
        key = (-len(frame.text[i] or ""), i)
        best[s] = min(best.get(s, key), key)
    assert ids[2] == sorted(i for _, i in best.values())
    texts = [frame.text[i] for i in ids[2]]
    assert ids[3] == sorted(set(plain_components(ids[2], list(plain_sets(texts, 5)))))
    taken = {r.doc_id: r for r in mixing.report(after[3]).collect()}
    copies = pd.Series(ids[4]).value_counts().to_dict()
    assert all(copies.get(i, 0) * r.size == r.taken for i, r in taken.items())
    assert ids[5] == ids[4]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECES)
    assert all(list(r.token_ids) == sp.encode(frame.text[r.doc_id]) for r in after[5].collect())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").collect()) == ids[5]


def test_queries_and_sql_agree_on_names():
    from corpusloom.llm import queries

    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(queries.QUERIES) == 13
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "source_mixing", "sentence_pieces"]


def test_stages_take_any_table(spark, sf_dir):
    """Null ids and texts, repeated rows, blank and very long texts, clashing columns; and no rows at all."""
    import random

    from tests.llm.fixtures import awkward, documents

    rng = random.Random(2)
    texts = awkward(rng)
    texts += [texts[6], None, texts[10]]
    ids = [None if i in (3, 9) else i for i in range(len(texts) - 1)] + [10]
    full = documents(spark, texts, ids, sources=[None if i % 5 == 0 else f"src{i % 3}" for i in range(len(texts))])
    for docs in (full, full.filter("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, sf_dir)
            assert made.columns == docs.columns, name
            rows = made.collect()
            assert len(rows) <= 2 * len(texts) and all(r.text is None or r.text in texts for r in rows), name
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
        assert len(out) == docs.count() and all(r.round_trip for r in out if r.token_ids is not None)
    kept = [r.text for r in corpus_pipeline.STAGES[1][1](spark, full, sf_dir).collect()]
    squeezed = [re.sub("[\x20\x09-\x0d]", "", t or "") for t in texts]
    assert sorted(re.sub("[\x20\x09-\x0d]", "", t or "") for t in kept) == sorted(set(squeezed))
