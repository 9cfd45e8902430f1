import numpy as np
from talkweave.llm import quality

TEXTS = ["Quiet words here.\nMore of them.", "\n\nA!! B!!", "", "1 2 3\n||||", "Last, one"]


def test_features_do_not_depend_on_the_texts_beside():
    whole = quality.line_features(TEXTS)
    alone = [quality.line_features([t]) for t in TEXTS]
    assert all(np.array_equal(whole[k], np.concatenate([a[k] for a in alone])) for k in range(3))


def test_driver_gets_features_of_the_sample_and_no_texts(spark, monkeypatch):
    rows = [(i, f"{'Good words, all in order.' if i % 2 else '!!! ### 111'} {i}\nline {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality long")
    monkeypatch.setattr(quality, "fit", None)  # the form that takes texts
    model = quality.train(docs, labels)
    monkeypatch.undo()
    taught = [(t, i % 2) for i, t in rows if i in {r.doc_id for r in docs.where(~quality.held_out("doc_id")).collect()}]
    same = quality.fit([t for t, _ in taught], np.array([y for _, y in taught]))
    assert all(np.array_equal(a, b) for a, b in zip(model.edges, same.edges)) and np.allclose(model.own, same.own) and model.slope == same.slope
