"""Where models are fitted, and on which rows."""

import numpy as np

from helixframe.llm import toxicity
from helixframe.llm.training import labelled_sample


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    """The driver holds neither the sample's texts nor the arrays of the fit; the model is that of the sample in its order."""
    rows = [(i, f"{'you vile fool' if i % 3 == 0 else 'a calm day'} number {'abcdefgh'[i % 8]} walks on", int(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame([*rows, rows[7], (None, "none", 1), (900, None, 1)], "doc_id long, text string, toxic int")
    want = toxicity.fit(labelled_sample(docs, docs, "toxic", 40, folds=5))

    def here(*_):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(toxicity, "fit", here)
    got = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), 40)
    assert got.trained and (got.scale, got.shift) == (want.scale, want.shift)
    assert all(np.array_equal(got.p[k], want.p[k]) for k in want.p)
    assert not toxicity.train(docs.limit(0), docs).trained
