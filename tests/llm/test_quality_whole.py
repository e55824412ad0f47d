"""The quality model is made from all labelled rows, not from the first ones of each label."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripwise.llm import quality
from tripwise.llm.common import doc_bucket

MANY, FEW = 4_300, 60  # more of one label than the 4,000 once read, and so few of the other that draws miss some


def corpus(spark, make_docs, many):
    """Documents, labels, and the learned rows' features and labels in the order of their ids' hash."""
    rng = np.random.default_rng(many)
    made = np.array("river stone market account session handler garden message customer invoice service".split())
    rows = [(i, " ".join(rng.choice(made, 8)) + "!" * int(rng.integers(0, 4) + 3 * (i % 72 == 0))) for i in range((MANY + FEW) * 4 // 3)]
    marks = [(i, 1 - many if i % 72 == 0 else many, 0) for i, _ in rows]
    docs, labels = make_docs(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    order = [r.doc_id for r in labels.filter(doc_bucket(4) != 2).orderBy(F.xxhash64("doc_id")).collect()]
    return docs, labels, quality.features(pa.array([rows[i][1] for i in order])), np.array([marks[i][1] for i in order])


def plain_quantile(scores, y, share, k):
    weight = np.where(y == 1, (1 - share) / (y == 1).sum(), share / (y == 0).sum())
    order = np.lexsort((y, scores))
    return np.interp(share * k, np.cumsum(weight[order]) - weight[order] / 2, scores[order])


@pytest.mark.parametrize("many", [1, 0])
def test_every_labelled_row_is_learned_from(spark, make_docs, many):
    docs, labels, x, y = corpus(spark, make_docs, many)
    assert (y == many).sum() > 4_000 and (y != many).sum() < 80
    learned = doc_bucket(4) != 2
    centre, scale, weights, cut = quality.fit(docs.filter(learned), labels.filter(learned))
    assert np.allclose(centre, x.mean(0), atol=1e-10) and np.allclose(scale, np.maximum(x.std(0), 1e-6), atol=1e-10)
    z = quality.standard(x, np.array(centre), np.array(scale))
    assert np.allclose(weights, quality.fit_weights(z, y), atol=1e-4)
    share = (y == 0).mean()
    assert np.isclose(cut, np.mean([plain_quantile(z @ weights, y, share, k) for k in (0.97, 1.03)]), atol=1e-9)


def test_each_document_is_in_some_pair(spark):
    n = {0: 3, 1: 200}
    x = np.zeros((203, len(quality.FEATURES)))
    x[:3, 0], x[3:, 1] = [1, 2, 3], np.arange(1, 201) / 200
    rows = spark.createDataFrame([(i, int(i >= 3), bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, y int, x binary")
    met = quality.pairs(rows, n[0], n[1], np.zeros(x.shape[1]), np.ones(x.shape[1]), rivals=5)
    d = quality.matrix(pa.array([bytes(r.d) for r in met.collect()]), "f4")
    assert sorted(set((-d[:, 0]).tolist())) == [1, 2, 3] and len(set(d[:, 1].tolist())) == 200
    assert len(d) == 15 + 200 - len(set(np.random.default_rng([7, 0]).integers(0, 200, 15).tolist()))
