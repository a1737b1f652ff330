import os
import random
import zlib

import pyarrow as pa
import pytest

from pointloom.llm import toxicity as X
from pointloom.llm.queries import op2_toxicity

SF = "/root/testdata/sf0.1"


def held(d):
    return zlib.crc32(str(d).encode()) % 3 == 1


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op2_toxicity(spark, SF).collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert len(got) == 10_000 and all(r.held_out == held(d) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in got.items())
    own = [(got[d], y) for d, y in labels if held(d)]
    toxic = [r for r, y in own if y]
    clean = [r for r, y in own if not y]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    from statistics import fmean

    auc = fmean((a.score > b.score) + 0.5 * (a.score == b.score) for a in toxic for b in clean)
    assert auc > 0.93


def test_edge_cases(spark):
    r = random.Random(0)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(40))
    rows = [(n, " ".join([word() for _ in range(30)] + ["zogk%d" % r.randrange(9)] * 3 * (n % 4 == 0))) for n in range(400)]
    labels = spark.createDataFrame([(n, int(n % 4 == 0)) for n, _ in rows] + [(5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(n, t, "x") for n, t in rows] + [(None, None, None), (7, "", ""), (8, " \n", "y"), (9, "w1 " * 40_000 + "zogk1 zogk2 ZOGK3!", "z"), (9, "zogk1", "z")], "doc_id long, text string, toxicity string")
    from pyspark.sql import functions as F

    model = X.fit(docs, labels, F.col("doc_id") % 3 == 1)
    assert model == X.fit(docs.repartition(3), labels, F.col("doc_id") % 3 == 1)
    out = X.score(docs, model)
    assert out.columns == ["doc_id", "text", "toxicity"] and dict(out.dtypes)["toxicity"] == "double"
    got = out.collect()
    assert len(got) == 405
    by = {x.text: x.toxicity for x in got}
    right = sum((by[t] >= 0.7) == (n % 4 == 0) for n, t in rows if n % 3 == 1)
    assert right >= 125 and by[None] == by[""] == by[" \n"] < 0.7
    assert next(x.toxicity for x in got if x.text and len(x.text) > 100_000) >= 0.7  # whole texts, not their beginnings
    nothing = X.fit(docs, labels.limit(0), F.lit(False))
    assert max(x.toxicity for x in X.score(docs, nothing).collect()) < 0.75 and X.score(docs.limit(0), nothing).count() == 0


def test_steps_change_nothing():
    model = X.train(pa.array(["a b c zog zog zog", "a b d e", "b c"] * 20), __import__("numpy").array([1, 0, 0] * 20))
    texts = pa.array(["", "a", "a b", "a b c zog x y z zog a zog b", "q " * 500 + "zog", None])
    ids, begin = X._features(texts)
    assert abs(model.pooled(ids, begin) - model.pooled(ids, begin, step=7)).max() < 1e-5


def test_parts_change_nothing(monkeypatch):
    texts = pa.array(["a b c", None, "", "d " * 50, "e f"] * 5)
    whole = X._features(texts)
    monkeypatch.setattr(X, "by_bytes", lambda batches, column: (b.slice(k, 3) for b in batches for k in range(0, len(b), 3)))
    parts = X._all_features(texts)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def plain_logit(model, ids):
    """One text's forward pass by the definition: every filter at every position, the largest and the third largest response."""
    import numpy as np

    vectors = [sum(model.emb[k] for k in row) for row in ids]
    features = []
    for nth in (0, 2):
        for i, width in enumerate(X.WIDTHS):
            for f in range(X.FILTERS):
                at = []
                for p in range(len(ids) - max(X.WIDTHS) + 1):
                    z = model.bias[i, f]
                    for o in range(width):
                        z += vectors[p + o] @ model.w[:, X._SHIFTS.index((width, o)), f]
                    at.append(max(0.0, z))
                features.append(sorted([*at, 0, 0, 0], reverse=True)[nth])
    return float(np.dot(features, model.out) + model.base[0])


def test_logits_equal_plain_forward_pass():
    import numpy as np

    model = X.train(pa.array(["a b c zog zog zog", "a b d e", "b c"] * 20), np.array([1, 0, 0] * 20))
    texts = pa.array(["zog a b", "", "a", "a zog zog c d zog e f", "b"])
    ids, begin = X._features(texts)
    want = [plain_logit(model, ids[s:e]) for s, e in zip(begin, begin[1:])]
    assert np.allclose(model.logits(ids, begin), want, atol=1e-4)


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(n, "word " * 200) for n in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(50)], "doc_id long, toxic int")
    assert X.sample(docs, labels, F.lit(False)).count() == 50
    monkeypatch.setattr(X, "TRAIN_BYTES", 10_500)
    rows = X.sample(docs, labels, F.lit(False)).collect()
    assert len(rows) == 10 and {r.toxic for r in rows} == {0, 1}


def test_a_long_text_leaves_the_others(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(X, "TRAIN_TEXT_BYTES", 3000)
    monkeypatch.setattr(X, "TRAIN_BYTES", 50_000)
    docs = spark.createDataFrame([(n, "word " * (2000 if n % 5 == 0 else 100)) for n in range(50)] + [(1, "a")] * 30 + [(1, None)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(50)], "doc_id long, toxic int")
    rows = X.sample(docs, labels, F.lit(False)).collect()
    assert sorted(r.doc_id for r in rows) == [n for n in range(50) if n % 5] and [r.text for r in rows if r.doc_id == 1] == [""]
    with pytest.raises(ValueError, match="more than 3000 bytes"):
        X.fit(docs.filter("doc_id % 5 = 0"), labels, F.lit(False))
