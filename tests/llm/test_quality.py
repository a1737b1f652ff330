import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointloom.llm import quality as Q
from pointloom.llm.queries import op9_quality

SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op9_quality(spark, SF).collect()}
    own = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) == 10_000 and all(r.held_out for r, _ in own)
    assert sum(r.keep == (y == 1) for r, y in own) >= 0.97 * len(own)


def plain_posteriors(rows):
    value = lambda r: r["known"] if r["known"] is not None else r["evidence"]
    total = lambda rs: (sum(map(value, rs)), len(rs))
    mean = total(rows)[0] / len(rows)
    strength = lambda between, m: max(1.0, min(1000.0, m * (1 - m) / max(between, 1e-9) - 1))
    sites, paths = {}, {}
    for r in rows:
        sites.setdefault(r["site"], []).append(r)
        paths.setdefault((r["site"], r["path"]), []).append(r)
    s = {k: total(v) for k, v in sites.items()}
    p = {k: total(v) for k, v in paths.items()}
    k0 = strength(sum(n * ((g / n - mean) ** 2 - mean * (1 - mean) / n) for g, n in s.values()) / len(rows), mean)
    rate = {k: (g + k0 * mean) / (n + k0) for k, (g, n) in s.items()}
    between = sum(n * ((g / n - rate[k[0]]) ** 2 - rate[k[0]] * (1 - rate[k[0]]) / n) for k, (g, n) in p.items()) / len(rows)
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    out = []
    for r in rows:
        others = [x for x in rows if x is not r]
        of = lambda *keys: [x for x in others if all(x[k] == r[k] for k in keys)]
        near = lambda rs, k, prior: (sum(map(value, rs)) + k * prior) / (len(rs) + k)
        m = sum(map(value, others)) / len(others) if others else 0.5
        site = near(of("site"), k0, m)
        path = near(of("site", "path"), strength(between, rate[r["site"]]), site)
        out.append((r["doc_id"], site, path, 1 / (1 + math.exp(-(logit(r["evidence"]) - logit(m) + logit(path))))))
    return sorted(out)


def test_posteriors_equal_plain_version(spark):
    r = np.random.default_rng(5)
    rows = [{"doc_id": i, "site": r.choice(["hot", "hot", "hot", "a", "b", None]), "path": r.choice(["x", "y", None]), "known": [None, 0, 1][r.integers(0, 3)], "evidence": float(r.uniform(0.01, 0.99))} for i in range(400)]
    rows += [{"doc_id": 900, "site": "lone", "path": "", "known": None, "evidence": 0.2}]
    df = spark.createDataFrame(rows, "doc_id long, site string, path string, known int, evidence double")
    got = sorted((x.doc_id, x.site_rate, x.path_rate, x.score) for x in Q.posteriors(df).collect())
    assert np.allclose(got, plain_posteriors(rows), rtol=1e-9)


@pytest.mark.parametrize("known", [None, 0, 1])
def test_lone_documents_do_not_vouch_for_themselves(spark, known):
    """The rates that a lone document of a lone site meets are the others' mean, whatever it says of itself."""
    rows = [(n, "big", "x", n % 2, 0.5) for n in range(100)] + [(900, "lone", "", known, 0.97)]
    df = spark.createDataFrame(rows, "doc_id long, site string, path string, known int, evidence double")
    r = Q.posteriors(df).filter("doc_id = 900").first()
    assert abs(r.site_rate - 0.5) < 1e-12 and abs(r.path_rate - 0.5) < 1e-12 and abs(r.score - 0.97) < 1e-9


def test_clashing_columns_change_nothing(spark):
    rows = [(n, "good words here " * (1 + n % 7), f"s{n % 3}", "en") for n in range(40)] + [(None, "no id", "s1", "de")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(0, 40, 3)], "doc_id long, quality int")
    more = docs.selectExpr("*", "9 AS known", "0.5D AS evidence", "'x' AS site", "1 AS path", "7L AS n", "true AS keep", "2 AS of_n")
    rows = lambda d: sorted((str(r.doc_id), round(r.score, 9), r.keep) for r in Q.assess(d, labels, F.col("source"), F.col("lang"), F.lit(False)).collect())
    assert rows(docs) == rows(more) and len(rows(docs)) == 43


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "good text here", "s", "en"), (None, None, None, None), (2, "", "s", None), (2, "", "s", None), (3, "w " * 50_000, "t", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (9, 1), (None, 0), (3, None)], "doc_id long, quality int")
    out = Q.assess(docs, labels, F.col("source"), F.col("lang"), F.lit(False)).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.keep == (r.score >= 0.5) for r in out)
    assert Q.assess(docs, labels.limit(0), F.col("source"), F.col("lang"), F.lit(False)).count() == 5
    assert Q.assess(docs.limit(0), labels, F.col("source"), F.col("lang"), F.lit(False)).count() == 0
    urls = spark.createDataFrame([("https://u:p@www.Ex.org:80/En/1?q",), ("http://a.b",), ("nothing",), (None,)], "url string")
    assert [tuple(r) for r in urls.select(*Q.url_levels(F.col("url"))).collect()] == [("ex.org", "en"), ("a.b", ""), ("", ""), (None, None)]


def test_long_texts_cannot_keep_others_out_of_training(spark, monkeypatch):
    monkeypatch.setattr(Q, "TRAIN_TEXT_BYTES", 2000)
    monkeypatch.setattr(Q, "TRAIN_BYTES", 3000)
    good, bad = "Plain words make a sentence here. ", "### $$$ ### 99 "
    docs = [(n, (good if n % 2 else bad) * 3) for n in range(40)] + [(n, bad * 1000) for n in range(40, 60)] + [(7, good * 3)] * 50
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(60)], "doc_id long, quality int")
    mean, scale, w = Q.fit(docs, labels, F.lit(False))
    p = lambda t: float(Q._design(Q.statistics(pa.array([t])), mean, scale)[0] @ w)
    assert p(good * 3) > 0 > p(bad * 3)
    with pytest.raises(ValueError):
        Q.fit(docs.filter("doc_id >= 40"), labels, F.lit(False))
    none = Q.fit(docs.filter("doc_id >= 90"), labels, F.lit(False))
    assert not none[2].any()


PAGE = "<html><head><title>t</title><style>p{a:b}</style><script>var t='</p>';</script></head><body><!-- c --><p>%s</p><div>x &amp;lt; <b>y</b></div></body></html>"


def test_pages_by_host_equal_plain_version(spark):
    assert spark.createDataFrame([(PAGE % "One two.",)], "h string").select(Q.page_text(F.col("h"))).first()[0].split("\n")[1:3] == ["One two.", "x &lt; y"]
    docs = [(n, ("Plain words make a sentence here. " if n % 2 else "### $$$ ### 99 ") * (1 + n % 5)) for n in range(60)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(60)], "doc_id long, quality int")
    said = ["Plain words make a sentence here. ", "### $$$ ### 99 ", "Words ### here "]
    urls = ["http://www.Hot.org/en/%d", "http://hot.org:80/de/%d", "https://thin.net/%d", "nothing"]
    pages = [(n, urls[(n * n) % 7 % 4] % n if n % 4 < 3 and "%" in urls[(n * n) % 7 % 4] else None, PAGE % (said[n % 3] * (1 + n % 4)), 1.0) for n in range(90)]
    pages += [(5, "http://hot.org/en/", None, 1.0), (None, None, "", 1.0), (8, "http://one.net", "<p>" + "word " * 50_000, 1.0)]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string, score double")
    got = Q.assess_pages(pages, docs, labels, F.lit(False)).collect()
    assert len(got) == 93 and {r.site for r in got} >= {"hot.org", "thin.net", "one.net", None}
    plain = plain_posteriors([{"doc_id": r.page_id if r.page_id is not None else -1, "site": r.site, "path": r.path, "known": None, "evidence": r.evidence} for r in got])
    assert np.allclose(sorted((r.page_id if r.page_id is not None else -1, r.site_rate, r.path_rate, r.score) for r in got), plain, rtol=1e-9)
    assert Q.assess_pages(pages.limit(0), docs, labels, F.lit(False)).count() == 0
