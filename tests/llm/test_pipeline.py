"""Every stage of the pipeline against a plain version, on the rows that its predecessor kept."""

import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from pointloom.llm import pii, toxicity

from .test_mixing import plain_targets
from .test_ngram_join import brute
from .test_packing import reference
from .test_pii import PATTERNS

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The tables before and after each stage; the documents with null, empty and repeated texts added."""
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "", "en", None, 0), (9003, "mail me@here.org now", None, "src1", 20), (9004, "mail me@here.org now", "de", "src2", 20)], docs.schema)
    docs.unionByName(more).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    tables = [spark.read.parquet(f"{folder}/documents.parquet")]
    for n, (_, stage) in enumerate(C.STAGES):
        stage(spark, tables[-1], str(folder)).write.parquet(f"{folder}/stage{n}")
        tables.append(spark.read.parquet(f"{folder}/stage{n}"))
    return [t.collect() for t in tables], tables, str(folder)


def test_names_and_columns(stages):
    _, tables, _ = stages
    assert [n for n, _ in C.STAGES] == ["toxicity", "ngram_join", "pii", "mixing", "packing"] and C.ORACLE_SQL is None
    assert all(t.columns == tables[0].columns and t.dtypes == tables[0].dtypes for t in tables[1:5])


def test_toxicity(spark, stages):
    rows, tables, folder = stages
    model = toxicity.Model.load(toxicity.fit(tables[0], spark.read.parquet(f"{folder}/labels.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1))
    score = model.scores(pa.array([r.text for r in rows[0]]))
    assert sorted(map(tuple, rows[1]), key=repr) == sorted((tuple(r) for r, s in zip(rows[0], score) if s < 0.7), key=repr)
    assert 0 < len(rows[0]) - len(rows[1]) < 60


def test_near_duplicates(stages):
    rows, _, _ = stages
    kept = {d for d, _, c in brute([(r.doc_id, r.text) for r in rows[1]]) if d == c}
    assert {r.doc_id for r in rows[2]} == kept and len(rows[2]) == len(kept)
    assert {9001, 9002, 9003} <= kept and 9004 not in kept


def test_personal_data(stages):
    import re

    rows, _, _ = stages
    before = {r.doc_id: r for r in rows[2]}
    assert len(rows[3]) == len(before)
    for r in rows[3]:
        text = before[r.doc_id].text
        assert r.text == pii.redacted(text) and r.n_chars == (None if text is None else len(r.text))
        assert not re.search(PATTERNS["email"], r.text or "")
        plain = re.sub(PATTERNS["email"], "<EMAIL>", text or "")
        if plain == (text or "") and not pii.find_spans(text):
            assert r.text == text
    assert next(r.text for r in rows[3] if r.doc_id == 9003) == "mail <EMAIL> now"


def test_mixing(stages):
    rows, _, _ = stages
    words = lambda t: len((t or "").encode().split())
    sizes, taken = {}, {}
    for r in rows[3]:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    times = Counter(r.doc_id for r in rows[4])
    own = {r.doc_id: r for r in rows[3]}
    assert max(times.values()) <= 3 and all(tuple(r) == tuple(own[r.doc_id]) for r in rows[4])
    for r in rows[4]:
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
    target = plain_targets(sizes)
    for s, t in target.items():
        largest = max(words(r.text) for r in rows[3] if r.source == s)
        assert abs(taken.get(s, 0) - t) <= max(20, largest / 2)


def test_packing(stages):
    rows, _, _ = stages
    texts = {r.doc_id: r.text for r in rows[3]}
    ids = dict(zip(texts, reference(list(texts.values()))))
    want = Counter()
    for d, n in Counter(r.doc_id for r in rows[4]).items():
        cut = [0, *range(len(ids[d]) % 2048 or 2048, len(ids[d]) + 1, 2048)] if len(ids[d]) > 2048 else [0, len(ids[d])]
        for k, (s, e) in enumerate(zip(cut, cut[1:])):
            want[d, k, s, e - s, zlib.crc32(np.array(ids[d][s:e], "<u4").tobytes())] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows[5]) == want
    sequences = {}
    for r in rows[5]:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in rows[5]) // 2048) + 1


def test_run_equals_stages(spark, stages):
    rows, _, folder = stages
    got = C.run(spark, folder).collect()
    key = lambda rs: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert key(got) == key(rows[5])


def test_columns_called_like_the_stages_own(spark, stages, tmp_path):
    """They pass through every stage with their values."""
    _, tables, folder = stages
    names = ("toxicity", "Shard", "pos", "copy", "row", "size", "aside_0", "component_id", "spans", "a.b")
    docs = tables[0].select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names])
    for n, (name, stage) in enumerate(C.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert docs.columns == [*tables[0].columns, *names]
        assert docs.count() == tables[n + 1].count()
        assert docs.filter(F.greatest(*[F.col(f"`{c}`") != F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in names])).isEmpty(), name
