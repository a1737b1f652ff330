"""Every query and the pipeline on empty tables, and on tables of one odd row with further columns."""

import pytest

from pointloom.llm.queries import QUERIES

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
}
ODD = {"documents": (None, None, None, None, None), "labels": (None, None, None), "embeddings": (None, None, None), "conversations": (None, None, None, None)}
CLASHES = "set_id long, spans string, evidence double, copies int, toxicity string, chunk int, grp long, block int, score double, rank int, i int, h1 long, pack_uid long, row string, learn int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = {}
    for kind in ("empty", "odd"):
        out[kind] = str(tmp_path_factory.mktemp(kind))
        for name, schema in SCHEMAS.items():
            extra = CLASHES.split(", ")
            rows = [(*ODD[name], *[None] * len(extra))] * 2 if kind == "odd" else []
            spark.createDataFrame(rows, f"{schema}, {CLASHES}").write.parquet(f"{out[kind]}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_query(spark, tables, name, kind):
    n = QUERIES[name](spark, tables[kind]).count()
    per_row = name.split("_")[0] not in ("op3", "op5", "op8")
    assert n == (0 if kind == "empty" else 2 if per_row else 1 if name.startswith("op8") else 0)


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_pipeline(spark, tables, kind):
    import corpus_pipeline

    # A text without words has size 0; a mix of no words takes nothing.
    assert corpus_pipeline.run(spark, tables[kind]).count() == 0
