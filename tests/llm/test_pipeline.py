"""The corpus pipeline: its stages' rows, and the whole against a plain version of what they decide."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weft.llm import decontaminate, line_dedup, ngram_join, packing, quality
from weft.llm.common import written

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def tables(spark, tmp_path):
    import random

    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, "\n".join(sentence(15) for _ in range(4)), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, " ".join(w.upper() + "!!" for w in sentence(40).split()), "en", "s0", 0) for i in range(30)]
    near = rows[3][1].replace("\n", " ").split()
    rows.append((200, " ".join(near), "en", "s1", 0))
    near[5] = "0123456789"  # more edits than a line of 60 words may have, few enough shingles
    rows.append((201, " ".join(near), None, None, None))
    leak = sentence(30)
    rows += [(202, rows[4][1], "en", "s1", 0), (203, f"{sentence(10)} {leak} {sentence(10)}", "en", "s2", 0), (204, None, "en", "s2", 0), (205, "", "en", "s2", 0)]
    for name, df in {
        "documents": spark.createDataFrame(rows, DOC).withColumn("key", F.lit("mine")),
        "labels": spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(30)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string"),
    }.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path), rows


def test_stages(spark, tables):
    sf_dir, rows = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, sf_dir), "stage")
        if name != "packing":
            assert docs.columns == before.columns and docs.schema["doc_id"].dataType == before.schema["doc_id"].dataType
            assert docs.where("key != 'mine'").isEmpty()
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert not left[0] & set(range(100, 130)) and set(range(60)) <= left[0]  # shouted junk goes, prose stays
    assert 202 not in left[1] and set(range(60)) <= left[1] and left[0] - left[1] <= {202}  # a copy has no line of its own
    assert len({3, 200, 201} & left[2]) == 1 and set(range(60)) <= left[2]
    assert 203 in left[2] and 203 not in left[3] and left[2] - left[3] == {203}
    assert left[4] == left[3]


def test_run_equals_its_stages(spark, tables):
    sf_dir, _ = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = {r.doc_id for r in quality.report(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    docs = docs.where(F.col("doc_id").isin(*scored))
    docs = line_dedup.deduplicated(docs)
    docs = docs.join(ngram_join.near_duplicates(docs).where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi")
    docs = docs.join(decontaminate.report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select("doc_id"), "doc_id", "left_semi")
    want = packing.pack(docs)
    got = corpus_pipeline.run(spark, sf_dir)
    digest = lambda df: hashlib.sha256(repr(sorted((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect())).encode()).hexdigest()
    assert digest(got) == digest(want) and got.agg(F.sum("length")).first()[0] == want.agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, tables, name):
    sf_dir, _ = tables
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, spark.createDataFrame([], DOC), sf_dir).count() == 0
