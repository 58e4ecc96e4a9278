import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as P
from tests.llm import odd
from tests.llm.test_simhash import brute_roots, shingles
from vellum.llm import mixing, piece_matching, quality_compression
from vellum.llm.common import crc_fold

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = dict(P.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(crc_fold(F.col("doc_id")) != 1)
    scorer = quality_compression.train(docs, labels).scorer()
    good = {d["doc_id"] for d in docs.collect() if scorer(d["text"].encode()) >= P.LEAST_QUALITY}
    one = step["quality"](spark, docs, SF)
    assert one.columns == docs.columns and {d["doc_id"] for d in one.collect()} == good
    two = step["language"](spark, one, SF)
    assert {d["doc_id"] for d in two.collect()} == {d["doc_id"] for d in one.collect() if any(c.isalpha() for c in d["text"])}
    three = step["near_dedup"](spark, two, SF)
    before = {d["doc_id"]: shingles(d["text"]) for d in two.collect()}
    kept = {d["doc_id"] for d in three.collect()}
    assert kept == set(brute_roots(set(before), lambda a, b: len(before[a] & before[b]) >= 0.8 * len(before[a] | before[b])).values())
    four = step["mix"](spark, three, SF)
    want = {d["doc_id"] for d in mixing.with_probabilities(three).where("__vellum_taken").collect()}
    assert four.columns == docs.columns and {d["doc_id"] for d in four.collect()} == want
    five = step["encode"](spark, four, SF)
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_matching.MODEL)
    texts = {d["doc_id"]: d["text"] for d in docs.collect()}
    rows = five.collect()
    assert {r["doc_id"] for r in rows} == want and all(list(r["ids"]) == lib.encode(texts[r["doc_id"]]) for r in rows)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in P.run(spark, SF).collect()) == sorted((r["doc_id"], r["n_tokens"]) for r in rows)


def test_stages_with_odd_documents(spark):
    for frame in (odd.frame(spark), odd.empty(spark)):
        docs = frame
        for name, f in P.STAGES:
            out = f(spark, docs, SF)
            if name != "encode":
                assert out.columns == frame.columns
                docs = spark.createDataFrame(out.collect(), out.schema)
            else:
                out.collect()


def test_language_stage_rejects_scripts_without_a_profile(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd_ones = docs.limit(3).withColumns({"doc_id": F.col("doc_id") + 10**9, "lang": F.lit(None).cast("string"), "text": F.lit("σύντομο κείμενο σε άλλη γραφή")})
    kept = {r["doc_id"] for r in dict(P.STAGES)["language"](spark, docs.unionByName(odd_ones), SF).collect()}
    assert kept == {d["doc_id"] for d in docs.collect() if any(c.isalpha() for c in d["text"])}


def test_entry():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_hand_python_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    try:
        for setting, most in (("10000", 500), ("0", 500), ("20", 20)):
            spark.conf.set(name, setting)
            assert P.encode(spark, docs, "").count() == 1
            assert int(spark.conf.get(name)) == most
    finally:
        spark.conf.set(name, before)
