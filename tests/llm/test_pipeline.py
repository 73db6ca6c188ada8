from collections import Counter

import corpus_pipeline as C
import public_tokenizers
from lodgely.llm import bpe, mixing, simhash, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash", "mixing", "bpe"] and C.ORACLE_SQL is None
    clean = C.drop_toxic(spark, docs, SF)
    scores = toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet")), keep=["doc_id"])
    kept = {r.doc_id for r in scores.filter("score < 0.5").collect()}
    assert {r.doc_id for r in clean.collect()} == kept and clean.columns == docs.columns
    single = C.drop_near_copies(spark, clean, SF)
    want = {r.component_id for r in simhash.near_duplicates(clean).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(want) and single.columns == docs.columns
    mixed = C.mix_sources(spark, single, SF)
    copies = {r.doc_id: r.copies for r in mixing.with_copies(single).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == {i: n for i, n in copies.items() if n} and mixed.columns == docs.columns
    last = C.encode(spark, mixed, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    back = bpe.decode(C.encode(spark, mixed, SF), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert all(r.decoded.decode() == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in back) and len(back) == len(last)
    assert Counter(r.doc_id for r in C.run(spark, SF).select("doc_id").collect()) == Counter(r.doc_id for r in last)


def test_odd_rows(spark, odd, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    clean = C.drop_toxic(spark, odd, d)
    assert clean.count() == 14 and clean.columns == odd.columns
    single = C.drop_near_copies(spark, clean, d)
    assert sorted(str(r.doc_id) for r in single.collect()) == sorted(["1", "3", "6", "7", "8", "9", "12", "None"])
    mixed = C.mix_sources(spark, single, d)
    assert mixed.columns == odd.columns and C.encode(spark, mixed, d).count() == mixed.count()
    assert C.mix_sources(spark, odd.limit(0), d).count() == 0 and C.drop_near_copies(spark, odd.limit(0), d).count() == 0
    assert C.drop_toxic(spark, odd.limit(0), d).select(F.count("*")).first()[0] == 0


def test_columns_of_the_input_keep_their_values(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names = ["score", "spans", "size", "rate", "copies", "component", "_copy", "_mix_key", "source_size", "target"]
    rows = [(k, f"text number {k} of some words that differ {k * k} each", "en", "a" if k % 2 else None, *[f"{n}-{k}" for n in names]) for k in range(1, 9)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in ["doc_id", "text", "lang", "source", *names]))
    for stage in (C.drop_toxic, C.drop_near_copies, C.mix_sources):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and got.count() > 0 and {tuple(r) for r in got.collect()} <= set(rows)
