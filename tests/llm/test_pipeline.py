"""The pipeline against a version in plain Python that is given the two models' verdicts."""

import public_tokenizers
from helpers import CLASHING, sentences
from pyspark.sql import functions as F
from test_documents import brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from tidecast.llm import langid, quality
from tidecast.llm.queries import ORACLES, QUERIES


def tables(spark, folder):
    rows, labels = [], []
    for i in range(160):
        lang = ("en", "fr", "de")[i % 3]
        text = "\n".join(sentences(lang, 25, i * 10 + j).capitalize() + "." for j in range(1 + i % 5))
        if i % 5 == 0:
            text = text.upper().replace(" ", "!! ")
        if i % 11 == 0:
            text = "\n".join(sentences("en", 25, j).capitalize() + "." for j in range(3)) + (" x" if i % 2 else "")
        if i == 50:
            text = None
        labels.append((i, 0 if i % 5 == 0 and i % 11 else 1, 0))
        rows.append((i, text, lang, "s", len(text or "")))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(1) for c in CLASHING}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_and_result(spark, tmp_path):
    folder = str(tmp_path)
    tables(spark, folder)
    assert corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = {r["doc_id"] for r in quality.predict(docs, quality.train(docs, labels)).where("predicted = 1").collect()}
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == columns
        out.write.parquet(f"{folder}/stage{n}")
        docs = spark.read.parquet(f"{folder}/stage{n}")
        if n == 0:
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == kept and 100 < len(kept) < 150
            kept = {r["doc_id"] for r in langid.predict(docs, langid.train(docs)).where("accepted").collect()}
        elif n == 1:
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == kept
            label, _ = brute_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
            kept = {i for i, c in label.items() if i == c}
        else:
            assert {r["doc_id"] for r in docs.select("doc_id").collect()} == kept
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {r["doc_id"]: len(encoder.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = corpus_pipeline.run(spark, folder).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == tokens
    assert got.groupby("sequence_id").length.sum().max() <= 2048


def test_every_operator_has_a_query():
    names = [q.split("_")[0] for q in QUERIES]
    assert sorted(names, key=lambda n: int(n[2:])) == [f"op{n}" for n in range(1, 11)]
    assert set(ORACLES) <= set(QUERIES)
