"""The stages of the pipeline against plain versions, with nulls, empty texts, repeats, ties and clashing columns."""

import random

import public_tokenizers
import sentencepiece

import corpus_pipeline
from fluxweave.llm import quality

from .test_texts import SPACE, UPPER, hits, prose


def made(spark, folder):
    r = random.Random(6)
    good = [(i, "\n".join(prose(r, 25, 900) for _ in range(3))) for i in range(60)]
    bad = [(i, "BUY!! NOW!! ### " * 20 + prose(r, 5)) for i in range(60, 120)]
    item = prose(r, 14, 900)
    extra = [(200, good[0][1]), (201, good[1][1].replace("w1", "w2", 1)), (202, f"{prose(r, 20, 900)} {item} {prose(r, 20, 900)}"), (203, None), (204, ""), (205, prose(r, 4000, 900)), (205, prose(r, 4000, 900)), (None, prose(r, 60, 900))]
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame(good + bad + extra, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'a' AS source", "cast(length(text) AS long) AS n_chars", "'kept' AS score", "'kept' AS predicted", "'kept' AS n_lines", "'kept' AS n_removed", "'kept' AS spans", "'kept' AS rep")
    docs.write.parquet(f"{folder}/documents.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), item


def sets(text, k=5):
    w = SPACE.findall((text or "").translate(UPPER))
    return {tuple(w[n : n + k]) for n in range(max(len(w) - k, 0) + 1)} if w else set()


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    docs, item = made(spark, folder)
    scored = {(x.doc_id, x.text): x.predicted for x in quality.classify(docs.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    one = corpus_pipeline.quality_stage(spark, docs, folder)
    rows = one.collect()
    assert one.columns == docs.columns and {x.score for x in rows} == {x.n_lines for x in rows} == {"kept"}
    assert sorted(str((x.doc_id, x.text)) for x in rows) == sorted(str(k) for k, v in scored.items() if v == 1 for _ in range(1))
    assert {x.doc_id for x in rows if x.doc_id is not None and x.doc_id < 120} == set(range(60))

    whole = docs.where("doc_id < 60 OR doc_id >= 200 OR doc_id IS NULL")
    two = corpus_pipeline.lines_stage(spark, whole, folder)
    got = {x.doc_id: x for x in two.collect() if x.doc_id != 205}
    assert two.columns == docs.columns and {x.n_removed for x in got.values()} == {"kept"} and 200 not in got
    assert got[0].text.count("\n") == 2 and got[203].text is None and got[204].text == "" and got[201].n_chars == len(got[201].text or "") if 201 in got else True
    assert corpus_pipeline.lines_stage(spark, whole.drop("n_chars"), folder).columns == [c for c in docs.columns if c != "n_chars"]

    three = corpus_pipeline.jaccard_stage(spark, whole, folder)
    left = [x for x in three.collect()]
    ids = [x.doc_id for x in left]
    assert three.columns == docs.columns and 200 not in ids and 201 not in ids and {0, 1, 202, 203, 204, None} <= set(ids)
    some = [(x.doc_id, sets(x.text)) for x in left if x.doc_id is not None and x.doc_id != 205]
    assert all(not s or not t or 100 * len(s & t) < 80 * len(s | t) for n, (_, s) in enumerate(some) for _, t in some[:n])

    four = corpus_pipeline.decontamination_stage(spark, whole, folder)
    windows = {}
    words = item.split()
    for n in range(len(words) - 9):
        windows[tuple(words[n : n + 10])] = {"1"}
    clean = {x.doc_id: x.text for x in four.collect()}
    before = {x.doc_id: x.text for x in whole.collect()}
    assert four.columns == docs.columns and all(hits(t, windows)[1] == 0 for t in clean.values()) and hits(before[202], windows)[1] > 0
    assert all(clean[i] == t for i, t in before.items() if i not in (202, 205))

    five = {x.doc_id: x for x in corpus_pipeline.pieces_stage(spark, whole, folder).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(list(five[i].ids or []) == model.encode(t or "") and five[i].round_trip for i, t in before.items() if i in (0, 7, 202, 204))


def test_quality_sends_a_text_once(spark, tmp_path, monkeypatch):
    docs, _ = made(spark, str(tmp_path))
    docs, seen, classify = docs.withColumnRenamed("score", "Score"), [], quality.classify
    monkeypatch.setattr(quality, "classify", lambda documents, labels: (seen.append(documents.schema), classify(documents, labels))[1])
    one = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    assert one.columns == docs.columns and {x.Score for x in one.collect()} == {"kept"}
    assert seen[0].simpleString().count("text:string") == 1


def test_empty(spark, tmp_path):
    docs, _ = made(spark, str(tmp_path))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
