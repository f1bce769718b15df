"""Language identification: held-out accuracy, rejection, edge cases."""

import numpy as np
from pyspark.sql import functions as F

from factorloom.llm import langid
from factorloom.llm.common import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = QUERIES["op10_language_id"](spark, FOLDER).join(docs, "doc_id").where("held_out")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_counts_cover_the_whole_text():
    text = "ab" * 70_000 + " жжж"
    counts, n = langid.ngram_counts(text)
    assert n == len(text) - 1
    assert (counts >= langid.ngram_counts("жжж")[0]).all()
    assert langid.ngram_counts(None)[1] == langid.ngram_counts("123 \n !")[1] == 0


def test_predictions_and_rejection(frame):
    say = {"aa": "lorem ipsum dolor sit amet ", "bb": "zwxk qvjy kkzx wqqv jyxx "}
    rows = [(i, say[k] * (3 + i % 4), k, "s") for i in range(200) for k in [("aa", "bb")[i % 2]]]
    docs = frame(rows, "doc_id long, text string, lang string, _language string")
    model = langid.fit(docs, "doc_id", "text", "lang")
    probe = frame([(1, "lorem dolor"), (2, "zwxk qvjy"), (3, None), (4, "12 ?!"), (5, "жзий " * 20), (5, "жзий " * 20), (None, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["p"]["lang_pred"], r["p"]["rejected"]) for r in langid.predict(probe, "text", model, "p").collect()}
    assert {(1, "aa", False), (2, "bb", False), (3, "und", True), (4, "und", True), (None, "und", True)} <= got
    assert any(k == 5 and r for k, _, r in got)
    assert langid.keep_known(docs, "doc_id", "text", "lang").columns == docs.columns
    assert langid.keep_known(docs, "doc_id", "text", "lang").count() == len(rows)


def test_nothing_to_learn_from(frame):
    docs = frame([(1, "abc", None), (None, None, "en")], "doc_id long, text string, lang string")
    assert langid.keep_known(docs, "doc_id", "text", "lang").count() == 2
    assert langid.keep_known(docs.where("false"), "doc_id", "text", "lang").count() == 0
    assert [r["p"]["lang_pred"] for r in langid.predict(docs, "text", langid.fit(docs, "doc_id", "text", "lang"), "p").collect()] == ["und", "und"]


def test_gibberish_of_any_length_is_rejected(spark, frame):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    rng, letters = np.random.default_rng(3), np.array(list("abcdefghijklmnopqrstuvwxyz"))
    sizes = [80, 120, 300, 1_000, 5_000, 20_000, 100_000]
    rows = [(n, " ".join("".join(rng.choice(letters, rng.integers(2, 9))) for _ in range(n // 5))) for n in sizes]
    model = langid.fit(docs, "doc_id", "text", "lang")
    out = langid.predict(frame(rows, "doc_id long, text string"), "text", model, "p").collect()
    assert {r["doc_id"]: r["p"]["rejected"] for r in out} == dict.fromkeys(sizes, True)
    long = docs.where(F.length("text") > 200)
    assert langid.predict(long, "text", model, "p").where("p.rejected").count() <= 0.02 * long.count()


def test_limits_count_every_row(frame):
    rows = [(i, "lorem ipsum dolor sit amet " * (5 + i % 3), "aa") for i in range(1500)]
    docs = frame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, "doc_id", "text", "lang", sample=50)
    assert sum(x.sum() for x in langid.distances(docs, "text", model).values()) == len(rows)


def test_sparse_buckets_inherit():
    counts = np.zeros((langid.BUCKETS, langid.STEPS + 1), int)
    counts[10, 300], counts[12, 500], counts[14, 900] = langid.LEAST, langid.LEAST, langid.LEAST - 1
    got = langid.distance_limits({"aa": counts, "bb": 0 * counts})
    want = [1.0] * 7 + [0.3 + langid.MARGIN] * 5 + [0.5 + langid.MARGIN] * 12
    assert np.allclose(got["aa"], want) and np.allclose(got["bb"], want)
    assert (langid.distance_limits({"aa": 0 * counts})["aa"] == 1).all()
