"""What Python workers hold: remembered words, and the batches that reach them."""

import pyarrow as pa

from feedloom.llm import langid, token_output
from feedloom.llm.common import small_batches


def test_a_word_that_is_a_piece_is_remembered_once():
    encode = token_output.Encoder(token_output.vocabulary_path())
    for text in ("alpha beta", "alpha, gamma.", "gamma beta!"):
        encode(text)
    assert {"alpha", "beta", "gamma"} <= encode.pieces.keys()
    assert not encode.pieces.keys() & encode.words.keys()


def test_batches_of_long_texts_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    texts = spark.range(0, 200, 1, 1).selectExpr("repeat('x', 100000) AS text")
    with small_batches(spark, 1_000, 1 << 20):
        found = [row["n"] for row in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(found) == 200 and max(found) <= 11


def test_language_stage_plans_its_batches_itself(spark):
    rows = [(1, "some words here", "en"), (2, "einige worte hier", "de"), (3, None, "en"), (4, "more words", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = langid.keep_determined(docs, langid.train(docs))
    assert "MapInArrow" not in kept._jdf.queryExecution().executedPlan().toString()
    assert 3 not in {row["doc_id"] for row in kept.collect()}
