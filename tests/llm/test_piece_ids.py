"""The query returns the piece ids, and they decode to the texts."""

import collections
import os

from signalbook.llm import pieces, queries

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def test_query_returns_ids_that_decode_to_the_texts(spark):
    encoded = queries.QUERIES["op2_sentencepiece"](spark, FOLDER)
    back = collections.Counter((r["doc_id"], r["text"]) for r in pieces.decoded(encoded).collect())
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert back == collections.Counter((r["doc_id"], r["text"] or "") for r in texts)
