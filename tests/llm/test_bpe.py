import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from panelframe.llm import bpe, queries

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "  \n\t x  'S a's 中文  😀  ", "Hello world, hello  world\n\n\nagain", "a" * 5000, "one two " * 3000, " nbsp em", "don't we'll I'M", "x\n y\r\n z"]


@pytest.fixture(scope="module")
def coder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("block", [50, 1 << 20])
def test_round_trip(spark, coder, block):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(0)).repartition(3)
    vocabulary = bpe.read_vocabulary(PATH)
    coded = bpe.encode(df, vocabulary, P.PATTERN, block_bytes=block)
    got = coded.select("doc_id", "ids", bpe.ids_sha256("ids").alias("h"), bpe.decode(spark, "ids", vocabulary).alias("b")).collect()
    texts = dict(rows)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    for r in got:
        want = coder.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == want and bytes(r.b) == (texts[r.doc_id] or "").encode()
        assert r.h == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def test_repeated_rows_and_string_ids(spark):
    df = spark.createDataFrame([("a", "same text")] * 3, "doc_id string, text string").repartition(3)
    out = bpe.encode(df.unionByName(df), bpe.read_vocabulary(PATH), P.PATTERN).collect()
    assert len(out) == 6 and {r.doc_id for r in out} == {"a"} and len({tuple(r.ids) for r in out}) == 1


def test_ids_outside_and_empty_table(spark):
    vocabulary = bpe.read_vocabulary(PATH)
    df = spark.createDataFrame([([0, 99999999],), ([],), (None,), ([-1],)], "ids array<int>")
    assert [r.b if r.b is None else bytes(r.b) for r in df.select(bpe.decode(spark, "ids", vocabulary).alias("b")).collect()] == [None, b"", b"", None]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(empty, vocabulary, P.PATTERN).count() == 0


def test_input_out_of_a_shuffle(spark, coder):
    """An input whose rows come in another order at each read is saved once."""
    rows = [(i, f"row {i} of many\n" * (i % 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("r", F.rand()).repartition(5, "r").select("doc_id", "text")
    got = {r.doc_id: r.ids for r in bpe.encode(df, bpe.read_vocabulary(PATH), P.PATTERN, block_bytes=2000).collect()}
    assert got == {i: coder.encode_ordinary(t) for i, t in rows}


def test_query_digests(spark, coder):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op7_bpe_round_trip(spark, "/root/testdata/sf0.001").collect():
        ids = coder.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_tasks_follow_the_text(spark):
    assert bpe._tasks(spark, 0) == 4 and bpe._tasks(spark, 1 << 34) == 1024 and bpe._tasks(spark, 10**14) == 10**14 >> 30
