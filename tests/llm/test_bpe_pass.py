"""Ids and decoded bytes in one pass over the texts."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tickforge.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)


def test_the_query_has_one_pass_of_python(spark, tmp_path):
    texts = [None, "", " ", "one two  three", "漢字 é𝄞 " * 50, "x" * 70_000]
    d = spark.createDataFrame([(i % 7, texts[i % len(texts)], 5) for i in range(30)], "doc_id long, text string, ids int")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    plan = bpe.op13_bpe(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    got = bpe.round_trip(d, PATH, public_tokenizers.PATTERN)
    two = bpe.decode(bpe.encode(d, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert got.columns == ["doc_id", "ids", "decoded"]
    key = lambda x: sorted(map(str, x.select("doc_id", "ids", "decoded").collect()))
    assert key(got) == key(two)
    assert two.where(F.col("decoded") != F.coalesce("text", F.lit("")).cast("binary")).count() == 0
    assert bpe.round_trip(d.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_ids_that_the_vocabulary_lacks():
    c = bpe.Codec({**{bytes([i]): i for i in range(256)}, b"ab": 300}, r"\S+")
    assert c.decode([97, 300]) == b"aab" and c.decode([]) == b""
    for bad in (-1, 299, 301):
        with pytest.raises(ValueError, match=f"no token has the id {bad}"):
            c.decode([97, bad])
