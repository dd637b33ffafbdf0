"""The stages of the pipeline on odd documents, and on none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import media
from tidemill.llm.common import saved, table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("some", ["odd", "none"])
def test_stages_take_whatever_comes(spark, odd_docs, some):
    """Nulls in every column, empty, blank and long texts, repeated rows and clashing
    columns; each stage gets what its predecessor kept."""
    given = table(spark, SF, "documents").limit(60).withColumns({c: F.lit("x") for c in odd_docs.columns[5:]})
    docs = odd_docs.union(given.select(*odd_docs.columns)) if some == "odd" else odd_docs.limit(0)
    kinds = docs.dtypes
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, SF), name)
        assert docs.dtypes == kinds, name
        if name == "secret_scans":
            assert docs.count() == before.count()
        if name == "mixing":
            assert before.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0
        assert some == "odd" or docs.count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() == docs.count() and (some == "none" or docs.count() > 30)


def test_each_stage_keeps_rows_it_cannot_judge(spark, odd_docs):
    """Of each stage alone: what it does with nulls and blank texts."""
    stages = dict(corpus_pipeline.STAGES)
    deduped = stages["minhash_near_dedup"](spark, odd_docs, SF)
    # One of the repeated rows' group stays by its id, and so both do; all others are alone.
    assert sorted(map(str, (r["doc_id"] for r in deduped.collect()))) == sorted(["1", "1", "2", "3", "4", "None", "5", "6", "7"])
    masked = stages["secret_scans"](spark, odd_docs, SF)
    assert sorted(map(str, masked.select("doc_id", "text").collect())) == sorted(map(str, odd_docs.select("doc_id", "text").collect()))
    packed = stages["packing"](spark, odd_docs, SF)
    assert packed.count() == 9 and packed.filter("n_tokens = 0").count() == 3


def test_long_media_are_decoded_whole(spark):
    text = "".join(chr(97 + i % 23) for i in range(1_300_000))
    stored = media.store_texts(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in media.decode_pixels(stored).collect()}
    assert (got[1]["width"], got[1]["height"]) == (64, -(-1_300_000 // 64))
    samples = (np.array(got[1]["pixels"], np.int64) >> 8 & 255).astype(np.uint8).tobytes()
    assert samples[:1_300_000] == text.encode() and not any(samples[1_300_000:])
    behind = stored.filter("doc_id = 2").withColumn("media", F.concat("media", F.lit(b"more")))
    assert media.decode_pixels(behind).first()["pixels"] is None
