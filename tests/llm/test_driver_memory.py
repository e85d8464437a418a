"""What the operators leave in the memory of processes that go on."""

import ctypes
import os
import re

from vigilake.llm import tokens, toxicity
from vigilake.llm.common import table
from vigilake.llm.queries import toxicity_field


def held() -> float:
    """MB of this process."""
    with open(f"/proc/{os.getpid()}/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024


def test_training_gives_its_memory_back(spark):
    sf = "/root/testdata/sf0.1"
    toxicity_field(spark, table(spark, sf, "documents"), sf)
    before = held()
    ctypes.CDLL("libc.so.6").malloc_trim(0)
    assert before - held() < 25


def test_a_new_run_forgets_the_pieces_of_the_last_one(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")

    def has(batches):
        for b in batches:
            tokens.encoder(path)
            yield b

    def left(batches):
        for b in batches:
            yield b.filter([tokens.encoder.cache_info().currsize > 0] * b.num_rows)

    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string").coalesce(1)
    assert docs.mapInArrow(has, docs.schema).count() == 1
    field = toxicity.Field(toxicity.np.full(toxicity.BUCKETS, -1.0), toxicity.np.zeros((2, 2)), toxicity.np.array([-4.0, 0.0, 0.0]))
    assert toxicity.drop_toxic(docs, field).mapInArrow(left, docs.schema).count() == 0
