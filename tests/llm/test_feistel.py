from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seriesloom.llm import feistel

PATH, END = public_tokenizers.path("word_bpe_49k.json"), 49407
SCHEMA = "text string, slot int, shard string, doc_id long"


@pytest.mark.parametrize("count", [1, 2, 3, 5, 16, 17, 1000, 4097, 100_000])
def test_permutation_of_any_count(count):
    order = feistel.feistel(np.arange(count), count, 4)
    assert sorted(order.tolist()) == list(range(count))
    assert (order == feistel.feistel(np.arange(count), count, 4)).all()
    if count >= 1000:
        assert (order != feistel.feistel(np.arange(count), count, 5)).mean() > 0.99
        assert abs(np.corrcoef(np.arange(count), order)[0, 1]) < 0.1


def test_shards_hold_every_token_at_its_slot(spark, tmp_path):
    texts = [f"some words {i} of a text, " * (i % 23) for i in range(200)] + [None, "", "long word " * 4000]
    docs = spark.createDataFrame([(t, 1, "s", 2) for t in texts], SCHEMA).repartition(5).cache()
    folder = f"file://{tmp_path}/shards"
    rows = feistel.write_training_order(docs, PATH, END, folder, length=32, per_shard=10).collect()
    count = len(rows)
    assert sorted(r.slot for r in rows) == sorted(r.sequence for r in rows) == list(range(count))
    read = list(feistel.read_slots(folder, 0, count, 32, 10))
    by_slot = {r.slot: r for r in rows}
    for slot, ids in enumerate(read):
        r = by_slot[slot]
        assert (r.shard, r.byte_offset) == (f"shard-{slot // 10:08d}.bin", slot % 10 * 64)
        assert hashlib.sha256(ids.tobytes()).hexdigest() == r.sha256
    assert [x.tolist() for x in feistel.read_slots(folder, 7, 25, 32, 10)] == [x.tolist() for x in read[7:25]]
    assert len(list(tmp_path.joinpath("shards").iterdir())) == -(-count // 10)
    # In order of sequences, without what fills up, the ids are the texts' in order of partitions.
    stream = np.concatenate([read[r.slot][: r.n_tokens] for r in sorted(rows, key=lambda r: r.sequence)]).tolist()
    tok = Tokenizer.from_file(PATH)
    want = [x for r in docs.collect() for x in [*tok.encode(r.text or "", add_special_tokens=False).ids, END]]
    assert stream == want


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    assert feistel.write_training_order(docs, PATH, END, f"file://{tmp_path}/none").count() == 0
