import numpy as np
import pytest
from tokenizers import Tokenizer

from plotyard.llm.tokens import default_tokenizer
from plotyard.llm.tokenstore import SAMPLE_BYTES, BlockReader, dictionary_hash, read_store, sample_piece, write_block, write_store
from plotyard.session import scratch_path

TEXTS = [None, "", "one", "The cat, the dog.", "long " * 30000, "same", "same"]


def test_a_store_reads_back_in_doc_id_order(spark):
    whole = Tokenizer.from_file(default_tokenizer())
    texts = {100 - i: t for i, t in enumerate(TEXTS)} | {1000 + i: f"Text number {i} of the shop, and more. " * (i % 7) for i in range(300)}
    rows = [(d, t, 7, "x") for d, t in texts.items()] + [(None, "no id", 7, "y"), (98, "one", 7, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, ids string").repartition(5)
    path = scratch_path(spark, "store")
    write_store(docs, path, block_bytes=500)
    got = sorted(read_store(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: -1 if d is None else d)
    at = 0
    for r in got:
        text = texts[r.doc_id] if r.doc_id is not None else "no id"
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (at, len(ids), ids)
        at += len(ids)
    assert spark.read.parquet(f"{path}/dictionary").first().dictionary
    some = read_store(spark, path, doc_ids=[98, 1003]).collect()
    assert sorted(r.doc_id for r in some) == [98, 98, 1003]


def test_an_empty_table_is_an_empty_store(spark):
    path = scratch_path(spark, "store")
    write_store(spark.createDataFrame([], "doc_id long, text string"), path)
    assert read_store(spark, path).collect() == []


def test_a_block_of_another_dictionary_is_refused():
    block = write_block([], [], 2, dictionary_hash(b"a"))
    with pytest.raises(ValueError):
        BlockReader(block, b"b")


def test_the_dictionary_sees_whole_texts():
    ids = np.arange(50_000, dtype="<u2").tobytes()
    starts = set()
    for key in range(-200, 200):
        piece = sample_piece(ids, 2, key)
        assert len(piece) == SAMPLE_BYTES
        numbers = np.frombuffer(piece, "<u2")
        assert (np.diff(numbers) == 1).all()  # whole ids, in order
        starts.add(int(numbers[0]))
    assert len(starts) > 350 and min(starts) < 1_000 and max(starts) > 47_000
    assert sample_piece(ids[:100], 2, 5) == ids[:100] and sample_piece(b"", 2, 5) == b""
