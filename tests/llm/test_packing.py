import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from plotyard.llm.packing import TIERS, cut_at_powers, pack_block, pack_documents, step_groups
from plotyard.llm.tokens import ChunkEncoder, default_tokenizer

TEXTS = [
    None, "", "one", "Don't stop. Won't, can't.'s", "a" * 9000, "x,y. Z,  two  spaces\n\nlines\tand\x1ctabs", "Ünïcödé, ΣΑΣ ﬁ é.",
    "<|endoftext|> <|ENDOFTEXT|> it's 123,4.5.", "word " * 12000, "The end. " * 700, "漢字 かな 한글 😀😀 😀.", "same text", "same text",
]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(default_tokenizer())


def test_chunks_give_the_ids_of_the_whole_text(whole):
    words = ChunkEncoder(default_tokenizer())
    for text in TEXTS:
        assert words.encode(text).tolist() == whole.encode(text or "", add_special_tokens=False).ids
    rng = random.Random(6)
    parts = ["ab", "É", "x'", "'s", "S", "<|endoftext|>", "<|", "|>", "%%%", ".,", "!", "9", "$", " ", " ", "\n", "\t", "…", "e\u0301", "#'ll", "İ", "ß"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert words.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_pieces_cover_every_id_once(spark, whole):
    rows = [(i if i != 3 else None, t, f"s{i}", i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, sequence_id long")
    got = pack_documents(docs, block_tokens=5000, keep_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert len(pieces) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        mine = sorted(pieces[i if i != 3 else None], key=lambda r: r.start)
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]]
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine]).tolist() == ids
        assert {r.doc_tokens for r in mine} == {len(ids)}
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1]]
        total = sum(r.length for r in parts)
        assert total <= 4096 and total & (total - 1) == 0 and {r.sequence_length for r in parts} == {total}


def test_an_empty_table_gives_no_rows(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_windows_are_full_and_gaps_take_shorter_tiers():
    windows, rest = pack_block([3000, 900, 300, 120, 9000, 77], TIERS)
    assert all(sum(n for *_, n in w) in TIERS for w in windows)
    first = next(w for w in windows if (0, 0, 3000) in w)
    assert (1, 0, 900) in first  # the largest rest that fits the gap of 1096
    assert sum(n for w in windows for *_, n in w) + sum(n for *_, n in rest) == 13397
    tail = cut_at_powers([(0, 0, 200), (1, 5, 13)], TIERS)
    assert [sum(n for *_, n in w) for w in tail] == [128, 64, 16, 4, 1]


def test_step_groups_hold_equal_tokens():
    sizes = [4096] * 31 + [1024] * 9 + [256] * 40
    totals = defaultdict(int)
    for size, group in zip(sizes, step_groups(sizes, 4 * 4096), strict=True):
        totals[group] += size
    assert max(totals.values()) - min(totals.values()) <= 4096
