import random
import re

import numpy as np

from plotyard.llm import decontaminate
from plotyard.llm.decontaminate import contamination, drop_contaminated, merge_spans, query_blocks
from plotyard.llm.fmindex import FMIndex, suffix_array

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=13):
    found = {}
    for item_id, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[k : k + window]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for n in {len(x) for x in found}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in found:
                    hit |= set(range(k, k + n))
                    ids |= {i for i in found[x] if i is not None}
        out.append((doc_id, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    parts = [np.zeros(1, np.int32)]
    for n in rng.integers(1, 60, 80):
        parts += [rng.integers(1, 5, n).astype(np.int32), np.zeros(1, np.int32)]
    parts += [np.ones(200, np.int32), np.zeros(1, np.int32)] * 2
    seq = np.concatenate(parts)
    assert sorted(suffix_array(seq).tolist()) == list(range(len(seq)))
    patterns = np.zeros((60, 6), np.int64)
    lengths = rng.integers(1, 7, 60)
    for row, n in zip(patterns, lengths, strict=True):
        row[6 - n :] = rng.integers(1, 5, n)
    index = FMIndex(seq, 5)
    low, high = index.search(patterns, lengths)
    for row, n, a, b in zip(patterns, lengths, low, high, strict=True):
        want = [k for k in range(len(seq) - n + 1) if (seq[k : k + n] == row[6 - n :]).all()]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_documents_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 700)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(9)] + ["Éa", "été", "x1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([2, 3, 13, 14, 20]))) for i in range(30)] + [(7, None), (None, text(3)), (99, "... ?"), (5, text(15)), (5, text(15))]
    docs = [(i, text(rng.randint(0, 120))) for i in range(60)]
    docs += [(100 + i, text(30) + "!! " + items[i][1].upper() + ",\n" + text(200)) for i in range(30)]
    docs += [(None, items[3][1]), (1, None), (2, ""), (3, docs[0][1]), (0, docs[0][1]), (4, text(30000))]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n_words int, items int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, items), key=str)
    for block in (decontaminate.QUERY_BLOCK_CHARS, 100):
        monkeypatch.setattr(decontaminate, "query_blocks", lambda x, size=block: query_blocks(x, size))
        got = contamination(d, b).collect()
        assert sorted(((r.row.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=str) == want
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in contamination(d, empty).collect()} == {0}
    assert contamination(d.limit(0), b).collect() == []
    left = drop_contaminated(d, b)
    assert left.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(
        (x for x, (*_, bad) in zip(docs, brute(docs, items), strict=True) if not bad), key=str
    )


def test_touching_spans_become_one():
    assert merge_spans(np.array([0, 3, 9]), np.array([3, 5, 10])) == ([0, 9], [5, 10])


def test_the_filter_keeps_rows_as_they_are(spark):
    passage = " ".join(f"bench{i}" for i in range(15))
    rows = [(1, passage, "a", 1), (1, passage, "a", 1), (None, passage, None, 2), (2, "clean text", "b", 3), (2, "clean text", "b", 3), (3, None, "c", 4), (4, " ", "d", 5),
            (5, passage + " filler" * 400, "e", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_words int")
    items = spark.createDataFrame([(10, passage), (None, "clean text"), (11, None)], "item_id long, text string")
    got = drop_contaminated(df, items.limit(1))
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted(rows[3:], key=str)
    assert sorted(map(tuple, drop_contaminated(df, items).collect()), key=str) == sorted(rows[5:], key=str)  # an item without an id counts too
    assert drop_contaminated(df.limit(0), items).collect() == []
    assert drop_contaminated(df, items.limit(0)).count() == len(rows)
