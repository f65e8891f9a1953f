import hashlib
import random
import re

import numpy as np

from plotyard.llm.queries import QUERIES
from plotyard.llm.word_repeats import Seeds, Words, remove_word_repeats

SCHEMA = "spans string, text string, doc_id long, slice int"


def brute(docs, w):
    """Documents as (id, text); ids may be null, which come first."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    ids = [-(10**18) if d is None else d for d, _ in docs]
    least = {}
    for d, ws in zip(ids, words, strict=True):
        for i in range(len(ws) - w + 1):
            key = tuple(ws[i : i + w])
            least[key] = min(least.get(key, d), d)
    out = []
    for (given, _), d, ws in zip(docs, ids, words, strict=True):
        gone = [False] * len(ws)
        for i in range(len(ws) - w + 1):
            if least[tuple(ws[i : i + w])] < d:
                gone[i : i + w] = [True] * w
        spans = []
        for i, g in enumerate(gone):
            if g and i and gone[i - 1]:
                spans[-1] = (spans[-1][0], spans[-1][1] + 1)
            elif g:
                spans.append((i, 1))
        out.append((given, len(ws), sum(gone), spans, " ".join(x for x, g in zip(ws, gone, strict=True) if not g)))
    return sorted(out, key=str)


def corpus(rng):
    spaces = [" ", "  ", "\n", "\t", " \r\n", "\x0b", "\x0c"]
    vocabulary = ["a", "b", "cé", "d\x00", "d", "ẞ", "x y", " ", "e\x1cf"]  # a no-break space is part of a word
    make = lambda n: "".join(rng.choice(vocabulary) + rng.choice(spaces) for _ in range(n))
    passages = [make(rng.randint(3, 30)) for _ in range(10)]
    docs = []
    for i in range(200):
        docs.append((rng.randint(0, 250), "".join(rng.choice([make(rng.randint(0, 15)), rng.choice(passages)]) for _ in range(rng.randint(0, 7)))))
        if i % 20 == 0:
            docs += [(1000 + i, docs[-1][1])] * 3 + [(2000 + i, docs[-1][1]), docs[-1]]
    docs += [(300, None), (301, ""), (302, "  \n "), (None, docs[3][1]), (None, docs[4][1]), (-5, docs[8][1]), (303, "a " * 500), (304, "a " * 400), (305, "a b " * 90)]
    docs += [(306, make(4000) + passages[0]), (307, "w" * 30_000), (308, "long " + passages[1] + "w" * 9000)]
    return docs


def read(rows):
    return sorted(((r.doc_id, r.n_words, r.n_removed, [(s.start, s.length) for s in r.spans], r.kept) for r in rows), key=str)


def test_documents_match_brute_force(spark):
    docs = corpus(random.Random(5))
    frame = spark.createDataFrame([("x", t, d, 1) for d, t in docs], SCHEMA).repartition(4)
    for sizes in ((1 << 22, 1 << 25, 1 << 19), (300, 2_000, 50)):  # one slice a task; many slices and ranges
        for window, gram in ((5, 2), (13, 4)):
            assert read(remove_word_repeats(frame, window, gram, *sizes).collect()) == brute(docs, window)


def test_empty_tables_and_tables_without_words(spark):
    assert remove_word_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    frame = spark.createDataFrame([("x", None, None, 1), ("x", "", 2, 1), ("x", "one", 2, 1)], SCHEMA)
    assert read(remove_word_repeats(frame).collect()) == brute([(None, None), (2, ""), (2, "one")], 13)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(6)
    text = " ".join(rng.choice("abc") for _ in range(3000)).encode()
    seeds = Seeds(Words([text, text[1:], b"q " + text]), 13, 4)
    by_window = {}
    words = [t.split() for t in (text, text[1:], b"q " + text)]
    for at, doc, anchor in zip(seeds.at.tolist(), seeds.doc.tolist(), seeds.anchors.tolist(), strict=True):
        start = at - int(seeds.words.first[doc])
        assert by_window.setdefault(tuple(words[doc][start : start + 13]), anchor) == anchor
    assert len(seeds.at) == sum(len(w) - 12 for w in words)
    turns = np.flatnonzero(np.diff(seeds.anchors))
    assert len(turns) < len(seeds.at) / 3  # a seed stands for several windows


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = QUERIES["op12_word_repeats"](spark, "/root/testdata/sf0.01").collect()
    want = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, _, kept in brute(docs, 13)]
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == sorted(want)
    assert sum(w[2] > 0 for w in want) > 20
