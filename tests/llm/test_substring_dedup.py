import random
from collections import Counter

import numpy as np

from plotyard.llm import substring_dedup
from plotyard.llm.substring_dedup import remove_repeats, repeated_windows
from plotyard.llm.suffix_array import permuted_prefixes, suffix_array


def brute(docs, w):
    seen = Counter(t[i : i + w] for _, t in docs for i in range(len(t) - w + 1))
    out = []
    for d, t in docs:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - w + 1):
            if seen[t[i : i + w]] > 1:
                gone[i : i + w] = True
        spans = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]]))) if len(t) else 0
        out.append((d, len(t), int(gone.sum()), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out, key=str)


def corpus(rng):
    make = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [make(rng.randint(15, 90)) for _ in range(8)]
    docs = []
    for i in range(150):
        text = "".join(rng.choice([make(rng.randint(0, 40)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 9) :]]) for _ in range(rng.randint(0, 6)))
        docs.append((i, text))
    docs += [(300, None), (301, ""), (None, docs[3][1]), (4, docs[4][1]), (302, "a" * 300), (303, "ab" * 200), (304, "ab" * 9 + "c"), (305, make(3000) + passages[0])]
    return docs


def test_documents_match_brute_force(spark, monkeypatch):
    docs = corpus(random.Random(3))
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_bytes int, anchor string").repartition(4)
    want = brute([(d, (t or "").encode()) for d, t in docs], 24)
    read = lambda rows: sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows), key=str)
    assert read(remove_repeats(frame, window=24, gram=8).collect()) == want
    monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", 3)  # large groups are split over shards
    monkeypatch.setattr(substring_dedup, "CHUNK", 500)
    assert read(remove_repeats(frame, window=24, gram=8).collect()) == want


def test_an_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_suffix_array_and_prefixes_match_sorting():
    rng = np.random.default_rng(4)
    for _ in range(150):
        body = rng.integers(1, rng.integers(2, 5), rng.integers(1, 60)) if rng.random() < 0.6 else np.tile(rng.integers(1, 4, rng.integers(1, 5)), rng.integers(1, 15))
        text = np.concatenate([body, [0]])
        want = sorted(range(len(text)), key=lambda i: text[i:].tolist())  # noqa: B023
        for sigma in (8, 5000):  # by bucket, by scan
            assert suffix_array(text, sigma).tolist() == want
        before, common = permuted_prefixes(text, np.array(want), np.arange(len(text)), 100)
        for i, p, c in zip(range(len(text)), before, common, strict=True):
            assert p == (want[want.index(i) - 1] if want[0] != i else -1)
            if p >= 0:
                n = min(len(text) - i, len(text) - p)
                same = text[i : i + n] == text[p : p + n]
                assert c == (n if same.all() else int(same.argmin()))


def test_windows_of_several_strings():
    got = repeated_windows([b"abcdefgh", b"xxcdefgyy", b"zzz", b"aaaaaaa"], 4)
    assert [x.tolist() for x in got] == [[2, 3], [2, 3], [], [0, 1, 2, 3]]
