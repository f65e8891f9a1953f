import random

import numpy as np

from plotyard.llm import shingle_join
from plotyard.llm.shingle_join import Forest, near_duplicates, one_per_class, prefix_depth, shingles, similar_pairs


def sets_of(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [sets_of(t) for _, t in docs]
    links, label = [0] * len(docs), list(range(len(docs)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                label[root(i)] = root(j)
    ids = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            ids[root(k)] = min(ids.get(root(k), d), d)
    return sorted(((d, ids.get(root(k), None) if sets[k] else d, links[k]) for k, (d, _) in enumerate(docs)), key=str)


def corpus(rng):
    word = lambda: f"w{rng.randrange(400)}"
    docs = []
    for base in range(12):
        text = [word() for _ in range(rng.randint(30, 150))]
        for _ in range(rng.choice([1, 2, 6, 25])):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = [word()] * rng.choice([0, 1])
            docs.append((len(docs) * 3 + base, " ".join(copy)))
    docs += [(900, None), (901, ""), (902, "A b"), (903, "a B"), (904, "a b c"), (None, docs[0][1]), (905, " \n"), (906, "x " * 5000), (907, "x " * 900)]
    return docs


def test_links_and_classes_match_brute_force(spark, monkeypatch):
    docs = corpus(random.Random(9))
    frame = spark.createDataFrame([(d, t, "c", 1) for d, t in docs], "doc_id long, text string, class_id string, rep int").repartition(5)
    want = brute(docs)
    got = near_duplicates(frame).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == want
    monkeypatch.setattr(shingle_join, "BLOCK", 4)  # large groups are cut into many block pairs
    got = near_duplicates(frame).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == want


def test_an_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_prefixes_are_shortened_to_the_target():
    assert prefix_depth(0.8) == 7 and prefix_depth(0.8, trees=5) < prefix_depth(0.95, trees=5)
    rng = np.random.default_rng(0)
    forest, met = Forest(40, 7), 0
    for _ in range(60):
        both = rng.integers(0, 1 << 63, 160, dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, 20, dtype=np.uint64)]) for _ in range(2))
        met += bool((forest.nodes(a) == forest.nodes(b)).any())
    assert met == 60


def test_both_ways_of_verifying_agree(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50, dtype=np.uint64)) for _ in range(40)] + [shingles("a b c d e f g")]
    pairs = np.argwhere(np.ones((41, 41), dtype=bool))
    packed = similar_pairs(sets, sets, pairs, 2, 5)
    monkeypatch.setattr(shingle_join, "PACKED_BYTES", 0)
    assert np.array_equal(packed, similar_pairs(sets, sets, pairs, 2, 5)) and len(packed) > 41


def test_one_row_of_each_class_stays(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words[:-1] + ["other"])
    rows = [(5, " ".join(words), "a", "x"), (3, near, "b", "y"), (3, near, "b", "y"), (None, near, None, None), (8, None, "c", "z"), (8, None, "c", "z"), (9, " ", "d", "z"), (1, "alone here", "e", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, plotyard_0 string, class string")
    got = one_per_class(df)
    assert got.columns == df.columns
    want = [(None, near, None, None), (8, None, "c", "z"), (8, None, "c", "z"), (9, " ", "d", "z"), (1, "alone here", "e", "z")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert one_per_class(df.limit(0)).collect() == []
