import random
from collections import defaultdict

import pyspark.sql.functions as F
import pytest

from plotyard.llm import line_dedup
from plotyard.llm.components import components
from plotyard.llm.line_dedup import duplicate_lines, within_edits, without_duplicate_lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        at = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            s.insert(at, rng.choice("abé😀"))
        elif s and kind == 1:
            s.pop(min(at, len(s) - 1))
        elif s:
            s[min(at, len(s) - 1)] = rng.choice("abé😀")
    return "".join(s)


def test_banded_distance_is_exact(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(600):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randint(3, 25)))
        b = edited(rng, a, rng.randint(0, 5))
        a, b = sorted((a, b), key=len, reverse=True)
        if len(a) - len(b) <= 2:
            pairs.append((a, b))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", *(within_edits(F.col("a"), F.col("b"), k).alias(f"k{k}") for k in (2,))).collect()
    assert len(got) > 300
    for r in got:
        assert r.k2 == (distance(r.a, r.b) <= 2), (r.a, r.b)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (22, 21)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 8: 1, 7: 1, 20: 20, 21: 20, 22: 20} | {100 + i: 100 for i in range(41)}


def brute(docs, k=2, min_chars=12):
    seen, out = [], []
    lines = sorted({x for _, t in docs for x in (t or "").split("\n") if len(x) >= min_chars})
    label, degree = {x: x for x in lines}, defaultdict(int)

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) <= k and distance(a, b) <= k:
                degree[a] += 1
                degree[b] += 1
                label[root(a)] = root(b)
    seen = {}
    for doc_id, t in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        mine = (t or "").split("\n")
        gone, firsts = [], set()
        for n, x in enumerate(mine):
            if len(x) >= min_chars:
                if root(x) in seen:
                    gone.append(n)
                    firsts.add(seen[root(x)])
                else:
                    seen[root(x)] = doc_id
        out.append((doc_id, len(mine), len(gone), gone, sum(degree[x] for x in mine), sorted(d for d in firsts if d is not None)))
    return out


@pytest.mark.parametrize("block", [line_dedup.BLOCK, 2])  # pairs as rows; blocks of lines with a segment in common
def test_documents_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(8)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(12, 40))) for _ in range(25)]
    line = lambda: edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 5]))
    docs = [(i, "\n".join(line() if rng.random() < 0.8 else rng.choice(["", "short", "\t"]) for _ in range(rng.randint(0, 9)))) for i in range(70)]
    long = "".join(rng.choice("abcde ") for _ in range(200))
    docs += [(600 + i, edited(rng, long, i % 6)) for i in range(14)]
    docs += [(500, None), (501, ""), (502, "\n\n"), (None, base[0] + "\n" + base[0]), (503, ("x" * 3000 + "\n") * 50)]
    frame = spark.createDataFrame([(i, t, 1, "q") for i, t in docs], "doc_id long, text string, line_no int, line string").repartition(4)
    got = duplicate_lines(frame, min_chars=12).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.removed, r.n_links, r.first_docs) for r in got), key=str) == sorted(brute(docs), key=str)


def test_repeated_rows_and_empty_tables(spark):
    text = "a line that is long enough to take part in this"
    got = duplicate_lines(spark.createDataFrame([(1, text)] * 3, "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in got) == [0, 1, 1]
    assert duplicate_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_short_lines_with_production_parameters(spark):
    """Copies go at every length; one edit for every ten code points, at most two; blank lines stay."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdef ") for _ in range(n)).strip() or "x" for n in (1, 2, 3, 5, 8, 9, 10, 11, 12, 15, 19, 20, 21, 22, 30, 39, 40) for _ in range(2)]
    line = lambda: edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3]))
    docs = [(i, "\n".join(line() if rng.random() < 0.8 else rng.choice(["", "  ", "\t", " " * 50]) for _ in range(rng.randint(1, 9)))) for i in range(80)]
    lines = sorted({x for _, t in docs for x in t.split("\n") if x.strip()})
    label = {x: x for x in lines}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if a and distance(a, b) <= min(2, min(len(a), len(b)) // 10):
                label[root(a)] = root(b)
    seen, want = set(), {}
    for i, t in docs:
        want[i] = []
        for n, x in enumerate(t.split("\n")):
            if x.strip():
                if root(x) in seen:
                    want[i].append(n)
                seen.add(root(x))
    got = {r.doc_id: r.removed for r in duplicate_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == want


def test_the_filter_keeps_its_columns_and_odd_rows(spark):
    line = "a line that is long enough to take part in this"
    rows = [(1, line, "x", 5), (2, line + "\nother words here", "x", 6), (None, line, None, None), (3, None, "x", 0), (4, "", "x", 0), (5, "  ", "x", 2), (2, line + "\nother words here", "x", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, plotyard_0 string, n_chars int")
    got = without_duplicate_lines(df)
    assert got.columns == df.columns
    kept = sorted(map(tuple, got.collect()), key=str)
    assert kept == sorted([(None, line, None, None), (2, "other words here", "x", 16), (3, None, "x", 0), (4, "", "x", 0), (5, "  ", "x", 2)], key=str)
    assert without_duplicate_lines(df.limit(0)).collect() == []
