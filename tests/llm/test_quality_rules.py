import random
import re
from math import comb

import pyspark.sql.functions as F

from plotyard.llm.quality_rules import RULES, binomial_tail, choose_cutoffs, judge, measures


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows, covered = {}, set()
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in windows.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_match_brute_force(spark):
    rng = random.Random(2)
    make = lambda n, v: "".join(f"w{rng.randrange(v)}" + rng.choice([" ", " ", "\n", "\t", "\x0b", "  ", " # ", "\x1c"]) for _ in range(n))
    docs = [(i, make(rng.randint(0, 90), rng.choice([1, 2, 5, 50]))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "  \n \n"), (503, "a b c d e f g h " * 3000), (504, "x\ny\nx\n😀 😀\n x"), (None, "n")]
    frame = spark.createDataFrame([(i, t, None, 1, "q") for i, t in docs], "doc_id long, text string, lang string, n_words int, stratum string")
    got = {r.doc_id: tuple(r)[2:8] for r in measures(frame).collect()}
    assert got == {i: brute(t) for i, t in docs}


def test_the_tail_is_exact(spark):
    cases = [(n, k) for n in (1, 7, 60, 900) for k in (0, 1, 3, 5) if k <= n]
    frame = spark.createDataFrame(cases, "n long, k long")
    for r in frame.select("n", "k", binomial_tail(F.col("n"), F.col("k"), 0.02).alias("p")).collect():
        want = sum(comb(r.n, i) * 0.02**i * 0.98 ** (r.n - i) for i in range(r.k + 1)) if r.k < 0.02 * r.n else 1.0
        assert abs(r.p - want) < 1e-9
    big = spark.createDataFrame([(200_000, 900)], "n long, k long").select(binomial_tail(F.col("n"), F.col("k"), 0.005).alias("p")).first()
    assert 0 < big.p < 0.001


def test_cutoffs_hold_and_verdicts_follow(spark):
    good = "The words of a plain text number {} go on and on, as a story of many small things would do when it is told again {}."
    rows = [(i, good.format(i, i * 7), "en", 0) for i in range(6000)]
    rows += [(10_000 + i, " | ".join(f"c{i}{k}" for k in range(60)), "en", 0) for i in range(50)]
    rows += [(20_000 + i, good.format(i, i), "xx", 0) for i in range(30)] + [(30_000, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6000)] + [(10_001, 0, 0), (10_002, None, 1), (None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    cut = {r.stratum: r for r in choose_cutoffs(measures(docs), labels).collect()}
    assert set(cut) == {"en"} and cut["en"].n_good == 6000 and cut["en"].cut_symbols == RULES["symbols"][2][-1]
    got = {r.doc_id: (r.base_failed, r.kept) for r in judge(docs, labels).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (False, True) for i in range(6000)) and all(got[20_000 + i] == (False, True) for i in range(30))
    assert all(got[10_000 + i] == (False, False) for i in range(50)) and got[30_000] == (True, False)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert judge(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "a " * 30, "en")], "doc_id long, text string, lang string")
    assert judge(one, labels).first().kept is False


def test_capitals_that_stand_apart_count(spark):
    docs = [(1, "B U Y N O W"), (2, "aBaBaB cDcD"), (3, "none here"), (4, "One")]
    frame = spark.createDataFrame([(i, t, None, 1, "q") for i, t in docs], "doc_id long, text string, lang string, n_words int, stratum string")
    got = {r.doc_id: r.capital_ratio for r in measures(frame).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.0, 4: 1 / 3}
