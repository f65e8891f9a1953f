import random
import re

import pyspark.sql.functions as F

from plotyard.llm.personal_data import BASE_KINDS, as_text, find_personal_data, redacted

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1]))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def test_base_spans_match_the_plain_patterns(spark):
    rng = random.Random(11)
    pieces = ["a.b@c.de", "@", "x_y@z", "é", "😀", "1.2.3.4", "300.1.1.1", ".5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234567", " ", "-",
              "0", "7", "+", "\n", "_d@e.f-g", "10.0.0.255.7", "5500 0000 0000 0004", "378282246310005", "()", "..", "000.001.02.255", "99999999999"]
    docs = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))) for i in range(800)]
    docs += [(900, None), (901, ""), (None, "mail me@x.org"), (905, "1." * 2_000)]
    frame = spark.createDataFrame([(i, t, 5, "s") for i, t in docs], "doc_id long, text string, start int, spans string")
    got = find_personal_data(frame).select("text", as_text(F.col("base")).alias("s")).collect()
    assert len(got) == len(docs)
    for r in got:
        assert [x for x in r.s.split(",") if x] == brute(r.text)


def test_very_long_texts(spark):
    docs = [(0, "9" * 300_000), (1, "a" * 300_000 + "@"), (2, "a@" + "b." * 100_000 + "c"), (3, "+" + "1 " * 100_000), (4, "A1" * 100_000)]
    got = find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", as_text(F.col("base")).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {0: "", 1: "", 2: "email:0:200003", 3: "", 4: ""}


def test_validators_and_context_add_spans(spark):
    docs = [
        (1, "Konto DE89 3704 0044 0532 0130 00 IN THE bank"), (2, "GB82WEST12345698765432"), (3, "DE89370400440532013001"), (4, "ssn 123-45-6789"),
        (5, "number 123-45-6789"), (6, 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"'), (7, "call (212) 555-0199 now"), (8, "(212) 555-0199"), (9, "+1 (212) 555-0199 tel"),
    ]
    got = {r.doc_id: (r.a, r.t) for r in find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).select(
        "doc_id", as_text(F.col("added")).alias("a"), redacted(F.col("text"), F.concat("base", "added")).alias("t")).collect()}
    assert got[1] == ("iban:6:33", "Konto [iban] IN THE bank")
    assert got[2][0] == "iban:0:22" and got[3][0] == ""
    assert got[4][0] == "social:4:15" and got[5][0] == ""
    assert got[6][1] == 'token = "[secret]"'
    assert got[7][1] == "call [local_phone] now" and got[8][0] == "" and got[9] == ("", "[phone] tel")


def test_an_empty_table(spark):
    assert find_personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert BASE_KINDS == tuple(PLAIN)


def test_long_secrets_are_found_whole(spark):
    docs = [(n, "api key: " + "0a1B" * (n // 4) + ".") for n in (24, 128, 132, 256, 4096)]
    got = find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: [(s.kind, s.start, s.end) for s in r.added] for r in got} == {n: [("secret", 9, 9 + n)] for n, _ in docs}
