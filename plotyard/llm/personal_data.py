"""Personal data in texts, as Spark SQL expressions only.

Patterns propose spans; validators confirm them (Luhn for cards, mod-97 for bank accounts, ranges for addresses and
numbers); words near a span adjust its score. A span stands if its score reaches ``ACCEPT``. The base kinds e-mail,
address, card and phone stand by their pattern and validator alone.

Patterns are written so that no text makes them backtrack: quantifiers are possessive, and a match may start inside a
run only where the previous match ended. They give the leftmost non-overlapping matches of the plain patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotyard.llm.columns import let, match_spans

ACCEPT = 0.5
CONTEXT_BEFORE, CONTEXT_AFTER = 40, 20  # code points around a span that are searched for context words

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9])[A-Za-z0-9]{24,}+(?![A-Za-z0-9])"

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kind: pattern, score of a proposed span, of a confirmed one in addition, of context in addition, context words.
KINDS = {
    "email": (EMAIL, 0.7, 0.0, 0.2, "mail|e-mail|contact|write"),
    "ip": (IP, 0.2, 0.4, 0.2, "ip|address|host|server|login"),
    "card": (CARD, 0.1, 0.6, 0.2, "card|visa|credit|karte|carte|tarjeta|payment"),
    "phone": (PHONE, 0.2, 0.4, 0.2, "phone|tel|call|mobile|fax|telefon"),
    "iban": (IBAN, 0.1, 0.6, 0.2, "iban|account|konto|compte|cuenta|bank"),
    "social": (SOCIAL, 0.2, 0.1, 0.4, "ssn|social security|tax id"),
    "local_phone": (LOCAL_PHONE, 0.3, 0.0, 0.4, "phone|tel|call|mobile|fax|telefon"),
    "secret": (SECRET, 0.2, 0.1, 0.4, "token|secret|password|passwd|api.?key|access.?key|bearer"),
}
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of ``text`` pass the Luhn checksum."""
    doubled = F.transform(
        F.reverse(F.split(digits(text), "")),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d > "4", 9).otherwise(0)),
    )
    return F.aggregate(doubled, F.lit(0), lambda acc, d: acc + d) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether a bank account number without blanks has remainder 1."""
    turned = F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4))
    value = lambda acc, c: F.when(c.between("0", "9"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: value(acc, c) % 97) == 1


def _part_fits(part: Column) -> Column:
    return let(F.regexp_replace(part, "^0+", ""), lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def confirmed(kind: str, match: Column) -> Column:
    """What the kind's validator says of a proposed span."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), _part_fits)
    if kind == "card":
        return luhn(match)
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, " ", ""))
    if kind == "social":
        return ~match.rlike("^(?:000|666|9)|-00-|0000$")
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def kind_spans(text: Column, kind: str) -> Column:
    """Spans of one kind whose score reaches ``ACCEPT``, in order of position."""
    pattern, prior, bonus, context_bonus, words = KINDS[kind]
    near = rf"(?i)(?<![a-z])(?:{words})(?![a-z])"

    def scored(s: Column) -> Column:
        begin = F.greatest(s["start"] - CONTEXT_BEFORE, F.lit(0))
        around = F.concat_ws(
            "\n", F.substring(text, begin + 1, s["start"] - begin), F.substring(text, s["end"] + 1, F.lit(CONTEXT_AFTER))
        )
        score = F.lit(prior) + F.when(confirmed(kind, s["match"]), bonus).otherwise(0.0)
        if kind in BASE_KINDS:
            score = F.when(confirmed(kind, s["match"]), score + F.when(around.rlike(near), context_bonus).otherwise(0.0)).otherwise(0.0)
        else:
            score = score + F.when(around.rlike(near), context_bonus).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(score, 2).alias("score"))

    found = match_spans(text, pattern)
    if kind == "iban":  # capital words after a grouped number are no part of it
        found = F.transform(found, _without_words)
    return F.filter(F.transform(found, scored), lambda s: s["score"] >= ACCEPT)


def _without_words(s: Column) -> Column:
    kept = F.regexp_replace(s["match"], r"(?:\x20[A-Z]+)+$", "")
    cut = F.struct(s["start"].alias("start"), (s["start"] + F.length(kept)).alias("end"), kept.alias("match"))
    return F.when(mod97(F.regexp_replace(s["match"], " ", "")), s).otherwise(cut)


def find_personal_data(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``base`` and ``added``: spans of the base kinds and of the others, as ``SPANS``.

    ``documents`` needs ``doc_id`` and ``text``; other columns are ignored. A null text is an empty one and has no spans.
    Positions are code points, end exclusive. Spans of one kind never overlap; an added span never overlaps a base one.
    Repeated rows are each searched; an empty table gives no rows.
    """
    text = F.col("text")
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = F.concat(*(kind_spans(text, k) for k in BASE_KINDS))
    more = F.concat(*(kind_spans(text, k) for k in KINDS if k not in BASE_KINDS))
    both = let(base, lambda b: F.struct(b.alias("base"), F.filter(more, lambda s: ~F.exists(b, lambda x: _overlap(s, x))).alias("added")))
    return docs.select("doc_id", "text", both.alias("found")).select("doc_id", "text", "found.base", "found.added")


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; where spans overlap, the earlier one names it."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.aggregate(by_start, start, add, done)


def as_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
