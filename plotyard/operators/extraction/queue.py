"""Work queue: which listings need which fields, the prompt text and the payload decoding."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotyard import fixed_values as fv
from plotyard.functions import text
from plotyard.operators.extraction.fields import FIELDS, KIND, LIST_EVIDENCE, QUEUE_FLAG, exempt

DEFAULT_INSTRUCTIONS = {
    "rooms": "total rooms of one unit: bedrooms, reception rooms, living rooms and a maid room",
    "livings": "living rooms named as such",
    "wc": "bathrooms over all floors of one unit",
    "furnished": "true when stated furnished, false when stated unfurnished",
    "age": "age of the building in years, 0 when new",
    "street_width": "width of the facing street in metres",
    "driver_room": "true when a driver's room is mentioned",
}
DEFAULT_RULES = (
    "Report only what the text states, null otherwise. Quote the exact words that state each value."
)


def build_queue(listings: DataFrame, content: str = "content") -> DataFrame:
    """Listings with usable text and at least one missing field that applies to their type.

    rooms and driver_room share one flag: they are asked for wherever bedrooms are missing.
    """
    need_beds = F.col("beds").isNull() & ~exempt("rooms")
    flags = {"need_beds": need_beds}
    for field in ("livings", "wc", "furnished", "age", "street_width"):
        flags[QUEUE_FLAG[field]] = F.col(field).isNull() & ~exempt(field)
    wanted = [F.col(f) for f in flags]
    queue = listings.select(
        "id", text.normalize_content(F.col(content)).alias("clean"),
        *[c.alias(name) for name, c in flags.items()],
    )
    return queue.filter((F.length("clean") >= fv.MIN_USABLE_CHARS) & F.greatest(*wanted))


def needed_fields() -> Column:
    """Requested fields of a queue row as an array, in field order."""
    return F.array_compact(
        F.array(*[F.when(F.col(QUEUE_FLAG[f]), F.lit(f)) for f in FIELDS])
    )


def tasks(queue: DataFrame) -> DataFrame:
    """id, clean, needed - rows that ask for nothing or have too little text are left out."""
    return queue.select("id", "clean", needed_fields().alias("needed")).filter(
        (F.size("needed") > 0) & (F.length("clean") >= fv.MIN_USABLE_CHARS)
    )


def with_prompt(
    work: DataFrame, instructions: Mapping[str, str] = DEFAULT_INSTRUCTIONS
) -> DataFrame:
    """Prompt text covering exactly the needed fields, then the whole listing text."""
    lines = F.create_map(
        *[
            F.lit(part)
            for f in FIELDS
            for part in (f, f"- {f}_value / {f}_evidence: {instructions[f]}")
        ]
    )
    asked = F.array_join(F.transform("needed", lambda f: lines[f]), "\n")
    return work.withColumn(
        "prompt",
        F.concat(
            F.lit("Extract these fields:\n"), asked, F.lit("\n\nListing text:\n<<<\n"),
            F.col("clean"), F.lit("\n>>>"),
        ),
    )


def prompt_version(
    instructions: Mapping[str, str] = DEFAULT_INSTRUCTIONS, rules: str = DEFAULT_RULES
) -> str:
    """First 12 hex digits of the SHA-256 of everything the wording consists of."""
    wording = rules + "".join(f"{f}:{instructions[f]}" for f in FIELDS)
    return hashlib.sha256(wording.encode()).hexdigest()[:12]


def version_of(wording: Column) -> Column:
    """The same stamp for a text column."""
    return F.substring(F.sha2(wording, 256), 1, 12)


def _payload_schema() -> str:
    kinds = {"int": "double", "float": "double", "bool": "boolean"}
    parts = []
    for f in FIELDS:
        spans = "array<string>" if f in LIST_EVIDENCE else "string"
        parts += [f"{f}_value {kinds[KIND[f]]}", f"{f}_evidence {spans}"]
    return ", ".join([*parts, "_broken string"])


def decode_payloads(replies: DataFrame) -> DataFrame:
    """Replies (id, needed, payload JSON) to one candidate row per needed field.

    One superset schema serves every subset of fields; a reply that does not parse, or lacks a
    needed key, makes its fields ``failed``.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    parsed = replies.withColumns(
        {
            "p": F.from_json("payload", _payload_schema(), options),
            "keys": F.json_object_keys("payload"),
        }
    )
    broken = F.coalesce(F.col("p._broken").isNotNull(), F.lit(True)) | F.col("keys").isNull()
    entries = []
    for f in FIELDS:
        value, spans = F.col(f"p.{f}_value"), F.col(f"p.{f}_evidence")
        absent = ~F.array_contains("keys", f"{f}_value") | ~F.array_contains("keys", f"{f}_evidence")
        evidence = spans if f in LIST_EVIDENCE else F.when(spans.isNotNull(), F.array(spans))
        entries.append(
            F.when(
                F.array_contains("needed", f),
                F.struct(
                    F.lit(f).alias("field"),
                    value.cast("double").alias("value"),
                    F.lit(KIND[f] == "bool").alias("is_boolean"),
                    evidence.alias("evidence"),
                    F.coalesce(broken | absent, F.lit(True)).alias("failed"),
                ),
            )
        )
    return parsed.select(
        "id", F.explode(F.array_compact(F.array(*entries))).alias("c")
    ).select("id", "c.*")
