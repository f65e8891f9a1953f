"""Structural nulls and the extraction pipeline: queue, verification, merge, evaluation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from driver_queries import tables as T
from driver_queries.registry import WITH_L, query
from plotyard import fixed_values as fv
from plotyard.operators import joins, sampling, structural
from plotyard.operators.extraction import evaluate, merge, queue, run, verify
from plotyard.operators.extraction.fields import CHECKPOINT_SCHEMA, FIELDS
from plotyard.session import scratch_path
from plotyard.sources import io
from plotyard.sources.io import read_checkpoint, union_by_name

# --- I: structural nulls -------------------------------------------------------------------

_EXEMPT = {
    f: "(" + ", ".join(f"'{t}'" for t in structural.exempt_types(fv.ZERO_FILL_EXEMPTIONS, f)) + ")"
    for f in fv.ZERO_FILL_FIELDS
}
_ZERO_SQL = (
    "z AS (SELECT id, estate_type, street_width, "
    + ", ".join(
        f"CASE WHEN estate_type IN {x} THEN coalesce({f}, 0) ELSE {f} END AS {f}, estate_type IN {x} AS {f}_na"
        for f, x in _EXEMPT.items()
    )
    + " FROM l)"
)
_EXTEND_SQL = (
    "x AS (SELECT * REPLACE (CASE WHEN estate_type IN ('building', 'store', 'room', 'office') THEN coalesce(beds, 0) ELSE beds "
    "END AS beds, beds_na OR estate_type IN ('building', 'store', 'room', 'office') AS beds_na, CASE WHEN estate_type IN "
    "('apartment', 'floor') THEN coalesce(street_width, 0) ELSE street_width END AS street_width), estate_type IN "
    "('apartment', 'floor') AS street_width_na FROM z)"
)


def _base(spark, sf):
    return T.listings(spark, sf).select(
        "id", "estate_type", "beds", "livings", "wc", "age", "furnished", "street_width"
    )


@query("I1_zero_fill", f"{WITH_L}, {_ZERO_SQL} SELECT * FROM z")
def _(spark, sf):
    return structural.zero_fill(_base(spark, sf))


@query("I2_extend_exemptions", f"{WITH_L}, {_ZERO_SQL}, {_EXTEND_SQL} SELECT * FROM x")
def _(spark, sf):
    return structural.extend_exemptions(structural.zero_fill(_base(spark, sf)))


@query(
    "H21_rooms",
    f"{WITH_L}, {_ZERO_SQL} SELECT id, beds + livings AS rooms, beds_na AND livings_na AS rooms_na FROM z",
)
def _(spark, sf):
    return structural.add_rooms(structural.zero_fill(_base(spark, sf))).select("id", "rooms", "rooms_na")


# Extracted room totals: one per listing, of varying status.
ROOMS = (
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 2 + o_orderkey % 9 END AS rooms_value, "
    "CASE WHEN o_orderkey % 3 = 0 THEN 'accepted' WHEN o_orderkey % 3 = 1 THEN 'accepted_fuzzy' ELSE 'rejected_ungrounded' "
    "END AS rooms_status FROM orders"
)
_ROOMS_SQL = (
    f"{WITH_L}, {_ZERO_SQL}, {_EXTEND_SQL}, r AS ({ROOMS}), f AS (SELECT x.*, CAST(coalesce(beds + livings, CASE WHEN "
    "rooms_status LIKE 'accepted%' THEN rooms_value END) AS INT) AS rooms, beds_na AND livings_na AS rooms_na FROM x LEFT JOIN r USING (id))"
)


def _recovered(spark, sf):
    ready = structural.extend_exemptions(structural.zero_fill(_base(spark, sf)))
    T.load(spark, sf, "orders")
    return structural.fill_rooms_from_extractions(structural.add_rooms(ready), spark.sql(ROOMS))


@query("I3_rooms_from_extractions", f"{_ROOMS_SQL} SELECT id, rooms, rooms_na FROM f")
def _(spark, sf):
    return _recovered(spark, sf).select("id", "rooms", "rooms_na")


@query("C4_left_merge_rooms", f"{_ROOMS_SQL} SELECT estate_type, count(rooms) AS known, sum(rooms)::BIGINT AS rooms FROM f GROUP BY 1")
def _(spark, sf):
    return _recovered(spark, sf).groupBy("estate_type").agg(
        F.count("rooms").alias("known"), F.sum("rooms").alias("rooms")
    )


@query("I4_drop_incomplete", f"{_ROOMS_SQL} SELECT id FROM f WHERE livings IS NOT NULL AND wc IS NOT NULL")
def _(spark, sf):
    return structural.drop_incomplete(_recovered(spark, sf)).select("id")


@query(
    "I5_model_ready",
    f"{_ROOMS_SQL} SELECT id, estate_type, CASE WHEN estate_type = 'warehouse' THEN coalesce(beds, 0) ELSE beds END AS beds, "
    "livings, wc, age, furnished, CASE WHEN estate_type = 'campsite' THEN coalesce(street_width, 0) ELSE street_width END AS "
    "street_width, beds_na OR estate_type = 'warehouse' AS beds_na, livings_na, wc_na, age_na, furnished_na, street_width_na OR "
    "estate_type = 'campsite' AS street_width_na, rooms, rooms_na FROM f WHERE livings IS NOT NULL AND wc IS NOT NULL",
)
def _(spark, sf):
    T.load(spark, sf, "orders")
    return structural.model_ready(_base(spark, sf), spark.sql(ROOMS))


_CATEGORIES = ", ".join(f"({c}, '{t}', '{b}')" for c, t, b in fv.CATEGORY_ROWS)
_PREPARED_SQL = (
    f"WITH l0 AS MATERIALIZED ({T.LISTINGS}), l AS (SELECT l0.* REPLACE (c.estate_type AS estate_type, c.estate_benefit AS estate_benefit, "
    f"CASE WHEN street_width > 0 THEN street_width END AS street_width) FROM l0 LEFT JOIN (VALUES {_CATEGORIES}) AS c(category, estate_type, "
    f"estate_benefit) USING (category)), {_ZERO_SQL}, {_EXTEND_SQL}, p AS (SELECT l.estate_benefit, l.area, l.price, x.* REPLACE (CASE WHEN "
    "x.estate_type = 'warehouse' THEN coalesce(x.beds, 0) ELSE x.beds END AS beds, CASE WHEN x.estate_type = 'campsite' THEN "
    "coalesce(x.street_width, 0) ELSE x.street_width END AS street_width) FROM x JOIN l USING (id))"
)


@query(
    "P1_prepared_tables",
    f"{_PREPARED_SQL} SELECT estate_benefit AS purpose, estate_type, count(*) AS listings, sum(beds)::BIGINT AS bedrooms, sum(livings)::BIGINT AS "
    "living_rooms, sum((furnished = 1)::INT)::BIGINT AS furnished, round(sum(street_width), 3) AS street_width, sum(age)::BIGINT AS age FROM p WHERE "
    "livings IS NOT NULL AND wc IS NOT NULL AND estate_type IS NOT NULL AND area IS NOT NULL AND beds IS NOT NULL AND street_width IS NOT NULL AND "
    "age IS NOT NULL AND furnished IS NOT NULL GROUP BY ALL",
)
def _(spark, sf):
    from plotyard.plans import preparation

    folder, raw = scratch_path(spark, "prepared"), T.listings(spark, sf).drop("estate_type", "estate_benefit", *fv.AMENITY_FLAGS)
    raw = raw.withColumnsRenamed({"lat": "location.lat", "lng": "location.lng"}).withColumn("uri", F.lit("x"))
    early, late = F.col("id") % 2 == 0, F.col("id") % 2 == 1
    raw.filter(early).drop("uri").write.parquet(f"{folder}/raw/a")  # parts of a scrape differ in their columns
    raw.filter(late).write.parquet(f"{folder}/raw/b")
    preparation.prepare_listings(spark, [f"{folder}/raw/a", f"{folder}/raw/b"], folder)
    none = spark.createDataFrame([], "id long, rooms_value long, rooms_status string")
    parts = []
    for purpose, part in zip(("sell", "rental"), preparation.finish_listings(spark, folder, none)):
        sums = [("bedrooms", "bedrooms"), ("living_rooms", "living_rooms"), ("is_furnished", "furnished"), ("age_years", "age")]
        parts.append(
            part.groupBy("estate_type").agg(
                F.count(F.lit(1)).alias("listings"), *[F.sum(c).cast("long").alias(n) for c, n in sums], F.round(F.sum("street_width_m"), 3).alias("street_width")
            ).withColumn("purpose", F.lit(purpose))
        )
    return parts[0].unionByName(parts[1])


# --- J, H14-H18: extraction ------------------------------------------------------------------

_NEED = {
    "need_beds": ("beds", "rooms"), "need_livings": ("livings", "livings"), "need_wc": ("wc", "wc"),
    "need_furnished": ("furnished", "furnished"), "need_age": ("age", "age"),
    "need_street_width": ("street_width", "street_width"),
}


def _exempt_sql(field: str) -> str:
    kinds = [k for k, fields in fv.EXTRACTION_EXEMPTIONS.items() if field in fields]
    return "(" + ", ".join(f"'{k}'" for k in kinds) + ")"


_QUEUE_SQL = (
    "q AS (SELECT id, content AS clean, "
    + ", ".join(
        f"{c} IS NULL AND estate_type NOT IN {_exempt_sql(f)} AS {n}" for n, (c, f) in _NEED.items()
    )
    + " FROM l)"
)
_ANY = " OR ".join(_NEED)


@query(
    "J1_work_queue",
    f"{WITH_L}, {_QUEUE_SQL} SELECT * FROM q WHERE ({_ANY}) AND length(clean) >= 10",
)
def _(spark, sf):
    return queue.build_queue(T.listings(spark, sf))


_NEEDED_SQL = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {row[4]} THEN '{row[0]}' END" for row in fv.EXTRACTION_FIELDS
) + ")"


@query(
    "H25_needed_fields",
    f"{WITH_L}, {_QUEUE_SQL} SELECT id, {_NEEDED_SQL} AS needed FROM q WHERE ({_ANY}) AND length(clean) >= 10",
)
def _(spark, sf):
    work = queue.tasks(queue.build_queue(T.listings(spark, sf)))
    return work.select("id", F.array_join("needed", ",").alias("needed"))


_ASK = " || chr(10) || ".join(
    ["'Extract these fields:'", "rtrim(concat(" + ", ".join(
        f"CASE WHEN {row[4]} THEN '- {row[0]}_value / {row[0]}_evidence: "
        + queue.DEFAULT_INSTRUCTIONS[row[0]].replace("'", "''") + "' || chr(10) ELSE '' END"
        for row in fv.EXTRACTION_FIELDS
    ) + "), chr(10))", "''", "'Listing text:'", "'<<<'", "clean", "'>>>'"]
)


@query(
    "H17_prompt_text",
    f"{WITH_L}, {_QUEUE_SQL} SELECT id, substr(sha256({_ASK}), 1, 12) AS stamp FROM q WHERE ({_ANY}) AND length(clean) >= 10",
)
def _(spark, sf):
    work = queue.with_prompt(queue.tasks(queue.build_queue(T.listings(spark, sf))))
    return work.select("id", queue.version_of(F.col("prompt")).alias("stamp"))


_WS = r"'[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'"
_C_SQL = (
    f"c AS MATERIALIZED (SELECT *, trim(regexp_replace(clean, {_WS}, ' ', 'g')) AS hay, "
    f"trim(regexp_replace(evidence, {_WS}, ' ', 'g')) AS span FROM ({T.CANDIDATES}))"
)
_STATUS_SQL = (
    "v AS (SELECT *, CASE WHEN value IS NULL THEN 'null_not_mentioned' WHEN evidence IS NULL THEN 'rejected_schema_invalid' "
    "WHEN NOT value BETWEEN 0 AND 10 THEN 'rejected_out_of_range' WHEN length(span) >= 2 AND contains(hay, span) THEN 'accepted' "
    "ELSE 'rejected_ungrounded' END AS status FROM c)"
)


def _candidates(spark, sf):
    proposed = T.candidates(spark, sf)
    return proposed.withColumns(
        {
            "is_boolean": F.lit(False),
            "evidence": F.when(F.col("evidence").isNotNull(), F.array("evidence")),
        }
    )


@query(
    "H14_grounding",
    f"WITH {_C_SQL} SELECT id, length(span) >= 2 AND contains(hay, span) AS grounded FROM c WHERE evidence IS NOT NULL",
)
def _(spark, sf):
    spans = _candidates(spark, sf).filter(F.col("evidence").isNotNull())
    judged = verify.verify(spans.withColumn("value", F.lit(1.0)))
    return judged.select("id", F.col("status").startswith("accepted").alias("grounded"))


@query(
    "H15_range_check",
    f"WITH {_C_SQL} SELECT id, coalesce(value BETWEEN 0 AND 10, false) AS fits FROM c",
)
def _(spark, sf):
    from plotyard.operators.extraction.fields import in_range

    fits = in_range(F.col("field"), F.col("value"), F.col("is_boolean"))
    return _candidates(spark, sf).select("id", fits.alias("fits"))


@query(
    "J4_verify_outcomes",
    f"WITH {_C_SQL}, {_STATUS_SQL} SELECT id, field, status, CASE WHEN status = 'accepted' THEN value END AS value, CASE WHEN "
    "status NOT IN ('null_not_mentioned', 'rejected_schema_invalid') THEN evidence END AS evidence FROM v",
)
def _(spark, sf):
    return verify.verify(_candidates(spark, sf)).select("id", "field", "status", "value", "evidence")


@query(
    "H16_status_counts",
    f"WITH {_C_SQL}, {_STATUS_SQL} SELECT estate_type, status, count(*) AS n FROM v GROUP BY 1, 2",
)
def _(spark, sf):
    return verify.verify(_candidates(spark, sf)).groupBy("estate_type", "status").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "H26_joined_evidence",
    f"WITH {_C_SQL} SELECT id, evidence || ' | ' || field AS recorded FROM c WHERE evidence IS NOT NULL",
)
def _(spark, sf):
    rows = _candidates(spark, sf).filter(F.col("evidence").isNotNull())
    spans = F.concat("evidence", F.array("field"))
    return rows.select("id", F.array_join(spans, fv.EVIDENCE_SEPARATOR).alias("recorded"))


# Replies of a model, written as JSON from the candidates; some are broken or lack a key.
_PAYLOAD = (
    "CASE WHEN id % 25 = 7 THEN '{\"wc_value\": ' WHEN id % 25 = 9 THEN '{\"wc_value\": 3}' ELSE concat('{\"wc_value\": ', "
    "coalesce(CAST(CAST(value AS BIGINT) AS VARCHAR(9)), 'null'), ', \"wc_evidence\": ', CASE WHEN evidence IS NULL THEN 'null' "
    "ELSE concat('\"', evidence, '\"') END, '}') END"
)


@query(
    "H18_decode_payloads",
    f"WITH {_C_SQL} SELECT id, 'wc' AS field, id % 25 IN (7, 9) AS failed, CASE WHEN id % 25 IN (7, 9) THEN NULL ELSE value END "
    "AS value, CASE WHEN id % 25 IN (7, 9) THEN NULL ELSE evidence END AS evidence FROM c",
)
def _(spark, sf):
    T.candidates(spark, sf).createOrReplaceTempView("candidates_view")
    replies = spark.sql(f"SELECT id, array('wc') AS needed, {_PAYLOAD} AS payload FROM candidates_view")
    decoded = queue.decode_payloads(replies)
    return decoded.select(
        "id", "field", "failed", F.when(~F.col("failed"), F.col("value")).alias("value"),
        F.when(~F.col("failed"), F.array_join("evidence", fv.EVIDENCE_SEPARATOR)).alias("evidence"),
    )


def stub_extractor(frame: pd.DataFrame) -> pd.DataFrame:
    """Deterministic stand-in for a model: quotes the first two words and reports their length."""
    rows = []
    for row in frame.itertuples(index=False):
        words = row.clean.split()
        for name in row.needed:
            rows.append(
                {
                    "id": row.id, "field": name, "value": float(len(words[0]) % 5) if words else None,
                    "is_boolean": name in ("furnished", "driver_room"),
                    "evidence": [" ".join(words[:2])] if words else None, "failed": False,
                    "attempt_count": 1, "latency_ms": 0,
                }
            )
    return pd.DataFrame(rows)


def _wide(spark, sf):
    judged = verify.verify(_candidates(spark, sf)).withColumns(
        {
            "model_name": F.lit("stub"), "prompt_version": F.lit("v1"),
            "extracted_at": F.lit("2024-01-01").cast("timestamp"),
            "attempt_count": F.lit(1).cast("long"), "latency_ms": F.lit(0).cast("long"),
        }
    )
    return verify.to_wide(judged)


@query(
    "J5_wide_checkpoint",
    f"WITH {_C_SQL}, {_STATUS_SQL} SELECT id, CASE WHEN status = 'accepted' THEN CAST(value AS BIGINT) END AS wc_value, status AS "
    "wc_status, NULL::VARCHAR AS age_status FROM v",
)
def _(spark, sf):
    return _wide(spark, sf).select("id", "wc_value", "wc_status", "age_status")


_DOC_LISTINGS = (
    "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'apartment' WHEN doc_id % 3 = 1 THEN 'villa' ELSE 'land' END AS estate_type, "
    "CASE WHEN doc_id % 4 = 0 THEN 2 END AS wc, CAST(NULL AS INT) AS livings, CAST(NULL AS INT) AS age, CAST(NULL AS INT) AS "
    "furnished, CAST(NULL AS DOUBLE) AS street_width, text AS content FROM documents"
)


def _doc_listings(spark, sf):
    T.load(spark, sf, "documents")
    return spark.sql(_DOC_LISTINGS)


_MERGE_SQL = (
    f"WITH {_C_SQL}, {_STATUS_SQL}, s AS ({_DOC_LISTINGS}), m AS (SELECT s.id, s.estate_type, s.wc AS was, v.status, v.value, "
    "s.wc IS NULL AND v.status = 'accepted' AS usable FROM s LEFT JOIN v USING (id)), a AS (SELECT *, usable AND estate_type = "
    "'apartment' AS fill FROM m), o AS (SELECT id, estate_type, CASE WHEN fill THEN CAST(value AS INT) ELSE was END AS wc, CASE WHEN usable AND NOT fill THEN "
    "'needs_human_review' WHEN fill THEN 'llm_filled' WHEN was IS NULL AND status IS NOT NULL THEN 'llm_' || status WHEN was IS NULL "
    "AND estate_type = 'land' THEN 'not_attempted_structural_exempt' WHEN was IS NOT NULL THEN 'original' ELSE 'not_attempted' END AS "
    "wc_extraction_status, CASE WHEN estate_type = 'land' THEN 'not_attempted_structural_exempt' ELSE 'not_attempted' END AS "
    "age_extraction_status FROM a)"
)


@query("J6_merge_with_gates", f"{_MERGE_SQL} SELECT id, wc, wc_extraction_status FROM o")
def _(spark, sf):
    merged = merge.apply_extractions(_doc_listings(spark, sf), merge.latest(_wide(spark, sf)), ["wc"])
    return merged.select("id", "wc", "wc_extraction_status")


@query(
    "J7_audit_status",
    f"{_MERGE_SQL} SELECT estate_type, wc_extraction_status, age_extraction_status, count(*) AS n FROM o GROUP BY 1, 2, 3",
)
def _(spark, sf):
    merged = merge.apply_extractions(_doc_listings(spark, sf), merge.latest(_wide(spark, sf)), ["wc"])
    return merged.groupBy("estate_type", "wc_extraction_status", "age_extraction_status").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "C5_status_lookup",
    f"WITH {_C_SQL}, {_STATUS_SQL}, s AS ({_DOC_LISTINGS}) SELECT s.id, v.status AS wc_status FROM s LEFT JOIN v USING (id)",
)
def _(spark, sf):
    wide = merge.latest(_wide(spark, sf)).select("id", "wc_status")
    return _doc_listings(spark, sf).select("id").join(wide, "id", "left")


@query("J8_guarded_merge", f"{_MERGE_SQL} SELECT count(*) AS n, count(wc) AS known FROM o")
def _(spark, sf):
    target = scratch_path(spark, "merged")
    merge.merge_to_table(_doc_listings(spark, sf), _wide(spark, sf), ["wc"], target)
    return io.read_table(spark, target).agg(F.count(F.lit(1)).alias("n"), F.count("wc").alias("known"))


@query(
    "J9_ground_truth",
    f"WITH s AS ({_DOC_LISTINGS}) SELECT id, wc FROM s WHERE wc IS NOT NULL AND estate_type <> 'land' AND length(content) >= 10",
)
def _(spark, sf):
    rows = _doc_listings(spark, sf).withColumn("clean", F.col("content"))
    return evaluate.eligible(rows, "wc").select("id", "wc")


_REQUESTED = ", ".join(
    f"CASE WHEN {row[4]} THEN '{'rejected_out_of_range' if row[0] == 'street_width' else 'accepted'}' END AS {row[0]}_status"
    for row in fv.EXTRACTION_FIELDS
)
_EXTRACTED = f"{WITH_L}, {_QUEUE_SQL} SELECT count(*) AS extracted, count(DISTINCT id) AS listings FROM q WHERE ({_ANY}) AND length(clean) >= 10"


@query("J2_extraction_run", f"{WITH_L}, {_QUEUE_SQL} SELECT id, {_REQUESTED} FROM q WHERE ({_ANY}) AND length(clean) >= 10")
def _(spark, sf):
    folder = scratch_path(spark, "checkpoint")
    work = queue.build_queue(T.listings(spark, sf))
    run.run_extraction(work, stub_extractor, folder, "stub")
    return read_checkpoint(spark, folder, CHECKPOINT_SCHEMA).select(
        "id", *[f"{f}_status" for f in FIELDS]
    )


@query("J3_resume_skips_done", _EXTRACTED)
def _(spark, sf):
    folder = scratch_path(spark, "checkpoint")
    work = queue.build_queue(T.listings(spark, sf))
    for kind in ("need_beds", "need_wc"):
        run.run_extraction(work.filter(kind), stub_extractor, folder, "stub")
    run.run_extraction(work, stub_extractor, folder, "stub")
    done = read_checkpoint(spark, folder, CHECKPOINT_SCHEMA)
    return done.agg(F.count("id").alias("extracted"), F.count_distinct("id").alias("listings"))


@query(
    "F7_pending_limit",
    f"{WITH_L}, {_QUEUE_SQL} SELECT id FROM q WHERE ({_ANY}) AND length(clean) >= 10 ORDER BY id LIMIT 100",
)
def _(spark, sf):
    return queue.tasks(queue.build_queue(T.listings(spark, sf))).orderBy("id").limit(100).select("id")


@query(
    "F8_task_sample",
    f"{WITH_L}, {_QUEUE_SQL} SELECT id FROM q WHERE ({_ANY}) AND length(clean) >= 10 ORDER BY md5('7|' || CAST(id AS VARCHAR)) LIMIT 50",
)
def _(spark, sf):
    work = queue.tasks(queue.build_queue(T.listings(spark, sf)))
    return sampling.uniform_sample(work, 50, sampling.hash_key("id", seed=7)).select("id")


@query(
    "G3_union_parts",
    f"WITH {_C_SQL}, {_STATUS_SQL} SELECT id, status FROM v",
)
def _(spark, sf):
    judged = verify.verify(_candidates(spark, sf)).select("id", "status", "estate_type")
    parts = [judged.filter(F.col("estate_type") == t).drop("estate_type") for t in ("apartment", "villa", "land")]
    return union_by_name(*parts)


# Predictions against the labels: quality stands for a count, toxicity for a yes/no field.
_DETAIL = (
    "SELECT doc_id AS id, 'furnished' AS field, estate_type, CAST(toxic AS DOUBLE) AS actual, CAST(length(text) % 2 AS DOUBLE) AS predicted, "
    "CASE WHEN doc_id % 5 = 0 THEN 'rejected_ungrounded' ELSE 'accepted' END AS status FROM d UNION ALL SELECT doc_id AS id, 'wc' AS field, "
    "estate_type, CAST(quality + 2 AS DOUBLE) AS actual, CAST(2 + length(text) % 3 AS DOUBLE) AS predicted, CASE WHEN doc_id % 7 = 0 THEN "
    "'rejected_out_of_range' WHEN doc_id % 7 = 1 THEN 'accepted_fuzzy' ELSE 'accepted' END AS status FROM d"
)
_D = (
    "SELECT labels.doc_id, quality, toxic, text, CASE WHEN labels.doc_id % 3 = 0 THEN 'apartment' ELSE 'villa' END AS estate_type FROM labels "
    "JOIN documents ON labels.doc_id = documents.doc_id"
)


def _detail(spark, sf):
    T.load(spark, sf, "documents", "labels")
    spark.sql(_D).createOrReplaceTempView("d")
    return spark.sql(_DETAIL)


def _metrics_sql(by: str) -> str:
    used = "status LIKE 'accepted%'"
    return (
        f"WITH d AS MATERIALIZED ({_D}), t AS MATERIALIZED ({_DETAIL}), g AS (SELECT {by}, count(*) AS sampled, count(*) FILTER ({used}) AS attempted, "
        f"avg(CAST(actual = predicted AS DOUBLE)) FILTER ({used}) AS ex, avg(CAST(abs(actual - predicted) <= 1 AS DOUBLE)) FILTER ({used}) AS one, "
        f"avg(abs(actual - predicted)) FILTER ({used}) AS err, avg(CAST(abs(actual - predicted) <= 5 AS DOUBLE)) FILTER ({used}) AS near5, "
        f"count(*) FILTER ({used} AND predicted = 1 AND actual = 1) AS tp, count(*) FILTER ({used} AND predicted = 1 AND actual = 0) AS fp, "
        f"count(*) FILTER ({used} AND predicted = 0 AND actual = 1) AS fn, count(*) FILTER (status = 'rejected_ungrounded') AS rejected_ungrounded, "
        f"count(*) FILTER (status = 'rejected_out_of_range') AS rejected_out_of_range, count(*) FILTER (status = 'retry_exhausted') AS retry_exhausted "
        f"FROM t GROUP BY {by}), p AS (SELECT *, field = 'furnished' AS b, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS pr, "
        "CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS re FROM g) "
        f"SELECT {by}, sampled, attempted, round(attempted / sampled::DOUBLE, 6) AS coverage, round(ex, 6) AS exact_match, CASE WHEN NOT b THEN "
        "round(one, 6) END AS off_by_one, CASE WHEN NOT b THEN round(err, 6) END AS mae, CASE WHEN NOT b THEN round(near5, 6) END AS within_tolerance, "
        "CASE WHEN b THEN round(pr, 6) END AS \"precision\", CASE WHEN b THEN round(re, 6) END AS recall, CASE WHEN b THEN round(CASE WHEN pr + re > 0 "
        "THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) END AS f1, rejected_ungrounded, rejected_out_of_range, retry_exhausted, CASE WHEN b THEN pr >= 0.9 AND "
        "2 * pr * re / CASE WHEN pr + re > 0 THEN pr + re ELSE 1 END >= 0.85 ELSE ex >= 0.85 AND one >= 0.95 END AS passed_gate FROM p"
    )


_ROUNDED = (
    "coverage", "exact_match", "off_by_one", "mae", "within_tolerance", "precision", "recall", "f1",
)


@query("D23_field_metrics", _metrics_sql("field"))
def _(spark, sf):
    table = evaluate.field_metrics(_detail(spark, sf))
    return table.withColumns({c: F.round(c, 6) for c in _ROUNDED})


@query("D25_metrics_by_type", _metrics_sql("field, estate_type"))
def _(spark, sf):
    table = evaluate.field_metrics(_detail(spark, sf), ["field", "estate_type"])
    return table.withColumns({c: F.round(c, 6) for c in _ROUNDED})


@query(
    "J11_gate_report",
    f"SELECT field, passed_gate, CASE WHEN passed_gate THEN 'passed' ELSE 'failed' END AS verdict FROM ({_metrics_sql('field')})",
)
def _(spark, sf):
    report = evaluate.gate_report(evaluate.field_metrics(_detail(spark, sf)))
    return report.select("field", "passed_gate", "verdict")


# A held-out sample: the listings of the URGENT orders.
_SAMPLE_SQL = "s AS (SELECT id FROM l WHERE content = 'order of 1-URGENT')"
_FILL_SQL = (
    f"{WITH_L}, {_SAMPLE_SQL}, h AS (SELECT * FROM l WHERE id NOT IN (SELECT id FROM s)), g AS (SELECT district_id, median(street_width) AS m "
    "FROM h GROUP BY 1), f AS (SELECT l.id, l.district_id, street_width AS actual, coalesce(g.m, (SELECT median(street_width) FROM h)) AS predicted "
    "FROM l LEFT JOIN g ON l.district_id = g.district_id WHERE id IN (SELECT id FROM s) AND street_width IS NOT NULL)"
)


@query("C14_group_median_fill", f"{_FILL_SQL} SELECT * FROM f")
def _(spark, sf):
    listings = T.listings(spark, sf)
    sample = listings.filter(F.col("content") == "order of 1-URGENT")
    return evaluate.group_median_fill(listings, "street_width", sample)


@query(
    "D24_median_baseline",
    f"{_FILL_SQL} SELECT round(avg(CAST(actual = predicted AS DOUBLE)), 6) AS exact_match, round(avg(abs(actual - predicted)), 6) AS mae, "
    "round(avg(CAST(abs(actual - predicted) <= 5 AS DOUBLE)), 6) AS within_tolerance FROM f",
)
def _(spark, sf):
    listings = T.listings(spark, sf)
    sample = listings.filter(F.col("content") == "order of 1-URGENT")
    table = evaluate.median_baseline(listings, "street_width", sample)
    return table.select(*[F.round(c, 6).alias(c) for c in table.columns])


@query("J10_evaluation_job")
def _(spark, sf):
    rows = _doc_listings(spark, sf).withColumn("clean", F.col("content"))
    return evaluate.evaluate_field(rows, "wc", stub_extractor, 100, "stub")


@query(
    "C6_held_out",
    f"{WITH_L}, {_SAMPLE_SQL} SELECT id FROM l WHERE id NOT IN (SELECT id FROM s)",
)
def _(spark, sf):
    listings = T.listings(spark, sf)
    return joins.pending(listings, listings.filter(F.col("content") == "order of 1-URGENT")).select("id")


@query("M1_incremental_run", _EXTRACTED)
def _(spark, sf):
    from plotyard.streaming.incremental import read_extracted, start_incremental

    arriving, done, progress = (scratch_path(spark, n) for n in ("arriving", "done", "progress"))
    work = queue.build_queue(T.listings(spark, sf))
    work.repartition(4).write.parquet(arriving)
    for _ in range(2):  # the second run finds nothing new
        stream = start_incremental(spark, arriving, work.schema, stub_extractor, done, progress, "stub", 2)
        stream.awaitTermination()
    return read_extracted(spark, done).agg(F.count("id").alias("extracted"), F.count_distinct("id").alias("listings"))
