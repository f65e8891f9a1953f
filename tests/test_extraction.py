import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotyard.operators import structural
from plotyard.operators.extraction import evaluate, merge, queue, run, verify
from plotyard.operators.extraction.fields import CHECKPOINT_SCHEMA
from plotyard.sources import io
from plotyard.streaming.incremental import read_extracted, start_incremental

TEXT = "شقة ثلاث غرف و صالة واحدة ودورتين مياه"
SCHEMA = "id long, field string, value double, is_boolean boolean, evidence array<string>, clean string"


@pytest.mark.parametrize(
    "field, value, boolean, evidence, status",
    [
        ("wc", 2.0, False, ["ودورتين مياه"], "accepted"),
        ("wc", 2.0, False, ["ودورتين  مياه"], "accepted"),  # whitespace is collapsed first
        ("wc", 2.0, False, ["ودورتين مياة"], "accepted_fuzzy"),
        ("wc", 2.0, False, ["خمس دورات كاملة"], "rejected_ungrounded"),
        ("wc", 2.0, False, ["و"], "rejected_ungrounded"),
        ("rooms", 4.0, False, ["ثلاث غرف", "صالة"], "accepted"),
        ("rooms", 4.0, False, ["ثلاث غرف", "مجلس كبير جدا"], "rejected_ungrounded"),
        ("rooms", 4.0, False, [], "rejected_ungrounded"),
        ("wc", 99.0, False, ["ودورتين مياه"], "rejected_out_of_range"),
        ("wc", 1.0, True, ["ودورتين مياه"], "rejected_out_of_range"),
        ("furnished", 1.0, False, ["شقة"], "rejected_out_of_range"),
        ("furnished", 1.0, True, ["شقة"], "accepted"),
        ("wc", None, False, ["ودورتين مياه"], "null_not_mentioned"),
        ("wc", 2.0, False, None, "rejected_schema_invalid"),
    ],
)
def test_outcome_precedence(spark, field, value, boolean, evidence, status):
    df = spark.createDataFrame([(1, field, value, boolean, evidence, TEXT)], SCHEMA)
    row = verify.verify(df).first()
    assert row["status"] == status
    assert (row["value"] is not None) == status.startswith("accepted")
    if status in ("null_not_mentioned", "rejected_schema_invalid"):
        assert row["evidence"] is None
    else:
        assert row["evidence"] == " | ".join(evidence)


def test_close_match_agrees_with_all_windows():
    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    def slow(a, b):
        if len(a) > len(b):
            a, b = b, a
        m, best = len(a), 0.0
        for s in range(-(m - 1), len(b)):
            w = b[max(0, s) : min(len(b), s + m)]
            best = max(best, 200.0 * common(a, w) / (m + len(w)))
        return best

    rng = random.Random(11)
    for _ in range(150):
        hay = "".join(rng.choice("abcd ") for _ in range(rng.randint(5, 40)))
        start = rng.randrange(len(hay) - 4)
        needle = list(hay[start : start + rng.randint(4, 20)])
        if rng.random() < 0.7:
            needle[rng.randrange(len(needle))] = "x"
        needle = "".join(needle)
        for threshold in (70.0, 90.0):
            assert verify.close_match(needle, hay, threshold) == (slow(needle, hay) >= threshold)


def _extractions(spark, rows):
    wide = []
    for i, status, value in rows:
        r = {f.name: None for f in CHECKPOINT_SCHEMA.fields}
        r.update(id=i, wc_status=status, wc_value=value)
        wide.append(tuple(r.values()))
    return spark.createDataFrame(wide, CHECKPOINT_SCHEMA)


def test_merge_gates_and_audit(spark):
    source = spark.createDataFrame(
        [(1, "villa", None), (2, "apartment", None), (3, "apartment", 1), (4, "land", None), (5, "apartment", None), (6, "villa", None)],
        "id long, estate_type string, wc int",
    ).select("*", *[F.lit(None).cast("int").alias(c) for c in ("livings", "age", "furnished")], F.lit(None).cast("double").alias("street_width"))
    ext = _extractions(spark, [(1, "accepted", 3), (2, "accepted_fuzzy", 2), (3, "accepted", 4), (5, "rejected_ungrounded", None)])
    got = {r["id"]: (r["wc"], r["wc_extraction_status"]) for r in merge.apply_extractions(source, ext, ["wc"]).collect()}
    assert got == {
        1: (None, "needs_human_review"), 2: (2, "llm_filled"), 3: (1, "original"),
        4: (None, "not_attempted_structural_exempt"), 5: (None, "llm_rejected_ungrounded"), 6: (None, "not_attempted"),
    }
    untrusted = merge.apply_extractions(source, ext, []).filter("id = 2").first()
    assert (untrusted["wc"], untrusted["wc_extraction_status"]) == (None, "needs_human_review")
    once = merge.apply_extractions(source, ext, ["wc"]).select(source.columns)
    twice = merge.apply_extractions(once, ext, ["wc"]).select(source.columns)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)


def test_latest_keeps_the_newest(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 1, "c")], "id long, extracted_at int, v string")
    assert {(r["id"], r["v"]) for r in merge.latest(df).collect()} == {(1, "b"), (2, "c")}


def test_guard_refuses_lost_rows_and_overwrites(spark):
    before = spark.createDataFrame([(1, 2), (2, None)], "id long, wc int")
    io.check_no_overwrite(before, before.fillna(7), ["wc"])
    with pytest.raises(io.GuardError, match="overwritten"):
        io.check_no_overwrite(before, before.withColumn("wc", F.lit(None).cast("int")), ["wc"])
    with pytest.raises(io.GuardError, match="row count"):
        io.check_no_overwrite(before, before.filter("id = 1"), ["wc"])
    with pytest.raises(io.GuardError, match="unique"):
        io.check_no_overwrite(before, before.unionByName(before), ["wc"])


def _stub(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(
        [
            {"id": r.id, "field": f, "value": 1.0, "is_boolean": f in ("furnished", "driver_room"), "evidence": [r.clean[:4]],
             "failed": r.id % 2 == 1, "attempt_count": 1, "latency_ms": 5}
            for r in frame.itertuples(index=False)
            for f in r.needed
        ]
    )


@pytest.fixture()
def listings(spark):
    rows = [(i, "apartment", None, 1 if i % 3 else None, TEXT) for i in range(20)] + [(50, "apartment", None, None, "قصير")]
    df = spark.createDataFrame(rows, "id long, estate_type string, beds int, wc int, content string")
    return df.select("*", *[F.lit(1).alias(c) for c in ("livings", "age", "furnished")], F.lit(9.0).alias("street_width"))


def test_run_resumes_and_marks_exhausted(spark, listings, tmp_path):
    work = queue.build_queue(listings)
    assert work.count() == 20  # the short text is not queued
    folder = str(tmp_path / "ckpt")
    run.run_extraction(work, _stub, folder, "m", limit=5)
    run.run_extraction(work, _stub, folder, "m")
    done = io.read_checkpoint(spark, folder, CHECKPOINT_SCHEMA)
    assert done.count() == done.select("id").distinct().count() == 20
    row = done.filter("id = 1").first()
    assert row["rooms_status"] == "retry_exhausted" and row["rooms_value"] is None and row["wc_status"] is None
    assert done.filter("id = 0").first()["driver_room_value"] is True


def test_incremental_run_takes_new_files_only(spark, listings, tmp_path):
    work = queue.build_queue(listings)
    arriving, done, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    work.filter("id < 10").write.parquet(arriving)
    for expected in (10, 20, 20):
        start_incremental(spark, arriving, work.schema, _stub, done, progress, "m").awaitTermination()
        found = read_extracted(spark, done)
        assert found.count() == found.select("id").distinct().count() == expected
        work.write.mode("append").parquet(arriving)
    # a new stream over the same files has batches of its own and finds nothing left to do
    start_incremental(spark, arriving, work.schema, _stub, done, str(tmp_path / "progress-2"), "m").awaitTermination()
    assert read_extracted(spark, done).count() == 20


@pytest.mark.parametrize("broken", ["commit_batch", "append_batch"])
def test_a_batch_that_stopped_is_replayed_once(spark, listings, tmp_path, monkeypatch, broken):
    work = queue.build_queue(listings)
    arriving, done, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    work.filter("id < 6").repartition(1).write.parquet(arriving)
    work.filter("id >= 6").repartition(1).write.mode("append").parquet(arriving)
    whole, calls = getattr(io, broken), []

    def stops(*args):
        calls.append(args)
        if len(calls) == 2:  # after the results of the second batch, before its commit; or in the middle of its results
            if broken == "append_batch":
                args[0].limit(3).write.parquet(f"{done}/batches/{args[2]}")
            raise RuntimeError("lost")
        return whole(*args)

    monkeypatch.setattr(io, broken, stops)
    with pytest.raises(Exception, match="lost"):
        start_incremental(spark, arriving, work.schema, _stub, done, progress, "m", 1).awaitTermination()
    part = read_extracted(spark, done)
    assert 0 < part.count() < 20
    monkeypatch.setattr(io, broken, whole)
    start_incremental(spark, arriving, work.schema, _stub, done, progress, "m", 1).awaitTermination()
    found = read_extracted(spark, done)
    assert found.count() == found.select("id").distinct().count() == 20


def test_tables_survive_a_stop_between_write_and_publish(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    before = spark.createDataFrame([(1, 2), (2, None)], "id long, wc int")
    with pytest.raises(FileNotFoundError):
        io.read_table(spark, path)
    io.write_table(before, path)
    filled = io.read_table(spark, path).fillna({"wc": 7})
    publish = io.publish
    monkeypatch.setattr(io, "publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        io.guarded_write(io.read_table(spark, path), filled, path, ["wc"])
    assert sorted(map(tuple, io.read_table(spark, path).collect()), key=str) == [(1, 2), (2, None)]
    monkeypatch.setattr(io, "publish", publish)
    held = io.read_table(spark, path)
    io.guarded_write(io.read_table(spark, path), filled, path, ["wc"])
    assert sorted(map(tuple, io.read_table(spark, path).collect())) == [(1, 2), (2, 7)]
    with pytest.raises(io.GuardError):
        io.guarded_write(io.read_table(spark, path), before, path, ["wc"])
    assert sorted(map(tuple, io.read_table(spark, path).collect())) == [(1, 2), (2, 7)]
    assert sorted(map(tuple, held.collect()), key=str) == [(1, 2), (2, None)]  # a reader keeps its version
    assert io.prune_versions(spark, path, keep=1) == 1 and io.read_table(spark, path).count() == 2


def test_payload_violations_fail_their_fields(spark):
    payloads = [(1, '{"wc_value": 2, "wc_evidence": "x"}'), (2, '{"wc_value": 2}'), (3, "not json"), (4, '{"wc_value": "many", "wc_evidence": "x"}'),
                (5, '{"wc_value": null, "wc_evidence": null}')]
    df = spark.createDataFrame(payloads, "id long, payload string").withColumn("needed", F.array(F.lit("wc")))
    got = {r["id"]: r["failed"] for r in queue.decode_payloads(df).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: False}


def test_prompt_covers_needed_fields_only(spark):
    df = spark.createDataFrame([(1, TEXT, ["wc", "age"])], "id long, clean string, needed array<string>")
    prompt = queue.with_prompt(df).first()["prompt"]
    assert "wc_value" in prompt and "age_value" in prompt and "rooms_value" not in prompt and TEXT in prompt
    assert len(queue.prompt_version()) == 12


def test_field_metrics_gates(spark):
    rows = [("furnished", 1.0, 1.0, "accepted")] * 9 + [("furnished", 1.0, 0.0, "accepted")]
    rows += [("wc", 2.0, 2.0, "accepted")] * 8 + [("wc", 2.0, 5.0, "accepted"), ("wc", 2.0, None, "rejected_ungrounded")]
    table = {r["field"]: r for r in evaluate.field_metrics(spark.createDataFrame(rows, "field string, actual double, predicted double, status string")).collect()}
    assert table["furnished"]["precision"] == 1.0 and table["furnished"]["recall"] == pytest.approx(0.9)
    assert table["furnished"]["passed_gate"] and table["furnished"]["mae"] is None
    assert table["wc"]["coverage"] == pytest.approx(0.9) and table["wc"]["exact_match"] == pytest.approx(8 / 9)
    assert not table["wc"]["passed_gate"]


def test_structural_rules(spark):
    rows = [(1, "land", None, None, 0, None), (2, "land", 2, 1, 0, None), (3, "villa", None, 1, 1, 5.0), (4, "apartment", 3, None, 1, None),
            (5, "store", None, None, None, 4.0), (6, "warehouse", None, 1, 1, 2.0)]
    df = spark.createDataFrame(rows, "id long, estate_type string, beds int, livings int, wc int, street_width double")
    df = df.withColumns({"age": F.lit(1), "furnished": F.lit(0)})
    first = {r["id"]: r for r in structural.add_rooms(structural.zero_fill(df)).collect()}
    assert (first[1]["beds"], first[1]["beds_na"]) == (0, True)
    assert (first[2]["beds"], first[2]["beds_na"]) == (2, True)
    assert (first[3]["beds"], first[3]["beds_na"]) == (None, False)
    assert first[4]["rooms"] is None and first[1]["rooms_na"]
    none = spark.createDataFrame([], "id long, rooms_value long, rooms_status string")
    final = {r["id"]: r for r in structural.model_ready(df, none).collect()}
    assert 4 not in final  # livings unknown
    assert (final[5]["beds"], final[5]["beds_na"]) == (0, True)
    assert (final[6]["beds"], final[6]["rooms"]) == (0, 1)
    assert final[1]["street_width"] is None and final[3]["street_width_na"] is False
