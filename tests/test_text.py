import pytest
from pyspark.sql import functions as F

from plotyard import fixed_values as fv
from plotyard.functions import labels, text
from plotyard.operators import prepare


def _one(spark, column, **values):
    fields = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], fields).select(column).first()[0]


def test_normalize_flags_folds_letters_digits_and_repeats(spark):
    raw = "شقّة جمييييلة \U0001F600 مـسبح ٣ غرف إيجار"
    assert _one(spark, text.normalize_flags(F.col("t")), t=raw) == "شقه جميله مسبح 3 غرف ايجار"


def test_missing_side_empties_the_flag_text(spark):
    column = text.normalize_flags(text.title_and_content())
    assert _one(spark, column, title=None, content="مسبح") == ""


def test_normalize_content_strips_links_phones_marks(spark):
    raw = "شُقة ٢ غرف https://x.example/a?b 0501234567 ✅  للايجار"
    assert _one(spark, text.normalize_content(F.col("t")), t=raw) == "شقة 2 غرف للايجار"


@pytest.mark.parametrize("body, pool", [("بدون مسبح", 0), ("فيلا مع مسبح", 1), ("لا يوجد مسبح خاص", 0)])
def test_negated_feature_is_not_flagged(spark, body, pool):
    df = spark.createDataFrame([(1, "فيلا", body)], "id long, title string, content string")
    assert prepare.with_text_flags(df).first()["f_pool"] == pool


def test_park_across_the_street_is_no_garden(spark):
    df = spark.createDataFrame(
        [(1, "شقه", "قريب من حديقه الحي"), (2, "فيلا", "حديقه و حوش")], "id long, title string, content string"
    )
    got = {r["id"]: (r["f_near_park"], r["f_garden"], r["f_yard"]) for r in prepare.with_text_flags(df).collect()}
    assert got == {1: (1, 0, 0), 2: (0, 1, 1)}


@pytest.mark.parametrize(
    "clean, rooms",
    [
        ("عدد المجالس : 3 عدد الصالات : 2 عدد غرف النوم : 6", 11),
        ("عدد الصالات : 2 عدد غرف النوم : 6", 8),
        ("غرفة خادمة عدد الصالات : 1 عدد غرف النوم : 4", 6),
        ("غرفة خادمة ( لا ) عدد الصالات : 1 عدد غرف النوم : 4", 5),
        ("ماستر عدد الصالات : 1 عدد غرف النوم : 4", None),
        ("عدد الصالات : 1 عدد غرف النوم : 4 و 2مجلس", None),
        ("عدد الصالات : 1", None),
        ("عدد الصالات : 0 عدد غرف النوم : 0", None),
    ],
)
def test_template_rooms(spark, clean, rooms):
    assert _one(spark, text.template_rooms(F.col("t")), t=clean) == rooms


def test_search_fold_unifies_spelling(spark):
    assert _one(spark, text.search_fold(F.col("t")), t="حي الأندلسية ") == "الاندلسيه"


@pytest.mark.parametrize(
    "value, label",
    [(120.0, "120"), (100.0, "100"), (1000.0, "1K"), (2400000.0, "2.4M"), (100000050000.0, "100B"),
     (1250000000.0, "1.25B"), (15500.0, "16K"), (999.4, "999")],
)
def test_compact_number_keeps_significant_zeros(spark, value, label):
    assert _one(spark, labels.compact_number(F.col("v")), v=value) == label


def test_small_prices_carry_the_unit(spark):
    assert _one(spark, labels.compact_price(F.col("v")), v=999.0) == "999 SAR"
    assert _one(spark, labels.compact_price(F.col("v")), v=1500.0) == "1.5K"


@pytest.mark.parametrize("metres, label", [(999.4, "999 m"), (1500.0, "1.5 km"), (float("nan"), "—")])
def test_distance_label(spark, metres, label):
    assert _one(spark, labels.distance_label(F.col("v")), v=metres) == label


def test_slug_round_trip_of_arabic_names(spark):
    slug = labels.district_slug(F.col("t"))
    assert _one(spark, slug, t="حي الملقا").startswith("%D8%AD")
    assert _one(spark, labels.district_from_slug(slug), t="حي الملقا") == "حي الملقا"


def test_band_labels_and_steps(spark):
    df = spark.createDataFrame([([1500.0, 2000.0, 120000.0],)], "b array<double>")
    assert df.select(labels.band_labels(F.col("b"))).first()[0] == ["< 1.5", "1.5–2", "2–120", "120+"]
    steps = [df.select(labels.shade_step(F.lit(v), F.col("b"), 4)).first()[0] for v in (1500.0, 1501.0, 1e9)]
    assert steps == [0, 1, 3]


def test_ac_is_filled_for_the_given_rentals_only(spark):
    rows = [(1, "chalet", "rental", None, "فيه مكيف"), (2, "chalet", "rental", None, None), (3, "villa", "rental", None, "مكيف"),
            (4, "chalet", "rental", 0.0, "مكيف")]
    df = spark.createDataFrame(rows, "id long, estate_type string, estate_benefit string, ac double, content string")
    df = df.withColumn("title", F.lit(None).cast("string"))
    assert [r[0] for r in df.select(text.fill_ac(F.col("ac"))).collect()] == [1.0, 0.0, None, 0.0]


def test_pattern_pack_is_complete():
    flags = set(fv.FLAG_PATTERNS) | {"f_near_park", "f_garden", "f_yard"}
    assert set(fv.AMENITY_FLAGS) <= flags
