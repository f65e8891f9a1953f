"""Vocabularies, patterns, bounds and thresholds that results depend on.

They are data, not logic: each table below is a plain statement of a value a result must agree
with, kept together so that a different country or language pack can replace them.
"""

from __future__ import annotations

# --- Geography (fixed values) ---------------------------------------------------------------
COUNTRY_BBOX = (16.0, 33.0, 34.0, 56.0)  # lat min, lat max, lng min, lng max
SEARCH_ENVELOPE = (12.0, 37.0, 29.0, 61.0)  # centres outside are discarded by saved searches
KM_PER_DEGREE = 111.19492664455873
MERCATOR_RADIUS_M = 6378137.0
NEAR_RADII_KM = (1, 3, 5, 10, 20)
POI_RADII_M = (500, 1000, 2000)
GRID_PER_DEGREE = 10

# --- Points of interest (fixed values) ------------------------------------------------------
# category, classes among general features, classes among places of worship
POI_CATEGORIES = (
    ("mosque", (), ("muslim", "muslim_sunni", "muslim_shia")),
    ("hospital", ("hospital", "clinic", "doctors"), ()),
    ("mall", ("mall", "department_store"), ()),
    ("university", ("university", "college"), ()),
)
POI_CATEGORY_NAMES = tuple(row[0] for row in POI_CATEGORIES)
# plausible typical distance in metres, used by the coverage report
POI_EXPECTED_DISTANCE_M = {"mosque": 300.0, "hospital": 1500.0, "mall": 3000.0, "university": 5000.0}

# --- Marts (fixed values) -------------------------------------------------------------------
MIN_LISTINGS_DISTRICT = 10
MIN_LISTINGS_PRICE = 5
SLIDER_QUANTILE = 0.995
MAP_ROW_GROUP_ROWS = 50_000
DETAILS_ROW_GROUP_ROWS = 2_000
EXPORT_PART_ROWS = 100_000

# --- Viewport (fixed values) ----------------------------------------------------------------
PIN_ZOOM = 14
PIN_LIMIT = {"desktop": 500, "small": 200}
HEAT_LIMIT = {"desktop": 25_000, "small": 8_000}
FEATURED_DISTRICTS = 8
IN_LINE_THRESHOLD = 0.05
CHOROPLETH_STEPS = 5
MIN_LOCAL_DISTRICTS = 8

# --- Outlines (fixed values) ----------------------------------------------------------------
OUTLINE_MIN_POINTS = 10
OUTLINE_RATIO = 0.4
OUTLINE_SIMPLIFY_DEG = 0.0012
OUTLINE_MAX_KM2 = 300.0

# --- Category code -> (estate type, purpose) (fixed values) -----------------------------------
CATEGORY_ROWS = (
    (1, "apartment", "rental"),
    (2, "land", "sell"),
    (3, "villa", "sell"),
    (4, "floor", "rental"),
    (5, "villa", "rental"),
    (6, "apartment", "sell"),
    (7, "building", "sell"),
    (8, "store", "rental"),
    (9, "house", "sell"),
    (10, "esterahah", "sell"),
    (11, "house", "rental"),
    (12, "farm", "sell"),
    (13, "esterahah", "rental"),
    (14, "office", "rental"),
    (15, "land", "rental"),
    (16, "building", "rental"),
    (17, "warehouse", "rental"),
    (18, "campsite", "rental"),
    (19, "room", "rental"),
    (20, "store", "sell"),
    (21, "furnished_apartment", "rental"),
    (22, "floor", "sell"),
    (23, "chalet", "rental"),
)

# --- Columns (fixed values) -----------------------------------------------------------------
AMENITY_FLAGS = (
    "f_ac", "f_parking", "f_new", "f_pool", "f_kitchen", "f_driver", "f_basement", "f_garden",
    "f_two_entr", "f_corner", "f_near_masjid", "f_investment", "f_negotiable", "f_urgent",
    "f_near_park", "f_yard",
)
MODEL_NAMES = {
    "wc": "bathrooms",
    "livings": "living_rooms",
    "beds": "bedrooms",
    "area": "area_m2",
    "age": "age_years",
    "street_width": "street_width_m",
    "furnished": "is_furnished",
    "daily_rentable": "is_daily_rentable",
    "f_ac": "has_ac",
    "f_parking": "has_parking",
    "f_new": "is_new",
    "f_pool": "has_pool",
    "f_kitchen": "has_kitchen",
    "f_driver": "has_driver_room",
    "f_basement": "has_basement",
    "f_garden": "has_garden",
    "f_two_entr": "has_two_entrances",
    "f_corner": "is_corner",
    "f_near_masjid": "near_masjid",
    "f_investment": "is_investment",
    "f_negotiable": "is_negotiable",
    "f_urgent": "is_urgent",
    "f_near_park": "near_park",
    "f_yard": "has_yard",
    "beds_na": "bedrooms_missing",
    "livings_na": "living_rooms_missing",
    "wc_na": "bathrooms_missing",
    "age_na": "age_missing",
    "furnished_na": "furnished_missing",
    "street_width_na": "street_width_missing",
}
SCRAPE_ONLY_COLUMNS = (
    "user_id", "user.img", "native.title", "native.image", "native.description",
    "native.external_url", "native.logo", "refresh", "user.name", "user.phone", "user.rega_id",
    "advertiser_type", "create_time", "has_extended_details", "rent_period", "width", "length",
    "imgs", "category", "type", "path", "street_direction", "user.review", "user.iam_verified",
    "uri",
)
REQUIRED_FOR_ANALYSIS = ("title", "content", "estate_type", "area")
REQUIRED_FOR_MODEL = ("beds", "street_width", "age", "furnished")
SPLIT_DROPS = ("price_per_m2", "district_id", "estate_benefit", "city_id", "lng", "lat")

# --- Valuation (fixed values) ---------------------------------------------------------------
MODELLED_TYPES = (
    "apartment", "building", "esterahah", "farm", "floor", "house", "land", "store", "villa",
)
BUILT_PRICE = (50_000.0, 50_000_000.0)
LAND_PRICE_MIN = 1_000.0
LAND_PRICE_PER_M2 = (10.0, 20_000.0)
LAND_FEATURES = (
    "city", "district", "area_m2", "street_width_m", "is_corner", "is_investment",
    "near_masjid", "is_negotiable",
)
MISSING_FLAG_OF = {
    "bedrooms_missing": "bedrooms",
    "bathrooms_missing": "bathrooms",
    "furnished_missing": "is_furnished",
    "street_width_missing": "street_width_m",
}
INTERVAL_QUANTILES = (0.1, 0.9)
LINEAR_ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0)
AREA_LIMIT_M2 = 1_000_000.0

# --- Structural exemptions (fixed values) ---------------------------------------------------
# estate type -> fields that carry no meaning for it
ZERO_FILL_EXEMPTIONS = {
    "land": ("beds", "livings", "wc", "furnished", "age"),
    "building": ("livings", "wc"),
    "store": ("livings", "wc", "furnished"),
    "esterahah": ("furnished",),
    "room": ("livings", "wc"),
    "office": ("livings", "wc"),
    "farm": ("beds", "livings", "wc", "furnished"),
    "warehouse": ("livings", "wc", "furnished"),
    "chalet": ("furnished",),
    "campsite": ("beds", "livings", "wc", "furnished", "age", "street_width"),
}
ZERO_FILL_FIELDS = ("beds", "livings", "wc", "age", "furnished")
# (field, estate types, how the flag is updated)
SECOND_EXEMPTIONS = (
    ("beds", ("building", "store", "room", "office"), "or"),
    ("street_width", ("apartment", "floor"), "set"),
)
LATE_EXEMPTIONS = (
    ("street_width", ("campsite",), "or"),
    ("beds", ("warehouse",), "or"),
)
EXTRACTION_EXEMPTIONS = {
    "land": ("rooms", "livings", "wc", "furnished", "age", "driver_room"),
    "building": ("livings", "wc"),
    "store": ("livings", "wc", "furnished", "driver_room"),
    "esterahah": ("furnished",),
    "room": ("livings", "wc"),
    "office": ("livings", "wc", "driver_room"),
    "farm": ("rooms", "livings", "wc", "furnished"),
    "warehouse": ("livings", "wc", "furnished", "driver_room"),
    "chalet": ("furnished",),
    "campsite": ("rooms", "livings", "wc", "furnished", "age", "street_width", "driver_room"),
}

# --- Extraction targets (fixed values) ------------------------------------------------------
# field, kind, minimum, maximum, queue flag, evidence is a list of spans
EXTRACTION_FIELDS = (
    ("rooms", "int", 0.0, 40.0, "need_beds", True),
    ("livings", "int", 0.0, 10.0, "need_livings", False),
    ("wc", "int", 0.0, 10.0, "need_wc", False),
    ("furnished", "bool", None, None, "need_furnished", False),
    ("age", "int", 0.0, 60.0, "need_age", False),
    ("street_width", "float", 1.0, 200.0, "need_street_width", False),
    ("driver_room", "bool", None, None, "need_beds", False),
)
EXTRACTION_NEW_COLUMNS = ("rooms", "driver_room")
ACCEPTED_STATUSES = ("accepted", "accepted_fuzzy")
# None: trusted for every estate type
TRUSTED_ESTATE_TYPES = {
    "rooms": None,
    "driver_room": None,
    "street_width": None,
    "livings": ("apartment",),
    "wc": ("apartment",),
    "age": ("apartment",),
    "furnished": (),
}
MIN_USABLE_CHARS = 10
MIN_EVIDENCE_CHARS = 2
FUZZY_THRESHOLD = 90.0
EVIDENCE_SEPARATOR = " | "
GATES = {
    "count_exact": 0.85,
    "count_off_by_one": 0.95,
    "furnished_precision": 0.90,
    "furnished_f1": 0.85,
    "street_width_within": 0.80,
    "street_width_mae": 5.0,
    "street_width_tolerance": 5.0,
}

# --- Text patterns, Arabic pack (fixed values) ------------------------------------------------
DIGITS_FROM = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
DIGITS_TO = "01234567890123456789"
NEGATION_PATTERN = r"(?:لا يوجد|لايوجد|بدون|غير|ما فيه|مافيه|ليس فيه|عدا|ما عدا)\s+\S+\s*\S*"
FLAG_PATTERNS = {
    "f_ac": r"مكيف|تكييف|سبلت|سبليت|اسبلت|شباك|مركزي|كونسيلد",
    "f_ac_central": r"تكييف مركزي|مكيفات مركزيه|مركزي راكب",
    "f_elevator": r"مصعد|اسانسير|مصاعد|ليفت",
    "f_parking": r"موقف|مواقف|كراج|قراج|جراج|باركن|مظله سياره",
    "f_furnished": r"مفروش|مفروشه|بالاثاث|مع الاثاث|فرش كامل|مؤثث",
    "f_new": r"جديد|جديده|لم تسكن|لم يسكن|اول ساكن|نظيف جدا|تحت الانشاء",
    "f_pool": r"مسبح|بركه سباحه|حوض سباحه",
    "f_kitchen": r"مطبخ راكب|مطبخ مركب|بالمطبخ|مع المطبخ",
    "f_maid": r"غرفه خادمه|غرفه شغاله|ملحق خادمه",
    "f_driver": r"سائق|سواق",
    "f_roof": r"سطح|روف|ملحق علوي",
    "f_basement": r"قبو|بدروم",
    "f_two_entr": r"مدخلين|مدخل خاص|مدخل مستقل",
    "f_corner": r"زاويه|ركنيه|شارعين|ثلاث شوارع",
    "f_near_masjid": r"قريب من المسجد|بجوار المسجد|امام المسجد|جامع",
    "f_investment": r"استثمار|دخل شهري|عائد|مؤجر بالكامل",
    "f_negotiable": r"قابل للتفاوض|التفاوض|السوم|قابل للنقاش",
    "f_urgent": r"للبيع السريع|بيع سريع|مستعجل|بسعر مغري|فرصه",
}
NEAR_PARK_PATTERN = r"(?:جوار|بجوار|قريب من|امام|مقابل|بجانب|قرب)\s+\S*\s*(?:حديق|منتزه|بارك)\S*"
GARDEN_PATTERN = r"حديقه|حديقة|لاند سكيب|مسطح اخضر|زرع"
YARD_PATTERN = r"حوش|فناء|ساحه خلفيه"
AC_PATTERN = r"مكيف|تكييف"
AC_FILL_TYPES = ("apartment", "chalet", "furnished_apartment", "esterahah", "house", "floor")
SHAPE_PATTERNS = {
    "n_emoji": r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]",
    "n_newlines": r"\n",
    "has_phone": r"(?:05|٠٥|\+9665)\d{6,}",
    "has_url": r"http|www\.|wa\.me|t\.me|snapchat|instagram",
    "has_latin": r"[A-Za-z]{3,}",
    "caps_symbols": r"[★☆✅✔️❤🔥●•▪]",
}
URL_PATTERN = r"(?U)https?://[^\s]+"
PHONE_PATTERN = r"(00966|\+?966)?0?5[0-9]{8}"
ROOM_COUNT_PATTERNS = {
    "majlis": r"(?U)(?:عدد\s*)?(?:ال)?مجالس\s*:",
    "salat": r"(?U)(?:عدد\s*)?(?:ال)?صالات\s*:",
    "bedrooms": r"(?U)(?:عدد\s*)?غرف\s*(?:ال)?نوم\s*:",
    "maqlat": r"(?U)(?:عدد\s*)?(?:ال)?(?:مقلط|ملقط|مجلط)\s*:",
}
FREEFORM_ROOMS_PATTERN = r"(?U)\d\s*(?:مجلس|مجالس|صاله|صالة|صالات|مقلط|ملقط|غرف|غرفه|غرفة)"
MASTER_ROOM_PATTERN = r"ماستر|رئيسيه|رئيسية"
MAID_PATTERN = r"خادمه|خادمة|شغاله|شغالة"
MAID_ABSENT_PATTERN = r"(?U)(?:خادمه|خادمة|شغاله|شغالة)\s*\S*\s*[\(:]\s*(?:لا|لايوجد|بدون)?\s*[\)]"

# Order and names of the leaderboard's targets and models.
TARGET_RANK = {"all": 0, "built": 1, "land": 2}
TARGET_LABEL = {"all": "universal", "built": "buildings", "land": "lands"}
MODEL_RANK = {"gbt": 1, "linear": 2, "ridge": 3, "lasso": 4}

# Letters folded to one spelling, and their replacements one for one.
CONTENT_LETTERS_FROM = "إأآٱى"
CONTENT_LETTERS_TO = "ااااي"
FLAG_LETTERS_FROM = "إأآٱىةؤئ"
FLAG_LETTERS_TO = "اااايهوي"
SEARCH_LETTERS_FROM = "إأآة"
SEARCH_LETTERS_TO = "اااه"

# Fixed values of the price models: columns that are no features, columns taken from listings, the search grid, the defaults
NOT_FEATURES = ("id", "price", "estate_type", "market", "true_log", "living_rooms_missing")
MODEL_SOURCE_COLUMNS = (
    "beds", "livings", "wc", "area", "street_width", "furnished", "f_ac", "f_parking", "f_pool",
    "f_kitchen", "f_driver", "f_basement", "f_garden", "f_two_entr", "f_corner", "f_near_masjid",
    "f_investment", "f_negotiable", "f_urgent", "f_near_park", "f_yard", "beds_na", "livings_na",
    "wc_na", "furnished_na", "street_width_na",
)
BOOSTER_GRID = {
    "maxIter": (300, 500, 800, 1200),
    "stepSize": (0.02, 0.03, 0.05),
    "maxDepth": (4, 5, 6, 8),
    "minInstancesPerNode": (10, 20, 50),
    "subsamplingRate": (0.7, 0.8),
    "featureSubsetStrategy": ("0.6", "0.8"),
}
BOOSTER_PARAMS = {
    "maxIter": 300, "stepSize": 0.05, "maxDepth": 6, "minInstancesPerNode": 20,
    "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8",
}

# Fixed values of the preparation: text flags that are not kept, columns that a model row must have
UNUSED_TEXT_FLAGS = ("f_ac_central", "f_elevator", "f_maid", "f_roof")
REQUIRED_FOR_MODELS = ("title", "content", "estate_type", "area", "beds", "street_width", "age", "furnished")
