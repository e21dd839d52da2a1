"""Fixed values that results depend on, stated plainly."""

# Spending band -> yen midpoint (fixed values).
SPENDING_MIDPOINTS = {
    "1,000円未満": 500,
    "1,000円以上 3,000円未満": 2000,
    "3,000円以上 5,000円未満": 4000,
    "5,000円以上 10,000円未満": 7500,
    "10,000円以上 20,000円未満": 15000,
    "20,000円以上 30,000円未満": 25000,
    "30,000円以上 40,000円未満": 35000,
    "40,000円以上 50,000円未満": 45000,
    "50,000円以上 100,000円未満": 75000,
    "100,000円以上": 150000,
    "使わない": 0,
}

# Five-step satisfaction labels (fixed values).
SATISFACTION_SCORES = {
    "とても不満": 1,
    "不満": 2,
    "どちらでもない": 3,
    "満足": 4,
    "とても満足": 5,
}

# Wider label set used by the score coercion ladder (fixed values).
SATISFACTION_LABELS = {
    "非常に満足": 5, "とても満足": 5, "大変満足": 5,
    "満足": 4, "やや満足": 4,
    "普通": 3, "どちらでもない": 3,
    "やや不満": 2, "不満": 2,
    "非常に不満": 1, "とても不満": 1, "大変不満": 1,
}

# Score values and labels that count as high and low (fixed values).
HIGH_LABELS = ("満足", "とても満足", "4", "5")
LOW_LABELS = ("不満", "とても不満", "1", "2")

# Keywords of under-vibrancy complaints (fixed values).
UNDERVIBRANCY_KEYWORDS = (
    "静か", "寂し", "さびし", "さみし", "人が少な", "人がいな",
    "活気", "賑わ", "にぎわ", "閑散", "寂れ", "さびれ",
    "閉まっ", "店がな", "営業し", "何もな", "つまらな",
    "退屈", "物足りな", "盛り上が", "人通り",
)

# Keywords of the site study (fixed values).
CONGESTION_KEYWORDS = (
    "混雑", "人が多", "込んで", "混んで", "うるさ", "騒がし",
    "待ち時間が長", "行列", "ごった返",
)
QUIETNESS_KEYWORDS = (
    "静か過ぎ", "寂し", "さびし", "さみし", "閑散", "寂れ", "退屈", "物足りな",
)

# Complaint classes of the driver study (fixed values).
COMPLAINT_LABELS = (
    "weather conditions",
    "poor transportation",
    "language barrier",
    "lack of information",
    "pricing",
)

# Stop words (fixed values).
STOP_WORDS_JA = (
    "する", "いる", "なる", "ある", "こと", "もの", "ため", "それ",
    "これ", "あの", "その", "どの", "よう", "ところ", "ほう",
    "思う", "行く", "来る", "見る", "言う", "できる", "ない",
    "いい", "よい", "多い", "少ない", "大きい", "小さい",
)
STOP_WORDS_EN = (
    "the", "be", "to", "of", "and", "in", "that", "have", "it",
    "for", "not", "on", "with", "he", "as", "you", "do", "at",
    "this", "but", "his", "by", "from", "they", "we", "her",
    "she", "or", "an", "will", "my", "one", "all", "would",
    "there", "their", "what", "so", "up", "out", "if", "about",
    "who", "get", "which", "go", "me", "when", "make", "can",
    "like", "very", "was", "were", "been", "being", "had", "has",
    "did", "does", "are", "is", "am",
)
STOP_WORDS = STOP_WORDS_JA + STOP_WORDS_EN

# Sentiment lexicon (fixed values).
SENTIMENT_LEXICON = {
    "素晴らしい": 1.0, "最高": 1.0, "美味しい": 0.8, "綺麗": 0.8,
    "楽しい": 0.9, "良い": 0.6, "嬉しい": 0.8, "満足": 0.7,
    "快適": 0.7, "親切": 0.8, "便利": 0.6, "絶景": 1.0,
    "感動": 0.9, "温かい": 0.6, "美しい": 0.8, "豊か": 0.6,
    "歓迎": 0.7, "落ち着く": 0.6, "魅力": 0.7, "おすすめ": 0.7,
    "悪い": -0.6, "辛い": -0.7, "不便": -0.7, "残念": -0.6,
    "寒い": -0.4, "暑い": -0.3, "混雑": -0.5, "高い": -0.3,
    "少ない": -0.4, "大変": -0.5, "問題": -0.5, "困る": -0.6,
    "不満": -0.7, "心配": -0.4, "危険": -0.6, "退屈": -0.5,
    "wonderful": 1.0, "excellent": 1.0, "amazing": 1.0, "beautiful": 0.8,
    "great": 0.8, "fantastic": 0.9, "incredible": 0.9, "outstanding": 1.0,
    "stunning": 0.9, "delicious": 0.8, "enjoyable": 0.7, "recommended": 0.7,
    "breathtaking": 1.0, "world-class": 1.0, "spiritual": 0.6, "lovely": 0.7,
    "bad": -0.6, "poor": -0.6, "terrible": -0.9, "difficult": -0.5,
    "disappointing": -0.7, "cold": -0.3, "inconvenient": -0.6,
    "needs": -0.3, "improvement": -0.3, "lacking": -0.5, "limited": -0.4,
}

# Canonical hourly weather columns, in output order (fixed values).
HOURLY_COLUMNS = (
    "timestamp", "snow_depth_cm", "snowfall_1h_cm", "temp_c", "precip_1h_mm",
    "sun_1h_h", "wind_speed_ms", "weather_type", "humidity_pct",
)
HOURLY_NUMBERS = (
    "snow_depth_cm", "snowfall_1h_cm", "temp_c", "precip_1h_mm",
    "sun_1h_h", "wind_speed_ms", "humidity_pct",
)

# Hourly weather names -> panel names (fixed values).
WEATHER_PANEL_NAMES = {
    "temp_c": "temp",
    "precip_1h_mm": "precip",
    "sun_1h_h": "sun",
    "wind_speed_ms": "wind",
    "snow_depth_cm": "snow_depth",
    "humidity_pct": "humidity",
}

# Hourly weather names -> dashboard names (fixed values).
WEATHER_DASHBOARD_NAMES = {
    "timestamp": "datetime",
    "temp_c": "temperature_c",
    "precip_1h_mm": "precipitation_mm",
    "sun_1h_h": "sunshine_hours",
}
WEATHER_DASHBOARD_NUMBERS = (
    "temperature_c", "precipitation_mm", "sunshine_hours", "wind_speed_ms",
    "humidity_pct", "snow_depth_cm", "snowfall_1h_cm",
)

# Raw weather export labels -> hourly names (fixed values).
RAW_EXPORT_LABELS = {
    "積雪(cm)": "snow_depth_cm",
    "降雪(cm)": "snowfall_1h_cm",
    "気温(℃)": "temp_c",
    "降水量(mm)": "precip_1h_mm",
    "日照時間(時間)": "sun_1h_h",
    "天気": "weather_type",
    "相対湿度(％)": "humidity_pct",
}
RAW_EXPORT_TIME = "年月日時"
RAW_EXPORT_WIND = "風速(m/s)"
RAW_EXPORT_WIND_DIRECTION = "風向"

# Scraped table cells that mean "missing" (fixed values).
MISSING_CELLS = ("--", "///", "×", "nan", "NaN", "#", "")

# Survey headings -> survey names (fixed values).
SURVEY_NAMES = {
    "都道府県": "prefecture",
    "NPS": "nps_score",
    "年代": "age_group",
    "回答日時": "date",
    "回答月": "response_month",
    "回答エリア": "area",
    "市町村": "municipality",
    "同行者": "travel_party",
    "エリア総消費額": "spending_yen",
    "県内消費額": "spending_in_prefecture",
    "宿泊数（全体）": "nights_total",
    "宿泊数（県内）": "nights_in_prefecture",
    "エリア訪問回数": "visit_count",
    "今後の来訪意向": "revisit_intention",
    "性別": "gender",
    "満足度の理由": "satisfaction_reason",
    "不便さの内容": "inconvenience_detail",
    "推奨項目": "recommendation_reason",
    "福井県に求めるもの": "requests_for_fukui",
    "施設に求めるもの": "requests_for_facility",
    "福井県内での交通手段の満足度の理由": "transport_satisfaction_reason",
}
SURVEY_TEXT_COLUMNS = (
    "satisfaction_reason", "inconvenience_detail", "recommendation_reason",
    "requests_for_fukui", "requests_for_facility",
)
SURVEY_SATISFACTION_HEADINGS = ("満足度(商品・サービス)", "福井県内での交通手段の満足度")

# Merged survey headings (fixed values).
TRIP_SATISFACTION = "満足度（旅行全体）"
SERVICE_SATISFACTION = "満足度（商品・サービス）"
RECOMMENDATION = "おすすめ度"
ANSWER_PLACE = "回答場所"
SURVEY_TEXT_HEADINGS = ("満足度理由", "不便に感じたこと・困ったこと", "自由意見")

# Order in which a grouping column is looked for (fixed values).
GROUP_CANDIDATES = (
    "area", "回答エリア", "回答エリア2", "municipality", "市町村",
    "prefecture", "都道府県", "age_group", "年代",
    "travel_party", "同行者", "gender", "性別",
)

# Feature families (fixed values).
WEATHER_FEATURES = (
    "precip", "temp", "sun", "wind", "precip_lag1", "weather_severity", "weekend_x_severity",
)
CALENDAR_FEATURES = ("is_weekend_or_holiday", "month", "dow_mean_count")

# Visitor bins, right-closed (fixed values).
VISITOR_EDGES = (0, 5000, 8000, 12000, 15000, 20000, 50000)
VISITOR_LABELS = ("<5K", "5-8K", "8-12K", "12-15K", "15-20K", ">20K")

# Ranking baseline by month, January first (fixed values).
RANK_BY_MONTH = (46, 47, 46, 47, 46, 45, 44, 43, 45, 47, 45, 47)
VISITORS_K_BY_MONTH = (522, 381, 707, 689, 890, 611, 752, 1229, 767, 766, 945, 493)
GAP_K_BY_MONTH = (232, 309, 274, 310, 325, 301, 235, 178, 216, 316, 236, 405)

# Seasonal weights of the ranking study, January first (fixed values).
SEASON_WEIGHTS = (6.26, 6.26, 2.5, 2.5, 2.5, 1.0, 1.0, 1.0, 1.0, 2.5, 2.5, 6.26)
FLAT_WINTER_WEIGHTS = (1.5, 1.5, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.5)
FLAT_WINTER_RANKS = (47, 47, 47, 46, 47, 47, 45, 35, 46, 47, 47, 47)

# Money (fixed values).
SPEND_PER_VISITOR = 13811.0
YEN_PER_DOLLAR = 164.7

# Response surface of the unit-root test with a constant, one series (published, fixed values).
UNIT_ROOT_MAX, UNIT_ROOT_MIN, UNIT_ROOT_SPLIT = 2.74, -18.83, -1.61
UNIT_ROOT_SMALL = (2.1659, 1.4412, 0.038269)
UNIT_ROOT_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


# Discomfort index, coefficients of 1, t, h and t·h (fixed values): 0.81 t + 0.01 h (0.99 t - 14.3) + 46.3.
DISCOMFORT_TERMS = {"1": 46.3, "t": 0.81, "h": -0.143, "th": 0.0099}

# Names of the model's features; {0} is the intent column (fixed values).
MODEL_FEATURES = (
    "{0}", "{0}_lag1", "{0}_lag2", "{0}_lag3", "{0}_roll7", "precip", "temp", "sun", "wind", "precip_lag1",
    "is_weekend_or_holiday", "weather_severity", "dow_mean_count", "weekend_x_severity", "weekend_x_intent", "month",
)
