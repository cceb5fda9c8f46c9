"""Thresholds, factors, names and texts that decide results.

They are stated here plainly because results are only right when they agree to the letter.
"""

from __future__ import annotations

# --- calendar -----------------------------------------------------------------------------------

WEEKDAY_NAMES = ("周一", "周二", "周三", "周四", "周五", "周六", "周日")

# Month groups and the factor applied to a route's seasonal index.
SEASON_FACTORS = (
    ((1, 2, 12), 0.9),
    ((6, 7, 8), 1.2),
    ((3, 4, 5), 1.1),
)

# Weekday groups (1 = Monday) and the demand factor; other days 1.0.
DAY_FACTORS = (
    ((1, 4), 0.85),
    ((5, 6), 1.15),
    ((7,), 1.2),
)

HOLIDAY_DEMAND_FACTOR = 1.3

HOLIDAYS = (
    "2025-01-01",
    "2025-01-28",
    "2025-01-29",
    "2025-01-30",
    "2025-01-31",
    "2025-02-01",
    "2025-02-02",
    "2025-02-03",
    "2025-04-05",
    "2025-04-06",
    "2025-04-07",
    "2025-05-01",
    "2025-05-02",
    "2025-05-03",
    "2025-05-04",
    "2025-05-05",
)

# --- flight economics ---------------------------------------------------------------------------

# Profitability tier of a route -> cost factor and price factor; any other tier takes the last entry.
TIER_COST_FACTORS = (("high", 0.6), ("medium", 0.7), ("low", 0.8))
TIER_PRICE_FACTORS = (("high", 1.15), ("medium", 1.1), ("low", 1.05))

CRUISE_KM_PER_HOUR = 800.0
MONEY_UNIT = 10000.0

LOAD_FACTOR_RANGE = (0.4, 0.98)

# Load factor above the threshold -> lowest and highest discount rate.
DISCOUNT_BANDS = ((0.85, 0.9, 1.0), (0.7, 0.8, 0.95))
DISCOUNT_BAND_ELSE = (0.7, 0.85)

# Subsidy tier -> lowest and highest subsidy per flight.
SUBSIDY_RANGES = (("A", 3.0, 8.0), ("B", 1.0, 4.0))

# --- dimensions ---------------------------------------------------------------------------------

# route_name, departure, arrival, distance, base_price, elasticity, seasonal_index, profitability
ROUTES = (
    ("北京-通辽线", "北京", "通辽", 500, 1000, 1.2, 1.0, "medium"),
    ("北京-鄂尔多斯线", "北京", "鄂尔多斯", 600, 1200, 1.1, 1.05, "high"),
    ("北京-呼和浩特线", "北京", "呼和浩特", 400, 900, 1.3, 0.95, "medium"),
    ("北京-巴彦淖尔线", "北京", "巴彦淖尔", 650, 1050, 1.0, 0.9, "low"),
    ("北京-包头线", "北京", "包头", 550, 1050, 1.2, 1.0, "medium"),
    ("北京-乌兰浩特线", "北京", "乌兰浩特", 700, 1300, 0.9, 1.1, "high"),
    ("北京-海拉尔线", "北京", "海拉尔", 900, 1500, 0.8, 1.2, "high"),
    ("北京-锡林浩特线", "北京", "锡林浩特", 600, 1050, 1.0, 1.0, "medium"),
    ("北京-乌海线", "北京", "乌海", 750, 1150, 0.9, 0.95, "low"),
    ("呼和浩特-巴彦淖尔线", "呼和浩特", "巴彦淖尔", 250, 650, 1.5, 0.85, "low"),
    ("呼和浩特-通辽线", "呼和浩特", "通辽", 450, 850, 1.3, 0.9, "low"),
    ("呼和浩特-成都线", "呼和浩特", "成都", 1200, 1900, 0.7, 1.15, "high"),
    ("呼和浩特-重庆线", "呼和浩特", "重庆", 1300, 2000, 0.7, 1.2, "high"),
    ("呼和浩特-广州线", "呼和浩特", "广州", 2000, 2400, 0.6, 1.25, "high"),
    ("呼和浩特-海口线", "呼和浩特", "海口", 2500, 2600, 0.5, 1.3, "high"),
    ("呼和浩特-乌兰巴托线", "呼和浩特", "乌兰巴托", 600, 2100, 0.8, 1.1, "high"),
    ("呼和浩特-满洲里线", "呼和浩特", "满洲里", 700, 1200, 0.9, 1.0, "medium"),
    ("呼和浩特-石家庄线", "呼和浩特", "石家庄", 500, 950, 1.1, 0.95, "medium"),
    ("呼和浩特-西安线", "呼和浩特", "西安", 800, 1300, 0.9, 1.05, "medium"),
    ("呼和浩特-杭州线", "呼和浩特", "杭州", 1500, 2100, 0.7, 1.15, "high"),
)

FLIGHT_NUMBERS = (
    ("北京-通辽线", ("CA1123", "CA1124", "CA8689", "CA8690")),
    ("北京-鄂尔多斯线", ("CA1141", "CA1142", "CA1149", "CA1150")),
    ("北京-呼和浩特线", ("CA1111", "CA1112")),
    ("北京-巴彦淖尔线", ("CA1147", "CA1148", "CA8363", "CA8364")),
    ("北京-包头线", ("CA1121", "CA1122")),
    ("北京-乌兰浩特线", ("CA1135", "CA1136")),
    ("北京-海拉尔线", ("CA1131", "CA1132")),
    ("北京-锡林浩特线", ("CA1109", "CA1110", "CA8625", "CA8626")),
    ("北京-乌海线", ("CA8607", "CA8608")),
    ("呼和浩特-巴彦淖尔线", ("CA8173", "CA8174", "CA8175", "CA8176")),
    ("呼和浩特-通辽线", ("CA8177", "CA8178")),
    ("呼和浩特-成都线", ("CA8141", "CA8142", "CA8143", "CA8144")),
    ("呼和浩特-重庆线", ("CA8145", "CA8146")),
    ("呼和浩特-广州线", ("CA8147", "CA8148")),
    ("呼和浩特-海口线", ("CA8149", "CA8150")),
    ("呼和浩特-乌兰巴托线", ("CA8151", "CA8152")),
    ("呼和浩特-满洲里线", ("CA8153", "CA8154")),
    ("呼和浩特-石家庄线", ("CA8155", "CA8156")),
    ("呼和浩特-西安线", ("CA8157", "CA8158")),
    ("呼和浩特-杭州线", ("CA8159", "CA8160")),
)

AIRCRAFT_SEATS = (
    ("738", 166),
    ("73W", 166),
    ("73E", 175),
    ("73F", 166),
    ("73B", 158),
    ("73K", 158),
    ("ARJ", 89),
    ("7S7", 127),
    ("737", 127),
)

SUBSIDY_ROUTES_A = (
    "北京-通辽线",
    "北京-鄂尔多斯线",
    "北京-巴彦淖尔线",
    "呼和浩特-巴彦淖尔线",
    "呼和浩特-通辽线",
    "北京-锡林浩特线",
    "北京-乌海线",
)
SUBSIDY_ROUTES_B = (
    "北京-呼和浩特线",
    "北京-包头线",
    "呼和浩特-石家庄线",
    "呼和浩特-西安线",
    "呼和浩特-满洲里线",
)

# --- cleaning and statistics --------------------------------------------------------------------

IQR_COLUMNS = ("ticket_price", "load_factor", "profit_margin")
REQUIRED_COLUMNS = ("route_name", "ticket_price", "load_factor", "profit_margin")
IQR_REACH = 1.5
MIN_ELASTICITY_ROWS = 10

# --- route recommendations ----------------------------------------------------------------------

HIGH_LOAD = 0.85
LOW_LOAD = 0.6

# name -> (strategy, price adjustment, reason)
RAISE = ("提高票价", 0.15, "客座率高但利润率为负，说明票价过低，无法覆盖成本")
SMALL_RAISE = ("小幅提高票价", 0.08, "客座率高且利润率为正，市场需求强劲，可以适当提高票价")
LOWER = ("降低票价", -0.12, "客座率低且利润率为负，需要降低票价刺激需求")
OPTIMISE_COST = ("优化成本结构", 0.05, "客座率适中但利润率为负，需要优化成本结构并小幅调整票价")
KEEP = ("维持现价", 0.0, "客座率和利润率处于合理水平，建议维持现有票价")

# --- flight quotes ------------------------------------------------------------------------------

# (factor, reason)
QUOTE_HOLIDAY = (1.15, "假期期间需求增加")
QUOTE_NO_HOLIDAY = (1.0, "非假期期间")

QUOTE_NEAR_WEEKEND_DAYS = ("周五", "周日")
QUOTE_NEAR_WEEKEND = (1.08, "周末前后需求较高")
QUOTE_PEAK_DAYS = ("周六",)
QUOTE_PEAK = (1.12, "周末需求高峰")
QUOTE_WORKDAY = (0.95, "平日需求较低")

# The seasonal factor is the index itself; only the reason depends on thresholds.
QUOTE_SEASON_HIGH = (1.1, "处于旅游旺季")
QUOTE_SEASON_LOW = (0.9, "处于淡季")
QUOTE_SEASON_ELSE = "季节性因素适中"

# (threshold, factor, reason); above the first, below the second, else the third
QUOTE_LOAD_HIGH = (0.85, 1.1, "预期客座率高，需求强劲")
QUOTE_LOAD_LOW = (0.7, 0.9, "预期客座率低，需求疲软")
QUOTE_LOAD_ELSE = (1.0, "预期客座率适中")

QUOTE_RIVAL_HIGH = (0.85, 1.05, "竞争对手客座率高，市场需求强劲")
QUOTE_RIVAL_LOW = (0.7, 0.95, "竞争对手客座率低，市场需求疲软")
QUOTE_RIVAL_ELSE = (1.0, "竞争对手客座率适中")

QUOTE_ELASTIC_HIGH = (1.2, 0.95, "价格弹性高，需谨慎定价")
QUOTE_ELASTIC_LOW = (0.8, 1.05, "价格弹性低，可适当提高价格")
QUOTE_ELASTIC_ELSE = (1.0, "价格弹性适中")

# (above 1.2, above 0.8, else)
ELASTICITY_LEVELS = ("高", "中", "低")
ELASTICITY_WORDS = ("非常敏感", "较为敏感", "不太敏感")
PRICE_SENSITIVITY = ("高", "中等", "低")
ABOVE, BELOW = "高于", "低于"

# --- prompts and responses ----------------------------------------------------------------------

DEFAULT_QUERIES = (
    "分析当前航线的定价策略，识别哪些航线的定价过高或过低，并提供具体的调价建议。",
    "分析客座率与票价之间的关系，找出最佳的价格点以最大化收入。",
    "分析季节性因素对航线定价的影响，并提供不同季节的差异化定价策略。",
    "分析价格弹性对不同航线的影响，识别哪些航线对价格变化更敏感。",
    "提供一个综合的动态定价优化方案，考虑所有相关因素。",
)

# Every prompt line stands on its own, indented by eight spaces. %s takes the data as JSON, then the
# question.
PROMPT_INDENT = "        "

ANALYSIS_PROMPT_LINES = (
    "作为一位航空公司定价专家，你需要分析以下航班数据并提供定价策略建议。",
    "",
    "# 数据概述",
    "```json",
    "%s",
    "```",
    "",
    "# 分析任务",
    "%s",
    "",
    "# 分析要求",
    "1. 请先理解数据结构和各字段含义",
    "2. 分析当前定价策略的优缺点",
    "3. 识别影响定价的关键因素（如客座率、成本、竞争等）",
    "4. 提出具体的定价优化建议，包括具体的调价幅度",
    "5. 考虑不同航线的特点，提供差异化定价策略",
    "",
    "# 分析步骤",
    "1. 首先，分析整体数据趋势和模式",
    "2. 其次，识别表现最好和最差的航线",
    "3. 然后，分析影响定价的关键因素",
    "4. 接着，提出针对性的定价策略",
    "5. 最后，总结建议并预测实施效果",
    "",
    "请详细展示你的思考过程，然后给出最终的定价建议。",
)

# %s in order: route, date, holiday, weekday, aircraft, seats, elasticity, season, load, rival load,
# historical load, rival price.
QUOTE_PROMPT_LINES = (
    "基于历史航班数据，为以下航班提供最优定价建议：",
    "",
    "航线: %s",
    "日期: %s",
    "是否假期: %s",
    "星期几: %s",
    "机型: %s",
    "座位容量: %s",
    "价格弹性: %s",
    "季节性指数: %s",
    "预期客座率: %s",
    "竞争对手客座率: %s",
    "历史客座率: %s",
    "竞争对手价格: %s元",
    "",
    "请分析该航班的最优定价区间，并给出具体的定价建议。考虑季节性因素、周内模式、假期影响、价格弹性、竞争情况等因素。",
    "提供详细的分析过程和定价建议，包括最优价格点和价格区间。",
)

THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"
REASONING_WORD = "思考过程"
ERROR_PREFIX = "错误: "
NO_CHOICES_SHORT = "无法从响应中提取内容"
NO_CHOICES_LONG = "无法从响应中提取内容: 缺少'choices'字段或为空"
NO_CONTENT = "无法从响应中提取内容: 缺少'content'字段"

# Characters that count as whitespace when a text is trimmed.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Texts that count as missing in a CSV file, besides the empty one.
CSV_MISSING = (
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
