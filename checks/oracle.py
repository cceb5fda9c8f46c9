"""SQL that states the same results independently, for DuckDB over the test tables."""

from __future__ import annotations

from farelens import fixed_values as fixed


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def mean(expr: str, digits: int = 4) -> str:
    """Rounding of aggregates: noise removed first, then half to even."""
    return (
        f"(round_even(round_even(({expr}) * 1e{digits + 6}, 0) / 1e6, 0) / 1e{digits})::DOUBLE"
    )


def row(expr: str, digits: int = 2) -> str:
    """Rounding of row values, half to even."""
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits})::DOUBLE"


def clamp(expr: str, low: str, high: str) -> str:
    return f"greatest({low}::DOUBLE, least({high}::DOUBLE, {expr}))"


def strip(expr: str) -> str:
    spaces = " || ".join(f"chr({ord(c)})" for c in fixed.WHITESPACE)
    return f"trim({expr}, {spaces})"


_MONTH_DAYS = "('01-01', '01-28', '02-01', '04-05', '05-01', '05-02')"
_SEASON = (
    "(CASE WHEN month({d}) IN (12, 1, 2) THEN 0.9 WHEN month({d}) IN (6, 7, 8) THEN 1.2 "
    "WHEN month({d}) IN (3, 4, 5) THEN 1.1 ELSE 1.0 END)::DOUBLE"
)
_NATION_TIER = "(CASE s_nationkey % 3 WHEN 0 THEN 0.6 WHEN 1 THEN 0.7 ELSE 0.8 END)::DOUBLE"

JOINED = f"""
joined AS (
  SELECT l.*, l_shipdate::DATE AS day, p_type, p_retailprice, s_nationkey, c_nationkey,
         sn.n_name AS departure_city, cn.n_name AS arrival_city,
         10 + 2 * c_nationkey AS cap, (250 + 90 * c_nationkey)::DOUBLE AS distance
  FROM lineitem l
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey
)"""

FLIGHTS = (
    JOINED
    + f""",
base AS (
  SELECT *,
    l_orderkey * 10 + l_linenumber AS flight_id,
    'FL' || l_suppkey AS flight_number,
    departure_city || '-' || arrival_city AS route_name,
    strftime(day, '%Y-%m-%d') AS flight_date,
    isodow(day)::INTEGER AS day_of_week,
    (strftime(day, '%m-%d') IN {_MONTH_DAYS})::INTEGER AS is_holiday,
    p_type AS aircraft_type,
    cap AS seat_capacity,
    greatest(0.4::DOUBLE, least(0.98::DOUBLE, l_quantity / cap)) AS load_factor,
    l_extendedprice / l_quantity AS avg_ticket_price,
    1.0::DOUBLE - l_discount AS discount_rate,
    l_extendedprice * (1.0::DOUBLE - l_discount) AS total_revenue,
    l_quantity * p_retailprice * {_NATION_TIER} AS total_cost,
    {_SEASON.format(d="day")} AS seasonal_index,
    0.5::DOUBLE + (l_partkey % 11) / 10.0::DOUBLE AS price_elasticity
  FROM joined
),
flights AS (
  SELECT *,
    floor(cap * load_factor)::INTEGER AS booked_seats,
    0.7::DOUBLE * total_cost AS variable_cost,
    total_revenue - total_cost AS profit,
    (total_revenue - total_cost) / total_revenue AS profit_rate,
    total_revenue - 0.7::DOUBLE * total_cost AS marginal_contribution,
    (total_revenue - 0.7::DOUBLE * total_cost) / total_revenue AS marginal_contribution_rate,
    {clamp("load_factor + (l_suppkey % 5 - 2) / 20.0::DOUBLE", "0.3", "0.95")}
      AS competitor_load_factor,
    {clamp("load_factor + (l_partkey % 5 - 2) / 20.0::DOUBLE", "0.3", "0.95")}
      AS historical_load_factor,
    round_even(avg_ticket_price, 0)::INTEGER AS competitor_price,
    day AS date,
    month(day)::INTEGER AS month,
    avg_ticket_price AS ticket_price,
    (total_revenue - total_cost) / total_revenue AS profit_margin,
    floor(cap * load_factor)::INTEGER AS sold_seats
  FROM base
)"""
)


def flights_sql(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([FLIGHTS, *more]) + "\n" + body


_GAPS = """gaps AS (
  SELECT * REPLACE (
    flight_id + 9007199254740990 AS flight_id,
    CASE WHEN flight_id % 10 <> 3 THEN avg_ticket_price END AS avg_ticket_price,
    CASE WHEN flight_id % 10 <> 5 THEN aircraft_type END AS aircraft_type,
    CASE WHEN flight_id % 10 <> 2 THEN booked_seats END AS booked_seats,
    CASE WHEN flight_id % 10 <> 6 THEN route_name END AS route_name,
    CASE WHEN flight_id % 10 <> 4 THEN price_elasticity END AS price_elasticity)
  FROM flights
)"""


def _bounds(source: str, price: str = "ticket_price") -> str:
    parts = []
    for name, expr in (
        ("ticket_price", price),
        ("load_factor", "load_factor"),
        ("profit_margin", "profit_margin"),
    ):
        q1, q3 = f"quantile_cont({expr}, 0.25)", f"quantile_cont({expr}, 0.75)"
        parts.append(f"{q1} - ({q3} - {q1}) * 1.5 AS {name}_low")
        parts.append(f"{q3} + ({q3} - {q1}) * 1.5 AS {name}_high")
    return f"bounds AS (SELECT {', '.join(parts)} FROM {source})"


def _capped(name: str, expr: str | None = None) -> str:
    expr = expr or name
    return (
        f"CASE WHEN {expr} < {name}_low THEN {name}_low WHEN {expr} > {name}_high "
        f"THEN {name}_high ELSE {expr} END"
    )


# --- flight plan --------------------------------------------------------------------------------

_PLAN_STEPS = f""",
plan AS (
  SELECT l_orderkey * 10 + l_linenumber AS flight_id, day, distance, cap AS seat_capacity,
    isodow(day) AS dow, strftime(day, '%m-%d') IN {_MONTH_DAYS} AS holiday,
    p_retailprice AS base_price,
    0.85::DOUBLE + ((s_nationkey * 7 + c_nationkey) % 10) / 20.0::DOUBLE AS seasonal_index,
    CASE s_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS tier,
    10.0::DOUBLE + 8.0::DOUBLE * (l_discount * 10.0::DOUBLE) AS variable_rate,
    5.0::DOUBLE + 60.0::DOUBLE * l_tax AS fixed_rate,
    0.5::DOUBLE + 1.5::DOUBLE * (l_discount * 10.0::DOUBLE) AS maintenance_rate,
    0.65::DOUBLE + l_quantity / 200.0::DOUBLE AS base_load,
    0.7::DOUBLE + 3.0::DOUBLE * l_tax AS discount_rate,
    {row("40.0::DOUBLE * l_tax")} AS subsidy_revenue,
    (l_suppkey % 5 - 2) / 20.0::DOUBLE AS competitor_shift,
    (l_partkey % 5 - 2) / 20.0::DOUBLE AS historical_shift
  FROM joined
),
demand AS (
  SELECT *, seasonal_index * {_SEASON.format(d="day")} AS adjusted_seasonal_index,
    (CASE WHEN dow IN (1, 4) THEN 0.85 WHEN dow IN (5, 6) THEN 1.15 WHEN dow = 7 THEN 1.2
     ELSE 1.0 END)::DOUBLE AS day_factor,
    (CASE WHEN holiday THEN 1.3 ELSE 1.0 END)::DOUBLE AS holiday_factor,
    {row("distance / 800")} AS flight_hours,
    (CASE tier WHEN 'high' THEN 0.6 WHEN 'medium' THEN 0.7 ELSE 0.8 END)::DOUBLE AS cost_factor,
    (CASE tier WHEN 'high' THEN 1.15 WHEN 'medium' THEN 1.1 ELSE 1.05 END)::DOUBLE AS price_factor
  FROM plan
),
costs AS (
  SELECT *, {row("variable_rate * cost_factor * flight_hours")} AS variable_cost,
    {row("fixed_rate * cost_factor")} AS fixed_cost,
    {row("maintenance_rate * flight_hours * cost_factor")} AS maintenance_cost,
    {clamp("base_load * day_factor * holiday_factor * adjusted_seasonal_index", "0.4", "0.98")}
      AS load_factor
  FROM demand
),
priced AS (
  SELECT *, {row("variable_cost + fixed_cost + maintenance_cost")} AS total_cost,
    trunc(seat_capacity * load_factor)::INTEGER AS booked_seats,
    {clamp("load_factor + competitor_shift", "0.3", "0.95")} AS competitor_load_factor,
    {clamp("load_factor + historical_shift", "0.3", "0.95")} AS historical_load_factor,
    {row(row("base_price * discount_rate * (1.0::DOUBLE + (adjusted_seasonal_index - 1.0::DOUBLE)"
             " * 0.5::DOUBLE)") + " * price_factor")} AS avg_ticket_price
  FROM costs
),
earned AS (
  SELECT *, {row("avg_ticket_price * booked_seats / 10000")} AS passenger_revenue,
    {row(row("avg_ticket_price * booked_seats / 10000") + " + subsidy_revenue")} AS total_revenue
  FROM priced
),
gained AS (
  SELECT *, {row("total_revenue - variable_cost")} AS marginal_contribution,
    {row("total_revenue - total_cost")} AS operational_profit,
    {row("seat_capacity * distance / 10000")} AS ask,
    {row("variable_cost * 10000 / (seat_capacity * 0.7::DOUBLE)")} AS price_lower_bound,
    {row("base_price * 1.2::DOUBLE")} AS price_upper_bound
  FROM earned
)
"""


def plan_sql(columns: str) -> str:
    return f"WITH {JOINED}{_PLAN_STEPS}SELECT flight_id, {columns} FROM gained"


# --- routes -------------------------------------------------------------------------------------

_ROUTE_DIMENSION = """route_dimension AS (
  SELECT DISTINCT departure_city || '-' || arrival_city AS route_name,
    250 + 90 * c_nationkey AS distance,
    500 + 40 * s_nationkey + 10 * c_nationkey AS base_price,
    0.5::DOUBLE + ((s_nationkey + c_nationkey) % 11) / 10.0::DOUBLE AS elasticity,
    0.85::DOUBLE + ((s_nationkey * 7 + c_nationkey) % 10) / 20.0::DOUBLE AS route_season,
    CASE s_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS profitability
  FROM joined
)"""


def _halves(source: str, key: str = "route_name") -> str:
    """Elasticity by halves, with every flight of a route ordered."""
    return f"""ordered AS (
  SELECT {key} AS k, ticket_price AS p, sold_seats AS s, price_elasticity AS e,
    row_number() OVER (PARTITION BY {key} ORDER BY ticket_price, sold_seats) AS rn,
    count(*) OVER (PARTITION BY {key}) AS n
  FROM {source}
),
halves AS (
  SELECT k, any_value(n) AS n, avg(e) AS supplied,
    avg(p) FILTER (rn <= n // 2) AS lp, avg(p) FILTER (rn > n // 2) AS hp,
    avg(s) FILTER (rn <= n // 2) AS ls, avg(s) FILTER (rn > n // 2) AS hs
  FROM ordered GROUP BY k
),
elasticities AS (
  SELECT k, n, supplied,
    CASE WHEN n >= 10 THEN ((hs - ls) / nullif(ls, 0)) / nullif((hp - lp) / nullif(lp, 0), 0) END AS e
  FROM halves
)"""


def _profile(source: str) -> tuple[str, ...]:
    return (
        _halves(source),
        f"""monthly AS (
  SELECT route_name, month, avg(ticket_price) AS month_price FROM {source} GROUP BY ALL
)""",
        f"""means AS (
  SELECT route_name, avg(ticket_price) AS price, avg(load_factor) AS load,
    avg(profit_margin) AS margin, count(*) AS n
  FROM {source} GROUP BY ALL
)""",
        f"""seasons AS (
  SELECT route_name, month, {mean("month_price / price", 2)} AS ratio
  FROM monthly JOIN means USING (route_name)
)""",
        f"""profiles AS (
  SELECT route_name, {mean("price", 2)} AS avg_price, {mean("load", 2)} AS avg_load_factor,
    {mean("margin", 2)} AS avg_profit_margin,
    {mean("CASE WHEN elasticities.n >= 10 THEN e ELSE supplied END", 2)} AS price_elasticity,
    means.n AS sample_count
  FROM means JOIN elasticities ON route_name = k
)""",
    )


_SEASON_TEXT = """season_text AS (
  SELECT route_name, string_agg(month || ':' || printf('%.2f', ratio), ';' ORDER BY month)
    AS seasonal_index
  FROM seasons GROUP BY route_name
)"""


def _selection(max_routes: int) -> str:
    return f"""ranked AS (
  SELECT route_name, avg_profit_margin AS m,
    row_number() OVER (ORDER BY avg_profit_margin DESC, route_name) AS best,
    row_number() OVER (ORDER BY avg_profit_margin, route_name) AS worst
  FROM profiles
),
listed AS (
  SELECT route_name, 1 AS part, best AS pos FROM ranked WHERE best <= 3
  UNION ALL
  SELECT * FROM (
    SELECT route_name, 2, 0 FROM ranked WHERE best > 3 AND worst > 3
    ORDER BY md5(route_name || '#42'), route_name LIMIT {max(0, max_routes - 6)})
  UNION ALL
  SELECT route_name, 3, worst FROM ranked WHERE worst <= 3
),
chosen AS (
  SELECT route_name FROM listed ORDER BY part, pos, route_name LIMIT {max_routes}
)"""


_OVERALL_STRUCT = f"""{{
  'avg_price': {mean("avg(ticket_price)", 2)},
  'avg_load_factor': {mean("avg(load_factor)", 2)},
  'avg_profit_margin': {mean("avg(profit_margin)", 2)},
  'total_routes': count(DISTINCT route_name),
  'total_samples': count(*),
  'date_range': {{'start': strftime(min(date), '%Y-%m-%d'), 'end': strftime(max(date), '%Y-%m-%d')}}
}}"""


def _summary_parts(max_routes: int, rows: str = "flights") -> tuple[str, ...]:
    return (
        *_profile(rows),
        _selection(max_routes),
        """season_maps AS (
  SELECT route_name, map_from_entries(list((month::VARCHAR, ratio) ORDER BY month)) AS seasonal_index
  FROM seasons GROUP BY route_name
)""",
        """entries AS (
  SELECT route_name, {
    'avg_price': avg_price, 'avg_load_factor': avg_load_factor,
    'avg_profit_margin': avg_profit_margin, 'price_elasticity': price_elasticity,
    'seasonal_index': seasonal_index, 'sample_count': sample_count} AS profile
  FROM profiles JOIN season_maps USING (route_name)
)""",
    )


_RANKED_LISTS = """
  'best_performing_routes': (SELECT list({'route': route_name, 'profit_margin': m} ORDER BY best)
                             FROM ranked WHERE best <= 3),
  'worst_performing_routes': (SELECT list({'route': route_name, 'profit_margin': m} ORDER BY worst)
                              FROM ranked WHERE worst <= 3)"""

_SAMPLES = """(SELECT list({
    'date': strftime(date, '%Y-%m-%d'), 'route_name': route_name, 'flight_number': flight_number,
    'flight_id': flight_id, 'total_revenue': total_revenue, 'total_cost': total_cost,
    'ticket_price': ticket_price, 'load_factor': load_factor, 'profit_margin': profit_margin,
    'month': month}
    ORDER BY date, route_name, flight_number, flight_id, total_revenue, total_cost)
  FROM (SELECT * FROM flights
        ORDER BY date, route_name, flight_number, flight_id, total_revenue, total_cost LIMIT 10))"""

_SIMPLE_JSON = f"""to_json({{
  'overall_stats': (SELECT {_OVERALL_STRUCT} FROM flights),{_RANKED_LISTS},
  'route_stats': (SELECT map_from_entries(list((route_name, profile) ORDER BY route_name))
                  FROM entries WHERE route_name IN (SELECT route_name FROM chosen))
}})::VARCHAR"""

# --- quotes -------------------------------------------------------------------------------------

_REQUESTS = f"""requests AS (
  SELECT route_name AS route, flight_date AS date, is_holiday = 1 AS is_holiday,
    [{", ".join(text(n) for n in fixed.WEEKDAY_NAMES)}][day_of_week] AS day_of_week,
    aircraft_type, seat_capacity, price_elasticity, seasonal_index, load_factor,
    competitor_load_factor, historical_load_factor, competitor_price
  FROM flights
)"""


def _band(col: str, high: str, low: str, values: tuple[str, str, str], kind: str) -> str:
    a, b, c = values
    return f"(CASE WHEN {col} > {high} THEN {a} WHEN {col} < {low} THEN {b} ELSE {c} END)::{kind}"


_LOAD_BAND = _band("load_factor", "0.85", "0.7", ("1.1", "0.9", "1.0"), "DOUBLE")
_QUOTE_FACTOR = (
    "(CASE WHEN is_holiday THEN 1.15 ELSE 1.0 END)::DOUBLE"
    " * (CASE WHEN day_of_week IN ('周五', '周日') THEN 1.08 WHEN day_of_week = '周六' THEN 1.12"
    " ELSE 0.95 END)::DOUBLE"
    " * seasonal_index * "
    + _LOAD_BAND
    + " * "
    + _band("competitor_load_factor", "0.85", "0.7", ("1.05", "0.95", "1.0"), "DOUBLE")
    + " * "
    + _band("price_elasticity", "1.2", "0.8", ("0.95", "1.05", "1.0"), "DOUBLE")
)
_MARGIN = clamp(f"0.15::DOUBLE + ({_LOAD_BAND} - 0.8::DOUBLE) * 0.5::DOUBLE", "0.05", "0.3")


def whole(expr: str) -> str:
    return f"round_even({expr}, 0)::BIGINT"


def _elastic_words(words: tuple[str, str, str]) -> str:
    a, b, c = (text(w) for w in words)
    return f"CASE WHEN price_elasticity > 1.2 THEN {a} WHEN price_elasticity > 0.8 THEN {b} ELSE {c} END"


def _percent(expr: str, digits: int = 2) -> str:
    return f"printf('%.{digits}f%%', {mean(f'({expr}) * 100', digits)})"


def _money(expr: str) -> str:
    return f"printf('%.2f', {mean(expr, 2)})"


_RULE_CONDITIONS = (
    "load > 0.85 AND profit_mean < 0",
    "load > 0.85 AND profit_mean > 0",
    "load < 0.6 AND profit_mean < 0",
    "load BETWEEN 0.6 AND 0.85 AND profit_mean < 0",
)
_RULES = (fixed.RAISE, fixed.SMALL_RAISE, fixed.LOWER, fixed.OPTIMISE_COST)


def _rule(part: int) -> str:
    def shown(value) -> str:
        return text(value) if isinstance(value, str) else f"{value}::DOUBLE"

    cases = " ".join(
        f"WHEN {condition} THEN {shown(rule[part])}"
        for condition, rule in zip(_RULE_CONDITIONS, _RULES)
    )
    return f"CASE {cases} ELSE {shown(fixed.KEEP[part])} END"


_ADVICE = f"""route_means AS (
  SELECT route_name, avg(load_factor) AS load, avg(avg_ticket_price) AS price,
    avg(profit_rate) AS profit_mean, avg(marginal_contribution_rate) AS marginal_mean,
    count(*) AS flight_count
  FROM flights GROUP BY route_name
),
advice AS (
  SELECT *, {_rule(0)} AS strategy, {_rule(1)} AS price_adjustment, {_rule(2)} AS reason,
    price * (1.0::DOUBLE + {_rule(1)}) AS recommended_price
  FROM route_means
)"""


# --- prompts, as the model is to see them; stated here and not taken from the package ------------------

_ANALYSIS_PROMPT = """
        作为一位航空公司定价专家，你需要分析以下航班数据并提供定价策略建议。
        
        # 数据概述
        ```json
        %s
        ```
        
        # 分析任务
        %s
        
        # 分析要求
        1. 请先理解数据结构和各字段含义
        2. 分析当前定价策略的优缺点
        3. 识别影响定价的关键因素（如客座率、成本、竞争等）
        4. 提出具体的定价优化建议，包括具体的调价幅度
        5. 考虑不同航线的特点，提供差异化定价策略
        
        # 分析步骤
        1. 首先，分析整体数据趋势和模式
        2. 其次，识别表现最好和最差的航线
        3. 然后，分析影响定价的关键因素
        4. 接着，提出针对性的定价策略
        5. 最后，总结建议并预测实施效果
        
        请详细展示你的思考过程，然后给出最终的定价建议。
        """

_QUOTE_PROMPT = """
        基于历史航班数据，为以下航班提供最优定价建议：
        
        航线: %s
        日期: %s
        是否假期: %s
        星期几: %s
        机型: %s
        座位容量: %s
        价格弹性: %s
        季节性指数: %s
        预期客座率: %s
        竞争对手客座率: %s
        历史客座率: %s
        竞争对手价格: %s元
        
        请分析该航班的最优定价区间，并给出具体的定价建议。考虑季节性因素、周内模式、假期影响、价格弹性、竞争情况等因素。
        提供详细的分析过程和定价建议，包括最优价格点和价格区间。
        """


def _object(fields: list[tuple[str, str]], depth: int) -> str:
    """SQL text of a JSON object, a field a line; the values are SQL expressions."""
    inside, end = "  " * (depth + 1), "  " * depth
    parts = [f"""'{inside}"{name}": ' || coalesce(({value})::VARCHAR, 'null')""" for name, value in fields]
    return "'{' || chr(10) || " + " || ',' || chr(10) || ".join(parts) + f" || chr(10) || '{end}}}'"


def _ranked_text(order: str) -> str:
    row = _object([("route", """'"' || route_name || '"'"""), ("profit_margin", "m")], 2)
    return f"(SELECT '[' || chr(10) || string_agg('    ' || {row}, ',' || chr(10) ORDER BY {order}) || chr(10) || '  ]' FROM ranked WHERE {order} <= 3)"


_OVERALL_TEXT = _object(
    [
        ("avg_price", mean("avg(ticket_price)", 2)),
        ("avg_load_factor", mean("avg(load_factor)", 2)),
        ("avg_profit_margin", mean("avg(profit_margin)", 2)),
        ("total_routes", "count(DISTINCT route_name)"),
        ("total_samples", "count(*)"),
        ("date_range", _object([("start", """'"' || min(flight_date) || '"'"""), ("end", """'"' || max(flight_date) || '"'""")], 2)),
    ],
    1,
)
_SEASON_LINES = """season_lines AS (
  SELECT route_name, '{' || chr(10) || string_agg('        "' || month || '": ' || ratio, ',' || chr(10) ORDER BY month)
    || chr(10) || '      }' AS season
  FROM seasons GROUP BY route_name
)"""
_PROFILE_TEXT = _object(
    [(c, c) for c in ("avg_price", "avg_load_factor", "avg_profit_margin", "price_elasticity")]
    + [("seasonal_index", "season"), ("sample_count", "sample_count")],
    2,
)


def _indented_json(rows: str = "flights") -> str:
    return _object(
        [
            ("overall_stats", f"SELECT {_OVERALL_TEXT} FROM {rows}"),
            ("best_performing_routes", _ranked_text("best")),
            ("worst_performing_routes", _ranked_text("worst")),
            (
                "route_stats",
                f"""SELECT '{{' || chr(10) || string_agg('    "' || route_name || '": ' || {_PROFILE_TEXT}, ',' || chr(10) ORDER BY route_name)
  || chr(10) || '  }}' FROM profiles JOIN season_lines USING (route_name) WHERE route_name IN (SELECT route_name FROM chosen)""",
            ),
        ],
        0,
    )


def _template(template: str, *values: str) -> str:
    """Concatenation of the template's pieces and the given SQL values."""
    pieces = template.split("%s")
    parts = [text(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        parts += [value, text(piece)]
    return " || ".join(parts)


# --- responses ----------------------------------------------------------------------------------
# The expected parts are stated from the raw turns, not by taking JSON apart.

_EXCHANGES = """exchanges AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS reply, (u.conv_id + u.turn) % 8 AS shape
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""

_WORD_TEXT = "'思考过程:' || chr(10) || question || chr(10) || '# 答' || chr(10) || reply"
_TWICE_TEXT = "'前  中 <think>二</think> ' || reply"


def _answer(no_choices: str, no_content: str) -> str:
    return f"""CASE shape
    WHEN 2 THEN {strip(_WORD_TEXT)}
    WHEN 3 THEN {text(fixed.ERROR_PREFIX)} || question
    WHEN 4 THEN {text(no_choices)}
    WHEN 5 THEN {no_content}
    WHEN 7 THEN {strip(_TWICE_TEXT)}
    ELSE {strip("reply")} END"""


_ANSWER = _answer(fixed.NO_CHOICES_SHORT, "NULL")
_ANSWER_ALT = _answer(fixed.NO_CHOICES_LONG, text(fixed.NO_CONTENT))
_REASONING = (
    f"CASE WHEN shape = 0 THEN question WHEN shape IN (1, 7) THEN {strip('question')} END"
)
# A heading inside the question would end the reasoning there.
_WORD_REASONING = strip("split_part(':' || chr(10) || question || chr(10) || '#', '#', 1)")
_REASONING_ALT = (
    f"CASE WHEN shape IN (1, 7) THEN {strip('question')} WHEN shape = 2 THEN {_WORD_REASONING} END"
)

_STAT_COLUMNS = ("load_factor", "avg_ticket_price", "profit_rate", "marginal_contribution_rate")
_STAT_MEANS = ", ".join(f"{mean(f'avg({c})')} AS {c}" for c in _STAT_COLUMNS)
_ROUTE_STATS = f"""SELECT route_name, {_STAT_MEANS},
  {mean("sum(total_revenue)")} AS total_revenue, {mean("sum(profit)")} AS profit,
  count(*) AS flight_count
FROM flights GROUP BY route_name"""

_MARGINS = f"""profiles AS (
  SELECT route_name, {mean("avg(profit_margin)", 2)} AS avg_profit_margin
  FROM flights GROUP BY route_name
)"""


def _every() -> dict[str, str]:
    gap_bounds = _bounds("filled", "ticket_price")
    filled = f"""filled AS (
  SELECT * REPLACE (coalesce(avg_ticket_price, (SELECT median(avg_ticket_price) FROM gaps))
      AS avg_ticket_price,
    coalesce(avg_ticket_price, (SELECT median(avg_ticket_price) FROM gaps)) AS ticket_price,
    coalesce(booked_seats::DOUBLE, (SELECT median(booked_seats) FROM gaps)) AS booked_seats,
    coalesce(booked_seats::DOUBLE, (SELECT median(booked_seats) FROM gaps)) AS sold_seats,
    coalesce(price_elasticity, (SELECT median(price_elasticity) FROM gaps)) AS price_elasticity,
    coalesce(route_name, (SELECT route_name FROM gaps WHERE route_name IS NOT NULL
      GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS route_name,
    coalesce(aircraft_type, (SELECT aircraft_type FROM gaps WHERE aircraft_type IS NOT NULL
      GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS aircraft_type)
  FROM gaps
)"""
    box_reach = "(q3 - q1) * 1.5"
    return {
        "csv_roundtrip": flights_sql(_ROUTE_STATS),
        "summary_json": flights_sql(
            f"""SELECT 0 AS section, NULL AS route_name, substr(j, 1, length(j) - 1) || ',"route_stats":{{' AS line
FROM (SELECT to_json({{'overall_stats': (SELECT {_OVERALL_STRUCT} FROM flights),{_RANKED_LISTS}}})::VARCHAR AS j)
UNION ALL
SELECT 1, route_name, CASE WHEN route_name = (SELECT min(route_name) FROM entries) THEN '' ELSE ',' END || substr(j, 2, length(j) - 2)
FROM (SELECT route_name, to_json(map_from_entries([(route_name, profile)]))::VARCHAR AS j FROM entries)
UNION ALL
SELECT 2, NULL, '}},"sample_data":' || to_json({_SAMPLES})::VARCHAR || '}}'""",
            *_summary_parts(20),
        ),
        "summary_elasticity": flights_sql(
            "SELECT route_name, price_elasticity FROM profiles WHERE price_elasticity IS NOT NULL",
            *_profile("flights"),
        ),
        "resolve_date": flights_sql("SELECT flight_id, flight_date AS date FROM flights"),
        "add_calendar": flights_sql(
            "SELECT flight_id, month, (day_of_week - 1)::INTEGER AS day_of_week FROM flights"
        ),
        "missing_counts": flights_sql(
            """SELECT 'avg_ticket_price' AS column_name, count(*) AS missing FROM gaps
WHERE avg_ticket_price IS NULL
UNION ALL SELECT 'aircraft_type', count(*) FROM gaps WHERE aircraft_type IS NULL
UNION ALL SELECT 'booked_seats', count(*) FROM gaps WHERE booked_seats IS NULL
UNION ALL SELECT 'route_name', count(*) FROM gaps WHERE route_name IS NULL
UNION ALL SELECT 'price_elasticity', count(*) FROM gaps WHERE price_elasticity IS NULL""",
            _GAPS,
        ),
        "fill_numeric_median": flights_sql(
            f"""SELECT flight_id, {mean("avg_ticket_price")} AS avg_ticket_price,
  {mean("load_factor")} AS load_factor FROM filled""",
            _GAPS,
            filled,
        ),
        "fill_categorical_mode": flights_sql(
            "SELECT flight_id, aircraft_type, route_name FROM filled", _GAPS, filled
        ),
        "fill_missing": flights_sql(
            f"""SELECT flight_id, {mean("avg_ticket_price")} AS avg_ticket_price, aircraft_type,
  booked_seats, route_name FROM filled""",
            _GAPS,
            filled,
        ),
        "resolve_aliases": flights_sql(
            "SELECT flight_id, profit_margin, profit_rate, ticket_price, sold_seats FROM flights"
        ),
        "iqr_outlier_counts": flights_sql(
            " UNION ALL ".join(
                f"""SELECT '{c}' AS column_name, {mean(f"any_value({c}_low)")} AS lower_bound,
  {mean(f"any_value({c}_high)")} AS upper_bound,
  count(*) FILTER ({c} < {c}_low OR {c} > {c}_high) AS outliers
FROM flights, bounds"""
                for c in fixed.IQR_COLUMNS
            ),
            _bounds("flights"),
        ),
        "cap_iqr": flights_sql(
            "SELECT flight_id, "
            + ", ".join(f"{mean(_capped(c))} AS {c}" for c in fixed.IQR_COLUMNS)
            + " FROM flights, bounds",
            _bounds("flights"),
        ),
        "route_name": flights_sql("SELECT flight_id, route_name FROM flights"),
        "split_route": flights_sql(
            """SELECT flight_id, route_name, departure_city AS origin, arrival_city AS destination
FROM flights"""
        ),
        "preprocess": flights_sql(
            f"""SELECT flight_id, route_name, aircraft_type, flight_date AS date, month,
  (day_of_week - 1)::INTEGER AS day_of_week,
  {", ".join(f"{mean(_capped(c))} AS {c}" for c in fixed.IQR_COLUMNS)},
  {mean("avg_ticket_price")} AS avg_ticket_price, sold_seats, price_elasticity
FROM filled, bounds""",
            _GAPS,
            filled,
            gap_bounds,
        ),
        "demand_factors": plan_sql("adjusted_seasonal_index, day_factor, holiday_factor"),
        "flight_cost": plan_sql(
            "flight_hours, variable_cost, fixed_cost, maintenance_cost, total_cost"
        ),
        "load_and_seats": plan_sql(
            "load_factor, booked_seats, competitor_load_factor, historical_load_factor"
        ),
        "discount_band": plan_sql(
            "load_factor, "
            "(CASE WHEN load_factor > 0.85 THEN 0.9 WHEN load_factor > 0.7 THEN 0.8 ELSE 0.7 END)"
            "::DOUBLE AS discount_low, "
            "(CASE WHEN load_factor > 0.85 THEN 1.0 WHEN load_factor > 0.7 THEN 0.95 ELSE 0.85 END)"
            "::DOUBLE AS discount_high"
        ),
        "ticket_price": plan_sql("avg_ticket_price"),
        "revenue_profit": plan_sql(
            "passenger_revenue, total_revenue, marginal_contribution, "
            + row("CASE WHEN total_revenue > 0 THEN marginal_contribution / total_revenue ELSE 0 END", 4)
            + " AS marginal_contribution_rate, operational_profit, "
            + row("CASE WHEN total_revenue > 0 THEN operational_profit / total_revenue ELSE 0 END", 4)
            + " AS profit_rate, total_revenue - total_cost AS profit, "
            "CASE WHEN total_revenue > 0 THEN (total_revenue - total_cost) / total_revenue "
            "ELSE 0 END AS profit_margin"
        ),
        "unit_revenue": plan_sql(
            f"ask, {row('CASE WHEN ask > 0 THEN total_revenue / ask ELSE 0 END', 4)} AS rask"
        ),
        "optimal_price": plan_sql(
            "price_lower_bound, price_upper_bound, "
            + row(
                "CASE WHEN load_factor > 0.85 THEN least(price_upper_bound, avg_ticket_price * 1.1::DOUBLE) "
                "WHEN load_factor < 0.6 THEN greatest(price_lower_bound, avg_ticket_price * 0.9::DOUBLE) "
                "ELSE avg_ticket_price END"
            )
            + " AS optimal_price"
        ),
        "route_lookup": flights_sql(
            """SELECT flight_id, route_name, total_revenue, r.distance, r.base_price, elasticity,
  route_season, profitability
FROM flights LEFT JOIN route_dimension r USING (route_name)""",
            _ROUTE_DIMENSION,
        ),
        "capacity_lookup": flights_sql(
            """SELECT flight_id, aircraft_type, total_revenue,
  (CASE WHEN aircraft_type = 'SMALL' THEN -1 ELSE 80 + 10 * length(aircraft_type) END)::INTEGER
    AS seats
FROM flights"""
        ),
        "holiday_flag": flights_sql(
            "SELECT flight_id, flight_date, total_revenue, is_holiday FROM flights"
        ),
        "subsidy_tier": flights_sql(
            """SELECT flight_id, route_name,
  CASE WHEN r.base_price < 700 THEN 'A' WHEN r.base_price < 900 THEN 'B' ELSE 'none' END
    AS subsidy_tier,
  (CASE WHEN r.base_price < 700 THEN 3 WHEN r.base_price < 900 THEN 1 ELSE 0 END)::DOUBLE
    AS subsidy_low,
  (CASE WHEN r.base_price < 700 THEN 8 WHEN r.base_price < 900 THEN 4 ELSE 0 END)::DOUBLE
    AS subsidy_high
FROM flights JOIN route_dimension r USING (route_name)""",
            _ROUTE_DIMENSION,
        ),
        "select_routes": flights_sql(
            """SELECT profiles.*, seasonal_index FROM profiles JOIN season_text USING (route_name)
WHERE route_name IN (SELECT route_name FROM chosen)""",
            *_profile("flights"),
            _SEASON_TEXT,
            _selection(20),
        ),
        "middle_routes": flights_sql(
            """SELECT route_name, m AS avg_profit_margin FROM ranked WHERE best > 3 AND worst > 3""",
            _MARGINS,
            _selection(20),
        ),
        "route_flight_numbers": flights_sql(
            """SELECT route_name, string_agg(DISTINCT flight_number, ',' ORDER BY flight_number)
  AS flight_numbers
FROM flights GROUP BY route_name"""
        ),
        "overview": flights_sql(
            """SELECT count(*) AS n_rows, 36::BIGINT AS n_columns,
  count(DISTINCT route_name) AS n_routes, count(DISTINCT flight_number) AS n_flight_numbers,
  min(flight_date) AS first_date, max(flight_date) AS last_date
FROM flights"""
        ),
        "overall_means": flights_sql(f"SELECT {_STAT_MEANS} FROM flights"),
        "route_stats": flights_sql(_ROUTE_STATS),
        "route_means": flights_sql(
            "SELECT route_name, "
            + ", ".join(f"{mean(f'avg({c})')} AS {c}" for c in _STAT_COLUMNS[:3])
            + " FROM flights GROUP BY route_name"
        ),
        "load_price_corr": flights_sql(
            f"""SELECT {mean("corr(load_factor, avg_ticket_price)", 6)} AS load_price_corr
FROM flights"""
        ),
        "price_elasticity": flights_sql(
            f"""SELECT k AS route_name, {mean("e")} AS price_elasticity, n AS sample_count
FROM elasticities""",
            _halves("flights"),
        ),
        "elasticity_fallback": flights_sql(
            f"""SELECT k AS route_name,
  {mean("CASE WHEN n >= 10 THEN e ELSE supplied END")} AS price_elasticity, n AS sample_count
FROM elasticities""",
            _halves("flights", "route_name || '/' || aircraft_type"),
        ),
        "elasticity_rank": flights_sql(
            f"""SELECT route_name, {mean("avg(price_elasticity)")} AS price_elasticity
FROM flights GROUP BY route_name"""
        ),
        "route_seasonal_index": flights_sql(
            f"""SELECT route_name, month, {mean("month_price / price")} AS seasonal_index
FROM monthly JOIN means USING (route_name)""",
            *_profile("flights")[1:3],
        ),
        "route_profile": flights_sql(
            "SELECT profiles.*, seasonal_index FROM profiles JOIN season_text USING (route_name)",
            *_profile("flights"),
            _SEASON_TEXT,
        ),
        "clean_route_profile": flights_sql(
            "SELECT profiles.*, seasonal_index FROM profiles JOIN season_text USING (route_name)",
            _bounds("flights"),
            "capped AS (SELECT * REPLACE ("
            + ", ".join(f"{_capped(c)} AS {c}" for c in fixed.IQR_COLUMNS)
            + ") FROM flights, bounds)",
            *_profile("capped"),
            _SEASON_TEXT,
        ),
        "seasonal_fallback": flights_sql(
            f"""SELECT route_name, {mean("avg(seasonal_index)", 2)} AS avg_index,
  count(*) AS sample_count
FROM flights GROUP BY route_name"""
        ),
        "overall_stats": flights_sql(
            f"""SELECT {mean("avg(ticket_price)", 2)} AS avg_price,
  {mean("avg(load_factor)", 2)} AS avg_load_factor,
  {mean("avg(profit_margin)", 2)} AS avg_profit_margin,
  count(DISTINCT route_name) AS total_routes, count(*) AS total_samples,
  min(flight_date) AS date_start, max(flight_date) AS date_end
FROM flights"""
        ),
        "monthly_seasonal_index": flights_sql(
            f"""SELECT month,
  {mean("avg(ticket_price) / (SELECT avg(ticket_price) FROM flights)")} AS seasonal_index
FROM flights GROUP BY month"""
        ),
        "load_price_trend": flights_sql(
            f"""SELECT {mean("regr_slope(ticket_price, load_factor * 100)")} AS slope,
  {mean("regr_intercept(ticket_price, load_factor * 100)")} AS intercept
FROM flights"""
        ),
        "fitted_line": flights_sql(
            f"""SELECT {mean("x")} AS load_pct, n AS flights, {mean("b + a * x")} AS fitted_price
FROM (SELECT load_factor * 100 AS x, count(*) AS n FROM flights GROUP BY 1),
  (SELECT regr_slope(ticket_price, load_factor * 100) AS a,
     regr_intercept(ticket_price, load_factor * 100) AS b FROM flights)"""
        ),
        "profit_by_route": flights_sql(
            f"""SELECT route_name, {mean("avg(profit_margin) * 100")} AS profit_pct
FROM flights GROUP BY route_name"""
        ),
        "revenue_cost": flights_sql(
            f"""SELECT route_name, {mean("avg(total_revenue)")} AS avg_revenue,
  {mean("avg(total_cost)")} AS avg_cost,
  {mean("avg(total_revenue) - avg(total_cost)")} AS avg_profit
FROM flights GROUP BY route_name"""
        ),
        "weekday_load": flights_sql(
            f"""SELECT day_of_week, {mean("avg(load_factor)")} AS avg_load_factor,
  [{", ".join(text(n) for n in fixed.WEEKDAY_NAMES)}][day_of_week] AS day_name
FROM flights GROUP BY day_of_week"""
        ),
        "price_box_stats": flights_sql(
            f"""SELECT route_name, {mean("q1")} AS q1, {mean("med")} AS median, {mean("q3")} AS q3,
  {mean(f"min(p) FILTER (p >= q1 - {box_reach})")} AS whisker_low,
  {mean(f"max(p) FILTER (p <= q3 + {box_reach})")} AS whisker_high,
  count(*) FILTER (p < q1 - {box_reach} OR p > q3 + {box_reach}) AS outliers,
  count(*) AS flights
FROM (SELECT route_name, avg_ticket_price AS p FROM flights)
JOIN boxes USING (route_name)
GROUP BY route_name, q1, med, q3""",
            """boxes AS (
  SELECT route_name, quantile_cont(avg_ticket_price, 0.25) AS q1,
    quantile_cont(avg_ticket_price, 0.5) AS med, quantile_cont(avg_ticket_price, 0.75) AS q3
  FROM flights GROUP BY route_name
)""",
        ),
        "routes": flights_sql("SELECT DISTINCT route_name FROM flights"),
        "report_kpis": flights_sql(
            f"""SELECT {mean("avg(load_factor) * 100")} AS avg_load_factor,
  {mean("avg(profit_margin) * 100")} AS avg_profit_margin,
  count(DISTINCT route_name) AS total_routes, count(*) AS total_samples
FROM flights"""
        ),
        "scatter_points": flights_sql(
            "SELECT route_name, load_factor * 100 AS load_pct, ticket_price AS price FROM flights"
        ),
        "margin_scatter": flights_sql(
            "SELECT route_name, load_factor, marginal_contribution_rate FROM flights"
        ),
        "top_bottom": flights_sql(
            f"""SELECT route_name, {mean("p")} AS profit_rate, {mean("l")} AS load_factor,
  {mean("t")} AS avg_ticket_price,
  CASE WHEN top <= 5 THEN top ELSE top - (n - 5) END AS position,
  CASE WHEN top <= 5 THEN 'top' ELSE 'bottom' END AS section
FROM (SELECT *, row_number() OVER (ORDER BY p DESC, route_name) AS top, count(*) OVER () AS n
      FROM (SELECT route_name, avg(profit_rate) AS p, avg(load_factor) AS l,
              avg(avg_ticket_price) AS t FROM flights GROUP BY route_name))
WHERE top <= 5 OR top > n - 5"""
        ),
        "best_worst": flights_sql(
            """SELECT route_name, m AS profit_margin, best AS position, 'best' AS section
FROM ranked WHERE best <= 3
UNION ALL SELECT route_name, m, worst, 'worst' FROM ranked WHERE worst <= 3""",
            _MARGINS,
            _selection(20),
        ),
        "preview": flights_sql(
            """SELECT flight_date AS date, route_name, flight_number, flight_id, total_revenue,
  total_cost
FROM flights
ORDER BY date, route_name, flight_number, flight_id, total_revenue, total_cost LIMIT 10"""
        ),
        "simplified_summary": flights_sql(
            f"SELECT {_SIMPLE_JSON} AS summary_json", *_summary_parts(5)
        ),
        "pricing_recommendations": flights_sql(
            f"""SELECT route_name, {mean("load")} AS avg_load_factor, {mean("price")} AS avg_price,
  {mean("profit_mean")} AS avg_profit_rate, {mean("marginal_mean")} AS avg_marginal_rate,
  strategy, price_adjustment, {mean("recommended_price")} AS recommended_price, reason
FROM advice""",
            _ADVICE,
        ),
        "flight_quotes": flights_sql(
            f"""SELECT route, date, competitor_price, price_factor, suggested_price,
  {whole("suggested_price * 0.9::DOUBLE")} AS price_low,
  {whole("suggested_price * 1.1::DOUBLE")} AS price_high,
  expected_margin, expected_margin + 0.05::DOUBLE AS expected_margin_high,
  {whole("competitor_price * 0.95::DOUBLE")} AS past_price_low,
  {whole("competitor_price * 1.05::DOUBLE")} AS past_price_high,
  {whole("historical_load_factor * 100")} AS past_load_low,
  {whole("historical_load_factor * 100 + 5")} AS past_load_high,
  {whole("load_factor * 100")} AS expected_load_low,
  {whole("least(98.0::DOUBLE, load_factor * 100 + 5)")} AS expected_load_high
FROM (SELECT *, {whole("competitor_price * price_factor")} AS suggested_price
      FROM (SELECT *, {_QUOTE_FACTOR} AS price_factor, {_MARGIN} AS expected_margin FROM requests))""",
            _REQUESTS,
        ),
        "quote_labels": flights_sql(
            f"""SELECT route, date,
  {_elastic_words(fixed.ELASTICITY_LEVELS)} AS elasticity_level,
  {_elastic_words(fixed.ELASTICITY_WORDS)} AS elasticity_word,
  {_elastic_words(fixed.PRICE_SENSITIVITY)} AS price_sensitivity,
  CASE WHEN seasonal_index > 1 THEN '高于' ELSE '低于' END AS season_level,
  CASE WHEN historical_load_factor > load_factor THEN '高于' ELSE '低于' END AS past_load_level,
  CASE WHEN is_holiday THEN '假期期间需求增加' ELSE '非假期期间' END AS holiday_reason,
  CASE WHEN day_of_week IN ('周五', '周日') THEN '周末前后需求较高'
    WHEN day_of_week = '周六' THEN '周末需求高峰' ELSE '平日需求较低' END AS weekday_reason,
  CASE WHEN seasonal_index > 1.1::DOUBLE THEN '处于旅游旺季'
    WHEN seasonal_index < 0.9::DOUBLE THEN '处于淡季' ELSE '季节性因素适中' END AS season_reason,
  {_band("load_factor", "0.85", "0.7", ("'预期客座率高，需求强劲'", "'预期客座率低，需求疲软'",
         "'预期客座率适中'"), "VARCHAR")} AS load_reason,
  {_band("competitor_load_factor", "0.85", "0.7", ("'竞争对手客座率高，市场需求强劲'",
         "'竞争对手客座率低，市场需求疲软'", "'竞争对手客座率适中'"), "VARCHAR")} AS competition_reason,
  {_band("price_elasticity", "1.2", "0.8", ("'价格弹性高，需谨慎定价'",
         "'价格弹性低，可适当提高价格'", "'价格弹性适中'"), "VARCHAR")} AS elasticity_reason
FROM requests""",
            _REQUESTS,
        ),
        "report_rows": flights_sql(
            f"""SELECT route_name, {_percent("load")} AS load_factor, {_money("price")} AS avg_ticket_price,
  {_percent("profit_mean")} AS profit_rate,
  CASE WHEN profit_mean > 0 THEN 'positive' ELSE 'negative' END AS profit_class,
  {_percent("marginal_mean")} AS marginal_contribution_rate,
  CASE WHEN marginal_mean > 0 THEN 'positive' ELSE 'negative' END AS marginal_class,
  flight_count::VARCHAR AS flight_count, strategy,
  {_percent("price_adjustment", 1)} AS price_adjustment,
  {_money("recommended_price")} AS recommended_price, reason
FROM advice""",
            _ADVICE,
        ),
        "analysis_prompts": flights_sql(
            f"""SELECT seq, query, {_template(_ANALYSIS_PROMPT, "data", "query")} AS prompt
FROM (VALUES {", ".join(f"({i}::BIGINT, {text(q)})" for i, q in enumerate(fixed.DEFAULT_QUERIES, 1))})
  AS q(seq, query), (SELECT {_indented_json()} AS data)""",
            *_summary_parts(5),
            _SEASON_LINES,
        ),
        "quote_prompts": flights_sql(
            "SELECT route, date, "
            + _template(
                _QUOTE_PROMPT,
                "route",
                "date",
                "(CASE WHEN is_holiday THEN '是' ELSE '否' END)",
                "day_of_week",
                "aircraft_type",
                "seat_capacity",
                f"({mean('price_elasticity', 2)})::VARCHAR",
                "seasonal_index::VARCHAR",
                f"({mean('load_factor', 2)})::VARCHAR",
                f"({mean('competitor_load_factor', 2)})::VARCHAR",
                f"({mean('historical_load_factor', 2)})::VARCHAR",
                "competitor_price",
            )
            + " AS prompt FROM requests",
            _REQUESTS,
        ),
        "parse_responses": f"""WITH {_EXCHANGES}
SELECT conv_id, turn, {_REASONING} AS reasoning, {_ANSWER} AS answer,
  CASE WHEN shape IN (3, 4) THEN -1 ELSE length(question) END AS reasoning_tokens
FROM exchanges""",
        "parse_responses_alt": f"""WITH {_EXCHANGES}
SELECT conv_id, turn, {_REASONING_ALT} AS reasoning, {_ANSWER_ALT} AS answer FROM exchanges""",
        "answer_preview": f"""WITH {_EXCHANGES}
SELECT conv_id, turn, question[:50] || '...' AS query_preview,
  CASE WHEN length(answer) > 100 THEN answer[:100] || '...' ELSE answer END AS answer_preview
FROM (SELECT *, {_ANSWER} AS answer FROM exchanges)""",
        "results_table": f"""WITH {_EXCHANGES}
SELECT query, CASE WHEN empty THEN NULL ELSE reasoning END AS reasoning,
  CASE WHEN empty THEN {text(fixed.NO_CHOICES_SHORT)} ELSE answer END AS answer
FROM (SELECT question AS query, {_REASONING} AS reasoning, {_ANSWER} AS answer, (conv_id + turn) % 3 = 0 AS empty,
        row_number() OVER (PARTITION BY question ORDER BY conv_id DESC, turn DESC) AS latest
      FROM exchanges)
WHERE latest = 1""",
        "pricing_summary_flow": flights_sql(
            "SELECT profiles.*, seasonal_index FROM profiles JOIN season_text USING (route_name)",
            _GAPS,
            filled,
            gap_bounds,
            "capped AS (SELECT * REPLACE ("
            + ", ".join(f"{_capped(c)} AS {c}" for c in fixed.IQR_COLUMNS)
            + ") FROM filled, bounds)",
            *_profile("capped"),
            _SEASON_TEXT,
        ),
        "pricing_flow_prompts": flights_sql(
            f"""SELECT seq, query, {_template(_ANALYSIS_PROMPT, "data", "query")} AS prompt
FROM (VALUES {", ".join(f"({i}::BIGINT, {text(q)})" for i, q in enumerate(fixed.DEFAULT_QUERIES, 1))})
  AS q(seq, query), (SELECT {_indented_json("capped")} AS data)""",
            _GAPS,
            filled,
            gap_bounds,
            "capped AS (SELECT * REPLACE ("
            + ", ".join(f"{_capped(c)} AS {c}" for c in fixed.IQR_COLUMNS)
            + ") FROM filled, bounds)",
            *_summary_parts(5, "capped"),
            _SEASON_LINES,
        ),
        "route_summary_rows": flights_sql(
            f"""SELECT 'overall' AS section, NULL AS route_name, to_json({{
  'avg_price': {mean("avg(ticket_price)", 2)}, 'avg_load_factor': {mean("avg(load_factor)", 2)},
  'avg_profit_margin': {mean("avg(profit_margin)", 2)}, 'total_routes': count(DISTINCT route_name),
  'total_samples': count(*), 'date_start': min(flight_date), 'date_end': max(flight_date)}})::VARCHAR AS summary_json
FROM flights
UNION ALL SELECT 'route', route_name, to_json(profile)::VARCHAR FROM entries""",
            *_summary_parts(20),
        ),
        "load_price_bins": flights_sql(
            """SELECT route_name, floor(load_factor * 100 / 5)::BIGINT AS load_pct_bin,
  floor(ticket_price / 100)::BIGINT AS price_bin, count(*) AS flights
FROM flights GROUP BY ALL"""
        ),
        "load_margin_bins": flights_sql(
            """SELECT route_name, floor(load_factor / 0.05::DOUBLE)::BIGINT AS load_factor_bin,
  floor(marginal_contribution_rate / 0.05::DOUBLE)::BIGINT AS marginal_contribution_rate_bin, count(*) AS flights
FROM flights GROUP BY ALL"""
        ),
        "route_flight_pairs": flights_sql("SELECT DISTINCT route_name, flight_number FROM flights"),
        "flight_number_lookup": flights_sql(
            """SELECT flight_id, total_revenue, flight_numbers
FROM flights JOIN (
  SELECT route_name, string_agg(DISTINCT flight_number, ',' ORDER BY flight_number) AS flight_numbers FROM flights GROUP BY 1) USING (route_name)"""
        ),
        "csv_by_name": flights_sql(
            """SELECT flight_id, route_name, avg_ticket_price, load_factor, booked_seats FROM flights
WHERE CASE WHEN flight_id % 2 = 0 THEN flight_id % 50 <> 0 ELSE flight_id % 35 <> 1 END"""
        ),
        "csv_rejects": flights_sql(
            """SELECT 'avg_ticket_price' AS column_name, 'bad-' || flight_id AS value FROM flights WHERE flight_id % 50 = 0
UNION ALL SELECT 'booked_seats', 'many-' || flight_id FROM flights WHERE flight_id % 2 = 1 AND flight_id % 35 = 1"""
        ),
        "scatter_sample": flights_sql(
            """SELECT route_name, load_factor * 100 AS load_pct, ticket_price AS price FROM flights
QUALIFY row_number() OVER (PARTITION BY route_name ORDER BY md5(flight_id::VARCHAR), flight_id, load_factor, ticket_price) <= 20"""
        ),
        "simplified_summary_all": flights_sql(
            f"""SELECT to_json({{
  'overall_stats': (SELECT {_OVERALL_STRUCT} FROM flights),{_RANKED_LISTS},
  'route_stats': (SELECT map_from_entries(list((route_name, profile) ORDER BY route_name)) FROM entries)
}})::VARCHAR AS summary_json""",
            *_summary_parts(20),
        ),
        "kept_route_stats": flights_sql(_ROUTE_STATS),
        "kept_totals": flights_sql(
            f"""SELECT {_STAT_MEANS}, {mean("corr(load_factor, avg_ticket_price)", 6)} AS load_price_corr,
  {mean("regr_slope(ticket_price, load_factor * 100)")} AS slope, {mean("regr_intercept(ticket_price, load_factor * 100)")} AS intercept,
  {mean("avg(load_factor) * 100")} AS load_pct, {mean("avg(profit_margin) * 100")} AS margin_pct,
  count(DISTINCT route_name) AS total_routes, count(*) AS total_samples
FROM flights"""
        ),
        "kept_weekday_load": flights_sql(
            f"SELECT day_of_week, {mean('avg(load_factor)')} AS avg_load_factor FROM flights GROUP BY day_of_week"
        ),
        "kept_monthly_season": flights_sql(
            f"""SELECT month, {mean("avg(ticket_price) / (SELECT avg(ticket_price) FROM flights)")} AS seasonal_index
FROM flights GROUP BY month"""
        ),
        "kept_route_season": flights_sql(
            f"""SELECT route_name, month, {mean("month_price / price")} AS seasonal_index
FROM (SELECT route_name, month, avg(ticket_price) AS month_price FROM flights GROUP BY ALL)
JOIN (SELECT route_name, avg(ticket_price) AS price FROM flights GROUP BY ALL) USING (route_name)"""
        ),
        "kept_route_money": flights_sql(
            f"""SELECT route_name, {mean("avg(total_revenue)")} AS avg_revenue, {mean("avg(total_cost)")} AS avg_cost,
  {mean("avg(total_revenue) - avg(total_cost)")} AS avg_profit, {mean("avg(profit_margin) * 100")} AS profit_pct
FROM flights GROUP BY route_name"""
        ),
    }


def oracle_sql() -> dict[str, str]:
    every = _every()
    return every | {"route_report_flow": every["report_rows"]}
