"""Oracles of feature blocks, written from the blocks' definitions and not from their steps."""

from __future__ import annotations

_COLUMNS = "line_id, custid, sales_datetime AS ts, CAST(sales_datetime AS DATE) AS day, str_nm, goodcd, brd_nm, corner_nm, pc_nm, part_nm, team_nm, buyer_nm, import_flg, tot_amt, dis_amt, net_amt, inst_mon"


def _lines(*tables: str) -> str:
    """Lines with custid and time, delivered once, of the tables one under the other."""
    parts = [f"SELECT DISTINCT {_COLUMNS} FROM {t}_transactions WHERE custid IS NOT NULL AND sales_datetime IS NOT NULL" for t in tables]
    return f"l AS ({' UNION ALL '.join(parts)})"


TRAIN, BOTH = _lines("train"), _lines("train", "test")
#: The code in 13 digits, one of its own for none; net amount, or the gross one where it is 0.
CODE = "coalesce(nullif(CASE WHEN length(trim(goodcd)) BETWEEN 1 AND 12 THEN lpad(trim(goodcd), 13, '0') ELSE trim(goodcd) END, ''), '0000000000nan')"
NET = "CASE WHEN net_amt IS NULL OR net_amt = 0 THEN tot_amt ELSE net_amt END"
PART = (
    "CASE part_nm WHEN '가정용품파트' THEN '가정용품' WHEN '공산품파트' THEN '공산품' WHEN '생식품파트' THEN '생식품' WHEN '잡화파트' THEN '잡화' "
    "WHEN '로얄부틱' THEN '로얄부띠끄' WHEN '스포츠캐쥬얼' THEN '스포츠캐주얼' WHEN '여성캐쥬얼' THEN '여성캐주얼' ELSE coalesce(part_nm, '') END"
)
EVENING = "((isodow(ts) <= 5 AND hour(ts) >= 18) OR (isodow(ts) >= 6 AND hour(ts) >= 12 AND hour(ts) <= 21))"
PAID = "(CASE WHEN net_amt > 0 THEN net_amt ELSE 0 END)"
GROSS = "(CASE WHEN tot_amt > 0 THEN tot_amt ELSE 0 END)"


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE) + 1e-10, {digits}) AS {name}"


def _dwell(lines: str, amount: str) -> str:
    return f"""WITH {lines},
x AS (SELECT custid, day, max(hour(ts) * 60 + minute(ts)) - min(hour(ts) * 60 + minute(ts)) AS span, {amount} AS amt, bool_or({EVENING}) AS soc FROM l GROUP BY custid, day)
SELECT custid, {r("avg(span)", "span_mean")}, {r("max(span)", "span_max")}, {r("count(*) FILTER (span >= 60) / count(*)", "longstay_share")}, {r("avg(amt / (span + 1.0::DOUBLE))", "amount_per_minute")},
{r("count(*) FILTER (span >= 60 AND soc) / count(*)", "social_long_share")} FROM x GROUP BY custid"""


def _recent(k: int) -> str:
    men = "'가정용품', '공산품', '생식품', '케주얼,구두,아동', '남성정장', '남성캐주얼'"
    women = "'여성캐주얼', '영캐릭터', '영플라자', '패션잡화', '여성정장'"
    return f"""WITH {TRAIN}, x AS (SELECT *, {PART} AS part FROM l QUALIFY row_number() OVER (PARTITION BY custid ORDER BY ts DESC, line_id DESC) <= {k})
SELECT custid, {r("avg(tot_amt)", "tot_mean")}, {r("max(tot_amt)", "tot_max")}, {r("sum(dis_amt) / (sum(tot_amt) + 1e-5)", "discount_mean")}, {r("avg(net_amt)", "net_mean")},
{r(f"count(*) FILTER (part IN ({men})) / count(*)", "men_share")}, {r(f"count(*) FILTER (part IN ({women})) / count(*)", "women_share")} FROM x GROUP BY custid"""


def _frequency(category: str) -> str:
    return f"""WITH {BOTH}, c AS (SELECT custid, coalesce({category}, 'nan') AS c FROM l), f AS (SELECT c, count(*) AS f FROM c GROUP BY c)
SELECT custid, {r("avg(ln(f + 1))", "freq_mean")}, {r("min(ln(f + 1))", "freq_min")}, {r("count(*) FILTER (f <= 5) / count(*)", "rare_share")} FROM c JOIN f USING (c) GROUP BY custid"""


def _diversity(category: str) -> str:
    return f"""WITH {TRAIN}, c AS (SELECT custid, {category} AS c, count(*) AS n FROM l WHERE {category} IS NOT NULL GROUP BY ALL), p AS (SELECT custid, n / sum(n) OVER (PARTITION BY custid) AS p FROM c),
x AS (SELECT custid, {r("-sum(p * ln(p + 1e-12))", "entropy")}, {r("sum(p ** 2)", "hhi")}, {r("max(p)", "top_share")}, {r("-sum(p * ln(p))", "entropy_plain")} FROM p GROUP BY custid)
SELECT custid, coalesce(entropy, 0) AS entropy, coalesce(hhi, 0) AS hhi, coalesce(top_share, 0) AS top_share, coalesce(entropy_plain, 0) AS entropy_plain FROM (SELECT DISTINCT custid FROM l) LEFT JOIN x USING (custid)"""


def _composition(category: str) -> str:
    return f"WITH {TRAIN}, c AS (SELECT custid, {category} AS cat, count(*) AS n FROM l WHERE {category} <> '' GROUP BY ALL) SELECT custid, cat, n, {r('n / sum(n) OVER (PARTITION BY custid)', 'share')} FROM c"


def _holidays() -> str:
    md = "strftime(ts, '%m-%d')"
    spans = {
        "parents": f"{md} >= '04-28' AND {md} <= '05-08'",
        "pepero": f"{md} >= '11-05' AND {md} <= '11-11'",
        "chuseok": "(ts >= '2017-09-20' AND ts <= '2017-10-06') OR (ts >= '2024-09-03' AND ts <= '2024-09-19') OR (ts >= '2025-09-22' AND ts <= '2025-10-08')",
        "seollal": "(ts >= '2018-01-28' AND ts <= '2018-02-17') OR (ts >= '2024-01-22' AND ts <= '2024-02-11') OR (ts >= '2025-01-10' AND ts <= '2025-01-30') OR (ts >= '2026-01-29' AND ts <= '2026-02-18')",
    }
    gift = "regexp_matches(concat_ws(' ', coalesce(part_nm, ''), coalesce(pc_nm, ''), coalesce(corner_nm, '')), '화장품|향수|주얼리|시계|상품권|건강|홍삼|선물|기프트|넥타이|지갑|벨트')"
    share = lambda cond, name: r(f"coalesce(sum(w) FILTER ({cond}), 0) / (sum(w) + 1)", name)
    return f"""WITH {TRAIN}, x AS (SELECT custid, {GROSS} AS w, {gift} AS gift, {", ".join(f"({c}) AS {n}" for n, c in spans.items())} FROM l)
SELECT custid, {", ".join(share(n, f"{n}_share") for n in spans)}, {share(" OR ".join(spans), "any_share")}, {share(f"({' OR '.join(spans)}) AND gift", "gift_in_share")}, {share(f"NOT ({' OR '.join(spans)}) AND gift", "gift_off_share")} FROM x GROUP BY custid"""


_LATE = "row_number() OVER (PARTITION BY custid ORDER BY ts, line_id) - 1 >= count(*) OVER (PARTITION BY custid) / 2"
_LAST = "lag({0}) OVER (PARTITION BY custid ORDER BY ts, line_id)"

SQL = {
    "base_agg": f"""WITH {TRAIN}, x AS (SELECT *, nullif(upper(trim(brd_nm)), '') AS brand, nullif({CODE}, '0000000000nan') AS good FROM l)
SELECT custid, {r("count(*)", "n_lines")}, {r("count(DISTINCT good)", "n_goods")}, {r("count(DISTINCT brand)", "n_brands")}, {r("count(DISTINCT corner_nm)", "n_corners")}, {r("count(DISTINCT pc_nm)", "n_pcs")}, {r("count(DISTINCT part_nm)", "n_parts")},
{r("count(DISTINCT team_nm)", "n_teams")}, {r("count(DISTINCT str_nm)", "n_stores")}, {r("count(DISTINCT day)", "visit_days")}, {r("sum(net_amt)", "net_sum")}, {r("avg(net_amt)", "net_mean")}, {r("max(net_amt)", "net_max")}, {r("min(net_amt)", "net_min")},
{r("stddev(net_amt)", "net_std")}, {r("quantile_cont(net_amt, 0.5)", "net_median")}, {r("sum(tot_amt)", "tot_sum")}, {r("sum(dis_amt)", "dis_sum")}, {r("count(*) FILTER (net_amt < 0) / count(*)", "refund_share")}, {r("avg(import_flg)", "import_share")},
{r("count(*) FILTER (inst_mon > 1) / count(*)", "instalment_share")}, {r("avg(inst_mon)", "inst_mon_mean")}, {r("count(*) FILTER (isodow(ts) > 5) / count(*)", "weekend_share")}, {r("count(*) FILTER (hour(ts) >= 18) / count(*)", "evening_share")},
{r("count(*) FILTER (hour(ts) < 12) / count(*)", "morning_share")}, {r("avg(hour(ts))", "hour_mean")}, {r("stddev(hour(ts))", "hour_std")}, {r("count(DISTINCT good) / count(*)", "goods_per_line")}, {r("count(DISTINCT brand) / count(*)", "brands_per_line")},
{r("count(*) / count(DISTINCT day)", "lines_per_visit")}, {r("sum(net_amt) / count(DISTINCT day)", "net_per_visit")}, {r("sum(dis_amt) / (abs(sum(tot_amt)) + 1)", "discount_rate")} FROM x GROUP BY custid""",
    "amount_stats": f"""WITH {TRAIN}, q AS (SELECT quantile_cont(net_amt, 0.9) AS q FROM l)
SELECT custid, {r("quantile_cont(net_amt, 0.25)", "q25")}, {r("quantile_cont(net_amt, 0.75)", "q75")}, {r("quantile_cont(net_amt, 0.75) - quantile_cont(net_amt, 0.25)", "iqr")}, {r("CASE WHEN count(net_amt) > 2 THEN skewness(net_amt) END", "net_skew")},
{r("count(*) FILTER (net_amt >= q) / count(*)", "high_share")}, {r("count(*) FILTER (net_amt >= q AND import_flg = 1) / count(*)", "luxury_share")} FROM l, q GROUP BY custid""",
    "tot_quantiles": f"""WITH {TRAIN} SELECT custid, {", ".join(r(f"quantile_cont(tot_amt, {q / 100})", f"q{q}") for q in (25, 50, 75, 90, 95))}, {r("quantile_cont(tot_amt, 0.75) - quantile_cont(tot_amt, 0.25)", "iqr")},
{r("quantile_cont(tot_amt, 0.9) / (abs(quantile_cont(tot_amt, 0.5)) + 1e-5)", "p90_p50")}, {r("stddev(tot_amt) / (abs(avg(tot_amt)) + 1e-5)", "cv")} FROM l GROUP BY custid""",
    "social_dwell": _dwell(TRAIN, "greatest(coalesce(sum(net_amt), 0), 0)"),
    "dwell_gross": _dwell(BOTH, "sum(tot_amt)"),
    "social_share": f"""WITH {TRAIN} SELECT custid, {r(f"count(*) FILTER ({EVENING})", "social_lines")}, {r(f"count(*) FILTER ({EVENING}) / count(*)", "social_line_share")},
{r(f"coalesce(sum({PAID}) FILTER ({EVENING}), 0) / (sum({PAID}) + 1)", "social_amount_share")}, {r(f"coalesce(sum({PAID}) FILTER ({EVENING}), 0)", "social_amount")} FROM l GROUP BY custid""",
    "social_gross": f"""WITH {BOTH} SELECT custid, {r("count(*)", "n_lines")}, {r(f"count(*) FILTER ({EVENING})", "social_lines")}, {r(f"count(*) FILTER ({EVENING}) / (count(*) + 1e-5)", "social_line_share")}, {r("sum(tot_amt)", "amount")},
{r(f"coalesce(sum(tot_amt) FILTER ({EVENING}), 0)", "social_amount")}, {r(f"coalesce(sum(tot_amt) FILTER ({EVENING}), 0) / (sum(tot_amt) + 1e-5)", "social_amount_share")} FROM l GROUP BY custid""",
    "recent_3": _recent(3),
    "recent_5": _recent(5),
    **{f"freq_{n}": _frequency(c) for n, c in {"brand": "nullif(upper(trim(brd_nm)), '')", "good": f"nullif({CODE}, '0000000000nan')", "corner": "corner_nm", "buyer": "buyer_nm", "pc": "pc_nm"}.items()},
    **{f"diversity_{n}": _diversity(c) for n, c in {"brand": "nullif(upper(trim(brd_nm)), '')", "corner": "corner_nm", "store": "str_nm", "part": "part_nm", "zone": "CASE WHEN hour(ts) < 12 THEN 1 WHEN hour(ts) < 15 THEN 2 WHEN hour(ts) < 18 THEN 3 ELSE 4 END"}.items()},
    **{f"composition_{n}": _composition(c) for n, c in {"team": "team_nm", "part": PART, "buyer": "buyer_nm"}.items()},
    "calendar_windows_kr": _holidays(),
    "interarrival": f"""WITH {TRAIN}, x AS (SELECT custid, epoch_us(ts) / 1e6 / 86400 - {_LAST.format("epoch_us(ts) / 1e6 / 86400")} AS gap FROM l)
SELECT custid, {r("coalesce(avg(gap), 0)", "gap_mean")}, {r("coalesce(stddev(gap), 0)", "gap_std")}, {r("coalesce(max(gap), 0)", "gap_max")}, {r("coalesce(min(gap), 0)", "gap_min")} FROM x GROUP BY custid""",
    "switch_rate": f"""WITH {TRAIN}, x AS (SELECT custid, coalesce(buyer_nm, 'nan') AS b, coalesce({_LAST.format("buyer_nm")}, 'nan') AS p FROM l) SELECT custid, {r("count(*) FILTER (b <> p) / count(*)", "switch_rate")} FROM x GROUP BY custid""",
    "transitions": f"""WITH {TRAIN}, x AS (SELECT custid, corner_nm AS c, {_LAST.format("corner_nm")} AS p FROM l WHERE corner_nm IS NOT NULL),
y AS (SELECT custid, count(*) AS n, count(*) FILTER (c = p) AS k, count(DISTINCT (p, c)) AS d FROM x WHERE p IS NOT NULL GROUP BY custid)
SELECT custid, {r("coalesce(n, 0)", "n_steps")}, coalesce({r("k / n", "x").removesuffix(" AS x")}, 0) AS same_share, {r("coalesce(d, 0)", "n_pairs")}, coalesce({r("d / (n + 1)", "x").removesuffix(" AS x")}, 0) AS pair_share FROM (SELECT DISTINCT custid FROM l) LEFT JOIN y USING (custid)""",
    "periodicity": f"""WITH {TRAIN}, x AS (SELECT DISTINCT custid, day FROM l), g AS (SELECT custid, date_diff('day', lag(day) OVER (PARTITION BY custid ORDER BY day), day) AS gap FROM x),
y AS (SELECT custid, avg(gap) AS m, stddev_pop(gap) AS s, max(gap) AS x FROM g GROUP BY custid)
SELECT custid, {", ".join(f"CASE WHEN m IS NULL THEN 0 ELSE {r(e, 'x').removesuffix(' AS x')} END AS {n}" for n, e in {"gap_mean": "m", "gap_std": "s", "gap_cv": "s / (m + 1e-6)", "gap_max": "x", "regularity": "1 / (s / (m + 1e-6) + 1)"}.items())} FROM y""",
    "gap_shape": f"""WITH {BOTH}, x AS (SELECT DISTINCT custid, day FROM l), g AS (SELECT custid, date_diff('day', lag(day) OVER (PARTITION BY custid ORDER BY day), day) AS gap FROM x)
SELECT custid, {r("coalesce(var_samp(gap), 0)", "gap_var")}, {r("coalesce(CASE WHEN count(gap) > 2 THEN skewness(gap) END, 0)", "gap_skew")} FROM g GROUP BY custid""",
    "refund_strength": f"""WITH {TRAIN}, x AS (SELECT custid, {NET} AS v FROM l), y AS (SELECT custid, count(*) AS n, count(*) FILTER (v < 0) AS k, sum(abs(v)) FILTER (v < 0) AS s, max(abs(v)) FILTER (v < 0) AS x FROM x GROUP BY custid)
SELECT custid, {r("n", "n_lines")}, {r("k", "refund_count")}, {r("k / n", "refund_share")}, {r("coalesce(s, 0)", "refund_sum")}, {r("coalesce(s / nullif(k, 0), 0)", "refund_mean")}, {r("coalesce(x, 0)", "refund_max")}, {r("CASE WHEN k / (n + 1e-5) >= 0.1::DOUBLE OR k >= 3 THEN 1 ELSE 0 END", "heavy")} FROM y""",
    "interest_score": f"""WITH {TRAIN}, x AS (SELECT custid, {PAID} AS w, coalesce(brd_nm, '') || ' ' || coalesce(corner_nm, '') || ' ' || coalesce(part_nm, '') AS t FROM l),
y AS (SELECT custid, coalesce(sum(w) FILTER (contains(t, '남성')), 0) / (sum(w) + 1e-5) AS m, coalesce(sum(w) FILTER (contains(t, '여성')), 0) / (sum(w) + 1e-5) AS f, coalesce(sum(w) FILTER (contains(t, '아동')), 0) / (sum(w) + 1e-5) AS k FROM x GROUP BY custid)
SELECT custid, {r("m", "men")}, {r("f", "women")}, {r("m - f + k / 2", "score")} FROM y""",
    "brand_hhi": f"""WITH {BOTH}, x AS (SELECT custid, upper(trim(brd_nm)) AS b, sum({GROSS}) AS s FROM l WHERE trim(brd_nm) <> '' GROUP BY ALL), y AS (SELECT custid, s / (sum(s) OVER (PARTITION BY custid) + 1e-5) AS p FROM x),
z AS (SELECT custid, {r("sum(p * p)", "hhi")} FROM y GROUP BY custid) SELECT custid, coalesce(hhi, 0) AS hhi FROM (SELECT DISTINCT custid FROM l) LEFT JOIN z USING (custid)""",
    "drift_cosine": f"""WITH {BOTH}, x AS (SELECT custid, substring({CODE}, 1, 2) AS g, {GROSS} AS a, {_LATE} AS late FROM l), y AS (SELECT custid, g, coalesce(sum(a) FILTER (NOT late), 0)::DOUBLE AS u, coalesce(sum(a) FILTER (late), 0)::DOUBLE AS v, bool_or(late) AS b FROM x GROUP BY custid, g)
SELECT custid, {r("CASE WHEN bool_or(b) THEN 1 - sum(u * v) / (sqrt(sum(u * u)) * sqrt(sum(v * v)) + 1e-9) ELSE 0 END", "drift")} FROM y GROUP BY custid""",
    "season_align": f"""WITH {BOTH}, c AS (SELECT DISTINCT custid FROM l), m AS (SELECT DISTINCT month(ts) AS m FROM l), s AS (SELECT custid, month(ts) AS m, sum({GROSS}) AS a FROM l GROUP BY ALL),
v AS (SELECT custid, m, coalesce(a, 0) / (sum(coalesce(a, 0)) OVER (PARTITION BY custid) + 1e-9) AS x FROM c CROSS JOIN m LEFT JOIN s USING (custid, m)), g AS (SELECT m, avg(x) AS y FROM v GROUP BY m)
SELECT custid, {r("CASE WHEN var_pop(x) * count(*) > 1e-15 AND var_pop(y) * count(*) > 1e-15 THEN corr(x, y) ELSE 0 END", "season_corr")} FROM v JOIN g USING (m) GROUP BY custid""",
    "code_hierarchy": f"""WITH {BOTH}, x AS (SELECT custid, {CODE} AS c FROM l), y AS (SELECT custid, count(*) AS n, count(DISTINCT c) AS c, {", ".join(f"count(DISTINCT left(c, {k})) AS n{k}" for k in (2, 3, 4, 9))} FROM x GROUP BY custid)
SELECT custid, {r("c / (n3 + 1e-5)", "leaf_per_group")}, {r("n9 / (n4 + 1e-5)", "deep_per_mid")}, {r("c / (n2 + 1e-5)", "code_per_top")}, {r("1 - c / (n + 1e-5)", "repeat_share")}, {r("n2 / (n + 1e-5)", "new_top_share")} FROM y""",
    "sibling_days": f"""WITH {BOTH}, x AS (SELECT custid, day, count(DISTINCT left({CODE}, 2)) < count(DISTINCT left({CODE}, 4)) AS more FROM l GROUP BY custid, day) SELECT custid, {r("count(*) FILTER (more) / count(*)", "sibling_share")} FROM x GROUP BY custid""",
    "group_switch": f"""WITH {BOTH}, x AS (SELECT custid, left({CODE}, 3) AS g, {_LAST.format(f"left({CODE}, 3)")} AS p FROM l) SELECT custid, {r("count(*) FILTER (g <> p) / count(*)", "switch_share")} FROM x GROUP BY custid""",
}

_TEXT = "coalesce(part_nm, '') || ' ' || coalesce(pc_nm, '') || ' ' || coalesce(corner_nm, '')"
# The words of the groups, segments and interests, as the blocks have them.
_GROUPS = {
    "cosmetic": ["화장품", "향수", "코스메", "뷰티"],
    "women_young": ["영캐", "여성캐", "미씨", "어덜트캐", "캐릭터캐", "란제리", "영플라자", "영라이브", "영어덜트", "패션잡화", "악세", "액세", "머플러", "스카프", "영트랜디", "진캐주얼", "진케주얼"],
    "men": ["남성정장", "남성의류", "신사", "정장"],
    "sport_golf": ["골프", "스포츠"],
    "kids": ["아동", "유아", "키즈", "완구", "문구", "레고", "문화용품"],
    "food": ["식품", "농산", "생식", "청과", "수산", "축산", "델리"],
    "living": ["가정용품", "공산품", "침구", "수예", "주방", "생활", "가전"],
}
_SEGMENTS = {
    "food": ["식품", "농산", "생식", "청과", "수산", "축산"], "kids": ["아동", "유아", "키즈", "완구", "문구"], "living": ["가정용품", "공산품", "주방", "생활", "침구"],
    "men": ["남성", "신사"], "women": ["여성", "숙녀"], "cos": ["화장품", "향수"], "golf": ["골프", "스포츠"],
}
_INTERESTS = ["남성", "여성", "아동", "학생", "골프", "스포츠", "영", "마담", "캐주얼", "정장", "화장품"]
_GIFT = ["화장품", "향수", "주얼리", "보석", "시계", "핸드백", "잡화", "상품권"]
_WINDOWS = {"valentine": "strftime(ts, '%m%d') BETWEEN '0201' AND '0214'", "whiteday": "strftime(ts, '%m%d') BETWEEN '0301' AND '0314'", "xmas": "strftime(ts, '%m%d') BETWEEN '1215' AND '1225'", "mayfamily": "strftime(ts, '%m%d') BETWEEN '0501' AND '0515'", "newyear": "strftime(ts, '%m%d') BETWEEN '0101' AND '0110'"}


def _holds(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _part(amount: str, cond: str, plus: str = "1") -> str:
    """The share of an amount in the rows of a condition."""
    return f"coalesce(sum({amount}) FILTER ({cond}), 0) / (sum({amount}) + {plus})"


def _select(lines: str, **columns: str) -> str:
    return f"WITH {lines} SELECT custid, {', '.join(r(e, n) for n, e in columns.items())} FROM l GROUP BY custid"


_SHARE = "count(*) FILTER ({0}) / count(*)".format
_MONTH_SEASON = "(month(ts) % 12) // 3"
_DAYS = "date_diff('day', {0}, {1})".format
_MEN, _WOMEN = "'가정용품', '공산품', '생식품', '케주얼,구두,아동', '남성정장', '남성캐주얼'", "'여성캐주얼', '영캐릭터', '영플라자', '패션잡화', '여성정장'"
_DISCOUNT = "CASE WHEN tot_amt > 0 THEN 100.0::DOUBLE * dis_amt / tot_amt ELSE 0 END"
_PLACE = "row_number() OVER (PARTITION BY custid ORDER BY ts, line_id) - 1"
_ALL = "count(*) OVER (PARTITION BY custid)"
_RANKED = "(rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2) / count({1}) OVER (PARTITION BY {0})".format
_BASKET = "custid, day, hour(ts), minute(ts)"

SQL |= {
    "composition_ratio": _select(TRAIN, **{f"season_{n}": _SHARE(f"{_MONTH_SEASON} = {k}") for k, n in enumerate(("winter", "spring", "summer", "fall"))}, **{f"zone_{n}": _SHARE(c) for n, c in {"morning": "hour(ts) < 12", "lunch": "hour(ts) BETWEEN 12 AND 14", "afternoon": "hour(ts) BETWEEN 15 AND 17", "evening": "hour(ts) > 17"}.items()}),
    "semantic_share": _select(TRAIN, **{f"{g}_{x}": e for g, ws in _GROUPS.items() for x, e in (("n", _SHARE(_holds(f"({_TEXT})", ws))), ("amt", _part(PAID, _holds(f"({_TEXT})", ws))))}),
    "temporal_dynamics": f"""WITH {TRAIN}, x AS (SELECT *, epoch_us(ts)::DOUBLE AS u, min(epoch_us(ts)) OVER w AS a, max(epoch_us(ts)) OVER w AS b FROM l WINDOW w AS (PARTITION BY custid))
SELECT custid, {r(_DAYS("max(day)", "(SELECT max(day) FROM l)"), "recency_days")}, {r(_DAYS("min(day)", "max(day)"), "tenure_days")}, {r("count(DISTINCT strftime(ts, '%Y%m'))", "active_months")}, {r("count(*) / count(DISTINCT strftime(ts, '%Y%m'))", "lines_per_month")},
{r(_part(PAID, "a = b OR (u - a) / (b - a) >= 0.5::DOUBLE"), "late_share")} FROM x GROUP BY custid""",
    "part_score": f"""WITH {TRAIN}, x AS (SELECT custid, count(*) FILTER ({PART} IN ({_MEN})) AS m, count(*) FILTER ({PART} IN ({_WOMEN})) AS f FROM l GROUP BY custid)
SELECT custid, {r("m", "men_parts")}, {r("f", "women_parts")}, {r("m / (m + f + 1e-5)", "men_share")}, {r("f / (m + f + 1e-5)", "women_share")}, {r("(m - f) / (m + f + 1e-5)", "score")} FROM x""",
    "buyer_variety": f"WITH {TRAIN}, x AS (SELECT custid, buyer_nm, count(*) AS c FROM l WHERE buyer_nm IS NOT NULL GROUP BY ALL) SELECT custid, {r('count(*)', 'n_buyers')}, {r('max(c) / sum(c)', 'top_buyer_share')} FROM x GROUP BY custid",
    "trajectory_delta": f"""WITH {TRAIN}, x AS (SELECT *, {_LATE} AS late, ({_TEXT}) AS t FROM l) SELECT custid, {", ".join(r(
        f"coalesce(sum({PAID}) FILTER (late AND {_holds('t', ws)}), 0) / (coalesce(sum({PAID}) FILTER (late), 0) + 1) - coalesce(sum({PAID}) FILTER (NOT late AND {_holds('t', ws)}), 0) / (coalesce(sum({PAID}) FILTER (NOT late), 0) + 1)", f"{g}_delta") for g, ws in _GROUPS.items())} FROM x GROUP BY custid""",
    "amount_slope": f"WITH {TRAIN}, x AS (SELECT custid, net_amt::DOUBLE AS y, ({_PLACE})::DOUBLE AS x FROM l), y AS (SELECT custid, count(y) AS n, regr_slope(y, x) AS s FROM x GROUP BY custid) SELECT custid, {r('coalesce(CASE WHEN n > 1 THEN s END, 0)', 'slope')} FROM y WHERE n > 0",
    "calendar_windows": f"""WITH {TRAIN}, x AS (SELECT *, {_holds(f"({_TEXT})", _GIFT)} AS gift, {" OR ".join(f"({c})" for c in _WINDOWS.values())} AS inside FROM l)
SELECT custid, {", ".join(r(_part(PAID, c), f"{n}_share") for n, c in _WINDOWS.items())}, {r(_part(PAID, "inside"), "any_share")}, {r(_part(PAID, "inside AND gift"), "gift_in_share")}, {r(_part(PAID, "gift"), "gift_share")} FROM x GROUP BY custid""",
    "relative_price": f"""WITH {TRAIN}, x AS (SELECT *, nullif(upper(trim(brd_nm)), '') AS b FROM l), y AS (SELECT custid, CASE WHEN b IS NOT NULL AND net_amt IS NOT NULL THEN {_RANKED("b", "net_amt")} END AS rb, CASE WHEN pc_nm IS NOT NULL AND net_amt IS NOT NULL THEN {_RANKED("pc_nm", "net_amt")} END AS rp FROM x)
SELECT custid, {r("coalesce(avg(rb), 0.5)", "brand_mean")}, {r("coalesce(max(rb), 0.5)", "brand_max")}, {r("coalesce(stddev(rb), 0.5)", "brand_std")}, {r("coalesce(avg(rp), 0.5)", "pc_mean")}, {r("coalesce(max(rp), 0.5)", "pc_max")} FROM y GROUP BY custid""",
    "visit_multiagg": f"""WITH {TRAIN}, x AS (SELECT custid, day, count(DISTINCT nullif({CODE}, '0000000000nan')) AS g, count(DISTINCT corner_nm) AS c, sum(net_amt) AS s FROM l GROUP BY custid, day)
SELECT custid, {r("count(*)", "n_visits")}, {r("avg(g)", "goods_mean")}, {r("max(g)", "goods_max")}, {r("stddev(g)", "goods_std")}, {r("avg(s)", "spend_mean")}, {r("max(s)", "spend_max")}, {r("stddev(s)", "spend_std")}, {r(_SHARE("c > 2"), "multi_corner_share")}, {r(_SHARE("g > 4"), "big_basket_share")}, {r("sum(g) / count(*)", "goods_per_visit")} FROM x GROUP BY custid""",
    "quantile_gap_daily": f"""WITH {TRAIN}, x AS (SELECT custid, day, count(DISTINCT nullif(upper(trim(brd_nm)), '')) AS brand, count(DISTINCT corner_nm) AS corner, count(*) AS n, sum(tot_amt) AS tot FROM l GROUP BY custid, day),
y AS (SELECT *, {_DAYS("lag(day) OVER (PARTITION BY custid ORDER BY day)", "day")} AS gap FROM x)
SELECT custid, {r("avg(gap)", "gap_mean")}, {r("quantile_cont(gap, 0.5)", "gap_median")}, {r("stddev(gap)", "gap_std")}, {r("max(gap)", "gap_max")}, {r(_SHARE("gap < 8"), "revisit7")}, {r(_SHARE("gap > 29"), "gap30")}, {", ".join(r(f"{f}({c})", f"daily_{c}_{n}") for c in ("brand", "corner", "n", "tot") for n, f in (("mean", "avg"), ("std", "stddev"), ("max", "max")))} FROM y GROUP BY custid""",
    "behavior": f"""WITH {TRAIN} SELECT custid, {r(f"count(*) FILTER (({NET}) < 0)", "refund_count")}, {r(_SHARE(f"({NET}) < 0"), "refund_share")}, {r(_SHARE("inst_mon >= 1"), "instalment_share")}, {r("max(inst_mon)", "inst_max")}, {r("count(DISTINCT nullif(upper(trim(brd_nm)), ''))", "n_brands")},
{r("count(DISTINCT corner_nm)", "n_corners")}, {r("count(DISTINCT part_nm)", "n_parts")}, {r("sum(tot_amt) / count(tot_amt)", "ticket_size")}, {r("count(*) FILTER (tot_amt > 300000)", "high_count")} FROM l GROUP BY custid""",
    "style": f"""WITH {TRAIN}, x AS (SELECT custid, coalesce(corner_nm, '') AS c, dis_amt / (tot_amt + 1e-5) AS d FROM l) SELECT custid, {r(_SHARE(_holds("c", ["수입", "명품", "부띠끄", "부틱", "디자이너"])), "luxury_share")},
{r(_SHARE(_holds("c", ["행사", "균일가", "대전", "기획", "특가", "이월"])), "bargain_share")}, {r("coalesce(stddev(d), 0)", "discount_std")}, {r("coalesce(avg(d), 0)", "discount_mean")} FROM x GROUP BY custid""",
    "base_gross": f"""WITH {BOTH}, n AS (SELECT max(day) AS now FROM l) SELECT custid, {r("sum(tot_amt)", "tot_sum")}, {r("avg(tot_amt)", "tot_mean")}, {r("max(tot_amt)", "tot_max")}, {r("min(tot_amt)", "tot_min")}, {r("stddev(tot_amt)", "tot_std")}, {r("sum(dis_amt)", "dis_sum")}, {r("avg(dis_amt)", "dis_mean")},
{r("avg(inst_mon)", "inst_mean")}, {r("max(inst_mon)", "inst_max")}, {r("count(*)", "freq")}, {r("avg(hour(ts))", "hour_mean")}, {r("stddev(hour(ts))", "hour_std")}, {r("sum(tot_amt) / count(*)", "ticket")}, {r("sum(dis_amt) / (sum(tot_amt) + 1e-5)", "disc_rate_sum")}, {r(f"avg({_DISCOUNT})", "disc_rate_mean")},
{r(_DAYS("max(day)", "any_value(now)"), "recency")}, {r(_SHARE("isodow(ts) IN (6, 7)"), "weekend_share")} FROM l, n GROUP BY custid""",
    "discount_peak": f"""WITH {TRAIN}, x AS (SELECT *, {_DISCOUNT} AS p FROM l) SELECT custid, {r("avg(p)", "disc_mean")}, {r("max(p)", "disc_max")}, {r("count(*) FILTER (p >= 10)", "high_count")}, {r(_SHARE("p >= 10"), "high_share")}, {r(_SHARE("dis_amt > 0"), "disc_share")},
{r("count(*) FILTER (hour(ts) IN (11, 12, 13))", "lunch_count")}, {r(_SHARE("hour(ts) IN (11, 12, 13)"), "lunch_share")}, {r("count(*) FILTER (hour(ts) IN (17, 18, 19))", "evening_count")}, {r(_SHARE("hour(ts) IN (17, 18, 19)"), "evening_share")}, {r("stddev(hour(ts))", "hour_std")} FROM x GROUP BY custid""",
    "interest_share": f"WITH {TRAIN}, x AS (SELECT *, coalesce(brd_nm, '') || ' ' || coalesce(corner_nm, '') || ' ' || coalesce(part_nm, '') AS t FROM l) SELECT custid, {', '.join(r(_part('tot_amt', _holds('t', [w]), '1e-5'), f'interest_{k}') for k, w in enumerate(_INTERESTS))} FROM x GROUP BY custid",
    "household_share": f"""WITH {TRAIN}, x AS (SELECT custid, {", ".join(f"{_part(GROSS, _holds(f'({_TEXT})', ws))} AS {n}" for n, ws in _SEGMENTS.items())} FROM l GROUP BY custid)
SELECT custid, {", ".join(r(n, n) for n in _SEGMENTS)}, {r("food + kids + living", "homemaker")}, {r("men * food + men * kids", "proxy_men")}, {r(" + ".join(f"({n} > 0.02::DOUBLE)::INTEGER" for n in _SEGMENTS), "breadth")}, {r("cos - men", "cos_vs_men")}, {r("men + golf", "men_signal")}, {r("cos + women", "women_signal")},
{r("(men + golf) * (cos + women)", "conflict")}, {r("men * (food + kids + living)", "proxy_men_all")} FROM x""",
    "top_tail_share": f"""WITH {BOTH}, x AS (SELECT custid, left({CODE}, 3) AS g, sum({GROSS}) AS s FROM l GROUP BY ALL), y AS (SELECT custid, s / (sum(s) OVER (PARTITION BY custid) + 1e-5) AS p, rank() OVER (PARTITION BY custid ORDER BY s DESC) + (count(*) OVER (PARTITION BY custid, s) - 1) / 2 AS k FROM x)
SELECT custid, {r("sum(p ** 2)", "hhi")}, {r("coalesce(sum(p) FILTER (k = 1), 0)", "top_share")}, {r("coalesce(sum(p) FILTER (k >= 4), 0)", "tail_share")}, {r("max(p)", "max_share")} FROM y GROUP BY custid""",
    "basket_stats": f"""WITH {BOTH}, x AS (SELECT *, {NET} AS v FROM l), y AS (SELECT custid, max(abs(v)) / (sum(abs(v)) + 1e-5) AS d, count(DISTINCT corner_nm) > 1 AS m, count(*) AS n, stddev(v) AS s FROM x GROUP BY {_BASKET})
SELECT custid, {r("avg(d)", "dominance")}, {r(_SHARE("m"), "multi_corner_share")}, {r("avg(n)", "basket_size")}, {r("avg(s)", "price_std")} FROM y GROUP BY custid""",
    "sequence_price": f"WITH {BOTH}, x AS (SELECT custid, {NET} AS v, {_LAST.format(NET)} AS p, {_PLACE} AS k FROM l), y AS (SELECT custid, (v - p) / (abs(p) + 1e-5) AS d FROM x WHERE k > 0) SELECT custid, {r('avg(d)', 'step_mean', 3)}, {r('stddev(d)', 'step_std', 3)} FROM y GROUP BY custid",
    "velocity": f"WITH {BOTH}, x AS (SELECT custid, {GROSS} AS a, {_LATE} AS late FROM l) SELECT custid, {r('CASE WHEN bool_or(late) THEN sum(a) FILTER (late) / (coalesce(sum(a) FILTER (NOT late), 0) + 1e-5) ELSE 1 END', 'velocity')} FROM x GROUP BY custid",
    "buyer_niche": f"WITH {BOTH}, b AS (SELECT buyer_nm, count(*) AS c FROM l WHERE buyer_nm IS NOT NULL GROUP BY 1) SELECT custid, {r('coalesce(avg(c), 0)', 'buyer_count_mean')} FROM l LEFT JOIN b USING (buyer_nm) GROUP BY custid",
    "refund_per_discount": _select(BOTH, refund_per_discount=f"count(*) FILTER (({NET}) < 0) / (count(*) FILTER (dis_amt > 0) + 1)"),
    "food_anchor": f"""WITH {BOTH}, x AS (SELECT *, {_holds("coalesce(part_nm, '')", ["식품", "생식", "푸드"])}::INTEGER AS f FROM l), y AS (SELECT custid, (first(f ORDER BY ts, line_id) + last(f ORDER BY ts, line_id)) / 2 AS a FROM x GROUP BY custid, day) SELECT custid, {r("avg(a)", "food_anchor")} FROM y GROUP BY custid""",
    "pivot_counts": f"""WITH {BOTH}, x AS (SELECT *, isodow(ts) AS w, month(ts) AS m, hour(ts) AS h FROM l) SELECT custid, {r("count(DISTINCT day)", "visit_days")}, {", ".join(r(f"count(*) FILTER ({c})", n) for n, c in {"wd_mtw": "w <= 3", "wd_tf": "w IN (4, 5)", "wd_we": "w >= 6", "ss_spring": "m IN (2, 3, 4)", "ss_summer": "m IN (5, 6, 7)", "ss_fall": "m IN (8, 9, 10)", "ss_winter": "m IN (11, 12, 1)", "tm_morning": "h < 12", "tm_lunch": "h IN (12, 13)", "tm_noon1": "h IN (14, 15)", "tm_noon2": "h IN (16, 17)", "tm_evening": "h >= 18"}.items())} FROM x GROUP BY custid""",
    "price_residual": f"""WITH {BOTH}, x AS (SELECT *, nullif(upper(trim(brd_nm)), '') AS b, left({CODE}, 3) AS g, ({NET})::DOUBLE AS v, coalesce(dis_amt, 0) / ({GROSS} + 1e-5) AS d FROM l), q AS (SELECT quantile_cont(v, 0.9) AS q FROM x),
y AS (SELECT custid, CASE WHEN b IS NOT NULL THEN v / (avg(v) OVER (PARTITION BY b) + 1e-5) END AS rel, CASE WHEN v IS NOT NULL THEN {_RANKED("g", "v")} END AS k, d - avg(d) OVER (PARTITION BY g) AS res, coalesce(dis_amt, 0) = 0 AND v >= q AS prem FROM x, q)
SELECT custid, {r("avg(rel)", "brand_relative")}, {r("avg(k)", "category_rank")}, {r(_SHARE("k >= 0.8::DOUBLE"), "category_high")}, {r("avg(res)", "discount_residual")}, {r(_SHARE("prem"), "full_price_premium")} FROM y GROUP BY custid""",
}

SQL |= {
    "transition_token": f"WITH {TRAIN}, x AS (SELECT custid, coalesce({_LAST.format('corner_nm')}, 'START') AS p, coalesce(corner_nm, '') AS c FROM l) SELECT custid, {r('count(*)', 'n_tokens')}, {r('count(DISTINCT (p, c))', 'n_different')} FROM x GROUP BY custid",
    "power_mean": _select(TRAIN, **{f"power_{k}": f"(sum(({GROSS} / 1e6) ** {k}) / count({GROSS})) ** (1.0::DOUBLE / {k})" for k in (2, 3, 5)}),
    "clip_replace": f"""WITH {TRAIN}, x AS (SELECT *, CASE WHEN tot_amt > 500000 THEN 500000 WHEN tot_amt < -500000 THEN -500000 ELSE tot_amt END AS c FROM l)
SELECT custid, {r(_SHARE("str_nm = '온라인몰'"), "online_share")}, {r(_SHARE("str_nm IS NULL"), "unknown_share")}, {r("avg(c)", "clipped_mean")}, {r("avg(CASE tot_amt WHEN 0 THEN 0 ELSE c::DOUBLE / tot_amt END)", "clipped_ratio")} FROM x GROUP BY custid""",
    "line_features": f"""WITH {TRAIN} SELECT custid, line_id, hour(ts) AS hour, isodow(ts) - 1 AS dow, month(ts) AS month, (isodow(ts) > 5)::BIGINT AS weekend, {r("CASE WHEN tot_amt <> 0 THEN dis_amt::DOUBLE / tot_amt ELSE 0 END", "dis_ratio")}, {r("CASE WHEN tot_amt <> 0 THEN net_amt::DOUBLE / tot_amt ELSE 1 END", "net_ratio")},
{r("CASE WHEN net_amt < 0 THEN -ln(1 - net_amt) ELSE ln(1 + net_amt) END", "signed_log")} FROM l""",
}
