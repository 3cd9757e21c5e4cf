"""Feature blocks over sales lines: one row per custid each."""

from __future__ import annotations

from tidemark.plans import oracles
from tidemark.plans.dsl import Block

LINES = Block()
BOTH = Block(tables=["train_transactions", "test_transactions"])

# Keyword groups of the category names.
GROUPS = {
    "cosmetic": "화장품|향수|코스메|뷰티",
    "women_young": "영캐|여성캐|미씨|어덜트캐|캐릭터캐|란제리|영플라자|영라이브|영어덜트|패션잡화|악세|액세|머플러|스카프|영트랜디|진캐주얼|진케주얼",
    "men": "남성정장|남성의류|신사|정장",
    "sport_golf": "골프|스포츠",
    "kids": "아동|유아|키즈|완구|문구|레고|문화용품",
    "food": "식품|농산|생식|청과|수산|축산|델리",
    "living": "가정용품|공산품|침구|수예|주방|생활|가전",
}
# Segments of the household block.
SEGMENTS = {
    "food": "식품|농산|생식|청과|수산|축산",
    "kids": "아동|유아|키즈|완구|문구",
    "living": "가정용품|공산품|주방|생활|침구",
    "men": "남성|신사",
    "women": "여성|숙녀",
    "cos": "화장품|향수",
    "golf": "골프|스포츠",
}
# Interest keywords, luxury and bargain words, parts by wearer.
INTERESTS = ["남성", "여성", "아동", "학생", "골프", "스포츠", "영", "마담", "캐주얼", "정장", "화장품"]
LUXURY = "수입|명품|부띠끄|부틱|디자이너"
BARGAIN = "행사|균일가|대전|기획|특가|이월"
MEN_PARTS = "'가정용품', '공산품', '생식품', '케주얼,구두,아동', '남성정장', '남성캐주얼'"
WOMEN_PARTS = "'여성캐주얼', '영캐릭터', '영플라자', '패션잡화', '여성정장'"
# Part names that stand for another.
PART_NAMES = {"가정용품파트": "가정용품", "공산품파트": "공산품", "생식품파트": "생식품", "잡화파트": "잡화", "로얄부틱": "로얄부띠끄", "스포츠캐쥬얼": "스포츠캐주얼", "여성캐쥬얼": "여성캐주얼"}
# Family holidays by date, for every year of which there are lines.
HOLIDAYS = {
    "chuseok": [("2017-09-20", "2017-10-06"), ("2024-09-03", "2024-09-19"), ("2025-09-22", "2025-10-08")],
    "seollal": [("2018-01-28", "2018-02-17"), ("2024-01-22", "2024-02-11"), ("2025-01-10", "2025-01-30"), ("2026-01-29", "2026-02-18")],
}
# Calendar windows (month, first and last day) and words of gift categories.
SEASONS = {"valentine": (2, 1, 14), "whiteday": (3, 1, 14), "xmas": (12, 15, 25), "mayfamily": (5, 1, 15), "newyear": (1, 1, 10)}
GIFTS = "화장품|향수|주얼리|보석|시계|핸드백|잡화|상품권"
GIFTS_KR = "화장품|향수|주얼리|시계|상품권|건강|홍삼|선물|기프트|넥타이|지갑|벨트"
FOOD = "식품|생식|푸드"

HALF = "case when mon between 3 and 5 then 'spring' when mon between 6 and 8 then 'summer' when mon between 9 and 11 then 'fall' else 'winter' end"
ZONE = "case when h <= 11 then 'morning' when h <= 14 then 'lunch' when h <= 17 then 'afternoon' else 'evening' end"
SOCIAL = "case when (dow < 5 and h >= 18) or (dow >= 5 and h between 12 and 21) then 1 else 0 end"
PART = "case coalesce(part_nm, '') " + " ".join(f"when '{a}' then '{b}'" for a, b in PART_NAMES.items()) + " else coalesce(part_nm, '') end"
MINUTES = "({{us {0}}} - {{us {1}}}) / 6e7"


def share(flag: str, amount: str = "w", plus: str = "1") -> str:
    return f"sum(case when {flag} then {amount} else 0 end) / (sum({amount}) + {plus})"


def gap_days() -> Block:
    """A row per custid and day with ``gap``, the days since the one before."""
    return LINES.agg("custid d", day_n="count(*)", day_net="sum(net_amt)", day_tot="sum(tot_amt)", day_brand="count(distinct brand)", day_corner="count(distinct corner_nm)")


BLOCKS: dict[str, Block] = {}

BLOCKS["base_agg"] = LINES.agg(
    "custid",
    n="count(*)",
    goods="count(distinct good)",
    brands="count(distinct brand)",
    corners="count(distinct corner_nm)",
    pcs="count(distinct pc_nm)",
    parts="count(distinct part_nm)",
    teams="count(distinct team_nm)",
    stores="count(distinct str_nm)",
    days="count(distinct d)",
    net_sum="sum(net_amt)",
    net_mean="avg(net_amt)",
    net_max="max(net_amt)",
    net_min="min(net_amt)",
    net_std="stddev_samp(net_amt)",
    net_median="median(net_amt)",
    tot="sum(tot_amt)",
    dis="sum(dis_amt)",
    refund="avg(case when net_amt < 0 then 1e0 else 0e0 end)",
    import_="avg(import_flg)",
    inst="avg(case when inst_mon > 1 then 1e0 else 0e0 end)",
    inst_mon_mean="avg(inst_mon)",
    weekend="avg(case when dow >= 5 then 1e0 else 0e0 end)",
    evening="avg(case when h >= 18 then 1e0 else 0e0 end)",
    morning="avg(case when h <= 11 then 1e0 else 0e0 end)",
    hour_mean="avg(h)",
    hour_std="stddev_samp(h)",
).out(
    n_lines="n",
    n_goods="goods",
    n_brands="brands",
    n_corners="corners",
    n_pcs="pcs",
    n_parts="parts",
    n_teams="teams",
    n_stores="stores",
    visit_days="days",
    net_sum="net_sum",
    net_mean="net_mean",
    net_max="net_max",
    net_min="net_min",
    net_std="net_std",
    net_median="net_median",
    tot_sum="tot",
    dis_sum="dis",
    refund_share="refund",
    import_share="import_",
    instalment_share="inst",
    inst_mon_mean="inst_mon_mean",
    weekend_share="weekend",
    evening_share="evening",
    morning_share="morning",
    hour_mean="hour_mean",
    hour_std="hour_std",
    goods_per_line="goods / n",
    brands_per_line="brands / n",
    lines_per_visit="n / days",
    net_per_visit="net_sum / days",
    discount_rate="dis / (abs(tot) + 1)",
)

BLOCKS["composition_ratio"] = LINES.cols(season=HALF, zone=ZONE).agg(
    "custid",
    **{f"season_{v}": f"avg(case when season = '{v}' then 1e0 else 0e0 end)" for v in ("spring", "summer", "fall", "winter")},
    **{f"zone_{v}": f"avg(case when zone = '{v}' then 1e0 else 0e0 end)" for v in ("morning", "lunch", "afternoon", "evening")},
).out(**{f"season_{v}": f"season_{v}" for v in ("spring", "summer", "fall", "winter")}, **{f"zone_{v}": f"zone_{v}" for v in ("morning", "lunch", "afternoon", "evening")})

for _name, _col in {"brand": "brand", "corner": "corner_nm", "store": "str_nm", "part": "part_nm", "zone": ZONE}.items():
    BLOCKS[f"diversity_{_name}"] = (
        LINES.cols(cat=_col)
        .where("cat is not null")
        .agg("custid cat", c="count(*)")
        .totals("custid", total="sum(c)")
        .cols(p="cast(c as double) / total")
        .agg("custid", entropy="-sum(p * ln(p + 1e-12))", hhi="sum(p * p)", top="max(p)", plain="-sum(p * ln(p))")
        .out(entropy="entropy", hhi="hhi", top_share="top", entropy_plain="plain")
        .spine()
    )

for _name, _col in {"team": "team_nm", "part": PART, "buyer": "buyer_nm"}.items():
    # the crosstab's filled cells: categories typed by hand have too many values for columns
    BLOCKS[f"composition_{_name}"] = (
        LINES.cols(cat=_col).where("cat <> ''").agg("custid cat", c="count(*)").totals("custid", total="sum(c)").select(custid="custid", cat="cat", n="c", share="round(cast(c as double) / total + 1e-10, 6)")
    )

BLOCKS["semantic_share"] = LINES.agg(
    "custid",
    **{f"{g}_n": f"avg(case when {{like txt;{p}}} then 1e0 else 0e0 end)" for g, p in GROUPS.items()},
    **{f"{g}_amt": share(f"{{like txt;{p}}}") for g, p in GROUPS.items()},
).out(**{f"{g}_{x}": f"{g}_{x}" for g in GROUPS for x in ("n", "amt")})

BLOCKS["amount_stats"] = (
    LINES.overall(q90="{pct net_amt;0.9}")
    .agg(
        "custid",
        q25="{pct net_amt;0.25}",
        q75="{pct net_amt;0.75}",
        skew="{skew net_amt}",
        high="avg(case when net_amt >= q90 then 1e0 else 0e0 end)",
        luxury="avg(case when net_amt >= q90 and import_flg = 1 then 1e0 else 0e0 end)",
    )
    .out(q25="q25", q75="q75", iqr="q75 - q25", net_skew="skew", high_share="high", luxury_share="luxury")
)

BLOCKS["temporal_dynamics"] = (
    LINES.overall(now="max(d)")
    .totals("custid", t0="min(ts)", t1="max(ts)")
    .cols(span=f"{MINUTES.format('t1', 't0')}", since=f"{MINUTES.format('ts', 't0')}")
    .agg("custid", now="max(now)", last="max(d)", first="min(d)", months="count(distinct date_trunc('month', ts))", n="count(*)", late=share("case when span = 0 then 0.5 else since / span end >= 0.5"))
    .out(recency_days="{days now;last}", tenure_days="{days last;first}", active_months="months", lines_per_month="n / months", late_share="late")
)

BLOCKS["social_share"] = LINES.cols(social=SOCIAL).agg("custid", n="count(*)", k="sum(social)", amt=share("social = 1"), total="sum(w)", part="sum(w * social)").out(social_lines="k", social_line_share="k / n", social_amount_share="amt", social_amount="part")

# minutes of the clock, as a day's dwell is told in whole ones
_CLOCK = {"social": SOCIAL, "clock": "h * 60 + minute(ts)"}
_DWELL = {"m": "avg(span)", "x": "max(span)", "long": "avg(case when span >= 60 then 1e0 else 0e0 end)", "per": "avg(amt / (span + 1e0))", "soclong": "avg(case when soc = 1 and span >= 60 then 1e0 else 0e0 end)"}
_DWELT = {"span_mean": "m", "span_max": "x", "longstay_share": "long", "amount_per_minute": "per", "social_long_share": "soclong"}
BLOCKS["social_dwell"] = LINES.cols(**_CLOCK).agg("custid d", span="max(clock) - min(clock)", amt="greatest(sum(coalesce(net_amt, 0)), 0)", soc="max(social)").agg("custid", **_DWELL).out(**_DWELT)
BLOCKS["dwell_gross"] = BOTH.cols(**_CLOCK).agg("custid d", span="max(clock) - min(clock)", amt="sum(tot_amt)", soc="max(social)").agg("custid", **_DWELL).out(**_DWELT)
BLOCKS["social_gross"] = (
    BOTH.cols(social=SOCIAL)
    .agg("custid", n="count(*)", k="sum(social)", amt="sum(tot_amt)", part="sum(tot_amt * social)")
    .out(n_lines="n", social_lines="k", social_line_share="k / (n + 1e-5)", amount="amt", social_amount="part", social_amount_share="part / (amt + 1e-5)")
)

for _k in (3, 5):
    BLOCKS[f"recent_{_k}"] = (
        LINES.position()
        .where(f"pos_back < {_k}")
        .cols(part=PART)
        .agg("custid", m="avg(tot_amt)", x="max(tot_amt)", t="sum(tot_amt)", ds="sum(dis_amt)", net="avg(net_amt)", men=f"avg(case when part in ({MEN_PARTS}) then 1e0 else 0e0 end)", women=f"avg(case when part in ({WOMEN_PARTS}) then 1e0 else 0e0 end)")
        .out(tot_mean="m", tot_max="x", discount_mean="ds / (t + 1e-5)", net_mean="net", men_share="men", women_share="women")
    )

BLOCKS["part_score"] = LINES.cols(part=PART).agg(
    "custid", m=f"sum(case when part in ({MEN_PARTS}) then 1 else 0 end)", f=f"sum(case when part in ({WOMEN_PARTS}) then 1 else 0 end)"
).out(men_parts="m", women_parts="f", men_share="m / (m + f + 1e-5)", women_share="f / (m + f + 1e-5)", score="(m - f) / (m + f + 1e-5)")

BLOCKS["buyer_variety"] = LINES.where("buyer_nm is not null").agg("custid buyer_nm", c="count(*)").agg("custid", n="count(*)", x="max(c)", t="sum(c)").out(n_buyers="n", top_buyer_share="cast(x as double) / t")

for _name, _col in {"brand": "brand", "good": "good", "corner": "corner_nm", "buyer": "buyer_nm", "pc": "pc_nm"}.items():
    # none is a category of its own
    BLOCKS[f"freq_{_name}"] = (
        BOTH.cols(cat=f"coalesce({_col}, 'nan')")
        .totals("cat", freq="count(*)")
        .agg("custid", m="avg(ln(1 + freq))", lo="min(ln(1 + freq))", rare="avg(case when freq <= 5 then 1e0 else 0e0 end)")
        .out(freq_mean="m", freq_min="lo", rare_share="rare")
    )

BLOCKS["trajectory_delta"] = (
    LINES.position()
    .cols(second="2 * pos >= n_rows")
    .agg("custid", **{f"{g}_{half}": f"sum(case when {cond} second and {{like txt;{p}}} then w else 0 end) / (sum(case when {cond} second then w else 0 end) + 1)" for g, p in GROUPS.items() for half, cond in (("b", ""), ("a", "not"))})
    .out(**{f"{g}_delta": f"{g}_b - {g}_a" for g in GROUPS})
)

BLOCKS["amount_slope"] = (
    LINES.position()
    .where("net_amt is not null")
    .cols(x="cast(pos as double)", y="cast(net_amt as double)")
    .agg("custid", n="count(*)", sx="sum(x)", sy="sum(y)", sxx="sum(x * x)", sxy="sum(x * y)")
    .out(slope="case when n * sxx - sx * sx = 0 then 0 else (n * sxy - sx * sy) / (n * sxx - sx * sx) end")
)

_INWIN = {n: f"mon = {m} and dom between {a} and {b}" for n, (m, a, b) in SEASONS.items()}
_ANY = " or ".join(f"({c})" for c in _INWIN.values())
BLOCKS["calendar_windows"] = LINES.agg(
    "custid",
    **{n: share(c) for n, c in _INWIN.items()},
    any_=share(_ANY),
    gift_in=share(f"({_ANY}) and {{like txt;{GIFTS}}}"),
    gift=share(f"{{like txt;{GIFTS}}}"),
).out(**{f"{n}_share": n for n in _INWIN}, any_share="any_", gift_in_share="gift_in", gift_share="gift")

_MD = "mon * 100 + dom"
_KR = {"parents": f"{_MD} between 428 and 508", "pepero": f"{_MD} between 1105 and 1111"}
_KR |= {n: "(" + " or ".join(f"ts between timestamp '{a} 00:00:00' and timestamp '{b} 00:00:00'" for a, b in spans) + ")" for n, spans in HOLIDAYS.items()}
_KRANY = " or ".join(f"({c})" for c in _KR.values())
BLOCKS["calendar_windows_kr"] = LINES.agg(
    "custid", **{n: share(c, "a") for n, c in _KR.items()}, any_=share(_KRANY, "a"), gift=share(f"({_KRANY}) and {{like txt;{GIFTS_KR}}}", "a"), off=share(f"not ({_KRANY}) and {{like txt;{GIFTS_KR}}}", "a")
).out(**{f"{n}_share": n for n in _KR}, any_share="any_", gift_in_share="gift", gift_off_share="off")

BLOCKS["relative_price"] = (
    LINES.relative("brand", "net_amt", "rb")
    .relative("pc_nm", "net_amt", "rp")
    .agg("custid", bm="avg(rb)", bx="max(rb)", bs="stddev_samp(rb)", pm="avg(rp)", px="max(rp)")
    .out(**{n: f"coalesce({c}, 0.5)" for n, c in {"brand_mean": "bm", "brand_max": "bx", "brand_std": "bs", "pc_mean": "pm", "pc_max": "px"}.items()})
)

BLOCKS["interarrival"] = (
    LINES.previous("ts").where("has_prev").cols(gap=f"{MINUTES.format('ts', 'prev_ts')} / 1440").agg("custid", m="avg(gap)", s="stddev_samp(gap)", x="max(gap)", lo="min(gap)").out(gap_mean="m", gap_std="s", gap_max="x", gap_min="lo").spine()
)

BLOCKS["switch_rate"] = LINES.previous("buyer_nm").agg("custid", r="avg(case when coalesce(buyer_nm, 'nan') <> coalesce(prev_buyer_nm, 'nan') then 1e0 else 0e0 end)").out(switch_rate="r")

BLOCKS["transition_token"] = (
    LINES.previous("corner_nm").cols(token="concat(coalesce(prev_corner_nm, 'START'), '>', coalesce(corner_nm, ''))").agg("custid", n="count(*)", k="count(distinct token)").out(n_tokens="n", n_different="k")
)

BLOCKS["transitions"] = (
    LINES.where("corner_nm is not null")
    .previous("corner_nm")
    .where("has_prev")
    .agg("custid", n="count(*)", same="avg(case when corner_nm = prev_corner_nm then 1e0 else 0e0 end)", pairs="count(distinct concat(prev_corner_nm, '>', corner_nm))")
    .out(n_steps="n", same_share="same", n_pairs="pairs", pair_share="pairs / (n + 1)")
    .spine()
)

BLOCKS["visit_multiagg"] = (
    LINES.agg("custid d", g="count(distinct good)", c="count(distinct corner_nm)", s="sum(net_amt)")
    .agg("custid", n="count(*)", gm="avg(g)", gx="max(g)", gs="stddev_samp(g)", sm="avg(s)", sx="max(s)", ss="stddev_samp(s)", multi="avg(case when c >= 3 then 1e0 else 0e0 end)", big="avg(case when g >= 5 then 1e0 else 0e0 end)", gsum="sum(g)")
    .out(n_visits="n", goods_mean="gm", goods_max="gx", goods_std="gs", spend_mean="sm", spend_max="sx", spend_std="ss", multi_corner_share="multi", big_basket_share="big", goods_per_visit="gsum / n")
)

_HAS_GAP = "gap is not null"
_GAPS = gap_days().gap()
BLOCKS["periodicity"] = (
    _GAPS.where(_HAS_GAP)
    .agg("custid", m="avg(gap)", s="stddev_pop(gap)", x="max(gap)")
    .out(gap_mean="m", gap_std="s", gap_cv="s / (m + 1e-6)", gap_max="x", regularity="1 / (s / (m + 1e-6) + 1)")
    .spine()
)
BLOCKS["quantile_gap_daily"] = _GAPS.agg(
    "custid",
    gm="avg(gap)",
    gd="median(gap)",
    gs="stddev_samp(gap)",
    gx="max(gap)",
    r7="avg(case when gap <= 7 then 1e0 else 0e0 end)",
    g30="avg(case when gap >= 30 then 1e0 else 0e0 end)",
    **{f"{c}_{f}": e.format(f"day_{c}") for c in ("brand", "corner", "n", "tot") for f, e in {"mean": "avg({})", "std": "stddev_samp({})", "max": "max({})"}.items()},
).out(gap_mean="gm", gap_median="gd", gap_std="gs", gap_max="gx", revisit7="r7", gap30="g30", **{f"daily_{c}_{f}": f"{c}_{f}" for c in ("brand", "corner", "n", "tot") for f in ("mean", "std", "max")})

BLOCKS["tot_quantiles"] = LINES.agg(
    "custid", **{f"q{q}": f"{{pct tot_amt;{q / 100}}}" for q in (25, 50, 75, 90, 95)}, s="stddev_samp(tot_amt)", m="avg(tot_amt)"
).out(**{f"q{q}": f"q{q}" for q in (25, 50, 75, 90, 95)}, iqr="q75 - q25", p90_p50="q90 / (abs(q50) + 1e-5)", cv="s / (abs(m) + 1e-5)")

BLOCKS["behavior"] = LINES.agg(
    "custid",
    r="sum(case when net < 0 then 1 else 0 end)",
    n="count(*)",
    i="avg(case when inst_mon > 0 then 1e0 else 0e0 end)",
    x="max(inst_mon)",
    b="count(distinct brand)",
    c="count(distinct corner_nm)",
    p="count(distinct part_nm)",
    t="avg(tot_amt)",
    hi="sum(case when tot_amt > 300000 then 1 else 0 end)",
).out(refund_count="r", refund_share="r / n", instalment_share="i", inst_max="x", n_brands="b", n_corners="c", n_parts="p", ticket_size="t", high_count="hi")

BLOCKS["style"] = (
    LINES.cols(dr="dis_amt / (tot_amt + 1e-5)")
    .agg("custid", lux=f"avg(case when {{like coalesce(corner_nm, '');{LUXURY}}} then 1e0 else 0e0 end)", bar=f"avg(case when {{like coalesce(corner_nm, '');{BARGAIN}}} then 1e0 else 0e0 end)", s="stddev_samp(dr)", m="avg(dr)")
    .out(luxury_share="lux", bargain_share="bar", discount_std="coalesce(s, 0)", discount_mean="coalesce(m, 0)")
)

BLOCKS["base_gross"] = (
    BOTH.overall(now="max(d)")
    .agg("custid", now="max(now)", last="max(d)", ts_="sum(tot_amt)", tm="avg(tot_amt)", tx="max(tot_amt)", tn="min(tot_amt)", td="stddev_samp(tot_amt)", ds="sum(dis_amt)", dm="avg(dis_amt)", im="avg(inst_mon)", ix="max(inst_mon)", n="count(*)", hm_="avg(h)", hs="stddev_samp(h)", dr="avg(case when tot_amt > 0 then dis_amt * 1e2 / tot_amt else 0 end)", wk="avg(case when dow >= 5 then 1e0 else 0e0 end)")
    .out(tot_sum="ts_", tot_mean="tm", tot_max="tx", tot_min="tn", tot_std="td", dis_sum="ds", dis_mean="dm", inst_mean="im", inst_max="ix", freq="n", hour_mean="hm_", hour_std="hs", ticket="ts_ / n", disc_rate_sum="ds / (ts_ + 1e-5)", disc_rate_mean="dr", recency="{days now;last}", weekend_share="wk")
)

BLOCKS["discount_peak"] = (
    LINES.cols(pct="case when tot_amt > 0 then dis_amt * 1e2 / tot_amt else 0 end")
    .agg(
        "custid",
        m="avg(pct)",
        x="max(pct)",
        k="sum(case when pct >= 10 then 1 else 0 end)",
        n="count(*)",
        d="sum(case when dis_amt > 0 then 1 else 0 end)",
        l="sum(case when h between 11 and 13 then 1 else 0 end)",
        e="sum(case when h between 17 and 19 then 1 else 0 end)",
        s="stddev_samp(h)",
    )
    .out(disc_mean="m", disc_max="x", high_count="k", high_share="k / n", disc_share="d / n", lunch_count="l", lunch_share="l / n", evening_count="e", evening_share="e / n", hour_std="s")
)

BLOCKS["refund_strength"] = (
    LINES.agg("custid", n="count(*)", k="sum(case when net < 0 then 1 else 0 end)", s="sum(case when net < 0 then abs(net) end)", m="avg(case when net < 0 then abs(net) end)", x="max(case when net < 0 then abs(net) end)")
    .out(n_lines="n", refund_count="k", refund_share="k / n", refund_sum="coalesce(s, 0)", refund_mean="coalesce(m, 0)", refund_max="coalesce(x, 0)", heavy="case when k >= 3 or k / (n + 1e-5) >= 0.1e0 then 1 else 0 end")
)

_INTEREST = "concat(coalesce(brd_nm, ''), ' ', coalesce(corner_nm, ''), ' ', coalesce(part_nm, ''))"
BLOCKS["interest_share"] = (
    LINES.cols(words=_INTEREST)
    .agg("custid", **{f"i{k}": f"sum(case when {{like words;{x}}} then tot_amt else 0 end) / (sum(tot_amt) + 1e-5)" for k, x in enumerate(INTERESTS)})
    .out(**{f"interest_{k}": f"i{k}" for k in range(len(INTERESTS))})
)

BLOCKS["interest_score"] = (
    LINES.cols(words=_INTEREST)
    .agg("custid", **{k: f"sum(case when {{like words;{x}}} then w else 0 end) / (sum(w) + 1e-5)" for k, x in (("m", "남성"), ("f", "여성"), ("k", "아동"))})
    .out(men="m", women="f", score="m - f + 0.5 * k")
)

BLOCKS["household_share"] = LINES.agg("custid", **{s: share(f"{{like txt;{p}}}", "a") for s, p in SEGMENTS.items()}).out(
    **{s: s for s in SEGMENTS},
    homemaker="food + kids + living",
    proxy_men="men * (food + kids)",
    breadth=" + ".join(f"case when {s} > 0.02 then 1 else 0 end" for s in SEGMENTS),
    cos_vs_men="cos - men",
    men_signal="men + golf",
    women_signal="cos + women",
    conflict="(men + golf) * (cos + women)",
    proxy_men_all="men * (food + kids + living)",
)

_G = {f"g{k}": f"substring(code, 1, {k})" for k in (2, 3, 4, 6, 9)}
BLOCKS["code_hierarchy"] = (
    BOTH.cols(**_G)
    .agg("custid", n="count(*)", c="count(distinct code)", **{f"n{k}": f"count(distinct g{k})" for k in (2, 3, 4, 9)})
    .out(leaf_per_group="c / (n3 + 1e-5)", deep_per_mid="n9 / (n4 + 1e-5)", code_per_top="c / (n2 + 1e-5)", repeat_share="1 - c / (n + 1e-5)", new_top_share="n2 / (n + 1e-5)")
)

BLOCKS["top_tail_share"] = (
    BOTH.cols(g3="substring(code, 1, 3)")
    .agg("custid g3", s="sum(a)")
    .totals("custid", total="sum(s)")
    .cols(p="s / (total + 1e-5)")
    .placed("s")
    .agg("custid", hhi="sum(p * p)", top="sum(case when place = 1 then p else 0 end)", tail="sum(case when place >= 4 then p else 0 end)", most="max(p)")
    .out(hhi="hhi", top_share="top", tail_share="tail", max_share="most")
)

BLOCKS["brand_hhi"] = BOTH.where("brand is not null").agg("custid brand", s="sum(a)").totals("custid", total="sum(s)").agg("custid", hhi="sum(pow(s / (total + 1e-5), 2))").out(hhi="hhi").spine()

BLOCKS["gap_shape"] = BOTH.agg("custid d", n="count(*)").gap().agg("custid", v="var_samp(gap)", s="{skew gap}").out(gap_var="coalesce(v, 0)", gap_skew="coalesce(s, 0)")

BLOCKS["basket_stats"] = (
    BOTH.agg("custid d hm", x="max(abs(net))", s="sum(abs(net))", c="count(distinct corner_nm)", n="count(*)", sd="stddev_samp(net)")
    .agg("custid", dom="avg(x / (s + 1e-5))", multi="avg(case when c >= 2 then 1e0 else 0e0 end)", size="avg(n)", sd="avg(sd)")
    .out(dominance="dom", multi_corner_share="multi", basket_size="size", price_std="sd")
)

BLOCKS["price_residual"] = (
    BOTH.cols(g3="substring(code, 1, 3)", dr="coalesce(dis_amt, 0) / (a + 1e-5)")
    .totals("brand", bmean="avg(net)")
    .totals("g3", gdr="avg(dr)")
    .overall(q90="{pct net;0.9}")
    .relative("g3", "net", "pr")
    .agg("custid", rel="avg(net / (bmean + 1e-5))", pm="avg(pr)", ph="avg(case when pr >= 0.8 then 1e0 else 0e0 end)", res="avg(dr - gdr)", prem="avg(case when coalesce(dis_amt, 0) = 0 and net >= q90 then 1e0 else 0e0 end)")
    .out(brand_relative="rel", category_rank="pm", category_high="ph", discount_residual="res", full_price_premium="prem")
)

BLOCKS["sequence_price"] = (
    BOTH.previous("net")
    .where("has_prev")
    .cols(step="(net - prev_net) / (abs(prev_net) + 1e-5)")
    .agg("custid", m="avg(step)", s="stddev_samp(step)")
    .out(digits=3, step_mean="m", step_std="s")
)

BLOCKS["velocity"] = (
    BOTH.position()
    .agg("custid", b="sum(case when 2 * pos >= n_rows then a else 0 end)", f="sum(case when 2 * pos < n_rows then a else 0 end)", n="count(*)")
    .out(velocity="case when n < 2 then 1 else b / (f + 1e-5) end")
)

BLOCKS["group_switch"] = (
    BOTH.previous("code").agg("custid", r="avg(case when has_prev and substring(code, 1, 3) <> substring(prev_code, 1, 3) then 1e0 else 0e0 end)").out(switch_share="r")
)

BLOCKS["sibling_days"] = (
    BOTH.cols(g2="substring(code, 1, 2)", g4="substring(code, 1, 4)").agg("custid d", n2="count(distinct g2)", n4="count(distinct g4)").agg("custid", r="avg(case when n2 < n4 then 1e0 else 0e0 end)").out(sibling_share="r")
)

BLOCKS["buyer_niche"] = BOTH.where("buyer_nm is not null").totals("buyer_nm", c="count(*)").agg("custid", m="avg(c)").out(buyer_count_mean="m").spine()

BLOCKS["refund_per_discount"] = BOTH.agg("custid", r="sum(case when net < 0 then 1 else 0 end)", d="sum(case when dis_amt > 0 then 1 else 0 end)").out(refund_per_discount="r / (d + 1)")

BLOCKS["food_anchor"] = (
    BOTH.cols(food=f"case when {{like coalesce(part_nm, '');{FOOD}}} then 1e0 else 0e0 end")
    .first_last("food")
    .agg("custid", m="avg((first_food + last_food) / 2)")
    .out(food_anchor="m")
)

BLOCKS["drift_cosine"] = (
    # a half without lines: 0; a half without amounts has no direction: 1
    BOTH.position()
    .cols(g2="substring(code, 1, 2)", late="case when 2 * pos >= n_rows then 1 else 0 end")
    .agg("custid g2", x="sum(case when late = 0 then a else 0 end)", y="sum(case when late = 1 then a else 0 end)", k="sum(late)")
    .agg("custid", xy="sum(cast(x as double) * y)", xx="sum(cast(x as double) * x)", yy="sum(cast(y as double) * y)", k="sum(k)")
    .out(drift="case when k = 0 then 0 else 1 - xy / (sqrt(xx) * sqrt(yy) + 1e-9) end")
)

_MONTHS = list(range(1, 13))
_SUM = lambda e: "(" + " + ".join(e.format(k=k) for k in _MONTHS) + ")"
BLOCKS["season_align"] = (
    # shares of the amount by the months of which there are lines, against their mean over the customers
    BOTH.agg("custid", s="sum(a)", **{f"a{k}": f"sum(case when mon = {k} then a else 0 end)" for k in _MONTHS}, **{f"c{k}": f"max(case when mon = {k} then 1 else 0 end)" for k in _MONTHS})
    .cols(**{f"m{k}": f"a{k} / (s + 1e-9)" for k in _MONTHS})
    .overall(**{f"r{k}": f"avg(m{k})" for k in _MONTHS}, **{f"o{k}": f"max(c{k})" for k in _MONTHS})
    .cols(mx=f"{_SUM('m{k}')} / {_SUM('o{k}')}", my=f"{_SUM('r{k}')} / {_SUM('o{k}')}")
    .cols(xy=_SUM("o{k} * (m{k} - mx) * (r{k} - my)"), xx=_SUM("o{k} * (m{k} - mx) * (m{k} - mx)"), yy=_SUM("o{k} * (r{k} - my) * (r{k} - my)"))
    .out(season_corr="case when xx > 1e-15 and yy > 1e-15 then xy / sqrt(xx * yy) else 0 end")
)

BLOCKS["pivot_counts"] = (
    BOTH.cols(
        wd="case when dow <= 2 then 'mtw' when dow <= 4 then 'tf' else 'we' end",
        ss="case when mon between 2 and 4 then 'spring' when mon between 5 and 7 then 'summer' when mon between 8 and 10 then 'fall' else 'winter' end",
        tm="case when hm < 1200 then 'morning' when hm < 1400 then 'lunch' when hm < 1600 then 'noon1' when hm < 1800 then 'noon2' else 'evening' end",
    )
    .agg(
        "custid",
        days="count(distinct d)",
        **{f"{c}_{v}": f"sum(case when {c} = '{v}' then 1 else 0 end)" for c, vs in {"wd": ("mtw", "tf", "we"), "ss": ("spring", "summer", "fall", "winter"), "tm": ("morning", "lunch", "noon1", "noon2", "evening")}.items() for v in vs},
    )
    .out(visit_days="days", **{f"{c}_{v}": f"{c}_{v}" for c, vs in {"wd": ("mtw", "tf", "we"), "ss": ("spring", "summer", "fall", "winter"), "tm": ("morning", "lunch", "noon1", "noon2", "evening")}.items() for v in vs})
)

BLOCKS["line_features"] = LINES.cols(season=HALF, zone=ZONE).agg(
    "custid line_id", h="max(h)", dow="max(dow)", mon="max(mon)", weekend="max(case when dow >= 5 then 1 else 0 end)", dr="max(case when coalesce(tot_amt, 0) = 0 then 0 else cast(dis_amt as double) / tot_amt end)", nr="max(case when coalesce(tot_amt, 0) = 0 then 1 else cast(net_amt as double) / tot_amt end)", sl="max(sign(net_amt) * ln(1 + abs(net_amt)))"
).select(custid="custid", line_id="line_id", **{n: f"cast({c} as bigint)" for n, c in {"hour": "h", "dow": "dow", "month": "mon", "weekend": "weekend"}.items()}, **{n: f"round({c} + 1e-10, 6)" for n, c in {"dis_ratio": "dr", "net_ratio": "nr", "signed_log": "sl"}.items()})

BLOCKS["power_mean"] = LINES.agg("custid", **{f"p{k}": f"pow(avg(pow(cast(a as double) / 1000000, {k})), 1e0 / {k})" for k in (2, 3, 5)}).out(**{f"power_{k}": f"p{k}" for k in (2, 3, 5)})

BLOCKS["clip_replace"] = LINES.cols(store="case when str_nm in ('온라인몰') then 'online' else coalesce(str_nm, 'unknown') end", c="greatest(least(tot_amt, 500000), -500000)").agg(
    "custid", online="avg(case when store = 'online' then 1e0 else 0e0 end)", unknown="avg(case when store = 'unknown' then 1e0 else 0e0 end)", m="avg(c)", z="avg(case when tot_amt = 0 then 0 else cast(c as double) / nullif(tot_amt, 0) end)"
).out(online_share="online", unknown_share="unknown", clipped_mean="m", clipped_ratio="z")

QUERIES = {name: block.spark for name, block in BLOCKS.items()}
#: Every block has an oracle written from its definition; a new one without has that of its steps.
SQL = {name: block.sql() for name, block in BLOCKS.items()} | oracles.SQL
