"""DuckDB SQL twins of the registered queries, written independently of the library."""

from __future__ import annotations

DP = 6


def q(a: str, b: str) -> str:
    return f"(CASE WHEN isfinite(({a})::DOUBLE) AND isfinite(({b})::DOUBLE) AND abs({b}) > 1e-12 THEN ({a}) / ({b}) END)"


def r(x: str, name: str) -> str:
    return f"round(({x})::DOUBLE, {DP}) AS {name}"


def rf(x: str, name: str) -> str:
    """Narrowed to single precision first."""
    return f"round(CASE WHEN isfinite(({x})::DOUBLE) THEN ({x})::FLOAT END::DOUBLE, {DP}) AS {name}"


def tie_free(sql: str) -> str:
    """Spell ``round(x, n)`` as a floor with an offset.

    Exact decimals ending in 5 then never sit on the rounding edge, where the last
    bit of a sum would decide.
    """
    out, at = "", 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end, comma = 1, start + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if sql[end] == "," and depth == 1:
                comma = end
            end += 1
        inner, digits = tie_free(sql[start + 6 : comma]), sql[comma + 1 : end - 1].strip()
        out += sql[at:start] + f"(floor(({inner})::DOUBLE * 1e{digits} + 0.5001) / 1e{digits})"
        at = end
    return out + sql[at:]


def cte(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# ---- fixtures -------------------------------------------------------------------------------------------------
DAILY = """
dt AS (
  SELECT lpad(CAST(l_suppkey // 4 % 1000000 AS VARCHAR), 6, '0') AS Code,
         CAST(year(l_shipdate)*10000 + month(l_shipdate)*100 + day(l_shipdate) AS INT) AS Date,
         l_extendedprice / l_quantity AS price, l_quantity, l_extendedprice,
         row_number() OVER (PARTITION BY l_suppkey // 4 % 1000000, l_shipdate
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS rn
  FROM lineitem),
db AS (
  SELECT Code, Date, min_by(price, rn) AS open, max(price) AS high, min(price) AS low, max_by(price, rn) AS close,
         sum(l_quantity) / 100 AS vol, sum(l_extendedprice) / 1000 AS amount
  FROM dt GROUP BY Code, Date),
daily AS (
  SELECT Code, Date, open, high, low, close,
         coalesce(lag(close) OVER (PARTITION BY Code ORDER BY Date), open) AS pre_close, vol, amount,
         1 + (CAST(Code AS INT) % 5) / CAST(100 AS DOUBLE) AS adj_factor
  FROM db)"""

MINUTES = """
me AS (
  SELECT lpad(CAST(user_id // 8 % 1000000 AS VARCHAR), 6, '0') AS Code,
         CAST(year(ts)*10000 + month(ts)*100 + day(ts) AS INT) AS Date,
         CAST(floor((hour(ts)*60 + minute(ts)) * 241 / CAST(1440 AS DOUBLE)) AS INT) AS k,
         value AS price, CAST(100 * (1 + event_id % 10) AS DOUBLE) AS v, event_id FROM events),
mm AS (SELECT *, CASE WHEN k <= 120 THEN 570 + k ELSE 781 + k - 121 END AS mins FROM me),
minutes AS (
  SELECT Code, Date, CAST(floor(mins / CAST(60 AS DOUBLE)) * 100 + mins % 60 AS INT) AS Minute,
         min_by(price, event_id) AS open, max(price) AS high, min(price) AS low, max_by(price, event_id) AS close,
         sum(v) AS vol, sum(price * v) AS amount,
         1 + (CAST(Code AS INT) % 5) / CAST(100 AS DOUBLE) AS adj_factor
  FROM mm GROUP BY Code, Date, CAST(floor(mins / CAST(60 AS DOUBLE)) * 100 + mins % 60 AS INT))"""

INTRADAY = """
ib AS (
  SELECT Code, Date, min_by(open, Minute) AS open, max(high) AS high, min(low) AS low, max_by(close, Minute) AS close,
         sum(vol / 100) AS vol, sum(amount / 1000) AS amount FROM minutes GROUP BY Code, Date),
intraday AS (
  SELECT *, coalesce(lag(close) OVER (PARTITION BY Code ORDER BY Date), open) AS pre_close,
         1 + (CAST(Code AS INT) % 5) / CAST(100 AS DOUBLE) AS adj_factor FROM ib)"""


def adjusted(source: str, name: str = "adj") -> str:
    prices = ", ".join(f"{p} * adj_factor AS {p}_adj" for p in ("open", "high", "low", "close", "pre_close"))
    return (
        f"{name} AS (SELECT Code, Date, {prices}, {q('amount * 1000', 'vol * 100')} * adj_factor AS vwap_adj, "
        f"vol * 100 AS volume_shares, amount * 1000 * adj_factor AS amount_adj, adj_factor FROM {source})"
    )


# ---- daily features -------------------------------------------------------------------------------------------
def lookback(source: str = "adj") -> str:
    w = "OVER (PARTITION BY Code ORDER BY Date)"
    cols = [f"lag(close_adj, {n}) {w} AS c{n}" for n in (1, 5, 10, 20, 60)]
    cols += [f"lag(vwap_adj) {w} AS pv", f"lag(volume_shares) {w} AS pvol", f"lag(amount_adj) {w} AS pamt"]
    for n in (5, 20, 60):
        f = f"OVER (PARTITION BY Code ORDER BY Date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        cols.append(f"CASE WHEN count(close_adj) {f} = {n} THEN avg(close_adj) {f} END AS ma{n}")
        cols.append(f"CASE WHEN count(low_adj) {f} = {n} THEN min(low_adj) {f} END AS lo{n}")
        cols.append(f"CASE WHEN count(high_adj) {f} = {n} THEN max(high_adj) {f} END AS hi{n}")
    return f"look AS (SELECT *, {', '.join(cols)} FROM {source})"


O, H, L, C, V = "open_adj", "high_adj", "low_adj", "close_adj", "vwap_adj"
D1 = {
    "OPEN_REL_CLOSE": q(O, C), "HIGH_REL_CLOSE": q(H, C), "LOW_REL_CLOSE": q(L, C), "VWAP_REL_CLOSE": q(V, C),
    "RANGE_OPEN": q(f"{H}-{L}", O), "BODY": q(f"{C}-{O}", O), "ABS_BODY": q(f"abs({C}-{O})", O),
    "UPPER_SHADOW": q(f"greatest({H}-greatest({O},{C}),0)", O), "LOWER_SHADOW": q(f"greatest(least({O},{C})-{L},0)", O),
    "BODY_RANGE_RATIO": q(f"abs({C}-{O})", f"({H}-{L})"), "CLOSE_POS": q(f"{C}-{L}", f"({H}-{L})"),
    "VWAP_POS": q(f"{V}-{L}", f"({H}-{L})"), "RET_OC": q(C, O) + "-1", "RET_CC_1D": q(C, "c1") + "-1",
    "GAP": q(O, "c1") + "-1", "RET_VWAP_1D": q(V, "pv") + "-1", "CLOSE_VWAP": q(C, V) + "-1", "OPEN_VWAP": q(O, V) + "-1",
    "LOG_VOLUME": "ln(1+volume_shares)", "LOG_AMOUNT": "ln(1+amount_adj)",
    "VOL_CHG_1D": q("volume_shares", "pvol") + "-1", "AMT_CHG_1D": q("amount_adj", "pamt") + "-1",
    "VWAP_AMOUNT_INTENSITY": q("amount_adj", f"abs({C}-{O})"),
    "RET_PER_AMOUNT": q(f"{q(C, O)}-1", "ln(1+amount_adj)"), "RANGE_PER_AMOUNT": q(q(f"{H}-{L}", O), "ln(1+amount_adj)"),
    "RET_5D": q(C, "c5") + "-1", "RET_10D": q(C, "c10") + "-1", "RET_20D": q(C, "c20") + "-1", "RET_60D": q(C, "c60") + "-1",
    "REV_1D": f"-({q(C, 'c1')}-1)",
    "MA_DEV_5D": q(C, "ma5") + "-1", "MA_DEV_20D": q(C, "ma20") + "-1", "MA_DEV_60D": q(C, "ma60") + "-1",
    "CLOSE_POS_20D": q(f"{C}-lo20", "(hi20-lo20)"), "CLOSE_POS_60D": q(f"{C}-lo60", "(hi60-lo60)"),
    "DIST_HIGH_20D": q(C, "hi20") + "-1", "DIST_LOW_20D": q(C, "lo20") + "-1",
    "DIST_HIGH_60D": q(C, "hi60") + "-1", "DIST_LOW_60D": q(C, "lo60") + "-1",
}


def d1_query(names: list[str]) -> str:
    fields = ", ".join(r(D1[n.removeprefix("D1_")], n) for n in names)
    return cte(DAILY, adjusted("daily"), lookback()) + f"SELECT Code, Date, {fields} FROM look"


# ---- bars of minutes ------------------------------------------------------------------------------------------
SLOT_CASE = (
    "CASE WHEN Minute BETWEEN 930 AND 1000 THEN 1 WHEN Minute BETWEEN 1001 AND 1030 THEN 2 "
    "WHEN Minute BETWEEN 1031 AND 1100 THEN 3 WHEN Minute BETWEEN 1101 AND 1130 THEN 4 "
    "WHEN Minute BETWEEN 1301 AND 1330 THEN 5 WHEN Minute BETWEEN 1331 AND 1400 THEN 6 "
    "WHEN Minute BETWEEN 1401 AND 1430 THEN 7 WHEN Minute BETWEEN 1431 AND 1500 THEN 8 END"
)


def corr(x: str, y: str) -> str:
    m = f"FILTER (WHERE isfinite({x}) AND isfinite({y}))"
    n, sx, sy = f"count(*) {m}", f"sum({x}) {m}", f"sum({y}) {m}"
    num = f"{n}*(sum({x}*{y}) {m})-{sx}*{sy}"
    dx, dy = f"({n}*(sum({x}*{x}) {m})-({sx})*({sx}))", f"({n}*(sum({y}*{y}) {m})-({sy})*({sy}))"
    return f"CASE WHEN {n} >= 2 AND {dx}*{dy} > 0 THEN {q(num, f'sqrt({dx}*{dy})')} END"


def bars(source: str, keys: str, prefix: str = "") -> str:
    """Row returns, then one bar per key: tables <prefix>rows and <prefix>bars."""
    w = f"(PARTITION BY {keys})"
    return f"""
{prefix}r0 AS (
  SELECT *, close / lag(close) OVER (PARTITION BY {keys} ORDER BY Minute) - 1 AS ret,
         sum(amt) OVER {w} AS bamt, sum(vol) OVER {w} AS bvol,
         first_value(open) OVER (PARTITION BY {keys} ORDER BY Minute) AS bopen FROM {source}),
{prefix}rows AS (
  SELECT *, abs(ret) AS absret, {q('close', q('bamt', 'bvol'))} - 1 AS dev, {q('close', 'bopen')} - 1 AS devo FROM {prefix}r0),
{prefix}bars AS (
  SELECT {keys}, arg_min(open, Minute) AS o, arg_max(close, Minute) AS c, max(high) AS h, min(low) AS l,
    sum(vol) AS vol, sum(amt) AS amt, {q('sum(amt)', 'sum(vol)')} AS vw,
    arg_min(vol, Minute) AS vf, arg_max(vol, Minute) AS vl, avg(vol) AS vm,
    arg_min(amt, Minute) AS af, arg_max(amt, Minute) AS al, avg(amt) AS am,
    count(ret) AS rn, stddev_samp(ret) AS rsd, coalesce(sum(ret*ret), 0) AS rsq, avg(absret) AS rabs,
    max(ret) AS rmax, min(ret) AS rmin,
    count(*) FILTER (WHERE ret > 0) AS un, count(*) FILTER (WHERE ret < 0) AS dn, count(*) FILTER (WHERE ret = 0) AS fn,
    coalesce(sum(vol) FILTER (WHERE ret > 0), 0) AS uv, coalesce(sum(vol) FILTER (WHERE ret < 0), 0) AS dv,
    coalesce(sum(amt) FILTER (WHERE ret > 0), 0) AS ua, coalesce(sum(amt) FILTER (WHERE ret < 0), 0) AS da,
    avg(dev) AS dmean, avg(abs(dev)) AS dabs, stddev_samp(dev) AS dsd, max(devo) AS domax, min(devo) AS domin,
    {corr('ret', 'vol')} AS crv, {corr('ret', 'amt')} AS cra, {corr('absret', 'vol')} AS cav,
    {corr('absret', 'amt')} AS caa, {corr('dev', 'vol')} AS cdv, {corr('dev', 'amt')} AS cda,
    max(close) FILTER (WHERE Minute = 930) AS ap, max(vol) FILTER (WHERE Minute = 930) AS av, max(amt) FILTER (WHERE Minute = 930) AS aa
  FROM {prefix}rows GROUP BY {keys})"""


SLOTTED = f"slotted AS (SELECT * FROM (SELECT *, amount * adj_factor AS amt, {SLOT_CASE} AS slot FROM minutes) WHERE slot IS NOT NULL)"
RUNNING = """
run AS (
  SELECT *, lag(c) OVER w AS pc, lag(vw) OVER w AS pvw, lag(vol) OVER w AS pvol, lag(amt) OVER w AS pamt,
         max(h) OVER w AS ch, min(l) OVER w AS cl, first_value(o) OVER w AS fo, sum(amt) OVER w AS camt, sum(vol) OVER w AS cvol
  FROM bars WINDOW w AS (PARTITION BY Code, Date ORDER BY slot))"""
SLOT_CHAIN = (MINUTES, SLOTTED, bars("slotted", "Code, Date, slot"), RUNNING)
REFERENCED = """
x AS (SELECT run.*, a.close_adj AS rc, a.volume_shares AS rv, a.amount_adj AS ra,
             CASE WHEN slot = 1 THEN a.pre_close_adj ELSE pc END AS prevc
      FROM run JOIN iadj a USING (Code, Date))"""
M30_CHAIN = (*SLOT_CHAIN, INTRADAY, adjusted("intraday", "iadj"), REFERENCED)

SHAPE = {
    "RET_OC": q("c", "o") + "-1", "RANGE_OPEN": q("h-l", "o"), "BODY": q("c-o", "o"), "ABS_BODY": q("abs(c-o)", "o"),
    "UPPER_SHADOW": q("greatest(h-greatest(o,c),0)", "o"), "LOWER_SHADOW": q("greatest(least(o,c)-l,0)", "o"),
    "BODY_RANGE_RATIO": q("abs(c-o)", "(h-l)"), "CLOSE_POS": q("c-l", "(h-l)"), "VWAP_POS": q("vw-l", "(h-l)"),
    "CLOSE_VWAP": q("c", "vw") + "-1", "OPEN_VWAP": q("o", "vw") + "-1", "HIGH_VWAP": q("h", "vw") + "-1",
    "LOW_VWAP": q("l", "vw") + "-1", "VWAP_OPEN": q("vw", "o") + "-1",
}
FLOW = {
    "UP_VOL_RATIO": q("uv", "vol"), "DOWN_VOL_RATIO": q("dv", "vol"), "NET_UP_VOL_RATIO": q("uv-dv", "vol"),
    "UP_AMT_RATIO": q("ua", "amt"), "DOWN_AMT_RATIO": q("da", "amt"), "NET_UP_AMT_RATIO": q("ua-da", "amt"),
}
PATH = {
    "REALIZED_VOL": "sqrt(rsq)", "ABS_MIN_RET_MEAN": "rabs", "MAX_MIN_RET": "rmax", "MIN_MIN_RET": "rmin",
    "UP_MIN_RATIO": q("un", "rn"), "DOWN_MIN_RATIO": q("dn", "rn"), "FLAT_MIN_RATIO": q("fn", "rn"),
    "PRICE_DEV_VWAP_MEAN": "dmean", "PRICE_DEV_VWAP_ABS_MEAN": "dabs", "PRICE_DEV_VWAP_STD": "dsd",
    "PRICE_MAX_DEV_OPEN": "domax", "PRICE_MIN_DEV_OPEN": "domin", "PRICE_DEV_RANGE_OPEN": "domax-domin",
    "RET_VOL_CORR": "crv", "RET_AMT_CORR": "cra", "ABSRET_VOL_CORR": "cav", "ABSRET_AMT_CORR": "caa",
    "PRICEDEV_VOL_CORR": "cdv", "PRICEDEV_AMT_CORR": "cda",
}
REF = {
    "OPEN": q("o", "rc"), "CLOSE": q("c", "rc"), "HIGH": q("h", "rc"), "LOW": q("l", "rc"), "VWAP": q("vw", "rc"),
    "VOLUME_FIRST": q("vf", "rv"), "VOLUME_LAST": q("vl", "rv"), "VOLUME_MEAN": q("vm", "rv"),
    "AMOUNT_FIRST": q("af", "ra"), "AMOUNT_LAST": q("al", "ra"), "AMOUNT_MEAN": q("am", "ra"),
}
_SA, _SV = q("amt", "ra"), q("vol", "rv")
M30 = REF | SHAPE | FLOW | PATH | {
    "VOL_SHARE": _SV, "AMT_SHARE": _SA, "RET_CC": q("c", "prevc") + "-1", "GAP": q("o", "prevc") + "-1",
    "RET_VWAP": q("vw", "pvw") + "-1", "VOL_CHG": q("vol", "pvol") + "-1", "AMT_CHG": q("amt", "pamt") + "-1",
    "RET_PER_AMT": q(f"{q('c', 'o')}-1", _SA), "RET_PER_VOL": q(f"{q('c', 'o')}-1", _SV),
    "ABS_RET_PER_AMT": q(f"abs({q('c', 'o')}-1)", _SA), "ABS_RET_PER_VOL": q(f"abs({q('c', 'o')}-1)", _SV),
    "RANGE_PER_AMT": q(q("h-l", "o"), _SA), "RANGE_PER_VOL": q(q("h-l", "o"), _SV),
    "MIN_RET_STD": "rsd", "CUM_RET": q("c", "fo") + "-1", "CUM_VWAP": q(q("camt", "cvol"), "rc"),
    "CLOSE_CUM_VWAP": q("c", q("camt", "cvol")) + "-1", "CUM_CLOSE_POS": q("c-cl", "(ch-cl)"),
    "DIST_TO_CUM_HIGH": q("c", "ch") + "-1", "DIST_TO_CUM_LOW": q("c", "cl") + "-1",
}
EO = REF | SHAPE | FLOW | PATH | {
    "RET_PREV_CLOSE": q("c", "rc") + "-1", "VWAP_PREV_CLOSE": q("vw", "rc") + "-1",
    "AUCTION_RET_PREV_CLOSE": q("ap", "rc") + "-1", "VOL_SHARE_PREV_DAY": _SV, "AMT_SHARE_PREV_DAY": _SA,
    "AUCTION_VOL_SHARE": q("av", "vol"), "AUCTION_AMT_SHARE": q("aa", "amt"), "AUCTION_PRICE_DEV_VWAP": q("ap", "vw") + "-1",
}


def slot_query(fields: dict[str, str], chain=SLOT_CHAIN, source: str = "run") -> str:
    return cte(*chain) + f"SELECT Code, Date, slot, {', '.join(r(x, n) for n, x in fields.items())} FROM {source}"


def m30_query(names: list[str]) -> str:
    return slot_query({n: M30[n] for n in names}, M30_CHAIN, "x")


def m30_long() -> str:
    return "f AS (SELECT Code, Date, slot, " + ", ".join(f"{x} AS {n}" for n, x in M30.items()) + " FROM x)"


def m30_wide(names: list[str]) -> str:
    cols = [f"max({n}) FILTER (WHERE slot = {s}) AS M30_{n}_{s}" for n in names for s in range(1, 9)]
    return f"wide AS (SELECT Code, Date, {', '.join(cols)} FROM f GROUP BY Code, Date)"


CALENDAR = """
days AS (SELECT Date, row_number() OVER (ORDER BY Date) AS session, lead(Date) OVER (ORDER BY Date) AS entry_date,
                lead(Date, 2) OVER (ORDER BY Date) AS exit_date FROM (SELECT DISTINCT Date FROM {source}))"""
EARLY = "opening AS (SELECT *, amount * adj_factor AS amt FROM minutes WHERE Minute IN (930, 931))"
EO_CHAIN = (EARLY, bars("opening", "Code, Date", "e"), CALENDAR.format(source="minutes"), """
eo AS (SELECT b.* EXCLUDE (Date), d.Date AS Date, a.close_adj AS rc, a.volume_shares AS rv, a.amount_adj AS ra
       FROM ebars b JOIN days d ON d.entry_date = b.Date LEFT JOIN iadj a ON a.Code = b.Code AND a.Date = d.Date)""")


def early_query() -> str:
    return cte(MINUTES, INTRADAY, adjusted("intraday", "iadj"), *EO_CHAIN) + (
        f"SELECT Code, Date, {', '.join(rf(EO[n], 'EO_' + n) for n in EO)} FROM eo"
    )


def raw_chain(protocol: str, m30_names: list[str], d1_names: list[str], eo_names: list[str]) -> tuple[str, ...]:
    """CTEs ending in ``raw`` with unrounded FLOAT features."""
    def narrow(x: str, name: str) -> str:
        return f"CASE WHEN isfinite(({x})::DOUBLE) THEN ({x})::FLOAT END AS {name}"

    cols = [narrow(f"M30_{n}_{s}", f"M30_{n}_{s}") for n in m30_names for s in range(1, 9)]
    cols += [narrow(D1[n], f"D1_{n}") for n in d1_names]
    parts = [*M30_CHAIN, m30_long(), m30_wide(m30_names), lookback("iadj")]
    join = "FROM wide JOIN look USING (Code, Date)"
    if protocol == "de":
        parts += [*EO_CHAIN, "ef AS (SELECT Code, Date, " + ", ".join(narrow(EO[n], f"EO_{n}") for n in eo_names) + " FROM eo)"]
        cols += [f"EO_{n}" for n in eo_names]
        join += " LEFT JOIN ef USING (Code, Date)"
    return (*parts, f"raw AS (SELECT Code, Date, {', '.join(cols)} {join})")


def raw_query(protocol: str, columns: list[str], *names: list[str]) -> str:
    return cte(*raw_chain(protocol, *names)) + f"SELECT Code, Date, {', '.join(r(c, c) for c in columns)} FROM raw"


# ---- normalisation --------------------------------------------------------------------------------------------
def normalised(source: str, columns: list[str]) -> tuple[str, ...]:
    """Long z-scores: table ``z(Code, Date, feature, z)``; single-precision median, MAD and clip bounds."""
    half = "CAST(0.5 AS FLOAT)"
    med = f"((quantile_disc({{x}}, 0.5) - quantile_disc(-({{x}}), 0.5))::FLOAT * {half})::FLOAT"
    w = "OVER (PARTITION BY Date, feature)"
    return (
        f"cells AS (SELECT Code, Date, feature, v::FLOAT AS v FROM "
        f"(SELECT Code, Date, {', '.join(columns)} FROM {source}) UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(columns)})))",
        f"n1 AS (SELECT Date, feature, {med.format(x='v')} AS md, count(*) AS nr, count(v) AS nv FROM cells GROUP BY Date, feature)",
        "n2 AS (SELECT cells.*, md, nr, nv, abs((v - md)::FLOAT)::FLOAT AS ad FROM cells JOIN n1 USING (Date, feature))",
        f"n3 AS (SELECT Date, feature, (CAST(3.0 * 1.4826 AS FLOAT) * {med.format(x='ad')})::FLOAT AS width FROM n2 GROUP BY Date, feature)",
        "n4 AS (SELECT Code, Date, feature, nr, nv, width, CASE WHEN v IS NOT NULL THEN greatest((md - width)::FLOAT, least((md + width)::FLOAT, v))::DOUBLE END AS cv "
        "FROM n2 JOIN n3 USING (Date, feature))",
        f"n5 AS (SELECT *, avg(cv) {w} AS mu FROM n4)",
        f"n6 AS (SELECT *, sqrt(sum((cv - mu) * (cv - mu)) {w} / greatest(nr - 1, 1)) AS sd FROM n5)",
        "z AS (SELECT Code, Date, feature, coalesce(CASE WHEN nv >= 10 AND width > 0 AND sd > 0 THEN ((cv - mu) / sd)::FLOAT END, 0)::DOUBLE AS z FROM n6)",
    )


def normalised_query(chain: tuple[str, ...], source: str, columns: list[str], outputs: list[str] | None = None) -> str:
    outputs = outputs if outputs is not None else columns
    cols = [f"round(max(z) FILTER (WHERE feature = '{c}'), {DP}) AS {c}_mad3_zscore" for c in outputs]
    return cte(*chain, *normalised(source, columns)) + f"SELECT Code, Date, {', '.join(cols)} FROM z GROUP BY Code, Date"


# ---- labels ---------------------------------------------------------------------------------------------------
LABEL_MINUTES = {"o2o": ("930, 931, 932, 933, 934, 935",) * 2, "de": ("933, 934, 935", "930, 931, 932, 933, 934, 935")}
LABEL_NAMES = {"o2o": "oto_d1_open6_to_open6", "de": "oto_gap_d1_open3_to_open6"}


def vwap(name: str, minutes: str) -> str:
    return (
        f"{name} AS (SELECT Code, Date, {q('10*sum(amount*adj_factor)', 'sum(vol)')} AS v FROM minutes "
        f"WHERE Minute IN ({minutes}) GROUP BY Code, Date)"
    )


def returns_chain(protocol: str) -> tuple[str, ...]:
    entry, exit_ = LABEL_MINUTES[protocol]
    return (
        MINUTES, CALENDAR.format(source="minutes"), vwap("ev", entry), vwap("xv", exit_),
        f"ret AS (SELECT ev.Code, d.Date, ({q('xv.v', 'ev.v')} - 1)::FLOAT AS raw FROM days d JOIN ev ON ev.Date = d.entry_date "
        "JOIN xv ON xv.Date = d.exit_date AND xv.Code = ev.Code)",
    )


ZSCORE = "CASE WHEN {x} IS NOT NULL AND count({x}) OVER (PARTITION BY Date) >= 2 AND stddev_samp({x}) OVER (PARTITION BY Date) > 0 " \
         "THEN (({x} - avg({x}) OVER (PARTITION BY Date)) / stddev_samp({x}) OVER (PARTITION BY Date))::FLOAT END"


def label_query(protocol: str) -> str:
    name = LABEL_NAMES[protocol]
    return cte(*returns_chain(protocol)) + (
        f"SELECT Code, Date, {r('raw', name)}, {r(ZSCORE.format(x='raw::DOUBLE'), name + '_zscore')} FROM ret"
    )


# ---- score panels ---------------------------------------------------------------------------------------------
SCORES = {
    "lgb": f"-({q(C, 'c5')}-1)", "xgb": f"-({q(C, 'c1')}-1)", "mlp": f"{q(C, 'ma5')}-1", "kan": f"{q(C, V)}-1",
    "gru": f"{q(C, 'hi20')}-1", "tcn": f"{q(f'{C}-{L}', f'({H}-{L})')}-0.5", "transformer": f"{q(O, 'c1')}-1",
    "mamba": f"{q('volume_shares', 'pvol')}-1",
}
MODELS = tuple(SCORES)


def noise(index: int) -> str:
    return f"((CAST(Code AS INT) * {37 + index} + Date * {11 + 2 * index}) % 1009 - 504) * 1e-7"


def scores_chain() -> tuple[str, ...]:
    cols = ", ".join(f"coalesce({x}, 0) + {noise(i)} AS {m}" for i, (m, x) in enumerate(SCORES.items()))
    return (
        DAILY, adjusted("daily"), lookback(),
        f"scores AS (SELECT Code, Date, {cols}, "
        f"{q(f'lead({C}) OVER (PARTITION BY Code ORDER BY Date)', C)} - 1 AS ret FROM look)",
        "sw AS (SELECT * FROM scores)",
        "sl AS (SELECT Code, Date, model, score, ret FROM (SELECT Code, Date, ret, " + ", ".join(MODELS) + " FROM sw) "
        "UNPIVOT (score FOR model IN (" + ", ".join(MODELS) + ")))",
    )


GRID_PARTS = """
elig AS (SELECT model, Date, Code, 'signed' AS mode, sign(score) AS pos, abs(score) AS strength, ret FROM {src} WHERE score <> 0
         UNION ALL SELECT model, Date, Code, 'long_only', 1, score, ret FROM {src} WHERE score > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model, Date, mode ORDER BY strength DESC, Code) AS place,
                  count(*) OVER (PARTITION BY model, Date, mode) AS n FROM elig),
qs AS (SELECT * FROM (VALUES (1.0::DOUBLE), (0.75), (0.5), (0.25)) t(quantile)),
frame AS (SELECT DISTINCT model, Date, mode, quantile FROM {src}, (VALUES ('signed'), ('long_only')) m(mode), qs),
picked AS (SELECT * FROM ranked, qs WHERE place <= ceil(quantile * n)),
grid AS (SELECT f.model, f.Date, f.mode, f.quantile, coalesce(sum(pos * ret), 0) AS pnl, count(p.Code) AS k,
                count(*) FILTER (WHERE pos * ret > 0) AS hits, count(*) FILTER (WHERE ret <> 0) AS moves,
                count(*) FILTER (WHERE pos > 0) AS longs, count(ret) AS obs
         FROM frame f LEFT JOIN picked p ON p.model = f.model AND p.Date = f.Date AND p.mode = f.mode AND p.quantile = f.quantile
         GROUP BY f.model, f.Date, f.mode, f.quantile)"""


def grid_chain(source: str = "sl") -> tuple[str, ...]:
    return (*scores_chain(), GRID_PARTS.format(src=source))


SUMMARY = (
    "round(sum(pnl), 6) AS pnl, sum(k)::DOUBLE AS notional, round(CASE WHEN sum(k) > 0 THEN sum(pnl) / sum(k) ELSE 0 END, 6) AS ppd, "
    "round(CASE WHEN stddev_samp(pnl) > 0 AND sum(k) > 0 THEN sqrt(252.0::DOUBLE) * avg(pnl) / stddev_samp(pnl) ELSE 0 END, 6) AS sharpe_ratio, "
    "round(CASE WHEN sum(moves) > 0 THEN sum(hits) / sum(moves)::DOUBLE ELSE 0 END, 6) AS hit_ratio, "
    "round(CASE WHEN sum(k) > 0 THEN sum(longs) / sum(k)::DOUBLE ELSE 0 END, 6) AS long_share, round(avg(k), 6) AS nr_instr, "
    "sum(k)::BIGINT AS nr_trades, count(*) AS n_days, count(*) FILTER (WHERE k = 0) AS cash_days"
)
RANKED = (
    "ranks AS (SELECT model, Date, Code, score, ret, rank() OVER (PARTITION BY model, Date ORDER BY score) + "
    "(count(*) OVER (PARTITION BY model, Date, score) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY model, Date) AS n FROM sl QUALIFY n >= 2)"
)
IC = (
    "pairs AS (SELECT model, Date, score AS s, ret AS r FROM sl WHERE ret IS NOT NULL)",
    "pr AS (SELECT *, rank() OVER (PARTITION BY model, Date ORDER BY s) + (count(*) OVER (PARTITION BY model, Date, s) - 1) / 2.0::DOUBLE AS sr, "
    "rank() OVER (PARTITION BY model, Date ORDER BY r) + (count(*) OVER (PARTITION BY model, Date, r) - 1) / 2.0::DOUBLE AS rr FROM pairs)",
    "icd AS (SELECT a.model, a.Date, coalesce(CASE WHEN n >= 2 AND smin < smax AND rmin < rmax THEN p END, 0) AS ic, "
    "coalesce(CASE WHEN n >= 2 AND smin < smax AND rmin < rmax THEN pk END, 0) AS rank_ic "
    "FROM (SELECT DISTINCT model, Date FROM sl) a LEFT JOIN (SELECT model, Date, count(*) AS n, min(s) AS smin, max(s) AS smax, "
    "min(r) AS rmin, max(r) AS rmax, CASE WHEN stddev_pop(s) > 0 AND stddev_pop(r) > 0 THEN covar_pop(s, r) / (stddev_pop(s) * stddev_pop(r)) END AS p, "
    "CASE WHEN stddev_pop(sr) > 0 AND stddev_pop(rr) > 0 THEN covar_pop(sr, rr) / (stddev_pop(sr) * stddev_pop(rr)) END AS pk "
    "FROM pr GROUP BY model, Date) b USING (model, Date))",
)

# ---- splits and universe --------------------------------------------------------------------------------------
ROLES = """
folds AS (SELECT * FROM (VALUES ('F1','train',1995,1998),('F1','validation',1999,1999),('F1','test',2000,2000),
  ('F2','train',1996,1999),('F2','validation',2000,2000),('F2','test',2001,2001)) t(fold_id, split, lo, hi)),
roles AS (SELECT fold_id, split, Date AS signal_date, entry_date, exit_date,
  row_number() OVER (PARTITION BY fold_id, split ORDER BY Date DESC) <= 3 AS purged
  FROM days JOIN folds ON Date // 10000 BETWEEN lo AND hi WHERE exit_date IS NOT NULL)"""


def flag(m: int, k: int, name: str) -> str:
    seed = "(CAST(Code AS INT) + Date)"
    return f"CASE WHEN {seed} % {k} <> 0 THEN {seed} % {m} = 0 END AS {name}"


def eligible_chain(source: str) -> tuple[str, ...]:
    return (
        f"flags AS (SELECT Code, Date, {flag(17, 101, 'st')}, {flag(19, 103, 'up')}, {flag(23, 107, 'dn')} FROM {source})",
        "eligible AS (SELECT f.Code, d.Date FROM flags f JOIN days d ON d.entry_date = f.Date "
        "WHERE left(f.Code, 1) IN ('0', '3', '6') AND NOT coalesce(st, TRUE) AND NOT coalesce(up, TRUE) AND NOT coalesce(dn, TRUE))",
    )


def history_chain(source: str, length: int = 10) -> tuple[str, ...]:
    return (
        f"runs AS (SELECT k.Code, k.Date, session - lag(session, {length - 1}) OVER (PARTITION BY Code ORDER BY k.Date) AS span "
        f"FROM {source} k JOIN days USING (Date))",
        f"history AS (SELECT Code, Date FROM runs WHERE span = {length - 1})",
    )


# The daily model panel: two features, the next-but-one forward return as label.
PANEL_FEATURES = ["D1_RET_OC", "D1_CLOSE_VWAP", "D1_RET_5D", "D1_MA_DEV_5D", "D1_CLOSE_POS_20D"]


def panel_chain() -> tuple[str, ...]:
    feats = ", ".join(f"({D1[n.removeprefix('D1_')]})::FLOAT AS {n}" for n in PANEL_FEATURES)
    return (
        DAILY, adjusted("daily"), lookback(), CALENDAR.format(source="daily"),
        f"feats AS (SELECT Code, Date, {feats} FROM look)",
        f"outc AS (SELECT e.Code, d.Date, ({q('x.close_adj', 'e.close_adj')} - 1)::FLOAT AS raw FROM days d "
        "JOIN adj e ON e.Date = d.entry_date JOIN adj x ON x.Date = d.exit_date AND x.Code = e.Code)",
        *eligible_chain("daily"), *history_chain("feats", 3),
        "pj AS (SELECT f.*, o.raw, (e.Code IS NOT NULL AND h.Code IS NOT NULL) AS is_eligible FROM feats f "
        "LEFT JOIN outc o USING (Code, Date) LEFT JOIN eligible e USING (Code, Date) LEFT JOIN history h USING (Code, Date))",
        "pk AS (SELECT *, CASE WHEN is_eligible THEN raw::DOUBLE END AS er FROM pj)",
        f"panel AS (SELECT *, {ZSCORE.format(x='er')} AS target FROM pk)",
    )


PANEL_COLUMNS = ", ".join(
    [f"round(coalesce({n}, 0)::DOUBLE, 5) AS {n}" for n in PANEL_FEATURES]
    + ["round(target::DOUBLE, 5) AS target", "round(raw::DOUBLE, 5) AS raw_return", "is_eligible", "(is_eligible AND target IS NOT NULL) AS is_scoreable"]
)
