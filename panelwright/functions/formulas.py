"""Missing-aware arithmetic as SQL text.

The wide feature families have hundreds of fields.  As text each field is one
parse on the JVM side instead of dozens of client calls, and it reads like the
formula it stands for.  Semantics equal those of :mod:`.safe`.
"""

from __future__ import annotations

INF = "double('inf')"


def finite(x: str) -> str:
    return f"CASE WHEN abs({x}) < {INF} THEN {x} END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN abs({a}) < {INF} AND abs({b}) < {INF} AND abs({b}) > 1e-12D THEN ({a}) / ({b}) END"


def change(a: str, b: str) -> str:
    return f"{ratio(a, b)} - 1D"


def both_max(a: str, b: str) -> str:
    return f"CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN greatest({a}, {b}) END"


def both_min(a: str, b: str) -> str:
    return f"CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL THEN least({a}, {b}) END"


def candle(o: str, h: str, low: str, c: str, vwap: str) -> dict[str, str]:
    """Measures of one bar's own prices."""
    height, body = f"({h} - {low})", f"({c} - {o})"
    return {
        "RANGE_OPEN": ratio(height, o),
        "BODY": ratio(body, o),
        "ABS_BODY": ratio(f"abs({body})", o),
        "UPPER_SHADOW": ratio(both_max(f"({h} - {both_max(o, c)})", "0D"), o),
        "LOWER_SHADOW": ratio(both_max(f"({both_min(o, c)} - {low})", "0D"), o),
        "BODY_RANGE_RATIO": ratio(f"abs({body})", height),
        "CLOSE_POS": ratio(f"({c} - {low})", height),
        "VWAP_POS": ratio(f"({vwap} - {low})", height),
        "RET_OC": change(c, o),
        "CLOSE_VWAP": change(c, vwap),
        "OPEN_VWAP": change(o, vwap),
        "HIGH_VWAP": change(h, vwap),
        "LOW_VWAP": change(low, vwap),
        "VWAP_OPEN": change(vwap, o),
    }


def against_reference(close: str, volume: str, amount: str) -> dict[str, str]:
    """Bar prices, volumes and amounts relative to a reference day."""
    fields = {name: ratio(name, close) for name in ("OPEN", "CLOSE", "HIGH", "LOW", "VWAP")}
    for part in ("FIRST", "LAST", "MEAN"):
        fields[f"VOLUME_{part}"] = ratio(f"VOLUME_{part}", volume)
        fields[f"AMOUNT_{part}"] = ratio(f"AMOUNT_{part}", amount)
    return fields


def order_flow() -> dict[str, str]:
    """Volume and amount on rising and falling minutes, as shares of the bar."""
    fields = {}
    for short, whole in (("VOL", "VOLUME"), ("AMT", "AMOUNT")):
        fields[f"UP_{short}_RATIO"] = ratio(f"UP_{short}", whole)
        fields[f"DOWN_{short}_RATIO"] = ratio(f"DOWN_{short}", whole)
        fields[f"NET_UP_{short}_RATIO"] = ratio(f"(UP_{short} - DOWN_{short})", whole)
    return fields


def minute_path() -> dict[str, str]:
    """Minute-return, deviation and correlation measures of a bar."""
    fields = {
        "MIN_RET_STD": "RET_STD",
        "REALIZED_VOL": "sqrt(RET_SQUARES)",
        "ABS_MIN_RET_MEAN": "RET_ABS_MEAN",
        "MAX_MIN_RET": "RET_MAX",
        "MIN_MIN_RET": "RET_MIN",
        "PRICE_DEV_VWAP_MEAN": "DEV_MEAN",
        "PRICE_DEV_VWAP_ABS_MEAN": "DEV_ABS_MEAN",
        "PRICE_DEV_VWAP_STD": "DEV_STD",
        "PRICE_MAX_DEV_OPEN": "DEV_MAX_OPEN",
        "PRICE_MIN_DEV_OPEN": "DEV_MIN_OPEN",
        "PRICE_DEV_RANGE_OPEN": "DEV_MAX_OPEN - DEV_MIN_OPEN",
    }
    fields |= {f"{side}_MIN_RATIO": ratio(f"{side}_N", "RET_N") for side in ("UP", "DOWN", "FLAT")}
    return fields | {f"{x}_{y}_CORR": f"{x}_{y}_CORR" for x in ("RET", "ABSRET", "PRICEDEV") for y in ("VOL", "AMT")}


def half_hour() -> dict[str, str]:
    """Half-hour fields over slot bars joined to their reference day (own columns only)."""
    previous = "CASE WHEN slot = 1 THEN ref_pre_close ELSE PREV_CLOSE END"
    fields = candle("OPEN", "HIGH", "LOW", "CLOSE", "VWAP")
    fields |= against_reference("ref_close", "ref_volume", "ref_amount") | order_flow() | minute_path()
    return fields | {
        "VOL_SHARE": ratio("VOLUME", "ref_volume"),
        "AMT_SHARE": ratio("AMOUNT", "ref_amount"),
        "RET_CC": change("CLOSE", f"({previous})"),
        "GAP": change("OPEN", f"({previous})"),
        "RET_VWAP": change("VWAP", "PREV_VWAP"),
        "VOL_CHG": change("VOLUME", "PREV_VOLUME"),
        "AMT_CHG": change("AMOUNT", "PREV_AMOUNT"),
        "CUM_RET": change("CLOSE", "FIRST_OPEN"),
        "CUM_VWAP": ratio("CUM_VWAP", "ref_close"),
        "CLOSE_CUM_VWAP": change("CLOSE", "CUM_VWAP"),
        "CUM_CLOSE_POS": ratio("(CLOSE - CUM_LOW)", "(CUM_HIGH - CUM_LOW)"),
        "DIST_TO_CUM_HIGH": change("CLOSE", "CUM_HIGH"),
        "DIST_TO_CUM_LOW": change("CLOSE", "CUM_LOW"),
    }


def per_share() -> dict[str, str]:
    """Half-hour fields that divide other fields; they read columns of the layer below."""
    fields = {}
    for name in ("VOL", "AMT"):
        fields[f"RET_PER_{name}"] = ratio("RET_OC", f"{name}_SHARE")
        fields[f"ABS_RET_PER_{name}"] = ratio("abs(RET_OC)", f"{name}_SHARE")
        fields[f"RANGE_PER_{name}"] = ratio("RANGE_OPEN", f"{name}_SHARE")
    return fields


def early_open() -> dict[str, str]:
    """Early-open fields over two-minute bars joined to the signal day."""
    fields = candle("OPEN", "HIGH", "LOW", "CLOSE", "VWAP")
    fields |= against_reference("ref_close", "ref_volume", "ref_amount") | order_flow() | minute_path()
    return fields | {
        "RET_PREV_CLOSE": change("CLOSE", "ref_close"),
        "VWAP_PREV_CLOSE": change("VWAP", "ref_close"),
        "AUCTION_RET_PREV_CLOSE": change("AUCTION_PRICE", "ref_close"),
        "VOL_SHARE_PREV_DAY": ratio("VOLUME", "ref_volume"),
        "AMT_SHARE_PREV_DAY": ratio("AMOUNT", "ref_amount"),
        "AUCTION_VOL_SHARE": ratio("AUCTION_VOL", "VOLUME"),
        "AUCTION_AMT_SHARE": ratio("AUCTION_AMT", "AMOUNT"),
        "AUCTION_PRICE_DEV_VWAP": change("AUCTION_PRICE", "VWAP"),
    }


def daily() -> dict[str, str]:
    """Daily fields over the adjusted panel with its look-back columns (see ``daily_lookbacks``)."""
    fields = candle("open_adj", "high_adj", "low_adj", "close_adj", "vwap_adj")
    fields |= {
        f"{name}_REL_CLOSE": ratio(f"{name.lower()}_adj", "close_adj") for name in ("OPEN", "HIGH", "LOW", "VWAP")
    }
    fields |= {
        "RET_CC_1D": change("close_adj", "close_lag1"),
        "REV_1D": f"-({change('close_adj', 'close_lag1')})",
        "GAP": change("open_adj", "close_lag1"),
        "RET_VWAP_1D": change("vwap_adj", "vwap_lag1"),
        "LOG_VOLUME": "log1p(volume_shares)",
        "LOG_AMOUNT": "log1p(amount_adj)",
        "VOL_CHG_1D": change("volume_shares", "volume_lag1"),
        "AMT_CHG_1D": change("amount_adj", "amount_lag1"),
        "VWAP_AMOUNT_INTENSITY": ratio("amount_adj", "abs(close_adj - open_adj)"),
        "RET_PER_AMOUNT": ratio(f"({fields['RET_OC']})", "log1p(amount_adj)"),
        "RANGE_PER_AMOUNT": ratio(f"({fields['RANGE_OPEN']})", "log1p(amount_adj)"),
    }
    fields |= {f"RET_{n}D": change("close_adj", f"close_lag{n}") for n in (5, 10, 20, 60)}
    fields |= {f"MA_DEV_{n}D": change("close_adj", f"(close_sum{n} / {n})") for n in (5, 20, 60)}
    for n in (20, 60):
        fields[f"CLOSE_POS_{n}D"] = ratio(f"(close_adj - low_min{n})", f"(high_max{n} - low_min{n})")
        fields[f"DIST_HIGH_{n}D"] = change("close_adj", f"high_max{n}")
        fields[f"DIST_LOW_{n}D"] = change("close_adj", f"low_min{n}")
    return fields
