"""Feature registry: ordered names, protocols, and the retained-feature manifests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

# The ordered field names of the three feature families.
HALF_HOUR_FIELDS = (
    "OPEN", "CLOSE", "HIGH", "LOW", "VWAP",
    "VOLUME_FIRST", "VOLUME_LAST", "VOLUME_MEAN", "AMOUNT_FIRST", "AMOUNT_LAST", "AMOUNT_MEAN",
    "VOL_SHARE", "AMT_SHARE", "RET_OC", "RET_CC", "GAP", "RET_VWAP", "RANGE_OPEN", "BODY", "ABS_BODY",
    "UPPER_SHADOW", "LOWER_SHADOW", "BODY_RANGE_RATIO", "CLOSE_POS", "VWAP_POS",
    "CLOSE_VWAP", "OPEN_VWAP", "HIGH_VWAP", "LOW_VWAP", "VWAP_OPEN", "VOL_CHG", "AMT_CHG",
    "UP_VOL_RATIO", "DOWN_VOL_RATIO", "NET_UP_VOL_RATIO", "UP_AMT_RATIO", "DOWN_AMT_RATIO", "NET_UP_AMT_RATIO",
    "RET_PER_AMT", "RET_PER_VOL", "ABS_RET_PER_AMT", "ABS_RET_PER_VOL", "RANGE_PER_AMT", "RANGE_PER_VOL",
    "MIN_RET_STD", "REALIZED_VOL", "ABS_MIN_RET_MEAN", "MAX_MIN_RET", "MIN_MIN_RET",
    "UP_MIN_RATIO", "DOWN_MIN_RATIO", "FLAT_MIN_RATIO",
    "CUM_RET", "CUM_VWAP", "CLOSE_CUM_VWAP", "CUM_CLOSE_POS", "DIST_TO_CUM_HIGH", "DIST_TO_CUM_LOW",
    "PRICE_DEV_VWAP_MEAN", "PRICE_DEV_VWAP_ABS_MEAN", "PRICE_DEV_VWAP_STD",
    "PRICE_MAX_DEV_OPEN", "PRICE_MIN_DEV_OPEN", "PRICE_DEV_RANGE_OPEN",
    "RET_VOL_CORR", "RET_AMT_CORR", "ABSRET_VOL_CORR", "ABSRET_AMT_CORR", "PRICEDEV_VOL_CORR", "PRICEDEV_AMT_CORR",
)
DAILY_FIELDS = (
    "OPEN_REL_CLOSE", "HIGH_REL_CLOSE", "LOW_REL_CLOSE", "VWAP_REL_CLOSE",
    "RANGE_OPEN", "BODY", "ABS_BODY", "UPPER_SHADOW", "LOWER_SHADOW", "BODY_RANGE_RATIO", "CLOSE_POS", "VWAP_POS",
    "RET_OC", "RET_CC_1D", "GAP", "RET_VWAP_1D", "CLOSE_VWAP", "OPEN_VWAP", "LOG_VOLUME", "LOG_AMOUNT",
    "VOL_CHG_1D", "AMT_CHG_1D", "VWAP_AMOUNT_INTENSITY", "RET_PER_AMOUNT", "RANGE_PER_AMOUNT",
    "RET_5D", "RET_10D", "RET_20D", "RET_60D", "REV_1D", "MA_DEV_5D", "MA_DEV_20D", "MA_DEV_60D",
    "CLOSE_POS_20D", "CLOSE_POS_60D", "DIST_HIGH_20D", "DIST_LOW_20D", "DIST_HIGH_60D", "DIST_LOW_60D",
)
EARLY_OPEN_FIELDS = (
    "OPEN", "CLOSE", "HIGH", "LOW", "VWAP", "RET_PREV_CLOSE", "VWAP_PREV_CLOSE", "AUCTION_RET_PREV_CLOSE",
    "VOLUME_FIRST", "VOLUME_LAST", "VOLUME_MEAN", "AMOUNT_FIRST", "AMOUNT_LAST", "AMOUNT_MEAN",
    "VOL_SHARE_PREV_DAY", "AMT_SHARE_PREV_DAY", "RET_OC", "RANGE_OPEN", "BODY", "ABS_BODY",
    "UPPER_SHADOW", "LOWER_SHADOW", "BODY_RANGE_RATIO", "CLOSE_POS", "VWAP_POS",
    "CLOSE_VWAP", "OPEN_VWAP", "HIGH_VWAP", "LOW_VWAP", "VWAP_OPEN",
    "UP_VOL_RATIO", "DOWN_VOL_RATIO", "NET_UP_VOL_RATIO", "UP_AMT_RATIO", "DOWN_AMT_RATIO", "NET_UP_AMT_RATIO",
    "REALIZED_VOL", "ABS_MIN_RET_MEAN", "MAX_MIN_RET", "MIN_MIN_RET",
    "UP_MIN_RATIO", "DOWN_MIN_RATIO", "FLAT_MIN_RATIO",
    "PRICE_DEV_VWAP_MEAN", "PRICE_DEV_VWAP_ABS_MEAN", "PRICE_DEV_VWAP_STD",
    "PRICE_MAX_DEV_OPEN", "PRICE_MIN_DEV_OPEN", "PRICE_DEV_RANGE_OPEN",
    "RET_VOL_CORR", "RET_AMT_CORR", "ABSRET_VOL_CORR", "ABSRET_AMT_CORR", "PRICEDEV_VOL_CORR", "PRICEDEV_AMT_CORR",
    "AUCTION_VOL_SHARE", "AUCTION_AMT_SHARE", "AUCTION_PRICE_DEV_VWAP",
)

# Fields the manifests leave out (everything else is retained, in registry order).
DROPPED_HALF_HOUR = ("VOLUME_MEAN", "AMOUNT_MEAN", "BODY")
DROPPED_GAP_SLOTS = (2, 3, 4, 6, 7, 8)
DROPPED_FIRST_SLOT = ("RET_VWAP", "VOL_CHG", "AMT_CHG", "CUM_RET", "CUM_VWAP", "CLOSE_CUM_VWAP", "CUM_CLOSE_POS")
DROPPED_DAILY = ("BODY", "REV_1D")
DROPPED_EARLY_OPEN = (
    "VOLUME_MEAN", "AMOUNT_MEAN", "BODY", "UP_VOL_RATIO", "UP_AMT_RATIO", "ABS_MIN_RET_MEAN", "MIN_MIN_RET",
    "UP_MIN_RATIO", "DOWN_MIN_RATIO", "FLAT_MIN_RATIO", "RET_VOL_CORR", "RET_AMT_CORR",
    "ABSRET_VOL_CORR", "ABSRET_AMT_CORR", "PRICEDEV_VOL_CORR", "PRICEDEV_AMT_CORR",
)

# Score columns, protocols, manifest sizes, normalised suffix, sequence length.
EIGHT_MODELS = ("lgb", "xgb", "mlp", "kan", "gru", "tcn", "transformer", "mamba")
PROTOCOLS = ("o2o", "de")
MANIFEST_SIZES = {"o2o": 560, "de": 602}
NORMALISED_SUFFIX = "mad3_zscore"
SEQUENCE_LENGTH = 10
SLOTS = tuple(range(1, 9))

HALF_HOUR_COLUMNS = tuple(f"M30_{field}_{slot}" for field in HALF_HOUR_FIELDS for slot in SLOTS)
DAILY_COLUMNS = tuple(f"D1_{field}" for field in DAILY_FIELDS)
EARLY_OPEN_COLUMNS = tuple(f"EO_{field}" for field in EARLY_OPEN_FIELDS)


def protocol_key(protocol: str) -> str:
    """Canonical protocol name; anything but o2o / de is an error."""
    key = protocol.strip().lower()
    if key not in PROTOCOLS:
        raise ValueError(f"protocol must be one of {PROTOCOLS}, got {protocol!r}")
    return key


def raw_columns(protocol: str) -> tuple[str, ...]:
    """Ordered raw feature names of a protocol: 599 (o2o) or 657 (de)."""
    base = HALF_HOUR_COLUMNS + DAILY_COLUMNS
    return base + EARLY_OPEN_COLUMNS if protocol_key(protocol) == "de" else base


@dataclass(frozen=True)
class FeatureManifest:
    """Ordered retained features of one protocol."""

    protocol: str
    columns: tuple[str, ...]

    def __post_init__(self) -> None:
        size = MANIFEST_SIZES[self.protocol]
        if len(self.columns) != size:
            raise ValueError(f"{self.protocol} manifest needs {size} features, got {len(self.columns)}")
        if any(not name for name in self.columns):
            raise ValueError("manifest has a blank feature name")
        if len(set(self.columns)) != size:
            raise ValueError("manifest repeats a feature name")


def _retained(protocol: str) -> list[str]:
    kept = []
    for field in HALF_HOUR_FIELDS:
        for slot in SLOTS:
            dropped = (
                field in DROPPED_HALF_HOUR
                or (field == "GAP" and slot in DROPPED_GAP_SLOTS)
                or (field in DROPPED_FIRST_SLOT and slot == 1)
            )
            if not dropped:
                kept.append(f"M30_{field}_{slot}")
    kept += [f"D1_{field}" for field in DAILY_FIELDS if field not in DROPPED_DAILY]
    if protocol == "de":
        kept += [f"EO_{field}" for field in EARLY_OPEN_FIELDS if field not in DROPPED_EARLY_OPEN]
    return kept


def manifest_of(protocol: str, names: Sequence[str] | None = None) -> FeatureManifest:
    """The built-in manifest, or one checked from an explicit list of names."""
    key = protocol_key(protocol)
    if names is None:
        names = [f"{name}_{NORMALISED_SUFFIX}" for name in _retained(key)]
    return FeatureManifest(key, tuple(name.strip() for name in names))


def check_manifest_pair(o2o: FeatureManifest, de: FeatureManifest) -> None:
    """The de manifest must begin with all o2o columns, in order."""
    if (o2o.protocol, de.protocol) != PROTOCOLS:
        raise ValueError("expected the o2o manifest, then the de manifest")
    if de.columns[: len(o2o.columns)] != o2o.columns:
        raise ValueError("the de manifest does not begin with the o2o columns")
