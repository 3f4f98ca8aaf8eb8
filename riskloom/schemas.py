"""Schemas, the model input order and the values that define results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# These must stay as they are for results to be right.

HOME_COUNTRY = "US"
SUSPICIOUS_AMOUNT = 200
HIGH_AMOUNT = 500

CATEGORIES = [
    "groceries", "electronics", "restaurants", "travel",
    "gas_station", "pharmacy", "clothing", "entertainment",
]
COUNTRIES = ["US", "NG", "RU", "CN", "BR", "IN"]
USER_ID_REGEX = r"\Auser_[0-9]{4}\z"
TRANSACTION_ID_REGEX = r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
AMOUNT_LIMIT = 100000

WINDOW_FEATURES = ["txn_count_5min", "total_amount_5min", "avg_amount_5min", "max_amount_5min"]
FLAG_FEATURES = ["is_foreign", "is_high_amount", "is_suspicious"]
FEATURE_ORDER = WINDOW_FEATURES + FLAG_FEATURES

USER_FEATURES_TTL = 300
FLAGS_TTL = 3600

HIGH_RISK = 0.7
MEDIUM_RISK = 0.4

MIN_TRAINING_ROWS = 200
MIN_ROWS_PER_CLASS = 5
TEST_FRACTION = 0.2
SEED = 42
TREES, TREE_DEPTH, LEARNING_RATE = 100, 4, 0.1

# Value at which a feature counts as fully active, in FEATURE_ORDER.
FEATURE_MAXIMA = [20.0, 5000.0, 2500.0, 5000.0, 1.0, 1.0, 1.0]
FLAG_WEIGHT = 0.6

AMOUNT_BOUNDS = [10, 50, 100, 250, 500, 1000, 2500, 5000, 10000]
REQUESTS_PER_MINUTE = 100
REQUESTS_PER_MINUTE_WITH_KEY = 1000
# --- end of fixed values ----------------------------------------------------


def _nullable(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# The field names below must equal those of the messages and layers.

# Message body of the transaction topic.
TRANSACTION = _nullable(
    ("transaction_id", T.StringType()),
    ("user_id", T.StringType()),
    ("amount", T.DoubleType()),
    ("merchant_category", T.StringType()),
    ("merchant_country", T.StringType()),
    ("merchant_name", T.StringType()),
    ("card_last4", T.StringType()),
    ("timestamp", T.StringType()),
)

# Message body of the label topic.
LABEL = _nullable(
    ("transaction_id", T.StringType()),
    ("user_id", T.StringType()),
    ("is_fraud", T.BooleanType()),
    ("label_timestamp", T.StringType()),
)

BRONZE = T.StructType(TRANSACTION.fields + [T.StructField("event_time", T.TimestampType(), True)])

WINDOWED = _nullable(
    ("user_id", T.StringType()),
    ("window_start", T.TimestampType()),
    ("window_end", T.TimestampType()),
    ("txn_count_5min", T.LongType()),
    ("total_amount_5min", T.DoubleType()),
    ("avg_amount_5min", T.DoubleType()),
    ("max_amount_5min", T.DoubleType()),
)

FLAG_COLUMNS = [
    "transaction_id", "user_id", "amount", "merchant_country", "merchant_category",
    "is_foreign", "is_high_amount", "is_suspicious", "event_time",
]

QUARANTINE = _nullable(
    ("kind", T.StringType()),
    ("batch_id", T.LongType()),
    ("errors", T.ArrayType(T.StringType())),
    ("record", T.StringType()),
    ("quarantined_at", T.TimestampType()),
)


@dataclass(frozen=True)
class SlidingSpec:
    """Window length, slide and watermark, in seconds."""

    size: int = 300
    slide: int = 60
    watermark: int = 600

    def __post_init__(self):
        if self.size % self.slide:
            raise ValueError("window size must be a multiple of the slide")

    @property
    def panes(self) -> int:
        return self.size // self.slide


SLIDING = SlidingSpec()


@dataclass(frozen=True)
class FeatureView:
    """What a point-in-time join needs to know about a feature table.

    ``ttl`` seconds of 0 mean no limit. ``step`` is the grid in seconds that all
    timestamps lie on, or 0 when they may lie anywhere.
    """

    name: str
    entity: str
    timestamp: str
    fields: dict[str, str] = field(hash=False)
    ttl: int = 0
    step: int = 0
    path: str | None = None
    online: bool = False

    def select_refs(self, refs: list[str]) -> list[str]:
        """Column names for references of the form ``view:feature``."""
        names = []
        for ref in refs:
            view, _, name = ref.partition(":")
            if view != self.name or name not in self.fields:
                raise ValueError(f"unknown feature reference: {ref}")
            names.append(name)
        return names


# The timestamp is the window's end: a window that is still open at time t
# holds transactions after t and must not be visible there.
USER_VIEW = FeatureView(
    name="user_transaction_features",
    entity="user_id",
    timestamp="window_end",
    fields={
        "txn_count_5min": "bigint",
        "total_amount_5min": "float",
        "avg_amount_5min": "float",
        "max_amount_5min": "float",
    },
    ttl=120,
    step=60,
    online=True,
)
