"""The registered queries once more as SQL over the same tables, for checking."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from riskloom.plans.fixed import SHAPLEY_UNIT, TREES

CTES = {
    "txns": r"""
        SELECT event_id,
               regexp_replace(md5(CAST(event_id AS VARCHAR)),
                 '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS transaction_id,
               'user_' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS user_id,
               round(value * 10, 2) AS amount,
               CASE event_type WHEN 'click' THEN 'groceries' WHEN 'view' THEN 'restaurants'
                 WHEN 'purchase' THEN 'electronics' WHEN 'signup' THEN 'travel'
                 WHEN 'error' THEN 'gas_station' END AS merchant_category,
               CASE WHEN k < 85 THEN 'US'
                 ELSE (['NG', 'RU', 'CN', 'BR', 'IN'])[(k - 85) % 5 + 1] END AS merchant_country,
               'shop ' || k AS merchant_name,
               lpad(CAST(event_id % 10000 AS VARCHAR), 4, '0') AS card_last4,
               make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 360) AS event_time
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    "labels": """
        SELECT transaction_id, user_id,
               CASE WHEN again = 1 THEN NOT fraud ELSE fraud END AS is_fraud,
               event_time + INTERVAL 30 SECOND + again * INTERVAL 1 HOUR AS label_time
        FROM (SELECT *, unnest(CASE WHEN event_id % 10 = 0 THEN [0, 1] ELSE [0] END) AS again,
                     CASE WHEN event_id % 50 = 0
                       THEN NOT (merchant_country IN ('NG', 'RU', 'CN') AND amount > 300)
                       ELSE merchant_country IN ('NG', 'RU', 'CN') AND amount > 300 END AS fraud
              FROM txns WHERE event_id % 7 <> 0)""",
    "first_labels": """
        SELECT transaction_id, is_fraud, label_time FROM labels
        QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY label_time, is_fraud) = 1""",
    "entities": """
        SELECT t.transaction_id, t.user_id, t.amount, t.merchant_country,
               t.event_time AS event_timestamp, CAST(l.is_fraud AS INT) AS fraud
        FROM txns t JOIN first_labels l USING (transaction_id)""",
    "dirty": """
        SELECT event_id, transaction_id,
               CASE WHEN event_id % 71 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 'bad'
                 ELSE user_id END AS user_id,
               CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 83 = 0 THEN -amount
                 ELSE amount END AS amount,
               merchant_category,
               CASE WHEN event_id % 79 = 0 THEN 'XX' ELSE merchant_country END AS merchant_country,
               CASE WHEN event_id % 73 = 0 THEN 'garbage'
                 ELSE strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') END AS "timestamp",
               CASE WHEN event_id % 73 = 0 THEN NULL ELSE event_time END AS event_time
        FROM txns""",
    "requests": """
        SELECT event_id, trim(user_id) AS user_id, amount, trim(merchant_category) AS merchant_category,
               merchant_country,
               concat_ws('; ',
                 CASE WHEN trim(user_id) = '' THEN 'user_id cannot be empty' END,
                 CASE WHEN isnan(amount) THEN 'amount must be a finite number'
                   WHEN amount <= 0 THEN 'amount must be positive'
                   WHEN amount > 100000 THEN 'amount exceeds maximum allowed value' END,
                 CASE WHEN trim(merchant_category) = '' THEN 'merchant_category cannot be empty' END
               ) AS errors
        FROM (SELECT event_id,
                     CASE WHEN event_id % 41 = 0 THEN '   ' ELSE user_id END AS user_id,
                     CASE WHEN event_id % 43 = 0 THEN amount * 1000 WHEN event_id % 47 = 0 THEN -amount
                       WHEN event_id % 53 = 0 THEN CAST('NaN' AS DOUBLE) ELSE amount END AS amount,
                     CASE WHEN event_id % 59 = 0 THEN '' ELSE merchant_category END AS merchant_category,
                     merchant_country
              FROM txns)""",
    "good_requests": "SELECT * EXCLUDE (errors) FROM requests WHERE errors = ''",
    "trailing_rows": """
        SELECT w.* FROM windows w
        JOIN (SELECT user_id, max(date_trunc('minute', event_time)) AS t FROM txns GROUP BY user_id) m
          ON w.user_id = m.user_id AND w.window_start = m.t - INTERVAL 4 MINUTE""",
    "online_rows": """
        SELECT w.*, u.updated_at, u.updated_at + INTERVAL 300 SECOND AS expires_at
        FROM trailing_rows w
        JOIN (SELECT user_id, max(event_time) AS updated_at FROM txns GROUP BY user_id) u USING (user_id)""",
    "online_live": """
        SELECT * FROM online_rows
        WHERE expires_at > (SELECT max(event_time) FROM txns)""",
    "pit": """
        SELECT transaction_id, user_id, amount, merchant_country, event_timestamp, fraud,
               CASE WHEN fresh THEN window_end END AS window_end,
               CASE WHEN fresh THEN txn_count_5min END AS txn_count_5min,
               CASE WHEN fresh THEN total_amount_5min END AS total_amount_5min,
               CASE WHEN fresh THEN avg_amount_5min END AS avg_amount_5min,
               CASE WHEN fresh THEN max_amount_5min END AS max_amount_5min
        FROM (SELECT e.*, w.* EXCLUDE (user_id),
                     w.window_end >= e.event_timestamp - INTERVAL 2 MINUTE AS fresh
              FROM entities e ASOF LEFT JOIN windows w
                ON e.user_id = w.user_id AND e.event_timestamp >= w.window_end) e""",
}


def _windows(source: str) -> str:
    return f"""
        SELECT user_id, window_start, window_start + INTERVAL 5 MINUTE AS window_end,
               count(*) AS txn_count_5min,
               CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_amount_5min,
               CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / nullif(count(amount), 0) AS avg_amount_5min,
               max(amount) AS max_amount_5min
        FROM (SELECT user_id, amount,
                     date_trunc('minute', event_time) - o * INTERVAL 1 MINUTE AS window_start
              FROM {source}, range(0, 5) r(o) WHERE event_time IS NOT NULL)
        GROUP BY user_id, window_start"""


def _vector(source: str, keep: str) -> str:
    flags = _flags()
    return f"""
        SELECT {keep},
               coalesce(CAST(txn_count_5min AS DOUBLE), 0.0) AS txn_count_5min,
               coalesce(total_amount_5min, 0.0) AS total_amount_5min,
               coalesce(avg_amount_5min, 0.0) AS avg_amount_5min,
               coalesce(max_amount_5min, 0.0) AS max_amount_5min,
               CAST({flags['is_foreign']} AS DOUBLE) AS is_foreign,
               CAST({flags['is_high_amount']} AS DOUBLE) AS is_high_amount,
               CAST({flags['is_suspicious']} AS DOUBLE) AS is_suspicious
        FROM {source}"""


def _flags() -> dict[str, str]:
    foreign = "merchant_country IS DISTINCT FROM 'US'"
    return {
        "is_foreign": f"(CASE WHEN {foreign} THEN 1 ELSE 0 END)",
        "is_high_amount": "(CASE WHEN amount > 500 AND NOT isnan(amount) THEN 1 ELSE 0 END)",
        "is_suspicious": f"(CASE WHEN {foreign} AND amount > 200 AND NOT isnan(amount) THEN 1 ELSE 0 END)",
    }


FLAGS = ", ".join(f"{sql} AS {name}" for name, sql in _flags().items())

CTES["windows"] = _windows("txns")
CTES["dirty_windows"] = _windows("dirty")
CTES["vectors"] = _vector("pit", "transaction_id, user_id, event_timestamp, amount, merchant_country, fraud")
CTES["looked_up"] = """
    SELECT r.*, o.txn_count_5min, o.total_amount_5min, o.avg_amount_5min, o.max_amount_5min,
           o.user_id IS NOT NULL AS features_found
    FROM good_requests r LEFT JOIN online_live o USING (user_id)"""
CTES["looked_up_any"] = CTES["looked_up"].replace("online_live", "trailing_rows")
CTES["request_vectors_any"] = _vector(
    "looked_up_any", "event_id, user_id, features_found, amount, merchant_country")
CTES["request_vectors"] = _vector("looked_up", "event_id, user_id, features_found, amount, merchant_country")
_SCORE = """
    SELECT *, CASE WHEN probability > 0.7 THEN 'HIGH' WHEN probability > 0.4 THEN 'MEDIUM'
                ELSE 'LOW' END AS risk_level
    FROM (SELECT *, least(1.0::DOUBLE, 0.05::DOUBLE + 0.4::DOUBLE * is_suspicious
                    + 0.3::DOUBLE * is_high_amount + 0.02::DOUBLE * txn_count_5min) AS probability
          FROM {source})"""
CTES["scored"] = _SCORE.format(source="vectors")
CTES["scored_requests"] = _SCORE.format(source="request_vectors")
CTES["scored_requests_any"] = _SCORE.format(source="request_vectors_any")

CTES["closed"] = """
    SELECT * FROM windows WHERE window_end <= (SELECT max(event_time) FROM txns) - INTERVAL 10 MINUTE"""
CTES["pit_closed"] = CTES["pit"].replace("JOIN windows w", "JOIN closed w")
CTES["vectors_closed"] = _vector("pit_closed", "transaction_id, fraud")

# What each relation is built from, in an order that can be written down.
ORDER = [
    "txns", "labels", "first_labels", "entities", "dirty", "requests", "good_requests", "windows",
    "dirty_windows", "trailing_rows", "online_rows", "online_live", "pit", "vectors", "looked_up",
    "request_vectors", "scored", "scored_requests", "looked_up_any", "request_vectors_any",
    "scored_requests_any", "closed", "pit_closed", "vectors_closed",
]


def sql(select: str) -> str:
    """The select with all relations before it; it may begin with relations of its own."""
    own = select.strip()
    more, select = (",\n" + own.removeprefix("WITH "), "") if own.startswith("WITH ") else ("", "\n" + select)
    return "WITH " + ",\n".join(f"{name} AS ({CTES[name]})" for name in ORDER) + more + select


def t(column: str) -> str:
    """A timestamp as text."""
    name = column.split(".")[-1]
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


NUMBERS = "txn_count_5min, total_amount_5min, avg_amount_5min, max_amount_5min"
WINDOW = f"user_id, {t('window_start')}, {t('window_end')}, {NUMBERS}"
TEXT_TIME = "strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f')"

_MESSAGES = "event_id, errors = '' AS valid, errors"
# The message texts below must equal the reference's.
_USER_ERROR = (
    "CASE WHEN user_id IS NULL OR NOT regexp_full_match(user_id, 'user_[0-9]{4}') "
    "THEN 'Invalid user_id format: ' || coalesce(user_id, 'None') END"
)
_TXN_ERRORS = f"""concat_ws('; ', {_USER_ERROR},
    CASE WHEN amount IS NULL THEN 'amount is required'
      WHEN amount <= 0 THEN 'amount must be positive: ' || amount
      WHEN amount >= 100000 THEN 'amount exceeds maximum: ' || amount END,
    CASE WHEN merchant_country NOT IN ('US', 'NG', 'RU', 'CN', 'BR', 'IN')
      THEN 'Invalid merchant_country: ' || merchant_country END)"""
_FLAG_ERRORS = f"""concat_ws('; ', {_USER_ERROR},
    CASE WHEN amount IS NULL OR amount <= 0
      THEN 'amount must be positive: ' || coalesce(CAST(amount AS VARCHAR), 'None') END)"""
_FEATURE_ERRORS = f"concat_ws('; ', {_USER_ERROR}, " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN '{c} is required' "
    f"WHEN {c} < 0 THEN '{c} must be non-negative: ' || {c} END"
    for c in NUMBERS.split(", ")
) + ")"

_BAD_FLAGS = f"SELECT transaction_id, user_id, {_FLAG_ERRORS} AS errors FROM dirty"
_BAD_USERS = f"""
    SELECT CAST(NULL AS VARCHAR) AS transaction_id, user_id, {_FEATURE_ERRORS} AS errors
    FROM (SELECT w.*, max(window_start) OVER (PARTITION BY user_id) AS newest FROM dirty_windows w)
    WHERE window_end > newest
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY window_start) = 1"""
_QUARANTINE = f"""
    SELECT 'transaction_flags' AS kind, 0::BIGINT AS batch_id, * FROM ({_BAD_FLAGS}) WHERE errors <> ''
    UNION ALL
    SELECT 'user_features', 1::BIGINT, * FROM ({_BAD_USERS}) WHERE errors <> ''"""

_SEEN = "(SELECT user_id FROM windows WHERE CAST(substr(user_id, 6) AS INT) % 5 <> 0)"

_IMPORTANCES = [0.22, 0.16, 0.12, 0.14, 0.10, 0.08, 0.18]
# The scales of the window features.
_MAXIMA = [20, 5000, 2500, 5000]


def _parts() -> list[tuple[str, str]]:
    names = NUMBERS.split(", ") + ["is_foreign", "is_high_amount", "is_suspicious"]
    total = sum(_IMPORTANCES)
    out = []
    for i, name in enumerate(names):
        weight = f"{_IMPORTANCES[i] / total!r}::DOUBLE"
        if i < 4:
            active = f"least({name} / {_MAXIMA[i]}::DOUBLE, 1.0::DOUBLE)"
        else:
            active = f"(({name} * 2 - 1) * 0.6::DOUBLE)"
        out.append((name, f"{weight} * {active}"))
    return out


_CONTRIBUTIONS = ", ".join(f"{part} AS {name}" for name, part in _parts())
_TOP3 = " UNION ALL ".join(
    f"SELECT transaction_id, {i} AS position, '{name}' AS feature, {name} AS feature_value, {part} AS part FROM scored"
    for i, (name, part) in enumerate(_parts())
)

# Wording and limits of the reasons.
_REASONS = """
    SELECT transaction_id, CASE WHEN r = '' THEN
        CASE WHEN probability > 0.4 THEN 'Model flagged transaction — pattern matches historical fraud'
          ELSE 'No strong fraud indicators in this transaction' END ELSE r END AS reasons
    FROM (SELECT transaction_id, probability, concat_ws('; ',
        CASE WHEN is_suspicious = 1
            THEN 'Foreign transaction exceeds suspicious threshold ($200) — country=' || merchant_country
          WHEN is_foreign = 1 THEN 'Foreign merchant country (' || merchant_country || ')' END,
        CASE WHEN is_high_amount = 1
            THEN printf('High-value transaction ($%.2f > $500 threshold)', amount) END,
        CASE WHEN txn_count_5min > 10
            THEN printf('High velocity: %.0f transactions in last 5 minutes', txn_count_5min)
          WHEN txn_count_5min > 5
            THEN printf('Elevated velocity: %.0f transactions in last 5 minutes', txn_count_5min) END,
        CASE WHEN max_amount_5min > 1000
            THEN printf('Peak amount in window is high ($%.2f)', max_amount_5min) END,
        CASE WHEN total_amount_5min > 5000
            THEN printf('Large total volume in window ($%.2f in 5 min)', total_amount_5min) END) AS r
      FROM scored)"""

# Bounds of the amount histogram.
_BOUNDS = [10, 50, 100, 250, 500, 1000, 2500, 5000, 10000]


def _quantile(q: float) -> str:
    cases, low, before = [], 0, "0"
    for bound in _BOUNDS:
        upto = f"le_{bound}"
        share = f"({q}::DOUBLE * le_inf - {before}) / nullif(CAST({upto} - {before} AS DOUBLE), 0)"
        cases.append(
            f"WHEN {upto} >= {q}::DOUBLE * le_inf "
            f"THEN coalesce({low}::DOUBLE + ({bound}::DOUBLE - {low}::DOUBLE) * ({share}), {bound}::DOUBLE)"
        )
        low, before = bound, upto
    return "CASE " + " ".join(cases) + f" ELSE {_BOUNDS[-1]}::DOUBLE END"


_BUCKETS = ", ".join(
    [f"count(*) FILTER (amount <= {b}) AS le_{b}" for b in _BOUNDS] + ["count(*) AS le_inf"]
)


def _velocity(seconds: int, limit: int) -> str:
    return f"""
    SELECT transaction_id, user_id, n_trailing, n_trailing > {limit} AS over_limit
    FROM (SELECT transaction_id, user_id, count(*) OVER (
            PARTITION BY user_id ORDER BY epoch_us(event_time)
            RANGE BETWEEN {seconds * 1_000_000 - 1} PRECEDING AND CURRENT ROW) AS n_trailing
          FROM txns)"""


_CONFUSION = """
    SELECT count(*) FILTER (fraud = 1 AND p) AS tp, count(*) FILTER (fraud = 0 AND p) AS fp,
           count(*) FILTER (fraud = 0 AND NOT p) AS tn, count(*) FILTER (fraud = 1 AND NOT p) AS fn
    FROM (SELECT fraud, probability > 0.5 AS p FROM scored)"""

_TEST_ROWS = """(SELECT transaction_id, fraud
    FROM (SELECT *, row_number() OVER (PARTITION BY fraud ORDER BY md5(transaction_id || '|42')) AS rn,
                 count(*) OVER (PARTITION BY fraud) AS n FROM entities)
    WHERE rn <= floor(0.2 * n + 0.5))"""

_FEATURES = [*NUMBERS.split(", "), "is_foreign", "is_high_amount", "is_suspicious"]


def _tree_given(node, known: tuple) -> str:
    """What a tree gives on average when only the features ``known`` are known."""
    if len(node) == 2:
        return f"{node[1]!r}::DOUBLE"
    feature, threshold, cover, *children = node
    left, right = (_tree_given(c, known) for c in children)
    if feature in known:
        return f"CASE WHEN {_FEATURES[feature]} <= {threshold!r}::DOUBLE THEN {left} ELSE {right} END"
    shares = [(c[0] if len(c) == 2 else c[2]) / cover for c in children]
    return f"({shares[0]!r}::DOUBLE * {left} + {shares[1]!r}::DOUBLE * {right})"


def _tree_features(node) -> set[int]:
    return set() if len(node) == 2 else {node[0]}.union(*(_tree_features(c) for c in node[3:]))


def _shapley(feature: int) -> str:
    """A feature's Shapley value by its definition, over all subsets of the other features of each tree."""
    terms = []
    for weight, root in TREES:
        used = _tree_features(root)
        if feature not in used:
            continue
        others, m = sorted(used - {feature}), len(used)
        for k in range(m):
            share = weight * factorial(k) * factorial(m - k - 1) / factorial(m)
            terms += [
                f"{share!r}::DOUBLE * ({_tree_given(root, (*s, feature))} - {_tree_given(root, s)})"
                for s in combinations(others, k)]
    return " + ".join(terms)


def _node_rows(tree: int, node, path: str) -> list[str]:
    """Sums of gradients and hessians of every split of a tree, signed as its gain adds them."""
    if len(node) == 2:
        return []
    feature, threshold, _, left, right = node
    side = f"{_FEATURES[feature]} <= {threshold!r}::DOUBLE"
    sides = (f"{path} AND {side}", f"{path} AND NOT ({side})")
    rows = [
        f"SELECT '{_FEATURES[feature]}' AS feature, {sign} AS sign, sum(p{tree} - fraud) AS g, sum(p{tree} * (1 - p{tree})) AS h "
        f"FROM margins WHERE {where}" for sign, where in ((-1, path), (1, sides[0]), (1, sides[1]))]
    return rows + _node_rows(tree, left, sides[0]) + _node_rows(tree, right, sides[1])


def _gains() -> str:
    margins, sums = ["0.0::DOUBLE"], []
    for weight, root in TREES:
        margins.append(f"{margins[-1]} + {weight!r}::DOUBLE * ({_tree_given(root, tuple(range(len(_FEATURES))))})")
    chances = ", ".join(f"1 / (1 + exp(-({m}))) AS p{i}" for i, m in enumerate(margins[:-1]))
    for i, (_, root) in enumerate(TREES):
        sums += _node_rows(i, root, "TRUE")
    return f"""WITH margins AS MATERIALIZED (SELECT *, {chances} FROM vectors),
        sums AS ({' UNION ALL '.join(sums)}),
        found AS (SELECT feature, sum(CASE WHEN h > 0 THEN sign * g * g / h / 2 ELSE 0 END) AS gain,
                         count(*) FILTER (sign < 0) AS n_splits FROM sums GROUP BY feature)
        SELECT name AS feature, coalesce(n_splits, 0) AS n_splits, CAST(round(coalesce(gain, 0) * 1e6) AS BIGINT) AS gain
        FROM (SELECT unnest({_FEATURES!r}) AS name) LEFT JOIN found ON name = feature"""


_VALID_WINDOWS = f"SELECT {WINDOW} FROM windows"

SELECTS = {
    "flags": f"SELECT transaction_id, {FLAGS} FROM txns",
    "sql_flags": f"SELECT transaction_id, {FLAGS} FROM txns",
    "flag_projection": f"""SELECT transaction_id, user_id, amount, merchant_country, merchant_category,
        {FLAGS}, {t('event_time')} FROM txns""",
    "flags_of_dirty": f"SELECT event_id, {FLAGS} FROM dirty",
    "json_parse": "SELECT event_id, " + ", ".join(
        f"CASE WHEN event_id % 61 <> 0 THEN {c} END AS {c}" for c in [
            "transaction_id", "user_id", "amount", "merchant_category", "merchant_country",
            "merchant_name", "card_last4"]
    ) + """, CASE WHEN event_id % 61 <> 0 THEN strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') END AS event_time,
        event_id % 61 = 0 AS corrupt FROM txns""",
    "parse_event_time": f"""SELECT event_id, "timestamp", strftime(
        TRY_CAST("timestamp" AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%f') AS event_time FROM dirty""",
    "windowed_features": _VALID_WINDOWS,
    "windowed_append_stream": f"""{_VALID_WINDOWS} WHERE windows.window_end <=
        (SELECT max(event_time) FROM txns) - INTERVAL 10 MINUTE""",
    "closed_windows": f"""{_VALID_WINDOWS} WHERE windows.window_end <=
        (SELECT max(event_time) FROM txns) - INTERVAL 10 MINUTE""",
    "trailing_window": f"SELECT {WINDOW} FROM trailing_rows",
    "trailing_direct": f"SELECT {WINDOW} FROM trailing_rows",
    "trailing_update_stream": f"SELECT {WINDOW} FROM trailing_rows",
    "latest_window_baseline": f"""SELECT {WINDOW} FROM (SELECT * FROM windows
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY windows.window_start DESC) = 1)""",
    "flags_stream": f"SELECT transaction_id, user_id, amount, {FLAGS} FROM txns WHERE amount > 0",
    "trailing_update_multibatch": f"SELECT {WINDOW} FROM trailing_rows",
    "windows_with_state": _VALID_WINDOWS,
    "late_drops": """SELECT count(*) AS n_dropped FROM (
        SELECT DISTINCT user_id, date_trunc('minute', event_time) - o * INTERVAL 1 MINUTE
        FROM txns, range(0, 5) r(o)
        WHERE event_id IN (SELECT event_id FROM events
                           WHERE ts < (SELECT max(ts) FROM events) - 40 * 360 * INTERVAL 1 MINUTE))""",
    "quarantine_observed": f"""SELECT 'transaction' AS kind, count(*) AS n, count(*) AS n_met, 0::BIGINT AS n_lost
        FROM (SELECT {_TXN_ERRORS} AS errors FROM dirty) WHERE errors <> ''""",
    "keyed_state_multibatch": f"SELECT {WINDOW} FROM trailing_rows",
    "flags_multibatch": f"""SELECT transaction_id, user_id, amount, {FLAGS}
        FROM (SELECT * REPLACE (CASE WHEN event_id % 20 = 0 THEN 1000.0::DOUBLE ELSE amount END AS amount) FROM txns)
        WHERE amount > 0""",
    "bronze_replay": _VALID_WINDOWS,
    "bronze_exact": f"SELECT transaction_id, {t('event_time')} FROM txns",
    "training_set_from_layers": f"""SELECT transaction_id, fraud, {NUMBERS}, is_foreign, is_high_amount,
        is_suspicious FROM vectors_closed""",
    "labels_stream": f"""SELECT transaction_id, user_id, is_fraud,
        strftime(label_time, '%Y-%m-%dT%H:%M:%S.%f') AS label_timestamp, {t('label_time')} FROM labels""",
    "rejected_stream": f"""SELECT 'transaction' AS kind, event_id, errors
        FROM (SELECT event_id, {_TXN_ERRORS} AS errors FROM dirty) WHERE errors <> ''""",
    "scores_stream": f"""SELECT event_id, user_id, features_found, {NUMBERS}, is_foreign, is_high_amount,
        is_suspicious, probability, risk_level FROM scored_requests_any""",
    "validate_transactions": f"SELECT {_MESSAGES} FROM (SELECT event_id, {_TXN_ERRORS} AS errors FROM dirty)",
    "validate_user_features": f"""SELECT user_id, {t('window_start')}, errors = '' AS valid, errors
        FROM (SELECT *, {_FEATURE_ERRORS} AS errors FROM dirty_windows)""",
    "validate_flags": f"SELECT {_MESSAGES} FROM (SELECT event_id, {_FLAG_ERRORS} AS errors FROM dirty)",
    "request_cleaning": "SELECT event_id, user_id, merchant_category, merchant_country, errors FROM requests",
    "quarantine_rows": _QUARANTINE,
    "quarantine_counts": f"SELECT kind, count(*) AS n FROM ({_QUARANTINE}) GROUP BY kind",
    "error_counts": f"""SELECT split_part(message, ':', 1) AS error_type, count(*) AS n
        FROM (SELECT unnest(string_split({_TXN_ERRORS}, '; ')) AS message FROM dirty)
        WHERE message <> '' GROUP BY 1""",
    "fail_fast_errors": f"""SELECT split_part(message, ':', 1) || ': ' || count(*) || ' rows' AS error
        FROM (SELECT unnest(string_split({_TXN_ERRORS}, '; ')) AS message FROM dirty)
        WHERE message <> '' GROUP BY split_part(message, ':', 1)""",
    "quarantine_fallback": f"SELECT 'transaction_flags' AS kind, transaction_id, errors FROM ({_BAD_FLAGS}) WHERE errors <> ''",
    "layer_counts": f"""WITH valid AS (SELECT * FROM (SELECT *, {_TXN_ERRORS} AS errors FROM dirty) WHERE errors = ''),
        timed AS (SELECT * FROM valid WHERE event_time IS NOT NULL),
        mark AS (SELECT max(event_time) - INTERVAL 10 MINUTE AS upto FROM valid)
        SELECT 'bronze' AS layer, count(*) AS n FROM dirty
        UNION ALL SELECT 'silver', count(*) FROM (
          SELECT DISTINCT user_id, date_trunc('minute', event_time) + (5 - o) * INTERVAL 1 MINUTE AS window_end
          FROM timed, range(0, 5) r(o)), mark WHERE window_end <= upto
        UNION ALL SELECT 'labels', count(*) FROM labels
        UNION ALL SELECT 'user_features', count(DISTINCT user_id) FROM timed
        UNION ALL SELECT 'flags', count(*) FROM valid
        UNION ALL SELECT 'rejected', count(*) FROM (SELECT {_TXN_ERRORS} AS errors FROM dirty) WHERE errors <> ''""",
    "labels_first_seen": f"SELECT transaction_id, is_fraud, {t('label_time')} FROM first_labels",
    "labeled_transactions": f"""SELECT transaction_id, user_id, amount, merchant_country,
        {t('event_timestamp')}, fraud FROM entities""",
    "cold_start_users": f"SELECT transaction_id, user_id FROM entities WHERE user_id NOT IN {_SEEN}",
    "known_user_entities": f"SELECT transaction_id, user_id FROM entities WHERE user_id IN {_SEEN}",
    "pit_join": f"""SELECT transaction_id, user_id, {t('event_timestamp')}, fraud, {t('window_end')},
        {NUMBERS} FROM pit""",
    "pit_join_any_age": f"""SELECT transaction_id, e.user_id, {t('e.event_timestamp')}, fraud,
        {t('w.window_end')}, {NUMBERS}
        FROM entities e ASOF LEFT JOIN windows w
          ON e.user_id = w.user_id AND e.event_timestamp >= w.window_end""",
    "pit_join_by_period": f"""SELECT transaction_id, e.user_id, {t('e.event_timestamp')}, fraud,
        {t('w.window_end')}, {NUMBERS}
        FROM entities e ASOF LEFT JOIN windows w
          ON e.user_id = w.user_id AND e.event_timestamp >= w.window_end""",
    "pit_coverage": """SELECT count(*) AS n_rows, count(txn_count_5min) AS n_matched,
        count(txn_count_5min) / CAST(count(*) AS DOUBLE) AS coverage FROM pit""",
    "training_set": f"""SELECT transaction_id, fraud, {NUMBERS}, is_foreign, is_high_amount, is_suspicious
        FROM vectors""",
    "feature_matrix": _vector(f"""(SELECT e.*,
        CASE WHEN fresh THEN c END AS txn_count_5min, CASE WHEN fresh THEN s END AS total_amount_5min,
        CASE WHEN fresh THEN a END AS avg_amount_5min, CASE WHEN fresh THEN m END AS max_amount_5min
        FROM (SELECT e.*, w.txn_count_5min AS c, w.total_amount_5min AS s, w.avg_amount_5min AS a,
                     w.max_amount_5min AS m,
                     w.window_end >= e.event_time - INTERVAL 2 MINUTE AS fresh
              FROM txns e ASOF LEFT JOIN windows w
                ON e.user_id = w.user_id AND e.event_time >= w.window_end) e)""", "transaction_id"),
    "rule_labels": """SELECT transaction_id, CAST((is_suspicious = 1 AND is_high_amount = 1)
        OR (txn_count_5min > 10 AND is_foreign = 1) AS INT) AS rule_fraud FROM vectors""",
    "class_counts": """SELECT count(*) AS n_rows, count(*) FILTER (fraud = 1) AS n_fraud,
        count(*) FILTER (fraud = 0) AS n_legit FROM entities""",
    "fraud_rate": "SELECT avg(fraud) AS fraud_rate FROM entities",
    "training_guard": """SELECT count(*) AS n_rows, count(*) FILTER (fraud = 1) AS n_fraud,
        count(*) >= 200 AND count(*) FILTER (fraud = 1) >= 5 AND count(*) FILTER (fraud = 0) >= 5 AS enough
        FROM entities""",
    "stratified_split": """SELECT transaction_id, fraud, rn <= floor(0.2 * n + 0.5) AS is_test
        FROM (SELECT *, row_number() OVER (PARTITION BY fraud ORDER BY md5(transaction_id || '|42')) AS rn,
                     count(*) OVER (PARTITION BY fraud) AS n FROM entities)""",
    "view_schema": f"""SELECT user_id, {t('window_end')}, txn_count_5min::DOUBLE AS txn_count_5min,
        total_amount_5min::FLOAT::DOUBLE AS total_amount_5min,
        avg_amount_5min::FLOAT::DOUBLE AS avg_amount_5min,
        max_amount_5min::FLOAT::DOUBLE AS max_amount_5min FROM windows""",
    "online_user_features": f"SELECT {WINDOW}, {t('updated_at')}, {t('expires_at')} FROM online_live",
    "online_flags": f"""SELECT transaction_id, user_id, amount, {FLAGS},
        strftime(event_time + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS expires_at FROM txns
        WHERE event_time + INTERVAL 1 HOUR > (SELECT max(event_time) FROM txns)""",
    "online_lookup": f"SELECT event_id, user_id, features_found, {NUMBERS} FROM looked_up",
    "store_keys": """SELECT 'user_features:' || user_id AS key, 300 AS ttl, user_id,
        CAST(txn_count_5min AS VARCHAR) AS txn_count_5min,
        strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start,
        strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end,
        strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS updated_at,
        total_amount_5min, max_amount_5min FROM online_live""",
    "store_rounded": "SELECT 'user_features:' || user_id AS key, " + ", ".join(
        f"CAST(round(CAST(CAST({n} AS VARCHAR) AS DECIMAL(38,18)), 2) AS DOUBLE) AS {n}"
        for n in ("total_amount_5min", "avg_amount_5min", "max_amount_5min")) + " FROM online_live",
    "flag_keys": f"""SELECT 'txn_flags:' || transaction_id AS key, 3600 AS ttl, transaction_id, user_id,
        CAST(amount AS VARCHAR) AS amount, CAST(is_foreign AS VARCHAR) AS is_foreign,
        CAST(is_high_amount AS VARCHAR) AS is_high_amount, CAST(is_suspicious AS VARCHAR) AS is_suspicious
        FROM (SELECT transaction_id, user_id, amount, {FLAGS} FROM txns)""",
    "materialize_latest": f"""SELECT {WINDOW}, {t('window_end')[:-len('window_end')]}updated_at,
        strftime(window_end + INTERVAL 300 SECOND, '%Y-%m-%d %H:%M:%S.%f') AS expires_at
        FROM (SELECT * FROM windows, (SELECT max(event_time) - INTERVAL 10 MINUTE AS stop FROM txns)
              WHERE window_end <= stop AND window_end > stop - INTERVAL 10 MINUTE
              QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY windows.window_start DESC) = 1)""",
    "materialize_incremental": f"""SELECT {WINDOW}, {t('window_end')[:-len('window_end')]}updated_at,
        strftime(window_end + INTERVAL 300 SECOND, '%Y-%m-%d %H:%M:%S.%f') AS expires_at
        FROM (SELECT * FROM closed
              QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY closed.window_start DESC) = 1)""",
    "score_features": f"""SELECT event_id, user_id, features_found, {NUMBERS}, is_foreign, is_high_amount,
        is_suspicious, probability, risk_level FROM scored_requests""",
    "risk_bands": "SELECT transaction_id, probability, risk_level FROM scored",
    "confusion_metrics": f"""SELECT tp, fp, tn, fn,
        coalesce((tp + tn) / nullif(CAST(tp + fp + tn + fn AS DOUBLE), 0), 0) AS accuracy,
        coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS precision,
        coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS recall,
        coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1_score
        FROM ({_CONFUSION})""",
    "roc_auc": """SELECT sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg,
        CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / (2.0::DOUBLE * sum(pos) * sum(neg)) AS roc_auc
        FROM (SELECT probability, pos, neg,
                     sum(neg) OVER (ORDER BY probability) - neg AS below
              FROM (SELECT probability, count(*) FILTER (fraud = 1) AS pos,
                           count(*) FILTER (fraud = 0) AS neg FROM scored GROUP BY probability))""",
    "contributions_fixed": f"SELECT transaction_id, {_CONTRIBUTIONS} FROM scored",
    "top3_contributors": f"""SELECT transaction_id, CAST(place - 1 AS INT) AS place, feature, feature_value,
        CASE WHEN part > 0 THEN 'increases risk' ELSE 'decreases risk' END AS direction
        FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY abs(part) DESC, position)
                AS place FROM ({_TOP3})) WHERE place <= 3""",
    "reasons": _REASONS,
    "risk_band_counts": "SELECT risk_level, count(*) AS n FROM scored GROUP BY risk_level",
    "lookup_found_counts": "SELECT features_found, count(*) AS n FROM looked_up GROUP BY features_found",
    "window_found_counts": "SELECT txn_count_5min IS NOT NULL AS found, count(*) AS n FROM pit GROUP BY 1",
    "amount_histogram": f"""SELECT {_BUCKETS}, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM txns""",
    "histogram_quantile": f"""SELECT {t('interval_start')}, {_quantile(0.5)} AS p50,
        {_quantile(0.95)} AS p95, {_quantile(0.99)} AS p99
        FROM (SELECT time_bucket(INTERVAL 5 MINUTE, event_time) AS interval_start, {_BUCKETS}
              FROM txns GROUP BY 1)""",
    "prediction_rate_5m": f"""SELECT {t('interval_start')}, risk_level, n, n / 300.0::DOUBLE AS per_second
        FROM (SELECT time_bucket(INTERVAL 5 MINUTE, event_timestamp) AS interval_start, risk_level,
                     count(*) AS n FROM scored GROUP BY 1, 2)""",
    "counter_rate_5m": f"""
        WITH minutes AS (
          SELECT risk_level, (epoch_us(event_timestamp) // 60000000) * 60 + 60 AS time, count(*) AS n FROM scored GROUP BY 1, 2),
        samples AS (
          SELECT risk_level, time, CAST(sum(n) OVER (PARTITION BY risk_level, (time - 1) // 2100 ORDER BY time) AS DOUBLE) AS v FROM minutes),
        seen AS (
          SELECT risk_level, moment, time, v, lag(v) OVER w AS before FROM samples, (SELECT DISTINCT unnest(range(time, time + 300, 60)) AS moment FROM samples)
          WHERE time > moment - 300 AND time <= moment WINDOW w AS (PARTITION BY risk_level, moment ORDER BY time)),
        sums AS (
          SELECT risk_level, moment, count(*) AS n, sum(CASE WHEN before IS NULL THEN 0.0::DOUBLE WHEN v < before THEN v ELSE v - before END) AS increase,
                 arg_min(v, time) AS shown, CAST(max(time) - min(time) AS DOUBLE) AS covered,
                 CAST(min(time) - (moment - 300) AS DOUBLE) AS before, CAST(moment - max(time) AS DOUBLE) AS after
          FROM seen GROUP BY 1, 2 HAVING count(*) > 1),
        limited AS (
          SELECT *, covered / (n - 1) AS mean,
                 CASE WHEN increase > 0 AND shown >= 0 AND covered * (shown / increase) < before
                      THEN covered * (shown / increase) ELSE before END AS ahead FROM sums)
        SELECT strftime(make_timestamp(moment * 1000000), '%Y-%m-%d %H:%M:%S.%f') AS evaluated_at, risk_level, n AS n_samples, increase,
          increase * ((covered + CASE WHEN ahead < mean * 1.1::DOUBLE THEN ahead ELSE mean / 2 END
            + CASE WHEN after < mean * 1.1::DOUBLE THEN after ELSE mean / 2 END) / covered) / 300 AS per_second
        FROM limited""",
    "sketched_quantiles": f"""SELECT {t('interval_start')}, name, n, TRUE AS all_counted, TRUE AS within
        FROM (SELECT time_bucket(INTERVAL 5 MINUTE, event_time) AS interval_start, count(*) AS n FROM txns GROUP BY 1),
             (SELECT unnest(['p50', 'p95', 'p99']) AS name)""",
    "last_probability": """SELECT probability FROM scored
        ORDER BY event_timestamp DESC, transaction_id DESC LIMIT 1""",
    "score_with_model": f"""SELECT event_id, user_id, features_found, {NUMBERS}, is_foreign, is_high_amount,
        is_suspicious, TRUE AS band_agrees FROM request_vectors""",
    "gbt_test_rows": f"SELECT transaction_id, fraud, TRUE AS band_agrees, TRUE AS class_agrees FROM {_TEST_ROWS}",
    "gbt_metrics_agree": """SELECT unnest(['accuracy', 'precision', 'recall', 'f1_score', 'importances']) AS metric,
        TRUE AS agrees""",
    "model_scores_stream": f"""SELECT event_id, user_id, features_found, {NUMBERS}, is_foreign, is_high_amount,
        is_suspicious, TRUE AS band_agrees FROM request_vectors_any""",
    "gain_importances_fixed": _gains(),
    "shapley_adds_up": f"""SELECT transaction_id, fraud, 7 AS n_values, TRUE AS adds_up, TRUE AS gives_probability
        FROM {_TEST_ROWS}""",
    "shapley_fixed_trees": "SELECT transaction_id, " + ", ".join(
        f"CAST(round(({_shapley(i)}) * {SHAPLEY_UNIT}) AS BIGINT) AS {name}" for i, name in enumerate(_FEATURES)
    ) + " FROM vectors",
    "velocity_60s": _velocity(60, 2),
    "velocity_of_dirty": f"""SELECT event_id, user_id, n_trailing, n_trailing > 2 AS over_limit
        FROM (SELECT event_id, user_id, CASE WHEN event_time IS NULL THEN 0 ELSE count(*) OVER (
                PARTITION BY user_id, event_time IS NULL ORDER BY epoch_us(event_time)
                RANGE BETWEEN {60 * 1_000_000 - 1} PRECEDING AND CURRENT ROW) END AS n_trailing
              FROM dirty)""",
    "exact_trailing_5m": _velocity(300, 10),
}


def oracle_sql() -> dict[str, str]:
    return {name: sql(select) for name, select in SELECTS.items()}
