"""Common table expressions of the DuckDB SQL that the queries are compared with."""

from __future__ import annotations

from swipeline.functions.values import AMOUNT_LABELS, AMOUNT_STEPS, CHIPS, INDUSTRIES, KNOWN_MCCS, SPECIALS, STATES

TXN = """txn AS (
  SELECT o_orderkey AS row_id, o_custkey AS "User", o_orderkey % 3 AS "Card", year(o_orderdate)::INT AS "Year", month(o_orderdate)::INT AS "Month",
         day(o_orderdate)::INT AS "Day", lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey * 7 % 60)::VARCHAR, 2, '0') AS "Time",
         '$' || CASE WHEN cents < 0 THEN '-' ELSE '' END || (abs(cents) // 100)::VARCHAR || '.' || lpad((abs(cents) % 100)::VARCHAR, 2, '0') AS "Amount",
         CASE o_orderstatus WHEN 'P' THEN 'Swipe' WHEN 'F' THEN 'Chip' ELSE 'Online' END || ' Transaction' AS "Use Chip",
         'Shop #' || ((o_custkey * 31 + o_orderkey) % 997)::VARCHAR || '-' || (o_orderkey % 7)::VARCHAR || '''s' AS "Merchant Name",
         CASE WHEN o_orderstatus = 'O' THEN 'ONLINE' ELSE 'City ' || (o_custkey % 40)::VARCHAR END AS "Merchant City",
         CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN '' END
              ELSE ['CA', 'NY', ' tx', 'Italy', 'FL', 'ia'][o_orderkey % 6 + 1] END AS "Merchant State",
         CASE WHEN o_orderstatus <> 'O' THEN (o_custkey * 97 % 99999)::VARCHAR || '.0' END AS "Zip",
         CASE WHEN o_orderkey % 50 <> 0 THEN (o_orderkey * 37 % 10500)::INT END AS "MCC",
         CASE WHEN o_orderkey % 97 = 0 THEN 'Yes' ELSE 'No' END AS "Is Fraud?"
  FROM (SELECT *, CASE WHEN o_orderkey % 41 = 0 THEN -2500 WHEN o_orderkey % 5 = 0 THEN o_orderkey % 1500 WHEN o_orderkey % 5 = 1 THEN 900 + o_orderkey * 13 % 6000
                       WHEN o_orderkey % 5 = 2 THEN 5000 + o_orderkey * 17 % 60000 WHEN o_orderkey % 5 = 3 THEN floor(o_totalprice / 2)::BIGINT
                       ELSE floor(o_totalprice * 2)::BIGINT END AS cents FROM orders))"""
AMOUNT = "replace(replace(\"Amount\", '$', ''), ',', '')::DOUBLE"


def industry(code: str, miss: str = "'GENERAL'") -> str:
    return "CASE " + " ".join(f"WHEN {code} BETWEEN {a} AND {z} THEN '{x}'" for a, z, x in INDUSTRIES) + f" ELSE {miss} END"


def bucket(amount: str) -> str:
    b = [*AMOUNT_STEPS, 1000000000]
    return f"CASE WHEN {amount} >= 0 AND {amount} <= 10 THEN '<$10' " + " ".join(f"WHEN {amount} > {x} AND {amount} <= {y} THEN '{n}'" for x, y, n in zip(b, b[1:], AMOUNT_LABELS[1:], strict=False)) + " ELSE 'Unknown' END"


def steps(amount: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {amount} >= {s} THEN 1 ELSE 0 END" for s in AMOUNT_STEPS) + ")"


CLEAN = f"""clean AS (
  SELECT *, greatest(coalesce(date_diff('second', lag(time_full) OVER (PARTITION BY "user", card ORDER BY time_full, row_id), time_full), 0), 0) AS time_delta_s
  FROM (
    SELECT row_id, "User" AS "user", least(greatest("Card", 0), 9)::INT AS card,
           make_timestamp("Year", "Month", "Day", split_part("Time", ':', 1)::INT, split_part("Time", ':', 2)::INT, 0) AS time_full,
           {AMOUNT} AS amount, {steps(AMOUNT)} AS amt_val, regexp_replace(upper("Merchant Name"), '[^A-Z0-9\\s\\-]', '', 'g') AS merch_hash,
           coalesce("MCC", -1) AS mcc_int, coalesce("MCC", -1)::VARCHAR AS mcc_str, split_part("Time", ':', 1)::INT AS hour,
           (isodow(make_date("Year", "Month", "Day")) - 1)::INT AS dow, "Month" AS month, upper("Use Chip") AS chip_upper,
           lpad(substr(replace(coalesce("Zip", '00000'), '.0', ''), 1, 3), 3, '0')::INT AS zip3,
           coalesce(nullif(trim(upper("Merchant State")), ''), 'XX') AS state_clean, least(greatest("User", 0), 2999)::INT AS cust,
           ("Is Fraud?" = 'Yes')::INT AS is_fraud
    FROM txn))"""
CATS, MCCS, CHIP, STATE = [*sorted({x for _, _, x in INDUSTRIES}), "GENERAL"], sorted(map(str, KNOWN_MCCS)), [*sorted(CHIPS.values()), "UNK"], sorted(STATES)
OFFSETS = {"amt_val": 5, "merch_hash": 12, "mcc_int": 2012, "mcc_str": 2026, "hour": 2136, "dow": 2160, "month": 2167, "card": 2179, "chip_upper": 2189, "zip3": 2193, "state_clean": 3193, "cust": 3251}
PARTS = {
    "amt_val": ("AMT_", "amt_val::VARCHAR", "amt_val"),
    "merch_hash": ("MERCH_", "(('0x' || substr(md5(merch_hash), 1, 8))::BIGINT % 2000)::VARCHAR", "('0x' || substr(md5(merch_hash), 1, 8))::BIGINT % 2000"),
    "mcc_int": ("CAT_", industry("mcc_int"), f"list_position({CATS}, {industry('mcc_int')}) - 1"),
    "mcc_str": ("MCC_", f"CASE WHEN list_contains({MCCS}, mcc_str) THEN mcc_str ELSE '-1' END", f"list_position({MCCS}, CASE WHEN list_contains({MCCS}, mcc_str) THEN mcc_str ELSE '-1' END) - 1"),
    "hour": ("HOUR_", "lpad(hour::VARCHAR, 2, '0')", "hour"),
    "dow": ("DOW_", "dow::VARCHAR", "dow"),
    "month": ("MONTH_", "lpad(month::VARCHAR, 2, '0')", "month - 1"),
    "card": ("CARD_", "card::VARCHAR", "card"),
    "chip_upper": ("CHIP_", "CASE chip_upper WHEN 'SWIPE TRANSACTION' THEN 'SWIPE' WHEN 'CHIP TRANSACTION' THEN 'CHIP' WHEN 'ONLINE TRANSACTION' THEN 'ONLINE' ELSE 'UNK' END", None),
    "zip3": ("ZIP3_", "lpad(zip3::VARCHAR, 3, '0')", "zip3"),
    "state_clean": ("STATE_", f"CASE WHEN list_contains({STATE}, state_clean) THEN state_clean ELSE 'XX' END", f"list_position({STATE}, CASE WHEN list_contains({STATE}, state_clean) THEN state_clean ELSE 'XX' END) - 1"),
    "cust": ("CUST_", "cust::VARCHAR", "cust"),
}
PARTS["chip_upper"] = (*PARTS["chip_upper"][:2], f"list_position({CHIP}, {PARTS['chip_upper'][1]}) - 1")
TOKEN = {k: f"'{p}' || {t}" for k, (p, t, _) in PARTS.items()}
TOK = "tok AS (SELECT row_id, " + ", ".join(f"{t} AS {k}" for k, t in TOKEN.items()) + " FROM clean)"
USED = "used AS (SELECT step, token, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS step, {k} AS token FROM tok" for k in PARTS) + ") GROUP BY ALL)"
IDS = "ids AS (SELECT row_id, [" + ", ".join(f"({OFFSETS[k]} + {i})::INT" for k, (_, _, i) in PARTS.items()) + "] AS ids FROM clean)"
LINE = "line AS (SELECT c.row_id, c.\"user\", c.card, c.time_full, concat_ws(' ', " + ", ".join(f"t.{k}" for k in PARTS) + ') AS line, row_number() OVER (PARTITION BY c."user", c.card ORDER BY c.time_full, c.row_id) - 1 AS pos FROM clean c JOIN tok t USING (row_id))'
CORPUS = "corpus AS (SELECT \"user\", card, (pos // 4)::INT AS chunk_id, count(*)::INT AS n_txn, '<bos> ' || string_agg(line, ' <sep> ' ORDER BY pos) || ' <eos>' AS text FROM line GROUP BY ALL)"
NAMES = {
    "amt_val": [str(k) for k in range(7)], "merch_hash": [str(k) for k in range(2000)], "mcc_int": CATS, "mcc_str": MCCS, "hour": [f"{k:02d}" for k in range(24)], "dow": [str(k) for k in range(7)],
    "month": [f"{k:02d}" for k in range(1, 13)], "card": [str(k) for k in range(10)], "chip_upper": CHIP, "zip3": [f"{k:03d}" for k in range(1000)], "state_clean": STATE, "cust": [str(k) for k in range(3000)],
}


def vocab(compatible: bool = False) -> str:
    shift = {"month": 1} if compatible else {}
    parts = ["SELECT unnest(" + str(SPECIALS) + ") AS token, unnest(range(5))::INT AS id, 'special' AS step, unnest(range(5))::INT AS local_id"]
    for k, names in NAMES.items():
        n = len(names)
        parts.append(f"SELECT '{PARTS[k][0]}' || unnest({names}), ({OFFSETS[k] + shift.get(k, 0)} + unnest(range({n})))::INT, '{k}', unnest(range({n}))::INT")
    return "vocab AS (" + " UNION ALL ".join(parts) + ")"


def sql(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


EVENTS = """ev AS (SELECT event_id AS row_id, user_id AS "user", (event_id % 2)::INT AS card, date_trunc('second', ts)::TIMESTAMP AS time_full, value AS amount,
  (event_type = 'error')::INT AS is_fraud, concat_ws('-', event_type, json_extract_string(props, '$.k')) AS merchant FROM events)"""
DATED = 'dated AS (SELECT *, make_date("Year", "Month", "Day") AS date FROM txn)'
CUTS = """daily AS (SELECT date, count(*) AS n FROM dated GROUP BY date), run AS (SELECT date, sum(n) OVER (ORDER BY date) AS run, sum(n) OVER () AS total FROM daily),
cuts AS (SELECT min(CASE WHEN run >= 0.8 * total THEN date END) AS train_end, min(CASE WHEN run >= 0.9 * total THEN date END) AS val_end FROM run)"""
SPLIT = "parts AS (SELECT dated.*, CASE WHEN date < train_end THEN 'train' WHEN date < val_end THEN 'val' ELSE 'test' END AS split FROM dated, cuts)"
