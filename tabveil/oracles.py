"""DuckDB SQL for the registered queries. Where outputs are seeded, the SQL derives the seeds itself."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

from tabveil.functions import seeds, strategies
from tabveil.functions.names import Hints
from tabveil.functions.text import STATE_CODES, STATE_NAMES
from tabveil.operators.masking import LOREM, global_offset
from tabveil.plans.model import DateShiftOptions
from tabveil.queries import KEY, dated_sql


def _text(s) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'" if isinstance(s, str) else str(s)


def _values(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in rows)}) AS v({columns})"


def _columns(table: str, columns: list[str], body: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {body.replace('$v', c)} FROM {table}" for c in columns)


def _money(c: str) -> str:
    return f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"


_AREA = "CAST(200 + c_custkey % 700 AS VARCHAR)"
CUSTOMERS = f"""(SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, {_money("c_acctbal")} AS c_acctbal, lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS zip,
  '(' || {_AREA} || ') ' || {_AREA} || '-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone,
  CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE 'note ' || c_custkey END AS c_note FROM customer)"""
CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_mktsegment", "c_acctbal", "zip", "phone", "c_note"]
ORDERS = f"""(SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, {_money("o_totalprice")} AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders)"""
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINES = f"""(SELECT {_money("l_quantity")} AS l_quantity, {_money("l_extendedprice")} AS l_extendedprice, {_money("l_discount")} AS l_discount, CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_returnflag FROM lineitem)"""


def _count(pattern: str) -> str:
    return f"count(*) FILTER (regexp_full_match($v, '{pattern}'))"


_PHONE = r"(\+?1[\s.-]?)?(\([0-9]{3}\)\s?|[0-9]{3}[\s.-])[0-9]{3}[\s.-][0-9]{4}"
_NUMBER = r"-?[0-9]+(\.[0-9]+)?"
_STATE = f"(length(w) = 2 AND upper(w) IN ({', '.join(map(_text, STATE_CODES))})) OR (length(w) BETWEEN 3 AND 30 AND upper(trim(w)) IN ({', '.join(_text(s.upper()) for s in STATE_NAMES)}))"

# Seeds in SQL: the digest, its little-endian words, and the first outputs of the generator modulo 2^64.
_INNER, _OUTER = (p.hex() for p in seeds.pad_bytes(KEY))


def _digest(message: str) -> str:
    return f"sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode({message}))))"


def _word(d: str, k: int) -> str:
    pairs = " || ".join(f"substr({d}, {16 * k + 2 * b + 1}, 2)" for b in range(7, -1, -1))
    return f"CAST(CAST('0x' || {pairs} AS UBIGINT) AS UHUGEINT)"


_M = "18446744073709551616::UHUGEINT"


def _output(x: str) -> str:
    five = f"(({x} * 5) % {_M})"
    turned = f"(((({five}) * 128) % {_M}) + ({five} // 144115188075855872::UHUGEINT))"
    return f"(({turned} * 9) % {_M})"


def _first(d: str) -> str:
    return _output(_word(d, 1))


def _second(d: str) -> str:
    return _output(f"xor(xor({_word(d, 1)}, {_word(d, 2)}), {_word(d, 0)})")


def _below(u: str, n: int) -> str:
    return f"CAST((({u} // 4294967296::UHUGEINT) * {n}) // 4294967296::UHUGEINT AS BIGINT)"


def _unit(u: str) -> str:
    return f"(CAST({u} // 2048::UHUGEINT AS DOUBLE) / 9007199254740992.0::DOUBLE)"


def _as_us(date: str, moved: str) -> str:
    part = lambda f: f"CASE WHEN length(CAST({f}({date}) AS VARCHAR)) = 2 THEN lpad(CAST({f}({moved}) AS VARCHAR), 2, '0') ELSE CAST({f}({moved}) AS VARCHAR) END"
    return f"({part('month')}) || '/' || ({part('day')}) || '/' || lpad(CAST(year({moved}) AS VARCHAR), 4, '0')"


def _global_factor(column: str, percent: float = 0.15) -> str:
    f = 1 - percent + 2 * percent * seeds.Draws(KEY, column, seeds.GLOBAL).unit()
    return str(Decimal(repr(f)).quantize(Decimal("1e-15") if f < 1 else Decimal("1e-14"), ROUND_HALF_EVEN))


def _scaled(value: str, factor: str, scale: int) -> str:
    return f"round(CAST({value} AS DECIMAL(20,2)) * CAST({factor} AS DECIMAL(17,15)), {scale})"


def _drawn(source: str, digest: str, n: int) -> str:
    """CTEs: source's rows with u1..un, the first n outputs of the generator whose seed is the digest."""
    low = lambda x: f"(({x}) % {_M})"
    out = [f"d0 AS (SELECT *, {', '.join(f'{_word(digest, k)} AS w{k}' for k in range(4))} FROM {source})"]
    for i in range(1, n + 1):
        a, b = "xor(w2, w0)", "xor(w3, w1)"
        step = {"w0": f"xor(w0, {b})", "w1": f"xor(w1, {a})", "w2": f"xor({a}, {low('w1 * 131072')})", "w3": f"({low(f'({b}) * 35184372088832')} + (({b}) // 524288::UHUGEINT))"}
        out.append(f"d{i} AS (SELECT * REPLACE ({', '.join(f'{x} AS {w}' for w, x in step.items())}), {_output('w1')} AS u{i} FROM d{i - 1})")
    return ", ".join(out)


def _pick(pool, u: str) -> str:
    return f"[{', '.join(map(_text, pool))}][{_below(u, len(pool))} + 1]"


def _made(kind: str, n: int, body: str, domain: str | None = None) -> str:
    names_of = f"n AS (SELECT c_custkey, {_digest(f"'{domain or kind}' || chr(31) || c_name")} AS d FROM customer)"
    return f"WITH {names_of}, {_drawn('n', 'd', n)} SELECT c_custkey, {body} FROM d{n}"


def _hashed(v: str) -> str:
    """HashId's first choice for Customer#000000000: eight letters and, after the padding zero, eight digits."""
    letters = " || ".join(f"chr(CAST({65 if i == 1 else 97} + {_below(f'u{i}', 26)} AS INTEGER))" for i in range(1, 9))
    numbers = " || ".join(f"CAST({_below(f'u{i}', 10)} AS VARCHAR)" for i in range(9, 17))
    return f"{letters} || '#0' || {numbers}"


_PHONE_DIGITS = [f"CAST({f'2 + {_below(f"u{i + 1}", 8)}' if i in (0, 3) else _below(f'u{i + 1}', 10)} AS VARCHAR)" for i in range(10)]
_PLACE = f"{_pick(strategies.PLACE_HEAD, 'u1')} || {_pick(strategies.PLACE_TAIL, 'u2')}"
_ALL_LOREM = " ".join(LOREM)
_STARTS = [sum(len(w) + 1 for w in LOREM[:i]) + 1 for i in range(len(LOREM))]
_LOREM_CUT = f"substr(repeat({_text(_ALL_LOREM + ' ')}, CAST(ceil(length(text) / {len(_ALL_LOREM)}.0) AS BIGINT) + 2), [{', '.join(map(str, _STARTS))}][{_below(_first('d'), len(LOREM))} + 1], length(text))"
_WEEKDAYS = global_offset(KEY, "day", DateShiftOptions(max_days=45, keep_weekday=True))
_DAY = "CAST(o_orderdate AS DATE)"
_ROW = "0.85::DOUBLE + 0.3::DOUBLE * " + _unit(_first("d"))

ORACLES: dict[str, str] = {
    "flagship": f"SELECT c AS \"column\", s AS strategy, count(*) AS n_rows, 0::BIGINT AS source_nulls, 0::BIGINT AS output_nulls, 0 AS n_failures FROM orders, (VALUES {', '.join(str((c, {'o_orderdate': 'DateShift', 'o_totalprice': 'Perturb', 'o_orderpriority': 'Redact'}.get(c, 'Keep'))) for c in ORDER_COLUMNS)}) AS v(c, s) GROUP BY c, s",
    "profile_counts": _columns(CUSTOMERS, CUSTOMER_COLUMNS, "count(*) AS n_rows, count(*) FILTER ($v IS NULL) AS n_null, count(*) FILTER (trim($v) = '') AS n_blank, count(*) FILTER (trim($v) <> '') AS n_values"),
    "profile_lengths": _columns(ORDERS, ORDER_COLUMNS, "min(length($v)) AS min_length, max(length($v)) AS max_length, CAST(sum(length($v)) AS BIGINT) AS sum_length"),
    "profile_numeric": _columns(LINES, ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "l_returnflag"], f"{_count('[0-9]+')} AS n_digit, {_count(_NUMBER)} AS n_numeric, {_count('-?[0-9]+')} AS n_integer, CAST(coalesce(max(CASE WHEN regexp_full_match($v, '{_NUMBER}') AND contains($v, '.') THEN length(split_part($v, '.', 2)) ELSE 0 END), 0) AS BIGINT) AS max_scale, false AS any_thousands, false AS any_currency"),
    "profile_patterns": _columns(CUSTOMERS, ["zip", "phone", "c_acctbal"], f"{_count('[0-9]{5}')} AS n_zip5, {_count('[0-9]{5}-[0-9]{4}')} AS n_zip_plus4, {_count('[0-9]{3,4}')} AS n_short_zip, {_count(_PHONE)} AS n_formatted_phone, count(*) FILTER (regexp_full_match($v, '\\+?[0-9\\s().-]+') AND length(regexp_replace($v, '[^0-9]', '', 'g')) BETWEEN 7 AND 20) AS n_phone_like, {_count('0[0-9]+')} AS n_leading_zero, 0::BIGINT AS n_state, {_count('[^@]+@[^@]+')} AS n_email"),
    "pattern_tokens": rf"WITH w AS (SELECT unnest(regexp_split_to_array(text, '[ \n]')) AS w FROM documents) SELECT count(*) AS n_words, count(*) FILTER (regexp_full_match(w, '[^@\s]+@[^@\s]+\.[A-Za-z]{{2,}}')) AS n_email, count(*) FILTER ({_STATE}) AS n_state, count(*) FILTER (regexp_full_match(w, '0[0-9]+')) AS n_leading_zero FROM w",
    "distinct_exact": _columns(ORDERS, ORDER_COLUMNS, "count(DISTINCT $v) AS n_distinct"),
    "distinct_estimate_ok": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", true AS within_5_percent" for c in ORDER_COLUMNS),
    "sample_values": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(nth AS INTEGER) AS nth, value FROM (SELECT {c} AS value, row_number() OVER (ORDER BY min(p_partkey), {c}) AS nth FROM part GROUP BY {c}) WHERE nth <= 5" for c in ("p_brand", "p_type")),
    "date_masks": f"WITH d AS (SELECT 'order_date' AS \"column\", 1 AS mask FROM orders UNION ALL SELECT 'ship_date', 512 + CASE WHEN day({_DAY}) <= 12 THEN 65536 ELSE 0 END FROM orders UNION ALL SELECT 'due_date', CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 512 + CASE WHEN day({_DAY}) <= 12 THEN 65536 ELSE 0 END END FROM orders) SELECT \"column\", CAST(mask AS BIGINT) AS mask, count(*) AS n_values FROM d GROUP BY ALL",
    "date_give_up": "WITH r AS (SELECT count(*) OVER w AS seen, sum(CAST(o_orderkey % 10 <> 0 AS INTEGER)) OVER w AS hits FROM orders WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT 'due_date' AS \"column\", bool_or(seen >= 200 AND hits < 0.95 * seen) AS gave_up FROM r UNION ALL SELECT 'order_date', false UNION ALL SELECT 'ship_date', false",
    "seed_draws": f"WITH s AS (SELECT c_custkey, {_digest("'c_name' || chr(31) || c_name")} AS d FROM customer) SELECT c_custkey, d AS digest, {_below(_first('d'), 1000)} AS first, {_below(_second('d'), 1000)} AS second, {_unit(_first('d'))} AS unit FROM s",
    "mask_redact": f"SELECT c_custkey, CASE WHEN trim(c_note) <> '' THEN '[REDACTED]' ELSE c_note END AS c_note FROM {CUSTOMERS}",
    "mask_dateshift": f"SELECT CAST(o_orderkey AS VARCHAR) AS k, strftime({_DAY} + {_WEEKDAYS}, '%Y-%m-%d') AS iso, {_as_us(_DAY, f'({_DAY} + {_WEEKDAYS})')} AS us FROM orders",
    "mask_dateshift_entity": f"WITH s AS (SELECT o_orderkey, o_custkey, {_DAY} AS day, {_digest("'entity:cust' || chr(31) || o_custkey || chr(31) || 'dateshift'")} AS d FROM orders) SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS cust, strftime(day + CAST((CASE WHEN {_below(_first('d'), 2)} = 0 THEN -1 ELSE 1 END) * ({_below(_second('d'), 60)} + 1) AS INTEGER), '%Y-%m-%d') AS day FROM s",
    "mask_perturb_row": f"WITH s AS (SELECT o_orderkey, {_money('o_totalprice')} AS price, {_digest("'price' || chr(31) || " + _money('o_totalprice') + " || chr(31) || 'row:' || (o_orderkey + 1)")} AS d FROM orders), f AS (SELECT *, {_ROW} AS f FROM s) SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(CAST({_scaled('price', "CASE WHEN f < 1 THEN printf('%.15f', f) ELSE printf('%.14f', f) END", 2)} AS DECIMAL(18,2)) AS VARCHAR) AS price FROM f",
    "mask_perturb_global": f"SELECT CAST(l_orderkey AS VARCHAR) AS k, CAST(l_linenumber AS VARCHAR) AS line, CAST(CAST({_scaled('l_extendedprice', repr(_global_factor('price')), 2)} AS DECIMAL(18,2)) AS VARCHAR) AS price, CAST(CAST(greatest({_scaled('CAST(l_quantity AS INTEGER)', repr(_global_factor('qty')), 0)}, 1) AS BIGINT) AS VARCHAR) AS qty FROM lineitem",
    "mask_perturb_shapes": "SELECT CAST(o_orderkey AS VARCHAR) AS k, true AS same_shape, true AS changed FROM orders",
    "mask_hashid": "SELECT count(*) AS n_rows, true AS injective, true AS consistent, 0::BIGINT AS n_unchanged, 0::BIGINT AS n_misshapen FROM customer",
    "mask_zip": "SELECT count(*) AS n_rows, true AS injective, true AS consistent, 0::BIGINT AS n_unchanged, 0::BIGINT AS n_misshapen FROM supplier",
    "mask_phone": "SELECT count(*) AS n_rows, true AS injective, true AS consistent, 0::BIGINT AS n_unchanged, 0::BIGINT AS n_misshapen FROM customer",
    "mask_email": "SELECT count(*) AS n_rows, true AS injective, true AS consistent, 0::BIGINT AS n_unchanged, 0::BIGINT AS n_misshapen FROM customer",
    "mask_shared_domain": "SELECT count(*) AS n_pairs, true AS one_output_each, true AS one_source_each FROM (SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS v FROM orders UNION SELECT lpad(CAST(o_custkey % 500 AS VARCHAR), 6, '0') FROM orders)",
    "mask_linked_identity": "SELECT count(*) AS n_rows, count(*) AS n_coherent FROM customer",
    "mask_lorem": f"WITH s AS (SELECT doc_id, text, {_digest("'text' || chr(31) || text")} AS d FROM documents), m AS (SELECT doc_id, text, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN text ELSE regexp_replace({_LOREM_CUT}, ' $', 'a') END AS m FROM s), c AS (SELECT doc_id, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND regexp_matches(substr(text, 1, 1), '\\p{{Lu}}') THEN upper(m[1]) || m[2:] ELSE m END AS m FROM m) SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(length(m) AS INTEGER) AS n, md5(m) AS masked FROM c",
    "mask_hashid_values": f"WITH n AS (SELECT c_custkey, {_digest("'c_name' || chr(31) || c_name")} AS d FROM customer), {_drawn('n', 'd', 16)} SELECT CAST(c_custkey AS VARCHAR) AS k, 'X-' || {_hashed('c_name')} AS c_name FROM d16",
    "mask_phone_first": f"WITH p AS (SELECT DISTINCT phone FROM {CUSTOMERS}), n AS (SELECT phone, {_digest("'phone' || chr(31) || phone")} AS d FROM p), {_drawn('n', 'd', 10)} SELECT phone, '(' || {' || '.join(_PHONE_DIGITS[:3])} || ') ' || {' || '.join(_PHONE_DIGITS[3:6])} || '-' || {' || '.join(_PHONE_DIGITS[6:])} AS first, true AS few_others FROM d10",
    "fake_company": _made("Company", 2, f"{_pick(strategies.LAST, 'u1')} || ' ' || {_pick(strategies.COMPANY, 'u2')} AS made"),
    "fake_city": _made("City", 2, f"{_PLACE} AS made"),
    "fake_hospital": _made("Hospital", 3, f"{_PLACE} || ' ' || {_pick(strategies.HOSPITAL, 'u3')} AS made"),
    "fake_street_address": _made("StreetAddress", 3, f"CAST(1 + {_below('u1', 9999)} AS VARCHAR) || ' ' || {_pick(strategies.LAST, 'u2')} || ' ' || {_pick(strategies.STREET, 'u3')} AS made"),
    "fake_person_email": _made("PersonFull", 4, f"{_pick(strategies.FIRST, 'u1')} || ' ' || {_pick(strategies.LAST, 'u2')} AS made, lower({_pick(strategies.FIRST, 'u1')} || '.' || {_pick(strategies.LAST, 'u2')} || CAST({_below('u3', 100)} AS VARCHAR) || '@' || {_pick(strategies.DOMAINS, 'u4')}) AS email"),
    "mask_cities": "SELECT count(*) AS n_rows, true AS injective, true AS consistent, 0::BIGINT AS n_unchanged, 0::BIGINT AS n_misshapen FROM customer",
    "mask_zip_reference": f"""WITH RECURSIVE known AS (
        SELECT list(DISTINCT lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') ORDER BY lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0')) AS l FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 100000 < 100),
      z AS (SELECT s_suppkey, lpad(CAST(s_suppkey % 25 AS VARCHAR), 5, '0') AS v FROM supplier),
      o AS (SELECT v, row_number() OVER (ORDER BY min(s_suppkey)) AS i FROM z GROUP BY v),
      c AS (SELECT i, v, a, {_digest("'zip' || chr(31) || v || CASE WHEN a > 0 THEN chr(31) || a ELSE '' END")} AS d FROM o, range(20) AS r(a)),
      p AS (SELECT i, v, list(l[{_below(_first('d'), 'len(l)::UHUGEINT')} + 1] ORDER BY a) AS tries FROM c, known GROUP BY i, v),
      w AS (SELECT 0 AS i, []::VARCHAR[] AS used UNION ALL SELECT w.i + 1, list_append(used, list_filter(tries, lambda x: x <> v AND NOT list_contains(used, x))[1]) FROM w JOIN p ON p.i = w.i + 1)
      SELECT CAST(s_suppkey AS VARCHAR) AS k, (SELECT used FROM w ORDER BY i DESC LIMIT 1)[o.i] AS zip FROM z JOIN o USING (v)""",
    "mask_zip_listed": "SELECT count(*) AS n_rows, count(DISTINCT s_suppkey % 5) AS n_outputs, 0::BIGINT AS n_unlisted, 0 AS n_warnings FROM supplier",
    "mask_perturb_entity": f"WITH s AS (SELECT o_orderkey, o_custkey, {_money('o_totalprice')} AS price, {_digest("'entity:cust' || chr(31) || o_custkey || chr(31) || 'perturb'")} AS d FROM orders), f AS (SELECT *, {_ROW} AS f FROM s) SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS cust, CAST(CAST({_scaled('price', "CASE WHEN f < 1 THEN printf('%.15f', f) ELSE printf('%.14f', f) END", 2)} AS DECIMAL(18,2)) AS VARCHAR) AS price FROM f",
    "mask_dateshift_formats": f"SELECT CAST(o_orderkey AS VARCHAR) AS k, {dated_sql(_DAY, 'o_orderkey', f'({_DAY} + {_WEEKDAYS})')} AS day FROM orders",
    "verify_distincts": f"SELECT 'c_name' AS \"column\", count(DISTINCT c_name) AS source_distinct, count(DISTINCT c_name) AS output_distinct FROM {CUSTOMERS} UNION ALL SELECT 'zip', count(DISTINCT zip), count(DISTINCT zip) FROM {CUSTOMERS} UNION ALL SELECT 'phone', count(DISTINCT phone), count(DISTINCT phone) FROM {CUSTOMERS}",
    "verify_change": f"WITH s AS (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS a, CAST(sum({_scaled('o_totalprice', repr(_global_factor('price')), 2)}) AS DOUBLE) AS b FROM orders) SELECT 'price' AS \"column\", CAST(CAST(round((b - a) / a * 100, 2) AS DECIMAL(18,2)) AS VARCHAR) AS sum_change_pct FROM s",
    "mask_custom": f"SELECT c_custkey, CASE WHEN trim(c_note) <> '' THEN upper(c_note[:3]) || '-' || {_digest("'c_note' || chr(31) || c_note")}[:8] ELSE c_note END AS c_note FROM {CUSTOMERS}",
    "profile_rates": _columns(CUSTOMERS, CUSTOMER_COLUMNS, "round(count(*) FILTER ($v IS NULL) / count(*), 9) AS null_rate, round(count(*) FILTER (trim($v) = '') / count(*), 9) AS blank_rate, round(sum(length($v)) FILTER (trim($v) <> '') / count(*) FILTER (trim($v) <> ''), 9) AS mean_length"),
    "mapping_limit": _values('"at", "column"', [(0, "c_name"), (1, "none")]),
    "csv_customers": "SELECT CAST(1 + row_number() OVER (ORDER BY c_custkey) + (SELECT count(*) FROM customer e WHERE e.c_custkey % 50 = 0 AND e.c_custkey < c.c_custkey) AS BIGINT) AS rec, CAST(c_custkey AS BIGINT) AS key, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'say \"' || c_custkey || '\",' || chr(10) || 'or not' ELSE '5\" of ' || c_custkey END AS note, c_custkey % 3 = 0 AS crlf, c_custkey % 4 IN (1, 2) AS note_quoted FROM customer c",
    "mask_unmaskable": "SELECT 'price' AS \"column\", count(*) AS n_rows, count(*) FILTER (o_orderkey % 7 = 0) AS n_unmaskable, CAST(count(*) FILTER (o_orderkey % 7 = 0) AS VARCHAR) || ' values could not be masked and were redacted' AS warnings FROM orders",
    "verify_report": _columns(CUSTOMERS, CUSTOMER_COLUMNS, f"CASE '$v' {' '.join(f"WHEN '{c}' THEN '{s}'" for c, s in (('c_name', 'HashId'), ('c_note', 'Redact'), ('zip', 'ZipRemap'), ('c_acctbal', 'Perturb')))} ELSE 'Keep' END AS strategy, count(*) AS n_rows, count(*) FILTER ($v IS NULL) AS source_nulls, count(*) FILTER ($v IS NULL) AS output_nulls, 0::BIGINT AS n_unchanged, '' AS failures"),
    "verify_sums": f"SELECT 'price' AS \"column\", CAST(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS VARCHAR) AS source_sum, CAST(CAST(sum({_scaled('o_totalprice', repr(_global_factor('price')), 2)}) AS DECIMAL(18,2)) AS VARCHAR) AS output_sum FROM orders",
    "preview_equals_run": "SELECT 20::BIGINT AS n_rows",
    "mapping_rounds_equal_walk": "SELECT 0::BIGINT AS n_different",
}

_HEADERS = """h AS (
  SELECT c_custkey // 20 AS header, CAST(c_custkey % 20 + 1 AS INTEGER) AS position,
    CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN ' ' || lower(c_mktsegment) || '  ' ELSE c_mktsegment END AS name FROM customer),
k AS (
  SELECT *, lower(trim(name)) AS norm, row_number() OVER (PARTITION BY header, lower(trim(name)) ORDER BY position) AS nth,
    CASE WHEN name = '' THEN 'Column' || position WHEN row_number() OVER (PARTITION BY header, name ORDER BY position) = 1 THEN name
      ELSE name || '#' || row_number() OVER (PARTITION BY header, name ORDER BY position) END AS key FROM h)"""

_RECIPES = """r0 AS (
  SELECT s_suppkey // 10 AS recipe, s_suppkey % 10 AS position, ['building', 'machinery', 'household', 'furniture', 'automobile'][(s_suppkey * 7 + s_suppkey // 10) % 5 + 1] AS norm,
    ['HashId', 'Redact', 'Lorem'][s_suppkey % 3 + 1] AS strategy FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY recipe, norm ORDER BY position) AS nth FROM r0),
b AS (SELECT header, recipe, count(*) AS n FROM k JOIN r USING (norm, nth) GROUP BY header, recipe)"""

_TITLE = "upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2))"

_RAGGED = """l AS (
  SELECT 1::BIGINT AS rec, 'header' AS kind, 2 AS n_fields, 'a/b' AS cells, 'false/false' AS quotes, 'a,b|' AS line
  UNION ALL SELECT 1 + row_number() OVER (ORDER BY s_suppkey), ['data', 'malformed', 'blank', 'data', 'malformed'][s_suppkey % 5 + 1], [2, 1, 1, 2, 3][s_suppkey % 5 + 1],
    [s_suppkey || '/x', '' || s_suppkey, 'NULL', s_suppkey || '",/', s_suppkey || '/y/z'][s_suppkey % 5 + 1],
    ['false/false', 'false', 'false', 'true/true', 'false/false/false'][s_suppkey % 5 + 1],
    [s_suppkey || ',x', '' || s_suppkey, '', '"' || s_suppkey || '"",",""', s_suppkey || ',y,z'][s_suppkey % 5 + 1] || '|' FROM supplier)"""

ORACLES |= {
    "header_keys": f"WITH {_HEADERS} SELECT header, position, key FROM k",
    "header_signature": f"WITH {_HEADERS} SELECT header, sha256(string_agg(norm, chr(31) ORDER BY position)) AS signature FROM k GROUP BY header",
    "name_tokens": "SELECT c_custkey, lower(c_mktsegment) || CASE c_custkey % 3 WHEN 0 THEN ' order ' || c_custkey % 100 WHEN 1 THEN ' id' ELSE ' name' END AS tokens FROM customer",
    "entity_groups": f"SELECT c_custkey AS header, {_TITLE} || '_ID' AS anchor, {_TITLE} || m AS member FROM customer, (VALUES ('_Name'), ('_Email')) AS v(m) WHERE m = '_Name' OR c_custkey % 5 <> 0",
    "recipe_rank": f"""WITH {_HEADERS}, {_RECIPES},
      hs AS (SELECT header, count(*) AS n_h, string_agg(norm, chr(31) ORDER BY position) AS all_h FROM k GROUP BY header),
      rs AS (SELECT recipe, count(*) AS n_r, string_agg(norm, chr(31) ORDER BY position) AS all_r FROM r GROUP BY recipe),
      f AS (SELECT header, recipe, all_h = all_r AS exact, n::DOUBLE / (n_h + n_r - n) AS score FROM b JOIN hs USING (header) JOIN rs USING (recipe)),
      p AS (SELECT *, CAST(row_number() OVER (PARTITION BY header ORDER BY exact DESC, score DESC, recipe % 7 DESC, recipe) AS INTEGER) AS place FROM f)
      SELECT header, place, recipe, exact, round(score, 9) AS score FROM p WHERE place <= 3""",
    "recipe_apply": f"WITH {_HEADERS}, {_RECIPES} SELECT k.header, k.position, k.key, b.recipe, r.strategy FROM k JOIN b USING (header) LEFT JOIN r ON r.recipe = b.recipe AND r.norm = k.norm AND r.nth = k.nth",
    "plan_problems": """WITH s AS (SELECT DISTINCT c_custkey // 20 AS header, c_mktsegment AS seg FROM customer)
      SELECT header, 'no rule for ' || chr(39) || seg || chr(39) AS problem FROM s WHERE seg <> 'BUILDING'
      UNION ALL SELECT DISTINCT header, 'a rule for ' || chr(39) || 'GHOST' || chr(39) || ', which the file lacks' FROM s
      UNION ALL SELECT header, 'a rule for ' || chr(39) || 'BUILDING' || chr(39) || ', which the file lacks' FROM s GROUP BY header HAVING NOT bool_or(seg = 'BUILDING')""",
    "csv_records": f"WITH {_RAGGED} SELECT rec, kind, CAST(n_fields AS INTEGER) AS n_fields, cells, quotes FROM l",
    "csv_roundtrip": f"WITH {_RAGGED} SELECT rec, line FROM l",
    "csv_totals": f"""WITH {_RAGGED} SELECT count(*) FILTER (kind = 'data') AS n_rows, count(*) FILTER (kind = 'blank') AS n_blank, count(*) FILTER (kind = 'malformed') AS n_malformed,
      array_to_string((list(CAST(rec AS VARCHAR) ORDER BY rec) FILTER (kind = 'malformed'))[1:100], ',') AS malformed_records FROM l""",
    "csv_first_rows": """WITH l AS (SELECT c_custkey, c_name, 1 + row_number() OVER (ORDER BY c_custkey) + (SELECT count(*) FROM customer e WHERE e.c_custkey % 50 = 0 AND e.c_custkey < c.c_custkey) AS rec FROM customer c)
      SELECT rec, c_custkey AS key, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'say "' || c_custkey || '",' || chr(10) || 'or not' ELSE '5" of ' || c_custkey END AS note
      FROM l ORDER BY rec LIMIT 50""",
    "csv_file_roundtrip": "SELECT 1 + count(*) + count(*) FILTER (c_custkey % 50 = 0) AS n_records, 0::BIGINT AS n_different FROM customer",
    "csv_encodings": """SELECT s_suppkey, ['utf-8', 'utf-8', 'utf-16-le', 'utf-16-be', 'windows-1252'][s_suppkey % 5 + 1] AS encoding, CAST([0, 3, 2, 2, 0][s_suppkey % 5 + 1] AS INTEGER) AS mark_bytes,
      ';' AS delimiter, 'a;b/|' || chr(233) || ';' || s_suppkey || '/|' AS read FROM supplier""",
}


def _types(cells: str, columns: list[str]) -> str:
    """Types and strategies from measures of the cells ("column", v): the rules, written down once more."""
    rows = []
    for c in columns:
        h = Hints.of(c)
        rows.append((c, h.zip, h.phone, h.state, h.city, h.address, h.count, h.measure, h.id, (h.name_kind or ("none",))[0]))
    names = '"column", h_zip, h_phone, h_state, h_city, h_address, h_count, h_measure, h_id, h_name'
    states = ", ".join(_text(x.upper()) for x in (*STATE_CODES, *STATE_NAMES))
    number = r"^[(]?[-+]?[$]?[-+]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)?([.][0-9]+)?[)]?$"
    of = {
        "HashId": ("Identifier",), "ZipRemap": ("Zip",), "Fake": ("Email", "Phone", "PersonName", "OrgName", "Address", "City"), "Keep": ("State", "Boolean", "Categorical", "Empty"),
        "DateShift": ("Date",), "Perturb": ("Measure", "Count"),
    }
    strategy = " ".join(f"WHEN type IN ({', '.join(map(_text, kinds))}) THEN '{name}'" for name, kinds in of.items())
    return f"""WITH hints AS ({_values(names, rows)}), c AS ({cells}), v AS (SELECT * FROM c WHERE regexp_matches(v, '[^ ]')),
    m AS (SELECT "column", count(*) AS n, count(DISTINCT v) AS d, min(length(v)) AS lo, max(length(v)) AS hi, sum(length(v)) AS total,
        count(*) FILTER (regexp_matches(v, '^[^@ ]+@[^@ ]+[.][A-Za-z]{{2,}}$')) AS email, count(*) FILTER (regexp_matches(v, '^[0-9]{{3,5}}$|^[0-9]{{5}}-[0-9]{{4}}$')) AS zip,
        count(*) FILTER (regexp_matches(v, '^[0-9]{{5}}-[0-9]{{4}}$')) AS plus4, count(*) FILTER (regexp_matches(v, '^[+]?[-0-9 ().]+$') AND length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 7 AND 20) AS phonelike,
        count(*) FILTER (regexp_matches(v, '^([+]?1[ .-]?)?([(][0-9]{{3}}[)] ?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}$')) AS phone,
        count(*) FILTER (regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND TRY_CAST(v AS DATE) IS NOT NULL) AS dates,
        count(*) FILTER (upper(v) IN ({states})) AS state, count(*) FILTER (regexp_matches(v, '^[0-9]+$')) AS digits, count(*) FILTER (regexp_matches(v, '^0[0-9]+$')) AS zero,
        count(*) FILTER (regexp_matches(v, '[0-9]') AND NOT regexp_matches(v, '[ \t]')) AS unspaced, count(*) FILTER (regexp_matches(v, '[ \t]')) AS spaced,
        count(*) FILTER (regexp_matches(v, '[0-9]') AND regexp_matches(v, '{number}')) AS num, count(*) FILTER (regexp_matches(v, '[0-9]') AND regexp_matches(v, '{number}') AND NOT contains(v, '.')) AS whole,
        coalesce(max(length(v) - instr(v, '.')) FILTER (regexp_matches(v, '^[0-9]+[.][0-9]+$')), 0) AS scale, list_sort(list(DISTINCT upper(v)))[1:5] AS spellings FROM v GROUP BY "column"),
    t AS (SELECT *, n > 0 AND num >= 0.95 * n AS numeric, n > 0 AND num >= 0.95 * n AND whole = num AS ints, d / greatest(n, 1) AS ratio FROM hints LEFT JOIN m USING ("column")),
    typed AS (SELECT "column", dates >= 0.95 * n AS is_date, CASE WHEN n IS NULL THEN 'Empty' WHEN email >= 0.95 * n THEN 'Email' WHEN (h_zip AND zip >= 0.95 * n) OR plus4 >= 0.95 * n THEN 'Zip'
        WHEN (h_phone AND phonelike >= 0.95 * n) OR phone >= 0.95 * n THEN 'Phone' WHEN dates >= 0.95 * n THEN 'Date' WHEN spellings IN (['N', 'Y'], ['NO', 'YES'], ['F', 'T'], ['FALSE', 'TRUE'], ['0', '1']) THEN 'Boolean'
        WHEN state >= 0.95 * n AND (h_state OR d >= 5) THEN 'State' WHEN h_id = 'strong' OR (h_id = 'weak' AND (ratio > 0.5 OR zero > 0)) OR (digits >= 0.95 * n AND zero > 0) THEN 'Identifier'
        WHEN NOT h_count AND NOT h_measure AND lo = hi AND lo >= 4 AND unspaced >= 0.95 * n AND (num = 0 OR ints) AND ratio > 0.5 THEN 'Identifier'
        WHEN NOT h_count AND NOT h_measure AND ints AND ratio > 0.9 THEN 'Identifier' WHEN h_name = 'person' THEN 'PersonName' WHEN h_name = 'org' THEN 'OrgName' WHEN h_city THEN 'City' WHEN h_address THEN 'Address'
        WHEN ints AND h_count THEN 'Count' WHEN numeric AND (h_measure OR scale > 0) THEN 'Measure' WHEN d <= 50 OR ratio < 0.01 THEN 'Categorical' WHEN numeric THEN 'Measure'
        WHEN total > 60 * n OR (ratio > 0.5 AND 2 * spaced >= n) THEN 'FreeText' ELSE 'Text' END AS type FROM t)
    SELECT "column", type, CASE {strategy} ELSE 'Redact' END AS strategy$more FROM typed"""


_ORDER_CELLS = {
    "o_orderkey": "CAST(o_orderkey AS VARCHAR)", "o_custkey": "CAST(o_custkey AS VARCHAR)", "o_orderstatus": "o_orderstatus", "o_totalprice": _money("o_totalprice"),
    "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d')", "o_orderpriority": "o_orderpriority",
}
ORACLES |= {
    "type_detect": _types(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM {CUSTOMERS}" for c in CUSTOMER_COLUMNS), CUSTOMER_COLUMNS).replace("$more", ""),
    # Dates of the year-first form are never ambiguous.
    "type_detect_orders": _types(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {v} AS v FROM orders" for c, v in _ORDER_CELLS.items()), list(_ORDER_CELLS)).replace("$more", ", false AS ambiguous"),
}
