"""The same queries as DuckDB SQL, written on long rows (one per character) instead of arrays."""

from __future__ import annotations

from glyphmill.functions import constants as C
from glyphmill.plans.fixtures import CODE_SWAP, DATE_SWAP, LETTERS, PIN_SWAP

_LETTER = [f"substr('{LETTERS}', CAST((p_partkey * {2 * i + 3} + {5 * i}) % 26 + 1 AS INT), 1)" for i in range(3)]
_PREFIX = f"{_LETTER[0]} || {_LETTER[1]} || CASE WHEN p_partkey % 2 = 1 THEN {_LETTER[2]} ELSE '' END"
_CASE = lambda pairs, default: " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs) + f" ELSE {default} END"

FIELDS = f"""
texts AS (
  SELECT 'date' AS field_type, o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%d-%m-%Y') END AS ground_truth FROM orders
  UNION ALL SELECT 'pin', c_custkey, CAST(100000 + (c_custkey * 7919) % 900000 AS VARCHAR) FROM customer
  UNION ALL SELECT 'code', p_partkey, {_PREFIX} || '-' || CAST(1000 + (p_partkey * 37) % 9000 AS VARCHAR) FROM part),
fields AS (SELECT *, id % 2 = 0 AS is_comb_box, CAST(length(ground_truth) AS INT) AS num_chars FROM texts)"""

CHARS = (
    FIELDS
    + f""",
marked AS (SELECT field_type, id, ground_truth, num_chars, CAST(pos AS INT) AS pos, substr(ground_truth, CAST(pos AS INT) + 1, 1) AS truth, (id * 31 + pos * 17) % 23 AS h FROM fields, LATERAL (SELECT unnest(range(num_chars)) AS pos)),
swaps AS (SELECT *, CASE field_type WHEN 'date' THEN translate(truth, '{DATE_SWAP[0]}', '{DATE_SWAP[1]}') WHEN 'pin' THEN translate(truth, '{PIN_SWAP[0]}', '{PIN_SWAP[1]}') ELSE translate(truth, '{CODE_SWAP[0]}', '{CODE_SWAP[1]}') END AS other FROM marked),
read_chars AS (SELECT *, CASE h WHEN 0 THEN other WHEN 11 THEN 'Z' ELSE truth END AS ch, CASE h WHEN 0 THEN 0.55::DOUBLE WHEN 5 THEN 0.82::DOUBLE WHEN 11 THEN 0.45::DOUBLE ELSE 0.99::DOUBLE END AS conf FROM swaps),
chars AS (SELECT *, regexp_full_match(ch, '[0-9]') AS is_digit, regexp_full_match(ch, '[A-Za-z]') AS is_letter,
  CASE WHEN h = 0 THEN CASE WHEN regexp_full_match(truth, '[0-9]') THEN truth ELSE '1' END END AS digit_alt,
  CASE WHEN h = 0 THEN CASE WHEN regexp_full_match(truth, '[A-Za-z]') THEN truth ELSE 'A' END END AS letter_alt FROM read_chars)"""
)

_TENS = lambda allowed: f"CASE WHEN h = 0 AND regexp_full_match(truth, '[{allowed}]') THEN truth ELSE '1' END"
DATES = (
    CHARS
    + f""",
seps AS (SELECT id, CASE WHEN bool_or(pos IN (2, 5) AND ch = '/') THEN '/' ELSE '-' END AS sep FROM chars WHERE field_type = 'date' GROUP BY id),
snapped AS (SELECT c.*, sep, lead(ch) OVER (PARTITION BY c.id ORDER BY pos) AS next_ch, CASE WHEN is_digit THEN ch ELSE coalesce(digit_alt, CASE ch {_CASE(C.DIGIT_FOR.items(), "'0'")}) END AS d FROM chars c JOIN seps USING (id) WHERE field_type = 'date'),
tens AS (SELECT *, CASE WHEN pos = 3 AND d NOT IN ('0', '1') THEN {_TENS("01")} WHEN pos = 0 AND d NOT IN ('0', '1', '2', '3') THEN {_TENS("0123")} ELSE d END AS t FROM snapped),
settled AS (SELECT *, CASE WHEN pos IN (2, 5) THEN sep
  WHEN pos = 6 THEN CASE WHEN d = '9' AND next_ch = '0' THEN '2' WHEN d IN ('9', '2') AND next_ch IN ('7', '8', '9') THEN '1' WHEN d = '9' THEN CASE WHEN next_ch IN ('0', '1', '2') THEN '2' ELSE '1' END ELSE d END
  WHEN pos = 3 AND t = '0' AND next_ch = '0' THEN '1' ELSE t END AS final FROM tens),
date_text AS (SELECT id, any_value(ground_truth) AS ground_truth, string_agg(final, '' ORDER BY pos) AS text FROM settled GROUP BY id),
dates AS (SELECT *, CASE WHEN valid THEN {C.DATE_VALID}::DOUBLE ELSE {C.DATE_INVALID}::DOUBLE END AS fsm_conf FROM (
  SELECT *, CAST(substr(text, 1, 2) AS INT) BETWEEN 1 AND 31 AND CAST(substr(text, 4, 2) AS INT) BETWEEN 1 AND 12 AND CAST(substr(text, 7, 4) AS INT) BETWEEN 1900 AND 2099 AS valid FROM date_text))"""
)

_AFFINITY = "affinity(a, b, s) AS (VALUES " + ", ".join(f"('{a}', '{b}', {s}::DOUBLE)" for a, b, s in C.affinity_rows()) + ")"
LEXICON = f"""
pin_lexicon AS (SELECT DISTINCT CAST(100000 + (s_suppkey * 5 * 7919) % 900000 + s_suppkey % 2 AS VARCHAR) AS entry FROM supplier),
code_lexicon AS (SELECT {_PREFIX} AS prefix, max({_PREFIX} || '-' || CAST(1000 + (p_partkey * 37) % 9000 + p_partkey % 2 AS VARCHAR)) AS entry FROM part WHERE p_partkey % 7 = 0 GROUP BY 1)"""


def _snap(name: str, lattice: str, entries: str, length: str, mismatch: float) -> str:
    """Best entry of every row of a lattice (id, pos, top, p, a1, p1, a2, p2) by a long join."""
    return f"""
{name} AS (SELECT id, score, entry FROM (
  SELECT id, e.entry, round(sum(CASE WHEN substr(e.entry, pos + 1, 1) = top THEN ln(greatest(p, {C.LEAST_PROBABILITY})) WHEN substr(e.entry, pos + 1, 1) = a1 THEN ln(greatest(p1, {C.LEAST_PROBABILITY})) WHEN substr(e.entry, pos + 1, 1) = a2 THEN ln(greatest(p2, {C.LEAST_PROBABILITY})) ELSE coalesce(s, {mismatch}) END), 6) AS score
  FROM {lattice} l JOIN {entries} e ON {length} LEFT JOIN affinity ON a = top AND b = substr(e.entry, pos + 1, 1) GROUP BY id, e.entry)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, entry) = 1)"""


PINS = (
    CHARS
    + ","
    + _AFFINITY
    + ","
    + LEXICON
    + f""",
pin_cells AS (SELECT id, pos, ground_truth, CASE WHEN is_digit THEN ch ELSE coalesce(digit_alt, '0') END AS top, conf AS p, digit_alt AS a1, CASE WHEN regexp_full_match(truth, '[0-9]') THEN 0.40 ELSE 0.03 END AS p1, CASE WHEN h = 0 AND truth <> '1' THEN '1' END AS a2, 0.03 AS p2 FROM chars WHERE field_type = 'pin' AND pos < 6),
pin_raw AS (SELECT id, any_value(ground_truth) AS ground_truth, string_agg(top, '' ORDER BY pos) AS raw, min(p) AS least FROM pin_cells GROUP BY id),
pin_missed AS (SELECT c.* FROM pin_cells c JOIN pin_raw USING (id) WHERE raw NOT IN (SELECT entry FROM pin_lexicon)),"""
    + _snap("pin_near", "pin_missed", "pin_lexicon", "true", C.PIN_MISMATCH)
    + f""",
pins AS (SELECT id, ground_truth, raw, coalesce(entry, raw) AS text, CASE WHEN entry IS NULL THEN least WHEN score > {C.PIN_FLOOR} THEN {C.PIN_SNAPPED}::DOUBLE ELSE {C.PIN_FAR}::DOUBLE END AS fsm_conf, coalesce(score > {C.PIN_FLOOR}, true) AS valid, score FROM pin_raw LEFT JOIN pin_near USING (id))"""
)

CODES = (
    CHARS
    + ","
    + _AFFINITY
    + ","
    + LEXICON
    + """,
code_cells AS (SELECT *, CASE WHEN num_chars <= 7 THEN 2 ELSE 3 END AS split FROM chars WHERE field_type = 'code'),
prefix_cells AS (SELECT id, pos, split, upper(CASE WHEN is_letter THEN ch ELSE coalesce(letter_alt, 'A') END) AS top, conf AS p, letter_alt AS a1, CASE WHEN regexp_full_match(truth, '[A-Za-z]') THEN 0.40 ELSE 0.01 END AS p1, CASE WHEN h = 0 AND truth <> 'A' THEN 'A' END AS a2, 0.01 AS p2 FROM code_cells WHERE pos < split),
code_raw AS (SELECT id, any_value(ground_truth) AS ground_truth, any_value(split) AS split, string_agg(CASE WHEN pos > split THEN CASE WHEN is_digit THEN ch ELSE coalesce(digit_alt, '0') END ELSE '' END, '' ORDER BY pos) AS suffix FROM code_cells GROUP BY id),
prefix_raw AS (SELECT id, string_agg(top, '' ORDER BY pos) AS raw FROM prefix_cells GROUP BY id),
prefixes AS (SELECT prefix AS entry FROM code_lexicon),
prefix_missed AS (SELECT c.* FROM prefix_cells c JOIN prefix_raw USING (id) WHERE raw NOT IN (SELECT entry FROM prefixes)),"""
    + _snap("prefix_near", "prefix_missed", "prefixes", "length(e.entry) = l.split", C.PREFIX_MISMATCH)
    + f""",
codes AS (SELECT id, ground_truth, raw, coalesce(n.entry, raw) || '-' || suffix AS text, coalesce(x.entry, y.entry, raw || '-' || suffix) AS registered, CASE WHEN x.entry IS NOT NULL THEN {C.CODE_EXACT}::DOUBLE WHEN n.entry IS NOT NULL THEN {C.CODE_SNAPPED}::DOUBLE ELSE {C.CODE_FALLBACK}::DOUBLE END AS fsm_conf, true AS valid, score
  FROM code_raw JOIN prefix_raw USING (id) LEFT JOIN prefix_near n USING (id) LEFT JOIN code_lexicon x ON x.prefix = raw LEFT JOIN code_lexicon y ON y.prefix = n.entry)"""
)

LARGE_PINS = (
    PINS[: PINS.index("pin_missed AS")]
    + f"""
large AS (SELECT DISTINCT lpad(CAST(((l_orderkey * 7 + l_linenumber) * 7919) % 1000000 AS VARCHAR), 6, '0') AS entry FROM lineitem),
coded AS (SELECT entry, {", ".join(f"CAST(substr(entry, {k + 1}, 1) AS INT) + {10 * k + 1} AS d{k}" for k in range(6))} FROM large),
cell_costs AS (SELECT id, list(CASE WHEN d = top THEN ln(greatest(p, {C.LEAST_PROBABILITY})) WHEN d = a1 THEN ln(greatest(p1, {C.LEAST_PROBABILITY})) WHEN d = a2 THEN ln(greatest(p2, {C.LEAST_PROBABILITY})) ELSE coalesce(s, {C.PIN_MISMATCH}) END ORDER BY pos, d) AS c
  FROM pin_cells JOIN (SELECT CAST(unnest(range(10)) AS VARCHAR) AS d) ON true LEFT JOIN affinity ON a = top AND b = d WHERE id IN (SELECT id FROM pin_raw WHERE raw NOT IN (SELECT entry FROM large)) GROUP BY id),
large_near AS (SELECT id, max(score) AS score, arg_min(entry, (-score, entry)) AS entry FROM (SELECT id, entry, round({" + ".join(f"c[d{k}]" for k in range(6))}, 6) AS score FROM cell_costs, coded) GROUP BY id)"""
)
_BASE = CHARS
_TAIL = lambda whole: whole[len(CHARS) :]
DECODED = (
    CHARS
    + _TAIL(DATES)
    + _TAIL(PINS)
    + _TAIL(CODES)[len("," + _AFFINITY + "," + LEXICON) :]
    + """,
decoded AS (SELECT 'date' AS field_type, id, ground_truth, text, fsm_conf, valid FROM dates UNION ALL SELECT 'pin', id, ground_truth, text, fsm_conf, valid FROM pins UNION ALL SELECT 'code', id, ground_truth, text, fsm_conf, valid FROM codes),
read_text AS (SELECT field_type, id, string_agg(ch, '' ORDER BY pos) AS raw_text, min(conf) AS least, sum(conf) AS total, count(*) AS n FROM chars GROUP BY field_type, id)"""
)
# after decoding, dates are digits with separators, PINs digits and codes of the expected shape, so that the repair
# changes only what is out of the calendar
VERIFIED = (
    DECODED
    + f""",
day_fixed AS (SELECT *, CASE WHEN field_type = 'date' AND substr(text, 1, 2) > '31' THEN '2' || substr(text, 2) ELSE text END AS t1 FROM decoded),
verified AS (SELECT field_type, id, ground_truth, text, fsm_conf, valid, CASE WHEN field_type = 'date' AND substr(t1, 4, 2) > '12' THEN substr(t1, 1, 3) || '0' || substr(t1, 5) ELSE t1 END AS verified_text,
  CASE field_type WHEN 'date' THEN {C.VERIFIED["date"]}::DOUBLE WHEN 'code' THEN {C.VERIFIED["code"]}::DOUBLE ELSE {C.VERIFIED["pin"]}::DOUBLE END AS sem_conf FROM day_fixed)"""
)
PREDICTIONS = (
    VERIFIED
    + f""",
predictions AS (
  SELECT field_type, id, ground_truth, 'raw_cnn' AS mode, raw_text AS text, least AS conf, true AS syntax_valid, raw_text, total / n AS mean_conf FROM verified JOIN read_text USING (field_type, id)
  UNION ALL SELECT field_type, id, ground_truth, 'grammar_fsm', text, fsm_conf, valid, raw_text, total / n FROM verified JOIN read_text USING (field_type, id)
  UNION ALL SELECT field_type, id, ground_truth, 'tri_engine', verified_text, CASE WHEN fsm_conf < {C.FUSION_BOUND} THEN least(fsm_conf, sem_conf) ELSE sem_conf END, true, raw_text, total / n FROM verified JOIN read_text USING (field_type, id)),
compared AS (SELECT *, pos, substr(text, CAST(pos AS INT), 1) AS p, substr(ground_truth, CAST(pos AS INT), 1) AS t FROM predictions, LATERAL (SELECT unnest(range(1, least(length(text), length(ground_truth)) + 1)) AS pos))"""
)
# the same chain on readings that are cut short, of fields whose kind may be missing; absent characters have defaults
_KEPT = "CASE WHEN id % 13 = 5 THEN 0 WHEN id % 3 = 0 THEN num_chars ELSE CAST(id % (num_chars + 1) AS INT) END"
ODD = (
    DECODED[: DECODED.index("decoded AS (")]
    .replace("\nchars AS (", "\nall_chars AS (")
    .replace(",\nseps AS (SELECT id", f""",
chars AS (SELECT * REPLACE (CASE WHEN id % 11 IN (4, 7) THEN 'other' ELSE field_type END AS field_type, {_KEPT} AS num_chars) FROM all_chars WHERE pos < {_KEPT}),
seps AS (SELECT id""")
    .replace("ch = '/')", "ch = '/') OR count(*) < 6")
    .replace("lead(ch) OVER (PARTITION BY c.id ORDER BY pos)", "coalesce(lead(ch) OVER (PARTITION BY c.id ORDER BY pos), '0')")
    .replace("CAST(substr(text", "TRY_CAST(substr(text")
    + f"""
odd AS (SELECT field_type AS source, id, CASE WHEN id % 11 = 4 THEN NULL WHEN id % 11 = 7 THEN 'name' ELSE field_type END AS field_type, {_KEPT} AS n FROM fields),
as_read AS (SELECT source, id, string_agg(ch, '' ORDER BY pos) AS raw_text, min(conf) AS least FROM (SELECT a.field_type AS source, a.* FROM all_chars a WHERE pos < {_KEPT}) GROUP BY 1, 2),
odd_decoded AS (
  SELECT source, id, o.field_type, coalesce(text, '') AS text, CASE WHEN coalesce(valid, false) THEN {C.DATE_VALID}::DOUBLE ELSE {C.DATE_INVALID}::DOUBLE END AS fsm_conf, coalesce(valid, false) AS valid FROM odd o LEFT JOIN dates USING (id) WHERE o.field_type = 'date'
  UNION ALL SELECT source, id, o.field_type, coalesce(text, ''), CASE WHEN n < 6 THEN {C.PIN_FAR}::DOUBLE ELSE fsm_conf END, n = 6 AND valid FROM odd o LEFT JOIN pins USING (id) WHERE o.field_type = 'pin'
  UNION ALL SELECT source, id, o.field_type, coalesce(text, ''), CASE WHEN n <= CASE WHEN n <= 7 THEN 2 ELSE 3 END + 1 THEN {C.PIN_FAR}::DOUBLE ELSE fsm_conf END, n > CASE WHEN n <= 7 THEN 2 ELSE 3 END + 1 FROM odd o LEFT JOIN codes USING (id) WHERE o.field_type = 'code'
  UNION ALL SELECT source, id, o.field_type, coalesce(raw_text, ''), coalesce(least, 0.0), true FROM odd o LEFT JOIN as_read USING (source, id) WHERE o.field_type IS NULL OR o.field_type = 'name')"""
)
LOG = """
log AS (SELECT event_id, ts, CASE event_type WHEN 'signup' THEN 'CORRECT' WHEN 'error' THEN 'REJECT' ELSE 'ACCEPT' END AS action, CASE user_id % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'pin' WHEN 2 THEN 'code' END AS field_type, 'v' || user_id AS verified_text, value AS latency_s, CASE WHEN event_type = 'error' THEN 'unreadable' END AS notes, CASE WHEN event_id % 3 = 0 THEN 'FLAGGED' ELSE 'APPROVED' END AS status FROM events)"""
PIXELS = """
images AS (SELECT CAST(s_suppkey AS BIGINT) AS img_id, CASE WHEN s_suppkey % 2 = 0 THEN 5 ELSE 12 END AS cells FROM supplier),
grid AS (SELECT img_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM images, range(40) a(y), range(40) b(x)),
pixels AS (SELECT *, CAST(CASE WHEN img_id % 7 <> 0 AND y BETWEEN 3 AND 36 AND x BETWEEN 3 AND 36 AND (y = 30 OR (img_id % 3 = 1 AND x IN (5, 33)) OR (img_id % 3 = 2 AND x = 12) OR (x * 7 + y * 13 + img_id * 5) % 11 < 3) THEN (x * 3 + y * 5 + img_id) % 200 ELSE 255 - (x + y) % 40 END AS INT) AS v FROM grid),
ink AS (SELECT * FROM pixels WHERE v <= 210)"""
BOXES = """
boxes AS (SELECT *, least(w * h, greatest(w, h) + part % 4) AS area FROM (SELECT l_orderkey AS img_id, CAST(l_linenumber AS INT) AS seq, CAST(l_linenumber * 22 + l_partkey % 9 - 22 AS INT) AS x, CAST((l_partkey * 5) % 39 AS INT) AS y, CAST(2 + l_partkey % 23 AS INT) AS w, CAST(1 + l_partkey % 31 AS INT) AS h, l_partkey AS part FROM lineitem))"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()} {select}"


def runs(along: str, across: str, least: int) -> str:
    return f"(SELECT img_id, y, x, v FROM (SELECT *, count(*) OVER (PARTITION BY img_id, {across}, g) AS n FROM (SELECT *, {along} - row_number() OVER (PARTITION BY img_id, {across} ORDER BY {along}) AS g FROM ink)) WHERE n >= {least})"
