"""Registered queries of the field operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import constants as C
from glyphmill.functions.chars import field_kind, least_confidence, mean_confidence, raw_text
from glyphmill.functions.session import fresh_path
from glyphmill.operators import audit, catalog, decode, evaluate, fields, glyphs, modes, network, recognize, regions, segment, training, verify
from glyphmill.plans import fixtures, oracles
from glyphmill.plans.fixtures import KEYS
from glyphmill.plans.oracles import with_
from glyphmill.sources import documents, files
from glyphmill.sources.audit_log import AuditLog
from glyphmill.sources.field_store import FieldStore
from glyphmill.sources.text_index import TextIndex
from glyphmill.streaming import history_stream
from glyphmill.streaming.audit_stream import read_log_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _predictions(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    return modes.read_fields(fixtures.hypotheses(spark, sf_dir), fixtures.lexicon(spark, sf_dir), modes=wanted or C.MODES)


def _of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return fixtures.hypotheses(spark, sf_dir).where(F.col("field_type") == kind)


# --- fields, filters, projections -------------------------------------------------------------------------------


@query(with_(oracles.FIELDS, "SELECT field_type, is_comb_box, count(*) AS n, sum(num_chars)::BIGINT AS chars FROM fields GROUP BY 1, 2"))
def t2_generated_fields(spark, sf_dir):
    return fixtures.form_fields(spark, sf_dir).groupBy("field_type", "is_comb_box").agg(F.count("*").alias("n"), F.sum("num_chars").alias("chars"))


@query(with_(oracles.FIELDS, "SELECT id, ground_truth FROM fields WHERE lower(field_type) = 'pin' AND is_comb_box"))
def p1_p2_list_fields(spark, sf_dir):
    return catalog.list_fields(fixtures.form_fields(spark, sf_dir), "PIN", True).select("id", "ground_truth")


@query(with_(oracles.FIELDS, "SELECT field_type, id, ground_truth FROM fields WHERE NOT is_comb_box AND (contains(CAST(id AS VARCHAR), '77') OR contains(lower(ground_truth), '77') OR contains(lower(field_type), '77'))"))
def p3_search_fields(spark, sf_dir):
    return catalog.search_fields(fixtures.form_fields(spark, sf_dir), None, False, "77").select("field_type", "id", "ground_truth")


_NEEDLES = ("7", "77", "1-0", "4/0", "PIN", "k-3", "2019", "zz-1")


@query(with_(oracles.FIELDS, "SELECT needle, field_type, id FROM fields, (VALUES " + ", ".join(f"('{n}')" for n in _NEEDLES) + ") v(needle) WHERE contains(CAST(id AS VARCHAR), lower(needle)) OR contains(lower(ground_truth), lower(needle)) OR contains(lower(field_type), lower(needle))"))
def p3_indexed_search(spark, sf_dir):
    index = TextIndex(spark, fresh_path(spark, "index"))
    index.build(fixtures.form_fields(spark, sf_dir), ["field_type", "id"], ["id", "ground_truth", "field_type"])
    found = [index.search(n).select(F.lit(n).alias("needle"), "field_type", "id") for n in _NEEDLES]
    return reduce(DataFrame.union, found)


@query(with_(oracles.FIELDS, r"SELECT id, upper(substr(field_type, 1, 1)) || lower(substr(field_type, 2)) AS type_label, CASE WHEN id % 3 = 0 THEN 'own_' || id ELSE field_type || '_' || id || '.png' END AS filename, CASE WHEN is_comb_box THEN 'Comb Box' ELSE 'Freeform' END AS layout, CASE WHEN id % 5 = 0 THEN CAST(length(ground_truth) AS INT) ELSE num_chars END AS cells, '/api/image/' || CASE WHEN id % 3 = 0 THEN 'own_' || id ELSE field_type || '_' || id || '.png' END AS image_url FROM fields"))
def p4_s4_described(spark, sf_dir):
    rows = fixtures.form_fields(spark, sf_dir)
    path = F.concat(F.lit("C:\\data\\form/x\\"), "field_type", F.lit("_"), F.col("id").cast("string"), F.lit(".png"))
    rows = rows.withColumns({"image_path": path, "filename": F.when(F.col("id") % 3 == 0, F.concat(F.lit("own_"), F.col("id").cast("string"))), "num_chars": F.when(F.col("id") % 5 != 0, F.col("num_chars"))})
    return catalog.described(rows)


@query(with_(oracles.FIELDS, "SELECT field_type, id, ground_truth FROM fields WHERE field_type = 'code' AND id = 17"))
def p5_lookup(spark, sf_dir):
    return catalog.lookup(fixtures.form_fields(spark, sf_dir), "code", 17).select("field_type", "id", "ground_truth")


@query(with_(oracles.FIELDS, "SELECT event_id AS id, coalesce(f.field_type, 'Date') AS field_type, coalesce(f.is_comb_box, true) AS is_comb_box, coalesce(f.num_chars, 8) AS cells FROM events LEFT JOIN (SELECT * FROM fields WHERE field_type = 'code') f ON f.id = event_id"))
def p6_enriched(spark, sf_dir):
    requests = fixtures.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("Date").alias("field_type"), F.lit(True).alias("is_comb_box"), F.lit(8).alias("cells"))
    return catalog.enriched(requests, fixtures.form_fields(spark, sf_dir).where("field_type = 'code'"))


def _stores(spark, sf_dir):
    """Requests and all fields, stored by id."""
    path = fresh_path(spark, "store")
    fields_, requests = (FieldStore(spark, f"{path}/{n}", f"{n}_{path.rpartition('-')[2]}", buckets=8) for n in ("fields", "requests"))
    fields_.refresh(fixtures.form_fields(spark, sf_dir), "1")
    requests.refresh(fixtures.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("Date").alias("field_type"), F.lit(True).alias("is_comb_box"), F.lit(8).alias("cells")), "1")
    return requests, fields_


@query(with_(oracles.FIELDS, "SELECT field_type, id, ground_truth FROM fields WHERE id = 17"))
def p5_stored_lookup(spark, sf_dir):
    return _stores(spark, sf_dir)[1].lookup(17).select("field_type", "id", "ground_truth")


@query(with_(oracles.FIELDS, "SELECT event_id AS id, coalesce(f.field_type, 'Date') AS field_type, coalesce(f.is_comb_box, true) AS is_comb_box, coalesce(f.num_chars, 8) AS cells FROM events LEFT JOIN fields f ON f.id = event_id"))
def p6_stored_enriched(spark, sf_dir):
    return catalog.enriched_stored(*_stores(spark, sf_dir))


@query(with_(oracles.CHARS, "SELECT field_type, CASE WHEN m >= 0.85 THEN 'accepted' ELSE 'flagged' END AS bucket, CASE WHEN m >= 0.9 THEN 'success' WHEN m >= 0.75 THEN 'warning' ELSE 'danger' END AS badge, count(*) AS n FROM (SELECT field_type, id, min(conf) AS m FROM chars GROUP BY 1, 2) GROUP BY 1, 2, 3"))
def p7_p8_split_and_badge(spark, sf_dir):
    rows = fixtures.hypotheses(spark, sf_dir).select("field_type", least_confidence(F.col("hyp")).alias("conf"))
    return catalog.confidence_split(rows, 0.85).groupBy("field_type", "bucket", catalog.badge(F.col("conf")).alias("badge")).agg(F.count("*").alias("n"))


_LABEL = "CASE user_id % 6 WHEN 0 THEN 'Date Field' WHEN 1 THEN 'PIN Code (######)' WHEN 2 THEN 'Short Code' WHEN 3 THEN 'Name' WHEN 4 THEN 'pin' ELSE 'UPDATE' END"


@query(f"SELECT label, CASE WHEN contains(lower(label), 'date') THEN 'date' WHEN contains(lower(label), 'pin') THEN 'pin' WHEN contains(lower(label), 'code') THEN 'code' ELSE 'other' END AS kind, CASE WHEN contains(lower(label), 'date') THEN '0123456789/-.' WHEN contains(lower(label), 'pin') THEN '0123456789' ELSE '0123456789/-.ABCDEFGHIJKLMNOPQRSTUVWXYZ' END AS allowed, CASE WHEN contains(lower(label), 'date') THEN 10 WHEN contains(lower(label), 'pin') THEN 6 ELSE 8 END AS cells, count(*) AS n FROM (SELECT {_LABEL} AS label FROM events) GROUP BY 1, 2, 3, 4")
def p9_vocabulary(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "events").select(F.expr(_LABEL).alias("label"))
    chars, length = catalog.vocabulary_for(F.col("label"))
    return rows.groupBy("label", field_kind(F.col("label")).alias("kind"), chars.alias("allowed"), length.alias("cells")).agg(F.count("*").alias("n"))


@query(with_(oracles.CHARS, "SELECT field_type, id, string_agg(coalesce(digit_alt, ''), '' ORDER BY pos) AS digits, string_agg(coalesce(letter_alt, ''), '' ORDER BY pos) AS letters FROM chars WHERE pos < 6 GROUP BY 1, 2"))
def p10_p11_alternatives(spark, sf_dir):
    from glyphmill.functions.chars import digit_alternatives, first_alternative, letter_alternatives

    cut = F.slice("hyp", 1, 6)
    first = lambda f: F.array_join(F.transform(cut, lambda x: F.coalesce(first_alternative(f(x)), F.lit(""))), "")
    return fixtures.hypotheses(spark, sf_dir).select(*KEYS, first(digit_alternatives).alias("digits"), first(letter_alternatives).alias("letters"))


_MODE_LABEL = "CASE user_id % 4 WHEN 0 THEN 'Raw engine' WHEN 1 THEN 'Grammar engine' WHEN 2 THEN 'Tri engine' ELSE 'new' END"


@query(f"SELECT label, CASE WHEN label = 'Raw engine' THEN 'raw_cnn' WHEN label = 'Grammar engine' THEN 'grammar_fsm' ELSE 'tri_engine' END AS mode, count(*) AS n FROM (SELECT {_MODE_LABEL} AS label FROM events) GROUP BY 1, 2")
def p13_mode_labels(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "events").select(F.expr(_MODE_LABEL).alias("label"))
    return rows.groupBy("label", catalog.mode_from_label(F.col("label")).alias("mode")).agg(F.count("*").alias("n"))


@query(with_(oracles.PREDICTIONS, "SELECT field_type, id, mode, text, round(conf, 4) AS min_conf, round(mean_conf, 4) AS mean_conf, round(conf * 100, 1) AS conf_pct, text = ground_truth AS exact, CASE WHEN conf >= 0.9 THEN 'success' WHEN conf >= 0.75 THEN 'warning' ELSE 'danger' END AS badge FROM predictions"))
def p12_p14_response(spark, sf_dir):
    return catalog.response(_predictions(spark, sf_dir))


@query(with_(oracles.FIELDS, "SELECT id, field_type, ground_truth FROM fields ORDER BY id, field_type LIMIT 6"))
def p15_presets(spark, sf_dir):
    return catalog.presets(fixtures.form_fields(spark, sf_dir)).select("id", "field_type", "ground_truth")


@query("SELECT event_id, 'data:image/png;base64,' || base64(encode(props)) AS uri, props AS back FROM events")
def s3_s11_data_uri(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "events").select("event_id", catalog.data_uri(F.col("props").cast("binary")).alias("uri"))
    return rows.withColumn("back", catalog.from_data_uri(F.col("uri")).cast("string"))


# --- recognition ------------------------------------------------------------------------------------------------


def _softmax_sql(allowed: str) -> str:
    places = ", ".join(f"({i}, '{ch}')" for i, ch in enumerate(C.FULL_VOCABULARY) if ch in allowed)
    return f"""WITH vocabulary(i, ch) AS (VALUES {places}), long AS (SELECT vec_id, ch, CAST(embedding[i + 1] AS DOUBLE) * 10 AS v FROM embeddings, vocabulary),
    probs AS (SELECT vec_id, ch, exp(v - max(v) OVER w) / sum(exp(v - m)) OVER w AS p FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM long) WINDOW w AS (PARTITION BY vec_id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, ch) AS r FROM probs)
    SELECT vec_id, max(ch) FILTER (r = 1) AS ch, round(max(p) FILTER (r = 1), 4) AS conf, string_agg(ch, '' ORDER BY r) FILTER (r BETWEEN 2 AND 4) AS alts, round(max(p) FILTER (r = 2), 4) AS p2 FROM ranked GROUP BY vec_id"""


def _top(spark, sf_dir, allowed):
    rows = recognize.hypotheses(fixtures.logits(spark, sf_dir), allowed)
    return rows.select("vec_id", "ch", F.round("conf", 4).alias("conf"), F.array_join(F.transform("alts", lambda a: a["ch"]), "").alias("alts"), F.get("alts", F.lit(0))["p"].alias("p2"))


@query(_softmax_sql(C.DATE_VOCABULARY))
def r2_r3_masked_topk_date(spark, sf_dir):
    return _top(spark, sf_dir, C.DATE_VOCABULARY)


@query(_softmax_sql(C.FULL_VOCABULARY))
def r2_r3_topk_full(spark, sf_dir):
    return _top(spark, sf_dir, C.FULL_VOCABULARY)


@query("SELECT vec_id, '?' AS ch, 0.5::DOUBLE AS conf, 0::INT AS n_alts FROM embeddings")
def r4_no_model(spark, sf_dir):
    rows = fixtures.logits(spark, sf_dir).withColumn("logits", F.lit(None).cast("array<double>"))
    return recognize.hypotheses(rows, C.PIN_VOCABULARY).select("vec_id", "ch", "conf", F.size("alts").alias("n_alts"))


@query(with_(oracles.CHARS, "SELECT field_type, id, string_agg(ch, '' ORDER BY pos) AS raw_text, round(min(conf), 4) AS min_conf, round(sum(conf) / count(*), 4) AS mean_conf FROM chars GROUP BY 1, 2"))
def r5_raw_reading(spark, sf_dir):
    hyp = F.col("hyp")
    return fixtures.hypotheses(spark, sf_dir).select(*KEYS, raw_text(hyp).alias("raw_text"), F.round(least_confidence(hyp), 4).alias("min_conf"), F.round(mean_confidence(hyp), 4).alias("mean_conf"))


# --- decoding ---------------------------------------------------------------------------------------------------


@query(with_(oracles.DATES, "SELECT id, text, valid, fsm_conf FROM dates"))
def g2_g9_dates(spark, sf_dir):
    return decode.decode_dates(_of(spark, sf_dir, "date")).select("id", "text", "valid", "fsm_conf")


@query(with_(oracles.DATES, """SELECT id, coalesce(string_agg(note, '|' ORDER BY pos, k), '') AS notes FROM (
  SELECT id, pos, 1 AS k, CASE WHEN pos IN (2, 5) AND ch <> sep THEN 'pos ' || pos || ': separator ' || sep END AS note FROM settled
  UNION ALL SELECT id, pos, 2, CASE WHEN pos NOT IN (2, 5) AND NOT is_digit THEN 'pos ' || pos || ': digit ' || d END FROM settled
  UNION ALL SELECT id, pos, 3, CASE WHEN pos IN (0, 3) AND t <> d THEN 'pos ' || pos || ': tens ' || t END FROM settled
  UNION ALL SELECT id, pos, 4, CASE WHEN pos = 3 AND final <> t THEN 'pos 3: month 10' END FROM settled
  UNION ALL SELECT id, pos, 5, CASE WHEN pos = 6 AND ((d = '9' AND next_ch = '0') OR (d IN ('9', '2') AND next_ch IN ('7', '8', '9'))) THEN 'pos 6: century ' || final END FROM settled) GROUP BY id"""))
def g7_date_notes(spark, sf_dir):
    return decode.decode_dates(_of(spark, sf_dir, "date")).select("id", "notes")


@query(with_(oracles.PINS, "SELECT id, raw, least FROM pin_raw"))
def g10_g13_pin_lattice(spark, sf_dir):
    lattice = decode.digit_lattice(F.col("hyp"), 6)
    return _of(spark, sf_dir, "pin").withColumn("l", lattice).select("id", decode.lattice_text(F.col("l")).alias("raw"), decode.lattice_confidence(F.col("l")).alias("least"))


@query(with_(oracles.PINS, "SELECT id, text, fsm_conf, valid, score FROM pins"))
def g11_g12_pins(spark, sf_dir):
    return decode.decode_pins(_of(spark, sf_dir, "pin"), fixtures.lexicon(spark, sf_dir)).select("id", "text", "fsm_conf", "valid", "score")


@query(with_(oracles.LARGE_PINS, f"SELECT id, coalesce(entry, raw) AS text, score, coalesce(score > {C.PIN_FLOOR}, true) AS valid FROM pin_raw LEFT JOIN large_near USING (id)"))
def g12_large_lexicon(spark, sf_dir):
    return decode.decode_pins(_of(spark, sf_dir, "pin"), fixtures.large_lexicon(spark, sf_dir)).select("id", "text", "score", "valid")


@query(with_(oracles.CODES, "SELECT id, text, fsm_conf, valid, score FROM codes"))
def g14_g18_codes(spark, sf_dir):
    return decode.decode_codes(_of(spark, sf_dir, "code"), fixtures.lexicon(spark, sf_dir)).select("id", "text", "fsm_conf", "valid", "score")


@query(with_(oracles.CODES, "SELECT id, registered AS text FROM codes"))
def g16_registry_substitution(spark, sf_dir):
    return decode.decode_codes(_of(spark, sf_dir, "code"), fixtures.lexicon(spark, sf_dir), registry_substitution=True).select("id", "text")


@query(with_(oracles.LEXICON, "SELECT 'pin' AS kind, entry, CAST(NULL AS VARCHAR) AS prefix FROM pin_lexicon UNION ALL SELECT 'code', entry, prefix FROM code_lexicon"))
def g19_lexicon(spark, sf_dir):
    rows = fixtures.lexicon(spark, sf_dir)
    codes = rows.where("kind = 'code'").groupBy("kind", "prefix").agg(F.max("entry").alias("entry")).select("kind", "entry", "prefix")
    return rows.where("kind = 'pin'").distinct().union(codes)


@query(with_(oracles.DECODED, "SELECT field_type, id, text, fsm_conf, valid FROM decoded"))
def g1_decode_all(spark, sf_dir):
    return decode.decode(fixtures.hypotheses(spark, sf_dir), fixtures.lexicon(spark, sf_dir)).select(*KEYS, "text", "fsm_conf", "valid")


@query(with_(oracles.ODD, "SELECT source, id, field_type, text, fsm_conf, valid FROM odd_decoded"))
def g1_odd_readings(spark, sf_dir):
    return decode.decode(fixtures.odd_hypotheses(spark, sf_dir), fixtures.lexicon(spark, sf_dir)).select("source", "id", "field_type", "text", "fsm_conf", "valid")


@query(with_(oracles.VERIFIED, "SELECT field_type, id, verified_text, sem_conf, CASE WHEN verified_text <> text THEN text || ' to ' || verified_text ELSE '' END AS sem_note FROM verified"))
def v1_v5_verified(spark, sf_dir):
    rows = decode.decode(fixtures.hypotheses(spark, sf_dir), fixtures.lexicon(spark, sf_dir))
    return verify.verify(rows).select(*KEYS, "verified_text", "sem_conf", "sem_note")


# the verifier on raw readings, where every rule has work to do
@query(with_(oracles.CHARS, """SELECT field_type, id, string_agg(fixed, '' ORDER BY pos) AS verified_text FROM (
  SELECT *, CASE WHEN field_type = 'pin' THEN CASE WHEN is_digit THEN ch ELSE coalesce(digit_alt, '0') END
    WHEN pos = split THEN '-' WHEN pos < split THEN CASE WHEN is_letter THEN ch ELSE coalesce(letter_alt, 'A') END
    ELSE CASE WHEN is_digit THEN ch ELSE coalesce(digit_alt, '0') END END AS fixed
  FROM (SELECT *, CASE WHEN num_chars <= 7 THEN 2 ELSE 3 END AS split FROM chars WHERE field_type <> 'date')) GROUP BY 1, 2"""))
def v2_v3_raw_verified(spark, sf_dir):
    rows = fixtures.hypotheses(spark, sf_dir).where("field_type <> 'date'").withColumn("text", raw_text(F.col("hyp")))
    return verify.verify(rows).select(*KEYS, "verified_text")


@query(with_(oracles.PREDICTIONS, "SELECT field_type, id, mode, text, conf, syntax_valid, conf >= 0.85 AND syntax_valid AS is_approved, CASE WHEN conf >= 0.85 AND syntax_valid THEN 'APPROVED' ELSE 'FLAGGED' END AS status, CASE WHEN conf >= 0.85 AND syntax_valid THEN 'passed' WHEN conf < 0.85 THEN 'confidence' ELSE 'syntax' END AS reason FROM predictions"))
def m1_m3_predictions(spark, sf_dir):
    return _predictions(spark, sf_dir).select(*KEYS, "mode", "text", "conf", "syntax_valid", "is_approved", "status", "reason")


@query(with_(oracles.PREDICTIONS, "SELECT mode, count_if(round(conf, 4) >= 0.96 AND syntax_valid) AS approved, count(*) AS n FROM predictions GROUP BY mode"))
def m4_regate(spark, sf_dir):
    rows = modes.gate(_predictions(spark, sf_dir).withColumn("conf", F.round("conf", 4)), 0.96)
    return rows.groupBy("mode").agg(F.count_if("is_approved").alias("approved"), F.count("*").alias("n"))


@query(with_(oracles.FIELDS, "SELECT field_type, id, substr(ground_truth, 1, CAST(id % 6 AS INT)) || 'X' || substr(ground_truth, CAST(id % 6 AS INT) + 2) AS text FROM fields"))
def m5_swap(spark, sf_dir):
    return fixtures.form_fields(spark, sf_dir).select(*KEYS, catalog.swapped(F.col("ground_truth"), (F.col("id") % 6).cast("int"), F.lit("X")).alias("text"))


# --- evaluation -------------------------------------------------------------------------------------------------

_BOARD = """SELECT mode, fields, chars, exact, round(100.0::DOUBLE * hits / chars, 2) AS char_accuracy, round(100.0::DOUBLE * exact / fields, 2) AS exact_rate, round(100.0::DOUBLE - round(100.0::DOUBLE * hits / chars, 2), 2) AS error_rate
FROM (SELECT mode, count(*) AS fields, count_if(text = ground_truth)::BIGINT AS exact FROM predictions GROUP BY mode) JOIN (SELECT mode, count(*) AS chars, count_if(p = t) AS hits FROM compared GROUP BY mode) USING (mode)"""


@query(with_(oracles.PREDICTIONS, _BOARD))
def a1_a3_a6_leaderboard(spark, sf_dir):
    return evaluate.leaderboard(_predictions(spark, sf_dir))


@query(with_(oracles.PREDICTIONS, "SELECT t AS truth, p AS pred, count(*) AS n FROM compared WHERE mode = 'raw_cnn' AND t <> p GROUP BY 1, 2"))
def a4_confusions(spark, sf_dir):
    return evaluate.confusions(_predictions(spark, sf_dir, "raw_cnn"))


@query(with_(oracles.PREDICTIONS, "SELECT t AS truth, p AS pred, count(*) AS n FROM compared WHERE mode = 'raw_cnn' AND t <> p GROUP BY 1, 2 ORDER BY n DESC, truth, pred LIMIT 10"))
def a5_top_confusions(spark, sf_dir):
    return evaluate.top_confusions(_predictions(spark, sf_dir, "raw_cnn"))


def _sweep_sql(conf: str, mode: str) -> str:
    values = ", ".join(f"({t}::DOUBLE)" for t in C.THRESHOLDS)
    return f"""SELECT theta, accepted, round(100.0::DOUBLE * accepted / total, 1) AS auto_rate, round(100.0::DOUBLE * right_ / greatest(accepted, 1), 1) AS accuracy, round(100.0::DOUBLE * (total - accepted) / total, 1) AS review_rate
    FROM (SELECT theta, count(*) AS total, count_if({conf} >= theta) AS accepted, count_if({conf} >= theta AND text = ground_truth) AS right_ FROM predictions, (VALUES {values}) v(theta) WHERE mode = '{mode}' GROUP BY theta)"""


@query(with_(oracles.PREDICTIONS, _sweep_sql("conf", "tri_engine")))
def a7_threshold_sweep(spark, sf_dir):
    return evaluate.threshold_sweep(_predictions(spark, sf_dir, "tri_engine"))


@query(with_(oracles.PREDICTIONS, _sweep_sql("conf", "raw_cnn")))
def a7_true_confidence_sweep(spark, sf_dir):
    return evaluate.threshold_sweep(_predictions(spark, sf_dir, "raw_cnn"), mode="raw_cnn")


_ANY_THETA = """SELECT coalesce(mode, 'all') AS mode, coalesce(field_type, 'all') AS field_type, coalesce(comb, 'all') AS is_comb_box, theta, count(*) AS total, count_if(conf >= theta) AS accepted, count_if(conf >= theta AND syntax_valid) AS approved, count_if(conf >= theta AND text = ground_truth) AS "right"
FROM (SELECT *, CAST(id % 2 = 0 AS VARCHAR) AS comb FROM predictions), (SELECT k / 100.0::DOUBLE AS theta FROM range(1, 101) r(k)) GROUP BY theta, CUBE (mode, field_type, comb)"""


@query(with_(oracles.PREDICTIONS, _ANY_THETA))
def m4_a7_any_threshold(spark, sf_dir):
    return evaluate.at_thresholds(evaluate.confidence_table(_predictions(spark, sf_dir)), [k / 100.0 for k in range(1, 101)])


@query(with_(oracles.PREDICTIONS, "SELECT mode, sum(levenshtein(text, ground_truth))::BIGINT AS edits, sum(length(ground_truth))::BIGINT AS chars, round(100.0::DOUBLE * sum(levenshtein(text, ground_truth)) / sum(length(ground_truth)), 2) AS cer FROM predictions GROUP BY mode"))
def ext_edit_error_rate(spark, sf_dir):
    return evaluate.edit_error_rate(_predictions(spark, sf_dir))


@query(with_(oracles.PREDICTIONS, "SELECT mode, CAST(least(floor(conf * 10), 9) AS INT) AS bin, count(*) AS fields, round(avg(conf), 4) AS mean_conf, round(avg(CAST(text = ground_truth AS INT)), 4) AS exact_share FROM predictions GROUP BY 1, 2"))
def ext_calibration(spark, sf_dir):
    return evaluate.calibration(_predictions(spark, sf_dir))


# --- audit ------------------------------------------------------------------------------------------------------


@query(with_(oracles.LOG, "SELECT count(*) AS total, count_if(action = 'ACCEPT') AS accept, count_if(action = 'CORRECT') AS correct, count_if(action = 'REJECT') AS reject FROM log"))
def a8_action_counts(spark, sf_dir):
    return audit.action_counts(fixtures.audit_events(spark, sf_dir))


@query(with_(oracles.LOG, "SELECT substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) AS audit_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, coalesce(field_type, 'Custom') AS field_type, action, CASE WHEN action = 'REJECT' THEN '[REJECTED]' ELSE verified_text END AS verified_text, round(latency_s, 2) AS latency_s, coalesce(notes, '') AS notes FROM log"))
def a9_appended(spark, sf_dir):
    return audit.appended(fixtures.audit_events(spark, sf_dir)).drop("ts")


@query(with_(oracles.LOG, "SELECT event_id, action FROM log ORDER BY ts DESC, event_id DESC LIMIT 500"))
def a10_history(spark, sf_dir):
    return audit.history(fixtures.audit_events(spark, sf_dir)).select("event_id", "action")


@query(with_(oracles.LOG, "SELECT event_id, action, (SELECT count(*) FROM log) AS total FROM log ORDER BY ts DESC, event_id DESC LIMIT 50"))
def a11_latest(spark, sf_dir):
    return audit.latest(fixtures.audit_events(spark, sf_dir)).select("event_id", "action", "total")


# three batches, of which one comes twice, and a late one that repeats records of the first two
@query(with_(oracles.LOG, "SELECT substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) AS audit_id, event_id, coalesce(field_type, 'Custom') AS field_type, action, CASE WHEN action = 'REJECT' THEN '[REJECTED]' ELSE verified_text END AS verified_text, coalesce(notes, '') AS notes FROM log"))
def s9_a9_repeatable_append(spark, sf_dir):
    rows = audit.appended(fixtures.audit_events(spark, sf_dir))
    log = AuditLog(spark, fresh_path(spark, "log"), rows.schema, key="event_id")
    third = F.pmod(F.col("event_id"), F.lit(3))
    for batch, wanted in (("a", third == 0), ("b", third == 1), ("b", third == 1), ("c", third == 2), ("late", F.col("event_id") % 7 == 0)):
        log.append(rows.where(wanted), batch)
    log.compact()
    log.vacuum()
    return log.read().drop("ts", "timestamp", "latency_s")


@query(with_(oracles.LOG, "SELECT event_id, action, (SELECT count(*) FROM log) AS total FROM log ORDER BY ts DESC, event_id DESC LIMIT 500"))
def a10_a11_streamed_history(spark, sf_dir):
    rows = fixtures.audit_events(spark, sf_dir).select("event_id", "ts", "action")
    source, out, mark = (fresh_path(spark, f"history-{k}") for k in ("in", "out", "mark"))
    rows.repartition(6, F.xxhash64("event_id")).write.parquet(source)  # files in no order of time
    stream = read_log_stream(spark, source, rows.schema, files_per_batch=2)
    history_stream.follow(stream, out, mark).awaitTermination()
    return history_stream.history(spark, out, rows.schema).select("event_id", "action", "total")


@query(with_(oracles.LOG, "SELECT CASE WHEN action = 'ACCEPT' THEN CASE WHEN status = 'APPROVED' THEN 'AUTO-APPROVED' ELSE 'HUMAN-APPROVED' END WHEN action = 'CORRECT' THEN 'CORRECTED' ELSE 'REJECTED' END AS decision, count(*) AS n FROM log GROUP BY 1"))
def a12_decisions(spark, sf_dir):
    return audit.decision_log(fixtures.audit_events(spark, sf_dir)).groupBy("decision").agg(F.count("*").alias("n"))


@query(with_(oracles.LOG, "SELECT event_id, 'REC-' || (row_number() OVER (ORDER BY ts, event_id) + 1000) AS record_id FROM log"))
def a13_record_ids(spark, sf_dir):
    return audit.numbered(fixtures.audit_events(spark, sf_dir)).select("event_id", "record_id")


@query(with_(oracles.PREDICTIONS, """SELECT field_type, id, mode, action, CASE action WHEN 'REJECT' THEN '[REJECTED]' WHEN 'CORRECT' THEN ground_truth ELSE text END AS verified_text, CASE WHEN action = 'CORRECT' THEN 'was ' || text ELSE '' END AS notes
FROM (SELECT *, CASE WHEN text = ground_truth THEN 'ACCEPT' WHEN length(text) = length(ground_truth) THEN 'CORRECT' ELSE 'REJECT' END AS action FROM predictions)"""))
def a14_payload(spark, sf_dir):
    return audit.payload(_predictions(spark, sf_dir))


@query(with_(oracles.FIELDS, "SELECT a.field_type, a.id, b.id AS next_id FROM fields a LEFT JOIN fields b ON a.field_type = b.field_type AND b.id = a.id + 1"))
def a15_next_field(spark, sf_dir):
    return audit.next_field(fixtures.form_fields(spark, sf_dir)).select("field_type", "id", "next_id")


@query(with_(oracles.LOG, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, action, count(*) AS n, CAST((2 * sum(CAST(round(latency_s * 10000) AS BIGINT)) + count(latency_s)) // (2 * count(latency_s)) AS DOUBLE) / 10000 AS mean_latency FROM log GROUP BY 1, 2"))
def ext_hourly_actions(spark, sf_dir):
    return audit.hourly_actions(fixtures.audit_events(spark, sf_dir)).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


# --- segmentation -----------------------------------------------------------------------------------------------


@query("SELECT event_id, CAST(round_even(0.114::DOUBLE * (event_id % 256) + 0.587::DOUBLE * ((event_id * 3) % 256) + 0.299::DOUBLE * ((event_id * 7) % 256), 0) AS INT) AS gray FROM events")
def i1_gray(spark, sf_dir):
    e = F.col("event_id")
    return fixtures.table(spark, sf_dir, "events").select("event_id", segment.gray(e % 256, (e * 3) % 256, (e * 7) % 256).alias("gray"))


@query(with_(oracles.PIXELS, "SELECT img_id, count(*) AS ink FROM ink GROUP BY 1"))
def i2_field_ink(spark, sf_dir):
    return segment.field_ink(fixtures.pixels(spark, sf_dir)).groupBy("img_id").agg(F.count("*").alias("ink"))


@query(with_(oracles.PIXELS + ", turned AS (SELECT img_id, CASE WHEN img_id % 5 = 4 THEN 255 - v ELSE v END AS v FROM pixels)", "SELECT img_id, count(*) AS ink FROM turned JOIN (SELECT img_id, median(v) AS m FROM turned GROUP BY 1) USING (img_id) WHERE CASE WHEN m > 120 THEN v <= 210 ELSE v > 45 END GROUP BY 1"))
def i3_glyph_ink(spark, sf_dir):
    rows = fixtures.pixels(spark, sf_dir).withColumn("v", F.when(F.col("img_id") % 5 == 4, 255 - F.col("v")).otherwise(F.col("v")))
    return segment.glyph_ink(rows).groupBy("img_id").agg(F.count("*").alias("ink"))


@query(with_(oracles.PIXELS, f"SELECT img_id, y, x FROM {oracles.runs('y', 'x', 16)}"))
def i4_vertical_lines(spark, sf_dir):
    return segment.vertical_lines(segment.field_ink(fixtures.pixels(spark, sf_dir)), 40).select("img_id", "y", "x")


_CELLS = f"""SELECT img_id, x0, x1, cell, l AS "left", CASE WHEN r <= l THEN CAST(least(40, l + floor(step)) AS INT) ELSE r END AS "right" FROM (
  SELECT *, CAST(greatest(0, round_even(x0 + cell * step, 0) + 2) AS INT) AS l, CAST(least(40, round_even(x0 + (cell + 1) * step, 0) - 2) AS INT) AS r FROM (
    SELECT *, greatest(10, x1 - x0) / cells::DOUBLE AS step, CAST(unnest(range(cells)) AS INT) AS cell FROM (
      SELECT img_id, cells, CAST(CASE WHEN wide THEN a ELSE pad END AS INT) AS x0, CAST(CASE WHEN wide THEN b ELSE 40 - pad END AS INT) AS x1 FROM (
        SELECT img_id, cells, a, b, coalesce(n >= 2 AND b - a > 20, false) AS wide, greatest(4, (40 % cells) // 2) AS pad
        FROM images LEFT JOIN (SELECT img_id, count(DISTINCT x) AS n, min(x) AS a, max(x) AS b FROM {oracles.runs('y', 'x', 16)} GROUP BY 1) USING (img_id)))))"""


@query(with_(oracles.PIXELS, _CELLS))
def i5_i7_cells(spark, sf_dir):
    lines = segment.column_sums(segment.vertical_lines(segment.field_ink(fixtures.pixels(spark, sf_dir)), 40))
    return segment.cells(segment.grid_extent(fixtures.images(spark, sf_dir), lines, 40), 40)


@query(with_(oracles.PIXELS, "SELECT img_id, y, x FROM (SELECT *, count(*) OVER (PARTITION BY img_id, y, g) AS n FROM (SELECT *, x - row_number() OVER (PARTITION BY img_id, y ORDER BY x) AS g FROM ink)) WHERE n < 20 AND y BETWEEN 2 AND 37 AND x BETWEEN 2 AND 37"))
def i8_i10_cleaned(spark, sf_dir):
    ink = segment.field_ink(fixtures.pixels(spark, sf_dir))
    return segment.border_cleared(segment.without(ink, segment.underlines(ink, 40)), 40, 40).select("img_id", "y", "x")


@query(with_(oracles.BOXES, "SELECT img_id, seq, CAST(row_number() OVER (PARTITION BY img_id ORDER BY x, seq) AS INT) AS place FROM boxes WHERE area >= 6 AND h >= 3 AND w >= 2 AND w < 0.85 * 200"))
def i12_i13_plausible(spark, sf_dir):
    rows = segment.plausible_boxes(fixtures.boxes(spark, sf_dir), 200)
    return rows.select("img_id", "seq", F.row_number().over(Window.partitionBy("img_id").orderBy("x", "seq")).alias("place"))


@query(with_(oracles.PIXELS, "SELECT img_id, CAST(cell AS INT) AS cell, CAST(floor(cell * (40::DOUBLE / 6)) AS INT) AS x, CAST(floor((cell + 1) * (40::DOUBLE / 6)) AS INT) AS \"right\", 6::INT AS w FROM images, range(6) r(cell) WHERE img_id NOT IN (SELECT img_id FROM ink)"))
def i14_slices(spark, sf_dir):
    ink = segment.field_ink(fixtures.pixels(spark, sf_dir))
    return segment.equal_slices(segment.blank(fixtures.images(spark, sf_dir), ink), 40)


_MERGE = """SELECT img_id, CAST(pos - 1 AS INT) AS pos, m.x AS x, m.y AS y, m.r - m.x AS w, m.b - m.y AS h FROM (SELECT img_id, generate_subscripts(merged, 1) AS pos, unnest(merged) AS m FROM (
  SELECT img_id, list_reduce(items, lambda acc, n: CASE WHEN least(acc[-1].r, n[1].r) - greatest(acc[-1].x, n[1].x) > 0 OR (n[1].x - acc[-1].r < 6 AND greatest(acc[-1].r, n[1].r) - least(acc[-1].x, n[1].x) <= lim)
    THEN list_concat(acc[1:len(acc) - 1], [{'x': least(acc[-1].x, n[1].x), 'y': least(acc[-1].y, n[1].y), 'r': greatest(acc[-1].r, n[1].r), 'b': greatest(acc[-1].b, n[1].b)}]) ELSE list_concat(acc, n) END) AS merged
  FROM (SELECT img_id, list([{'x': x, 'y': y, 'r': x + w, 'b': y + h}] ORDER BY x, seq, y, w, h) AS items, greatest(1.3::DOUBLE * median(w), 0.8::DOUBLE * 24) AS lim FROM boxes GROUP BY img_id)))"""


@query(with_(oracles.BOXES, _MERGE))
def i15_merged_boxes(spark, sf_dir):
    return segment.merged_boxes(fixtures.boxes(spark, sf_dir), 24.0)


@query(with_(oracles.BOXES, "SELECT img_id, seq, greatest(0, x - px)::INT AS x0, greatest(0, y - py)::INT AS y0, least(200, x + w + px)::INT AS x1, least(40, y + h + py)::INT AS y1 FROM (SELECT *, greatest(2, floor(0.15::DOUBLE * w)) AS px, greatest(2, floor(0.15::DOUBLE * h)) AS py FROM boxes)"))
def i16_padded(spark, sf_dir):
    return segment.padded_boxes(fixtures.boxes(spark, sf_dir), 200, 40).select("img_id", "seq", "x0", "y0", "x1", "y1")


@query(with_(oracles.BOXES, "SELECT img_id, seq FROM boxes WHERE NOT ((w > 0.6 * 30 AND h <= 3) OR (h > 0.6 * 40 AND w <= 3) OR ((x <= 1 OR x + w >= 29) AND w <= 2) OR ((y <= 1 OR y + h >= 39) AND h <= 2))"))
def i17_without_grid(spark, sf_dir):
    return segment.without_grid_parts(fixtures.boxes(spark, sf_dir), 30, 40).select("img_id", "seq")


@query(with_(oracles.PIXELS, """SELECT img_id, coalesce(k.x0, a.x0, -1) AS x0, coalesce(k.x1, a.x1, -1) AS x1, coalesce(k.y0, a.y0, -1) AS y0, coalesce(k.y1, a.y1, -1) AS y1, CASE WHEN k.x0 IS NOT NULL THEN 'kept' WHEN a.x0 IS NOT NULL THEN 'all' ELSE 'blank' END AS source
FROM images LEFT JOIN (SELECT img_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ink WHERE img_id % 4 <> 0 AND x BETWEEN 14 AND 30 GROUP BY 1) k USING (img_id) LEFT JOIN (SELECT img_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ink GROUP BY 1) a USING (img_id)"""))
def i18_tight_crop(spark, sf_dir):
    ink = segment.field_ink(fixtures.pixels(spark, sf_dir))
    return segment.tight_crop(fixtures.images(spark, sf_dir), ink.where((F.col("img_id") % 4 != 0) & F.col("x").between(14, 30)), ink).fillna(-1)


@query(with_(oracles.BOXES, "SELECT img_id, seq, round(CASE WHEN greatest(w, h) <= 8 THEN least(least(24::DOUBLE / w, 24::DOUBLE / h), 1.2::DOUBLE) WHEN h <= 6 AND w >= 8 THEN least(least(24::DOUBLE / w, 24::DOUBLE / h), 2.0::DOUBLE) ELSE least(24::DOUBLE / w, 24::DOUBLE / h) END, 6) AS scale FROM boxes"))
def i19_scale(spark, sf_dir):
    return fixtures.boxes(spark, sf_dir).select("img_id", "seq", F.round(segment.scale_factor(F.col("w"), F.col("h")), 6).alias("scale"))


@query(with_(oracles.PIXELS, "SELECT img_id, round(sum(v / 255.0::DOUBLE), 6) AS total FROM pixels GROUP BY 1"))
def i21_unit_scaled(spark, sf_dir):
    rows = fixtures.pixels(spark, sf_dir).groupBy("img_id").agg(F.sort_array(F.collect_list("v")).alias("v"))
    return rows.select("img_id", F.round(F.aggregate(segment.unit_scaled(F.col("v")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_REGIONS = f"""WITH RECURSIVE {oracles.PIXELS.strip()},
row_runs AS (SELECT img_id, y, min(x) AS a, max(x) AS b, row_number() OVER (ORDER BY img_id, y, min(x)) AS k FROM (SELECT *, x - row_number() OVER (PARTITION BY img_id, y ORDER BY x) AS g FROM ink) GROUP BY img_id, y, g HAVING count(*) < 20),
touching AS (SELECT p.k AS p, q.k AS q FROM row_runs p JOIN row_runs q ON p.img_id = q.img_id AND q.y = p.y + 1 AND q.a <= p.b + 1 AND q.b >= p.a - 1),
both_ways AS (SELECT p, q FROM touching UNION ALL SELECT q, p FROM touching),
reached(p, q) AS (SELECT k, k FROM row_runs UNION SELECT r.p, e.q FROM reached r JOIN both_ways e ON e.p = r.q),
region AS (SELECT p AS k, min(q) AS root FROM reached GROUP BY p),
found AS (SELECT img_id, CAST(min(a) AS INT) AS x, CAST(min(y) AS INT) AS y, CAST(max(b) - min(a) + 1 AS INT) AS w, CAST(max(y) - min(y) + 1 AS INT) AS h, CAST(sum(b - a + 1) AS INT) AS area FROM row_runs JOIN region USING (k) GROUP BY img_id, root)
SELECT img_id, CAST(row_number() OVER (PARTITION BY img_id ORDER BY x, y, w, h, area) - 1 AS INT) AS seq, x, y, w, h, area FROM found"""


@query(_REGIONS)
def i11_components(spark, sf_dir):
    ink = segment.field_ink(fixtures.pixels(spark, sf_dir))
    return regions.regions(segment.without(ink, segment.underlines(ink, 40)))


@query()
def t1_t5_glyph_set(spark, sf_dir):
    return glyphs.glyph_set(spark, 500).select("label", "sample", F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 4).alias("ink"))


_REPORT = f"""board AS ({_BOARD}), wrong AS (SELECT t AS truth, p AS pred, count(*) AS n FROM compared WHERE mode = 'raw_cnn' AND t <> p GROUP BY 1, 2 ORDER BY n DESC, truth, pred LIMIT 10), sweep AS ({_sweep_sql("conf", "tri_engine")})
SELECT 'summary' AS part, mode AS name, fields AS n, chars AS m, char_accuracy AS a, exact_rate AS b FROM board UNION ALL SELECT 'confusion', truth || pred, n, NULL, NULL, NULL FROM wrong UNION ALL SELECT 'sweep', CAST(theta AS VARCHAR), accepted, NULL, auto_rate, review_rate FROM sweep"""


@query(with_(oracles.PREDICTIONS + ",", _REPORT))
def s6_report(spark, sf_dir):
    rows = _predictions(spark, sf_dir).cache()
    path = fresh_path(spark, "report")
    files.write_report(files.report_json(evaluate.leaderboard(rows), evaluate.top_confusions(rows), evaluate.threshold_sweep(rows)), path)
    rows.unpersist()
    report = files.read_report(spark, path)
    long_ = lambda name, first, n, m, a, b: report.select(F.explode(name).alias("r")).select(F.lit({"summary": "summary", "top_confusions": "confusion", "threshold_sweep": "sweep"}[name]).alias("part"), first.alias("name"), n.alias("n"), m.cast("long").alias("m"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    r, null = lambda c: F.col(f"r.{c}"), F.lit(None)
    return (
        long_("summary", r("mode"), r("fields"), r("chars"), r("char_accuracy"), r("exact_rate"))
        .union(long_("top_confusions", F.concat(r("truth"), r("pred")), r("n"), null, null, null))
        .union(long_("threshold_sweep", r("theta").cast("string"), r("accepted"), null, r("auto_rate"), r("review_rate")))
    )


@query("SELECT CAST(arg_min(epoch, (-accuracy, epoch)) AS INT) AS epoch, max(accuracy) AS accuracy FROM (SELECT CAST(n_nationkey + 1 AS INT) AS epoch, CAST((n_nationkey * 7) % 11 AS DOUBLE) AS accuracy FROM nation)")
def t10_best_epoch(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("epoch"), ((F.col("n_nationkey") * 7) % 11).cast("double").alias("accuracy"))
    return glyphs.best_epoch(rows)


@query()
def t6_t9_training(spark, sf_dir):
    rows = fixtures.table(spark, sf_dir, "embeddings")
    return training.history_of(rows, training.train(rows, key="vec_id", features="embedding"))


# --- sources and sinks: written, read again -------------------------------------------------------------------------


@query(with_(oracles.FIELDS, "SELECT id AS field_id, field_type, ground_truth, is_comb_box, field_type || '.png' AS image_path, num_chars FROM fields"))
def s1_s5_metadata(spark, sf_dir):
    path = fresh_path(spark, "metadata")
    rows = fixtures.form_fields(spark, sf_dir)
    files.write_metadata(rows.select(F.col("id").alias("field_id"), "field_type", "ground_truth", "is_comb_box", F.concat("field_type", F.lit(".png")).alias("image_path"), "num_chars"), path)
    return files.read_metadata(spark, path)


@query("SELECT CAST(n_nationkey + 1 AS INT) AS epoch, CAST(1.0 / (n_nationkey + 1) AS DOUBLE) AS loss, CAST((n_nationkey * 7) % 11 AS DOUBLE) AS accuracy FROM nation")
def s7_history(spark, sf_dir):
    path = fresh_path(spark, "history")
    n = F.col("n_nationkey")
    files.write_history(fixtures.table(spark, sf_dir, "nation").select((n + 1).cast("int").alias("epoch"), (F.lit(1.0) / (n + 1)).alias("loss"), ((n * 7) % 11).cast("double").alias("accuracy")), path)
    return spark.read.schema("epoch int, loss double, accuracy double").json(path)


@query(with_(oracles.LOG, "SELECT substr(sha256(CAST(event_id AS VARCHAR)), 1, 8) AS audit_id, coalesce(field_type, 'Custom') AS field_type, action, CASE WHEN action = 'REJECT' THEN '[REJECTED]' ELSE verified_text END AS verified_text, coalesce(notes, '') AS notes FROM log"))
def s8_s9_audit(spark, sf_dir):
    path = fresh_path(spark, "audit")
    rows = audit.appended(fixtures.audit_events(spark, sf_dir)).select("audit_id", "field_type", "action", "verified_text", "notes")
    for part in (0, 1):  # two appends, and a line that is no JSON
        files.write_audit_json(rows.where(F.pmod(F.crc32(F.col("audit_id").cast("binary")), F.lit(2)) == part), path)
    spark.createDataFrame([("no json",)], "value string").write.mode("append").text(path)
    return files.read_audit(spark, path).select(*rows.columns)


_VARIANT = f"""WITH texts AS (SELECT event_id, {fixtures.DOCUMENT} AS body FROM events),
judged AS (SELECT *, CASE WHEN body IS NULL OR trim(body) = '' THEN 'empty' WHEN NOT json_valid(body) THEN 'broken' WHEN json_type(body) <> 'OBJECT' THEN 'not an object' ELSE 'ok' END AS reason FROM texts),
docs AS (SELECT *, CASE WHEN reason = 'ok' THEN body::JSON END AS doc FROM judged),
read_ AS (SELECT event_id, reason, TRY_CAST(doc->>'$.k' AS BIGINT) AS k, TRY_CAST(doc->>'$.who.id' AS BIGINT) AS who, doc->>'$.note' AS note, coalesce(json_type(doc->'$.k'), 'NULL') <> 'NULL' AS has_k, coalesce(json_type(doc->'$.who.id'), 'NULL') <> 'NULL' AS has_who FROM docs)
SELECT event_id, reason, k, who, note, concat(CASE WHEN has_k AND k IS NULL THEN 'k' ELSE '' END, CASE WHEN has_who AND who IS NULL THEN 'who' ELSE '' END) AS retyped FROM read_"""


@query(_VARIANT)
def s8_log_documents(spark, sf_dir):
    rows = documents.parsed(fixtures.documents_log(spark, sf_dir), "body")
    read = documents.typed(rows, {"k": ("$.k", "long"), "who": ("$.who.id", "long"), "note": ("$.note", "string")})
    return read.select("event_id", "reason", "k", "who", "note", F.array_join("retyped", "").alias("retyped"))


@query(with_(oracles.LOG, "SELECT event_id, action, 'say \"' || verified_text || '\", twice' AS verified_text FROM log"))
def s14_export(spark, sf_dir):
    path = fresh_path(spark, "export")
    rows = fixtures.audit_events(spark, sf_dir).select("event_id", "action", F.concat(F.lit('say "'), "verified_text", F.lit('", twice')).alias("verified_text"))
    files.write_csv_export(rows, path)
    return spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


@query()
def t3_t4_s2_s13_benchmark(spark, sf_dir):
    rows = glyphs.benchmark_fields(spark, 150)
    path = fresh_path(spark, "benchmark")
    meta = files.build_benchmark(rows, glyphs.field_images(spark, rows), path)
    images = files.read_images(spark, f"{path}/images").select(F.element_at(F.split("origin", "/"), -1).alias("filename"), "height", "width")
    return meta.withColumn("filename", F.element_at(F.split("image_path", "/"), -1)).join(images, "filename").select("field_id", "field_type", "ground_truth", "is_comb_box", "num_chars", "height", "width")


@query()
def i20_i22_segmented(spark, sf_dir):
    rows = glyphs.benchmark_fields(spark, 150)
    path = fresh_path(spark, "fields")
    files.build_benchmark(rows, glyphs.field_images(spark, rows), path)
    images = files.read_images(spark, f"{path}/images").withColumn("id", F.regexp_extract("origin", r"field_(\d+)_", 1).cast("long"))
    cut = fields.segment(rows.withColumn("cells", F.length("ground_truth")).join(images, "id"), ["field_type", "id"])
    return cut.select("field_type", "id", "pos", "x", "y", "w", "h", F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 3).alias("ink"))


@query()
def r1_s10_logits(spark, sf_dir):
    path = fresh_path(spark, "network")
    network.save_checkpoint(spark, network.drawn_weights(7), path)
    read = recognize.hypotheses(network.classify(glyphs.glyph_set(spark, 10), network.load_checkpoint(spark, path)), C.FULL_VOCABULARY)
    return read.select("label", "sample", "ch", F.round("conf", 3).alias("conf"))
