"""Hand-worked cases of the reading rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import constants
from glyphmill.functions.chars import HYPOTHESES, field_kind
from glyphmill.operators import catalog, decode, evaluate, glyphs, modes, network, recognize, verify
from glyphmill.operators import fields as picture
from glyphmill.plans import fixtures
from glyphmill.plans.registry import QUERIES
from glyphmill.sources import files

KEYS = ["id"]


def read(text, conf=0.99, alts=None):
    return [(c, conf, (alts or {}).get(i, [])) for i, c in enumerate(text)]


def frame(spark, rows):
    return spark.createDataFrame(rows, f"id int, field_type string, hyp {HYPOTHESES}")


DATES = [
    ("18/09/9006", "18/09/2006", True),
    ("18/09/9987", "18/09/1987", True),
    ("01.05.2001", "01-05-2001", True),
    ("01/05-2001", "01/05/2001", True),
    ("05/00/2001", "05/10/2001", True),
    ("45/05/2001", "15/05/2001", True),
    ("31-06-2008", "31-06-2008", True),
    ("39/05/2001", "39/05/2001", False),
    ("O1/O5/2OO1", "01/05/2001", True),
    ("18/09/9501", "18/09/1501", False),
    ("18/0", "18/1", False),
    ("", "", False),
]


def test_dates(spark):
    rows = decode.decode_dates(frame(spark, [(i, "date", read(raw)) for i, (raw, _, _) in enumerate(DATES)])).orderBy("id").collect()
    assert [(r.text, r.valid) for r in rows] == [(text, valid) for _, text, valid in DATES]
    assert {r.fsm_conf for r in rows} == {0.96, 0.65}


def test_date_alternatives(spark):
    row = decode.decode_dates(frame(spark, [(0, "date", read("X5/45/2001", alts={0: [("Q", 0.3), ("2", 0.2)], 3: [("9", 0.3), ("1", 0.1)]}))])).first()
    assert row.text == "25/15/2001" and row.notes.count("|") >= 1


PIN_LEXICON = [("pin", "123456", None), ("pin", "799999", None)]


def test_pins(spark):
    lexicon = spark.createDataFrame(PIN_LEXICON, "kind string, entry string, prefix string")
    rows = decode.decode_pins(frame(spark, [(0, "pin", read("123456", 0.8)), (1, "pin", read("129456", alts={2: [("3", 0.4)]})), (2, "pin", read("12345")), (3, "pin", read("000000"))]), lexicon).orderBy("id").collect()
    assert (rows[0].text, rows[0].fsm_conf, rows[0].valid) == ("123456", 0.8, True)
    assert (rows[1].text, rows[1].fsm_conf, rows[1].valid) == ("123456", 0.96, True)
    assert not rows[2].valid and rows[2].text == "123456"  # a short reading is flagged, not an error
    assert rows[3].fsm_conf == 0.70 and not rows[3].valid


def test_pins_without_lexicon(spark):
    empty = spark.createDataFrame([], "kind string, entry string, prefix string")
    row = decode.decode_pins(frame(spark, [(0, "pin", read("12A456"))]), empty).first()
    assert (row.text, row.valid, row.fsm_conf) == ("120456", True, 0.99)


def test_codes(spark):
    lexicon = spark.createDataFrame([("code", "AB-1111", "AB"), ("code", "XYZ-2222", "XYZ")], "kind string, entry string, prefix string")
    rows = frame(spark, [(0, "code", read("AB-1234")), (1, "code", read("A8-1234", alts={1: [("B", 0.3)]})), (2, "code", read("XYQ-123Z", alts={7: [("2", 0.4)]}))])
    kept = decode.decode_codes(rows, lexicon).orderBy("id").collect()
    assert [(r.text, r.fsm_conf) for r in kept] == [("AB-1234", 0.96), ("AB-1234", 0.96), ("XYZ-1232", 0.95)]
    whole = decode.decode_codes(rows, lexicon, registry_substitution=True).orderBy("id").collect()
    assert [r.text for r in whole] == ["AB-1111", "AB-1111", "XYZ-2222"]


def test_lexicon_order_does_not_matter(spark):
    rows = frame(spark, [(0, "pin", read("555555"))])
    texts = {decode.decode_pins(rows, spark.createDataFrame(lex, "kind string, entry string, prefix string")).first().text for lex in (PIN_LEXICON, PIN_LEXICON[::-1])}
    assert len(texts) == 1


def test_verifier(spark):
    rows = frame(spark, [(0, "date", read("39x13y2001")), (1, "code", read("1B/12O4", alts={0: [("Q", 0.2)]})), (2, "pin", read("12E4567")), (3, "date", read("39/1")), (4, "other", read("abc"))])
    got = verify.verify(rows.withColumn("text", F.array_join(F.transform("hyp", lambda x: x["ch"]), ""))).orderBy("id").collect()
    assert [(r.verified_text, r.sem_conf) for r in got] == [("29-03-2001", 0.95), ("QB-1204", 0.96), ("120456", 0.97), ("39/1", 0.90), ("abc", 0.90)]


def test_gate_and_fusion(spark):
    rows = spark.createDataFrame([(0.85, True), (0.8499, True), (0.99, False)], "conf double, syntax_valid boolean")
    assert [(r.status, r.reason) for r in modes.gate(rows).collect()] == [("APPROVED", "passed"), ("FLAGGED", "confidence"), ("FLAGGED", "syntax")]
    level = spark.createDataFrame([(0.8, 0.97), (0.86, 0.95)], "a double, b double").select(modes.fused(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.c for r in level] == [0.8, 0.95]


def test_modes_and_evaluation(spark):
    fields = frame(spark, [(0, "date", read("18/09/9006")), (1, "pin", read("123456"))]).withColumn("ground_truth", F.when(F.col("id") == 0, "18/09/2006").otherwise("123456"))
    lexicon = spark.createDataFrame(PIN_LEXICON, "kind string, entry string, prefix string")
    predictions = modes.read_fields(fields, lexicon)
    board = {r.mode: r for r in evaluate.leaderboard(predictions).collect()}
    assert (board["raw_cnn"].exact_rate, board["raw_cnn"].char_accuracy) == (50.0, 93.75)
    assert board["tri_engine"].exact_rate == 100.0
    sweep = evaluate.threshold_sweep(predictions).orderBy("theta").collect()
    assert [r.accepted for r in sweep] == sorted((r.accepted for r in sweep), reverse=True)
    assert [(r.truth, r.pred, r.n) for r in evaluate.top_confusions(predictions).collect()] == [("2", "9", 1)]


@pytest.mark.parametrize(("label", "kind"), [("PIN Code (######)", "pin"), ("Date", "date"), ("Short Code", "code"), ("Name", "other")])
def test_kinds(spark, label, kind):
    assert spark.range(1).select(field_kind(F.lit(label)).alias("k")).first().k == kind


def test_files(spark, tmp_path):
    meta = spark.createDataFrame([(1, "pin", "012345", True, "C:\\a\\b.png", 6)], files.METADATA)
    files.write_metadata(meta, str(tmp_path / "m"))
    assert files.read_metadata(spark, str(tmp_path / "m")).first().ground_truth == "012345"
    (tmp_path / "log.json").write_text('{"audit_id": "a", "min_conf": 0.5}\nnot json\n')
    assert [r.audit_id for r in files.read_audit(spark, str(tmp_path / "log.json")).collect()] == ["a"]
    assert files.history_rows([0.5, 0.1], [90.0, 99.0], spark).count() == 2


def test_images(spark, tmp_path):
    fields = spark.createDataFrame([("pin", 1, "123456", True)], "field_type string, id long, ground_truth string, is_comb_box boolean")
    row = glyphs.field_images(spark, fields).first()
    (tmp_path / row.filename).write_bytes(row.content)
    (tmp_path / "broken.png").write_bytes(b"no image")
    got = files.read_images(spark, str(tmp_path)).collect()
    want = glyphs.field_image("123456", 1, True)
    assert [(r.height, r.width, r.nChannels) for r in got] == [want.shape] and bytes(got[0].data) == want.tobytes()
    uri = spark.createDataFrame([(bytearray(row.content),)], "c binary").select(catalog.data_uri(F.col("c")).alias("u")).select(catalog.from_data_uri(F.col("u")).alias("b")).first().b
    assert bytes(uri) == row.content


def test_recognizer(spark, tmp_path):
    rows = glyphs.glyph_set(spark, 20).cache()
    model, history = glyphs.train_with_history(rows, epochs=3, rounds=15)
    got = glyphs.recognized(model, glyphs.split(rows)[1])
    told = {r.epoch: r for r in history.collect()}
    best = glyphs.best_epoch(history).first()
    assert best.accuracy == max(r.accuracy for r in told.values()) == pytest.approx(glyphs.accuracy(got).first().accuracy)
    assert best.accuracy > 60 and told[3].loss < told[1].loss and len(got.first().logits) == 39
    files.write_history(history, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 3


def test_components_touch_at_corners():
    mask = np.zeros((5, 6), bool)
    mask[0, 0] = mask[1, 1] = mask[3, 4] = True
    label, boxes = picture.components(mask)
    assert sorted(boxes) == [(0, 0, 2, 2, 2), (4, 3, 1, 1, 1)] and label.max() == 2 and (label > 0).sum() == 3
    assert picture.components(np.zeros((3, 3), bool))[1] == [] and picture.components(np.ones((3, 3), bool))[1] == [(0, 0, 3, 3, 9)]


def test_classes_are_digits_then_signs_then_letters():
    assert len(constants.FULL_VOCABULARY) == 39
    assert [constants.FULL_VOCABULARY.index(c) for c in "09/-.AZ"] == [0, 9, 10, 11, 12, 13, 38]


def _plain_forward(w, patch):
    """The network pixel by pixel, batch norms unfolded."""
    norm = lambda x, n: (x - w[f"{n}.running_mean"]) / np.sqrt(w[f"{n}.running_var"] + 1e-5) * w[f"{n}.weight"] + w[f"{n}.bias"]
    x = patch[None].astype(float)
    for conv, bn, _, after in network.CONVOLUTIONS:
        _, h, wd = x.shape
        pad = np.pad(x, ((0, 0), (1, 1), (1, 1)))
        y = np.zeros((after, h, wd))
        for i in range(h):
            for j in range(wd):
                y[:, i, j] = np.maximum(norm((w[f"{conv}.weight"] * pad[None, :, i : i + 3, j : j + 3]).sum((1, 2, 3)) + w[f"{conv}.bias"], bn), 0)
        if conv in network.POOLED_AFTER:
            y = np.array([[[m[i : i + 2, j : j + 2].max() for j in range(0, wd, 2)] for i in range(0, h, 2)] for m in y])
        x = y
    x = np.maximum(norm(w["fc1.weight"] @ x.reshape(-1) + w["fc1.bias"], "bn_fc1"), 0)
    return w["fc_out.weight"] @ x + w["fc_out.bias"]


def test_network_equals_a_plain_version_and_its_checkpoint(spark, tmp_path):
    weights = network.drawn_weights(3)
    assert sum(w.size for n, w in weights.items() if "running" not in n) == 674_567
    patch = np.random.default_rng(1).random((32, 32)).astype(np.float32)
    want = _plain_forward(weights, patch)
    network.save_checkpoint(spark, weights, str(tmp_path / "net"), best_accuracy=99.0)
    net = network.load_checkpoint(spark, str(tmp_path / "net"))
    assert np.allclose(net.forward(patch[None])[0], want, rtol=1e-3, atol=1e-3)
    rows = spark.createDataFrame([(1, patch.reshape(-1).tolist()), (2, None)], "id int, features array<float>")
    got = {r.id: r.logits for r in network.classify(rows, net).collect()}
    assert np.allclose(got[1], want, rtol=1e-3, atol=1e-3) and got[2] is None
    assert network.load_checkpoint(spark, str(tmp_path / "none")) is network.load_checkpoint(spark, None) is None
    none = recognize.hypotheses(network.classify(rows, None), "0123456789").collect()
    assert {(r.ch, r.conf) for r in none} == {("?", 0.5)}
    with pytest.raises(ValueError):
        network.Network(weights, "0123")


def test_images_become_texts(spark, tmp_path):
    """Benchmark images are written, read, cut and classified; each field gives as many characters as it has cells."""
    fields = glyphs.benchmark_fields(spark, 24)
    meta = files.build_benchmark(fields, glyphs.field_images(spark, fields), str(tmp_path))
    assert meta.count() == 24 and {r.field_type for r in meta.collect()} == {"date", "pin", "code"}
    images = files.read_images(spark, str(tmp_path / "images")).withColumn("filename", F.element_at(F.split("origin", "/"), -1))
    rows = meta.withColumn("filename", F.element_at(F.split("image_path", "/"), -1)).join(images, "filename").withColumn("cells", F.col("num_chars"))
    keys = ["field_type", "field_id", "ground_truth", "is_comb_box"]
    cut = picture.segment(rows, keys).cache()
    counts = cut.groupBy(*keys).count().collect()
    assert all(r["count"] == len(r.ground_truth) for r in counts if r.is_comb_box) and len(counts) == 24
    assert cut.where("size(features) <> 1024").count() == 0
    net = network.Network(network.drawn_weights(1))
    read = recognize.hypotheses(network.classify(cut, net), "0123456789")
    texts = modes.read_fields(picture.hypotheses_of(read, keys), spark.createDataFrame([], "kind string, entry string, prefix string")).collect()
    assert len(texts) == 3 * 24 and all(r.latency_ms is None for r in texts)


def test_glyphs_of_the_same_drawing_look_alike_in_a_cell_and_alone():
    """Cutting and normalization undo the grid: a glyph in a comb cell is nearest to its own drawing."""
    hits = 0
    for k, text in enumerate(["123456", "ABCDEF", "90/12-77"]):
        image = glyphs.field_image(text, 40 + k, True)
        found = picture.cut(image, True, len(text))
        for place, (_, crop) in enumerate(found):
            patch = picture.normalized(crop)
            c = glyphs.C.FULL_VOCABULARY.index(text[place])
            distance = [min(np.abs(patch - picture.normalized(glyphs.drawn(v, s, 44, 44))).sum() for s in range(12)) for v in range(39)]
            hits += int(np.argmin(distance) == c)
    assert hits >= 14  # of 20


def test_cutting_agrees_with_the_relations(spark):
    """The same cells, cleaned ink and slices as operators.segment gives on the pixels of the fixture's images."""
    sf = "/root/testdata/sf0.001"
    rows = fixtures.pixels(spark, sf).collect()
    cells = {}
    for r in QUERIES["i5_i7_cells"](spark, sf).collect():
        cells.setdefault(r.img_id, {})[r.cell] = (r.left, r.right)
    cleaned = {(r.img_id, r.y, r.x) for r in QUERIES["i8_i10_cleaned"](spark, sf).collect()}
    slices = {(r.img_id, r.cell): (r.x, r.right) for r in QUERIES["i14_slices"](spark, sf).collect()}
    for image in sorted({r.img_id for r in rows}):
        level = np.zeros((40, 40), np.uint8)
        for r in rows:
            if r.img_id == image:
                level[r.y, r.x] = r.v
        ink = level <= 210
        n = 5 if image % 2 == 0 else 12
        assert picture.comb_spans(ink, n) == [cells[image][k] for k in range(n)]
        clear = ink & ~picture.runs(ink, 20)
        assert {(image, int(y), int(x)) for y, x in zip(*np.nonzero(clear[2:38, 2:38]), strict=True)} == {(i, y - 2, x - 2) for i, y, x in cleaned if i == image}
        if not ink.any():
            found = picture.cut(level, False, None)
            assert [(b[0], b[0] + c.shape[1]) for b, c in found] == [slices[image, k] for k in range(6)]


def test_normalized_patches():
    level = np.full((30, 30), 250, np.uint8)
    assert picture.normalized(level).sum() == 0 and picture.normalized(np.zeros((0, 5), np.uint8)).sum() == 0
    level[:, 0] = 0  # a grid line alone: all ink counts
    assert picture.normalized(level).any()
    level[10:20, 12:16] = 0
    patch = picture.normalized(level)
    y, x = np.nonzero(patch)
    assert (np.ptp(y) + 1, np.ptp(x) + 1) == (24, 10) and set(np.unique(patch)) == {0.0, 1.0}
    assert np.array_equal(patch, picture.normalized(255 - level))  # either polarity
    dot = np.full((30, 30), 250, np.uint8)
    dot[14:19, 14:19] = 0
    assert (picture.normalized(dot) > 0).sum() == 36
    wide = np.zeros((3, 40), np.uint8)
    assert picture.resized(np.arange(12, dtype=np.uint8).reshape(3, 4) * 20, 2, 2, True).tolist() == [[37, 77], [143, 183]]
    assert picture.gray(np.array([[[10, 20, 30]]], np.uint8)).tolist() == [[22]] and picture.gray(wide) is wide


def test_free_fields_merge_strokes():
    ink = np.zeros((40, 120), bool)
    ink[10:30, 10:14] = ink[10:30, 16:20] = True  # two strokes of one character
    ink[10:30, 60:68] = True
    ink[35, 5:100] = True  # the underline
    ink[20, 90:92] = True  # too small
    assert picture.free_boxes(ink, 3) == [(10, 10, 10, 20), (60, 10, 8, 20)]
    assert picture.free_boxes(np.zeros((40, 120), bool), 3) == []


def test_audit_stream(spark, tmp_path):
    from glyphmill.streaming import audit_stream

    log = spark.createDataFrame([(1, "ACCEPT", 1.0), (2, "REJECT", 2.0)], "event_id long, action string, latency_s double").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 3600))
    log.write.parquet(str(tmp_path / "in"))
    stream = audit_stream.action_stream(audit_stream.read_log_stream(spark, str(tmp_path / "in"), log.schema))
    run = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("counts").count() == 2
    audit_stream.append_log(audit_stream.read_log_stream(spark, str(tmp_path / "in"), log.schema), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_the_registered_glyph_set_has_500_of_each_class(spark):
    counts = QUERIES["t1_t5_glyph_set"](spark, "").groupBy("label").count().collect()
    assert len(counts) == 39 and {r["count"] for r in counts} == {500}
