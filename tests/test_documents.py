"""Log documents of varying shape."""

from glyphmill.sources import documents

CASES = {
    '{"k": 1, "who": {"id": "a"}}': ("ok", 1, "a", []),
    '{"k": "12"}': ("ok", 12, None, []),
    '{"k": "twelve"}': ("ok", None, None, ["k"]),
    '{"k": 1.5}': ("ok", 1, None, []),
    '{"k": {"v": 2}, "who": null}': ("ok", None, None, ["k"]),
    '{"k": null}': ("ok", None, None, []),
    '{"who": {"id": [1]}}': ("ok", None, "[1]", []),
    "{}": ("ok", None, None, []),
    '{"k": 1': ("broken", None, None, []),
    '{"k": 1} x': ("ok", 1, None, []),
    '{"k": 1, "k": 2}': ("broken", None, None, []),
    "no json": ("broken", None, None, []),
    "[1, 2]": ("not an object", None, None, []),
    "null": ("not an object", None, None, []),
    "7": ("not an object", None, None, []),
    "  ": ("empty", None, None, []),
    "": ("empty", None, None, []),
    None: ("empty", None, None, []),
}


def test_documents(spark):
    rows = documents.parsed(spark.createDataFrame([(k, "kept") for k in CASES], "body string, other string"), "body")
    got = {r.body: (r.reason, r.k, r.who, r.retyped) for r in documents.typed(rows, {"k": ("$.k", "long"), "who": ("$.who.id", "string")}).collect()}
    assert got == CASES
    good, bad = documents.split(rows)
    assert good.count() == 9 and bad.count() == 9 and "doc" not in bad.columns and bad.where("other = 'kept'").count() == 9
    shape = documents.shape_of(rows).first()
    assert shape.documents == {"ok": 9, "broken": 3, "not an object": 3, "empty": 3} and shape["shape"].startswith("OBJECT<") and "who" in shape["shape"]


def test_no_documents(spark):
    rows = documents.parsed(spark.createDataFrame([], "body string"), "body")
    assert rows.count() == 0 and documents.typed(rows, {"k": ("$.k", "long")}).count() == 0
