import json

from pagemill.operators.nested import apply_schema, flat_tables, flatten_records


def make(spark, payloads):
    return spark.createDataFrame([(i, p, "clash") for i, p in enumerate(payloads)], "rec_id long, payload string, node_kind string")


def found(spark, payloads):
    return sorted(map(tuple, flatten_records(make(spark, payloads)).select("rec_id", "node_kind", "node_path").collect()))


FULL = {"blocks": [None, {"bbox": [1, 2, 3, 4], "lines": [{"bbox": {"x0": 1, "y0": 2, "x1": 3, "y1": "4"}, "spans": {"text": "ab", "size": "11.0", "chars": [{"c": "a", "bbox": [1, 2, 3, 4]}, None, 7, {"c": "\ud800"}]}}, None]}]}


def test_paths_and_holes(spark):
    want = [(0, "block", "1"), (0, "char", "1/0/0/0"), (0, "char", "1/0/0/3"), (0, "line", "1/0"), (0, "span", "1/0/0")]
    assert found(spark, [json.dumps(FULL)]) == want
    assert found(spark, [json.dumps({"engine": "x", "page": {"text_dict": FULL}})]) == want
    assert found(spark, [json.dumps([FULL])]) == want


def test_nothing_from_broken_or_empty(spark):
    text = json.dumps(FULL)
    bad = [None, "", "null", "[]", "{}", '{"blocks":null}', '{"blocks":[]}', '{"blocks":3}', text[:-1], text + "x", '{"blocks":[{"number":NaN}]}', "[" * 100_000, '{"blocks":[{"lines":"x"}], "a": "\x01"}']
    assert found(spark, bad) == []
    assert found(spark, []) == []


def test_typed_tables_link_to_parents(spark):
    t = flat_tables(make(spark, [json.dumps(FULL)] * 2))
    chars = t["char"].orderBy("rec_id", "position").collect()
    assert [(r.rec_id, r.span_path, r.position, r.x1) for r in chars] == [(i, "1/0/0", p, x) for i in (0, 1) for p, x in ((0, 3.0), (3, None))]
    assert chars[0].c == "a" and chars[1].c in ("\ufffd", "?")
    span = t["span"].first()
    assert (span.line_path, span.text, span.size, span.flags, span.x0) == ("1/0", "ab", 11.0, None, None)
    line = t["line"].filter("rec_id = 0").first()
    assert (line.block_path, line.x0, line.y1) == ("1", 1.0, 4.0)
    assert t["block"].count() == 2


def test_misfit_becomes_null(spark):
    bad = {"blocks": [{"number": "seven", "bbox": "none", "type": 1.0}]}
    r = apply_schema(flatten_records(make(spark, [json.dumps(bad)])), "block").first()
    assert (r.number, r.x0, r.type) == (None, None, 1)
    assert json.loads(r.extra) == {"number": "seven", "bbox": "none"}


def test_nothing_is_lost(spark):
    doc = {"blocks": [{"number": "3x", "mood": {"a": [1, None]}, "lines": [{"spans": [{"text": 5, "size": True, "bbox": [1, 2], "chars": [{"c": "a", "fontId": 2**40}]}], "dir": ["x", 0]}]}]}
    t = {k: v.first() for k, v in flat_tables(make(spark, [json.dumps(doc)])).items()}
    assert json.loads(t["block"].extra) == {"number": "3x", "mood": {"a": [1, None]}} and t["block"].number is None
    assert json.loads(t["span"].extra) == {"size": True, "bbox": [1, 2]} and (t["span"].text, t["span"].x0, t["span"].x1) == ("5", 1.0, None)
    assert json.loads(t["line"].extra) == {"dir": ["x", 0]} and json.loads(t["char"].extra) == {"fontId": 2**40}
    assert (t["char"].c, t["char"].span_path, t["span"].line_path) == ("a", "0/0/0", "0/0")


def test_very_long_payload(spark):
    p = json.dumps({"blocks": [{"lines": [{"spans": [{"chars": [{"c": "x"}] * 50_000}]}]}]})
    assert flatten_records(make(spark, [p])).count() == 50_003


def test_deep_envelopes_and_several_records(spark):
    deep = FULL
    for k in range(50):
        deep = {"x": 1, f"e{k}": [deep]}
    want = found(spark, [json.dumps(FULL)])
    assert want and found(spark, [json.dumps(deep)]) == want
    assert found(spark, [json.dumps([{"a": [[FULL]]}, {"blocks": [{}] * 9}])]) == want  # the first one, depth first
