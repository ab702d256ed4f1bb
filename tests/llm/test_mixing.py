import os

import pytest

from pagemill.llm.mixing import DEFAULT_TOKENIZER, encoder, mix_sources

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_TOKENIZER), reason="no tokenizer files")
TARGETS = "source string, target_share double, max_repeats int"


def docs(spark, sizes):
    rows, i = [], 0
    for source, n in sizes:
        for _ in range(n):
            rows.append((i, "one two three four five six seven eight", source, 3))
            i += 1
    rows += [(i, None, "a", 1), (i + 1, "", "a", 1), (i + 2, "text", None, 1), (i + 3, "text", "other", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")


def test_shares_caps_and_reports(spark):
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("none", 0.1, 3), ("c", 0.1, 2), ("zero", 0.0, 2), (None, 0.1, 2)], TARGETS)
    sel, shares = mix_sources(docs(spark, [("a", 3000), ("b", 300), ("c", 900)]), t)
    got = {r.source: r for r in shares.collect()}
    copies = {r["id"]: r["count"] for r in sel.groupBy("id").count().collect()}
    per = {s: [n for r in sel.select("id", "source").distinct().collect() if r.source == s for n in [copies[r["id"]]]] for s in "abc"}
    assert max(per["a"]) == 1 and set(per["b"]) == {4} and max(per["c"]) == 1
    assert got["none"].tokens_reached == 0 and got["none"].rate is None and "other" not in got
    whole = 0.5 + 0.3 + 0.1
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(got[s].share_reached - share / whole) < 0.03
        assert got[s].most_repeats <= got[s].max_repeats
    assert sum(r.share_reached for r in got.values()) == pytest.approx(1)


def test_same_draw_each_time_and_no_bias_by_partition(spark):
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS)
    d = docs(spark, [("a", 400), ("b", 100)])
    one = sorted(map(tuple, mix_sources(d, t)[0].collect()))
    assert one == sorted(map(tuple, mix_sources(d.repartition(7), t)[0].collect()))
    assert one != sorted(map(tuple, mix_sources(d, t, seed=18)[0].collect()))


def test_empty(spark):
    t = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    sel, shares = mix_sources(docs(spark, []).limit(0), t)
    assert sel.count() == 0 and [r.tokens_reached for r in shares.collect()] == [0]
    assert mix_sources(docs(spark, [("a", 3)]), t.limit(0))[0].count() == 0


def test_tokens_are_of_the_whole_text():
    text = "Die Brücke <|endoftext|> ist 12345 offen.\n\n" * 500
    e = encoder()
    assert e.decode(e.encode_ordinary(text)) == text
