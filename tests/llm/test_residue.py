import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm.residue import ORDERS, PAGE_WINDOWS, WINDOW, Model, find_residue, fit_model, labelled_windows, learned_phrases, page_features, stream, train, weak_spans, window_features, without_residue

WORDS = "the baker closed market town river of bridge and council was sold to widow by harbour near school library again in haste every old new page found book".split()
RESIDUE = ["{{headline}}", "This page needs JavaScript to be enabled in your browser.", "502 Bad Gateway. Internal server error. Trace id 4f92", "Lorem ipsum dolor sit amet consectetur adipiscing elit veniam", "Body copy goes here, further copy goes here.", "Seite nicht gefunden. Bitte prüfen Sie die Adresse."]
DECOYS = ["The page was not found in the parish book until Friday.", "An error of 502 pounds was found in the accounts.", "Access to all but members was refused [see table].", "The script of the new play is required by the mill."]
BOXES = "array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>"
DDL = f"doc_id long, text string, line_boxes {BOXES}, paper_id string, score string"


def article(rng, n=60):
    w = [rng.choice(WORDS)]
    while len(w) < n:
        w.append(rng.choice([x for x in WORDS if x != w[-1]]))
    return "\n".join(" ".join(w[i : i + 6]) for i in range(0, n, 6))


def corpus():
    rng = random.Random(1)
    rows, truth = [], set()
    for i in range(900):
        text = article(rng)
        if i % 9 == 0:
            r = RESIDUE[(i // 9) % len(RESIDUE)]
            text = r if i % 27 == 0 else f"{article(rng, 30)}\n{r}\n{article(rng, 30)}"
            truth.add(i)
        elif i % 9 < 4:
            text = f"{article(rng, 30)}\n{DECOYS[i % len(DECOYS)]}\n{article(rng, 30)}"
        rows.append((i, text, None, f"np-{i % 23}", "clash"))
    rows += [(1000, None, None, "x", "c"), (1001, "", [], None, "c"), (1002, "a", None, None, "c"), (1003, "x " * 100_000 + RESIDUE[1], None, None, "c"), (1004, "Thls page needs JavaScr1pt to he ena-\nbled in yonr browser.", None, None, "c"), (0, RESIDUE[0], None, "np-0", "c"), (None, RESIDUE[1], None, "np-0", "c")]
    return rows, truth | {1003, 1004}


def test_finds_pages_and_leaves_decoys(spark):
    rows, truth = corpus()
    df = spark.createDataFrame(rows, DDL)
    found = find_residue(df)
    got = {r.id for r in found.collect()}
    assert got == truth
    left = without_residue(df, found)
    assert left.count() == df.count() - len(truth) - 1 and left.columns == df.columns
    figures = fit_model(df)[1]
    assert figures["precision"] > 0.9 and figures["recall"] > 0.9 and figures["held_positive"] > 10


def test_empty_and_without_residue(spark):
    assert find_residue(spark.createDataFrame([], DDL)).count() == 0
    rng = random.Random(3)
    assert find_residue(spark.createDataFrame([(i, article(rng), None, "p", "") for i in range(50)], DDL)).count() == 0


def test_window_scores_are_those_of_single_windows():
    rng = np.random.default_rng(5)
    model = Model(rng.normal(size=1 << 18), 0.3)
    for text in ("short", "a" * WINDOW, "One line of text and another, x9 {{y}} to go on with for a while longer."):
        score, where, c, off = model.best_windows([text, ""])
        chars, _ = stream([text])
        n = len(chars)
        want = max(model.weights[window_features(chars[k : k + WINDOW], n, k == 0)].sum() + model.bias for k in range(max(1, n - WINDOW + 1)))
        assert score[0] == pytest.approx(want, abs=1e-3) and score[1] == -np.inf and len(ORDERS) == 2


def test_training_separates_and_penalty_shrinks():
    f = [np.array([40 + k % 7, 60 if k % 2 else 61]) for k in range(200)]
    y = np.array([k % 2 for k in range(200)], float)
    m = train(f, y)
    assert m.weights[60] > 0.5 and m.weights[61] < -0.5
    assert abs(train(f, y, penalty=1.0).weights[60]) < abs(m.weights[60])


def test_weak_labels_read_through_damage():
    assert weak_spans("this poge needs javascrlpt to bc enabled") and not weak_spans("the page was not found in the parish book") and len(page_features(10, True)) == 3
    assert weak_spans("lorem ipsum dolor sit") == [(0, 21)] and not weak_spans("et dolore in town, neither he nor his")
    for text in ("error 999: gone", "please allow scripts and reload", "[user.name] said", "titel einfügen", "@@by_line@@", "tk tk", "foo foo foo foo", "your session is over"):
        assert weak_spans(text), text
    for text in ("an error of 999 pounds was found", "the script of the new play is required", "a filler of sand and the template", "write your name below the line", "who came to be read here"):
        assert not weak_spans(text), text


def test_windows_of_a_page_are_bounded():
    got = labelled_windows("{{a}} " * 20_000, np.random.default_rng(0))
    assert len(got) == PAGE_WINDOWS and all(y == 1 for y, _, _ in got)
    assert labelled_windows("no connection. log in", np.random.default_rng(0), skip=frozenset(["short"]))[0][0] == 0


def test_short_pages_teach_phrases(spark):
    ddl = "id long, text string, boxes array<struct<x0:int>>, host string"
    short = spark.createDataFrame([(i, f"Fatal fehler: the quiet mill lost its way in the year {i} server", None, f"h{i}") for i in range(4)], ddl)
    pages = spark.createDataFrame([(i, "it came to pass lost its way in the year of grace " + article(random.Random(i)), None, "h") for i in range(9)], ddl)
    known = learned_phrases(short, pages)
    a, b = ("the baker came home and " * 20 + x + " again the baker came home" for x in ("the quiet mill lost", "its way in the year"))
    assert weak_spans(a, known) and not weak_spans(a) and not weak_spans(b, known)


def test_rules_left_out_are_measured(spark):
    rng = random.Random(9)
    marks = ["{{headline}}", "${headline}", "[[headline]]", "<%= headline %>", "#{headline}", "{% headline %}"]
    rows = [(i, f"{article(rng, 30)}\n{marks[i % 6]}\n{article(rng, 30)}" if i % 5 == 0 else article(rng), None, f"np-{i % 23}", "") for i in range(1500)]
    figures = fit_model(spark.createDataFrame(rows, DDL), skip=frozenset(["braces", "hash", "bracketed slot"]))[1]
    assert figures["held_unlisted"] > 20 and 0 <= figures["recall_unlisted"] <= 1 and figures["recall"] > 0.9
    assert fit_model(spark.createDataFrame(rows, DDL))[1]["held_unlisted"] == 0
