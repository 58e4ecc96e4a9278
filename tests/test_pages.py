"""The renderer of whole pages against the one by joins."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import render as R
from vellum.plans import registry
from vellum.sources import pdf

MODES = ["rowfill", "ct120", "legacy"]


def page(rng, number):
    """Characters, words and cells of a page: ruled grids (some with a cell in a cell, turned text, blank rows), two columns."""
    chars, words, cells = [], [], []

    def say(x, y, text, upright=True):
        for k, c in enumerate(text):
            chars.append((x + 5.0 * k + rng.random() / 10, y + rng.random(), x + 5.0 * k + 5, y + 10.0, 10.0, c, upright))
        words.append((x, y, x + 5.0 * len(text), y + 10.0))

    if number % 3 == 0:
        for k in range(90):
            say(30.0 + (k % 6) * 40 + (k % 6 // 3) * 180, 20.0 + k // 6 * 14, rng.choice(["ab", "cde", "x|", "  q"]))
    for g in range(rng.randrange(4)):
        x, y, turned = 40.0 + rng.randrange(5) * 60, 240.0 + g * 130, rng.random() < 0.2
        rows, cols = rng.randrange(1, 5), rng.randrange(1, 4)
        for r in range(rows):
            for c in range(cols):
                cells.append((g, r, c, x + 90 * c, y + 24 * r, x + 90 * c + 90, y + 24 * r + 24))
                if rng.random() < 0.7:
                    say(x + 90 * c + 6, y + 24 * r + 6, rng.choice(["a b", "7|8", "é", "w" * 14, " "]), not turned)
        if rng.random() < 0.4:
            cells.append((g, rows, 0, x + 4, y + 2, x + 60, y + 22))
        if rng.random() < 0.3:
            cells.append((g + 10, 0, 0, x - 5, y - 5, x + 400, y + 120))
    for k in range(rng.randrange(5)):
        say(50.0 + rng.randrange(300), 700.0 + k * 8 * rng.random(), "line %d" % k)
    return chars, words, cells


def test_whole_pages_are_rendered_as_by_joins(spark):
    rng = random.Random(3)
    rows = []
    for n in range(60):
        base = (n // 2, n % 2 + 1)
        chars, words, cells = page(rng, n)
        rows.append((*base, "page", None, None, None, None, 0.0, 0.0, 612.0, 792.0, None, None, None))
        rows += [(*base, "char", k, None, None, None, *c[:4], c[5], c[4], c[6]) for k, c in enumerate(chars)]
        rows += [(*base, "word", k, None, None, None, *w, None, None, None) for k, w in enumerate(words)]
        rows += [(*base, "cell", None, *c, None, None, None) for c in cells]
    columns = "doc_id int, page_no int, kind string, seq long, grid_id int, row int, col int, x0 double, top double, x1 double, bottom double, text string, size double, upright boolean"
    parts = spark.createDataFrame(rows, columns).coalesce(1)
    got = {(r["doc_id"], r["page_no"], r["mode"]): r["text"] for r in R.render_parts(parts, MODES).collect()}
    documents = {(r["doc_id"], r["mode"]): r["text"] for r in R.documents_of_parts(parts, MODES).collect()}
    for mode in MODES:
        want = R.render_pages(*pdf.parts(parts), mode=mode)
        assert {k[:2]: v for k, v in got.items() if k[2] == mode} == {(r["doc_id"], r["page_no"]): r["text"] for r in want.collect()}
        want_ = R.render_documents(*pdf.parts(parts), mode=mode)
        assert {k[0]: v for k, v in documents.items() if k[1] == mode} == {r["doc_id"]: r["text"] for r in want_.collect()}
        R.release(want)
        R.release(want_)
    assert len({v for k, v in got.items() if k[2] == "rowfill"} - {v for k, v in got.items() if k[2] == "legacy"}) > 5


@pytest.mark.parametrize("name", ["render_page", "variant_sweep", "pdf_convert"])
def test_pages_are_rendered_without_moving_their_characters(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "InMemoryTableScan" not in plan


def test_runs_are_characters_in_equal_steps(spark):
    run = spark.createDataFrame([(1, "page", 1, 0.0, 0.0, 612.0, 792.0, None), (1, "run", 1, 10.0, 10.0, 40.0, 20.0, "ab cd é"[:6]), (1, "run", 1, 90.0, 10.0, 100.0, 20.0, "xy")], "doc_id int, kind string, page_no int, x0 double, top double, x1 double, bottom double, text string")
    run = run.withColumns({"size": F.lit(10.0), "upright": F.lit(True), "grid_id": F.lit(None).cast("int"), "row": F.lit(None).cast("int"), "col": F.lit(None).cast("int")}).coalesce(1)
    assert [r["text"] for r in R.render_parts(run, ["rowfill"]).collect()] == ["ab cd xy"]


def test_measuring_moves_no_character_and_broadcasts_nothing_once_its_scores_are_kept(spark):
    query = lambda: registry.queries()["corpus_measure"](spark, "/root/testdata/sf0.001")
    first = query()
    first.collect()
    plan = query()._jdf.queryExecution().executedPlan().toString()
    R.release(first)
    assert "Broadcast" not in plan
    assert "kind" not in plan
