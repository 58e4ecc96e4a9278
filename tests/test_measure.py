"""The corpus measurement, file names and projections, end to end."""

import re

import pytest
from pyspark.sql import functions as F

from tests.pdf_files import FILES, grid, pdf, say
from vellum.functions import register
from vellum.functions import text as T
from vellum.operators import corpus, measure
from vellum.sources import pdf as P
from vellum.streaming import ingest


@pytest.fixture
def folders(tmp_path):
    a, b = tmp_path / "a", tmp_path / "b" / "deep"
    a.mkdir()
    b.mkdir(parents=True)
    table = pdf(say(72, 700, "total 12 of 30") + grid(72, 600, [["H", "I"], ["1", "2"], ["3", "4"]]), "0 0 m 9 9 l S")
    (a / "table.pdf").write_bytes(table)
    (b / "table.pdf").write_bytes(table)  # the same file again
    (b / "prose.pdf").write_bytes(pdf(say(72, 700, "word " + "x" * 30 + " 7")))
    (a / "broken.pdf").write_bytes(b"nothing")
    (a / "large.pdf").write_bytes(table + b" " * 5000)
    (a / "UPPER.PDF").write_bytes(table)
    (a / "notes.txt").write_text("no")
    return [str(a), str(tmp_path / "b")]


def test_measure(spark, folders):
    rows = {r["file"].rsplit("/", 1)[1]: r for r in measure.measure(spark, folders, limit=5000).collect()}
    assert set(rows) == {"table.pdf", "prose.pdf", "broken.pdf"}
    t, p = rows["table.pdf"], rows["prose.pdf"]
    assert (t["grids"], t["notext"], sorted(t["base"])) == (1, 1, sorted("12301234")) and (p["grids"], p["notext"], p["base"]) == (0, 0, "7")
    assert [(t[e]["digit_excess"], t[e]["digit_deficit"], t[e]["phantom_rows"]) for e in ("own", "stock")] == [(0, 0, 0)] * 2
    assert p["own"]["glued"] == 1 and rows["broken.pdf"]["own"] is None and rows["broken.pdf"]["unreadable"]
    report = {r["engine"]: r for r in measure.report(measure.measure(spark, folders, limit=5000)).collect()}
    r = report["own"]
    assert (r["n_docs"], r["n_broken"], r["gridless"], r["notext"], r["failures"], r["glued"], r["docs_with_glue"]) == (2, 0, 1, 1, 1, 1, 1)
    assert set(report) == {"own", "stock"} and r["median_glued"] == 0.5
    assert measure.measure(spark, folders, sample=2, seed=3).count() == 2
    assert {x["file"].rsplit("/", 1)[1] for x in measure.measure(spark, folders, limit=0).collect()} == {*rows, "large.pdf"}


def test_analyse_counts_pages_without_text(spark):
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()], "path string, content binary")
    got = {r["doc_id"]: r for r in measure.analyse(P.decode(files)).collect()}
    assert got["text_then_image"]["notext"] == 1 and got["ruled"]["grids"] == 1 and got["ruled"]["notext"] == 0


def test_sample_of_paths_and_of_large_numbers(spark):
    paths = spark.createDataFrame([(f"/in/{i}/Ä.pdf",) for i in range(50)], "path string")
    one = [r["path"] for r in corpus.seeded_sample(paths, 7, 1, "path").collect()]
    assert one == sorted(one) and len(set(one)) == 7 == len(set(one) & {f"/in/{i}/Ä.pdf" for i in range(50)})
    assert one == [r["path"] for r in corpus.seeded_sample(paths.repartition(9), 7, 1, "path").collect()]
    assert one != [r["path"] for r in corpus.seeded_sample(paths, 7, 2, "path").collect()]
    large = spark.range(4_000_000_000, 4_000_000_090)
    assert corpus.seeded_sample(large, 5, 1, "id").count() == 5 and corpus.seeded_sample(large, 500, 1, "id").count() == 90


def test_saved_names_are_unique(spark):
    done = spark.createDataFrame([("/in/report.pdf", "a", None), ("/in/report.docx", "b", None), ("/x/report.pdf", "c", None), ("/in/other.pdf", None, "broken")], "path string, text string, error string")
    got = {r["path"]: (r["filename"], r["status"], r["saved_as"], r["detail"]) for r in ingest.events(done).collect()}
    assert {got[p][2] for p in got} == {"report.md", "report (2).md", "report (3).md", None}
    assert got["/in/other.pdf"] == ("other.pdf", "error", None, "broken") and got["/in/report.docx"][:3] == ("report.docx", "ok", "report.md")
    taken = spark.createDataFrame([("report.md",), ("report (3).md",)], "filename string")
    again = {r["saved_as"] for r in ingest.events(done, taken).collect()}
    assert again == {"report (2).md", "report (4).md", "report (5).md", None}


def test_responses(spark):
    done = spark.createDataFrame([("/in/a.pdf", "x", None, 3, 2250, "page", 1), ("/in/b.pdf", None, "bad", None, None, None, None)], "path string, text string, error string, tokens_after int, tokens_before int, unit string, units int")
    assert [r.asDict(recursive=True) for r in ingest.responses(done).collect()] == [{"filename": "a.pdf", "content": "x", "tokens": {"before": 2250, "unit": "page", "units": 1, "after": 3}}]


TEXTS = ["", "a", "x" * 30 + " 12,5 ٣", "| a\n|b\r\n c|\n", "é" * 9, "\t| x", "a\n\nb\nc\n\n| d\ne", "y" * 301 + "\n|" + "z" * 400 + "|", "k\n[vellum: no extractable text layer on page 4]\nl", "a.tar.GZ", "https://x/y", "https://x/", '{"detail": "no"}', '{"x": 1}', "dir/ \t.pdf", "deck.pptx", "1" * 5 + "22", "a\x85|b\x1e| c"]


@pytest.mark.parametrize(("call", "column"), [
    ("glued(t)", T.glued), ("mojibake(t)", T.mojibake), ("mojibake_doc(t)", T.mojibake_doc), ("n_digits(t)", lambda t: F.size(T.digits(t))), ("digit_text(t)", T.digit_text),
    ("digits_beyond(digit_text(t), '1223')", lambda t: T.digits_beyond(T.digit_text(t), F.lit("1223"))), ("digits_beyond('1223', digit_text(t))", lambda t: T.digits_beyond(F.lit("1223"), T.digit_text(t))),
    ("numeric_tokens(t)", T.numeric_tokens), ("text_lines(t)", T.split_lines), ("size(text_lines(t))", T.line_count), ("pipe_rows(t)", T.pipe_rows), ("phantom_rows(t, 0)", lambda t: T.phantom_rows(t, F.lit(0))),
    ("blob_lines(t)", T.blob_lines), ("without_markers(t)", T.without_markers), ("reflow(t)", T.reflow), ("cell_text(t)", T.cell_text), ("escape_pipe(t)", T.escape_pipe),
    ("safe_stem(t)", T.safe_stem), ("file_suffix(t)", T.suffix_of), ("file_badge(t)", T.file_badge), ("size_label(length(t))", lambda t: T.size_label(F.length(t))), ("is_https_url(t)", T.is_https_url),
    ("error_detail(t)", T.error_detail), ("is_own_pdf('.PDF', cast(t as binary))", lambda t: T.is_own_pdf(F.lit(".PDF"), t.cast("binary"))), ("unit_of(file_suffix(t))", lambda t: T.unit_of(T.suffix_of(t))),
    ("tokens_before(file_suffix(t), length(t))", lambda t: T.tokens_before(T.suffix_of(t), F.length(t))), ("savings_percent(100, length(t))", lambda t: T.savings_percent(F.lit(100), F.length(t))),
    ("pipe_table(array(split(t, ' '), split(t, 'a')))", lambda t: T.pipe_table(F.array(F.split(t, " "), F.split(t, "a")))), ("no_text_marker(length(t))", lambda t: T.no_text_marker(F.length(t))),
    ("is_real_table(array(split(t, ' '), split(t, 'a')))", lambda t: T.is_real_table(F.array(F.split(t, " "), F.split(t, "a")))),
])
def test_sql_functions_agree_with_columns(spark, call, column):
    register.register(spark)
    d = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in d.select("t", F.expr(call).alias("sql"), column(F.col("t")).alias("own")).collect():
        assert r["sql"] == r["own"], r["t"]


def test_blank_cells_are_blank_in_sql_too(spark):
    register.register(spark)
    rows = [["a", "b"], ["\t", " "], [" ", "c"]]
    d = spark.createDataFrame([(rows,)], "g array<array<string>>")
    assert tuple(d.select(F.expr("is_real_table(g)"), T.is_real_table(F.col("g"))).first()) == (False, False)


def test_line_metrics_against_plain_python(spark):
    d = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in d.select("t", T.line_count(F.col("t")).alias("n"), T.blob_lines(F.col("t")).alias("b"), T.paragraph_cells(F.col("t")).alias("p")).collect():
        lines = r["t"].splitlines()
        cells = [c for x in lines if x.startswith("|") for c in x.split("|")]
        assert (r["n"], r["b"], r["p"]) == (len(lines), sum(len(x) > 300 for x in lines), sum(len(c) > 300 for c in cells)), r["t"]


def test_exact_medians(spark):
    import random
    from statistics import median

    r = random.Random(5)
    data = [(r.choice([None, *range(9)]), r.random() * 10 ** r.randint(-3, 6), r.choice([0, 0, 7])) for _ in range(501)] + [(None, None, None)]
    d = spark.createDataFrame(data, "a int, b double, c int").repartition(7)
    got = {x["name"]: x["median"] for x in corpus.exact_medians(d, {"a": F.col("a"), "b": F.col("b"), "c": F.col("c"), "none": F.lit(None).cast("int")}).collect()}
    assert got == {k: median([x[i] for x in data if x[i] is not None]) for i, k in enumerate("abc")}
    assert re.match("double", dict(corpus.exact_medians(d, {"a": F.col("a")}).dtypes)["median"])
