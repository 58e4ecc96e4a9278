"""Operators against plain Python, at their boundaries."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import archive, corpus
from vellum.operators import geometry as G


def one(spark, column, **values):
    row = spark.range(1).select(*[(v if hasattr(v, "alias") else F.lit(v)).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


LINES = ["", "a", "a\n", "a\r\nb", "a\n\nb\x0bc\x0cd\x1ce\x85f g ", "\n", "\r\n\r", "| x\r\n|y\n z |", "\x1d\x1e"]


@pytest.mark.parametrize("text", LINES)
def test_lines_are_those_of_splitlines(spark, text):
    assert list(one(spark, T.split_lines(F.col("t")), t=text)) == text.splitlines()
    assert one(spark, T.pipe_rows(F.col("t")), t=text) == sum(x.startswith("|") for x in text.splitlines())


@pytest.mark.parametrize(("name", "stem"), [("report.pdf", "report"), ('bad<>:"name.txt', "bad____name"), ("a/b\\c?d*.txt", "c_d_"), ("Отчёт.pdf", "Отчёт"), ("///.txt", "file"), ("no_ext", "no_ext"), ("x.tar.gz", "x.tar"), ("", "file")])
def test_safe_stem(spark, name, stem):
    assert one(spark, T.safe_stem(F.col("n")), n=name) == stem


@pytest.mark.parametrize(("base", "out", "deficit", "excess"), [("10 20 30", "10 20", 2, 0), ("10 20 30", "10 10 20 30", 0, 2), ("10 20 30", "| 1 | 0 | 20 | 30 |", 0, 0), ("", "٣7", 0, 2)])
def test_digits(spark, base, out, deficit, excess):
    assert one(spark, T.digit_deficit(F.col("o"), F.col("b")), o=out, b=base) == deficit
    assert one(spark, T.digit_excess(F.col("o"), F.col("b")), o=out, b=base) == excess


def test_glue_and_mojibake(spark):
    assert one(spark, T.glued(F.col("t")), t="extraordinarilyuncharacteristic") == 1
    assert one(spark, T.glued(F.col("t")), t="x" * 25 + " " + "я" * 52) == 1
    assert one(spark, T.mojibake(F.col("t")), t="Привет".encode("cp1251").decode("latin-1")) == 6
    assert one(spark, T.mojibake_doc(F.col("t")), t="") == 0
    assert [one(spark, T.mojibake_doc(F.col("t")), t="é" * k + "a" * (20 - k)) for k in (3, 4)] == [0, 1]


@pytest.mark.parametrize(("rows", "real"), [([["H1", "H2"], ["a", "b"], ["c", "d"]], True), ([["H1", "H2"], ["a", ""]], False), ([["x", ""], ["y", ""], ["a", "b"], ["z", ""]], False), ([["a", None], ["b", "c"]], False), ([["a", "b"], ["c", "d"], ["e", ""], ["f", ""]], True), ([], False), ([["a"], ["b"]], False), ([["", ""], ["", ""]], False)])
def test_row_fill_vote(spark, rows, real):
    d = spark.createDataFrame([(rows,)], "r array<array<string>>")
    assert d.select(T.is_real_table(F.col("r"))).first()[0] is real


def test_savings(spark):
    d = spark.createDataFrame([(100, 50), (100, 100), (100, 150), (None, 5), (100, None), (200, 1), (0, 5)], "b int, a int")
    assert [r[0] for r in d.select(T.savings_percent(F.col("b"), F.col("a"))).collect()] == [50, None, None, None, None, 100, None]


def test_percent_rounds_halves_to_even(spark):
    d = spark.createDataFrame([(1, 40), (3, 40), (5, 0)], "n int, w int")
    assert [r[0] for r in d.select(T.percent(F.col("n"), F.col("w"))).collect()] == ["1 (2%)", "3 (8%)", "5"]


def test_legacy_table(spark):
    d = spark.createDataFrame([([["a", "", "b"]],), ([["a"], [""], ["b"]],), ([[""]],), ([["h", "i"], ["1", "2"]],)], "r array<array<string>>")
    assert [r[0] for r in d.select(T.legacy_table(F.col("r"))).collect()] == ["a b", "a\nb", None, "| h | i |\n| --- | --- |\n| 1 | 2 |"]


def test_names_fill_gaps(spark):
    taken = spark.createDataFrame([("report.md",), ("report (3).md",), ("other (1).md",), ("other (02).md",)], "filename string")
    arrivals = spark.createDataFrame([("report", 1), ("report", 2), ("report", 3), ("other", 4), ("new", 5)], "stem string, seq int")
    got = {r["seq"]: r["filename"] for r in archive.archive_names(arrivals, taken).collect()}
    assert got == {1: "report (2).md", 2: "report (4).md", 3: "report (5).md", 4: "other.md", 5: "new.md"}


def test_archive_files(spark, tmp_path):
    names = [archive.save_unique(tmp_path, "a", str(i)) for i in range(3)]
    assert names == ["a.md", "a (2).md", "a (3).md"] and (tmp_path / names[1]).read_text() == "1"
    (tmp_path / "x.txt").write_text("no")
    assert {r["filename"] for r in archive.scan_archive(spark, str(tmp_path)).collect()} == set(names)
    for bad, code in (("../x", 400), ("/etc/passwd", 400), ("none.md", 404)):
        with pytest.raises(archive.Refused) as e:
            archive.safe_path(tmp_path, bad)
        assert e.value.code == code
    import io
    import zipfile

    assert zipfile.ZipFile(io.BytesIO(archive.zip_files(tmp_path, names))).namelist() == names
    archive.delete(tmp_path, "a.md")
    assert archive.save_unique(tmp_path, "a", "again") == "a.md"
    with pytest.raises(archive.Refused):
        archive.batch_guard(["x"] * 11)


def test_search(spark):
    day = datetime.datetime(2024, 1, 1)
    d = spark.createDataFrame([("alpha.md", day), ("beta.md", day), ("ALPINE.md", day + datetime.timedelta(1)), ("a%p.md", day)], "filename string, modified timestamp")
    assert [r[0] for r in archive.search(d, "alp").collect()] == ["ALPINE.md", "alpha.md"]
    assert [r[0] for r in archive.search(d, "%").collect()] == ["a%p.md"]
    assert archive.search(d).count() == 4


def test_duplicates_need_name_size_and_content(spark):
    rows = [("a.pdf", b"xy", "1"), ("a.pdf", b"xy", "2"), ("a.pdf", b"zz", "3"), ("b.pdf", b"xy", "4")]
    d = spark.createDataFrame([(n, len(c), bytearray(c), p) for n, c, p in rows], "name string, length long, content binary, path string")
    assert sorted(r["path"] for r in corpus.without_duplicates(d).collect()) == ["1", "3", "4"]


def test_scan_filters_by_size(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, n in (("a.pdf", 5), ("sub/b.pdf", 10), ("c.txt", 1)):
        (tmp_path / name).write_bytes(b"x" * n)
    names = lambda limit: sorted(r["name"] for r in corpus.scan(spark, [str(tmp_path)], limit).select("name").collect())
    assert names(10) == ["a.pdf"] and names(0) == ["a.pdf", "b.pdf"]


BOX = "doc_id int, page_no int, grid_id int, row int, col int, x0 double, top double, x1 double, bottom double"


def test_edges_of_boxes(spark):
    cells = spark.createDataFrame([(1, 1, 1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1, 0, 1, 10.0, 0.0, 20.0, 10.0)], BOX)
    chars = spark.createDataFrame([(1, 1, i, x - 1.0, y - 1.0, x + 1.0, y + 1.0) for i, (x, y) in enumerate([(0, 0), (10, 5), (20, 5), (5, 10), (21, 5)])], "doc_id int, page_no int, char_seq int, x0 double, top double, x1 double, bottom double")
    assert sorted((r["char_seq"], r["col"]) for r in G.chars_in_cells(chars, cells).collect()) == [(0, 0), (1, 1)]
    assert [r["char_seq"] for r in G.outside_cells(chars, cells).collect()] == [4]


def test_containment_and_nesting(spark):
    g = spark.createDataFrame([(1, 1, 1, 0, 0, 0.0, 0.0, 100.0, 100.0), (1, 1, 2, 0, 0, -2.0, 10.0, 50.0, 50.0), (1, 1, 3, 0, 0, 200.0, 0.0, 210.0, 10.0)], BOX)
    assert sorted(r["grid_id"] for r in G.without_frames(g).collect()) == [2, 3]
    one_grid = g.withColumn("grid_id", F.lit(1))
    assert G.nested_cells(one_grid).count() == 0  # no slack here
    claimed = spark.createDataFrame([(1, 1, 1, 0, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1, 1, 0, 0.0, 0.0, 5.0, 10.0)], BOX)
    chars = spark.createDataFrame([(1, 1, 1, 1.0, 1.0, 2.0, 2.0), (1, 1, 2, 7.0, 1.0, 8.0, 2.0)], "doc_id int, page_no int, char_seq int, x0 double, top double, x1 double, bottom double")
    assert sorted((r["row"], r["char_seq"]) for r in G.subtract_nested(chars, claimed).collect()) == [(0, 2), (1, 1)]


def random_cells(seed, n, whole):
    """(page, grid, row, x0, top, x1, bottom): many alike, some of no width, some the wrong way round."""
    r = random.Random(seed)
    at = (lambda: r.randrange(12)) if whole else (lambda: r.choice([r.random() * 12, float(r.randrange(12))]))
    out = []
    for k in range(n):
        x, y = at(), at()
        out.append((r.randrange(4), r.choice([1, 1, 2]), k, x, y, x + at() / 2 - 1 if not whole else x + r.randrange(-1, 7), y + r.randrange(-1, 7)))
    return out


def encloses(o, i):
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    return area(o) > area(i) and o[0] <= i[0] and o[1] <= i[1] and o[2] >= i[2] and o[3] >= i[3]


@pytest.mark.parametrize("whole", [True, False])
def test_nesting_like_a_straight_reading(spark, whole):
    cells = random_cells(3, 400, whole)
    kind = "long" if whole else "double"
    r = random.Random(4)
    chars = [(r.randrange(5), k, x, y, x + 1, y + 1) for k in range(900) for x, y in [(r.randrange(14), r.randrange(14)) if whole else (r.random() * 14, float(r.randrange(14)))]]
    c = spark.createDataFrame([(p, 1, g, k, 0, *b) for p, g, k, *b in cells] + [(0, 1, 1, 1000, 0, None, None, None, None), (None, 1, 1, 1001, 0, *cells[0][3:]), (1, 1, None, 1002, 0, *cells[1][3:])], f"doc_id int, page_no int, grid_id int, row int, col int, x0 {kind}, top {kind}, x1 {kind}, bottom {kind}")
    ch = spark.createDataFrame([(p, 1, k, *b, f"t{k}") for p, k, *b in chars] + [(1, 1, 5000, None, None, None, None, "n")], f"doc_id int, page_no int, char_seq int, x0 {kind}, top {kind}, x1 {kind}, bottom {kind}, text string")
    boxes = {(p, g, *b) for p, g, _, *b in cells}
    pairs = {(*o, *i[2:]) for o in boxes for i in boxes if o[:2] == i[:2] and encloses(o[2:], i[2:])}
    got = [(r["doc_id"], r["grid_id"], *[r[k] for k in ("x0", "top", "x1", "bottom", "in_x0", "in_top", "in_x1", "in_bottom")]) for r in G.nested_cells(c.where("grid_id is not null")).collect()]
    assert len(pairs) > 100 and sorted(got) == sorted(pairs)
    counts = {(r["doc_id"], r["grid_id"], r["x0"], r["top"], r["x1"], r["bottom"]): (r["n_inner"], r["n_outer"]) for r in G.nested_counts(c.where("grid_id is not null")).collect()}
    assert counts == {b: (sum(p[:6] == b for p in pairs), sum(p[:2] + p[6:] == b for p in pairs)) for b in boxes}
    holds = lambda b, x: 2 * b[0] <= x[0] + x[2] < 2 * b[2] and 2 * b[1] <= x[1] + x[3] < 2 * b[3]
    want = [(k, n, f"t{n}") for p, g, k, *b in [*cells, (1, None, 1002, *cells[1][3:])] for q, n, *x in chars if p == q and holds(b, x) and not any((p, g) == i[:2] and encloses(b, i[2:]) and holds(i[2:], x) for i in boxes)]
    assert len(want) > 100
    for out in (G.subtract_nested(ch, c), G.subtract_nested_in_place(ch, c)):
        assert out.dtypes == [*ch.dtypes, ("grid_id", "int"), ("row", "int"), ("col", "int")]
        assert sorted((r["row"], r["char_seq"], r["text"]) for r in out.collect()) == sorted(want)


def test_nesting_in_blocks_of_any_size(monkeypatch):
    import numpy as np

    from vellum.operators import nesting as N

    b = np.array(random_cells(5, 500, True))
    b = b[np.argsort(b[:, 0], kind="stable")]
    r = lambda: N.Rectangles(b[:, 0], *b[:, 3:].T, (b[:, 5] - b[:, 3]) * (b[:, 6] - b[:, 4]))
    want = r().n_inner().tolist()
    assert want == [len({tuple(i[3:]) for i in b if i[0] == o[0] and encloses(o[3:], i[3:])}) for o in b]
    monkeypatch.setattr(N, "COLS", 70)
    monkeypatch.setattr(N, "ROWS", 9)
    assert r().n_inner().tolist() == want


def test_pages_stay_whole_in_batches_of_any_size(monkeypatch):
    import pyarrow as pa

    from vellum.operators import nesting as N

    monkeypatch.setattr(N, "CALL", 3)
    sizes = [1, 1, 20, 2, 1, 9, 4]
    page = [k for k, n in enumerate(sizes) for _ in range(n)]
    for step in (1, 2, 5, 50):
        batches = [pa.record_batch({"doc_id": page[k : k + step], "v": list(range(k, min(len(page), k + step)))}) for k in range(0, len(page), step)]
        got = [t.to_pydict() for t in N.whole_pages(iter(batches), ["doc_id"])]
        assert [v for t in got for v in t["v"]] == list(range(len(page)))
        assert sum(len(set(t["doc_id"])) for t in got) == len(sizes)


def straight_gutter(words, x0, x1):
    if len(words) < 60 or x1 <= x0:
        return None
    counts = [0] * 60
    for a, b in words:
        lo, hi = (max(0, min(59, int((v - x0) / (x1 - x0) * 60))) for v in (a, b))
        for i in range(lo, hi + 1):
            counts[i] += 1
    bands, i = [], 0
    while i < 60:
        j = i
        while j < 60 and not counts[j]:
            j += 1
        if j > i:
            bands.append((i, j))
        i = max(j, i + 1)
    fit = [b for b in bands if 0.30 <= (b[0] + b[1]) / 2 / 60 <= 0.70]
    if not fit:
        return None
    a, b = min(fit, key=lambda s: (s[0] - s[1], s[0]))
    left, right = sum(counts[:a]), sum(counts[b:])
    if b - a < 2 or min(left, right) < 0.25 * (left + right):
        return None
    return (round(x0 + a / 60 * (x1 - x0), 6), round(x0 + b / 60 * (x1 - x0), 6))


def test_gutters_like_a_straight_reading(spark):
    r = random.Random(5)
    pages, words = {}, []
    for p in range(120):
        x0, x1 = r.choice([(0.0, 612.0), (-20.0, 300.0)])
        own = []
        for _ in range(r.choice([40, 59, 60, 61, 90])):
            side = r.random() < r.choice([0.5, 0.9])
            a = x0 + (x1 - x0) * ((0.05 if side else 0.55) + r.random() * 0.3)
            own.append((a, a + r.random() * r.choice([20, 60, 200]) * (r.random() < 0.9)))
        pages[p] = (x0, x1, own)
        words += [(p, 1, a, b) for a, b in own]
    w = spark.createDataFrame(words, "doc_id int, page_no int, x0 double, x1 double")
    frame = spark.createDataFrame([(p, 1, a, b) for p, (a, b, _) in pages.items()], "doc_id int, page_no int, x0 double, x1 double")
    got = {x["doc_id"]: (round(x["g0"], 6), round(x["g1"], 6)) for x in G.gutters(w, frame).collect()}
    want = {p: g for p, (a, b, own) in pages.items() if (g := straight_gutter(own, a, b))}
    assert want and len(want) < 120
    assert got == want


def test_rotated_share(spark):
    g = spark.createDataFrame([(1, 1, 1, 0, 0, 0.0, 0.0, 100.0, 100.0), (1, 1, 2, 0, 0, 300.0, 0.0, 400.0, 100.0)], BOX)
    chars = spark.createDataFrame([(1, 1, float(i), 1.0, i + 1.0, 2.0, None if i == 5 else i >= 3) for i in range(20)], "doc_id int, page_no int, x0 double, top double, x1 double, bottom double, upright boolean")
    got = {r["grid_id"]: (r["rotated"], r["debris"]) for r in G.rotated_share(chars, g).collect()}
    assert got == {1: (0.15, True), 2: (0.0, False)}


def test_characters_in_cells_are_counted_as_their_pairs_are(spark):
    rng = random.Random(5)
    n = lambda: rng.choice([None, *range(12)])
    chars = [(rng.choice([None, 1, 2, 3]), 1, k, n(), n(), n(), n(), rng.choice([None, True, False])) for k in range(400)]
    cells = [(rng.choice([None, 1, 2, 4]), 1, rng.choice([None, *range(60)]), n(), n(), n(), n()) for _ in range(400)]
    cells += cells[:90]
    c = spark.createDataFrame(chars, "doc_id int, page_no int, char_seq int, x0 int, top int, x1 int, bottom int, upright boolean")
    b = spark.createDataFrame(cells, "doc_id int, page_no int, grid_id int, x0 int, top int, x1 int, bottom int").withColumns({"row": F.lit(0), "col": F.lit(0)})
    got = G.chars_per_grid(c, b, {"seqs": F.col("char_seq")}, distinct=True)
    want = G.chars_in_cells(c, b.distinct()).groupBy(*G.PAGE, "grid_id").agg(F.count("*").alias("n"), F.sum("char_seq").alias("seqs"))
    assert want.count() > 20
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    for distinct, own in ((True, b.distinct()), (False, b)):
        assert sorted(map(repr, G.rotated_share(c, b, distinct).collect())) == sorted(map(repr, G.rotated_share_in_place(c, own).collect()))


def test_cli(tmp_path, capsysbinary, monkeypatch, spark):
    from vellum import cli

    assert cli.main(["convert", str(tmp_path / "none.pdf")]) == 1
    assert cli.main(["convert", "-"]) == 2
    (tmp_path / "a.html").write_text("<p>é</p>", encoding="utf-8")
    assert cli.main(["convert", str(tmp_path / "a.html"), "-o", str(tmp_path / "o.md")]) == 0
    assert (tmp_path / "o.md").read_bytes() == "é".encode()


def test_streaming_ingest(spark, tmp_path):
    from vellum.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<p>one</p>")
    (tmp_path / "in" / "b.msg").write_bytes(b"\xd0\xcf\x11\xe0")
    for _ in range(2):
        q = ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
        q.awaitTermination()
        (tmp_path / "in" / "c.txt").write_text("two")
    got = {r["filename"]: (r["status"], r["saved_as"], r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a.html": ("ok", "a.md", "one"), "b.msg": ("error", None, None), "c.txt": ("ok", "c.md", "two")}


def test_match_boxes_looks_in_bands(spark):
    tops = [-2.0, -1.0, -0.99, 0.0, 0.5, 1.0, 1.01, 1.5, 2.0, 2.02, 3.03, 7.0]
    found = spark.createDataFrame([(1, 1, i, x, t) for i, t in enumerate(tops) for x in (0.0,)], "doc_id int, page_no int, grid_id int, x0 double, top double")
    labels = found.select(F.col("grid_id").alias("gid"), "doc_id", "page_no", "x0", "top")
    out = G.match_boxes(labels, found)
    assert "__band" in out._jdf.queryExecution().executedPlan().toString()
    assert {r["gid"]: r["grid_id"] for r in out.collect()} == {i: next(k for k, u in enumerate(tops) if abs(t - u) < 1) for i, t in enumerate(tops)}
