"""Whole files to Markdown: every fixture in one job."""

import io
import os
import zipfile

import pytest

from tests.pdf_files import FILES, pdf, say
from vellum.sources import convert as C
from vellum.sources import html, office
from vellum.sources import pdf as P

TABLE = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def results(spark):
    rows = [(f"{k}.pdf", bytearray(v), ".pdf") for k, v in FILES.items()]
    rows += [("page.html", bytearray(b"<h1>T</h1><p>x <b>y</b></p>"), ".html"), ("fake.pdf", bytearray(b"<html><body><p>not a pdf</p></body></html>"), ".pdf"), ("plain.txt", bytearray("é ok".encode()), ".txt"), ("mail.msg", bytearray(b"\xd0\xcf\x11\xe0"), ".msg")]
    out = C.convert(spark.createDataFrame(rows, "path string, content binary, suffix string"))
    return {r["path"].split(".")[0]: r for r in out.collect()}


@pytest.mark.parametrize(
    ("name", "text"),
    [
        ("gapped", "harvest ledger"),
        ("gapped_small", "harvest ledger"),
        ("ruled", "A line above.\n\n| Item | Price |\n| --- | --- |\n| a1 | b1 |\n| a2 | b2 |"),
        ("key_value", "Colour: blue oak"),
        ("pipe", "| H1 | H2 |\n| --- | --- |\n| x\\|y | z |\n| u | v |"),
        ("pipe_line", "a|b plain"),
        ("framed", "A note in a frame\nand what follows it"),
        ("blank_row", "H1 H2\na b"),
        ("prose", "Only prose here."),
        ("image", "[vellum: no extractable text layer on page 1]"),
        ("text_then_image", "Page one.\n\n[vellum: no extractable text layer on page 2]"),
        ("offset", "Begins late."),
        ("frame_with_table", "List of parts\n\n| H1 | H2 |\n| --- | --- |\n| a | b |\n| c | d |"),
        ("page", "# T\n\nx **y**"),
        ("fake", "not a pdf"),
        ("plain", "é ok"),
    ],
)
def test_text(results, name, text):
    if name == "blank_row":  # two filled rows of two that are not blank make a table; the empty one is gone
        text = "| H1 | H2 |\n| --- | --- |\n| a | b |"
    assert results[name]["text"] == text
    assert results[name]["error"] is None


def test_two_columns_are_read_one_after_the_other(results):
    lines = results["two_columns"]["text"].replace("\n\n", "\n").split("\n")
    assert len(lines) == 20
    assert all(x.startswith("left") and "right" not in x for x in lines[:10])
    assert all(x.startswith("right") for x in lines[10:])


def test_a_grid_across_the_gutter_cancels_it(results):
    text = results["spanned"]["text"]
    assert "| S1 | S2 |\n| --- | --- |\n| t1 | t2 |" in text
    assert any("left0" in x and "right0" in x for x in text.split("\n"))


def test_few_words_make_no_columns(results):
    assert all("left" in x and "right" in x for x in results["few_words"]["text"].split("\n"))


def test_single_column_is_unchanged(results):
    assert results["one_column"]["text"] == "\n".join(" ".join(f"word{i}x{w}" for w in range(8)) for i in range(15))


def test_rotated_text_makes_debris(results):
    assert "| --- |" not in results["rotated"]["text"]


def test_nested_cells_say_their_text_once(results):
    text = results["nested"]["text"]
    assert [text.count(x) for x in ("9104", "5523", "Crop", "Field")] == [1, 1, 1, 1]


def test_errors_and_estimates(results):
    assert results["mail"]["text"] is None and "no reader" in results["mail"]["error"]
    r = results["text_then_image"]
    assert (r["units"], r["unit"], r["tokens_before"], r["tokens_after"]) == (2, "page", 4500, None)
    assert results["page"]["tokens_before"] is None


def test_flate_and_strings():
    import zlib

    raw = zlib.compress(say(72, 700, r"a\(b\)\101").encode())
    data = pdf("@").replace(b"<< /Length 1 >>\nstream\n@\n", b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\n" % (len(raw), raw))
    doc = P.Document(data)
    assert "".join(c["text"] for c in P.read_page(doc, doc.pages()[0]).chars) == "a(b)A"


def test_stream_filters():
    import base64

    plain = say(72, 700, "plain text")
    runs = b"".join(bytes([len(plain[i : i + 100]) - 1]) + plain[i : i + 100].encode() for i in range(0, len(plain), 100)) + b"\x80"
    coded = {"ASCIIHexDecode": plain.encode().hex().encode() + b">", "ASCII85Decode": base64.a85encode(plain.encode()) + b"~>", "RunLengthDecode": runs, "LZWDecode": lzw(plain.encode())}
    for name, raw in coded.items():
        data = pdf("@").replace(b"<< /Length 1 >>\nstream\n@\n", b"<< /Length %d /Filter /%s >>\nstream\n%s\n" % (len(raw), name.encode(), raw))
        doc = P.Document(data)
        assert "".join(c["text"] for c in P.read_page(doc, doc.pages()[0]).chars) == "plain text", name
    assert P._runs(b"\x01ab\xfec\x80zz") == b"abccc" and P._hexadecimal(b"4 1\n4>") == b"A@"
    long = bytes(range(256)) * 40 + b"ab" * 9000  # through every width of a code, and a cleared table
    assert P._lzw(lzw(long)) == long
    assert P._lzw(bytes.fromhex("800B6050220C0C8501")) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])  # the format's own example


def lzw(data):
    codes, table, run = [256], {bytes([i]): i for i in range(256)}, b""
    for b in data:
        if run + bytes([b]) in table:
            run += bytes([b])
            continue
        codes.append(table[run])
        table[run + bytes([b])] = 2 + len(table)
        if len(table) + 2 > 4090:
            codes.append(256)
            table = {bytes([i]): i for i in range(256)}
        run = bytes([b])
    codes += [table[run], 257]
    bits, width, known = "", 9, 0
    for c in codes:
        bits += f"{c:0{width}b}"
        known = 0 if c == 256 else known + 1  # codes since the table was cleared; the reader has one entry less
        width = 9 if c == 256 else min(12, max(9, (258 + known).bit_length()))
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_epub():
    book = _zip({"META-INF/container.xml": '<container xmlns="c"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>', "OPS/book.opf": '<package xmlns="p"><manifest><item id="b" href="two%20.xhtml"/><item id="a" href="one.xhtml"/><item id="x" href="gone.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="x"/><itemref idref="b"/></spine></package>', "OPS/one.xhtml": "<html><body><h1>One</h1><p>first</p></body></html>", "OPS/two .xhtml": "<html><body><p>second</p></body></html>"})
    assert office.epub(book) == "# One\n\nfirst\n\nsecond" and C._generic(".epub", book) == office.epub(book)


def test_html():
    page = "<html><head><title>t</title></head><body><nav>n</nav><ul><li>a<li>b</ul><table><tr><th>h<th>i</tr><tr><td>1</td><td>2|3</td></tr></table><p>x<br>y <a href='u'>z</a></body></html>"
    assert html.to_markdown(page) == "- a\n- b\n\n| h | i |\n| --- | --- |\n| 1 | 2\\|3 |\n\nx\ny [z](u)"
    assert html.to_markdown(None) == ""


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def test_office():
    assert office.docx(_zip({"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:t>a b</w:t></w:r></w:p></w:body></w:document>'})) == "# T\n\na b"
    slides = _zip({f"ppt/slides/slide{i}.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:t>s{i}</a:t></a:p></p:sld>' for i in (1, 2, 10)})
    assert office.slide_count(slides) == 3 and "s10" in office.pptx(slides).split("\n")[-1]
    sheet = _zip({"xl/sharedStrings.xml": "<sst><si><t>h</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="A2"><v>1</v></c></row></sheetData></worksheet>'})
    assert office.xlsx(sheet) == "| h |  | 3 |\n| --- | --- | --- |\n| 1 |  |  |"


def test_token_counts_degrade_to_null(spark):
    d = spark.createDataFrame([("a b",)], "t string")
    from pyspark.sql import functions as F

    assert d.select(C.count_tokens(F.col("t"), None)).first()[0] is None
    assert d.select(C.count_tokens(F.col("t"), "/nowhere")).first()[0] is None


@pytest.mark.skipif(not os.path.exists(TABLE), reason="no byte-pair table")
def test_token_counts_with_a_table(spark):
    import base64

    import tiktoken
    from pyspark.sql import functions as F

    texts = ["", "a b", "Hello, world 2024!", "naïve — 日本", "x" * 1000]
    with open(TABLE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=C.PATTERN, mergeable_ranks=ranks, special_tokens={})
    d = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = {r["t"]: r["n"] for r in d.select("t", C.count_tokens(F.col("t"), TABLE).alias("n")).collect()}
    assert got == {None: None} | {t: len(enc.encode_ordinary(t)) for t in texts}
    row = C.convert_bytes(spark, b"one two three", ".txt", TABLE).first()
    assert row["tokens_after"] == len(enc.encode_ordinary("one two three"))
