"""PDF files made in code, one for each behaviour of the page engine."""

#: The font sizes, and the gaps of 274 and 123 thousandths below, lie on either side of the word gap's threshold.
SIZE = 10.56


def pdf(*streams: str, lead: bytes = b"") -> bytes:
    """A page of 612 by 792 points for each content stream, in one Helvetica."""
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(streams)))
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(streams)} >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for i, s in enumerate(streams):
        data = s.encode("latin-1")
        bodies.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode())
        bodies.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(data), data))
    out = lead + b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, b) for n, b in enumerate(bodies, 1))
    return out + b"trailer\n<< /Size %d /Root 1 0 R >>\n%%%%EOF\n" % (len(bodies) + 1)


def say(x, y, text, size=SIZE):
    return f"BT /F1 {size} Tf {x} {y} Td ({text}) Tj ET\n"


def box(x, y, w, h):
    return f"{x} {y} {w} {h} re S\n"


def rule(x0, y0, x1, y1):
    return f"{x0} {y0} m {x1} {y1} l S\n"


def grid(x, y, rows, w=120, h=24):
    """rows of texts in stroked cells; y is the top row's lower edge."""
    return "".join(box(x + c * w, y - r * h, w, h) + (say(x + c * w + 4, y - r * h + 8, t) if t else "") for r, row in enumerate(rows) for c, t in enumerate(row))


def two_columns(lines=10, words=4):
    left = "".join(say(72, 700 - 20 * i, " ".join(f"left{i}{w}" for w in range(words)), 9) for i in range(lines))
    right = "".join(say(340, 700 - 20 * i, " ".join(f"right{i}{w}" for w in range(words)), 9) for i in range(lines))
    return left + right


FILES = {
    "gapped": pdf(f"BT /F1 {SIZE} Tf 72 700 Td [(harvest) -274 (ledger)] TJ ET\n"),
    "gapped_small": pdf("BT /F1 6.0 Tf 72 700 Td [(harvest) -123 (ledger)] TJ ET\n"),
    "ruled": pdf(say(72, 740, "A line above.") + grid(72, 640, [["Item", "Price"], ["a1", "b1"], ["a2", "b2"]])),
    "key_value": pdf(grid(72, 640, [["Colour:", "blue oak"]])),
    "pipe": pdf(grid(72, 640, [["H1", "H2"], ["x|y", "z"], ["u", "v"]])),
    "pipe_line": pdf(grid(72, 640, [["a|b", "plain"]])),
    "framed": pdf(box(60, 500, 400, 200) + rule(60, 600, 460, 600) + say(72, 650, "A note in a frame") + say(72, 550, "and what follows it")),
    "blank_row": pdf(grid(72, 640, [["H1", "H2"], ["", ""], ["a", "b"]])),
    "prose": pdf(say(72, 700, "Only prose here.")),
    "image": pdf("100 100 200 200 re f\n"),
    "text_then_image": pdf(say(72, 700, "Page one."), "100 100 200 200 re f\n"),
    "offset": pdf(say(72, 700, "Begins late."), lead=b"\r\n"),
    "frame_with_table": pdf(box(60, 400, 480, 330) + rule(60, 690, 540, 690) + say(72, 700, "List of parts") + grid(90, 600, [["H1", "H2"], ["a", "b"], ["c", "d"]])),
    "two_columns": pdf(two_columns()),
    "spanned": pdf(two_columns() + grid(200, 400, [["S1", "S2"], ["t1", "t2"]])),
    "one_column": pdf("".join(say(72, 700 - 20 * i, " ".join(f"word{i}x{w}" for w in range(8)), 9) for i in range(15))),
    "few_words": pdf(two_columns(3, 4)),
    "rotated": pdf(grid(72, 640, [["H1", "H2"], ["a", "b"], ["c", "d"]]) + "".join(f"BT /F1 9 Tf 0 1 -1 0 {100 + 12 * i} 600 Tm (axis) Tj ET\n" for i in range(8))),
    "nested": pdf(rule(72, 700, 312, 700) + rule(72, 676, 312, 676) + rule(192, 652, 312, 652) + rule(72, 628, 312, 628) + rule(72, 628, 72, 700) + rule(312, 628, 312, 700) + rule(192, 628, 192, 700) + say(76, 684, "Crop") + say(196, 684, "Yield") + say(196, 660, "9104") + say(196, 636, "5523") + say(76, 650, "Field")),
    "broken": b"%PDF-1.4\nnothing",
}
