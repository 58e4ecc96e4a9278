"""Word, PowerPoint, Excel and EPUB files, which are zipped XML.  [SRC8, SRC9]"""

from __future__ import annotations

import io
import re
import zipfile
from posixpath import dirname, join, normpath
from urllib.parse import unquote
from xml.etree import ElementTree

from vellum.sources import html


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node, tag: str = "t") -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == tag)


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _table(rows: list[list[str]]) -> str:
    rows = [[c.replace("|", "\\|").replace("\n", " ") for c in r] for r in rows if any(r)]
    if not rows:
        return ""
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join("---" for _ in rows[0]) + " |", *lines[1:]])


def docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for node in next(x for x in root.iter() if _local(x.tag) == "body"):
        if _local(node.tag) == "tbl":
            out.append(_table([[_texts(c) for c in r if _local(c.tag) == "tc"] for r in node if _local(r.tag) == "tr"]))
        elif _local(node.tag) == "p":
            style = next((v for x in node.iter() if _local(x.tag) == "pStyle" for v in x.attrib.values()), "")
            level = re.fullmatch(r"Heading\s?([1-6])", style)
            out.append(("#" * int(level[1]) + " " if level else "") + _texts(node))
    return "\n\n".join(x for x in out if x.strip("# "))


def slide_count(data: bytes) -> int:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return len(_numbered(z, r"ppt/slides/slide(\d+)\.xml"))


def pptx(data: bytes) -> str:
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for k, name in enumerate(_numbered(z, r"ppt/slides/slide(\d+)\.xml"), 1):
            paragraphs = [_texts(p) for p in ElementTree.fromstring(z.read(name)).iter() if _local(p.tag) == "p"]
            out.append("\n".join([f"<!-- slide {k} -->", *[p for p in paragraphs if p]]))
    return "\n\n".join(out)


def xlsx(data: bytes) -> str:
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = [_texts(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(x.tag) == "si"]
        for name in _numbered(z, r"xl/worksheets/sheet(\d+)\.xml"):
            rows = []
            for r in (x for x in ElementTree.fromstring(z.read(name)).iter() if _local(x.tag) == "row"):
                cells: dict[int, str] = {}
                for k, c in enumerate(x for x in r if _local(x.tag) == "c"):
                    letters = re.match(r"[A-Z]*", c.get("r", "")).group()
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else k
                    value = _texts(c, "v") or _texts(c)
                    cells[at] = shared[int(value)] if c.get("t") == "s" and value else value
                rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
            width = max(map(len, rows), default=0)
            out.append(_table([r + [""] * (width - len(r)) for r in rows]))
    return "\n\n".join(x for x in out if x)


def epub(data: bytes) -> str:
    """The chapters in the order of the book's spine, each by the HTML reader; chapters that are missing are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        find = lambda root, tag: [x for x in root.iter() if _local(x.tag) == tag]
        book = find(ElementTree.fromstring(z.read("META-INF/container.xml")), "rootfile")[0].attrib["full-path"]
        root = ElementTree.fromstring(z.read(book))
        files = {x.attrib["id"]: normpath(join(dirname(book), unquote(x.attrib["href"]))) for x in find(root, "item")}
        order = [files.get(x.attrib.get("idref")) for x in find(root, "itemref")]
        texts = [html.to_markdown(z.read(n).decode("utf-8", "replace")) for n in order if n in z.namelist()]
    return "\n\n".join(t for t in texts if t)
