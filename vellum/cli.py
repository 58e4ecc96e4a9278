"""Command line.  [SRC3, SNK1, CMP8]

python -m vellum.cli convert FILE|- [--type .pdf] [-o OUT]
python -m vellum.cli measure FOLDER... [--limit BYTES] [--sample N --seed K] [--tokens TABLE] [--details OUT]
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vellum")
    commands = p.add_subparsers(dest="command", required=True)
    m = commands.add_parser("measure", help="how well the PDFs under some folders convert")
    m.add_argument("folder", nargs="+")
    m.add_argument("--limit", type=int, default=10 << 20, help="files of so many bytes or more are left out; 0: none")
    m.add_argument("--sample", type=int, help="so many files, drawn by chance")
    m.add_argument("--seed", type=int, default=0)
    m.add_argument("--tokens", help="a byte-pair table; without one tokens are not counted")
    m.add_argument("--details", help="a folder for a record of each file, names included")
    c = commands.add_parser("convert", help="a document to Markdown")
    c.add_argument("input", help="a file, or - for standard input")
    c.add_argument("-o", "--output", help="write here instead of standard output")
    c.add_argument("--type", help="the kind of standard input, such as .pdf")
    return p


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: no such file, or it cannot be converted; 2: standard input without --type."""
    args = parser().parse_args(argv)
    if args.command == "measure":
        return _measure(args)
    if args.input == "-":
        if not args.type:
            print("--type is needed with standard input", file=sys.stderr)
            return 2
        data, suffix = sys.stdin.buffer.read(), args.type if args.type.startswith(".") else f".{args.type}"
    else:
        path = Path(args.input)
        if not path.is_file():
            print(f"No such file: {path}", file=sys.stderr)
            return 1
        data, suffix = path.read_bytes(), path.suffix
    from vellum.session import local
    from vellum.sources.convert import convert_bytes

    row = convert_bytes(local(), data, suffix).first()
    if row["error"]:
        print(f"Cannot convert: {row['error']}", file=sys.stderr)
        return 1
    out = row["text"].encode()
    if args.output:
        Path(args.output).write_bytes(out)
    else:
        sys.stdout.buffer.write(out)
    return 0


def _measure(args: argparse.Namespace) -> int:
    """A JSON line for each selection; 1: a folder that is none."""
    for folder in args.folder:
        if not Path(folder).is_dir():
            print(f"No such folder: {folder}", file=sys.stderr)
            return 1
    from vellum.operators import corpus, measure
    from vellum.session import local

    rows = measure.measure(local(), args.folder, ranks=args.tokens, limit=args.limit, sample=args.sample, seed=args.seed).persist()
    for line in measure.report(rows).toJSON().collect():  # a row for each selection
        print(line)
    if args.details:
        corpus.write_details(rows, args.details)
    return 0


if __name__ == "__main__":
    sys.exit(main())
