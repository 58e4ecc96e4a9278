"""The text functions and the PDF reader for use from SQL.  [SURVEY §2.11]

Scalar functions are SQL functions whose bodies Catalyst inlines; `pdf_parts` is a table function for LATERAL joins; only the
HTML reader runs in Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from vellum.functions import text as T
from vellum.sources import html, pdf


def _sql(literal: str) -> str:
    return "r'" + literal + "'"


def _strip(value: str) -> str:
    return f"regexp_replace({value}, {_sql(f'^{T.WS}+|{T.WS}+$')}, '')"


_LINES = f"split(t, {_sql(T.LINE_END)}, -1)"
_BADGES = ", ".join(f"'{k}', '{v}'" for k, v in T.BADGES.items())
_FILL = "transform(g, r -> size(filter(r, c -> " + _strip("coalesce(c, '')") + " <> '')))"
_PIPE = "concat('| ', array_join({0}, ' | '), ' |')"

FUNCTIONS = {
    "glued(t STRING) RETURNS INT": f"regexp_count(t, {_sql(T.GLUED)})",
    "mojibake(t STRING) RETURNS INT": f"regexp_count(t, {_sql(T.MOJIBAKE)})",
    "mojibake_doc(t STRING) RETURNS INT": f"CAST(regexp_count(t, {_sql(T.MOJIBAKE)}) > {T.MOJIBAKE_SHARE}D * length(t) AS INT)",
    "n_digits(t STRING) RETURNS INT": r"regexp_count(t, r'\p{Nd}')",
    "digit_text(t STRING) RETURNS STRING": r"regexp_replace(t, r'\P{Nd}+', '')",
    "digits_beyond(a STRING, b STRING) RETURNS INT": r"aggregate(array_distinct(regexp_extract_all(a, r'(\p{Nd})')), 0, (n, d) -> n + greatest(length(a) - length(replace(a, d, '')) - length(b) + length(replace(b, d, '')), 0))",
    "numeric_tokens(t STRING) RETURNS ARRAY<STRING>": f"filter(regexp_extract_all(t, {_sql(f'({T.NUMBER})')}), x -> length(x) >= 2)",
    "text_lines(t STRING) RETURNS ARRAY<STRING>": f"IF(t IS NULL, NULL, filter({_LINES}, (x, i) -> x <> '' OR i < size({_LINES}) - 1))",
    "pipe_rows(t STRING) RETURNS INT": "size(filter(text_lines(t), x -> startswith(x, '|')))",
    "phantom_rows(t STRING, grids INT) RETURNS INT": "IF(grids > 0, 0, pipe_rows(t))",
    "blob_lines(t STRING) RETURNS INT": "size(filter(text_lines(t), x -> length(x) > 300))",
    "without_markers(t STRING) RETURNS STRING": f"array_join(filter(text_lines(t), x -> NOT contains(x, '{T.NO_TEXT_MARKER}')), chr(10))",
    "no_text_marker(page INT) RETURNS STRING": f"concat('[vellum: {T.NO_TEXT_MARKER} on page ', page, ']')",
    "reflow(t STRING) RETURNS STRING": "array_join(transform(split(t, chr(10) || chr(10)), b -> IF(exists(split(b, chr(10)), x -> startswith(x, '|')), b, replace(b, chr(10), ' '))), chr(10) || chr(10))",
    "cell_text(c STRING) RETURNS STRING": _strip("replace(coalesce(c, ''), chr(10), ' ')"),
    "escape_pipe(t STRING) RETURNS STRING": r"replace(t, '|', r'\|')",
    "pipe_line(cells ARRAY<STRING>) RETURNS STRING": _PIPE.format("cells"),
    "pipe_table(g ARRAY<ARRAY<STRING>>) RETURNS STRING": "array_join(transform(concat(slice(g, 1, 1), array(transform(g[0], c -> '---')), slice(g, 2, greatest(size(g) - 1, 0))), (r, i) -> " + _PIPE.format("IF(i = 1, r, transform(r, c -> replace(c, '|', r'\\|')))") + "), chr(10))",
    "safe_stem(n STRING) RETURNS STRING": "coalesce(nullif(" + _strip(f"regexp_replace(regexp_replace(regexp_extract(n, {_sql('(?s)([^/' + chr(92) * 2 + ']*)$')}, 1), {_sql('(?s)' + chr(92) + '.[^.]*$')}, ''), {_sql(T.NOT_NAME)}, '_')") + ", ''), 'file')",
    "file_suffix(n STRING) RETURNS STRING": f"lower(regexp_extract(n, {_sql('(?s)[^/' + chr(92) * 2 + '.][^/' + chr(92) * 2 + ']*(' + chr(92) + '.[^./' + chr(92) * 2 + ']+)$')}, 1))",
    "file_badge(n STRING) RETURNS STRING": f"coalesce(element_at(map({_BADGES}), lower(regexp_extract(n, {_sql('(?s)' + chr(92) + '.([^.]*)$')}, 1))), nvl2(nullif(regexp_extract(n, {_sql('(?s)' + chr(92) + '.([^.]*)$')}, 1), ''), upper(substring(regexp_extract(n, {_sql('(?s)' + chr(92) + '.([^.]*)$')}, 1), 1, 3)), 'DOC'))",
    "size_label(n BIGINT) RETURNS STRING": "concat(format_string('%.1f', n / 1024), ' KB')",
    "is_https_url(u STRING) RETURNS BOOLEAN": "u RLIKE '^https://.+[^/]$'",
    "is_own_pdf(suffix STRING, head BINARY) RETURNS BOOLEAN": "lower(suffix) = '.pdf' AND instr(decode(substring(head, 1, 1024), 'ISO-8859-1'), '%PDF') > 0",
    "tokens_before(suffix STRING, units INT) RETURNS INT": f"IF(suffix IN ('.pdf', '.pptx'), units * {T.TOKENS_PER_UNIT}, NULL)",
    "unit_of(suffix STRING) RETURNS STRING": "CASE suffix WHEN '.pdf' THEN 'page' WHEN '.pptx' THEN 'slide' END",
    "savings_percent(b BIGINT, a BIGINT) RETURNS BIGINT": "IF(a IS NOT NULL AND floor((1 - a / nullif(b, 0)) * 100 + 0.5) > 0, least(floor((1 - a / nullif(b, 0)) * 100 + 0.5), 100), NULL)",
    "error_detail(body STRING) RETURNS STRING": "coalesce(get_json_object(IF(startswith(body, '{'), body, NULL), '$.detail'), 'Conversion failed')",
    "is_real_table(g ARRAY<ARRAY<STRING>>) RETURNS BOOLEAN": f"coalesce(size(g) >= 2 AND size(g[0]) >= 2 AND size(filter({_FILL}, n -> n >= 2)) >= 2 AND 2 * size(filter({_FILL}, n -> n >= 2)) >= size(filter({_FILL}, n -> n > 0)), false)",
}


class PdfParts:
    """pdf_parts(content): a row for each page, character, word and cell of a file."""

    def eval(self, content: bytes):
        names = [c.split()[0] for c in pdf.SCHEMA.split(", ")][1:]
        for r in pdf._rows("", bytes(content or b"")):
            yield tuple(r[n] for n in names)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("html_to_markdown", html._convert)
    spark.udtf.register("pdf_parts", udtf(PdfParts, returnType=pdf.SCHEMA.split(", ", 1)[1]))
    return [h.partition("(")[0] for h in FUNCTIONS] + ["html_to_markdown", "pdf_parts"]
