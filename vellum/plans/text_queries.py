"""Queries of the text operators over driver tables, each with its SQL twin.

Raw documents hold no glued runs, no table lines and no markers, so each query first disturbs the text, alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import corpus
from vellum.streaming import ingest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL of the same classes for DuckDB (fixed values).
SQL_WS = r"[\p{Z}\x09-\x0D\x1C-\x1F\x{85}]"
SQL_LINES = r"string_split_regex({0}, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')"


def sql_lines(x: str) -> str:
    parts = SQL_LINES.format(x)
    return f"(case when {parts}[-1] = '' then {parts}[:-2] else {parts} end)"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"


#: Every seventh document loses its blanks (glued runs), every eleventh has its vowels garbled (mojibake).
DISTURBED = """case when doc_id % 7 = 0 then replace(text, ' ', '') when doc_id % 11 = 0 then translate(text, 'aeiounrst', 'àéîõüñðÿþ') else text end"""


def _disturbed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.expr(DISTURBED).alias("text"))


def quality_score(spark, sf_dir):
    """[CMP6: SC10-SC13] The per-document metrics."""
    d, t = _disturbed(spark, sf_dir), F.col("text")
    return d.select("doc_id", T.glued(t).alias("glued"), T.mojibake(t).alias("mojibake"), T.mojibake_doc(t).alias("mojibake_doc"), F.size(T.digits(t)).alias("n_digits"))


def _digit_pairs(spark, sf_dir):
    out = "case doc_id % 3 when 0 then text when 1 then text || ' 77 1' else replace(replace(text, '1', ''), '3', '4') end"
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("base"), F.expr(out).alias("out"))


def digit_parity(spark, sf_dir):
    """[JN8, SET3, SC13]"""
    d = _digit_pairs(spark, sf_dir)
    return d.select("doc_id", T.digit_excess(F.col("out"), F.col("base")).alias("digit_excess"), T.digit_deficit(F.col("out"), F.col("base")).alias("digit_deficit"))


def quality_totals(spark, sf_dir):
    """[AGG6, AGG7, AGG14] Corpus totals."""
    q = quality_score(spark, sf_dir)
    n = F.count("*")
    with_glue = F.count_if(F.col("glued") > 0)
    return q.agg(n.alias("n_docs"), F.sum("glued").alias("glued"), F.sum("mojibake").alias("mojibake"), F.sum("mojibake_doc").alias("mojibake_docs"), with_glue.alias("docs_with_glue"), T.percent(with_glue, n).alias("glue_share"))


def quality_medians(spark, sf_dir):
    """[AGG8] Exact medians."""
    q = quality_score(spark, sf_dir).join(digit_parity(spark, sf_dir), "doc_id")
    m = corpus.exact_medians(q, {c: F.col(c) for c in ("glued", "mojibake", "digit_deficit")})
    return m.agg(*[F.coalesce(F.max(F.when(F.col("name") == c, F.col("median"))), F.lit(0.0)).alias(f"median_{c}") for c in ("glued", "mojibake", "digit_deficit")])


def mojibake_by_lang(spark, sf_dir):
    """[SC11, SC12, AGG7]"""
    d = _disturbed(spark, sf_dir)
    return d.groupBy("lang").agg(F.sum(T.mojibake(F.col("text"))).alias("mojibake"), F.sum(T.mojibake_doc(F.col("text"))).alias("mojibake_docs"), F.count("*").alias("n_docs"))


#: Sentences on lines of their own; every third line a table line, every fifth document with CRLF and a final line end.
PIPED = r"""case when doc_id % 5 = 0 then replace(replace(text, '. ', E'.\n| '), E'\n', E'\r\n') || E'\r\n' else replace(text, ', ', E'\n|') end"""
PIPED_SPARK = PIPED.replace("E'", "'")


def pipe_rows(spark, sf_dir):
    """[SC14, SC16, SC15, AGG12]"""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(PIPED_SPARK).alias("text"), (F.col("doc_id") % 4).alias("grids"))
    t = F.col("text")
    return d.select("doc_id", T.line_count(t).alias("n_lines"), T.pipe_rows(t).alias("pipe_rows"), T.phantom_rows(t, F.col("grids")).alias("phantom_rows"), T.blob_lines(t).alias("blob_lines"), T.paragraph_cells(t).alias("paragraph_cells"))


MARKED = r"case when doc_id % 2 = 0 then replace(text, E'\n', E'\n[vellum: no extractable text layer on page 12]\n') else text end"


def without_markers(spark, sf_dir):
    """[FLT11, SC19]"""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(MARKED.replace("E'", "'")).alias("text"))
    out = T.without_markers(F.col("text"))
    return d.select("doc_id", F.md5(out.cast("binary")).alias("digest"), F.length(out).alias("n_chars"), F.size(T.digits(out)).alias("n_digits"), T.no_text_marker(F.col("doc_id")).alias("marker"))


BLOCKED = r"replace(replace(text, '. ', E'.\n\n'), ', ', case when doc_id % 3 = 0 then E',\n| ' else E',\n' end)"


def reflow(spark, sf_dir):
    """[SC22, FLT14]"""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(BLOCKED.replace("E'", "'")).alias("text"))
    out = T.reflow(F.col("text"))
    return d.select("doc_id", F.md5(out.cast("binary")).alias("digest"), F.length(out).alias("n_chars"))


def source_quality_split(spark, sf_dir):
    """[FLT10, AGG6] Well-formed and broken sources by the glue of one engine's text alone."""
    d = _disturbed(spark, sf_dir).select("doc_id", T.glued(F.col("text")).alias("glued"), F.length("text").alias("n_chars"))
    bucket = F.when(F.col("glued") <= T.BROKEN_SOURCE_GLUE, "well").otherwise("broken")
    return d.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_docs"), F.sum("glued").alias("glued"), F.sum("n_chars").alias("n_chars"))


def rowfill_vote(spark, sf_dir):
    """[AGG1, FLT2, FLT4, PRJ1] A document as a grid: lines are rows, comma fields cells."""
    rows = F.transform(F.split("text", "\n"), lambda line: F.transform(F.split(line, ","), T.cell_text))
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(rows, lambda r: F.exists(r, lambda c: c != "")).alias("rows"))
    return d.select("doc_id", F.size("rows").alias("n_rows"), F.size(F.filter("rows", lambda r: F.size(F.filter(r, lambda c: c != "")) >= 2)).alias("n_filled"), T.is_real_table(F.col("rows")).alias("is_table"))


def numeric_tokens(spark, sf_dir):
    """[SC17]"""
    d = _digit_pairs(spark, sf_dir)
    return d.select("doc_id", F.size(T.numeric_tokens(F.col("out"))).alias("n_numbers"))


def safe_stem(spark, sf_dir):
    """[SC7, SC5, SC6, FLT15] A page's url as a file name."""
    p, u = table(spark, sf_dir, "pages"), F.col("url")
    return p.select("page_id", T.safe_stem(u).alias("stem"), T.file_badge(u).alias("badge"), T.size_label(F.length("html")).alias("size_label"), T.is_https_url(u).alias("is_https"))


def token_savings(spark, sf_dir):
    """[SC3, SC4] Estimates and savings; every fifth order without a count, every seventh with an unknown type."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("case o_orderkey % 7 when 0 then '.docx' when 1 then '.pptx' else '.pdf' end").alias("suffix"), F.expr("o_custkey % 12").alias("units"), F.expr("case when o_orderkey % 5 <> 0 then cast(o_totalprice as bigint) % 30000 end").alias("after"))
    before = T.tokens_before(F.col("suffix"), F.col("units"))
    return o.select("o_orderkey", before.alias("tokens_before"), T.unit_of(F.col("suffix")).alias("unit"), T.savings_percent(before, F.col("after")).alias("savings"))


def route(spark, sf_dir):
    """[FLT1, SRC1, SRC2] Files made of documents: three suffixes, the magic at the start, further on, too late or missing."""
    d = table(spark, sf_dir, "documents")
    content = F.expr("case doc_id % 5 when 0 then '%PDF-1.4 ' || text when 1 then '  %PDF-1.7 ' || text when 2 then repeat(' ', 1022) || '%PDF' when 3 then repeat(' ', 1020) || '%PDF' else text end").cast("binary")
    suffix = F.expr("case doc_id % 3 when 0 then '.pdf' when 1 then '.PDF' else '.html' end")
    d = d.select("doc_id", content.alias("content"), suffix.alias("suffix"))
    own = T.is_own_pdf(F.col("suffix"), F.col("content"))
    return d.select("doc_id", F.when(own, "pdf").otherwise("generic").alias("route"))


def batch_events(spark, sf_dir):
    """[PRJ3, FLT6, SC23, WIN3] An event for each file: saved under a free name of its stem, or refused."""
    d = table(spark, sf_dir, "documents").select(F.expr("concat('/in/', doc_id, '/doc ', doc_id % 100, '.txt')").alias("path"), "text", (F.col("n_chars") * 100000).alias("size"))
    files = d.withColumn("error", ingest.refusal(F.col("size")))
    return ingest.events(files).select("path", "filename", "status", "saved_as", "detail")


def error_details(spark, sf_dir):
    """[SC23] Error bodies made of events: JSON with and without a detail, and plain text."""
    e = table(spark, sf_dir, "events")
    body = F.expr("case event_id % 3 when 0 then '{\"detail\": \"bad ' || event_type || '\"}' when 1 then '{\"other\": 1}' else event_type end")
    return e.select("event_id", T.error_detail(body).alias("detail"))


def changelog(spark, sf_dir):
    """[SC24]"""
    d = table(spark, sf_dir, "documents")
    log = F.expr("'# Log\n\n## v1.2.0 (new)\n' || case when doc_id % 3 = 0 then '' else text end || '\n## v1.1.0\nold\n'")
    return d.select("doc_id", T.changelog_section(log, "1.2.0").alias("section"), T.changelog_section(log, "1.1.0").alias("older"), T.changelog_section(log, "9.9").alias("missing"))


_D = f"d as (select doc_id, lang, source, {DISTURBED} as text from documents)"
_SCORE = f"""select doc_id, len(regexp_extract_all(text, '{T.GLUED}'))::int as glued, len(regexp_extract_all(text, '{T.MOJIBAKE}'))::int as mojibake,
  (len(regexp_extract_all(text, '{T.MOJIBAKE}')) > 0.15 * length(text))::int as mojibake_doc, len(regexp_extract_all(text, '\\p{{Nd}}'))::int as n_digits from d"""
_PAIRS = "p as (select doc_id, text as base, case doc_id % 3 when 0 then text when 1 then text || ' 77 1' else replace(replace(text, '1', ''), '3', '4') end as out from documents)"
_PARITY = """, dig as (
  select doc_id, unnest(regexp_extract_all(out, '\\p{Nd}')) as g, 1 as o, 0 as b from p union all select doc_id, unnest(regexp_extract_all(base, '\\p{Nd}')), 0, 1 from p),
cnt as (select doc_id, g, sum(o) as o, sum(b) as b from dig group by all),
par as (select p.doc_id, coalesce(sum(greatest(o - b, 0)), 0)::int as digit_excess, coalesce(sum(greatest(b - o, 0)), 0)::int as digit_deficit from p left join cnt using (doc_id) group by p.doc_id)"""
_PIPED = f"t as (select doc_id, {PIPED} as text, doc_id % 4 as grids from documents), l as (select *, {sql_lines('text')} as lines, from t)"

ORACLE = {
    "quality_score": f"with {_D} {_SCORE}",
    "digit_parity": f"with {_PAIRS}{_PARITY} select * from par",
    "quality_totals": f"""with {_D}, q as ({_SCORE}), a as (select count(*) as n_docs, sum(glued)::bigint as glued, sum(mojibake)::bigint as mojibake, sum(mojibake_doc)::bigint as mojibake_docs, count(*) filter (glued > 0) as docs_with_glue from q)
  select *, docs_with_glue || ' (' || round_even(docs_with_glue * 100.0 / n_docs, 0)::bigint || '%)' as glue_share from a""",
    "quality_medians": f"with {_D}, {_PAIRS}{_PARITY}, q as ({_SCORE}) select median(glued)::double as median_glued, median(mojibake)::double as median_mojibake, median(digit_deficit)::double as median_digit_deficit from q join par using (doc_id)",
    "mojibake_by_lang": f"with {_D}, q as ({_SCORE}) select lang, sum(mojibake)::bigint as mojibake, sum(mojibake_doc)::bigint as mojibake_docs, count(*) as n_docs from q join d using (doc_id) group by lang",
    "pipe_rows": f"""with {_PIPED} select doc_id, len(lines)::int as n_lines, len(list_filter(lines, lambda x: starts_with(x, '|')))::int as pipe_rows,
  (case when grids > 0 then 0 else len(list_filter(lines, lambda x: starts_with(x, '|'))) end)::int as phantom_rows, len(list_filter(lines, lambda x: length(x) > 300))::int as blob_lines,
  len(list_filter(flatten(list_transform(list_filter(lines, lambda x: starts_with(x, '|')), lambda x: string_split(x, '|'))), lambda c: length(c) > 300))::int as paragraph_cells from l""",
    "without_markers": f"""with t as (select doc_id, {MARKED} as text from documents),
  o as (select doc_id, coalesce(array_to_string(list_filter({sql_lines('text')}, lambda x: not contains(x, 'no extractable text layer')), E'\\n'), '') as out from t)
  select doc_id, md5(out) as digest, length(out)::int as n_chars, len(regexp_extract_all(out, '\\p{{Nd}}'))::int as n_digits, '[vellum: no extractable text layer on page ' || doc_id || ']' as marker from o""",
    "reflow": f"""with t as (select doc_id, {BLOCKED} as text from documents),
  o as (select doc_id, array_to_string(list_transform(string_split(text, E'\\n\\n'), lambda b: case when regexp_matches(b, '(^|\\n)\\|') then b else replace(b, E'\\n', ' ') end), E'\\n\\n') as out from t)
  select doc_id, md5(out) as digest, length(out)::int as n_chars from o""",
    "source_quality_split": f"with {_D}, q as (select len(regexp_extract_all(text, '{T.GLUED}')) as glued, length(text) as n_chars from d) select case when glued <= 50 then 'well' else 'broken' end as bucket, count(*) as n_docs, sum(glued)::bigint as glued, sum(n_chars)::bigint as n_chars from q group by 1",
    "rowfill_vote": f"""with c as (select doc_id, i, j, {sql_strip("string_split(string_split(text, E'\\n')[i], ',')[j]")} as cell
  from documents, lateral (select unnest(range(1, len(string_split(text, E'\\n')) + 1)) as i), lateral (select unnest(range(1, len(string_split(string_split(text, E'\\n')[i], ',')) + 1)) as j)),
r as (select doc_id, i, count(*) as width, count(*) filter (cell <> '') as n from c group by all having count(*) filter (cell <> '') > 0),
g as (select doc_id, count(*) as n_rows, count(*) filter (n >= 2) as n_filled, min_by(width, i) as first_width from r group by doc_id)
select doc_id, coalesce(n_rows, 0)::int as n_rows, coalesce(n_filled, 0)::int as n_filled, coalesce(n_rows >= 2 and first_width >= 2 and n_filled >= 2 and n_filled / n_rows >= 0.5, false) as is_table from documents left join g using (doc_id)""",
    "numeric_tokens": f"with {_PAIRS} select doc_id, len(list_filter(regexp_extract_all(out, '\\p{{Nd}}+(?:[.,]\\p{{Nd}}+)*'), lambda x: length(x) >= 2))::int as n_numbers from p",
    "safe_stem": f"""with s as (select *, regexp_extract(url, '([^/\\\\]*)$', 1) as last from pages), t as (select *, {sql_strip("regexp_replace(regexp_replace(last, '\\.[^.]*$', ''), '[^\\p{L}\\p{N}_\\-. ]', '_', 'g')")} as st, lower(regexp_extract(url, '\\.([^.]*)$', 1)) as ext from s)
select page_id, case when st = '' then 'file' else st end as stem, coalesce(case ext {" ".join(f"when '{k}' then '{v}'" for k, v in T.BADGES.items())} when '' then 'DOC' end, upper(ext[1:3])) as badge,
  printf('%.1f KB', floor(length(html) / 1024 * 10 + 0.5) / 10) as size_label, regexp_matches(url, '^https://.+[^/]$') as is_https from t""",
    "token_savings": """with o as (select o_orderkey, case o_orderkey % 7 when 0 then '.docx' when 1 then '.pptx' else '.pdf' end as suffix, o_custkey % 12 as units, case when o_orderkey % 5 <> 0 then trunc(o_totalprice)::bigint % 30000 end as after from orders),
b as (select *, case when suffix <> '.docx' then units * 2250 end as before from o), p as (select *, floor((1 - after / nullif(before, 0)) * 100 + 0.5)::bigint as pct from b)
select o_orderkey, before as tokens_before, case suffix when '.pdf' then 'page' when '.pptx' then 'slide' end as unit, case when pct > 0 then least(pct, 100) end as savings from p""",
    "route": """select doc_id, case when doc_id % 3 <> 2 and (doc_id % 5 in (0, 1, 3) or (doc_id % 5 = 4 and contains(left(text, 1000), '%PDF'))) then 'pdf' else 'generic' end as route from documents""",
    "batch_events": """with d as (select '/in/' || doc_id || '/doc ' || doc_id % 100 || '.txt' as path, 'doc ' || doc_id % 100 as stem, n_chars * 100000 > 209715200 as large from documents),
k as (select *, row_number() over (partition by stem, large order by path) as k from d)
select path, stem || '.txt' as filename, case when large then 'error' else 'ok' end as status, case when large then null when k = 1 then stem || '.md' else stem || ' (' || k || ').md' end as saved_as, case when large then 'File too large (200 MB max)' end as detail from k""",
    "error_details": "select event_id, case event_id % 3 when 0 then 'bad ' || event_type else 'Conversion failed' end as detail from events",
    "changelog": f"select doc_id, case when doc_id % 3 = 0 then '' else {sql_strip('text')} end as section, 'old' as older, null::varchar as missing from documents",
}
QUERIES = {k: globals()[k] for k in ORACLE}
