"""Queries of the archive and corpus operators, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import archive, corpus, measure
from vellum.operators.render import ordered_join
from vellum.sources import convert
from vellum.streaming import ingest
from vellum.plans.text_queries import DISTURBED, PIPED, sql_lines, sql_strip, table


def _files(spark, sf_dir):
    """Documents as files: a name of their source, their text as content."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat("source", F.lit(".pdf")).alias("name"), F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("path"))


def dedupe_content(spark, sf_dir):
    """[SET2, JN12, WIN4, SC21] The files that stay."""
    return corpus.without_duplicates(_files(spark, sf_dir)).select("doc_id", "name", "length")


def duplicates_dropped(spark, sf_dir):
    """[AGG13]"""
    f = _files(spark, sf_dir)
    kept = corpus.without_duplicates(f).select(F.lit(1).alias("n"))
    return f.select(F.lit(0).alias("n")).unionAll(kept).agg(F.count("*").alias("rows"), F.sum("n").alias("kept")).select((F.col("rows") - 2 * F.col("kept")).alias("dropped"))


def seeded_sample(spark, sf_dir):
    """[LIM1, SRT3]"""
    return corpus.seeded_sample(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), 100, 7, "doc_id")


def _cells(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = d.select(F.col("doc_id").alias("gid"), F.posexplode(F.split("text", "\n")).alias("row", "line"))
    return lines.select("gid", "row", F.posexplode(F.split("line", ",")).alias("col", "text")).withColumn("text", T.strip(F.replace("text", F.lit(". "), F.lit("\n"))))


def grid_features(spark, sf_dir):
    """[AGG15, AGG1]"""
    f = corpus.grid_features(_cells(spark, sf_dir))
    return f.select("gid", "nrows", "ncols", "ncells", "nfilled", "nonblank", "maxlen", "medlen", "p90len", "nmultiline", *[F.round(c, 6).alias(c) for c in ("empty", "rowfill", "mlfrac")])


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("gid"), F.expr("case when doc_id % 10 = 0 then 'A' when toxic = 1 then 'D' when quality = 1 then 'T' else 'F' end").alias("label"))


def rule_sweep(spark, sf_dir):
    """[FLT12, FLT13, JN9, AGG10, CMP10]"""
    return corpus.rule_sweep(corpus.grid_features(_cells(spark, sf_dir)), _labels(spark, sf_dir))


def signal_sweep(spark, sf_dir):
    """[AGG11] The share of signs in a text as the signal."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("gid"), (F.regexp_count("text", F.lit("[#$%&*!|]")) / F.greatest(F.length("text"), F.lit(1))).alias("rotated"), (F.col("doc_id") % 4 != 0).alias("kept"))
    return corpus.signal_sweep(d.join(_labels(spark, sf_dir), "gid"), [0.02, 0.05, 0.15])


def archive_names(spark, sf_dir):
    """[WIN3, SC7, SC9] Pages arrive under their url's stem; some names are taken."""
    p = table(spark, sf_dir, "pages").select("page_id", T.safe_stem(F.regexp_replace("url", "[0-9]+", F.expr("cast(page_id % 7 as string)"))).alias("stem"))
    taken = p.where("page_id % 5 = 0").select("stem").distinct()
    names = taken.select(T.candidate_name(F.col("stem"), F.lit(1)).alias("filename")).unionAll(taken.select(T.candidate_name(F.col("stem"), F.lit(3)).alias("filename")))
    return archive.archive_names(p, names, order="page_id").select("page_id", "filename")


def archive_search(spark, sf_dir):
    """[FLT8, SRT2, SC6] Events as archive entries."""
    e = table(spark, sf_dir, "events")
    entries = e.select(F.concat(F.lit("Report_"), F.col("event_type"), F.lit("_"), F.col("user_id").cast("string"), F.lit(".md")).alias("filename"), F.col("event_id").alias("size"), F.col("ts").alias("modified"))
    return archive.search(entries, "port_PURCHASE").select("filename", "size", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"), T.size_label(F.col("size")).alias("label"))


def _measured(spark, sf_dir):
    """Two engines' texts made of documents: one glues and garbles, the other invents table lines; some fail."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("base"), (F.col("doc_id") % 4).alias("grids"), F.col("n_chars").alias("bytes"), F.expr("cast(doc_id % 9 = 0 as int)").alias("notext"), F.expr(DISTURBED).alias("stock"), F.expr(PIPED.replace("E'", "'")).alias("own"))
    extra = {}
    for e, k in (("stock", 13), ("own", 17)):
        extra |= {f"{e}_s": F.expr(f"doc_id % {k} / 100.0D"), f"{e}_tokens": F.expr(f"cast(n_words as bigint) + doc_id % {k}"), f"{e}_error": F.expr(f"case when doc_id % {k} = 5 then 'broken' end")}
    return d.withColumn("n_words", F.size(F.split("base", " "))).withColumns(extra)


def corpus_report(spark, sf_dir):
    """[CMP8, CMP6, CMP11, FLT9, FLT10, AGG6-AGG9, SNK5]"""
    rows = _measured(spark, sf_dir)
    for e in ("stock", "own"):
        rows = corpus.score(rows, e)
    return corpus.report(rows, ("stock", "own"), "stock")


def engine_diff(spark, sf_dir):
    """[CMP11]"""
    d = _measured(spark, sf_dir).select("doc_id", "stock", "own")
    out = corpus.engine_diff(d, "stock", "own")
    return out.select("doc_id", "n_left", "n_right", F.size("only_left").alias("only_left"), F.size("only_right").alias("only_right"))


def file_lookup(spark, sf_dir):
    """[JN10, AGG10] Labels by an opaque id of their file; a third of the files have another id than their labels."""
    ids = table(spark, sf_dir, "documents").select(F.md5(F.expr("case when doc_id % 3 = 0 then concat('other ', doc_id) else cast(doc_id as string) end").cast("binary")).alias("file_id"), F.concat("source", F.lit(".pdf")).alias("filename"))
    labels = table(spark, sf_dir, "labels").select(F.md5(F.col("doc_id").cast("string").cast("binary")).alias("file_id"), "quality")
    return corpus.with_file_names(labels, ids).groupBy("filename").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))


def conversation_export(spark, sf_dir):
    """[AGG5, SRT1] Turns in order, one text for each conversation."""
    c = table(spark, sf_dir, "conversations").withColumn("line", F.concat("role", F.lit(": "), "text"))
    c = c.groupBy("conv_id").agg(F.count("*").cast("int").alias("n_turns"), ordered_join(["turn", "role"], "line", "\n\n").alias("t"))
    return c.select("conv_id", "n_turns", F.md5(F.col("t").cast("binary")).alias("digest"))


#: The bytes of a file of two pages for each customer, in SQL that both engines read: two lines of text, for a third of them a
#: ruled grid, and a second page that for a seventh has no text and for an eleventh a glued run.
_SAY = "'BT /F1 10 Tf {x} {y} Td (' || {text} || ') Tj ET' || chr(10)"
_ONE = " || ".join(
    [_SAY.format(x=72, y=700, text="c_mktsegment"), _SAY.format(x=72, y=680, text="c_name")]
    + ["case when c_custkey % 3 = 0 then " + " || ".join(
        f"'{x} {y} 120 24 re S' || chr(10) || " + _SAY.format(x=x + 4, y=y + 8, text=text)
        for x, y, text in ((72, 500, "'key'"), (192, 500, "'nation'"), (72, 476, "c_custkey"), (192, 476, "c_nationkey"))
    ) + " else '' end"]
)
_GLUE = "case when c_custkey % 11 = 0 then ' ' || repeat('x', 30) else '' end"
_TWO = f"case when c_custkey % 7 = 0 then '0 0 m 10 10 l S' else {_SAY.format(x=72, y=700, text=f"'second page of ' || c_custkey || {_GLUE}")} end"


def _object(number: int, body: str) -> str:
    return f"'{number} 0 obj' || chr(10) || {body} || chr(10) || 'endobj' || chr(10)"


def _stream(number: int, body: str) -> str:
    return _object(number, f"'<< /Length ' || length({body}) || ' >>' || chr(10) || 'stream' || chr(10) || {body} || chr(10) || 'endstream'")


def _page(number: int, content: int) -> str:
    return _object(number, f"'<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents {content} 0 R >>'")


PDF = " || ".join([
    "'%PDF-1.4' || chr(10)", _object(1, "'<< /Type /Catalog /Pages 2 0 R >>'"), _object(2, "'<< /Type /Pages /Kids [4 0 R 6 0 R] /Count 2 >>'"),
    _object(3, "'<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>'"), _page(4, 5), _stream(5, _ONE), _page(6, 7), _stream(7, _TWO), "'trailer << /Size 8 /Root 1 0 R >>'",
])


def _pdfs(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a small file of them is a lot of bytes
    c = c.select(F.expr("c_custkey || '.pdf'").alias("path"), F.expr(PDF).alias("t"))
    return c.select("path", F.length("t").cast("long").alias("length"), F.col("t").cast("binary").alias("content"))


def pdf_convert(spark, sf_dir):
    """[CMP5, CMP4, CMP3, SRC2, SRC5, SRC8, PRJ2, SC3, FLT1] Files to texts, as a caller gets them."""
    got = ingest.responses(convert.convert(_pdfs(spark, sf_dir)))
    return got.select("filename", "content", F.col("tokens.before").alias("tokens_before"), F.col("tokens.unit").alias("unit"), F.col("tokens.units").alias("units"))


def corpus_measure(spark, sf_dir):
    """[CMP7, CMP8, CMP9, SC2] The whole measurement over files: parsed, rendered by both selections, scored, reported."""
    return measure.report(measure.measure_files(_pdfs(spark, sf_dir)))


_FILES = "f as (select doc_id, source || '.pdf' as name, strlen(text) as length, sha256(text) as h from documents)"
_KEPT = f"{_FILES}, k as (select *, row_number() over (partition by name, length, h order by doc_id) as n from f)"
_CELLS = f"""c as (select doc_id as gid, i as row, j as col, {sql_strip("replace(string_split(string_split(text, E'\\n')[i], ',')[j], '. ', E'\\n')")} as text
  from documents, lateral (select unnest(range(1, len(string_split(text, E'\\n')) + 1)) as i), lateral (select unnest(range(1, len(string_split(string_split(text, E'\\n')[i], ',')) + 1)) as j)),
r as (select gid, row, count(*) filter (text <> '') as f, count(*) as width from c group by all),
v as (select gid, count(*) as nrows, max(width) as ncols, count(*) filter (f >= 2) as nfilled, count(*) filter (f > 0) as nonblank from r group by gid),
p as (select gid, count(*) as ncells, count(*) filter (text = '') / count(*) as empty, max(length(text))::int as maxlen, median(length(text))::double as medlen, quantile_cont(length(text), 0.9)::double as p90len,
  count(*) filter (contains(text, E'\\n')) as nmultiline, count(*) filter (text <> '') as nonempty from c group by gid),
g as (select v.*, p.* exclude (gid, nonempty), coalesce(nfilled / nullif(nonblank, 0), 0) as rowfill, coalesce(nmultiline / nullif(nonempty, 0), 0) as mlfrac from v join p using (gid)),
lab as (select doc_id as gid, case when doc_id % 10 = 0 then 'A' when toxic = 1 then 'D' when quality = 1 then 'T' else 'F' end as label from labels)"""
_P = f"""s as (select *, regexp_extract(regexp_replace(url, '[0-9]+', (page_id % 7)::varchar, 'g'), '([^/\\\\]*)$', 1) as last from pages), t as (select page_id, {sql_strip("regexp_replace(regexp_replace(last, '\\.[^.]*$', ''), '[^\\p{L}\\p{N}_\\-. ]', '_', 'g')")} as st from s),
a as (select page_id, case when st = '' then 'file' else st end as stem from t)"""


def _engine(e: str, k: int) -> str:
    text = DISTURBED if e == "stock" else PIPED
    return f"""{e}_t as (select doc_id, {text} as t from documents),
{e} as (select doc_id, len(regexp_extract_all(t, '{T.GLUED}')) as glued, len(regexp_extract_all(t, '{T.MOJIBAKE}')) as mojibake, (len(regexp_extract_all(t, '{T.MOJIBAKE}')) > 0.15 * length(t))::int as mojibake_doc,
  case when doc_id % 4 > 0 then 0 else len(list_filter(string_split_regex(t, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: starts_with(x, '|'))) end as phantom_rows,
  len(string_split(text, ' ')) + doc_id % {k} as tokens, doc_id % {k} / 100.0 as s, case when doc_id % {k} = 5 then 'broken' end as error from {e}_t join documents using (doc_id)),
{e}_d as (select doc_id, coalesce(sum(greatest(o - b, 0)), 0) as digit_excess, coalesce(sum(greatest(b - o, 0)), 0) as digit_deficit from
  (select doc_id, g, sum(o) as o, sum(b) as b from (select doc_id, unnest(regexp_extract_all(t, '\\p{{Nd}}')) as g, 1 as o, 0 as b from {e}_t union all select doc_id, unnest(regexp_extract_all(text, '\\p{{Nd}}')), 0, 1 from documents) group by all) group by doc_id)"""


def _row(e: str) -> str:
    return f"""select '{e}' as engine, count(*) filter (well) as n_docs, count(*) filter (ok and not well) as n_broken, sum(n_chars) filter (well)::bigint as bytes, count(*) filter (well and doc_id % 4 = 0) as gridless, sum((doc_id % 9 = 0)::int) filter (well)::bigint as notext,
  {", ".join(f"sum({e}.{c}) filter (well)::bigint as {c}" for c in ("glued", "mojibake", "mojibake_doc", "phantom_rows", "tokens"))},
  coalesce(sum(digit_excess) filter (well), 0)::bigint as digit_excess, coalesce(sum(digit_deficit) filter (well), 0)::bigint as digit_deficit,
  count(*) filter (well and {e}.glued > 0) as docs_with_glue, count(*) filter ({e}.error is not null) as failures, round(sum({e}.s) filter (well), 4)::double as elapsed,
  median({e}.s) filter (well)::double as median_s, median({e}.glued) filter (well)::double as median_glued, median(coalesce(digit_deficit, 0)) filter (well)::double as median_digit_deficit
  from m join {e} using (doc_id) left join {e}_d using (doc_id)"""


ORACLE = {
    "dedupe_content": f"with {_KEPT} select doc_id, name, length from k where n = 1",
    "duplicates_dropped": f"with {_KEPT} select count(*) filter (n > 1) as dropped from k",
    "seeded_sample": "select doc_id, source, n_chars from documents order by md5(doc_id || ':7'), doc_id limit 100",
    "grid_features": f"with {_CELLS} select gid, nrows, ncols, ncells, nfilled, nonblank, maxlen, medlen, p90len, nmultiline, round(empty, 6) as empty, round(rowfill, 6) as rowfill, round(mlfrac, 6) as mlfrac from g",
    "rule_sweep": f"with {_CELLS}, x as (select * from g join lab using (gid) where label <> 'A') "
    + " union all ".join(f"select '{r}' as rule, " + ", ".join(f"count(*) filter ({'not ' if w == 'dropped' else ''}({c}) and label = '{k}') as {w}_{k}" for k in "TFD" for w in ("kept", "dropped")) + " from x" for r, c in corpus.RULES.items()),
    "signal_sweep": """with x as (select len(regexp_extract_all(text, '[#$%&*!|]')) / greatest(length(text), 1) as s, case when doc_id % 10 = 0 then 'A' when toxic = 1 then 'D' when quality = 1 then 'T' else 'F' end as label from documents join labels using (doc_id) where doc_id % 4 <> 0)
select t::double as threshold, """ + ", ".join(f"count(*) filter (s >= t and label = '{k}') as dropped_{k}" for k in "DTF") + " from x, (values (0.02), (0.05), (0.15)) v(t) group by t",
    "archive_names": f"""with {_P}, u as (select distinct stem from a where page_id % 5 = 0),
n as (select stem, k, row_number() over (partition by stem order by k) as f from (select distinct stem from a) s, range(1, 1000) r(k) where not exists (select 1 from u where u.stem = s.stem and k in (1, 3))),
o as (select *, row_number() over (partition by stem order by page_id) as f from a)
select page_id, case when k = 1 then o.stem || '.md' else o.stem || ' (' || k || ').md' end as filename from o join n using (stem, f)""",
    "archive_search": "select 'Report_' || event_type || '_' || user_id || '.md' as filename, event_id as size, strftime(ts, '%Y-%m-%dT%H:%M:%S') as modified, printf('%.1f KB', floor(event_id / 1024 * 10 + 0.5) / 10) as label from events where contains(lower('Report_' || event_type || '_' || user_id || '.md'), 'port_purchase')",
    "corpus_report": f"""with {_engine("stock", 13)}, {_engine("own", 17)},
m as (select d.doc_id, n_chars, stock.error is null and own.error is null as ok, stock.error is null and own.error is null and stock.glued <= 50 as well from documents d join stock using (doc_id) join own using (doc_id)) {_row("stock")} union all {_row("own")}""",
    "engine_diff": f"""with s as (select doc_id, {DISTURBED} as a, {PIPED} as b from documents), l as (select doc_id, {sql_lines("a")} as a, {sql_lines("b")} as b from s)
select doc_id, len(a)::int as n_left, len(b)::int as n_right, len(list_distinct(list_filter(a, lambda x: not list_contains(b, x))))::int as only_left, len(list_distinct(list_filter(b, lambda x: not list_contains(a, x))))::int as only_right from l""",
    "file_lookup": "select source || '.pdf' as filename, count(*) as n, sum(quality)::bigint as good from labels join documents using (doc_id) where doc_id % 3 <> 0 group by 1",
    "pdf_convert": """select c_custkey || '.pdf' as filename, c_mktsegment || chr(10) || c_name || case when c_custkey % 3 = 0 then E'\\n\\n| key | nation |\\n| --- | --- |\\n| ' || c_custkey || ' | ' || c_nationkey || ' |' else '' end || E'\\n\\n'
  || case when c_custkey % 7 = 0 then '[vellum: no extractable text layer on page 2]' else 'second page of ' || c_custkey || case when c_custkey % 11 = 0 then ' ' || repeat('x', 30) else '' end end as content,
  4500 as tokens_before, 'page' as unit, 2 as units from customer""",
    "corpus_measure": f"""select engine, count(*) as n_docs, 0 as n_broken, sum(length({PDF}))::bigint as bytes, count(*) filter (c_custkey % 3 <> 0) as gridless, count(*) filter (c_custkey % 7 = 0) as notext,
  count(*) filter (c_custkey % 11 = 0 and c_custkey % 7 <> 0) as glued, 0 as mojibake, 0 as mojibake_doc, 0 as phantom_rows, 0 as digit_excess, 0 as digit_deficit, 0 as tokens, count(*) filter (c_custkey % 11 = 0 and c_custkey % 7 <> 0) as docs_with_glue,
  0 as failures, null::double as elapsed, 0.0::double as median_s, 0.0::double as median_glued, 0.0::double as median_digit_deficit from customer, (values ('own'), ('stock')) v(engine) group by engine""",
    "conversation_export": "select conv_id, count(*)::int as n_turns, md5(string_agg(role || ': ' || text, E'\\n\\n' order by turn, role, text)) as digest from conversations group by conv_id",
}
QUERIES = {k: globals()[k] for k in ORACLE}
