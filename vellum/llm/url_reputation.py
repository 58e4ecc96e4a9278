"""URL filters (2): explicit rules first, then empirical-Bayes host reputation. DataFrame operations only.

Labelled outcomes of pages are counted by host. Their bad share is shrunk through beta-binomial priors: a host's towards its
registered domain's, that towards its suffix's, that towards the corpus's. How strongly is learned at each level by the
method of moments. A host is blocked when the lower posterior bound of its bad share exceeds a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Public suffixes of two labels that registered domains stand under (fixed values). A full list is passed as `suffixes`.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "co.za")
Z, MAX_BAD = 1.645, 0.25
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no ://: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; null or no ://: empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


_NUMERIC = r"^([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*\])$"


def bare_host(host: Column) -> Column:
    """The host without a user before @ and a port after the last colon."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")


def suffix_of(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The public suffix: one of the given ones of two labels, else the last label. Addresses in numbers: empty."""
    bare = bare_host(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(bare.rlike(_NUMERIC), "").when(two.isin(*suffixes), two).otherwise(F.substring_index(bare, ".", -1))


def domain_of(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The label before the suffix, and the suffix; a bare suffix and an address in numbers are their own domains."""
    bare = bare_host(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(bare.rlike(_NUMERIC), bare).when(two.isin(*suffixes), F.substring_index(bare, ".", -3)).otherwise(two)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null for none. A rule fits its host and all subdomains of it if the
    path starts with the rule's. Of equally long ones the first in the alphabet wins."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _concentration(groups: DataFrame) -> float:
    """Of the beta prior that groups (n, bad, parent mean m) have in common: moments of a beta-binomial."""
    p = F.col("bad") / F.col("n")
    own = groups.where("n > 0").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * (p - F.col("m")) ** 2 / (F.col("m") * (1 - F.col("m")))).alias("s"),
    ).first()
    if not own["k"]:
        return 1.0
    room = own["n"] - own["nn"] / own["n"] - (own["k"] - 1)
    rho = (own["s"] - (own["k"] - 1)) / room if room > 0 else 0.0
    return 1 / min(0.9, max(0.001, rho)) - 1


def _shrunk(groups: DataFrame, k: float) -> DataFrame:
    """groups with the mean and concentration of their posteriors."""
    return groups.withColumns({"mean": (F.lit(k) * F.col("m") + F.col("bad")) / (F.lit(k) + F.col("n")), "size": F.lit(k) + F.col("n")})


def lower_bound(mean: Column, size: Column) -> Column:
    """The lower 95 % bound of a beta posterior of this mean and concentration: the usual closed form of the beta quantile (26.5.22
    of Abramowitz and Stegun) where both of its parameters are 1 or more, else that of the normal curve with the same moments."""
    a, b = mean * size, (1 - mean) * size
    p, q = F.try_divide(F.lit(1.0), 2 * a - 1), F.try_divide(F.lit(1.0), 2 * b - 1)
    level = (Z * Z - 3) / 6
    mid = F.try_divide(F.lit(2.0), p + q)
    w = Z * F.try_divide(F.sqrt(mid + level), mid) - (q - p) * (level + 5 / 6 - F.try_divide(F.lit(2 / 3), mid))
    return F.when((a >= 1) & (b >= 1), a / (a + b * F.exp(2 * w))).otherwise(mean - Z * F.sqrt(mean * (1 - mean) / (size + 1)))


def host_reputation(outcomes: DataFrame, hosts: DataFrame, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """outcomes (host, bad 0 or 1) and hosts (host), repeated or not -> (host, n, bad, mean, lower): the posterior mean and lower
    bound of each host's bad share. Hosts without an outcome take their domain's prior, domains their suffix's.

    Outcomes and hosts are counted in each task before the one shuffle of them, so a host with a third of them does not gather;
    the counts are written once, and all levels are sums of those. Outcomes with a null host or a null bad are ignored;
    without any every host has the mean 0.5. Only three numbers reach the driver."""
    seen = outcomes.where(F.col("host").isNotNull() & F.col("bad").isNotNull()).select("host", F.col("bad").cast("long").alias("bad"))
    every = hosts.select("host", F.lit(None).cast("long").alias("bad")).unionByName(seen)
    every = every.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    every = materialize(every.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)}), "hosts")
    domains = every.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes_ = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes_.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    base = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1)

    suffixes_ = suffixes_.withColumn("m", F.lit(base))
    suffixes_ = _shrunk(suffixes_, _concentration(suffixes_)).select("suffix", F.col("mean").alias("m"))
    domains = materialize(domains.join(suffixes_, "suffix"), "domains")
    domains = _shrunk(domains, _concentration(domains)).select("domain", F.col("mean").alias("m"))
    every = every.join(domains, "domain")
    every = _shrunk(every, _concentration(every))
    return every.select("host", "n", "bad", "mean", lower_bound(F.col("mean"), F.col("size")).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, max_bad: float = MAX_BAD, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """-> (page_id, host, path, rule, verdict): block or allow for every page: the longest fitting rule's verdict, else block
    where the lower bound of the host's bad share exceeds max_bad. Null urls and urls without :// have the empty host, which
    is judged like any other; long urls are read whole. Repeated rows are judged alike; an empty table gives no rows; only id_col
    and url_col are read, so other columns may have any name."""
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    blocked = host_reputation(outcomes, urls.select("host"), suffixes).where(F.col("lower") > max_bad).select("host", F.lit("block").alias("by_host"))
    out = urls.withColumns({"rule": rule, "by_rule": verdict}).join(materialize(blocked, "blocked"), "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "by_host", F.lit("allow")).alias("verdict"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad): a page's path ends in the number of the document that was taken from it; its label is the outcome."""
    doc = F.regexp_extract(path_of(F.col("url")), r"^/[^/]*/([0-9]{1,18})", 1)
    known = pages.select(host_of(F.col("url")).alias("host"), doc.try_cast("long").alias("doc_id")).where("doc_id is not null")
    return known.join(labels.select("doc_id", "quality"), "doc_id").select("host", (1 - F.col("quality")).alias("bad"))


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return judge(pages, page_outcomes(pages, labels))


def _level(name: str, groups: str) -> str:
    """SQL for a level: groups has the columns n, bad and m."""
    return f"""{name}_k as (select 1 / least(0.9, greatest(0.001, coalesce(case when room > 0 then (s - (k - 1)) / room else 0 end, 0.5))) - 1 as c
  from (select count(*) as k, sum(n) - sum(n::double * n) / sum(n) - (count(*) - 1) as room,
    sum(n * (bad / n - m) ** 2 / (m * (1 - m))) as s from {groups} where n > 0))"""


ORACLE = f"""with u as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
seen as (
  select u.host, count(*) as n, sum(1 - quality)::double as bad
  from u join labels on doc_id = try_cast(nullif(regexp_extract(path, '^/[^/]*/([0-9]{{1,18}})', 1), '') as bigint)
  where quality is not null group by u.host),
h0 as (
  select h.host, coalesce(n, 0) as n, coalesce(bad, 0) as bad, regexp_replace(regexp_replace(h.host, '(?s)^.*@', ''), ':[0-9]*$', '') as bare, string_split(bare, '.') as l
  from (select distinct host from u) h left join seen on seen.host = h.host),
h as (
  select host, n, bad, array_to_string(l[-3:], '.') as three, array_to_string(l[-2:], '.') as two, l[-1] as one,
    two in ({", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)}) as long, regexp_matches(bare, '{_NUMERIC}') as numeric,
    case when numeric then bare when long then three else two end as domain, case when numeric then '' when long then two else one end as suffix from h0),
d as (select domain, suffix, sum(n) as n, sum(bad) as bad from h group by all),
s as (select suffix, sum(n) as n, sum(bad) as bad, (sum(sum(bad)) over () + 0.5) / (sum(sum(n)) over () + 1) as m from d group by suffix),
{_level("s", "s")},
dm as (select d.domain, d.n, d.bad, (s_k.c * s.m + s.bad) / (s_k.c + s.n) as m from d join s using (suffix), s_k),
{_level("d", "dm")},
hm as (select h.host, h.n, h.bad, (d_k.c * dm.m + dm.bad) / (d_k.c + dm.n) as m from h join dm using (domain), d_k),
{_level("h", "hm")},
p0 as (select host, (h_k.c * m + bad) / (h_k.c + n) as mean, h_k.c + n as size, mean * size as a, (1 - mean) * size as b from hm, h_k),
p1 as (select *, 1 / (2 * a - 1) as p, 1 / (2 * b - 1) as q, {(Z * Z - 3) / 6} as level, 2 / (p + q) as mid from p0),
p as (select host, case when a >= 1 and b >= 1 then a / (a + b * exp(2 * ({Z} * sqrt(mid + level) / mid - (q - p) * (level + 5 / 6 - 2 / (3 * mid))))) else mean - {Z} * sqrt(mean * (1 - mean) / (size + 1)) end as lower from p1),
r(rule, rhost, rpath, rv) as (values {", ".join(f"('{h}{p}', '{h}', '{p}', '{v}')" for h, p, v in RULES)}),
best as (
  select page_id, host, path, max_by(rule, length(rule)) as rule, max_by(rv, length(rule)) as rv
  from u join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by all)
select u.page_id, u.host, u.path, best.rule,
  coalesce(best.rv, case when lower > {MAX_BAD} then 'block' end, 'allow') as verdict
from u join p using (host) left join best on best.page_id = u.page_id and best.host = u.host and best.path = u.path"""
