"""Operators that judge each document by itself, and sharding and mixing, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from urllib.parse import urlsplit

import numpy as np
import pytest
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import functions as F

from tests.llm import odd
from vellum.llm import decision_list, language_profiles, licences, mixing, oph, piece_matching, quality_compression, queries, sharding, url_reputation
from vellum.llm.common import crc_fold, drawn

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# -- 2


def test_urls(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "no scheme", None, "x://h", "http://h?://z/q", "https://u://v/w", "ftp://Ä.org/fr/1#a?b", "://", "http://example.com/de/", "http://example.com.evil.org/de/", "http://notexample.net/en/", "http://net/", "http://a\nb.net/c", "http://sub.example.com/de", "http://u@h.example.org:80/fr/x", "http://10.0.0.1:8080/a", "http://[::1]/a", "http://long.example.net/en/" + "x/" * 200_000, "http://" + "a." * 5000 + "net/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string")
    none = spark.createDataFrame([], "host string, bad int")
    pages = pages.withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "by_rule", "by_host", "bad", "n", "domain", "suffix", "m", "mean", "lower")})
    got = {r["page_id"]: tuple(r)[1:] for r in url_reputation.judge(pages, none).collect()}
    assert url_reputation.judge(pages, none).count() == len(urls) + 1
    lower = lambda h: "".join(c.lower() if "A" <= c <= "Z" else c for c in h)
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest).group()
            path = re.match(r"[^?#]*", rest[len(host) :]).group()
            host = lower(host)
        fits = [(h + p, v) for h, p, v in url_reputation.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        assert got[i] == (host, path, rule, verdict), u
    assert url_reputation.judge(pages.limit(0), none).count() == 0
    assert urlsplit(urls[0]).hostname == got[0][0]


def test_urls_against_sql(spark):
    import duckdb

    db = duckdb.connect()
    for t in ("pages", "labels"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = sorted(db.sql(url_reputation.ORACLE).fetchall(), key=repr)
    assert sorted(map(tuple, url_reputation.op2_url_filters(spark, SF).collect()), key=repr) == want and len(want) == 250


def test_reputation(spark):
    r = random.Random(1)
    outcomes = [("bad.example.com", 1)] * 60 + [("x.example.org", int(r.random() < 0.1)) for _ in range(200)] + [(f"h{i}.d{i % 5}.net", int(r.random() < 0.05 * (i % 5))) for i in range(40) for _ in range(9)] + [(None, 1), ("x.example.org", None)]
    o = spark.createDataFrame(outcomes, "host string, bad int")
    hosts = spark.createDataFrame([("bad.example.com",), ("new.d4.net",), ("y.co.uk",), ("",)], "host string")
    got = {x["host"]: x for x in url_reputation.host_reputation(o, hosts).collect()}
    assert got["bad.example.com"]["lower"] > 0.25 > got["x.example.org"]["mean"]
    assert got["new.d4.net"]["n"] == 0 and got["bad.example.com"]["n"] == 60
    assert all(-1 < x["lower"] <= x["mean"] < 1 for x in got.values())
    raw = sum(b for h, b in outcomes if h == "x.example.org" and b is not None) / 200
    assert abs(got["x.example.org"]["mean"] - raw) < 0.1
    d = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("net",), ("",)], "h string")
    assert [tuple(x) for x in d.select(url_reputation.domain_of(F.col("h")), url_reputation.suffix_of(F.col("h"))).collect()] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("net", "net"), ("", "")]
    d = spark.createDataFrame([("u@a.b.com:80",), ("10.0.0.1:8080",), ("[::1]:80",), ("x.y.z.museum",)], "h string")
    assert [tuple(x) for x in d.select(url_reputation.domain_of(F.col("h"), ("z.museum",)), url_reputation.suffix_of(F.col("h"), ("z.museum",))).collect()] == [("b.com", "com"), ("10.0.0.1", ""), ("[::1]", ""), ("y.z.museum", "z.museum")]


def test_lower_bound_is_the_beta_quantile(spark):
    def below(x, a, b, n=20000):
        scale, h = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b), x / n
        return h * sum(math.exp(scale + (a - 1) * math.log((i + 0.5) * h) + (b - 1) * math.log(1 - (i + 0.5) * h)) for i in range(n))

    shapes = [(3.0, 7.0), (10.0, 30.0), (50.0, 50.0), (2.0, 1.5), (1.0, 9.0)]
    d = spark.createDataFrame([(a / (a + b), a + b) for a, b in shapes] + [(0.25, 2.0), (0.5, 1.0), (0.9, 0.2)], "mean double, size double")
    got = [r[0] for r in d.select(url_reputation.lower_bound(F.col("mean"), F.col("size"))).collect()]
    assert all(abs(below(x, a, b) - 0.05) < 0.012 for x, (a, b) in zip(got, shapes))
    assert all(x < 0.9 for x in got[len(shapes) :])


def test_pages_are_read_once_for_the_counts_and_once_for_the_result(spark):
    plan = url_reputation.op2_url_filters(spark, SF)._jdf.queryExecution().toString()
    assert plan.split("Physical Plan")[1].count("pages.parquet") == 1 and "Python" not in plan


# -- 3


def test_quality(spark):
    got = {r["doc_id"]: r for r in quality_compression.op3_quality_classifier(spark, SF).collect()}
    labels = table(spark, "labels").collect()
    held = [(got[x["doc_id"]]["score"], x["quality"]) for x in labels if got[x["doc_id"]]["held_out"]]
    assert sum((s >= 0.5) == q for s, q in held) / len(held) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())


def test_scores_against_plain_compression(spark):
    docs = table(spark, "documents").limit(80)
    labels = table(spark, "labels").where(crc_fold(F.col("doc_id")) != 1)
    model = quality_compression.train(table(spark, "documents"), labels)
    assert model.trained and len(model.weights) == 2 and model.weights[0] > 0
    by = [zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False, write_dict_id=False) for x in (model.good, model.bad)]
    for r in quality_compression.score_documents(docs, model).join(docs, "doc_id").collect():
        raw = r["text"].encode()
        chunks = [raw[i : i + model.chunk] for i in range(0, len(raw), model.chunk)]
        good, bad = (1 + sum(len(c.compress(x)) - 4 for x in chunks) for c in by)
        z = model.weights[0] * 10 * (bad - good) / (bad + good) + model.weights[1]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-12)


def test_the_sample_is_bounded_before_it_is_shuffled(spark):
    rows = spark.range(0, 30000, 1, 20).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(1).alias("y"))
    got = drawn(rows, "y", "doc_id", 1500, {0: 10000, 1: 20000})
    both = {0: [], 1: []}
    for r in rows.select("doc_id", "y", F.xxhash64("doc_id").alias("h")).collect():
        both[r["y"]].append((r["h"] % (1 << 64), r["doc_id"]))
    ids = {r["doc_id"] for r in got.collect()}
    assert len(ids) == 3000
    low = {y: {i for _, i in sorted(v)[:1800]} for y, v in both.items()}
    assert all(ids & {i for _, i in both[y]} <= low[y] for y in both)
    moved = rows.count() - 2 * 1500  # what lies above the bound is left out before the window's shuffle
    text = got._jdf.queryExecution().executedPlan().toString()
    assert moved > 0 and text.index("Exchange") < text.index("shiftrightunsigned")


def test_curve_of_separable_classes():
    r = np.random.RandomState(0)
    for n, gap in ((40, 1.0), (1500, 0.2), (1500, 0.0)):
        d = np.concatenate([r.normal(gap, 0.05, n), r.normal(-gap, 0.05, n)])
        x = np.array([quality_compression._terms(v) for v in d])
        y = np.repeat([1.0, 0.0], n)
        w = quality_compression._fit(x, y)
        p = 1 / (1 + np.exp(-x @ w))
        assert np.abs(w).max() < 1000 and ((p >= 0.5) == y).mean() >= (0.99 if gap else 0.45)


def test_quality_of_odd_documents(spark):
    docs = odd.frame(spark)
    assert quality_compression.train(docs, spark.createDataFrame([(3, 1)], "doc_id long, quality int")) is None
    assert {r["score"] for r in quality_compression.score_documents(docs, None).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 60)] + [(None, 1), (11, None)], "doc_id long, quality int")
    model = quality_compression.train(docs, labels)
    scores = quality_compression.score_documents(docs, model).collect()
    assert len(scores) == len(odd.rows()) and all(0 <= r["score"] <= 1 for r in scores)
    blank = {round(r["score"], 12) for r in scores if r["doc_id"] in (0, 1)}
    assert len(blank) == 1
    assert quality_compression.with_score(docs, model, "q").columns == [*docs.columns, "q"]
    assert quality_compression.score_documents(odd.empty(spark), model).count() == 0
    assert quality_compression.train(odd.empty(spark), labels) is None


# -- 4


def brute_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {p + k for v in at.values() if len(v) > 1 for p in v for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_rules(spark):
    r = random.Random(2)
    data = odd.rows() + [(1000 + i, "".join(r.choice(["a ", "b ", "c ", "\n", "\x0b", " ", "d|", "é "]) for _ in range(r.randint(0, 200))), "en", "s", 1) for i in range(150)]
    data.append((2000, "x y " * 40 + "\nz\nz\n \nz", "en", "s", 1))
    got = decision_list.judge(odd.frame(spark, data), []).collect()
    want = []
    for d in data:
        b = brute_base(d[1])
        failed = b[0] < 20 or 100 * b[4] > 30 * b[0]
        want.append((d[0], *b, failed, not failed))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert decision_list.judge(odd.empty(spark), []).count() == 0


def test_decision_list(spark):
    r = np.random.RandomState(0)
    x = {f: r.rand(900) for f in decision_list.FEATURES}
    bad = (x["symbol_share"] > 0.8) | ((x["upper_share"] > 0.6) & (x["distinct_share"] < 0.4))
    rules = decision_list.learn(x, bad, np.ones(900))
    covered = np.zeros(900, bool)
    for rule in rules:
        covered |= decision_list._covers(rule, x, 900)
    assert rules and (covered == bad).mean() > 0.95
    frame = spark.createDataFrame([tuple(float(x[f][i]) for f in decision_list.FEATURES) for i in range(100)], ", ".join(f"{f} double" for f in decision_list.FEATURES))
    assert [not v[0] for v in frame.select(decision_list.verdict(rules)).collect()] == covered[:100].tolist()
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert decision_list.train(odd.frame(spark), labels) == []
    got = {v["doc_id"]: v["kept"] for v in decision_list.op4_quality_rules(spark, SF).collect()}
    marks = [(got[v["doc_id"]], v["quality"]) for v in table(spark, "labels").collect()]
    assert np.mean([k for k, q in marks if q == 1]) > 0.93 > 0.2 > np.mean([k for k, q in marks if q == 0])


# -- 5


def brute_profile(texts, top):
    counts = {}
    for w in re.findall(r"[^\W\d_]+", "\n".join(texts).lower()):
        padded = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g != " ":
                    counts[g] = counts.get(g, 0) + 1
    pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], pack(g)))[:top]


def test_distance_against_brute_force():
    r = random.Random(6)
    by = {"a": [odd.words(r, 400) for _ in range(3)], "b": ["".join(r.choice("zxwvkq ué") for _ in range(3000))]}
    profiles = language_profiles.build(by)
    top = language_profiles.TOP
    lists = {k: {g: i for i, g in enumerate(brute_profile(v, top))} for k, v in by.items()}
    for t in [odd.words(r, 50), "Zxw vkq, xz! é", "A1b"]:
        own = brute_profile([t], top)
        d = {k: sum(abs(p[g] - i) if g in p else top for i, g in enumerate(own)) / (top * len(own)) for k, p in lists.items()}
        best = min(sorted(d), key=d.get)
        assert profiles.identify(t) == (best, pytest.approx(1 - d[best]))
    assert [profiles.identify(t) for t in (None, "", "12 !?")] == [("und", 0.0)] * 3


def test_language(spark):
    got = {r["doc_id"]: r for r in language_profiles.op5_language_id(spark, SF).collect()}
    held = [got[d["doc_id"]]["lang_pred"] == d["lang"] for d in table(spark, "documents").collect() if got[d["doc_id"]]["held_out"]]
    assert sum(held) / len(held) > 0.98
    docs = odd.frame(spark)
    profiles = language_profiles.train(docs)
    assert set(profiles.languages) == {"en", "de"}
    out = language_profiles.with_language(docs, profiles)
    assert {r["lang_pred"] for r in out.collect() if r["doc_id"] in (0, 1, 2, 9)} == {"und"}
    assert out.count() == docs.count() and set(docs.columns) < set(out.columns)
    clash = docs.withColumns({"__found": F.lit(7), "found": F.lit(8), "id": F.lit("i"), "h": F.lit("h")})
    assert {r["__found"] for r in language_profiles.with_language(clash, language_profiles.train(clash)).collect()} == {7}
    assert language_profiles.train(docs, most_bytes=3).languages == language_profiles.train(docs.where("length(text) <= 3")).languages
    nothing = language_profiles.train(odd.empty(spark))
    assert language_profiles.with_language(docs, nothing).where("lang_pred <> 'und'").count() == 0
    assert language_profiles.with_language(odd.empty(spark), profiles).count() == 0


# -- 6


@pytest.fixture(scope="module")
def pieces():
    return piece_matching.Pieces.load()


def test_pieces_like_the_library(spark, pieces):
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_matching.MODEL)
    r = random.Random(3)
    texts = [d[1] for d in odd.rows()] + ["▁x", "<s> <0x0A> </s>", "\0\x01", "a" * 9000, "  lead", "x\n\n\ty", "=" * 300, "abcdefghij" * 500, "😀 é 日本"]
    texts += ["".join(r.choice("abcdetion  \n▁thé中1.") for _ in range(r.randint(1, 400))) for _ in range(150)]
    texts += [d["text"] for d in table(spark, "documents").limit(60).collect()]
    got = {x["doc_id"]: x for x in piece_matching.encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pieces).collect()}
    for i, t in enumerate(texts):
        want = lib.encode(t or "")
        assert list(got[i]["ids"]) == want and got[i]["n_tokens"] == len(want)
        assert got[i]["round_trip"] == ("▁" not in (t or ""))
    matcher = piece_matching.Matcher(pieces)
    for t in texts[:80]:
        assert matcher.decode(lib.encode(t or "")) == lib.decode(lib.encode(t or ""))
    back = {x["doc_id"]: x["text"] for x in piece_matching.decode_documents(spark.createDataFrame([(i, x["ids"]) for i, x in got.items()] + [(-1, None)], "doc_id long, ids array<int>"), pieces).collect()}
    assert back[-1] == "" and all(back[i] == (t or "") for i, t in enumerate(texts) if "▁" not in (t or ""))
    assert piece_matching.encode_documents(odd.empty(spark), pieces).count() == 0
    assert piece_matching.encode_documents(odd.frame(spark), pieces).count() == len(odd.rows())


# -- 7


def brute_scan(m, text):
    """The same, unit by unit, with dictionaries and without running sums."""
    tokens, lines, at = [], [], 0
    for line in text.split("\n"):
        own = [(x.group().lower(), at + x.start(), at + x.end()) for x in licences._WORD.finditer(line)]
        lines.append((bool(line.strip()), len(tokens), len(tokens) + len(own)))
        tokens += own
        at += len(line) + 1
    parts, run = [], []
    for full, a, b in [*lines, (False, 0, 0)]:
        if full:
            run.append((a, b))
        elif run:
            parts.append(run)
            run = []
    units = []
    for run in parts:
        p, q = run[0][0], run[-1][1]
        units += [(a, b, p) for a, b in run if b > a]
        for size in (20, 60):
            if q - p > size or (size == 60 and len(run) > 1 and q > p):
                units += [(a, min(a + size, q), p) for a in range(p, p + max(1, q - p - size // 2), size // 2)]
    found = []
    for a, b, p in units:
        ws = [t[0] for t in tokens[a:b]]
        z = m.rest[0] * (sum(w not in m.words for w in ws) / len(ws)) + m.rest[1]
        for w in ws:
            z = z + m.single[m.words.get(w, 0)] * 2 / math.sqrt(len(ws))
        for u, v in zip(ws, ws[1:]):
            z = z + m.double[m.pair_of[m.words.get(u, 0), m.words.get(v, 0)]] * 2 / math.sqrt(len(ws))
        e = np.exp(z / m.temperature - max(z / m.temperature))
        chance = e / e.sum()
        k = int(np.argmax(chance[:-1]))
        if chance[k] < 0.5:
            continue
        best = (0, 0, 0)
        for family, wanted in m.templates:
            if family != m.families[k]:
                continue
            hits = [i for i in range(len(ws) - 1) if (ws[i], ws[i + 1]) in wanted]
            for x in range(len(hits)):
                if x and hits[x] - hits[x - 1] <= 6:
                    continue
                y = x
                while y + 1 < len(hits) and hits[y + 1] - hits[y] <= 6:
                    y += 1
                run = hits[x : y + 1]
                every = {(ws[i], ws[i + 1]) for i in run}
                stretch = min((run[v] - run[u], u, v) for u in range(len(run)) for v in range(u, len(run)) if {(ws[i], ws[i + 1]) for i in run[u : v + 1]} == every)
                best = max(best, (len(every) / len(wanted), run[stretch[1]], run[stretch[2]] + 2), key=lambda v: v[0])
        x, y = a + best[1], a + best[2]
        if best[0] >= 0.7 and not {t[0] for t in tokens[max(p, x - 4) : x]} & licences.NEGATIONS:
            found.append((-best[0], -chance[k], tokens[x][1], tokens[y - 1][2], m.families[k]))
    taken = []
    for f in sorted(found):
        if all(f[3] <= t[2] or f[2] >= t[3] for t in taken):
            taken.append(f)
    return sorted((f[2], f[3], f[4], pytest.approx(-f[1], abs=1e-9), -f[0]) for f in sorted(taken, key=lambda f: f[2]))


def wrapped(text, n):
    ws = text.split(" ")
    return "\n".join(" ".join(ws[i : i + n]) for i in range(0, len(ws), n))


def test_licences_against_brute_force(spark):
    m, r = licences.trained(), random.Random(4)
    notices = [t.format(year=2001, holder="Lake Press", version="3.0") for ts in licences.TEMPLATES.values() for t in ts]
    texts = ["", " \n\t\n", "İİİİ\nLicensed under the MIT License.", "a\n \nb"]
    for _ in range(50):
        part = []
        for _ in range(r.randint(1, 6)):
            part.append(r.choice([odd.words(r, r.randint(1, 90)), wrapped(r.choice(notices), r.randint(3, 12)), r.choice(licences.OTHERS), "not " + r.choice(notices), "", r.choice(notices) + " " + odd.words(r, 30)]))
        texts.append("\n".join(part))
    texts += [d["text"] for d in table(spark, "documents").limit(40).collect()]
    got = m.scan_all(texts)
    assert [[(a, b, f, p, o) for a, b, f, p, o in x] for x in got] == [brute_scan(m, t) for t in texts]
    assert sum(map(len, got)) > 40 and got[2][0][:3] == (5, 35, "MIT")


def test_licences(spark):
    m = licences.trained()
    for text, family in [("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), ("This work is licensed under the GNU General Public License, version 3.", "GPL"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Released under the MIT License.", "MIT"), ("All rights reserved.", "proprietary"), ("Copyright (c) 2019 Lake Press. All Rights Reserved.", "proprietary"), ("licensed under cc by-sa 3.0", "CC-BY-SA"), ("Licensed under the ISC License.", "ISC"), ("Licensed under the Eclipse Public License, version 2.0.", "EPL-2.0"), ("Licensed under the Unlicense.", "Unlicense")]:
        for whole in (f"Some prose first.\n{text}\nand after it", f"Prose.\n\n{wrapped(text, 3)}\n\nMore.", " ".join(["prose"] * 70) + " " + text + " " + " ".join(["prose"] * 70)):
            (start, stop, found, chance, share), = m.scan(whole)
            assert found == family and whole[start:stop].replace("\n", " ") in text and 0.5 <= chance <= 1 and share >= 0.7
    for f, ts in licences.TEMPLATES.items():  # every notice, wrapped as in a file's head
        for t in ts:
            filled = t.format(year=1999, holder="North", version="3.0")
            assert [x[2] for x in m.scan("Head line\n\n" + wrapped(filled, 9) + "\n\nfoot")] == [f], t
    for text in [None, "", "She asked for permission to leave.", "He lost his driving license.", "the general public and their rights", "licen " * 500, "This is not released under the MIT license.", "Never licensed under the GPL version 2 or later", "Licensed under the Boost Software License, Version 1.0.", "Use of this software is governed by the Business Source License.", "Released under the Foo License."]:
        assert m.scan(text) == []
    docs = table(spark, "documents")
    pattern = "Licensed under CC BY-NC|GNU General Public License, version 3|Apache License, Version 2.0|MIT License|All rights reserved"
    want = {d["doc_id"]: sum(bool(re.search(pattern, x)) for x in d["text"].split("\n")) for d in docs.collect()}
    got = {d["doc_id"]: d["n_notices"] for d in licences.op7_licence_scans(spark, SF).collect()}
    assert got == want and sum(want.values()) > 5
    many = "Licensed under the MIT License.\n" * 20_000  # a long text with a notice in every line
    assert len(m.scan(many)) == 20_000
    docs = odd.frame(spark).withColumns({"start": F.lit(1), "end": F.lit(2), "family": F.lit("x"), "probability": F.lit(3)})
    out = licences.with_licences(docs, m)
    assert out.columns == [*docs.columns, "licences"] and out.count() == len(odd.rows()) and {(r["family"], r["start"]) for r in out.collect()} == {("x", 1)}
    assert licences.with_licences(odd.empty(spark), m).count() == 0


# -- 8


def test_raking():
    r = random.Random(8)
    tokens = {(s, l, t): float(r.randint(1, 500)) for s in "ab*" for l in "xy" for t in "pq"}
    targets = mixing.Targets({"a": 0.4, "b": 0.3, "*": 0.3}, {"x": 0.5, "y": 0.5}, {"p": 0.6, "q": 0.4}, fraction=0.2)
    fit = mixing.calibrate(tokens, targets)
    p, total = fit.probability, sum(tokens.values())
    assert fit.settled and fit.gap < 1e-8 and sum(tokens[c] * p[c] for c in tokens) == pytest.approx(0.2 * total)
    odds = lambda m: m["a", "x", "p"] * m["b", "y", "p"] / m["a", "y", "p"] / m["b", "x", "p"]
    if max(p.values()) < 1:
        assert odds(p) == pytest.approx(1, rel=1e-5)  # raking keeps interactions: probabilities are products of factors
    full = mixing.calibrate(tokens, mixing.Targets(targets.source, targets.lang, targets.topic, fraction=0.9))
    assert max(full.probability.values()) <= 1 and full.gap > 0.001  # more than some cells have: what is missed is reported
    assert {(d, k): pytest.approx(v, abs=1e-6) for d, k, v, _ in fit.margins} == {("source", "a"): 0.4, ("source", "b"): 0.3, ("source", "*"): 0.3, ("lang", "x"): 0.5, ("lang", "y"): 0.5, ("topic", "p"): 0.6, ("topic", "q"): 0.4}
    nothing = mixing.calibrate({}, targets)
    assert nothing.probability == {} and nothing.gap == 0 and mixing.calibrate({("a", "x", "p"): 0.0}, targets).probability == {("a", "x", "p"): 0.0}


def test_full_cells_are_made_up_for_by_others():
    tokens = {("a", "x", "p"): 10.0, ("a", "y", "p"): 1000.0, ("b", "x", "p"): 1000.0, ("b", "y", "p"): 1000.0}
    targets = mixing.Targets({"a": 0.4, "b": 0.6}, {"x": 0.55, "y": 0.45}, {"p": 1.0}, fraction=0.3)
    fit = mixing.calibrate(tokens, targets)
    assert fit.probability["a", "x", "p"] <= 1 and fit.gap < 1e-8


def brute_fit(tokens, targets):
    """Cyclic coordinate search for the factors of categories: a cell's probability is their product, at most 1."""
    names = [sorted({c[d] for c in tokens}) for d in range(3)]
    want = []
    for d, wanted in enumerate((targets.source, targets.lang, targets.topic)):
        share = {k: wanted.get(k, 0.0) for k in names[d]}
        want.append({k: v / sum(share.values()) * targets.fraction * sum(tokens.values()) for k, v in share.items()})
    value = {c: t * targets.fraction for c, t in tokens.items()}
    for _ in range(400):
        for d in range(3):
            for k in names[d]:
                own = [c for c in tokens if c[d] == k]
                low, high = 0.0, 1e9
                for _ in range(200):  # the factor at which the capped cells sum to the goal
                    mid = (low + high) / 2
                    low, high = (mid, high) if sum(min(tokens[c], value[c] * mid) for c in own) < want[d][k] else (low, mid)
                for c in own:
                    value[c] = min(tokens[c], value[c] * high)
    return {c: v / tokens[c] for c, v in value.items()}


def test_mixing(spark):
    out = mixing.op8_mixing(spark, SF).collect()
    total = sum(r["n_tokens"] for r in out)
    assert sum(r["n_tokens"] * r["probability"] for r in out) == pytest.approx(0.5 * total, rel=1e-6)
    docs = {d["doc_id"]: d for d in table(spark, "documents").collect()}
    tokens, cell = {}, {}
    for i, d in docs.items():
        t = d["text"]
        topic = "tabular" if " | " in t else "emphatic" if "!!" in t else "marked" if any(x in t for x in ("###", "$$$", "%%%")) else "prose"
        cell[i] = (d["source"], d["lang"], topic)
        tokens[cell[i]] = tokens.get(cell[i], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want = brute_fit({c: float(n) for c, n in tokens.items() if n}, mixing.PRODUCTION)
    chance = spark.createDataFrame([(i,) for i in docs], "doc_id long").select("doc_id", mixing._uniform(F.col("doc_id"), mixing.PRODUCTION.seed).alias("u"))
    drawn_ = {r["doc_id"]: r["u"] for r in chance.collect()}
    for r in out:
        assert (r["source"], r["lang"], r["topic"]) == cell[r["doc_id"]] and r["probability"] == pytest.approx(want[cell[r["doc_id"]]], abs=1e-4)
        assert r["taken"] == (drawn_[r["doc_id"]] < r["probability"])
    assert out[0]["margin_gap"] < 1e-6
    taken = sum(r["n_tokens"] for r in out if r["taken"])
    assert abs(taken / total - 0.5) < 0.05
    english = sum(r["n_tokens"] for r in out if r["taken"] and r["lang"] == "en") / taken
    assert abs(english - 0.5) < 0.06
    odd_docs = odd.frame(spark)
    some = mixing.sample(odd_docs)
    assert some.columns == odd_docs.columns and some.count() <= odd_docs.count()
    assert mixing.sample(odd.empty(spark)).count() == 0
    assert mixing.with_probabilities(odd_docs).count() == odd_docs.count()
    topics = mixing.Targets({"*": 1.0}, {"*": 1.0}, {"x": 0.5, "y": 0.5})  # a topic column of the user's own
    assert {r["__vellum_topic"] for r in mixing.with_probabilities(odd_docs, topics, topic=F.col("label")).collect()} <= {"x", "y", "*"}


# -- 9


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding(spark, shards):
    data = odd.rows(n=400)
    out = sharding.shard_by_bytes(odd.frame(spark, data), shards).collect()
    assert len(out) == len(data)
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in out) == sorted((d[0] or -1, size(d[1]), zlib.crc32((d[1] or "").encode())) for d in data)
    assert len({(r["shard"], r["slot"]) for r in out}) == len(out)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    where = {}
    for r in out:
        where.setdefault(r["text_hash"], set()).add(r["shard"])
    assert all(len(v) == 1 for v in where.values())  # copies stay together
    groups = {}
    for r in out:
        groups[r["text_hash"]] = groups.get(r["text_hash"], 0) + r["size"]
    total = sum(r["size"] for r in out)
    assert all(abs(sum(r["size"] for r in by.get(k, [])) - total / shards) <= max(groups.values()) for k in range(shards))
    assert sharding.shard_by_bytes(odd.empty(spark), shards).count() == 0


@pytest.mark.parametrize("name", ["op1_simhash_near_dedup", "op9_sharding"])
def test_queries_against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    db.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = db.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


# -- 10


def brute_print(text):
    """One permutation, optimal densification, packed digits: in whole numbers, bin by bin."""
    low = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & low
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & low
        return x ^ (x >> 31)

    step = 0x9E3779B97F4A7C15
    ws = [xxhash.xxh3_64_intdigest(w) for w in text.encode().lower().split()]
    if not ws:
        return "empty"
    least = [None] * 512
    for i in range(max(1, len(ws) - 4)):
        h = min(5, len(ws))
        for j, w in enumerate(ws[i : i + 5]):
            h = mix((h + w * step + j) & low)
        b, v = h >> 55, h & ((1 << 48) - 1)
        least[b] = v if least[b] is None else min(least[b], v)
    out = []
    for i in range(512):
        t, at = 0, i
        while least[at] is None:
            at = mix((i + t * 512 + 1) * step & low) % 512
            t += 1
        out.append(f"{mix((least[at] + (i + 1) * step) & low) & 15:x}")
    return "".join(out)


def test_bins_against_brute_force():
    r = random.Random(3)
    for t in ["", " ", "one", "ONE", "a b c", *(odd.words(r, n) for n in (4, 5, 6, 30, 200, 3000)), "é ß " * 40]:
        assert oph.fingerprint(t.encode()) == brute_print(t)


def test_fingerprints_against_brute_force(spark):
    docs = odd.frame(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
    want = []
    for r, n in zip(rows, [*rows[1:], rows[0]]):
        t, half = r["t"], len(r["t"]) // 2
        e = t[: len(t) - half] + n["t"][:half]
        a, b, c = (oph.fingerprint(x.encode()) for x in (t, e, n["t"]))
        want.append((r["doc_id"], len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, oph.likeness(a, b), oph.likeness(a, c)))
    assert sorted(map(tuple, oph.neighbour_fingerprints(docs).collect()), key=repr) == sorted(want, key=repr)
    assert oph.neighbour_fingerprints(odd.empty(spark)).count() == 0
    assert oph.neighbour_fingerprints(odd.frame(spark, odd.rows()[10:11])).collect()[0]["near_next"] == 1.0


def test_likeness_is_unbiased():
    r = random.Random(1)
    errors = []
    for _ in range(150):
        w = odd.words(r, r.choice([3, 8, 60, 700])).split()
        v = list(w)
        for _ in range(r.randint(0, len(v) // 3)):
            v[r.randrange(len(v))] = odd.words(r, 1)
        s = lambda x: {tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))}
        errors.append(oph.likeness(*(oph.fingerprint(" ".join(x).encode()) for x in (w, v))) - len(s(w) & s(v)) / len(s(w) | s(v)))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04
    assert oph.likeness(oph.EMPTY, oph.EMPTY) == 1.0 and oph.likeness(oph.EMPTY, oph.fingerprint(b"x")) == 0.0
