"""Vector codes, importance resampling and URL filter against plain versions, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textlens.llm import resample, url_filter, vector_codes
from textlens.llm.queries import URL_RULES

VECTORS = "vec_id long, embedding array<double>, label string, code int, error string"


def plain_codes(rows, parts, entries, rounds, scale):
    """(codes, errors, codebooks) of (key, vector) rows of one length."""
    q = {k: [math.floor(scale * x) for x in v] for k, v in rows}
    w = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(q[k], p) for k in sorted(q)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(cut(v, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = defaultdict(list)
        for v in q.values():
            for p in range(parts):
                groups[p, near(v, p)[1]].append(cut(v, p))
        for (p, i), own in groups.items():
            books[p][i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = {k: [near(v, p) for p in range(parts)] for k, v in q.items()}
    return {k: "".join(f"{i:02x}" for _, i in f) for k, f in found.items()}, {k: sum(d for d, _ in f) for k, f in found.items()}, books


@pytest.mark.parametrize("levels", [3, 60, 5000])
def test_partial_distances_find_the_nearest(levels):
    rng = np.random.default_rng(levels)
    for width in (1, 2, 5, 16):
        x, book = rng.integers(-levels, levels, (3000, width)), rng.integers(-levels, levels, (40, width))
        book[7] = book[3]  # a tie
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        entry, error = vector_codes.nearest(x, book)
        assert (entry == d.argmin(1)).all() and (error == d.min(1)).all()
    big = rng.integers(-vector_codes.MOST, vector_codes.MOST, (50, 8))
    entry, error = vector_codes.nearest(big, big[:9])
    assert (error == ((big[:, None] - big[None, :9]) ** 2).sum(2).min(1)).all()


def test_codes_by_plain_rounds(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(8) * 0.02).round(3).tolist()) for i in rng.permutation(200).tolist()]
    frame = spark.createDataFrame([(k, v, "even" if k % 2 == 0 else None, 1, "x") for k, v in rows], VECTORS).repartition(5)
    out = {r["vec_id"]: r for r in vector_codes.compress(frame, entries=10, rounds=3, scale=100).collect()}
    codes, errors, books = plain_codes(rows, 4, 10, 3, 100)
    assert {k: r["code"] for k, r in out.items()} == codes and {k: r["error"] for k, r in out.items()} == errors
    sums = [sum(e for k, e in errors.items() if k % 2 == i) for i in range(2)]
    assert all(r["label_error"] == sums[k % 2] for k, r in out.items())
    assert {r["codebooks_sha256"] for r in out.values()} == {hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()}


def test_odd_vectors(spark):
    good = [0.5, -0.25, 0.0, 1.0]
    odd = [(1, None), (2, [None, 1.0, 1.0, 1.0]), (3, [math.nan, 1.0, 1.0, 1.0]), (4, [math.inf, 0.0, 0.0, 0.0]), (5, []), (6, [1.0] * 3), (7, [1.0] * 8), (8, [1e300, 0.0, 0.0, 0.0]), (9, good), (9, good), (None, [0.0] * 4), (10, good)]
    frame = spark.createDataFrame([(k, v, None, 0, "clash") for k, v in odd], VECTORS)
    out = [tuple(r[:4]) for r in vector_codes.compress(frame).collect()]
    assert sorted((k for k, *_ in out), key=str) == sorted([5, 6, 7, 8, 9, 9, None, 10], key=str)
    assert {k for k, code, *_ in out if code is None} == {5, 6, 7, 8}
    assert [e for k, _, e, _ in out if k in (9, 10, None)] == [0] * 4 and {r[3] for r in out} == {0}
    assert vector_codes.compress(frame.limit(0)).collect() == []
    assert {r["code"] for r in vector_codes.compress(frame.where("vec_id < 7")).collect()} == {None}  # none has a usable length


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_runs(text, order):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return len(w), [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def plain_resample(docs, target, percent, least, order, buckets, seed):
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    s = Counter(bucket(r) for _, t in docs for r in plain_runs(t, order)[1])
    t = Counter(bucket(r) for x in target for r in plain_runs(x, order)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for key, text in docs:
        n, runs = plain_runs(text, order)
        weight = sum(gain(bucket(r)) for r in runs)
        u = (int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        rows.append((key, n, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log(u)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0]))
    rank = {r[0]: i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return {(k, runs, weight, score, rank.get(k)) for k, _, runs, weight, score in rows}


@pytest.mark.parametrize(("order", "percent"), [(1, 10), (3, 35), (2, 100)])
def test_resampling_by_plain_counts(spark, order, percent):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(10_001, None), (10_002, ""), (10_003, "A-b_C 1é2\u00a0x\u3000y Ä\x85!" * 9), (10_004, "z " * 5000), (10_005, "..."), (10_006, docs[0][1])]
    target = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()] + [None, ""]
    frame = spark.createDataFrame([(k, t, 1, "clash") for k, t in docs], "doc_id long, text string, score int, words string").repartition(5)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    out = resample.resample(frame, items, percent, 20, order, 97, 5, keep=["doc_id", "score", "words"])
    assert out.columns == ["doc_id", "words", "n_features", "weight", "score", "rank"]
    assert {(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in out.collect()} == plain_resample(docs, target, percent, 20, order, 97, 5)


def test_tries_may_be_emptied(monkeypatch):
    monkeypatch.setattr(resample, "NODES", 5)
    monkeypatch.setattr(resample, "SLICE", 7)
    text = "one two three two one four five one two three six seven one two eightnineteneleven one"
    totals, scores = np.zeros(31, np.int64), []
    for order in (1, 2, 4):
        totals[:] = 0
        trie = resample.Trie(order, 31)
        trie.count(text.encode(), totals)
        trie.flush(totals)
        runs = plain_runs(text, order)[1]
        want = Counter(zlib.crc32(r.encode()) % 31 for r in runs)
        assert totals.tolist() == [want[b] for b in range(31)]
        gains = np.arange(31) * 3 - 40
        scores.append(resample.Trie(order, 31, gains).score(text.encode()) == (16, len(runs), sum(int(gains[zlib.crc32(r.encode()) % 31]) for r in runs)))
    assert all(scores)


def test_resampling_ties_and_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a " * 30)] * 3 + [(1, "a " * 30)] * 7, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    out = resample.resample(docs, none, percent=50).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == [1, 2, 3, 4, 5] and len(out) == 10
    assert resample.resample(docs.limit(0), none).collect() == []


def plain_judge(urls, rules):
    """Verdicts of all urls, by dictionaries."""
    width = url_filter.ORDER

    def parts(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u)
        return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")

    def rule(u):
        host, path = parts(u)
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fit, key=lambda r: len(r.host + r.path)).verdict if fit else None

    def runs(u):
        x = b"\2" * width + u.encode() + b"\3"
        return [x[i - k : i + 1] for i in range(width, len(x)) for k in range(width + 1)]

    test = lambda u: zlib.crc32(u.encode()) % url_filter.HELD_OUT == 0
    urls = [u or "" for u in urls]
    decided = [rule(u) for u in urls]
    n = {"allow": Counter(), "block": Counter()}
    for u, d in zip(urls, decided, strict=True):
        if d and not test(u):
            n[d].update(runs(u))
    seen = {d: defaultdict(Counter) for d in n}
    for d in n:
        for g, k in n[d].items():
            seen[d][len(g), g[:-1]][g] += k

    def p(d, g):
        if not g:
            return 1 / 256
        strength, total = url_filter.STRENGTH, sum(seen[d][len(g), g[:-1]].values())
        return (n[d][g] + strength * p(d, g[1:])) / (total + strength)

    known = set(n["allow"]) | set(n["block"])

    def score(u):
        x = b"\2" * width + u.encode() + b"\3"
        total = 0
        for i in range(width, len(x)):
            g = next((x[i - k : i + 1] for k in range(width, -1, -1) if x[i - k : i + 1] in known), None)
            total += math.floor(1e6 * math.log(p("allow", g) / p("block", g))) if g else 0
        return math.floor(total / (len(u.encode()) + 1))

    step, best = 1_000_000 // url_filter.BINS, None
    held = [(score(u) // step, d) for u, d in zip(urls, decided, strict=True) if d and test(u)]
    a, r = ([s for s, d in held if d == k] for k in ("allow", "block"))
    for e in range(-4000, 4001):
        good = round(sum(s >= e for s in a) / len(a) + sum(s < e for s in r) / len(r), 12)
        best = min(best or (0, 0, 0), (-good, abs(e), e))
    return [d or ("allow" if score(u) >= best[2] * step else "block") for u, d in zip(urls, decided, strict=True)]


def test_urls_by_dictionaries_and_by_join(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = [(-1, None), (-2, ""), (-3, "no scheme /es/"), (-4, "HTTP://A.ORG?x"), (-5, "http://täst.example.net/ß"), (-6, "x://org/"), (-7, "x://notorg/"), (-8, "http://a.com/de/" + "y" * 3000), (-9, "ftp://q.net/" + "de/" * 2000), (-9, "ftp://q.net/" + "de/" * 2000)]
    frame = pages.unionByName(spark.createDataFrame(odd, "page_id long, url string")).selectExpr("*", "1 AS host", "url AS r", "'x' AS verdict").repartition(3)
    out = url_filter.judge_urls(frame, URL_RULES)
    assert out.columns == ["page_id", "url", "r", "host", "path", "rule", "verdict", "score"]
    rows = out.collect()
    assert len(rows) == frame.count()
    want = plain_judge([r["url"] for r in rows], URL_RULES)
    assert [r["verdict"] for r in rows] == want
    joined = url_filter.judge_urls(frame, URL_RULES, broadcast_rows=0).collect()
    assert sorted(map(str, joined)) == sorted(map(str, rows))
    by = {r["page_id"]: r for r in rows}
    assert (by[-1]["host"], by[-1]["path"], by[-1]["rule"]) == ("", "", None) and (by[-4]["host"], by[-4]["path"], by[-4]["rule"]) == ("a.org", "", None)
    assert by[-6]["rule"] == "org/" and by[-7]["rule"] is None and by[-8]["verdict"] == "block" and by[-5]["host"] == "täst.example.net"


def test_urls_held_out(spark):
    """A language that rules block in one domain is blocked in others: what the models learn carries over."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    rules = [r for r in URL_RULES if r.host == "com"]
    out = url_filter.judge_urls(pages, rules).where("rule IS NULL AND (path LIKE '/fr/%' OR path LIKE '/de/%')").collect()
    assert len(out) > 100 and np.mean([(r["verdict"] == "allow") == r["path"].startswith("/fr/") for r in out]) > 0.95


def test_urls_of_one_class_and_none(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.net/x"), (2, "http://b.net/x")], "page_id long, url string")
    assert sorted((r["page_id"], r["verdict"], r["score"]) for r in url_filter.judge_urls(pages, URL_RULES).collect() if r["page_id"] == 2) == [(2, "allow", 0.0)] * 2
    assert url_filter.judge_urls(pages, []).where("verdict = 'allow'").count() == 3 and url_filter.judge_urls(pages.limit(0), URL_RULES).collect() == []
    kept = url_filter.keep_allowed(pages, [url_filter.Rule("block", "b.net")])
    assert kept.columns == pages.columns and [r["page_id"] for r in kept.collect()] == [1]
