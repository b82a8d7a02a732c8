"""Quality rules and URL reputation: DuckDB on the tables, the binomial bound and edge rows."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwise.llm import quality_rules as Q
from keepwise.llm import queries
from keepwise.llm import url_reputation as U
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.conftest import LABELS
from tests.oracle_compare import compare, duck


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID, "/root/testdata/sf0.1"])
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_duckdb(spark, name, sf):
    r = compare(spark, duck(sf), name, queries.QUERIES[name], queries.ORACLE[name], sf)
    assert r["ok"], r


@pytest.mark.parametrize("n,k,p", [(1, 0, 0.1), (50, 3, 0.1), (1000, 1, 0.004), (5000, 12, 0.004), (200_000, 700, 0.004), (1322, 0, 0.004)])
def test_binomial_tail(spark, n, k, p):
    got = spark.range(1).select(Q.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
    lg = math.lgamma
    want = sum(math.exp(lg(n + 1) - lg(i + 1) - lg(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    assert got == pytest.approx(want, rel=1e-6)


def test_no_cutoff_beyond_the_expected_count(spark):
    assert spark.range(1).select(Q.binomial_tail(F.lit(5), F.lit(10), 0.1)).first()[0] == 1.0


def test_cutoffs_follow_the_labels_of_each_stratum(spark, make_docs):
    clean = "plain words of ordinary prose here " * 20
    noisy = "## mark ## words # of # noise # here " * 20
    rows = [(i, clean, "en", "s") for i in range(1600)] + [(5000 + i, noisy, "en", "s") for i in range(20)]
    rows += [(10_000 + i, clean, "fr", "s") for i in range(50)] + [(20_000, noisy, "fr", "s"), (30_000, noisy, None, "s")]
    # all windows differ or the base check would fail them
    rows = [(i, " ".join(f"{w}{k}" if w.isalpha() else w for k, w in enumerate(t.split())), lang, s) for i, t, lang, s in rows]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, lang, _ in rows if lang != "fr" and i < 5000]
                                   + [(5000, 0, 0), (5001, 0, 0), (7, 1, 0), (8, None, 0), (None, 1, 0)], LABELS)
    out = {r.doc_id: r for r in Q.quality_rules(make_docs(rows), labels).collect()}
    assert all(out[i].kept for i in range(1600)) and not any(out[5000 + i].kept for i in range(20))
    assert "symbols" in out[5000].rejected_by
    assert out[20_000].kept and out[30_000].kept      # strata without enough labels keep what the base check keeps


def test_odd_documents(spark, make_docs):
    rows = [(1, None, "en", "s"), (2, "", None, "s"), (3, " \n\t ", "en", "s"), (4, "a b a b a b " * 30, "en", "s"),
            (None, "l\nl\n\n \nl", "en", None), (5, "x " * 60_000, "en", "s"), (6, "a b c a b", "en", "s"), (7, "a b c d a b c", "en", "s")]
    docs = make_docs(rows).selectExpr("*", "doc_id AS stratum", "text AS w", "text AS t", "lang AS quality")
    out = {r.doc_id: r for r in Q.quality_rules(docs, spark.createDataFrame([], LABELS)).collect()}
    assert len(out) == len(rows) and not any(r.kept for r in out.values())
    assert (out[1].n_words, out[2].word_chars, out[3].n_dup_lines, out[4].n_repeat_words) == (0, 0, 0, 180)
    assert out[None].n_dup_lines == 2 and out[5].n_repeat_words == 60_000
    assert out[6].n_repeat_words == 0 and out[7].n_repeat_words == 6
    left = Q.kept_documents(docs, spark.createDataFrame([], LABELS))
    assert left.columns == docs.columns and left.count() == 0
    assert Q.quality_rules(make_docs([]), spark.createDataFrame([], LABELS)).count() == 0


PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("host", T.StringType())])


def test_rules_and_hosts(spark):
    urls = {1: ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
            2: ("https://example.net/de/", "example.net", "/de/", "net/", "block"), 3: ("x://net", "net", "", None, "allow"),
            4: ("http://fr.example.com/de/1", "fr.example.com", "/de/1", "example.com/de/", "block"),
            5: ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"), 6: (None, "", "", None, "allow"),
            7: ("no scheme", "", "", None, "allow"), 8: ("http://b.org/fr/?x", "b.org", "/fr/", "org/fr/", "allow"),
            9: ("http://h?x/y", "h", "", None, "allow"), 10: ("a://b://c/d", "b:", "//c/d", None, "allow"),
            11: ("http://ÉX.org/fr", "Éx.org", "/fr", None, "allow")}
    pages = spark.createDataFrame([(i, v[0], "clash") for i, v in urls.items()] + [(1, urls[1][0], "clash")], PAGES)
    out = U.url_filter(pages, spark.createDataFrame([], LABELS)).collect()
    assert len(out) == len(urls) + 1
    for r in out:
        assert (r.host, r.path, r.rule, r.verdict) == urls[r.page_id][1:], r
    assert U.url_filter(spark.createDataFrame([], PAGES), spark.createDataFrame([], LABELS)).count() == 0


def test_reputation_needs_evidence(spark):
    rows = [(i, "http://bad.one.com/x", None) for i in range(60)] + [(100 + i, f"http://h{i % 20}.two.com/x", None) for i in range(200)]
    rows += [(400, "http://new.one.com/x", None), (401, "http://single.three.com/x", None)]
    labels = spark.createDataFrame([(i, int(i >= 100), 0) for i in range(300)] + [(401, 0, 0), (0, 1, 0), (1, None, 0)], LABELS)
    out = {r.page_id: r.verdict for r in U.url_filter(spark.createDataFrame(rows, PAGES), labels).collect()}
    assert all(out[i] == "block" for i in range(60)) and all(out[100 + i] == "allow" for i in range(200))
    assert out[401] == "allow"      # one bad page is not enough


def plain_blocked(rows, labels, max_bad=U.MAX_BAD, risk=U.RISK):
    """The reputation in plain Python, its beta probability by numeric integration."""
    import re
    from collections import defaultdict

    outcome = {}
    for i, q, _ in labels:
        if q is not None and i is not None:
            outcome[i] = min(q, outcome.get(i, 1))
    counts = defaultdict(lambda: [0, 0])
    tree = {}
    for i, url, _ in rows:
        host = re.split(r"[/?#]", url.split("://", 1)[1])[0].lower()
        host = re.sub(r"\.$", "", re.sub(r":[0-9]*$", "", host))
        w = host.split(".")
        two = len(w) > 2 and len(w[-1]) == 2 and w[-2] in U.SECOND_LEVELS
        key = (host,) * 3 if re.fullmatch(r"[0-9.]+", host) else (".".join(w[-1 - two:]), ".".join(w[-2 - two:]), host)
        tree[host] = key
        for depth in range(4):
            c = counts[key[:depth]]
            if i in outcome:
                c[0] += 1
                c[1] += 1 - outcome[i]
    mean, k = {(): 0.5}, 1.0
    for depth in (1, 2, 3):
        groups = {key[:depth] for key in tree.values()}
        for g in groups:
            (n, x), (nu, xu) = counts[g], counts[g[:-1]]
            mean[g] = (mean[g[:-1]] * k + xu - x) / (k + nu - n)
        seen = [(counts[g], mean[g]) for g in groups if counts[g][0]]
        s, v, nv = (sum(f(n, x, m) for (n, x), m in seen) for f in (
            lambda n, x, m: (x - n * m) ** 2 / n, lambda n, x, m: m * (1 - m), lambda n, x, m: n * m * (1 - m)))
        rho = (s - v) / (nv - v) if nv > v else 0
        k = 100.0 if not nv else max((1 - rho) / rho, U.MIN_STRENGTH) if rho > 1e-4 else 9999.0
    out = set()
    for host, key in tree.items():
        (n, x), m = counts[key], mean[key]
        a, b = m * k + x, (1 - m) * k + n - x
        lg = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        # substituting t = u^(1/a) takes the pole at zero away
        steps = 20_000
        top = max_bad ** a
        mass = sum(math.exp(lg + (b - 1) * math.log1p(-(((j + 0.5) / steps * top) ** (1 / a)))) / a for j in range(steps)) * top / steps
        if counts[key[:2]][0] and mass <= risk:
            out.add(host)
    return out


def test_reputation_against_plain_python(spark):
    hosts = ([("bad.one.com", 60, 0.95), ("alsobad.one.com", 12, 0.9), ("x.shop.co.uk", 30, 0.9), ("y.shop.co.uk", 4, 1.0), ("fine.co.uk", 50, 0.1),
              ("10.1.2.3", 25, 1.0), ("10.9.2.3", 25, 0.0), ("edge.org:8080", 40, 0.5), ("edge2.org.", 40, 0.3), ("one.page.info", 1, 1.0)]
             + [(f"h{j}.good{j % 7}.com", 10 + j, 0.05) for j in range(30)])
    rows, labels, at = [], [], 0
    for host, n, bad in hosts:
        for j in range(n):
            rows.append((at, f"http://{host}/p{j}", None))
            labels.append((at, int(j >= n * bad), 0))
            at += 1
    rows += [(at, "http://new.one.com/", None), (at + 1, "http://never.seen.se/", None)]
    pages = spark.createDataFrame(rows, PAGES)
    out = U.url_filter(pages, spark.createDataFrame(labels, LABELS), rules=[]).collect()
    got = {r.host for r in out if r.verdict == "block"}
    want = plain_blocked(rows, labels)
    clean = {h: h.rstrip(".").split(":")[0] for h in {r.host for r in out}}
    assert {clean[h] for h in got} == want
    assert {"bad.one.com", "alsobad.one.com", "x.shop.co.uk", "10.1.2.3"} <= got
    assert not got & {"10.9.2.3", "fine.co.uk", "edge2.org.", "one.page.info", "never.seen.se"} and not any("good" in h for h in got)
    # without labels nothing is judged; a host outside every labelled domain is not either
    none = U.url_filter(pages, spark.createDataFrame([], LABELS), rules=[]).collect()
    assert {r.verdict for r in none} == {"allow"}


@pytest.mark.parametrize("a,b", [(1.46, 1.54), (0.97, 0.03), (60.5, 3.0), (31.0, 69.0), (500.0, 1000.0), (2e6, 4e6), (2.0, 0.001), (4000.0, 9000.0)])
def test_beta_probability(spark, a, b):
    got = spark.range(1).select(U.beta_cdf(0.3, F.lit(a), F.lit(b))).first()[0]
    lg = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    steps = 40_000
    lo = max(0.0, a / (a + b) - 40 * math.sqrt(a * b / (a + b + 1)) / (a + b)) if a > 50 else 0.0
    if lo >= 0.3:
        assert got < 1e-12
        return
    if a > 1:
        want = sum(math.exp(lg + (a - 1) * math.log(t) + (b - 1) * math.log1p(-t)) for t in
                   (lo + (j + 0.5) / steps * (0.3 - lo) for j in range(steps)) if t > 0) * (0.3 - lo) / steps
    else:
        top = 0.3 ** a
        want = sum(math.exp(lg + (b - 1) * math.log1p(-(((j + 0.5) / steps * top) ** (1 / a)))) / a for j in range(steps)) * top / steps
    if a < 100_000:
        assert got == pytest.approx(want, rel=2e-3, abs=1e-12)
    assert got >= want * (1 - 1e-3) - 1e-12        # never too small
