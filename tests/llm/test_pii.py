"""Personal data: base spans and the bootstrapped extension against plain Python."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from keepwise.llm import pii as P
from tests.conftest import SF_MID

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def base(text):
    out = []
    for kind, regex in BASE.items():
        for m in re.finditer(regex, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def written(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def context(text, s, e):
    same = lambda w: "".join(c.lower() if c.isascii() else c for c in w).translate(str.maketrans("123456789", "0" * 9))
    before = re.search(r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*\Z", text[max(0, s - P.REACH):s])
    after = re.match(r"[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", text[e:e + P.REACH])
    return same(before[1]) if before else "", same(after[1]) if after else ""


def extended(rows):
    """{row number: all spans} by the same graph in plain dictionaries."""
    mentions, kinds = [], list(BASE)
    for n, text in enumerate(rows):
        text = text or ""
        spans = base(text)
        for k, s, e in spans:
            value = text[s:e] if k in ("email", "ip") else re.sub("[^0-9]", "", text[s:e])
            mentions.append((n, kinds.index(k), s, e, value.lower() if k == "email" else value, *context(text, s, e)))
        for m in re.finditer(P.NUMBER, text):
            d = re.sub("[^0-9]", "", m[0])
            if len(d) >= P.MIN_DIGITS and not any(s < m.end() and m.start() < e for _, s, e in spans):
                mentions.append((n, -1, m.start(), m.end(), d, *context(text, m.start(), m.end())))
    edges, seed = defaultdict(dict), {}
    for _, k, _, _, i, left, right in mentions:
        seed[i] = max(seed.get(i, -1), k)
        for p in ("< " + left, "> " + right, left + " _ " + right):
            edges[p][i] = max(edges[p].get(i, -1), k)
    known = {(i, k): 1.0 for i, k in seed.items() if k >= 0}
    score = dict(known)
    for _ in range(P.ROUNDS):
        of = defaultdict(dict)
        for (i, k), v in score.items():
            of[i][k] = v
        share = {}
        for p, members in edges.items():
            w, borne = defaultdict(float), defaultdict(int)
            for i, k in members.items():
                for kind, v in of.get(i, {}).items():
                    w[kind] += v
                    borne[kind] += k >= 0
            for kind in w:
                x = w[kind] / (len(members) + P.SMOOTH)
                if borne[kind] >= P.MIN_SEEDS and x >= P.MIN_PATTERN:
                    share[p, kind] = x
        guess = defaultdict(float)
        for (p, kind), x in share.items():
            for i in edges[p]:
                if seed[i] < 0:
                    guess[i, kind] += math.log(max(1 - x, 1e-12))
        score = {**known, **{ik: 1 - math.exp(v) for ik, v in guess.items()}}
    best = {}
    for (i, k), v in score.items():
        best[i] = max(best.get(i, (0, 0)), (v, k))
    out = {n: [] for n in range(len(rows))}
    for n, k, s, e, i, _, _ in mentions:
        if k >= 0:
            out[n].append((k, s, e))
        elif best.get(i, (0, 0))[0] >= P.ACCEPT:
            out[n].append((best[i][1], s, e))
    return {n: [(kinds[k], s, e) for k, s, e in sorted(v)] for n, v in out.items()}


def check(spark, make_docs, texts):
    out = {r.doc_id: r for r in P.personal_data(make_docs([(n, t, "en", "s") for n, t in enumerate(texts)])).collect()}
    want = extended(texts)
    for n, t in enumerate(texts):
        b = base(t)
        assert [out[n][f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in b) for k in BASE], t
        assert out[n].base_sha256 == hashlib.sha256(written(b).encode()).hexdigest(), (t, b)
        assert out[n].spans == written(want[n]), t
    return out


ODD = ["", None, "a@b.c", "a@b", "x@y.z%w@v.u", "a.b@c..d e@f.g.", ".a@b.c.-", "é@b.c éa@b-c.d1", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.255",
       "1.2.3", "01.2.3.4.", "+1 (743) 555-3824.", "+12 345", "++123456789", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "4111 1111 1111 1111",
       "4111-1111-1111-1111 x", "4111  1111 1111 1111", "41111111111111112", " 4111 4111111111111111", "41111111 1111 1111 a@bc.d",
       "1 " * 9000, "1.2." * 5000 + "3", "a." * 4000 + "@" + "b." * 4000 + "c", "9" * 50_000 + "@", "+" * 3000 + "1 23456789", "-4111111111111111-",
       "mail x_y+z%w-1@a-b.example.com, or <q@r.st>", "😀 4242424242424242 😀 1.1.1.1 é +44 20 7946 0958"]


def test_odd_texts(spark, make_docs):
    check(spark, make_docs, ODD)


def test_random_texts(spark, make_docs):
    rng = random.Random(4)
    check(spark, make_docs, ["".join(rng.choice("aB1.@-+ 0é9(),%_2\n4") for _ in range(rng.randrange(80))) for _ in range(400)])


def test_table(spark, make_docs):
    rows = spark.read.parquet(f"{SF_MID}/documents.parquet").orderBy("doc_id").select("text").collect()
    check(spark, make_docs, [r.text for r in rows])


def test_contexts_discover_what_the_patterns_miss(spark, make_docs):
    rng = random.Random(2)
    word = lambda: rng.choice("alpha beta gamma delta eps".split())
    texts = [f"{word()} call me at +1 212 555 {i:04d} tonight {word()}" for i in range(20)]
    texts += [f"{word()} order number 99{i:07d} shipped {word()}" for i in range(20)]
    texts += ["call me at 212 555 7777 tonight", "my line is 12125550003 now", "order number 995555555 shipped"]
    out = check(spark, make_docs, texts)
    assert out[40].spans == "phone:11:23" and out[40].n_phone == 0
    assert out[41].spans == "phone:11:22"          # a seed's digits without the plus
    assert out[42].spans == "" and all(out[i].spans == "" for i in range(20, 40))


def test_contexts_discover_words_and_parts_of_runs(spark, make_docs):
    texts = [f"call me at +1 212 555 {i:04d} tonight" for i in range(20)] + [f"write to user{i}@mail{i}.example please" for i in range(20)]
    odd = ["write to jane@localhost please", "write to jane(at)host.org please", "lines 12125550003 12125550004 both",
           "from 10.0.0.1 1 212 555 0005 again", "the file a.b@c is x9y, see it"]
    out = P.personal_data(make_docs([(n, t, "en", "s") for n, t in enumerate(texts + odd)])).collect()
    got = {r.doc_id: r.spans for r in out}
    assert got[40] == "email:9:23" and got[41] == "email:9:25"
    assert got[42] == "phone:6:17,phone:18:29"
    assert got[43] == "ip:5:13,phone:14:28"
    assert got[44] == ""


def test_masking_and_odd_rows(spark, make_docs):
    rows = [(1, "write a@b.com or 4111111111111111!", "en", "s"), (1, "write a@b.com or 4111111111111111!", "en", "s"),
            (None, "x 1.2.3.4", None, None), (2, None, "en", "s"), (3, "nothing here", "en", "s"), (4, "+12345678901234 5", "en", "s")]
    docs = make_docs(rows).selectExpr("*", "doc_id AS row", "text AS spans", "text AS key")
    out = P.masked(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id or -1), r.text or "", r.n_chars) for r in out.collect())
    assert got == sorted([(1, "write [EMAIL] or [CARD]!", 24), (1, "write [EMAIL] or [CARD]!", 24), (-1, "x [IP]", 6), (2, "", None),
                          (3, "nothing here", 12), (4, "[PHONE]", 7)])
    assert P.personal_data(make_docs([])).count() == 0 and P.masked(make_docs([])).count() == 0


def test_pieces_of_long_texts(spark, make_docs, monkeypatch):
    """Cut into short pieces, texts give what they give whole."""
    rng = random.Random(4)
    bits = ["mail jane.doe@site.org now", "call +44 (0) 20 7946-0958", "from 10.0.0.1, 212 555 0003", "card 4111 1111 1111 1111 ok", "plain words here\n", "a.b c1 d(at)e",
            "x" * 90, "1 2 3 4 5 6 7 8 9", "tel. +1-202-555-0172"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))), "en", "s") for i in range(40)] + [(90, None, "en", "s"), (91, "", "en", "s")]
    docs = make_docs(rows)
    whole = sorted(map(tuple, P.personal_data(docs).collect()))
    monkeypatch.setattr(P, "PIECE", 90)
    monkeypatch.setattr(P, "_PIECES", P._PIECES.replace("{16384}", "{90}"))
    assert sorted(map(tuple, P.personal_data(docs).collect())) == whole


def test_time_grows_with_the_spans_of_a_text(spark, make_docs):
    import time

    def took(n):
        docs = make_docs([(1, " ".join(f"user{i}@site{i % 7}.org wrote" for i in range(n)), "en", "s")])
        t = time.perf_counter()
        assert P.personal_data(docs).first().n_email == n
        return time.perf_counter() - t

    fixed = min(took(10) for _ in range(2))
    assert took(16_000) - fixed < 4 * max(2.5, took(8_000) - fixed)      # four times for twice the text would be quadratic
