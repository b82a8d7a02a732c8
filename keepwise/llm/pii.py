"""Personal data: base patterns, extended by bootstrapped contexts.

Base spans come from four regular expressions with checks (address parts, card
check digit, digit counts), written so that the regex engine needs no recursion and
no quadratic search on long runs. Starts are code points, summed up from the pieces
between the matches.

The extension is a pattern-instance graph. Mentions are the base matches (seeds)
and every other run of at least seven digits with separators; besides, the parts of
such runs between base spans, and between blanks if all of them have seven digits, and words with '@', '(at)', an inner
dot or letters next to digits. An instance is a
mention's normalised value; a pattern is the word before it, the word after it, or
both. A pattern's score for a kind is the smoothed share of its instances that are
of that kind, an instance's score the noisy-or of its patterns (1 for a seed); they
are computed in turn for a few rounds. An unseen instance is taken for a kind if
its score is high and its patterns are borne by enough seeds, or if its digits are
those of a seed of that kind. All mentions of it become spans of that kind unless they touch a
base span. Parts and words are judged in a second graph, which has them besides the
others, so that they do not change what whole runs are taken for; where accepted spans
overlap, a whole run goes before them, and then the first and longest.

Everything is DataFrame expressions, aggregations and equi-joins. The graph is
aggregated to distinct (pattern, instance) edges before anything is joined to it, and
the joined tables are written ones, so that a pattern like a frequent word is split
by AQE.

A long text is searched in pieces, cut before a blank whose neighbour no mention can
contain, each with a margin of ``REACH`` characters for contexts, so that the work grows
with the length of a text (but for stretches without such a blank).

Edge cases: null or empty text has no spans; rows repeated are judged one by one,
and a null doc_id like any other; an empty table gives an empty result; extra
columns are not read by ``personal_data`` and are kept by ``masked``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.llm.common import LOWER, SPACE_RUN, UPPER, let, materialize
from keepwise.llm.sieve import Sieve

KINDS = ["email", "ip", "card", "phone"]
#: A private character stands for a separator that lies inside a value.
JOINT, NOT_JOINT = "\ue000", "\ue001"
_LOCAL = "A-Za-z0-9._%+" + JOINT + "-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]+{JOINT}[A-Za-z0-9{JOINT}-]+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
CARD = rf"[0-9{JOINT}]{{13,}}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"[0-9][0-9().\x20-]{5,}[0-9]"
PART = r"[0-9][0-9().-]{5,}[0-9]"
#: Words with '@', '(at)', an inner dot or letters next to digits.
WORD = (r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*(?:@|\(at\)|[A-Za-z0-9]\.[A-Za-z0-9]|[A-Za-z][0-9]|[0-9][A-Za-z]))"
        r"[^\x20\x09-\x0D]+")
#: Mentions that are no seeds: digit runs; what is left of runs cut at base spans or blanks; words.
RUN, CUT, TOKEN = -1, -2, -3
MIN_DIGITS = 7
#: Characters looked at on either side of a mention for its context: a longer word counts by its nearer part.
REACH = 64
#: Texts are taken apart into pieces of about so many characters, at blanks that no mention can contain.
PIECE = 16_384
_PIECES = rf"(?s).{{{PIECE}}}.*?[^0-9().\x20+-](?=[\x20\x09-\x0D])|.+"
ROUNDS, MIN_SEEDS, SMOOTH, MIN_PATTERN, ACCEPT = 3, 5, 2.0, 0.6, 0.9
_FOUND = "array<struct<m:string,s:int,e:int>>"


def find(text: Column, regex: str) -> Column:
    """[(m, s, e)]: every match and where it stands, in code points."""
    none = F.array().cast(_FOUND)

    def located(parts: Column, hits: Column) -> Column:
        start = lambda a, k: a["at"] + F.length(F.get(parts, k))
        return F.aggregate(
            F.sequence(F.lit(0), F.size(hits) - 1), F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda a, k: F.struct((start(a, k) + F.length(F.get(hits, k))).alias("at"), F.concat(a["out"], F.array(F.struct(
                F.get(hits, k).alias("m"), start(a, k).alias("s"), (start(a, k) + F.length(F.get(hits, k))).alias("e")))).alias("out")),
            lambda a: a["out"])

    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    return let(hits, lambda h: F.when(F.size(h) > 0, let(F.split(text, regex, -1), lambda p: located(p, h))).otherwise(none))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i):
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _checked(found: Column, kind: int, value, ok) -> Column:
    """Matches that pass, as (kind, s, e, instance)."""
    valued = F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), value(x["m"]).alias("instance")))
    return F.filter(valued, lambda x: ok(x["instance"]))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind as listed, then start."""
    nothing = F.array().cast("array<struct<kind:int,s:int,e:int,instance:string>>")
    clean = F.translate(text, JOINT, NOT_JOINT)
    dotted = F.regexp_replace(clean, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", JOINT)
    joined = F.regexp_replace(clean, r"(?<=[0-9])[\x20-](?=[0-9])", JOINT)
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    n = lambda d, low, high: F.length(d).between(low, high)
    return F.concat(
        F.when(F.contains(text, F.lit("@")), let(dotted, lambda t: _checked(
            find(t, EMAIL), 0, lambda m: F.translate(F.translate(m, JOINT, "."), UPPER, LOWER), lambda v: v.isNotNull()))).otherwise(nothing),
        F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _checked(
            find(text, IP), 1, lambda m: m, lambda v: v.rlike(rf"^{part}(?:\.{part}){{3}}$"))).otherwise(nothing),
        F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), let(joined, lambda t: _checked(
            find(t, CARD), 2, _digits, lambda v: n(v, 13, 19) & _luhn(v)))).otherwise(nothing),
        F.when(text.rlike(r"\+[0-9]"), _checked(find(text, PHONE), 3, _digits, lambda v: n(v, 9, 15))).otherwise(nothing))


def _context(text: Column, s: Column, e: Column) -> tuple[Column, Column]:
    """The word before and the word after a span, lower-cased, digits as 0."""
    same = lambda w: F.translate(w, UPPER + "123456789", LOWER + "0" * 9)
    before = F.substring(text, F.greatest(F.lit(1), s - REACH + 1), F.least(s, F.lit(REACH)))
    after = F.substring(text, e + 1, F.lit(REACH))
    word = SPACE_RUN.replace("[", "[^")
    return (same(F.regexp_extract(before, rf"({word})[\x20\x09-\x0D]*$", 1)),
            same(F.regexp_extract(after, rf"^[\x20\x09-\x0D]*({word})", 1)))


def _pieces(docs: DataFrame) -> DataFrame:
    """row, doc_id, key and per piece of the text: piece (its number), at (where it starts), t, left and right margin."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = F.when(F.length(text) > PIECE, F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))).otherwise(F.array(text))
    each = lambda p: F.transform(p, lambda x, i: F.struct(
        x.alias("t"), F.when(i > 0, F.right(F.get(p, i - 1), F.lit(REACH))).otherwise("").alias("before"),
        F.coalesce(F.left(F.get(p, i + 1), F.lit(REACH)), F.lit("")).alias("after"),
        F.aggregate(F.slice(p, F.lit(1), i), F.lit(0), lambda n, y: n + F.length(y)).alias("at")))
    # numbered before the pieces are rows of their own
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"),
                           F.xxhash64(F.col("text").cast("string")).alias("key"), let(cut, each).alias("pieces"))
    return numbered.select("row", "doc_id", "key", F.posexplode("pieces").alias("piece", "p")).select("row", "doc_id", "key", "piece", "p.*")


def mentions(docs: DataFrame) -> DataFrame:
    """row, doc_id, key, base spans and the other digit runs, each with its context; no texts."""
    start = _pieces(docs)

    def others(base: Column) -> Column:
        runs = F.when(F.col("t").rlike(NUMBER), find(F.col("t"), NUMBER)).otherwise(F.array().cast(_FOUND))
        free = F.filter(runs, lambda x: (F.length(_digits(x["m"])) >= MIN_DIGITS)
                        & ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
        return F.transform(free, lambda x: F.struct(F.lit(RUN).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _digits(x["m"]).alias("instance")))

    def cuts(base: Column, whole: Column) -> Column:
        """Runs between base spans, and between blanks, that are no whole run; words that touch neither."""
        hidden = F.aggregate(base, F.col("t"), lambda t, b: F.overlay(t, F.repeat(F.lit(NOT_JOINT), b["e"] - b["s"]), b["s"] + 1, b["e"] - b["s"]))

        def among(t: Column) -> Column:
            none = F.array().cast(_FOUND)
            # a blank may also stand inside a value: runs are cut there only if every part is a number
            alone = lambda r: F.forall(F.split(r["m"], r"\x20+"), lambda w: F.length(_digits(w)) >= MIN_DIGITS)
            parted = lambda r: F.concat(F.array(r), F.when(alone(r), F.transform(find(r["m"], PART), lambda x: F.struct(
                x["m"].alias("m"), (x["s"] + r["s"]).alias("s"), (x["e"] + r["s"]).alias("e")))).otherwise(none))
            runs = F.when(t.rlike(NUMBER), F.flatten(F.transform(find(t, NUMBER), parted))).otherwise(none)
            parts = F.filter(runs, lambda x: (F.length(_digits(x["m"])) >= MIN_DIGITS)
                             & ~F.exists(whole, lambda w: (w["s"] == x["s"]) & (w["e"] == x["e"])))
            parts = F.array_distinct(F.transform(parts, lambda x: F.struct(F.lit(CUT).alias("kind"), x["s"].alias("s"), x["e"].alias("e"),
                                                                           _digits(x["m"]).alias("instance"))))
            trim = lambda m, side: F.length(F.regexp_extract(m, side, 0))
            tokens = F.transform(F.when(t.rlike(WORD), find(t, WORD)).otherwise(none), lambda x: F.struct(
                F.lit(TOKEN).alias("kind"), (x["s"] + trim(x["m"], r"^[^A-Za-z0-9+]*")).alias("s"),
                (x["e"] - trim(x["m"], r"[^A-Za-z0-9]*+$")).alias("e"),
                F.translate(F.regexp_replace(x["m"], r"^[^A-Za-z0-9+]+|[^A-Za-z0-9]++$", ""), UPPER, LOWER).alias("instance")))
            return F.concat(parts, F.filter(tokens, lambda x: (x["s"] < x["e"]) & ~F.contains(x["instance"], F.lit(NOT_JOINT))))

        return let(hidden, among)

    def in_context(x: Column) -> Column:
        edge = F.length("before")
        left, right = _context(F.concat("before", "t", "after"), x["s"] + edge, x["e"] + edge)
        return F.struct(x["kind"].alias("kind"), (x["s"] + F.col("at")).alias("s"), (x["e"] + F.col("at")).alias("e"), x["instance"].alias("instance"),
                        left.alias("left"), right.alias("right"))

    found = let(base_spans(F.col("t")), lambda b: let(others(b), lambda o: F.concat(b, o, cuts(b, o))))
    parts = start.select("row", "doc_id", "key", "piece", F.transform(found, in_context).alias("mentions"))
    # pieces of one text come together again; as many as its length needs
    whole = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("key").alias("key"),
                                     F.sort_array(F.collect_list(F.struct("piece", "mentions"))).alias("all"))
    return whole.select("row", "doc_id", "key", F.flatten("all.mentions").alias("mentions"))


def accepted_instances(each: DataFrame) -> DataFrame:
    """(instance, kind): unseen instances that the contexts of seeds lead to."""
    pattern = F.explode(F.array(F.concat(F.lit("< "), "left"), F.concat(F.lit("> "), "right"), F.concat_ws(" _ ", "left", "right")))
    # distinct edges first: how often one value stands in one context does not count
    edges = materialize(each.select(pattern.alias("pattern"), "instance", "kind").groupBy("pattern", "instance")
                        .agg(F.max("kind").alias("kind")), "pii-edges")
    # a digit run whose digits are a seed's own is that seed
    seeds = materialize(edges.groupBy("instance").agg(F.max("kind").alias("seed")), "pii-instances")
    score = materialize(seeds.where("seed >= 0").select("instance", F.col("seed").alias("k"), F.lit(1.0).alias("score")), "pii-scores")
    for _ in range(ROUNDS):
        size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
        weight = (edges.join(score, "instance").groupBy("pattern", "k")
                  .agg(F.sum("score").alias("w"), F.sum(F.when(F.col("kind") >= 0, 1).otherwise(0)).alias("borne")))
        patterns = materialize(weight.join(size, "pattern").where(F.col("borne") >= MIN_SEEDS)
                               .select("pattern", "k", F.round(F.col("w") / (F.col("n") + SMOOTH), 9).alias("p"))
                               .where(F.col("p") >= MIN_PATTERN), "pii-patterns")
        unseen = edges.join(seeds.where("seed < 0").select("instance"), "instance").select("pattern", "instance")
        guessed = (unseen.join(patterns, "pattern").groupBy("instance", "k")
                   .agg(F.round(1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-12))))), 9).alias("score")))
        known = seeds.where("seed >= 0").select("instance", F.col("seed").alias("k"), F.lit(1.0).alias("score"))
        score = materialize(known.unionByName(guessed), "pii-scores")
    top = score.groupBy("instance").agg(F.max(F.struct("score", "k")).alias("b")).select("instance", "b.score", F.col("b.k").alias("kind"))
    return top.where(F.col("score") >= ACCEPT).select("instance", "kind")


def found_spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, key, base and spans (arrays of kind, s, e, in order) of every row."""
    rows = materialize(mentions(docs), "pii-mentions")
    each = rows.where(F.size("mentions") > 0).select("row", F.explode("mentions").alias("x")).select("row", "x.*")
    # the graph takes unseen mentions as one kind
    as_unseen = lambda x: x.withColumn("kind", F.greatest("kind", F.lit(RUN)))
    taken = materialize(accepted_instances(each.where(F.col("kind") >= RUN)), "pii-accepted")
    taken_cuts = materialize(accepted_instances(as_unseen(each)), "pii-accepted-cuts")
    runs = each.where(F.col("kind") == RUN).drop("kind").join(taken, "instance").select("row", F.lit(0).alias("late"), "s", "e", "kind")
    late = each.where(F.col("kind") < RUN).drop("kind").join(taken_cuts, "instance").select("row", F.lit(1).alias("late"), "s", "e", "kind")
    clear = lambda out, x: ~F.exists(out, lambda o: (o["s"] < -x["till"]) & (x["s"] < o["e"]))
    spans = F.array().cast("array<struct<kind:int,s:int,e:int>>")
    chosen = F.aggregate(F.sort_array("more"), spans, lambda out, x: F.when(clear(out, x), F.concat(out, F.array(
        F.struct(x["kind"].alias("kind"), x["s"].alias("s"), (-x["till"]).alias("e"))))).otherwise(out))
    # the key of the order: whole runs first, then by start, the longest first
    keyed = F.struct("late", "s", (-F.col("e")).alias("till"), "kind")
    more = (runs.unionByName(late).groupBy("row").agg(F.collect_list(keyed).alias("more"))   # spans of one text
            .select("row", chosen.alias("more")))
    base = F.sort_array(F.transform(F.filter("mentions", lambda x: x["kind"] >= 0),       # pieces each have theirs in order
                                    lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    return (rows.select("row", "doc_id", "key", base.alias("base")).join(materialize(more, "pii-more"), "row", "left")
            .select("row", "doc_id", "key", "base", F.sort_array(F.concat("base", F.coalesce(
                "more", F.array().cast("array<struct<kind:int,s:int,e:int>>")))).alias("spans")))


def _written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(kinds, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base counts per kind, base_sha256 and all spans."""
    of = lambda k: F.filter("base", lambda x: x["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found_spans(docs).select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
                                    _written(F.col("spans")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (overlapping ones as one), ``n_chars`` to match."""
    marks = (found_spans(docs).where(F.size("spans") > 0).groupBy("doc_id", "key").agg(F.first("spans").alias("spans"))
             .select(F.col("doc_id").alias("mark_id"), F.col("key").alias("mark_key"), "spans"))
    by_start = F.sort_array(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("doc.text").cast("string")
    cut = F.aggregate(
        by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] < a["at"], a["out"]).otherwise(F.concat(
            a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.get(kinds, x["kind"]))).alias("out")),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    marks = materialize(marks, "pii-marks")
    # texts without a span stay where they are
    whole = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_key"))
    sifted = Sieve(marks, ["mark_id", "mark_key"]).marked(whole, ["_id", "_key"], "_marked")
    found = sifted.where("_marked").join(marks, F.col("_id").eqNullSafe(F.col("mark_id")) & (F.col("_key") == F.col("mark_key")), "left")
    clear = sifted.where("NOT _marked").select("doc", F.lit(None).cast(marks.schema["spans"].dataType).alias("spans"))
    met = clear.unionByName(found.select("doc", "spans"))
    new = met.withColumn("new_text", F.when(F.col("spans").isNull(), text).otherwise(cut))
    changed = F.col("spans").isNotNull()
    swap = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        swap["n_chars"] = F.when(changed, F.length("new_text").cast("long")).otherwise(F.col("doc.n_chars").cast("long"))
    return new.select(*[(swap[c] if c in swap else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
