"""Quality rules with risk-controlled cutoffs.

Each rule turns a document's counts into "reject when the ratio passes a
cutoff". Cutoffs are not set by hand: on labelled documents of good quality the
operator counts, per stratum, how many of them each cutoff of a fixed grid would
reject, and takes the strictest cutoff whose false-rejection rate is shown to be
at most ``alpha / rules`` by the exact binomial tail
``P(Bin(n, alpha_rule) <= k) <= delta / (strata * rules)``. A grid is walked from
its mildest cutoff and stops at the first that fails (fixed-sequence testing), so
the grid itself costs no correction; strata and rules are Bonferroni-corrected.
By the union bound a stratum then loses at most ``alpha`` of its good documents,
with probability 1 - delta over all strata at once. A stratum with too few
labelled documents gets no cutoff and keeps everything the base check keeps.

All of it is DataFrame expressions: the per-document counts, the calibration
counts (one partial aggregation per stratum) and the binomial tail.

Edge cases: null or empty text has no words and fails the base check; a null
stratum is a stratum of its own; repeated rows are judged (and calibrated) one by
one; a null label is no label; a document with contradicting labels counts as
good only if every label says so; an empty table gives an empty result; columns
other than id, text and stratum are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.llm.common import ASCII_SPACE, let, materialize, words
from keepwise.llm.sieve import Sieve

SYMBOLS = "#*$%&|<>"
#: rule -> (numerator, denominator, direction, cutoffs in hundredths, mildest first)
RULES = {
    "symbols": ("n_symbols", "n_words", ">", [300, 200, 150, 100, 75, 50, 30, 20, 10]),
    "dup_lines": ("n_dup_lines", "n_lines", ">", [90, 80, 70, 60, 50, 40, 35]),
    "repeats": ("n_repeat_words", "n_words", ">", [50, 45, 40]),
    "long_words": ("word_chars", "n_words", ">", [1200, 1000, 900, 850, 800, 750, 700, 650]),
    "short_words": ("word_chars", "n_words", "<", [150, 200, 250, 300, 350, 400]),
}
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
ALPHA, DELTA = 0.02, 0.1
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(w: Column) -> Column:
    """Words lying in a 3-word window that is found twice or more.

    The windows are sorted with their positions, so equal windows are
    neighbours; the union of the covered positions is counted from the gaps.
    O(n log n) in the length of the text, without leaving the row.
    """
    def covered(pos: Column) -> Column:
        steps = F.transform(pos, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(pos, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")

    def flagged(s: Column) -> Column:
        hit = F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["w"] == x["w"], F.lit(False))
                       | F.coalesce((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["w"] == x["w"]), F.lit(False)))
        return F.sort_array(F.transform(hit, lambda x: x["i"]))

    def windows(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(a) - 3), lambda i: F.struct(
            F.concat_ws(" ", F.get(a, i), F.get(a, i + 1), F.get(a, i + 2)).alias("w"), i.alias("i")))

    body = let(w, lambda a: let(F.sort_array(windows(a)), lambda s: let(flagged(s), covered)))
    return F.when(F.size(w) >= 4, body).otherwise(F.lit(0).cast("long"))


def document_counts(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, key (hash of the text), stratum and the counts every rule is built from."""
    text = F.col("text").cast("string")
    base = docs.select("doc_id", F.xxhash64(text).alias("key"), F.col(stratum).cast("string").alias("stratum"),
                       F.coalesce(text, F.lit("")).alias("t"))
    lines = F.filter(F.split(F.col("t"), "\n", -1), lambda x: F.translate(x, ASCII_SPACE, "") != "")
    return (base.withColumn("w", words(F.col("t")))
            .select("doc_id", "key", "stratum", F.size("w").cast("long").alias("n_words"),
                    F.length(F.translate("t", ASCII_SPACE, "")).cast("long").alias("word_chars"),
                    (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                    let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                                  F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("l"),
                    _repeat_words(F.col("w")).alias("n_repeat_words"))
            .select("doc_id", "key", "stratum", "n_words", "word_chars", "n_symbols",
                    F.col("l.n").alias("n_lines"), (F.col("l.n") - F.col("l.d")).alias("n_dup_lines"), "n_repeat_words")
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))))


def _passes(rule: str, cutoff: Column | int) -> Column:
    num, den, op, _ = RULES[rule]
    left, right = 100 * F.col(num), F.lit(cutoff) * F.col(den) if isinstance(cutoff, int) else cutoff * F.col(den)
    return left > right if op == ">" else left < right


def _log_gamma(x: Column) -> Column:
    """Stirling's series at x + 7, shifted back (x >= 1)."""
    z = x + 7.0
    shift = F.ln(x * (x + 1)) + F.ln((x + 2) * (x + 3)) + F.ln((x + 4) * (x + 5)) + F.ln(x + 6)
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5))
    return (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k < n * p, else 1 (the bound cannot hold there).

    Sums the probabilities downwards from k, where each is the one above times
    a shrinking ratio; what lies beyond 20,000 terms is added as a geometric
    bound, so the value is never too small.
    """
    k, n = k.cast("double"), n.cast("double")
    log_top = (_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)
               + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    ratio = lambda i: i * (1 - p) / ((n - i + 1) * p)
    steps = F.sequence(F.lit(0), F.least(k, F.lit(20_000.0)).cast("int"))
    total = F.aggregate(
        steps, F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda a, j: F.struct((a["t"] * ratio(k - j)).alias("t"), (a["s"] + a["t"]).alias("s")),
        lambda a: a["s"] + a["t"] / F.greatest(1 - ratio(k), F.lit(1e-9)))
    return F.when(k < n * p, F.exp(log_top) * total).otherwise(F.lit(1.0))


def calibrate(counts: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum and rule with a proven cutoff:
    (stratum, rule, cutoff, n_good, n_rejected)."""
    good = (labels.where(F.col("quality").isNotNull()).groupBy("doc_id")
            .agg(F.min("quality").alias("q")).where("q = 1").select("doc_id"))
    held = counts.where(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    sums = [F.sum(F.when(_passes(r, c), 1).otherwise(0)).cast("long").alias(f"{r}_{c}")
            for r, (_, _, _, grid) in RULES.items() for c in grid]
    per = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *sums)
    # as many hypotheses as strata seen in the whole table, labelled or not
    n_strata = max(1, counts.select("stratum").distinct().count())
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"),
                               F.col(f"{r}_{c}").alias("n_rejected"))
                      for r, (_, _, _, grid) in RULES.items() for i, c in enumerate(grid)])
    tested = (per.select("stratum", "n_good", F.explode(cells).alias("c")).select("stratum", "n_good", "c.*")
              .where(binomial_tail(F.col("n_rejected"), F.col("n_good"), alpha / len(RULES))
                     <= delta / (n_strata * len(RULES))))
    # counts only rise along a grid, so the last cutoff that passes ends an unbroken sequence
    return (tested.groupBy("stratum", "rule").agg(F.max(F.struct("step", "cutoff", "n_good", "n_rejected")).alias("b"))
            .select("stratum", "rule", "b.cutoff", "b.n_good", "b.n_rejected"))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang",
           alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per row of ``docs``: doc_id, key, the counts, ``base_failed``, ``kept`` and the rules that reject it.

    The counts are written once to the checkpoint folder (numbers only, no
    texts); calibration and judgement both read them.
    """
    counts = materialize(document_counts(docs, stratum), "quality-counts")
    cut = calibrate(counts, labels, alpha, delta)
    # one row per stratum, as many columns as rules
    wide = cut.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    wide = wide.select(F.col("stratum").alias("s"), *[f"cut_{r}" for r in RULES])
    hit = F.array_compact(F.array(*[F.when(_passes(r, F.col(f"cut_{r}")), F.lit(r)) for r in RULES]))
    found = counts.join(wide, F.col("stratum").eqNullSafe(F.col("s")), "left").withColumn("rejected_by", hit)
    return found.select("doc_id", "key", *COUNTS, "base_failed",
                        (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"),
                        F.array_join("rejected_by", ",").alias("rejected_by"))


def quality_rules(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """doc_id, the counts, ``base_failed``, ``kept`` and the rules that reject it, per document."""
    return judged(docs, labels, **params).drop("key")


def kept_documents(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns (of rows alike in id and
    text none, if one is rejected).

    Texts do not move for it: rows that a sieve of the rejected keys passes stay where they
    are, and only those that the kept keys may have as well meet the rejected ones exactly."""
    names = ["_id", "_none", "_key"]
    key = lambda i, k: [i.alias("_id"), i.isNull().alias("_none"), k.alias("_key")]
    keys = materialize(judged(docs, labels, **params).select(*key(F.col("doc_id"), F.col("key")), "kept").groupBy(*names)
                       .agg(F.min("kept").alias("kept")), "quality-verdicts")
    bad, good = keys.where("NOT kept"), keys.where("kept")
    whole = docs.select(F.struct("*").alias("doc"), *key(F.col("doc_id"), F.xxhash64(F.col("text").cast("string"))))
    marked = Sieve(bad, names).marked(whole, names, "_bad")
    held = Sieve(good, names).marked(marked.where("_bad"), names, "_good").where("_good").select("doc", "_id", "_key")
    bad = bad.select(F.col("_id").alias("bad_id"), F.col("_key").alias("bad_key"))
    kept = held.join(bad, F.col("_id").eqNullSafe(F.col("bad_id")) & (F.col("_key") == F.col("bad_key")), "left_anti")
    return marked.where("NOT _bad").select("doc.*").unionByName(kept.select("doc.*"))
