"""URL filters: explicit rules first, then an empirical-Bayes host reputation.

Labelled page outcomes are counted per host and shrunk through beta-binomial
priors from the global rate to the suffix, the registered domain and the host.
The prior mean of a group is the posterior mean of its parent without the group's
own pages, so no page is evidence twice; the strength of each level's priors comes
from how much its groups scatter around them (method of moments, at least
``MIN_STRENGTH`` pages). A host is blocked when the posterior probability that its
bad rate is at most ``max_bad`` is no more than ``risk``: the lower ``risk``
quantile of Beta(a, b) lies above ``max_bad``. That probability is a regularised
incomplete beta function, summed as a series whose rest is bounded from above, so
it is never too small and a host is never blocked for want of terms.

For the reputation a host counts without port and closing dot. Its suffix is the
last label, or the last two where a generic second level stands below a country
code (``co.uk``); the registered domain is one label more. An address of digits is
its own domain and suffix.

Hosts are counted with map-side partial aggregation, so a host with a third of
all pages is a few rows per task; the page side of the verdict join is split by
AQE when one host is hot. Only three scalars per level reach the driver.

Edge cases: a null url or one without ``://`` has empty host and path (a host
like any other for the reputation, fitting no rule); pages without a label count
for nothing but get the verdict of their host; a host whose registered domain has
no labelled page is not judged, so no labels at all means nothing is blocked by the
method; a page labelled more than once is bad if any label says so; repeated pages
are judged one by one; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.llm.common import ascii_lower, materialize
from keepwise.llm.quality_rules import _log_gamma

#: (verdict, host, path); a rule fits its host and every subdomain of it.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: block when P(bad rate <= MAX_BAD) <= RISK
MAX_BAD, RISK = 0.3, 0.05
#: a prior weighs at least so many pages; terms of the series before its rest is bounded
MIN_STRENGTH, TERMS = 2.0, 400
LEVELS = ["suffix", "domain", "host"]
#: generic second levels that belong to the suffix below a two-letter country code
SECOND_LEVELS = ["ac", "co", "com", "edu", "gov", "net", "org"]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return ascii_lower(host), path


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):   # the longest is tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def reputation_keys(host: Column) -> dict[str, Column]:
    """suffix, domain and host as the reputation groups them."""
    host = F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"\.$", "")
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    two = (n > 2) & (F.length(F.get(parts, n - 1)) == 2) & F.get(parts, n - 2).isin(SECOND_LEVELS)
    digits = host.rlike(r"^[0-9.]+$|^\[")
    tail = lambda k: F.when(digits, host).otherwise(F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), k), "."))
    return {"suffix": F.when(two, tail(2)).otherwise(tail(1)), "domain": F.when(two, tail(3)).otherwise(tail(2)), "host": host}


def _strength(groups: DataFrame) -> float:
    """Beta-binomial strength (a + b) of groups (n, x) around their prior mean m."""
    v = F.col("m") * (1 - F.col("m"))
    r = groups.where("n > 0").agg(
        F.sum((F.col("x") - F.col("n") * F.col("m")) ** 2 / F.col("n")).alias("s"),
        F.sum(v).alias("v"), F.sum(F.col("n") * v).alias("nv")).first()
    if not r or r["nv"] is None or r["nv"] <= 0:
        return 100.0
    spread = r["nv"] - r["v"]           # what full correlation inside groups would add
    rho = (r["s"] - r["v"]) / spread if spread > 0 else 0.0
    return max((1 - rho) / rho, MIN_STRENGTH) if rho > 1e-4 else 9999.0


def beta_cdf(x: float, a: Column, b: Column, terms: int = TERMS) -> Column:
    """P(Beta(a, b) <= x) where x lies below the mean, else 1 (nothing to show there).

    x^a (1-x)^b / (a B(a, b)) times the series 1 + t1 + t2 + ..., each term the last
    one times x (a+b+n) / (a+1+n). The ratios go monotonically to x, so what follows
    the last term is at most a geometric series of the larger of both ratios.
    """
    # lgamma(b) = lgamma(b + 1) - ln b: the series of _log_gamma wants arguments of one and more
    log_top = (a * F.ln(F.lit(x)) + b * F.ln(F.lit(1 - x)) + _log_gamma(a + b + 1) - F.ln(a + b)
               - _log_gamma(a + 1) - _log_gamma(b + 1) + F.ln(b))
    ratio = lambda n: F.lit(x) * (a + b + n) / (a + 1 + n)
    rest = F.greatest(ratio(F.lit(float(terms))), F.lit(x))
    total = F.aggregate(
        F.sequence(F.lit(0), F.lit(terms - 1)), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda acc, n: F.struct((acc["t"] * ratio(n)).alias("t"), (acc["s"] + acc["t"]).alias("s")),
        lambda acc: acc["s"] + acc["t"] / (1 - rest))
    return F.when(F.lit(x) * (a + b) < a, F.least(F.exp(log_top) * total, F.lit(1.0))).otherwise(F.lit(1.0))


def host_reputation(pages: DataFrame, labels: DataFrame, max_bad: float = MAX_BAD, risk: float = RISK) -> DataFrame:
    """Per reputation host: labelled pages n, bad pages x, posterior mean, the probability
    ``p_fine`` that at most ``max_bad`` of its pages are bad, and ``blocked``."""
    outcome = (labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("labelled"))
               .agg(F.min("quality").alias("quality")))
    keys = reputation_keys(F.col("host"))
    hosts = (pages.select("page_id", *[c.alias(k) for k, c in keys.items()])
             .join(outcome, F.col("page_id") == F.col("labelled"), "left")
             .groupBy(*LEVELS).agg(F.count("quality").alias("n"),
                                   F.coalesce(F.sum(1 - F.col("quality")), F.lit(0)).cast("long").alias("x")))
    hosts = materialize(hosts, "url-hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("x").alias("x")).first()
    n_up, x_up = F.lit(float(total["n"] or 0)), F.lit(float(total["x"] or 0))
    m_up, k_up, above = F.lit(0.5), 1.0, None     # half a bad page of one, before any page is seen
    for i, level in enumerate(LEVELS):
        keys = LEVELS[: i + 1]
        g = hosts if level == "host" else hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        if above is not None:
            g = g.join(above, LEVELS[:i])
            n_up, x_up, m_up = F.col("n_up"), F.col("x_up"), F.col("m_up")
        g = g.withColumn("m", (m_up * k_up + x_up - F.col("x")) / (k_up + n_up - F.col("n")))
        k_up = _strength(g)
        above = g.select(*keys, F.col("n").alias("n_up"), F.col("x").alias("x_up"), F.col("m").alias("m_up"))
    a, b = F.col("m") * k_up + F.col("x"), (1 - F.col("m")) * k_up + F.col("n") - F.col("x")
    g = g.select("host", "n", "x", (F.col("n_up") > 0).alias("seen"), a.alias("a"), b.alias("b"))
    g = g.withColumn("p_fine", F.round(beta_cdf(max_bad, F.col("a"), F.col("b")), 9))
    return g.select("host", "n", "x", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), "p_fine",
                    (F.col("seen") & (F.col("p_fine") <= risk)).alias("blocked"))


def url_filter(pages: DataFrame, labels: DataFrame, rules=RULES, max_bad: float = MAX_BAD, risk: float = RISK) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) of every page."""
    host, path = split_url(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = (host_reputation(parsed, labels, max_bad, risk).where("blocked")
           .select(F.col("host").alias("bad_host")))
    text, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return (parsed.join(bad, reputation_keys(F.col("host"))["host"] == F.col("bad_host"), "left")
            .select("page_id", "host", "path", text.alias("rule"),
                    F.coalesce(verdict, F.when(F.col("bad_host").isNull(), "allow").otherwise("block")).alias("verdict")))
