"""URL filter: explicit rules, then an empirical-Bayes reputation of hosts.

Labelled page outcomes (bad or good) are counted for each host and added up to
its registered domain and its suffix.  Each level's beta-binomial prior has the
posterior mean of the level above as its mean, and a strength fitted from the
spread between the groups of that level (method of moments):

    suffix  ~ prior(corpus rate),  domain ~ prior(suffix mean),  host ~ prior(domain mean)

A host is blocked if the lower bound of its posterior bad rate (mean minus z
standard deviations of the beta posterior) exceeds a threshold: few outcomes
give a wide posterior and no block.

A rule is (host, path, verdict); it fits its host and all subdomains where the
url's path starts with the rule's; the longest fitting rule wins and overrules
the reputation.

A null url or one without "://" has an empty host and path, no rule, and the
reputation of the empty host.  Urls of any length are judged whole.  Of rules of
one length that fit, the first by (host, path, verdict) wins.  Repeated pages
each count and each give a row; an empty labels table leaves the wide prior,
which allows; a null or unmatched label id is no outcome; an id with several
labels has as many outcomes; other columns are ignored.  Hosts are aggregated
before any shuffle of pages, so a hot host moves as one row for each task, and
written once; the levels above are aggregated from that table.  The join back to
pages is split by adaptive skew handling.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Fixed rules of the query: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Public suffixes of two labels; a parameter.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host: after the first "://", up to "/", "?", "#" or the end; the path: from there up to "?", "#" or the end."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upto = F.regexp_extract(rest, r"^[^?#]*", 0)
    host = F.regexp_extract(upto, r"^[^/]*", 0)
    return lower_ascii(host), F.substring(upto, F.length(host) + 1, F.length(upto))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    whole = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    out = None
    for h, p, verdict in whole:
        fits = ((host == F.lit(h)) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def suffix_of(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    last2 = F.substring_index(host, ".", -2)
    return F.when(last2.isin(*two_label), last2).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The suffix and one label more; an address of digits is its own domain."""
    last2 = F.substring_index(host, ".", -2)
    named = F.when(last2.isin(*two_label), F.substring_index(host, ".", -3)).otherwise(last2)
    return F.when(host.rlike(r"^[0-9.:]+$"), host).otherwise(named)


def _strength(groups: DataFrame, mean: Column, least: float = 2.0, most: float = 1000.0) -> float:
    """The prior strength a + b at one level: how far the rates of groups of two or more outcomes spread about their means."""
    p = mean
    row = groups.where("n >= 2").agg(
        F.sum(F.col("n") * (F.col("x") / F.col("n") - p) ** 2).alias("spread"),
        F.sum(p * (1 - p)).alias("own"),
        F.sum((F.col("n") - 1) * p * (1 - p)).alias("room"),
    ).first()  # one row of three sums
    if not row or not row["room"]:
        return 10.0
    rho = max((row["spread"] - row["own"]) / row["room"], 1e-9)
    return float(min(max((1 - rho) / rho, least), most))


def reputation(hosts: DataFrame, threshold: float = 0.6, z: float = 1.645) -> DataFrame:
    """hosts: (host, n outcomes, x bad).  Adds the posterior's a, b, lower bound and verdict."""
    hosts = hosts.select("host", "n", "x", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("x"), F.lit(0)).alias("x")).first()
    rate = (total["x"] + 1) / (total["n"] + 2)

    def shrunk(df: DataFrame, mean: Column, strength: float, name: str) -> DataFrame:
        return df.withColumn(name, (F.col("x") + strength * mean) / (F.col("n") + strength))

    k = _strength(suffixes, F.lit(rate))
    suffixes = shrunk(suffixes, F.lit(rate), k, "suffix_mean").select("suffix", "suffix_mean")
    domains = domains.join(suffixes, "suffix")
    k = _strength(domains, F.col("suffix_mean"))
    domains = shrunk(domains, F.col("suffix_mean"), k, "domain_mean").select("suffix", "domain", "domain_mean")
    hosts = hosts.join(domains, ["suffix", "domain"])
    k = _strength(hosts, F.col("domain_mean"))
    a, b = F.col("x") + k * F.col("domain_mean"), F.col("n") - F.col("x") + k * (1 - F.col("domain_mean"))
    hosts = hosts.withColumn("a", a).withColumn("b", b)
    deviation = F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) ** 2 * (F.col("a") + F.col("b") + 1)))
    hosts = hosts.withColumn("bound", F.col("a") / (F.col("a") + F.col("b")) - z * deviation)
    return hosts.select("host", "domain", "suffix", "n", "x", "a", "b", "bound", F.when(F.col("bound") > threshold, "block").otherwise("allow").alias("reputation"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = 0.6, z: float = 1.645) -> DataFrame:
    """pages: (page_id, url); outcomes: (page_id, bad 0 or 1).  One row for each page."""
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("bad").alias("x"))
    hosts = pages.join(seen, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("x"), F.lit(0)).alias("x"))
    judged = reputation(checkpointed(hosts), threshold, z).select("host", "reputation")
    rule = ruled(F.col("host"), F.col("path"), rules)
    return pages.join(judged, "host", "left").withColumn("r", rule).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.col("reputation")).alias("verdict"))


def op10_urls(spark, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document with its id: bad if its quality is 0."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 0).alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels)


def _two() -> str:
    return ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)


def _strength_sql(groups: str, mean: str) -> str:
    return f"""(SELECT CASE WHEN coalesce(sum((n - 1) * {mean} * (1 - {mean})), 0) = 0 THEN 10.0 ELSE
        least(greatest((1 - greatest((sum(n * (x / n - {mean}) ** 2) - sum({mean} * (1 - {mean}))) / sum((n - 1) * {mean} * (1 - {mean})), 1e-9))
        / greatest((sum(n * (x / n - {mean}) ** 2) - sum({mean} * (1 - {mean}))) / sum((n - 1) * {mean} * (1 - {mean})), 1e-9), 2.0), 1000.0) END AS k
        FROM {groups} WHERE n >= 2)"""


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE_SQL = f"""
WITH cut AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
upto AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^?#]*') AS u FROM cut),
p AS (SELECT page_id, translate(regexp_extract(u, '^[^/]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    u[length(regexp_extract(u, '^[^/]*')) + 1:] AS path FROM upto),
seen AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS x FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(x), 0) AS DOUBLE) AS x FROM p LEFT JOIN seen USING (page_id) GROUP BY host),
hl AS (SELECT *, string_split(host, '.') AS l FROM h0),
h1 AS (SELECT host, n, x,
    CASE WHEN array_to_string(l[-2:], '.') IN ({_two()}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix,
    CASE WHEN regexp_matches(host, '^[0-9.:]+$') THEN host WHEN array_to_string(l[-2:], '.') IN ({_two()}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM hl),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(x) AS x FROM h1 GROUP BY suffix, domain),
s0 AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM d0 GROUP BY suffix),
total AS (SELECT (sum(x) + 1) / (sum(n) + 2) AS rate FROM s0),
s1 AS (SELECT s0.*, rate FROM s0, total),
ks AS {_strength_sql("s1", "rate")},
s2 AS (SELECT suffix, (x + k * rate) / (n + k) AS m FROM s1, ks),
d1 AS (SELECT d0.*, m FROM d0 JOIN s2 USING (suffix)),
kd AS {_strength_sql("d1", "m")},
d2 AS (SELECT suffix, domain, (x + k * m) / (n + k) AS m FROM d1, kd),
h2 AS (SELECT h1.*, m FROM h1 JOIN d2 USING (suffix, domain)),
kh AS {_strength_sql("h2", "m")},
h3 AS (SELECT host, x + k * m AS a, n - x + k * (1 - m) AS b FROM h2, kh),
h4 AS (SELECT host, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) > 0.6 THEN 'block' ELSE 'allow' END AS reputation FROM h3),
rules AS (SELECT * FROM (VALUES {_RULE_ROWS}) AS r(h, rp, verdict)),
fit AS (SELECT page_id, host, path, h || rp AS rule, verdict,
    row_number() OVER (PARTITION BY host, path ORDER BY length(h || rp) DESC) AS k
    FROM (SELECT DISTINCT host, path, NULL AS page_id FROM p) q JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, rp))
SELECT p.page_id, p.host, p.path, fit.rule AS rule, coalesce(fit.verdict, reputation) AS verdict
FROM p LEFT JOIN h4 ON p.host = h4.host LEFT JOIN fit ON p.host = fit.host AND p.path = fit.path AND fit.k = 1
"""
