"""URL filters with empirical-Bayes host reputation.

Listed rules decide the urls they fit, the longest rule first. What they decide serves as
labelled outcomes (block is 1) for the reputation of hosts, which decides the rest. A rate
is shrunk from level to level: the suffix towards the rate of all outcomes, the registered
domain towards its suffix, the host towards its domain. Each level's beta-binomial prior
has the mean of the level above and a strength estimated from how much more its groups
vary than binomial draws would (method of moments). A host without outcomes has its
domain's prior. A url is blocked if the lower bound of the posterior, mean less Z standard
deviations, is above LIMIT.

Reputation belongs to a site: the host without user part, port and last dot. A site that is
an address (IPv4, or IPv6 in brackets) is its own domain, below the suffix `address`.
Otherwise the suffix is the last label, or the last two where the last is a country's (two
letters) and the one before is one of SECOND_LEVEL, as in `co.uk`; the registered domain has
one label more (a site without one is its own domain). Counts are summed before any shuffle,
so a host with a third of the urls is one row of each task. Each level is stored and
summed once; overall rate and strengths are single numbers. Sites' verdicts join back by
broadcast while their measured bytes are few; beyond that, those of the most frequent
sites still do, so no site is one task's.

Urls of any length are read whole; equal urls are judged each. Null urls, and those without `://`, have an empty host and path, fit no rule, and get the
verdict of the empty host. Rows are neither merged nor dropped; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textframe.llm._common import fits, hot_keys, spread_join, stored

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
Z = 1.645
LIMIT = 0.5
#: Labels that stand for a kind of registrant below a country's label: a fixed list, to be changed where more is known.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc")
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path)"""
    of = lambda i: F.coalesce(F.regexp_extract(url_col, _PARTS, i), F.lit(""))
    host = F.translate(of(1), string.ascii_uppercase, string.ascii_lowercase)
    return pages.select(F.col(id_col).alias("page_id"), host.alias("host"), of(2).alias("path"))


def _rule(rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does."""
    out = F.lit(None)
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(f"{host}{path}").alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


_ADDRESS = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[.*\])$"
_SECOND = rf"(?:^|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})$"


def site(host: Column) -> Column:
    """A host without user part, port and last dot."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$|\.$|\.:[0-9]*$", "")


def levels(of: str = "site") -> dict[str, Column]:
    address, second = F.col(of).rlike(_ADDRESS), F.regexp_extract(of, _SECOND, 1)
    suffix = F.when(address, "address").when(second != "", second).otherwise(F.substring_index(of, ".", -1))
    domain = F.when(address, F.col(of)).when(second != "", F.substring_index(of, ".", -3)).otherwise(F.substring_index(of, ".", -2))
    return {"suffix": suffix, "domain": domain}


def _strength(k: str, n: str, mean: str) -> Column:
    """A prior's strength from groups of n outcomes, k of them ones, whose means would be `mean` without variation."""
    k, n, m = F.col(k), F.col(n), F.col(mean)
    spread = m * (1 - m)
    over = F.sum(F.when(n > 0, (k - n * m) * (k - n * m) / n - spread))
    most = F.sum(F.when(n > 0, (n - 1) * spread))
    rho = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.coalesce(F.when(most > 0, over / most), F.lit(0.01))))
    return 1 / rho - 1


def reputation(outcomes: DataFrame) -> DataFrame:
    """(site, mean, low): posterior of each site. outcomes: a stored row for each site, with n outcomes and k ones."""
    sites = stored(outcomes.select("site", "n", "k", *(c.alias(name) for name, c in levels().items())), "sites")
    domains = stored(sites.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
    every = suffixes.agg(((F.sum("k") + 0.5) / (F.sum("n") + 1)).alias("m")).first()["m"] or 0.5

    def shrunk(level: DataFrame, key: str, out: str) -> DataFrame:
        """The level's posterior means; level: with the mean `m` of the one above."""
        kappa = F.lit(level.agg(_strength("k", "n", "m").alias("kappa")).first()["kappa"])
        a = F.col("k") + kappa * F.col("m")
        return level.select(key, (a / (F.col("n") + kappa)).alias(out), (F.col("n") + kappa).alias("total"))

    def below(level: DataFrame, above: DataFrame, key: str) -> DataFrame:
        """level with the mean of the level above it. Keys that many groups have are not one task's."""
        if fits(above):
            return stored(level.join(F.broadcast(above), key), f"with-{key}")
        sizes = stored(level.groupBy(key).agg(F.count(F.lit(1)).alias("groups")), f"sizes-{key}")
        return stored(spread_join(level, above, key, hot_keys(sizes, key, "groups"), "inner"), f"with-{key}")

    suffixes = stored(shrunk(suffixes.withColumn("m", F.lit(every)), "suffix", "m").select("suffix", "m"), "suffix-means")
    domains = stored(shrunk(below(domains, suffixes, "suffix"), "domain", "m").select("domain", "m"), "domain-means")
    mean = F.col("mean")
    return shrunk(below(sites, domains, "domain"), "site", "mean").select("site", "mean", (mean - Z * F.sqrt(mean * (1 - mean) / (F.col("total") + 1))).alias("low"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability) for each row of pages."""
    rows = parts(pages, id_col, url_col).withColumns({"by": _rule(rules), "site": site(F.col("host"))})
    decided = F.col("by").isNotNull()
    sums = rows.groupBy("site").agg(F.count_if(decided).alias("n"), F.count_if(decided & (F.col("by.verdict") == "block")).alias("k"), F.count(F.lit(1)).alias("urls"))
    sums = stored(sums, "outcomes")
    known = stored(reputation(sums), "reputation")
    if fits(known):
        rows = rows.join(F.broadcast(known), "site")
    else:
        rows = spread_join(rows, known, "site", hot_keys(sums, "site", "urls"), "inner")
    verdict = F.coalesce(F.col("by.verdict"), F.when(F.col("low") > LIMIT, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("by.rule").alias("rule"), verdict.alias("verdict"), F.col("mean").alias("block_probability"))


def report(pages: DataFrame) -> DataFrame:
    """What op10 returns."""
    return judge(pages).drop("block_probability")


SQL = rf"""
WITH u AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM u),
v AS (SELECT *, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS given FROM r),
w AS (SELECT *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$|\.$|\.:[0-9]*$', '') AS site FROM v),
g AS (SELECT site, count(given) AS n, count(*) FILTER (given = 'block') AS k, regexp_extract(site, '{_SECOND}', 1) AS second,
    regexp_matches(site, '{_ADDRESS}') AS address FROM w GROUP BY site),
h AS (SELECT site, n, k, CASE WHEN address THEN 'address' WHEN second <> '' THEN second ELSE regexp_extract(site, '[^.]*$') END AS suffix,
    CASE WHEN address THEN site WHEN second <> '' THEN regexp_extract(site, '([^.]*\.)?[^.]*\.[^.]*$')
         WHEN contains(site, '.') THEN regexp_extract(site, '[^.]*\.[^.]*$') ELSE site END AS domain FROM g),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
e AS (SELECT (sum(k) + 0.5) / (sum(n) + 1) AS m FROM s),
ks AS (SELECT 1 / least(0.99, greatest(0.01, coalesce(sum(CASE WHEN n > 0 THEN (k - n * m) * (k - n * m) / n - m * (1 - m) END) / nullif(sum(CASE WHEN n > 0 THEN (n - 1) * m * (1 - m) END), 0), 0.01))) - 1 AS kappa FROM s, e),
s2 AS (SELECT suffix, (k + kappa * m) / (n + kappa) AS m FROM s, e, ks),
d1 AS (SELECT d.*, s2.m FROM d JOIN s2 USING (suffix)),
kd AS (SELECT 1 / least(0.99, greatest(0.01, coalesce(sum(CASE WHEN n > 0 THEN (k - n * m) * (k - n * m) / n - m * (1 - m) END) / nullif(sum(CASE WHEN n > 0 THEN (n - 1) * m * (1 - m) END), 0), 0.01))) - 1 AS kappa FROM d1),
d2 AS (SELECT domain, (k + kappa * m) / (n + kappa) AS m FROM d1, kd),
h1 AS (SELECT h.*, d2.m FROM h JOIN d2 USING (domain)),
kh AS (SELECT 1 / least(0.99, greatest(0.01, coalesce(sum(CASE WHEN n > 0 THEN (k - n * m) * (k - n * m) / n - m * (1 - m) END) / nullif(sum(CASE WHEN n > 0 THEN (n - 1) * m * (1 - m) END), 0), 0.01))) - 1 AS kappa FROM h1),
p AS (SELECT site, (k + kappa * m) / (n + kappa) AS mean, n + kappa AS total FROM h1, kh),
q AS (SELECT site, mean - 1.645 * sqrt(mean * (1 - mean) / (total + 1)) AS low FROM p)
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM w JOIN q USING (site)
"""
