"""URL filter: fixed rules, then empirical-Bayes reputation of hosts.

Labelled pages (a label's doc_id being the page's id) are good or bad; good
means quality 1 and not toxic. Rates of good pages are shrunk down a chain of
beta-binomial priors: a host's prior is its registered domain's posterior mean,
a domain's is its suffix's, a suffix's is the rate of all pages. The strength of
each level's prior is estimated from the pages themselves: the intraclass
correlation of the units at that level (analysis of variance estimator) gives
the prior's weight in pages. A page is allowed if the lower posterior bound of
its host, mean - z x standard deviation, is at least ``LEAST``.

Only counts by host are shuffled; hosts, domains and suffixes meet in equi-joins
on tables with a row for each of them.

Defined results: a null url, or one without ``://``, has an empty host and path,
which is a host like any other. Pages with a null or repeated id are judged like
others. Null labels count as not good if the other label is bad, else not at
all; a label's repeats are one (the least of each). Without labelled pages every
rate is one half with a weak prior. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
# Public suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "gov.uk", "net.au", "or.jp", "org.au", "org.uk")
#: Standard deviations below the mean, least bound to allow, and the bounds of a prior's weight in pages.
Z, LEAST, WEIGHTS = 1.645, 0.55, (1.0, 1000.0)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def domain_of(host: Column) -> Column:
    """The suffix and one label more; a host of fewer labels is its own domain."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def outcomes(labels: DataFrame) -> DataFrame:
    """``id, good`` of labelled pages."""
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    good = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 0).when((F.col("quality") == 1) & (F.col("toxic") == 0), 1)
    return one.select(F.col("doc_id").alias("id"), good.alias("good")).where("good is not null")


def _weight(units: DataFrame) -> float:
    """The weight, in pages, of a beta prior over the rates of ``units(n, y)``."""
    p = F.col("y") / F.col("n")
    n = F.col("n").cast("double")
    got = units.where("n > 0").agg(F.count("*"), F.sum(n), F.sum(F.col("y").cast("double")), F.sum(n * n), F.sum(n * p * p), F.sum(n * p * (1 - p))).first()
    k, pages, y, squares, square_rates, inner = got
    if k < 2 or pages <= k:
        return WEIGHTS[1] if k else WEIGHTS[0]
    between = max(0.0, square_rates - y * y / pages) / (k - 1)
    within = inner / (pages - k)
    size = (pages - squares / pages) / (k - 1)
    low = between + (size - 1) * within
    rho = (between - within) / low if low > 0 else 0.0
    return min(WEIGHTS[1], max(WEIGHTS[0], (1 - rho) / rho)) if rho > 0 else WEIGHTS[1]


def reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``host, domain, suffix, n, y, mean, sd, bound`` for each host of ``pages(page_id, url)``."""
    page = pages.select(F.col("page_id").alias("id"), host_of(F.col("url")).alias("host"))
    marked = page.join(outcomes(labels), "id", "left")
    hosts = marked.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("y"))
    hosts = materialise(hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "y"), "hosts")
    domains = materialise(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y")), "domains")
    suffixes = materialise(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y")), "suffixes")
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("y"), F.lit(0))).first()
    rate = total[1] / total[0] if total[0] else 0.5

    def shrunk(prior: Column, weight: float) -> Column:
        return (prior * weight + F.col("y")) / (F.col("n") + weight)

    top = suffixes.select("suffix", shrunk(F.lit(rate), _weight(suffixes)).alias("suffix_mean"))
    mid = domains.join(top, "suffix").select("domain", "suffix", shrunk(F.col("suffix_mean"), _weight(domains)).alias("domain_mean"))
    weight = _weight(hosts)
    own = hosts.join(mid, ["domain", "suffix"]).withColumn("mean", shrunk(F.col("domain_mean"), weight))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + weight + 1))
    return own.withColumn("sd", sd).withColumn("bound", F.col("mean") - Z * F.col("sd")).drop("domain_mean")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, least: float = LEAST) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``."""
    known = materialise(reputation(pages, labels).select("host", F.when(F.col("bound") >= least, "allow").otherwise("block").alias("by_host")), "reputation")
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    return split.join(small(known), "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("by_host")).alias("verdict"))


def keep_allowed(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, least: float = LEAST) -> DataFrame:
    """``pages`` that are allowed, all columns unchanged."""
    known = materialise(reputation(pages, labels).select("host", (F.col("bound") >= least).alias("fine")), "reputation")
    row = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("r"))
    _, verdict = ruled(F.col("host"), F.col("path"), rules)
    fine = F.coalesce(verdict == "allow", F.col("fine"))
    return row.join(small(known), "host").where(fine).select("r.*")


def sql() -> str:
    fits = lambda name, start: f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}')"
    longest = sorted(RULES, key=lambda r: (len(r[1] + r[2]), len(r[1])), reverse=True)
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in longest)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in longest)
    two = "(" + ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES) + ")"
    weight = lambda t: f"""(SELECT CASE WHEN k = 0 THEN {WEIGHTS[0]} WHEN k < 2 OR pages <= k THEN {WEIGHTS[1]}
        ELSE (SELECT CASE WHEN rho > 0 THEN least({WEIGHTS[1]}, greatest({WEIGHTS[0]}, (1 - rho) / rho)) ELSE {WEIGHTS[1]} END
              FROM (SELECT CASE WHEN b + (s - 1) * w > 0 THEN (b - w) / (b + (s - 1) * w) ELSE 0 END AS rho
                    FROM (SELECT greatest(0, sr - y * y / pages) / (k - 1) AS b, inn / (pages - k) AS w, (pages - sq / pages) / (k - 1) AS s))) END
        FROM (SELECT count(*) AS k, sum(n * 1.0::DOUBLE) AS pages, sum(y * 1.0::DOUBLE) AS y, sum(n * n * 1.0::DOUBLE) AS sq,
                     sum(y * 1.0::DOUBLE * y / n) AS sr, sum(y * 1.0::DOUBLE * (n - y) / n) AS inn FROM {t} WHERE n > 0))"""  # noqa: E731
    return f"""
    WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
                      coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages),
    o1 AS (SELECT doc_id, min(quality) AS q, min(toxic) AS t FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    o AS (SELECT * FROM (SELECT doc_id, CASE WHEN q = 0 OR t = 1 THEN 0 WHEN q = 1 AND t = 0 THEN 1 END AS good FROM o1) WHERE good IS NOT NULL),
    l AS (SELECT host, string_split(host, '.') AS p, count(good) AS n, coalesce(sum(good), 0) AS y FROM u LEFT JOIN o ON o.doc_id = u.page_id GROUP BY host),
    l2 AS (SELECT *, array_to_string(p[-2:], '.') AS two FROM l),
    h AS (SELECT host, n, y, CASE WHEN two IN {two} THEN array_to_string(p[-3:], '.') ELSE two END AS domain,
                 CASE WHEN two IN {two} THEN two ELSE p[-1] END AS suffix FROM l2),
    d AS (SELECT domain, suffix, sum(n) AS n, sum(y) AS y FROM h GROUP BY domain, suffix),
    s AS (SELECT suffix, sum(n) AS n, sum(y) AS y FROM d GROUP BY suffix),
    w AS (SELECT {weight('s')} AS ws, {weight('d')} AS wd, {weight('h')} AS wh, (SELECT coalesce(sum(y) * 1.0::DOUBLE / nullif(sum(n), 0), 0.5) FROM s) AS rate),
    sm AS (SELECT suffix, (rate * ws + y) / (n + ws) AS m FROM s, w),
    dm AS (SELECT domain, suffix, (sm.m * wd + y) / (n + wd) AS m FROM d JOIN sm USING (suffix), w),
    hm AS (SELECT host, (dm.m * wh + y) / (n + wh) AS m, n + wh + 1 AS size FROM h JOIN dm USING (domain, suffix), w),
    v AS (SELECT host, CASE WHEN m - {Z} * sqrt(m * (1 - m) / size) >= {LEAST} THEN 'allow' ELSE 'block' END AS by_host FROM hm)
    SELECT page_id, host, path, CASE {rule} END AS rule, coalesce(CASE {verdict} END, by_host) AS verdict FROM u JOIN v USING (host)"""
