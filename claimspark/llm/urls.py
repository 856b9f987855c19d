"""URL filters: rules, and host reputation shrunk from host to registered domain to suffix.

Labelled pages give each host some good and bad outcomes. A beta-binomial prior at each level is
fitted to the level above it: a suffix leans to the whole web, a domain to its suffix, a host
to its domain, by as much as siblings are alike. A page is blocked where even the lower bound of its
host's posterior bad rate is above the limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import table
from claimspark.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
LIMIT = 0.5            # of the bad rate
Z = 1.645              # one-sided 95 %
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0     # of a prior, in pages

Rule = tuple[str, str]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column, suffixes: Sequence[str] = ()) -> Column:
    """Registered domain: one label more than the suffix. ``suffixes`` lists those of several labels."""
    labels = F.split(host, r"\.")
    n = F.lit(2)
    for s in sorted(suffixes, key=len):
        n = F.when(F.concat(F.lit("."), host).endswith("." + s), F.lit(s.count(".") + 2)).otherwise(n)
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n), ".")


def suffix_of(domain: Column) -> Column:
    """A registered domain without its first label; a single label is its own suffix."""
    return F.when(F.instr(domain, ".") > 0, F.regexp_replace(domain, r"^[^.]*\.", "")).otherwise(domain)


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; NULL where none does.

    A rule is host and path in one string. It fits its host and all subdomains, where the path starts with the rule's.
    """
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        text, action = F.when(fits, rule).otherwise(text), F.when(fits, verdict).otherwise(action)
    return text, action


def _level(children: DataFrame) -> DataFrame:
    """Add ``strength`` and ``rate``, the posterior mean, to rows of ``n, bad, prior``.

    The prior's strength is one figure for the level, by moments: the spread of the children's rates
    about their priors beyond what binomial chance explains.
    """
    n, m = F.col("n"), F.col("prior")
    some = n > 0
    chance = F.sum(F.when(some, m * (1 - m)))
    spread = F.sum(F.when(some, n * (F.col("bad") / n - m) * (F.col("bad") / n - m)))
    between = F.sum(F.when(some, (n - 1) * m * (1 - m)))
    fitted = F.least(F.lit(MOST_STRENGTH), F.greatest(F.lit(LEAST_STRENGTH), between / (spread - chance) - 1))
    strength = children.agg(F.coalesce(F.when(spread > chance, fitted), F.lit(MOST_STRENGTH))).first()[0]
    return children.withColumn("strength", F.lit(float(strength))).withColumn(
        "rate", (F.col("bad") + m * F.col("strength")) / (n + F.col("strength"))
    )


def host_reputation(counts: DataFrame, suffixes: Sequence[str] = (), z: float = Z) -> DataFrame:
    """Add ``rate`` and ``bound`` to ``host, n, bad``: labelled pages and bad ones among them, a row per host.

    ``rate`` is the posterior mean, ``bound`` lies ``z`` posterior deviations below it. A host without
    labels gets its domain's rate.
    """
    hosts = materialise(
        counts.select("host", "n", "bad", domain_of(F.col("host"), suffixes).alias("domain"))
        .withColumn("suffix", suffix_of(F.col("domain"))),
        "hosts",
    )
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)
    counted = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = hosts.groupBy("suffix").agg(*counted).withColumn("prior", F.lit(overall))
    suffix = _level(by_suffix)
    domain = _level(
        hosts.groupBy("domain", "suffix").agg(*counted)
        .join(suffix.select("suffix", F.col("rate").alias("prior")), "suffix")
    )
    host = _level(hosts.join(domain.select("domain", F.col("rate").alias("prior")), "domain"))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("strength") + 1))
    return host.select("host", "n", "bad", "rate", F.greatest(F.lit(0.0), F.col("rate") - z * deviation).alias("bound"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule] = RULES,
    limit: float = LIMIT,
    suffixes: Sequence[str] = (),
) -> DataFrame:
    """``page_id, host, path, rule, verdict, rate, bound`` of every row of ``pages`` (``page_id, url``).

    ``outcomes``: ``page_id, bad`` (1 or 0), of labelled pages; several labels of a page all count.
    A rule decides first, else the host's posterior bound. A NULL url, or one without ``://``, has an empty
    host and path; the empty host is judged like any other. NULL ids and NULL outcomes carry no label.
    Repeated rows are judged alike. An empty table gives no rows; no labels block nothing beyond the rules.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = (
        outcomes.where("bad is not null").groupBy("page_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("bad").cast("bigint").alias("_bad"))
    )
    counts = read.select("page_id", "host").join(labels, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad")
    )
    known = materialise(host_reputation(counts, suffixes), "reputation").select("host", "rate", "bound")
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return read.join(known, "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict"), "rate", "bound"
    )


DOC_NUMBER = r"/([0-9]{1,18})(?:[.][a-z]+)?/?$"


def op1_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled through the document that its url names; bad: toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    named = pages.select("page_id", F.try_to_number(F.regexp_extract(path_of(F.col("url")), DOC_NUMBER, 1), F.lit("9" * 18)).cast("bigint").alias("doc_id"))
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    outcomes = named.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")
    return judge(pages, outcomes).select(
        "page_id", "host", "path", "rule", "verdict", F.round("rate", 6).alias("bad_rate"), F.round("bound", 6).alias("bad_bound")
    )


def _level_sql(name: str, rows: str) -> str:
    some = "CASE WHEN n > 0 THEN {} END".format
    spread, chance = f"sum({some('n * (bad / n - prior) * (bad / n - prior)')})", f"sum({some('prior * (1 - prior)')})"
    return f"""
{name}_rows AS ({rows}),
{name}_fit AS (
  SELECT coalesce(CASE WHEN {spread} > {chance}
           THEN least({MOST_STRENGTH}, greatest({LEAST_STRENGTH}, sum({some('(n - 1) * prior * (1 - prior)')}) / ({spread} - {chance}) - 1)) END,
         {MOST_STRENGTH})::DOUBLE AS strength FROM {name}_rows
),
{name}_level AS (SELECT *, (bad + prior * strength) / (n + strength) AS rate FROM {name}_rows, {name}_fit)"""


SQL = f"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), o AS (
  SELECT page_id, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
  FROM p JOIN labels l ON l.doc_id = try_cast(regexp_extract(path, '{DOC_NUMBER}', 1) AS BIGINT)
  WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY page_id
), h AS (
  SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad,
         array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain
  FROM p LEFT JOIN o USING (page_id) GROUP BY host
), hs AS (
  SELECT *, CASE WHEN contains(domain, '.') THEN regexp_replace(domain, '^[^.]*\\.', '') ELSE domain END AS suffix FROM h
),
{_level_sql('s', "SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(prior) AS prior FROM hs, (SELECT (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1) AS prior FROM hs) GROUP BY suffix")},
{_level_sql('d', "SELECT hs.domain, sum(hs.n) AS n, sum(hs.bad) AS bad, any_value(s_level.rate) AS prior FROM hs JOIN s_level USING (suffix) GROUP BY hs.domain")},
{_level_sql('h', "SELECT hs.host, hs.n, hs.bad, d_level.rate AS prior FROM hs JOIN d_level USING (domain)")},
b AS (
  SELECT host, rate, greatest(0, rate - {Z}::DOUBLE * sqrt(rate * (1 - rate) / (n + strength + 1))) AS bound FROM h_level
), r AS (
  SELECT p.*, b.rate, b.bound,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p JOIN b USING (host)
)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
            WHEN 'org/fr/' THEN 'allow' ELSE CASE WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END END AS verdict,
       round(rate, 6) AS bad_rate, round(bound, 6) AS bad_bound
FROM r
"""
