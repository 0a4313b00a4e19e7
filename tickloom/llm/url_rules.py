"""URL filters by listed rules and by association rules that Spark's FP-growth mines from labelled URLs.

All of it is DataFrame operations. URLs are reduced to tokens (host labels and path segments, digits as ``#``); URLs
of the same tokens are judged once. Mined rules are matched by an inverted index from tokens to rules: a rule fires
where as many of its tokens are found as it has.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import looked_up, written

#: (verdict, host, path prefix): fixed by the contract of op5.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for a null and where ``://`` is missing."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, PARTS, 1), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(text, PARTS, 2)


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls: its host or a subdomain, and the path's beginning."""
    rule = verdict = F.lit(None).cast("string")
    for kind, of, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a later one overrides
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(of + prefix)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens in order: ``h=`` each label of the host, ``p=`` each segment of the path."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.when(x != "", F.concat(F.lit("h="), x)))
    segments = F.transform(F.split(path, "/"), lambda x: F.when(x != "", F.concat(F.lit("p="), F.regexp_replace(x, "[0-9]+", "#"))))
    return F.array_sort(F.array_distinct(F.filter(F.concat(labels, segments), lambda x: x.isNotNull())))


def mine(labelled: DataFrame, support: float, confidence: float) -> DataFrame:
    """Rules (rule_id, antecedent, verdict, confidence, support) from rows (tokens, verdict).

    Kept are rules on the verdict that hold at least ``support`` of the rows and reach ``confidence``, of any
    number of tokens."""
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("v="), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    goal = F.element_at("consequent", 1)
    rules = model.associationRules.filter(goal.startswith("v="))
    ordered = F.array_sort("antecedent")
    return rules.select(F.concat_ws("\x1f", ordered, goal).alias("rule_id"), ordered.alias("antecedent"), F.substring(goal, 3, 1 << 20).alias("verdict"), "confidence", "support")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined) of distinct token arrays that a rule fits: the verdict of the most confident one; of equal ones
    that of the greater support, then of fewer tokens, then block before allow ('block' is the greater word)."""
    index = rules.select("rule_id", "verdict", "confidence", "support", F.size("antecedent").alias("n"), F.explode("antecedent").alias("token"))
    found = urls.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    fired = found.groupBy("tokens", "rule_id").agg(F.count("*").alias("hits"), *[F.first(c).alias(c) for c in ("n", "verdict", "confidence", "support")]).filter("hits = n")
    best = F.max(F.struct("confidence", "support", (-F.col("n")).alias("shorter"), "verdict"))
    return fired.groupBy("tokens").agg(best.alias("best")).select("tokens", F.col("best.verdict").alias("mined"))


def judge(pages: DataFrame, rules=RULES, support: float = 0.01, confidence: float = 0.8, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row.

    The rows that a listed rule fits are the labelled ones: association rules mined from them judge the others, and
    ``default`` those that no rule fits. support: share of the labelled rows; confidence: least share of a rule's rows
    with its verdict.

    A null url, and one without ``://``, has an empty host and path and gets the default. Null and repeated page_ids
    are judged row by row. An empty table, and one without labelled rows, needs no mining. Other columns are ignored.
    """
    host, path = url_parts(F.col("url"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    own = own.select("page_id", "host", "path", tokens(F.col("host"), F.col("path")).alias("tokens"), rule.alias("rule"), verdict.alias("listed"))
    labelled = own.filter("listed is not null").select("tokens", F.col("listed").alias("verdict"))
    # every distinct array once; counts tell which are frequent
    each = written(own.groupBy("tokens").agg(F.count("*").alias("n"), F.max(F.col("listed").isNull()).alias("asked")), "token-sets")
    rest = each.filter("asked").select("tokens")
    mined = match(rest, mine(labelled, support, confidence)) if not labelled.isEmpty() else rest.select("tokens", F.lit(None).cast("string").alias("mined")).limit(0)
    judged = each.select("tokens", "n").join(mined, "tokens", "left")
    found = looked_up(own, written(judged, "verdicts"), ["tokens"], "n")
    return found.select("page_id", "host", "path", "rule", F.coalesce("listed", "mined", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH own AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM own),
marked AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS listed,
         list_sort(list_distinct(list_concat(
           list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h=' || x),
           list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p=' || regexp_replace(x, '[0-9]+', '#', 'g'))))) AS tokens
  FROM ruled),
kinds AS (SELECT tokens, listed, count(*) AS n FROM marked WHERE listed IS NOT NULL GROUP BY ALL),
total AS (SELECT sum(n) AS n FROM kinds),
sets AS (
  SELECT list_value(x) AS antecedent, listed, n FROM (SELECT unnest(tokens) AS x, listed, n FROM kinds)
  UNION ALL
  SELECT list_value(a.x, b.x) AS antecedent, a.listed, a.n
  FROM (SELECT tokens, listed, n, unnest(tokens) AS x FROM kinds) a JOIN (SELECT tokens, listed, n, unnest(tokens) AS x FROM kinds) b
    ON a.tokens = b.tokens AND a.listed = b.listed AND a.x < b.x),
counted AS (SELECT antecedent, listed AS verdict, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY antecedent) AS of FROM sets GROUP BY antecedent, listed),
rules AS (
  SELECT antecedent, verdict, n::DOUBLE / of::DOUBLE AS confidence, n::DOUBLE / (SELECT n FROM total)::DOUBLE AS support
  FROM counted WHERE n >= ceil(0.01 * (SELECT n FROM total)) AND n::DOUBLE / of::DOUBLE >= 0.8),
rest AS (SELECT DISTINCT tokens FROM marked WHERE listed IS NULL),
mined AS (
  SELECT r.tokens, arg_max(u.verdict, (u.confidence, u.support, -len(u.antecedent), u.verdict)) AS mined
  FROM rest r JOIN rules u ON list_has_all(r.tokens, u.antecedent) GROUP BY r.tokens)
SELECT m.page_id, m.host, m.path, m.rule, coalesce(m.listed, d.mined, 'allow') AS verdict
FROM marked m LEFT JOIN mined d ON m.tokens = d.tokens
"""
