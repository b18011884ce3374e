"""URL filters: rules on hosts and paths, and association rules mined from labelled URLs.

Everything runs in Spark's own operators; FP-growth is Spark's.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, rule); a rule is a host, a slash and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://`, up to `/`, `?`, `#` or the end; A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # the longest last, so outermost
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct parts: h:<host label>, p:<word of the path>, q:<name of a query field>. Digits become 0."""
    host, path = host_of(url), path_of(url)
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    parts = lambda c, by, tag: F.transform(F.filter(F.split(F.regexp_replace(c, r"\d+", "0"), by), lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    names = F.regexp_replace(query, r"=[^&]*", "")
    return F.array_distinct(F.concat(parts(host, r"[.-]", "h:"), parts(path, r"[^A-Za-z0-9]+", "p:"), parts(names, "&", "q:")))


def lower_bound(share: Column, n: Column, z: float) -> Column:
    """The lower end of Wilson's interval for a share seen in n rows; z standard deviations wide."""
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine_rules(labelled: DataFrame, *, min_support: float = 0.0005, min_count: int = 8, min_confidence: float = 0.5, min_lift: float = 2.0, z: float = 2.0) -> DataFrame:
    """Rules (rule_id, tokens, confidence, support) for bad URLs from (url, bad boolean).

    FP-growth mines token combinations. Those stay that imply the label in at least `min_count` rows
    and the share `min_support` of all, with at least `min_confidence`, and whose confidence is, by
    the lower end of its interval of width `z`, `min_lift` times the share of bad rows at least. Of
    rules whose tokens contain those of another one, that other alone stays. Rows with a null url or
    label are left out; rows of one url count each.
    """
    good = labelled.where("url is not null and bad is not null")
    rows = good.select(F.when(F.col("bad"), F.array_append(url_tokens(F.col("url")), BAD)).otherwise(url_tokens(F.col("url"))).alias("items"), "bad")
    seen = rows.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    spark, n = labelled.sparkSession, seen["n"]
    if not seen["bad"]:
        return spark.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double")
    share = max(min_support, min_count / n)
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, share), minConfidence=min_confidence).fit(rows.select("items")).associationRules
    surely = lower_bound(F.col("confidence"), F.col("support") * n / F.col("confidence"), z) >= min_lift * seen["bad"] / n
    kept = found.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == BAD) & surely).select(F.sort_array("antecedent").alias("tokens"), "confidence", "support")
    kept = kept.select(F.xxhash64("tokens").alias("rule_id"), "*")
    # of rules whose tokens contain those of another, the other alone is kept; found by shared tokens
    one = kept.select(F.col("rule_id").alias("big"), F.explode("tokens").alias("t"), F.size("tokens").alias("n_big"))
    two = kept.select(F.col("rule_id").alias("small"), F.explode("tokens").alias("t"), F.size("tokens").alias("n_small"))
    inside = one.join(two, "t").where("n_small < n_big").groupBy("big", "small", "n_small").count().where("count = n_small").select(F.col("big").alias("rule_id")).distinct()
    return kept.join(inside, "rule_id", "left_anti")


def matching_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls that hold all tokens of a rule, by an index from each rule's rarest token."""
    urls = pages.where("url is not null").select("url").distinct().select("url", url_tokens(F.col("url")).alias("have"))
    each = urls.select("url", "have", F.explode("have").alias("t"))
    often = each.groupBy("t").agg(F.count("*").alias("f"))
    key = rules.select("rule_id", "tokens", F.explode("tokens").alias("t")).join(often, "t").groupBy("rule_id", "tokens").agg(F.min_by("t", F.struct("f", "t")).alias("t"))
    return each.join(key, "t").where(F.size(F.array_except("tokens", "have")) == 0).select("url").distinct()


def filter_urls(pages: DataFrame, labelled: DataFrame, *, rules=RULES, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url).

    The longest fixed rule that fits decides. Where none does, a URL is blocked if it matches a mined
    rule and allowed otherwise. Null urls and those without `://` have empty host and path and are
    allowed. Rows are kept one for one, repeated and null ids too; other columns are ignored.
    """
    mined = mine_rules(labelled, **mining)
    bad = matching_urls(pages, mined).select("url", F.lit(True).alias("mined"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    out = pages.select("page_id", "url").join(bad, "url", "left").select("page_id", host.alias("host"), path.alias("path"), "mined")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"))
