"""URL filters: host rules, and gradient-boosted trees on lexical features for URLs that no rule fits."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.common import small, stored

#: (verdict, host and path); a list in the plan, so of bounded length.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MOST_RULES = 1000
#: The trees are fitted on at most so many URLs that a rule labels, those of least hash.
FIT_URLS = 20_000
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digits", "hyphens", "entropy", "params", "suffix_rate", "suffix_count"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#`` or the end. Both empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain and begins the path; null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, piece: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))).cast("double")


def features(urls: DataFrame) -> DataFrame:
    """Lexical features of (url, host, path), beside them."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.filter(F.array_distinct(F.split(url, "")), lambda c: c != ""), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    return urls.select(
        "*",
        F.length(url).cast("double").alias("length"), F.length("host").cast("double").alias("host_length"), F.length("path").cast("double").alias("path_length"),
        _count(F.col("path"), "/").alias("depth"), _count(F.col("host"), ".").alias("labels"), (F.length(F.regexp_replace(url, "[^0-9]+", "")) / n).alias("digits"),
        _count(F.col("host"), "-").alias("hyphens"), entropy.alias("entropy"), F.when(query == "", 0.0).otherwise(_count(query, "&") + 1).alias("params"),
        F.regexp_extract("host", "([^.]*)$", 1).alias("suffix"),
    )


def _quotas(kinds: dict[str, int], most: int) -> dict[str, int]:
    """How many of each verdict go into a sample of at most so many."""
    least = {k: min(n, most // 10) for k, n in kinds.items()}
    free, beyond = most - sum(least.values()), sum(kinds.values()) - sum(least.values())
    return {k: least[k] + ((n - least[k]) if beyond <= free else (n - least[k]) * free // beyond) for k, n in kinds.items()}


def judged(pages: DataFrame, *, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", seed: int = 11) -> DataFrame:
    """(id, host, path, rule, verdict, score) of each row: the verdict of the longest fitting rule, else block if the trees give at least 0.5.

    The URLs that rules fit are the labelled ones. Trees are fitted on a sample of at most FIT_URLS distinct ones, drawn
    from each verdict in proportion but at least a tenth if it has so many, with a suffix's smoothed share of blocked URLs
    and its count, both over all labelled rows, among the features. If the labelled rows lack one of the verdicts, URLs
    without a rule get the one that there is, or allow. score is the trees' probability of block.

    A null URL, or one without ``://``, has an empty host and path, no rule, and is judged by the trees. Repeated rows are
    rows of their own; clashing columns are not read. An empty table gives none.
    """
    url = F.col(f"`{url_col}`")
    host, path = host_and_path(url)
    named = pages.select(F.col(f"`{id_col}`").alias("id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = features(named.select("*", rule.alias("rule"), verdict.alias("verdict")))
    label = (F.col("verdict") == "block").cast("double")
    labelled = named.select("*", verdict.alias("verdict")).where("verdict is not null")
    rates = stored(labelled.groupBy(F.regexp_extract("host", "([^.]*)$", 1).alias("suffix")).agg(((F.sum(label) + 1) / (F.count(F.lit(1)) + 2)).alias("suffix_rate"), F.log1p(F.count(F.lit(1))).alias("suffix_count")))
    beside = small(rates)
    whole = lambda df: df.join(beside, "suffix", "left").fillna({"suffix_rate": 0.5, "suffix_count": 0.0})
    single = stored(labelled.select("url", "host", "path", "verdict").distinct())
    kinds = {r.verdict: r["count"] for r in single.groupBy("verdict").count().collect()}
    parts = [single.where(F.col("verdict") == k).orderBy(F.xxhash64("url"), "url").limit(n) for k, n in sorted(_quotas(kinds, FIT_URLS).items())]
    fit_on = stored(features(reduce(DataFrame.union, parts)).withColumn("label", label).coalesce(2)) if parts else None
    if len(kinds) < 2:
        out = ruled.withColumn("score", F.lit(1.0 if "block" in kinds else 0.0))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
        trees = GBTClassifier(maxIter=12, maxDepth=4, maxBins=64, stepSize=0.3, seed=seed).fit(vectors.transform(whole(fit_on)))
        out = trees.transform(vectors.transform(whole(ruled))).withColumn("score", vector_to_array("probability")[1])
    said = F.coalesce("verdict", F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("id", "host", "path", "rule", said.alias("verdict"), "score")


def op5_urls(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("id", "page_id")
