"""URL filter: gradient-boosted trees on lexical features and host suffix statistics."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
import pyspark.sql.functions as F

from kinfold.llm.common import cut, free_name, lowest, numbered, pick, position

LEXICAL = ("n_chars", "host_chars", "path_chars", "labels", "depth", "digit_ratio", "hyphens", "entropy", "params", "encoded", "fragment", "secure")
SUFFIXES = ("rate1", "rate2", "rate3", "seen2", "seen3")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a leading www., '' if there is none."""
    host = F.regexp_extract(F.trim(url), r"^(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.|\.$", "")


def suffix(host: Column, labels: int) -> Column:
    """The host's last labels, all of them where it has fewer."""
    return F.array_join(F.slice(F.reverse(F.slice(F.reverse(F.split(host, r"\.")), 1, labels)), 1, labels), ".")


def lexical(url: Column) -> dict[str, Column]:
    """Features of the URL's text alone; all are defined for any string, '' included."""
    u = F.trim(url)
    n = F.length(u)
    host = host_of(u)
    rest = F.regexp_replace(u, r"^(?i:[a-z][a-z0-9+.-]*:)?//[^/?#]*", "")
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    query = F.regexp_extract(rest, r"\?([^#]*)", 1)
    share = lambda c: F.try_divide((n - F.length(F.replace(u, c, F.lit("")))).cast("double"), n.cast("double"))
    letters = F.array_distinct(F.filter(F.split(u, ""), lambda c: c != ""))
    bits = F.aggregate(letters, F.lit(0.0), lambda s, c: s - F.coalesce(share(c) * F.log2(share(c)), F.lit(0.0)))
    return {
        "n_chars": n,
        "host_chars": F.length(host),
        "path_chars": F.length(path),
        "labels": F.size(F.split(host, r"\.")),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "digit_ratio": F.coalesce(F.try_divide(F.length(F.regexp_replace(u, "[^0-9]", "")).cast("double"), n), F.lit(0.0)),
        "hyphens": F.length(F.regexp_replace(u, "[^-]", "")),
        "entropy": bits,
        "params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
        "encoded": F.length(F.regexp_replace(u, "[^%]", "")),
        "fragment": u.contains("#").cast("int"),
        "secure": F.lower(u).startswith("https:").cast("int"),
    }


class UrlFilter:
    """A fitted model: trees, suffix counts of all labelled URLs and the base rate."""

    def __init__(self, model: GBTClassificationModel | None, stats: DataFrame | None, base: float):
        self.model, self.stats, self.base = model, stats, base


def _suffixes(df: DataFrame, stats: DataFrame, base: float, own: bool) -> DataFrame:
    """Adds each suffix's smoothed rate and count. `own`: the labelled URLs of the row's own host
    (host_bad, host_n) are left out, so that a rate says what other hosts of the suffix are like."""
    for k in (1, 2, 3):
        s = stats.where(F.col("k") == k).select(F.col("suffix").alias(f"s{k}"), F.col("bad").alias(f"b{k}"), F.col("n").alias(f"m{k}"))
        df = df.join(s, f"s{k}", "left")
        bad, n = F.coalesce(f"b{k}", F.lit(0.0)), F.coalesce(f"m{k}", F.lit(0.0))
        if own:
            bad, n = bad - F.col("host_bad"), n - F.col("host_n")
        df = df.withColumn(f"rate{k}", (bad + 4 * base) / (n + 4)).withColumn(f"seen{k}", F.log1p(n))
    return df


def _prepared(urls: DataFrame, *keep: str) -> DataFrame:
    host = host_of(F.col("url"))
    return urls.select(*keep, host.alias("host"), *[c.cast("double").alias(n) for n, c in lexical(F.col("url")).items()], *[suffix(host, k).alias(f"s{k}") for k in (1, 2, 3)])


def _labelled(labelled: DataFrame, url: str, label: str) -> DataFrame:
    """Distinct URLs with their label; a URL with two labels is bad if one is."""
    return pick(labelled, url=url, y=label).where("url IS NOT NULL AND y IS NOT NULL").groupBy("url").agg((F.max("y") > 0).cast("double").alias("label"))


def suffix_counts(hosts: DataFrame) -> DataFrame:
    """k, suffix, bad, n: labelled URLs by each of their hosts' suffixes, from counts by host."""
    long = hosts.select("host_bad", "host_n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), suffix(F.col("host"), k).alias("suffix")) for k in (1, 2, 3)])).alias("x"))
    return long.groupBy("x.k", "x.suffix").agg(F.sum("host_bad").alias("bad"), F.sum("host_n").alias("n"))


def train(labelled: DataFrame, url: str = "url", label: str = "bad", rows: int = 200_000, trees: int = 20, depth: int = 4, seed: int = 7) -> UrlFilter:
    """The model from labelled URLs (label > 0: bad).

    Counts by host suffix are over all of them. The trees are fitted to at most `rows` distinct
    ones, the lowest by hash: the documented bound of the training sample; a training URL's rates
    leave its own host out. NULL URLs and labels are left out; a URL with two labels is bad if one
    is. With one class or no rows the model is the base rate.
    """
    spark = labelled.sparkSession
    every = _labelled(labelled, url, label)
    hosts = cut(every.groupBy(host_of(F.col("url")).alias("host")).agg(F.sum("label").alias("host_bad"), F.count(F.lit(1)).cast("double").alias("host_n")))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_bad").alias("bad")).first()
    n, bad = total["n"] or 0.0, total["bad"] or 0.0
    base = bad / n if n else 0.0
    if not n or bad in (0.0, n):
        return UrlFilter(None, None, base)
    stats = cut(suffix_counts(hosts))
    # The sample is ordered by one task; the fit is spread over all of them.
    sample = lowest(every, "url", rows, int(n)).repartition(max(spark.sparkContext.defaultParallelism, 2), "url")
    full = _suffixes(_prepared(sample, "label").join(hosts, "host"), stats, base, True)
    ready = cut(VectorAssembler(inputCols=[*LEXICAL, *SUFFIXES], outputCol="features").transform(full).select("label", "features").repartition(max(spark.sparkContext.defaultParallelism, 2)))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, maxBins=64, cacheNodeIds=True).fit(ready)
    return UrlFilter(model, stats, base)


def held_out_auc(labelled: DataFrame, url: str = "url", label: str = "bad", part: float = 0.25, **how: int) -> float:
    """The chance that a bad URL scores above a good one, ties half, when both are of hosts that
    training didn't see: `part` of the hosts, chosen by hash. NaN if a class isn't among them."""
    d = _labelled(labelled, url, label)
    out = F.pmod(F.xxhash64(host_of(F.col("url")), F.lit(11)), F.lit(1000)) < int(1000 * part)
    model = train(d.where(~out), "url", "label", **how)
    by = url_scores(d.where(out), model).groupBy("bad_score").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n"))
    # Ranks by a running sum over distinct scores, of which trees have few.
    below = F.coalesce(F.sum(F.col("n") - F.col("bad")).over(Window.orderBy("bad_score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    r = by.withColumn("below", below).agg(F.sum(F.col("bad") * (F.col("below") + (F.col("n") - F.col("bad")) / 2)).alias("won"), F.sum("bad").alias("p"), F.sum(F.col("n") - F.col("bad")).alias("q")).first()
    return float(r["won"] / (r["p"] * r["q"])) if r["p"] and r["q"] else float("nan")


def url_scores(pages: DataFrame, model: UrlFilter, url: str = "url", reject: float = 0.5) -> DataFrame:
    """The table with `bad_score` and `bad` (score >= reject).

    One row for each row. A NULL URL has a NULL score and isn't bad; '' and malformed URLs are
    scored by their text. Columns that have the new names already stay; the new ones are then
    numbered. Empty table: no rows.
    """
    names = pages.columns
    new = free_name(names, "bad_score")
    flag = free_name([*names, new], "bad")
    cols = [f"__c{i}" for i in range(len(names))]
    rows = numbered(pages).withColumn("url", F.col(f"__c{position(pages, url)}"))
    if model.model is None:
        scored = rows.withColumn("score", F.lit(model.base))
    else:
        # Scores go by distinct URL: repeated ones are scored once, and NULL needs no features.
        distinct = rows.where("url IS NOT NULL").select("url").distinct()
        ready = _suffixes(_prepared(distinct, "url"), model.stats, model.base, False)
        full = VectorAssembler(inputCols=[*LEXICAL, *SUFFIXES], outputCol="features").transform(ready)
        each = model.model.transform(full).select("url", vector_to_array("probability")[1].alias("score"))
        scored = rows.join(each, "url", "left")
    score = F.when(F.col("url").isNotNull(), F.col("score"))
    return scored.select(*cols, score.alias("__score"), F.coalesce(score >= reject, F.lit(False)).alias("__bad")).toDF(*names, new, flag)
