"""URL filters: rules first, then gradient-boosted trees on lexical features.

Features are lengths, depth, digit ratio, entropy, numbers of parameters and
hyphens, and the share of bad URLs of the host's suffix in the labelled table.
The labelled table is small and made from lists of host names and forms of
paths; it is fitted with Spark's gradient-boosted trees and applied where the
URLs are. Rules are a short list in the code; the longest that fits wins.

Defined cases: a null url or one without ``://`` has an empty host and path,
fits no rule and is judged by its features; urls of any length are read whole;
equal rows are judged alike; an empty table gives an empty result; other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm.words import utf8

#: Host, path and verdict of the rules.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

GOOD_HOSTS = ["library", "cityhall", "riverside", "museum", "gardenia", "openscience", "kitchen", "northwind",
              "weather", "astronomy", "chronicle", "botanica", "harbour", "theatre", "meadow", "teacher",
              "thornton", "whitehouse", "antonia", "national", "elementary", "orchestra", "interior", "ancient",
              "radio4", "route66", "university", "parliament"]
BAD_HOSTS = ["cheap-loans", "win-casino", "free-pills", "best-bets", "ad-tracker", "spam-mail", "hot-singles",
             "x-videos24", "buy-followers", "click-ads", "fast-cash", "lucky-slots", "porn-x", "banner-farm",
             "pills-4-u", "bet-now", "crypto-win", "sale-outlet88", "link-farm", "pop-ads", "track-click",
             "vip-casino", "weight-loss", "viagra-shop",
             "casino777", "bets4u24", "xxx-tube", "free-movies-hd"]
# Good hosts with hyphens or digits, and bad ones without: no single feature tells the classes apart.
GOOD_MARKED = ["rolls-royce", "saint-gobain", "harley-davidson", "aix-en-provence", "stratford-upon-avon", "rhein-main",
               "mercedes-benz", "north-west", "studio54", "open-data", "a1-museum", "baden-baden"]
BAD_PLAIN = ["onlinecasino", "luckyslots", "fastcash", "hotsingles", "viagrashop", "moviesfree", "betnow", "cryptowin",
             "buyfollowers", "adclicks", "dietpills", "spamhaven"]
GOOD_SUFFIXES = ["example.com", "example.org", "example.net", "com", "info", "de", "edu", "org"]
MARKED_SUFFIXES = ["com", "org", "de", "fr", "co.uk", "edu"]
BAD_SUFFIXES = ["example.net", "info", "xyz", "net", "click", "top", "biz"]
GOOD_PATHS = ["/en/{n}", "/fr/{n}.html", "/de/{n}/", "/{n}?utm_source=feed", "/a/b/{n}?page=2&ref=x", "/es/{n}#top", "/",
              "/news/2019/05/{n}.html", "/x/{n}.html"]
BAD_PATHS = ["/en/{n}", "/x/{n}", "/win/{n}.html", "/buy?id={n}&aff=3&sub=x&c=9", "/go/{n}/a/b/c/d/offer.php",
             "/?s=a8f{n}k29zq&u=1&r=2", "/{n}"]
PLAIN_PATHS = ["/buy?x={n}&y=2&z=3", "/bonus/{n}/play/now/free/win/?ref=1&u={n}&k=2", "/t/9f{n}b7c6d5e4f3a2/?a=1&b=2&c=3",
               "/{n}{n}{n}{n}.php?k=1&s=2&aff=9", "/r?u={n}&go=1&cid=77&src=pop"]
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "entropy",
            "params", "hyphens", "suffix_bad"]


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A to Z in lower case, and path."""
    whole = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(whole, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(whole, pattern, 2)


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _entropy(text: pd.Series) -> pd.Series:
    """Bits per byte of each text's own byte frequencies."""
    import pyarrow as pa

    data, at = utf8(pa.array(text, pa.string()))
    out = np.zeros(len(text))
    for i, (s, e) in enumerate(zip(at[:-1], at[1:])):
        p = np.bincount(data[s:e], minlength=1) / max(e - s, 1)
        p = p[p > 0]
        out[i] = -(p * np.log2(p)).sum() if e > s else 0
    return pd.Series(out)


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def labelled(spark: SparkSession) -> DataFrame:
    """The labelled table ``(url, label)``, 1 for bad, made from the lists above."""
    kinds = [(0, GOOD_HOSTS, GOOD_SUFFIXES, GOOD_PATHS), (0, GOOD_MARKED, MARKED_SUFFIXES, GOOD_PATHS),
             (1, BAD_HOSTS, BAD_SUFFIXES, BAD_PATHS), (1, BAD_PLAIN, BAD_SUFFIXES[1:] + ["com"], PLAIN_PATHS)]
    rows = [(f"http{'s' * (i % 2)}://{('', 'www.', 'm.', 'blog.')[i % 4]}{host}.{suffixes[(i // 3 + i) % len(suffixes)]}"
             + path.format(n=(i * 37) % 1000), float(bad))
            for bad, hosts, suffixes, paths in kinds
            for i, (host, path) in enumerate(product(hosts, paths))]
    return spark.createDataFrame(rows, "url string, label double")


def suffix_shares(labels: DataFrame) -> dict[str, float]:
    """Share of bad URLs of every suffix of the labelled table, drawn towards one half."""
    rows = labels.groupBy(_suffix(parts(F.col("url"))[0]).alias("suffix")) \
        .agg(((F.sum("label") + 5) / (F.count("*") + 10)).alias("share")).collect()
    return {r["suffix"]: r["share"] for r in rows}


def features(urls: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``urls (url, host, path, ...)`` with :data:`FEATURES`."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    share = lambda text, pattern: F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))
    known = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return urls.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"), "depth": F.regexp_count(path, F.lit("/[^/]")).cast("double"),
        "labels": F.regexp_count(host, F.lit(r"\.")).cast("double"), "digits": share(url, "[0-9]"),
        "host_digits": share(host, "[0-9]"), "entropy": F.pandas_udf(_entropy, "double")(host),
        "params": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1).cast("double"),
        "hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "suffix_bad": F.coalesce(F.try_element_at(known, _suffix(host)), F.lit(0.5))})


def fit(labels: DataFrame, rounds: int = 20, depth: int = 4) -> tuple[PipelineModel, dict[str, float]]:
    """Trees over a labelled table ``(url, label)``, which should be small."""
    shares = suffix_shares(labels)
    host, path = parts(F.col("url"))
    rows = features(labels.withColumn("host", host).withColumn("path", path), shares).coalesce(1)
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.3, featureSubsetStrategy="onethird",
                          seed=1)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), trees]).fit(rows), shares


def judged(urls: DataFrame, model: PipelineModel, shares: dict[str, float], id: str = "page_id", url: str = "url",
           rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``(id, host, path, rule, verdict, bad)``; ``bad`` is the trees' prediction."""
    host, path = parts(F.col(url))
    named = urls.select(F.col(id).alias("__id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    seen = model.transform(features(named, shares))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    bad = F.col("prediction") == 1
    return seen.select(F.col("__id").alias(id), "host", "path", rule.alias("rule"),
                       F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"), bad.alias("bad"))
