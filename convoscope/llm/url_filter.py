"""URL filter: rules on host and path, and logistic regression on hashed character n-grams for the rest.

A rule ``host/path`` fits its host and all subdomains where the URL's path
starts with the rule's; the longest rule wins.  Other URLs are judged by a
model trained from a small labelled table (``LABELLED``, or the caller's).  All
of it is DataFrame expressions and Spark ML's own transformers.

Defined results: a null URL, or one without ``://``, has an empty host and
path, fits no rule and is judged by the model; rows that repeat are judged
each; no rows give no rows; other columns pass through.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAMS = (3, 4, 5)
SLOTS = 1 << 18
RIDGE = 0.0005
#: How much more an allowed row of the labelled table weighs: most URLs on the web are not to be blocked.
PRIOR = 3.0

#: Default labelled URLs (fixed values).
BLOCKED = """
https://www.casino-royal.example/en/12 http://best-casino.example/slots/7 https://online-casino-bonus.example/fr/3
https://win-casino.example/en/9.html http://casino.example/ https://jackpot-win.example/en/55 https://big-win-slots.example/es/1
http://free-bets.example/en/4 https://sport-bets.example/de/77 https://bets-online.example/en/18 https://betting-tips.example/en/2
https://poker-free.example/en/301 http://cheap-pills.example/en/1 https://pills-online.example/fr/52 https://buy-pills.example/es/6
https://cheap-meds.example/en/91 http://viagra-cheap.example/en/8 https://pharma-discount.example/de/14 https://diet-pills.example/en/63
https://adult-cams.example/en/5 http://adult-x.example/fr/20 https://xxx-videos.example/en/11 https://x-adult-chat.example/es/36
https://hot-singles.example/en/71 http://porn-tube.example/en/2 https://sexy-dates.example/de/9 https://escort-x.example/en/44
https://spam-farm.example/en/10 http://link-farm.example/fr/16 https://seo-spam.example/en/880 https://spam-links.example/es/2
https://content-farm.example/en/640 https://backlinks-cheap.example/en/17 http://ads-track.example/en/3 https://track-ads.example/pixel
https://ad-server.example/click https://click-track.example/en/90 https://banner-ads.example/de/31 http://popup-ads.example/en/29
https://free-prize.example/en/6 https://claim-prize.example/win/4 http://lottery-win.example/en/8 https://free-iphone.example/en/13
https://payday-loans.example/en/22 http://fast-loans.example/fr/7 https://bad-credit-cash.example/en/41 https://crypto-double.example/en/5
https://www.casino-king.example/en/3 http://blog.spam-network.example/es/4 https://m.adult-site.example/en/50 http://www.bets-now.example/fr/9
https://www.pills-store.example/en/61 https://blog.cheap-viagra.example/de/2 http://m.ads-network.example/en/7 https://www.free-casino.example/en/80
https://m.track-click.example/en/30 https://blog.adult-dating.example/es/11 https://www.link-spam.example/en/5 http://m.win-bets.example/en/66
https://login-verify-account.example/secure http://secure-bank-login.example/verify https://warez-crack.example/en/82
http://torrent-free.example/en/19 https://keygen-crack.example/es/33 https://malware-download.example/setup http://hack-tool.example/en/3
""".split()
ALLOWED = """
https://www.cityweather.example/en/12 http://news.townpaper.example/en/7 https://docs.compiler.example/guide/3.html
https://library.university.example/fr/91 https://museum.example/es/5 http://www.recipes.example/en/301 https://blog.gardening.example/en/44
https://m.travelnotes.example/de/17 https://forum.cycling.example/en/63 https://history.society.example/en/820 http://maths.school.example/en/2
https://physics.institute.example/en/34 https://www.theatre.example/fr/6 https://m.books.example/es/77 http://charity.example/en/18
https://council.gov.example/en/5 https://health.gov.example/de/14 https://parliament.example/en/90 https://wiki.example/en/31
https://encyclopedia.example/fr/880 https://archive.example/en/22 http://photos.example/en/9 https://opensource.example/docs/1
https://www.orchestra.example/en/640 https://astronomy.example/en/10 https://blog.knitting.example/en/82 http://hiking.example/de/3
https://zoo.example/en/4 https://trains.example/fr/52 https://www.airport.example/en/36 https://bakery.example/en/71
https://blog.ther.example/en/11 https://www.tionan.example/en/40 http://m.onth.example/fr/8 https://anth.example/de/61
https://blog.erin.example/es/2 https://entheou.example/en/13 http://www.hander.example/en/9 https://m.ingst.example/en/55
https://thatin.example/en/29 https://reth.example/fr/41 https://blog.stere.example/en/3.html https://www.leoned.example/en/20
https://mentiar.example/es/16 https://www.cioner.example/es/1 https://schunge.example/de/7 https://keiter.example/de/33
https://oiser.example/fr/19 https://m.aulle.example/fr/5 https://therba.example/en/100 https://www.lyther.example/en/502/
https://translation.example/en/6 https://dictionary.example/en/8 https://radio.example/en/74 https://football.example/en/15
https://chess.example/en/27 https://farming.example/en/38 https://www.tracking-parcels.example/en/12 https://freedom.example/en/2
https://window-repair.example/en/3 https://pillows.example/en/19 https://adultlearning.example/en/21 https://addresses.example/en/4
""".split()
#: (rule, allow or block), fixed values of the query that uses them.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = "(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, parts, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(url, parts, 2)


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, allow or block) of the longest rule that fits, else nulls.  Rules are a short list: one branch each."""
    rule = verdict = None
    for text, action in sorted(rules, key=lambda r: -len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, each marked with its field."""

    def of(field: str, text: Column, n: int) -> Column:
        text = F.concat(F.lit("^"), text, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(field), F.substr(text, i, F.lit(n))))

    return F.array_distinct(F.concat(*(of(f, x, n) for f, x in (("h", host), ("p", path)) for n in GRAMS)))


def _hashed(df: DataFrame) -> DataFrame:
    tf = HashingTF(numFeatures=SLOTS, binary=True, inputCol="_grams", outputCol="_features")
    return tf.transform(df.withColumn("_grams", grams(F.col("host"), F.col("path"))))


def labelled_urls(spark: SparkSession, blocked: Sequence[str] = BLOCKED, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """(url, label) of the default table."""
    rows = [F.struct(F.lit(u).alias("url"), F.lit(float(y)).alias("label")) for y, urls in ((1, blocked), (0, allowed)) for u in urls]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def train(labelled: DataFrame) -> LogisticRegressionModel:
    """Ridge logistic regression from labelled(url, label: 1 blocks); the table is small by contract."""
    host, path = host_and_path(F.col("url"))
    rows = _hashed(labelled.select(host.alias("host"), path.alias("path"), "label"))
    rows = rows.select("_features", "label", F.when(F.col("label") == 1, 1.0).otherwise(PRIOR).alias("_weight"))
    lr = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="_weight", regParam=RIDGE, standardization=False, maxIter=60)
    return lr.fit(rows)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], model: LogisticRegressionModel) -> DataFrame:
    """pages(url, ...) -> its columns with host, path, rule, score (chance to be blocked), verdict."""
    host, path = host_and_path(F.col("url"))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "score", "verdict")]
    rows = pages.select(*kept).withColumns({"host": host, "path": path})
    model = model.copy({model.probabilityCol: "_probability", model.rawPredictionCol: "", model.predictionCol: ""})
    rows = model.transform(_hashed(rows)).withColumn("score", vector_to_array("_probability")[1])
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")))
    return rows.select(*kept, "host", "path", "rule", "score", "verdict")
