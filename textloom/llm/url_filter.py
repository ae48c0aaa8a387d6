"""URL filters: rules by host and path, else logistic regression on hashed character n-grams.

Features are the distinct character trigrams of host and path (the host between ^ and $, so that ends count); a trigram's
feature is the number in the first three hexadecimal digits of its MD5. The model is trained on the driver, from a small
labelled table that comes with the operator or is given; every page is judged by DataFrame functions alone.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 12
PASSES, STEP, DECAY = 300, 0.5, 1e-3

#: (verdict, host, path); a rule fits its host and all subdomains, and paths that start with its path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: The labelled table: hosts and paths, written for this purpose.
ALLOWED = (
    "www.citylibrary.org/catalogue/history", "docs.compiler.dev/manual/types", "blog.gardening.net/2021/05/roses", "news.daily.com/world/article-1234", "en.encyclopedia.org/wiki/Glacier",
    "university.edu/physics/lectures/12", "recipes.kitchen.com/bread/sourdough.html", "forum.cycling.org/thread/8841", "museum.art/collections/paintings/77", "weather.gov/forecast/coast",
    "journal.science.org/articles/10.1000", "www.mountain-guide.com/en/routes/42", "poems.example.org/fr/1203", "help.editor.dev/faq", "stories.archive.net/de/5512/",
    "blog.travel.com/en/lisbon", "www.hospital.org/patients/guide", "magazine.music.com/reviews/2019", "tutorials.code.dev/python/lists", "www.townhall.gov/minutes/2020-04",
    "m.newspaper.com/en/7741", "reading.books.org/es/904.html", "astronomy.club.net/en/observing", "wiki.chess.org/openings/sicilian", "www.farmers.net/articles/soil",
)
BLOCKED = (
    "ads.tracker.com/click/banner", "www.bestcasino.win/poker/bonus", "cheap-pills.biz/buy/now", "free-money.xyz/win/prize", "track.adserver.net/pixel.gif",
    "login.secure-bank.xyz/verify/account", "xxx-videos.club/hot", "casino.slots.win/jackpot", "click.popunder.com/redirect", "www.loans-fast.biz/apply/now",
    "download.crack.ws/keygen", "torrent.pirate.ws/free/movie", "bet.sports.win/odds/bonus", "cdn.banner-ads.com/ad/728x90", "promo.coupons.biz/deal/free",
    "shop.replica-watch.xyz/cart/checkout", "affiliate.clicks.net/ref/track", "hot-singles.club/chat/xxx", "win-iphone.xyz/survey/prize", "spam.mailer.biz/unsubscribe",
    "adult.cams.club/live", "pills.pharmacy.xyz/viagra", "crypto-double.win/bonus", "ads.doubleserve.com/click", "free-slots.casino.biz/spin",
)


def feature(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:3], 16)


def trigrams(host: str, path: str) -> set[str]:
    text = f"^{host}${path}"
    return {text[i : i + 3] for i in range(len(text) - 2)}


def train(allowed=ALLOWED, blocked=BLOCKED, passes: int = PASSES) -> tuple[list[float], float]:
    """Weights and bias for the log-odds of block, by gradient descent over the labelled hosts and paths."""
    rows = []
    for label, urls in ((0.0, allowed), (1.0, blocked)):
        for url in urls:
            host, slash, path = url.partition("/")
            rows.append((label, sorted(map(feature, trigrams(host, slash + path)))))
    weights, bias = [0.0] * FEATURES, 0.0
    for _ in range(passes):
        for label, found in rows:
            z = bias + math.fsum(weights[i] for i in found)
            miss = label - 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
            step = STEP * miss / math.sqrt(len(found))
            bias += STEP * miss / 10
            for i in found:
                weights[i] += step / math.sqrt(len(found)) - DECAY * weights[i] / len(rows)
    # few digits, so that sums are the same wherever they are made
    return [round(x, 4) for x in weights], round(bias, 4)


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_filter(df: DataFrame, rules=RULES, model: tuple[list[float], float] | None = None) -> DataFrame:
    """Per row of df (page_id, url): page_id, host, path, rule, verdict.

    Null urls, and urls without ``://``, have an empty host and path, and the model judges them as such (so all alike).
    The longest of the rules that fit gives the verdict, the first of equally long ones. Ports and user names are
    part of the host. A url of any length is judged whole. Repeated rows are returned as often; other columns are ignored; an empty table gives an empty
    result.
    """
    weights, bias = model or train()
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    parts = "://([^/?#]*)([^?#]*)"
    rows = df.select("page_id", _lower(F.regexp_extract(url, parts, 1)).alias("host"), F.regexp_extract(url, parts, 2).alias("path"))

    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest comes to stand first
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    text = F.concat(F.lit("^"), "host", F.lit("$"), "path")
    grams = F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substr(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<decimal(12,4)>")
    found = F.transform(grams, lambda g: F.get(table, F.conv(F.substr(F.md5(F.encode(g, "UTF-8")), F.lit(1), F.lit(3)), 16, 10).cast("int")))
    log_odds = F.aggregate(found, F.lit(str(bias)).cast("decimal(20,4)"), lambda a, w: (a + w).cast("decimal(20,4)"))
    return rows.withColumn("rule", rule).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), verdict).when(log_odds > 0, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))


def oracle(rules=RULES, model: tuple[list[float], float] | None = None) -> str:
    """The same in SQL, over a table pages."""
    weights, bias = model or train()
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(kind, host, path, f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))") for kind, host, path in ordered]
    rule = "CASE " + " ".join(f"WHEN {cond} THEN '{host}{path}'" for _, host, path, cond in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {cond} THEN '{kind}'" for kind, _, _, cond in fits) + " END"
    digit = "(instr('0123456789abcdef', substr(md5(g), {}, 1)) - 1)"
    number = f"{digit.format(1)} * 256 + {digit.format(2)} * 16 + {digit.format(3)}"
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
weights AS (SELECT [{",".join(map(str, weights))}]::DECIMAL(12,4)[] AS w),
texts AS (SELECT DISTINCT host, path, '^' || host || '$' || path AS t FROM parts),
grams AS (SELECT DISTINCT host, path, substr(t, i, 3) AS g FROM (SELECT host, path, t, unnest(range(1, length(t) - 1)) AS i FROM texts)),
odds AS (SELECT host, path, sum(w[({number}) + 1]) + {bias}::DECIMAL(12,4) AS z FROM grams, weights GROUP BY host, path)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN coalesce(z, {bias}) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN odds USING (host, path)"""


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))
