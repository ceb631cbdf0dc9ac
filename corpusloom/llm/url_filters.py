"""URL filters: rules first, then logistic regression on hashed character n-grams (operator 12).

Everything is DataFrame expressions. A url gives a host and a path; ``<host>`` and ``/path`` give their
distinct character n-grams of ``SIZES`` characters (digits as 0), told apart by where they stand and hashed into
``SLOTS`` slots. The model is trained on a small labelled table of urls, at most ``TRAIN_URLS`` (those with the least
hash), in one row: full-batch gradient descent as array expressions, the gradient of a slot summed over
the list of the examples that have it. Weights are whole millionths, so a score is a sum of integers and
the same wherever and in whatever order it is taken. They are read by the driver (``SLOTS`` numbers at most) and go into the
scoring expression as one literal array; urls are judged where they stand, without a shuffle, and blocked at a probability of
``SURE`` or more.

Rules are a short list of (verdict, host, path): one fits its host and all subdomains where the path starts
with the rule's; of those that fit the longest wins. Only urls without a rule are scored.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule, and is judged by the bias
alone; an empty labelled table, or one with a single label, gives no model, and urls without a rule are allowed; of several labels of one
url block wins; null labels or urls are left out; repeated rows give repeated results; other columns are kept out of the result; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import char_grams, let
from corpusloom.llm.common import checkpointed

SIZES = (3, 4, 5)
SLOTS = 1 << 14
TRAIN_URLS = 2_000
ROUNDS = 150
RATE, L2 = 12.0, 0.0005
UNIT = 1_000_000
#: A url is blocked from this probability on: a blocked page is lost, so the model has to be sure.
SURE = 0.8

#: The rules of the query, as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Names of unwanted and of ordinary sites, from which the small labelled table is made.
BLOCKED = """
casino casino-royal lucky-casino casino-spins online-casino casino-win free-bets sports-bets best-bets betting betting-tips bet-now poker poker-win
big-win lottery-win win-prize jackpot jackpot-slots free-slots free-spins free-gifts free-cash free-crypto cheap-pills pills pills-online cheap-meds
buy-viagra cheap-viagra cheap-pharmacy online-pharmacy cheap-watches replica-watches cheap-loans payday-loans fast-cash weight-loss-pills ads adserver
ads-server ads-track ads-click ad-network adtrack track-clicks click-track click-tracker banner-ads popup-ads tracking-pixel pixel-track spam
spam-farm spam-links link-farm content-farm click-farm spam-mail seo-spam adult adult-x adult-videos free-adult xxx-adult adult-cams adult-dating
xxx-cams porn porn-x xxx escort-x hot-cams malware malware-download free-keygen crack-keygen phishing-login torrent-crack
""".split()
ALLOWED = """
library city-library gardening news river-news history-museum museum school school-district university research science science-daily open-data
weather travel travel-notes recipes cooking-at-home hiking-trails book-reviews poetry evening-post local-paper health-service engineering software
docs wiki forum photography music music-lessons there another thinking rating nation station winter information better freedom trains farmers-market
thread reading listing shed blessing they entity earth heat trend sound under renting ending whole sharing story family table friendly where
what thorn ring hold tithe teachers mountains orchestra theatre garden rivers bridge harbour village council parish church choir painting pottery
knitting carpentry cycling rowing football chess astronomy geology botany birds forest lakes islands coast maps atlas dictionary grammar letters
archive records census energy transport railways buses tickets timetable post office jobs volunteers charity hospital dentist nursing children
parents play toys bakery bread cheese coffee tea vineyard orchard honey sheep horses wool thatch brick stone timber glass mentor thanks tender
stand hand land band wonder thunder render other mother weather-station ourselves handout tinder noted onward reason season lesson
""".split()
PLACES = ("{}.example.com", "www.{}.example.org", "m.{}.example.net", "{}.com", "blog.{}.example.com", "{}.example.org", "{}.example.net", "www.{}.org", "{}.net")
LANGUAGES = ("en", "de", "fr", "es")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label) of the small table; label 1 is to be blocked. Places and paths go round alike for both labels, so that names decide."""

    def urls(names: list[str], label: int) -> Column:
        text = [f"https://{PLACES[i % len(PLACES)].format(x)}/{LANGUAGES[i % len(LANGUAGES)]}/{i * 7919 % 40_000}" for i, x in enumerate(names)]
        return F.transform(F.split(F.lit(" ".join(text)), " "), lambda u: F.struct(u.alias("url"), F.lit(label).alias("label")))

    return spark.range(1, numPartitions=1).select(F.explode(F.concat(urls(BLOCKED, 1), urls(ALLOWED, 0))).alias("r")).select("r.*")


def host_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def slots(host: Column, path: Column) -> Column:
    """The distinct slots of a url's n-grams, in order."""

    def grams(text: Column, place: int) -> Column:
        plain = F.regexp_replace(text, "[0-9]", "0")
        return F.transform(F.concat(*[char_grams(plain, n) for n in SIZES]), lambda g: F.pmod(F.xxhash64(F.lit(place), g), F.lit(SLOTS)).cast("int"))

    own = F.when(host != "", grams(F.concat(F.lit("<"), host, F.lit(">")), 0)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.concat(own, grams(path, 1))))


def fit(labelled: DataFrame, rounds: int = ROUNDS) -> list[int] | None:
    """Weights in millionths, the bias last; None where one of the labels is missing.

    ``labelled(url, label)`` is small; of more than ``TRAIN_URLS`` different urls those with the least hash are taken.
    """
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL").groupBy("url").agg(F.max(F.col("label").cast("int")).alias("y"))
    rows = rows.orderBy(F.xxhash64("url"), "url").limit(TRAIN_URLS)
    rows = rows.select("url", "y", slots(host_of(F.col("url")), path_of(F.col("url"))).alias("x"))
    # One row: the examples in order, and per slot (numbered densely) the places of the examples that have it.
    examples = F.array_sort(F.collect_list(F.struct("url", F.col("y").cast("double").alias("y"), "x")))
    whole = rows.agg(examples.alias("e")).where(F.size("e") > 0)
    one = whole.select(
        F.transform("e", lambda r: r["y"]).alias("y"),
        F.transform("e", lambda r: F.sqrt(F.greatest(F.size(r["x"]), F.lit(1)).cast("double"))).alias("norm"),
        F.transform("e", lambda r: r["x"]).alias("x"),
    ).where(F.exists("y", lambda y: y == 0) & F.exists("y", lambda y: y == 1))
    holders = one.select(F.posexplode("x").alias("row", "x")).select("row", F.explode("x").alias("slot"))
    lists = holders.groupBy("slot").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    table = lists.agg(F.map_from_entries(F.collect_list(F.struct("slot", "rows"))).alias("m"))
    dense = table.select(F.col("m"), F.array_sort(F.map_keys("m")).alias("slot"))
    dense = dense.select("slot", F.transform("slot", lambda s: F.element_at("m", s)).alias("rows"))
    data = one.crossJoin(F.broadcast(dense))  # one row each
    number = F.map_from_arrays(F.col("slot"), F.sequence(F.lit(0), F.size("slot") - 1))
    data = data.withColumn("x", let(number, lambda m: F.transform("x", lambda x: F.transform(x, lambda s: F.element_at(m, s)))))
    data, n = checkpointed(data), F.size("y")

    def step(state: Column, _) -> Column:
        # Error of each example, then the gradient of each slot over its own list of examples.
        margin = lambda x, i: state["b"] + F.aggregate(x, F.lit(0.0), lambda a, s: a + F.get(state["w"], s)) / F.get(F.col("norm"), i)
        errors = F.transform("x", lambda x, i: (1 / (1 + F.exp(-margin(x, i))) - F.get(F.col("y"), i)) / n)

        def move(err: Column) -> Column:
            gradient = lambda rows: F.aggregate(rows, F.lit(0.0), lambda a, r: a + F.get(err, r) / F.get(F.col("norm"), r))
            w = F.transform(state["w"], lambda v, i: v - RATE * (gradient(F.get(F.col("rows"), i)) + L2 * v))
            b = state["b"] - RATE * F.aggregate(err, F.lit(0.0), lambda a, e: a + e)
            return F.struct(w.alias("w"), b.alias("b"))

        return let(errors, move)

    start = F.struct(F.transform("slot", lambda _: F.lit(0.0)).alias("w"), F.lit(0.0).alias("b"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    whole_units = lambda v: F.round(v * UNIT).cast("int")
    row = data.select("slot", state.alias("s")).select("slot", F.transform("s.w", whole_units).alias("w"), whole_units(F.col("s.b")).alias("b")).first()
    if row is None:
        return None
    out = [0] * SLOTS
    for slot, w in zip(row["slot"], row["w"], strict=True):
        out[slot] = w
    return [*out, row["b"]]


def score(host: Column, path: Column, weights: Sequence[int]) -> Column:
    """The model's log odds that a url is to be blocked."""
    table = F.split(F.lit(",".join(map(str, weights[:-1]))), ",").cast("array<int>")  # one literal once it is folded
    own = slots(host, path)
    return let(own, lambda x: F.lit(weights[-1] / UNIT) + F.aggregate(x, F.lit(0).cast("long"), lambda a, s: a + F.get(table, s)) / F.sqrt(F.greatest(F.size(x), F.lit(1)).cast("double")) / UNIT)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(verdict, rule); of equally long ones the first listed."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)[::-1]:
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(out)
    return out


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per row; the score is null where a rule decides or there is no model."""
    weights = fit(labelled)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    margin = score(F.col("host"), F.col("path"), weights) if weights else F.lit(None).cast("double")
    rows = rows.withColumn("score", F.when(F.col("_r").isNull(), margin))
    own = F.when(F.col("score") >= math.log(SURE / (1 - SURE)), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", own).alias("verdict"), "score")
