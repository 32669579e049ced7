"""URL filter: character language-model ratio, with DataFrame functions only.

Rules come first: a rule names a host suffix and a path prefix, and the longest that fits
decides (of equally long ones the first given). What no rule decides is judged by two smoothed variable-order Markov
models over characters, one of rejected and one of accepted URLs. Their examples are a table of their own, apart from the rows that
are judged; ``ACCEPTED`` and ``REJECTED`` are the documented default. Every length of context backs the next longer one up:

    P_k(c | ctx) = (count(ctx c) + m P_{k-1}(c | shorter ctx)) / (count(ctx) + m)

down to a uniform distribution. A URL's score is the mean over its characters of
log P(rejected) - log P(accepted). The models are fitted on four fifths of the examples (by a hash of the name) and the limit is set on the
fifth that is left out: between the classes' mean scores, as many of each one's standard deviations from both, and above ``SAFE`` of
the accepted ones. Characters are folded to an alphabet of 33 first and models give only grams that occur, so what is
broadcast has at most 33 ** 4 rows (of 12 bytes, 14 MB) whatever the input is.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; a
null or empty url scores 0; without examples of both classes on both sides of the split nothing is rejected by score; very long URLs are scored whole, in
linear time; repeated rows and null page_ids are each judged; other columns are not read and not returned; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: (verdict, host suffix, path prefix). Fixed values.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Names of hosts to accept and to reject, made up for this purpose. Each gives an example of every form, so that only the names tell the classes apart.
ACCEPTED = """
city-library harbour-times slow-cooking parser-tools encyclopedia weather-centre university-press gardeners railway-museum mountain-trails
health-service old-maps teachers-network the-other-paper wool-and-thread parliament open-statistics astronomy-club kitchen-garden orchestra
code-notes bird-watch electronics law-review local-radio philosophy-papers island-ferries film-notes geology-society night-sky
medical-journal chess-school recipes woodwork museum-of-science river-trust football-results language-lessons town-history theatre-royal
story-time cycle-routes thoughts-on-type engineering-standards hospital-trust music-theory nature-reserve public-transport botany water-board
reading-room national-education translation-studies station-clock nutrition-notes
""".split()
REJECTED = """
best-casino-bonus cheap-pills-online adult-cams-xxx free-bets-poker win-big-slots cheap-meds-rx hot-singles-xxx casino-free-spins buy-followers-cheap xxx-adult-videos
poker-bonus-bets pills-no-prescription crypto-double-profit click-ads-track spam-mailer-pro online-gambling-bets payday-loans-fast replica-watches-cheap porn-tube-free best-betting-tips
slots-casino-win viagra-cheap-pills adult-dating-hot make-money-fast track-popup-ads sex-chat-adult lottery-winner-claim casino-vip-bets weight-loss-pills free-xxx-adult
ads-banner-click bets-live-casino instant-cash-loans cheap-viagra-rx bonus-codes-casino hot-adult-xxx spam-seo-links poker-win-cash miracle-diet-pills adult-x-movies
free-bonus-slots cheap-replica-bags gambling-jackpot-win click-track-redirect xxx-porn-adult bets-bonus-free buy-cheap-pills casino-adult-games win-free-prizes online-pills-rx
ads-spam-track best-bets-odds
""".split()
FORMS = ("http://{}.example.com/en/12.html", "https://www.{}.example.org/fr/3456/", "https://m.{}.example.net/de/789?page=2&ref=x", "http://blog.{}.example.com/es/45#top")
#: Longest context and one; weight of the shorter context; letters, 0 for digits, and ``./_-``; anything else is ``?``. ``^`` starts a URL.
ORDER, WEIGHT, SYMBOLS = 4, 4.0, 33
#: Share of the left-out accepted examples that the limit is above.
SAFE = 0.95


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_name(host: str, path: str) -> str:
    return f"{host}{path}"


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, suffix, prefix = rule
    return ((host == suffix) | host.endswith(f".{suffix}")) & path.startswith(prefix)


def apply_rules(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Adds host, path, rule and ruled (its verdict), the last two null where none fits."""
    host, path = F.col("host"), F.col("path")
    longest = sorted(rules, key=lambda r: -len(rule_name(*r[1:])))  # stable
    name = F.coalesce(*[F.when(_fits(host, path, r), F.lit(rule_name(*r[1:]))) for r in longest], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(_fits(host, path, r), F.lit(r[0])) for r in longest], F.lit(None).cast("string"))
    url = F.col("url")
    return pages.withColumns({"host": host_of(url), "path": path_of(url)}).withColumns({"rule": name, "ruled": verdict})


def _folded(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.concat(F.lit("^^^"), F.regexp_replace(F.regexp_replace(low, r"[0-9]", "0"), r"[^a-z0./_-]", "?"))


def _grams(urls: DataFrame, *keys: str) -> DataFrame:
    """A row for each character of a URL: the character with the ones before it."""
    windows = F.regexp_extract_all("folded", F.lit(f"(?s)(?=(.{{{ORDER}}}))"), F.lit(1))
    return urls.select(*keys, F.explode(windows).alias("gram"))


def examples(spark: SparkSession, accepted: list[str] = ACCEPTED, rejected: list[str] = REJECTED) -> DataFrame:
    """name, url and rejected, of every name in every form."""
    named = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).alias("rejected")) for names, r in ((accepted, False), (rejected, True)) for n in names])
    rows = spark.range(1).select(F.explode(named).alias("n")).select("n.*", F.explode(F.array(*map(F.lit, FORMS))).alias("form"))
    return rows.select("name", F.replace("form", F.lit("{}"), F.col("name")).alias("url"), "rejected")


def train(urls: DataFrame, needed: DataFrame) -> DataFrame:
    """gram, delta: log P(rejected) - log P(accepted) of the last character of each gram of ``needed``, from ``urls`` (folded, rejected)."""
    counts = _grams(urls, "rejected").groupBy("gram").agg(F.count_if("rejected").alias("n1"), F.count_if(~F.col("rejected")).alias("n0"))
    asked = needed.select("gram").distinct().withColumns({"n1": F.lit(0).cast("long"), "n0": F.lit(0).cast("long")})
    model = counts.unionByName(asked).groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).withColumnRenamed("gram", f"g{ORDER}")
    model = materialise(model, "url-grams")  # at most SYMBOLS ** ORDER rows, read once for each level
    model = model.withColumns({f"g{k}": F.right(f"g{ORDER}", F.lit(k)) for k in range(1, ORDER)})
    levels = None
    for k in range(1, ORDER + 1):
        # of each suffix of k characters: its count, and the count of its context
        level = model.groupBy(f"g{k}").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).withColumn("ctx", F.left(f"g{k}", F.lit(k - 1)))
        totals = level.groupBy("ctx").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
        level = level.join(totals, "ctx").drop("ctx")
        if levels is None:
            shorter = [F.lit(1.0 / SYMBOLS)] * 2
        else:
            level = level.withColumn("s", F.right(f"g{k}", F.lit(k - 1))).join(levels.withColumnRenamed(f"g{k - 1}", "s"), "s")
            shorter = [F.col("p0"), F.col("p1")]
        p = [(F.col(f"n{c}") + WEIGHT * shorter[c]) / (F.col(f"t{c}") + WEIGHT) for c in (0, 1)]
        levels = level.select(f"g{k}", p[0].alias("q0"), p[1].alias("q1")).withColumnsRenamed({"q0": "p0", "q1": "p1"})
    return levels.select(F.col(f"g{ORDER}").alias("gram"), (F.log("p1") - F.log("p0")).alias("delta"))


def _scored(urls: DataFrame, model: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and score, of the rows with grams."""
    return _grams(urls, *keys).join(F.broadcast(model), "gram").groupBy(*keys).agg(F.round(F.avg("delta"), 9).alias("score"))


def limit_of(left_out: DataFrame) -> float:
    """The calibrated limit from the left-out examples' ``score`` and ``rejected``; infinite if a class is missing."""
    of = {int(c): F.when(F.col("rejected") == c, F.col("score")) for c in (False, True)}
    stats = left_out.agg(*[f(x).alias(f"{n}{c}") for c, x in of.items() for n, f in (("mean", F.avg), ("sd", F.stddev_pop))], F.percentile(of[0], SAFE).alias("safe")).first()
    if stats is None or stats.mean0 is None or stats.mean1 is None:
        return float("inf")
    sd0, sd1 = stats.sd0 + 1e-9, stats.sd1 + 1e-9
    return max((stats.mean0 * sd1 + stats.mean1 * sd0) / (sd0 + sd1), stats.safe)


def judge(pages: DataFrame, rules: tuple = RULES, known: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score of each row of ``pages`` (page_id, url). ``known``: examples (name, by which they are left out together, url, rejected), ``examples`` by default."""
    known = (examples(pages.sparkSession) if known is None else known).select("name", "url", "rejected").where("name is not null and url is not null and rejected is not null").distinct()
    known = known.select("url", "rejected", _folded(F.col("url")).alias("folded"), (F.crc32("name") % 5 == 0).alias("left_out"))
    # grams carry a digest, not the URL: a long one would be copied as often as it has characters
    judged = apply_rules(pages.select("page_id", "url"), rules).withColumn("folded", _folded(F.col("url"))).withColumn("key", F.sha2(F.col("folded").cast("binary"), 256))
    model = materialise(train(known.where("not left_out"), _grams(judged).union(_grams(known))), "url-model")  # at most SYMBOLS ** ORDER rows
    limit = limit_of(_scored(known.where("left_out"), model, "url", "rejected"))
    if known.where("not left_out").select("rejected").distinct().count() < 2:
        limit = float("inf")
    scored = judged.drop("folded").join(_scored(judged, model, "key"), "key", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    verdict = F.coalesce("ruled", F.when(F.col("score") > limit, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
