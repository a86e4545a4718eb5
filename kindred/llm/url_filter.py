"""URL filter: rules first, then a logistic regression on hashed character n-grams of host and path.

Everything is column expressions: parsing, n-gram hashes, training and scoring run without Python in tasks.

* A rule (verdict, host, path) fits its host and all subdomains where the URL's path starts with the rule's;
  of several the longest (host and path together) decides. Rules are compiled into one expression.
* The model sees the distinct buckets of the n-grams of ``^host$`` and of ``path$``, all digits as 0, two blocks
  that are scaled to fixed lengths (SCALE), and a constant. It is trained by full-batch gradient descent with an L2 penalty. The
  steps start from nought, so the weights stay sums of training rows, and a step changes one number a row: the
  inner products of the rows, found by joining them on their buckets, are held as one row of at most
  ``most_labelled`` squared numbers, and all steps are one expression over it. Weights are kept as whole
  millionths, so sums over a URL are exact and do not depend on the order of its n-grams.

Defined cases: host and path are empty where the URL is null or has no ``://``; such a URL is scored by the
constant and the two n-grams of nothing but marks. Only ASCII letters of the host are lower-cased. Labelled
rows without URL or label are left out; with labels of one kind only, or none, the model follows that
kind (none: allow). Ties at a score of exactly 0 are allowed. Repeated rows are judged each; other columns
are not read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16384
SIZES = (3, 4, 5)
STEPS = 200
PENALTY = 0.0005
MOST_LABELLED = 512
SALT = {"host": 17, "path": 29}
SCALE = {"host": 1.0, "path": 0.5}
PRIME, BASE = 2_147_483_647, 1_000_003

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

BLOCKED = """
http://casino-royal.example.biz/slots/777
https://www.bigcasino.example.info/bonus
http://play-casino.example.top/en/1204
https://luckyspin.example.site/jackpot?aff=2
http://bets-online.example.biz/live/44
https://freebet.example.info/sports/odds
http://m.bet-now.example.top/en/831.html
https://bestbets.example.site/football/tips
http://win-cash.example.biz/prize/claim
https://poker-win.example.info/en/99
http://free-money.example.top/win/now
https://freespins.example.site/signup
http://cheap-meds.example.biz/pills/blue
https://pills-shop.example.info/en/5510
http://m.cheappills.example.top/order/now
https://diet-pills.example.site/buy/cheap
http://viagra-cheap.example.biz/discount
https://pharm-discount.example.info/pills
http://adult-video.example.top/hot/812
https://www.xxx-adult.example.site/en/3307
http://adultcams.example.biz/live
https://sexy-chat.example.info/adult/18
http://blog.adult-dating.example.top/fr/20
https://x-tube.example.site/adult/clips
http://ads-server.example.biz/click?id=8
https://adtrack.example.info/pixel.gif
http://m.track-ads.example.top/redirect/66
https://tracker.example.site/ads/banner
http://click-ads.example.biz/impression/9
https://popup-ads.example.info/track/12
http://spam-links.example.top/backlinks
https://linkfarm.example.site/en/7781
http://www.spammy-farm.example.biz/seo/buy
https://content-farm.example.info/spam/3
http://buy-spam-farm.example.top/list/41
https://link-spam.example.site/index/2
http://loan-fast.example.biz/payday/apply
https://quick-loans.example.info/cash
http://get-rich.example.top/crypto/double
https://crypto-pump.example.site/invest/now
http://fake-watches.example.biz/replica/rolex
https://replica-bags.example.info/cheap
http://warez-crack.example.top/keygen/serial
https://torrent-crack.example.site/download
http://free-ringtones.example.biz/win
https://survey-prize.example.info/claim/iphone
http://hot-singles.example.top/adult/near
https://slots-casino.example.site/en/620/
http://casino.example.biz/de/18?page=2
https://m.winbets.example.info/fr/77#top
http://ads.example.biz/en/4410
https://www.ads-network.example.info/en/92.html
http://m.ad-tracking.example.top/fr/318/
https://tracks.example.site/en/7004?utm_source=feed
http://blog.adtracker.example.biz/de/51
https://cheap-rx.example.info/en/2240/
http://www.pills-online.example.top/en/61#top
https://m.cheapdeals.example.site/es/905
http://buypills.example.biz/fr/33.html
https://cheap-cialis.example.info/de/4178
http://casino-games.example.top/en/3
https://www.winner-casino.example.site/fr/5020/
http://m.jackpot-win.example.biz/en/870?page=2
https://free-slots.example.info/es/4
http://blog.free-bet.example.top/en/6677#top
https://www.sportsbets.example.site/de/290
http://freeporn.example.biz/en/14
https://adult-toys.example.info/en/5081.html
http://m.xxx-girls.example.top/fr/9/
https://www.adult-pics.example.site/de/705
http://spam.example.biz/en/11
https://linkspam.example.info/es/3920/
http://blog.seo-farm.example.top/en/488
https://www.bot-farm.example.site/en/72?ref=x
http://farm-links.example.biz/fr/1633
"""

ALLOWED = """
http://blog.thorne.example.biz/en/8123
https://www.thresh.example.info/en/4401.html
http://m.theater.example.top/fr/2210/
https://stationers.example.site/de/917?page=2
http://nationtimes.example.biz/en/3392#top
https://blog.thinking.example.info/es/605
http://theory.example.top/en/7340?ref=x
https://www.mathnotes.example.site/articles/graph-theory
http://library.example.biz/catalogue/item/5531
https://news.townpost.example.info/2024/05/07/council-vote
http://m.weather.example.top/forecast/week
https://docs.framework.example.site/guide/install.html
http://wiki.history.example.biz/page/Roman_roads
https://blog.garden.example.info/spring/tulips
http://recipes.kitchen.example.top/soup/onion
https://www.university.example.site/department/physics
http://museum.example.biz/collection/1204
https://journal.biology.example.info/vol/12/issue/3
http://forum.cycling.example.top/thread/8841
https://www.railways.example.site/timetable/north
http://m.cityhall.example.biz/services/waste
https://schools.example.info/en/term-dates
http://planet.astronomy.example.top/moon/phases
https://translation.example.site/fr/lexicon/maison
http://www.therapy.example.biz/en/6604/
https://blog.thirteen.example.info/de/73.html
http://motion.example.top/en/5150
https://www.institution.example.site/es/88
http://m.ration.example.biz/fr/1742?utm_source=feed
https://fraction.example.info/en/29
http://blog.caption.example.top/en/4127/
https://www.north.example.site/de/3308#top
http://clothing-history.example.biz/essay/wool
https://m.method.example.info/en/9071
http://earth-science.example.top/volcano/etna
https://www.healthadvice.example.site/sleep/children
http://chess-club.example.biz/openings/italian
https://local-radio.example.info/programme/morning
http://www.poetry.example.top/anthology/ode
https://code.tutorial.example.site/python/lists
http://m.bakery.example.biz/bread/rye
https://architecture.example.info/bridges/stone
http://blog.winter-walks.example.top/en/302
https://www.freedom-writers.example.site/essay/4
http://betterment.example.biz/en/811
https://blog.spanish-lessons.example.info/es/12
http://adventure.example.top/trails/alps
https://www.addition.example.site/en/2046.html
http://m.theses.example.biz/en/1187
https://thistle.example.info/fr/460
http://cheapside-history.example.biz/london/cheapside
https://www.farmhouse.example.info/sheep/wool
http://m.winter.example.top/snow/drift
https://freedom.example.site/law/speech
http://blog.adult-education.example.biz/courses/evening
https://alphabets.example.info/letters/greek
http://www.railtracks.example.top/maps/coast
https://shadows.example.site/photography/light
http://windows.example.biz/glass/restoration
https://m.spillway.example.info/river/dam
http://gardening.example.top/roses/pruning
https://www.shipyards.example.site/harbour/crane
http://farmers.example.biz/market/saturday
https://blog.readers.example.info/novel/review
http://trackways.example.top/archaeology/bronze
http://harbour.example.biz/en/4410
https://www.orchestra.example.info/en/92.html
http://m.letters.example.top/fr/318/
https://garden.example.site/en/7004?utm_source=feed
http://blog.astronomer.example.biz/de/51
https://shelter.example.info/en/2240/
http://www.theatre-school.example.top/en/61#top
https://m.mountain.example.site/es/905
http://novels.example.biz/fr/33.html
https://theorem.example.info/de/4178
http://history-games.example.top/en/3
https://www.whisper.example.site/fr/5020/
http://m.thatcher.example.biz/en/870?page=2
https://shipwright.example.info/es/4
http://blog.physics.example.top/en/6677#top
https://www.whales.example.site/de/290
http://hospital.example.biz/en/14
https://adults-learning.example.info/en/5081.html
http://m.thread.example.top/fr/9/
https://www.thunder.example.site/de/705
http://tradition.example.biz/en/11
https://nationhood.example.info/es/3920/
http://blog.seaside.example.top/en/488
https://www.other-lands.example.site/en/72?ref=x
http://tables.example.biz/fr/1633
https://tornado.example.info/en/310
http://m.authors.example.top/en/52/
https://www.whether.example.site/fr/7
"""


def labelled_rows() -> list[tuple[str, int]]:
    """(url, 1 for block or 0 for allow)."""
    return [(u, y) for y, text in ((1, BLOCKED), (0, ALLOWED)) for u in text.split()]


def labelled_table(spark: SparkSession, rows: list[tuple[str, int]] | None = None) -> DataFrame:
    text = json.dumps([{"url": u, "label": y} for u, y in (labelled_rows() if rows is None else rows)])
    return spark.sql("SELECT inline(from_json(:rows, 'array<struct<url: string, label: int>>'))", args={"rows": text})


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(url, F.lit(""))
    at = F.instr(known, "://")
    rest = F.when(at > 0, known.substr(at + 3, F.length(known))).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _grams(codes: str, salt: int, buckets: int) -> Column:
    """The distinct buckets of the n-grams of a column of characters' codes, n of SIZES."""

    def hashed(i: Column, n: int) -> Column:
        h = F.lit(salt).cast("long")
        for j in range(n):
            h = (h * BASE + F.get(codes, i + j)) % PRIME
        return (h % buckets).cast("int")

    def all_of(n: int) -> Column:
        last = F.size(codes) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: hashed(i, n))).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.concat(*map(all_of, SIZES)))


def featured(urls: DataFrame, url_col: str, buckets: int = BUCKETS) -> DataFrame:
    """``urls`` with host and path, and with the buckets of both blocks as _host and _path."""
    host, path = host_and_path(F.col(url_col))
    code = lambda text: F.transform(F.split(F.translate(text, "123456789", "000000000"), ""), lambda c: F.ascii(c).cast("long"))
    read = urls.withColumns({"host": host, "path": path})
    read = read.withColumns({"_h": code(F.concat(F.lit("^"), "host", F.lit("$"))), "_p": code(F.concat("path", F.lit("$")))})
    return read.withColumns({"_host": _grams("_h", SALT["host"], buckets), "_path": _grams("_p", SALT["path"], buckets)}).drop("_h", "_p")


@dataclass(frozen=True)
class Model:
    """Weights in millionths: of the constant, and of each bucket of either block."""

    bias: int
    host: list[int]
    path: list[int]


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", buckets: int = BUCKETS, steps: int = STEPS, penalty: float = PENALTY, most_labelled: int = MOST_LABELLED) -> Model:
    """Learns from at most ``most_labelled`` rows, the first in the order of a hash of URL and label."""
    rows = labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("int").alias("y")).where("url IS NOT NULL AND y IN (0, 1)").distinct()
    rows = rows.withColumn("h", F.md5(F.concat("url", F.lit(" "), F.col("y").cast("string")))).orderBy("h").limit(most_labelled)
    read = featured(rows, "url", buckets).select("h", "y", "_host", "_path")
    block = lambda c: read.select("h", "y", F.lit(c).alias("block"), F.explode(f"_{c}").alias("b"), (SCALE[c] / F.sqrt(F.size(f"_{c}"))).alias("v"))
    cells = block("host").union(block("path")).union(read.select("h", "y", F.lit("bias"), F.lit(0), F.lit(1.0)))
    other = cells.select(F.col("h").alias("h2"), "block", "b", F.col("v").alias("v2"))
    # inner products of rows; all share the constant, so every row has one with each
    products = cells.join(other, ["block", "b"]).groupBy("h", "y", "h2").agg(F.sum(F.col("v") * F.col("v2")).alias("k"))
    lists = products.groupBy("h", "y").agg(F.array_sort(F.collect_list(F.struct("h2", "k")))["k"].alias("k"))
    held = lists.agg(F.array_sort(F.collect_list(F.struct("h", "y", "k"))).alias("rows"))
    rate = "coalesce(4D / array_max(transform(rows, r -> aggregate(r.k, 0D, (s, v) -> s + v))), 0D)"
    step = f"""aggregate(sequence(1, {int(steps)}), transform(rows, r -> 0D), (a, i) -> transform(rows, (r, j) ->
        a[j] * (1 - rate * {penalty}D) - rate * (1 / (1 + exp(-aggregate(zip_with(r.k, a, (x, y) -> x * y), 0D, (s, v) -> s + v))) - r.y)))"""
    shares = held.select("rows", F.expr(rate).alias("rate")).select("rows", F.expr(step).alias("a")).select(F.inline(F.expr("transform(rows, (r, j) -> struct(r.h AS h, a[j] AS a))")))
    weights = cells.join(shares, "h").groupBy("block", "b").agg(F.round(F.sum(F.col("a") * F.col("v")) * 1_000_000).cast("long").alias("w"))
    out = {"bias": [0], "host": [0] * buckets, "path": [0] * buckets}
    for r in weights.collect():  # at most 2 * buckets + 1 rows
        out[r.block][r.b] = r.w
    return Model(out["bias"][0], out["host"], out["path"])


def judge(pages: DataFrame, model: Model, rules=RULES, id_col: str = "page_id", url_col: str = "url", buckets: int = BUCKETS) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_logit) of each row: the rule's verdict, else block where the logit is above 0."""
    read = featured(pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url")), "url", buckets)
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)

    def part(block: str) -> Column:
        w = F.from_json(F.lit(json.dumps(getattr(model, block))), "array<bigint>")  # folded to a constant
        total = F.aggregate(f"_{block}", F.lit(0).cast("long"), lambda s, b: s + F.get(w, b))
        return F.when(F.size(f"_{block}") > 0, SCALE[block] * total / F.sqrt(F.size(f"_{block}"))).otherwise(0.0)

    logit = (F.lit(model.bias) + part("host") + part("path")) / 1_000_000
    scored = read.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("own"), logit.alias("z"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("z") > 0, "block").otherwise("allow")).alias("verdict"), F.round("z", 6).alias("block_logit"))


def oracle(rules=RULES, buckets: int = BUCKETS, steps: int = STEPS, penalty: float = PENALTY, table: str = "pages") -> str:
    """DuckDB: the rows of judge(), training included."""
    values = ", ".join(f"('{u}', {y})" for u, y in labelled_rows())

    def hashed(codes: str, salt: int, n: int) -> str:
        h = str(salt)
        for j in range(n):
            h = f"(({h} * {BASE} + {codes}[i + {j}]) % {PRIME})"
        return f"list_transform(range(1, len({codes}) - {n - 2}), lambda i: {h} % {buckets})"

    def grams(codes: str, block: str) -> str:
        return f"list_distinct({' || '.join(hashed(codes, SALT[block], n) for n in SIZES)})"

    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, kind) for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))]
    rule, verdict = ("CASE " + " ".join(f"WHEN {f} THEN '{x[i]}'" for f, *x in fits) + " END" for i in (0, 1))
    codes = lambda text: f"list_transform(string_split(translate({text}, '123456789', '000000000'), ''), lambda c: CAST(unicode(c) AS BIGINT))"
    return f"""
    WITH RECURSIVE src AS (SELECT page_id, url, CAST(NULL AS INT) AS y, row_number() OVER () AS n FROM {table} UNION ALL SELECT NULL, u, y, -row_number() OVER () FROM (VALUES {values}) v(u, y)),
    rest AS (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM src),
    cut AS (SELECT * EXCLUDE (r), translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    coded AS (SELECT *, {codes("'^' || host || '$'")} AS hc, {codes("path || '$'")} AS pc FROM cut),
    f AS (SELECT * EXCLUDE (hc, pc), {grams("hc", "host")} AS h, {grams("pc", "path")} AS p FROM coded),
    cells AS (SELECT n, page_id, md5(url || ' ' || y) AS d, y, 'host' AS block, unnest(h) AS b, {SCALE["host"]} / sqrt(len(h)) AS v FROM f
        UNION ALL SELECT n, page_id, md5(url || ' ' || y), y, 'path', unnest(p), {SCALE["path"]} / sqrt(len(p)) FROM f UNION ALL SELECT n, page_id, md5(url || ' ' || y), y, 'bias', 0, 1.0 FROM f),
    own AS (SELECT * FROM cells WHERE y IS NOT NULL),
    products AS (SELECT a.d, a.y, b.d AS d2, sum(a.v * b.v) AS k FROM own a JOIN own b USING (block, b) GROUP BY ALL),
    lists AS (SELECT d, y, list(k ORDER BY d2) AS k FROM products GROUP BY d, y),
    m AS (SELECT list(k ORDER BY d) AS k, list(y ORDER BY d) AS y, list(d ORDER BY d) AS d FROM lists),
    m2 AS (SELECT *, 4 / list_max(list_transform(k, lambda r: list_sum(r))) AS rate FROM m),
    gd AS (SELECT 0 AS i, list_transform(y, lambda v: CAST(0 AS DOUBLE)) AS a FROM m2 UNION ALL
        SELECT i + 1, list_transform(range(1, len(y) + 1), lambda j: a[j] * (1 - rate * {penalty}) - rate * (1 / (1 + exp(-list_dot_product(k[j], a))) - y[j])) FROM gd, m2 WHERE i < {steps}),
    shares AS (SELECT unnest(d) AS d, unnest(a) AS a FROM gd, m2 WHERE i = {steps}),
    weights AS (SELECT block, b, CAST(round(sum(a * v) * 1000000) AS BIGINT) AS w FROM own JOIN shares USING (d) GROUP BY block, b),
    sums AS (SELECT n, block, any_value(v) AS v, sum(w) AS w FROM cells JOIN weights USING (block, b) WHERE y IS NULL GROUP BY n, block),
    z AS (SELECT n, (sum(w) FILTER (block = 'bias') + coalesce(sum(v * w) FILTER (block = 'host'), 0) + coalesce(sum(v * w) FILTER (block = 'path'), 0)) / 1000000 AS z FROM sums GROUP BY n)
    SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN z > 0 THEN 'block' ELSE 'allow' END) AS verdict, round(z, 6) AS block_logit FROM f JOIN z USING (n) WHERE y IS NULL"""
