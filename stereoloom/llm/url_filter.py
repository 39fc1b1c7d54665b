"""URL filter: rules by host and path, and for the rest a logistic regression on hashed character n-grams.

All of it is DataFrame expressions. The regression is fitted in its dual form:
weights are sums of the labelled URLs' feature vectors, so gradient descent
moves one number a labelled URL and needs only how many n-grams two URLs share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
STEPS, DECAY = 400, 0.002
#: Log odds of a URL that nothing is known of: it passes.
PRIOR = -1.0
#: The labelled table meets in one row, whose dual form has the square of this many numbers.
MOST_LABELLED = 2000

#: Rules of the registered query: verdict, host, start of the path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

# Labelled URLs of invented hosts, unwanted ones first.
UNWANTED = """
http://best-casino-bonus.info/en/12 https://www.online-casino.biz/slots http://casino-royal-win.net/fr/871 https://win-big-casino.co/en/1
http://free-casino-spins.com/register http://lucky-slots.info/en/win http://www.poker-bets.net/bonus https://sports-betting-tips.com/de/free
http://bets-online.info/odds https://free-bets-today.net/en/offer http://bet-win-now.com/ http://www.cheap-meds.biz/en/640/
https://buy-cheap-pills.com/checkout http://discount-pills-online.net/es/51 http://viagra-pills.info/cheap http://pills-shop.biz/en/cart
https://cheap-watches-replica.com/sale http://www.cheap-loans-now.net/en/98.html http://payday-loans-fast.info/apply http://adult-videos.biz/en/watch
https://www.adult-dating.net/join http://xxx-adult-cams.com/en/33 http://hot-adult-x.info/fr/7 https://adult-chat.co/room http://sexy-singles-x.com/meet
http://porn-tube-x.net/videos https://ads-server.net/en/4 http://ads-tracker.com/pixel http://track-clicks.biz/de/15 https://adserv-track.info/imp
http://popup-ads.net/en/210 http://click-track-ads.com/go http://link-farm.info/links https://seo-link-farm.biz/en/9 http://spam-links.net/es/list
http://spam-blog-farm.com/en/77 http://backlink-spam.biz/buy http://content-farm.info/articles/81 https://free-download-crack.com/serial
http://warez-cracks.net/keygen http://free-ringtones.biz/en/5 http://win-free-iphone.info/claim http://you-win-prize.net/en/402 http://miracle-weight-loss.biz/pills
http://get-rich-quick.info/join https://crypto-doubler.biz/en/win http://cheap-essay-writing.info/order http://torrent-free-movies.biz/fr/watch
""".split()
WANTED = """
https://www.stonebridge-library.org/catalogue/44 https://news.harbourpost.com/en/world/2021 https://blog.quietgarden.net/en/531 http://www.northlake-college.edu/courses
https://en.openatlas.org/wiki/River https://docs.blueheron.io/guide/install https://museum.old-town.co/exhibits https://www.rivervalley-school.org/staff
https://journal.plant-science.org/articles/118 http://weather.hilltop.net/forecast https://blog.martinsworkshop.com/en/853/ https://www.thornfield.co/en/474.html
https://forum.woodcraft.net/topic/671 https://research.lakeside.edu/papers/2019 https://m.dailyherald.com/fr/144.html https://www.city-hall.info/es/services
https://recipes.grandmother.net/de/252.html https://www.walking-trails.org/maps https://open-data.statistics.info/tables/12 https://blog.thehistorian.com/en/325
http://www.thinkers.org/essays/platon https://theatre.brightstage.com/en/echo https://m.trainspotters.net/photos https://physics.northern.edu/lectures/3
https://thesis.archive-house.com/view/97 http://chess-club.riverside.org/games https://m.birdwatch.net/en/heron https://astronomy.hill-top.biz/news
https://www.translation-notes.com/fr/825 https://health.county-clinics.info/en/88 https://www.nursing-journal.org/issue/7 https://www.transport-times.co/en/timetable
https://music.oldrecords.net/artists https://law.review-pages.com/cases/2003 https://blog.another-day.com/en/960 https://www.mathnotes.org/en/algebra
https://wiki.gardeners.net/en/roses https://maps.terrain.biz/tiles https://www.philharmonic.org/season https://books.corner.net/en/685
https://www.inventions.info/patents/5 https://support.printerworks.com/en/manuals https://www.theherald.biz/es/799 https://status.cloudnine.io/history
https://www.harvest-market.org/vendors https://kernel.devnotes.net/en/scheduler https://www.ancient-history.biz/rome https://thread.needlework.net/en/217
""".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): the fixed table; label 1 is unwanted."""
    return spark.createDataFrame([(u, 1) for u in UNWANTED] + [(u, 0) for u in WANTED], "url string, label int")


def folded(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(folded(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def features(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Distinct buckets of the n-grams of host and path, each between ``^`` and ``$``; one pass over a URL however long it is."""
    def bucket(kind: str):
        return lambda gram: F.conv(F.substring(F.md5(F.concat(F.lit(kind), gram).cast("binary")), 1, 8), 16, 10).cast("long") % buckets

    grams = []
    for kind, text in (("h", host), ("p", path)):
        for n in GRAMS:
            found = F.regexp_extract_all(F.concat(F.lit("^"), text, F.lit("$")), F.lit(f"(?s)(?=(.{{{n}}}))"), 1)
            grams.append(F.transform(found, bucket(kind)))
    return F.array_distinct(F.concat(*grams))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none does.

    A rule fits its host and all subdomains where the path starts as it says.
    Of rules of equal length the one with the longer host wins.
    """
    name = verdict = F.lit(None).cast("string")
    for what, rule_host, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(start)
        name, verdict = F.when(fits, rule_host + start).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.exp(-x) + 1.0)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def fit(labelled: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row ``weights``: a weight for each bucket; log odds are ``PRIOR`` and the scaled sum of a URL's weights.

    Rows with null url or label are left out; equal rows count once. Features
    of a URL are scaled to unit length, gradients are those of the whole
    table, so the result depends on no order. The step is four over the
    greatest row sum of likenesses, which bounds the curvature. More than ``MOST_LABELLED`` rows
    raise; an empty table gives weights of 0 (everything is allowed).
    """
    rows = labelled.select("url", F.col("label").cast("double").alias("y")).na.drop().distinct()
    rows = rows.withColumn("f", features(host_of(F.col("url")), path_of(F.col("url")), buckets))
    one = rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("url", "y", "f"))).alias("rows"))
    one = one.filter(F.when(F.size("rows") > MOST_LABELLED, F.raise_error(F.lit(f"more than {MOST_LABELLED} labelled URLs")).cast("boolean")).otherwise(True))

    def likeness(a: Column, b: Column) -> Column:
        return F.size(F.array_intersect(a.f, b.f)).cast("double") / F.sqrt((F.size(a.f) * F.size(b.f)).cast("double"))

    one = one.withColumn("alike", F.transform("rows", lambda a: F.transform(F.col("rows"), lambda b: likeness(a, b))))
    one = one.withColumn("rate", F.lit(4.0) / F.array_max(F.transform("alike", lambda k: F.aggregate(k, F.lit(0.0), lambda x, y: x + y))))

    def step(alpha: Column, _: Column) -> Column:
        error = F.zip_with("alike", "rows", lambda k, r: r.y - _sigmoid(_dot(k, alpha) + PRIOR))
        return F.zip_with(alpha, error, lambda a, e: a * (F.lit(1.0) - F.col("rate") * DECAY) + e * F.col("rate"))

    alpha = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.transform("rows", lambda _: F.lit(0.0)), step)
    learned = one.select(F.inline(F.arrays_zip(alpha.alias("alpha"), F.col("rows").alias("row"))))
    # a feature's weight sums the scaled numbers of the URLs that have it
    weight = learned.select(F.explode("row.f").alias("at"), (F.col("alpha") / F.sqrt(F.size("row.f").cast("double"))).alias("w")).groupBy("at").agg(F.sum("w").alias("w"))
    dense = labelled.sparkSession.range(buckets).withColumnRenamed("id", "at").join(weight, "at", "left").select("at", F.coalesce("w", F.lit(0.0)).alias("w"))
    return dense.groupBy().agg(F.sort_array(F.collect_list(F.struct("at", "w"))).alias("cells")).select(F.col("cells.w").alias("weights"))


def block_score(host: Column, path: Column, model: DataFrame, buckets: int = BUCKETS) -> Column:
    """Probability that a URL is unwanted. The model's one row, of a size that ``buckets`` fixes, becomes a constant of the plan."""
    text = model.select(F.array_join(F.transform("weights", lambda w: F.when(w == 0.0, "0").otherwise(w.cast("string"))), " ").alias("w")).first().w
    weights = F.split(F.lit(text), " ").cast("array<double>")
    f = features(host, path, buckets)
    total = F.aggregate(f, F.lit(0.0), lambda s, at: s + F.element_at(weights, (at + 1).cast("int")))
    return _sigmoid(F.when(F.size(f) > 0, total / F.sqrt(F.size(f).cast("double"))).otherwise(0.0) + PRIOR)


def url_filter(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): one row for each row of ``pages(page_id, url)``.

    The longest fitting rule decides; where none fits, a score of 0.5 or more
    blocks. Null urls and those without ``://`` have an empty host and path,
    fit no rule and are judged by the prior alone, so they pass.
    ``score`` is rounded to six places. Repeated rows are judged each, an
    empty table gives no rows; other columns are not read. ``rules`` stand in
    the plan, so they are meant to be some dozens.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), block_score(F.col("host"), F.col("path"), fit(labelled)).alias("p"))
    learned = F.when(F.col("p") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), F.round("p", 6).alias("score"))


def sql() -> str:
    """DuckDB form of the registered query: the same fit as a recursive query over the dual numbers."""
    table = ", ".join(f"('{u}', {y}::DOUBLE)" for y, urls in ((1, UNWANTED), (0, WANTED)) for u in urls)
    grams = " || ".join(
        f"list_transform(range(1, greatest(length({text}) + 2 - {n} + 2, 1)), lambda i: '{kind}' || substr('^' || {text} || '$', i, {n}))" for kind, text in (("h", "host"), ("p", "path")) for n in GRAMS
    )
    buckets = f"list_sort(list_distinct(list_transform({grams}, lambda g: ('0x' || substr(md5(g), 1, 8))::BIGINT % {BUCKETS})))"
    host = "coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    path = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    fits = [(f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{s}')", h + s, v) for v, h, s in sorted(RULES, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1])))]
    case = lambda i: "CASE " + " ".join(f"WHEN {x[0]} THEN '{x[i]}'" for x in fits) + " END"
    return f"""
WITH RECURSIVE labelled AS (SELECT row_number() OVER (ORDER BY url) AS u, y, {buckets} AS f FROM (SELECT url, y, {host} AS host, {path} AS path FROM (VALUES {table}) t(url, y))),
alike AS (SELECT a.u, list(len(list_intersect(a.f, b.f))::DOUBLE / sqrt((len(a.f) * len(b.f))::DOUBLE) ORDER BY b.u) AS k FROM labelled a, labelled b GROUP BY a.u),
whole AS (SELECT list(k ORDER BY u) AS k, list(y ORDER BY u) AS y, 4.0 / max(list_sum(k)) AS rate FROM alike JOIN labelled USING (u)),
steps AS (SELECT 0 AS i, list_transform(y, lambda x: 0.0::DOUBLE) AS a FROM whole UNION ALL
    SELECT i + 1, list_transform(range(1, len(a) + 1), lambda j: a[j] * (1.0 - rate * {DECAY}::DOUBLE) + (y[j] - 1.0 / (exp(-(list_inner_product(k[j], a) + {PRIOR})) + 1.0)) * rate) FROM steps, whole WHERE i < {STEPS}),
alpha AS (SELECT unnest(range(1, len(a) + 1)) AS u, unnest(a) AS alpha FROM steps WHERE i = {STEPS}),
weights AS (SELECT f, sum(w) AS w FROM (SELECT unnest(f) AS f, alpha / sqrt(len(f)::DOUBLE) AS w FROM labelled JOIN alpha USING (u)) GROUP BY f),
parts AS (SELECT row_number() OVER () AS row, page_id, {host} AS host, {path} AS path FROM pages),
framed AS (SELECT row, {buckets} AS f FROM parts),
summed AS (SELECT row, max(size) AS size, sum(w) AS s FROM (SELECT row, len(f) AS size, unnest(f) AS f FROM framed) LEFT JOIN weights USING (f) GROUP BY row),
scored AS (SELECT p.*, 1.0 / (exp(-(coalesce(s / sqrt(size::DOUBLE), 0.0) + {PRIOR})) + 1.0) AS p FROM parts p LEFT JOIN summed USING (row))
SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(2)}, CASE WHEN p >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(p, 6) AS score FROM scored
"""
