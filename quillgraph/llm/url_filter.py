"""URL filters: rules for hosts and paths, and a logistic regression where no rule fits. DataFrame functions only.

The regression's features are character n-grams of host and path, hashed, binary and scaled to unit length. It is
fitted by ``pyspark.ml`` on a small table of labelled URLs (LABELLED, a fixed size), never on the corpus, and scores each row by
itself: nothing is shuffled, so no host can be too frequent.

A rule fits its host and all subdomains, if the URL's path starts with the rule's path; of several the longest wins.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no rule, score 0 and is allowed; so is an
empty host. A host followed by nothing, ``?`` or ``#`` has the empty path, which no rule with ``/`` fits. A score of
exactly one half is allowed. Very long URLs are read whole; repeated rows each give a row; an empty table gives an empty
one. Other columns are handed on; one named like a result is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SIZES, SLOTS, ALLOW_WEIGHT = (3, 4, 5), 1 << 16, 2.0

#: Labelled URLs, for training and for the cross-validation in the tests.
LABELLED = {
    "block": """
        http://www.lucky-casino.com/slots https://casino-royal.net/bonus http://online-casino-spins.example/jackpot http://casino4you.biz/play/now https://mega-slots.info/free-spins
        http://slots-jackpot.example.org/en/7/ https://winbig-poker.example.com/en/610?page=2&ref=x https://poker-freeroll.net/win/cash http://m.roulette-win.com/en/12 https://bets-online.com/odds
        https://www.bet-now.example.org/en/204#top http://sure-bets.info/tips/77 http://freebet-bonus.net/en/5 https://sports-bets.example.com/de/90 http://m.betting-odds.example.net/de/58.html
        http://blog.winner-casino.example.net/fr/31 https://lottery-winner.info/claim/prize http://www.cheap-meds.example.net/en/330/ https://blog.buy-viagra.example.com/fr/81?utm_source=feed http://cialis-pharmacy.biz/cheap
        https://pills-discount.example.org/en/913 https://www.no-prescription-pills.com/buy https://cheap-tramadol.example.net/es/4.html https://diet-pills-fast.com/weight-loss http://cheap-watches-replica.com/rolex
        https://replica-handbags.net/cheap/lv http://m.cheap-cigarettes.org/buy https://cheapest-drugs.example.org/es/8 http://adult-cams.com/live http://xxx-videos.example.com/en/78?page=2&ref=x
        http://www.sex-tube.org/watch/1 https://m.hot-adult.example.org/en/550#top https://www.porn-free.example.net/de/402/ https://adultfriend-x.net/en/70 http://nude-cams-x.biz/chat
        https://escort-adult.com/city/paris http://xxx-pics.example.com/fr/19 https://m.adult-movies.example.net/en/21 http://erotic-stories-x.com/read https://sexy-singles.net/signup
        https://ad-tracker.example.com/en/9?utm_source=feed http://ads-clicks.example.net/en/87.html http://adserver-banner.com/ad/300 https://track.popup-ads.org/redirect http://ads-network.biz/serve?zone=4
        https://blog.click-track.example.org/fr/615 http://banner-ads-exchange.com/imp https://pixel-track.net/collect http://www.adstat-track.com/fr/3 https://popunder-ads.example.org/en/66
        http://link-farm.example.com/en/23?page=2&ref=x https://m.spam-links.example.com/en/18#top http://www.spam-blog.example.net/es/131 https://spamhost-farm.org/en/40 http://buy-backlinks-cheap.com/seo
        https://content-farm.example.org/en/705/ http://farm-of-links.net/directory https://seo-spam-network.com/page/2 http://m.doorway-spam.example.com/de/11 https://linkfarm-pages.example.net/en/2
        https://blog.payday-loans.example.org/en/488.html https://instant-cash-loans.net/now http://free-iphone.example.net/en/92 https://prize-claim-now.info/win http://work-from-home-cash.biz/rich
        https://crypto-doubler.net/invest http://secure-login-paypal.verify-account.info/update https://account-verify-bank.com/login https://www.free-gifts.example.com/de/720?utm_source=feed https://keygen-crack-warez.net/download
        http://warez-torrents.example.org/en/36/ https://free-cracks.org/serial/keygen http://hot-stocks-penny.biz/tip https://miracle-cure-pills.com/order/now
        https://adult-chat.example.com/en/61 http://www.adult-tube.example.net/de/12/ https://adult-sex-cams.org/live http://free-sex-porn.com/watch https://m.porn-tube.example.org/fr/9#top
        http://cheap-drugs-online.com/buy https://cheap-loans.example.net/en/300.html http://win-casino-cash.com/play https://blog.casino-games.example.com/es/77 http://win-free-cash.example.org/en/1?page=2&ref=x
        https://ads-pixel.example.net/en/402 http://tracker-ads.example.com/fr/18/ https://farm-links.example.org/de/5 http://spam-pages.example.net/en/640?utm_source=feed https://poker-bets.example.com/en/33
        https://free-spins-bets.net/bonus http://login-verify-account.net/update https://cracks-keygen.example.com/en/2 http://tramadol-pills.example.org/de/88 https://track-click-ads.com/redirect
    """,
    "allow": """
        https://en.wikipedia.org/wiki/Cat https://www.bbc.co.uk/news/world http://www.nytimes.com/2020/01/science.html https://docs.python.org/3/library/re.html https://spark.apache.org/docs/latest/
        http://www.gutenberg.org/ebooks/1342 https://www.lemonde.fr/culture/article/2019/ https://www.zeit.de/wissen/2021-03/ https://elpais.com/ciencia/2022/ https://www.nature.com/articles/d41586
        https://arxiv.org/abs/1706.03762 http://www.weather.gov/forecast/boston https://www.nasa.gov/mission/pages https://cs.stanford.edu/people/courses/ https://www.mit.edu/research
        https://github.com/apache/spark/pull/7 https://stackoverflow.com/questions/11227809 https://news.ycombinator.com/item?id=1 https://www.gov.uk/browse/benefits https://europa.eu/languages/de
        http://blog.gardening.example.com/en/853/ https://www.mathforum.example.org/de/252?page=2&ref=x http://recipes.example.net/fr/369#top https://travel-notes.example.com/es/977?utm_source=feed https://m.history.example.org/en/926.html
        https://ththng.example.com/en/742/ http://blog.anderth.example.net/en/588#top https://www.tionre.example.org/fr/964 https://m.onther.example.com/en/216.html http://erthing.example.net/de/448#top
        https://hering.example.org/en/380 http://www.restand.example.com/es/997.html https://blog.thation.example.net/en/20 https://entha.example.com/de/120/ http://m.ouring.example.org/fr/833?page=2&ref=x
        https://ndthe.example.net/en/99 https://www.lyther.example.com/en/864?utm_source=feed http://blog.stion.example.org/de/532 https://inthe.example.net/es/41/ https://m.areas.example.com/en/780#top
        https://library.city.example.org/catalog/item/4411 https://museum.example.org/exhibits/2021 https://school-district.org/calendar https://farmers-market.org/produce/apples https://trackandfield.org/results/2020
        https://www.winery-tours.com/visit https://better-health.org/exercise/running https://pharmacology.edu/course/101 https://www.adoption-center.org/pets https://address-book.net/help
        https://free-software.org/philosophy https://freedom-press.org/reports https://www.betterment-society.org/about https://alphabet-songs.net/kids https://windows-help.com/guides
        https://adventure-books.com/series/3 https://www.administration.gov/forms https://cashmere-knitting.com/patterns https://sussex-council.gov.uk/bins https://essex.ac.uk/study
        https://dairy-farm-museum.org/visit https://organic-farming.org/soil https://race-track-history.net/1950 https://soundtrack-reviews.com/film/9 https://linked-data.org/spec
        https://poetry.example.net/en/15 https://orchestra.example.org/program/4 http://chess-club.example.com/en/311 https://maths-olympiad.org/problems/2018 https://cycling-routes.net/alps/3
        https://blog.photography.example.com/de/42 https://www.tax-office.gov/guide/income https://train-timetable.net/stations https://river-watch.org/levels/7 https://www.hospital.org/patients/visiting
        https://bakery.example.com/fr/bread/8 https://astronomy.example.org/en/photos/1204 https://www.open-data.org/datasets/air http://linguistics.edu/papers/2009.pdf https://birds.net/species/robin
        https://heron.example.com/en/14 http://blog.ingthe.example.org/es/808/ https://athens.example.net/fr/36#top https://www.redand.example.com/de/611 http://m.seaing.example.net/en/202?page=2&ref=x
        https://github.com/pandas-dev/issues https://stackexchange.com/questions/77 https://www.adelaide.edu/study https://alps-hiking.net/routes/12 https://address-search.org/postcodes
        https://windmill-history.net/towers/4 https://camera-club.org/photos/2 https://farmhouse-cheese.com/recipes https://linking-libraries.org/members https://freedom-trail.org/walk
    """,
}


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


def rule_of(text: str, verdict: str) -> Rule:
    """A rule from host/path."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; empty without ://."""
    found = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(found, F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def decided(rules: list[Rule], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, else null: tried from the longest on, equal lengths in their order."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits(r, host, path), value) if out is None else out.when(fits(r, host, path), value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def grams(value: Column, field: str) -> Column:
    """Distinct n-grams of the value with marked ends, told apart by field."""
    whole = F.concat(F.lit("^"), value, F.lit("$"))
    every = F.concat(*[F.regexp_extract_all(whole, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in SIZES])  # one pass each, however long
    return F.transform(F.array_distinct(every), lambda g: F.concat(F.lit(field), g))


def features(host: Column, path: Column) -> Column:
    """n-grams of host and path, A-Z in lower case. Runs of digits count as one: their length and value tell little."""
    plain = lambda c: F.regexp_replace(F.translate(c, UPPER, LOWER), "[0-9]+", "0")
    return F.concat(grams(plain(host), "h"), grams(plain(path), "p"))


def labelled(spark: SparkSession) -> DataFrame:
    """url, label (1 for block) of LABELLED."""
    rows = [(u, float(kind == "block")) for kind, urls in LABELLED.items() for u in urls.split()]
    return spark.createDataFrame(rows, "url string, label double").coalesce(1)


def fit(rows: DataFrame, slots: int = SLOTS) -> PipelineModel:
    """The regression over rows (url, label). rows: a table of labelled URLs of a bounded size. A good URL that is blocked counts as much as ALLOW_WEIGHT bad ones that are not."""
    rows = rows.withColumns({"grams": features(host(F.col("url")), path(F.col("url"))), "weight": F.when(F.col("label") == 0, ALLOW_WEIGHT).otherwise(1.0)})
    stages = [HashingTF(inputCol="grams", outputCol="counts", numFeatures=slots, binary=True), Normalizer(inputCol="counts", outputCol="features"), LogisticRegression(weightCol="weight", maxIter=60, regParam=0.0005, standardization=False)]
    return Pipeline(stages=stages).fit(rows)


def judge(pages: DataFrame, model: PipelineModel, rules: list[Rule] = RULES, column: str = "url") -> DataFrame:
    """Every row of pages with host, path, rule, verdict and score (the regression's probability of block)."""
    result = ("host", "path", "rule", "verdict", "score")
    kept = [c for c in pages.columns if c.lower() not in result]
    own, taken = {}, list(pages.columns)
    for name in ("host", "path", "grams", "counts", "features", "raw", "probability", "prediction", "by"):
        own[name] = fresh("_" + name, taken)
        taken.append(own[name])
    tf, scale, regression = (s.copy() for s in model.stages)
    tf.setInputCol(own["grams"]).setOutputCol(own["counts"])
    scale.setInputCol(own["counts"]).setOutputCol(own["features"])
    regression.setFeaturesCol(own["features"]).setRawPredictionCol(own["raw"]).setProbabilityCol(own["probability"]).setPredictionCol(own["prediction"])
    url = F.col(f"`{column}`")
    rows = pages.withColumns({own["host"]: host(url), own["path"]: path(url)})
    at, way = F.col(own["host"]), F.col(own["path"])
    rows = rows.withColumns({own["grams"]: features(at, way), own["by"]: decided(rules, at, way)})
    rows = regression.transform(scale.transform(tf.transform(rows)))
    score = F.when(at == "", 0.0).otherwise(F.get(vector_to_array(F.col(own["probability"])), F.lit(1)))
    by = F.col(own["by"])
    verdict = F.coalesce(by["verdict"], F.when(score > 0.5, "block").otherwise("allow"))
    return rows.select(*[f"`{c}`" for c in kept], at.alias("host"), way.alias("path"), by["rule"].alias("rule"), verdict.alias("verdict"), score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: one row per page."""
    return judge(table(spark, sf_dir, "pages", "page_id", "url"), fit(labelled(spark))).select("page_id", "host", "path", "rule", "verdict", "score")


#: The regression is no SQL; host, path and rule are tested against a brute force.
ORACLE_SQL = None
