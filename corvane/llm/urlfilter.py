"""URL filters: rules first, else logistic regression on hashed character n-grams of host and path.

Rules are (host, path, verdict); a rule fits its host and all subdomains where the url's path starts with the
rule's, and the longest rule wins. The classifier learns from a small labelled table of urls, which knows nothing of
the rules; `labelled_urls` is one. Its features
are the 3- and 4-grams of host and path, each marked with its side, hashed into `BUCKETS` counts.

Everything runs in the JVM: SQL functions cut the n-grams, MLlib fits and scores.

Defined cases: a null url or one without `://` has an empty host and path, fits no rule and is judged by the
classifier; repeated rows are judged alike; without labelled rows of both kinds every unruled url is allowed.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import given_back, set_aside

BUCKETS = 1 << 14
GRAMS = (3, 4)
#: Fixed values: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add `host` and `path`."""
    u = F.col(f"`{url}`")
    host = F.coalesce(lower_ascii(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return pages.withColumn("host", host).withColumn("path", path)


def rule_of(rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null where none does. Rules are a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(x: Column, n: int, mark: str) -> Column:
    padded = F.concat(F.lit("^"), x, F.lit("$"))
    places = F.sequence(F.lit(1), F.greatest(F.char_length(padded) - (n - 1), F.lit(1)))
    return F.transform(places, lambda k: F.concat(F.lit(mark), F.substring(padded, k, F.lit(n))))


def _features(pages: DataFrame) -> DataFrame:
    terms = F.concat(*[_grams(F.col(c), n, c[0]) for c in ("host", "path") for n in GRAMS])
    return HashingTF(inputCol="__terms", outputCol="__features", numFeatures=BUCKETS).transform(pages.withColumn("__terms", terms)).drop("__terms")


def judge(pages: DataFrame, labelled: DataFrame, *, url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = 0.5, most_labelled: int = 50_000) -> DataFrame:
    """Add `host`, `path`, `rule`, `block_score` and `verdict`; such columns, in any case of letters, are replaced.

    `labelled`: (url, label), 1 for block; a small table, fitted in one partition so that reruns agree. Of a larger
    one about `most_labelled` rows are used, picked by a hash of the url.
    """
    n = labelled.count()
    if n > most_labelled:
        labelled = labelled.where(F.pmod(F.xxhash64(F.lit(10), "url"), F.lit(1 << 20)) < (1 << 20) * most_labelled // n)
    learned = with_parts(labelled.select(F.col("url"), F.col("label").cast("double")).where("label is not null")).orderBy("url", "label").coalesce(1)
    learned = _features(learned).select("__features", "label").cache()
    kinds = [r[0] for r in learned.select("label").distinct().collect()]
    pages, renamed = set_aside(pages, "__rule", "__terms", "__features", "__raw", "__p", "__guess")
    pages = with_parts(pages.drop("host", "path", "rule", "block_score", "verdict"), renamed.get(url, url)).withColumn("__rule", rule_of(rules))
    if len(kinds) < 2:
        scored = pages.withColumn("block_score", F.lit(0.0))
    else:
        model = LogisticRegression(featuresCol="__features", labelCol="label", regParam=0.001, maxIter=60, rawPredictionCol="__raw", probabilityCol="__p", predictionCol="__guess").fit(learned)
        scored = model.transform(_features(pages)).withColumn("block_score", vector_to_array("__p")[1]).drop("__raw", "__p", "__guess", "__features")
    learned.unpersist()
    guess = F.when(F.col("block_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    judged = scored.withColumn("verdict", F.coalesce(F.col("__rule.verdict"), guess)).withColumn("rule", F.col("__rule.rule")).drop("__rule")
    return given_back(judged, renamed)


#: Words that tell, in hosts or paths, and forms of urls: the labelled table is made of each word in each form.
BLOCKED_WORDS = ("casino", "poker", "jackpot", "betting", "slots", "pills", "viagra", "xxx", "porn", "escort", "warez", "torrent", "keygen", "cracked", "payday-loan", "get-rich", "free-gift", "click-here", "replica-watch", "spam")
ALLOWED_WORDS = ("wiki", "news", "library", "museum", "university", "science", "history", "weather", "recipes", "gardening", "docs", "tutorial", "research", "health", "travel", "sports", "music", "blog", "events", "council")
URL_FORMS = ("http://www.{}.com/index.html", "https://{}.example.net/en/12", "http://best-{}.info/", "https://site.net/{}/page/3", "http://m.host.org.uk/a/{}-2.html")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, label): 1 for block. Every word of both lists in every form, 200 rows."""
    words = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(label).alias("label")) for label, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)) for w in words])
    rows = spark.range(1).select(F.explode(words).alias("w")).select("w.*", F.explode(F.array(*[F.lit(f) for f in URL_FORMS])).alias("form"))
    return rows.select(F.replace("form", F.lit("{}"), F.col("word")).alias("url"), "label")
