"""URL verdicts: longest matching rule first, boosted trees for the rest.

With DataFrame functions and the DataFrame API of Spark's ML library alone.
URLs that a rule fits are the labelled ones. Gradient-boosted trees on lexical
features (lengths, depth, digit share, entropy, parameters, and what share of
labelled URLs with the same suffix or first section is blocked) learn from them
and judge the URLs that no rule fits. A labelled URL's own shares leave out the
labelled URLs of its fold (of ``FOLDS``, by the URL's hash), so that its label is
not among its features. The learner sees the ``FIT_ROWS`` labelled pages of
smallest URL hash; the shares count every labelled page.

A null url, or one without "://", has an empty host and path, no rule and the
model's verdict. Of rules of one length, which none are, the later listed would
win. Where labels of only one kind exist, that kind is the verdict; without any
labels the verdict is allow. A score of exactly one half is block. Very long
URLs are read whole. Pages that repeat are judged each and fall into one fold;
an empty table gives no rows. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, joined

#: (verdict, host, path): fixed by contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: The classifier is fitted on at most this many labelled pages.
FIT_ROWS = 20_000
TREES, DEPTH, FOLDS = 12, 4, 5
#: Suffixes or sections whose shares are broadcast; beyond it the join is salted.
BROADCAST_KEYS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENTROPY_OF = "abcdefghijklmnopqrstuvwxyz0123456789-._/%?=&"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, what, ""))).cast("double")


def _entropy(text: Column) -> Column:
    """Bits a character, over the usual characters of URLs."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    shares = F.transform(F.lit(list(_ENTROPY_OF)), lambda ch: (F.length(text) - F.length(F.replace(text, ch, F.lit("")))) / n)
    return F.aggregate(shares, F.lit(0.0), lambda total, p: total + F.when(p > 0, -p * F.log2(p)).otherwise(0.0))


def lexical(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule, ruled (the rule's verdict) and the lexical features."""
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    query = F.regexp_extract("url", r"(?s)\?([^#]*)", 1)
    length = F.greatest(F.length("url"), F.lit(1))
    parts = {
        "url_length": F.length("url").cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": _count(F.col("path"), "/"),
        "labels": _count(F.col("host"), "."),
        "digit_ratio": _count(F.col("url"), "0123456789") / length,
        "host_digits": _count(F.col("host"), "0123456789"),
        "hyphens": _count(F.col("host"), "-"),
        "marks": _count(F.col("url"), "%_~;,!@"),
        "parameters": F.when(query == "", 0.0).otherwise(_count(query, "&") + 1),
        "secure": F.col("url").startswith("https:").cast("double"),
        "fragment": F.col("url").contains("#").cast("double"),
        "host_entropy": _entropy(F.lower("host")),
        "path_entropy": _entropy(F.lower("path")),
    }
    return rows.select(
        "page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.regexp_extract("host", r"([^.]*)$", 1).alias("suffix"),
        F.regexp_extract("path", r"^/([^/]*)", 1).alias("section"), *(c.alias(f"f_{name}") for name, c in parts.items()),
    )


def _with_share(rows: DataFrame, key: str) -> DataFrame:
    """Adds the smoothed share of blocked pages among the labelled ones with the same suffix or section, and their number, out of fold."""
    bad = F.col("ruled") == "block"
    folds = range(FOLDS)
    counts = [F.count("*").alias("n"), F.count_if(bad).alias("bad")]
    counts += [x for f in folds for x in (F.count_if(F.col("fold") == f).alias(f"n{f}"), F.count_if((F.col("fold") == f) & bad).alias(f"bad{f}"))]
    told = cut(rows.filter("ruled is not null").groupBy(key).agg(*counts))
    own = lambda c: F.when(F.col("ruled").isNotNull(), F.get(F.array(*(F.col(f"{c}{f}") for f in folds)), F.col("fold"))).otherwise(0)
    n, b = F.coalesce(F.col("n") - own("n"), F.lit(0)), F.coalesce(F.col("bad") - own("bad"), F.lit(0))
    return joined(rows, told, key, BROADCAST_KEYS).select(*rows.columns, ((b + 1) / (n + 2)).alias(f"f_{key}"), F.log1p(n.cast("double")).alias(f"f_{key}_n"))


def verdicts(pages: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the method's share for block) for each row of ``pages``."""
    rows = lexical(pages).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int"))
    for key in ("suffix", "section"):
        rows = _with_share(rows, key)
    features = [c for c in rows.columns if c.startswith("f_")]
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    labelled = rows.filter("ruled is not null").withColumn("label", (F.col("ruled") == "block").cast("double"))
    # a fitting row is picked by its URL's hash, so a rerun picks the same
    fit = cut(labelled.select("features", "label", F.xxhash64("url").alias("h"), "page_id").orderBy("h", "page_id").limit(fit_rows).repartition(8).select("features", "label"))
    kinds = {r.label for r in fit.select("label").distinct().collect()}
    if len(kinds) == 2:
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=1, checkpointInterval=-1).fit(fit)
        rows = model.transform(rows)
        score = vector_to_array("probability")[1]
    else:
        score = F.lit(1.0 if kinds == {1.0} else 0.0)
    method = F.when(score >= 0.5, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), score.alias("score"))
