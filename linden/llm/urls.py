"""URL filter: rules first, gradient-boosted trees over lexical features for the rest.

Everything here is DataFrame expressions and Spark's own boosted trees.

* ``split_url`` cuts host and path; ``with_rule`` finds the longest fitting
  rule.  Rules are a bounded list, compiled into one ordered CASE: no join.
* ``with_features`` describes a URL's wording: length, depth, digit ratio,
  entropy, parameter counts, and how often its host suffix was blocked among
  the labelled URLs (suffix statistics, smoothed, joined by suffix).
* ``train`` fits the trees on labelled URLs; ``judge`` applies rule or model.

Nulls and edge cases: a URL that is null or lacks ``://`` has an empty host
and path, fits no rule and is judged by the model on features of an empty
text; repeated rows are kept; without labelled URLs of both verdicts the
model's verdict is the one label there is, or allow; an empty table gives no
rows; input columns named as a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linden.llm.common import written

MOST_RULES = 1000


@dataclass(frozen=True)
class Rule:
    """Verdict for a host, its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host`` and ``path``."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return pages.withColumns({"host": F.translate(host, upper, upper.lower()), "path": path})


def with_rule(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Pages with ``host`` and ``path`` get ``rule`` (text or null) and
    ``rule_verdict``.  The longest rule wins; among equally long ones the one
    with the longer host, then the first in order."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: the list is compiled into the plan")
    order = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text, r.verdict))

    def fits(r: Rule) -> Column:
        host = (F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")
        return host & F.col("path").startswith(r.path)

    def choose(value) -> Column:
        return reduce(lambda c, r: F.when(fits(r), F.lit(value(r))).otherwise(c), reversed(order), F.lit(None).cast("string"))

    return pages.withColumns({"rule": choose(lambda r: r.text), "rule_verdict": choose(lambda r: r.verdict)})


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits: one pass over each of the
    distinct characters (few, whatever the length)."""
    chars = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1))
    return F.aggregate(
        F.array_distinct(chars), F.lit(0.0),
        lambda total, c: total - F.when(c == "", 0.0).otherwise(
            (lambda p: p * F.log2(F.greatest(p, F.lit(1e-12))))((F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)))


FEATURES = ("url_length", "host_length", "path_length", "path_depth", "host_depth", "digit_ratio", "host_digit_ratio",
            "symbol_ratio", "upper_ratio", "entropy", "host_entropy", "parameters", "fragment", "longest_token",
            "last_digits", "secure", "suffix_blocked", "site_blocked", "section_blocked")


def _suffixes() -> dict[str, Column]:
    labels = F.split("host", r"\.")
    return {
        "suffix_key": F.element_at(labels, -1),
        "site_key": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
        "section_key": F.concat_ws("/", F.element_at(labels, -1), F.substring_index(F.substring("path", 2, 1 << 30), "/", 1)),
    }


def with_features(pages: DataFrame, statistics: DataFrame, url: str = "url") -> DataFrame:
    """Pages with ``host`` and ``path`` get the columns FEATURES."""
    text = F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    plain = {
        "url_length": F.length(text),
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "path_depth": F.regexp_count("path", F.lit("/")),
        "host_depth": F.regexp_count("host", F.lit(r"\.")),
        "digit_ratio": _share(text, "[0-9]"),
        "host_digit_ratio": _share(F.col("host"), "[0-9]"),
        "symbol_ratio": _share(text, r"[-_%~+=&]"),
        "upper_ratio": _share(text, "[A-Z]"),
        "entropy": _entropy(text),
        "host_entropy": _entropy(F.col("host")),
        "parameters": F.when(query == "", 0).otherwise(F.regexp_count(query, F.lit("&")) + 1),
        "fragment": F.instr(text, "#") > 0,
        "longest_token": F.array_max(F.transform(F.split(text, r"[^A-Za-z0-9]+"), lambda t: F.length(t))),
        "last_digits": F.length(F.regexp_extract("path", r"([0-9]+)[^0-9]*$", 1)),
        "secure": F.lower(F.substring(text, 1, 6)) == "https:",
    }
    out = pages.withColumns({k: v.cast("double") for k, v in plain.items()} | _suffixes())
    for kind in ("suffix", "site", "section"):
        own = statistics.where(F.col("kind") == kind).select(F.col("key").alias(f"{kind}_key"), F.col("blocked").alias(f"{kind}_blocked"))
        out = out.join(own, f"{kind}_key", "left").fillna(0.5, [f"{kind}_blocked"])
    return out.drop("suffix_key", "site_key", "section_key")


def suffix_statistics(labelled: DataFrame, smoothing: float = 4.0) -> DataFrame:
    """(kind, key, blocked): smoothed share of blocked URLs of each top-level
    suffix, of each two-label site, and of each suffix with first path part."""
    keys = F.explode(F.array(*[F.struct(F.lit(k.split("_")[0]).alias("kind"), c.alias("key")) for k, c in _suffixes().items()]))
    rows = labelled.select(keys.alias("k"), (F.col("label") == 1).cast("double").alias("label")).select("k.*", "label")
    return rows.groupBy("kind", "key").agg(
        ((F.sum("label") + smoothing / 2) / (F.count("*") + smoothing)).alias("blocked"))


@dataclass
class UrlModel:
    """Fitted trees with their suffix statistics, or one verdict for all."""

    trees: GBTClassificationModel | None
    statistics: DataFrame
    only: str = "allow"

    def judge(self, pages: DataFrame) -> DataFrame:
        """Pages with ``host`` and ``path`` get ``model_score`` (that they are
        to be blocked) and ``model_verdict``."""
        if self.trees is None:
            return pages.withColumns({"model_score": F.lit(float(self.only == "block")), "model_verdict": F.lit(self.only)})
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(pages, self.statistics))
        rows = self.trees.setFeaturesCol("features").transform(rows)
        rows = rows.withColumn("model_score", vector_to_array("probability")[1])
        return rows.drop("features", "rawPrediction", "probability", "prediction", *FEATURES) \
            .withColumn("model_verdict", F.when(F.col("model_score") >= 0.5, "block").otherwise("allow"))


def train(labelled: DataFrame, url: str = "url", most: int = 20_000, trees: int = 20, depth: int = 4, seed: int = 7) -> UrlModel:
    """Fit on rows (url, host, path, label 0 or 1).  The suffix statistics
    count every distinct labelled URL; the trees see at most ``most`` of them,
    those with the smallest hashes."""
    distinct = labelled.select(url, "host", "path", "label").distinct()
    statistics = written(suffix_statistics(distinct), "url-statistics")
    sample = written(distinct.orderBy(F.xxhash64(url), url, "label").limit(most), "labelled-urls")
    kinds = sorted(r.label for r in sample.select("label").distinct().collect())
    if len(kinds) < 2:
        return UrlModel(None, statistics, "block" if kinds == [1] else "allow")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(sample, statistics, url))
    fitted = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed,
                           stepSize=0.3).fit(rows.select("features", F.col("label").cast("double")))
    return UrlModel(fitted, statistics)


def filter_urls(pages: DataFrame, rules: list[Rule], model: UrlModel) -> DataFrame:
    """``pages`` (with ``url``) with host, path, rule, model_score and
    verdict: the rule's where one fits, else the model's."""
    rows = model.judge(with_rule(split_url(pages), rules))
    return rows.withColumn("verdict", F.coalesce("rule_verdict", "model_verdict")).drop("rule_verdict", "model_verdict")
