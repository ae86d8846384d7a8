"""URL filter: rules on host and path, and boosted trees for the rest.

A rule fits a url whose host is the rule's or below it and whose path starts with the rule's; the
longest rule that fits decides. Urls without a rule are judged by gradient-boosted trees on lexical
features: lengths, depth, share of digits, entropy of the characters, number of parameters, and how
often the suffix (last part of the host) was to be blocked among the labelled urls.

A labelled url that is fitted takes the statistics of its suffix from the urls of other folds (FOLDS, by
a hash of the url): with its own label in them, trees would only learn to read that back, and a suffix
nobody else has would look like proof. Urls that are judged get the statistics of all labelled rows.

The trees are fitted on at most SAMPLE different pairs of url and label, those with the least hash,
each with the number of its rows as weight, so the choice does not depend on order or partitions and
a url that has many of the rows is one pair. Of each label, one part in PARTS of the sample is kept,
or all its pairs if there are fewer; weights are scaled to the label's share of all rows. Everything
else covers all rows: the rates and counts of suffixes, the overall rate, and whether there are
labels of both kinds.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and is
judged by its features like any other; labels that are null are not used; without labels of both
kinds every url gets the only label there is, or ``allow``. Of rules of equal length that fit one url, the first
by name, then action, decides. A url of any length is one row of features; empty tables give empty results.
Columns of the input are kept whatever their names, but for host, path and ``judged``, which are replaced.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import others, written

SAMPLE = 20_000
# Each label has at least one part in so many of the sample.
PARTS = 20
TREES, DEPTH = 20, 3
FOLDS = 5
# Labelled urls of its own that a suffix needs to outweigh the overall rate.
PRIOR = 20
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)

FEATURES = [
    "_length", "_host_length", "_path_length", "_depth", "_labels", "_digits", "_entropy", "_parameters",
    "_hyphens", "_suffix_rate", "_suffix_count",
]
# Hashes are even over these numbers.
LEAST_HASH, HASHES = -(1 << 63), 1 << 64


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``; both empty where there is no ``://``."""
    start = F.instr(F.col(url), "://")
    rest = F.when(start > 0, F.substring(F.col(url), start + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    kept = others(df, ["host", "path"])
    return df.select(*kept, lowered.alias("host"), path.alias("path"))


def rule_of(rules: Sequence[Rule], what: str) -> Column:
    """``name`` or ``action`` of the longest rule that fits host and path, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name, r.action))

    def fits(rule: Rule) -> Column:
        host = (F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit(f".{rule.host}"))
        return host & F.startswith(F.col("path"), F.lit(rule.path))

    choices = [F.when(fits(rule), F.lit(getattr(rule, what))) for rule in ordered]
    return F.coalesce(*choices, F.lit(None).cast("string"))


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Add the features that need the url alone. The frame must have host and path."""
    text = F.coalesce(F.col(url), F.lit(""))
    n = F.length(text)
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    characters = F.array_remove(F.array_distinct(F.split(text, "")), "")
    entropy = F.aggregate(characters, F.lit(0.0), lambda h, c: h - share(c) * F.log2(share(c)))
    host_parts = F.split("host", r"\.")
    return df.withColumns(
        {
            "_length": n,
            "_host_length": F.length("host"),
            "_path_length": F.length("path"),
            "_depth": F.size(F.array_remove(F.split("path", "/"), "")),
            "_labels": F.size(host_parts),
            "_digits": F.when(n > 0, F.length(F.regexp_replace(text, "[^0-9]", "")) / n).otherwise(0.0),
            "_entropy": entropy,
            "_parameters": F.size(F.array_remove(F.split(query, "&"), "")),
            "_hyphens": F.length(F.regexp_replace(text, "[^-]", "")),
            "_suffix": F.element_at(host_parts, -1),
        }
    )


@dataclass
class Judge:
    """Fitted trees with the suffix statistics, or a fixed answer where there was nothing to fit."""

    model: PipelineModel | None
    suffixes: DataFrame | None
    overall: float

    def __call__(self, df: DataFrame, url: str = "url") -> DataFrame:
        """Add ``judged`` (allow or block). The frame must have host and path."""
        if self.model is None:
            return df.withColumn("judged", F.lit(BLOCK if self.overall > 0.5 else ALLOW))
        # Columns of the input travel as one, where none of the features' names can meet theirs.
        kept = F.struct(*others(df, ["judged"])).alias("_kept")
        rows = lexical(df.select(kept, F.col(url).alias("_url"), "host", "path"), "_url")
        answered = self.model.transform(with_suffixes(rows, self.suffixes, self.overall))
        judged = F.when(F.col("_prediction") > 0.5, BLOCK).otherwise(ALLOW)
        return answered.select("_kept.*", judged.alias("judged"))


def with_suffixes(rows: DataFrame, suffixes: DataFrame, overall: float, on: Sequence[str] = ("_suffix",)) -> DataFrame:
    """Add the statistics of the suffix; ``suffixes`` has no bound."""
    found = rows.join(suffixes, list(on), "left")
    return found.withColumns(
        {
            "_suffix_rate": F.coalesce("_suffix_rate", F.lit(overall)),
            "_suffix_count": F.coalesce("_suffix_count", F.lit(0)),
        }
    )


def _labelled(df: DataFrame, label: str, url: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).select(url, F.col(label).cast("double").alias("_label"))


def sampled(labelled: DataFrame, label: str = "block", url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """(url, _label, _weight): the ``sample`` pairs of least hash, or all if there are fewer, and how many rows each has.

    The pairs of least hash of each label come first, as many as its part. Pairs are about counted
    first. Only those whose hash is in a range that has some twice as many as asked for are grouped
    and sorted, so little of the rows is moved, however many there are.
    """
    rows = _labelled(labelled, label, url).withColumn("_hash", F.xxhash64(url, "_label"))
    about = dict(rows.groupBy("_label").agg(F.approx_count_distinct("_hash")).collect())
    part = max(1, sample // PARTS)

    def range_end(asked: int, pairs: int) -> int:
        return LEAST_HASH + min(HASHES - 1, HASHES * (2 * asked + 1000) // max(1, pairs))

    near = F.col("_hash") <= range_end(sample, sum(about.values()))
    for kind, pairs in about.items():
        near = near | ((F.col("_label") == kind) & (F.col("_hash") <= range_end(part, pairs)))
    pairs = rows.where(near).groupBy(url, "_label", "_hash").agg(F.count(F.lit(1)).cast("double").alias("_weight"))
    pairs = written(pairs, "labelled-pairs")
    first = F.lit(False)
    for kind in about:
        least = pairs.where(F.col("_label") == kind).orderBy("_hash").limit(part).agg(F.max("_hash")).first()[0]
        first = first | ((F.col("_label") == kind) & (F.col("_hash") <= least))
    return pairs.orderBy(first.desc(), "_hash", url, "_label").limit(sample).drop("_hash")


def fold_of(url: str) -> Column:
    return F.pmod(F.xxhash64(F.col(url), F.lit("fold")), F.lit(FOLDS)).cast("int")


def suffix_counts(labelled: DataFrame, label: str = "block", url: str = "url") -> DataFrame:
    """(_suffix, _fold, _suffix_count, _blocked): labelled rows of each suffix and fold, and those to be blocked."""
    rows = split_url(_labelled(labelled, label, url), url)
    suffix = F.element_at(F.split("host", r"\."), -1).alias("_suffix")
    rows = rows.groupBy(suffix, fold_of(url).alias("_fold"))
    return rows.agg(F.count(F.lit(1)).alias("_suffix_count"), F.sum("_label").alias("_blocked"))


def _rates(counts: DataFrame, overall: float) -> DataFrame:
    rate = (F.col("_blocked") + F.lit(PRIOR * overall)) / (F.col("_suffix_count") + PRIOR)
    return counts.withColumn("_suffix_rate", rate).drop("_blocked")


def of_other_folds(counts: DataFrame, overall: float) -> DataFrame:
    """(_suffix, _fold, _suffix_count, _suffix_rate) without the fold's own rows. A suffix has at most FOLDS rows."""
    every = Window.partitionBy("_suffix")
    rest = {c: F.sum(c).over(every) - F.col(c) for c in ("_suffix_count", "_blocked")}
    return _rates(counts.select("_suffix", "_fold", *(value.alias(c) for c, value in rest.items())), overall)


def fit(labelled: DataFrame, label: str = "block", url: str = "url", sample: int = SAMPLE) -> Judge:
    """Fit on rows with a url and ``label`` (1: block, 0: allow)."""
    counts = written(suffix_counts(labelled, label, url), "suffixes")
    n, blocked = counts.agg(F.sum("_suffix_count"), F.sum("_blocked")).first()
    overall = blocked / n if n else 0.0
    if overall in (0.0, 1.0):
        return Judge(None, None, overall)
    whole = counts.groupBy("_suffix").agg(F.sum("_suffix_count").alias("_suffix_count"), F.sum("_blocked").alias("_blocked"))
    suffixes = _rates(whole, overall)
    rows = written(lexical(split_url(sampled(labelled, label, url, sample), url), url), "labelled-urls")
    own_n, own_blocked = rows.agg(F.sum("_weight"), F.sum(F.col("_label") * F.col("_weight"))).first()
    share = own_blocked / own_n
    scale = F.when(F.col("_label") == 1, overall / share).otherwise((1 - overall) / (1 - share))
    rows = rows.withColumn("_weight", F.col("_weight") * scale)
    rows = with_suffixes(rows.withColumn("_fold", fold_of(url)), of_other_folds(counts, overall), overall, ["_suffix", "_fold"])
    trees = GBTClassifier(
        labelCol="_label", featuresCol="_features", predictionCol="_prediction", maxIter=TREES, maxDepth=DEPTH, seed=7,
        weightCol="_weight", checkpointInterval=-1,
    )
    trees.set(trees.rawPredictionCol, "_raw")
    trees.set(trees.probabilityCol, "_probability")
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="_features"), trees]
    return Judge(Pipeline(stages=stages).fit(rows), suffixes, overall)


def verdicts(pages: DataFrame, labelled: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    judge = fit(labelled)
    rows = judge(split_url(pages.select("page_id", "url")))
    return rows.select(
        "page_id",
        "host",
        "path",
        rule_of(rules, "name").alias("rule"),
        F.coalesce(rule_of(rules, "action"), "judged").alias("verdict"),
    )
