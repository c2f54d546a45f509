"""URL filters: rules first, then gradient-boosted trees on lexical features.

Rules name a host and a path; a rule fits its host and all subdomains, if the url's path starts with the rule's. The longest fitting
rule decides. The urls that rules decide are the labelled urls, from which the trees learn to judge the rest. Features: lengths, depth, digit ratio,
entropy, numbers of parameters, separators and subdomains, and suffix statistics: the smoothed share of blocked urls under a host's last one and
last two labels.

Suffix statistics are counted over all labelled urls, each different url once, in folds: a url that trees are fitted on gets the share of the other folds,
so a suffix tells the trees what it will tell about urls they have not seen. Trees are fitted on a bounded sample, ``max_train`` different urls
(those with the smallest hashes).

Features, fitting and judging run on Spark alone, on narrow rows. Statistics are a table of any size, joined as Spark finds best; a suffix
under which many urls lie is split by adaptive execution.

Defined results: a null url, or one without ``://``, has an empty host and path; rules of equal length: the longer host wins; without a
labelled url of both kinds, the verdict is the only kind there is, and ``allow`` if there is none; a url labelled in both ways counts as both; equal urls get equal verdicts;
repeated rows give repeated results and weigh no more than one; an empty table gives an empty table; columns besides the key and url are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, written


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query's contract.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)

FEATURES = [
    "url_length", "host_length", "path_length", "query_length", "depth", "subdomains", "digit_ratio", "entropy",
    "parameters", "hyphens", "escapes", "longest_label", "last_label_blocked", "last_two_blocked",
]
SUFFIXES = ["last_label", "last_two"]
#: Parts of the labelled urls, each judged by the suffix statistics of the others.
FOLDS = 5


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and the rest, from after the first ``://``."""
    at = F.locate("://", url)
    tail = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(tail, r"^[^/?#]*", 0)
    after = F.substring(tail, F.length(host) + 1, F.length(tail))
    path = F.regexp_extract(after, r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    none = F.lit("")
    return F.coalesce(F.translate(host, upper, lower), none), F.coalesce(path, none), F.coalesce(F.substring(after, F.length(path) + 1, F.length(after)), none)


def with_rule(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` (null if none fits) to ``host, path``. The longest rule is asked first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith(f".{rule.host}")) & F.col("path").startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return df.withColumns({"rule": name, "rule_verdict": verdict})


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    share = F.transform(chars, lambda c: (n - F.length(F.replace(text, c))) / F.length(c) / n)
    return F.when(n > 0, -F.aggregate(share, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))).otherwise(0.0)


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features that need nothing but the url, and the two suffixes."""
    url, host, path, rest = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path"), F.col("rest")

    def count(text: Column, part: str) -> Column:
        return ((F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)).cast("double")

    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    query = F.regexp_extract(rest, r"^\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    return df.withColumns({
        "url_length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "query_length": F.length(query).cast("double"),
        "depth": count(path, "/"),
        "subdomains": count(host, "."),
        "digit_ratio": F.when(F.length(url) > 0, digits / F.length(url)).otherwise(0.0),
        "entropy": _entropy(url),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "hyphens": count(host, "-"),
        "escapes": count(url, "%"),
        "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double"),
        "last_label": F.substring_index(host, ".", -1),
        "last_two": F.substring_index(host, ".", -2),
    })


def suffix_counts(labelled: DataFrame, suffix: str) -> DataFrame:
    """``suffix, counts``: for each suffix the numbers of urls and of blocked urls in each fold. ``labelled``: ``url, label`` and the suffixes."""
    folds = labelled.groupBy(suffix, _fold(F.col("url")).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked"))
    whole = folds.groupBy(suffix).agg(F.collect_list(F.struct("fold", F.col("n").cast("double").alias("n"), "blocked")).alias("counts"))  # as many as there are folds
    return written(whole, "url-suffixes")


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(FOLDS), url), F.lit(FOLDS)).cast("int")


def _is_not(fold: Column) -> Callable[[Column], Column]:
    return lambda counted: counted["fold"] != fold


def with_suffix_statistics(df: DataFrame, counts: dict[str, DataFrame], own_fold: bool) -> DataFrame:
    """Adds the share of blocked urls under each suffix; without ``own_fold`` a url's own fold does not count."""
    for suffix, table_ in counts.items():
        fold = F.lit(-1) if own_fold else _fold(F.col("url"))
        others = F.filter("counts", _is_not(fold))
        n, blocked = (F.aggregate(others[x], F.lit(0.0), lambda a, b: a + b) for x in ("n", "blocked"))
        df = df.join(table_, suffix, "left").withColumn(f"{suffix}_blocked", F.coalesce((blocked + 1.0) / (n + 2.0), F.lit(0.5))).drop("counts")
    return df


def judge(urls: DataFrame, labelled: DataFrame, max_train: int = 20_000, trees: int = 10, depth: int = 4, seed: int = 7) -> DataFrame:
    """Adds ``verdict`` (allow or block) to ``url, host, path, rest``; ``labelled`` has these and ``label`` (1: block).

    ``max_train`` bounds the different urls that trees are fitted on; suffixes are counted over all.
    """
    different = written(lexical(labelled.select("url", "host", "path", "rest", "label").distinct()).select("url", "host", "path", "rest", "label", *SUFFIXES), "url-labelled")
    counts = {suffix: suffix_counts(different, suffix) for suffix in SUFFIXES}
    h, most = F.pmod(F.xxhash64("url"), F.lit(1 << 40)), max(1, different.count())
    # only hashes so small that about four times the sample passes are sorted: the sort's input does not grow with the table
    near = different.where(h * F.lit(float(most)) < 4.0 * max_train * (1 << 40)).orderBy(h, "url", "label").limit(max_train)
    sample = written(with_suffix_statistics(lexical(near.drop(*SUFFIXES)), counts, own_fold=False), "url-sample")
    kinds = [r.label for r in sample.select("label").distinct().collect()]
    if len(kinds) < 2:
        return urls.withColumn("verdict", F.lit("block" if 1.0 in kinds else "allow"))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    classifier = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.3)
    model = classifier.fit(assembler.transform(sample).select("features", "label").coalesce(4))
    scored = model.transform(assembler.transform(with_suffix_statistics(lexical(urls), counts, own_fold=True)))
    return scored.withColumn("verdict", F.when(F.col("prediction") == 1.0, "block").otherwise("allow")).select(*urls.columns, "verdict")


def filtered(df: DataFrame, key: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key, host, path, rule, verdict`` for every row."""
    host, path, rest = split_url(F.col("url"))
    parts = df.select(F.col(key).alias("_key"), "url").withColumns({"host": host, "path": path, "rest": rest})
    urls = with_rule(parts, rules)
    labelled = urls.where(F.col("rule").isNotNull()).select("url", "host", "path", "rest", (F.col("rule_verdict") == "block").cast("double").alias("label"))
    judged = judge(urls, labelled)
    return judged.select(F.col("_key").alias(key), "host", "path", "rule", F.coalesce("rule_verdict", "verdict").alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"), "page_id")
