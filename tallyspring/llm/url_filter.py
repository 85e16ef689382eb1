"""URL filters: rules on host suffix and path prefix, and gradient-boosted trees for what no rule decides.

Features are lexical and built from Spark expressions; the trees are Spark's own, trained on a bounded sample of the
URLs that the rules label. Prediction is a projection; nothing but the statistics of suffixes is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspring.llm.storage import cut

#: Labelled URLs to train on, on average, drawn by hash; suffixes up to which statistics are sent to all tasks.
SAMPLE_URLS, BROADCAST_SUFFIXES = 20_000, 10_000
FEATURES = ["url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "entropy", "n_parameters", "suffix_share", "suffix_hosts", "suffix_block_rate"]


@dataclass(frozen=True)
class Rule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


#: The rules of the registered query.
RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching(rules: tuple[Rule, ...], value) -> Column:
    """``value`` of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def lexical(url: Column) -> dict[str, Column]:
    n = F.length(url)
    each = F.array_distinct(F.split(url, ""))

    def add(total: Column, c: Column) -> Column:
        k = (n - F.length(F.replace(url, c, F.lit("")))).cast("double")
        return total + F.when(k > 0, k * F.log2(k)).otherwise(0.0)

    empty = n == 0
    return {
        "url_length": n,
        "host_length": F.length("host"),
        "path_length": F.length("path"),
        "host_depth": F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit(""))),
        "path_depth": F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit(""))),
        "digit_ratio": F.when(empty, 0.0).otherwise((n - F.length(F.translate(url, "0123456789", ""))) / n),
        "entropy": F.when(empty, 0.0).otherwise(F.log2(F.greatest(n, F.lit(1)).cast("double")) - F.aggregate(each, F.lit(0.0), add) / n),
        "n_parameters": F.when(F.instr(url, "?") > 0, F.size(F.split(F.substring_index(F.substring_index(url, "?", -1), "#", 1), "&"))).otherwise(0),
    }


def judge(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE_URLS, seed: int = 11, fold: int | None = None) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, block_score.

    The longest rule that fits decides; else the trees do (``block`` where their score is over 0.5). A null URL counts
    as empty: host and path are empty and the trees judge it. Where the rules don't label URLs of both kinds there is
    nothing to learn and what no rule decides is allowed. Ids may be null or repeat. Other columns are left out.

    With ``fold`` (0 to 4), a fifth of the labels, by hash of the URL, are neither trained on nor counted in suffix
    rates, and the result is those URLs' id, by_rule and block_score alone: a held-out measure of the trees.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = host_and_path(url)
    rows = df.select(F.col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", matching(rules, lambda r: r.rule)).withColumn("by_rule", matching(rules, lambda r: r.verdict))
    rows = rows.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("h", F.xxhash64("url"))
    held = F.lit(False) if fold is None else F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(5)) == fold
    rows = rows.withColumn("label", F.when(~held, F.col("by_rule")))
    # a labelled URL's suffix rate leaves out the labels of its own half, its own among them
    half = F.pmod("h", F.lit(2))
    blocked, known = (F.col("label") == "block").cast("int"), F.col("label").isNotNull().cast("int")
    by_half = {f"{name}{k}": F.sum(F.when(half == k, c)) for name, c in (("blocked", blocked), ("known", known)) for k in (0, 1)}
    by_host = rows.groupBy("suffix", "host").agg(F.count("*").alias("n"), *(c.alias(n) for n, c in by_half.items()))
    sums = (F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("n", *by_half))
    stats = cut(by_host.groupBy("suffix").agg(F.count("*").alias("hosts"), *sums))
    n_suffixes, n_urls, n_known, n_blocked = stats.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", F.col("known0") + F.col("known1"), F.col("blocked0") + F.col("blocked1")))).first()
    stats = stats.select(F.col("suffix").alias("suffix2"), (F.col("n") / max(n_urls, 1)).alias("suffix_share"), F.col("hosts").cast("double").alias("suffix_hosts"), *by_half)
    stats = F.broadcast(stats) if n_suffixes <= BROADCAST_SUFFIXES else stats
    other = lambda name: F.when(F.col("label").isNull(), F.col(f"{name}0") + F.col(f"{name}1")).when(half == 0, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    rate = ((other("blocked") + 1) / (other("known") + 2)).alias("suffix_block_rate")
    features = [c.cast("double").alias(n) for n, c in lexical(F.col("url")).items()]
    ready = rows.join(stats, F.col("suffix") == F.col("suffix2")).select("page_id", "host", "path", "rule", "by_rule", "label", "h", *features, "suffix_share", "suffix_hosts", rate)
    if not 0 < n_blocked < n_known:
        judged = ready.withColumn("block_score", F.lit(0.0))
    else:
        drawn = F.pmod("h", F.lit(1 << 30)) < F.lit(int(min(1.0, sample / n_known) * (1 << 30)))
        labelled = cut(ready.filter(F.col("label").isNotNull() & drawn).select(*FEATURES, (F.col("label") == "block").cast("double").alias("label")))
        trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=8, maxDepth=4, maxBins=32, stepSize=0.3, seed=seed, cacheNodeIds=False)
        model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep"), trees]).fit(labelled)
        from pyspark.ml.functions import vector_to_array

        judged = model.transform(ready).withColumn("block_score", vector_to_array("probability")[1])
    if fold is not None:
        return judged.filter(F.col("by_rule").isNotNull() & F.col("label").isNull()).select(F.col("page_id").alias(id_col), "by_rule", "block_score")
    verdict = F.coalesce("by_rule", F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))
    return judged.select(F.col("page_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "block_score")
