"""URL filters: explicit host and path rules first, then logistic regression on hashed character n-grams.

Everything runs as DataFrame operations: URLs are split by one regular expression, n-grams are cut by
higher-order functions, hashed by `HashingTF`, and the model is `pyspark.ml`'s logistic regression,
fitted on a bounded labelled sample and applied row by row without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: (rule, verdict): the rule is a host, a slash and the start of a path.
Rule = tuple[str, str]

#: Host words that name what such pages sell, the seed of the labelled table.
SEED_BLOCK_WORDS = ["ads", "adult", "bets", "casino", "pills", "spam"]

#: So many rules become one expression; longer lists are joined as a table.
MAX_RULES = 500


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased.
    Path: from there up to `?`, `#` or the end. Null or without `://`: both empty."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def rule_fits(rule: str, host: Column, path: Column) -> Column:
    """A rule fits its host and all subdomains, where the path starts with the rule's. A rule without a slash fits every path."""
    rule_host, slash, rest = rule.partition("/")
    return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rest)


def match_rules(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equally long ones the first in the alphabet.

    A rule that stands twice has the last of its verdicts in the alphabet (block before allow). Without a text or a verdict it is none.
    """
    rule = verdict = F.lit(None).cast("string")
    last = dict(sorted((text, says) for text, says in rules if text is not None and says is not None))
    for text, says in sorted(last.items(), key=lambda r: (-len(r[0]), r[0]), reverse=True):
        fits = rule_fits(text, host, path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def match_rule_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path and more) with rule and verdict as by `match_rules`, from a table (rule, verdict) of any length.

    A pair of host and path meets the rules by equality: with each of its host's suffixes, up to as many labels as a rule
    has, before each start of its path of a length that rules have. These lengths are few; only they come to the driver.
    """
    rules = rules.select("rule", "verdict").filter("rule is not null and verdict is not null").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("slash", F.instr("rule", "/")).withColumn("n", F.when(F.col("slash") > 0, F.length("rule") - F.col("slash") + 1).otherwise(0))
    shape = rules.agg(F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\."))).alias("labels"), F.collect_set("n").alias("lengths")).first()
    if not shape["lengths"]:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, shape["labels"] + 1)]))
    # A start as long as wanted only; a shorter path has none of that length.
    starts = F.filter(F.array(*[F.when(F.length("path") >= n, F.struct(F.substring("path", 1, n).alias("start"), F.lit(n).alias("n"))) for n in sorted(shape["lengths"])]), lambda x: x.isNotNull())
    pairs = urls.select("host", "path").distinct()
    keys = pairs.select("host", "path", F.explode(suffixes).alias("suffix"), starts.alias("starts")).select("host", "path", "suffix", F.explode("starts").alias("s"))
    # The lengths must agree, too: `a/b` is a host's rule with a path, and no host of that name.
    met = keys.select("host", "path", F.concat("suffix", "s.start").alias("rule"), "s.n").join(rules.drop("slash"), ["rule", "n"])
    best = met.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("n"), "rule", "verdict")).alias("b"))
    return urls.join(best.select("host", "path", "b.rule", "b.verdict"), ["host", "path"], "left")


def ngrams(text: Column, sizes: Sequence[int], mark: str) -> Column:
    """All character n-grams of ^text$, each with a mark for its field. One pass over the text for each size: a look-ahead matches at every character."""
    text = F.concat(F.lit("^"), F.coalesce(text, F.lit("")), F.lit("$"))

    def cut(n: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), 1), lambda g: F.concat(F.lit(f"{mark}{n}:"), g))

    parts = [cut(n) for n in sizes]
    return F.concat(*parts)


def url_grams(host: Column, path: Column) -> Column:
    """Host n-grams of 3 to 5 characters and path n-grams of 3; digits count as one class, so ids don't."""
    return F.concat(ngrams(host, (3, 4, 5), "h"), ngrams(F.regexp_replace(path, "[0-9]", "0"), (3,), "p"))


def labelled_urls(pages: DataFrame, url_col: str = "url", bound: int = 4000, words: Sequence[str] = SEED_BLOCK_WORDS) -> DataFrame:
    """The small labelled table (host, path, label): label 1 where a host word is a seed word, else 0.

    At most `bound` URLs of each label, the first in the order of a hash of the URL: a bounded sample,
    the same at every run. Distinct URLs only: of a label with many, those with a hash below a bound are told apart, not all.
    """
    host, path = split_url(F.col(url_col))
    named = pages.filter(F.col(url_col).isNotNull()).select(F.col(url_col).alias("u"), host.alias("host"), path.alias("path"), F.xxhash64(url_col).alias("h"))
    named = named.filter(F.col("host") != "").withColumn("label", F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, words))).cast("double"))
    sizes = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}  # two rows
    few = None
    for label in (1.0, 0.0):
        # Twice the share that would do: the estimate is off by some per cent.
        share = min(2 * bound / max(sizes.get(label, 0), 1), 1.0)
        some = named.filter((F.col("label") == label) & (F.col("h") / F.lit(float(1 << 64)) + 0.5 <= share)).distinct().orderBy("h", "u").limit(bound)
        few = some if few is None else few.unionByName(some)
    return few.select("host", "path", "label")


def fit(labelled: DataFrame, features: int = 1 << 14, rounds: int = 40, reg: float = 1e-3) -> PipelineModel | None:
    """Hashing and logistic regression; None where the labels hold fewer than two classes.

    The rows are ordered in one partition, so equal tables give equal models. They are few by construction.
    """
    rows = labelled.select(url_grams(F.col("host"), F.col("path")).alias("grams"), "label", "host", "path").coalesce(1).sortWithinPartitions("label", "host", "path")
    classes = rows.groupBy("label").count().collect()  # at most two rows
    if len(classes) < 2:
        return None
    total = sum(r["count"] for r in classes)
    weight = F.lit(0.0)
    for r in classes:
        weight = F.when(F.col("label") == r["label"], F.lit(total / (2 * r["count"]))).otherwise(weight)
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True)
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, regParam=reg).fit(hashing.transform(rows.withColumn("weight", weight)))
    return PipelineModel([hashing, model])


def score(urls: DataFrame, model: PipelineModel | None, host: str = "host", path: str = "path") -> Column | DataFrame:
    """Adds `p_block` (double), the model's probability; 0 without a model."""
    if model is None:
        return urls.withColumn("p_block", F.lit(0.0))
    rows = urls.withColumn("grams", url_grams(F.col(host), F.col(path)))
    made = ("grams", "features", "rawPrediction", "probability", "prediction")
    return model.transform(rows).withColumn("p_block", vector_to_array("probability")[1]).drop(*made)


def filter_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, p_block.

    rules: a list, or a table (rule, verdict); both are read alike (`match_rules`), whatever their length. verdict: the rule's where one fits, else `block` where p_block >= threshold, else `allow`.
    Null, empty and odd URLs have empty host and path and are judged like others; null ids, repeated
    rows and extra columns (which don't go on) need no care, since each row is judged alone. An empty table gives no rows.
    """
    model = fit(labelled)
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame) or len(rules) > MAX_RULES:
        named = rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(list(rules), "rule string, verdict string")
        rows = match_rule_table(rows, named)
    else:
        rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
        rows = rows.withColumns({"rule": rule, "verdict": verdict})
    judged = score(rows, model)
    return judged.withColumn("verdict", F.coalesce("verdict", F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))).select(id_col, "host", "path", "rule", "verdict", "p_block")
