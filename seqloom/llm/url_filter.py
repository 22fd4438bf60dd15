"""URL filters: prefix rules first, gradient-boosted trees on lexical features for the rest.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: what
follows up to ``?``, ``#`` or the end. A rule fits its host and all subdomains where the path starts with
the rule's path, and the longest rule decides. The trees are trained on the urls that rules decide, or on
any given labelled urls. Everything is DataFrame code and Spark's own MLlib; no Python runs per row.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is judged
by the trees from its (empty) features; equal urls get equal verdicts and repeated rows stay; with no
labelled url, or labels of one class only, the verdict is that class (``allow`` without any); an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import lower_ascii
from seqloom.operators.lookup import lookup
from seqloom.session import materialize

Rule = tuple[str, str, str]  # verdict, host, path
RULES: list[Rule] = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
SAMPLE_ROWS = 20_000  # bound of the labelled urls that one fit takes
FEATURES = (
    "url_length host_length path_length host_labels hyphens depth digit_ratio letter_ratio entropy parameters "
    "has_fragment secure suffix_log_count suffix_block_rate suffix_labelled"
).split()


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    cut = pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
    return cut.withColumns(
        {
            "host": lower_ascii(F.regexp_extract("_rest", r"^([^/?#]*)", 1)),
            "path": F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1),
        }
    ).drop("_rest")


def _first_rule(rules: list[Rule], give: int | None) -> Column:
    """The longest rule that fits, as its text or, with ``give`` 0, its verdict; else null."""
    out = None
    for rule in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        _, host, path = rule
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        value = F.lit(host + path if give is None else rule[give])
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


def _count(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def lexical(pages: DataFrame, url: str = "url") -> DataFrame:
    """Features of the text of a url; ``pages`` has ``host`` and ``path``. Adds ``suffix``, its last host label."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u)
    some = F.greatest(n, F.lit(1))
    with_chars = pages.withColumn("_chars", F.array_distinct(F.array_remove(F.split(u, ""), "")))
    shares = F.transform("_chars", lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / some)
    entropy = F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return with_chars.withColumns(
        {
            "suffix": F.element_at(F.split("host", r"\."), -1),
            "url_length": n.cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "host_labels": F.size(F.split("host", r"\.")).cast("double"),
            "hyphens": _count(F.col("host"), "[^-]").cast("double"),
            "depth": _count(F.col("path"), "[^/]").cast("double"),
            "digit_ratio": _count(u, "[^0-9]") / some,
            "letter_ratio": _count(u, "[^A-Za-z]") / some,
            "entropy": entropy,
            "parameters": F.size(F.array_remove(F.split(query, "[&;]"), "")).cast("double"),
            "has_fragment": F.contains(u, F.lit("#")).cast("double"),
            "secure": u.startswith("https://").cast("double"),
        }
    ).drop("_chars")


def with_suffix_statistics(urls: DataFrame) -> DataFrame:
    """Add how often a host's last label occurs, and how often its labelled urls are blocked.

    ``urls`` has ``suffix`` and ``label`` (1 block, 0 allow, null unlabelled). The counts cover all rows;
    they are summed before the shuffle, and :func:`lookup` brings them back, hot suffixes spread over many places.
    """
    blocked = F.coalesce(F.sum("label"), F.lit(0))
    counts = urls.groupBy("suffix").agg(
        F.count(F.lit(1)).alias("_n"), F.count("label").alias("_labelled"), blocked.alias("_blocked")
    )
    joined = lookup(urls, materialize(counts, "suffixes"), ["suffix"])
    return joined.withColumns(
        {
            "suffix_log_count": F.log1p(F.coalesce("_n", F.lit(0))),
            "suffix_labelled": F.log1p(F.coalesce("_labelled", F.lit(0))),
            "suffix_block_rate": (F.coalesce("_blocked", F.lit(0)) + 0.5) / (F.coalesce("_labelled", F.lit(0)) + 1.0),
        }
    ).drop("_n", "_labelled", "_blocked")


def fit(urls: DataFrame, sample_rows: int = SAMPLE_ROWS) -> GBTClassificationModel | str:
    """Trees trained on at most ``sample_rows`` distinct labelled feature rows, chosen by hash; or the
    constant verdict where labels do not hold two classes."""
    labelled = urls.where(F.col("label").isNotNull()).select("label", *FEATURES).distinct()
    sample = materialize(labelled.orderBy(F.xxhash64(*FEATURES), *FEATURES).limit(sample_rows), "urls")
    seen = {r[0] for r in sample.select("label").distinct().collect()}  # two values at most
    if len(seen) < 2:
        return "block" if seen == {1} else "allow"
    trees = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, seed=7, maxBins=64, labelCol="label", featuresCol="_f")
    # The sample is bounded, so a few tasks hold it at any input size.
    return trees.fit(VectorAssembler(inputCols=FEATURES, outputCol="_f").transform(sample.coalesce(4)))


def judge(pages: DataFrame, rules: list[Rule] = RULES, labels: Column | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row with a ``page_id`` and a ``url``.

    ``labels`` (1 block, 0 allow, null unknown) defaults to what the rules decide.
    """
    split = parts(pages.select("page_id", "url"))
    ruled = split.withColumns({"rule": _first_rule(rules, None), "_ruled": _first_rule(rules, 0)})
    label = F.when(F.col("_ruled") == "block", 1).when(F.col("_ruled") == "allow", 0) if labels is None else labels
    urls = materialize(with_suffix_statistics(lexical(ruled).withColumn("label", label.cast("int"))), "pages")
    model = fit(urls)
    if isinstance(model, str):
        judged = urls.withColumn("_method", F.lit(model))
    else:
        scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="_f").transform(urls))
        judged = scored.withColumn("_method", F.when(F.col("prediction") == 1, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_ruled", "_method").alias("verdict"))
