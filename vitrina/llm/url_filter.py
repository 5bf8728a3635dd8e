r"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case.
Path: then up to ``?``, ``#`` or the end.  A rule ``host/path`` fits its host and all
subdomains if the path starts with the rule's; the longest rule wins.

The trees learn from labelled URLs (by default those that a rule decides): length, depth,
shares of digits and of other signs, entropy of the characters, numbers of parameters,
labels and hyphens, lengths of host and longest segment, and how often URLs of the same
last label and of the same last two labels are blocked.  These statistics count all labelled
rows; a labelled URL's own labels are left out of them.  At most ``sample`` distinct labelled
URLs, the first by hash of the URL, are used to fit the trees; every URL is judged.

DataFrame functions and Spark's own boosted trees only.  Labelled URLs are grouped with partial
sums, to count suffixes and to find the distinct ones; all URLs are joined with the suffix
statistics, which are tables of any size.

Edge cases: a null URL, or one without ``://``, has empty host and path and gets the
trees' verdict like any other (if there are labelled URLs of one class only: that class; if only
the sample has one class: the class of most labels;
if there are none: allow).  Repeated rows get the same verdict; a null id passes.  Empty
tables give an empty result.  Only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import cut_lineage

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "digit_share", "sign_share", "entropy", "parameters",
    "labels", "hyphens", "longest_segment", "fragment", "secure", "suffix_1", "suffix_2",
)


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return _lower(host), path


def rule_of(host: Column, path: Column, rules: dict[str, bool]) -> Column:
    """The longest rule that fits, else null.  ``rules``: ``host/path`` to whether it blocks."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Entropy of the characters in bits: from the runs of the sorted characters."""
    n = F.length(text)
    state = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))

    def weight(run: Column) -> Column:
        return F.when(run > 0, run * F.log2(run.cast("double"))).otherwise(F.lit(0.0))

    total = F.aggregate(
        F.array_sort(F.split(text, "")), state,
        lambda s, c: F.when(s["last"] == c, F.struct(c.alias("last"), (s["run"] + 1).alias("run"), s["sum"].alias("sum"))).otherwise(
            F.struct(c.alias("last"), F.lit(1).alias("run"), (s["sum"] + weight(s["run"])).alias("sum"))),
        lambda s: s["sum"] + weight(s["run"]))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(F.lit(0.0))


def _suffixes() -> tuple[Column, Column]:
    """Last label and last two labels of ``host``."""
    labels = F.reverse(F.split("host", r"\."))
    return F.get(labels, F.lit(0)).alias("last_1"), F.concat_ws(".", F.get(labels, F.lit(1)), F.get(labels, F.lit(0))).alias("last_2")


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that need nothing but ``url``, ``host`` and ``path``."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    segments = F.transform(F.split("path", "/"), lambda s: F.length(s))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    suffix = F.reverse(F.split("host", r"\."))
    return urls.select(
        "*",
        F.length(url).alias("url_length"), F.length("host").alias("host_length"), F.length("path").alias("path_length"),
        F.size(F.filter(segments, lambda x: x > 0)).alias("depth"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / n).alias("digit_share"),
        (F.length(F.regexp_replace(url, "[A-Za-z0-9]", "")) / n).alias("sign_share"),
        _entropy(url).alias("entropy"),
        F.when(query != "", F.length(F.regexp_replace(query, "[^&;]", "")) + 1).otherwise(0).alias("parameters"),
        F.size(suffix).alias("labels"), F.length(F.regexp_replace("host", "[^-]", "")).alias("hyphens"),
        F.coalesce(F.array_max(segments), F.lit(0)).alias("longest_segment"),
        F.contains(url, F.lit("#")).cast("int").alias("fragment"), url.startswith("https").cast("int").alias("secure"),
        *_suffixes(),
    )


def _with_suffixes(rows: DataFrame, statistics: dict[str, DataFrame], share: float, own: bool, strength: float = 4.0) -> DataFrame:
    """Adds smoothed shares of blocked URLs per suffix; ``own``: without the ``copies`` of the row's own label."""
    for name, table in statistics.items():
        rows = rows.join(table, name, "left")
        n, blocked = F.coalesce(f"{name}_n", F.lit(0)), F.coalesce(f"{name}_blocked", F.lit(0))
        if own:
            n, blocked = n - F.col("copies"), blocked - F.col("copies") * F.col("label")
        rows = rows.withColumn(name.replace("last", "suffix"), (blocked + strength * share) / (n + strength))
    return rows


def judge_urls(pages: DataFrame, rules: dict[str, bool], labelled: DataFrame | None = None,
               sample: int = 20_000, trees: int = 12, depth: int = 4, seed: int = 7) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` per row; ``score`` is the trees' probability of block.

    ``labelled``: rows of ``url`` and ``label`` (1: block); by default what the rules decide.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    blocks = [r for r in rules if rules[r]]
    if labelled is None:
        known = rows.filter("rule is not null").select("url", "host", "path", F.col("rule").isin(blocks).cast("int").alias("label"))
    else:
        known = labelled.filter("url is not null and label is not null").select(
            "url", F.col("label").cast("int").alias("label")).withColumn("host", host).withColumn("path", path)
    suffixes = cut_lineage(known.select(*_suffixes(), "label").groupBy("last_1", "last_2").agg(
        F.count("*").alias("n"), F.sum("label").alias("blocked")))
    counts = suffixes.agg(F.sum("n").alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked")).first()
    share = counts["blocked"] / counts["n"] if counts["n"] else 0.0
    distinct = known.groupBy("url", "host", "path", "label").agg(F.count("*").alias("copies"))
    train = cut_lineage(lexical(distinct.orderBy(F.xxhash64(F.lit(seed), "url"), "url", "label").limit(sample)).coalesce(1))
    if share in (0.0, 1.0) or train.agg(F.count_distinct("label").alias("n")).first()["n"] < 2:
        scored = rows.withColumn("score", F.lit(share))
    else:
        statistics = {
            name: suffixes.groupBy(name).agg(F.sum("n").alias(f"{name}_n"), F.sum("blocked").alias(f"{name}_blocked"))
            for name in ("last_1", "last_2")
        }
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        fitted = cut_lineage(
            _with_suffixes(train, statistics, share, own=True).orderBy("url", "label").select(*FEATURES, "label").coalesce(1))
        model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=seed, stepSize=0.3).fit(
            assembler.transform(fitted).select("features", "label"))
        ready = assembler.transform(_with_suffixes(lexical(rows), statistics, share, own=False))
        scored = model.transform(ready).withColumn("score", vector_to_array("probability")[1])
    verdict = F.when(F.col("rule").isNotNull(), F.when(F.col("rule").isin(blocks), "block").otherwise("allow")).otherwise(
        F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
