"""URL filtering: host and path rules, and gradient-boosted trees for what no rule decides.

The longest rule that fits gives the verdict: a rule names a host (all its
subdomains included) and the beginning of a path. URLs that a rule decided are
the labelled ones; a bounded sample of them trains Spark's gradient-boosted
trees on lexical features: lengths, depths, digit ratio, entropy, parameter
count, and how often URLs with the same host suffix and the same file suffix are
blocked among all labelled ones (smoothed). The trees judge the other URLs.

Rows: a null URL or one without ``://`` has empty host and path, fits no rule and
is judged by its (empty) features. Where no labelled URL is there, or all have
one verdict, that verdict (allow, if none) is given to the rest. Repeated rows
give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Training bound: labelled URLs that the trees are fitted on.
SAMPLE = 10_000
#: Suffix tables of up to so many bytes are broadcast; larger ones meet the pages by a shuffle.
BROADCAST_BYTES = 4 << 20
PRIOR_ROWS = 20.0
TREES, DEPTH, BINS = 12, 4, 32

FEATURES = ["url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "entropy",
            "parameters", "hyphens", "host_suffix_rate", "file_suffix_rate"]

_PLACE = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER = "".join(map(chr, range(65, 91)))


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``page_id, url, host, path``; A-Z of the host are lower-cased."""
    u = F.col(url).cast("string")
    pick = lambda i: F.coalesce(F.regexp_extract(u, _PLACE, i), F.lit(""))
    return pages.select("page_id", u.alias("url"), F.translate(pick(1), _UPPER, _UPPER.lower()).alias("host"),
                        pick(2).alias("path"))


def rule_of(rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``; null if none fits.

    ``rules``: (verdict, host/path-beginning) pairs; of equally long rules the first listed.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        host, slash, rest = rule.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits = fits & F.col("path").startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _lexical(df: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    chars = F.array_distinct(F.split(url, ""))
    share = F.transform(chars, lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size)
    entropy = F.aggregate(share, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    count = lambda text, c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double")
    query = F.when(F.instr(url, "?") > 0, F.expr("substring_index(substring(coalesce(url, ''), "
                                                 "instr(coalesce(url, ''), '?') + 1), '#', 1)")).otherwise("")
    return df.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"), "host_depth": count(F.col("host"), "."),
        "path_depth": count(F.col("path"), "/"),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / size, "entropy": entropy,
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "hyphens": count(url, "-"),
        "host_suffix": F.substring_index("host", ".", -1),
        "file_suffix": F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)})


def _rates(labelled: DataFrame, column: str, overall: float) -> DataFrame:
    """Smoothed block rate of every value of a suffix column."""
    seen = labelled.groupBy(column).agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    return seen.select(
        column, ((F.col("bad") + overall * PRIOR_ROWS) / (F.col("n") + PRIOR_ROWS)).alias(column + "_rate"))


def _placing(rates: DataFrame) -> DataFrame:
    """``rates`` to join with: broadcast if its counted size is small, else by a shuffle."""
    size = rates.agg(F.sum(F.octet_length(rates.columns[0]) + 40).alias("b")).first()["b"] or 0
    return F.broadcast(rates) if size <= BROADCAST_BYTES else rates.hint("merge")


def judge(pages: DataFrame, rules: list[tuple[str, str]], sample: int = SAMPLE, seed: int = 11) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    placed = parts(pages).withColumn("_r", rule_of(rules))
    labelled = placed.filter("_r is not null").withColumn("label", (F.col("_r.verdict") == "block").cast("double"))
    known = labelled.agg(F.count("*").alias("n"), F.avg("label").alias("p")).first()
    only = "allow" if not known["n"] else {0.0: "allow", 1.0: "block"}.get(known["p"])
    if only:
        return placed.select("page_id", "host", "path", F.col("_r.rule").alias("rule"),
                             F.coalesce("_r.verdict", F.lit(only)).alias("verdict"))
    overall = known["p"]
    full = _lexical(labelled)
    rates = [_placing(cut(_rates(full, c, overall), "suffixes")) for c in ("host_suffix", "file_suffix")]

    def features(df: DataFrame) -> DataFrame:
        out = _lexical(df)
        for r in rates:
            out = out.join(r, r.columns[0], "left").fillna(overall, [r.columns[1]])
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(out)

    scale = 1 << 30
    rate = min(scale, -(-scale * sample // known["n"]))
    chosen = labelled.filter(F.pmod(F.xxhash64("url", "page_id", F.lit(seed)), F.lit(scale)) < rate)
    train = cut(features(chosen).select("features", "label"), "url_sample")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, seed=seed, stepSize=0.3).fit(train)
    judged = model.transform(features(placed))
    by_trees = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("_r.rule").alias("rule"),
                         F.coalesce("_r.verdict", by_trees).alias("verdict"))
