"""URL filter: allow and block rules, and for urls without a rule a tree of path templates per host.

Rules come first; the longest that fits wins.  Each host's paths form a tree of segments in which digits and long
hexadecimal runs are marks already, so most paths fall into few shapes.  At each node, children of which hardly more
than one path is known are variable: eight or more of them become one wildcard.  Other children are merged into it
when they look like the rest of the node by two tests: the kinds of segments below them, and, where both sides have
labels, the share of blocked ones.  A child whose labels differ from the rest's stays apart, however wide the node.  What
results is a template per host.

Labels are the verdicts of the rules (or a table of labelled urls).  A template's purity is the smoothed share of
blocked ones among its labels; one without labels borrows that of the nearest branch above it that has some, then that
of the host's domain (its last two names), drawn towards one half by BORROWED a step.  Templates of PURITY or more are
rejected: their urls without a rule are blocked, all others allowed.

All levels are counted in one pass over the distinct shapes, per host, node and segment, combined before each shuffle;
no host or node is gathered into one task and nothing depends on how many children a node has in all.

Defined cases: a null url, or one without ``://``, has empty host and path and is judged like any other; very long and
very deep paths are taken whole; repeated page ids are judged row by row; an empty table gives an empty result; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, require, written

#: (host, path, verdict) in the order of the contract.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Paths below a child that is variable, at most, and variable children that make a wildcard, at least.
RARE, MANY = 2, 8
#: Labelled urls, or paths, that both sides of a test need; bound of the tests in standard deviations.
LEAST, BOUND = 5, 2.0
#: Difference of two branches' kinds of segments that is never held against them.
ALIKE = 0.1
PURITY, SMOOTHING, BORROWED = 0.8, 1.0, 0.7
#: Kinds of what stands below a segment: nothing, a bare number, a number among others, hexadecimal, a word with a dot, another.
KINDS = 6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, extra=()) -> DataFrame:
    """``page_id, host, path`` and the ``extra`` columns."""
    require(pages, ("page_id", "url"))
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    return pages.select(F.col("page_id").cast("long"), host.alias("host"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"), *extra)


def parsed_labels(labels: DataFrame) -> DataFrame:
    """``host, path, ruled`` of labelled urls."""
    require(labels, ("url", "ruled"))
    return parsed(labels.withColumnRenamed("ruled", "page_id_ruled").withColumn("page_id", F.lit(0)), ["page_id_ruled"]).select("host", "path", F.col("page_id_ruled").alias("ruled"))


def with_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """``rule`` and ``ruled`` (the rule's verdict) of the longest rule that fits; null where none does."""
    rule = verdict = None
    for host, path, kind in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return urls.withColumn("rule", none if rule is None else rule).withColumn("ruled", none if verdict is None else verdict)


def _shape(path):
    """A path with its variable parts as marks; marks never reach across a slash."""
    hexed = F.regexp_replace(path, r"[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}|(?<![0-9a-zA-Z])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{12,}(?![0-9a-zA-Z])", "{h}")
    return F.regexp_replace(hexed, r"[0-9]+", "{n}")


def _segments(shape):
    return F.when(shape == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(shape, "^/", ""), "/"))


def _kind(segment):
    """Number of a segment's kind; null (nothing below) is 0."""
    return (
        F.when(segment.isNull() | (segment == ""), 0)
        .when(segment == "{n}", 1)
        .when(F.contains(segment, F.lit("{h}")), 3)
        .when(F.contains(segment, F.lit("{n}")), 2)
        .when(F.contains(segment, F.lit(".")), 4)
        .otherwise(5)
    )


def _walk(shapes: DataFrame) -> DataFrame:
    """A row for each segment of each shape: ``level``, ``seg``, ``node`` (the path above it) and ``kind`` of what is below."""
    rows = shapes.withColumn("segments", _segments(F.col("shape"))).select("*", F.posexplode("segments").alias("level", "seg"))
    above = F.concat_ws("/", F.slice("segments", 1, F.col("level")))
    below = F.get("segments", F.col("level") + 1)
    return rows.withColumn("node", F.xxhash64("level", above)).withColumn("kind", _kind(below)).drop("segments")


def _labels(walk: DataFrame) -> DataFrame:
    """``host, node, seg, label``: the segment itself, or a wildcard."""
    kinds = [F.sum(F.when(F.col("kind") == k, F.col("paths")).otherwise(0)).alias(f"k{k}") for k in range(KINDS)]
    kids = walk.groupBy("host", "node", "seg").agg(F.sum("paths").alias("p"), F.sum("blocked").alias("b"), F.sum(F.col("blocked") + F.col("allowed")).alias("n"), *kinds)
    names = ["p", "b", "n", *(f"k{k}" for k in range(KINDS))]
    rare = F.col("p") <= RARE
    nodes = kids.groupBy(F.col("host").alias("__h"), F.col("node").alias("__n")).agg(F.sum(F.when(rare, 1).otherwise(0)).alias("rare"), *(F.sum(c).alias(f"all_{c}") for c in names))
    both = kids.join(nodes, (F.col("host") == F.col("__h")) & (F.col("node") == F.col("__n")))
    rest = {c: F.col(f"all_{c}") - F.col(c) for c in names}
    one = F.lit(1)
    share = F.col("all_b") / F.greatest(F.col("all_n"), one)
    gap = F.abs(F.col("b") / F.greatest(F.col("n"), one) - rest["b"] / F.greatest(rest["n"], one))
    spread = F.sqrt(share * (1 - share) * (1 / F.greatest(F.col("n"), one) + 1 / F.greatest(rest["n"], one)))
    differs = (F.col("n") >= LEAST) & (rest["n"] >= LEAST) & (gap > BOUND * spread)
    far = sum((F.abs(F.col(f"k{k}") / F.col("p") - rest[f"k{k}"] / F.greatest(rest["p"], one)) for k in range(KINDS)), F.lit(0.0)) / 2
    chance = BOUND * F.sqrt((1 / F.col("p") + 1 / F.greatest(rest["p"], one)) / 4)
    alike = (F.col("p") >= LEAST) & (rest["p"] >= LEAST) & (far <= ALIKE + chance)
    wild = ~differs & (alike | (rare & (F.col("rare") >= MANY)))
    return both.select("host", "node", "seg", F.when(wild, "*").otherwise(F.col("seg")).alias("label"))


def _domain(host):
    """The last two names of a host."""
    return F.substring_index(host, ".", -2)


def _share(b, n):
    return (b + SMOOTHING) / (n + 2 * SMOOTHING)


def _purities(named: DataFrame) -> DataFrame:
    """``host, template, purity, judged_by`` from ``host, template, blocked, allowed``.

    Branches above a template are those its segments begin with, down to none: the host's.
    """
    own = written(named.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum(F.col("blocked") + F.col("allowed")).alias("n")), "templates")
    parts = F.split("template", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws("/", F.slice(parts, 1, k)))
    above = own.select("host", "template", "b", "n", F.posexplode(F.when(F.col("template") == "", F.array(F.lit(""))).otherwise(up)).alias("level", "branch"))
    branches = above.filter("n > 0").groupBy(F.col("host").alias("__h"), F.col("branch").alias("__b")).agg(F.sum("b").alias("of_b"), F.sum("n").alias("of_n"))
    none = above.filter("n = 0").select("host", "template", "level", "branch")
    near = none.join(branches, (F.col("host") == F.col("__h")) & (F.col("branch") == F.col("__b"))).groupBy(F.col("host").alias("__h"), F.col("template").alias("__t")).agg(F.max(F.struct("level", "of_b", "of_n")).alias("near"))
    domains = own.filter("n > 0").groupBy(_domain(F.col("host")).alias("__d")).agg(F.sum("b").alias("dom_b"), F.sum("n").alias("dom_n"))
    both = own.join(near, (F.col("host") == F.col("__h")) & (F.col("template") == F.col("__t")), "left").join(domains, _domain(F.col("host")) == F.col("__d"), "left")
    drawn = lambda share, steps: 0.5 + BORROWED**steps * (share - 0.5)
    purity = (
        F.when(F.col("n") > 0, _share(F.col("b"), F.col("n")))
        .when(F.col("near").isNotNull(), drawn(_share(F.col("near.of_b"), F.col("near.of_n")), 1))
        .when(F.col("dom_n").isNotNull(), drawn(_share(F.col("dom_b"), F.col("dom_n")), 2))
        .otherwise(F.lit(0.5))
    )
    by = F.when(F.col("n") > 0, "template").when(F.col("near.level") > 0, "branch").when(F.col("near").isNotNull(), "host").when(F.col("dom_n").isNotNull(), "domain").otherwise("none")
    return both.select("host", "template", purity.alias("purity"), by.alias("judged_by"))


def templates(labelled: DataFrame) -> DataFrame:
    """From ``host, path, ruled``: a row per (host, shape) with its ``template``, ``purity`` and ``judged_by`` (template,
    branch, host, domain or none: whose labels its purity is taken from)."""
    count = lambda kind, name: F.sum(F.when(F.col("ruled") == kind, 1).otherwise(0)).alias(name)
    paths = labelled.groupBy("host", "path").agg(count("block", "blocked"), count("allow", "allowed"))
    shapes = paths.groupBy("host", _shape(F.col("path")).alias("shape")).agg(F.count(F.lit(1)).alias("paths"), F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
    shapes = written(shapes, "shapes")
    walk = _walk(shapes)
    names = _labels(walk).select(F.col("host").alias("__h"), F.col("node").alias("__n"), F.col("seg").alias("__s"), "label")
    met = walk.select("host", "shape", "level", "node", "seg").join(names, (F.col("host") == F.col("__h")) & (F.col("node") == F.col("__n")) & (F.col("seg") == F.col("__s")))
    # as many labels as the path has segments
    row = met.groupBy(F.col("host").alias("__h"), F.col("shape").alias("__s")).agg(F.array_sort(F.collect_list(F.struct("level", "label"))).alias("row"))
    template = F.when(F.col("row").isNull(), "").otherwise(F.concat(F.lit("/"), F.concat_ws("/", F.col("row.label"))))
    both = shapes.join(row, (F.col("host") == F.col("__h")) & (F.col("shape") == F.col("__s")), "left")
    named = written(both.select("host", "shape", template.alias("template"), "blocked", "allowed"), "named")
    judged = _purities(named).select(F.col("host").alias("__h"), F.col("template").alias("__t"), "purity", "judged_by")
    out = written(named.join(judged, (F.col("host") == F.col("__h")) & (F.col("template") == F.col("__t"))).select("host", "shape", "template", "purity", "judged_by"), "judged")
    for spent in (shapes, named):
        drop_table(labelled.sparkSession, spent)
    return out


def filter_urls(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, purity: float = PURITY) -> DataFrame:
    """A row per page: ``page_id, host, path, rule, verdict, template, purity, judged_by``.

    ``labels``: a table of ``url`` and ``ruled`` (block or allow) to learn from in place of the rules' verdicts.
    """
    urls = with_rules(parsed(pages), rules)
    seen = urls.select("host", "path", "ruled")
    if labels is not None:
        seen = seen.withColumn("ruled", F.lit(None).cast("string")).unionAll(parsed_labels(labels))
    found = templates(seen).select(F.col("host").alias("__h"), F.col("shape").alias("__s"), "template", "purity", "judged_by")
    both = urls.withColumn("shape", _shape(F.col("path"))).join(found, (F.col("host") == F.col("__h")) & (F.col("shape") == F.col("__s")))
    method = F.when(F.col("purity") >= purity, "block").otherwise("allow")
    return both.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "template", "purity", "judged_by")


def op4_urls(spark, sf_dir: str) -> DataFrame:
    """Every row of ``pages``."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
