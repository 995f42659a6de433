"""Mixing of sources to target weights, exact to the word.

Each document gets a random key by hashing its id, or its text where it has no id; within its source documents are
sorted by key and take part in that order until the source's budget is used up.  Keys are dealt into equal ranges whose
number follows the row count, so the sort and the prefix sums of a hot source run in many tasks: sums per range first,
then an offset per range, then a running sum inside each range.  A budget above the source's size repeats whole epochs;
the last document of the last epoch is cut at the word where the budget ends.

Defined cases: a null text has size 0 and takes 0; null sources form a source of their own, ranked last; rows that
repeat an id share its key, stand beside each other and are budgeted row by row, each in its own source; texts are
measured whole, however long; an empty table gives an empty result; further columns, whatever their names, are ignored
by :func:`mix` and kept by :func:`apply_mix`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import beside, free_name, located, require, text_of, word_count, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"
#: Rows of one key range, about; ranges beyond MANY hold more, so that a source's offsets stay one small sort.
RANGE_ROWS, MANY = 1024, 1 << 20


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """From ``source, skey, source_size``: ``skey, source_size, target``.  A row per source.

    A source is full when the level that the sources after it would get reaches its own; sources are taken in the
    order of (largest size / weight), so one pass finds the level of those that are not full.
    """
    total = F.sum("source_size").over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    a = sizes.withColumn("total", total).withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    a = a.withColumn("most", F.col("source_size") * F.lit(most))
    in_order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    left = F.lit(share) * F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))
    weight_left = F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    a = a.withColumn("level", left / weight_left).withColumn("pos", F.row_number().over(in_order))
    open_ = F.when(F.col("level") * F.col("weight") < F.col("most"), F.struct("pos", "level"))
    a = a.withColumn("first_open", F.min(open_).over(W.partitionBy()))
    target = F.when(F.col("pos") >= F.col("first_open.pos"), F.col("first_open.level") * F.col("weight")).otherwise(F.col("most").cast("double"))
    return a.select("skey", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _slim(docs: DataFrame, seed: str, extra=()) -> DataFrame:
    require(docs, ("doc_id", "text", "source"))
    named = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("text:"), text_of()))
    return docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("skey"),
        word_count(text_of()).alias("size"),
        F.md5(F.concat(F.lit(seed), F.lit(":"), named)).alias("key"),
        *extra,
    )


def _range_bits(rows: int, range_rows: int) -> int:
    """Leading bits of the keys that number the ranges."""
    ranges = rows / range_rows
    if ranges > MANY:
        ranges = max(MANY, ranges / 64)
    return min(31, max(0, math.ceil(math.log2(max(1, ranges)))))


def mix(docs: DataFrame, seed: str = SEED, range_rows: int = RANGE_ROWS, extra=(), **shares) -> DataFrame:
    """A row per document: ``doc_id, size, source_size, target, taken, epochs, last_words`` and the ``extra`` columns.

    ``taken`` words in all: ``epochs`` whole passes and the first ``last_words`` words of one more.
    """
    slim = written(_slim(docs, seed, extra), "mix")
    bits = _range_bits(slim.count(), range_rows)
    ranged = slim.withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits) if bits else F.lit(0).cast("long"))
    per_range = ranged.groupBy("source", "skey", "range").agg(F.sum("size").alias("range_size"))
    sizes = per_range.groupBy("source", "skey").agg(F.sum("range_size").alias("source_size"))
    ahead = F.sum("range_size").over(W.partitionBy("skey").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    offsets = per_range.select("skey", "range", F.coalesce(ahead, F.lit(0)).alias("offset")).join(targets(sizes, **shares), "skey")
    inside = W.partitionBy("skey", "range").orderBy("key", "doc_id", "size", *extra).rowsBetween(W.unboundedPreceding, 0)
    run = ranged.withColumn("through", F.sum("size").over(inside))
    out = run.join(offsets, ["skey", "range"])
    budget = F.least(F.col("source_size") * 2, F.floor(F.col("target") + F.lit(0.5)))
    out = out.withColumn("budget", budget).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("int"))
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    begins = F.col("offset") + F.col("through") - F.col("size")
    out = out.withColumn("last_words", F.greatest(F.lit(0), F.least(F.col("size"), rest - begins)).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("last_words")).cast("long").alias("taken"), "epochs", "last_words", *extra)


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with the input's columns: a row per pass.

    Rows find their share again by a stored number, so ids may be null or repeat, within a source or across sources.

    The document where a source's budget ends gives its first words to the last pass; ``n_chars``, where there is
    such a column, follows its text.  Documents that take nothing go, unless empty: those have no words to cut and
    stay once.
    """
    own, row = located(docs, "mixrows")
    plan, times, words = (free_name(own, f"__{x}") for x in ("plan", "pass", "size"))
    taken = mix(own, extra=[row], **options).select(row, F.struct("size", "epochs", "last_words").alias(plan))
    both = own.join(taken.hint("shuffle_hash"), row)
    last = F.col(plan)["last_words"]
    passes = F.when(F.col(plan)["size"] == 0, F.array(F.lit(-1).cast("long"))).otherwise(
        F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col(plan)["epochs"]), F.when(last > 0, F.array(last)).otherwise(F.array().cast("array<long>")))
    )
    rows = both.withColumn(times, F.explode(passes)).withColumn(words, F.col(plan)["size"])
    cut = (F.col(times) >= 0) & (F.col(times) < F.col(words))
    parts = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    head = F.concat_ws(" ", F.slice(parts, 1, F.greatest(F.lit(1), F.col(times).cast("int"))))
    rows = rows.withColumn("text", F.when(cut, head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*beside(docs, ()))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1:' || coalesce(cast(doc_id AS varchar), 'text:' || coalesce(text, ''))) AS key FROM documents
), s AS (
  SELECT source, cast(sum(size) AS bigint) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, 2 * source_size AS most,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         cast(sum(source_size) OVER () AS bigint) AS total FROM s
), l AS (
  SELECT *, row_number() OVER o AS pos,
         (1.5::double * total - cast(coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint))
         / cast(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS level
  FROM r WINDOW o AS (ORDER BY most / weight, source IS NULL, source)
), f AS (
  SELECT min(pos) AS pos, min_by(level, pos) AS level FROM l WHERE level * weight < most
), t AS (
  SELECT l.source, l.source_size, CASE WHEN f.pos IS NOT NULL AND l.pos >= f.pos THEN f.level * l.weight ELSE cast(l.most AS double) END AS target
  FROM l CROSS JOIN f
), b AS (
  SELECT *, least(2 * source_size, cast(floor(target + 0.5) AS bigint)) AS budget FROM t
), p AS (
  SELECT d.doc_id, cast(d.size AS bigint) AS size, b.source_size, b.target, b.budget,
         CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs,
         cast(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS bigint) AS through
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       cast(epochs * size + greatest(0, least(size, budget - epochs * source_size - (through - size))) AS bigint) AS taken FROM p
"""
