"""Mixing sources to target weights by hash thresholds.

A document's place in its source is a 60-bit hash of its id and text. For every source and budget a
threshold is found such that the documents below it hold about the budget: sizes are summed by source and
hash bucket (``BITS`` bits of the hash), running sums name the bucket in which the budget ends, and only
that bucket's documents are summed again by the next bits, until it is a single hash value. The documents
are then filtered by comparing their hash with the threshold; nothing is sorted or sampled, and reruns
agree. Thresholds of larger budgets are larger, so mixes of a smaller share lie within those of a larger.

Sources are numbered by code point, null last, and weigh ``weights`` in turn. The share of the corpus is
dealt to them by weight; a target stops at ``most`` times its source's size and the excess is dealt again
by weight among the others, until none is above. A target of q whole sizes and a rest takes every document
q times and those below the rest's threshold once more, so no document is taken over ``most`` times. The
document at the threshold is taken if at least half of it fits, so a source misses its target by half a
document at most.

Size is the number of words ``[^\\x20\\x09-\\x0D]+``; null and empty texts have size 0 and take no part in
budgets, and so has a source of such texts. Rows that agree in id and text have one hash and are taken
alike. Ids may be null. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.numbering import row_numbers
from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
HASH_BITS, BITS = 60, 12  # bits of the hash, and those that a round of histograms looks at


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, text: Column) -> Column:
    """The document's hash, from 0 to 2 ** 60 - 1."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 15), 16, 10).cast("long")


def source_sizes(rows: DataFrame, weights: Sequence[int]) -> DataFrame:
    """(no, source, source_size, weight): a row for each source, numbered from 0 in code point order."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = row_numbers(sums, [F.asc_nulls_last("source")], "no").withColumn("no", F.col("no") - 1)
    turn = F.array(*map(F.lit, weights))
    return materialize(numbered.withColumn(
        "weight", F.get(turn, (F.col("no") % len(weights)).cast("int")).cast("long")), "sources")


def targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """``sources`` with a target: the share of all sizes by weight, none above ``most`` times its size."""
    if share > most:
        raise ValueError("the share is more than the sources can be repeated to")
    left = int(share * (sources.agg(F.sum("source_size")).first()[0] or 0))
    size, weight = F.col("source_size"), F.col("weight")
    level, rest, parts = None, left, None
    while True:
        # one row a round: what sources at their limit take, and the weight of the others
        full = F.lit(False) if level is None else (size * most).cast("double") * level[1] < weight.cast("double") * level[0]
        taken, parts = sources.agg(F.coalesce(F.sum(F.when(full, size * most)), F.lit(0)),
                                   F.coalesce(F.sum(F.when(~full, weight)), F.lit(0))).first()
        if (left - taken, parts) == level or not parts:
            break
        level = (left - taken, parts)
        rest = left - taken
    share_of = (weight * rest).cast("double") / F.lit(float(parts)) if parts else (size * most).cast("double")
    return sources.withColumn("target", F.least(share_of, (size * most).cast("double")))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(no, budget_no, threshold): documents with a hash below the threshold hold about the budget.

    ``rows`` has (no, hash, size), ``budgets`` (no, budget_no, budget) with budgets above 0 and below
    their source's size.
    """
    open_ = materialize(budgets.select("no", "budget_no", F.col("budget").alias("rest"),
                                       F.lit(0).cast("long").alias("prefix")), "open")
    done = None
    for used in range(BITS, HASH_BITS + 1, BITS):
        low = HASH_BITS - used
        inside = F.shiftright("hash", low + BITS) == F.col("prefix")
        sums = (rows.join(open_, "no").where(inside)
                .groupBy("no", "budget_no", "rest", F.shiftright("hash", low).alias("bucket"))
                .agg(F.sum("size").alias("size"), F.min("hash").alias("first"), F.max("hash").alias("last")))
        upto = Window.partitionBy("no", "budget_no").orderBy("bucket")  # at most 2 ** BITS rows
        found = materialize(
            sums.withColumn("sum", F.sum("size").over(upto)).where(F.col("sum") >= F.col("rest"))
            .groupBy("no", "budget_no").agg(F.min_by(
                F.struct("bucket", "first", "last", "size", (F.col("rest") - F.col("sum") + F.col("size")).alias("rest")),
                "bucket").alias("x")).select("no", "budget_no", "x.*"), "boundaries")
        single = F.col("first") == F.col("last")
        fits = F.col("rest") * 2 >= F.col("size")
        ended = found.where(single).select(
            "no", "budget_no", (F.col("last") + fits.cast("long")).alias("threshold"))
        done = ended if done is None else done.union(ended)
        open_ = found.where(~single).select("no", "budget_no", "rest", F.col("bucket").alias("prefix"))
        if not open_.limit(1).count():
            break
    return done


def plan(slim: DataFrame, shares: Sequence[float] = (1.0,), weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, plan) for each source of (source, size, hash) rows.

    ``plan`` has an entry for each share: its target, how often every document is taken, and the threshold
    below which a document is taken once more.
    """
    sources = source_sizes(slim, weights)
    aims = None
    for k, share in enumerate(shares):
        some = targets(sources, share, most).withColumn("budget_no", F.lit(k))
        aims = some if aims is None else aims.union(some)
    size = F.col("source_size")
    aims = materialize(
        aims.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", size)), F.lit(0)))
        .withColumn("budget", F.col("target") - F.col("whole") * size), "targets")
    known = sources.select("no", F.col("source").alias("_of"))
    numbered = slim.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("_of"))).select("no", "hash", "size")
    found = thresholds(materialize(numbered, "numbered"), aims.where("budget > 0"))
    entry = F.struct("budget_no", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    return materialize(aims.join(found, ["no", "budget_no"], "left").groupBy("no", "source", "source_size").agg(
        F.array_sort(F.collect_list(entry)).alias("plan")).drop("no"), "plan")


def copies(entry: Column, hash_: Column) -> Column:
    """How often a plan's entry takes a document."""
    return entry["whole"] + (hash_ < entry["threshold"]).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash) of (doc_id, text, source) rows."""
    return materialize(docs.select(
        "doc_id", "source", words(F.col("text")).alias("size"),
        place(F.col("doc_id"), F.col("text")).alias("hash")), "sized")


def mixed(docs: DataFrame, shares: Sequence[float] = (1.0,), weights: Sequence[int] = WEIGHTS,
          most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, targets, copies): how often each document is in the mix of each share.

    ``docs`` has (doc_id, text, source); a share is the mix's size as a part of all sizes. The lists have
    an entry for each share.
    """
    slim = sized(docs)
    plans = plan(slim, shares, weights, most).withColumnRenamed("source", "_of")
    return slim.join(plans, F.col("source").eqNullSafe(F.col("_of"))).select(
        "doc_id", "size", "source_size", F.col("plan.target").alias("targets"),
        F.transform("plan", lambda p: copies(p, F.col("hash"))).alias("copies"))


def mixture(docs: DataFrame, share: float = 1.0, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` that the mix takes, all columns, as often as it takes them."""
    plans = plan(sized(docs), (share,), weights, most)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(whole, F.col("source").alias("_from"), place(F.col("doc_id"), F.col("text")).alias("hash"))
    times = copies(F.col("plan")[0], F.col("hash")).cast("int")
    return (rows.join(plans, F.col("_from").eqNullSafe(F.col("source")))
            .select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*"))
