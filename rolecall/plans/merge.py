"""Write path: raw batch -> ingested rows -> merged archive segment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_to_markdown
from ..operators.dedup import (
    SAME, SKIP, affected_leaves, exact_distinct, instance_digest, leaf_texts, leaves,
    merge_leaves, merge_pass, position_token, strict_anti, text_facts, unpacked, with_texts)
from ..operators.numbering import sequenced
from ..schema import DERIVED, INSTANCE_COLS, conform, is_text
from ..sources.storage import spool, temporary


def iso_date(value: Column) -> Column:
    """Any date or timestamp spelling the engine parses, as an ISO string."""
    return F.date_format(
        F.coalesce(value.try_cast("date"), F.try_to_timestamp(value).cast("date")), "yyyy-MM-dd")


def ingest(batch: DataFrame, html: bool = True) -> DataFrame:
    """Normalise collected rows: markdown descriptions, ISO dates, no NaN, not favourite."""
    rows = conform(batch)
    changed = {
        "date_posted": iso_date(F.col("date_posted")),
        "min_amount": F.when(~F.isnan("min_amount"), F.col("min_amount")),
        "max_amount": F.when(~F.isnan("max_amount"), F.col("max_amount")),
        "is_favorite": F.lit(False),
    }
    if html:
        changed["description"] = html_to_markdown(F.col("description"))
    return rows.withColumns(changed)


def batch_leaf(order: str = "ord") -> Column:
    return F.concat(F.lit("b:"), F.col(order).cast("string"))


def archive_leaf() -> Column:
    return F.concat(F.lit("a:"), F.col("posting_id"), F.lit("@"), F.col("merge_seq").cast("string"))


def batch_leaves(batch: DataFrame, order: str = "ord") -> DataFrame:
    token = position_token(0, F.lit(0), F.col(order))
    return leaves(batch, batch_leaf(order), token).drop(order)


def raw_leaf(order: str = "ord") -> Column:
    return F.concat(F.lit("r:"), F.col(order).cast("string"))


def raw_archive_leaves(archive: DataFrame, order: str = "ord") -> DataFrame:
    """Leaves of an archive that is still a plain posting table in ``order``."""
    token = position_token(1, F.lit(0), F.col(order))
    return leaves(archive, raw_leaf(order), token).drop(order)


def raw_archive_texts(archive: DataFrame, order: str = "ord") -> DataFrame:
    return leaf_texts(archive, raw_leaf(order))


def archive_leaves(postings: DataFrame) -> DataFrame:
    token = position_token(1, -F.col("merge_seq"), F.col("ord"))
    rows = leaves(postings, archive_leaf(), token, F.col("n_instances"))
    return rows.drop("posting_id", "merge_seq", "ord", "n_instances", *DERIVED.fieldNames())


def merge_input(new: DataFrame, archive: DataFrame) -> DataFrame:
    """New leaves first, then the archive leaves that share a key with them."""
    touched = affected_leaves(archive, new)
    return new.unionByName(archive.join(touched, "_leaf", "left_semi"))


def merged_table(
    batch: DataFrame, archive: DataFrame | None = None, null_keys: str = SKIP, order: str = "ord"
) -> DataFrame:
    """The archive after a merge, for plain posting tables and without instance rows.

    Adds ``n_instances``; archive rows the batch does not touch come back as they were.
    """
    kept = [c for c in batch.columns if c != order]
    with temporary(batch.sparkSession, keep=("touched", *READ_AGAIN)):
        new = exact_distinct(batch_leaves(batch, order), "_tok")
        texts = leaf_texts(batch, batch_leaf(order))
        if archive is None:
            return _finished(merge_leaves(new, null_keys).rows, texts, kept)
        # Read several times below; written without texts, so those are hashed once.
        old = spool(raw_archive_leaves(archive, order), "archive")
        new = spool(strict_anti(new, old), "new")
        touched = spool(affected_leaves(old, new), "touched")
        taking_part = spool(new.unionByName(old.join(touched, "_leaf", "left_semi")), "leaves")
        texts = texts.unionByName(
            raw_archive_texts(archive, order).join(touched, "_leaf", "left_semi"))
        untouched = archive.withColumn("_leaf", raw_leaf(order)).join(touched, "_leaf", "left_anti")
        merged = _finished(merge_leaves(taking_part, null_keys).rows, texts, kept)
        return merged.unionByName(untouched.select(*kept, F.lit(1).cast("long").alias("n_instances")))


READ_AGAIN = ("pointed", "holders", "again")  # what ``with_texts`` leaves to be read with its result


def _finished(rows: DataFrame, texts: DataFrame, kept: list[str]) -> DataFrame:
    return with_texts(rows, texts).select(*kept, F.col("_n").alias("n_instances"))


def single_pass(
    table: DataFrame, criterion: str, null_keys: str = SKIP, order: str = "ord"
) -> DataFrame:
    """A posting table merged on one duplicate criterion only."""
    with temporary(table.sparkSession, keep=READ_AGAIN):
        rows = merge_pass(batch_leaves(table, order), criterion, null_keys)
        texts = leaf_texts(table, batch_leaf(order))
        return _finished(rows, texts, [c for c in table.columns if c != order])


@dataclass
class Segment:
    """What one merge adds to an archive, and the archive rows it replaces."""

    postings: DataFrame
    instances: DataFrame
    retired: DataFrame


def merge_batch(
    batch: DataFrame,
    merge_seq: int,
    postings: DataFrame | None = None,
    instances: DataFrame | None = None,
    null_keys: str = SKIP,
    known: str = "instances",
    order: str = "ord",
) -> Segment:
    """Merge an ingested batch into an archive of ``postings`` and ``instances``.

    Only batch rows and the archive rows they touch are merged and returned. A batch row is
    dropped as known when it equals any archived instance, or with ``known="postings"`` only
    when it equals the merged values of an archived posting.
    """
    with temporary(batch.sparkSession, keep=("sequenced", "retired")):
        new = exact_distinct(batch_leaves(batch, order), "_tok")
        texts = leaf_texts(batch, batch_leaf(order))
        if postings is None:
            taking_part = new
        else:
            new = spool(strict_anti(new, instances if known == "instances" else postings), "new")
            taking_part = spool(merge_input(new, archive_leaves(postings)), "leaves")
        merged = merge_leaves(taking_part, null_keys, members=True)
        fields = [c for c in INSTANCE_COLS if c in taking_part.columns]
        # a batch row is an instance, an archived posting has the instances that are stored of it
        placed = merged.members.where(F.col("_leaf").startswith("b:")).withColumn("_old", F.lit(0).cast("long"))
        retired = None
        if postings is not None:
            touched = spool(taking_part.where(F.col("_leaf").startswith("a:")).select("_leaf"), "touched")
            texts = texts.unionByName(
                leaf_texts(postings, archive_leaf()).join(touched, "_leaf", "left_semi"),
                allowMissingColumns=True)
            earlier = instances.select(archive_leaf().alias("_leaf"), *fields, F.col("seq").alias("_old"))
            placed = placed.unionByName(earlier.join(
                merged.members.where(F.col("_leaf").startswith("a:")).drop(*fields), "_leaf"))
            retired = spool(touched.select(
                F.regexp_extract("_leaf", "^a:(.*)@", 1).alias("posting_id"),
                F.regexp_extract("_leaf", "@([0-9]+)$", 1).cast("long").alias("merge_seq")), "retired")

        stamp = F.lit(merge_seq).cast("long").alias("merge_seq")
        facts = [f(F.col(c)).alias(n) for c in batch.columns if is_text(c)
                 for n, f in zip(text_facts(c), (F.length, lambda x: F.sha2(x, 256)))]
        segment_postings = sequenced(
            with_texts(merged.rows, texts).select(
                F.col("_gid").alias("posting_id"), *[c for c in batch.columns if c != order], *facts,
                F.col("_n").alias("n_instances"), "_tok"),
            posting_order(), "ord")
        segment_instances = sequenced(placed.drop("_leaf"), instance_order(), "seq")
        same = instance_digest(segment_instances.select(*fields)).alias(SAME)
        return Segment(
            segment_postings.drop("_tok").withColumn("merge_seq", stamp),
            segment_instances.select(
                unpacked(F.col("_final")).alias("posting_id"), *fields, "seq", same, stamp),
            retired)


def posting_order() -> list[Column]:
    """Order of merged rows: title, description, nulls last, rows without a key at the end."""
    keyed = ~F.col("_tok").startswith("1")
    return [
        F.when(keyed, F.col("_tok")).asc_nulls_last(),
        F.when(keyed, F.col("description")).asc_nulls_last(), F.col("_tok"),
    ]


def instance_order() -> list[Column]:
    """Lists concatenate in row order at every pass, the last pass deciding first."""
    return [F.col(c) for c in ("_final", "_tok3", "_tok2", "_tok1", "_tok0", "_old")]
