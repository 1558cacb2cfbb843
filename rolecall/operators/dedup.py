"""Exact deduplication and the four-pass duplicate merge.

Merging works on *leaves*: one row per incoming or archived posting, with long texts replaced
by a reference (length, digest, leaf). Texts therefore cross the network once, for the winning
leaves only, however many passes run. A pass is one grouping on one digest column whose
aggregates all combine map-side, so a hot key costs one partial row per task. Rows that meet no
other in a pass are told by a filter and stay where they are.

Leaf columns: the short posting columns, ``_ref_<text>`` per long text, ``_leaf`` (identity),
``_gid`` (current group), ``_tok`` (row order, a sortable string) and ``_n`` (instances held).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CRITERIA, INSTANCE_COLS, is_text
from ..sources.storage import spool
from .key_filter import parted, thinned

SKIP, GROUP = "skip", "group"


def digest(*columns: Column) -> Column:
    """Digest of a tuple of values in which null equals null."""
    named = [c.alias(f"c{i}") for i, c in enumerate(columns)]
    return F.sha2(F.to_json(F.struct(*named)), 256)


def _comparable(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    if df.schema[name].dataType.typeName() == "double":
        return column + F.lit(0.0)  # one spelling of zero
    return column


SAME = "same_sha"  # where an archive stores the digest of an instance


def instance_digest(df: DataFrame) -> Column:
    """Digest of a row's instance columns, the test for an exact copy.

    Null fields leave no trace in it, so a missing column counts as null.
    """
    if SAME in df.columns:
        return F.col(SAME)
    fields = [_comparable(df, c).alias(c) for c in INSTANCE_COLS if c in df.columns]
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def exact_distinct(df: DataFrame, order: str) -> DataFrame:
    """First row in ``order`` of every set of rows equal on all instance columns, as a stored table.

    Only rows that may have an equal are shuffled.
    """
    rows = spool(df, "rows")
    alone, met = parted(rows, instance_digest(rows), F.col(order).isNull())
    if met is None:
        return rows
    same = met.groupBy(F.unhex(instance_digest(met)).alias("_same"))  # half as wide
    first = same.agg(F.min_by(F.struct(*df.columns), order).alias("_kept")).select("_kept.*")
    return spool(first if alone is None else alone.unionByName(first), "distinct")


def strict_anti(batch: DataFrame, archive: DataFrame) -> DataFrame:
    """Batch rows with no archive row equal on all instance columns (null equals null).

    Digests are shuffled to find those that both have; of a much larger archive only those that a filter of the
    batch's lets through. The batch should be a stored table, as it is read again to take out the rows that are known.
    """
    keyed = batch.withColumn("_same", F.unhex(instance_digest(batch)))
    wanted = keyed.select("_same")
    known = thinned(archive.select(F.unhex(instance_digest(archive)).alias("_same")), "_same", wanted, archive)
    both = spool(known.distinct().join(wanted, "_same", "left_semi"), "both")
    return keyed.join(both, "_same", "left_anti").drop("_same")


def text_facts(column: str) -> tuple[str, str]:
    """Names under which an archive stores a text's length and digest."""
    return f"{column}_len", f"{column}_sha"


def leaves(df: DataFrame, leaf: Column, token: Column, held: Column | None = None) -> DataFrame:
    """Turn posting rows into leaves.

    Where ``df`` stores the length and digest of a text, the text itself is not read.
    """
    texts = [c for c in df.columns if is_text(c)]
    stored = {c for c in texts if text_facts(c)[1] in df.columns}
    facts = {name for c in stored for name in text_facts(c)}
    refs = []
    for c in texts:
        length, sha = F.length(c), F.sha2(F.col(c), 256)
        if c in stored:
            length, sha = (F.col(name) for name in text_facts(c))
        ref = F.struct((-length).alias("neglen"), F.unhex(sha).alias("sha"), leaf.alias("leaf"))
        refs.append(F.when(length.isNotNull(), ref).alias(f"_ref_{c}"))
    return df.select(
        *[c for c in df.columns if c not in texts and c not in facts], *refs,
        leaf.alias("_leaf"), leaf.alias("_gid"), token.alias("_tok"),
        (F.lit(1) if held is None else held).cast("long").alias("_n"))


def leaf_texts(df: DataFrame, leaf: Column) -> DataFrame:
    """The long texts of the same rows, by leaf identity."""
    return df.select(leaf.alias("_leaf"), *[c for c in df.columns if is_text(c)])


def _key(df: DataFrame, column: str) -> Column:
    return F.lower(F.hex(F.col(f"_ref_{column}.sha"))) if f"_ref_{column}" in df.columns else F.col(column)


def _any_null(keys: list[Column]) -> Column:
    missing = keys[0].isNull()
    for k in keys[1:]:
        missing = missing | k.isNull()
    return missing


def match_keys(df: DataFrame) -> Column:
    """Array with one digest per duplicate criterion whose columns are all present, as 16 bytes."""
    found = []
    for name, columns in CRITERIA.items():
        keys = [_key(df, c) for c in columns]
        found.append(F.when(~_any_null(keys), F.substring(F.unhex(digest(F.lit(name), *keys)), 1, 16)))
    return F.array_compact(F.array(*found))


def affected_leaves(archive: DataFrame, batch: DataFrame) -> DataFrame:
    """Identities of archive leaves that share any non-null key with the batch (one hop).

    Of a much larger archive only the keys that a filter of the batch's lets through are shuffled.
    """
    wanted = spool(batch.select(F.explode(match_keys(batch)).alias("_match")).distinct(), "wanted")
    offered = thinned(archive.select("_leaf", F.explode(match_keys(archive)).alias("_match")), "_match", wanted, archive)
    return offered.join(wanted, "_match", "left_semi").select("_leaf").distinct()


def next_group(df: DataFrame, criterion: str, null_keys: str) -> Column:
    """Group a row joins in a pass; with ``skip`` a row with a null key stays on its own."""
    keys = [_key(df, c) for c in CRITERIA[criterion]]
    grouped = F.concat(F.lit(f"{criterion}:"), digest(*keys))
    if null_keys == GROUP:
        return grouped
    return F.when(_any_null(keys), F.col("_gid")).otherwise(grouped)


def _merged_value(name: str) -> str:
    """Aggregate of one leaf column, as SQL."""
    if name.startswith("_ref_"):  # longest text, first in row order on ties
        order = f"if(`{name}` IS NULL, NULL, struct(`{name}`.neglen, _tok))"
        return f"min_by(`{name}`, {order}) AS `{name}`"
    if name == "date_posted":  # latest date
        return f"max_by({name}, try_cast({name} AS DATE)) AS {name}"
    return f"max_by(`{name}`, if(`{name}` IS NULL, NULL, _tok)) AS `{name}`"  # last present


def position_token(source: int, major: Column, minor: Column) -> Column:
    """Row order before the first pass as a sortable string: source, then two numbers."""
    def digits(n: Column) -> Column:
        return F.lpad(F.hex(n.cast("long") + F.lit(1 << 62)), 16, "0")

    return F.concat(F.lit(str(source)), digits(major), digits(minor))


def _order_token(df: DataFrame, criterion: str, null_keys: str, before: Column | None = None) -> Column:
    """Where a merged row stands, as a sortable string; ``before`` is its token of the pass before.

    Rows go by key with nulls last; a row passed through for its null key follows all of them
    in its old place. A NUL ends each key, so a key sorts before its own extensions.
    """
    columns = CRITERIA[criterion]
    parts = [
        F.coalesce(
            F.concat(F.lit("0"), F.replace(c, F.lit("\0"), F.lit("\0\1")), F.lit("\0\0")),
            F.lit("1"))
        for c in (F.col(name) for name in columns if not is_text(name))
    ]
    keyed = F.concat(F.lit("0"), *parts)
    if null_keys == GROUP:
        return keyed
    passed = _any_null([_key(df, c) for c in columns])
    return F.when(passed, F.concat(F.lit("1"), F.col("_tok") if before is None else before)).otherwise(keyed)


_ROW = ("_leaf", "_gid", "_tok", "_n")  # what a leaf has besides values
_BIRTH = ("_node", "_base", "_born")  # identity, token and pass of the merge a row came from, or the leaf's


def _meeting(rows: DataFrame, criterion: str, null_keys: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Stored rows that are alone in a pass, and those that may meet others."""
    keys = [_key(rows, c) for c in CRITERIA[criterion]]
    named = [k.alias(f"c{i}") for i, k in enumerate(keys)]
    alone = F.lit(False) if null_keys == GROUP else _any_null(keys)
    key = F.when(alone, F.col("_gid")).otherwise(F.to_json(F.struct(*named)))
    return parted(rows, key, F.col("_tok").isNull())


def _grouped(rows: DataFrame, criterion: str, null_keys: str) -> DataFrame:
    held = [c for c in rows.columns if c not in _ROW + _BIRTH]
    keys = [_key(rows, c) for c in CRITERIA[criterion]]
    alone = F.lit(False) if null_keys == GROUP else _any_null(keys)
    # Grouped by bytes, half as wide as the names that ``next_group`` gives.
    named = F.concat(F.lit(f"{criterion}:"), F.lower(F.hex("_key")))
    merged = (
        rows.withColumns({"_own": F.when(alone, F.col("_gid")), "_key": F.when(~alone, F.unhex(digest(*keys)))})
        .groupBy("_own", "_key")
        .agg(*map(F.expr, [*map(_merged_value, held), "min(_tok) AS _tok", "sum(_n) AS _n"]))
        .withColumn("_gid", F.coalesce(named, "_own")).drop("_own", "_key")
    )
    return merged.withColumn("_tok", _order_token(merged, criterion, null_keys))


def _carried(rows: DataFrame, criterion: str, null_keys: str) -> DataFrame:
    """Rows that meet no other: only group and token change."""
    return rows.withColumns({
        "_gid": next_group(rows, criterion, null_keys), "_tok": _order_token(rows, criterion, null_keys)}).drop("_leaf")


def _passed(alone: DataFrame | None, met: DataFrame | None, criterion: str, null_keys: str, born: int = 0) -> DataFrame:
    """The rows after a pass; ``born`` is the pass' number, if rows say where they came from."""
    parts = []
    if met is not None:
        merged = _grouped(met, criterion, null_keys)
        parts.append(merged.withColumns(
            {"_node": F.col("_gid"), "_base": F.col("_tok"), "_born": F.lit(born)}) if born else merged)
    if alone is not None:
        parts.append(_carried(alone, criterion, null_keys))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _dated(rows: DataFrame) -> DataFrame:
    """A row that never met another has no date either, if that is none."""
    if "date_posted" not in rows.columns:
        return rows
    return rows.withColumn("date_posted", F.expr("if(try_cast(date_posted AS DATE) IS NULL, NULL, date_posted)"))


def merge_pass(rows: DataFrame, criterion: str, null_keys: str = SKIP) -> DataFrame:
    """Merge leaves that agree on one criterion. Those that agree with no other are not shuffled."""
    return _dated(_passed(*_meeting(spool(rows, "level"), criterion, null_keys), criterion, null_keys))


def with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Replace text references by the texts they point at.

    Of leaves with equal texts one holds the text for all, and only the texts of holders are shuffled: the others
    are kept out by a filter of the holders. A leaf that occurs several times holds its own texts. Rows
    meet texts by plain shuffles from files, so a text that many rows have is split by adaptive execution.
    """
    refs = [c for c in rows.columns if c.startswith("_ref_")]
    if not refs:
        return rows
    rows = spool(rows, "winners")
    again = spool(texts.groupBy("_leaf").count().where("count > 1").select("_leaf"), "again")
    for ref in refs:
        name, rest = ref.removeprefix("_ref_"), [c for c in rows.columns if c != ref]
        own = rows.select(F.col(f"{ref}.sha").alias("_sha"), F.col(f"{ref}.leaf").alias("_leaf")).where("_leaf is not null")
        holders = spool(
            own.join(again, "_leaf", "left_anti").groupBy("_sha").agg(F.min("_leaf").alias("_held")), "holders")
        several = again.select(F.col("_leaf").alias("_several"))
        # rows without a text get a key of their own, so that they are spread
        key = F.coalesce(F.when(F.col(f"{ref}.leaf").isNotNull(), F.coalesce("_several", "_held")),
                         F.concat(F.lit("-"), "_gid"))
        pointed = rows.join(several, F.col(f"{ref}.leaf") == F.col("_several"), "left").join(
            holders, F.col(f"{ref}.sha") == F.col("_sha"), "left")
        pointed = spool(pointed.select(*rest, key.alias("_from")), "pointed")
        wanted = holders.select(F.col("_held").alias("_from")).union(again.select(F.col("_leaf").alias("_from")))
        source = texts.where(F.col(name).isNotNull()).select(F.col("_leaf").alias("_from"), name)
        rows = pointed.join(thinned(source, "_from", wanted, texts), "_from", "left").select(*rest, name)
    return rows


@dataclass
class Merged:
    """Merged rows, still without texts, and which leaf went into which of them."""

    rows: DataFrame
    members: DataFrame | None


def packed(group: Column) -> Column:
    """A group's name in half the bytes: the digest of a named group after its criterion's number."""
    found = F.concat(F.lit(b"\0"), group.cast("binary"))
    for number, name in enumerate(CRITERIA, start=1):
        rest = F.unhex(F.substring(group, len(name) + 2, 64))
        is_named = group.startswith(f"{name}:") & (F.length(group) == len(name) + 65) & rest.isNotNull()
        found = F.when(is_named, F.concat(F.lit(bytes([number])), rest)).otherwise(found)
    return found


def unpacked(group: Column) -> Column:
    kind, rest = F.hex(F.substring(group, 1, 1)), F.substring(group, 2, 1 << 30)
    found = rest.cast("string")
    for number, name in enumerate(CRITERIA, start=1):
        found = F.when(kind == f"{number:02X}", F.concat(F.lit(f"{name}:"), F.lower(F.hex(rest)))).otherwise(found)
    return found


def _tokens(rows: DataFrame, depth: int, null_keys: str) -> list[Column]:
    """``_tok0`` and so on: a row's tokens from the pass it was born in up to ``depth``, null for others."""
    found, token = [], F.col("_base")
    for i, criterion in enumerate(CRITERIA):
        if 0 < i <= depth:
            later = _order_token(rows, list(CRITERIA)[i - 1], null_keys, token)
            token = F.when(F.col("_born") < i, later).otherwise(token)
        known = token if i <= depth else F.lit(None).cast("string")
        found.append(F.when(F.col("_born") <= i, known).alias(f"_tok{i}"))
    return found


def merge_leaves(rows: DataFrame, null_keys: str = SKIP, members: bool = False) -> Merged:
    """All four passes in order, over a stored table of leaves.

    Every level is written once, and a pass shuffles only rows that may meet others in it. With ``members``, rows
    know which merge they came from, and ``members`` gives each leaf with its instance columns, its final group
    (``packed``) and the tokens that order the group's instances.
    """
    names = list(CRITERIA)
    if members:
        rows = rows.withColumns({"_node": F.col("_leaf"), "_base": F.col("_tok"), "_born": F.lit(0)})
    fields = [c for c in INSTANCE_COLS if c in rows.columns]
    links, level = [], rows

    def link(part: DataFrame, depth: int, to: Column) -> DataFrame:
        return part.select("_node", "_born", *fields, *_tokens(part, depth, null_keys), to.alias("_to"))

    for depth, criterion in enumerate(names):
        last = depth + 1 == len(names)
        alone, met = _meeting(level, criterion, null_keys)
        if members:
            # in the last pass every row gets its final group
            part = level if last else met
            links.append(None if part is None else link(part, depth, packed(next_group(part, criterion, null_keys))))
        level = _passed(alone, met, criterion, null_keys, (depth + 1) * members)
        level = level if last else spool(level, "merge")
    merged = _dated(level.drop(*_BIRTH))
    if not members:
        return Merged(merged, None)

    # From the last pass backwards: rows that met in a pass go where the row went that came of them. The key may be
    # hot; the joins have plain shuffles that adaptive execution can split.
    toks = [f"_tok{i}" for i in range(len(names))]
    found = links[-1].withColumnRenamed("_to", "_final")
    for depth in reversed(range(len(names) - 1)):
        if links[depth] is None:
            continue
        onward = found.where(F.col("_born") == depth + 1).select(
            packed(F.col("_node")).alias("_to"), "_final", *[F.col(t).alias(f"{t}_on") for t in toks])
        joined = links[depth].join(onward, "_to").select(
            "_node", "_born", *fields, *[F.coalesce(t, f"{t}_on").alias(t) for t in toks], "_final")
        found = found.where(F.col("_born") != depth + 1).unionByName(joined)
    return Merged(merged, found.select(F.col("_node").alias("_leaf"), *fields, "_final", *toks))
