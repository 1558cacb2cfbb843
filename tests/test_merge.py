import random

import pytest
from pyspark.sql import functions as F

from rolecall.operators.dedup import GROUP, SKIP, merge_leaves
from rolecall.operators.details import aligned_records, instance_records
from rolecall.operators.numbering import row_numbers
from rolecall.plans.merge import batch_leaves, merge_batch, merged_table
from rolecall.schema import CRITERIA, INSTANCE_COLS
from rolecall.sources.storage import materialize

COLS = ["id", "job_url_direct", "title", "company", "date_posted", "min_amount", "is_favorite",
        "description", "company_description"]
LISTED = [c for c in COLS if c in INSTANCE_COLS]
SCHEMA = ("ord long, id string, job_url_direct string, title string, company string, "
          "date_posted string, min_amount double, is_favorite boolean, description string, "
          "company_description string")


def random_rows(seed, n, start=0):
    rnd = random.Random(seed)
    def pick(*values):
        return rnd.choice(values)
    return [
        dict(ord=start + i, id=f"p{rnd.randrange(n)}", job_url_direct=pick(None, None, "u1", "u2", "u3\0x", "u3"),
             title=pick("A", "B", "Bé", "C", None), company=pick("x", "y", None, "xx"),
             date_posted=pick("2024-01-0%d" % rnd.randrange(1, 9), None),
             min_amount=pick(None, 1.0, 2.5, float(i)), is_favorite=pick(True, False),
             description=pick(None, "long text", "text", "éééé", "same", f"d{i % 5}"),
             company_description=pick(None, "we", "us!"))
        for i in range(n)]


def same(a, b, columns):
    return all(a[c] == b[c] for c in columns)


def plain_merge(batch, archive, null_keys):
    """The merge rules on lists of dicts, row by row."""
    batch = [dict(r, lists={c: [r[c]] if r[c] is not None else [] for c in LISTED}) for r in batch]
    archive = [r if "lists" in r else
               dict(r, lists={c: [r[c]] if r[c] is not None else [] for c in LISTED}) for r in archive]
    fresh = []
    for r in batch:
        if not any(same(r, k, LISTED) for k in fresh):
            fresh.append(r)
    fresh = [r for r in fresh if not any(same(r, a, LISTED) for a in archive)]
    def touches(a):
        return any(
            all(a[k] is not None and a[k] == r[k] for k in keys)
            for keys in CRITERIA.values() for r in fresh)
    rows = fresh + [a for a in archive if touches(a)]
    rest = [a for a in archive if not touches(a)]
    for keys in CRITERIA.values():
        groups, passed = {}, []
        for r in rows:
            if null_keys == SKIP and any(r[k] is None for k in keys):
                passed.append(r)
            else:
                groups.setdefault(tuple(r[k] for k in keys), []).append(r)
        order = sorted(groups, key=lambda t: [(v is None, v or "") for v in t])
        rows = [merge_group(groups[k]) for k in order] + passed
    return rows + rest


def merge_group(rows):
    out = {"lists": {c: sum((r["lists"][c] for r in rows), []) for c in LISTED}}
    for c in COLS:
        present = [r[c] for r in rows if r[c] is not None]
        if not present:
            out[c] = None
        elif c == "date_posted":
            out[c] = max(present)
        elif c.endswith("description"):
            out[c] = max(present, key=len)
        else:
            out[c] = present[-1]
    return out


def key(row):
    return tuple((v is None, str(v)) for v in row)


def frame(spark, rows):
    return spark.createDataFrame([[r[c] for c in ["ord", *COLS]] for r in rows], SCHEMA)


@pytest.mark.parametrize("null_keys", [SKIP, GROUP])
@pytest.mark.parametrize("seed", [1, 2])
def test_merge_equals_row_by_row_rules(spark, seed, null_keys):
    batch, archive = random_rows(seed, 60), random_rows(seed + 100, 50)
    got = merged_table(frame(spark, batch), frame(spark, archive), null_keys)
    want = plain_merge(batch, archive, null_keys)
    assert sorted((tuple(r[c] for c in COLS) for r in got.collect()), key=key) == sorted(
        (tuple(r[c] for c in COLS) for r in want), key=key)


@pytest.mark.parametrize("null_keys", [SKIP, GROUP])
def test_lists_after_two_merges(spark, null_keys):
    first, second = random_rows(5, 60), random_rows(6, 60, start=1000)
    one = merge_batch(frame(spark, first), 1, null_keys=null_keys)
    two = merge_batch(frame(spark, second), 2, one.postings, one.instances, null_keys, "postings")
    gone = {(r.posting_id, r.merge_seq) for r in two.retired.collect()}
    postings, instances = one.postings.unionByName(two.postings), one.instances.unionByName(two.instances)
    lists = {}
    for r in instances.orderBy("seq").collect():
        for c in LISTED:
            if r[c] is not None:
                lists.setdefault((r.posting_id, r.merge_seq), {}).setdefault(c, []).append(r[c])
    got = [
        tuple(str(r[c]) for c in COLS)
        + tuple(str(lists[r.posting_id, r.merge_seq].get(c, [])) for c in LISTED)
        for r in postings.collect() if (r.posting_id, r.merge_seq) not in gone]
    want = [
        tuple(str(r[c]) for c in COLS) + tuple(str(r["lists"][c]) for c in LISTED)
        for r in plain_merge(second, plain_merge(first, [], null_keys), null_keys)]
    assert sorted(got) == sorted(want)


def test_merging_again_changes_nothing(spark):
    rows = frame(spark, random_rows(7, 50))
    one = merge_batch(rows, 1)
    two = merge_batch(rows, 2, one.postings, one.instances)
    assert two.postings.count() == 0 and two.retired.count() == 0


def test_instances_are_preserved(spark):
    rows = random_rows(8, 80)
    one = merge_batch(frame(spark, rows), 1, null_keys=GROUP)
    assert one.postings.agg(F.sum("n_instances")).first()[0] == one.instances.count()


def test_explode_takes_lists_by_position(spark):
    rows = random_rows(9, 60)
    one = merge_batch(frame(spark, rows), 1, null_keys=GROUP)
    lists = {}
    for r in one.instances.orderBy("seq").collect():
        held = lists.setdefault(r.posting_id, {c: [] for c in LISTED})
        for c in LISTED:
            if r[c] is not None:
                held[c].append(r[c])
    want = [
        (p, i + 1) + tuple((held[c][i] or None) if i < len(held[c]) else None for c in LISTED)
        for p, held in lists.items() for i in range(len(held["id"]))]
    got = [(r.posting_id, r.instance) + tuple(r[c] for c in LISTED)
           for r in instance_records(one.instances).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert aligned_records(one.instances).count() == one.instances.count()


def test_row_numbers_over_many_slices(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), (F.col("id") % 3).alias("k"))
    got = row_numbers(rows, [F.col("k").desc(), F.col("v")]).collect()
    want = sorted(((r["k"], r["v"]) for r in got), key=lambda t: (-t[0], t[1]))
    assert [(r["k"], r["v"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 5001))


def test_hot_key_joins_are_split(spark):
    """A third of all leaves in one group: adaptive execution splits the join that follows it."""
    settings = {
        "spark.sql.shuffle.partitions": "60",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.files.openCostInBytes": "1000", "spark.sql.files.maxPartitionBytes": "40000",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    saved = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 20000, 1, 8).selectExpr(
            "id AS ord", "concat('p', if(id % 3 = 0, 0, id)) AS id",
            "CAST(NULL AS STRING) AS job_url_direct", "concat('t', id % 1000) AS title",
            "concat('c', id) AS company", "'2024-01-01' AS date_posted",
            "CAST(id AS DOUBLE) AS min_amount", "concat('d', id) AS description")
        leaves = materialize(batch_leaves(rows), "leaves")
        totals = merge_leaves(leaves, members=True).members.agg(F.count("*"), F.max("_tok0"))
        assert totals.first()[0] == 20000
        totals.collect()
        assert "skew=true" in totals._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
