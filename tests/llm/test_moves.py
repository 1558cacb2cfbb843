"""What operators send: blocks are not broadcast, texts go once."""

from pyspark.sql import functions as F

from rolecall.llm import repeats, topk


def test_blocks_of_queries_are_not_broadcast(spark):
    vectors = spark.range(300).select(F.col("id").alias("vec_id"), F.array(*(F.rand(i) for i in range(4))).alias("embedding"))
    plan = topk.top_k(vectors.where("vec_id < 3"), vectors, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [block" in plan and "BroadcastHashJoin [block" not in plan


def test_rows_carry_their_text_once(spark, monkeypatch):
    seen = []

    def watched(rows, most):
        seen.append(rows.schema)
        return with_runs(rows, most)

    with_runs = repeats._with_runs
    monkeypatch.setattr(repeats, "_with_runs", watched)
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words, 5), (2, "x " + words, 6), (3, None, None)], "doc_id long, text string, n_chars int")
    kept = repeats.without_repeats(docs)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, words, 5), (2, "x", 1), (3, None, None)], key=str)
    assert kept.columns == docs.columns and "text" not in seen[0]["_row"].dataType.fieldNames()
