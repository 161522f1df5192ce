"""Items that are short or full of numbers, at every offset and beside any other item."""

from pyspark.sql import functions as F

from lexmill.llm import decontamination


def test_numbers_and_short_items_at_every_offset(spark):
    rows = [(1, "List 1 2 3 4 5 6 7 8"), (2, "blue heron"), (3, "red"), (4, "5 6")]
    texts = ["so " * n + "on. List 1 2 3 4 5 6 7 8 and so on" for n in range(8)] + ["a blue heron stands", "it was red here", "5 6", "a heron, blue"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for only in ([1], [1, 2, 3, 4]):
        bench = spark.createDataFrame([r for r in rows if r[0] in only], "item_id long, text string")
        got = {(r.doc_id, r.item_id) for r in decontamination.contaminated_documents(docs, bench).collect()}
        assert got == {(i, j) for i, j in [*((n, 1) for n in range(8)), (8, 2), (9, 3)] if j in only}


def test_long_runs_of_names_and_numbers(spark):
    # Runs that a backtracking matcher can't hold on a task's stack; what stands beside them is still found.
    runs = [", so " + " ".join(["Alpha Beta"] * 30_000), " ".join(["Alpha Beta"] * 30_000), "12," * 60_000 + "12", " 1.2:3/4" * 40_000]
    docs = spark.createDataFrame([(i, f"the quick brown fox jumps over lazy dogs. {run}") for i, run in enumerate(runs)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over lazy dogs")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.coverage) for r in decontamination.contaminated_documents(docs, bench).collect()}
    assert got == {(i, 1, 1.0) for i in range(len(runs))}
    sizes = [r.n for r in docs.orderBy("doc_id").selectExpr("doc_id", "text").withColumn("n", F.size(decontamination.tokens(F.col("text")))).collect()]
    assert sizes == [8 + 2, 8 + 1, 8 + 1, 8 + 40_000]
