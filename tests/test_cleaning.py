import hashlib

from inkspan.functions import decode
from inkspan.operators import cleaning
from inkspan.streaming import clean_stream

ROWS = [
    (0, "doc_000000", "<p>Revenue   &amp; <b>costs</b></p>"),
    (1, "doc_000001", "revenue & COSTS"),
    (2, "doc_000002", "<table><tr><td>1a</td><td>2</td></tr></table>&lt;12%&gt;x"),
    (3, "doc_000003", None),
    (4, "doc_000004", ""),
]


def _docs(spark):
    return spark.createDataFrame(ROWS, "doc_idx long, document_id string, text string")


def test_pipeline(spark):
    got = {r["doc_idx"]: r for r in cleaning.mark_duplicates(cleaning.clean(_docs(spark))).collect()}
    assert got[0]["text"] == "Revenue & costs"
    assert got[0]["html_elements_removed"] == 4
    assert got[1]["is_duplicate"] and got[1]["duplicate_of"] == "doc_000000"
    assert got[2]["text"] == "1a 2\nx" and got[2]["table_count"] == 1
    assert got[2]["content_hash"] == hashlib.sha256(b"1a 2 x").hexdigest()
    assert got[3]["original_length"] == 0 and got[4]["duplicate_of"] == "doc_000003"
    assert list(got[0]["steps_completed"]) == list(cleaning.STEPS) and got[0]["errors"] == []


def test_report_and_running_totals(spark):
    found = cleaning.mark_duplicates(cleaning.clean(_docs(spark)))
    r = cleaning.cleaning_report(found).first()
    assert (r["documents_processed"], r["documents_failed"], r["duplicates_detected"], r["table_count"]) == (5, 0, 2, 1)
    marked = cleaning.mark_hashed(found.drop("is_duplicate", "duplicate_of"))._jdf.queryExecution().executedPlan().toString()
    # one scan of the written table, no cleaning again, and texts are in no exchange
    assert marked.count("ArrowEvalPython") == 0 and "Exchange hashpartitioning" not in marked
    assert [x["table_count"] for x in cleaning.running_counts(found).orderBy("doc_idx").collect()] == [0, 0, 1, 1, 1]
    assert tuple(cleaning.dedup_statistics(found).first()) == (5, 3, 2)
    assert cleaning.cleaning_report(found.limit(0)).first()["documents_processed"] == 0


def test_null_texts_are_no_copies(spark):
    got = {r["doc_idx"]: (r["is_duplicate"], r["duplicate_of"]) for r in cleaning.mark_duplicates(_docs(spark).union(_docs(spark).where("text is null").selectExpr("doc_idx + 9", "document_id", "text"))).collect()}
    assert got[3] == got[12] == (False, None) and len(got) == 6


def test_failure_is_alone():
    class Odd(str):
        def __contains__(self, x):
            raise RuntimeError("odd")

    assert decode._decode(Odd("x")) == ("", "odd")
    assert decode._decode(None) == (None, None)


def test_plan_has_one_python_pass_and_no_text_sort(spark):
    plan = cleaning.clean(_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "Exchange" not in plan


def test_stream(spark, tmp_path):
    _docs(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_idx long, document_id string, text string").parquet(str(tmp_path / "in"))
    q = clean_stream.clean_stream(stream).writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("cleaned").where("doc_idx = 0").first()["text"] == "Revenue & costs"


def test_stream_keeps_first_copies(spark, tmp_path):
    rows = spark.sql("select * from values (timestamp'2024-01-01 00:00:00', 'A  b'), (timestamp'2024-01-01 00:00:01', 'a B '), (timestamp'2024-01-01 00:00:02', 'c') as t(ts, text)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = clean_stream.first_copies(stream, "ts").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 2
