import random

from gridlake.plans.detect import detect_tables
from gridlake.streaming import append_tables

PAGES = "page_id long, url string, html string"


def test_stream_finds_what_the_batch_finds(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("pages", "grid", "marks"))
    body = "<table><tr><td>h</td></tr><tr><td>{}</td></tr></table><pre>a,b\n{},2</pre>"

    def arrive(ids):
        rows = [(i, "u", body.format(i, i)) for i in ids]
        spark.createDataFrame(rows, PAGES).write.mode("append").parquet(source)

    def drain():
        stream = spark.readStream.schema(PAGES).parquet(source)
        append_tables(stream, out, marks, available_now=True).awaitTermination()

    arrive(range(3))
    drain()
    arrive(range(3, 5))
    drain()
    columns = ["page_id", "kind", "table_idx", "row_idx", "cells"]

    def plain(df):
        return sorted((tuple(r[:4]), tuple(r.cells)) for r in df.select(*columns).collect())

    assert plain(spark.read.parquet(out)) == plain(detect_tables(spark.read.parquet(source)))


def test_profiles_follow_a_stream_of_rows(spark, tmp_path):
    from gridlake.operators.types import column_evidence, decide_profile, infer_types, merge_evidence
    from gridlake.streaming import append_evidence, current_profile

    rng = random.Random(2)
    cells = ["1.234,50", "$ 5", "12%", "03/04/2020", "N/A", "", "abc", "7"]
    rows = [(page, "html", 0, i, ["a", "b", "c"] if i == 0 else [rng.choice(cells[j::3]) for j in range(rng.randrange(1, 4))]) for page in (None, *range(12)) for i in range(30)]
    rng.shuffle(rows)
    schema = "page_id long, kind string, table_idx int, row_idx long, cells array<string>"
    whole = spark.createDataFrame(rows, schema)
    source = str(tmp_path / "rows")
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    append_evidence(stream, str(tmp_path / "evidence"), str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
    want = sorted(map(str, infer_types(whole).collect()))
    assert sorted(map(str, current_profile(spark, str(tmp_path / "evidence")).collect())) == want
    parts = [column_evidence(spark.createDataFrame(rows[i::2], schema)) for i in (0, 1)]
    assert sorted(map(str, decide_profile(merge_evidence(*parts)).collect())) == want
    assert sorted(map(str, decide_profile(merge_evidence(*parts[::-1])).collect())) == want
