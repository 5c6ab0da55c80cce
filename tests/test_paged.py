import json

from tallyforge.sources import paged


def put(folder, table, n, rows, more=True):
    (folder / table).mkdir(parents=True, exist_ok=True)
    page = {"items": [{"record_id": i, "fields": f} for i, f in rows], "has_more": more, "page_token": f"{n + 1:09d}"}
    (folder / table / f"{n:09d}.json").write_text(json.dumps(page))


def test_batches_read_all_pages_of_all_tables(spark, tmp_path):
    for n in range(40):
        put(tmp_path, "t1", n, [(f"r{n}", {"c": n, "标题": ["é", {"text": "x"}]})], n < 39)
    put(tmp_path, "t2", 0, [("z", None), ("y", {})], False)
    got = paged.read(spark, f"file://{tmp_path}")
    assert got.rdd.getNumPartitions() == 4  # 16, 16 and 8 pages, and those of t2
    rows = {(r["table"], r["record_id"]): (r["page"], r["fields"]) for r in got.collect()}
    assert len(rows) == 42 and rows["t2", "z"] == (0, {})
    page, cells = rows["t1", "r7"]
    assert page == 7 and cells["c"] == "7" and json.loads(cells["标题"]) == ["é", {"text": "x"}]
    assert paged.read(spark, f"file://{tmp_path}", ["t2"]).count() == 2


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    pages, out, state = tmp_path / "pages", f"file://{tmp_path}/out", f"file://{tmp_path}/state"

    def run():
        query = paged.stream(spark, f"file://{pages}").writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        query.awaitTermination()
        return sorted(r["record_id"] for r in spark.read.parquet(out).collect())

    put(pages, "t1", 0, [("a", {})])
    put(pages, "t1", 1, [("b", {}), ("c", {})])
    assert run() == ["a", "b", "c"]
    put(pages, "t1", 2, [("d", {})], False)
    put(pages, "t2", 0, [("e", {})], False)
    assert run() == ["a", "b", "c", "d", "e"]
    assert run() == ["a", "b", "c", "d", "e"]


def test_pages_that_spark_writes_read_back(spark, tmp_path):
    rows = spark.range(1050).selectExpr("IF(id < 50, 'few', 'many') AS table", "lpad(id, 5, '0') AS record_id", "id AS n", "IF(id % 2 = 0, NULL, 'x') AS t")
    paged.write_pages(rows, f"file://{tmp_path}/p", 100)
    got = paged.read(spark, f"file://{tmp_path}/p").collect()
    assert len(got) == 1050 and {r["page"] for r in got if r["table"] == "many"} == set(range(10))
    assert all(int(r["record_id"]) == int(r["fields"]["n"]) for r in got)
    assert all(r["page"] == (int(r["record_id"]) - 50) // 100 for r in got if r["table"] == "many")
    last = json.loads((tmp_path / "p" / "many" / "000000009.json").read_text())
    assert last["has_more"] is False
