import pyarrow as pa
import pytest

from verso.operators.index import KeywordIndex
from verso.operators.manifest import Manifest
from verso.operators.store import ChunkStore, ingest
from verso.sources import files
from verso.streaming import jobs


def test_texts_are_not_sorted_on_the_way_to_the_store(spark):
    seen = []

    class Told:
        def change(self, added, **_):
            seen.append(added)

        def documents(self):
            return spark.createDataFrame([], "doc_id string, status string, chunk_count long, page_count long, error string")

    pages = jobs.document_pages(spark.createDataFrame([(1, "a b " * 300, "x"), (2, "c d " * 300, "y")], "doc_id long, text string, source string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ingest(Told(), pages)
        plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_ingest_patch_and_delete(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("# Điều 1\n" + "nội dung quy định chung " * 20, encoding="utf-8")
    (src / "b.csv").write_text("tên,tuổi\nan,3\n", encoding="utf-8")
    (src / "bad.docx").write_bytes(b"not a zip")
    (src / "tiny.txt").write_text("ngắn", encoding="utf-8")
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    assert store.version() == 0 and store.scan().count() == 0
    pages = files.pages(files.files(spark, f"file://{src}"))
    got = {r["doc_id"]: r for r in ingest(store, pages).collect()}
    names = {r["filename"]: r["doc_id"] for r in pages.collect()}
    assert store.version() == 1 and {n: got[d]["status"] for n, d in names.items()} == {"a.md": "done", "b.csv": "done", "bad.docx": "failed", "tiny.txt": "failed"}
    rows = {r["filename"]: r for r in store.scan().collect()}
    assert rows["b.csv"]["is_table"] and rows["a.md"]["document_status"] == "chua_xac_dinh" and "embedding" not in rows["a.md"].asDict()
    change = spark.createDataFrame([(names["a.md"], "hieu_luc", None, "hr")], "doc_id string, document_status string, document_type string, department string")
    assert store.patch(change) == 1 and store.version() == 2
    assert {r["filename"]: r["department"] for r in store.scan().collect()} == {"a.md": "hr", "b.csv": ""}
    assert store.delete(change) == 1 and store.scan().count() == 1 and store.delete(change) == 0 and store.version() == 3
    assert store.scan(vectors=True).first()["embedding"] is not None


def rows_of(store, version=None):
    return sorted(map(tuple, store.scan(version=version).select("chunk_id", "text", "department").collect()))


def chunk_rows(spark, rows):
    return spark.createDataFrame([(f"{d}_{i}", d, t, [1.0]) for d, i, t in rows], "chunk_id string, doc_id string, text string, embedding array<float>")


def test_adding_twice_is_adding_once_and_only_new_rows_are_written(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    q = spark.createDataFrame([(1, "alpha beta")], "query_id int, question string")
    found = lambda: sorted((r["chunk_id"], r["bm25_score"]) for r in store.index.search(q).collect())
    store.add(chunk_rows(spark, [("a", i, f"alpha {i}") for i in range(30)] + [("b", 0, "beta"), ("b", 1, "gamma")]))
    first, hits = rows_of(store), found()
    store.add(chunk_rows(spark, [("b", 0, "beta"), ("b", 1, "gamma")]))
    assert rows_of(store) == first and found() == hits and store.version() == 2
    assert [p["n"] for p in store.manifest.state()["chunks"]] == [32, 2]  # a part of its own
    store.add(chunk_rows(spark, [("b", 0, "beta beta")]))  # a document that is shorter now
    assert [r for r in rows_of(store) if r[0][0] == "b"] == [("b_0", "beta beta", "")] and rows_of(store, 1) == first
    assert "b_1" not in {c for c, _ in found()} and store.delete(spark.createDataFrame([("a",)], "doc_id string")) == 30
    assert {c for c, _ in found()} == {"b_0"}
    with pytest.raises(ValueError):
        store.add(chunk_rows(spark, [("z", 0, "z")]).drop("embedding"))


def test_a_batch_is_taken_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text of document {i} " * (4 + i), "s") for i in range(9)] + [(20, "text of document 3 " * 7, "s"), (21, None, "s")], "doc_id long, text string, source string")
    whole = ChunkStore(spark, f"file://{tmp_path}/whole")
    pages = jobs.document_pages(docs)
    ingest(whole, pages.filter("doc_id not in ('20')"))

    folder, state = f"file://{tmp_path}/in", f"file://{tmp_path}/state"
    stream = lambda: jobs.document_pages(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(folder))
    for part in ("doc_id < 4", "doc_id >= 4 and doc_id < 20", "doc_id >= 20"):
        docs.filter(part).coalesce(1).write.mode("append").parquet(folder)
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    publish, calls = store.manifest.publish, []

    def dies(state):
        calls.append(state["version"])
        if len(calls) == 1:
            raise RuntimeError("lost before the version is there")
        version = publish(state)
        if len(calls) == 3:
            raise RuntimeError("lost right after")
        return version

    store.manifest.publish = dies
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            jobs.ingest_pages(stream(), store, state).awaitTermination()
    jobs.ingest_pages(stream(), store, state).awaitTermination()
    assert store.version() == 3 and store.manifest.state()["batches"] == {"stream": 2}
    assert rows_of(store) == rows_of(whole)
    shown = lambda s: sorted(map(tuple, s.documents().select("doc_id", "status", "chunk_count", "file_hash").collect()))
    assert shown(store) == shown(whole)
    q = spark.createDataFrame([(1, "document 3")], "query_id int, question string")
    assert sorted(map(tuple, store.index.search(q).collect())) == sorted(map(tuple, whole.index.search(q).collect()))


def test_a_stream_of_documents_equals_one_batch(spark):
    sf_dir = "/root/testdata/sf0.001"
    store, whole = jobs.run_store(spark, sf_dir), ChunkStore(spark, jobs.shared_dir(spark, "whole"))
    pages = jobs.document_pages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    firsts = {}
    for r in pages.select("doc_id", "file_hash").collect():
        firsts[r["file_hash"]] = min(r["doc_id"], firsts.get(r["file_hash"], r["doc_id"]))
    ingest(whole, pages.filter(pages["doc_id"].isin(list(firsts.values()))))
    assert rows_of(store) == rows_of(whole) and store.documents().count() == len(firsts)


def test_python_steps_of_written_parts_get_few_rows_at_once(spark, tmp_path):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    name, manifest = "spark.sql.execution.arrow.maxRecordsPerBatch", Manifest(spark, str(tmp_path))
    before = spark.conf.get(name)
    rows = spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long")
    for at_once, most in ((4, 4), (1024, 1024)):
        found = [r["n"] for r in manifest.read([manifest.write(rows, "sizes", at_once)], "n long").collect()]
        assert max(found) == most and sum(found) == 3000
    assert spark.conf.get(name) == before


def test_an_empty_part_starts_no_python(spark, tmp_path):
    none = Manifest(spark, str(tmp_path)).read([], "chunk_id string, died long")
    assert none.count() == 0 and none.columns == ["chunk_id", "died"]
    assert "ExistingRDD" not in none._jdf.queryExecution().toString()


def test_blocks_reach_python_few_at_once(spark, tmp_path, monkeypatch):
    seen = {}
    write = Manifest.write

    def spy(self, rows, table, at_once=1024):
        seen[table] = max(at_once, seen.get(table, 0))
        return write(self, rows, table, at_once)

    monkeypatch.setattr(Manifest, "write", spy)
    index = KeywordIndex(spark, str(tmp_path))
    index.refresh(spark.createDataFrame([(i, f"one w{i}", "", "", "") for i in range(20)], "chunk_id long, text string, department string, document_status string, document_type string"))
    found = index.search(spark.createDataFrame([(1, "one w3")], "query_id int, question string"), 5)
    assert [r["chunk_id"] for r in found.orderBy("bm25_rank").collect()][0] == 3
    assert seen["bounds"] <= 8 and seen["searches"] <= 8 and seen["blocks"] <= 1024
