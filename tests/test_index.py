"""The segmented keyword index and the manifest against searches over the whole corpus."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from verso.operators import answering, blocks, index, lexical, predicates
from verso.operators.index import KeywordIndex
from verso.operators.manifest import Conflict, Manifest, alive
from verso.operators.registry import checksum_of, corpus_checksum, digest_sums, row_digest

RNG = random.Random(7)
WORDS = [f"w{i}" for i in range(120)]
CHUNK = "chunk_id long, text string, doc_id long, filename string, department string, document_status string, document_type string"


def row(i, rng=RNG):
    return (i, " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(len(WORDS))], k=rng.randint(0, 60))), i // 3, f"f{i % 4}", rng.choice(("", "hr", None)), rng.choice(("a", "b")), "t")


def jobs(spark, work):
    """What ``work`` returns, and how many jobs it has run."""
    group = f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    out = work()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "rest")
    return out, n


def same_as_whole(spark, own, chunks, k=7):
    q = spark.createDataFrame([(i, " ".join(RNG.choices(WORDS, k=RNG.randint(1, 9)))) for i in range(12)], "query_id int, question string")
    for keep in (RNG.choice((None, predicates.metadata({"document_status": "a"}))),):
        want = sorted(map(tuple, lexical.search(chunks, q, k, keep).select("query_id", "chunk_id", "bm25_score", "bm25_rank").collect()))
        assert sorted(map(tuple, own.search(q, k, keep).select("query_id", "chunk_id", "bm25_score", "bm25_rank").collect())) == want
    state = own.current()
    n, length = chunks.agg(F.count("*"), F.sum(F.size(F.expr(r"regexp_extract_all(lower(coalesce(text, '')), '([\\p{L}\\p{N}_]+)', 1)")))).head()
    assert (state["n"], state["length"]) == (n, length or 0)
    assert own.checksum() == corpus_checksum(chunks).head()["checksum"]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "CHUNKS", 16)


def test_segments_equal_a_full_build(spark, tmp_path, small_blocks, monkeypatch):
    monkeypatch.setattr(index, "FEW", 0)  # by bounds
    rows = {i: row(i) for i in range(300)}
    folder = f"{tmp_path}/files"

    def put(part):
        spark.createDataFrame([rows[i] for i in part if i in rows], CHUNK).coalesce(1).write.mode("overwrite").parquet(f"file://{folder}/p{part[0]}")

    def now():
        return spark.read.schema(CHUNK).option("recursiveFileLookup", "true").parquet(f"file://{folder}").select("*", F.col("_metadata.file_path").alias("file"))

    parts = [list(range(a, a + 50)) for a in range(0, 300, 50)]
    for p in parts:
        put(p)
    own = KeywordIndex(spark, f"file://{tmp_path}/index")
    assert own.refresh(now())
    same_as_whole(spark, own, now())
    assert jobs(spark, lambda: own.refresh(now())) == (False, 0) and own.current()["version"] == 1  # nothing is read
    for i in (3, 4, 5):  # three chunks of one file
        rows[i] = row(i, random.Random(100 + i))
    rows[6] = (*rows[6][:3], "renamed", *rows[6][4:])
    put(parts[0])
    assert own.refresh(now())
    state = own.current()
    assert [s["n"] for s in state["segments"]] == [296, 4]  # only what differs is indexed
    same_as_whole(spark, own, now())
    assert {r["filename"] for r in own.segments.rows(state).filter("chunk_id = 6").collect()} == {"renamed"}
    del rows[60], rows[61]
    put(parts[1])
    assert own.refresh(now())
    same_as_whole(spark, own, now())
    rows |= {i: row(i) for i in range(1000, 1200)}
    put(list(range(1000, 1200)))
    assert own.refresh(now())
    state = own.current()
    assert len(state["segments"]) == 1 and not state["dead"]  # merged, and what had ended is gone
    same_as_whole(spark, own, now())
    last = own.manifest.versions()[-1]
    assert own.manifest.forget() > 0 and own.manifest.versions() == [last]
    same_as_whole(spark, own, now())


def test_chunks_that_are_no_files_are_compared(spark, tmp_path, small_blocks):
    rows = [row(i) for i in range(40)]
    own = KeywordIndex(spark, f"file://{tmp_path}/index")
    df = lambda r: spark.createDataFrame(r, CHUNK)
    assert own.refresh(df(rows)) and not own.refresh(df(rows[::-1]))
    assert own.refresh(df(rows[5:])) and own.current()["n"] == 35
    same_as_whole(spark, own, df(rows[5:]))
    assert own.refresh(df(rows)) and own.current()["n"] == 40
    same_as_whole(spark, own, df(rows))
    assert own.refresh(df([])) and own.search(spark.createDataFrame([(1, "w1")], "query_id int, question string")).count() == 0


def test_blocks_out_of_reach_are_not_scored(spark, tmp_path, small_blocks, monkeypatch):
    """Where rare words decide, blocks without them are left out; the result is whole."""
    monkeypatch.setattr(index, "FEW", 0)
    rows = [(i, "common common rare gem" if i in (5, 6, 7) else "common " * (1 + i % 3) + f"w{i % 9}", i, "f", "", "a", "t") for i in range(200)]
    chunks = spark.createDataFrame(rows, CHUNK)
    own = KeywordIndex(spark, f"file://{tmp_path}/index")
    own.refresh(chunks)
    q = spark.createDataFrame([(1, "rare gem common")], "query_id int, question string")
    found = own.search(q, 1)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, lexical.search(chunks, q, 1).select(found.columns).collect()))
    assert own.segments.scores(own.current(), q, 1).count() <= 3 < 190 < own.scores(q).count()


def test_words_come_back_from_blocks(spark):
    words = spark.createDataFrame([(i, "d", WORDS[i : i + i % 7] * 2) for i in range(50)], "chunk_id long, department string, words array<string>")
    back = blocks.words_of(blocks.build(words, "s", 50))
    assert {r["chunk_id"]: sorted(r["words"]) for r in back.collect()} == {r["chunk_id"]: sorted(r["words"]) for r in words.collect()}


def test_blocks_of_long_texts_are_bounded_and_dealt(spark, monkeypatch):
    """Long texts fill a block by their words and go to several tasks, as fresh texts and as words of a merge."""
    monkeypatch.setattr(blocks, "CHUNKS", 64)
    monkeypatch.setattr(blocks, "WORDS", 2000, raising=False)
    rows = [(i, "d", " ".join(WORDS[(i + j) % len(WORDS)] for j in range(500 if i % 4 == 0 else 5))) for i in range(400)]
    texts = spark.createDataFrame(rows, "chunk_id long, department string, text string")
    words = texts.select("chunk_id", "department", F.split("text", " ").alias("words"))
    for source in (words, texts):
        made = blocks.build(source, "s", 400).select("chunk_ids", "lengths", F.spark_partition_id().alias("task")).collect()
        assert sorted(c for r in made for c in r["chunk_ids"]) == list(range(400))
        assert all(sum(r["lengths"]) <= 4000 and len(r["lengths"]) <= 64 for r in made)
        tasks = {}
        for r in made:
            tasks[r["task"]] = tasks.get(r["task"], 0) + sum(r["lengths"])
        assert max(tasks.values()) <= 16000  # of 51,500
    assert len([r for r in made if max(r["lengths"]) < 500]) < 10  # short texts share blocks


def test_what_is_found_is_not_searched_again(spark, tmp_path):
    """Padded searches and answers read their hits several times, and search once."""
    rng = random.Random(5)
    chunks = spark.createDataFrame([row(i, rng) for i in range(60)], CHUNK)
    own = KeywordIndex(spark, f"file://{tmp_path}/index")
    own.refresh(chunks)
    q = spark.createDataFrame([(1, WORDS[0]), (2, f"{WORDS[1]} {WORDS[2]}")], "query_id int, question string")
    padded = lexical.search_padded(chunks, q, 7, index=own)
    assert sorted(map(tuple, padded.collect())) == sorted(map(tuple, lexical.search_padded(chunks, q, 7).select(padded.columns).collect()))
    asked = q.selectExpr("query_id", "question", "array(1f, 0f) query_vector", "cast(null as long) doc_id", "false has_history")
    whole = chunks.selectExpr("*", "1 page_num", "0 chunk_index", "array(cast(chunk_id as float), 1f) embedding")
    told = answering.answer(asked, whole, index=own, guard_input=False, embed_query=lambda _: F.array(F.lit(1.0), F.lit(0.0)))
    assert told.count() == 2
    for made in (padded, told):
        assert "MapInArrow" not in made._jdf.queryExecution().toString()


def test_cells_follow_lengths():
    assert blocks.cells([]) == ([0], [1])
    first, many = blocks.cells([(0, 10, 10), (1, 10, 20), (3, 5 * blocks.CHUNKS, 100), (5, 3, 3 * blocks.WORDS)])
    assert first == [0, 0, 0, 1, 7, 7] and many == [1, 1, 1, 6, 1, 3]  # class 4 is empty


def test_checksums_add_up(spark):
    chunks = spark.createDataFrame([row(i) for i in range(30)], CHUNK)
    parts = [chunks.filter(f"chunk_id % 3 = {i}") for i in range(3)] + [chunks.filter("false")]
    sums = [[x or 0 for x in p.agg(*digest_sums(row_digest())).head()] for p in parts]
    assert checksum_of(sums) == corpus_checksum(chunks).head()["checksum"]
    assert checksum_of([]) == corpus_checksum(chunks.filter("false")).head()["checksum"]


def test_one_of_two_writers_wins(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    assert m.state() == {"version": 0} and m.publish({"version": 0, "a": [1]}) == 1
    old = m.state()
    assert m.publish(old | {"a": [2]}) == 2
    with pytest.raises(Conflict):
        m.publish(old | {"a": [3]})
    assert m.state()["a"] == [2] and m.state(1)["a"] == [1] and m.newer(1) == [2]
    writers = [threading.Thread(target=lambda i=i: Manifest(spark, f"file://{tmp_path}/m").change(lambda s: s | {"a": [*s["a"], i]}, tries=50)) for i in range(8)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(m.state()["a"]) == sorted([2, *range(8)]) and m.newer(2) == list(range(3, 11))  # nothing is lost, and a reader that polls sees each
    assert m.change(lambda s: None)["version"] == 10


def test_later_entries_end_rows(spark):
    rows = spark.createDataFrame([(1, 1), (1, 3), (2, 1), (3, 2)], "chunk_id long, born long")
    dead = spark.createDataFrame([(1, 3), (3, 2), (2, 5), (2, 1)], "chunk_id long, died long")
    assert sorted(map(tuple, alive(rows, dead).collect())) == [(1, 3), (3, 2)]
