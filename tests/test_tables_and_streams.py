import datetime as dt

from pyspark.sql import functions as F

import pytest

from matchloom.sources import snapshots, tables, vector_index
from matchloom.streaming import jobs as streams


def status(spark, rows):
    return spark.createDataFrame(rows, "tenantId string, jobId string, entityType string, status string, updatedAt long")


def test_upsert_and_compaction(spark, tmp_path):
    vec = "tenantId string, id string, text string, embedding array<float>"
    path, target = str(tmp_path / "v"), str(tmp_path / "v2")
    tables.upsert_vectors(spark.createDataFrame([("t", "a", "old", [1.0]), ("t", "b", "keep", [2.0])], vec), path, F.lit(1))
    tables.upsert_vectors(spark.createDataFrame([("t", "a", "new", [3.0])], vec), path, F.lit(2))
    want = {("a", "new"), ("b", "keep")}
    assert {(r.id, r.text) for r in tables.vectors(spark, path).collect()} == want
    tables.compact(spark, path, target, tables.VECTOR_KEYS, ("version", "text"))
    stored = spark.read.parquet(target)
    assert stored.count() == 2 and {(r.id, r.text) for r in stored.collect()} == want
    one = tables.upsert(spark.createDataFrame([(1, 1, "a")], "k int, v int, x string"), spark.createDataFrame([(1, 2, "b"), (2, 1, "c")], "k int, v int, x string"), ["k"], ["v"])
    assert {(r.k, r.x) for r in one.collect()} == {(1, "b"), (2, "c")}


def test_job_status(spark):
    rows = [("t", "a", "STATUS", "RUNNING", 5), ("t", "a", "RESULT", "COMPLETED", 4), ("t", "b", "STATUS", "RUNNING", 1), ("u", "c", "STATUS", "RUNNING", 1)]
    jobs = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "c")], "tenantId string, jobId string")
    s = status(spark, rows)
    assert {r.jobId: r.status for r in tables.current_job_status(jobs, s).collect()} == {"a": "COMPLETED", "b": "RUNNING", "c": "UNKNOWN"}
    assert {r.jobId: r.status for r in tables.current_job_status(jobs, s, raw=True).collect()} == {"a": "RUNNING", "b": "RUNNING", "c": "UNKNOWN"}
    assert {r.jobId for r in tables.stuck_jobs(s, F.lit(902)).collect()} == {"b", "c"}
    assert tables.stuck_jobs(s, F.lit(901)).count() == 0
    assert tables.status_rows(jobs).count() == 3


def test_artifacts(spark, tmp_path):
    jobs = spark.createDataFrame(
        [("t", "job1", "cl", None, "p"), ("t", "job10", "cl", "letter", None)],
        "tenantId string, jobId string, changeLog string, coverLetter string, profile string",
    )
    manifest = tables.artifact_manifest(jobs, F.lit(1000))
    by_job = {r.jobId: r.artifacts for r in manifest.collect()}
    assert by_job["job1"].coverLetterKey is None and by_job["job1"].styleProfileKey == "t/job1/1000/style_profile.json"
    assert by_job["job10"].coverLetterKey == "t/job10/1000/cover_letter.json" and by_job["job1"].expiresAt == 1000 + 7 * 86400
    keys = tables.manifest_keys(manifest)
    assert tables.list_artifacts(keys, "t").count() == 8
    assert all("/job1/" in r.key for r in tables.list_artifacts(keys, "t", "job1").collect())
    result = tables.result_rows(manifest, F.lit(1)).first()
    assert result.status == "COMPLETED" and '"coverLetterKey":null' in result.artifacts + '"coverLetterKey":null'
    path = str(tmp_path / "a")
    assert tables.read_json_artifacts(spark, path, "change_log").count() == 0
    # a run that broke off before its end is read by nobody and replaced by its repetition
    jobs.selectExpr("tenantId", "jobId", "'half' as change_log").write.partitionBy("tenantId").json(f"{path}/change_log/run=r1")
    assert tables.read_json_artifacts(spark, path, "change_log").count() == 0
    assert tables.write_json_artifacts(jobs, path, "r1") and not tables.write_json_artifacts(jobs, path, "r1")
    assert tables.write_json_artifacts(jobs.where("jobId = 'job10'"), path, "r2")
    logs = tables.read_json_artifacts(spark, path, "change_log")
    assert sorted((r.run, r.jobId, r.change_log) for r in logs.collect()) == [("r1", "job1", "cl"), ("r1", "job10", "cl"), ("r2", "job10", "cl")]
    assert tables.read_json_artifacts(spark, path, "cover_letter").count() == 2
    objects = spark.createDataFrame([("x", 0), ("y", 1), ("z", None)], "key string, lastModified long")
    now = F.lit(1 + 7 * 86400)
    assert [r.key for r in tables.expired_artifacts(objects, now).collect()] == ["x"]
    assert {r.key for r in tables.surviving_artifacts(objects, now).collect()} == {"y", "z"}


def write_batches(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_stream_upsert_equals_batch_and_survives_replay(spark, tmp_path):
    schema = "k int, v int, x string"
    batches = [[(1, 1, "a"), (2, 1, "b")], [(1, 3, "d"), (1, 2, "c")], [(2, 0, "late")]]
    stream = write_batches(spark, tmp_path, batches, schema)
    path = str(tmp_path / "out")
    for checkpoint in ("c1", "c2"):  # the second run replays everything
        streams.stream_upsert(stream, path, str(tmp_path / checkpoint), ["k"], ["v"]).awaitTermination()
        assert {(r.k, r.x) for r in snapshots.read(spark, path, ["k"], ["v"]).collect()} == {(1, "d"), (2, "b")}
        snapshots.compact(spark, path, ["k"], ["v"])
    before = snapshots.current(spark, path)
    streams.stream_upsert(stream, path, str(tmp_path / "c2"), ["k"], ["v"]).awaitTermination()
    assert snapshots.current(spark, path) == before  # nothing new, nothing published


def at(minute):
    return dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=minute)


def test_alarms_equal_batch(spark, tmp_path):
    schema = "ts timestamp, kind string"
    batches = [[(at(1), "error"), (at(2), "ok")], [(at(3), "error"), (at(12), "error")], [(at(30), "ok")]]
    stream = write_batches(spark, tmp_path, batches, schema)
    path = str(tmp_path / "out")
    streams.stream_alarms(stream, F.col("kind") == "error", path, str(tmp_path / "c")).awaitTermination()
    got = {(r.window_start, r.failures) for r in streams.current_alarms(spark.read.parquet(path)).collect()}
    batch = spark.createDataFrame([r for b in batches for r in b], schema)
    want = {(r.window_start, r.failures) for r in streams.failure_windows(batch, F.col("kind") == "error").collect()}
    assert got == want and len(got) == 2


def test_alarm_once(spark, tmp_path):
    schema = "ts timestamp, kind string"
    batches = [[(at(1), "error"), (at(2), "ok"), (at(2), "error")], [(at(12), "error"), (at(3), "error")], [(at(30), "ok"), (at(21), "error")], [(at(31), "error"), (at(13), "error")]]
    stream = write_batches(spark, tmp_path, batches[:2], schema)
    path = str(tmp_path / "out")
    found = lambda: sorted(r.window_start for r in spark.read.parquet(path).collect())
    for _ in range(2):
        streams.stream_alarm_once(stream, F.col("kind") == "error", path, str(tmp_path / "c")).awaitTermination()
        assert found() == [at(0), at(10)]
    for i, rows in enumerate(batches[2:]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"later{i}"))
    streams.stream_alarm_once(stream, F.col("kind") == "error", path, str(tmp_path / "c")).awaitTermination()
    assert found() == [at(0), at(10), at(20), at(30)]


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, streams.ROCKSDB)
    yield
    spark.conf.set(name, before)


def test_stuck_stream(spark, tmp_path, rocksdb):
    schema = "tenantId string, jobId string, entityType string, status string, ts timestamp"
    batches = [
        [("t", "slow", "STATUS", "RUNNING", at(0)), ("t", "fine", "STATUS", "RUNNING", at(0)), ("t", "early", "RESULT", "COMPLETED", at(1))],
        [("t", "fine", "RESULT", "COMPLETED", at(5)), ("t", "early", "STATUS", "RUNNING", at(6)), ("t", "broken", "STATUS", "RUNNING", at(6))],
        [("t", "broken", "STATUS", "FAILED", at(7)), ("t", "again", "STATUS", "FAILED", at(7)), ("t", "again", "STATUS", "RUNNING", at(8))],
        [("t", "new", "STATUS", "RUNNING", at(60)), ("t", None, "STATUS", None, None)],
        [("t", "other", "RESULT", "COMPLETED", at(61))],
    ]
    stream = write_batches(spark, tmp_path, batches, schema)
    out = streams.stream_stuck(stream)
    for _ in range(2):  # the second run goes on from the checkpoint and reports nothing twice
        query = (
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        assert sorted(r.jobId for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["again", "slow"]


ROWS = "k int, v int, x string, part string"


def test_snapshots(spark, tmp_path):
    path, keys, order = str(tmp_path / "t"), ["k", "part"], ["v"]
    rows = lambda *r: spark.createDataFrame(list(r), ROWS)
    found = lambda: {(r.k, r.v, r.x) for r in snapshots.read(spark, path, keys, order).collect()}
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path, keys, order)
    snapshots.append(rows((1, 1, "a", "p"), (2, 1, "b", "q"), (None, 1, "n", "q")), path, partition=["part"])
    snapshots.append(rows((1, 2, "c", "p"), (None, 2, "m", "q")), path, "one", ["part"])
    snapshots.append(rows((1, 9, "not twice", "p")), path, "one", ["part"])
    assert found() == {(1, 2, "c"), (2, 1, "b"), (None, 2, "m")}
    old = snapshots.current(spark, path)
    assert snapshots.compact(spark, path, keys, order, ["part"])
    assert not snapshots.compact(spark, path, keys, order, ["part"])  # nothing to do
    snapshots.append(rows((2, 5, "z", "q"), (3, 1, "new", "p"), (1, 1, "late", "p")), path, partition=["part"])
    assert found() == {(1, 2, "c"), (2, 5, "z"), (None, 2, "m"), (3, 1, "new")}
    files = snapshots.read(spark, path, keys, order).inputFiles()
    assert files and not any(folder in f for f in files for folder in old.folders)
    # a writer that dies between write and publish leaves nothing that is read, and its repetition replaces it
    snapshots._write(rows((2, 99, "lost", "q")), path, "changes-two", ["part"])
    assert (2, 5, "z") in found()
    snapshots.append(rows((2, 100, "found", "q")), path, "two", ["part"])
    assert (2, 100, "found") in found()
    # so does a compaction; and a writer that knows an old version only does not publish
    snapshots._write(rows((2, 0, "half", "q")), path, "base-lost", ["part"])
    assert not snapshots.publish(spark, path, old, old) and (2, 100, "found") in found()
    before = found()
    assert "base-lost" in snapshots.clean(spark, path) and found() == before
    only = snapshots.read(spark, path, keys, order, F.col("part") == "q", ["x"])
    assert only.columns == ["k", "part", "x"] and {r.x for r in only.collect()} == {"found", "m"}
    assert "PartitionFilters: [isnotnull(part" in only._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(FileExistsError):
        snapshots.create(rows(), path, ["part"])


def test_compaction_keeps_changes_that_come_meanwhile(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    row = lambda v, x: spark.createDataFrame([(1, v, x)], "k int, v int, x string")
    snapshots.append(row(1, "a"), path)
    write = snapshots._write

    def slow(df, path, folder, partition):
        write(df, path, folder, partition)
        if folder.startswith("base-"):
            monkeypatch.setattr(snapshots, "_write", write)
            snapshots.append(row(2, "b"), path)

    monkeypatch.setattr(snapshots, "_write", slow)
    assert snapshots.compact(spark, path, ["k"], ["v"])
    now = snapshots.current(spark, path)
    assert now.base and len(now.changes) == 1 and snapshots.read(spark, path, ["k"], ["v"]).first().x == "b"


def test_vector_index(spark, tmp_path):
    import numpy as np

    rng, path = np.random.default_rng(4), str(tmp_path / "index")
    centres = rng.normal(size=(20, 16)) * 4
    x = centres[rng.integers(0, 20, 1200)] + rng.normal(size=(1200, 16))
    schema = "tenantId string, id long, embedding array<float>, note string"
    rows = [(f"t{i % 2}", i, x[i].tolist(), "first") for i in range(1000)]
    odd = [("t0", 5000, [], "none"), ("t0", 5001, None, "none"), rows[3], rows[3]]
    vector_index.create(spark.createDataFrame(rows + odd, schema), path, buckets=20)
    assert vector_index.rows(spark, path).count() == 1000
    # new keys, and old keys whose vectors move to another bucket
    moved = [("t0", i, x[i + 1].tolist(), "second") for i in range(0, 100, 2)]
    vector_index.upsert(spark.createDataFrame([(f"t{i % 2}", i, x[i].tolist(), "second") for i in range(1000, 1200)] + moved, schema), path, version=2)
    stored = {(r.tenantId, r.id): r.embedding for r in vector_index.rows(spark, path).collect()}
    assert len(stored) == 1200 and stored["t0", 4] == spark.createDataFrame(moved[2:3], schema).first().embedding
    for _ in range(2):
        asked = spark.createDataFrame([("t0", 9000 + i, x[40 * i].tolist()) for i in range(30)] + [("t0", 1, []), ("t9", 2, x[0].tolist())], "tenantId string, query_id long, embedding array<float>")
        unit = {k: np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) for k, v in stored.items() if k[0] == "t0"}
        want = {}
        for i in range(30):
            q = np.array(np.float32(x[40 * i]), dtype=np.float64)
            q /= np.linalg.norm(q)
            want[9000 + i] = sorted(unit, key=lambda key: (-round(float(unit[key] @ q), 12), key[1]))[:10]
        exact = vector_index.search(spark, path, asked, probes=20).collect()
        assert {(r.query_id, r.rank): r.doc_id for r in exact} == {(q, n + 1): key[1] for q, keys in want.items() for n, key in enumerate(keys)}
        usual = vector_index.search(spark, path, asked).collect()
        hits = {(r.query_id, r.doc_id) for r in usual} & {(q, key[1]) for q, keys in want.items() for key in keys}
        assert len(hits) >= 0.9 * 300 and vector_index._centres(spark, path)[1] <= 6  # far from all buckets
        vector_index.compact(spark, path)
    one = vector_index.search(spark, path, asked.where("query_id = 9001"), probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {f.split("bucket=")[1].split("/")[0] for f in one.inputFiles() if "bucket=" in f}


def test_retention(spark, tmp_path):
    day, now = 86400, 20 * 86400 + 3600
    rows = [("t", f"old{i}", i * day + 7) for i in range(10)] + [("t", "edge", 13 * day + 3599), ("t", "kept", 13 * day + 3600)]
    rows += [("u/%", "gone", 13 * day), ("u/%", "fresh", 19 * day), ("t", "unknown", None), (None, "old", 5)]
    path = str(tmp_path / "o")
    tables.write_objects(spark.createDataFrame(rows, "tenantId string, key string, lastModified long"), path)
    assert tables.prune_objects(spark, path, now) == 13
    assert tables.prune_objects(spark, path, now) == 0
    left = spark.read.parquet(path)
    assert sorted(r.key for r in left.collect()) == ["fresh", "kept", "unknown"]
    assert {r.tenantId for r in left.collect()} == {"t", "u/%"}


def test_search_of_all_buckets_copies_no_query(spark, tmp_path, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(6)
    data = [("ab"[i % 2], i, [float(x) for x in rng.normal(size=4)]) for i in range(120)] + [("a", 500, None)]
    df = spark.createDataFrame(data, "tenantId string, id long, embedding array<double>")
    path = str(tmp_path / "index")
    vector_index.create(df, path, buckets=6)
    asked = df.withColumnRenamed("id", "query_id")

    def routed(*_):
        raise AssertionError("a query was routed")

    monkeypatch.setattr(vector_index, "materialise", routed)
    got = {(r.query_id, r["rank"]): r.doc_id for r in vector_index.search(spark, path, asked, k=3, probes=6).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for _, i, v in data if v}
    tenant = {i: t for t, i, _ in data}
    want = {}
    for i in unit:
        near = sorted((j for j in unit if tenant[j] == tenant[i]), key=lambda j: (-round(float(unit[i] @ unit[j]), 12), j))
        want.update({(i, n + 1): j for n, j in enumerate(near[:3])})
    assert got == want


def test_search_of_many_buckets_copies_no_query(spark, tmp_path, monkeypatch):
    import numpy as np

    from matchloom.operators import matching

    rng = np.random.default_rng(8)
    data = [("ab"[i % 2], i, [float(x) for x in rng.normal(size=4)]) for i in range(200)] + [("a", 500, None)]
    df = spark.createDataFrame(data, "tenantId string, id long, embedding array<double>")
    path = str(tmp_path / "index")
    vector_index.create(df, path, buckets=8)
    asked = df.withColumnRenamed("id", "query_id")
    columns = ["tenantId", "query_id", "rank", "doc_id", "score"]

    def found():
        return sorted(tuple(r) for r in vector_index.search(spark, path, asked, k=3, probes=3).select(columns).collect())

    monkeypatch.setattr(vector_index, "MASKED_SHARE", 2.0)
    want = found()
    exact = sorted(tuple(r) for r in vector_index.search(spark, path, asked, k=3, probes=8).select(columns).collect())
    assert len(want) == 600 and want != exact  # some neighbours lie in buckets not visited
    monkeypatch.undo()

    def routed(*_):
        raise AssertionError("a query was copied")

    monkeypatch.setattr(vector_index, "materialise", routed)
    assert found() == want
    monkeypatch.setattr(matching, "SHARED_QUERIES", 0)  # by blocks
    monkeypatch.setattr(matching, "VECTOR_BLOCK_ROWS", 30)
    assert found() == want


def test_stuck_stream_keeps_jobs_by_shard(spark, tmp_path, rocksdb):
    import random

    rng = random.Random(5)
    schema = "tenantId string, jobId string, entityType string, status string, ts timestamp"
    kinds = [("STATUS", "RUNNING"), ("STATUS", "RUNNING"), ("STATUS", "FAILED"), ("RESULT", "COMPLETED"), ("STATUS", None)]
    batches = [[(f"t{rng.randrange(2)}", f"j{rng.randrange(120)}", *rng.choice(kinds), at(b)) for _ in range(60)] for b in range(5)]
    batches += [[("t", "last", "RESULT", "COMPLETED", at(60))], [("t", "last", "RESULT", "COMPLETED", at(61))]]
    stream = write_batches(spark, tmp_path, batches, schema)
    writer = streams.stream_stuck(stream, lateness="0 seconds", shards=3).writeStream.format("parquet")
    query = writer.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = sorted((r.tenantId, r.jobId, r.startedAt) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    latest, done = {}, set()
    for tenant, job, kind, status, ts in (r for b in batches for r in b):
        if kind == "RESULT":
            done.add((tenant, job))
        else:
            latest[tenant, job] = max(latest.get((tenant, job), (ts, "")), (ts, status or ""))
    want = sorted((*k, ts.replace(tzinfo=None)) for k, (ts, status) in latest.items() if status == "RUNNING" and k not in done)
    assert want and found == want
    # a shard holds two rows at most, its jobs and its timer, however many jobs there are
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held and max(held) <= 4 * 3
