import base64
import hashlib
import json

from pyspark.sql import functions as F

from matchloom.sources import intake


def test_uploads(spark):
    good = base64.b64encode(b"hello").decode()
    rows = [("t", "jd", good, "md", {"kind": "cv", "a": "b"}), ("", "jd", good, None, None), ("t", "jd", "", None, None), ("t", "jd", "***", None, None), ("t", "resume", good, None, None)]
    df = spark.createDataFrame(rows, "tenantId string, kind string, content_b64 string, extension string, metadata map<string,string>")
    documents, rejects = intake.ingest_uploads(df)
    digest = hashlib.sha256(b"hello").hexdigest()
    assert {r.key for r in documents.collect()} == {f"t/jd/{digest}.md", f"t/resume/{digest}.txt"}
    assert sorted(r.reason for r in rejects.collect()) == ["content is not base64", "content is required", "tenantId is required"]
    meta = {r.tenantJobId: json.loads(r.metadata) for r in intake.upload_metadata(documents, F.lit(1)).collect()}
    assert meta[f"t#t/jd/{digest}.md"] == {"kind": "cv", "a": "b"} and meta[f"t#t/resume/{digest}.txt"] == {"kind": "resume"}


def test_documents_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("t", "jd", base64.b64encode(b"x").decode())], "tenantId string, kind string, content_b64 string")
    documents, _ = intake.ingest_uploads(df)
    intake.write_documents(documents, str(tmp_path / "docs"))
    assert spark.read.parquet(str(tmp_path / "docs")).where("tenantId = 't'").count() == 1


def test_requests(spark):
    pointer = "struct<s3Key:string,text:string,metadata:map<string,string>,documentType:string>"
    schema = (
        "tenantId string, jobId string, jobDescriptionKey string, baseResumeKey string, styleGuideKey string, "
        f"styleGuideMetadata map<string,string>, styleGuideDocumentType string, styleGuide {pointer}, "
        f"executionInput struct<jobId:string,jobDescription:{pointer},baseResume:{pointer}>"
    )
    inline = (None, "text", None, None)
    rows = [
        ("t", "j1", "jd", "cv", "style", {"fontFamily": "Arial"}, "plain-text", None, None),
        ("t", "", "jd", "cv", None, None, None, ("own", None, None, None), None),
        ("t", "j3", None, None, None, None, None, None, ("jx", inline, inline)),
        ("t", "j4", "jd", None, None, None, None, None, None),
        (None, "j5", "jd", "cv", None, None, None, None, None),
    ]
    good, bad = intake.normalise_requests(spark.createDataFrame(rows, schema))
    got = {r.jobId: r for r in good.collect()}
    assert len(got) == 3 and got["j1"].styleGuide.s3Key == "style" and got["j1"].styleGuide.metadata == {"fontFamily": "Arial"}
    assert got["j1"].styleGuide.documentType == "plain-text" and got["jx"].jobDescription.text == "text"
    (generated,) = set(got) - {"j1", "jx"}
    assert len(generated) == 36 and got[generated].styleGuide.s3Key == "own"
    assert bad.count() == 2


def test_required_fields(spark):
    df = spark.createDataFrame([("t", None, "jd", None)], "tenantId string, jobId string, jobDescription string, baseResume string")
    good, bad = intake.validate_requests(df)
    assert good.count() == 0 and bad.first().missing == ["jobId", "baseResume"]


def test_resolve(spark):
    pointers = spark.createDataFrame(
        [(1, ("k1", "")), (2, ("k1", "inline")), (3, ("gone", None)), (4, (None, None))], "id int, pointer struct<s3Key:string,text:string>"
    )
    objects = spark.createDataFrame([("k1", bytearray("é".encode()))], "key string, content binary")
    found, rejects = intake.resolve_documents(pointers, objects)
    assert {(r.id, r.text) for r in found.collect()} == {(1, "é"), (2, "inline")}
    assert {r.id: r.reason for r in rejects.collect()} == {3: "object not found", 4: "document pointer must include either text or s3Key"}


def test_request_documents(spark):
    p = "struct<s3Key:string>"
    df = spark.createDataFrame(
        [("t", "j", ("a",), ("b",), [("v0",), ("v1",)], None)],
        f"tenantId string, jobId string, jobDescription {p}, baseResume {p}, validatedResumes array<{p}>, styleGuide {p}",
    )
    got = {(r.role, r.idx, r.pointer.s3Key) for r in intake.request_documents(df).collect()}
    assert got == {("job", 0, "a"), ("base", 0, "b"), ("validated", 0, "v0"), ("validated", 1, "v1")}


def test_blocks_and_files(spark, tmp_path):
    blocks = spark.createDataFrame(
        [(1, 2, "LINE", "b"), (1, 1, "CELL", "a"), (1, 3, "PAGE", "x"), (1, 4, "LINE", "")], "doc_id int, seq int, blockType string, text string"
    )
    assert intake.assemble_blocks(blocks).first().text == "a\nb"
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("hi")
    (tmp_path / "t" / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "t" / "c.bin").write_bytes(b"\xff")
    objects, rejects = intake.read_text_objects(spark, str(tmp_path), "*.txt")
    assert [(r.key, r.reason) for r in rejects.collect()] == [("t/b.txt", "not UTF-8")]
    row = objects.first()
    assert row.key == "t/a.txt" and bytes(row.content) == b"hi"
