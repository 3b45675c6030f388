import io
import json
import random
import time
import zipfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vitaeloom.operators import jobs
from vitaeloom.sources import dimensions, files, handoff
from vitaeloom.streaming import limiter
from vitaeloom.streaming import terms as stream_terms

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def brute(hits, limit, window):
    kept, out = [], []
    for t in hits:
        kept = [x for x in kept if x > t - window]
        ok = len(kept) < limit
        if ok:
            kept.append(t)
        out.append(ok)
    return out


def test_denied_hits_do_not_count(spark):
    rows = [("k", i, at(t)) for i, t in enumerate((0, 30, 40, 61))] + [(None, 9, at(0)), ("k", 8, None)]
    df = spark.createDataFrame(rows, "key string, request_id int, ts timestamp")
    got = {(r["key"], r["request_id"]): r["allowed"] for r in limiter.decide(df, 2, 60.0).collect()}
    assert got == {("k", 0): True, ("k", 1): True, ("k", 2): False, ("k", 3): True, ("unknown", 9): True}


def test_waits(spark):
    same = spark.createDataFrame([("k", i, at(0)) for i in range(4)], "key string, request_id int, ts timestamp")
    assert [(r["allowed"], r["retry_after"]) for r in limiter.decide(same, 3, 60.0).orderBy("request_id").collect()] == [(True, 0)] * 3 + [(False, 60)]
    late = spark.createDataFrame([("k", 0, at(0)), ("k", 1, at(45.2))], "key string, request_id int, ts timestamp")
    assert limiter.decide(late, 1, 60.0).orderBy("request_id").collect()[1]["retry_after"] == 15


def test_batch_equals_brute_force_with_a_hot_key(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 9)}", i, at(rng.randint(0, 2000))) for i in range(3000)]
    got = {r["request_id"]: r["allowed"] for r in limiter.decide(spark.createDataFrame(rows, "key string, request_id int, ts timestamp"), 3, 60.0).collect()}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        assert [got[r[1]] for r in own] == brute([(r[2] - START).total_seconds() for r in own], 3, 60.0)


def test_client_key(spark):
    df = spark.createDataFrame([("1.1.1.1, 2.2.2.2", "p"), (" ", "p"), (None, None)], "h string, p string")
    assert [r["k"] for r in df.select(limiter.client_key(F.col("h"), F.col("p")).alias("k")).collect()] == ["1.1.1.1", "p", "unknown"]


def test_stream_of_requests(spark, tmp_path):
    rows = spark.createDataFrame([("k", i, at(t)) for i, t in enumerate((0, 30, 40, 61))], "key string, request_id int, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = limiter.decide_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 2, 60.0)
    q = stream.writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "c")).start()
    # With processing-time state the query goes on after the data, so it is stopped once they are through.
    until = time.time() + 90
    while spark.table("decided").count() < 4 and q.isActive and time.time() < until:
        time.sleep(0.5)
    q.stop()
    assert [r["allowed"] for r in spark.table("decided").orderBy("request_id").collect()] == [True, True, False, True]


def test_stream_of_terms(spark, tmp_path):
    schema = "submission_id int, term string"
    spark.createDataFrame([(1, "dbt"), (1, "dbt"), (2, "dbt"), (2, None), (2, "kafka")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    stream_terms.merge_counts(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert {r["term"]: r["count"] for r in spark.read.parquet(str(tmp_path / "out" / "v=0")).collect()} == {"dbt": 2, "kafka": 1}


def job(i, status, days, when=0):
    return (i, status, START - timedelta(days=days), START - timedelta(days=days))


def test_retention(spark):
    rows = [job("a", "done", 31), job("b", "failed", 45), job("c", "done", 29), job("d", "running", 40), job("e", "queued", 40), job("f", "awaiting_payment", 7), job("g", "awaiting_payment", 8), job("a", "queued", 60), ("h", None, None, None)]
    df = jobs.current_jobs(spark.createDataFrame(rows, "id string, status string, created_at timestamp, updated_at timestamp"))
    assert sorted(r["id"] for r in jobs.purge(df, F.lit(START)).collect()) == ["c", "d", "e", "f", "h"]
    assert {r["status"]: r["rows"] for r in jobs.purge(df, F.lit(START), dry_run=True).collect()} == {"done": 1, "failed": 1, "awaiting_payment": 1}


def test_unpack(spark):
    payload = {"resume": {"skills": [{"raw_text": "SQL", "matched_clusters": ["sql"]}], "work": [{"bullets": [{"raw_text": "did", "matched_clusters": []}]}]}, "jd": {"requirements": [{"raw_text": "SQL", "requirement_type": "required", "matched_clusters": []}]}}
    df = jobs.unpack_inputs(spark.createDataFrame([("a", json.dumps(payload)), ("b", "no json"), ("c", None)], "id string, input_json string"))
    assert {(r["id"], r["source"], r["raw_text"]) for r in jobs.job_lines(df).collect()} == {("a", "skill", "SQL"), ("a", "work", "did")}
    assert jobs.job_requirements(df).count() == 1


def docx(body, header=None):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {ns}><w:p><w:r><w:t>{header}</w:t></w:r></w:p></w:hdr>")
    return out.getvalue()


def test_files(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in ("Skills", "SQL", "Go")) + "</w:tr></w:tbl>"
    (tmp_path / "a.docx").write_bytes(docx(p("Hello") + table + '<w:sectPr><w:cols w:num="2"/></w:sectPr>', "me@site.example"))
    (tmp_path / "b.txt").write_bytes("café".encode() + b"\xff")
    (tmp_path / "c.txt").write_bytes(b"%PDF-1.7 ...")
    (tmp_path / "d.bin").write_bytes(b"x")
    (tmp_path / "e.docx").write_bytes(b"broken")
    good, bad = files.split_accepted(files.read_files(spark, str(tmp_path)))
    assert {r["path"].rpartition("/")[2]: r["file_format"] for r in good.collect()} == {"a.docx": "docx", "b.txt": "text", "c.txt": "pdf", "e.docx": "docx"}
    assert [r["reason"] for r in bad.collect()] == ["unsupported"]
    assert files.read_text(good).first()["text"] == "café�"
    parts = {r["doc_id"].rpartition("/")[2]: r for r in files.read_docx(good).collect()}
    assert parts["a.docx"]["text"] == "me@site.example\nHello\nSkills: SQL, Go" and parts["a.docx"]["n_tables"] == 1 and parts["a.docx"]["n_columns"] == 2
    assert parts["e.docx"]["error"] == "BadZipFile"
    from vitaeloom.operators.checks import check_docx

    failed = {r["check_name"] for r in check_docx(files.read_docx(good)).where("status = 'fail' and doc_id like '%a.docx'").collect()}
    assert failed == {"multi_column_layout", "table_detected", "header_footer_content"}


def test_docx_rows_and_margins():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
    body = p("SKILLS") + "<w:tbl>" + row("Skills:", "Python") + row("", "Acme", "2020") + row("Tools", "Git", "", "Make") + "</w:tbl>" + "<w:p><w:r><w:txbxContent>" + p("Box text") + "</w:txbxContent></w:r></w:p>"
    parts = files.docx_parts(docx(body, "Page 1"))
    assert parts["text"] == "Box text\nSKILLS\nSkills:\nPython\nAcme\n2020\nTools: Git, Make\n" and parts["margin_text"] == ""
    assert parts["table_notes"] == ["3x4 table after 'SKILLS'"] and parts["box_texts"] == ["Box text"]
    assert files.docx_parts(docx(p("x"), "A header of many words here"))["margin_zone"] == "header (section 1)"


def test_submissions(spark):
    rows = [("x" * 100, "y" * 200, 1), ("x", "y" * 200, 1), ("x" * 100, None, 1), ("x" * 100, "y", 1), ("x" * 100, "y" * 200, 10**8)]
    df = files.check_submissions(spark.createDataFrame(rows, "posting_text string, resume_text string, n_bytes bigint"))
    assert [r["reason"] for r in df.collect()] == [None, "posting_too_short", "resume_missing", "resume_too_short", "too_large"]
    assert [r["x"] for r in spark.createDataFrame([(" Lever ",), ("other",), (None,)], "p string").select(files.lenient(F.col("p"), files.PLATFORMS).alias("x")).collect()] == ["lever", None, None]


def test_tokens(spark):
    df = spark.createDataFrame([('{"a": "é"}',), (None,)], "j string").select("j", handoff.encode(F.col("j")).alias("t"))
    back = df.select("j", handoff.decode(F.col("t")).alias("same"), handoff.decode(F.concat(F.lit("A"), "t")).alias("broken")).collect()
    assert back[0]["same"] == back[0]["j"] and back[0]["broken"] is None and back[1]["same"] is None


def test_dimensions(spark):
    clusters = spark.createDataFrame([("sql", "SQL", "data"), ("Bad", "x", "none"), ("sql", "again", "data")], "cluster_id string, canonical_name string, category string")
    forms = spark.createDataFrame([("sql", 0, "SQL"), ("sql", 1, "structured query"), ("ghost", 0, "boo")], "cluster_id string, form_idx int, form string")
    weights = spark.createDataFrame([("data", "mle", 0.5), ("data", "ds", 0.9)], "category string, track string, weight double")
    own = spark.createDataFrame([("sql", "mle", 1.0)], "cluster_id string, track string, weight double")
    bad = {(r["kind"], r["key"]) for r in dimensions.taxonomy_violations(clusters, forms, weights).collect()}
    assert bad == {("bad_id", "Bad"), ("repeated_id", "sql"), ("few_forms", "Bad"), ("unknown_cluster", "ghost"), ("unknown_category", "Bad")}
    one = clusters.where("canonical_name = 'SQL'")
    assert {(r["track"], r["weight"]) for r in dimensions.track_weights(one, weights, own).collect()} == {("mle", 1.0), ("ds", 0.9)}
    bullets = spark.createDataFrame([("sql", "b", 1, "data"), ("sql", "a", 0, "data")], "cluster_id string, text string, line_no int, category string")
    notes = spark.createDataFrame([("Two words!", "t", "lever")], "title string, text string, platform string")
    chunks = dimensions.corpus(dimensions.equivalence_chunks(one, forms), dimensions.bullet_chunks(bullets), dimensions.note_chunks(notes, "platform_quirk"), dimensions.note_chunks(notes, "guidance"))
    assert {r["chunk_id"] for r in chunks.collect()} == {"equiv:sql", "bullet:sql:1", "bullet:sql:2", "platform:lever:1", "guidance:two_words"}
    assert dimensions.corpus_violations(chunks, one).count() == 0 and dimensions.corpus_violations(chunks.union(chunks), one.limit(0)).count() > 0


def test_labelled_queries(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"query": "a", "expect": {"kind": "x"}}, {"query": "b", "expect": {"chunk_id": "c"}}]))
    rows = dimensions.read_labelled(spark, str(tmp_path / "e.json")).collect()
    assert rows[0]["expect"]["kind"] == "x" and rows[1]["expect"]["kind"] is None
