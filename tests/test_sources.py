"""Reading files."""

from brightwater.plans.scratch import scratch_path, scratch_root
from brightwater.sources import readers


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\nworld " + "x" * 20_000)
    (tmp_path / "b.TXT").write_text(" \n ")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    accepted, rejected = readers.read_text_documents(spark, str(tmp_path), ["u1", "u2"])
    rows = accepted.collect()
    assert [(r.name, len(r.text), r.permissions) for r in rows] == [("a.txt", 20_012, ["u1", "u2"])]
    assert {r.name: r.reason for r in rejected.collect()} == {
        "b.TXT": 'Document "b.TXT" contains no extractable text.',
        "c.pdf": "Unsupported format: pdf. Use TXT.",
    }
    checked = readers.ingest_documents(accepted)
    assert [len(r.content) for r in readers.document_rows(checked).collect()] == [10_000]


def test_scratch_follows_the_session(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_path(spark, "x").startswith(scratch_root(spark))
