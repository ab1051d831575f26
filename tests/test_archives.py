import io
import zipfile

from docuquarry.sources import archives


def packed(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members:
            z.writestr(name, body)
    return bytearray(out.getvalue())


def test_archives_give_documents_and_reasons(spark):
    good = packed([("a/x.pdf", b"%PDF1"), ("b/X.pdf", b"%PDF2"), ("__MACOSX/x.pdf", b"j"), ("._x.pdf", b"j"), ("inner.zip", b"z"), ("..\\..\\y.docx", b"PK\x03\x04")])
    rows = [("good", good), ("bad", bytearray(b"nothing")), ("empty", None), ("many", packed([(f"{i}.pdf", b"%PDF") for i in range(7)])), ("big", packed([("b.pdf", b"0" * 5000)]))]
    df = archives.expand_archives(spark.createDataFrame(rows, "path string, content binary"), most=6, most_bytes=4000)
    got = {(r["archive"], r["name"], bytes(r["content"]) if r["content"] is not None else None, r["reason"]) for r in df.collect()}
    assert got == {
        ("good", "x.pdf", b"%PDF1", None), ("good", "X.pdf", b"%PDF2", None), ("good", "inner.zip", None, "nested"), ("good", "y.docx", b"PK\x03\x04", None),
        ("bad", None, None, "unreadable"), ("empty", None, None, "unreadable"), ("many", None, None, "too_many_members"), ("big", None, None, "too_large"),
    }


def test_uploads_are_judged(spark):
    rows = [(1, "a.pdf", b"%PDF1"), (1, "b.pdf", b"%PDF1"), (2, "b.pdf", b"%PDF1"), (1, "c.pdf", b"oops"), (1, "d.txt", b"t"), (1, "e.pdf", None), (2, "f.PDF", b"%PDF9"), (1, "g.pdf", b"%PDF" + b"0" * 50)]
    up = spark.createDataFrame([(p, n, bytearray(c) if c is not None else None) for p, n, c in rows], "project_id int, name string, content binary")
    known = up.where("name = 'f.PDF'").selectExpr("project_id", "sha2(content, 256) AS content_hash")
    got = [r["status"] for r in archives.validate_uploads(up, known, 40).orderBy("name", "project_id").collect()]
    assert got == ["accepted", "duplicate", "accepted", "mismatch", "unsupported", "empty", "duplicate", "too_large"]


def test_names_are_taken_by_kept_members_only(spark):
    members = [("a/n.txt", b"t"), ("a/n.pdf", b""), ("b/n.pdf", b"%PDF1"), ("c/n.pdf", b"%PDF2"), ("c/n.pdf ", b"x"), ("d/e/c/n.pdf", b"%PDF3"), ("d/Thumbs.db", b"j"), (".hidden.pdf", b"%PDF4")]
    broken = packed([("ok.pdf", b"%PDF1"), ("bad.pdf", b"%PDF" + b"1" * 99)])
    at = bytes(broken).rindex(b"1" * 99)
    broken[at : at + 3] = b"222"
    df = archives.expand_archives(spark.createDataFrame([("kept", packed(members)), ("broken", broken)], "path string, content binary"))
    got = {(r["archive"], r["name"], bytes(r["content"]) if r["content"] is not None else None, r["reason"]) for r in df.collect()}
    assert got == {
        ("kept", "n.txt", None, "unsupported"), ("kept", "n.pdf", None, "empty"), ("kept", "n.pdf", b"%PDF1", None), ("kept", "c - n.pdf", b"%PDF2", None), ("kept", "n.pdf ", None, "unsupported"),
        ("kept", "n (2).pdf", b"%PDF3", None), ("kept", ".hidden.pdf", b"%PDF4", None), ("broken", None, None, "corrupt"),
    }


def test_stored_files_are_checked(spark):
    word = packed([("word/document.xml", b"<w/>")])
    broken = bytearray(word)
    broken[40] ^= 255
    files = {"ok.pdf": b"%PDF-1 x %%EOF", "cut.pdf": b"%PDF-1 x", "locked.pdf": b"%PDF-1 /Encrypt %%EOF", "ok.docx": word, "bare.docx": packed([("x.txt", b"x")]), "broken.docx": broken, "text.pdf": b"text", "empty.pdf": b"", "big.pdf": b"%PDF" + b"0" * 900, "odd.txt": b"x"}
    df = spark.createDataFrame([(n, n.rsplit(".", 1)[1], bytearray(c)) for n, c in files.items()] + [("none.pdf", None, None)], "document string, file_type string, content binary").selectExpr("*", "if(document = 'ok.docx', upper(sha2(content, 256)), sha2(content, 256)) AS expected_hash")
    more = df.where("document = 'ok.pdf'").selectExpr("'swapped.pdf' AS document", "file_type", "content", "'00' AS expected_hash")
    got = {r.document: r.halt for r in archives.check_stored(df.unionByName(more), 800).collect()}
    assert got == {
        "ok.pdf": None, "cut.pdf": "unreadable", "locked.pdf": "encrypted", "ok.docx": None, "bare.docx": "unreadable", "broken.docx": "unreadable", "text.pdf": "wrong_signature", "empty.pdf": "empty",
        "big.pdf": "too_large", "odd.txt": "wrong_signature", "none.pdf": "hash_mismatch", "swapped.pdf": "hash_mismatch",
    }
