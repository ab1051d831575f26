"""Uploads: archives expanded into documents, validated, and told apart by their content."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: What is read, by the first bytes that it must have, and names that are never documents.
MAGIC = {"pdf": b"%PDF", "docx": b"PK\x03\x04"}
JUNK_FOLDERS, JUNK_NAMES = ("__MACOSX/",), {".DS_Store", "Thumbs.db"}
_SCHEMA = "archive string, name string, content binary, reason string"


def _free_name(base: str, folders: list[str], taken: set[str]) -> str:
    """A name that isn't taken: behind its folder's name, or else numbered from 2."""
    if base not in taken:
        return base
    apart = f"{folders[-1].strip()} - {base}" if folders and folders[-1].strip() else base
    if apart not in taken:
        return apart
    stem, dot, kind = base.rpartition(".")
    n = 2
    while (name := f"{stem or base} ({n}){'.' + kind if dot and kind else ''}") in taken:
        n += 1
    return name


def _members(path: str, content: bytes, most: int, most_bytes: int) -> Iterator[tuple]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content or b""))
    except (zipfile.BadZipFile, OSError):
        yield path, None, None, "unreadable"
        return
    with archive:
        entries = [e for e in archive.infolist() if not e.is_dir()]
        # the declared sizes are read before anything is unpacked
        if len(entries) > most or sum(e.file_size for e in entries) > most_bytes:
            yield path, None, None, "too_many_members" if len(entries) > most else "too_large"
            return
        if not any(e.flag_bits & 1 for e in entries) and archive.testzip() is not None:
            yield path, None, None, "corrupt"
            return
        taken: set[str] = set()
        for entry in entries:
            *folders, base = entry.filename.replace("\\", "/").strip("/").split("/")
            if entry.filename.startswith(JUNK_FOLDERS) or base in JUNK_NAMES or base.startswith("._") or not base:
                continue
            name = _free_name(base, folders, taken)
            kind = name.rpartition(".")[2].lower() if "." in name else ""
            if kind not in MAGIC:
                yield path, name, None, "nested" if kind == "zip" else "unsupported"
                continue
            try:
                body = archive.read(entry)
            except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError):
                yield path, name, None, "unreadable"
                continue
            if not body:
                yield path, name, None, "empty"
                continue
            taken.add(name)  # a skipped file doesn't rename a later one
            yield path, name, body, None


def expand_archives(files: DataFrame, most: int = 500, most_bytes: int = 1 << 30) -> DataFrame:
    """(archive, name, content, reason) of the documents in ZIP files (path, content), as the binaryFile source reads them.

    reason says why an archive (name null) gives nothing: unreadable, too_many_members, too_large or
    corrupt (a checksum fails); or why a member doesn't: nested (an archive), unsupported, unreadable or
    empty. Junk is left out; a name that a kept member has already gets its folder's before it, or a
    number. A task holds one archive's member at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in _members(path, content, most, most_bytes):
                    types = (pa.string(), pa.string(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, types, strict=True)], ["archive", "name", "content", "reason"])

    return files.select("path", "content").mapInArrow(run, _SCHEMA)


def validate_uploads(uploads: DataFrame, known: DataFrame, most_bytes: int = 100 << 20) -> DataFrame:
    """uploads (project_id, name, content) with content_hash and status: empty, too_large, unsupported, mismatch, duplicate or accepted.

    A duplicate has the hash of a document that the project holds (known: project_id, content_hash), or of
    an accepted upload with a smaller name.
    """
    kind = F.lower(F.element_at(F.split("name", r"\."), -1))
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    begins = F.lit(False)
    for ext, magic in MAGIC.items():
        begins = begins | ((kind == ext) & F.coalesce(F.expr(f"startswith(content, X'{magic.hex()}')"), F.lit(False)))
    bad = F.when(size == 0, "empty").when(size > most_bytes, "too_large").when(~kind.isin(*MAGIC), "unsupported").when(~begins, "mismatch")
    rows = uploads.withColumn("content_hash", F.sha2("content", 256)).withColumn("_bad", bad)
    held = known.select("project_id", "content_hash").distinct().withColumn("_held", F.lit(True))
    w = Window.partitionBy("project_id", "content_hash").orderBy(F.col("_bad").isNotNull(), "name")
    again = F.col("_held").isNotNull() | (F.row_number().over(w) > 1)
    status = F.coalesce(F.col("_bad"), F.when(again, "duplicate").otherwise("accepted"))
    return rows.join(held, ["project_id", "content_hash"], "left").withColumn("status", status).select(*uploads.columns, "content_hash", "status")


def _opened(kind: str, content: bytes) -> str | None:
    if kind == "pdf":
        return "encrypted" if b"/Encrypt" in content else None if b"%%EOF" in content[-1024:] else "unreadable"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if any(m.flag_bits & 1 for m in z.infolist()):
                return "encrypted"
            return None if "word/document.xml" in z.namelist() and z.testzip() is None else "unreadable"
    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError):
        return "unreadable"


def check_stored(files: DataFrame, most_bytes: int = 100 << 20) -> DataFrame:
    """files (document, file_type, content, expected_hash) as (document, sha256, halt): why a stored document isn't processed, null if it is.

    hash_mismatch, empty, too_large, wrong_signature, encrypted or unreadable, the first that holds. Only files that pass
    the first four are opened: a Word file is a whole ZIP with its document part, a PDF has an end mark and no encryption
    entry. Pages of a PDF aren't counted, and viruses aren't looked for: both need tools from outside.
    """
    sha, size, kind = F.sha2("content", 256), F.coalesce(F.octet_length("content"), F.lit(0)), F.lower("file_type")
    begins = F.lit(False)
    for ext, magic in MAGIC.items():
        begins = begins | ((kind == ext) & F.expr(f"startswith(content, X'{magic.hex()}')"))
    halt = F.when(~F.coalesce(sha == F.lower("expected_hash"), F.lit(False)), "hash_mismatch").when(size == 0, "empty").when(size > most_bytes, "too_large").when(~F.coalesce(begins, F.lit(False)), "wrong_signature")
    rows = files.select("document", kind.alias("kind"), "content", sha.alias("sha256"), halt.alias("halt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_opened(k, c) for k, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(found, pa.string())], ["document", "sha256", "halt"])

    kept = [f for f in rows.schema.fields if f.name in ("document", "sha256")]
    opened = rows.where("halt IS NULL").mapInArrow(run, StructType([*kept, StructField("halt", StringType())]))
    return rows.where("halt IS NOT NULL").select("document", "sha256", "halt").unionByName(opened)
