"""Files are made, patched and read once; members of archives are handed on in batches of their own size."""

import io
import zipfile
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lakescreen import worked
from lakescreen.operators import redact
from lakescreen.sources import extract, zips


def test_files_that_have_an_error_keep_it(spark):
    files = spark.createDataFrame([("a.txt", b"said", None), ("b.txt", None, "gone"), ("c.odt", b"x", "unsupported: .odt")], "path string, content binary, error string")
    told = {r.path: (r.text, r.error, r.image_based, r.warning_code) for r in extract.texts(files).collect()}
    assert told == {"a.txt": ("said", None, False, "little_text_extracted"), "b.txt": (None, "gone", False, None), "c.odt": (None, "unsupported: .odt", False, None)}


def test_office_files_are_patched_once(spark, tmp_path):
    pq.write_table(pa.table({"o_orderkey": np.arange(8, dtype=np.int64)}), tmp_path / "orders.parquet")
    done = worked.patch_office(spark, str(tmp_path))
    assert done._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3  # made, patched, read
    rows = {r.doc_id: (r.text, r.error) for r in done.collect()}
    assert len(rows) == 8 and rows[3] == rows[7] == (None, "unsupported: .odt") and rows[2][0] == "[One]\n<Navn 1> | 12\n[Two]\n<Tall>"


def test_small_archives_share_a_batch_and_large_members_do_not():
    rows = [(f"{k}.zip", m, "a.txt", b"x" * (50 if k == 7 else 1), None) for k in range(10) for m in range(3)]
    batches = list(extract.member_batches(iter(rows), most_rows=12, most_held=100))
    assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == rows
    assert [b.num_rows for b in batches] == [12, 11, 7] and not list(extract.member_batches(iter(())))


def test_files_that_know_their_labels_are_not_shuffled(spark, tmp_path):
    pq.write_table(pa.table({"o_orderkey": np.arange(8, dtype=np.int64)}), tmp_path / "orders.parquet")
    assert "Join" not in worked.patch_office(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_parts_are_patched_in_place_as_by_a_tree():
    uri = redact.WORD[1:-1]
    pairs = [("Ola Nordmann", "<Navn 1>"), ("123", "<Tall>"), ("A&B", "<Firma>")]
    run = "<w:r><w:t{}>{}</w:t></w:r>".format
    bodies = [
        "<w:p>" + run("", "Ola Nord") + run(' xml:space="preserve"', "mann, 123") + "<w:r><w:t/></w:r></w:p><w:p/><w:p>" + run("", "1234 A&amp;B &lt;x&gt;") + "</w:p>",
        "<w:p>" + run("", "Ola ") + "<w:pict><w:p>" + run("", "123") + "</w:p></w:pict>" + run("", "Nordmann 9") + "</w:p>",
        "<w:p><w:r><w:t/></w:r>" + run(' w:x="a&gt;b>c"', "Ola Nordmann") + "<w:tab/><w:tbl/></w:p>", "<w:p>" + run("", "none of it") + "</w:p>", run("", "Ola Nordmann outside"),
    ]
    said = lambda part: ["".join(t.text or "" for t in p.iter(f"{redact.WORD}t")) for p in ElementTree.fromstring(part).iter(f"{redact.WORD}p")]
    for body in bodies:
        part = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{uri}" xmlns:w14="urn:w14" w14:Ignorable="w14"><w:body>{body}</w:body></w:document>'.encode()
        done = redact.spliced(part, uri, ("p",), pairs)
        assert done is not None and said(done) == said(redact._treed(part, uri, ("p",), pairs)) and b'xmlns:w14="urn:w14" w14:Ignorable' in done
    root = f'<w:p xmlns:w="{uri}">' + "{}</w:p>"
    for odd in ("<!-- <w:t>Ola Nordmann</w:t> -->", "<w:t>&#79;la Nordmann</w:t>", f'<v:t xmlns:v="{uri}">Ola Nordmann</v:t>', "<w:t>Ola<w:t>x</w:t></w:t>", "<w:t>Ola", '<w:t xmlns:w="urn:x">Ola Nordmann</w:t>'):
        assert redact.spliced(root.format(odd).encode(), uri, ("p",), pairs) is None
    assert redact.spliced(root.format("<w:t>Ola</w:t>").encode("utf-16"), uri, ("p",), pairs) is None


def test_archives_are_written_as_zipfile_reads_them():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:p xmlns:w="{redact.WORD[1:-1]}"><w:t>Ola Nordmann</w:t></w:p>')
        z.writestr("media/ø.png", bytes(range(256)) * 40)
        z.writestr(zipfile.ZipInfo("plain.bin", (1999, 12, 31, 23, 59, 58)), b"as it is")
        z.writestr("empty", b"")
        z.mkdir("folder")
    before, after = zipfile.ZipFile(out), zipfile.ZipFile(io.BytesIO(redact.patched(".docx", out.getvalue(), [("Ola Nordmann", "<Navn 1>")])))
    told = lambda z: [(m.filename, m.compress_type, m.date_time, m.external_attr) for m in z.infolist()]
    assert after.testzip() is None and told(after) == told(before)
    assert b"&lt;Navn 1&gt;" in after.read("word/document.xml") and all(after.read(n) == before.read(n) for n in before.namelist()[1:])
    broken = bytearray(out.getvalue())
    broken[broken.index(b"as it is")] ^= 1
    archive = zipfile.ZipFile(io.BytesIO(broken))
    with pytest.raises(zipfile.BadZipFile, match="CRC"):
        zips.read(archive, bytes(broken), archive.getinfo("plain.bin"))
