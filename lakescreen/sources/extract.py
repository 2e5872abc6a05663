"""Text from files: one read of their bytes, native rules for plain formats, an Arrow pass for packed ones."""

from __future__ import annotations

import csv
import email
import email.policy
import html
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import folders, zips

# Suffixes, limits, excluded folders, headers.
SUFFIXES = (".pdf", ".docx", ".pptx", ".xlsx", ".md", ".txt", ".html", ".csv", ".eml", ".rtf", ".odt", ".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")
EXCLUDED = (
    ".git", ".hg", ".svn", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "venv", "__pycache__", "node_modules", "build", "dist", "Library", "AppData",
)
ZIP_FILES, ZIP_BYTES, ZIP_MEMBER = 1000, 250 << 20, 100 << 20
#: Members of archives that are handed on at once: so many, or so many bytes.
MOST_ROWS, MOST_HELD = 10_000, 16 << 20
HEADERS = ("From", "To", "Cc", "Bcc", "Subject", "Date", "Reply-To")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def decode(data: bytes) -> str:
    """The first of UTF-8, CP1252 and Latin-1 that reads the bytes."""
    for name in ("utf-8", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def table_lines(rows: list[list[str]]) -> str:
    """A table's rows that say anything, cells between bars, padded to equal length; a rule under the first of several."""
    rows = [row for row in rows if any(row)]
    wide = max(map(len, rows), default=0)
    lines = [" | ".join([*row, *[""] * (wide - len(row))]) for row in rows]
    return "\n".join([*lines[:1], *[" | ".join(["---"] * wide)][: len(lines) - 1], *lines[1:]])


def from_csv(text: str) -> str:
    rows = (" | ".join(c for c in row if c.strip()) for row in csv.reader(text.splitlines()))
    return "\n".join(r for r in rows if r)


def from_eml(text: str) -> str:
    message = email.message_from_string(text, policy=email.policy.default)
    out = [f"{h}: {message[h]}" for h in HEADERS if message[h]]
    parts = [p for p in message.walk() if p.get_content_type() == "text/plain"] if message.is_multipart() else [message]
    for part in parts:
        try:
            out.append(str(part.get_content()))
        except (KeyError, LookupError, ValueError):
            continue
    return "\n".join(out)


class Archive:
    """The parts of an office file, by name."""

    def __init__(self, data: bytes):
        self.data, self.zip = data, zipfile.ZipFile(io.BytesIO(data))
        self.names = self.zip.NameToInfo

    def read(self, name: str) -> bytes:
        return zips.read(self.zip, self.data, self.zip.getinfo(name))


#: Bytes of a part, and parts, that a task remembers what it has read of.
MOST_KNOWN, KNOWN = 16 << 10, 512


class known:  # noqa: N801
    """``read`` of a part, which is not read again where another file holds the same part: layouts, relations, notes."""

    def __init__(self, read: Callable[[bytes], object]):
        self.read, self.kept = read, {}

    def __reduce__(self):
        return known, (self.read,)  # tasks begin without what others remember

    def __call__(self, part: bytes):
        if len(part) > MOST_KNOWN:
            return self.read(part)
        if part not in self.kept:
            if len(self.kept) >= KNOWN:
                self.kept.clear()
            self.kept[part] = self.read(part)
        return self.kept[part]


@known
def _relations(part: bytes) -> list[tuple[str | None, str, str]]:
    """(id, kind, target) of what a part refers to."""
    return [(e.get("Id"), e.get("Type", "").rpartition("/")[2], e.get("Target", "")) for e in ElementTree.fromstring(part)]


def _related(archive: Archive, part: str) -> dict[str, tuple[str, str]]:
    """(kind, name) of the parts that a part refers to, by id."""
    folder, _, name = part.rpartition("/")
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in archive.names:
        return {}
    full = lambda to: to.lstrip("/") if to.startswith("/") else posixpath.normpath(f"{folder}/{to}")
    return {key: (kind, full(to)) for key, kind, to in _relations(archive.read(rels))}


@known
def _listed(part: bytes) -> list[tuple[str | None, str | None]]:
    """(title, id) of the slides or sheets that a part lists."""
    return [(e.get("name"), e.get(f"{R}id")) for e in ElementTree.fromstring(part).iter() if e.tag in (f"{P}sldId", f"{S}sheet")]


def _in_order(archive: Archive, part: str) -> list[tuple[str | None, str]]:
    """(title, name) of the slides or sheets that a part lists, in its order."""
    parts = _related(archive, part)
    listed = [(title, parts.get(key, ("", ""))[1]) for title, key in _listed(archive.read(part))]
    return [(title, name) for title, name in listed if name in archive.names]


#: Marks in runs of text that stand for characters.
MARKS = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-", f"{A}br": "\v"}


def _paragraphs(e: ElementTree.Element, space: str) -> list[str]:
    """Texts of the paragraphs in ``e``, itself included."""
    said = lambda x: x.text or "" if x.tag == f"{space}t" else MARKS.get(x.tag, "")
    return ["".join(map(said, p.iter())) for p in e.iter(f"{space}p")]


def from_docx(archive: Archive) -> str:
    return _docx(archive.read("word/document.xml"))


@known
def _docx(part: bytes) -> str:
    """Paragraphs and tables in the order of the body."""
    out = []
    for e in ElementTree.fromstring(part).find(f"{W}body"):
        if e.tag == f"{W}p":
            out += _paragraphs(e, W)[:1]
        elif e.tag == f"{W}tbl":
            out.append(table_lines(_docx_rows(e)))
    return "\n".join(x for x in out if x)


def _docx_rows(table: ElementTree.Element) -> list[list[str]]:
    """A table's cells; one that goes on from the row above says what that one says."""
    rows, above = [], {}
    for tr in table.findall(f"{W}tr"):
        row, at = [], 0
        for tc in tr.findall(f"{W}tc"):
            how = tc.find(f"{W}tcPr")
            span, merge = (how.find(f"{W}{n}") if how is not None else None for n in ("gridSpan", "vMerge"))
            goes_on = merge is not None and merge.get(f"{W}val", "continue") == "continue"
            text = above.get(at, "") if goes_on else "\n".join(_paragraphs(tc, W)).strip()
            row.append(text)
            above[at] = text
            at += int(span.get(f"{W}val", "1")) if span is not None else 1
        rows.append(row)
    return rows


def from_pptx(archive: Archive) -> str:
    """Slides in their order: texts of shapes, tables, and then the notes."""
    out = []
    for _, name in _in_order(archive, "ppt/presentation.xml"):
        out += _slide(archive.read(name))
        for kind, notes in _related(archive, name).values():
            if kind == "notesSlide":
                out += _notes(archive.read(notes))
    return "\n".join(x for x in out if x)


@known
def _slide(part: bytes) -> list[str]:
    out = []
    for shape in ElementTree.fromstring(part).find(f"{P}cSld/{P}spTree"):
        if (said := shape.find(f"{P}txBody")) is not None:
            out.append("\n".join(_paragraphs(said, A)))
        for table in shape.iter(f"{A}tbl") if shape.tag == f"{P}graphicFrame" else ():
            out.append(table_lines([["\n".join(_paragraphs(c, A)).strip() for c in row.findall(f"{A}tc")] for row in table.findall(f"{A}tr")]))
    return out


@known
def _notes(part: bytes) -> list[str]:
    bodies = (sp for sp in ElementTree.fromstring(part).iter(f"{P}sp") if any(ph.get("type") == "body" for ph in sp.iter(f"{P}ph")))
    return ["\n".join(_paragraphs(sp, A)) for sp in bodies]


def from_xlsx(archive: Archive) -> str:
    """Sheets in the workbook's order, under their titles."""
    shared = _shared(archive.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in archive.names else []
    out = []
    for title, name in _in_order(archive, "xl/workbook.xml"):
        out.append(f"[{title}]")
        for row in _sheet(archive.read(name)):
            cells = [shared[int(value)] if points and value else value for points, value in row]
            if kept := [c for c in cells if c.strip()]:
                out.append(" | ".join(kept))
    return "\n".join(out)


@known
def _shared(part: bytes) -> list[str]:
    return ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(part).iter(f"{S}si")]


@known
def _sheet(part: bytes) -> list[list[tuple[bool, str]]]:
    """Rows of cells: whether a cell points at a shared text, and its value."""
    value = lambda c: "".join(t.text or "" for t in c.iter(f"{S}t")) if c.get("t") == "inlineStr" else (c.findtext(f"{S}v") or "")
    return [[(c.get("t") == "s", value(c)) for c in row.iter(f"{S}c")] for row in ElementTree.fromstring(part).iter(f"{S}row")]


def from_odt(archive: Archive) -> str:
    if "content.xml" not in archive.names:
        return ""
    said = (x.strip() for e in ElementTree.fromstring(archive.read("content.xml")).iter() for x in (e.text or "", e.tail or ""))
    return "\n".join(x for x in said if x)


PACKED = {".docx": from_docx, ".pptx": from_pptx, ".xlsx": from_xlsx, ".odt": from_odt}


#: From the bytes of a file: its text; and for PDF files, the number of images in it.
Provider = Callable[[bytes], str | tuple[str, int]]


def extract(suffix: str, data: bytes, providers: dict[str, Provider] | None = None) -> tuple[str | None, str | None, int]:
    """(text, error, images) of one file. Nothing is raised.

    providers: functions that read what needs a library: ``.pdf``, and ``image`` for all pictures. Without one a PDF file
    is an error, and a picture has no text.
    """
    own = (providers or {}).get("image" if suffix in IMAGES else suffix)
    try:
        if own is not None:
            told = own(data)
            text, images = told if isinstance(told, tuple) else (told, int(suffix in IMAGES))
            return (text or "").strip(), None, images
        if suffix in PACKED:
            return PACKED[suffix](Archive(data)).strip(), None, 0
        if suffix == ".pdf":
            return None, "no PDF provider", 0
        if suffix in IMAGES:
            return "", None, 1
        if suffix not in SUFFIXES:
            return None, f"unsupported: {suffix}", 0
        text = decode(data)
        if suffix == ".csv":
            text = from_csv(text)
        elif suffix == ".eml":
            text = from_eml(text)
        elif suffix == ".html":
            text = html.unescape(re.sub(r"(?s)<[^>]+>", " ", re.sub(r"(?is)<(script|style).*?>.*?</\1>", " ", text)))
            text = re.sub(r"\s+", " ", text)
        elif suffix == ".rtf" and text.lstrip().startswith("{\\rtf"):
            text = re.sub(r"\s+", " ", re.sub(r"(?i)\\(?:[a-z]+(?:-?\d+)? ?|'[0-9a-f]{2}|[^a-z\s])|[{}]", "", text))
        return text.strip(), None, 0
    except Exception as error:  # a broken file is a row that says so
        return None, f"{type(error).__name__}: {error}", 0


def suffix_of(path: str | Column) -> Column:
    col = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(col, r"(\.[^./]+)$", 1))


def texts(files: DataFrame, providers: dict[str, Provider] | None = None) -> DataFrame:
    """(path, text, error, image_based, warning_code) of files (path, content); those that have an error already (error) keep it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(*(batch.column(c).to_pylist() for c in ("suffix", "content", "before")), strict=True)
            rows = [extract(s, d or b"", providers) if before is None else (None, before, 0) for s, d, before in each]
            text, error, images = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(text, pa.string()), pa.array(error, pa.string()), pa.array(images, pa.int32())], ["path", "text", "error", "images"])

    before = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    told = files.select("path", suffix_of("path").alias("suffix"), "content", before.alias("before")).mapInArrow(run, "path string, text string, error string, images int")
    based = told.withColumn("image_based", image_based(F.col("images"), F.col("text")))
    return based.select("path", "text", "error", "image_based", text_warning(F.col("text"), F.col("image_based")).alias("warning_code"))


def meaningful(text: Column) -> Column:
    """A text without the marks that stand for pictures."""
    return F.trim(F.regexp_replace(text, "<!-- image -->", " "))


def image_based(images: Column, text: Column) -> Column:
    """Whether a file has pictures and hardly any text of its own."""
    return F.coalesce((images > 0) & (F.length(meaningful(F.coalesce(text, F.lit("")))) < 50), F.lit(False))


def text_warning(text: Column, scanned: Column | None = None) -> Column:
    """Whether no text or little was found, marks of pictures aside; files of pictures need more of it."""
    plain = meaningful(text)
    marked = text.contains("<!-- image -->") if scanned is None else scanned | text.contains("<!-- image -->")
    little = (F.length(plain) < 50) | marked & (F.length(plain) < 200)
    return F.when(text.isNull(), None).when(plain == "", "no_text_extracted").when(little, "little_text_extracted")


def friendly_error(error: Column) -> Column:
    """What a user is told of a file that could not be read."""
    xml = F.lower(error).rlike("xml|not well-formed|badzipfile|syntax")
    return F.when(error.isNull(), None).when(xml, "The file is damaged or not of the kind that its name says.").otherwise(error)


def html_text(raw: Column) -> Column:
    """Text of HTML by native rules alone; the five entities of XML are read, others stay."""
    out = raw
    for p in (r"(?is)<script.*?>.*?</script>", r"(?is)<style.*?>.*?</style>", r"(?s)<[^>]+>"):
        out = F.regexp_replace(out, p, " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def looks_tabular(text: Column) -> Column:
    """Whether the first 300 lines look like a table: columns, numbers, words of tables."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    some = F.slice(lines, 1, 300)
    bars = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    number = r"(?i)(?:\b\d{1,3}(?:[ .,\t]\d{3})+(?:[,.]\d{1,2})?\b|\b\d+[,.]\d{2}\b|\b\d+\s*(?:kr|nok|eur|usd|%|\$|€)\b)"
    word = r"(?i)\b(unit\s+price|quantity|qty|description|invoice|subtotal|total|vat|amount|table\s+\d+|kolonne|beløp|sum|mva|antall|enhetspris)\b"
    n = lambda cond: F.size(F.filter(some, cond))
    columns = n(lambda x: x.rlike(r"\S\s{2,}\S") | (bars(x, "\t") >= 2) | (bars(x, "|") >= 2))
    numbers, words = n(lambda x: F.regexp_count(x, F.lit(number)) >= 2), n(lambda x: x.rlike(word))
    return (F.size(lines) >= 3) & ((columns >= 4) | (columns >= 2) & ((numbers >= 2) | (words >= 2)) | (numbers >= 4) & (words >= 1))


def pdf_strategy(mode: Column, ocr: Column, fast: Column, layout: Column) -> Column:
    """(strategy, text) for a PDF whose fast and layout texts are known: fast suffices in auto mode if it has 50 characters and no tables."""
    plain = F.trim(F.regexp_replace(fast, "<!-- image -->", " "))
    enough = (F.length(plain) >= 50) & ~looks_tabular(fast)
    better = F.length(F.trim(layout)) > F.length(plain)
    advanced = F.struct(F.lit("advanced").alias("strategy"), layout.alias("text"))
    quick = F.struct(F.lit("fast").alias("strategy"), fast.alias("text"))
    return F.when(ocr | (mode == "advanced"), advanced).when((mode == "auto") & ~enough & better, advanced).otherwise(quick)


def folder_plan(spark: SparkSession, folder: str, recursive: bool = False, max_files: int = 500, max_depth: int = 5, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(path, relative_path, file_size, modified, truncated): supported files, cut to ``max_files`` in the order of a walk, then by path.

    A walk takes a folder's files before its sub-folders. Hidden and excluded folders, and links to folders, are left out.
    truncated: whether the cut left out a file. The folder is one that the driver and all tasks see.
    """
    most, deep = min(max(1, max_files), 10_000), min(max(0, max_depth), 50) if recursive else 0
    kept = folders.files(spark, re.sub("^file:/*", "/", folder), deep, most + 1, excluded, SUFFIXES)
    parts = F.split("relative_path", "/")
    # Folders sort after files at each level.
    walk = F.transform(parts, lambda p, k: F.concat(F.when(k == F.size(parts) - 1, F.lit("0")).otherwise("1"), F.lower(p)))
    first = kept.withColumn("_walk", walk).orderBy("_walk").limit(most + 1)  # one more tells whether any is left out
    placed = first.withColumn("_at", F.row_number().over(Window.orderBy("_walk"))).withColumn("truncated", F.max("_at").over(Window.partitionBy()) > most)
    return placed.where(F.col("_at") <= most).drop("_walk", "_at").orderBy(F.lower("relative_path"))


def plan_summary(plan: DataFrame, samples: int = 10) -> DataFrame:
    """One row for a ``folder_plan``: n_files, n_bytes, truncated, and the first paths."""
    first = F.slice(F.array_sort(F.collect_list(F.struct(F.lower("relative_path").alias("l"), "relative_path"))), 1, samples)
    size, cut = F.coalesce(F.sum("file_size"), F.lit(0)), F.coalesce(F.bool_or("truncated"), F.lit(False))
    return plan.limit(10_000).agg(F.count("*").alias("n_files"), size.alias("n_bytes"), F.transform(first, lambda x: x["relative_path"]).alias("samples"), cut.alias("truncated"))


#: From so many files or bytes on, a user is told that a scan will take long.
MANY_FILES, MANY_BYTES = 100, 50 << 20


def zip_summary(members: DataFrame) -> DataFrame:
    """One row an archive of ``zip_members``: n_files and n_bytes to scan, n_skipped, whether it is large, whether it could be read."""
    read = F.col("content").isNotNull()
    told = members.groupBy("zip").agg(
        F.count_if(read).alias("n_files"), F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("long").alias("n_bytes"),
        F.count_if(F.col("skipped").isNotNull()).alias("n_skipped"), F.bool_or(F.coalesce(F.col("skipped") == "not a zip", F.lit(False))).alias("unreadable"),
    )
    return told.withColumn("large", (F.col("n_files") >= MANY_FILES) | (F.col("n_bytes") >= MANY_BYTES))


def member_batches(rows: Iterator[tuple], most_rows: int = MOST_ROWS, most_held: int = MOST_HELD) -> Iterator[pa.RecordBatch]:
    """Members in batches of their own size: a batch for each archive would cost more than small archives do."""
    kinds = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string())
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], ["zip", "ord", "path", "content", "skipped"])

    for row in rows:
        held.append(row)
        size += len(row[3] or b"")
        if len(held) >= most_rows or size >= most_held:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def zip_members(files: DataFrame, max_files: int = ZIP_FILES, max_bytes: int = ZIP_BYTES, max_member: int = ZIP_MEMBER) -> DataFrame:
    """(zip, ord, path, content, skipped): members of archives (path, content); those over a limit, unsafe or unsupported say why."""

    def members(path: str, data: bytes) -> Iterator[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            yield path, 0, "", None, "not a zip"
            return
        total = 0
        for k, m in enumerate(m for m in archive.infolist() if not m.is_dir()):
            name = m.filename.replace("\\", "/").lstrip("/")
            why = None
            if k >= max_files:
                why = "too many files"
            elif m.file_size > max_member:
                why = "member too large"
            elif total + m.file_size > max_bytes:
                why = "archive too large"
            elif ".." in name.split("/"):
                why = "unsafe path"
            else:
                total += m.file_size
                if not name.lower().endswith(SUFFIXES):
                    why = "unsupported"
            yield path, k, name, None if why else archive.read(m), why

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for b in batches)
        return member_batches(row for batch in each for path, data in batch for row in members(path, data or b""))

    return files.select("path", "content").mapInArrow(run, "zip string, ord int, path string, content binary, skipped string")


def base64_upload(rows: DataFrame, most: int = 25 << 20) -> DataFrame:
    """Uploads (path, data) as bytes; too large or unreadable ones carry an error."""
    content = F.try_to_binary("data", F.lit("base64"))
    large = F.length(content) > most
    return rows.select("path", F.when(~large, content).alias("content"), F.when(content.isNull(), "not base64").when(large, "too large").alias("error"))
