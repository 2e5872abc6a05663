"""Redacted copies: what is chosen, texts and office files without it, and the check that nothing of it is left."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import escape, unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import zips
from . import anonymize, risk

OFFICE = (".docx", ".pptx", ".xlsx")
#: Fixed value: audit entries that are kept.
AUDITS = 100
WORD, DRAWING = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def active(findings: DataFrame) -> DataFrame:
    """What a redaction takes out: findings that are neither warnings nor cleared."""
    return findings.where(~F.col("category").startswith("⚠") & (F.col("severity") != "grønn"))


def selected(findings: DataFrame) -> DataFrame:
    """(doc_id, ord, category, text, engine) of chosen findings, each category and text once, whatever their case."""
    key = F.lower(F.concat_ws("|", F.trim("category"), F.trim("text")))
    first = Window.partitionBy("doc_id", "_key").orderBy("ord")
    engine = F.when(F.col("category").startswith("🤖"), "ai").otherwise("rule")
    once = findings.where("trim(text) <> ''").withColumn("_key", key).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return once.select("doc_id", "ord", "category", "text", engine.alias("engine"))


def redacted_name(path: str | Column) -> Column:
    """The sibling that a redacted copy is written to; ``-redacted`` before the suffix."""
    col = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(col, r"(?s)^(.*?)(\.[^./]+)?$", "$1-redacted$2")


def redact(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, path, target, anonymized, n, error) of files (doc_id, path, text, error), by their active findings.

    A file that could not be read says so; one without active findings is copied as it is, with n 0.
    """
    chosen = active(findings)
    labels = anonymize.replacements(chosen)
    counts = labels.groupBy("doc_id").agg(F.count("*").alias("_n"))
    done = anonymize.anonymize(files.select("doc_id", "path", "text", "error"), labels).join(counts, "doc_id", "left")
    failed = F.coalesce("error", F.when(F.col("text").isNull(), "no text"))
    return done.select(
        "doc_id", "path", F.when(failed.isNull(), redacted_name("path")).alias("target"), F.when(failed.isNull(), F.col("anonymized")).alias("anonymized"),
        F.coalesce("_n", F.lit(0)).alias("n"), failed.alias("error"),
    )


def audit(anonymized: DataFrame, chosen: DataFrame, rescanned: DataFrame) -> DataFrame:
    """(doc_id, removed, not_found, remaining, risk_level, passed) of redacted texts.

    anonymized: (doc_id, text, anonymized); chosen: (doc_id, target); rescanned: findings of another scan, of the redacted
    texts. Passed: the copy is green and holds none of the chosen values.
    """
    status = anonymize.verify(anonymized, chosen).groupBy("doc_id").pivot("status", ["removed", "not_found", "remaining"]).count().na.fill(0)
    levels = risk.assess(anonymized.select("doc_id"), rescanned).select("doc_id", "risk_level")
    told = levels.join(status, "doc_id", "left").na.fill(0, ["removed", "not_found", "remaining"])
    passed = (F.col("risk_level") == "grønn") & (F.col("remaining") == 0)
    return told.select("doc_id", "removed", "not_found", "remaining", "risk_level", passed.alias("passed"))


def audit_log(entries: DataFrame, details: bool = True, n: int = AUDITS) -> DataFrame:
    """The last n audit entries by time; without ``details`` they do not tell the values."""
    last = entries.orderBy(F.desc("timestamp")).limit(n)
    return last if details else last.drop("target", "text", "context")


def audit_summary(entries: DataFrame) -> DataFrame:
    """One row: copies, those that passed, and values by what became of them."""
    return entries.agg(
        F.count("*").alias("n_copies"), F.count_if("passed").alias("n_passed"),
        *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("removed", "not_found", "remaining")),
    )


def _put(text: str, pairs: list[tuple[str, str]]) -> str:
    """Replace values by labels, the longest first; values of digits only between what are none."""
    if not any(old in text for old, _ in pairs):
        return text
    tokens = []
    for k, (old, new) in enumerate(sorted(pairs, key=lambda p: -len(p[0]))):
        token = f"{k}".translate({48 + d: 0xE010 + d for d in range(10)})
        text = re.sub(rf"(?<!\d){old}(?!\d)", token, text) if old.isdigit() and old.isascii() else text.replace(old, token)
        tokens.append((token, new))
    for token, new in tokens:
        text = text.replace(token, new)
    return text


def _runs(root: ElementTree.Element, paragraph: str, run: str, pairs: list[tuple[str, str]]) -> bool:
    """Replace in paragraphs, whose runs are joined where a value lies across them; whether anything has changed."""
    changed = False
    for p in root.iter(paragraph):
        nodes = list(p.iter(run))
        before = "".join(t.text or "" for t in nodes)
        after = _put(before, pairs)
        if after != before:
            changed = True
            for k, t in enumerate(nodes):
                t.text = after if k == 0 else ""
    return changed


#: Of a tag's end: attributes, whose values may hold an angle bracket.
REST = r"""(?:\s+[\w:.\-]+\s*=\s*(?:"[^"<]*"|'[^'<]*'))*\s*"""
QUOTES = {"&quot;": '"', "&apos;": "'"}
BOUND, ENCODING = re.compile(r"""xmlns(?::([\w.\-]+))?\s*=\s*["']([^"']*)["']"""), re.compile(r"""<\?xml[^>]*?encoding\s*=\s*["']([^"']+)""")
_TAGS: dict[tuple[str, tuple[str, ...]], tuple[re.Pattern, ...]] = {}


def _tags(name: str, owners: tuple[str, ...]) -> tuple[re.Pattern, ...]:
    """Patterns of runs of text, of their beginnings, and of the owners' tags, for a prefix."""
    if (name, owners) not in _TAGS:
        each = (rf"<{name}t{REST}(?:/>|>([^<]*)</{name}t\s*>)", rf"<{name}t(?=[\s/>])", *(rf"<(/?){name}{o}{REST}(/?)>" for o in owners))
        _TAGS[name, owners] = tuple(map(re.compile, each))
    return _TAGS[name, owners]


def spliced(content: bytes, space: str, owners: tuple[str, ...], pairs: list[tuple[str, str]]) -> bytes | None:
    """A part with values replaced where its runs stand, all else byte for byte; None for what only a tree can tell.

    That is a part in another encoding, with comments, a document type, references by number or carriage returns, with
    several prefixes for ``space``, or not well-formed.
    """
    try:
        text = content.decode("utf-8")
        expat.ParserCreate(namespace_separator=" ").Parse(content, True)
    except (UnicodeDecodeError, expat.ExpatError):
        return None
    said = ENCODING.match(text)
    if text[:1] != "<" or "<!" in text or "&#" in text or "\r" in text or text.find("<?", 1) >= 0 or said and said[1].lower() not in ("utf-8", "us-ascii"):
        return None
    bound = set(BOUND.findall(text))
    prefixes = {p for p, uri in bound if uri == space}
    if not prefixes:
        return content
    prefix = prefixes.pop()
    if prefixes or any(p == prefix and uri != space for p, uri in bound):
        return None
    name = re.escape(f"{prefix}:" if prefix else "")
    whole, begins, *tags = _tags(name, owners)
    runs = list(whole.finditer(text))
    if len(runs) != len(begins.findall(text)):
        return None
    before = [r[1] or "" for r in runs]
    if "&" in text:
        before = [unescape(x, QUOTES) for x in before]
    joined = "".join(before)
    if not any(old in joined for old, _ in pairs):
        return content
    now, starts = list(before), [r.start() for r in runs]
    for tag in tags:
        spans, opened = [], []
        for m in tag.finditer(text):
            if m[1]:
                spans.append((opened.pop(), m.start()))
            elif not m[2]:
                opened.append(m.start())
        for start, end in sorted(spans):
            low, high = bisect_left(starts, start), bisect_left(starts, end)
            if low == high:
                continue
            own = "".join(now[low:high])
            after = _put(own, pairs)
            if after != own:
                now[low:high] = [after, *[""] * (high - low - 1)]
    out, at = [], 0
    for run, old, new in zip(runs, before, now, strict=True):
        if old != new:
            alone = run[1] is None
            out += [text[at : run.end() - 2 if alone else run.start(1)], ">" if alone else "", escape(new), f"</{prefix}:t>" if alone and prefix else "</t>" if alone else ""]
            at = run.end() if alone else run.end(1)
    return "".join([*out, text[at:]]).encode()


def _treed(content: bytes, space: str, owners: tuple[str, ...], pairs: list[tuple[str, str]]) -> bytes:
    """``spliced`` for any part, which is written anew."""
    root = ElementTree.fromstring(content)
    if not any([_runs(root, f"{{{space}}}{o}", f"{{{space}}}t", pairs) for o in owners]):
        return content
    # As one string; to write bytes it would encode each tag by itself.
    return ("<?xml version='1.0' encoding='utf-8'?>\n" + ElementTree.tostring(root, encoding="unicode")).encode("utf-8", "xmlcharrefreplace")


PARTS = {
    ".docx": (re.compile(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml"), WORD[1:-1], ("p",)),
    ".pptx": (re.compile(r"ppt/(slides|notesSlides)/[^/]+\.xml"), DRAWING[1:-1], ("p",)),
    ".xlsx": (re.compile(r"xl/(sharedStrings|worksheets/sheet\d+)\.xml"), SHEET[1:-1], ("si", "is")),
}


def patched(suffix: str, data: bytes, pairs: list[tuple[str, str]]) -> bytes:
    """An office file with values replaced in its texts; all else as it was, other members as they were packed."""
    pattern, space, owners = PARTS[suffix]
    members = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for info in archive.infolist():
            held = zips.packed(archive, data, info)
            if held is not None and not pattern.fullmatch(info.filename):
                members.append((info, held, info.CRC, info.file_size))
                continue
            old = zips.read(archive, data, info)
            new = old
            if pattern.fullmatch(info.filename) and (new := spliced(old, space, owners, pairs)) is None:
                new = _treed(old, space, owners, pairs)
            if held is None:
                info.compress_type, info.flag_bits = zipfile.ZIP_DEFLATED, info.flag_bits & 0x800
            if held is None or new is not old:
                pack = zlib.compressobj(wbits=-15) if info.compress_type else None
                held = pack.compress(new) + pack.flush() if pack else new
            members.append((info, held, zlib.crc32(new) if new is not old else info.CRC, len(new)))
    return zips.write(members)


def patch_files(files: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, path, content, error): office files (doc_id, path, content) with the values of ``labels`` replaced."""
    pairs = labels.groupBy("doc_id").agg(F.collect_list(F.struct("target", "label")).alias("pairs"))
    return patch(files.select("doc_id", "path", "content").join(pairs, "doc_id", "left"))


def patch(files: DataFrame) -> DataFrame:
    """``patch_files`` of files (doc_id, path, content, pairs) that know their labels (target, label), so none is shuffled."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    joined = files.select("doc_id", "path", suffix.alias("suffix"), "content", "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for suffix, data, pairs in zip(*(batch.column(c).to_pylist() for c in ("suffix", "content", "pairs")), strict=True):
                try:
                    known = suffix in OFFICE
                    rows.append((patched(suffix, data, [(p["target"], p["label"]) for p in pairs or []]) if known else None, None if known else f"unsupported: {suffix}"))
                except Exception as error:  # a broken file is a row that says so
                    rows.append((None, f"{type(error).__name__}: {error}"))
            content, error = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), pa.array(content, pa.binary()), pa.array(error, pa.string())], ["doc_id", "path", "content", "error"])

    kind = dict(files.dtypes)["doc_id"]
    return joined.mapInArrow(run, f"doc_id {kind}, path string, content binary, error string")
