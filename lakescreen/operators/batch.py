"""Batches of files: ranking, summaries, export rows, history, access of folders, permissions, sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits and status texts.
TOP, HISTORY, MOST_ENTRIES = 8, 200, 30
ACCESS_STATUS = {"broad": "Bred tilgang", "shared_local": "Delt lokalt", "restricted": "Begrenset"}
SHARE_STATUS = {
    "public": "Offentlig lenke", "organization": "Hele organisasjonen", "group": "Delt med gruppe", "specific": "Bestemte personer",
    "restricted": "Begrenset", "not_checked": "Ikke kontrollert",
}
PUBLIC_IDENTITIES = ("everyone", "alle", "authenticated users", "godkjente brukere", "anonymous logon")
SHARED_IDENTITIES = ("domain users", "domenebrukere", "builtin\\users", "builtin\\brukere")
ACCESS_RIGHTS = ("F", "M", "RX", "R", "W", "D", "RD", "WD", "AD", "REA", "WEA", "RA", "WA", "DC", "DE", "RC", "WDAC", "WO", "GA", "GR", "GW", "GX")


def top_findings(findings: DataFrame, n: int = TOP) -> DataFrame:
    """(doc_id, findings_summary): the first n findings that are no warnings."""
    order = F.struct("det_ord", "sub_ord", "match_ord")
    shown = findings.where(~F.col("category").startswith("⚠"))
    # A rank keeps what each group collects to n rows.
    ranked = shown.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(order))).where(F.col("_n") <= n)
    cell = F.struct("_n", "category", "text", "severity", "context")
    return ranked.groupBy("doc_id").agg(F.array_sort(F.collect_list(cell)).alias("findings_summary"))


def is_redacted(name: str | Column) -> Column:
    """Whether a file's stem ends in ``-redacted``, numbered or not."""
    col = F.col(name) if isinstance(name, str) else name
    stem = F.regexp_replace(F.regexp_extract(col, r"([^/]*)$", 1), r"\.[^.]+$", "")
    return stem.rlike(r"(?i)-redacted(?:-[0-9]+)?$")


def rank(results: DataFrame) -> DataFrame:
    """Most severe first, then by path whatever its case."""
    return results.orderBy(F.desc("risk_ord"), F.lower("relative_path"))


def result_rows(results: DataFrame, findings: DataFrame) -> DataFrame:
    joined = results.join(top_findings(findings), "doc_id", "left")
    empty = F.array().cast("array<struct<_n:int,category:string,text:string,severity:string,context:string>>")
    return joined.withColumn("findings_summary", F.coalesce("findings_summary", empty)).withColumn("is_redacted", is_redacted("relative_path"))


def _mapped(value: Column, table: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[value], other)


def export_rows(rows: DataFrame) -> DataFrame:
    """Flat rows for a table, with texts for access levels. rows: ``result_rows`` with access and sharepoint structs."""
    access, share = F.col("access"), F.col("sharepoint")
    level, share_level = F.coalesce(access["access_level"], F.lit("")), F.coalesce(share["access_level"], F.lit(""))
    unknown = F.when(access.isNotNull() & ~F.coalesce(access["available"], F.lit(False)), "Ikke tilgjengelig").otherwise("Ikke kontrollert")
    names = lambda *of: F.array_join(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in of)), ", ")
    return rows.select(
        "relative_path", "risk_level", "scan_status", "finding_count", "text_length", F.coalesce("error", F.lit("")).alias("error"),
        level.alias("access_level"), _mapped(level, ACCESS_STATUS, unknown).alias("access_status"), names(access["broad_identities"]).alias("access_broad"),
        names(access["shared_identities"]).alias("access_shared"), share_level.alias("sharepoint_access_level"),
        _mapped(share_level, SHARE_STATUS, F.when(share.isNull(), "Ikke relevant").otherwise("Ukjent")).alias("sharepoint_access_status"),
        names(share["group_identities"], share["person_identities"]).alias("sharepoint_identities"),
        F.array_join(F.transform("findings_summary", lambda f: F.concat_ws(": ", f["category"], f["text"])), "; ").alias("top_findings"),
    )


def safe_cell(value: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


#: What a spreadsheet needs before the header to read a file as UTF-8.
MARK = "﻿"
CSV_COLUMNS = ("severity", "category", "engine", "confidence", "text", "context")


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV files with safe cells, each with a mark of UTF-8 and a header; quotes in cells are doubled."""
    first, *others = rows.columns
    cells = [safe_cell(F.col(first)).alias(f"{MARK}{first}"), *(safe_cell(F.col(c)).alias(c) for c in others)]
    rows.select(*cells).write.csv(path, header=True, encoding="UTF-8", mode="overwrite", escape='"', emptyValue="", lineSep="\n")


def csv_cell(value: Column) -> Column:
    """A cell that is quoted where it has to be."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def _in_order(findings: DataFrame, row: Column, name: str) -> DataFrame:
    """(doc_id, name): an array of ``row`` of each document's findings, in their order."""
    each = findings.select("doc_id", F.struct("det_ord", "sub_ord", "match_ord", row.alias("row")).alias("r"))
    return each.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"]).alias(name))


def findings_csv(results: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, csv): a document's findings as one CSV file, marked as UTF-8, with a header; only the header without any."""
    row = F.concat_ws(",", *(csv_cell(F.col(c)) for c in CSV_COLUMNS))
    joined = results.select("doc_id").join(_in_order(findings, row, "rows"), "doc_id", "left")
    lines = F.concat(F.array(F.lit(MARK + ",".join(CSV_COLUMNS))), F.coalesce("rows", F.array().cast("array<string>")), F.array(F.lit("")))
    return joined.select("doc_id", F.array_join(lines, "\r\n").alias("csv"))


def findings_json(results: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, json): a document's risk and findings as one JSON file; null fields are told as such."""
    row = F.struct(*(F.col(c) for c in CSV_COLUMNS))
    joined = results.join(_in_order(findings, row, "findings"), "doc_id", "left")
    kept = [c for c in ("relative_path", "risk_level", "scan_status", "risk_summary", "language", "finding_count") if c in results.columns]
    none = F.array().cast(f"array<struct<{','.join(f'{c}:string' for c in CSV_COLUMNS)}>>")
    return joined.select("doc_id", F.to_json(F.struct(*kept, F.coalesce("findings", none).alias("findings")), {"ignoreNullFields": "false"}).alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path, mode="overwrite")


def write_text(anonymized: DataFrame, path: str) -> None:
    """Anonymised texts as text files, one row each."""
    anonymized.select(F.col("anonymized").alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def escape(value: Column) -> Column:
    out = F.coalesce(value.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_report(results: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, html): a page a document, its findings in order, everything escaped."""
    row = F.concat(*(x for c in ("severity", "category", "text", "context") for x in (F.lit("<td>"), escape(F.col(c)), F.lit("</td>"))))
    body = findings.select("doc_id", F.struct("det_ord", "sub_ord", "match_ord", F.concat(F.lit("<tr>"), row, F.lit("</tr>")).alias("h")).alias("r"))
    rows = body.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["h"]), "").alias("rows"))
    joined = results.join(rows, "doc_id", "left")
    head = F.concat(F.lit("<h1>"), escape(F.col("relative_path")), F.lit("</h1><p>"), escape(F.col("risk_level")), F.lit(": "), escape(F.col("risk_summary")), F.lit("</p>"))
    return joined.select("doc_id", F.concat(F.lit("<!doctype html><meta charset=utf-8>"), head, F.lit("<table>"), F.coalesce("rows", F.lit("")), F.lit("</table>")).alias("html"))


def payload(results: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, json): what an API tells of a document; never its text."""
    joined = result_rows(results, findings)
    keep = [c for c in joined.columns if c not in ("text", "content", "original_text")]
    return joined.select("doc_id", F.to_json(F.struct(*keep)).alias("json"))


def history(entries: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last n entries by time; a limit over a sort, so no partition holds more than n."""
    return entries.orderBy(F.desc("timestamp"), F.desc("seq")).limit(n)


def posix_access(mode: str | Column) -> Column:
    """Who a folder's mode bits let in: broad, shared_local or restricted."""
    col = F.col(mode) if isinstance(mode, str) else mode
    return F.when(col.bitwiseAND(7) > 0, "broad").when(col.bitwiseAND(56) > 0, "shared_local").otherwise("restricted")


def acl_entries(acls: DataFrame) -> DataFrame:
    """Rows (path, ord, identity, rights, inherited, effect, grants_access, scope) of icacls output (path, output)."""
    lines = acls.select("path", F.posexplode(F.split("output", "\r?\n")).alias("ord", "line"))
    said = F.trim("line")
    own = F.when(said.startswith(F.col("path")) & (F.col("path") != ""), F.trim(F.substr(said, F.length("path") + 1, F.length(said)))).otherwise(said)
    kept = lines.select("path", "ord", own.alias("said")).where(~F.lower("said").rlike("^(successfully processed|failed processing)") & F.col("said").contains(":"))
    cut = kept.select("path", "ord", F.trim(F.split("said", ":", 2)[0]).alias("identity"), F.trim(F.split("said", ":", 2)[1]).alias("rights")).where("identity <> '' and rights <> ''")
    low = F.lower("identity")
    public = F.element_at(F.split(low, r"\\"), -1).isin(*PUBLIC_IDENTITIES) | low.isin(*PUBLIC_IDENTITIES)
    shared = low.rlike("|".join(s.replace("\\", r"\\") for s in SHARED_IDENTITIES)) | low.endswith("\\users")
    deny = F.upper("rights").contains("(DENY)")
    tokens = F.transform(F.regexp_extract_all("rights", F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda t: F.upper(t))
    grants = ~deny & (F.size(F.array_intersect(tokens, F.array(*map(F.lit, ACCESS_RIGHTS)))) > 0)
    return cut.select(
        "path", "ord", "identity", "rights", F.col("rights").contains("(I)").alias("inherited"), F.when(deny, "deny").otherwise("allow").alias("effect"),
        grants.alias("grants_access"), F.when(public, "public").when(shared, "shared_local").otherwise("specific").alias("scope"),
    )


def acl_summary(entries: DataFrame) -> DataFrame:
    """One row a path: its level, its broad, shared and denied identities, counts."""
    names = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("identity"))))
    grouped = entries.groupBy("path").agg(
        F.count("*").alias("entries_total"), F.count_if("inherited").alias("inherited_entries"),
        names((F.col("scope") == "public") & F.col("grants_access")).alias("broad_identities"),
        names((F.col("scope") == "shared_local") & F.col("grants_access")).alias("shared_identities"),
        names(F.col("effect") == "deny").alias("denied_identities"),
    )
    level = F.when(F.size("broad_identities") > 0, "broad").when(F.size("shared_identities") > 0, "shared_local").otherwise("restricted")
    return grouped.withColumn("access_level", level).withColumn("truncated", F.col("entries_total") > MOST_ENTRIES).withColumn("available", F.lit(True))


def folder_of(path: str | Column) -> Column:
    col = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(col, r"/[^/]*$", "")


def with_folder_access(files: DataFrame, summary: DataFrame) -> DataFrame:
    """Each file with the access of its folder, which is looked up once a folder. summary: of ``acl_summary``."""
    access = summary.select(F.col("path").alias("_folder"), F.struct(*[c for c in summary.columns if c != "path"]).alias("access"))
    return files.withColumn("_folder", folder_of("source_path")).join(access, "_folder", "left").drop("_folder")


def archive_summary(results: DataFrame, archive: str = "zip") -> DataFrame:
    """One row an archive: its members' highest level, their number, and whether all could be read."""
    return results.groupBy(archive).agg(
        F.max("risk_ord").alias("risk_ord"), F.count("*").alias("n_files"), F.sum("finding_count").alias("finding_count"),
        F.when(F.bool_or(F.col("scan_status") == "failed"), "partial").otherwise("success").alias("scan_status"),
    )


def redaction_audit(verified: DataFrame) -> DataFrame:
    """(doc_id, removed, not_found, remaining, passed) of ``anonymize.verify``: passed if nothing remains."""
    counts = verified.groupBy("doc_id").pivot("status", ["removed", "not_found", "remaining"]).count().na.fill(0)
    return counts.withColumn("passed", F.col("remaining") == 0)


def merge_alerts(*alerts: DataFrame, n: int = 50) -> DataFrame:
    """The last n alerts of several watched folders."""
    merged = alerts[0]
    for more in alerts[1:]:
        merged = merged.unionByName(more)
    return merged.orderBy(F.desc("timestamp")).limit(n)


def _labels_of(payload: str | None) -> list[tuple[int, str | None, str | None]]:
    """(ord, id, name) of the labels in a JSON text, in the order of a walk from the top; of labels with one id the first."""
    try:
        todo = [json.loads(payload or "null")]
    except (ValueError, RecursionError):
        return []
    found: dict[str, tuple[int, str | None, str | None]] = {}
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            keys = {k.casefold() for k in value}
            label = None
            if keys & {"id", "name"} and any("label" in k for k in keys):
                label = value
            elif keys & {"sensitivitylabel", "sensitivitylabelid"}:
                nested = value.get("sensitivityLabel") or value.get("SensitivityLabel")
                label = nested if isinstance(nested, dict) else value
            if label is not None:
                known = str(label.get("id") or label.get("labelId") or label.get("name") or label).casefold()
                told = [next((str(label[k]) for k in ks if label.get(k)), None) for ks in (LABEL_IDS, LABEL_NAMES)]
                found.setdefault(known, (len(found), *told))
            value = list(value.values())
        if isinstance(value, list):
            todo += reversed(value)
    return list(found.values())


#: Fields of a label, the first that says anything counts.
LABEL_IDS, LABEL_NAMES = ("id", "labelId", "sensitivityLabelId"), ("name", "displayName", "labelName", "sensitivityLabelName")


def labels(rows: DataFrame, key: str = "doc_id", payload: str = "payload") -> DataFrame:
    """(key, ord, id, name) of labels anywhere in a JSON payload, each once.

    An object is a label if it has an id or a name and a field whose name holds "label", or is what the field
    sensitivityLabel of another holds. Null payloads and those that are no JSON have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *label) for i, text in enumerate(batch.column("payload").to_pylist()) for label in _labels_of(text)]
            i, *columns = zip(*found, strict=True) if found else ((), (), (), ())
            kinds = (pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(i, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["key", "ord", "id", "name"])

    each = rows.select(F.col(key).alias("key"), F.col(payload).alias("payload")).mapInArrow(run, f"key {rows.schema[key].dataType.simpleString()}, ord int, id string, name string")
    return each.withColumnRenamed("key", key)


IDENTITY = "struct<displayName:string,email:string,id:string>"
CONTAINER = f"struct<user:{IDENTITY},group:{IDENTITY},siteUser:{IDENTITY},siteGroup:{IDENTITY},application:{IDENTITY}>"
PERMISSIONS = (
    f"struct<value:array<struct<id:string,roles:array<string>,link:struct<scope:string>,grantedToV2:{CONTAINER},grantedTo:{CONTAINER},"
    f"grantedToIdentitiesV2:array<{CONTAINER}>,grantedToIdentities:array<{CONTAINER}>,invitation:struct<email:string>,inheritedFrom:struct<id:string>>>>"
)


def permission_summary(rows: DataFrame, key: str = "doc_id", json: str = "permissions") -> DataFrame:
    """Access level and identities from a permissions payload in JSON."""
    each = rows.select(key, F.explode_outer(F.from_json(json, PERMISSIONS)["value"]).alias("p"))
    p = F.col("p")
    name = lambda i: F.nullif(F.trim(F.coalesce(F.nullif(i["displayName"], F.lit("")), F.nullif(i["email"], F.lit("")), i["id"])), F.lit(""))
    kinds = ("user", "group", "siteUser", "siteGroup", "application")
    one = lambda c: F.coalesce(*(F.when(name(c[k]).isNotNull(), F.struct(F.lit("group" if "roup" in k else "person").alias("kind"), name(c[k]).alias("name"))) for k in kinds))
    many = lambda of: F.filter(F.transform(of, one), lambda x: x.isNotNull())[0]
    invited = F.when(F.coalesce(p["invitation"]["email"], F.lit("")) != "", F.struct(F.lit("person").alias("kind"), p["invitation"]["email"].alias("name")))
    identity = F.coalesce(invited, one(p["grantedToV2"]), one(p["grantedTo"]), many(p["grantedToIdentitiesV2"]), many(p["grantedToIdentities"]))
    scope = F.lower(F.coalesce(p["link"]["scope"], F.lit("")))
    told = each.select(key, scope.alias("scope"), identity.alias("i"), p["inheritedFrom"].isNotNull().alias("inherited"), p.isNotNull().alias("there"))
    names = lambda kind: F.array_sort(F.collect_set(F.when(F.col("i.kind") == kind, F.col("i.name"))))
    grouped = told.groupBy(key).agg(
        names("group").alias("group_identities"), names("person").alias("person_identities"), F.count_if("there").alias("entries_total"),
        F.count_if("inherited").alias("inherited_entries"), F.coalesce(F.bool_or(F.col("scope") == "anonymous"), F.lit(False)).alias("public_link"),
        F.coalesce(F.bool_or(F.col("scope") == "organization"), F.lit(False)).alias("organization_access"),
    )
    level = (
        F.when(F.col("public_link"), "public").when(F.col("organization_access"), "organization").when(F.size("group_identities") > 0, "group")
        .when(F.size("person_identities") > 0, "specific").otherwise("restricted")
    )
    return grouped.withColumn("access_level", level)
