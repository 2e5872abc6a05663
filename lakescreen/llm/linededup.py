"""Removal of repeated runs of lines by winnowing over line hashes, with DataFrame functions only.

A run of consecutive lines of at least ``least`` words that has occurred earlier, in the order (doc_id, text hash, line),
is removed. Each line begins a window: the fewest lines from there that hold ``least`` words; and each ends one, read
backwards. Winnowing selects the least line hash of each window: its line is a fingerprint, kept once for all windows that
select it. Equal windows select equal lines, so every repeated run has a fingerprint at two places at least: fingerprints
at one place only are left out by a join on their positions. From each of the others the match is extended both ways, over
the windows around it: a window is looked up by its content at the first place that has it, never at all of them, and
windows that lie in or at one another join to the longest run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, spread, staged, with_columns_free

WORD = r"[^\x20\x09-\x0D]+"
LEAST = 50


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, t, line, words, h, g) of each line that has words, once for rows repeated with equal doc_id and text."""
    text = F.col("text")
    numbered = spread(docs.select("doc_id", "text")).select(
        "doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split(text, "\n")).alias("line", "said")
    )
    said = F.trim(F.regexp_replace("said", r"[\x20\x09-\x0D]+", " "))
    counted = numbered.select("doc_id", "t", "line", said.alias("said")).where("said <> ''")
    return counted.select(
        "doc_id",
        "t",
        "line",
        (F.length("said") - F.length(F.replace("said", F.lit(" "), F.lit(""))) + 1).cast("long").alias("words"),
        F.xxhash64("said").alias("h"),
        F.xxhash64(F.lit(1), "said").alias("g"),
    )


def fingerprints(of: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, t, at, chosen, around) of each line that some window selects.

    chosen: its hash, the least of the window; around: the windows (first, last, c, d) that select it, c and d their content.
    """
    doc = Window.partitionBy("doc_id", "t")
    lines_ = of.groupBy("doc_id", "t", "line").agg(*(F.first(c).alias(c) for c in ("words", "h", "g")))
    run = lines_.withColumn("upto", F.sum("words").over(doc.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("before", F.col("upto") - F.col("words"))
    # Every line has a word, so lines are in the order of their words; a frame holds at most ``least`` lines.
    ahead, behind = doc.orderBy("before").rangeBetween(0, least - 1), doc.orderBy("upto").rangeBetween(1 - least, 0)

    def way(over: Window, full: F.Column) -> F.Column:
        return F.struct(
            F.min("line").over(over).alias("first"),
            F.max("line").over(over).alias("last"),
            F.min(F.struct("h", "line")).over(over).alias("least"),
            F.xxhash64(F.collect_list("h").over(over)).alias("c"),
            F.xxhash64(F.collect_list("g").over(over)).alias("d"),
            full.alias("full"),
        )

    words = F.sum("words")
    # A window read backwards is also one read forwards, unless it holds enough words without its last line.
    both = run.select(
        "doc_id",
        "t",
        way(ahead, words.over(ahead) >= least).alias("a"),
        way(behind, words.over(behind) - F.col("words") >= least).alias("b"),
    )
    each = both.select("doc_id", "t", F.explode(F.filter(F.array("a", "b"), lambda w: w["full"])).alias("w"))
    # Rows lie by document already; a fingerprint has as many windows as lines of ``least`` words hold, at most twice.
    return each.groupBy("doc_id", "t", F.col("w.least.line").alias("at"), F.col("w.least.h").alias("chosen")).agg(
        F.collect_list(F.struct("w.first", "w.last", "w.c", "w.d")).alias("around")
    )


def repeated_windows(of: DataFrame) -> DataFrame:
    """Windows whose content has an earlier place: (doc_id, t, first, last, from_doc, from_line)."""
    # Written first, so that a fingerprint of very many places can be split in the join.
    many = staged(of.groupBy("chosen").agg(F.count("*").alias("n")).where("n > 1").select("chosen"), "many")
    live = staged(of.join(many, "chosen").select("doc_id", "t", F.explode("around").alias("w")).select("doc_id", "t", "w.*"), "live")
    earliest = live.groupBy("c", "d").agg(F.min(F.struct("doc_id", "t", "first")).alias("from"), F.count("*").alias("n"))
    # Written first, so that a content of very many places can be split in the join.
    matched = live.join(staged(earliest.where("n > 1").drop("n"), "earliest"), ["c", "d"])
    later = ~F.struct("doc_id", "t", "first").eqNullSafe(F.col("from"))
    return matched.where(later).select(
        "doc_id", "t", "first", "last", F.col("from.doc_id").alias("from_doc"), F.col("from.first").alias("from_line")
    )


def repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, t, runs): for each document in which runs repeat earlier ones, the runs (first, last) in order."""
    found = staged(fingerprints(lines(docs), least), "fingerprints")
    doc = Window.partitionBy("doc_id", "t")
    order = doc.orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = repeated_windows(found).withColumn("begins", (F.coalesce(reach, F.lit(-2)) < F.col("first") - 1).cast("int"))
    runs = begun.withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("doc_id", "t", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.groupBy("doc_id", "t").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with repeated runs of lines removed from ``text``, and columns n_lines, n_removed (long), runs.

    runs: the removed lines as ``first-last`` from 0, comma-joined. Lines are compared with white space collapsed; a
    blank line is never part of a run's count, and goes if it lies inside a removed window. The first place of a run
    stays, and so do runs of fewer than ``least`` words. A null text stays null and has 0 lines; an empty one has one. Rows
    with equal doc_id and text are one document and are edited alike; of texts tied in doc_id, or without one, that of the
    least hash comes first, and a missing doc_id before all. A very long text is one row when it is split and put together,
    and many rows, by line, in between. An empty table gives no rows. Columns of the added names are replaced; others may
    have any names.
    """
    rows = with_columns_free(docs, "n_lines", "n_removed", "runs")
    key, doc, text = free_names(docs, "key", "doc", "text")
    found = repeated_lines(docs, least).select(F.col("doc_id").alias(doc), F.col("t").alias(text), "runs")
    keyed = rows.withColumn(key, F.xxhash64("text"))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(text)), "left")
    gone = F.when(F.col("runs").isNull(), F.array().cast("array<int>")).otherwise(
        F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))
    )
    parts = F.split("text", "\n")
    # Kept stretches between the runs, each a slice, so a long text is not tested line by line against every run.
    bounds = F.transform(
        F.sequence(F.lit(0), F.size("runs")),
        lambda k: F.struct(
            F.when(k == 0, F.lit(0)).otherwise(F.get("runs", k - 1)["last"] + 1).alias("a"),
            F.when(k == F.size("runs"), F.size(parts)).otherwise(F.get("runs", k)["first"]).alias("b"),
        ),
    )
    kept = F.array_join(F.flatten(F.transform(bounds, lambda s: F.slice(parts, s["a"] + 1, s["b"] - s["a"]))), "\n")
    columns = [F.when(F.col("runs").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in rows.columns]
    return joined.select(
        *columns,
        F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["first"], r["last"])), ","), F.lit("")).alias("runs"),
    )


def op10_digest(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "runs", F.md5("text").alias("clean_md5"))


OP10_SQL = r"""
with rows_ as (select distinct doc_id, text from documents),
split_ as (select doc_id, text, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line from rows_),
counted as (
  select doc_id, text, line, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) as said from split_),
worded as (select *, length(said) - length(replace(said, ' ', '')) + 1 as words from counted where said <> ''),
run as (select *, sum(words) over (partition by doc_id, text order by line)::bigint as upto from worded),
both_ as (
  select doc_id, text, min(line) over a as first_, max(line) over a as last_, sum(words) over a as total, string_agg(said, chr(10)) over a as content
  from run window a as (partition by doc_id, text order by (upto - words) range between 0 preceding and 49 following)
  union
  select doc_id, text, min(line) over b, max(line) over b, sum(words) over b, string_agg(said, chr(10)) over b
  from run window b as (partition by doc_id, text order by upto range between 49 preceding and 0 following)),
wins as (select * from both_ where total >= 50),
ranked as (select *, row_number() over (partition by content order by doc_id, first_) as k from wins),
later as (select * from ranked where k > 1),
gone as (select distinct doc_id, text, unnest(range(first_, last_ + 1)) as line from later),
isles as (select *, line - row_number() over (partition by doc_id, text order by line) as isle from gone),
runs_ as (select doc_id, text, min(line) as first_, max(line) as last_ from isles group by doc_id, text, isle),
told as (select doc_id, text, string_agg(first_ || '-' || last_, ',' order by first_) as runs, sum(last_ - first_ + 1)::bigint as n_removed from runs_ group by doc_id, text),
kept as (
  select s.doc_id, s.text, string_agg(raw, chr(10) order by line) as clean from split_ s
  where not exists (select 1 from gone g where g.doc_id = s.doc_id and g.text = s.text and g.line = s.line) group by s.doc_id, s.text)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
  coalesce(runs, '') as runs, case when d.text is null then null else md5(coalesce(clean, '')) end as clean_md5
from documents d left join told t on d.doc_id = t.doc_id and d.text = t.text left join kept k on d.doc_id = k.doc_id and d.text = k.text
"""
