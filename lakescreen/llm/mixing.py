"""Mixing sources to target weights, with DataFrame functions only.

Words are counted per document and summed per source. Targets are a water level: source weights share all words, no
target goes above ``most`` times its source's words, and what a capped source leaves is shared again by weight. The level
has a closed form over sources in the order in which they reach their cap, so no loop is needed.

A document is emitted floor(rate) times, and once more with the probability that the rate's fraction says, by a hash of its
doc_id and text. Independent draws would leave a source far from its target where a few documents hold much of it. So the
documents of a source are put into classes of nearly equal size, and from the largest class on, each class says how many of
its documents are drawn: so many that the words drawn so far come to the fraction of the words seen so far, the rest below
one by a hash-seeded draw, within what the smaller ones can still make up for. Of a class those of the smallest hashes are drawn; the hash up to which they go is found by
counting hashes in buckets and ranking one bucket, so a source of any size is no group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix"
#: Buckets of a class's hashes; the documents of one are ranked together.
BUCKETS = 4096


def words(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size). One task sees one row a source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = by.withColumn(
        "w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    )
    # Sources by the level at which they are full: those before a source are full when it fills.
    filled = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stepped = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("open"),
    )
    full = stepped.withColumn("full", F.col("left") * F.col("w") >= most * F.col("source_size") * F.col("open"))
    # The level comes from the first source that does not fill, after which none does.
    first = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("left"), F.col("open")))).over(everything)
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(
        (F.col("level.left") * F.col("w")).cast("double") / F.col("level.open").cast("double")
    )
    return (
        full.withColumn("level", first)
        .withColumn("target", target)
        .select(
            "source",
            "source_size",
            "target",
            F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most))))
            .otherwise(0.0)
            .alias("rate"),
        )
    )


def draw(key: str = "doc_id", text: str = "text", seed: str = SEED) -> F.Column:
    """A number below 1 from 52 bits of a hash of seed, key and text: rows of one key, or of none, draw apart."""
    said = F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return _unit(said)


def _unit(said: F.Column) -> F.Column:
    """A number from 0 below 1 by a string's MD5."""
    return F.conv(F.substring(F.md5(said), 1, 13), 16, 10).cast("double") / 2.0**52


def size_class(size: str = "size") -> F.Column:
    """Sizes to seven binary digits, the rest zero: the smallest of sizes that differ by less than one in 64."""
    return F.expr(f"{size} - {size} % shiftleft(1L, cast(greatest(length(bin({size})) - 7, 0) as int))")


def draws(classes: DataFrame, seed: str = SEED) -> DataFrame:
    """(source, class, k): how many documents of each class get another copy, from (source, class, n, w, fraction).

    Classes of a source are folded from the largest on; there are some 64 of them for each binary digit of a size at most.
    """
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), F.lit(":"), F.col("class").cast("string"))
    by = (
        classes.withColumn("u", _unit(said))
        .groupBy("source", "fraction")
        .agg(F.sum("w").cast("double").alias("total"), F.sort_array(F.collect_list(F.struct((-F.col("class")).alias("down"), "class", F.col("n").cast("double").alias("n"), F.col("w").cast("double").alias("w"), "u"))).alias("rows"))
    )
    # Of a class: drawn freely; most and least that leave what the smaller ones can make up for.
    free = "floor((fraction * y.seen - acc.took) / y.mean + x.u)"
    most = "floor((fraction * total - acc.took) / y.mean)"
    least = "ceil((fraction * total - acc.took - (total - y.seen)) / y.mean)"
    k = f"if(x.class = 0, floor(fraction * x.n + x.u), least(x.n, greatest(0D, if({least} > {most}, {free}, least({most}, greatest({least}, {free}))))))"
    fold = f"""aggregate(rows, named_struct('seen', 0D, 'took', 0D, 'out', cast(array() as array<struct<class:bigint,k:double>>)),
      (acc, x) -> transform(transform(array(named_struct('seen', acc.seen + x.w, 'mean', x.w / x.n)), y -> named_struct('seen', y.seen, 'mean', y.mean, 'k', cast({k} as double))),
        z -> named_struct('seen', z.seen, 'took', acc.took + z.k * z.mean, 'out', concat(acc.out, array(named_struct('class', x.class, 'k', z.k)))))[0],
      acc -> acc.out)"""
    return by.select("source", F.inline(F.expr(fold))).withColumn("k", F.col("k").cast("long"))


def thresholds(sizes: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """(of, class, most): the largest hash up to which documents of a source and class get another copy; none where none do."""
    cells = sizes.groupBy("source", size_class().alias("class"), F.floor(F.col("drawn") * BUCKETS).alias("bucket")).agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    cells = staged(cells, "cells")
    fractions = rates.select(F.col("source").alias("of"), (F.col("rate") - F.floor("rate")).alias("fraction"))
    classes = cells.groupBy("source", "class").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    k = draws(classes.join(fractions, F.col("source").eqNullSafe(F.col("of"))).drop("of"), seed).where("k > 0")
    k = k.select(F.col("source").alias("of"), F.col("class").alias("_class"), "k")
    along = Window.partitionBy("of", "class").orderBy("bucket")
    met = cells.join(k, F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("_class"))).select("of", "class", "bucket", "n", "k")
    last = met.withColumn("upto", F.sum("n").over(along)).where("upto >= k and upto - n < k")
    last = last.select("of", F.col("class").alias("_class"), F.col("bucket").alias("_bucket"), (F.col("k") - F.col("upto") + F.col("n")).alias("nth"))
    here = F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("_class")) & (F.col("bucket") == F.col("_bucket"))
    rows = sizes.select("source", "drawn", size_class().alias("class"), F.floor(F.col("drawn") * BUCKETS).alias("bucket")).join(last, here)
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("of", "class").orderBy("drawn"))).where("at = nth")
    return ranked.select("of", "class", F.col("drawn").alias("most"))


def copies() -> F.Column:
    """floor(rate), and one more up to the class's last hash."""
    return (F.floor("rate") + F.coalesce((F.col("drawn") <= F.col("most")).cast("long"), F.lit(0))).cast("long")


def _rated(rows: DataFrame, by: DataFrame, upto: DataFrame) -> DataFrame:
    """``rows`` (source, size, drawn) with their source's target and rate, and their class's last hash."""
    by = by.select(F.col("source").alias("_source"), "source_size", "target", "rate")
    upto = upto.select(F.col("of").alias("_of"), F.col("class").alias("_class"), "most")
    met = rows.join(by, F.col("source").eqNullSafe(F.col("_source")))
    return met.join(upto, F.col("source").eqNullSafe(F.col("_of")) & (size_class() == F.col("_class")), "left").drop("_source", "_of", "_class")


def _decided(docs: DataFrame, weights: tuple[int, ...], most: int, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes and draws of all documents, targets by source, and last hashes by source and class."""
    sizes = staged(spread(docs.select("doc_id", "text", "source")).select("doc_id", "source", words().alias("size"), draw(seed=seed).alias("drawn")), "sizes")
    by = staged(targets(sizes, weights, most), "targets")
    return sizes, by, staged(thresholds(sizes, by, seed), "thresholds")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row (doc_id, size, source_size, target, taken, copies, source) for each row of ``docs``.

    Each source's taken words come to its target but for about the size of its smallest documents, or of a larger one where
    its others cannot make up for that. Null and empty texts have size 0 and take 0 words; their copies follow their source's
    rate. A source of no words has target 0. Rows without a source are one source, the last. Rows equal in doc_id and text
    draw alike, all others apart. Sources are ordered without ties. A very long text counts as any other. An empty table
    gives no rows. Columns other than doc_id, text and source are not looked at.
    """
    return _rated(*_decided(docs, weights, most, seed)).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * copies()).alias("taken"),
        copies().alias("copies"),
        "source",
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with each row emitted as often as the mix takes it; columns, of any names, stay as they are.

    Nulls, empty and very long texts, repeated rows, ties and empty tables as in ``plan``.
    """
    _, by, upto = _decided(docs, weights, most, seed)
    held = docs.select(F.struct("*").alias("_row"), draw(seed=seed).alias("drawn"), words().alias("size"), F.col("source").alias("source"))
    rated = _rated(held, by, upto).withColumn("_n", copies())
    return rated.where("_n > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy")).select("_row.*")


def op3_digest(docs: DataFrame) -> DataFrame:
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
with recursive sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5('mix:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as hash from documents),
by_source as (select source, sum(size)::bigint as source_size from sizes group by source),
weighed as (select *, ((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::bigint as w from by_source),
stepped as (
  select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over (o rows between unbounded preceding and 1 preceding), 0))::bigint as room,
    (sum(w) over () - coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0))::bigint as still
  from weighed window o as (order by source_size / w, source is null, encode(source))),
filled as (select *, room * w >= 3 * source_size * still as is_full from stepped),
level as (select room, still from filled where not is_full order by source_size / w, source is null, encode(source) limit 1),
targets as (
  select source, source_size, case when is_full then (3 * source_size)::double
    else ((select room from level) * w)::double / (select still from level)::double end as target from filled),
rates as (select *, case when source_size > 0 then least(target / source_size, 3.0::double) else 0.0::double end as rate from targets),
drawn as (select *, ('0x' || substr(hash, 1, 13))::bigint::double / 4503599627370496.0 as u, size - size % (1::bigint << greatest(length(bin(size)) - 7, 0)::int) as class from sizes),
classes as (
  select d.source, class, count(*)::double as n, sum(size)::double as w, any_value(rate - floor(rate)) as fraction,
    ('0x' || substr(md5('mix:' || coalesce('=' || d.source, '') || ':' || class::varchar), 1, 13))::bigint::double / 4503599627370496.0 as u,
    row_number() over (partition by d.source order by class desc) as i
  from drawn d join rates r on d.source is not distinct from r.source group by d.source, class),
summed as (
  select *, w / n as mean, sum(w) over (partition by source) as total, sum(w) over (partition by source order by i rows unbounded preceding) as seen from classes),
steps as (
  select source, class, i, k, took + k * mean as took from (
    select *, case when class = 0 then floor(fraction * n + u) else least(n, greatest(0.0::double,
      case when lo > hi then free else least(hi, greatest(lo, free)) end)) end as k from (
      select *, 0.0::double as took, floor((fraction * seen - 0.0) / mean + u) as free, floor((fraction * total - 0.0) / mean) as hi,
        ceil((fraction * total - 0.0 - (total - seen)) / mean) as lo from summed where i = 1))
  union all
  select source, class, i, k, took + k * mean from (
    select *, case when class = 0 then floor(fraction * n + u) else least(n, greatest(0.0::double,
      case when lo > hi then free else least(hi, greatest(lo, free)) end)) end as k from (
      select c.*, s.took, floor((c.fraction * c.seen - s.took) / c.mean + c.u) as free, floor((c.fraction * c.total - s.took) / c.mean) as hi,
        ceil((c.fraction * c.total - s.took - (c.total - c.seen)) / c.mean) as lo
      from steps s join summed c on c.source is not distinct from s.source and c.i = s.i + 1))),
ranked as (select *, row_number() over (partition by source, class order by u) as at from drawn),
upto as (
  select r.source, r.class, r.u as most from ranked r join steps s on r.source is not distinct from s.source and r.class = s.class and r.at = s.k)
select doc_id, size, source_size, target, (size * (floor(rate)::bigint + case when d.u <= most then 1 else 0 end))::bigint as taken
from drawn d join rates r on d.source is not distinct from r.source
left join upto t on d.source is not distinct from t.source and d.class = t.class
"""
