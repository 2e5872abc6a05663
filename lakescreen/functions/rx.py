"""Regular expressions with offsets as native columns: matches, their places, their surroundings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters kept at each side of a match for context checks and snippets.
AROUND = 140

HIT = "array<struct<start:int,end:int,m:string,g:array<string>,pre:string,post:string>>"


def ascii_digits(pattern: str) -> str:
    """``\\d`` as 0-9, which Java finds much faster than all of Unicode's digits; no check accepts others."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\d":
            out.append("0-9" if inside else "[0-9]")
            k += 2
        elif two[0] == "\\":
            out.append(two)
            k += 2
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
            k += 1
    return "".join(out)


def java(pattern: str, flags: str = "") -> str:
    """A pattern whose words and case follow Unicode and whose lines end at a line feed only."""
    return f"(?dU{flags})" + ascii_digits(pattern).replace("(?P<", "(?<")


def literal(value: str) -> str:
    """A pattern that matches ``value`` itself."""
    return re.sub(r"([^\w\s]|_)", r"\\\1", value).replace("\\_", "_")


def quoted(value: str) -> str:
    """``value`` as a literal of Spark's SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def up_to(pattern: str) -> str:
    """A pattern of what stands from one match of ``pattern`` to the end of the next; ``pattern`` matches no empty text."""
    return rf"\G(?s:.*?)(?:{pattern})"


def offsets_sql(text: str, pattern: str, may_be_empty: bool = False, found: str | None = None) -> str:
    """``offsets`` as SQL; for many patterns one expression as text is built much faster than one by calls.

    Gaps and matches together tell the places: to split at a pattern compiles it for each text, which costs far more than
    to match it. may_be_empty: for a pattern that can match an empty text, which is split after all. found: the name of
    the matches, where they are known.
    """
    p, empty = quoted(pattern), "cast(array() as array<struct<start:int,end:int,m:string>>)"
    gaps = f"split({text}, {p}, -1)" if may_be_empty else f"regexp_extract_all({text}, {quoted(up_to(pattern))}, 0)"
    m = f"x.{found or '`0`'}"
    end = "acc.at + length(x.`1`)" + (f" + length({m})" if may_be_empty else "")
    start = "acc.at + length(x.`1`)" + ("" if may_be_empty else f" - length({m})")
    one = f"named_struct('start', {start}, 'end', {end}, 'm', {m})"
    step = f"if({m} is null, acc, named_struct('at', {end}, 'out', concat(acc.out, array({one}))))"
    folded = f"aggregate(arrays_zip({found or f'regexp_extract_all({text}, {p}, 0)'}, {gaps}), named_struct('at', 0, 'out', {empty}), (acc, x) -> {step}, acc -> acc.out)"
    if not found or may_be_empty:
        return folded
    # Most texts hold one match, whose place needs no fold.
    first = f"length(regexp_extract({text}, {quoted(up_to(pattern))}, 0))"
    alone = f"transform(array({first}), e -> named_struct('start', e - length(found[0]), 'end', e, 'm', found[0]))"
    return f"if(size({found}) = 1, {alone}, {folded})"


#: Hits without their surroundings.
BARE = "array<struct<start:int,end:int,m:string,g:array<string>>>"
NO_BARE = f"cast(array() as {BARE})"


def bare_sql(text: str, pattern: str, groups: int = 0, g: str | None = None, may_be_empty: bool = False) -> str:
    """Hits without their surroundings, as SQL. g: another expression for the groups, of the hit ``o`` (start, end, m)."""
    p = quoted(pattern)
    if groups:
        of = ", ".join([offsets_sql(text, pattern, found="found"), *(f"regexp_extract_all({text}, {p}, {k})" for k in range(1, groups + 1))])
        own = "array(" + ", ".join(f"z.`{k}`" for k in range(1, groups + 1)) + ")"
        rows = f"transform(arrays_zip({of}), z -> named_struct('start', z.`0`.start, 'end', z.`0`.`end`, 'm', z.`0`.m, 'g', {own}))"
    else:
        own = g or "cast(array() as array<string>)"
        rows = f"transform({offsets_sql(text, pattern, may_be_empty, 'found')}, o -> named_struct('start', o.start, 'end', o.`end`, 'm', o.m, 'g', {own}))"
    return f"transform(array(regexp_extract_all({text}, {p}, 0)), found -> if(size(found) > 0, cast({rows} as {BARE}), {NO_BARE}))[0]"


def around_sql(text: str, h: str) -> str:
    """The characters before and after a hit, as SQL."""
    low = f"greatest(0, {h}.start - {AROUND})"
    return f"'pre', substring({text}, {low} + 1, {h}.start - {low}), 'post', substring({text}, {h}.`end` + 1, {AROUND})"


def hits_sql(text: str, pattern: str) -> str:
    """``hits`` without groups, as SQL, of any pattern."""
    row = f"named_struct('start', h.start, 'end', h.`end`, 'm', h.m, 'g', h.g, {around_sql(text, 'h')})"
    return f"transform({bare_sql(text, pattern, may_be_empty=True)}, h -> {row})"


def near_sql(found: str, text: str, keyword: str, within: int) -> str:
    """``near`` as SQL, of bare hits."""
    places = f"transform({offsets_sql(text, keyword)}, w -> w.start)"
    kept = f"transform(array({places}), places -> filter({found}, h -> exists(places, w -> abs(w - h.start) < {within})))[0]"
    return f"if({text} rlike {quoted(keyword)}, {kept}, {NO_BARE})"


def offsets(text: Column, pattern: str, may_be_empty: bool = False) -> Column:
    """array<struct<start, end, m>> of all matches, by one fold over the gaps between them; linear in the text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1) if may_be_empty else F.regexp_extract_all(text, F.lit(up_to(pattern)), F.lit(0))
    zipped = F.arrays_zip(found.alias("m"), gaps.alias("gap"))
    empty = F.array().cast("array<struct<start:int,end:int,m:string>>")
    begin = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        own = F.length(x["m"])
        end = acc["at"] + F.length(x["gap"]) + (own if may_be_empty else 0)
        one = F.struct((end - own).cast("int").alias("start"), end.cast("int").alias("end"), x["m"].alias("m"))
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    return F.aggregate(zipped, begin, step, lambda acc: acc["out"])


def hits(text: Column, pattern: str, groups: int = 0) -> Column:
    """``HIT`` rows of all matches, with ``groups`` capture groups; an empty array, by one look only, if there is none."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in range(1, groups + 1)]
    zipped = F.arrays_zip(offsets(text, pattern).alias("o"), *(p.alias(f"g{k}") for k, p in enumerate(parts, 1)))

    def row(z: Column) -> Column:
        o = z["o"]
        lo = F.greatest(F.lit(0), o["start"] - AROUND)
        return F.struct(
            o["start"].alias("start"),
            o["end"].alias("end"),
            o["m"].alias("m"),
            (F.array(*(z[f"g{k}"] for k in range(1, groups + 1))) if groups else F.array().cast("array<string>")).alias("g"),
            F.substr(text, lo + 1, o["start"] - lo).alias("pre"),
            F.substr(text, o["end"] + 1, F.lit(AROUND)).alias("post"),
        )

    return F.when(text.rlike(pattern), F.transform(zipped, row).cast(HIT)).otherwise(F.array().cast(HIT))


def near(found: Column, text: Column, keyword: str, within: int) -> Column:
    """Those hits that start less than ``within`` characters from the start of a keyword."""
    places = F.transform(offsets(text, keyword), lambda o: o["start"])
    zipped = F.transform(found, lambda h: F.struct(h.alias("h"), F.exists(places, lambda k: F.abs(k - h["start"]) < within).alias("ok")))
    kept = F.transform(F.filter(zipped, lambda z: z["ok"]), lambda z: z["h"])
    return F.when((F.size(found) > 0) & text.rlike(keyword), kept).otherwise(F.array().cast(HIT))


def snippet(pre: Column, m: Column, post: Column, start: Column, end: Column, length: Column, radius: Column) -> Column:
    """The match with ``radius`` characters at each side, line feeds as spaces, cut ends marked."""
    left = F.substr(pre, F.greatest(F.lit(1), F.length(pre) - radius + 1), radius)
    right = F.substr(post, F.lit(1), radius)
    mark = F.lit("…")
    return F.concat(
        F.when(start > radius, mark).otherwise(F.lit("")),
        F.translate(F.concat(left, m, right), "\n", " "),
        F.when(end + radius < length, mark).otherwise(F.lit("")),
    )


def last(text: Column, n: int) -> Column:
    """The last n characters."""
    return F.substr(text, F.greatest(F.lit(1), F.length(text) - n + 1), F.lit(n))


def strip(text: Column, chars: str) -> Column:
    return F.trim(text, F.lit(chars))


def squeeze(text: Column) -> Column:
    """White space runs as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
