"""Lists that a scan is given: loading, merging, keeping, and all of them in one JSON document."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How the kinds of an ignore list are called in its file.
IGNORE_KEYS = {"email_domains": "domain", "emails": "email", "names": "name"}
#: Lists of a settings document: name, and whether case tells values apart.
LISTS = {"whitelist": True, "blacklist": False, "clients": True}


def parse_ignore(content: str) -> list[tuple[str, str]]:
    """(kind, value) of an ignore list in TOML; a ValueError says what is wrong."""
    try:
        read = tomllib.loads(content)
    except tomllib.TOMLDecodeError as error:
        raise ValueError(f"TOML: {error}") from error
    table = read.get("ignore", read)
    return [(kind, str(v).strip()) for key, kind in IGNORE_KEYS.items() for v in table.get(key, []) if str(v).strip()]


def ignore_list(*parts: DataFrame) -> DataFrame:
    """The union of ignore lists (kind, value): the one that comes with a deployment and the users' own, each value once."""
    merged = parts[0].select("kind", "value")
    for more in parts[1:]:
        merged = merged.unionByName(more.select("kind", "value"))
    return merged.where("kind is not null and trim(value) <> ''").select("kind", F.trim("value").alias("value")).distinct()


def kept(values: DataFrame, case: bool) -> DataFrame:
    """(ord, value): each value of a list (ord, value) once, where it stands first; ``case`` tells whether case matters."""
    trimmed = values.select("ord", F.trim("value").alias("value")).where("value <> ''")
    key = F.col("value") if case else F.lower("value")
    first = Window.partitionBy("_key").orderBy("ord", "value")
    return trimmed.withColumn("_key", key).withColumn("_n", F.row_number().over(first)).where("_n = 1").select("ord", "value")


def saved(spark: SparkSession, path: str, values: DataFrame, case: bool) -> None:
    """Keep a list as a table; the file that was there stays readable until the new one is whole."""
    kept(values, case).write.mode("overwrite").parquet(path)


def settings(named: dict[str, DataFrame], ignored: DataFrame, patterns: DataFrame) -> DataFrame:
    """(json): all lists in one document. Lists: (ord, value) by name; patterns: (name, regex, severity, ignore_case)."""
    kinds = {"l": "struct<ord:int,value:string>", "i": "struct<kind:string,value:string>", "p": "struct<name:string,regex:string,severity:string,ignore_case:boolean>"}

    def row(df: DataFrame, name: str, **of: F.Column) -> DataFrame:
        return df.select(F.lit(name).alias("list"), *(of.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))

    rows = row(ignored, "ignore", i=F.struct("kind", "value")).unionByName(row(patterns, "patterns", p=F.struct("name", "regex", "severity", "ignore_case")))
    for name, case in LISTS.items():
        rows = rows.unionByName(row(kept(named[name], case), name, l=F.struct("ord", "value")))
    of = lambda name, c: F.array_sort(F.collect_list(F.when(F.col("list") == name, F.col(c))))
    one = rows.agg(of("patterns", "p").alias("patterns"), F.array_distinct(of("ignore", "i")).alias("ignore"), *(F.transform(of(n, "l"), lambda x: x["value"]).alias(n) for n in LISTS))
    return one.select(F.to_json(F.struct("*")).alias("json"))


SETTINGS = (
    "struct<patterns:array<struct<name:string,regex:string,severity:string,ignore_case:boolean>>,whitelist:array<string>,blacklist:array<string>,"
    "clients:array<string>,ignore:array<struct<kind:string,value:string>>>"
)


def from_settings(document: DataFrame) -> dict[str, DataFrame]:
    """The lists of a settings document (json): (ord, value) by name, ``ignore`` (kind, value), ``patterns``."""
    read = document.select(F.from_json("json", SETTINGS).alias("s")).select("s.*")
    lists = {n: kept(read.select(F.posexplode(n).alias("ord", "value")), case) for n, case in LISTS.items()}
    return lists | {"ignore": ignore_list(read.select(F.inline("ignore"))), "patterns": read.select(F.inline("patterns"))}
