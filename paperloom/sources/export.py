"""JSON export of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPORTED = ("knowledge_bases", "papers", "conversations", "messages", "settings")


def redacted(settings: DataFrame) -> DataFrame:
    """Settings without the values of API keys."""
    return settings.withColumn("value", F.regexp_replace("value", r'("apiKey"\s*:\s*)"(?:[^"\\]|\\.)*"', '$1""'))


def bundle(tables: dict[str, DataFrame], redact: bool = True) -> DataFrame:
    """(section, row): every row of the exported tables as a JSON line; written with ``write.text`` it is the backup, of any size."""
    out = None
    for name in EXPORTED:
        if name not in tables:
            continue
        df = redacted(tables[name]) if name == "settings" and redact else tables[name]
        lines = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = lines if out is None else out.unionByName(lines)
    return out


def backup_name(millis: F.Column) -> F.Column:
    """File name of a backup made at a time."""
    return F.concat(F.lit("paperloom-backup-"), millis.cast("string"), F.lit(".json"))


def bundle_counts(exported: DataFrame) -> DataFrame:
    return exported.groupBy("section").agg(F.count("*").alias("rows"))
