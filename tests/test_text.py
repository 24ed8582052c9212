import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.schema import TABLES


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,heading", [("1. Introduction\nWe", True), ("2 Methods\n", True), ("INTRODUCTION\ntext", True), ("Conclusion\n", True), ("abstract\n", True), ("第一章 绪论\n", True), ("1.1 研究背景\n正文", True), ("12\nIntroduction", True), ("lower case prose only", False), ("1. Introduction We present x.", False), ("in the Introduction we", False), ("1. Introduction\n", True), (None, False), ("", False)])
def test_headings(spark, text, heading):
    assert one(spark, T.is_heading(F.col("t")), t=text) is heading


def test_trimmed(spark):
    assert one(spark, T.trimmed(F.col("t")), t="　 \n a b \t﻿") == "a b"


@pytest.mark.parametrize("text,year", [("于2024年", 2024), ("x2024", 0), ("(1999)", 1999), ("12024", 0), ("1899 and 2099", 2099), (None, 0)])
def test_year(spark, text, year):
    assert one(spark, T.year_of(F.col("t")), t=text) == year


def test_abstract(spark):
    assert one(spark, T.abstract_of(F.col("t")), t="ABSTRACT: " + "a" * 700) == "a" * 600
    assert one(spark, T.abstract_of(F.col("t")), t="Abstract short") == ""


def test_metadata(spark):
    assert one(spark, T.title_of(F.col("t"), F.col("f")), t="", f="A.pdf.PDF") == "A.pdf"
    assert one(spark, T.split_authors(F.col("t")), t=" A B ;, C,; ") == ["A B", "C"]
    assert one(spark, T.split_authors(F.col("t")), t=None) == []
    assert one(spark, T.preview(F.col("t"), 3), t="abcd") == "abc…"
    assert one(spark, T.preview(F.col("t"), 3), t="abc") == "abc"


def test_math(spark):
    assert one(spark, T.display_math(F.col("t")), t="a \\[ x\n+ y \\] b") == "a \n$$\nx\n+ y\n$$\n b"
    assert one(spark, T.inline_math(F.col("t")), t="\\(a\\) and \\(b\\)") == "$a$ and $b$"


def test_links(spark):
    assert one(spark, T.allowed_url(F.col("t")), t="HTTPS://a") and not one(spark, T.allowed_url(F.col("t")), t="file:///etc") and not one(spark, T.allowed_url(F.col("t")), t=None)


def test_links_of_all_messages(spark, tmp_path):
    import __spark_entry__ as entry

    texts = {"zh": "你好", "ru": "Привет", "wide": "\u3000\u00a0\ufeff", "ascii": " \t\n", "null": None, "link": "HTTPS://пример.рф", "file": "file:///é"}
    rows = [(k, "c", "user", t, None, 1) for k, t in texts.items()]
    spark.createDataFrame(rows, TABLES["messages"]).write.parquet(f"{tmp_path}/messages.parquet")
    got = {r.id: (r.allowed, r.sendable) for r in entry.queries()["q_link_check"](spark, str(tmp_path)).collect()}
    assert got == {"zh": (False, True), "ru": (False, True), "wide": (False, False), "ascii": (False, False), "null": (False, False), "link": (True, True), "file": (False, True)}
