"""Question and answer items by the places of lines on pages."""

from pyspark.sql import functions as F

from granary.operators import pages

SCHEMA = "file string, page int, y double, text string, mark string"


def laid(spark, *lines, file="f"):
    return spark.createDataFrame([(file, *x, *([None] * (4 - len(x)))) for x in lines], SCHEMA)


def items(df, *names, **how):
    return [tuple(r[n] for n in names) for r in pages.question_items(df, **how).orderBy("file", "section", "number").collect()]


def test_an_item_runs_across_pages_and_ends_at_its_number(spark):
    df = laid(
        spark,
        (1, 10.0, "제6장의2"), (1, 20.0, "직장 내 괴롭힘"), (1, 30.0, "12 해고의 예고"), (1, 32.0, "too near"), (1, 60.0, "A  title"), (1, 70.0, "in\ttwo"),
        (1, 100.0, None, "question"), (1, 100.0, "level with the mark"), (1, 120.0, "first"), (1, 900.0, "총칙 / 3"), (2, 900.0, "17"),
        (2, 10.0, "second"), (2, 20.0, None), (2, 300.0, None, "answer"), (2, 320.0, "yes"), (3, 10.0, "(임금정책과-12, 2020.1.2.)"), (3, 20.0, "noise"), (3, 30.0, "(임금정책과-13, 2020.1.3.)"),
        (3, 150.0, "no title"), (3, 250.0, None, "question"), (3, 260.0, "third"),
    )
    assert items(df, "id", "chapter", "chapter_title", "section", "section_title", "title", "question", "answer", "admin_no", "admin_date") == [
        ("INTER_C06_S12_01", "6", "직장내괴롭힘", "12", "해고의 예고", "A title intwo", "first\nsecond", "yes\n(임금정책과-12, 2020.1.2.)", "임금정책과-12", "2020.1.2"),
        ("INTER_C06_S12_02", "6", "직장내괴롭힘", "12", "해고의 예고", "", "third", "", "", ""),
    ]


def test_the_last_answer_counts_and_empty_questions_take_a_number(spark):
    df = laid(
        spark,
        (1, 5.0, None, "answer"), (1, 6.0, "before any question"),
        (1, 200.0, None, "question"), (1, 210.0, "q1"), (1, 400.0, None, "answer"), (1, 410.0, "old"), (1, 600.0, None, "answer"), (1, 610.0, "new"),
        (2, 200.0, None, "question"), (2, 400.0, None, "question"), (2, 410.0, "q3"),
    )
    assert items(df, "id", "number", "question", "answer") == [("INTER_C00_S00_01", 1, "q1", "new"), ("INTER_C00_S00_03", 3, "q3", "")]


def test_a_chapter_closes_the_section_and_numbers_restart(spark):
    df = laid(
        spark,
        (1, 10.0, "제 1 장 총 칙"), (1, 20.0, "4 해고의 예고"), (1, 200.0, None, "question"), (1, 210.0, "q1"), (1, 400.0, None, "question"), (1, 410.0, "q2"),
        (2, 10.0, "제2장 임금"), (2, 200.0, None, "question"), (2, 210.0, "q3"),
    )
    both = df.unionByName(df.withColumn("file", F.lit("g")))
    expected = [("2", "", "INTER_C02_S00_01", "q3"), ("1", "4", "INTER_C01_S04_01", "q1"), ("1", "4", "INTER_C01_S04_02", "q2\n제2장 임금")]
    got = items(both, "file", "chapter", "section", "id", "question")
    assert got == [("f", *e) for e in expected] + [("g", *e) for e in expected]
    assert {c for (c,) in items(df, "chapter", chapter=F.lit("9"))} == {"9"}
    assert items(laid(spark, (1, 1.0, "alone")), "id") == []
    assert items(df.limit(0), "id") == []


def test_extra_columns_with_clashing_names(spark):
    df = laid(spark, (1, 200.0, None, "question"), (1, 210.0, "q1")).withColumns({c: F.lit("x") for c in ("at", "n", "item", "chapter", "section", "kind", "body")})
    assert items(df, "id", "question") == [("INTER_C00_S00_01", "q1")]
