"""Question and answer items out of the lines of pages, by their places.

Lines come from any extractor as (file, page, y, text, mark): ``mark`` is
``question`` or ``answer`` where a mark stands, else null. A place counts over
all pages of a file, so an item may run across pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import admin_info, page_edge, stripped

# What a chapter, a section and the last line of an answer look like.
CHAPTER = r"^제\s*(\d+)\s*장(?:의\s*\d+)?\s+([^/]+)$"
CHAPTER_ALONE = r"^제\s*(\d+)\s*장(?:의\s*\d+)?$"
SECTION = r"^(\d+)\s+([가-힣][가-힣\s·･의]+)$"
LAST_LINE = r"^\([가-힣]+-\d+,\s*\d{4}\.\d{1,2}\.\d{1,2}\.?\)$"


def headings(lines: DataFrame, near: float = 50.0) -> DataFrame:
    """``lines`` with ``chapter`` and ``section``, structs of number and title, where a line is such a heading.

    A chapter's number alone takes its title from a line of its page less than ``near`` away.
    """
    t = stripped(F.col("text"))
    plain = ~page_edge(F.col("text"))
    beside = F.when(plain & t.rlike("^[가-힣]") & ~t.rlike(CHAPTER_ALONE) & ~F.contains(t, F.lit("/")), t)
    hundredths = round(near * 100) - 1
    around = Window.partitionBy("file", "page").orderBy((F.col("y") * 100).cast("long")).rangeBetween(-hundredths, hundredths)
    lines = lines.withColumn("__beside", F.first(beside, ignorenulls=True).over(around))
    title = F.when(t.rlike(CHAPTER_ALONE), F.col("__beside")).when(t.rlike(CHAPTER), F.regexp_extract(t, CHAPTER, 2))
    chapter = F.when(plain & title.isNotNull(), F.struct(F.regexp_extract(t, r"(\d+)", 1).alias("number"), F.replace(title, F.lit(" "), F.lit("")).alias("title")))
    section = F.when((F.length(t) <= 25) & t.rlike(SECTION), F.struct(F.regexp_extract(t, SECTION, 1).alias("number"), stripped(F.regexp_extract(t, SECTION, 2)).alias("title")))
    return lines.withColumns({"chapter": chapter, "section": section}).drop("__beside")


def question_items(lines: DataFrame, *, chapter: Column | None = None, offset: float = 10_000.0, title_within: float = 100.0) -> DataFrame:
    """file, id, chapter, chapter_title, section, section_title, number, title, question, answer, admin_no, admin_date.

    A question's lines run to the next mark, an answer's to the line that holds
    an office's number alone. Lines less than ``title_within`` above a question
    are its title (without control characters), if no mark and no section lies between. The last answer
    before the next question counts. ``number`` restarts where chapter or section
    change. ``chapter``, a column over ``file``, overrides the chapter's number.
    Page edges, null texts, lines level with a mark and lines before the first
    question go; a question without a line is no item but has a number. No
    lines, no items.

    What stands before a line decides on it, so a file is one window group;
    groups spill, and only an item's lines are ever gathered.
    """
    at = F.col("page") * F.lit(offset) + F.col("y")
    rows = headings(lines.select("file", "page", "y", "text", "mark")).withColumn("at", at)
    rows = rows.filter(F.col("mark").isNotNull() | (F.col("text").isNotNull() & (~page_edge(F.col("text")) | F.col("chapter").isNotNull())))
    marked, cut = F.col("mark").isNotNull(), F.col("section").isNotNull()
    # up: what follows a line; a mark comes behind the lines on its level
    up = Window.partitionBy("file").orderBy(F.col("at").desc(), F.col("mark").isNull(), F.col("text").desc()).rowsBetween(Window.unboundedPreceding, -1)
    follows = F.last(F.when(marked | cut, F.struct("at", "mark")), ignorenulls=True).over(up)
    rows = rows.withColumn("follows", follows)
    down = Window.partitionBy("file").orderBy("at", F.col("mark").isNull(), "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.last(F.when(F.col("chapter").isNotNull() | cut, F.struct("chapter", "section")), ignorenulls=True)  # a chapter closes the section
    rows = rows.withColumns({
        "n": F.count("mark").over(down),
        "item": F.count_if(F.col("mark") == "question").over(down),
        "mark_at": F.last(F.when(marked, F.col("at")), ignorenulls=True).over(down),
        "section_at": F.last(F.when(cut, F.col("at")), ignorenulls=True).over(down),
        "last_chapter": F.last("chapter", ignorenulls=True).over(down),
        "last_heading": heading.over(down),
        "kind": F.last("mark", ignorenulls=True).over(down),
    })
    is_title = ~marked & ~cut & (F.col("follows.mark") == "question") & (F.col("follows.at") > F.col("at")) & (F.col("follows.at") - F.col("at") < title_within) & (F.col("section_at").isNull() | (F.col("at") - F.col("section_at") >= 5))
    is_title = F.coalesce(is_title & (F.col("mark_at").isNull() | (F.col("at") > F.col("mark_at"))), F.lit(False))
    body = ~marked & ~is_title & (F.col("at") > F.col("mark_at")) & ~(F.col("follows.mark").isNotNull() & (F.col("follows.at") == F.col("at")))
    rows = rows.withColumns({"is_title": is_title, "body": F.coalesce(body, F.lit(False))})
    ended = F.count_if(F.col("body") & stripped(F.col("text")).rlike(LAST_LINE)).over(Window.partitionBy("file", "n").orderBy("at", F.col("mark").isNull(), "text").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("body", F.col("body") & ((F.col("kind") == "question") | (F.coalesce(ended, F.lit(0)) == 0)))

    joined = lambda keep, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("at", "text")))), lambda x: x["text"]), sep)
    clean = lambda c: stripped(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]", ""), r"(?U)\s+", " "))
    titles = rows.filter("is_title").groupBy("file", (F.col("item") + 1).alias("item")).agg(clean(joined(F.lit(True), " ")).alias("title"))
    parts = rows.filter("n > 0 AND item > 0").groupBy("file", "item", "n").agg(
        F.first("kind").alias("kind"),
        F.max(F.when(F.col("mark") == "question", F.struct(F.coalesce("last_chapter.number", F.lit("")).alias("chapter"), F.coalesce("last_chapter.title", F.lit("")).alias("chapter_title"), F.coalesce("last_heading.section.number", F.lit("")).alias("section"), F.coalesce("last_heading.section.title", F.lit("")).alias("section_title")))).alias("under"),
        joined(F.col("body"), "\n").alias("content"),
    )
    answers = F.col("kind") == "answer"
    items = parts.groupBy("file", "item").agg(
        F.max("under").alias("under"),
        F.max(F.when(~answers, F.col("content"))).alias("question"),
        F.coalesce(F.max_by(F.when(answers, F.col("content")), F.when(answers, F.col("n"))), F.lit("")).alias("answer"),
    )
    items = items.join(titles, ["file", "item"], "left").select("file", "item", "under.*", F.coalesce("title", F.lit("")).alias("title"), "question", "answer")
    if chapter is not None:
        items = items.withColumn("chapter", F.coalesce(chapter, F.col("chapter")))
    by = Window.partitionBy("file").orderBy("item")
    key = F.struct("chapter", "section")
    items = items.withColumn("run", F.sum(F.coalesce((key != F.lag(key).over(by)).cast("int"), F.lit(1))).over(by))
    items = items.withColumn("number", F.row_number().over(Window.partitionBy("file", "run").orderBy("item"))).filter("question <> ''")
    two = lambda c: F.format_string("%02d", F.coalesce(F.col(c).try_cast("int"), F.lit(0)))
    ident = F.concat(F.lit("INTER_C"), two("chapter"), F.lit("_S"), two("section"), F.lit("_"), F.format_string("%02d", F.col("number")))
    info = admin_info(F.col("answer"))
    return items.select("file", ident.alias("id"), "chapter", "chapter_title", "section", "section_title", "number", "title", "question", "answer", info["number"].alias("admin_no"), info["date"].alias("admin_date"))
