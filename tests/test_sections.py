"""Layouts of question and answer sections against small files."""

from granary.sources import files, sections

NAMED = """# Items
### QA-001
- Type: `multi`
- Persona: `P3` (new owner)
**Question**
first line

second line
**Answer**
yes
**Evidence**
- a
- b
### QA-002
**Question**
without an answer
### QA-001
- Domains: `tax, labor`
**Question**
again
**Answer**
**Evidence**
"""


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_named_items_span_lines_and_the_last_of_an_id_stays(spark, tmp_path):
    (tmp_path / "a.md").write_text(NAMED)
    (tmp_path / "b.md").write_text(NAMED.rsplit("### QA-001", 1)[0])
    (tmp_path / "c.md").write_text("")
    (tmp_path / "d.md").write_text("no section ### QA-003\n")
    one = sections.named_items(spark, str(tmp_path / "a.md"))
    assert rows(one, "id", "type", "domains", "question", "answer") == [("QA-001", "unknown", "tax, labor", "again", ""), ("QA-002", "unknown", "", "", "")]
    first = [r for r in sections.named_items(spark, str(tmp_path)).collect() if r.type == "multi"]
    assert [(r.persona_id, r.persona, r.question, r.answer, r.evidence) for r in first] == [("P3", "new owner", "first line\n\nsecond line", "yes", "- a\n- b")]
    assert sections.named_items(spark, str(tmp_path)).count() == 4
    assert sections.named_items(spark, str(tmp_path / "[cd].md")).count() == 0


def test_numbered_titles(spark, tmp_path):
    (tmp_path / "n.md").write_text("#### Q1. A title — [P2 baker]\n**질문**: q\nr\n**기대 답변**: a\n**검증 포인트**: v\n**참조 데이터**: d\n---\n#### Q22. plain —\n**질문**: q\n#### Qx. no item\n")
    found = rows(sections.numbered_items(spark, str(tmp_path / "n.md")), "id", "title", "persona_id", "persona", "question", "answer", "verification", "reference")
    assert found == [("Q1", "A title", "P2", "baker", "q\nr", "a", "v", "d"), ("Q22", "#### Q22. plain", "", "", "", "", "", "")]


def test_graded_fallbacks(spark, tmp_path):
    (tmp_path / "g.md").write_text(
        "### Q5. t [Easy] [페르소나 C: x]\n**질문**:\n> one\n> two\n**도메인**: `a`\n**기대 답변**:\nbody\n---\n**[답변 근거]**\nb\n**Evidence**:\n| e |\n"
        "### Q6. t\n**질문**: plain\n**도메인**: a, b\n**기대 답변**:\nshort\n--- end\n"
    )
    found = rows(sections.graded_items(spark, str(tmp_path / "g.md")), "id", "difficulty", "persona", "domains", "question", "answer", "basis", "evidence")
    assert found == [("Q5", "Easy", "C", "a", "one\ntwo", "body", "---\n**[답변 근거]**\nb\n**Evidence**:\n| e |", "| e |"), ("Q6", "Medium", "", "a, b", "plain", "short", "", "")]


def test_evaluation_rows_need_domain_question_and_answer(spark, tmp_path):
    whole = "### U-7. t\n- **도메인**: d\n**질문**: q1\nq2\n\n**기대 답변**:\n\na1\n\na2\n---\n**[답변 근거]**\n"
    (tmp_path / "e.md").write_text(whole + whole.replace("U-7", "W-12").replace("- **도메인**: d\n", "") + whole.replace("U-7", "V-1234").replace("---\n**[답변 근거]**", "\n**검증 포인트**") + whole.replace("U-7", "X-1").split("---")[0])
    found = rows(sections.evaluation_rows(spark, str(tmp_path / "e.md")), "id", "difficulty", "question", "ground_truth")
    assert found == [("U-007", "", "q1\nq2", "a1\n\na2"), ("V-1234", "", "q1\nq2", "a1\n\na2")]


def test_a_log_page_runs_over_files_by_name(spark, tmp_path):
    for name, first in (("log-1.txt", 0), ("log-2.txt", 3), ("log-3.txt", 1000)):
        (tmp_path / name).write_text("\n".join(f"line {i}" for i in range(first, {0: 3, 3: 1000, 1000: 1001}[first])))
    page = lambda n, **how: [int(r.line.split()[1]) for r in files.log_page(spark, str(tmp_path), n, 4, **how).collect()]
    assert page(1) == [1000, 999, 998, 997] and page(2) == [996, 995, 994, 993]
    assert page(2, most=6) == [996, 995] and page(250) == [4, 3, 2, 1] and page(252) == []
