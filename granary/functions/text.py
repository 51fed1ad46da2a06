"""Text expressions: tokens, cleaning, masking, citations, keywords.

All are Column -> Column and stay in the JVM, except the two that need a
Unicode table (``flatten_html``, ``nfc``), which are vectorised functions.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The token pattern and the shortest token kept.
TOKEN = "[가-힣]+|[a-zA-Z]+|[0-9]+"
LEAST_TOKEN = 2

# Words that are no keywords of a query.
QUERY_STOP_WORDS = (
    "은", "는", "이", "가", "을", "를", "의", "에", "에서",
    "으로", "로", "와", "과", "도", "만", "까지", "부터",
    "어떻게", "무엇", "언제", "어디", "왜", "얼마나",
    "할", "수", "있", "없", "해야", "하나요", "인가요",
    "알려주세요", "해주세요", "싶어요", "궁금해요",
)

# Words that the quality gate ignores.
GATE_STOP_WORDS = (
    "것", "수", "등", "때", "위해", "대해", "관해",
    "어떻게", "무엇", "언제", "어디", "왜", "어떤",
    "하는", "되는", "있는", "없는", "같은",
)

# Sensitive data, in the order in which it is masked.
SENSITIVE = (
    (r"[\w.+-]+@[\w.-]+\.[a-zA-Z]{2,}", "***@***.***"),
    (r"01[0-9]-?[0-9]{3,4}-?[0-9]{4}", "010-****-****"),
    (r"\d{6}-?[1-4]\d{6}", "******-*******"),
    (r"\d{3}-?\d{2}-?\d{5}", "***-**-*****"),
    (r"\d{4}-?\d{4}-?\d{4}-?\d{4}", "****-****-****-****"),
    (r"(?<![0-9\-])\d{3,4}-\d{4,8}-\d{2,4}(?![0-9\-])", "***-******-***"),
)

# Texts that stand for no value.
NO_VALUE = ("정보 없음", "정보없음", "없음", "-", "N/A", "n/a")

# Marks that an answer carries about its sources.
CITATION = r"\s*\[\d+\](?![가-힣a-zA-Z0-9])"
FOOTER = r"\n*참고\s*자료\s*:\s*\[[\d,\s]+\]\s*$"
WARNING = "주의: 이 답변은 참고 자료 인용이 누락되었을 수 있습니다."
WARNING_LINE = r"\n*>\s*주의:\s*이 답변은 참고 자료 인용이 누락되었을 수 있습니다\.\s*$"

# A citation of a law.
LAW_CITATION = r"제\s*\d+\s*조|법\s+제\s*\d+|시행령|시행규칙|동법|같은\s*법"

# Marks of a converted guide that are no text: images, page types, fences, rules.
GUIDE_MARKS = (r"!\[.*?\]\(.*?\)", r"\\?\[TYPE:\s*(?:content|form|divider|cover)\\?\]", r"(?m)^```(?:markdown)?\s*$", r"(?m)^-{3,}\s*$")

# Attempts to take over a prompt, each with its name, in the order in which they are filtered.
INJECTIONS = (
    (r"ignore\s+(all\s+)?previous\s+(instructions?|prompts?|rules?)", "ignore previous instructions"),
    (r"disregard\s+(all\s+)?previous\s+(instructions?|prompts?|rules?)", "disregard previous instructions"),
    (r"forget\s+(all\s+)?previous\s+(instructions?|prompts?|rules?)", "forget previous instructions"),
    (r"override\s+(all\s+)?previous\s+(instructions?|prompts?|rules?)", "override previous instructions"),
    (r"(print|show|reveal|display|output|repeat)\s+(the\s+)?(system\s+prompt|initial\s+prompt|instructions?|hidden\s+prompt)", "reveal system prompt"),
    (r"you\s+are\s+now\s+", "role override (you are now)"),
    (r"act\s+as\s+(if\s+you\s+are\s+|a\s+)?", "role override (act as)"),
    (r"pretend\s+(you\s+are|to\s+be)\s+", "role override (pretend)"),
    (r"from\s+now\s+on\s+you\s+(are|will|should|must)", "role override (from now on)"),
    (r"new\s+(instructions?|rules?|role|persona)\s*:", "new instructions injection"),
    (r"(do\s+not|don'?t)\s+follow\s+(your|the|any)\s+(rules?|instructions?|guidelines?)", "instruction bypass"),
    (r"jailbreak", "jailbreak attempt"),
    (r"DAN\s+mode", "DAN mode attempt"),
    (r"\[SYSTEM\]|\[INST\]|\[/INST\]|<<SYS>>|<\|im_start\|>", "special token injection"),
    (r"이전\s*(의\s*)?(지시|명령|프롬프트|규칙|지침)(을|는|은)?\s*(무시|잊어|잊으|무효|취소|삭제)", "이전 지시 무시"),
    (r"(위|위의|앞의|앞)\s*(지시|명령|프롬프트|규칙|지침)(을|는|은)?\s*(무시|잊어|잊으|무효|취소|삭제)", "위 지시 무시"),
    (r"시스템\s*프롬프트(를|을)?\s*(보여|출력|알려|공개|표시|반복)", "시스템 프롬프트 공개 시도"),
    (r"(숨겨진|숨긴|내부|초기)\s*(프롬프트|지시|명령|설정)(를|을)?\s*(보여|출력|알려|공개|표시)", "숨겨진 프롬프트 공개 시도"),
    (r"너(는|의)\s*(역할|규칙|설정|지침)(을|를|은|는)?\s*(변경|바꿔|수정|무시|잊어)", "역할 변경 시도"),
    (r"(너는|당신은)\s*이제\s*(부터\s*)?", "역할 재정의 (너는 이제)"),
    (r"(지금|이제)\s*부터\s*(너는|당신은|네가)", "역할 재정의 (지금부터 너는)"),
    (r"(새로운|다른)\s*(역할|규칙|지시|명령|페르소나)\s*:", "새 역할 주입"),
    (r"(모든|전체)\s*(규칙|제한|제약|지침)(을|를|은|는)?\s*(무시|해제|풀어|없애)", "규칙 해제 시도"),
    (r"(원래|본래|실제)\s*(설정|프롬프트|지시)(가|을|를)?\s*(뭐|무엇|어떻게)", "원래 설정 탐색"),
)

# Lines of a collection of answers that are page heads and feet.
PAGE_EDGES = (
    r"^제\s*\d*\s*장(?:의\s*\d+)?\s*[가-힣\s]+/\s*\d+$",
    r"^\d+\s*/\s*근로기준법\s*질의회시집$",
    r"^근로기준법\s*질의회시집$",
    r"^[가-힣]+\s*/\s*\d+$",
)

# Characters that show nothing.
INVISIBLE = r"[\x{200b}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{2060}\x{feff}]"

WIDE = "".join(chr(c) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
NARROW = "".join(chr(c - 0xFEE0) for c in (*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))


def words(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def bracketed(*parts: Column, most: int = 50) -> Column:
    """``[first > second]`` of the parts that are not blank, each cut at ``most`` characters with an ellipsis; empty without any."""
    short = [F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c) for c in parts]
    said = F.filter(F.array(*short), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(F.size(said) > 0, F.concat(F.lit("["), F.array_join(said, " > "), F.lit("]"))).otherwise("")


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Lower-cased runs of Hangul, Latin letters or digits, two characters or more; duplicates and order kept."""
    runs = TOKEN.replace("+", f"{{{LEAST_TOKEN},}}")  # a run is matched whole or not at all
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(runs), F.lit(0))


def word_set(c: Column) -> Column:
    """Distinct runs of word characters, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)))


def query_keywords(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[가-힣a-zA-Z0-9]+"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) >= 2) & ~F.array_contains(words(*QUERY_STOP_WORDS), w))


def gate_keywords(c: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[가-힣a-zA-Z]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~F.array_contains(words(*GATE_STOP_WORDS), w))


def html_keeping_breaks(c: Column) -> Column:
    """Line breaks stay, other tags go, at most one blank line in a row; entities are left alone."""
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    return stripped(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\n{3,}", "\n\n"))


@F.pandas_udf(T.StringType())
def unescaped(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def flatten_html(c: Column) -> Column:
    """Entities first, so an escaped tag goes like a tag; then all white space becomes single blanks."""
    return stripped(F.regexp_replace(F.regexp_replace(unescaped(F.coalesce(c, F.lit(""))), "<[^>]+>", ""), r"(?U)\s+", " "))


def law_text(c: Column) -> Column:
    """Breaks and tags as above (lower-case ``br`` only), blanks collapsed, each line stripped, wide blanks last."""
    c = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"<br\s*/?>", "\n"), "<[^>]+>", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    c = F.array_join(F.transform(F.split(c, "\n", -1), stripped), "\n")
    return stripped(F.replace(c, F.lit("　"), F.lit(" ")))


def one_line_title(c: Column) -> Column:
    """Control characters out, white space collapsed."""
    return stripped(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " "), r"(?U)\s+", " "))


def value_or_empty(c: Column) -> Column:
    c = stripped(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(c.isin(*NO_VALUE), "").otherwise(c)


def mask(c: Column, *, longest_first: bool = True) -> Column:
    """Sensitive data replaced. As fixed, the ten-digit rule comes before the card rule and
    leaves half of an unhyphenated card; ``longest_first`` moves the card rule up."""
    order = [0, 1, 2, 4, 3, 5] if longest_first else range(len(SENSITIVE))
    for i in order:
        pattern, mark = SENSITIVE[i]
        c = F.regexp_replace(c, F.lit(pattern.replace(r"\w", r"[\p{L}\p{N}_]") if "@" in pattern else pattern), F.lit(mark))
    return c


def without_citations(c: Column) -> Column:
    for pattern in (WARNING_LINE, FOOTER, CITATION):
        c = F.regexp_replace(c, pattern, "")
    return stripped(c)


def audited(c: Column, documents: Column) -> Column:
    """The footer goes; an answer from documents that cites none gets the warning."""
    c = F.regexp_replace(F.regexp_replace(c, FOOTER, ""), r"(?U)\s+$", "")
    return F.when((documents > 0) & ~c.rlike(r"\[\d+\]"), F.concat(c, F.lit("\n\n> " + WARNING))).otherwise(c)


def normal(c: Column) -> Column:
    return F.regexp_replace(stripped(F.lower(c)), r"(?U)\s+", " ")


def contains_term(text: Column, term: Column) -> Column:
    return F.contains(normal(text), normal(term))


def claims(c: Column) -> Column:
    """Lines without a leading dash; the whole text where none is left."""
    lines = F.transform(F.split(c, "\n", -1), lambda x: stripped(x))
    lines = F.transform(lines, lambda x: F.when(F.startswith(x, F.lit("- ")), stripped(F.substring(x, 3, 1 << 30))).otherwise(x))
    kept = F.filter(lines, lambda x: x != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(stripped(c)))


def judged_score(c: Column) -> Column:
    """The first number of a reply, held within 0 and 10; 5 without one."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"\d+(?:\.\d+)?", 0)
    return F.when(found != "", F.least(F.lit(10.0), F.nullif(found, F.lit("")).cast("double"))).otherwise(5.0)


def narrow(c: Column) -> Column:
    """Wide Latin letters as plain ones, invisible characters out."""
    return F.regexp_replace(F.translate(c, WIDE, NARROW), INVISIBLE, "")


def filtered(c: Column, patterns: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(text with each pattern's matches replaced in turn, names of the patterns that matched)."""
    names: list[Column] = []
    for pattern, name in patterns:
        names.append(F.when(c.rlike("(?i)" + pattern), F.lit(name)))
        c = F.regexp_replace(c, F.lit("(?i)" + pattern), F.lit("[FILTERED]"))
    return c, F.array_compact(F.array(*names))


def sanitised(c: Column, patterns: Sequence[tuple[str, str]], greeting: str = "안녕하세요") -> tuple[Column, Column]:
    """Injection patterns filtered from a normalised query; a greeting where under five characters are left."""
    text, found = filtered(narrow(nfc(c)), patterns)
    rest = stripped(F.replace(text, F.lit("[FILTERED]"), F.lit("")))
    return F.when((F.size(found) > 0) & (F.length(rest) < 5), F.lit(greeting)).otherwise(text), found


def matching_types(c: Column, families: dict[str, Sequence[str]], default: str) -> Column:
    """Names of the pattern families that match, in order; ``default`` alone if none does."""
    found = F.array_compact(F.array(*[F.when(F.lower(c).rlike("|".join(p)), F.lit(n)) for n, p in families.items()]))
    return F.when(F.size(F.coalesce(found, F.array().cast("array<string>"))) > 0, found).otherwise(F.array(F.lit(default)))


def quoted(c: Column) -> Column:
    """What stands in quotes, then what stands in corner brackets."""
    return F.concat(F.regexp_extract_all(c, F.lit("['\"](.*?)['\"]"), F.lit(1)), F.regexp_extract_all(c, F.lit("「(.+?)」"), F.lit(1)))


def law_references(c: Column) -> Column:
    """Distinct (law_name, article_ref) in order: a bracketed name and the article in the 50 characters after it."""
    spans = F.regexp_extract_all(c, F.lit("([「『][^」』]+[」』])"), F.lit(1))
    # a fold over the names, each time moving behind the name
    step = F.aggregate(
        spans,
        F.struct(c.alias("rest"), F.array().cast("array<struct<law_name:string,article_ref:string>>").alias("out")),
        lambda acc, s: F.struct(
            F.substr(acc["rest"], F.instr(acc["rest"], s) + F.length(s)).alias("rest"),
            F.array_append(
                acc["out"],
                F.struct(
                    stripped(F.substr(s, F.lit(2), F.length(s) - 2)).alias("law_name"),
                    F.nullif(F.regexp_extract(F.substr(acc["rest"], F.instr(acc["rest"], s) + F.length(s), F.lit(50)), r"제\d+(?:의\d+)?조", 0), F.lit("")).alias("article_ref"),
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.array_distinct(step)


def page_edge(c: Column) -> Column:
    """A page head or foot, or a page number alone."""
    c = stripped(c)
    return c.rlike("|".join(PAGE_EDGES)) | c.rlike(r"^\d+$")


def guide_text(c: Column) -> Column:
    """Without NUL, images, page type tags, fences and rules; blanks collapsed, lines stripped, one blank line at most."""
    c = F.translate(F.coalesce(c, F.lit("")), "\0", " ")
    for pattern in GUIDE_MARKS:
        c = F.regexp_replace(c, pattern, "")
    c = F.array_join(F.transform(F.split(F.regexp_replace(c, r"[ \t]+", " "), "\n", -1), stripped), "\n")
    return stripped(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def shortened(c: Column, most: int = 60) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most), F.lit("…")))


def law_prefix(law: Column, number: Column, title: Column, most: int = 60) -> Column:
    """[law > 제n조(title)], without what is missing; empty without a law and an article."""
    filled = lambda c: F.coalesce(c, F.lit(""))
    law, number, title = shortened(filled(law), most), filled(number), filled(title)
    article = F.concat(F.lit("제"), number, F.lit("조"), F.when(title != "", F.concat(F.lit("("), title, F.lit(")"))).otherwise(""))
    return F.when(number != "", F.concat(F.lit("["), law, F.lit(" > "), article, F.lit("]"))).when(law != "", F.concat(F.lit("["), law, F.lit("]"))).otherwise("")


def references_to_end(c: Column) -> Column:
    """Table rows of references become notes behind the text, each once."""
    lines = F.split(c, "\n", -1)
    is_note = lambda x: F.startswith(x, F.lit("|")) & F.contains(x, F.lit("참고"))
    cell = lambda x: F.regexp_replace(x, r"^참고\s*", "※ 참고: ")
    cells = F.flatten(F.transform(F.filter(lines, is_note), lambda x: F.filter(F.transform(F.split(x, r"\|", -1), stripped), lambda y: y != "")))
    notes = F.array_distinct(F.transform(cells, cell))
    rest = F.filter(lines, lambda x: ~is_note(x))
    return F.array_join(F.when(F.size(notes) > 0, F.concat(rest, F.array(F.lit("")), notes)).otherwise(rest), "\n")


def admin_info(c: Column) -> Column:
    """struct(number, date) of the first (office-number, year.month.day.); empty texts without one."""
    pattern = r"\(([가-힣]+-\d+),\s*(\d{4}\.\d{1,2}\.\d{1,2})\.?\)"
    return F.struct(F.regexp_extract(c, pattern, 1).alias("number"), F.regexp_extract(c, pattern, 2).alias("date"))


def legal(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(LAW_CITATION)


def kept_parts(parts: Column, refusals: Sequence[str], least: int = 50) -> Column:
    """The parts without a refusal, joined; null where under ``least`` characters are left."""
    held = F.array_join(F.filter(parts, lambda p: ~F.exists(words(*refusals), lambda r: F.contains(p, r))), "\n")
    return F.when(F.length(held) >= least, held)


def plain_history(messages: Column, most: int = 20) -> Column:
    """The last messages (role, content) of user and assistant that are not blank, contents stripped."""
    clean = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), stripped(F.coalesce(m["content"], F.lit(""))).alias("content")))
    said = F.filter(clean, lambda m: m["role"].isin("user", "assistant") & (m["content"] != ""))
    return F.slice(said, F.greatest(F.size(said) - most + 1, F.lit(1)), most)
