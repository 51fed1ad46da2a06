"""Fixed value tables: regions, target groups, subject words, organisations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import stripped

# Short, full and former names of the seventeen regions.
REGIONS = {
    "서울": "서울특별시",
    "부산": "부산광역시",
    "대구": "대구광역시",
    "인천": "인천광역시",
    "광주": "광주광역시",
    "대전": "대전광역시",
    "울산": "울산광역시",
    "세종": "세종특별자치시",
    "경기": "경기도",
    "충북": "충청북도",
    "충남": "충청남도",
    "전남": "전라남도",
    "경북": "경상북도",
    "경남": "경상남도",
    "제주": "제주특별자치도",
    "강원": "강원특별자치도",
    "전북": "전북특별자치도",
    "전라북도": "전북특별자치도",
    "강원도": "강원특별자치도",
}
NATIONWIDE = ("전국", "전 지역", "전지역", "전체", "해당없음")

# Words that mark a target group.
TARGETS = {
    "target_예비창업자": ("예비창업자", "예비 창업자", "예비창업"),
    "target_창업기업": ("창업기업", "초기창업", "창업초기", "신규창업", "창업 기업"),
    "target_중소기업": ("중소기업", "중견기업", "중소 기업"),
    "target_소상공인": ("소상공인", "소기업", "소규모"),
}
EVERYONE = "target_전체"

# Words of a subject, in order of precedence.
SUBJECT_WORDS = {
    "finance_tax": (
        "세법", "소득세", "법인세", "부가가치세", "국세", "세금", "세무",
        "조특법", "세액", "과세", "납세", "상속세", "증여세", "관세",
        "지방세", "종합부동산세", "인지세", "조세", "증권거래세",
    ),
    "hr_labor": (
        "근로", "노동", "고용", "임금", "퇴직", "해고", "휴가",
        "4대보험", "산재", "근로기준", "최저임금", "산업재해",
        "국민연금", "건강보험", "고용보험", "직업안정", "직업능력",
        "산업안전", "남녀고용평등",
    ),
    "startup_funding": (
        "창업", "벤처", "중소기업", "소상공인", "사업자", "법인설립",
        "업종", "인허가", "지원사업", "보조금", "정책자금", "공고", "융자",
        "특허", "상표", "저작권", "지식재산", "발명", "실용신안",
        "공정거래", "하도급",
    ),
    "general": (
        "민법", "상법", "행정절차", "행정심판", "전자상거래", "소비자",
        "개인정보", "정보통신", "전자서명",
    ),
}
ORGANISATIONS = {
    "고용노동부": "hr_labor",
    "기획재정부": "finance_tax",
    "국세청": "finance_tax",
    "중소벤처기업부": "startup_funding",
    "공정거래위원회": "startup_funding",
    "지식재산처": "startup_funding",
}
OVERRIDES = {"법인세": "finance_tax", "법인세법": "finance_tax"}
OVERRIDE_WEIGHT = 5


def region(c: Column) -> Column:
    """The full name of the region named or contained, the longest name first; empty for the whole country or none."""
    c = stripped(F.coalesce(c, F.lit("")))
    names = REGIONS | {full: full for full in REGIONS.values()}
    found = F.when(c.isin(*NATIONWIDE), "")
    for name, full in names.items():
        found = found.when(c == name, full)
    for name in sorted(names, key=len, reverse=True):
        found = found.when(F.contains(c, F.lit(name)), names[name])
    return found.otherwise("")


def target_flags(c: Column) -> dict[str, Column]:
    """``true`` or ``false`` for each target group; for everyone where no group is named."""
    c = F.coalesce(c, F.lit(""))
    hit = {flag: c.rlike("|".join(words)) for flag, words in TARGETS.items()}
    anyone = ~F.greatest(*[h.cast("int") for h in hit.values()]).cast("boolean")
    return {flag: F.when(h, "true").otherwise("false") for flag, h in (hit | {EVERYONE: anyone}).items()}


def subject(text: Column, organisation: Column | None = None, words: dict[str, tuple[str, ...]] | None = None, overrides: dict[str, str] | None = None) -> Column:
    """The organisation's subject, else the one with most words in the text (ties: the first declared), else ``etc``."""
    words = SUBJECT_WORDS if words is None else words
    overrides = OVERRIDES if overrides is None else overrides
    low = F.lower(F.coalesce(text, F.lit("")))
    scores = []
    for k, (name, own) in enumerate(words.items()):
        value = sum((F.contains(low, F.lit(w)).cast("int") for w in own), F.lit(0))
        value = sum((F.contains(low, F.lit(w)).cast("int") * OVERRIDE_WEIGHT for w, to in overrides.items() if to == name), value)
        scores.append(F.struct(value.alias("score"), F.lit(-k).alias("place"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scores))
    by_words = F.when(best["score"] > 0, best["name"]).otherwise("etc")
    if organisation is None:
        return by_words
    found = None
    for name, to in ORGANISATIONS.items():
        hit = F.contains(F.coalesce(organisation, F.lit("")), F.lit(name))
        found = F.when(hit, to) if found is None else found.when(hit, to)
    return found.otherwise(by_words)
