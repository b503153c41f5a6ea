"""Domain glossary: acronyms, entities by type and typed relations, as plain values and as small tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ACRONYM, acronyms, has_word

# Fixed values of the default glossary (capital markets, in Korean).
ACRONYMS = {
    "FSC": "금융위원회", "SFC": "증권선물위원회", "FSS": "금융감독원", "KRX": "한국거래소", "KSD": "한국예탁결제원", "KOFIA": "금융투자협회", "KOSCOM": "코스콤",
    "DART": "전자공시시스템", "XBRL": "재무정보표준화언어", "IFRS": "국제회계기준", "K-IFRS": "한국채택국제회계기준",
    "KOSPI": "코스피", "KOSDAQ": "코스닥", "KONEX": "코넥스",
    "PER": "주가수익비율", "PBR": "주가순자산비율", "EPS": "주당순이익", "BPS": "주당순자산", "DPS": "주당배당금", "ROE": "자기자본이익률", "ROA": "총자산이익률",
    "ETF": "상장지수펀드", "ETN": "상장지수증권", "ELS": "주가연계증권", "ELW": "주식워런트증권", "DLS": "파생결합증권", "MMF": "머니마켓펀드", "CMA": "종합자산관리계좌", "ISA": "개인종합자산관리계좌", "IRP": "개인형퇴직연금", "CB": "전환사채", "BW": "신주인수권부사채", "RCPS": "상환전환우선주",
    "IPO": "기업공개", "SPAC": "기업인수목적회사", "IR": "기업설명회", "AGM": "주주총회", "ESG": "환경사회지배구조",
}
ENTITIES = {
    "INSTITUTION": ["금융위원회", "증권선물위원회", "금융감독원", "한국거래소", "한국예탁결제원", "금융투자협회", "코스콤", "한국회계기준원", "한국상장회사협의회", "코스닥협회"],
    "LAW": ["자본시장법", "외부감사법", "상법", "금융소비자보호법", "신용정보법", "공정공시규정", "유가증권시장공시규정", "코스닥시장공시규정"],
    "PRODUCT": ["주식", "채권", "펀드", "상장지수펀드", "상장지수증권", "주가연계증권", "주식워런트증권", "파생결합증권", "부동산투자회사", "머니마켓펀드", "종합자산관리계좌", "개인종합자산관리계좌", "개인형퇴직연금", "전환사채", "신주인수권부사채", "상환전환우선주", "선물", "옵션"],
    "EVENT": ["기업공개", "유상증자", "무상증자", "자사주매입", "배당", "인수합병", "공매도", "주주총회", "기업설명회", "사업보고서", "분기보고서", "감사보고서", "정정공시", "공정공시"],
    "INDEX": ["코스피200", "코스피", "코스닥", "코넥스"],
}
# Fixed order of edge types (ties go to the first) and of relations (the first of a pair counts).
EDGE_TYPES = ["SUPERVISES", "GOVERNED_BY", "ISSUES", "LISTED_ON", "CALCULATES", "REQUIRES", "CLASSIFIES", "DISCLOSES", "UNTYPED"]
RELATIONS = [
    ("한국거래소", "CALCULATES", "코스피200"),
    ("한국거래소", "CALCULATES", "코스피"),
    ("한국거래소", "CALCULATES", "코스닥"),
    ("공매도", "LISTED_ON", "한국거래소"),
    ("기업공개", "LISTED_ON", "한국거래소"),
    ("코스피200", "LISTED_ON", "한국거래소"),
    ("자본시장법", "REQUIRES", "사업보고서"),
    ("자본시장법", "REQUIRES", "분기보고서"),
    ("외부감사법", "REQUIRES", "감사보고서"),
    ("자본시장법", "CLASSIFIES", "파생결합증권"),
    ("자본시장법", "CLASSIFIES", "주가연계증권"),
    ("자본시장법", "CLASSIFIES", "상장지수증권"),
    ("주가연계증권", "GOVERNED_BY", "자본시장법"),
    ("상장지수펀드", "GOVERNED_BY", "자본시장법"),
    ("공매도", "GOVERNED_BY", "자본시장법"),
    ("금융위원회", "SUPERVISES", "한국거래소"),
    ("금융감독원", "SUPERVISES", "한국거래소"),
    ("금융감독원", "SUPERVISES", "사업보고서"),
]
# Fixed patterns of a law's name with an optional decree, and of the decree, which is cut off.
LAW = "[가-힣]{2,}법(?![인률])(?:\\s*시행령|\\s*시행규칙)?"
DECREE = "\\s*(시행령|시행규칙)$"


@dataclass(frozen=True)
class Glossary:
    """What entity extraction, typed edges and query rewriting know; ``law_rule`` adds names by pattern."""

    acronyms: dict[str, str] = field(default_factory=lambda: dict(ACRONYMS))
    entities: dict[str, list[str]] = field(default_factory=lambda: {k: list(v) for k, v in ENTITIES.items()})
    relations: list[tuple[str, str, str]] = field(default_factory=lambda: list(RELATIONS))
    law_rule: bool = True

    def names(self) -> list[str]:
        """Every entity once, in order."""
        return list(dict.fromkeys(x for xs in self.entities.values() for x in xs))

    def type_of(self, name: str) -> str | None:
        return next((kind for kind, xs in self.entities.items() if name in xs), None)

    def relation(self, a: str, b: str) -> str | None:
        """Of the first relation between two entities, whichever way it points."""
        return next((t for x, t, y in self.relations if {x, y} == {a, b}), None)

    def extract(self, text: str | None) -> set[str]:
        """Entities of one text: names it contains, full names of its acronyms, laws by pattern."""
        text = text or ""
        laws = re.findall(LAW, text) if self.law_rule else []
        short = re.findall(ACRONYM, text, re.ASCII)
        return {x for x in self.names() if x in text} | {self.acronyms[a] for a in short if a in self.acronyms} | {re.sub(DECREE, "", " ".join(x.split())) for x in laws}

    def rewrite(self, query: str | None) -> str | None:
        """The query and, in the glossary's order, what it lacks of an acronym and its full name."""
        if query is None or not query.strip():
            return query
        added = []
        for short, full in self.acronyms.items():
            has = (re.search(rf"\b{re.escape(short)}\b", query, re.ASCII) is not None, full in query)
            added += {(True, False): [full], (False, True): [short]}.get(has, [])
        return " ".join([query, *added])

    def rewritten(self, questions: DataFrame, column: str = "question", into: str = "asked") -> DataFrame:
        """``rewrite`` for a column of questions, as expressions over the glossary's literals."""
        query, added = F.col(column), []
        for short, full in self.acronyms.items():
            has = has_word(query, F.lit(short))
            added += [F.when(has & ~query.contains(full), F.lit(full)), F.when(~has & query.contains(full), F.lit(short))]
        told = F.concat_ws(" ", query, *added) if added else query
        return questions.withColumn(into, F.when(query.isNull() | (F.regexp_replace(query, "\\s", "") == ""), query).otherwise(told))

    def entity_table(self, spark: SparkSession) -> DataFrame:
        rows = [(x, self.type_of(x), i) for i, x in enumerate(self.names())]
        return spark.createDataFrame(rows, "entity string, type string, ord int")

    def acronym_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a, f, i) for i, (a, f) in enumerate(self.acronyms.items())], "acronym string, full string, ord int")

    def relation_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(a, t, b, i) for i, (a, t, b) in enumerate(self.relations)], "src string, type string, dst string, ord int")


def article_entities(articles: DataFrame, glossary: Glossary | None = None, text: str = "text") -> DataFrame:
    """(namespace, id, entity), each once: names that ``text`` contains, full names of its acronyms, laws by pattern.

    The glossary is one literal array (its size is the glossary's, not the data's), so there is no join and no shuffle but the last
    distinct's; entities of an article are found in its own row.
    """
    own = glossary or Glossary()
    names = F.filter(F.lit(own.names()), lambda e: F.col(text).contains(e))
    found = names
    if own.acronyms:
        pairs = F.create_map(*[F.lit(x) for kv in own.acronyms.items() for x in kv])
        found = F.concat(found, F.filter(F.transform(acronyms(F.col(text)), lambda a: pairs[a]), lambda x: x.isNotNull()))
    if own.law_rule:
        laws = F.regexp_extract_all(text, F.lit(LAW), F.lit(0))
        found = F.concat(found, F.transform(laws, lambda x: F.regexp_replace(F.regexp_replace(x, "\\s+", " "), DECREE, "")))
    return articles.select("namespace", "id", F.explode(F.array_distinct(found)).alias("entity"))
