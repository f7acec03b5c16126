"""Parameters and word lists. Word lists are data: pass another Lexicon for other languages."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 5
    candidate_pool: int = 120
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 10
    vector_weight: float = 0.25
    bm25_weight: float = 1.0
    rrf_weight: float = 1.0
    coverage_weight: float = 0.08
    phrase_weight: float = 0.12
    numeric_weight: float = 0.04

    def __post_init__(self):
        if self.top_k <= 0 or self.candidate_pool < self.top_k:
            raise ValueError("candidate_pool >= top_k > 0 is required")
        if self.rrf_k <= 0:
            raise ValueError("rrf_k must be positive")
        if self.k1 <= 0 or not 0 <= self.b <= 1:
            raise ValueError("k1 > 0 and 0 <= b <= 1 are required")
        if self.vector_weight < 0 or self.bm25_weight < 0 or self.vector_weight + self.bm25_weight == 0:
            raise ValueError("fusion weights must not be negative, nor both be 0")


@dataclass(frozen=True)
class AnswerConfig:
    max_citations: int = 5
    max_quote_chars: int = 800
    least_coverage: float = 0.08
    relative_score: float = 0.7

    def __post_init__(self):
        if self.max_citations <= 0 or self.max_quote_chars <= 0 or not 0 <= self.relative_score <= 1 or not 0 <= self.least_coverage <= 1:
            raise ValueError("answer settings are out of range")


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 800
    overlap: int = 150
    target: int = 700
    most: int = 1000
    structured_overlap: int = 120
    unit: int = 400

    def __post_init__(self):
        if not 0 <= self.overlap < self.size:
            raise ValueError("0 <= overlap < size is required")
        if not 0 < self.target <= self.most:
            raise ValueError("0 < target <= most is required")
        if not 0 <= self.structured_overlap < self.target:
            raise ValueError("0 <= structured_overlap < target is required")
        if not 0 < self.unit <= self.most:
            raise ValueError("0 < unit <= most is required")


# The default word lists, patterns and texts.
ALIASES = {
    "归母净利润": "归属于上市公司股东的净利润",
    "研发资金": "研发投入金额",
    "员工人数": "在职员工数量",
    "经营现金流": "经营活动产生的现金流量净额",
    "现金流": "现金流量",
    "分红": "现金红利利润分配",
    "海外": "境外出口",
    "占总收入": "占营业收入比重",
    "汽车相关业务": "汽车汽车相关产品及其他产品业务",
    "手机部件业务": "手机部件组装及其他产品业务",
}
TERMS = ("营业收入", "净利润", "现金红利", "研发投入", "研发人员", "客户", "境外收入", "在职员工", "审计意见", "存货", "汽车相关产品", "手机部件", "政府补助", "担保", "现金流量净额")
COMPONENTS = {
    "归母净利润": ("归属于上市公司股东", "净利润"),
    "境外收入": ("境外", "收入"),
    "汽车相关业务": ("汽车", "相关产品", "收入"),
    "手机部件业务": ("手机部件", "收入"),
    "经营现金流": ("经营活动", "现金流量净额"),
    "存货余额": ("存货", "账面价值"),
    "实际提供的担保": ("本公司", "子公司", "实际提供", "担保"),
}
ADVICE = ("应该.*买", "应该.*卖", "是否值得投资", "投资建议", "目标价", "股价.*(?:涨|跌)", "预测.*股价", "推荐.*股票")
CHAPTERS = ("^第[一二三四五六七八九十百]+节\\s+.+$", "^第[一二三四五六七八九十百]+章\\s+.+$", "^[一二三四五六七八九十]+、\\s*[^，。；]{2,40}$")
HEADING = "^(?:第[一二三四五六七八九十百]+[章节]|[一二三四五六七八九十]+、)"
PRINTED = ("^\\s*[-—–]?\\s*(\\d{1,4})\\s*[-—–]?\\s*$", "^\\s*第\\s*(\\d{1,4})\\s*页\\s*$")
RULES = (
    "你是上市公司年报信息整理助手。必须遵守：",
    "1. 只能使用下方证据，不得使用外部知识或猜测。",
    "2. 每个事实结论后标注对应证据编号，如[证据1]。",
    "3. 数值必须同时说明公司、年度和单位；证据未给出单位时不得自行补充。",
    "4. 先区分合并口径与母公司口径、期末余额与发生额、当年预案与往年已实施方案；只有相同口径的数值不一致才属于冲突。",
    "5. 证据不足以回答时只回答“现有证据不足，无法回答该问题”。",
    "6. 不提供投资建议、估值、股价预测或买卖建议。",
    "7. 资产负债表问题只问“余额”而未明确“账面余额/原值”时，回答合并口径的期末账面价值（扣除减值准备后的列报金额），并说明该口径。",
    "8. “同比增长/下降多少”默认询问同比变动比例；证据已直接给出比例时应直接回答，不要因无法计算绝对变动额而拒答。",
)
EVIDENCE_ONLY = "当前未配置LLM，以下是与问题最相关的年报原文证据："
#: What a question has, and what a text needs to have then.
INTENTS = (
    ("年末|余额", "年末|12\\s*月\\s*31\\s*日|期末"),
    ("拟|预案", "预案"),
    ("占|比例|比重", "占.*(?:比例|比重)|\\d+(?:\\.\\d+)?%"),
    ("公司为子公司|实际提供的担保", "本公司为其?子公司实际提供的担保"),
    ("营业收入", "营业收入(?:合计)?（?元）?"),
)
IGNORED = ("公司", "比亚迪", "2025", "多少", "如何", "什么", "的是", "是否")


# The fields' defaults.
@dataclass(frozen=True)
class Lexicon:
    aliases: dict[str, str] = field(default_factory=lambda: dict(ALIASES))
    terms: tuple[str, ...] = TERMS
    components: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(COMPONENTS))
    advice: tuple[str, ...] = ADVICE
    chapters: tuple[str, ...] = CHAPTERS
    printed: tuple[str, ...] = PRINTED
    heading: str = HEADING
    sentence_ends: str = "。！？；"
    natural_end: str = "[。！？；：]$"
    numeric_inner: str = "多少|金额|比例|同比|增长|下降|余额|人数|分别"
    numeric_outer: str = "多少|金额|比例|同比|增长|下降|余额|人数"
    units: str = "%|元|万元|百万元|千元|人|股"
    toc_start: str = "目录"
    toc_mark: str = "第"
    tables: tuple[str, ...] = ("合并资产负债表", "合并利润表", "合并现金流量表")
    not_body: tuple[str, ...] = ("资产负债表", "利润表", "现金流量表", "目录")
    body_chapter: str = "管理层讨论与分析"
    unit_pattern: str = "财务附注中报表的单位为[：:]\\s*([^\\s，。；]+)"
    unit_prefix: str = "财务附注报表单位为"
    report_word: str = "年度报告"
    ignored: tuple[str, ...] = IGNORED
    insufficient: str = "证据不足|无法回答|不能回答"
    citation: str = "\\[证据(\\d+)\\]"
    citation_label: str = "证据"
    unknown: str = "unknown"
    proposal: str = "拟"
    dividend: str = "分红"
    plan_suffix: str = "年度利润分配预案"
    year_in_query: str = "(20\\d{2})年"
    intents: tuple[tuple[str, str], ...] = INTENTS
    intent_proposal: str = "拟|预案"
    plan_years: str = "(20\\d{2})年度利润分配"
    plan_done: str = "实施完毕|已实施"


def settings(path: str, section: str) -> dict:
    """The settings of a section of a configuration file: JSON, or YAML as far as sections of plain ``key: value`` lines go.

    They are passed on by name, for instance ``RetrievalConfig(**settings(path, "retrieval"))``, which checks them.
    """
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        return dict(json.loads(text)[section])
    except json.JSONDecodeError:
        pass
    found, inside = {}, False
    for line in text.splitlines():
        plain = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not plain:
            continue
        key, _, value = plain.strip().partition(":")
        if not line[0].isspace():
            inside = key == section
        elif inside and value.strip():
            word = value.strip().strip("'\"")
            number = re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", value.strip())
            found[key.strip()] = (float(word) if number[1] else int(word)) if number else {"true": True, "false": False}.get(word.lower(), word)
    if not found:
        raise KeyError(f"{path} has no section {section!r}")
    return found


#: For the tables of TESTDATA.md, which have no Chinese: same operators, other words.
LATIN = Lexicon(
    aliases={"licence": "licensed under", "mail": "example.com", "the than": "thhasted", "ention": "mentelle"},
    terms=("the", "and", "license", "token", "des", "der", "los"),
    components={"the": ("th", "he"), "tion": ("ti", "on", "or"), "que": ("qu", "ue")},
    advice=("stupid", "idiot.*", "worthless", "trash"),
    chapters=("^(Licensed|Released) under .+$", "^This work is .+$"),
    heading="^(?:Licensed|Released|This work)",
    sentence_ends=".!?;",
    natural_end="[.!?;:]$",
    numeric_inner="the|des|der|los|and",
    numeric_outer="the|des|der|los",
    units="%|th|st",
    toc_start="The",
    toc_mark="th",
    tables=("Apache License", "MIT License"),
    not_body=("token", "@"),
    body_chapter="License",
    unit_pattern="token = \"([0-9a-f]+)",
    unit_prefix="unit ",
    report_word="the",
    ignored=("the", "and"),
    citation_label="E",
    citation="\\[E(\\d+)\\]",
    intents=(("the|ent", "and|of"), ("des|der", "[0-9]+%|des"), ("license|token", "Apache|MIT")),
    intent_proposal="ention",
    plan_done="Apache License",
    proposal="license",
    dividend="the",
)
