"""Terms of a question in two layers, as column expressions: anchors, of which a passage must hold one, and auxiliaries.

Anchors come from the pieces of Chinese text that question phrases leave over, and from tokens with a Latin letter or a
digit; auxiliaries are the pairs of neighbouring Chinese characters. Null texts have no terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CJK, anchor_weight, strip

# Phrases of questions, pairs of characters that mean nothing, words that say little alone, and what else
# stands for a word in a passage.
# fmt: off
TEMPLATES = (
    "如何", "怎么", "怎样", "咋样", "哪些", "什么", "是否", "能否", "可不可以", "有没有", "干嘛", "请问", "哪儿", "哪里", "多少",
    "为啥", "为什么", "办理", "申请", "查询", "相关", "有哪些", "是什么", "什么意思", "指的是", "一下", "帮我", "告诉",
)
NOISE = ("卫不", "不小", "小心", "心杀", "了对", "方需", "要判", "刑吗", "正当", "当防", "卫杀", "人需")
LOW_VALUE = (
    "对方", "需要", "可以", "应当", "进行", "规定", "下列", "以下", "其中", "之一", "或者", "以及", "并且", "根据", "按照", "予以",
    "对于", "依法", "情形",
)
ALIASES = {
    "杀了": ("杀人", "杀害", "致死", "死亡"),
    "判刑": ("有期徒刑", "刑罚", "刑事责任", "处刑"),
    "防卫": ("正当防卫", "防卫过当"),
    "防御": ("正当防卫", "防卫过当", "防卫"),
}
# fmt: on
MOST_FALLBACK = 24


def _runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({CJK}{{2,}})"), F.lit(1))


def _tokens(c: Column) -> Column:
    tokens = F.split(strip(c), r"(?U)[\s　]+")
    return F.filter(tokens, lambda t: (F.length(t) >= 2) & t.rlike("[A-Za-z0-9]"))


def entity_parts(c: Column) -> Column:
    """Distinct pieces of two or more characters that are left of runs of Chinese text without question phrases."""
    longest_first = sorted(TEMPLATES, key=len, reverse=True)
    peel = lambda run: reduce(lambda x, t: F.replace(x, F.lit(t), F.lit("|")), longest_first, run)
    pieces = F.flatten(F.transform(_runs(c), lambda run: F.split(peel(run), "[|]")))
    return F.array_distinct(F.filter(F.coalesce(pieces, F.array().cast("array<string>")), lambda p: F.length(p) >= 2))


def anchor_variants(part: Column) -> Column:
    """A piece with the beginnings and the ends that stand for it, by its length."""
    n, head, tail = F.length(part), lambda k: F.substring(part, 1, k), F.substring(part, -2, 2)
    return F.when(n == 4, F.array(part, head(3), tail, head(2))).when(n > 4, F.array(part, head(3), tail)).when(n == 3, F.array(part, head(2), tail)).otherwise(F.array(part))


def term_layers(c: Column) -> Column:
    """Struct of `anchors`, `required` (of which a passage must hold one, in full or in part) and `auxiliaries`."""
    parts = entity_parts(c)
    made = F.flatten(F.transform(parts, anchor_variants))
    anchors = F.array_distinct(F.concat(parts, made, F.coalesce(_tokens(c), F.array().cast("array<string>"))))
    anchors = F.filter(anchors, lambda a: (F.length(a) >= 2) & ~a.isin(*TEMPLATES))
    pair = lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2)))
    pairs = F.coalesce(F.flatten(F.transform(_runs(c), pair)), F.array().cast("array<string>"))
    pairs = F.filter(pairs, lambda p: ~p.isin(*TEMPLATES, *NOISE, *LOW_VALUE))
    return F.struct(anchors.alias("anchors"), F.when(F.size(parts) > 0, parts).otherwise(anchors).alias("required"), F.array_except(pairs, anchors).alias("auxiliaries"))


def layer_weight(term: Column, auxiliary: Column) -> Column:
    """What a matched term adds, as an anchor or as an auxiliary."""
    idle = term.isin(*TEMPLATES, *NOISE)
    weak = F.when(term.isin(*LOW_VALUE), 0.15).when(term.rlike(f"^{CJK}{{2}}$"), 0.45).when(term.rlike("[A-Za-z0-9]"), 0.35).otherwise(0.25)
    return F.when(idle, 0.0).when(auxiliary, weak).otherwise(anchor_weight(term))


def flat_weight(term: Column) -> Column:
    """What a matched term adds where there are no layers."""
    chinese = term.rlike(f"^{CJK}+$")
    n = F.length(term)
    weight = F.when(chinese & (n >= 4), 2.5).when(chinese & (n == 3), 2.0).when(chinese & (n == 2), 1.5)
    return F.when(term.isin(*NOISE), 0.0).when(term.isin(*LOW_VALUE), 0.35).otherwise(weight.when(term.rlike("[A-Za-z0-9]"), 1.2).otherwise(1.0))


def spellings(term: Column) -> Column:
    """The term and what else stands for it."""
    others = F.create_map(*(x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.concat(F.array(term), F.coalesce(others[term], F.array().cast("array<string>")))


def accepted_parts(part: Column) -> Column:
    """What satisfies a required piece: the piece, or its beginning, or for four characters its end."""
    n, head = F.length(part), lambda k: F.substring(part, 1, k)
    found = F.when(n >= 5, F.array(part, head(3))).when(n == 4, F.array(part, head(2), F.substring(part, -2, 2))).when(n == 3, F.array(part, head(2))).otherwise(F.array(part))
    return F.array_distinct(F.flatten(F.transform(found, spellings)))


def term_hits(text: Column, term: Column) -> Column:
    """Whether a passage holds the term in one of its spellings; letters count as they are."""
    return F.exists(spellings(term), lambda s: F.contains(text, s))


def layered_score(text: Column, layers: Column) -> Column:
    """The weights of all matched terms; 0 without anchors, or where the passage holds no required piece."""
    required = layers["required"]
    meets = (F.size(required) == 0) | F.exists(F.flatten(F.transform(required, accepted_parts)), lambda s: F.contains(text, s))
    total = lambda terms, auxiliary: F.aggregate(
        terms, F.lit(0.0), lambda a, t: a + F.when(term_hits(text, t), layer_weight(t, F.lit(auxiliary))).otherwise(0.0)
    )
    score = total(layers["anchors"], False) + total(layers["auxiliaries"], True)
    return F.coalesce(F.when((F.size(layers["anchors"]) > 0) & meets, score), F.lit(0.0))


def flat_score(text: Column, terms: Column) -> Column:
    return F.coalesce(F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.when(term_hits(text, t), flat_weight(t)).otherwise(0.0)), F.lit(0.0))


def fallback_terms(c: Column) -> Column:
    """Distinct anchors, auxiliaries, tokens and, alone, a single Chinese character, to search as substrings."""
    layers = term_layers(c)
    single = F.when(strip(c).rlike(f"^{CJK}$"), F.array(strip(c))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(layers["anchors"], layers["auxiliaries"], F.coalesce(_tokens(c), F.array().cast("array<string>")), single)), 1, MOST_FALLBACK)
