"""Search terms, gates and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CJK, strip


def search_terms(c: Column) -> Column:
    """Runs of two or more Chinese characters and Latin words of two or more, distinct; the text's first 64 characters
    where there are none."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(rf"{CJK}{{2,}}|[A-Za-z0-9]{{2,}}"), F.lit(0)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.substring(strip(c), 1, 64)))


def expanded_terms(terms: Column) -> Column:
    """Chinese terms over four characters give way to their pairs of characters."""
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))
    return F.array_distinct(F.flatten(F.transform(terms, lambda t: F.when((F.length(t) > 4) & t.rlike(f"^{CJK}+$"), pairs(t)).otherwise(F.array(t)))))


def least_matches(terms: Column) -> Column:
    """How many terms a hit must hold: one of up to two, else a quarter, from two to three."""
    n = F.size(terms)
    return F.when(n <= 2, 1).otherwise(F.least(F.lit(3), F.greatest(F.lit(2), F.floor(n / 4)))).cast("long")


def cjk_share(c: Column, first: int = 80_000) -> Column:
    """Share of Chinese characters among the first characters."""
    head = F.substring(c, 1, first)
    return F.when(F.length(head) > 0, F.regexp_count(head, F.lit(CJK)) / F.length(head)).otherwise(0.0)


def indexable(c: Column, most: int = 3_000_000) -> Column:
    """Why a text can't be indexed: 'empty' or 'too long'; null if it can."""
    n = F.length(strip(F.coalesce(c, F.lit(""))))
    return F.when(n == 0, "empty").when(n > most, "too long")


def placeholder_share(c: Column) -> Column:
    """Share of a text's non-blank lines that are image placeholders."""
    lines = F.filter(F.split(c, "\n", -1), lambda x: strip(x) != "")
    marks = F.filter(lines, lambda x: strip(x).rlike(r"^!\[[^\]]*\]\([^)]*\)$"))
    return F.when(F.size(lines) > 0, F.size(marks) / F.size(lines)).otherwise(0.0)


def location_label(path: Column, block: Column, page: Column) -> Column:
    """The last heading, else the block's name, else the page after the first."""
    last = strip(F.element_at(F.filter(F.split(F.coalesce(path, F.lit("")), " / "), lambda x: strip(x) != ""), -1))
    has = F.size(F.filter(F.split(F.coalesce(path, F.lit("")), " / "), lambda x: strip(x) != "")) > 0
    return (
        F.when(has, last)
        .when(block == "image", "图片 OCR")
        .when(block == "document_preamble", "文前")
        .when(block == "table", "表格")
        .when(page > 1, F.format_string("第 %d 页", page))
    )


def with_prefix(text: Column, prefix: Column) -> Column:
    """The text after its context, unless it starts with or holds the context's beginning."""
    p = strip(F.coalesce(prefix, F.lit("")))
    there = F.contains(text, F.substring(p, 1, 24))
    return F.when((p == "") | there, text).otherwise(F.concat(p, F.lit("\n\n"), text))


def flipped_box(box: Column, height: Column) -> Column:
    """A box with its origin moved between the bottom and the top of a page."""
    return F.array(box[0], height - box[3], box[2], height - box[1])


def plausible_header(cells: Column) -> Column:
    """Whether all cells are filled and short."""
    return (F.size(cells) > 0) & F.forall(cells, lambda c: (F.length(strip(c)) > 0) & (F.length(c) <= 40))


def suffixed_name(name: Column, suffix: str, most: int = 200) -> Column:
    return F.concat(F.substring(name, 1, most - len(suffix)), F.lit(suffix))


def prepared_for_embedding(c: Column, most: int = 8192) -> Column:
    """Without control characters, stripped and cut; a blank text is one blank."""
    s = F.substring(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")), 1, most)
    return F.when(s == "", " ").otherwise(s)


def skips_retrieval(c: Column) -> Column:
    """Whether a message is a greeting or asks what the assistant is."""
    s = F.lower(F.regexp_replace(strip(c), r"(?U)[\s!?.,。！？，~～]+$", ""))
    greeting = s.rlike(r"^(你好|您好|嗨|hi|hello|hey|在吗|早上好|下午好|晚上好|谢谢|thanks|thank you)$")
    return greeting | s.contains("what can you do") | s.contains("who are you") | s.contains("你是谁") | s.contains("你能做什么")
