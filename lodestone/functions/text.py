"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[一-鿿]"
#: Colloquial phrases and what they are searched as.
COLLOQUIAL = (("被动防御", "正当防卫"), ("被动防卫", "正当防卫"), ("自我防御", "正当防卫"), ("自我防卫", "正当防卫"))
#: Circled digits that stand for reference numbers.
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"


#: The characters that are white space in Unicode.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(c, F.lit(BLANKS))


def strip_column(c: Column) -> Column:
    """strip, for a column that is at hand: Spark's trim of the right end notes the places of all characters of a text, so only
    texts that end in white space are put through it."""
    ends = reduce(lambda x, y: x | y, (F.endswith(c, F.lit(b)) for b in BLANKS))
    return F.when(ends, strip(c)).otherwise(F.ltrim(c, F.lit(BLANKS)))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def collapse_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)[\s ]+", " "))


def preview(c: Column, size: int = 240) -> Column:
    """The stripped text; a longer one is cut to size - 1 characters and an ellipsis."""
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(s) <= size, s).otherwise(F.concat(rstrip(F.substring(s, 1, size - 1)), F.lit("…")))


def escape_like(c: Column) -> Column:
    return reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("\\" + s)), ("\\", "%", "_"), c)


def expand_colloquial(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), COLLOQUIAL, strip(c))


def strip_markdown(c: Column, depth: int = 3) -> Column:
    """Without pairs of ** and __ around text, nested `depth` deep at most; ideographic spaces become blanks."""
    pair = lambda x: F.regexp_replace(F.regexp_replace(x, r"\*\*(.+?)\*\*", "$1"), r"__(.+?)__", "$1")
    plain = F.replace(c, F.lit("　"), F.lit(" "))
    marked = F.contains(c, F.lit("**")) | F.contains(c, F.lit("__"))
    return strip(F.when(marked, reduce(lambda x, _: pair(x), range(depth), plain)).otherwise(plain))


def estimated_tokens(c: Column) -> Column:
    """A quarter of the characters, one at least, none for an empty text."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def dominant_identifier(c: Column) -> Column:
    """The first blank-separated token of six or more characters that is an identifier; null without one."""
    tokens = F.split(strip(c), r"(?U)[\s　]+")
    return F.get(F.filter(tokens, lambda t: (F.length(t) >= 6) & t.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]*$")), F.lit(0))


def latin_anchors(c: Column) -> Column:
    """Distinct blank-separated tokens of two or more characters with a letter or digit, in order."""
    tokens = F.split(strip(c), r"(?U)[\s　]+")
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 2) & t.rlike("[A-Za-z0-9]")))


def anchor_weight(t: Column) -> Column:
    """Weight of a matched anchor by script and length."""
    chinese = t.rlike(f"^{CJK}+$")
    n = F.length(t)
    return (
        F.when(chinese & (n >= 5), 3.0)
        .when(chinese & (n == 4), 2.5)
        .when(chinese & (n == 3), 2.0)
        .when(chinese & (n == 2), 1.5)
        .when(t.rlike("[A-Za-z0-9]"), F.when(n >= 6, 4.0).otherwise(1.2))
        .otherwise(1.0)
    )


def cited_references(c: Column) -> Column:
    """Distinct reference numbers [n], ［n］ and circled digits, in order of appearance."""
    found = F.regexp_extract_all(c, F.lit(rf"[\[［](\d+)[\]］]|([{CIRCLED}])"), F.lit(0))
    number = lambda x: F.when(F.length(x) == 1, F.instr(F.lit(CIRCLED), x)).otherwise(F.regexp_extract(x, r"(\d+)", 1).cast("int"))
    return F.array_distinct(F.transform(found, number))


#: What a site's furniture says, alone or in a short line.
FURNITURE = "(?i)^(视力保护色[:：]?|网站地图|无障碍|RSS订阅|分享到[:：]?)$"
POSITION, HOME = "当前位置|您现在所在的位置|您现在的位置", r"^首页( \S+){1,6}$"


def layout_noise(c: Column) -> Column:
    """Whether a text is page furniture: nothing, one character, a tick of up to three characters, a short e-mail address,
    or words of a site's navigation."""

    def noise(s: Column) -> Column:
        n = F.length(s)
        tick, address = (n <= 3) & s.rlike(r"(?U)^-?\d+$"), (n <= 32) & s.rlike(r"(?U)^[\w.+-]+@[\w.-]+\.\w+$")
        return (n <= 1) | tick | address | s.rlike(FURNITURE) | ((n <= 48) & s.rlike(POSITION)) | ((n <= 36) & s.rlike(HOME))

    # the text without repeated blanks is made once, not once for each pattern
    return F.get(F.transform(F.array(collapse_whitespace(F.coalesce(c, F.lit("")))), noise), F.lit(0))


def retrievable(c: Column) -> Column:
    """Whether a text is long enough or has any line that isn't furniture."""
    return (F.length(strip(c)) > 24) | F.exists(F.split(c, r"[\n\r]+"), lambda x: ~layout_noise(x))


def keyword_text(content: Column, keywords: Column, questions: Column) -> Column:
    """Content with its keywords and questions on lines of their own."""
    line = lambda name, xs: F.when(F.size(xs) > 0, F.concat(F.lit(name), F.array_join(xs, "；")))
    return F.concat_ws("\n", content, line("关键词：", keywords), line("问题：", questions))


def cleaned_terms(c: Column, limit: int) -> Column:
    """Stripped, non-blank, distinct in order, `limit` at most."""
    return F.slice(F.array_distinct(F.filter(F.transform(c, strip), lambda t: t != "")), 1, limit)


def duration_label(seconds: Column) -> Column:
    """A span as hours, minutes and seconds in words."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return (
        F.when(seconds.isNull(), "—")
        .when(seconds < 1, "不足 1 秒")
        .when(s < 60, F.format_string("%d 秒", s))
        .when(s < 3600, F.format_string("%d 分 %d 秒", m, r))
        .otherwise(F.format_string("%d 小时 %d 分 %d 秒", h, m, r))
    )


def excerpt(text: Column, start: Column, end: Column, margin: int = 320) -> Column:
    """The text around start..end with where the span lies in it and whether the sides were cut."""
    n = F.length(text)
    a, b = F.greatest(start - margin, F.lit(0)), F.least(end + margin, n)
    return F.struct(F.substr(text, a + 1, b - a).alias("excerpt"), (start - a).alias("from"), (end - a).alias("to"), (a > 0).alias("cut_before"), (b < n).alias("cut_after"))


def cache_key(model: Column, text: Column) -> Column:
    return F.sha2(F.concat(model.cast("string"), F.char(F.lit(0)), text), 256)


def chunk_uid(document_id: Column, index: Column) -> Column:
    """A chunk's name: document, position and a digest of both, so that a rebuild gives the same."""
    return F.concat(F.format_string("doc%d-%04d-", document_id, index), F.substring(F.sha2(F.concat_ws(":", document_id, index), 256), 1, 12))


def table_row(cells: Column, header: Column) -> Column:
    """`header：value` pairs, or the bare cells where there is no header."""
    pairs = F.zip_with(header, cells, lambda h, c: F.when(F.length(c) > 0, F.concat(h, F.lit("："), c)))
    return F.when(F.size(header) > 0, F.concat_ws("；", pairs)).otherwise(F.array_join(cells, " | "))
