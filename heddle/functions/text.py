"""Text functions as column expressions. Nulls read as '' where the function says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation (fixed values).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Full-width and CJK punctuation (fixed values).
CJK_PUNCTUATION = "！？｡。＂＃＄％＆＇（）＊＋，－／：；＜＝＞＠［＼］＾＿｀｛｜｝～｟｠｢｣､、〃》「」『』【】〔〕〖〗〘〙〚〛〜〝〞〟〰〾〿–—‘’‛“”„‟…‧﹏."


def filled(s: Column) -> Column:
    return F.coalesce(s.cast("string"), F.lit(""))


def squeeze(s: Column, by: str = " ") -> Column:
    """Runs of white space become `by`, none at the ends."""
    return F.regexp_replace(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", by)


def casefold(s: Column) -> Column:
    """Lower case for comparison, with the sharp s as ss; other letters that fold to several stay as they are."""
    return F.replace(F.lower(filled(s)), F.lit("ß"), F.lit("ss"))


def tokens(s: Column) -> Column:
    return F.array_remove(F.split(filled(s), r"(?U)\s+"), "")


def normalize_answer(s: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces, in this order."""
    plain = F.translate(F.lower(filled(s)), PUNCTUATION, "")
    return squeeze(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "))


def normalize_zh(s: Column) -> Column:
    """Lower case, no ASCII or CJK punctuation, no white space."""
    return F.regexp_replace(F.translate(F.lower(filled(s)), PUNCTUATION + CJK_PUNCTUATION, ""), r"(?U)\s+", "")


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def strip_control(s: Column) -> Column:
    return strip(F.regexp_replace(strip(filled(s)), r"[\x00-\x1f]", ""))


def digits_all(s: Column) -> Column:
    return F.regexp_extract_all(filled(s), F.lit("([0-9]+)"), F.lit(1))


def first_int(s: Column) -> Column:
    return F.regexp_extract(filled(s), "[0-9]+", 0)


def last_choice(s: Column, letters: str = "A-J") -> Column:
    """The last letter of the first line that holds one and is followed by none on that line; '' if there is none."""
    return F.regexp_extract(filled(s), rf"\b[{letters}]\b(?!.*\b[{letters}]\b)", 0)


def hex_ids(s: Column) -> Column:
    """12-digit hexadecimal identifiers, also after v_, that no letter or digit touches."""
    return F.regexp_extract_all(F.lower(filled(s)), F.lit(r"(?<![a-z0-9])(?:v_)?([a-f0-9]{12})(?![a-z0-9])"), F.lit(1))


def spaced(s: Column, chars: str) -> Column:
    return F.translate(filled(s), chars, " " * len(chars))


def boxed(s: Column, last: bool) -> Column:
    """Text after the first or last `boxed{` up to the next brace; without one, null for the first and the text for the last."""
    parts = F.split(filled(s), r"boxed\{")
    part = F.element_at(parts, -1) if last else F.get(parts, F.lit(1))
    return F.get(F.split(part, r"\}"), F.lit(0))


def first_code_line(s: Column) -> Column:
    """The first line without a backtick, # or //, line feeds in front left out; '' if there is none."""
    lines = F.split(F.regexp_replace(filled(s), r"^\n+", ""), "\n")
    return F.coalesce(F.get(F.filter(lines, lambda x: ~x.rlike("[`#]|//")), F.lit(0)), F.lit(""))


def preview(s: Column, most: int = 160) -> Column:
    one = squeeze(filled(s))
    return F.when(F.length(one) > most, F.concat(F.left(one, F.lit(most - 3)), F.lit("..."))).otherwise(one)


def head_and_tail(s: Column, most: int, marker: str) -> Column:
    half = most // 2
    return F.when(F.length(s) > most, F.concat(F.left(s, F.lit(half)), F.lit(marker), F.right(s, F.lit(half)))).otherwise(s)


def token_count(s: Column) -> Column:
    """Tokens by the rule of thumb of four characters each, 1 at the least."""
    return F.greatest(F.lit(1), F.floor(F.length(filled(s)) / 4)).cast("long")


def insert_at(body: Column, what: Column, at: Column) -> Column:
    return F.concat(F.substring(body, F.lit(1), at), what, F.substring(body, at + 1, F.length(body)))


def html_paragraphs(html: Column) -> Column:
    """The text of all paragraphs, tags left out."""
    found = F.regexp_extract_all(filled(html), F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    return F.array_join(F.transform(found, lambda x: F.regexp_replace(x, "<[^>]*>", "")), "")
