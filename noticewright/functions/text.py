"""Scalar text functions as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

QUOTES = '"“”'
#: Unicode's white space.
UNICODE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = r"[\s,，。；;、]+"


def normalised(t: Column) -> Column:
    """Without any Unicode white space and double quotes, lower case."""
    return F.lower(F.translate(t, UNICODE_SPACE + QUOTES, ""))


def without_punctuation(t: Column) -> Column:
    """Without white space and common punctuation, lower case."""
    return F.lower(F.regexp_replace(t, r"""(?U)[\s,.;:!?"'()\[\]，。；：！？、“”‘’（）【】《》\-]+""", ""))


def folded_title(t: Column) -> Column:
    """Brackets of all widths become one kind, quotes go, white space goes."""
    return F.regexp_replace(F.translate(t, "（）【】〔〕", "()[][]"), r"(?U)[\s\"“”'《》]+", "")


def collapsed(t: Column) -> Column:
    """Runs of Unicode white space become one space; trimmed."""
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def tidy_lines(t: Column) -> Column:
    """Each line collapsed and trimmed, blank lines dropped."""
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t　 ]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def few_newlines(t: Column) -> Column:
    """Spaces collapsed, at most two newlines together, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\r", ""), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def no_tail_punctuation(t: Column) -> Column:
    return F.regexp_replace(t, r"[.,;:!?，。；：！？、\s]+$", "")


def no_ordinals(t: Column) -> Column:
    """Clause ordinals such as (1) or （一） go."""
    return F.regexp_replace(t, r"[（(][一二三四五六七八九十0-9]+[)）]", "")


def tokens(t: Column, shortest: int = 2) -> Column:
    """Lower-case tokens between separators, short ones dropped."""
    return F.filter(F.split(F.lower(t), SEPARATORS), lambda x: F.length(x) >= shortest)


def runs(t: Column, letters: str = "a-z", least: int = 2, most: int = 6) -> Column:
    """Runs of ``letters`` of bounded length."""
    return F.regexp_extract_all(t, F.lit(f"[{letters}]{{{least},{most}}}"), F.lit(0))


def summary(t: Column, size: int = 100) -> Column:
    """The collapsed text, cut to ``size`` characters and dots."""
    c = collapsed(t)
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def escaped_html(t: Column) -> Column:
    """The five special characters of HTML as references."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def hits(t: Column, words: list[str]) -> Column:
    """The ``words`` that ``t`` contains, in their order."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(t, w))


def any_word(words: list[str]) -> str:
    """A pattern of any of ``words``. Testing for the range of the words' first characters before the
    alternation makes one fast pass of texts in another script."""
    first = sorted({w[0] for w in words})
    low, high = [c for c in first if c < "\u0100"], [c for c in first if c >= "\u0100"]
    guard = "".join(re.escape(c) for c in low) + (f"{high[0]}-{high[-1]}" if high else "")
    return f"(?=[{guard}])(?:" + "|".join(re.escape(w) for w in words) + ")"


def contains_any(t: Column, words: list[str]) -> Column:
    return t.rlike(any_word(words))


def months(n: Column) -> Column:
    return F.substring(n.cast("string"), 1, 7)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def running_sums(numbers: Column) -> Column:
    """Sums of an array's first 1, 2, ... elements, in blocks, so that long arrays aren't copied for each."""
    block, none = 256, F.array().cast("array<int>")
    state = lambda at, out: F.struct(at.cast("int").alias("at"), out.alias("out"))
    inside = lambda b: F.aggregate(F.slice(numbers, b * block + 1, F.lit(block)), state(F.lit(0), none), lambda s, x: state(s["at"] + x, F.concat(s["out"], F.array((s["at"] + x).cast("int")))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / block).cast("int")), inside)
    offsets = F.aggregate(blocks, state(F.lit(0), none), lambda s, x: state(s["at"] + x["at"], F.concat(s["out"], F.array(s["at"]))), lambda s: s["out"])
    return F.when(F.size(numbers) == 0, none).otherwise(F.flatten(F.zip_with(blocks, offsets, lambda b, o: F.transform(b["out"], lambda v: v + o))))
