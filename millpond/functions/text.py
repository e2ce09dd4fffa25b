"""Text as other programs see it: full case folding, and JSON strings of ASCII characters alone."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Letters that fold to one other letter, and those that fold to several, as Unicode's full case folding has them."""
    folded = {c: c.casefold() for c in map(chr, range(0x20000)) if not 0xD800 <= ord(c) < 0xE000 and c.casefold() != c}
    return {c: f for c, f in folded.items() if len(f) == 1}, {c: f for c, f in folded.items() if len(f) > 1}


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def casefold(text: Column) -> Column:
    """The text without differences of case, which for letters such as the sharp s is more than lower case."""
    one, several = _foldings()
    simple = F.translate(text, "".join(one), "".join(one.values()))
    longer = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), several.items(), simple)
    return F.when(_is_ascii(text), F.lower(text)).when(text.rlike(f"[{''.join(several)}]"), longer).otherwise(simple)


def holds(text: Column, wanted: str) -> Column:
    """Case-folded search; the wanted text stands for itself, wildcards included.

    Only letters that fold to something of the wanted text can matter, so a text is folded whole only where it holds one that
    folds to several letters with some of them.
    """
    folded = wanted.casefold()
    one, several = _foldings()
    alike = {c: c + "".join(v for v, f in one.items() if f == c) for c in set(folded)}
    longer = [c for c, f in several.items() if set(f) & set(folded)]
    if not longer and all(len(same) == 1 for same in alike.values()):
        return F.contains(text, F.lit(folded))
    found = text.rlike("".join(f"[{_points(alike[c])}]" for c in folded))
    if longer:
        found = F.when(text.rlike(f"[{_points(longer)}]"), F.contains(casefold(text), F.lit(folded))).otherwise(found)
    return F.when(_is_ascii(text), F.contains(F.lower(text), F.lit(folded))).otherwise(found)


def _points(letters: Iterable[str]) -> str:
    """Letters as code points of a pattern, which none of them can end or escape."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in letters)


# The characters that JSON writes with a short escape.
SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))


def _escaped(char: Column) -> Column:
    code = F.ascii(char).cast("bigint")
    above = code - 0x10000
    pair = F.concat(_unit(F.shiftright(above, 10) + 0xD800), _unit(above.bitwiseAND(0x3FF) + 0xDC00))
    short = reduce(lambda e, pair: e.when(char == pair[0], pair[1]), SHORT.items(), F.when(F.lit(False), ""))
    return short.when(code.between(32, 126), char).when(code < 0x10000, _unit(code)).otherwise(pair)


def json_ascii(text: Column) -> Column:
    """A JSON string whose other characters are `\\uXXXX`, in pairs beyond the first plane; `null` for null."""
    plain = ~text.rlike(r'[^ !#-\[\]-~]')
    inner = F.when(plain, text).otherwise(F.array_join(F.transform(F.split(text, ""), _escaped), ""))
    return F.coalesce(F.concat(F.lit('"'), inner, F.lit('"')), F.lit("null"))
