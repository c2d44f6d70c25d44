"""Scalar expressions: text keys, money, formulas, local time, URLs."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def collapse(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\x0B\f]+", " "))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\n\r\x0B\f]+", "")


def name_key(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """Collapsed and lower-cased name, through the alias map if it has it."""
    key = F.lower(collapse(text))
    return aliased(key, aliases) if aliases else key


#: White space between words, of any script.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@functools.lru_cache(maxsize=1)
def _odd() -> str:
    """A class of the characters whose folded compatibility form the batch functions below give otherwise, as found by trying all, and of
    the marks that join what stands before them."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    chars = pa.array(map(chr, points))
    got = pc.utf8_lower(pc.utf8_normalize(chars, form="NFKC")).to_pylist()
    forms = [unicodedata.normalize("NFKC", chr(c)) for c in points]
    return "[" + "".join(f"\\x{{{c:x}}}" for c, x, form in zip(points, got, forms) if x != form.casefold() or unicodedata.combining(form[0])) + "]"


@F.arrow_udf(StringType())
def name_key_unicode(text: pa.Array) -> pa.Array:
    """The key for any script: compatibility form, white space collapsed, case-folded. Batch by batch; only rows with characters that fold
    in some other way than to lower case are taken one by one."""
    plain = pc.utf8_lower(pc.utf8_normalize(text, form="NFKC"))
    key = pc.utf8_trim(pc.replace_substring_regex(plain, SPACE, " "), " ")
    if not pc.any(pc.invert(pc.string_is_ascii(text))).as_py():
        return key
    odd = pc.fill_null(pc.match_substring_regex(text, _odd()), False)
    rows = text.filter(odd).to_pylist()
    return pc.replace_with_mask(key, odd, pa.array([" ".join(unicodedata.normalize("NFKC", x).split()).casefold() for x in rows], key.type))


def aliased(key: Column, aliases: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), key), key)


def money_text(value: Column) -> Column:
    return F.format_number(value, 0)


def money_value(text: Column) -> Column:
    """A whole amount with thousands separators; null if it isn't one."""
    return F.when(text.rlike(r"^[0-9]{1,3}(,[0-9]{3})*$|^[0-9]+$"), F.replace(text, F.lit(","), F.lit("")).cast("long"))


def neutralized(text: Column) -> Column:
    """A quote in front of what a spreadsheet would take for a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def kst_text(utc: Column) -> Column:
    return F.date_format(utc + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd HH:mm")


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])


def stat_value(text: Column) -> Column:
    """Digits, '?' as -1 and '-' as 0; null for anything else."""
    return F.when(text == "?", -1).when(text == "-", 0).when(text.rlike("^[0-9]+$"), text.cast("int"))


def softmax(values: Column) -> Column:
    """Stable softmax of an array."""
    top = F.array_max(values)
    powers = F.transform(values, lambda x: F.exp(x - top))
    total = lambda p: F.array(F.aggregate(p, F.lit(0.0), lambda a, y: a + y))  # noqa: E731  worked out once, as the only element of an array
    return F.transform(F.array(powers), lambda p: F.transform(total(p), lambda t: F.transform(p, lambda x: x / t))[0])[0]


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
