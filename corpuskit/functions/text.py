"""Column functions for text: normalisation, word splitting, special markers."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Special pieces in id order, for the current and for the older vocabulary layout.
SPECIALS = ("[UNK]", "[CLS]", "[SEP]", "[EOS]", "[PAD]", "[MASK]")
LEGACY_SPECIALS = ("[UNK]", "[CLS]", "[SEP]", "[PAD]", "[MASK]")

# Special pieces written out in a text travel through normalisation as Unicode noncharacters.
_MARK_BASE = 0xFDD0
_MARK_COUNT = 16
_MARKS = f"{chr(_MARK_BASE)}-{chr(_MARK_BASE + _MARK_COUNT - 1)}"

_HANGUL_FIRST, _HANGUL_LAST = "\uac00", "\ud7a3"
_LEADS = "".join(chr(0x1100 + i) for i in range(19))
_VOWELS = "".join(chr(0x1161 + i) for i in range(21))
_TAILS = "".join(chr(0x11A8 + i) for i in range(27))

# Runs of word characters, or runs of characters that are neither word characters nor space.
WORD_PATTERN = rf"[{_MARKS}]|(?U:\w+)|(?U:[^\w\s{_MARKS}]+)"

ASCII_WORD_PATTERN = r"\w+|[^\w\s]+"

# Not ASCII, a Latin letter or a common mark (a negated set takes Java 50 times as long); of these, runs outside all words (RE2).
_FAR_FROM_LATIN = r"[\u0080-\u00a0\u0180-\u200f\u2028-\x{10ffff}]"
_LATIN_MARKS = r"[^\w\s\x0b\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}]+"


def special_mark(index: int) -> str:
    """The one-character stand-in of the special piece at ``index``."""
    if not 0 <= index < _MARK_COUNT:
        raise ValueError(f"at most {_MARK_COUNT} special pieces are supported")
    return chr(_MARK_BASE + index)


def fold_character(ch: str) -> str:
    """Decompose, lowercase and drop combining marks of one character."""
    lowered = unicodedata.normalize("NFD", ch).lower()
    return "".join(c for c in lowered if unicodedata.category(c)[0] != "M")


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """``translate`` arguments for every character outside ASCII that folds to one character or to none."""
    source, target, dropped = [], [], []
    for cp in range(0x80, 0x110000):
        ch = chr(cp)
        if unicodedata.category(ch) in ("Cs", "Cn"):
            continue
        folded = fold_character(ch)
        if folded == "":
            dropped.append(ch)
        elif len(folded) == 1 and folded != ch:
            source.append(ch)
            target.append(folded)
    return "".join(source + dropped), "".join(target)


def _hangul_letters(ch: Column) -> Column:
    """One character as its letters when it is a Hangul syllable, itself otherwise."""
    offset = F.ascii(ch) - F.lit(ord(_HANGUL_FIRST))
    tail = offset % 28
    letters = F.concat(
        F.substring(F.lit(_LEADS), F.floor(offset / 588).cast("int") + 1, F.lit(1)),
        F.substring(F.lit(_VOWELS), F.floor(offset % 588 / 28).cast("int") + 1, F.lit(1)),
        F.when(tail > 0, F.substring(F.lit(_TAILS), tail.cast("int"), F.lit(1))).otherwise(F.lit("")),
    )
    return F.when(ch.between(_HANGUL_FIRST, _HANGUL_LAST), letters).otherwise(ch)


def _once(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed one time, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def normalize(text: Column) -> Column:
    """Decompose, lowercase, drop combining marks. ASCII rows take the plain ``lower`` path."""
    folded = F.lower(F.translate(text, *_fold_table()))
    with_hangul = F.array_join(F.transform(F.split(folded, ""), _hangul_letters), "")
    return (
        F.when(_is_ascii(text), F.lower(text))
        .when(text.rlike(f"[{_HANGUL_FIRST}-{_HANGUL_LAST}]"), with_hangul)
        .otherwise(folded)
    )


def pretokenize(text: Column) -> Column:
    """Words of a text as an array, in order. ASCII rows, where both patterns agree, take the cheaper one."""
    return F.when(_is_ascii(text), F.regexp_extract_all(text, F.lit(ASCII_WORD_PATTERN), F.lit(0))).otherwise(
        F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    )


def mark_specials(text: Column, specials=SPECIALS) -> Column:
    """Replace special pieces written in the text by their stand-ins, before normalisation.

    Characters that the stand-ins are made of become U+FFFD first, so a text cannot smuggle in a special piece.
    """
    reserved = "".join(chr(c) for c in range(0xFDD0, 0xFDE0))
    raw = ~_is_ascii(text) & text.rlike(f"[{reserved[0]}-{reserved[-1]}]")
    text = F.when(raw, F.translate(text, reserved, "\ufffd" * len(reserved))).otherwise(text)
    for index, piece in enumerate(specials):
        text = F.replace(text, F.lit(piece), F.lit(special_mark(index)))
    return text


def _normal(text: Column, specials) -> Column:
    return _once(mark_specials(text, specials), normalize) if specials else normalize(text)


def words(text: Column, specials=None) -> Column:
    """Normalised words of a raw text; with ``specials``, written special pieces become their own word."""
    return _once(_normal(text, specials), pretokenize)


def splittable(text: Column, specials=None) -> Column:
    """What :func:`split_words` makes the same words of: ``text``, and ``plain`` where its marks still touch words.

    Most texts are plain and leave the JVM as they are; only those far from Latin are split there.
    """

    def parts(normal):
        plain = F.is_valid_utf8(normal) & (_is_ascii(normal) | ~normal.rlike(_FAR_FROM_LATIN))
        return F.struct(F.when(plain, normal).otherwise(F.array_join(pretokenize(normal), " ")).alias("text"), plain.alias("plain"))

    return _once(_normal(text, specials), parts)


def split_words(texts: pa.StructArray) -> pa.ListArray:
    """The words of :func:`splittable` texts, inside an Arrow function; a text that is empty, or begins or ends with
    white space, has empty ones besides."""
    text, plain = texts.field("text"), texts.field("plain")
    apart = pc.replace_substring_regex(text, _LATIN_MARKS, r" \0 ")
    return pc.ascii_split_whitespace(pc.if_else(plain, apart, text))


def _key_part(key: Column) -> Column:
    """A key as text in which neither the separator nor null can be mistaken for a value."""
    shown = F.replace(F.replace(key.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))
    return F.coalesce(shown, F.lit("\\N"))


def permutation_key(seed, *keys: Column) -> Column:
    """A hash order that depends on seed and key only, never on partitioning or retries."""
    parts = [F.lit(str(seed))] + [_key_part(key) for key in keys]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def hash_fraction(seed, *keys: Column) -> Column:
    """A number in [0, 1) from the leading 32 bits of the permutation key."""
    leading = F.conv(F.substring(permutation_key(seed, *keys), 1, 8), 16, 10)
    return leading.cast("bigint") / F.lit(4294967296.0)


_ESCAPED = r"[\p{C}\p{Z}&&[^ ]]"


def _escape_character(ch: Column) -> Column:
    code = F.ascii(ch)
    digits = F.lower(F.hex(code.cast("bigint")))
    escape = (
        F.when(code < 0x100, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
        .when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
        .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
    )
    return F.when(ch.rlike(_ESCAPED), escape).otherwise(ch)


def _quoted_string(value: Column) -> Column:
    """A string as Python shows it inside a list."""
    body = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    body = F.when(
        body.rlike(_ESCAPED), F.array_join(F.transform(F.split(body, ""), _escape_character), "")
    ).otherwise(body)
    double = F.contains(value, F.lit("'")) & ~F.contains(value, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(single)


def shown_value(value: Column, data_type, nested: bool = False) -> Column:
    """A value as a Python format string prints it: null is ``None``, booleans are capitalised, lists use brackets."""
    kind = data_type.typeName()
    if kind == "array":
        items = F.transform(value, lambda item: shown_value(item, data_type.elementType, nested=True))
        shown = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif kind == "boolean":
        shown = F.when(value, "True").otherwise("False")
    elif kind == "string" and nested:
        shown = _quoted_string(value)
    elif kind in ("struct", "map"):
        shown = F.to_json(value)
    else:
        shown = value.cast("string")
    return F.when(value.isNull(), "None").otherwise(shown)
