"""Invisible and unusual characters as Catalyst expressions: no Python touches a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges.
INVISIBLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0xE000, 0xF8FF), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB),
    (0xE0000, 0xE007F), (0xE0100, 0xE01EF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD),
]
SPACES = [(0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
EMOJI = [(0x2300, 0x23FF), (0x2600, 0x27BF), (0x1F000, 0x1FAFF), (0xA9, 0xA9), (0xAE, 0xAE), (0x203C, 0x203C), (0x2049, 0x2049), (0x2122, 0x2122), (0x2139, 0x2139)]
JOINED_SCRIPTS = [(0x590, 0x8FF), (0x900, 0xDFF), (0x1780, 0x18AF)]
#: Characters that may stay beside a character of their own block.
NEIGHBOURS = [((0x180B, 0x180D), (0x1800, 0x18AF)), ((0x17B4, 0x17B5), (0x1780, 0x17FF)), ((0x115F, 0x1160), (0x1100, 0x11FF))]
ZWNJ, ZWJ, EMOJI_STYLE = chr(0x200C), chr(0x200D), chr(0xFE0F)


def char_class(*ranges: tuple[int, int]) -> str:
    # literal characters: Java takes escapes above U+FFFF wrongly inside a look-behind
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"


def _pattern() -> str:
    emoji, some = char_class(*EMOJI), "(?s:.)"
    stays = [f"(?<={emoji})[{ZWJ}{EMOJI_STYLE}]", f"(?<={some}){ZWJ}(?={emoji})", f"(?<={EMOJI_STYLE}){ZWJ}(?={some})"]
    for script in map(char_class, JOINED_SCRIPTS):
        stays.append(f"(?<={script})[{ZWNJ}{ZWJ}](?={script})")
    for marks, block in NEIGHBOURS:
        mark, beside = char_class(marks), char_class(block)
        stays += [f"(?<={beside}){mark}(?={some})", f"(?<={some}){mark}(?={beside})"]
    hidden = char_class(*INVISIBLE)
    return f"(?={hidden})(?!{'|'.join(stays)}){hidden}"  # the class first: most characters fail it at once


INVISIBLE_PATTERN = _pattern()
SPACE_PATTERN = char_class(*SPACES)
_SPACE_CHARS = "".join(chr(c) for a, b in SPACES for c in range(a, b + 1))


def invisible_count(text: Column) -> Column:
    """Invisible characters that aren't joining an emoji or a script around them."""
    return F.regexp_count(text, F.lit(INVISIBLE_PATTERN)).cast("long")


def space_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SPACE_PATTERN)).cast("long")


def clean_text(text: Column) -> Column:
    """Without the counted invisible characters, and with plain spaces for unusual ones."""
    return F.translate(F.regexp_replace(text, F.lit(INVISIBLE_PATTERN), F.lit("")), _SPACE_CHARS, " " * len(_SPACE_CHARS))
