"""Texts as words."""

from __future__ import annotations

import html
import re
import unicodedata

# Invisible characters (soft hyphen, grapheme joiner, zero-width, direction marks, word joiner, byte order mark)
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_WORD = re.compile(r"[^\W_]+")
#: Marks of the Latin, Greek and Cyrillic scripts; what may hold marks of others.
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]")
_OTHER = re.compile("[\u0590-\u1dbf\u2c00-\ufe1f\U00010000-\U0010ffff]")


def visible(text: str) -> str:
    """HTML entities decoded, invisible characters dropped."""
    if "&" in text:
        text = html.unescape(text)
    return text if text.isascii() else INVISIBLE.sub("", text)


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without case and accents; none of a null text."""
    if not text:
        return []
    text = visible(text).casefold()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
        if _OTHER.search(text):
            text = "".join(c for c in text if not unicodedata.combining(c))
    return _WORD.findall(text)
