"""SQL fragments that the check texts share."""

from __future__ import annotations

from pictorium.functions.text import WHITESPACE

BLANK_CLASS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
WORD_CLASS = r"[\p{L}\p{N}_]+"


def base(path: str) -> str:
    return f"split_part({path}, '/', -1)"


def suffix(name: str) -> str:
    return rf"regexp_extract({name}, '(?s)^.+(\.[^.]+)$', 1)"


def ext(name: str) -> str:
    return f"lower({suffix(name)})"


def stem(name: str) -> str:
    return f"left({name}, length({name}) - length({suffix(name)}))"


def blank_words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{BLANK_CLASS}'), lambda w: w <> '')"


def strip(text: str) -> str:
    return f"trim({text}, '{WHITESPACE}')"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


def quoted(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def incomplete(text: str) -> str:
    return f"coalesce(right({strip(text)}, 1) NOT IN ('.', '!', '?'), true)"
