"""What a pattern cannot match without: short strings, one of which is in every match.

Looking for plain strings is many times cheaper than a pattern with alternatives and look-behind, and most texts hold few
of the words that patterns are after. Needles are derived from the pattern, so a guarded pattern finds what it found before.
"""

from __future__ import annotations

import functools
import re
from re import _constants as C
from re import _parser as syntax

from pyspark.sql import Column
from pyspark.sql import functions as F


def _worth(words: frozenset[str]) -> tuple[int, int]:
    return min(map(len, words)), -len(words)


def _required(parts) -> frozenset[str] | None:
    """Strings of which every match of a parsed sequence holds one; None if there are none to tell."""
    found, run = [], ""

    def close() -> None:
        nonlocal run
        found.extend([frozenset([run])] if run else [])
        run = ""

    for op, arg in parts:
        if op is C.LITERAL:
            run += chr(arg)
            continue
        close()
        inner = None
        if op is C.SUBPATTERN:
            inner = _required(arg[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            inner = _required(arg[2])
        elif op is C.BRANCH:
            each = [_required(branch) for branch in arg[1]]
            inner = frozenset().union(*each) if all(each) else None
        elif op is C.IN and all(kind is C.LITERAL for kind, _ in arg):
            inner = frozenset(chr(code) for _, code in arg)
        found.extend([inner] if inner else [])
    close()
    return max(found, key=_worth) if found else None


@functools.cache
def needles(pattern: str) -> tuple[str, ...]:
    """Strings of which every match of a pattern (of small letters, matched with case) holds one; empty if there are none."""
    words = _required(syntax.parse(pattern, re.MULTILINE)) or frozenset()
    # a string that holds another needs no look of its own
    return tuple(sorted(w for w in words if not any(v != w and v in w for v in words)))


def may_match(text: Column, pattern: str) -> Column:
    """Whether a text of small letters holds what a pattern needs; true for all that the pattern matches."""
    words = needles(pattern)
    return functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]) if words else F.lit(True)
