"""A guarded pattern finds what the pattern finds."""

from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skonto.operators import document_rules as R
from skonto.operators.needles import needles

PATTERNS = sorted({rx.lower() for rules in R.CLASSES.values() for rx, _ in rules} | set(R.AMOUNTS.values()) | set(R.DATES.values()))


def test_known_needles():
    assert needles("rechnungs(?:nummer|datum)") == ("rechnungs",)
    assert needles(r"\bmahnung\b|first\s+notice") == ("mahnung", "notice")
    assert needles("a?b*") == () and needles(r"\d+") == () and needles("") == ()
    assert needles("(?:abc)?xy") == ("xy",) and needles("(?:abc)+") == ("abc",)
    assert needles("abc|abcd") == ("abc",) and needles("[pq]") == ("p", "q") and needles("(?<!x)[^a]yz(?=longer)") == ("yz",)


def hold(rx: str) -> None:
    """Strings made from a pattern hold one of its needles if the pattern matches them."""

    @settings(max_examples=25, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(rx, re.MULTILINE)))
    def check(text):
        if re.search(rx, text, re.MULTILINE):
            assert any(w in text for w in needles(rx)), (rx, text)

    check()


@pytest.mark.parametrize("k", range(8))
def test_no_match_is_lost(k):
    for rx in PATTERNS[k::8]:
        if needles(rx):
            hold(rx)
