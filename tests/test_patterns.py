"""Search patterns of the dialect: which texts they match, and which are refused before any job."""

import pytest

from traceloom.functions.patterns import translate
from traceloom.operators.filters import search

MATCHES = [
    (r"\d{1,3}\.\d{1,3}", "10.20", True), (r"(?i)invoke-.*", "INVOKE-x", True), ("a.b", "a\nb", False), ("a.b", "a\u0085b", True), ("(?s)a.b", "a\nb", True), ("a[^]b", "a\nb", True), ("a[]b", "ab", False), ("b$", "ab\n", False), ("(?m)b$", "ab\nc", True), ("^b", "a\nb", False), ("(?m)^b", "a\nb", True),
    (r"\u{1F600}", "x😀", True), (r"A", "a", True), (r"\x41", "A", True), (r"(?<a_b>x)\k<a_b>", "xx", True), (r"(?<year>\d)-\k<year>", "1-2", False), (r"(a)\1", "aa", True), (r"[[]", "[", True), (r"[a&&b]", "&", True), (r"[a&&b]", "b", True), (r"x{", "x{", True), (r"{x}", "{x}", True), (r"a]", "a]", True), (r"x{2}", "xx", True), (r"x{2,}?y", "xxy", True), (r"a+?b", "aab", True),
    (r"\s", "\u00a0", True), (r"\s", "\ufeff", True), (r"\S", "\u3000", False), (r"[^\S\n]", "\n", False), (r"[^\S\n]", " ", True), (r"[\s\d]", "\u2003", True), (r"\v", "\x0b", True), (r"\v", "\n", False), (r"[\b]", "\x08", True), (r"\bfoo\b", "a foo.", True), (r"\bfoo\b", "afoo", False), (r"é\b", "é", False), (r"o\Bo", "foo", True), (r"\Q.\E", "QaE", True), (r"\Q.\E", ".", False), (r"\/", "/", True), (r"\-", "-", True),
    (r"\p{Script=Greek}", "α", True), (r"\p{Lu}", "a", True), (r"(?<!a)b", "cb", True), (r"(?<=a{1,3})b", "aab", True), (r"\++", "+++", True), (r"[+*?]+", "*", True), (r"\0", "\x00", True), (r"\cJ", "\n", True), ("a|b", "B", True), ("", "x", True), (r"\$\{jndi:", "${JNDI:ldap", True), (r"(?:x|y)+z", "xyz", True), (r"[\]]", "]", True), (r"[\^a]", "^", True), (r"[a^]", "^", True), (r"\W", "é", True),
]


def test_patterns_match_what_the_dialect_matches(spark):
    rows = spark.createDataFrame([(k, t) for k, (_, t, _) in enumerate(MATCHES)], "k int, t string")
    wrong = []
    for k, (pattern, text, want) in enumerate(MATCHES):
        got = rows.where(f"k = {k}").where(search(["t"], pattern, "regex")).count() == 1
        if got != want:
            wrong.append((pattern, text, want))
    assert not wrong


@pytest.mark.parametrize("pattern", ["a++", "a*+", "x{2}+", "a**", "(?>a)", "a(?i)b", "(", "[a", "a\\", r"\k<no>", "(?<x>a)(?<x>b)", "(?#note)", ")", "*a"])
def test_patterns_that_cannot_run_are_refused(spark, pattern):
    with pytest.raises(ValueError, match="pattern"):
        translate(pattern)
