"""Column functions over message text: stripping, case folding and phrase counting."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tellsign.fixed import KEYWORDS, PATTERNS, WHITESPACE

WORD = r"[\p{L}\p{N}_]"
GAP = r"[\s\x{1c}-\x{1f}]+"


def strip(value: Column) -> Column:
    """Missing becomes empty; Unicode white space is cut at both ends.

    ``btrim`` with a character set only walks the ends; a regular expression would try
    every run of blanks in a long text.
    """
    return F.btrim(F.coalesce(value, F.lit("")), F.lit(WHITESPACE))


def lowered(text: Column) -> Column:
    return F.lower(text)


def folded(text: Column) -> Column:
    """Text in which a plain, case-sensitive search finds what a case-blind one would.

    Lower case, plus the letters that case-blind matching equates with ``i`` and ``s``.
    """
    dotted = F.when(F.contains(text, F.lit("İ")), F.replace(text, F.lit("İ"), F.lit("i")))
    low = F.lower(F.coalesce(dotted, text))
    return F.replace(F.replace(low, F.lit("ı"), F.lit("i")), F.lit("ſ"), F.lit("s"))


def _quote(word: str) -> str:
    return re.sub(r"([^\w])", r"\\\1", word)


def phrase_regex(phrases: Sequence[str], gap: str) -> str:
    """Whole-word alternation; the leading letter check skips most positions cheaply."""
    letters = "".join(sorted({p[0] for p in phrases}))
    body = "|".join(gap.join(_quote(w) for w in p.split(" ")) for p in phrases)
    return f"(?U)(?=[{letters}])(?<!{WORD})(?:{body})(?!{WORD})"


def anchor(phrase: str) -> str:
    """The longest word of a phrase; a text without it cannot contain the phrase."""
    return max(phrase.split(" "), key=len)


def _any_contains(text: Column, needles: Sequence[str]) -> Column:
    found = F.contains(text, F.lit(needles[0]))
    for needle in needles[1:]:
        found = found | F.contains(text, F.lit(needle))
    return found


def _guarded_count(text: Column, needles: Sequence[str], regex: str) -> Column:
    """Count matches, but only in texts in which a plain substring search succeeds."""
    hits = F.regexp_count(text, F.lit(regex))
    return F.when(_any_contains(text, needles), hits).otherwise(F.lit(0))


def pattern_hits(folded_text: Column, family: str) -> Column:
    """Non-overlapping hits of a family's pattern in a ``folded`` text."""
    phrases = PATTERNS[family]
    needles = list(dict.fromkeys(anchor(p) for p in phrases))
    return _guarded_count(folded_text, needles, phrase_regex(phrases, GAP))


def _overlap(a: str, b: str) -> bool:
    x, y = a.split(" "), b.split(" ")
    if len(x) < len(y):
        x, y = y, x
    inside = any(x[i:i + len(y)] == y for i in range(len(x) - len(y) + 1))
    ends = any(x[-k:] == y[:k] or y[-k:] == x[:k] for k in range(1, len(y)))
    return inside or ends


def disjoint_groups(phrases: Sequence[str]) -> list[list[str]]:
    """Split phrases so that no two in a group can share words of a text.

    Within such a group one alternation finds every hit of every phrase, so a family takes
    one pass per group and not one per keyword.
    """
    groups: list[list[str]] = []
    for phrase in phrases:
        for group in groups:
            if not any(_overlap(phrase, other) for other in group):
                group.append(phrase)
                break
        else:
            groups.append([phrase])
    return groups


def keyword_hits(lowered_text: Column, family: str) -> Column:
    """Sum over the family's keywords of their whole-word hits in a ``lowered`` text."""
    total = None
    for group in disjoint_groups(KEYWORDS[family]):
        hits = _guarded_count(lowered_text, group, phrase_regex(group, " "))
        total = hits if total is None else total + hits
    return total


def _all_phrases() -> list[str]:
    return list(dict.fromkeys(
        p for table in (PATTERNS, KEYWORDS) for phrases in table.values() for p in phrases))


def union_regex(phrases: Sequence[str]) -> str:
    """One pattern that finds every phrase at every word start, overlapping ones too.

    It looks ahead and consumes nothing, and it branches on the first letter.  At one place
    it can report one phrase only, so no phrase may be the beginning of another.
    """
    for a in phrases:
        for b in phrases:
            if a != b and (b + " ").startswith(a + " "):
                raise ValueError(f"'{a}' is the beginning of '{b}'")
    by_letter: dict[str, list[str]] = {}
    for phrase in phrases:
        body = GAP.join(_quote(w) for w in phrase.split(" "))
        by_letter.setdefault(phrase[0], []).append(body[1:])
    branches = "|".join(f"{k}(?:{'|'.join(rest)})" for k, rest in by_letter.items())
    letters = "".join(by_letter)
    return f"(?U)(?=[{letters}])(?<!{WORD})(?=({branches})(?!{WORD}))"


def found_phrases(folded_text: Column) -> Column:
    """All phrases of all families in a folded text, as written there, in one pass."""
    return F.regexp_extract_all(folded_text, F.lit(union_regex(_all_phrases())), F.lit(1))


def plain_gaps(found: Column) -> Column:
    """Found phrases with any white space between their words turned into one blank."""
    single = [p for p in _all_phrases() if " " not in p]
    return F.transform(found, lambda x: F.when(x.isin(*single), x).otherwise(
        F.regexp_replace(x, F.lit("(?U)" + GAP), F.lit(" "))))


def _count_in(found: Column, phrases: Sequence[str]) -> Column:
    return F.size(F.filter(found, lambda x: x.isin(*phrases)))


def pattern_count(plain: Column, folded_text: Column, family: str) -> Column:
    """Pattern hits of a family from its found phrases.

    Where phrases of a family can share words, a pattern passes over what it has consumed;
    texts with several hits of such a family are counted by the pattern itself.
    """
    phrases = PATTERNS[family]
    hits = _count_in(plain, phrases)
    if len(disjoint_groups(phrases)) == 1:
        return hits
    return F.when(hits > 1, pattern_hits(folded_text, family)).otherwise(hits)


def keyword_count(found: Column, folded_text: Column, lowered_text: Column, family: str) -> Column:
    """Keyword hits of a family from the found phrases.

    Keywords need single blanks and do not equate the letters that ``folded`` does; in the
    rare texts with such letters they are counted one by one.
    """
    return F.when(
        folded_text == lowered_text, _count_in(found, KEYWORDS[family])
    ).otherwise(keyword_hits(lowered_text, family))


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def html_escape(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value


def contains_ignore_case(value: Column, needle: str) -> Column:
    """Literal search; ``%`` and ``_`` have no special meaning."""
    return F.contains(F.upper(value), F.upper(F.lit(needle)))
