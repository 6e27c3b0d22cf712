"""One regular expression for a whole keyword list.

Searching a text once per keyword costs (keywords x characters). A list folded into a
single pattern shares common beginnings and rejects most positions after one or two
character tests, so a text is read once however long the list is.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from os.path import commonprefix

from pyspark.sql import Column
from pyspark.sql import functions as F

from workforce_signals.functions.text import regex_quote

# Keywords per pattern; longer lists become several patterns over the same text.
PATTERN_KEYWORDS = 5_000

# Widest choice tried branch by branch, and letters tested ahead before a choice is entered.
_FANOUT = 4
_AHEAD = 4


def keyword_patterns(keywords: Iterable[str]) -> list[str]:
    """Patterns whose leftmost match is the earliest keyword, the shortest one on a tie."""
    words = sorted(set(keywords))
    chunks = [words[i : i + PATTERN_KEYWORDS] for i in range(0, len(words), PATTERN_KEYWORDS)]
    return [_pattern(chunk) for chunk in chunks]


def _pattern(words: Sequence[str]) -> str:
    # Words come sorted, so a word follows its own beginnings. A word that extends another
    # can never win (the shorter one starts at the same place), so it needs no branch.
    kept: list[str] = []
    for word in words:
        if not (kept and word.startswith(kept[-1])):
            kept.append(word)
    return _ahead(kept, 0) + _branches(kept, 0)


def _branches(words: Sequence[str], depth: int) -> str:
    shared = commonprefix(words)[depth:]
    if len(words) == 1:
        return regex_quote(shared)
    depth += len(shared)
    heads: dict[str, list[str]] = {}
    for word in words:
        heads.setdefault(word[depth], []).append(word)
    return regex_quote(shared) + _choose(heads, sorted(heads), depth)


def _choose(heads: dict[str, list[str]], chars: Sequence[str], depth: int) -> str:
    # Wide choices are halved, and a half is entered only where the next letters could fit.
    if len(chars) > _FANOUT:
        mid = len(chars) // 2
        options = [
            _ahead([w for ch in part for w in heads[ch]], depth) + _choose(heads, part, depth)
            for part in (chars[:mid], chars[mid:])
        ]
    else:
        options = [_branches(heads[ch], depth) for ch in chars]
    return f"(?:{'|'.join(options)})"


def _ahead(words: Sequence[str], depth: int) -> str:
    reach = min(_AHEAD, min(map(len, words)) - depth)
    classes = ({w[depth + i] for w in words} for i in range(reach))
    return f"(?={''.join('[' + ''.join(map(regex_quote, sorted(c))) + ']' for c in classes)})"


def longest_pattern(pieces: Iterable[str]) -> str:
    """A pattern that matches the longest of ``pieces`` a text begins with."""
    return r"\A" + _longest(sorted(set(pieces)), 0)


def _longest(words: Sequence[str], depth: int) -> str:
    shared = commonprefix(words)[depth:]
    depth += len(shared)
    ends, longer = len(words[0]) == depth, [w for w in words if len(w) > depth]
    heads: dict[str, list[str]] = {}
    for word in longer:
        heads.setdefault(word[depth], []).append(word)
    if not heads:
        return regex_quote(shared)
    choice = "|".join(_longest(group, depth) for group in heads.values())
    return f"{regex_quote(shared)}(?:{choice}){'?' if ends else ''}"


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """The keyword that starts earliest in ``text``; NULL when none occurs."""
    hits = [F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns]
    if not hits:
        return F.lit(None).cast("string")
    if len(hits) == 1:
        return hits[0]
    found = [F.when(h.isNotNull(), F.struct(F.instr(text, h).alias("pos"), h.alias("kw"))) for h in hits]
    return F.array_min(F.array(*found))["kw"]
