"""Regular expressions on whole texts, guarded by a cheap literal test.

Most expressions cannot match without some fixed piece of text. Looking for that
piece first is a plain byte search, many times faster than running the
expression; only texts that hold it are matched at all. Where an expression begins
with what fits almost anywhere, its ``core`` is looked for before it. The answer is the same.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # the parser that ``re`` itself uses
    from re import _constants as _c
    from re import _parser as _p
except ImportError:  # pragma: no cover
    _p = None


#: One piece of an expression and how often it is repeated; a group's opening is one by itself.
_PIECE = re.compile(
    r"(\()|(\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|N\{[^}]*\}|.)|\[\^?\]?(?:\\.|[^\]\\])*\]|.)((?:[*+?]|\{[\d,]*\})[?+]?)?", re.S
)


def _pieces(regex: str) -> list[tuple[str, str]]:
    return [(group or piece, times) for group, piece, times in _PIECE.findall(regex)]


def java_regex(regex: str, ignore_case: bool = False) -> str:
    """The Python expression as Java reads it: Unicode classes, line feeds only, multi-line anchors.

    A word and then the rest of a line is one letter and then the rest of the line: Java would try the rest anew for every
    shorter word.
    """
    pieces = ["".join(piece) for piece in _pieces(regex)]
    quick = ["\\w" if pair == ("\\w+", ".*") else pair[0] for pair in zip(pieces, [*pieces[1:], ""], strict=True)]
    return f"(?dmUu{'i' if ignore_case else ''}){''.join(quick)}"


def _branches(regex: str) -> list[list[tuple[str, str, int]]]:
    """The alternatives of an expression as lists of piece, repetition and depth."""
    out, depth = [[]], 0
    for piece, times in _pieces(regex):
        depth -= piece == ")"
        if piece == "|" and not depth:
            out.append([])
        else:
            out[-1].append((piece, times, depth))
        depth += piece == "("
    return out


def _is_literal(piece: tuple[str, str, int]) -> bool:
    text, times, depth = piece
    fixed = re.fullmatch(r"\\[^a-zA-Z0-9]", text) or text in ("\\n", "\\t") or (len(text) == 1 and text not in "()|.^$")
    return bool(fixed) and not times and not depth


def _is_wide(piece: tuple[str, str, int]) -> bool:
    """Reads on past blanks and a word: from many starts, the same text many times."""
    text, times, _ = piece
    return text == "(" or (times[:1] in ("*", "+", "{") and text not in ("\\s", "\\w"))


@lru_cache(maxsize=1024)
def core(regex: str) -> str | None:
    """A part that every match of ``regex`` holds, looked for in one reading of the text; None where there is none to gain.

    It is what follows the first ``.*``, or a repetition at the start, from the next literal up to where the expression reads
    far again (after a line break it may: a line is then read once). The expression itself finds a start nearly everywhere
    and reads the rest of the word or line from each one.
    """
    flags, body = re.fullmatch(r"(\(\?[a-zA-Z]+\))?(.*)", regex, re.S).groups(default="")
    if "x" in flags or "(?" in body or re.search(r"\\\d", body):  # has comments, looks around, or names a group that may be cut off
        return None
    branches = _branches(body)
    whole = branches[0]
    if len(branches) == 1 and len(whole) > 2 and whole[0][0] == "(" and whole[-1][:2] == (")", "") and all(depth for _, _, depth in whole[1:-1]):
        branches = _branches(body[1:-1])
    cores = []
    for pieces in branches:
        starts = [i for i, (text, times, depth) in enumerate(pieces) if not depth and times[:1] in ("*", "+") and (text == "." or i == 0)]
        first = next((i for i in range(starts[0], len(pieces)) if _is_literal(pieces[i])), None) if starts else None
        if first is None:
            return None
        ends = (i for i in range(first, len(pieces)) if _is_wide(pieces[i]) and not (pieces[i][0] == "." and pieces[i - 1][:2] == ("\\n", "")))
        part = pieces[first : next(ends, len(pieces))]
        while part[-1][0] == "\\s":
            part.pop()
        if all(map(_is_literal, part)):  # ``needles`` has these
            return None
        cores.append("".join(text + times for text, times, _ in part))
    return flags + "|".join(cores)


def _worth(alternatives: list[str] | None) -> int:
    return min(map(len, alternatives)) if alternatives else 0


def _demands(parsed) -> list[list[str]]:
    """What every match of a sequence holds: at least one text of each group."""
    groups: list[list[str]] = []
    run = ""
    for op, arg in [*parsed, (None, None)]:
        if op is _c.LITERAL:
            run += chr(arg)
            continue
        if run:
            groups.append([run])
        run = ""
        if op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0] >= 1:
            groups += _demands(arg[2])
        elif op is _c.SUBPATTERN:
            groups += _demands(arg[-1])
        elif op is _c.BRANCH:
            best = [max(_demands(branch), key=_worth, default=None) for branch in arg[1]]
            if all(best):
                groups.append([text for branch in best for text in branch])
    return groups


@lru_cache(maxsize=1024)
def needles(regex: str) -> tuple[tuple[str, ...], ...]:
    """Groups of literal texts, the most telling first: a match holds one text of each group."""
    if _p is None:
        return ()
    plain = re.sub(r"^\(\?[a-zA-Z]+\)", "", regex)
    groups = sorted(_demands(_p.parse(plain)), key=_worth, reverse=True)
    return tuple(dict.fromkeys(tuple(dict.fromkeys(group)) for group in groups))[:4]


def folded(text: Column) -> Column:
    """Lower case, with the two letters that only case-blind matching equates with i and s."""
    return F.replace(F.replace(F.lower(text), F.lit("ı"), F.lit("i")), F.lit("ſ"), F.lit("s"))


def _may_match(text: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    every = F.lit(True)
    for words in groups:
        some = text.contains(words[0])
        for word in words[1:]:
            some = some | text.contains(word)
        every = every & some
    return every


def guarded(text: Column, lower: Column, regex: str, ignore_case: bool = False) -> Column:
    """``text`` matches ``regex``; ``lower`` is the folded text, computed once by the caller."""
    groups = tuple(tuple(w.lower() for w in words) for words in needles(regex))
    part, test = core(regex), _may_match(lower, groups)
    if part:
        test = test & text.rlike(java_regex(part, ignore_case))
    return test & text.rlike(java_regex(regex, ignore_case))


def guarded_count(text: Column, regex: str) -> Column:
    """Number of matches of a case-sensitive expression; zero without running it where it cannot match."""
    count = F.regexp_count(text, F.lit(regex)).cast("long")
    return F.when(_may_match(text, needles(regex)), count).otherwise(F.lit(0).cast("long"))
