"""Places of regular-expression matches as DataFrame expressions.

Spark's functions give the matched strings but not where they stand. Splitting
the text at the matches gives the pieces between them, and the running sum of
the pieces' and matches' lengths (in code points) gives the places. The running
sum is taken in doubling steps over whole arrays, so that its cost grows with
n log n and no array grows entry by entry.
"""

from __future__ import annotations

#: Characters of the blocks that a text is cut from.
BLOCK = 4096


def running(array: str, combine: str) -> str:
    """SQL for the array of running results of ``combine``, an expression of x (earlier) and y (later)."""
    one = combine.replace("{x}", "acc[i - shiftleft(1, k)]").replace("{y}", "v")
    steps = f"slice(sequence(0, 30), 1, CASE WHEN size({array}) > 1 THEN int(ceil(log2(size({array})))) ELSE 0 END)"
    return f"aggregate({steps}, {array}, (acc, k) -> transform(acc, (v, i) -> CASE WHEN i >= shiftleft(1, k) THEN {one} ELSE v END))"


def bound(value: str, name: str, body: str) -> str:
    """SQL for ``body``, in which ``name`` stands for ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def spans(text: str, regex: str, fields: str = "", around: int = 0) -> str:
    """SQL for an array of structs (``fields``, low, high, found) of the leftmost non-overlapping matches.

    ``text`` and ``regex`` are SQL expressions; ``fields`` are further struct
    fields, each with a comma after it. With ``around`` there are also left and
    right: as many characters beside the match, which reach over three matches
    at most.
    """
    sides = ""
    if around:
        before = [f"CASE WHEN i >= {k} THEN right(b.{a}[i - {k}], {around}) ELSE '' END" for k, a in ((3, "f"), (2, "p"), (2, "f"), (1, "p"), (1, "f"), (0, "p"))]
        after = [f"CASE WHEN i + {k} < size(b.{a}) THEN left(b.{a}[i + {k}], {around}) ELSE '' END" for k, a in ((1, "p"), (1, "f"), (2, "p"), (2, "f"), (3, "p"), (3, "f"))]
        sides = f", 'left', right(concat({', '.join(before)}), {around}), 'right', left(concat({', '.join(after)}), {around})"
    ends = bound("transform(b.f, (m, i) -> length(b.p[i]) + length(m))", "n", running("n", "{x} + {y}"))
    one = f"named_struct({fields}'low', e[i] - length(m), 'high', e[i], 'found', m{sides})"
    body = bound(ends, "e", f"transform(b.f, (m, i) -> {one})")
    return bound(f"named_struct('f', regexp_extract_all({text}, {regex}, 0), 'p', split({text}, {regex}, -1))", "b", body)


def blocks(text: str) -> str:
    """SQL for the text in blocks of ``BLOCK`` characters, from which cut() takes parts."""
    return f"regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0)"


def cut(array: str, low: str, high: str) -> str:
    """SQL for the characters from low to high of the text whose blocks ``array`` holds."""
    joined = f"array_join(slice({array}, int(({low}) div {BLOCK}) + 1, int(({high}) div {BLOCK} - ({low}) div {BLOCK}) + 1), '')"
    return f"substr({joined}, int(({low}) % {BLOCK}) + 1, ({high}) - ({low}))"


def quoted(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
