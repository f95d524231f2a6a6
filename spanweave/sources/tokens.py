"""Source files as a table of tokens with the brackets around them.

The lexer reads a file once, character by character class, and writes no more than what a token is and which bracket
holds it; everything that is looked for in code is found by DataFrame operations on that table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_BLANK = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
_TOKEN = re.compile(
    r"""(?P<name>[^\W\d][\w$]*|[$#@][\w$]*)
    |(?P<number>\.?\d[\w.]*)
    |(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<punct>=>|\?\.(?!\d)|\.\.\.|[=!]==?|&&=?|\|\|=?|\?\?=?|\*\*=?|[<>+\-*/%&|^]=|\+\+|--|.)""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
#: After these names a slash begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "await", "yield"}
_CLOSES = {")": "(", "]": "[", "}": "{"}
_ROWS = 50_000

#: parent: seq of the opening bracket around a token; mate: of the other bracket; after: text behind a bracket's mate;
#: close: the bracket that ends what a token is in, with the line of the token before it. A template is a pair of brackets.
SCHEMA = "file string, seq int, kind string, text string, line int, col int, parent int, mate int, mate_line int, after string, close int, close_line int"


def lex(source: str) -> dict[str, list]:
    """The columns of a file's tokens. Comments and white space aren't tokens; a template's text has ${} for its holes."""
    kind, text, line, col, parent, mate = [], [], [], [], [], []
    stack: list[int] = []
    at, row, begin = 0, 1, 0

    def add(k: str, s: str, a: int, z: int) -> None:
        nonlocal row, begin
        kind.append(k)
        text.append(s)
        line.append(row)
        col.append(a - begin)
        parent.append(stack[-1] if stack else None)
        mate.append(None)
        move(a, z)

    def move(a: int, z: int) -> None:
        nonlocal row, begin
        if n := source.count("\n", a, z):
            row, begin = row + n, source.rfind("\n", a, z) + 1

    def close(s: str, a: int) -> None:
        opened = stack.pop()
        add("punct", s, a, a + 1)
        mate[opened], mate[-1] = len(text) - 1, opened

    while at < len(source):
        top = text[stack[-1]] if stack else ""
        if stack and kind[stack[-1]] == "template":
            end = _TEMPLATE.match(source, at).end()
            text[stack[-1]] += source[at:end]
            move(at, end)
            at = end
            if source.startswith("${", at):
                text[stack[-1]] += "${}"
                add("punct", "${", at, at + 2)
                stack.append(len(text) - 1)
                at += 2
            elif at < len(source):
                close("`", at)
                at += 1
            continue
        if blank := _BLANK.match(source, at):
            move(at, blank.end())
            at = blank.end()
            continue
        before = (kind[-1], text[-1]) if text else ("punct", "")
        divides = before[0] in ("number", "string") or before[1] in (")", "]", "}", "`") or (before[0] == "name" and before[1] not in _BEFORE_REGEX)
        m = None if divides or source[at] != "/" else _REGEX.match(source, at)
        k = "regex" if m else None
        m = m or _TOKEN.match(source, at)
        k, s = k or m.lastgroup, m.group()
        if s == "`":
            add("template", "", at, at + 1)
            stack.append(len(text) - 1)
        elif s in ("(", "[", "{"):
            add(k, s, at, at + 1)
            stack.append(len(text) - 1)
        elif s in _CLOSES and (top == _CLOSES[s] or (s == "}" and top == "${")):
            close(s, at)
        else:
            add(k, s[1:-1] if k == "string" else s, at, m.end())
        at = m.end()
    n = len(text)
    closes = [None if p is None else mate[p] for p in parent]
    return {
        "seq": list(range(n)), "kind": kind, "text": text, "line": line, "col": col, "parent": parent, "mate": mate, "mate_line": [None if m is None else line[m] for m in mate],
        "after": [None if m is None or max(m, i) + 1 >= n else text[max(m, i) + 1] for i, m in enumerate(mate)], "close": closes, "close_line": [None if c is None else line[c - 1] for c in closes],
    }


def _lexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"seq": pa.int32(), "kind": pa.string(), "text": pa.string(), "after": pa.string()}
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            found = lex(content or "")
            for at in range(0, len(found["seq"]), _ROWS):
                part = {c: pa.array(v[at : at + _ROWS], kinds.get(c, pa.int32())) for c, v in found.items()}
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part["seq"]), pa.string()), *part.values()], names=["file", *part])


def tokens(files: DataFrame) -> DataFrame:
    """The tokens of files(path, content), in the order of seq; a null content has none."""
    return files.select("path", "content").mapInArrow(_lexed, SCHEMA)


def neighbours(t: DataFrame, back: int = 6, ahead: int = 3) -> DataFrame:
    """tokens with the texts (p1 ..., n1 ...), places and kinds of those around."""
    w = Window.partitionBy("file").orderBy("seq")
    cols = [F.lag("text", i).over(w).alias(f"p{i}") for i in range(1, back + 1)] + [F.lead("text", i).over(w).alias(f"n{i}") for i in range(1, ahead + 1)]
    cols += [F.lag("kind", i).over(w).alias(f"pk{i}") for i in (1, 2, 3)] + [F.lead("kind", i).over(w).alias(f"nk{i}") for i in (1, 2)] + [F.lag("line", i).over(w).alias(f"pl{i}") for i in (1, 2, 3)] + [F.lag("col", 1).over(w).alias("pc1")]
    return t.select("*", *cols, *[F.lead(c, i).over(w).alias(f"n{i}_{c}") for i in (1, 2) for c in ("mate", "mate_line", "after")])


def next_sibling(condition: Column, value: Column) -> Column:
    """value at the next token in the same bracket for which condition holds; null where there is none."""
    later = Window.partitionBy("file", "parent").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(condition, value), ignorenulls=True).over(later)


def segments(t: DataFrame, brackets: DataFrame) -> DataFrame:
    """(file, parent, idx, toks): what stands between the commas of brackets(file, parent), each as an array of (seq, kind, text, mate)."""
    before = Window.partitionBy("file", "parent").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = t.join(brackets.select("file", "parent").distinct(), ["file", "parent"], "left_semi")
    comma = (F.col("text") == ",") & (F.col("kind") == "punct")
    d = inside.withColumn("idx", F.coalesce(F.sum(comma.cast("int")).over(before), F.lit(0))).where(~comma)
    return d.groupBy("file", "parent", "idx").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "text", "mate"))).alias("toks"))
