"""Source files into functions.

Python is cut by its own parser.  Other languages go through a small scanner: strings,
comments and preprocessor lines are blanked out, what is left becomes a stream of
tokens, and every brace that opens a block is asked whether the tokens before it head
a function.  A block that never closes is an error, and its function is left out.  A
unit is widened upwards over the comments, attributes and decorators right above it.
"""

from __future__ import annotations

import ast
import re
import textwrap
from itertools import takewhile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Extension -> language (fixed values).
LANGUAGES = {
    "rs": "rust", "py": "python", "go": "go", "js": "javascript", "mjs": "javascript", "jsx": "javascript", "ts": "typescript",
    "tsx": "typescript", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "swift": "swift", "sh": "bash", "bash": "bash",
}
#: How lines begin that belong to the function below them (fixed values).
ATTACHED = {"rust": ("//", "#["), "python": ("#", "@"), "bash": ("#", "@")}
OTHERS = ("//", "/*", "*", "@")

#: Words that introduce a function, by language; the others name it before its parameters.
INTRODUCED = {"rust": "fn", "go": "func", "swift": "func", "bash": "function", "javascript": "function", "typescript": "function"}
#: Languages in which a name before parameters is enough.
BY_PARAMETERS = {"javascript", "typescript", "java", "c", "cpp", "bash"}
#: What stands before parentheses and a block without being a function.
CONTROL = {"if", "for", "while", "switch", "catch", "with", "return", "synchronized", "elif", "else", "do", "try", "new", "function", "super", "sizeof"}

_STRING = r"\"(?:\\.|[^\"\\])*\""
_CHARACTER = r"'(?:\\[^\n']+|[^'\\\n])'"
_SLASHES = r"//[^\n]*|/\*.*?\*/"
SILENT = {
    "bash": re.compile(rf"(?<!\S)\#[^\n]*|{_STRING}|'[^']*'", re.S),
    "rust": re.compile(rf"{_SLASHES}|r(\#*)\".*?\"\1|{_STRING}|{_CHARACTER}", re.S),
    "go": re.compile(rf"{_SLASHES}|`[^`]*`|{_STRING}|{_CHARACTER}", re.S),
    "javascript": re.compile(rf"{_SLASHES}|`(?:\\.|[^`\\])*`|{_STRING}|'(?:\\.|[^'\\\n])*'", re.S),
    "c": re.compile(rf"^[ \t]*\#(?:\\\n|[^\n])*|{_SLASHES}|{_STRING}|{_CHARACTER}", re.S | re.M),
    "java": re.compile(rf"{_SLASHES}|\"\"\".*?\"\"\"|{_STRING}|{_CHARACTER}", re.S),
}
SILENT |= {"typescript": SILENT["javascript"], "cpp": SILENT["c"], "swift": SILENT["java"]}
TOKEN = re.compile(r"\n|[A-Za-z_$][\w$]*|::|=>|\S")
NAME = re.compile(r"[A-Za-z_$]")


def language(path):
    """Column: the language of a path's extension, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.regexp_extract(path, r"\.([^./]+)$", 1))


def tokens(lang: str, source: str) -> list[tuple[str, int]]:
    """(token, line) of what is neither comment nor literal; a literal keeps its lines and stands as one quote."""
    out, line = [], 1
    for m in TOKEN.finditer(SILENT[lang].sub(lambda m: ('"' if m[0][0] in "\"'`r" else " ") + "\n" * m[0].count("\n"), source)):
        if m[0] == "\n":
            line += 1
        else:
            out.append((m[0], line))
    return out


def headed(lang: str, header: list[tuple[str, int]]) -> tuple[str, int] | None:
    """(name, first line) if the tokens before a block's brace head a function."""
    words = [t for t, _ in header]
    lead = INTRODUCED.get(lang)
    if lead in words:
        at = len(words) - 1 - words[::-1].index(lead)
        k = at + 1
        if lang == "go" and words[k : k + 1] == ["("]:  # the receiver
            k = closing(words, k) + 1
        k += words[k : k + 1] == ["*"]
        if k < len(words) and NAME.match(words[k]):
            return words[k], header[at][1]
    if lang not in BY_PARAMETERS:
        return None
    depth = 0
    for k, t in enumerate(words):
        if t == "=" and not depth and lang not in ("javascript", "typescript"):
            return None
        if t == "(" and not depth and k and NAME.match(words[k - 1]) and words[k - 1] not in CONTROL:
            first = k - 1
            while first >= 2 and words[first - 1] in ("::", "~"):
                first -= 2 if words[first - 1] == "::" else 1
            before = words[first - 1] if first else ""
            end = closing(words, k)
            if before not in ("@", ".", "new", "=") and "=>" not in words[end:] and "=" not in words[end:] and not words[k - 1].startswith("__attribute"):
                # Where statements end with their line, the header starts with the name's.
                lines = [n for _, n in header]
                start = lines[first] if lang in ("javascript", "typescript", "bash") else lines[0]
                return "".join(words[first:k]), start
        depth += (t == "(") - (t == ")")
    return None


def closing(words: list[str], at: int) -> int:
    """Where the parenthesis at ``at`` closes."""
    depth = 0
    for k in range(at, len(words)):
        depth += (words[k] == "(") - (words[k] == ")")
        if not depth:
            return k
    return len(words) - 1


def spans(lang: str, source: str) -> list[tuple[int, int, str]]:
    """(first line, last line, name) of the functions, by place."""
    if lang == "python":
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            return []
        found = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
        return sorted((n.lineno, n.end_lineno, n.name) for n in found)
    out: list[tuple[int, int, str]] = []
    blocks: list[tuple[str, int] | None] = []
    header: list[tuple[str, int]] = []
    depth = 0  # of parentheses: a semicolon inside them ends nothing
    for token, line in tokens(lang, source):
        if token == "{" and not depth:
            blocks.append(headed(lang, header))
            header = []
        elif token == "}" and not depth:
            if blocks and (head := blocks.pop()):
                out.append((head[1], line, head[0]))
            header = []
        elif token == ";" and not depth or token == ":" and header and header[-1][0] in ("public", "private", "protected"):
            header = []
        else:
            depth = max(0, depth + (token == "(") - (token == ")"))
            header.append((token, line))
    return sorted(out)


def cut(lang: str, source: str) -> list[tuple[int, int, str, str]]:
    """(first line, last line, name, text) of each function and what is attached to it."""
    lines, marks, out = source.split("\n"), ATTACHED.get(lang, OTHERS), []
    for start, end, name in spans(lang, source):
        above = sum(1 for _ in takewhile(lambda x: x.strip().startswith(marks), reversed(lines[: start - 1])))
        out.append((start - above, end, name, "\n".join(lines[start - above - 1 : end])))
    return out


def functions(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """One row per function: the other columns, start, end, heading (its name), text."""
    kind = "array<struct<start:int,end:int,heading:string,text:string>>"
    read = F.udf(lambda lang, source: cut(lang, source or "") if lang else [], kind, useArrow=True)
    keep = [c for c in files.columns if c != text]
    some = files.withColumn("_lang", language(F.col(path))).where("_lang is not null")
    return some.withColumn("_u", F.explode(read("_lang", text))).select(*keep, "_u.start", "_u.end", "_u.heading", "_u.text")


def statements(lang: str, source: str) -> tuple[int, list[int]]:
    """Of a function's own text: the lines of its header, and the lines (from 0) on which a
    statement of its body starts."""
    lines = source.split("\n")
    if lang == "python":
        try:
            node = ast.parse(textwrap.dedent(source)).body[0]
        except (SyntaxError, ValueError, IndexError):
            return 1, list(range(1, len(lines)))
        body = getattr(node, "body", [])
        starts = [min([x.lineno, *[d.lineno for d in getattr(x, "decorator_list", [])]]) - 1 for x in body]
        return (starts[0], starts) if starts and starts[0] else (1, list(range(1, len(lines))))
    depth, header, starts, fresh = 0, None, [], True
    for token, line in tokens(lang, source):
        if header is not None and depth == 1 and fresh and token != "}" and (not starts or starts[-1] < line - 1):
            starts.append(line - 1)
        fresh = False
        if token == "{":
            depth += 1
            if header is None:
                header, fresh = line, True
        elif token == "}":
            depth -= 1
            fresh = depth == 1
        elif token == ";" and depth == 1:
            fresh = True
    return (header or 1, starts or list(range(header or 1, len(lines))))


def chunks(lang: str, source: str, budget: int) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of a function in pieces of at most ``budget``
    characters: the statements of its body, neighbours together while there is room, each
    piece under the header.  A statement too long by itself is a piece of its own."""
    lines = source.rstrip("\n").split("\n")
    if len(source) <= budget:
        return [(0, len(lines) - 1, "\n".join(lines))]
    header, starts = statements(lang, source)
    head, out = "\n".join(lines[:header]), []
    edges = sorted({header, *[s for s in starts if header < s < len(lines)]}) + [len(lines)]
    first = edges[0]
    for a, b in zip(edges, edges[1:]):
        if a > first and len(head) + 1 + len("\n".join(lines[first:b])) > budget:
            out.append((first, a - 1, head + "\n" + "\n".join(lines[first:a])))
            first = a
    out.append((first, len(lines) - 1, head + "\n" + "\n".join(lines[first:])))
    return out


def chunked(units: DataFrame, budget: int, path: str = "path", text: str = "text") -> DataFrame:
    """Functions (path, text and the other columns) in chunks: start and end count from the function's first line."""
    kind = "array<struct<first:int,last:int,text:string>>"
    cut_ = F.udf(lambda lang, source: chunks(lang or "c", source or "", budget), kind, useArrow=True)
    keep = [c for c in units.columns if c not in (text, "start", "end")]
    each = units.withColumn("_c", F.explode(cut_(language(F.col(path)), F.col(text))))
    return each.select(*keep, (F.col("_c.first") + 1).alias("start"), (F.col("_c.last") + 1).alias("end"), F.col("_c.text").alias("text"))
