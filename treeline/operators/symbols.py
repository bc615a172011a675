"""Symbols, imports and calls from the node tables of parsed sources."""

from __future__ import annotations

import ast
import bisect
import itertools
import keyword
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.model import Node, Tree
from treeline.operators.labels import recovered, usable
from treeline.sources.parsers import PARSERS, parse_python
from treeline.storage import spread

#: Which kinds of nodes define functions, call and import, by language.
FUNCTIONS = {
    "python": {"function_definition"}, "rust": {"function_item"}, "go": {"function_declaration", "method_declaration"}, "java": {"method_declaration", "constructor_declaration"},
    **dict.fromkeys(("javascript", "typescript", "tsx"), {"function_declaration", "method_definition"}),
}
CALLS = {"python": "call", "java": "method_invocation"} | dict.fromkeys(("javascript", "typescript", "tsx", "rust", "go"), "call_expression")
IMPORTS = {
    "python": {"import_statement", "import_from_statement"}, "rust": {"use_declaration"}, "go": {"import_declaration"}, "java": {"import_declaration"},
    **dict.fromkeys(("javascript", "typescript", "tsx"), {"import_statement"}),
}
_HEAD = re.compile(r"([\w.:$]+?)!?\s*\(")
_TARGETS = [re.compile(p) for p in (r"from\s+([\w.]+)\s+import\b", r"[^'\"]*['\"]([^'\"]+)['\"]", r"use\s+([\w:]+)", r"import\s+(?:static\s+)?([\w.]+)")]
#: Node kinds by the symbol that they declare.
SYMBOL_KINDS = {
    **{f"{what}_{form}": what for what in ("function", "class", "type", "method") for form in ("declaration", "definition")},
    **{f"{what}_declaration": what for what in ("interface", "variable", "module", "namespace", "enum", "field", "property", "constructor")},
    "let_declaration": "variable", "const_declaration": "constant", "constant": "constant",
}
VISIBILITIES = {"pub": "public", "public": "public", "priv": "private", "private": "private", "protected": "protected", "internal": "internal", "package": "package"}


def _group(text: str, at: int) -> tuple[int, list[str]]:
    """Where the bracket that opens at `at` closes, and what stands between the commas inside it, nested ones left alone."""
    depth, begin, parts, quote = 0, at + 1, [], ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "'\"`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return i, [x for x in [*parts, text[begin:i]] if x.strip()]
        elif c == "," and depth == 1:
            parts.append(text[begin:i])
            begin = i + 1
    return len(text), [x for x in [*parts, text[begin:]] if x.strip()]


def _definition(node: Node, language: str) -> tuple | None:
    name = node.child("name")
    if name is None:
        return None
    body = node.child("body")
    return _signature(node.text, name.text, name.end - node.start, None if body is None or language == "python" else body.start - node.start, language)


def _signature(text: str, name: str, after: int, body: int | None, language: str) -> tuple[str, str, int]:
    """Name, signature and number of arguments of a definition's text, whose name ends at `after`."""
    at = text.find("(", after)
    close, args = _group(text, at) if at >= 0 else (len(name) - 1, [])
    stop = (_PYTHON_STOP if language == "python" else _STOP).search(text[close + 1 :]).start() + close + 1
    if body is not None:
        stop = min(stop, body)
    return name, text[:stop].strip(), len(args)


_STOP, _PYTHON_STOP = re.compile(r"[{;\n]|$"), re.compile(r":(?!:)|$")
_PYTHON_DEF = re.compile(r"(?:async(?:[ \t]|\\\n)+)?def(?:[ \t]|\\\n)+([A-Za-z_][A-Za-z_0-9]*)")
_PYTHON_WHAT = {ast.FunctionDef: "def", ast.AsyncFunctionDef: "def", ast.Call: "call", ast.Import: "import", ast.ImportFrom: "import"}
_BARE = (ast.Name, ast.Constant, ast.alias, ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop)
#: Deeper sources are left to the tree, whose parser reads very deep ones as bracketed code.
_DEEP = 100
#: Fields that hold names, numbers, operators or bare nodes only; a type alias has a node for its name.
_PLAIN = {"arg", "attr", "conversion", "ctx", "id", "is_async", "kind", "kwd_attrs", "level", "module", "name", "names", "op", "ops", "rest", "simple", "type_comment", "type_ignores"}
_ODD = re.compile(r"[$\r\f\v\0\x1a]")


def _kinds(kind: type) -> Iterator[type]:
    yield kind
    for below in kind.__subclasses__():
        yield from _kinds(below)


#: The fields in which nodes of a kind may hold others, for all that aren't bare.
_BELOW = {k: tuple(f for f in k._fields if f not in _PLAIN or f == "name" and k.__name__ == "TypeAlias") for k in _kinds(ast.AST) if not issubclass(k, _BARE)}


def _parsed_spots(source: str) -> list[tuple[str, int, int]] | None:
    """(what, start, end) of the definitions, calls and imports in a Python source, straight from the interpreter's own parser.

    They stand where the nodes of the source's tree do, at a fraction of the
    work: no tokens, no other nodes. None where only the tree can say: deep
    nesting, errors.
    """
    try:
        module = compile(source, "<source>", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except Exception:  # the tree's parser meets the same and knows what to make of it
        return None
    lines = [0]
    for line in source.split("\n"):
        lines.append(lines[-1] + len(line) + 1)
    spots, level, depth = [], [module], 0
    while level:
        if depth > _DEEP:
            return None
        below: list[ast.AST] = []
        for node in level:
            kind = type(node)
            if kind in _PYTHON_WHAT:
                spots.append((_PYTHON_WHAT[kind], lines[node.lineno - 1] + node.col_offset, lines[node.end_lineno - 1] + node.end_col_offset))
            for name in _BELOW[kind]:
                value = getattr(node, name, None)
                if type(value) is list:
                    below += [x for x in value if type(x) in _BELOW]
                elif type(value) in _BELOW:
                    below.append(value)
        level, depth = below, depth + 1
    return sorted(spots, key=lambda s: (s[1], -s[2]))


#: Comments, strings of one line, numbers and words, between which all other text is told as it is.
_PIECES = re.compile(r"""(\#[^\n]*|[A-Za-z]{0,2}(?:"[^"\n]*"|'[^'\n]*')|\d[\w.]*|\w+|["'])""", re.A)
#: Escapes, formatted and long strings, and what stands for pieces in a shape.
_SHAPELESS = re.compile(r"""[\\\0-\x08\x0b-\x1f\x7f]|\"{3}|'{3}|[fFtT][rR]?["']|[rR][fFtT]["']""")
#: Words that the grammar knows, or may treat in ways of their own.
_WORDS = frozenset(keyword.kwlist + keyword.softkwlist + ["barry_as_FLUFL"])
_SHAPED = 4096
_shapes: dict[str, list[tuple]] = {}


def _shape_of(piece: str) -> str:
    first = piece[0]
    if first == "#":
        return "\3"
    if piece[-1] in "\"'":
        if len(piece) == 1:
            return ""  # it opens a string that doesn't end
        return piece.partition(piece[-1])[0] + "\2"
    if first.isdigit():
        return "\1" if piece.isdigit() and (first != "0" or len(piece) == 1) and len(piece) < 19 else piece
    return piece if piece in _WORDS or piece.startswith("__") else "\0"


def _python_spots(source: str) -> list[tuple[str, int, int]] | None:
    """What `_parsed_spots` says, from a source of the same shape if a worker has met one; None also for what isn't plain ASCII, pattern variables, odd line ends.

    Two sources have the same shape if they differ in names, whole numbers,
    texts of plain strings and comments alone. These make no difference to the
    grammar, so spots lie between the same pieces. Of short sources alone, and
    of _SHAPED at a time, shapes are kept.
    """
    if PARSERS.get("python") is not parse_python or not source.isascii() or _ODD.search(source):
        return None
    if len(source) > _SHAPED or _SHAPELESS.search(source):
        return _parsed_spots(source)
    pieces = _PIECES.split(source)
    shapes = pieces[:]
    shapes[1::2] = [_shape_of(x) for x in pieces[1::2]]
    if "" in shapes[1::2]:
        return _parsed_spots(source)
    shape = "".join(shapes)
    starts = list(itertools.accumulate(map(len, pieces), initial=0))
    known = _shapes.get(shape)
    if known is not None:
        return [(what, starts[i] + a, starts[j] + b) for what, i, a, j, b in known]
    spots = _parsed_spots(source)
    if spots is not None:
        known = []
        for what, a, b in spots:
            i, j = (bisect.bisect_right(starts, x, hi=len(pieces)) - 1 for x in (a, b))
            known.append((what, i, a - starts[i], j, b - starts[j]))
        if all(not (i % 2 and a) and not (j % 2 and b) for _, i, a, j, b in known):  # none begins or ends within a piece
            if len(_shapes) >= _SHAPED:
                _shapes.clear()
            _shapes[shape] = known
    return spots


_ROW = "file_id string, what string, name string, receiver string, start_char int, end_char int, signature string, n_args int, language string"


WHATS = frozenset(("def", "call", "import"))


def _extracted(fid: str, content: str, language: str, recovery: str, wanted: frozenset[str] = WHATS) -> Iterator[tuple]:
    """The rows of one source that are wanted: Python's from its spots, others' from the tree."""
    spots = _python_spots(content) if language == "python" else None
    heads = [_PYTHON_DEF.match(content, a) for what, a, _ in spots or () if what == "def"]
    if spots is None or not all(heads):
        yield from _of_tree(fid, recovered(content, language, recovery), language, wanted)
        return
    names = iter(heads)
    for what, a, b in spots:
        m = next(names) if what == "def" else None
        if what not in wanted:
            continue
        text = content[a:b]
        if m is not None:
            name, signature, n = _signature(text, m[1], m.end() - a, None, language)
            yield fid, "def", name, None, a, b, signature, n, language
        elif (row := _call(text) if what == "call" else _import(text)) is not None:
            yield fid, what, row[0], row[1], a, b, None, row[2], language


def _last(rows: Iterator[tuple]) -> Iterator[tuple]:
    """A source's rows, with the last of its definitions of each name."""
    last: dict[str, tuple] = {}
    for row in rows:
        if row[1] != "def":
            yield row
        elif (held := last.get(row[2])) is None or held[4:6] <= row[4:6]:
            last[row[2]] = row
    yield from last.values()


def _of_tree(fid: str, tree: Tree | None, language: str, wanted: frozenset[str] = WHATS) -> Iterator[tuple]:
    defs = FUNCTIONS[language] if "def" in wanted else ()
    call = CALLS[language] if "call" in wanted else None
    imports = IMPORTS[language] if "import" in wanted else ()
    for n in tree.nodes if tree is not None else ():
        if n.kind in defs and (found := _definition(n, language)) is not None:
            yield fid, "def", found[0], None, n.start, n.end, found[1], found[2], language
        elif n.kind == call and (row := _call(n.text)) is not None:
            yield fid, "call", row[0], row[1], n.start, n.end, None, row[2], language
        elif n.kind in imports and (row := _import(n.text)) is not None:
            yield fid, "import", row[0], row[1], n.start, n.end, None, row[2], language


def _call(text: str) -> tuple[str, str | None, int] | None:
    """Name, receiver and number of arguments."""
    m = _HEAD.match(text)
    if m is None:
        return None
    head = re.split(r"\.|::", m[1])
    return head[-1], m[1][: len(m[1]) - len(head[-1])].rstrip(".:") or None, len(_group(text, m.end() - 1)[1])


def _import(text: str) -> tuple[str, None, None] | None:
    target = next((m[1] for p in _TARGETS if (m := p.match(text)) is not None), None)
    return (target, None, None) if target else None


def extract(sources: DataFrame, recovery: str = "partial", wanted: frozenset[str] = WHATS, last: bool = False) -> DataFrame:
    """(file_id, what, name, receiver, start_char, end_char, signature, n_args, language) of sources (file_id, language, content), each parsed once.

    what: def, call or import. Calls aren't resolved; an import's name is its
    target. Arguments are counted at the top level of the brackets. wanted: only
    these leave the task. last: so do, of a source's definitions of a name, only
    the last one.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _ROW.split(", ")]
        for frame in frames:
            rows: list[tuple] = []
            for fid, language, content in zip(frame.file_id, frame.language, frame.content):
                found = _extracted(fid, content, language, recovery, wanted)
                rows += _last(found) if last else found
            out = pd.DataFrame(rows, columns=names)
            for c in ("start_char", "end_char", "n_args"):
                out[c] = out[c].astype("Int32")
            yield out

    known = sources.where(F.col("language").isin(sorted(FUNCTIONS)) & usable())
    return spread(known.select("file_id", "language", "content")).mapInPandas(run, _ROW)


def functions(sources: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """(file_id, name, start_char, end_char, signature, n_args): definitions; of equal names the last one stays, which a task knows of its sources. extracted: what `extract` says, if it is at hand."""
    columns = ["file_id", "name", "start_char", "end_char", "signature", "n_args"]
    if extracted is None:
        return extract(sources, wanted=frozenset(("def",)), last=True).select(columns)
    found = extracted.where("what = 'def'")
    return found.groupBy("file_id", "name").agg(F.max(F.struct("start_char", "end_char", "signature", "n_args")).alias("s")).select("file_id", "name", "s.*")


def imports(sources: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """(file_id, target): what a file imports."""
    found = extract(sources, wanted=frozenset(("import",))) if extracted is None else extracted
    return found.where("what = 'import'").select("file_id", F.col("name").alias("target")).distinct()


def calls(sources: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """(file_id, name, receiver, start_char, n_args): calls, not yet resolved."""
    found = extract(sources, wanted=frozenset(("call",))) if extracted is None else extracted
    return found.where("what = 'call'").select("file_id", "name", "receiver", "start_char", "n_args")


def argument_count(args: Column) -> Column:
    """Non-empty pieces between commas."""
    return F.size(F.filter(F.split(args, ","), lambda x: F.trim(x) != ""))


def symbol_kind(kind: Column) -> Column:
    """What a node kind declares, by SYMBOL_KINDS; any other kind is `other:` and itself."""
    return _named(SYMBOL_KINDS, kind)


def visibility(modifier: Column) -> Column:
    """One of VISIBILITIES; any other modifier is `other:` and itself."""
    return _named(VISIBILITIES, modifier)


def _named(names: dict[str, str], value: Column) -> Column:
    out = F.concat(F.lit("other:"), value)
    for word, name in names.items():
        out = F.when(value == word, name).otherwise(out)
    return out


def span_contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_start) & (b_end <= a_end)


def span_overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def file_summary(nodes: DataFrame) -> DataFrame:
    """(file_id, n_nodes, n_edges, n_lines) of parsed files."""
    return nodes.groupBy("file_id").agg(F.count("*").alias("n_nodes"), F.sum((F.col("parent") >= 0).cast("bigint")).alias("n_edges"), (F.max("end_line") + 1).cast("bigint").alias("n_lines"))
