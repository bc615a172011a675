"""Parsers from text to trees: HTML, JSON, YAML, Python, CSS, and bracketed code for all other languages, some with kinds of their own (`code`).

They are total: any text gives a tree, what can't be understood becomes an
ERROR node. `$NAME`, `$$NAME` and `$$$NAME` are accepted wherever a name may
stand, so that patterns parse like the code they match. If a `tree_sitter`
module with a `get_parser` is importable, `register` may put it in place of any
of these.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Iterator

from treeline.model import Node, Tree
from treeline.sources import code

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CLOSED_BY = {"p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "article", "section", "nav", "footer"}, "li": {"li"}, "td": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
_TAG = re.compile(r"<(/?)([A-Za-z$][\w:.$-]*)")
_RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in ("script", "style")}
_ATTRIBUTE = re.compile(r"""\s*([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


def parse_html(source: str) -> Node:
    root = Node("document", 0, len(source))
    stack, names = [root], [""]
    open_now: dict[str, int] = {}  # how many elements of a name are open, so that an end tag without one doesn't look through all

    def close(at: int) -> None:
        stack.pop().end = at
        open_now[names.pop()] -= 1

    def opened(element: Node, name: str) -> None:
        stack.append(element)
        names.append(name)
        open_now[name] = open_now.get(name, 0) + 1

    at, n = 0, len(source)
    while at < n:
        if source[at] != "<":
            end = source.find("<", at)
            end = n if end < 0 else end
            text = source[at:end]
            if text.strip():
                lead = len(text) - len(text.lstrip())
                stack[-1].add(Node("text", at + lead, at + lead + len(text.strip())))
            at = end
            continue
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = n if end < 0 else end + 3
            stack[-1].add(Node("comment", at, end))
            at = end
            continue
        if source.startswith("<!", at) or source.startswith("<?", at):
            end = source.find(">", at)
            end = n if end < 0 else end + 1
            stack[-1].add(Node("doctype", at, end))
            at = end
            continue
        m = _TAG.match(source, at)
        if not m:
            stack[-1].add(Node("text", at, at + 1))
            at += 1
            continue
        name, end = m[2].lower(), source.find(">", m.end())
        if m[1]:
            end = n if end < 0 else end + 1
            open_at = next(i for i in range(len(stack) - 1, 0, -1) if names[i] == name) if open_now.get(name) else None
            if open_at is None:
                tag = stack[-1].add(Node("erroneous_end_tag", at, end))
            else:
                while len(stack) - 1 > open_at:
                    close(at)
                tag = stack[-1].add(Node("end_tag", at, end))
            tag.add(Node("</", at, at + 2, named=False))
            tag.add(Node("tag_name", m.start(2), m.end(2), field="name"))
            tag.add(Node(">", end - 1, end, named=False))
            if open_at is not None:
                close(end)
            at = end
            continue
        while len(stack) > 1 and name in _CLOSED_BY.get(names[-1], ()):
            close(at)
        raw = name in ("script", "style")
        element = stack[-1].add(Node(f"{name}_element" if raw else "element", at, n))
        tag = element.add(Node("start_tag", at, n))
        tag.add(Node("<", at, at + 1, named=False))
        tag.add(Node("tag_name", m.start(2), m.end(2), field="name"))
        pos = m.end()
        while pos < n and source[pos] != ">":
            if source[pos].isspace() or source[pos] == "/":
                pos += 1
                continue
            a = _ATTRIBUTE.match(source, pos)
            if not a or a.end() == pos:
                pos += 1
                continue
            attribute = tag.add(Node("attribute", a.start(1), a.end()))
            attribute.add(Node("attribute_name", a.start(1), a.end(1), field="name"))
            if a[2] is not None:
                attribute.add(Node("=", source.index("=", a.end(1)), source.index("=", a.end(1)) + 1, named=False))
                if a[2][0] in "\"'":
                    quoted = attribute.add(Node("quoted_attribute_value", a.start(2), a.end(2), field="value"))
                    quoted.add(Node(a[2][0], a.start(2), a.start(2) + 1, named=False))
                    if a.end(2) - a.start(2) > 2:
                        quoted.add(Node("attribute_value", a.start(2) + 1, a.end(2) - 1))
                    quoted.add(Node(a[2][0], a.end(2) - 1, a.end(2), named=False))
                else:
                    attribute.add(Node("attribute_value", a.start(2), a.end(2), field="value"))
            pos = a.end()
        tag.end = min(n, pos + 1)
        tag.add(Node(">", tag.end - 1, tag.end, named=False))
        at = tag.end
        if raw:
            tail = _RAW_END[name].search(source, at)
            end = tail.start() if tail else n
            if end > at:
                element.add(Node("raw_text", at, end))
            at = end
            opened(element, name)
        elif name in _VOID or source[tag.end - 2 : tag.end] == "/>":
            element.end = tag.end
        else:
            opened(element, name)
    while len(stack) > 1:
        close(n)
    return root


_JSON = re.compile(r'\s+|"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|\$+[A-Z_][A-Z0-9_]*|\$\$\$|[\[\]{}:,]|.', re.S)


def parse_json(source: str) -> Node:
    root = Node("document", 0, len(source))
    stack = [root]
    for m in _JSON.finditer(source):
        t, a, b = m[0], m.start(), m.end()
        if t.isspace():
            continue
        top = stack[-1]
        if t in "}]" and t:
            while stack[-1].kind == "pair":
                stack.pop()
            want = {"}": "object", "]": "array"}[t]
            if stack[-1].kind == want:
                stack[-1].add(Node(t, a, b, named=False))
                stack.pop().end = b
            else:
                stack[-1].add(Node("ERROR", a, b, error=True))
            _after_value(stack, b)
        elif t == ",":
            if stack[-1].kind == "pair":
                stack.pop()
            stack[-1].add(Node(t, a, b, named=False))
        elif t == ":":
            top.add(Node(t, a, b, named=False, error=top.kind != "pair"))
            if top.kind == "pair":
                top.end = b
        else:
            if top.kind == "object" and not (t.startswith("$$$")):
                top = top.add(Node("pair", a, b))
                stack.append(top)
            role = {"pair": "value" if top.children else "key"}.get(top.kind)
            if t in "{[":
                node = top.add(Node({"{": "object", "[": "array"}[t], a, len(source), field=role))
                node.add(Node(t, a, b, named=False))
                stack.append(node)
                continue
            kind = "string" if t[0] == '"' else "identifier" if t[0] == "$" else t if t in ("true", "false", "null") else "number" if t[0] in "-0123456789" else "ERROR"
            node = top.add(Node(kind, a, b, field=role, error=kind == "ERROR"))
            if kind == "string":
                node.add(Node('"', a, a + 1, named=False))
                if b - a > 2:
                    node.add(Node("string_content", a + 1, b - 1))
                node.add(Node('"', b - 1, b, named=False))
            _after_value(stack, b)
    for node in stack[1:]:
        node.error = True
        node.end = len(source)
    return root


def _after_value(stack: list[Node], end: int) -> None:
    if stack[-1].kind == "pair":
        stack[-1].end = end
        if len(stack[-1].children) >= 3:
            stack.pop()


def parse_yaml(source: str) -> Node:
    import yaml

    root = Node("stream", 0, len(source))

    def build(event: yaml.Node, into: Node, field: str | None = None, seen: tuple = ()) -> None:
        a, b = event.start_mark.index, max(event.start_mark.index, event.end_mark.index)
        b = a + len(source[a:b].rstrip())
        if any(s is event for s in seen):
            into.add(Node("alias", a, b, field=field))
            return
        if isinstance(event, yaml.MappingNode):
            node = into.add(Node("mapping", a, b, field=field))
            for key, value in event.value:
                start, stop = key.start_mark.index, max(key.end_mark.index, value.end_mark.index)
                pair = node.add(Node("pair", start, start + len(source[start:stop].rstrip())))
                build(key, pair, "key", (*seen, event))
                build(value, pair, "value", (*seen, event))
        elif isinstance(event, yaml.SequenceNode):
            node = into.add(Node("sequence", a, b, field=field))
            for item in event.value:
                build(item, node, None, (*seen, event))
        else:
            kind = {"tag:yaml.org,2002:int": "integer", "tag:yaml.org,2002:float": "float", "tag:yaml.org,2002:bool": "boolean", "tag:yaml.org,2002:null": "null"}.get(event.tag, "string")
            into.add(Node(kind, a, b, field=field))

    try:
        for document in yaml.compose_all(source, Loader=yaml.SafeLoader):
            if document is not None:
                node = root.add(Node("document", document.start_mark.index, max(document.start_mark.index, document.end_mark.index)))
                build(document, node)
    except (yaml.YAMLError, RecursionError):
        root.add(Node("ERROR", root.children[-1].end if root.children else 0, len(source), error=True))
    return root


_PY_KINDS = {
    "Module": "module", "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "Call": "call", "Name": "identifier",
    "Attribute": "attribute", "Expr": "expression_statement", "Import": "import_statement", "ImportFrom": "import_from_statement", "Return": "return_statement", "Assign": "assignment",
    "AugAssign": "augmented_assignment", "AnnAssign": "assignment", "If": "if_statement", "For": "for_statement", "While": "while_statement", "With": "with_statement", "Try": "try_statement",
    "BinOp": "binary_operator", "Compare": "comparison_operator", "BoolOp": "boolean_operator", "UnaryOp": "unary_operator", "List": "list", "Tuple": "tuple", "Dict": "dictionary", "Set": "set",
    "Subscript": "subscript", "Lambda": "lambda", "Raise": "raise_statement", "Assert": "assert_statement", "Pass": "pass_statement", "Delete": "delete_statement", "arguments": "parameters", "arg": "parameter",
    "keyword": "keyword_argument", "alias": "dotted_name", "JoinedStr": "string", "Starred": "list_splat", "ListComp": "list_comprehension", "IfExp": "conditional_expression", "Await": "await",
}
_PY_FIELDS = {("Call", "func"): "function", ("Attribute", "value"): "object", ("Assign", "targets"): "left", ("Assign", "value"): "right", ("BinOp", "left"): "left", ("BinOp", "right"): "right", ("keyword", "value"): "value", ("If", "test"): "condition", ("While", "test"): "condition", ("Return", "value"): "value"}
EXPANDO = "µ"


def parse_python(source: str) -> Node:
    text = re.sub(r"\$(?=\$*[A-Z_])|\$(?=\$)|(?<=\$\$)\$", EXPANDO, source)
    try:
        module = ast.parse(text)
        tokens = list(tokenize.generate_tokens(io.StringIO(text).readline))
    except (SyntaxError, ValueError, tokenize.TokenError, RecursionError):
        return parse_brackets(source)
    lines = [0]
    for line in text.split("\n"):
        lines.append(lines[-1] + len(line) + 1)
    raw = [line.encode() for line in text.split("\n")]

    def at(line: int, byte: int) -> int:
        row = raw[line - 1] if line - 1 < len(raw) else b""
        return lines[line - 1] + (byte if len(row) == lines[line] - lines[line - 1] - 1 else len(row[:byte].decode("utf-8", "replace")))

    root = Node("module", 0, len(source))
    skip = (tokenize.NEWLINE, tokenize.NL, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER)
    leaves = []
    for t in tokens:
        if t.type in skip or not t.string:
            continue
        a, b = lines[t.start[0] - 1] + t.start[1], lines[t.end[0] - 1] + t.end[1]
        if t.type == tokenize.COMMENT:
            leaves.append(Node("comment", a, b))
        elif t.type == tokenize.NAME and not (t.string in ("def", "class", "return", "import", "from", "if", "else", "elif", "for", "while", "in", "is", "not", "and", "or", "lambda", "with", "as", "try", "except", "finally", "raise", "assert", "pass", "del", "global", "nonlocal", "yield", "async", "await", "break", "continue", "True", "False", "None")):
            leaves.append(Node("identifier", a, b))
        elif t.type == tokenize.NUMBER:
            leaves.append(Node("integer" if t.string.isdigit() else "float", a, b))
        elif t.type == tokenize.STRING or t.type in (getattr(tokenize, "FSTRING_START", -1), getattr(tokenize, "FSTRING_MIDDLE", -1), getattr(tokenize, "FSTRING_END", -1)):
            leaves.append(Node("string", a, b))
        else:
            leaves.append(Node(t.string, a, b, named=t.string in ("True", "False", "None")))
    spans: list[Node] = []

    def visit(node: ast.AST, into: Node, field: str | None) -> None:
        here = into
        name = type(node).__name__
        if hasattr(node, "lineno") and name not in ("Name", "Constant"):
            a, b = at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset)
            here = into.add(Node(_PY_KINDS.get(name, re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()), a, b, field=field))
            spans.append(here)
        for part, value in ast.iter_fields(node):
            for child in value if isinstance(value, list) else [value]:
                if isinstance(child, ast.AST):
                    visit(child, here, _PY_FIELDS.get((name, part), part if part in ("body", "value", "test") else None))

    try:
        visit(module, root, None)
        _hang(root, leaves)
    except RecursionError:
        return parse_brackets(source)
    for node in spans:  # the name of a definition is the identifier after def or class
        if node.kind in ("function_definition", "class_definition"):
            for child in node.children:
                if child.kind == "identifier":
                    child.field = "name"
                    break
        if node.kind == "call":
            first = node.children[0] if node.children else None
            if first is not None and first.kind in ("identifier", "attribute"):
                first.field = "function"
        if node.kind == "attribute" and node.children and node.children[-1].kind == "identifier":
            node.children[-1].field = "attribute"
    return root


def _hang(root: Node, leaves: list[Node]) -> None:
    """Puts leaves under the innermost node around them, all children in source order."""

    def order(node: Node) -> None:
        node.children.sort(key=lambda c: (c.start, -c.end))
        for i, c in enumerate(node.children):
            c.index, c.parent = i, node
            order(c)

    order(root)
    for leaf in leaves:
        node = root
        while True:
            inner = next((c for c in node.children if c.children is not None and c.start <= leaf.start and leaf.end <= c.end and (c.end - c.start > leaf.end - leaf.start or c.kind in ("argument",))), None)
            if inner is None:
                break
            node = inner
        if not any(c.start == leaf.start and c.end == leaf.end for c in node.children):
            node.add(leaf)
    order(root)


_CODE = re.compile(
    r"""\s+|//[^\n]*|/\*.*?\*/|\#[^\n]*|\$\$\$[A-Z_0-9]*|\$+[A-Z_][A-Z0-9_]*|[^\W\d]\w*|\d[\w.]*|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|=>|->|::|==|!=|<=|>=|&&|\|\||\+=|-=|.""", re.S
)
_GOES_ON = re.compile(r"[{.?:,&|]|=>|(?:else|catch|finally|where|extends|implements)\b")
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_GROUPS = {"(": "arguments", "[": "brackets", "{": "block"}


def parse_brackets(source: str) -> Node:
    """Bracketed code: tokens, balanced groups, calls (a name with arguments right after it) and statements."""
    root = Node("program", 0, len(source))
    stack = [root]

    def wrap(parent: Node, kind: str, start: int) -> None:
        """The children from start on become one node."""
        inner = parent.children[start:]
        node = Node(kind, inner[0].start, inner[-1].end)
        del parent.children[start:]
        for c in inner:
            node.add(c)
        parent.add(node)

    begins = [0]
    for m in _CODE.finditer(source):
        t, a, b = m[0], m.start(), m.end()
        if t.isspace():
            # a line that begins like this goes on with the statement before it
            if "\n" in t and stack[-1].kind in ("program", "block") and not _GOES_ON.match(source, b):
                _end_statement(stack[-1], begins, wrap)
            continue
        top = stack[-1]
        if t in _PAIRS:
            node = top.add(Node(_GROUPS[t], a, len(source)))
            node.add(Node(t, a, b, named=False))
            stack.append(node)
            begins.append(1)
        elif t in ")]}":
            if len(stack) > 1 and _PAIRS[source[top.start]] == t:
                if top.kind == "block":
                    _end_statement(top, begins, wrap)
                top.add(Node(t, a, b, named=False))
                top.end = b
                stack.pop()
                begins.pop()
                parent = stack[-1]
                i = len(parent.children) - 1
                if top.kind == "arguments" and i >= 1 and parent.children[i - 1].kind in ("identifier", "call", "member") and parent.children[i - 1].end == top.start:
                    parent.children[i - 1].field, top.field = "function", "arguments"
                    wrap(parent, "call", i - 1)
            else:
                top.add(Node("ERROR", a, b, error=True))
        elif t[:2] in ("//", "/*") or t[0] == "#":
            top.add(Node("comment", a, b))
        elif t[0] in "\"'`" and len(t) > 1:
            top.add(Node("string", a, b))
        elif t[0].isdigit():
            top.add(Node("number", a, b))
        elif t[0] == "$" and len(t) > 1 or t[0] == "_" or t[0].isalpha():
            top.add(Node("identifier", a, b))
            i = len(top.children) - 1
            if i >= 2 and top.children[i - 1].kind in (".", "::") and top.children[i - 2].kind in ("identifier", "call", "member") and top.children[i - 1].end == a:
                top.children[i - 2].field, top.children[i].field = "object", "property"
                wrap(top, "member", i - 2)
        elif t == ";" and top.kind in ("program", "block"):
            top.add(Node(t, a, b, named=False))
            _end_statement(top, begins, wrap)
        else:
            top.add(Node(t, a, b, named=False))
    for node in reversed(stack[1:]):
        node.error = True
    while len(stack) > 1:
        stack.pop()
        begins.pop()
    _end_statement(root, begins, wrap)
    return root


def _end_statement(node: Node, begins: list[int], wrap: Callable) -> None:
    start = begins[-1]
    while start < len(node.children) and node.children[start].kind == "comment":
        start += 1
    tail = len(node.children)
    if start < tail and not (tail - start == 1 and node.children[start].kind == "comment"):
        wrap(node, "statement", start)
    begins[-1] = len(node.children)


_CSS = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[{};]""", re.S)
_CSS_VALUE = re.compile(r"""/\*.*?\*/|"[^"]*"|'[^']*'|\#[0-9A-Fa-f]{3,8}\b|[-+]?\d*\.\d+[%\w]*|[-+]?\d+[%\w]*|!\s*important|[-\w$]+(?=\()|[-\w$]+|\S""", re.S)
_CSS_AT = {"@media": "media_statement", "@keyframes": "keyframes_statement", "@supports": "supports_statement", "@import": "import_statement", "@charset": "charset_statement", "@namespace": "namespace_statement"}
_CSS_SELECTOR = {".": "class_selector", "#": "id_selector", "[": "attribute_selector", ":": "pseudo_class_selector", "*": "universal_selector"}


def css_pieces(source: str) -> Iterator[tuple[str, int, int]]:
    """(mark, start, end) of what stands before each mark of a style sheet - {, }, ; or, at its end, none -, and of comments, marked /, that stand alone."""
    begin = 0
    for m in _CSS.finditer(source):
        t = m[0]
        if t[0] == "/":
            if not source[begin : m.start()].strip():
                yield "/", m.start(), m.end()
                begin = m.end()
        elif t in "{};":
            yield t, begin, m.start()
            begin = m.end()
    yield "", begin, len(source)


def css_values(source: str, start: int, end: int) -> Iterator[tuple[str, bool, int, int]]:
    """(kind, is_named, start, end) of the values behind a property's colon or an at-keyword."""
    for m in _CSS_VALUE.finditer(source, start, end):
        t, a, b = m[0], m.start(), m.end()
        if t.startswith("/*"):
            yield "comment", True, a, b
        elif t[0] in "\"'" and len(t) > 1:
            yield "string_value", True, a, b
        elif t[0] == "#" and len(t) > 1:
            yield "color_value", True, a, b
        elif t[0] == "!" and len(t) > 1:
            yield "important", True, a, b
        elif t[0].isdigit() or len(t) > 1 and t[0] in "+-." and (t[1].isdigit() or t[1] == "."):
            yield "float_value" if "." in t else "integer_value", True, a, b
        elif t[0] in "-$_" or t[0].isalpha():
            yield "function_name" if source[b : b + 1] == "(" else "plain_value", True, a, b
        else:
            yield t, False, a, b


def css_declarations(source: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """Each declaration's property and its named values (kind, text): those of the tree that parse_css makes, without its nodes."""
    for mark, begin, end in css_pieces(source):
        if mark in ("/", "{"):
            continue
        text = source[begin:end].strip()
        head, colon, _ = text.partition(":")
        if head and colon and head[0] != "@":
            start = source.index(":", begin) + 1
            yield head.rstrip(), [(kind, source[a:b]) for kind, named, a, b in css_values(source, start, begin + len(source[begin:end].rstrip())) if named]


def parse_css(source: str) -> Node:
    """Style sheets: rule_set > selectors, block > declaration > property_name and values; at-rules by their names."""
    n = len(source)
    root = Node("stylesheet", 0, n)
    stack = [root]

    def trimmed(a: int, b: int) -> tuple[int, int]:
        text = source[a:b]
        return a + len(text) - len(text.lstrip()), a + len(text.rstrip()) if text.strip() else a

    def selectors(into: Node, a: int, b: int) -> None:
        node = into.add(Node("selectors", a, b))
        at = a
        for piece in source[a:b].split(","):
            x, y = trimmed(at, at + len(piece))
            if y > x:
                if node.children:
                    comma = source.rindex(",", node.children[-1].end, x)
                    node.add(Node(",", comma, comma + 1, named=False))
                compound = any(c in source[x:y] for c in " >+~\n\t")
                node.add(Node("descendant_selector" if compound else _CSS_SELECTOR.get(source[x], "tag_name"), x, y))
            at += len(piece) + 1

    def plain(a: int, b: int) -> None:
        """What stands between two marks and is no rule: a declaration, or a statement of one line."""
        a, b = trimmed(a, b)
        if b <= a:
            return
        text, colon = source[a:b], source.find(":", a, b)
        if text[0] == "@":
            name = re.match(r"@[\w-]*", text)[0]
            node = stack[-1].add(Node(_CSS_AT.get(name, "at_rule"), a, b))
            node.add(Node("at_keyword", a, a + len(name), named=False))
            begin = a + len(name)
        elif colon > a:
            node = stack[-1].add(Node("declaration", a, b))
            x, y = trimmed(a, colon)
            node.add(Node("property_name", x, y))
            node.add(Node(":", colon, colon + 1, named=False))
            begin = colon + 1
        else:
            stack[-1].add(Node("ERROR", a, b, error=True))
            return
        for kind, named, x, y in css_values(source, begin, b):
            node.add(Node(kind, x, y, named=named))

    for mark, begin, end in css_pieces(source):
        if mark == "/":
            stack[-1].add(Node("comment", begin, end))
        elif mark == "{":
            a, b = trimmed(begin, end)
            name = re.match(r"@[\w-]*", source[a:b])
            node = stack[-1].add(Node(_CSS_AT.get(name[0], "at_rule") if name else "rule_set", a if b > a else end, n))
            if name:
                node.add(Node("at_keyword", a, a + len(name[0]), named=False))
                x, y = trimmed(a + len(name[0]), b)
                if y > x:
                    node.add(Node("query", x, y))
            elif b > a:
                selectors(node, a, b)
            block = node.add(Node("block", end, n))
            block.add(Node("{", end, end + 1, named=False))
            stack += [node, block]
        else:
            plain(begin, end)
            if mark == "}" and len(stack) > 1:
                block, node = stack.pop(), stack.pop()
                block.add(Node("}", end, end + 1, named=False))
                block.end = node.end = end + 1
            elif mark == "}":
                root.add(Node("ERROR", end, end + 1, error=True))
    for node in stack[1:]:
        node.error = True
    return root


def _coded(language: str) -> Callable[[str], Node]:
    return lambda source: code.refine(source, parse_brackets(source), language)


PARSERS: dict[str, Callable[[str], Node]] = {"html": parse_html, "json": parse_json, "yaml": parse_yaml, "python": parse_python, "css": parse_css} | {name: _coded(name) for name in code.LANGUAGES}


def register(language: str, parser: Callable[[str], Node]) -> None:
    PARSERS[language] = parser


def parse(source: str, language: str) -> Tree:
    """The tree of a text; a language without a parser of its own is read as bracketed code."""
    return Tree(source, PARSERS.get(language, parse_brackets)(source), language)


def parse_ranges(source: str, ranges: list[tuple[int, int]], language: str) -> list[Tree]:
    """The parts of a host text as another language, each parsed in place: all offsets are the host's."""
    trees = []
    for a, b in ranges:
        root = PARSERS.get(language, parse_brackets)(source[a:b])
        stack = [root]
        while stack:
            node = stack.pop()
            node.start, node.end = node.start + a, node.end + a
            stack.extend(node.children)
        trees.append(Tree(source, root, language))
    return trees
