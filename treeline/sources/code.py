"""Named kinds for bracketed languages: what `parse_brackets` finds, told apart by keywords and shape.

A statement that begins with a declaring keyword, behind any modifiers, becomes
the declaration that the keyword makes, with its name, parameters and body in
fields; members of class bodies become methods and fields; calls, accesses,
argument lists and blocks get the kinds of their language. What no keyword tells
apart stays an expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from treeline.model import Node


@dataclass(frozen=True)
class Form:
    """A declaration: its kind, those of its body and its name, and whether it has parameters."""

    kind: str
    body: str | None = None
    name: str = "identifier"
    params: bool = False


@dataclass(frozen=True)
class Language:
    root: str
    call: str
    member: str
    arguments: str
    params: str
    block: str
    forms: dict[str, Form]
    modifiers: frozenset[str]
    control: dict[str, str]
    variables: dict[str, str] = field(default_factory=dict)
    brackets: str = "array"
    string: str = "string"
    number: str = "number"
    method: Form | None = None
    attribute: str | None = None
    constructor: str | None = None
    property: str = "identifier"
    typed: str | None = None


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


def _control(words: str, tail: str = "_statement") -> dict[str, str]:
    return {w: w + tail for w in words.split()}


_JS = Language(
    "program", "call_expression", "member_expression", "arguments", "formal_parameters", "statement_block",
    {"function": Form("function_declaration", "statement_block", params=True), "class": Form("class_declaration", "class_body"), "import": Form("import_statement"), "interface": Form("interface_declaration", "interface_body", "type_identifier"),
     "enum": Form("enum_declaration", "enum_body"), "namespace": Form("internal_module", "statement_block"), "type": Form("type_alias_declaration", None, "type_identifier")},
    _words("export default async declare abstract public private protected static readonly override"), _control("if for while do return throw switch try break continue"),
    {"const": "lexical_declaration", "let": "lexical_declaration", "var": "variable_declaration"}, method=Form("method_definition", "statement_block", "property_identifier", True), attribute="field_definition", property="property_identifier",
)
_RUST = Language(
    "source_file", "call_expression", "field_expression", "arguments", "parameters", "block",
    {"fn": Form("function_item", "block", params=True), "struct": Form("struct_item", "field_declaration_list", "type_identifier"), "enum": Form("enum_item", "enum_variant_list", "type_identifier"), "trait": Form("trait_item", "declaration_list", "type_identifier"),
     "impl": Form("impl_item", "declaration_list", "type_identifier"), "mod": Form("mod_item", "declaration_list"), "use": Form("use_declaration"), "type": Form("type_item", None, "type_identifier"), "static": Form("static_item"), "union": Form("union_item", "field_declaration_list", "type_identifier")},
    _words("pub async unsafe extern default"), _control("if match for while loop return break continue", "_expression"), {"let": "let_declaration", "const": "const_item"},
    brackets="array_expression", string="string_literal", number="integer_literal", property="field_identifier",
)
_GO = Language(
    "source_file", "call_expression", "selector_expression", "argument_list", "parameter_list", "block",
    {"func": Form("function_declaration", "block", params=True), "type": Form("type_declaration", "field_declaration_list", "type_identifier"), "import": Form("import_declaration"), "package": Form("package_clause", None, "package_identifier")},
    frozenset(), _control("if for return switch select go defer break continue"), {"var": "var_declaration", "const": "const_declaration"},
    brackets="index", string="interpreted_string_literal", number="int_literal", property="field_identifier",
)
_JAVA = Language(
    "program", "method_invocation", "field_access", "argument_list", "formal_parameters", "block",
    {"class": Form("class_declaration", "class_body"), "interface": Form("interface_declaration", "interface_body"), "enum": Form("enum_declaration", "enum_body"), "record": Form("record_declaration", "class_body", params=True), "import": Form("import_declaration"), "package": Form("package_declaration")},
    _words("public private protected static final abstract native synchronized transient volatile default sealed"), _control("if for while do return throw switch try break continue assert"),
    brackets="array_access", string="string_literal", number="decimal_integer_literal", method=Form("method_declaration", "block", params=True), attribute="field_declaration", constructor="constructor_declaration", typed="local_variable_declaration",
)
LANGUAGES: dict[str, Language] = {"javascript": _JS, "typescript": _JS, "tsx": _JS, "rust": _RUST, "go": _GO, "java": _JAVA}


class _Refiner:
    def __init__(self, source: str, language: Language):
        self.source, self.lang = source, language

    def text(self, node: Node) -> str:
        return self.source[node.start : node.end]

    def keyword(self, node: Node) -> None:
        node.kind, node.named, node.children = self.text(node), False, []

    def hang(self, parent: Node, children: list[Node]) -> None:
        parent.children = []
        for c in children:
            parent.add(c)

    def wrap(self, kind: str, children: list[Node], fld: str | None = None) -> Node:
        if len(children) == 1:
            children[0].field = fld
            return children[0]
        node = Node(kind, children[0].start, children[-1].end, field=fld)
        self.hang(node, children)
        return node

    def run(self, root: Node) -> Node:
        order, stack = [], [root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.children)
        for node in reversed(order):  # children come before their parents
            if node.kind in ("program", "block"):
                done: list[Node] = []
                for c in node.children:
                    done += self.statement(c) if c.kind == "statement" else [c]
                self.hang(node, done)
        lang = self.lang
        names = {"call": lang.call, "member": lang.member, "arguments": lang.arguments, "brackets": lang.brackets, "block": lang.block, "string": lang.string, "number": lang.number, "statement": "expression_statement"}
        for node in order:
            if node.named and node.kind in names and node is not root:
                node.kind = names[node.kind]
            if node.kind == lang.member and len(node.children) == 3 and node.children[1].kind == "::":
                node.kind = "scoped_identifier"
            elif node.kind == lang.member and node.children and node.children[-1].kind == "identifier":
                node.children[-1].kind = lang.property
        root.kind = lang.root
        return root

    def statement(self, node: Node) -> list[Node]:
        """The statement by its kind; and what stands behind it on its line as others."""
        ch, lang = node.children, self.lang
        i = 0
        while i < len(ch) - 1:
            if ch[i].kind == "@":
                i += 2
            elif ch[i].kind == "comment" or ch[i].kind == "identifier" and self.text(ch[i]) in lang.modifiers and ch[i + 1].kind != "=":
                i += 1
            else:
                break
        if i >= len(ch):
            return [node]
        head = ch[i]
        if head.kind == "call" and head.children[0].kind == "identifier" and self.text(head.children[0]) in lang.control:
            ch = [*ch[:i], *head.children, *ch[i + 1 :]]
            head = ch[i]
        word = self.text(head) if head.kind == "identifier" else ""
        if word in lang.forms and i + 1 < len(ch):
            for c in ch[:i]:
                if c.kind == "identifier":
                    self.keyword(c)
            return self.declaration(node, ch, i, lang.forms[word])
        if word in lang.variables and i + 1 < len(ch):
            self.keyword(head)
            return [self.variables(node, ch, i, lang.variables[word])]
        if word in lang.control:
            self.keyword(head)
            head.field = None
            for c in ch[i + 1 :]:
                if c.kind == "arguments":
                    c.kind, c.field = "parenthesized_expression", "condition"
                elif c.kind == "identifier" and self.text(c) in ("else", "catch", "finally", "in", "of"):
                    self.keyword(c)
            node.kind = lang.control[word]
            self.hang(node, ch)
            return [node]
        if lang is _RUST:  # name!(...)
            for k in range(len(ch) - 2, 0, -1):
                if ch[k].kind == "!" and ch[k - 1].kind == "identifier" and ch[k + 1].kind in ("arguments", "brackets", "block") and ch[k - 1].end == ch[k].start:
                    macro = self.wrap("macro_invocation", ch[k - 1 : k + 2])
                    macro.children[0].field = "macro"
                    ch = [*ch[: k - 1], macro, *ch[k + 2 :]]
            self.hang(node, ch)
        if lang is _GO and any(a.kind == ":" and b.kind == "=" and a.end == b.start for a, b in zip(ch, ch[1:])):
            node.kind = "short_var_declaration"
        elif lang.typed and len(ch) >= 3 and ch[i].kind in ("identifier", "member") and ch[i + 1].kind == "identifier" and ch[i + 2].kind in ("=", ";") and node.parent is not None:
            ch[i].kind, ch[i].field = "type_identifier", "type"
            rest, tail = self.declared(ch, i + 1)
            self.hang(node, [*ch[: i + 1], rest, *tail])
            node.kind = lang.typed
        return [node]

    def declared(self, ch: list[Node], i: int) -> tuple[Node, list[Node]]:
        """name = value from i on as one declarator, and what closes the statement."""
        tail = []
        while len(ch) > i + 1 and ch[-1].kind in (";", "comment"):
            tail.insert(0, ch[-1])
            ch = ch[:-1]
        own = ch[i:]
        own[0].field = "name"
        at = next((k for k, c in enumerate(own) if c.kind == "="), None)
        if at is not None and at + 1 < len(own):
            arrow = next((k for k, c in enumerate(own[at + 1 :], at + 1) if c.kind == "=>"), None)
            value = own[at + 1 :]
            if arrow is not None:
                for c in own[at + 1 : arrow]:
                    if c.kind == "arguments":
                        c.kind, c.field = self.lang.params, "parameters"
                if own[-1].kind == "block":
                    own[-1].field = "body"
                value = [self.wrap("arrow_function", value, "value")]
            elif value[0].kind == "identifier" and self.text(value[0]) == "function":
                self.keyword(value[0])
                value = [self.wrap("function_expression", value, "value")]
            else:
                value = [self.wrap("binary_expression" if len(value) == 3 and not value[1].named else "expression", value, "value")]
            own = [*own[: at + 1], *value]
        node = Node("variable_declarator", own[0].start, own[-1].end)
        self.hang(node, own)
        return node, tail

    def variables(self, node: Node, ch: list[Node], i: int, kind: str) -> Node:
        node.kind = kind
        if self.lang is _RUST or self.lang is _GO:
            at = i + 1 + (ch[i + 1].kind == "identifier" and self.text(ch[i + 1]) == "mut")
            if at < len(ch):
                ch[at].field = "pattern" if kind == "let_declaration" else "name"
            eq = next((k for k, c in enumerate(ch) if c.kind == "="), None)
            if eq is not None and eq + 1 < len(ch) and ch[eq + 1].kind != ";":
                stop = len(ch) - (ch[-1].kind == ";")
                ch = [*ch[: eq + 1], self.wrap("binary_expression", ch[eq + 1 : stop], "value"), *ch[stop:]]
            self.hang(node, ch)
            return node
        rest, tail = self.declared(ch, i + 1)
        self.hang(node, [*ch[: i + 1], rest, *tail])
        return node

    def declaration(self, node: Node, ch: list[Node], i: int, form: Form) -> list[Node]:
        lang = self.lang
        self.keyword(ch[i])
        kind, j = form.kind, i + 1
        if lang is _GO and form.kind == "function_declaration" and ch[j].kind == "arguments":  # a receiver
            ch[j].kind, ch[j].field, kind = lang.params, "receiver", "method_declaration"
            j += 1
        while j < len(ch) and ch[j].kind == "*":
            j += 1
        if j < len(ch) and ch[j].kind == "call":
            ch = [*ch[:j], *ch[j].children, *ch[j + 1 :]]
            for c in ch[j : j + 2]:
                c.field = None
        if j < len(ch) and ch[j].kind == "identifier" and form.kind not in ("import_statement", "import_declaration", "use_declaration", "package_declaration"):
            ch[j].field = "type" if form.kind == "impl_item" else "name"
            ch[j].kind = form.name
        rest: list[Node] = []
        if form.params:
            params = next((c for c in ch[j:] if c.kind == "arguments"), None)
            if params is not None:
                params.kind, params.field = lang.params, "parameters"
        body = next((k for k in range(j, len(ch)) if ch[k].kind == "block"), None)
        if body is not None and form.body:
            ch[body].kind, ch[body].field = form.body, "body"
            stop = body + 1 + (len(ch) > body + 1 and ch[body + 1].kind == ";")
            ch, rest = ch[:stop], ch[stop:]
            if lang.method and form.body in ("class_body", "interface_body", "enum_body"):
                name = next((self.text(c) for c in ch if c.field == "name"), "")
                for m in ch[body].children:
                    if m.kind in ("statement", lang.typed):
                        self.member(m, name)
        for c in ch[j:]:
            if form.kind in ("import_statement", "import_declaration") and c.kind == "string":
                c.field = "source"
            if form.kind in ("import_statement", "use_declaration") and c.kind == "block":
                c.kind = "named_imports" if form.kind == "import_statement" else "use_list"
            if c.kind == "identifier" and c.field is None and self.text(c) in ("extends", "implements", "from", "for", "where", "as", "struct", "interface"):
                self.keyword(c)
        node.kind, node.end = kind, ch[-1].end
        self.hang(node, ch)
        if not rest or all(c.kind == "comment" for c in rest):
            return [node, *rest]
        more = Node("statement", rest[0].start, rest[-1].end)
        self.hang(more, rest)
        more.parent = node.parent
        return [node, *self.statement(more)]

    def member(self, node: Node, owner: str) -> None:
        """A statement of a class body as a method, a constructor or a field."""
        lang, ch = self.lang, node.children
        at = next((k for k, c in enumerate(ch) if c.kind == "call" and c.children[0].kind == "identifier" and not any(x.kind == "=" for x in ch[:k])), None)
        if at is not None and lang.method is not None and (ch[-1].kind == "block" or lang is _JAVA or at == len(ch) - 1):
            name, params = ch[at].children[0], ch[at].children[1]
            name.kind, name.field = lang.method.name, "name"
            params.kind, params.field = lang.params, "parameters"
            if at and ch[at - 1].kind == "identifier" and self.text(ch[at - 1]) not in lang.modifiers and lang is _JAVA:
                ch[at - 1].kind, ch[at - 1].field = "type_identifier", "type"
            for c in ch[:at]:
                if c.kind == "identifier" and self.text(c) in lang.modifiers | {"get", "set"}:
                    self.keyword(c)
            if ch[-1].kind == "block":
                ch[-1].kind, ch[-1].field = lang.method.body or "block", "body"
            node.kind = lang.constructor if lang.constructor and self.text(name) == owner else lang.method.kind
            self.hang(node, [*ch[:at], name, params, *ch[at + 1 :]])
        elif lang.attribute and (any(c.kind == "=" for c in ch) or node.kind == lang.typed or all(c.kind in ("identifier", ";", "brackets", "type_identifier", "?", ":", "string") for c in ch)):
            for c in ch[:-1]:
                if c.kind == "identifier" and self.text(c) in lang.modifiers:
                    self.keyword(c)
            node.kind = lang.attribute


def refine(source: str, root: Node, language: str) -> Node:
    """The tree of parse_brackets with the kinds of a language that has them; of any other as it is."""
    return _Refiner(source, LANGUAGES[language]).run(root) if language in LANGUAGES else root
