"""Patterns: code with meta-variables, compiled once on the driver and matched against nodes.

$A and $_A stand for one named node, $$A for any node, $$$ and $$$A for any
number of siblings. A variable that occurs twice must bind equal nodes; names
that begin with _ bind nothing. An ellipsis is first-fit: it takes siblings
until the next goal that isn't trivial matches, and never gives one back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from treeline.model import Node
from treeline.sources.parsers import parse

STRICTNESS = ("cst", "smart", "ast", "relaxed", "signature")
_META = re.compile(r"^(?:µ|\$)(?:(?P<multi>(?:µ|\$){2})(?P<many>[A-Z_][A-Z0-9_]*)?|(?P<any>µ|\$)?(?P<one>[A-Z_][A-Z0-9_]*))$")


class PatternError(ValueError):
    """Parse error, no content, multiple nodes, invalid kind or a selector that isn't in the context; .code tells which."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Var:
    """name None: matches without binding. many: an ellipsis. named: only named nodes."""

    name: str | None
    many: bool = False
    named: bool = True


def lex_var(text: str) -> Var | None:
    """The meta-variable that a text spells, or None."""
    m = _META.match(text)
    if not m:
        return None
    if m["multi"]:
        name = m["many"]
        return Var(None if not name or name[0] == "_" else name, many=True)
    return Var(None if m["one"][0] == "_" else m["one"], named=not m["any"])


def preprocess(pattern: str, expando: str = "µ") -> str:
    """`$` as an identifier character, where it begins a meta-variable, for languages that don't take it."""
    return re.sub(r"\$\$\$|\$\$?(?=[A-Z_])", lambda m: expando * len(m[0]), pattern)


def validate(pattern: str) -> None:
    """The service's own check: not empty, and every $ before a letter or underscore."""
    if not pattern.strip():
        raise PatternError("no_content", "empty pattern")
    if re.search(r"\$(?![A-Za-z_])", pattern):
        raise PatternError("parse", "$ must be followed by a name")


@dataclass
class Goal:
    """One node of a compiled pattern."""

    kind: str
    named: bool
    text: str | None = None  # of a leaf
    var: Var | None = None
    children: list[Goal] = field(default_factory=list)

    @property
    def trivial(self) -> bool:
        return not self.named and self.var is None

    def variables(self) -> set[str]:
        found = {self.var.name} if self.var and self.var.name else set()
        return found.union(*(c.variables() for c in self.children)) if self.children else found

    def longest_text(self) -> str:
        texts = [self.text or ""] if not self.var else [""]
        return max([*texts, *(c.longest_text() for c in self.children)], key=len)


@dataclass
class Pattern:
    goal: Goal
    root_kind: str | None = None
    strictness: str = "smart"

    @property
    def kinds(self) -> set[str] | None:
        """Kinds that can match; None is any."""
        if self.root_kind:
            return {self.root_kind}
        return None if self.goal.var or self.goal.kind == "ERROR" or self.strictness == "signature" and not self.goal.kind else {self.goal.kind}

    def variables(self) -> set[str]:
        return self.goal.variables()

    def fixed_text(self) -> str:
        """A text that every match contains: a filter on sources before any parsing."""
        return "" if self.strictness == "signature" else self.goal.longest_text()


def compile_pattern(text: str, language: str, selector: str | None = None, strictness: str = "smart") -> Pattern:
    """text alone must be one node; with a selector, text is a context and the pattern its first node of that kind."""
    if strictness not in STRICTNESS:
        raise PatternError("parse", f"unknown strictness {strictness}")
    if not text.strip():
        raise PatternError("no_content")
    tree = parse(text, language)
    if selector is not None:
        node = next((n for n in tree.nodes if n.kind == selector), None)
        if node is None:
            raise PatternError("no_selector", selector)
        return Pattern(_goal(node), selector, strictness)
    node = tree.root
    while len(node.children) == 1 and lex_var(node.text.strip()) is None:
        inner = node.children[0]
        if inner.start == node.start and inner.end == node.end or node is tree.root or node.kind in ("document", "statement", "expression_statement", "mapping", "stream", "program", "module"):
            node = inner
        else:
            break
    while node.children and len(node.children) == 1 and lex_var(node.text.strip()) is not None and not node.is_leaf:
        node = node.children[0]
    if node is tree.root:
        if not node.children:
            raise PatternError("no_content")
        raise PatternError("multiple_nodes", text)
    return Pattern(_goal(node), None, strictness)


def _goal(node: Node) -> Goal:
    var = lex_var(node.text.strip()) if node.is_named_leaf else None
    if var is not None:
        return Goal(node.kind, node.named, var=var)
    if node.is_named_leaf and all(not c.children for c in node.children) and not (node.children and any(lex_var(c.text) for c in node.children)):
        return Goal(node.kind, node.named, text=node.text)
    goal = Goal(node.kind, node.named)
    for child in node.children:
        if child.missing:
            continue
        inner = _goal(child)
        # a statement that is nothing but a variable stands for whatever is there
        only = child
        while only.named and len(only.children) == 1:
            only = only.children[0]
        if only is not child and (v := lex_var(only.text.strip())) is not None:
            inner = Goal(only.kind, True, var=v)
        goal.children.append(inner)
    return goal


# --- environments -----------------------------------------------------------


class Env:
    """What variables are bound to. Copies share until one changes."""

    __slots__ = ("one", "many", "made")

    def __init__(self, one: dict | None = None, many: dict | None = None, made: dict | None = None):
        self.one: dict[str, Node] = dict(one or {})
        self.many: dict[str, list[Node]] = dict(many or {})
        self.made: dict[str, str] = dict(made or {})

    def copy(self) -> Env:
        return Env(self.one, self.many, self.made)

    def take(self, other: Env) -> None:
        self.one, self.many, self.made = other.one, other.many, other.made

    def bind(self, name: str, node: Node) -> bool:
        held = self.one.get(name)
        if held is not None and not alike(held, node):
            return False
        self.one[name] = node
        return True

    def bind_many(self, name: str, nodes: list[Node]) -> bool:
        held = self.many.get(name)
        if held is not None:
            a, b = [n for n in held if n.named], [n for n in nodes if n.named]
            if len(a) != len(b) or not all(map(alike, a, b)):
                return False
        self.many[name] = nodes
        return True

    def text(self, name: str) -> str | None:
        if name in self.made:
            return self.made[name]
        if name in self.one:
            return self.one[name].text
        if nodes := self.many.get(name):
            return nodes[0].tree.source[nodes[0].start : nodes[-1].end]
        return "" if name in self.many else None

    def strings(self) -> dict[str, str]:
        out = {k: n.text for k, n in self.one.items()}
        out |= {k: "[" + ", ".join(n.text for n in v) + "]" for k, v in self.many.items() if k != "secondary"}
        return out | self.made


def alike(a: Node, b: Node) -> bool:
    """Structural equality: the same node, equal text where either has no named children, else alike child by child."""
    if a is b:
        return True
    if a.is_named_leaf or b.is_named_leaf:
        return a.text == b.text
    return a.kind == b.kind and len(a.children) == len(b.children) and all(map(alike, a.children, b.children))


# --- matching ---------------------------------------------------------------

_BOTH, _SKIP_GOAL, _SKIP_NODE, _SKIP_BOTH, _NO = range(5)


def _is_comment(node: Node) -> bool:
    return node.named and "comment" in node.kind


def _leaf_test(goal: Goal, node: Node, strictness: str) -> int:
    if goal.kind == node.kind and (not goal.named or goal.text == node.text or strictness == "signature"):
        return _BOTH
    skip_goal = strictness in ("ast", "relaxed", "signature") and not goal.named
    skip_node = strictness != "cst" and not node.named or strictness in ("relaxed", "signature") and _is_comment(node)
    return {(True, True): _SKIP_BOTH, (True, False): _SKIP_GOAL, (False, True): _SKIP_NODE, (False, False): _NO}[skip_goal, skip_node]


def _trailing_ok(node: Node, strictness: str) -> bool:
    if strictness == "smart":
        return True
    return strictness in ("relaxed", "signature") and (not node.named or _is_comment(node))


def _leftover_ok(goal: Goal, strictness: str) -> bool:
    if goal.var and goal.var.many:
        return strictness != "cst"
    if strictness in ("cst", "smart"):
        return False
    return not goal.named if goal.var is None else not goal.var.named


class Matcher:
    """Matches a pattern against nodes; `reach` is the end of the last node that a goal matched."""

    def __init__(self, pattern: Pattern):
        self.pattern = pattern
        self.reach = 0

    def match(self, node: Node, env: Env) -> bool:
        """Binds into env only if the whole pattern matches."""
        p = self.pattern
        if p.root_kind and node.kind != p.root_kind:
            return False
        trial, self.reach = env.copy(), node.start
        if self._one(p.goal, node, trial) != _BOTH:
            return False
        env.take(trial)
        return True

    def length(self, node: Node, env: Env) -> int:
        """Characters of a match without the trivia after its last goal."""
        return self.reach - node.start if self.match(node, env.copy()) and self.reach > node.start else node.end - node.start

    def _hit(self, node: Node) -> None:
        self.reach = max(self.reach, node.end)

    def _one(self, goal: Goal, node: Node, env: Env) -> int:
        if goal.var is not None:
            v = goal.var
            if v.named and not v.many and not node.named:
                return _NO
            if v.name and not env.bind(v.name, node):
                return _NO
            self._hit(node)
            return _BOTH
        if not goal.children:
            result = _leaf_test(goal, node, self.pattern.strictness)
            if result == _BOTH:
                self._hit(node)
            return result
        if goal.kind not in (node.kind, "ERROR"):
            return _NO
        return _BOTH if self._siblings(goal.children, node.children, env) else _NO

    def _siblings(self, goals: list[Goal], nodes: list[Node], env: Env) -> bool:
        """g and n run over goals and nodes; neither ever goes back."""
        g = n = 0
        strictness = self.pattern.strictness
        if not nodes:
            return False

        def bind(var: Var, taken: list[Node], cut: int) -> bool:
            if taken:
                self._hit(taken[-1])
            return not var.name or env.bind_many(var.name, taken[: len(taken) - cut] if cut < len(taken) else [])

        while True:
            if g == len(goals):
                return True
            if goals[g].var is not None and goals[g].var.many:
                var, begin, cut = goals[g].var, n, 0
                g += 1
                while g < len(goals) and goals[g].trivial:
                    g, cut = g + 1, cut + 1
                if g == len(goals):
                    return bind(var, nodes[begin:], cut)
                if goals[g].var is not None and goals[g].var.many:
                    n += 1
                    if n >= len(nodes) or not bind(var, nodes[begin:n], cut):
                        return False
                    continue
                while self._one(goals[g], nodes[n], env) != _BOTH:
                    n += 1
                    if n >= len(nodes):
                        return False
                if not bind(var, nodes[begin:n], cut):
                    return False
            # one goal against the first node that isn't skipped
            while True:
                if g == len(goals):
                    return all(_trailing_ok(x, strictness) for x in nodes[n:])
                if n >= len(nodes):
                    return all(_leftover_ok(x, strictness) for x in goals[g:])
                if goals[g].var is not None and goals[g].var.many:
                    break
                result = self._one(goals[g], nodes[n], env)
                if result == _BOTH:
                    break
                if result == _NO:
                    return False
                g += result in (_SKIP_GOAL, _SKIP_BOTH)
                n += result in (_SKIP_NODE, _SKIP_BOTH)
            if goals[g].var is not None and goals[g].var.many:
                continue
            g, n = g + 1, n + 1
            if g == len(goals):
                return all(_trailing_ok(x, strictness) for x in nodes[n:])
            if n >= len(nodes):
                return False
