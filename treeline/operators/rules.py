"""Rule documents: loading, checking, and evaluation over one tree (the Arrow tier).

`load` reads YAML into `Config`s; a `Rule` is a small object graph with
`match(node, env) -> node or None`. Keys of one rule object are a conjunction in
a fixed order, since bindings flow from left to right.
"""

from __future__ import annotations

import graphlib
import re
from dataclasses import dataclass, field
from typing import Any

import yaml

from treeline.functions import transforms as tf
from treeline.model import Node, Tree
from treeline.operators.patterns import Env, Matcher, Pattern, PatternError, compile_pattern
from treeline.sources.languages import canonical

ORDER = ("pattern", "kind", "regex", "nthChild", "range", "all", "any", "not", "matches", "inside", "has", "precedes", "follows")
RELATIONS = ("inside", "has", "precedes", "follows")
SEVERITIES = ("hint", "info", "warning", "error", "off")
_CORE = {"rule", "constraints", "utils", "transform", "fix"}
_CONFIG = _CORE | {"id", "language", "severity", "message", "note", "url", "metadata", "labels", "files", "ignores", "rewriters"}


class RuleError(ValueError):
    """A rule document that can't be used; .code names the reason."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


# --- An+B -------------------------------------------------------------------


def parse_nth(expr: int | str) -> tuple[int, int]:
    """(step, offset) of a number or an An+B expression."""
    if isinstance(expr, int):
        return 0, expr
    text = re.sub(r"\s+", "", expr)
    if bad := re.search(r"[^0-9n+\-]", text):
        raise RuleError("nth_child_illegal_character", bad[0])
    m = re.fullmatch(r"([+-]?)(\d*)n(?:([+-])(\d+))?|([+-]?\d+)", text)
    if not m:
        raise RuleError("nth_child_syntax", expr)
    if m[5] is not None:
        return 0, int(m[5])
    step = int(m[2] or 1) * (-1 if m[1] == "-" else 1)
    return step, int(m[4] or 0) * (-1 if m[3] == "-" else 1)


def nth_holds(step: int, offset: int, index: int) -> bool:
    """Whether the 1-based index is step * k + offset for some k >= 0."""
    rest = index - offset
    return rest == 0 if step == 0 else rest % step == 0 and rest // step >= 0


# --- rules ------------------------------------------------------------------


class Rule:
    """Matches a node under bindings; kinds() is the set of kinds it can match, None for any."""

    def match(self, node: Node, env: Env) -> Node | None:
        raise NotImplementedError

    def kinds(self) -> set[str] | None:
        return None

    def variables(self) -> set[str]:
        return set()

    def __and__(self, other: Rule) -> Rule:
        return All([self, other])

    def __or__(self, other: Rule) -> Rule:
        return AnyOf([self, other])

    def __invert__(self) -> Rule:
        return Not(self)


class MatchAll(Rule):
    def match(self, node, env):
        return node


class MatchNone(Rule):
    def match(self, node, env):
        return None

    def kinds(self):
        return set()


@dataclass
class Kind(Rule):
    kind: str

    def match(self, node, env):
        return node if (node.error if self.kind == "ERROR" else node.kind == self.kind) else None

    def kinds(self):
        return {self.kind}


@dataclass
class Regex(Rule):
    regex: str

    def __post_init__(self):
        try:
            self._re = re.compile(self.regex)
        except re.error as e:
            raise RuleError("invalid_regex", str(e)) from e

    def match(self, node, env):
        return node if self._re.search(node.text) else None


@dataclass
class PatternRule(Rule):
    pattern: Pattern

    def match(self, node, env):
        return node if Matcher(self.pattern).match(node, env) else None

    def kinds(self):
        return self.pattern.kinds

    def variables(self):
        return self.pattern.variables()


@dataclass
class NthChild(Rule):
    step: int
    offset: int
    of: Rule | None = None
    reverse: bool = False

    def match(self, node, env):
        if not node.named or node.parent is None:
            return None
        peers = [c for c in node.parent.children if c.named and (self.of is None or self.of.match(c, env.copy()) is not None)]
        if not any(c is node for c in peers):
            return None
        at = next(i for i, c in enumerate(peers) if c is node)
        at = len(peers) - at if self.reverse else at + 1
        if not nth_holds(self.step, self.offset, at):
            return None
        return node if self.of is None else self.of.match(node, env)

    def kinds(self):
        return self.of.kinds() if self.of else None

    def variables(self):
        return self.of.variables() if self.of else set()


@dataclass
class Range(Rule):
    start: tuple[int, int]
    end: tuple[int, int]

    def __post_init__(self):
        if self.start > self.end:
            raise RuleError("invalid_range", f"{self.start} > {self.end}")

    def match(self, node, env):
        t = node.tree
        return node if t.position(node.start) == self.start and t.position(node.end) == self.end else None


@dataclass
class All(Rule):
    rules: list[Rule]

    def match(self, node, env):
        trial = env.copy()
        for r in self.rules:
            if r.match(node, trial) is None:
                return None
        env.take(trial)
        return node

    def kinds(self):
        found: set[str] | None = None
        for r in self.rules:
            k = r.kinds()
            found = k if found is None else found if k is None else found & k
        return found

    def variables(self):
        return set().union(*(r.variables() for r in self.rules))


@dataclass
class AnyOf(Rule):
    rules: list[Rule]

    def match(self, node, env):
        for r in self.rules:
            trial = env.copy()
            if (found := r.match(node, trial)) is not None:
                env.take(trial)
                return found
        return None

    def kinds(self):
        found: set[str] = set()
        for r in self.rules:
            if (k := r.kinds()) is None:
                return None
            found |= k
        return found

    def variables(self):
        return set().union(*(r.variables() for r in self.rules))


@dataclass
class Not(Rule):
    rule: Rule

    def match(self, node, env):
        return node if self.rule.match(node, env.copy()) is None else None


@dataclass
class Matches(Rule):
    name: str
    registry: dict[str, Rule]

    def match(self, node, env):
        return self.registry[self.name].match(node, env)

    def kinds(self):
        return self.registry[self.name].kinds()

    def variables(self):
        return self.registry[self.name].variables() if self.name in self.registry else set()


@dataclass
class Relation(Rule):
    """inside, has, precedes or follows; stop is 'neighbor', 'end' or a rule."""

    relation: str
    rule: Rule
    stop: Any = "neighbor"
    field_name: str | None = None

    def match(self, node, env):
        found = self._find(node, env)
        if found is not None:
            env.many.setdefault("secondary", [])
            env.many["secondary"] = [*env.many["secondary"], found]
        return None if found is None else (found if self.relation == "has" and getattr(self, "bare", False) else node)

    def _try(self, node: Node, env: Env) -> Node | None:
        trial = env.copy()
        found = self.rule.match(node, trial)
        if found is not None:
            env.take(trial)
        return found

    def _stops(self, node: Node) -> bool:
        return isinstance(self.stop, Rule) and self.stop.match(node, Env()) is not None

    def _find(self, node: Node, env: Env) -> Node | None:
        if self.relation == "has":
            return self._has(node, env)
        if self.relation == "inside":
            chain, left = list(node.ancestors()), node
            steps = []
            for up in chain:
                steps.append((up, self.field_name is None or up.child(self.field_name) is left))
                left = up
        else:
            steps = [(s, True) for s in (node.later() if self.relation == "precedes" else node.earlier())]
        for i, (at, allowed) in enumerate(steps):
            if self.stop == "neighbor" and i:
                break
            if allowed and (found := self._try(at, env)) is not None:
                return found
            if self._stops(at):
                break
        return None

    def _has(self, node: Node, env: Env) -> Node | None:
        if self.field_name is not None:
            child = node.child(self.field_name)
            if child is None:
                return None
            if self.stop == "end":
                return next((f for n in child.walk() if (f := self._try(n, env)) is not None), None)
            found = self._try(child, env)
            if found is not None or self.stop == "neighbor" or self._stops(child):
                return found
            return next((f for n in child.children if (f := self._try(n, env)) is not None), None)
        if self.stop == "neighbor":
            return next((f for n in node.children if (f := self._try(n, env)) is not None), None)
        if self.stop == "end":
            return next((f for n in list(node.walk())[1:] if (f := self._try(n, env)) is not None), None)
        stack = list(reversed(node.children))
        while stack:
            n = stack.pop()
            if (found := self._try(n, env)) is not None:
                return found
            if not self._stops(n):
                stack.extend(reversed(n.children))
        return None

    def variables(self):
        return self.rule.variables() | (self.stop.variables() if isinstance(self.stop, Rule) else set())


# --- loading ----------------------------------------------------------------


def build(spec: Any, language: str, registry: dict[str, Rule]) -> Rule:
    """A rule object from its YAML form."""
    if not isinstance(spec, dict) or not spec:
        raise RuleError("no_positive_matcher", str(spec))
    if unknown := set(spec) - set(ORDER):
        raise RuleError("unknown_key", ", ".join(sorted(map(str, unknown))))
    if nulls := [k for k, v in spec.items() if v is None]:
        raise RuleError("null_value", ", ".join(nulls))
    rules = [_key(k, spec[k], language, registry) for k in ORDER if k in spec]
    if len(rules) == 1:
        if isinstance(rules[0], Relation):
            rules[0].bare = True
        return rules[0]
    return All(rules)


def _key(key: str, value: Any, language: str, registry: dict[str, Rule]) -> Rule:
    if key == "pattern":
        try:
            if isinstance(value, dict):
                return PatternRule(compile_pattern(value["context"], language, value.get("selector"), value.get("strictness", "smart")))
            return PatternRule(compile_pattern(value, language))
        except PatternError as e:
            raise RuleError("invalid_pattern", str(e)) from e
    if key == "kind":
        if not isinstance(value, str) or not value:
            raise RuleError("invalid_kind", str(value))
        return Kind(value)
    if key == "regex":
        return Regex(str(value))
    if key == "nthChild":
        if isinstance(value, dict):
            of = build(value["ofRule"], language, registry) if "ofRule" in value else None
            return NthChild(*parse_nth(value["position"]), of, bool(value.get("reverse", False)))
        return NthChild(*parse_nth(value))
    if key == "range":
        point = lambda p: (int(p["line"]), int(p["column"]))
        return Range(point(value["start"]), point(value["end"]))
    if key in ("all", "any"):
        return (All if key == "all" else AnyOf)([build(v, language, registry) for v in value])
    if key == "not":
        return Not(build(value, language, registry))
    if key == "matches":
        if value not in registry:
            raise RuleError("undefined_util", str(value))
        return Matches(value, registry)
    inner = {k: v for k, v in value.items() if k not in ("stopBy", "field")}
    stop = value.get("stopBy", "neighbor")
    if isinstance(stop, dict):
        stop = build(stop, language, registry)
    elif stop not in ("neighbor", "end"):
        raise RuleError("invalid_stop_by", str(stop))
    if "field" in value and key in ("precedes", "follows"):
        raise RuleError("field_not_supported", key)
    return Relation(key, build(inner, language, registry), stop, value.get("field"))


def _needs(spec: Any) -> set[str]:
    """Utils that a rule refers to through all, any and not - a reference through a relation may recurse."""
    if not isinstance(spec, dict):
        return set()
    found = {spec["matches"]} if "matches" in spec else set()
    for k in ("all", "any"):
        for v in spec.get(k) or []:
            found |= _needs(v)
    return found | _needs(spec.get("not"))


def build_utils(specs: dict[str, Any], language: str, registry: dict[str, Rule]) -> dict[str, Rule]:
    """Adds utils to a registry in the order of their references; a cycle is an error."""
    known = dict(registry)
    graph = {k: {n for n in _needs(v) if n in specs} for k, v in specs.items()}
    try:
        order = list(graphlib.TopologicalSorter(graph).static_order())
    except graphlib.CycleError as e:
        raise RuleError("cyclic_rule", str(e.args[1])) from e
    for name in specs:
        known.setdefault(name, MatchNone())
    for name in order:
        known[name] = build(specs[name], language, known)
    return known


@dataclass
class Fix:
    template: str
    title: str | None = None
    before: Relation | None = None
    after: Relation | None = None


def _fixes(spec: Any, language: str, registry: dict[str, Rule]) -> list[Fix]:
    if spec is None:
        return []
    if isinstance(spec, str):
        return [Fix(spec)]
    if isinstance(spec, list):
        if any(not isinstance(s, dict) or "title" not in s for s in spec):
            raise RuleError("fix_without_title")
        return [f for s in spec for f in _fixes(s, language, registry)]
    ends = [_key(way, spec[k], language, registry) if k in spec else None for k, way in (("expandStart", "follows"), ("expandEnd", "precedes"))]
    return [Fix(spec["template"], spec.get("title"), *ends)]


@dataclass
class Config:
    """A compiled rule document."""

    id: str
    language: str
    rule: Rule
    severity: str = "hint"
    message: str = ""
    note: str | None = None
    url: str | None = None
    metadata: Any = None
    constraints: dict[str, Rule] = field(default_factory=dict)
    transform: dict[str, Any] = field(default_factory=dict)
    fixes: list[Fix] = field(default_factory=list)
    labels: dict[str, dict] = field(default_factory=dict)
    files: list[str] = field(default_factory=list)
    ignores: list[str] = field(default_factory=list)
    rewriters: dict[str, Config] = field(default_factory=dict)
    spec: dict = field(default_factory=dict)

    def kinds(self) -> set[str] | None:
        found = self.rule.kinds()
        return found

    def match(self, node: Node, outer: Env | None = None) -> tuple[Node, Env] | None:
        """Kind gate, rule, constraints, transforms."""
        kinds = self.kinds()
        if kinds is not None and node.kind not in kinds and not (node.error and "ERROR" in kinds) and "ERROR" not in kinds:
            return None
        env = outer.copy() if outer else Env()
        found = self.rule.match(node, env)
        if found is None:
            return None
        for name in sorted(self.constraints):
            if name in env.one:
                trial = env.copy()
                if self.constraints[name].match(env.one[name], trial) is None:
                    return None
                env.take(trial)
        tf.apply(self.transform, env, self.rewriters)
        return found, env

    def find_all(self, tree: Tree) -> list[tuple[Node, Env]]:
        return [m for n in tree.nodes if (m := self.match(n)) is not None]


def _core(spec: dict, language: str, globals_: dict[str, Rule], need_kinds: bool, outer: set[str] = frozenset()) -> dict[str, Any]:
    registry = build_utils(spec.get("utils") or {}, language, globals_)
    if "rule" not in spec:
        raise RuleError("no_rule")
    rule = build(spec["rule"], language, registry)
    if need_kinds and rule.kinds() is None:
        raise RuleError("missing_kinds", spec.get("id", ""))
    defined = rule.variables() | set(outer)
    constraints = {k: build(v, language, registry) for k, v in (spec.get("constraints") or {}).items()}
    for k, c in constraints.items():
        if k not in defined:
            raise RuleError("undefined_meta_var", f"{k} in constraints")
        defined |= c.variables()
    try:
        transform = tf.compile_all(spec.get("transform") or {}, defined)
    except tf.TransformError as e:
        raise RuleError(e.code, str(e)) from e
    fixes = _fixes(spec.get("fix"), language, registry)
    for fix in fixes:
        free = defined | set(transform)
        for part in (fix.before, fix.after):
            free |= part.variables() if part else set()
        if missing := tf.template_vars(fix.template) - free:
            raise RuleError("undefined_meta_var", f"{min(missing)} in fix")
    return {"rule": rule, "constraints": constraints, "transform": transform, "fixes": fixes, "defined": defined}


def from_dict(spec: dict, globals_: dict[str, Rule] | None = None, need_kinds: bool = True) -> Config:
    if unknown := set(spec) - _CONFIG:
        raise RuleError("unknown_key", ", ".join(sorted(unknown)))
    if "id" not in spec or "language" not in spec:
        raise RuleError("missing_key", "id and language")
    language = canonical(spec["language"])
    if language is None:
        raise RuleError("unknown_language", str(spec["language"]))
    severity = spec.get("severity", "hint")
    if severity not in SEVERITIES:
        raise RuleError("invalid_severity", str(severity))
    core = _core(spec, language, globals_ or {}, need_kinds)
    defined = core.pop("defined")
    labels = spec.get("labels") or {}
    for name, label in labels.items():
        if name not in defined:
            raise RuleError("label_variable", name)
        if label.get("style") not in ("primary", "secondary"):
            raise RuleError("label_style", name)
    rewriters: dict[str, Config] = {}
    for r in spec.get("rewriters") or []:
        if not r.get("fix"):
            raise RuleError("rewriter_without_fix", r.get("id", ""))
        inner = _core(r, language, globals_ or {}, False, defined)
        inner.pop("defined")
        rewriters[r["id"]] = Config(id=r["id"], language=language, **inner, rewriters=rewriters, spec=r)
    for t in core["transform"].values():
        for name in t.get("rewriters", []):
            if name not in rewriters:
                raise RuleError("undefined_rewriter", name)
    keep = {k: spec[k] for k in ("message", "note", "url", "metadata") if k in spec}
    return Config(id=spec["id"], language=language, severity=severity, labels=labels, files=list(spec.get("files") or []), ignores=list(spec.get("ignores") or []), rewriters=rewriters, spec=spec, **keep, **core)


def load(text: str, globals_: dict[str, Rule] | None = None, need_kinds: bool = True) -> list[Config]:
    """All documents of a YAML text, as compiled rules. Severity off is kept here and dropped by collections."""
    return [from_dict(d, globals_, need_kinds) for d in yaml.safe_load_all(text) if d is not None]


def load_globals(text: str, language: str) -> dict[str, Rule]:
    """Global utils: documents with id and a core, usable from each other and from all rules."""
    specs = {d["id"]: d["rule"] for d in yaml.safe_load_all(text) if d is not None}
    return build_utils(specs, language, {})
