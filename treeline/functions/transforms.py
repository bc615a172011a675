"""String functions of rules: substring, replace, convert and rewrite, as text functions and as columns.

The text functions serve the per-tree interpreter; the columns are built-in
expressions only, so that they stay in the JVM.
"""

from __future__ import annotations

import ast
import graphlib
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

CASES = ("lowerCase", "upperCase", "capitalize", "camelCase", "snakeCase", "kebabCase", "pascalCase")
SEPARATORS = {"dash": "-", "dot": ".", "slash": "/", "space": " ", "underscore": "_", "caseChange": ""}
_VAR = re.compile(r"\$\$\$([A-Z_][A-Z0-9_]*)|\$([A-Z_][A-Z0-9_]*)")


class TransformError(ValueError):
    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


# --- on texts ---------------------------------------------------------------


def substring(text: str, start: int | None = None, end: int | None = None) -> str:
    """Half open, in characters; negative counts from the end; out of range is clamped."""
    n = len(text)
    a, b = 0 if start is None else start, n if end is None else end
    a, b = (max(0, min(n, x + n if x < 0 else x)) for x in (a, b))
    return text[a:b] if a < b else ""


def replace(text: str, pattern: str, by: str) -> str:
    """All matches; $1 and ${1} are groups, $1x is a group named 1x. A bad regex has no value: an empty text."""
    try:
        found = re.compile(pattern)
    except re.error:
        return ""

    def fill(m: re.Match) -> str:
        def group(g: re.Match) -> str:
            name = g[1] or g[2]
            if name == "$":
                return "$"
            try:
                return m[int(name) if name.isdigit() else name] or ""
            except (IndexError, error_type):
                return ""

        return re.sub(r"\$(?:\{(\w+)\}|(\$|\w+))", group, by)

    error_type = re.error
    return found.sub(fill, text)


def split_words(text: str, separated_by: list[str] | None = None) -> list[str]:
    """Words between delimiters and at changes of case: aB, and XMLHttp before the last capital."""
    chosen = SEPARATORS.keys() if separated_by is None else separated_by
    marks = {SEPARATORS[s] for s in chosen if SEPARATORS[s]}
    cases = "caseChange" in chosen
    words, now = [], ""
    for i, c in enumerate(text):
        if c in marks:
            words.append(now)
            now = ""
            continue
        if cases and now:
            before, after = now[-1], text[i + 1] if i + 1 < len(text) else ""
            if before.islower() and c.isupper() or not before.islower() and not c.islower() and after.islower() and before not in "-./ _":
                words.append(now)
                now = ""
        now += c
    return [w for w in [*words, now] if w]


def convert(text: str, to: str, separated_by: list[str] | None = None) -> str:
    if to not in CASES:
        raise TransformError("parse", f"unknown case {to}")
    capital = lambda w: w[:1].upper() + w[1:].lower()
    if to == "lowerCase":
        return text.lower()
    if to == "upperCase":
        return text.upper()
    if to == "capitalize":
        return text[:1].upper() + text[1:]
    words = split_words(text, separated_by)
    if to == "camelCase":
        return "".join(w.lower() if i == 0 else capital(w) for i, w in enumerate(words))
    if to == "pascalCase":
        return "".join(map(capital, words))
    return {"snakeCase": "_", "kebabCase": "-"}[to].join(w.lower() for w in words)


# --- as columns -------------------------------------------------------------


def substring_col(text: Column, start: int | None = None, end: int | None = None) -> Column:
    n = F.length(text)

    def at(x: int | None, default: Column) -> Column:
        if x is None:
            return default
        return F.greatest(F.lit(0), F.least(n, n + x if x < 0 else F.lit(x)))

    a, b = at(start, F.lit(0)), at(end, n)
    return F.when(a < b, F.substring(text, a + 1, b - a)).otherwise(F.when(text.isNotNull(), F.lit("")))


def replace_col(text: Column, pattern: str, by: str) -> Column:
    """by in the rules' notation: ${1}; a group without braces takes all word characters after $."""
    by = by.replace("\\", "\\\\")
    java = re.sub(r"\$(?:\{(\w+)\}|(\d+)(?!\w)|(\w+)|\$)", lambda m: f"${m[1] or m[2]}" if (m[1] or m[2] or "").isdigit() else "" if m[1] or m[3] else "\\$", by)
    return F.regexp_replace(text, F.lit(pattern), F.lit(java))


def split_words_col(text: Column, separated_by: list[str] | None = None) -> Column:
    chosen = SEPARATORS.keys() if separated_by is None else separated_by
    marks = "".join(re.escape(SEPARATORS[s]) for s in chosen if SEPARATORS[s])
    out = text
    if "caseChange" in chosen:
        out = F.regexp_replace(out, r"(?<=\p{javaLowerCase})(?=\p{javaUpperCase})", "\u0001")
        out = F.regexp_replace(out, r"(?<=[^\p{javaLowerCase}\-./ _\u0001])(?=[^\p{javaLowerCase}\-./ _\u0001]\p{javaLowerCase})", "\u0001")
    return F.filter(F.split(out, f"[\u0001{marks}]"), lambda w: w != "")


def convert_col(text: Column, to: str, separated_by: list[str] | None = None) -> Column:
    if to not in CASES:
        raise TransformError("parse", f"unknown case {to}")
    if to == "lowerCase":
        return F.lower(text)
    if to == "upperCase":
        return F.upper(text)
    if to == "capitalize":
        return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))
    words = split_words_col(text, separated_by)
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
    if to == "camelCase":
        return F.array_join(F.transform(words, lambda w, i: F.when(i == 0, F.lower(w)).otherwise(capital(w))), "")
    if to == "pascalCase":
        return F.array_join(F.transform(words, capital), "")
    return F.array_join(F.transform(words, F.lower), {"snakeCase": "_", "kebabCase": "-"}[to])


def template_col(template: str, columns: dict[str, Column]) -> Column:
    """A message template as a concatenation; unknown variables stay as they are spelled."""
    parts, at = [], 0
    for m in _VAR.finditer(template):
        name = m[1] or m[2]
        if name in columns:
            parts += [F.lit(template[at : m.start()]), F.coalesce(columns[name], F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


# --- transforms of a rule ---------------------------------------------------


def template_vars(template: str) -> set[str]:
    return {m[1] or m[2] for m in _VAR.finditer(template)}


def parse_call(text: str) -> dict[str, Any]:
    """`func($VAR, key=value, ...)`; values are numbers, strings in quotes, names or lists in brackets."""
    m = re.fullmatch(r"\s*(\w+)\s*\(\s*(\$+[A-Z_][A-Z0-9_]*)\s*(?:,(.*))?\)\s*", text, re.S)
    if not m or m[1] not in ("substring", "replace", "convert", "rewrite"):
        raise TransformError("parse", text)
    out: dict[str, Any] = {"func": m[1], "source": m[2]}
    rest = (m[3] or "").strip()
    while rest:
        a = re.match(r"""(\w+)\s*=\s*("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\[[^\]]*\]|[^,\s]+)\s*(?:,\s*|$)""", rest)
        if not a:
            raise TransformError("parse", rest)
        value: Any = a[2]
        if value[0] == "[":
            value = [v.strip().strip("\"'") for v in value[1:-1].split(",") if v.strip()]
        elif value[0] in "\"'":
            value = ast.literal_eval(value)
        elif re.fullmatch(r"-?\d+", value):
            value = int(value)
        out[a[1]] = value
        rest = rest[a.end() :]
    return out


def compile_all(specs: dict[str, Any], defined: set[str]) -> dict[str, dict]:
    """Transforms in the order of their references."""
    parsed: dict[str, dict] = {}
    for name, spec in specs.items():
        if name in defined:
            raise TransformError("already_defined", name)
        if isinstance(spec, str):
            one = parse_call(spec)
        else:
            if not isinstance(spec, dict) or len(spec) != 1:
                raise TransformError("parse", str(spec))
            func, args = next(iter(spec.items()))
            if func not in ("substring", "replace", "convert", "rewrite"):
                raise TransformError("parse", func)
            one = {"func": func, **args}
        if not _VAR.fullmatch(str(one.get("source", ""))):
            raise TransformError("malformed_var", str(one.get("source")))
        parsed[name] = one
    source = {k: str(v["source"]).lstrip("$") for k, v in parsed.items()}
    for name, s in source.items():
        if s not in parsed and s not in defined:
            raise TransformError("undefined_meta_var", f"{s} in transform of {name}")
    try:
        order = list(graphlib.TopologicalSorter({k: {s} & set(parsed) for k, s in source.items()}).static_order())
    except graphlib.CycleError as e:
        raise TransformError("cyclic_transform", str(e.args[1])) from e
    return {k: parsed[k] for k in order}


def deindent(text: str, source: str, start: int) -> str:
    """A text of several lines without the indentation of the line it begins on."""
    if "\n" not in text:
        return text
    return shift(text, indent_at(source[:start]), 0)


def indent_at(before: str) -> int:
    """Leading spaces of the line that `before` ends in, looking back 512 characters at most."""
    part = before[-512:]
    line = part.rsplit("\n", 1)
    if len(line) == 1 and len(before) > 512:
        return 0
    return len(line[-1]) - len(line[-1].lstrip(" "))


def shift(text: str, old: int, new: int) -> str:
    """Lines after the first get new - old spaces more, or lose as many where they have them."""
    if old == new or "\n" not in text:
        return text
    first, *rest = text.split("\n")
    if new > old:
        return "\n".join([first, *(" " * (new - old) + line for line in rest)])
    cut = " " * (old - new)
    return "\n".join(line[len(cut) :] if line.startswith(cut) else line for line in [first, *rest])


def apply(transforms: dict[str, dict], env: Any, rewriters: dict[str, Any] | None = None) -> None:
    """Runs compiled transforms over bindings; a source without a value gives an empty text."""
    for name, t in transforms.items():
        key = str(t["source"]).lstrip("$")
        text = env.text(key)
        if text is None:
            env.made[name] = ""
            continue
        first = env.one.get(key) or (env.many.get(key) or [None])[0]
        if key not in env.made and first is not None:
            text = deindent(text, first.tree.source, first.start)
        if t["func"] == "substring":
            env.made[name] = substring(text, t.get("startChar"), t.get("endChar"))
        elif t["func"] == "replace":
            env.made[name] = replace(text, t["replace"], t["by"])
        elif t["func"] == "convert":
            env.made[name] = convert(text, t["toCase"], t.get("separatedBy"))
        else:
            from treeline.operators.rewrite import rewrite_nodes

            nodes = [env.one[key]] if key in env.one else env.many.get(key, [])
            env.made[name] = rewrite_nodes(nodes, [rewriters[r] for r in t["rewriters"]], t.get("joinBy"), env) if nodes else ""
