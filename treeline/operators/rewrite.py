"""Rewriting: templates, edits and their application, per tree and per table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from treeline.functions.transforms import deindent, indent_at, shift
from treeline.model import Node, Tree
from treeline.operators.patterns import Env, Matcher, Pattern, compile_pattern
from treeline.sources.parsers import parse
from treeline.storage import spread

_VAR = re.compile(r"\$\$\$([A-Z_][A-Z0-9_]*)|\$([A-Z_][A-Z0-9_]*)")

Edit = tuple[int, int, str]  # position, deleted length, inserted text


def render(template: str, env: Env, node: Node) -> str:
    """The template with its variables, each indented as its place is, all indented as the node's line."""
    out, at = [], 0
    for m in _VAR.finditer(template):
        name = m[1] or m[2]
        out.append(template[at : m.start()])
        at = m.end()
        text = env.text(name)
        if text is None:
            continue
        first = env.one.get(name) or (env.many.get(name) or [None])[0]
        if name not in env.made and first is not None:
            text = deindent(text, first.tree.source, first.start)
        out.append(shift(text, 0, indent_at(template[: m.start()])))
    return shift("".join([*out, template[at:]]), 0, indent_at(node.tree.source[: node.start]))


def structural(template: str, language: str, env: Env) -> str:
    """The template as a tree: its named leaves that are variables are substituted."""
    tree, out, at = parse(template, language), [], 0
    for n in tree.nodes:
        if n.is_leaf and n.named and (m := _VAR.fullmatch(n.text)) and n.start >= at:
            text = env.text(m[1] or m[2])
            out += [template[at : n.start], n.text if text is None else text]
            at = n.end
    return "".join([*out, template[at:]])


def edit_of(node: Node, env: Env, fix: Any) -> Edit:
    """A fix's edit; expandStart and expandEnd take in siblings while they match, as far as the stop allows."""
    start, end = node.start, node.end
    for part, siblings in ((fix.before, node.earlier()), (fix.after, node.later())):
        if part is None:
            continue
        reach = None
        if part.stop == "neighbor":
            siblings = siblings[:1]
        for s in siblings:
            if part.rule.match(s, env.copy()) is not None:
                reach = s
                break
            if part._stops(s):
                break
        if reach is not None:
            start, end = min(start, reach.start), max(end, reach.end)
    return start, end - start, render(fix.template, env, node)


def apply_edits(source: str, edits: list[Edit]) -> str:
    """Edits in order of position; one that overlaps an earlier one is skipped."""
    out, at = [], 0
    for pos, size, text in sorted(edits, key=lambda e: e[0]):
        if pos < at:
            continue
        out += [source[at:pos], text]
        at = pos + size
    return "".join([*out, source[at:]])


def rewrite_nodes(nodes: list[Node], rewriters: list[Any], join_by: str | None, outer: Env) -> str:
    """What rewriters make of captured nodes: depth first, the first that matches a node, nothing below it."""
    edits: list[Edit] = []
    for top in nodes:
        last = -1
        for n in top.walk():
            if n.start < last:
                continue
            for r in rewriters:
                base = Env(outer.one, outer.many, outer.made)
                if (found := r.match(n, base)) is not None:
                    edits.append(edit_of(n, found[1], r.fixes[0]))
                    last = max(last, n.end)
                    break
    if join_by is not None:
        return join_by.join(e[2] for e in edits)
    a, b = nodes[0].start, nodes[-1].end
    inside = [(p - a, s, t) for p, s, t in edits]
    return deindent(apply_edits(nodes[0].tree.source[a:b], inside), nodes[0].tree.source, a)


@lru_cache(maxsize=256)
def _compiled(pattern: str, language: str) -> Pattern:
    return compile_pattern(pattern, language)


def replacements(tree: Tree, pattern: str, template: str, only_first: bool = False) -> list[Edit]:
    """Edits for the outermost matches of a pattern, in document order; trailing trivia of a match stays."""
    matcher = Matcher(_compiled(pattern, tree.language))
    edits, past = [], -1
    for n in tree.nodes:
        if n.pre <= past:
            continue
        env = Env()
        if matcher.match(n, env):
            size = (matcher.reach if matcher.reach > n.start else n.end) - n.start
            edits.append((n.start, size, render(template, env, n)))
            past = n.end_pre
            if only_first:
                break
    return edits


def node_edit(kind: str, node: Node, text: str = "") -> Edit:
    """remove, empty, before, after, append, prepend or replace as an edit."""
    inner = (node.children[0].start, node.children[-1].end) if node.children else (node.end, node.end)
    return {
        "replace": (node.start, node.end - node.start, text), "remove": (node.start, node.end - node.start, ""), "empty": (inner[0], inner[1] - inner[0], ""),
        "before": (node.start, 0, text), "after": (node.end, 0, text), "prepend": (inner[0], 0, text), "append": (inner[1], 0, text),
    }[kind]


# --- on tables --------------------------------------------------------------


def rewrite_sources(sources: DataFrame, edits_of: Callable[[Tree], list[Edit]], may: Callable[[str, str], bool] | None = None) -> DataFrame:
    """(file_id, content, n_edits) of sources (file_id, language, content); a null content stays null. may(content, language): whether a text can have edits at all; others aren't parsed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for fid, language, content in zip(frame.file_id, frame.language, frame.content):
                if content is None or may is not None and not may(content, language):
                    rows.append((fid, content, 0))
                    continue
                edits = edits_of(parse(content, language))
                rows.append((fid, apply_edits(content, edits), len(edits)))
            yield pd.DataFrame(rows, columns=["file_id", "content", "n_edits"])

    return spread(sources.select("file_id", "language", "content")).mapInPandas(run, "file_id string, content string, n_edits bigint")


def replace_all(sources: DataFrame, pattern: str, template: str) -> DataFrame:
    return rewrite_sources(sources, lambda tree: replacements(tree, pattern, template), lambda content, language: _compiled(pattern, language).fixed_text() in content)


def replace_first(sources: DataFrame, pattern: str, template: str) -> DataFrame:
    return rewrite_sources(sources, lambda tree: replacements(tree, pattern, template, only_first=True), lambda content, language: _compiled(pattern, language).fixed_text() in content)
