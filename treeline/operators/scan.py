"""Scans of many rules over many files: dispatch, path globs, suppression, fixes.

Two ways give the same findings. `scan_sources` parses each file once and runs
all rules on its tree, in Arrow batches that are dealt out to all cores; it takes every rule.
`scan_nodes` compiles rules without bindings to plans over the node table.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.functions.transforms import template_col
from treeline.model import Node, Tree
from treeline.operators import structural
from treeline.operators.labels import embedded_spots, recovered, usable
from treeline.operators.patterns import Env
from treeline.operators.rewrite import edit_of, render
from treeline.operators.rules import Config, Rule, build
from treeline.sources.parsers import PARSERS, css_declarations, parse, parse_css, parse_ranges
from treeline.storage import spread

MARKER = "lint-ignore"
UNUSED_ID = "unused-suppression"

FINDING = (
    "file_id string, rule_id string, severity string, pre int, start_char int, end_char int, start_line int, start_col int, text string, message string, "
    "is_diff boolean, edit_start int, edit_length int, edit_text string, labels string, captures string"
)


# --- globs ------------------------------------------------------------------


def glob_regex(glob: str) -> str:
    """A glob as a regex for whole paths: * within a part, ** over parts, ? one character, [..] and {a,b}."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i:]:
            end = glob.index("]", i)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end + 1
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    return f"^{out}$"


def applies(path: str, files: list[str], ignores: list[str]) -> bool:
    """ignores beat files; no globs means always."""
    if any(re.search(glob_regex(g), path) for g in ignores):
        return False
    return not files or any(re.search(glob_regex(g), path) for g in files)


def applies_col(path: Column, files: list[str], ignores: list[str]) -> Column:
    value = F.lit(True) if not files else F.lit(False)
    for g in files:
        value = value | path.rlike(glob_regex(g))
    for g in ignores:
        value = value & ~path.rlike(glob_regex(g))
    return F.coalesce(value, F.lit(False))


# --- collections ------------------------------------------------------------


class Collection:
    """Rules by language; severity off is dropped. Rules with globs are contingent on the path, others always on."""

    def __init__(self, rules: list[Config]):
        self.rules = [r for r in rules if r.severity != "off"]
        self.tenured: dict[str, list[Config]] = {}
        self.contingent: dict[str, list[Config]] = {}
        for r in self.rules:
            (self.contingent if r.files or r.ignores else self.tenured).setdefault(r.language, []).append(r)

    def for_path(self, path: str, language: str) -> list[Config]:
        """Rules for a file: those without a fix first, then by id."""
        found = [*self.tenured.get(language, []), *(r for r in self.contingent.get(language, []) if applies(path, r.files, r.ignores))]
        return sorted(found, key=lambda r: (bool(r.fixes), r.id))

    def __len__(self) -> int:
        return len(self.rules)


# --- suppression ------------------------------------------------------------


def suppressed_ids(text: str, marker: str = MARKER) -> set[str] | None:
    """Rule ids after `marker:`; None, for all rules, if there is no colon."""
    after = text.split(marker, 1)[1].strip()
    if not after.startswith(":"):
        return None
    return {i.strip() for i in after[1:].split(",") if i.strip()}


class Suppressions:
    """Comments that hide findings, by line or for the whole file."""

    def __init__(self, tree: Tree, marker: str = MARKER):
        self.by_line: dict[int, tuple[Node, set[str] | None]] = {}
        self.file: tuple[Node, set[str] | None] | None = None
        self.used: set[int] = set()
        for n in tree.nodes:
            if "comment" not in n.kind or marker not in n.text:
                continue
            ids, line = suppressed_ids(n.text.rstrip("->*/ \n"), marker), tree.position(n.start)[0]
            before = n.earlier()[:1]
            own = bool(before) and tree.position(before[0].start)[0] == line
            after = n.later()[:1]
            if line == 0 and not own and (not after or tree.position(after[0].start)[0] >= 2):
                self.file = (n, ids)
            else:
                self.by_line[line if own else line + 1] = (n, ids)

    @property
    def blanket(self) -> bool:
        """A file-level comment without ids: nothing is reported at all."""
        return self.file is not None and self.file[1] is None

    def hides(self, line: int, rule_id: str) -> bool:
        for held in (self.by_line.get(line), self.file):
            if held and (held[1] is None or rule_id in held[1]):
                self.used.add(held[0].pre)
                return True
        return False

    def unused(self) -> list[Node]:
        held = [*self.by_line.values(), *([self.file] if self.file else [])]
        return sorted((n for n, _ in held if n.pre not in self.used), key=lambda n: n.start)


# --- per tree ---------------------------------------------------------------


def labels_of(rule: Config, node: Node, env: Env) -> list[dict]:
    """The match as primary and relations' nodes as secondary; or what the rule configures for its variables."""
    if rule.labels:
        out = []
        for name, label in sorted(rule.labels.items()):
            nodes = [env.one[name]] if name in env.one else env.many.get(name, [])
            if nodes:
                out.append({"style": label["style"], "message": label.get("message"), "start": nodes[0].start, "end": nodes[-1].end})
        return out
    out = [{"style": "primary", "message": None, "start": node.start, "end": node.end}]
    return out + [{"style": "secondary", "message": None, "start": n.start, "end": n.end} for n in env.many.get("secondary", [])]


def scan_tree(tree: Tree, rules: list[Config], file_id: str, separate_fix: bool = False, report_unused: bool = True) -> list[tuple]:
    """Findings of one tree in the order of their start; one pass serves all rules, dispatched by kind."""
    hidden = Suppressions(tree)
    if hidden.blanket:
        return []
    by_kind: dict[str, list[Config]] = {}
    always: list[Config] = []
    for r in rules:
        kinds = r.kinds()
        for k in kinds or ():
            by_kind.setdefault(k, []).append(r)
        if kinds is None or "ERROR" in kinds:
            always.append(r)
    out = []
    for n in tree.nodes:
        seen = set()
        for r in [*by_kind.get(n.kind, []), *always]:
            if r.id in seen:
                continue
            seen.add(r.id)
            found = r.match(n)
            if found is None:
                continue
            node, env = found
            line, col = tree.position(node.start)
            if hidden.hides(line, r.id):
                continue
            diff = separate_fix and bool(r.fixes)
            edit = edit_of(node, env, r.fixes[0]) if r.fixes else (None, None, None)
            captures = {k: v for k, v in sorted(env.strings().items())}
            out.append((
                file_id, r.id, r.severity, node.pre, node.start, node.end, line, col, node.text, render(r.message, env, node), diff, *edit,
                json.dumps(labels_of(r, node, env)), json.dumps(captures, ensure_ascii=False),
            ))
    if report_unused:
        for n in hidden.unused():
            line, col = tree.position(n.start)
            out.append((file_id, UNUSED_ID, "hint", n.pre, n.start, n.end, line, col, n.text, "unused suppression", False, n.start, n.end - n.start, "", "[]", "{}"))
    return sorted(out, key=lambda f: (f[4], f[1]))


def scan_sources(sources: DataFrame, rules: list[Config], separate_fix: bool = False, report_unused: bool = True) -> DataFrame:
    """Findings of sources (file_id, path, language, content). Contents that are null or empty give none."""
    collection = Collection(rules)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FINDING.split(", ")]
        for frame in frames:
            rows: list[tuple] = []
            for fid, path, language, content in zip(frame.file_id, frame.path, frame.language, frame.content):
                wanted = collection.for_path(path or "", language) if content else []
                if wanted:
                    rows += scan_tree(parse(content, language), wanted, fid, separate_fix, report_unused)
            out = pd.DataFrame(rows, columns=names)
            for c in ("edit_start", "edit_length", "pre", "start_char", "end_char", "start_line", "start_col"):
                out[c] = out[c].astype("Int32")
            yield out

    wanted = sources.where(F.col("language").isin(sorted({r.language for r in collection.rules})))
    # a text that a pattern needs is looked for before any parsing
    needles = [_needle(r) for r in collection.rules]
    if needles and all(needles) and not report_unused:
        keep = F.lit(False)
        for needle in needles:
            keep = keep | F.col("content").contains(needle)
        wanted = wanted.where(keep)
    return spread(wanted.select("file_id", "path", "language", "content")).mapInPandas(run, FINDING)


MATCH = "file_id string, rule_id string, pre int, end_pre int, parent int, field string, kind string, start_char int, end_char int, text string"


def matches(sources: DataFrame, specs: dict[str, dict], most_bytes: int = 10 << 20, embedded: str | None = None) -> DataFrame:
    """The columns MATCH of the nodes of sources (file_id, language, content) that match rules, by their ids.

    What `structural.select` finds in the tables of `parse_sources` and, where
    sources has start_char and end_char, of `parse_embedded`; but each source is
    parsed once for all rules, and only matches leave the task. Texts are whole.
    embedded: HTML sources are searched in their scripts and styles of that
    language, in the task that parsed them: no source travels once a script.
    """
    inside = {"start_char", "end_char"} <= set(sources.columns)

    def found_in(fid: str, language: str, content: str, a: int | None, b: int | None) -> Iterator[tuple[str, Tree]]:
        if inside:
            yield f"{fid}#{a}", parse_ranges(content, [(a, b)], language)[0]
            return
        tree = recovered(content, language, "partial")
        if embedded is None:
            yield fid, tree
            return
        for held, a, b in embedded_spots(tree):
            if held == embedded:
                yield f"{fid}#{a}", parse_ranges(content, [(a, b)], held)[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built: dict[str, list[tuple[str, Rule, set[str] | None]]] = {}
        for frame in frames:
            rows: list[tuple] = []
            spots = zip(frame.start_char, frame.end_char) if inside else itertools.repeat((None, None))
            for fid, language, content, (a, b) in zip(frame.file_id, frame.language, frame.content, spots):
                for name, tree in found_in(fid, language, content, a, b):
                    if tree.language not in built:
                        found = [(k, build(spec, tree.language, {})) for k, spec in specs.items()]
                        built[tree.language] = [(k, r, kinds if (kinds := r.kinds()) is not None and "ERROR" not in kinds else None) for k, r in found]
                    for n in tree.nodes:
                        for rule_id, rule, kinds in built[tree.language]:
                            if (kinds is None or n.kind in kinds) and (m := rule.match(n, Env())) is not None:
                                rows.append((name, rule_id, m.pre, m.end_pre, m.parent.pre if m.parent else -1, m.field, m.kind, m.start, m.end, m.text))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MATCH.split(", ")])

    good = sources if inside else sources.where(usable(most_bytes))
    return spread(good.select(F.col("file_id").cast("string").alias("file_id"), "language", "content", *(["start_char", "end_char"] if inside else []))).mapInPandas(run, MATCH)


def _declared(content: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """Each declaration's property and its named values (kind, text)."""
    if PARSERS.get("css") is parse_css:
        yield from css_declarations(content)
        return
    for node in recovered(content, "css", "partial").nodes:
        if node.kind == "declaration":
            found = [(c.kind, c.text) for c in node.children if c.named and c.kind != "property_name"]
            yield from ((c.text, found) for c in node.children if c.kind == "property_name")


def declarations(sources: DataFrame, kinds: set[str], most_bytes: int = 10 << 20) -> DataFrame:
    """(file_id, property, kind, value): the values of some kinds in the declarations of CSS sources (file_id, language, content).

    A declaration's values are put to its property where it is read, so that
    nothing is sorted or travels by file and node. The parser's own pieces are
    enough, without a tree; where another parser is in place, its tree is read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(fid, name, kind, value) for fid, content in zip(frame.file_id, frame.content) for name, values in _declared(content) for kind, value in values if kind in kinds]
            yield pd.DataFrame(rows, columns=["file_id", "property", "kind", "value"])

    good = sources.where(usable(most_bytes) & (F.col("language") == "css"))
    return spread(good.select(F.col("file_id").cast("string").alias("file_id"), "content")).mapInPandas(run, "file_id string, property string, kind string, value string")


def _needle(rule: Config) -> str:
    pattern = getattr(rule.rule, "pattern", None)
    return pattern.fixed_text() if pattern is not None else ""


def scan_nodes(nodes: DataFrame, rules: dict[str, dict], severity: dict[str, str] | None = None, messages: dict[str, str] | None = None, utils: dict[str, dict] | None = None) -> DataFrame:
    """(file_id, pre, rule_id, severity, message) of rules without bindings: one scan, one sort, a column a rule."""
    marked, pieces = structural.with_text(nodes) if structural.reads_text(list(rules.values()), utils or {}) else nodes, []
    for rule_id, spec in sorted(rules.items()):
        level = (severity or {}).get(rule_id, "hint")
        if level == "off":
            continue
        marked, name = structural.mark(marked, spec, utils or {})
        message = template_col((messages or {}).get(rule_id, ""), {"TEXT": F.col("text"), "KIND": F.col("kind")})
        pieces.append(F.when(F.col(name), F.struct(F.lit(rule_id).alias("rule_id"), F.lit(level).alias("severity"), message.alias("message"))))
    hits = F.filter(F.array(*pieces), lambda x: x.isNotNull())
    return marked.select("file_id", "pre", "kind", "start_line", F.explode(hits).alias("f")).select("file_id", "pre", "kind", "start_line", "f.*") if "start_line" in nodes.columns else marked.select("file_id", "pre", "kind", F.explode(hits).alias("f")).select("file_id", "pre", "kind", "f.*")


def suppress(findings: DataFrame, comments: DataFrame) -> DataFrame:
    """findings (file_id, line, rule_id, ...) without those that comments (file_id, line, rule_id or null for all) hide."""
    c = comments.select(F.col("file_id").alias("c_file"), F.col("line").alias("c_line"), F.col("rule_id").alias("c_rule")).distinct()
    return findings.join(c, (F.col("file_id") == F.col("c_file")) & (F.col("line") == F.col("c_line")) & (F.col("c_rule").isNull() | (F.col("rule_id") == F.col("c_rule"))), "left_anti")


def unused(findings: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments that hid nothing."""
    f = findings.select(F.col("file_id").alias("f_file"), F.col("line").alias("f_line"), F.col("rule_id").alias("f_rule")).distinct()
    return comments.join(f, (F.col("file_id") == F.col("f_file")) & (F.col("line") == F.col("f_line")) & (F.col("rule_id").isNull() | (F.col("rule_id") == F.col("f_rule"))), "left_anti")


def suppression_comments(lines: DataFrame, marker: str = MARKER) -> DataFrame:
    """(file_id, line, rule_id) from lines (file_id, line, text): a marker hides findings on the next line, all of them without ids."""
    found = lines.where(F.col("text").contains(marker))
    ids = F.regexp_extract("text", re.escape(marker) + r"\s*:\s*([A-Za-z0-9_\-, ]+)", 1)
    listed = F.filter(F.transform(F.split(ids, ","), lambda x: F.trim(x)), lambda x: x != "")
    some = F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit(None).cast("string")))
    return found.select("file_id", (F.col("line") + 1).alias("line"), F.explode(some).alias("rule_id"))


def counts_by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("files"))


def rollup(findings: DataFrame, *columns: str) -> DataFrame:
    """Counts for every prefix of columns, with the level that a row is of."""
    return findings.rollup(*columns).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def context_lines(content: Column, line: Column, before: int, after: int) -> Column:
    """The lines around a line, from `before` above to `after` below."""
    lines = F.split(content, "\n", -1)
    first = F.greatest(F.lit(0), line - before)
    return F.array_join(F.slice(lines, (first + 1).cast("int"), (line - first + after + 1).cast("int")), "\n")
