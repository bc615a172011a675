"""The node table and the trees that Python functions see.

One row is one syntax-tree node. `pre` is its rank in document order within its
file, the subtree of a node is every row with pre in [pre, end_pre]. Offsets
are kept in bytes and in characters, lines and columns count from 0.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np

NODE = (
    "file_id string, pre int, end_pre int, parent int, depth int, child_idx int, named_idx int, n_children int, n_named int, "
    "field string, kind string, is_named boolean, is_error boolean, is_missing boolean, start_byte int, end_byte int, "
    "start_char int, end_char int, start_line int, start_col int, end_line int, end_col int, text string"
)
COLUMNS = [c.split()[0] for c in NODE.split(", ")]


class Node:
    """A node of a parsed text. Equality is identity."""

    __slots__ = ("kind", "named", "start", "end", "field", "parent", "children", "tree", "pre", "end_pre", "depth", "index", "error", "missing")

    def __init__(self, kind: str, start: int, end: int, named: bool = True, field: str | None = None, error: bool = False, missing: bool = False):
        self.kind, self.named, self.start, self.end, self.field = kind, named, start, end, field
        self.error, self.missing = error, missing
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.tree: Tree | None = None
        self.pre = self.end_pre = self.depth = self.index = 0

    def add(self, child: Node) -> Node:
        child.parent, child.index = self, len(self.children)
        self.children.append(child)
        return child

    @property
    def text(self) -> str:
        return self.tree.source[self.start : self.end]

    @property
    def is_leaf(self) -> bool:
        return not self.children

    @property
    def is_named_leaf(self) -> bool:
        """No named children, which is not the same as named and a leaf."""
        return not any(c.named for c in self.children)

    def child(self, field: str) -> Node | None:
        return next((c for c in self.children if c.field == field), None)

    def ancestors(self) -> Iterator[Node]:
        """Nearest first."""
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def walk(self) -> Iterator[Node]:
        """The node and all below it, in document order."""
        yield from self.tree.nodes[self.pre : self.end_pre + 1]

    def later(self) -> list[Node]:
        return self.parent.children[self.index + 1 :] if self.parent else []

    def earlier(self) -> list[Node]:
        """Nearest first."""
        return self.parent.children[: self.index][::-1] if self.parent else []

    def __repr__(self) -> str:
        return f"<{self.kind} {self.start}..{self.end}>"


class Tree:
    """A source text with its nodes in document order."""

    def __init__(self, source: str, root: Node, language: str = ""):
        self.source, self.root, self.language = source, root, language
        self.nodes: list[Node] = []
        stack: list[tuple[Node, int]] = [(root, 0)]
        while stack:
            node, depth = stack.pop()
            node.tree, node.depth, node.pre = self, depth, len(self.nodes)
            self.nodes.append(node)
            stack.extend((c, depth + 1) for c in reversed(node.children))
        for node in reversed(self.nodes):
            node.end_pre = node.children[-1].end_pre if node.children else node.pre

    @functools.cached_property
    def _lines(self) -> list[int]:
        """Where lines begin. Only made when asked for: a page with many scripts is the source of as many trees."""
        lines, at = [0], self.source.find("\n")
        while at >= 0:
            lines.append(at + 1)
            at = self.source.find("\n", at + 1)
        return lines

    def position(self, char: int) -> tuple[int, int]:
        """Line and column, in characters, of an offset in characters."""
        line = bisect.bisect_right(self._lines, char) - 1
        return line, char - self._lines[line]

    def columns(self, file_id: str, most_text: int = 256) -> list[list]:
        """The node table's columns. Leaves and the root have their text, other nodes up to most_text characters: longer ones are slices of the root's (`structural.with_text`)."""
        nodes, source = self.nodes, self.source
        starts, ends = [n.start for n in nodes], [n.end for n in nodes]
        chars = np.array([starts, ends])
        lines = np.array(self._lines)
        line = np.searchsorted(lines, chars, side="right") - 1
        col = chars - lines[line]
        at = chars
        if not source.isascii():
            points = np.frombuffer(source.encode("utf-32-le", "surrogatepass"), np.uint32)
            widths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
            at = np.concatenate([[0], np.cumsum(widths)])[chars]
        named_idx: list[int | None] = []
        n_named = [0] * len(nodes)
        for n in nodes:  # in document order, so that a node comes behind its earlier siblings
            if n.parent is None:
                named_idx.append(None)
                continue
            up = n.parent.pre
            named_idx.append(n_named[up] if n.named else None)
            n_named[up] += n.named
        texts = [source[a:b] if b - a <= most_text or not n.children or n.parent is None else None for n, a, b in zip(nodes, starts, ends)]
        return [
            [file_id] * len(nodes), [n.pre for n in nodes], [n.end_pre for n in nodes], [-1 if n.parent is None else n.parent.pre for n in nodes], [n.depth for n in nodes], [n.index for n in nodes], named_idx, [len(n.children) for n in nodes], n_named,
            [n.field for n in nodes], [n.kind for n in nodes], [n.named for n in nodes], [n.error for n in nodes], [n.missing for n in nodes], *at.tolist(), starts, ends, *(x.tolist() for pair in zip(line, col) for x in pair), texts,
        ]

    def rows(self, file_id: str, most_text: int = 256) -> list[tuple]:
        """The node table's rows."""
        return list(zip(*self.columns(file_id, most_text)))
