"""Operator 1: BPE encoding and decoding by a tokenisation automaton.

The merges are compiled one after another, each by a *merge gadget*, into a
deterministic automaton over tokens whose language is exactly the token
sequences that BPE can produce. A gadget for the merge (u, v) -> x

* takes the state s that u leads to, makes a copy of it without the arc v, and
  lets u lead to the copy (u and v can no longer stand side by side), then
* adds an arc x from every state that still has an arc u, to the state that v
  led to before.

All arcs with one label lead to one state, so a state is kept as its parent
(what it was copied from) and the one label it lost. Whether a state has an arc
is read off the two tokens' split histories (`Automaton.allowed`) and kept in a
transition table; the bytes of all labels form a trie, a second table.

Encoding a word walks both tables from left to right. A prefix of a word has
exactly one accepted token sequence, so each position keeps one last token, and
the sequence is read back from the end: time is linear in the word's length.
Whole batches of distinct words advance together in numpy. Decoding emits the
arcs' labels.
"""

from __future__ import annotations

import base64
import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import textscan as ts

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_NEVER = np.iinfo(np.int32).max
#: Words of more bytes than this are encoded one by one.
_LONG_WORD = 48
_LETTER, _NUMBER, _OTHER, _BLANK = 0, 1, 2, 3


class _Table:
    """An open-addressing map from non-negative int64 to int32 in two arrays; absent is -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 0):
        size = 1 << max(4, int(np.ceil(np.log2(max(1, len(keys), room) * 3))))
        self.shift = np.uint64(64 - int(np.log2(size)))
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, -1, np.int32)
        self.add(keys, values)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys are distinct and not in the table, which has room for them."""
        size, left, at = len(self.keys), np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several that want one slot, the last gets it
            won = self.keys[at] == keys[left]
            self.values[at[won]] = values[left[won]]
            left, at = left[~won], (at[~won] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found, out = self.keys[at], self.values[at]
        miss = np.flatnonzero((found != keys) & (found >= 0))
        out[found < 0] = -1
        at, mask = at[miss], len(self.keys) - 1
        while len(miss):
            at = (at + 1) & mask
            found = self.keys[at]
            hit = found == keys[miss]
            out[miss[hit]] = self.values[at[hit]]
            out[miss[found < 0]] = -1
            more = ~hit & (found >= 0)
            miss, at = miss[more], at[more]
        return out


class _Known:
    """Words already encoded by this process, by hash. Forgets all when ROOM are in it."""

    ROOM = 1 << 19

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.table = _Table(np.zeros(0, np.int64), np.zeros(0, np.int32), self.ROOM)
        self.tokens, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.n = 0

    def add(self, keys: np.ndarray, tokens: np.ndarray, offsets: np.ndarray) -> None:
        used = int(self.ends[self.n])
        while used + len(tokens) > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.zeros_like(self.tokens)])
        while self.n + len(keys) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.tokens[used : used + len(tokens)] = tokens
        self.ends[self.n + 1 : self.n + 1 + len(keys)] = used + offsets[1:]
        self.table.add(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)


class Automaton:
    """The compiled merges. `labels[t]` are token t's bytes; ids without a label never occur."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        """merges: (u, v, x) token ids in the order of their ranks; byte tokens are those no merge makes."""
        size = max(labels, default=-1) + 1
        self.size = size
        self.labels = [labels.get(t, b"") for t in range(size)]
        self.left = np.full(size, -1, np.int32)
        self.right = np.full(size, -1, np.int32)
        self.rank = np.full(size, _NEVER, np.int32)
        self._compile(merges)
        self._build_trie({t: b for t, b in labels.items() if b and (self.left[t] >= 0 or len(b) == 1)})
        self.length = np.array([len(b) for b in self.labels], np.int64)
        self.blob = np.frombuffer(b"".join(self.labels), np.uint8)
        self.blob_at = np.concatenate([[0], np.cumsum(self.length)])[:-1].astype(np.int64)
        self.__setstate__({})

    def _compile(self, merges: list[tuple[int, int, int]]) -> None:
        """One merge gadget per merge. target[t]: the state that arcs t lead to; state k > 0 is a copy of
        parent[k] without the arc lost[k], made by the gadget of rank k - 1."""
        target = [0] * self.size
        self.parent, self.lost = [0], [-1]
        keys, ranks = [], []
        for r, (u, v, x) in enumerate(merges):
            to = target[v]
            self.parent.append(target[u])
            self.lost.append(v)
            target[u] = len(self.parent) - 1
            if self.left[x] < 0:
                target[x] = to
                self.left[x], self.right[x], self.rank[x] = u, v, r
            keys.append(u * self.size + v)
            ranks.append(r)
        self.target = np.array(target, np.int32)
        self.removed = _Table(np.array(keys, np.int64), np.array(ranks, np.int32))

    def _build_trie(self, labels: dict[int, bytes]) -> None:
        nodes: dict[int, int] = {}
        token_at = [-1]
        for t, label in labels.items():
            node = 0
            for byte in label:
                key = node * 257 + byte
                if (to := nodes.get(key)) is None:
                    to = nodes[key] = len(token_at)
                    token_at.append(-1)
                node = to
            token_at[node] = t
        self.trie = _Table(np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int32, len(nodes)))
        self.token_at = np.array(token_at, np.int32)
        self._nodes = nodes

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_memo_key", "_memo", "_pairs", "_known")} | {"_nodes": None}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._memo_key = np.full(1 << 20, -1, np.int64)
        self._memo = np.zeros(1 << 20, bool)
        self._pairs: dict[int, bool] = {}
        self._known: _Known | None = None

    def _allowed(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whether the state that w leads to has an arc x.

        The state lost, at rank r, the arc x' if a gadget (w', x') of that rank
        ran while w' was w or the last part of w not yet merged (r < the rank
        that made it part of more), and x got its arc from x' only if x' still
        had it when x was made (so r at most that rank counts).
        """
        ok = np.ones(len(w), bool)
        rows, a, bound_a = np.arange(len(w)), w, np.full(len(w), _NEVER, np.int32)
        while len(rows):
            inner, b, bound_b = np.arange(len(rows)), x[rows], np.full(len(rows), _NEVER, np.int32)
            while len(inner):
                r = self.removed.get(a[inner].astype(np.int64) * self.size + b)
                bad = (r >= 0) & (r < bound_a[inner]) & (r <= bound_b)
                ok[rows[inner[bad]]] = False
                more = ~bad & (self.left[b] >= 0)
                inner, b = inner[more], b[more]
                bound_b, b = self.rank[b], self.left[b]
            more = ok[rows] & (self.right[a] >= 0)
            rows, a = rows[more], a[more]
            bound_a, a = self.rank[a], self.right[a]
        return ok

    def allowed(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The transition table: rows are made when first needed and kept."""
        key = w.astype(np.int64) * self.size + x
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        out = self._memo[at]
        miss = np.flatnonzero(self._memo_key[at] != key)
        if len(miss):
            unique, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            fresh = self._allowed(w[miss[first]], x[miss[first]])
            out[miss] = fresh[back]
            put = at[miss[first]]
            self._memo_key[put] = unique
            # of several keys in one slot numpy keeps the last of each assignment alike
            self._memo[put] = fresh
        return out

    def _walk(self, word: bytes) -> list[int]:
        """One long word, the same walk without numpy's batches."""
        if self._nodes is None:
            self._nodes = {int(k): int(v) for k, v in zip(self.trie.keys, self.trie.values) if k >= 0}
        nodes, token_at, pairs = self._nodes, self.token_at, self._pairs
        n = len(word)
        last = [-1] * (n + 1)
        for i in range(n):
            before = last[i]
            if i and before < 0:
                continue
            node = 0
            for k in range(i, n):
                node = nodes.get(node * 257 + word[k], -1)
                if node < 0:
                    break
                t = int(token_at[node])
                if t >= 0 and last[k + 1] < 0:
                    if i:
                        key = before * self.size + t
                        if (ok := pairs.get(key)) is None:
                            if len(pairs) > 1_000_000:
                                pairs.clear()
                            ok = pairs[key] = bool(self._allowed(np.array([before]), np.array([t]))[0])
                        if not ok:
                            continue
                    last[k + 1] = t
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(self.labels[last[at]])
        return out[::-1]

    def encode_words(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words buf[start:end], one after another, and len(start) + 1 offsets."""
        size = end - start
        counts = np.zeros(len(start), np.int64)
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for row in np.flatnonzero(size > _LONG_WORD):
            tokens = np.array(self._walk(buf[start[row] : end[row]].tobytes()), np.int32)
            counts[row] = len(tokens)
            made.append((np.full(len(tokens), row), np.arange(len(tokens)), tokens))
        rows = np.flatnonzero((size > 0) & (size <= _LONG_WORD))
        n = size[rows]
        most = int(n.max()) if len(rows) else 0
        place = start[rows][:, None] + np.arange(most)
        chars = np.where(place < end[rows][:, None], buf[np.minimum(place, len(buf) - 1)], 256).astype(np.int64)  # 256 is on no arc
        last = np.full((most + 1, len(rows)), -1, np.int32)
        for i in range(most):
            live = np.flatnonzero((last[i] >= 0) & (i < n)) if i else np.arange(len(rows))
            before = last[i][live]
            node = np.zeros(len(live), np.int64)
            for k in range(i, most):
                node = self.trie.get(node * 257 + chars[live, k]).astype(np.int64)
                on = node >= 0
                live, before, node = live[on], before[on], node[on]
                if not len(live):
                    break
                token = self.token_at[node]
                goal = np.flatnonzero((token >= 0) & (last[k + 1][live] < 0))
                if i and len(goal):
                    goal = goal[self.allowed(before[goal], token[goal])]
                last[k + 1][live[goal]] = token[goal]
        at, live, step = n.copy(), np.arange(len(rows)), 0
        while len(live):
            token = last[at[live], live]
            made.append((rows[live], np.full(len(live), -1 - step), token))
            counts[rows[live]] += 1
            at[live] -= self.length[token]
            step += 1
            live = live[at[live] > 0]
        offsets = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(offsets[-1], np.int32)
        for row, at, token in made:
            out[np.where(at < 0, offsets[row + 1], offsets[row]) + at] = token
        return out, offsets

    def encode_all(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode_words; words that this process met before are looked up."""
        known = self._known = self._known or _Known()
        keys = (ts.word_hashes(buf, start, end) >> np.uint64(1)).astype(np.int64)
        which = known.table.get(keys)
        miss = np.flatnonzero(which < 0)
        if len(miss):
            fresh, first = np.unique(keys[miss], return_index=True)
            if known.n + len(fresh) > known.ROOM:
                known.clear()
                fresh, miss = np.unique(keys, return_index=True)
                if len(fresh) > known.ROOM:
                    return self.encode_words(buf, start, end)
            else:
                miss = miss[first]
            known.add(fresh, *self.encode_words(buf, start[miss], end[miss]))
            which = known.table.get(keys)
        size = known.ends[which + 1] - known.ends[which]
        offsets = np.concatenate([[0], np.cumsum(size)])
        return known.tokens[np.repeat(known.ends[which] - offsets[:-1], size) + np.arange(offsets[-1])], offsets

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        """The labels of the arcs, one after another."""
        size = self.length[tokens]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.repeat(self.blob_at[tokens] - (ends - size), size) + np.arange(total)]


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    return out | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


@lru_cache(maxsize=4)
def compiled(path: str = VOCABULARY) -> Automaton:
    """The automaton of a byte-level vocabulary file: JSON with merges, or base64 ranks (.tiktoken)."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = _byte_alphabet()
        name = {k: bytes(alphabet[c] for c in k) for k in model["vocab"] if all(c in alphabet for c in k)}
        ids, merges = model["vocab"], []
        for pair in model["merges"]:
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            merges.append((ids[u], ids[v], ids[u + v]))
        return Automaton({ids[k]: b for k, b in name.items()}, merges)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Automaton({r: b for b, r in ranks.items()}, [(*_parts(b, ranks), r) for b, r in sorted(ranks.items(), key=lambda x: x[1]) if len(b) > 1])


def _parts(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int]:
    """The two tokens that make this one: what BPE with lower ranks alone leaves of it."""
    parts, most = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        r, i = min((ranks.get(parts[i] + parts[i + 1], most), i) for i in range(len(parts) - 1))
        if r >= most:
            raise ValueError(f"no merges lead to {token!r}")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return ranks[parts[0]], ranks[parts[1]]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = _LETTER
        elif kind == "N":
            out[c] = _NUMBER
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _BLANK
    return out


def pre_split(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words that the vocabulary's pattern cuts, and n + 1 word offsets of the texts.

    A word is a run of letters, of numbers, of blanks or of other characters;
    one space goes with the run after it; an apostrophe that begins a word goes
    with a following s, d, m, t, ll, ve or re; of blanks before a word the last
    is cut off. Words never cross texts.
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    chars = np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(chars)
    wide = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
    byte_at = np.concatenate([[0], np.cumsum(wide)])
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(byte_at, off)] = True  # where texts begin
    kind = _classes()[chars]
    cut = np.ones(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    cut |= edge
    blank = kind == _BLANK
    follows = np.zeros(n, bool)  # a blank with a word right after it in its text
    follows[:-1] = blank[:-1] & ~blank[1:] & ~edge[1:n]
    cut[:-1] |= follows
    glued = np.flatnonzero(follows & (chars == 32))
    cut[glued + 1] = False
    quote = np.flatnonzero(chars == 0x27)
    quote = quote[cut[quote]]
    if len(quote):
        padded = np.concatenate([chars, np.zeros(2, np.uint32)])
        in_text = ~np.concatenate([edge, np.ones(2, bool)])
        one = np.isin(padded[quote + 1], np.frombuffer("sdmt".encode("utf-32-le"), np.uint32)) & in_text[quote + 1]
        pair = padded[quote + 1].astype(np.int64) << 32 | padded[quote + 2]
        two = np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("ll", "ve", "re")]) & in_text[quote + 1] & in_text[quote + 2]
        for at, size in ((quote[one], 2), (quote[two], 3)):
            cut[at + 1] = False
            cut[at + size] = True
    marks = np.flatnonzero(cut)
    return byte_at[marks[:-1]], byte_at[marks[1:]], np.searchsorted(marks[:-1], np.searchsorted(byte_at, off))


def encode_column(automaton: Automaton, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs [a, b) of texts: a, b, their tokens, b - a + 1 offsets into these, and whether each decodes to itself."""
    buf, off = ts.raw(texts)
    for a, b in ts.chunks(off):
        part, local = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        start, end, word_off = pre_split(part, local)
        out, ends = automaton.encode_all(part, start, end)
        out_off = ends[word_off].astype(np.int64)
        again = automaton.decode(out)
        if len(again) == len(part):
            wrong = np.concatenate([[0], np.cumsum(again != part)])
            same = wrong[local[1:]] == wrong[local[:-1]]
        else:
            same = np.array([np.array_equal(automaton.decode(out[out_off[k] : out_off[k + 1]]), part[local[k] : local[k + 1]]) for k in range(b - a)])
        yield a, b, out, out_off, same


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, token_ids ARRAY<INT>, n_tokens BIGINT, round_trip BOOLEAN) of every row of docs.

    A null text gives null tokens, null count and null round_trip; an empty
    text gives an empty array, an empty table no rows. Rows and ids repeat as they do in docs, other
    columns are left out. Texts of any length are encoded whole; special
    tokens' names in a text are ordinary text.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(compiled(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b, tokens, off, same in encode_column(automaton, texts):
                null = pa.compute.is_null(texts.slice(a, b - a)).to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32), pa.int32(), mask=np.append(null, False)), pa.array(tokens, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), lists, pa.array(np.diff(off), pa.int64(), mask=null), pa.array(same, pa.bool_(), mask=null)],
                    ["doc_id", "token_ids", "n_tokens", "round_trip"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, token_ids array<int>, n_tokens bigint, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from doc_id and token_ids. Null tokens give a null text, no tokens an empty one; unknown ids raise. A batch's tokens are decoded at once and cut where texts end."""
    shared = encoded.sparkSession.sparkContext.broadcast(compiled(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            lists = batch.column(1)
            tokens, sizes = lists.flatten().to_numpy().astype(np.int64), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
            if len(tokens) and tokens.min() < 0:
                raise ValueError("a token id below 0")
            data = automaton.decode(tokens)
            # bytes before each token, and so before each text
            before = np.concatenate([[0], np.cumsum(automaton.length[tokens])])
            ends = before[np.concatenate([[0], np.cumsum(sizes)])]
            valid = pa.compute.is_valid(lists).to_numpy(zero_copy_only=False)
            texts = pa.Array.from_buffers(pa.large_string(), len(lists), [pa.py_buffer(np.packbits(valid, bitorder="little").tobytes()), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), texts.cast(pa.string())], ["doc_id", "text"])

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "token_ids").mapInArrow(run, f"doc_id {id_type}, text string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document of the table: `encode` with the default vocabulary."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage of the pipeline: the tokens of every document, on the terms of `encode`."""
    return encode(docs).select("doc_id", "token_ids", "n_tokens", F.col("round_trip"))
