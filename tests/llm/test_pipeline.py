"""The pipeline against a naive version of each of its stages, one document at a time."""

import base64
import hashlib
import random
import re
from collections import Counter
from math import isqrt

import pytest
from test_substring import brute
from test_toxicity import naive_mix, naive_probability, naive_train

import corpus_pipeline
from treeline.llm import mixing, simhash, textscan, toxicity

M = (1 << 64) - 1
CLEAN = "the river walks under old trees slowly towards evening light and stones remember every boat that passed before winter came down from hills".split()


def corpus():
    """(doc_id, text, lang, source, n_chars): toxic ones, near and exact copies, shared passages, nulls, repeats, a long text."""
    draw = random.Random(11)
    fresh = lambda n: [draw.choice(CLEAN) + str(draw.randrange(400)) for _ in range(n)]
    passage = " ".join(fresh(60))
    texts = [" ".join(fresh(draw.randrange(20, 120))) for _ in range(60)]
    for k in range(0, 12):
        words = fresh(40)
        for bad in ("stupid", "moron", "worthless"):
            words.insert(draw.randrange(len(words)), bad)
        texts.append(" ".join(words))
    for k in range(4):  # near copies
        words = texts[k].split() + fresh(120)
        texts[k] = " ".join(words)
        for _ in range(3):
            copy = list(words)
            copy[draw.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    for k in range(10, 16):
        texts[k] += "\n" + passage + " " + " ".join(fresh(5))
    texts += [passage, texts[20], "", " \n ", "a", " ".join(fresh(40_000))]
    rows = [(i, t, "en", f"src{i % 5 if i % 3 else 0}", len(t)) for i, t in enumerate(texts)]
    rows += [(200, None, "en", None, None), (None, texts[21], "de", "src1", 5), (201, texts[22] + " x", None, "src2", -3), rows[30], rows[30], (31, "another text, a short one, of an id that has one", "en", "src1", 9)]
    labels = [(i, int(any(b in t.split() for b in ("stupid", "moron", "worthless")))) for i, t in enumerate(texts) if i % 2 == 0 or 60 <= i < 72]
    return rows, labels


def fingerprint(text):
    """The bits of a text, word by word, or None without a word."""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
    if not words:
        return None
    base = int(textscan._BASE)
    value = [int(v) for v in textscan._BYTE_VALUE]
    once = {w: naive_mix(sum(value[b] * pow(base, k, 1 << 64) for k, b in enumerate(w.encode())) & M) for w in set(words)}
    features = set(once.values()) | {naive_mix((once[a] * 3 + once[b]) & M) for a, b in zip(words, words[1:])}
    bits = [0] * simhash.BITS
    for f in features:
        for lane in range(simhash.LANES):
            x = f if lane == 0 else naive_mix((f + 0x9E37 * lane) & M)
            for j in range(64):
                bits[lane * 64 + j] += x >> j & 1
    return [2 * b > len(features) for b in bits]


def naive_simhash(rows):
    prints = {(r[0], r[1]): fingerprint(r[1]) for r in rows if r[0] is not None}
    keys = [k for k, v in prints.items() if v is not None]
    group = {k[0]: k[0] for k in keys}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for n, a in enumerate(keys):
        for b in keys[:n]:
            if sum(x != y for x, y in zip(prints[a], prints[b])) <= simhash.DISTANCE:
                x, y = top(a[0]), top(b[0])
                group[max(x, y)] = min(x, y)
    return [r for r in rows if r[0] not in group or top(r[0]) == r[0]]


def naive_cut(rows):
    spans, out = {}, []
    distinct = sorted({(r[0], r[1]) for r in rows if len((r[1] or "").split()) >= 50}, key=lambda k: (k[0] is None, k[0] or 0))
    assert len({k[0] for k in distinct}) == len(distinct)  # else the order would need the hash of the text
    for doc, found in brute([(d, t) for d, t in distinct]).items():
        spans[doc] = found
    for r in rows:
        if len((r[1] or "").split()) < 50 or r[0] not in spans:
            out.append(r)
            continue
        starts = [m.start() for m in re.finditer(r"[^ \t\n\x0b\f\r]+", r[1])] + [len(r[1])]
        text, at = "", 0
        for s, e, _ in sorted(spans[r[0]]):
            text += r[1][at : starts[s]]
            at = starts[e]
        text += r[1][at:]
        if re.search(r"[^ \t\n\x0b\f\r]", text):
            out.append((r[0], text, *r[2:4], len(text)))
    return out


def naive_mixing(rows):
    size = [1 + isqrt(max(r[4] or 0, 0)) for r in rows]
    u = [(int(hashlib.md5(f"{mixing.SEED}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52 for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS.get(s, mixing.DEFAULT_WEIGHT) for s in sources}
    out, cum, all_weight = [], 0, sum(weight.values())
    for s in sources:
        target = len(rows) * (cum + weight[s]) // all_weight - len(rows) * cum // all_weight
        cum += weight[s]
        own = [k for k in range(len(rows)) if rows[k][3] == s]
        total = sum(size[k] for k in own)
        rest = {k: target * size[k] % total for k in own}
        ranked = sorted((k for k in own if rest[k]), key=lambda k: (u[k] / (1 - u[k]) * ((total - rest[k]) / rest[k]), rows[k][0] is None, rows[k][0] or 0, rows[k][4] is None, rows[k][4] or 0))
        more = set(ranked[: sum(rest.values()) // total])
        for k in own:
            out += [rows[k]] * (target * size[k] // total + (k in more))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, labels = corpus()
    folder = tmp_path_factory.mktemp("tables")
    # names that stages use for columns of their own
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame(rows, kind)
    df.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, labels


def test_every_stage_and_the_whole_against_the_naive_version(spark, tables):
    import public_tokenizers as P
    import tiktoken

    folder, rows, labels = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = naive_train(*toxicity.sample(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    bad = [r for r in rows if r[1] is not None and (p := naive_probability(model, r[1])) is not None and p >= toxicity.THRESHOLD]
    want = [[r for r in rows if r not in bad]]
    assert len(bad) >= 10
    want += [f(want[-1])] if (f := naive_simhash) else []
    want.append(naive_cut(want[-1]))
    want.append(naive_mixing(want[-1]))
    assert len(want[1]) <= len(want[0]) - 12 and sum(len(r[1] or "") for r in want[2]) < sum(len(r[1] or "") for r in want[1])
    for (name, stage), rows in zip(corpus_pipeline.STAGES, want):
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        assert Counter(map(tuple, docs.collect())) == Counter(rows), name
    with open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = Counter((r[0], None if r[1] is None else tuple(public.encode_ordinary(r[1]))) for r in want[-1])
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, None if r.token_ids is None else tuple(r.token_ids)) for r in got) == tokens
    assert all(r.round_trip for r in got if r.token_ids is not None)


def test_an_empty_table_and_clashing_columns(spark, tables, tmp_path):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    names = "copies __toxicity key i t rest left h node group_id starts found".split()
    wide = docs.selectExpr("*", *(f"'{n}' AS `{n}`" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide = corpus_pipeline.written(stage(spark, wide, folder), name)
        assert wide.columns == [*docs.columns, *names]
    assert {tuple(r) for r in wide.select(*names).distinct().collect()} == {tuple(names)}
