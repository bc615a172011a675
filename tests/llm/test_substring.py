import random
import re

from treeline.llm import substring


def brute(rows):
    """All passages of LENGTH words compared; the order is doc_id (nulls last), then as given."""
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]
        marked, sources = set(), {}
        for i in range(len(words) - substring.LENGTH + 1):
            passage = tuple(words[i : i + substring.LENGTH])
            if passage in seen:
                marked |= set(range(i, i + substring.LENGTH))
                sources[i] = seen[passage]
            else:
                seen[passage] = doc
        spans, at = [], sorted(marked)
        for k, w in enumerate(at):
            if k == 0 or w != at[k - 1] + 1:
                spans.append([w, w + 1])
            else:
                spans[-1][1] = w + 1
        # repeats that only touch are one span
        for s, e in spans:
            out.setdefault(doc, []).append((s, e, sorted({src for i, src in sources.items() if s <= i < e}, key=str)))
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.start_word, r.end_word, sorted(r.source_doc_ids, key=str)))
    return {k: sorted(v) for k, v in out.items()}


def corpus(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [[draw.choice(words) for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    rows = []
    for doc in range(40):
        text = []
        for _ in range(draw.randrange(4)):
            text += [draw.choice(words) for _ in range(draw.randrange(60))]
            if draw.random() < 0.7:
                text += draw.choice(shared)
        rows.append((doc, " ".join(text)))
    return rows


def test_equals_brute_force(docs):
    for seed in (1, 2):
        rows = corpus(seed)
        assert found(substring.spans(docs(rows))) == brute(rows)


def test_every_alignment_of_a_passage_is_found(docs):
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(k, " ".join(f"d{k}x{i}" for i in range(k)) + " " + passage) for k in range(64)]
    got = found(substring.spans(docs(rows)))
    assert got == {k: [(k, k + 50, [0])] for k in range(1, 64)}


def test_repeats_within_a_text_and_one_word_texts(docs):
    rows = [(1, "la " * 300), (2, "x"), (3, "la " * 49)]
    assert found(substring.spans(docs(rows))) == {1: [(1, 300, [1])]}


def test_partitions_small_flushes_and_hot_windows_change_nothing(docs, monkeypatch):
    """What a task settles by itself, what it leaves to others and what is split, against brute force."""
    rows = corpus(3) + [(None, corpus(3)[5][1]), (100, "x " * 900)]
    want = brute(rows)
    for parts, flush, hot in ((1, 1 << 20, 20_000), (7, 1 << 20, 2), (3, 64, 3), (1, 64, 20_000)):
        monkeypatch.setattr(substring, "FLUSH", flush)
        monkeypatch.setattr(substring, "HOT", hot)
        assert found(substring.spans(docs(rows).repartition(parts))) == want


def test_a_very_long_text(docs):
    long = " ".join(f"n{i}" for i in range(300_000))
    tail = " ".join(f"n{i}" for i in range(299_900, 300_000))
    assert found(substring.spans(docs([(1, long), (2, "begin " + tail)]))) == {2: [(1, 101, [1])]}


def test_texts_are_shuffled_once(spark, docs):
    """The two joins with texts read one exchange, however large their other sides are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = substring.without_repeats(docs(corpus(4)))
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange" in plan


def test_nulls_repeats_and_empty_tables(docs):
    text = " ".join(f"t{i}" for i in range(70))
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, " \n ")]
    assert found(substring.spans(docs(rows, "key h m i"))) == {None: [(0, 70, [1])]}
    assert substring.spans(docs([])).count() == 0


def test_cut_keeps_the_first_and_drops_what_is_left_empty(docs):
    text = " ".join(f"t{i}" for i in range(70))
    rows = [(1, text), (2, f"before\n{text}  after"), (3, text), (4, None), (5, "é short"), (6, "")]
    df = docs(rows, "places hashes i t rest left")
    out = substring.without_repeats(df)
    assert out.columns == df.columns
    by = {r.doc_id: r for r in out.collect()}
    assert set(by) == {1, 2, 4, 5, 6}
    assert by[1].text == text and by[2].text == "before\nafter" and by[2].n_chars == 12 and by[5].text == "é short"
    assert substring.without_repeats(docs([])).count() == 0
