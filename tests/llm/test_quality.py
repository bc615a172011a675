from treeline.llm import quality


def run(df, **k):
    return {r.doc_id: r for r in quality.line_rules(df, most_docs=2, most_share=0.1, **k).collect()}


def test_lines_over_the_limits_go_and_depleted_documents_too(docs):
    rows = [(i, f"own line number {chr(97 + i)}{chr(97 + i)} which is long enough to stay\nShare  this 12!\n") for i in range(6)] + [(9, "share this 7!\nshare this 8!\nx")]
    got = run(docs(rows, "key h at line"))
    assert set(got) == set(range(6))
    assert got[0].text == "own line number aa which is long enough to stay\n" and (got[0].n_lines, got[0].n_removed) == (2, 1)


def test_hosts_are_apart(docs):
    rows = [(i, "same line\nand own " + "abcdef"[i] * 30, "a" if i < 2 else "b") for i in range(5)]
    got = run(docs(rows))
    assert got[0].n_removed == 0 and got[4].n_removed == 1


def test_repeats_count_once(docs):
    rows = [(1, "line\nline\nline\nand more of it")] * 5 + [(2, "line\nother words of it")]
    got = quality.line_rules(docs(rows), most_docs=2, most_share=0.1)
    assert got.count() == 6 and got.where("n_removed > 0").count() == 0


def test_nulls_empty_and_long(docs):
    rows = [(1, None), (2, ""), (None, "a\nb"), (3, "\n\n"), (4, "long\n" * 50_000), (5, "x", None)]
    got = run(docs(rows))
    assert set(got) == {1, 2, None, 3, 4, 5} and got[1].text is None and got[4].n_lines == 50_000 and got[3].n_lines == 0
    assert quality.line_rules(docs([])).count() == 0
