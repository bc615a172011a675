from collections import Counter

from treeline.llm import mixing


def rows_of(df):
    return [(r.doc_id, r.source, r.copies) for r in df.collect()]


def test_targets_are_met_exactly(docs):
    rows = [(i, "x" * (i % 50), f"s{i % 3}") for i in range(900)] + [(1000 + i, "y" * 9, "rare") for i in range(5)]
    total = Counter()
    for _, source, copies in rows_of(mixing.mix(docs(rows), {"s0": 5, "s1": 3, "s2": 1}, total=1000)):
        total[source] += copies
    assert sum(total.values()) == 1000
    assert {k: abs(total[k] - v) <= 1 for k, v in {"s0": 500, "s1": 300, "s2": 100, "rare": 100}.items()} == dict.fromkeys(total, True)


def test_a_rare_source_gets_certain_whole_copies(docs):
    rows = [(i, "x" * 9, "big") for i in range(95)] + [(100 + i, "x" * 9, "rare") for i in range(5)]
    copies = Counter({d: c for d, s, c in rows_of(mixing.mix(docs(rows))) if s == "rare"})
    assert sorted(copies.values()) == [10] * 5


def test_inclusion_is_in_proportion_to_the_odds(docs):
    """Over many seeds a document that expects p copies has p on average."""
    rows = [(i, "x" * (400 if i < 5 else 0), "a") for i in range(20)] + [(50 + i, "", "b") for i in range(20)]
    got = Counter()
    for seed in range(60):
        for d, s, c in rows_of(mixing.mix(docs(rows), {"a": 1, "b": 3}, total=20, seed=f"t{seed}")):
            if s == "a":
                got[d] += c
    # target 5 for a: weights 21 for five documents, 1 for fifteen
    assert abs(sum(got[d] for d in range(5)) / 300 - 5 * 21 / 120) < 0.12
    assert sum(got.values()) == 300


def test_order_and_partitions_change_nothing(docs):
    rows = [(i, "x" * (i % 9), f"s{i % 4}") for i in range(200)]
    assert sorted(rows_of(mixing.mix(docs(rows)))) == sorted(rows_of(mixing.mix(docs(rows[::-1]).repartition(7))))


def test_nulls_repeats_and_empty_tables(docs):
    rows = [(1, "a", None), (1, "a", None), (None, None, "s"), (2, "", "s"), (3, "x" * 100_000, "s")]
    out = mixing.mix(docs(rows, "w all target copies"), {})
    assert sum(r.copies for r in out.collect()) == 5 and out.columns.count("copies") == 1
    df = docs(rows, "copies copy n")
    assert mixing.stage(None, df, "").columns == df.columns and {r.copies for r in mixing.stage(None, df, "").collect()} == {"x"}
    assert mixing.mix(docs([])).count() == 0
    assert mixing.mix(docs(rows), {"s": 0}, default_weight=0).count() == 0


def test_stage_repeats_rows(spark, docs):
    df = docs([(i, "x", "big") for i in range(9)] + [(99, "x", "rare")])
    out = mixing.stage(spark, df, "")
    assert out.columns == df.columns
    assert Counter(r.source for r in out.collect()) == {"big": 5, "rare": 5}
