"""`edits` above 2 is honoured."""

import random

from quadrille.llm import line_dedup


def test_more_edits_share_keys_and_link(spark):
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("abcde ") for _ in range(rng.randint(20, 90)))
        b = list(a)
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(len(b))
            b[at : at + 1] = rng.choice([[], ["x"], [b[at], "y"]])
        b = "".join(b)
        t = line_dedup.threshold(min(len(a), len(b)), 5)
        assert t == (5 if min(len(a), len(b)) >= 20 else 1)
        if a == b or not line_dedup.edit_distance_within(a, b, t):
            continue
        key, who, probes = line_dedup.join_keys([a, b], 5)
        mine = lambda i, p: {k for k, w, q in zip(key, who, probes) if w == i and q == p}
        assert mine(0, False) & mine(1, True) or mine(1, False) & mine(0, True)
        assert line_dedup.links_of([a, b], 5)
    rows = [(1, "the quick brown fox jumps over the lazy dog today"), (2, "the quick brown cat jumps over the lazy dog today")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for edits, gone in ((2, 0), (3, 1)):
        assert line_dedup.line_report(df, edits).agg({"n_removed": "sum"}).first()[0] == gone
