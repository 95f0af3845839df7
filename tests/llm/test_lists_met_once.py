"""Entries of the Jaccard join's lists go through one exchange by key."""

from test_operators import small, sorted_rows

from taskloom.llm import jaccard_join


def test_lists_are_shuffled_once(spark, monkeypatch):
    plans, stored = [], jaccard_join.stored

    def noted(df, tag, **options):
        if tag == "jaccard-lists":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, tag, **options)

    monkeypatch.setattr(jaccard_join, "stored", noted)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:i] + ["x"] * (i > 3) + words[i:]), None, None) for i in range(12)]
    got = sorted_rows(jaccard_join.jaccard_components(small(spark, rows)))
    assert {r[2] for r in got} == {0} and len(got) == 12
    # the first turn's: made from the sets alone
    assert plans[0].count("Exchange hashpartitioning(key") == 1 and "Aggregate" not in plans[0] and "Join" not in plans[0]
