"""Numbers of rows, within groups and over a table."""

from codestrata.operators.numbering import number_in_order, number_within


def test_number_within(spark):
    """A hot group and null groups; numbers are 0 to n - 1, whatever the size of a bucket."""
    rows = [("hot" if i % 3 else None if i % 2 else f"g{i % 5}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i long")
    for size in (7, 10_000):
        got = number_within(df, ["g"], ["i"], "n", size).collect()
        assert sorted(r.i for r in got) == list(range(2000))
        groups: dict = {}
        for r in got:
            groups.setdefault(r.g, []).append(r.n)
        assert all(sorted(ns) == list(range(len(ns))) for ns in groups.values())
    assert number_within(df.limit(0), ["g"], ["i"]).count() == 0


def test_number_in_order(spark):
    df = spark.range(0, 3000, 1, 7).selectExpr("(id * 7919) % 3000 as k", "id")
    got = number_in_order(df, ["k"], "n").collect()
    assert all(r.n == r.k + 1 for r in got) and len(got) == 3000
    assert number_in_order(df.limit(0), ["k"]).count() == 0
