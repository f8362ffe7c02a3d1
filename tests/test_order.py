"""Global order as a column."""

import random

from tallypanel.operators.order import ranked


def test_rank_by_weight(spark):
    """Sums of the weights before, over groups that span parts."""
    rng = random.Random(4)
    rows = [(rng.choice("aab"), i, rng.randint(0, 9)) for i in range(400)] + [(None, 1000, 5), (None, 1001, 2)]
    df = spark.createDataFrame(rows, "g string, i long, w long").repartition(5)
    got = {r["i"]: r["before"] for r in ranked(df, ["i"], within=["g"], out="before", weight="w").collect()}
    want, sums = {}, {}
    for g, i, w in sorted(rows, key=lambda r: r[1]):
        want[i] = sums.get(g, 0)
        sums[g] = want[i] + w
    assert got == want
    empty = ranked(df.where("false"), ["i"], within=["g"], weight="w")
    assert empty.count() == 0
