import random

from tickloom.llm import _common as c


def test_components_by_one_task_and_by_steps(spark):
    rng = random.Random(6)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = {x: find(x) for x in list(parent)}
    df = spark.createDataFrame(links, "a long, b long")
    for k, few in enumerate((1000, 0)):
        assert {r.id: r.component for r in c.components(spark, df, c.Stage(spark), f"t{k}", few).collect()} == want
    assert c.components(spark, df.limit(0), c.Stage(spark), "none").count() == 0
