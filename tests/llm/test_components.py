"""Connected components against union by hand."""

import random

from paperloom.llm.components import components


def roots(links):
    root = {n: n for link in links for n in link if None not in link and link[0] != link[1]}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        if a in root and b in root and a != b:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {n: top(n) for n in root}


def test_components(spark):
    draw = random.Random(3)
    chain = list(range(100, 160))
    draw.shuffle(chain)
    cases = [
        [],
        [(1, 1), (None, 2), (3, None)],
        [(5, 9), (9, 5), (5, 9), (7, 9)],
        [(0, n) for n in range(1, 300)],
        [(300, n) for n in range(300)],
        list(zip(chain, chain[1:], strict=False)) + [(-5, -9), (-9, -7)],
        [(draw.randrange(200), draw.randrange(200)) for _ in range(130)],
    ]
    for links in cases:
        found = components(spark.createDataFrame(links, "a long, b long")).collect()
        assert len(found) == len({r["node"] for r in found}) and {r["node"]: r["root"] for r in found} == roots(links)
