import random

from evigraph.llm import topk


def brute(rows, queries, k):
    bits = {}
    for i, v in rows:
        if i is not None and v is not None:
            bits[i] = [1 if x is not None and x == x and x > 0 else 0 for x in v]
    width = max(map(len, bits.values()), default=0)
    code = {i: tuple(b + [0] * (width - len(b))) for i, b in bits.items()}
    out = set()
    for q in {i for i, v in queries if i in code}:
        near = sorted((sum(a != b for a, b in zip(code[q], c)), i) for i, c in code.items() if i != q)[:k]
        out |= {(q, r + 1, i, d) for r, (d, i) in enumerate(near)}
    return out


def result(spark, rows, queries, k=5):
    schema = "vec_id long, embedding array<float>"
    return {tuple(r) for r in topk.top_k(spark.createDataFrame(rows, schema), spark.createDataFrame(queries, schema), k).collect()}


def test_random_and_clustered_codes(spark):
    rnd = random.Random(5)
    centres = [[rnd.choice([-1.0, 1.0]) for _ in range(40)] for _ in range(4)]
    rows = [(i, [x if rnd.random() > 0.1 else -x for x in rnd.choice(centres)]) for i in range(300)]
    rows += [(1000 + i, [1.0] * 40) for i in range(40)]  # one code many times
    queries = rows[::30] + rows[-1:]
    assert result(spark, rows, queries) == brute(rows, queries, 5)


def test_odd_vectors(spark):
    rows = [(1, [1.0, None]), (2, [1.0]), (3, None), (None, [1.0, 1.0]), (4, [float("nan"), -1.0]), (5, []), (5, []), (6, [1.0, 1.0])]
    assert result(spark, rows, rows, 2) == brute(rows, rows, 2)
    assert result(spark, rows[:1], rows[:1], 3) == set()
    assert result(spark, [], []) == set()
