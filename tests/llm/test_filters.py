"""The filter audit against a brute-force walk through every order."""

import re
from fractions import Fraction
from itertools import permutations

import pytest

from chartweave.llm import filters

SCHEMA = "doc_id long, text string, source string, part string, mask int, n long, good string"
GOOD = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, GOOD, "s0"), (2, GOOD, "s1"), (2, GOOD, "s1"), (3, GOOD, None), (None, GOOD, "s0"), (None, GOOD, None),
    (4, None, "s0"), (5, "", "s0"), (6, " \t\n\x0b ", "s0"), (7, "a # b", None), (8, "a # b", ""), (9, "ABC DEF", "s1"),
    (10, "same " * 80, "s1"), (11, "Café 你好 " * 30, "s2"), (12, "x" * 300_000, "s2"), (13, (GOOD + " &\n") * 3, "s2"),
    (-5, "same " * 80, "s2"), (14, GOOD.upper(), "s0"), (1, "another text of one id", "s0"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, None, 1), (10, 1, None), (10, 0, 1), (13, 1, 0), (None, 1, 1), (99, 1, 1)]


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None,
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        docs.append((source or "", {k for k, v in bad.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                shares[x] += len(gone)
                out[part, "".join(order), k] = [
                    len(left), len(gone), sum(x in d[1] for d in own) - len(gone), sum(d[1] == {x} for d in own),
                    sum(d[2] for d in gone), sum(d[3] for d in gone),
                ]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shares[order[k - 1]])
    return out


def found(df):
    rows = df.collect()
    out = {tuple(r)[:3]: list(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_audit_equals_brute_force(spark, labels):
    docs = spark.createDataFrame([(*r, "p", 1, 2, "g") for r in ROWS], SCHEMA).repartition(4)
    assert found(filters.filter_audit(docs, labels)) == brute(ROWS, LABELS)


def test_audit_without_labels_or_rows(spark, labels):
    docs = spark.createDataFrame([(*r, "p", 1, 2, "g") for r in ROWS[:6]], SCHEMA)
    assert found(filters.filter_audit(docs, labels.limit(0))) == brute(ROWS[:6], [])
    assert found(filters.filter_audit(docs.limit(0), labels)) == {}


def test_audit_of_a_large_group_of_copies(spark, labels):
    rows = [(i, GOOD, "hot") for i in range(400)] + [(500, "other text", "s")]
    docs = spark.createDataFrame([(*r, "p", 1, 2, "g") for r in rows], SCHEMA).repartition(7)
    assert found(filters.filter_audit(docs, labels)) == brute(rows, LABELS)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_least_squares_gives_shapley_shares(n):
    v = [Fraction((s * 37 + s * s * 11) % 101) if s else Fraction(0) for s in range(1 << n)]
    want = [Fraction(0)] * n
    orders = list(permutations(range(n)))
    for order in orders:
        s = 0
        for i in order:
            want[i] += (v[s | 1 << i] - v[s]) / len(orders)
            s |= 1 << i
    assert [sum(w * x for w, x in zip(row, v)) for row in filters.shapley_weights(n)] == want
