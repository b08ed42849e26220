"""The prefix trie against a brute-force trie of tuples."""

import hashlib
import re
import zlib

import pytest

from chartweave.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string, at long, n long, c string, said string"


def brute(rows, group=20, heads=4):
    own = {}
    for i, turn, role, text in rows:
        if i is not None:
            own.setdefault(i, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {i: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for i, v in own.items()}
    whole = {}
    for i, v in own.items():
        h = zlib.crc32(str(i).encode()) % heads
        whole[i] = tuple(own.get(i - (i % group if i >= 0 else -(-i % group)), [])[:h] + v[h:])
    members = {}
    for i, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(i)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in below)]
        words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        ends = sorted(i for i in m if whole[i] == node)
        out.append((
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids), len(leaves),
            sum((len(members[x]) - 1) * words(x) for x in below),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: r[:2])


def rows():
    out = []
    for i in range(90):
        turns = [("user", f"hello {i % 3}"), ("assistant", f"a b  c{i % 5}"), ("user", "x"), ("user", f"q {i % 2} r")]
        out += [(i * 7 % 120, t, *turns[t]) for t in range(i % 5 if i % 5 < 4 else 4)]
    out += [(500, t, "user", "the same turn") for t in range(40)] + [(501, t, "user", "the same turn") for t in range(37)]
    out += [(-3, 0, None, None), (-3, None, "user", "first"), (-45, 5, "user", ""), (-45, -5, None, "é 你好")]
    out += [(None, 0, "user", "nobody"), (621, 0, "user", "alone"), (622, 0, "user", "alone"), (623, 1, "user", "alone")]
    out += [(700, 0, "user", "long " * 50_000), (720, 0, "user", "long " * 50_000), (720, 1, "user", "\t\n \x0b")]
    return out


def table(spark, data):
    return spark.createDataFrame([(*r, 1, 2, "c", "s") for r in data], SCHEMA).repartition(5)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def test_trie_equals_brute_force(spark):
    assert found(prefixes.prefix_trie(table(spark, rows()))) == brute(rows())


@pytest.mark.parametrize("segment, round_paths, batch", [(1, 1, 2), (3, 4, 3), (7, 16, 10_000)])
def test_bands_and_rounds_change_nothing(spark, segment, round_paths, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        said, convs = prefixes.rebuilt(prefixes.turns(table(spark, rows()[:-40] + rows()[-6:])))
        got = found(prefixes.trie(said, convs, segment, round_paths))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows()[:-40] + rows()[-6:])


def test_copies_ties_and_nothing(spark):
    hot = [(i, t, "user", f"turn {t}") for i in range(3000) for t in range(2)]
    convs = table(spark, hot).groupBy("conv_id").count().toDF("conv_id", "n_turns")
    got = found(prefixes.trie(prefixes.turns(table(spark, hot)), convs))
    saved = 2999 * 2
    assert [r[:7] for r in got] == [
        (0, 0, None, 3000, 1, 1, 2 * saved), (0, 1, 0, 3000, 1, 1, 2 * saved), (0, 2, 0, 3000, 0, 1, saved),
    ]
    assert got[2][7] == hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()
    twice = [(20, 0, "user", "a"), (20, 0, "user", "a"), (20, 0, None, "b")]
    one, two = (found(prefixes.prefix_trie(table(spark, x))) for x in (twice, twice[::-1]))
    assert one == two and len(one) == 4
    assert prefixes.prefix_trie(table(spark, hot).limit(0)).count() == 0
