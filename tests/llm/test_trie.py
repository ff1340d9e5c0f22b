"""The prefix trie against prefixes listed one by one."""

import hashlib
import random
import re
import zlib

import pytest

from verso.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, top string, skip int, base string"


def conversations(spark, rows):
    """Turns with extra columns whose names the operator uses inside."""
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def plain_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        base = None if c is None else abs(c) // 20 * 20 * (1 if c > 0 else -1)
        out[c] = own.get(base, [])[:h] + ts[h:] if c is not None else ts
    return out


def plain_nodes(rows):
    convs = plain_rebuilt(rows)
    nodes = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    key = lambda c: (c is None, c or 0)
    kids, leaves, saved = {}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, members in nodes.items():
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    for p in nodes:
        if p not in kids:
            for d in range(len(p) + 1):
                leaves[p[:d]] += 1
    out = []
    for p, members in nodes.items():
        ends = ",".join("null" if c is None else str(c) for c in sorted((c for c in members if len(convs[c]) == len(p)), key=key))
        out.append((min(members, key=key), len(p), min(nodes[p[:-1]], key=key) if p else None, len(members), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def hot_rows():
    """A third of all conversations are equal, another third share their first turns; one is long; some are short."""
    rng = random.Random(5)
    rows = []
    for c in range(150):
        same = [("user", "hello there"), ("assistant", "good day to you"), ("user", "bye")]
        shared = [("system", "you help"), ("user", "a b c"), ("assistant", f"d {c % 4}"), *[("user", rng.choice("xyz"))] * rng.randint(0, 3)]
        free = [(rng.choice(("user", None)), rng.choice(("", None, "one two", "q  r\ts"))) for _ in range(rng.randint(1, 5))]
        rows += [(c * (3 if c % 2 else 1), t, role, text) for t, (role, text) in enumerate((same, shared, free)[c % 3])]
    rows += [(900 + c, t, "user", f"long {t}") for c in range(3) for t in range(120 - c)]
    return rows


ODD = [
    (0, 1, "user", "a b"), (0, 2, "assistant", None), (0, 2, "assistant", None), (0, None, None, "first"), (0, 2, "x", "tie"),
    (7, 1, "user", "a b"), (7, 0, "user", ""), (-3, 0, "user", "neg"), (-40, 0, "user", "neg"), (2**60 + 1, 0, "user", "a b"), (2**60 + 2, 0, "user", "a b"),
    (None, 1, "user", "no id"), (None, 0, "user", "first"), (5, 0, "user", "one only"), (13, 0, "us", "era b"), (33, 0, "user", "word " * 3000),
]


@pytest.mark.parametrize("rows,most", [(ODD, 1 << 13), (ODD, 1), (hot_rows(), 1 << 13), (hot_rows(), 40)])
def test_nodes_against_plain_prefixes(spark, rows, most):
    assert got(trie.prefix_trie(trie.rebuilt(conversations(spark, rows).repartition(6)), most)) == plain_nodes(rows)


def test_ids_are_hashed_in_order(spark):
    ids = [*range(-5000, 9000, 3), 2**61, None]
    rows = spark.createDataFrame([("s", i) for i in ids] + [("t", 4)], "seq string, conv_id long").repartition(7)
    want = ",".join("null" if i is None else str(i) for i in ids)
    assert dict(map(tuple, trie.digests_of_ids(rows).collect())) == {"s": hashlib.sha256(want.encode()).hexdigest(), "t": hashlib.sha256(b"4").hexdigest()}


def test_no_conversations(spark):
    assert got(trie.prefix_trie(trie.rebuilt(conversations(spark, [])))) == []


def test_conversations_without_turns(spark):
    """An id whose few turns are all replaced by those of an absent conversation leaves a conversation without turns."""
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 1)
    rows = [(c, 0, "user", "replaced")]
    assert got(trie.prefix_trie(trie.rebuilt(conversations(spark, rows)))) == plain_nodes(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
