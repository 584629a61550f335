"""The conversations' trie against one of plain dictionaries, also with buckets of a few turns and on odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cairnpath.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            said.setdefault(c, []).append(((turn is not None, turn or 0, role.encode(), tie), (role, text)))
    said = {c: [t for _, t in sorted(x)] for c, x in said.items()}
    out = {}
    for c, own in said.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = said.get(base, [])[:h] + own[h:]
    return out


def brute(rows):
    below, ends = {}, {}
    for c, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            below.setdefault(tuple(turns[:d]), set()).add(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids, leaves, saved = dict.fromkeys(below, 0), dict.fromkeys(below, 0), dict.fromkeys(below, 0)
    for p in below:
        if p:
            kids[p[:-1]] += 1
    for p, own in below.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted(((min(b), len(p), min(below[p[:-1]]) if p else None, len(b), kids[p], leaves[p], saved[p], sha(p)) for p, b in below.items()), key=str)


def found(df, *bucket):
    return sorted((tuple(r) for r in prefix_trie.prefix_nodes(df, *bucket).collect()), key=str)


@pytest.mark.parametrize("bucket", [prefix_trie.BUCKET, 20])
def test_conversations(spark, data, bucket):
    talks = spark.read.parquet(f"{data}/conversations.parquet")
    assert found(talks, bucket) == brute([tuple(r) for r in talks.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("bucket", [prefix_trie.BUCKET, 8])
def test_odd_conversations(spark, bucket, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 16)
    monkeypatch.setattr(prefix_trie, "PACK", 8)
    draw, rows = random.Random(5), []
    for c in range(-12, 260):
        first = draw.choice(["hot", "hot", f"own {c}", None])
        rows += [(c, t, draw.choice(["user", None, ""]), first if t == 0 else draw.choice(["a", "b", "é", ""])) for t in range(draw.randrange(0, 7))]
    rows += [(c, t, "user", "same") for c in range(300, 420) for t in range(3)]
    rows += [(500, t % 50, "user", f"long {t}") for t in range(120)] + [(505, None, None, None)] * 3 + [(None, 1, "user", "lost")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("rep", "pos", "p1", "depth", "bytes", "n")})
    assert found(df, bucket) == brute(rows)
    assert found(df.limit(0), bucket) == []


def test_turnless(spark):
    rows = [(c, 0, "user", "x") for c in range(1, 40) if c % 5 and zlib.crc32(str(c).encode()) % 9]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
