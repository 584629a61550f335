"""The Jaccard join against all pairs of sets, with scarce spares and crowded keys, and on odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnpath.llm import jaccard_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    holders, root = {}, list(range(len(rows)))
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    seen = set()
    for i, s in enumerate(sets):
        counts = {}
        if s in seen:
            for j in range(i):
                if sets[j] == s:
                    root[top(i)] = top(j)
                    break
            continue
        if s:
            seen.add(s)
        for x in s:
            for j in holders[x]:
                if j < i:
                    counts[j] = counts.get(j, 0) + 1
        for j, both in counts.items():
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                root[top(i)] = top(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[top(i)] = min(doc, low.get(top(i), doc))
    return sorted(((doc, len(s), low.get(top(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(df):
    return sorted((tuple(r) for r in jaccard_join.jaccard_groups(df).collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = found(docs)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len({r[2] for r in got}) < len(got)


def crowds():
    """Groups of near copies, a passage in a third of all rows that makes up between a tenth and most of a text, chains of edits."""
    draw, rows = random.Random(11), []
    word = lambda: "w%d" % draw.randrange(4000)
    passage, base = [word() for _ in range(90)], [word() for _ in range(300)]
    for _ in range(160):
        rows.append(passage + [word() for _ in range(draw.choice([4, 9, 12, 14, 20, 60, 400]))])
    for _ in range(120):
        copy = list(base)
        for _ in range(draw.randrange(0, 9)):
            copy[draw.randrange(300)] = word()
        rows.append(copy)
    chain = [word() for _ in range(60)]
    for _ in range(40):
        chain = list(chain)
        chain[draw.randrange(60)] = word()
        rows.append(chain)
    for n in (1, 2, 3, 4, 5, 8, 9, 10, 11, 12, 13, 20, 40):
        own = [word() for _ in range(n)]
        for _ in range(14):
            rows.append(own + [word() for _ in range(draw.choice([0, 1, 1, 2]))])
    return [(i, " ".join(r)) for i, r in enumerate(draw.sample(rows, len(rows)))]


@pytest.mark.parametrize("crowd", [jaccard_join.CROWD, 2])
def test_crowds(spark, crowd, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CROWD", crowd)
    monkeypatch.setattr(jaccard_join, "HELD", 3000)
    rows = crowds()
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_odd_texts(spark):
    long = " ".join(f"word{i}" for i in range(9000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (5, "one  TWO"), (6, long), (7, long + " tail"), (8, "É a b c"), (9, "é a b c"), (None, "one two"), (None, "lost"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("sid", "n", "set_no", "key", "unit", "low", "a", "b")})
    assert found(df) == brute(rows)
    assert found(df.limit(0)) == []


def test_one_key_at_least_of_sets_that_are_alike():
    """Any two sets at the limit share a key of the smaller one's band at the smaller one of their seeds."""
    draw = np.random.default_rng(2)
    for n in [6, 7, 9, 12, 13, 20, 33, 60, 90, 131, 400, 3000]:
        for _ in range(60):
            more = int(draw.integers(0, n * 100 // 85 - n + 1))
            both = -(-85 * (2 * n + more) // 185)
            tokens = np.unique(draw.integers(0, 2**63, 3 * n + 50).astype(np.uint64))
            draw.shuffle(tokens)
            a, b = np.sort(tokens[:n]), np.sort(np.concatenate((tokens[:both], tokens[n : 2 * n + more - both])))
            if 100 * both < 85 * (2 * n + more - both) or both > n:
                continue
            band = set(jaccard_join.bands(len(a))) & set(jaccard_join.bands(len(b)))
            band = max(band)
            keys = [[k for _, made in jaccard_join.keys(x, band) for k in made.tolist()] for x in (a, b)]
            assert a.tolist() == b.tolist() or set(keys[0]) & set(keys[1]), (n, len(b))
