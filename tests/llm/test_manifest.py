"""The Merkle manifest against trees built in plain Python, also on odd rows."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from cairnpath.llm import merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return digest("".join(map(shown, (row[0], row[3], row[2], row[4], text))))


def tree(nodes):
    """The last hash, and for each node what stands left and right of it on its way there."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, o in enumerate(at):
            run, j = nodes[o // 3 * 3 : o // 3 * 3 + 3], o % 3
            paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            at[i] = o // 3
        nodes = [digest("".join(nodes[g : g + 3])) for g in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    by_source, out = {}, []
    for r in rows:
        by_source.setdefault(r[3], []).append((r, leaf(r, r[1])))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by_source[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    subs = [tree([x[1] for x in by_source[s]]) for s in order]
    root, tops = tree([x[0] for x in subs]) if order else (None, [])
    for s, (subroot, paths), top in zip(order, subs, tops, strict=True):
        for (r, own), path in zip(by_source[s], paths, strict=True):
            node = own
            if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0 and r[1] is not None:
                node = leaf(r, r[1].replace("\n", ""))
            for a, b in path + top:
                node = digest(a + node + b)
            out.append((r[0], own, subroot, root, digest("".join(a + b for a, b in path + top)), node, node == root, s))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in merkle_manifest.manifest(df).collect()), key=str)


def test_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = found(docs)
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    assert {r[6] for r in got} == {True, False}


def test_odd_rows(spark):
    draw = random.Random(3)
    rows = [(i * 70_001 - 900_000, f"t{i}\n", "en", draw.choice([None, "", "a", "é", "z\n"]), i) for i in range(300)]
    rows += [(7, f"tie {i % 20}\n", None, "hot", None) for i in range(400)] + [(None, None, None, None, None)] * 3
    rows += [(None, "x\ny" * 5000, "en", "hot", 3), (2**63 - 1, "", "en", "one", 0), (-(2**63), "\n", "en", "two", 1), (0, "\n", "en", "two", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("leaf", "rank", "node", "tree", "group", "path")})
    assert found(df) == brute(rows)
    assert found(df.limit(0)) == []


def test_sizes_of_a_tree(spark):
    rows = [(i, "t\n", None, f"s{n}", 2) for n in (1, 2, 3, 4, 9, 10, 243, 244) for i in range(n)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert found(spark.createDataFrame(rows[:1], SCHEMA)) == brute(rows[:1])


def test_plan_has_no_python_and_no_product(spark, data):
    plan = merkle_manifest.manifest(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
