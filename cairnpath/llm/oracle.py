"""SQL of the checking engine for operators whose rows take more than a few lines of it."""

from __future__ import annotations

#: CRC-32 of an ASCII text, bit by bit.
CRC32 = (
    "xor(4294967295, list_reduce("
    "list_prepend(4294967295, list_transform(range(length({0})), lambda i: ascii(substring({0}, i + 1, 1))::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"
)

PREFIX_NODES = f"""
    WITH own AS (
      SELECT conv_id, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, strlen(coalesce(text, '')) AS bytes,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), said) AS i
      FROM conversations WHERE conv_id IS NOT NULL),
    plan AS (
      SELECT c.conv_id, c.conv_id - c.conv_id % 5 AS base, {CRC32.format("c.conv_id::VARCHAR")} % 9 AS h, n
      FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id) c),
    led AS (SELECT p.*, least(p.h, coalesce(b.n, 0)) AS lead FROM plan p LEFT JOIN plan b ON b.conv_id = p.base),
    turns AS (
      SELECT l.conv_id, o.i AS pos, said, bytes FROM led l JOIN own o ON o.conv_id = l.base AND o.i <= l.lead
      UNION ALL
      SELECT l.conv_id, l.lead + o.i - l.h, said, bytes FROM led l JOIN own o ON o.conv_id = l.conv_id AND o.i > l.h),
    prefixes AS (
      SELECT conv_id, pos AS depth, bytes, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM turns
      UNION ALL SELECT conv_id, 0, 0, '' FROM plan),
    ends AS (
      SELECT prefix, string_agg(conv_id, ',' ORDER BY conv_id) AS ids
      FROM (SELECT conv_id, max_by(prefix, depth) AS prefix FROM prefixes GROUP BY conv_id) GROUP BY prefix),
    nodes AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM prefixes GROUP BY depth, prefix),
    kids AS (SELECT left(prefix, -64) AS above, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
    sums AS (
      SELECT n.prefix, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.bytes)::BIGINT AS saved_tokens
      FROM nodes n JOIN nodes b ON starts_with(b.prefix, n.prefix) LEFT JOIN kids k ON k.above = b.prefix GROUP BY n.prefix)
    SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved_tokens,
           sha256(coalesce(e.ids, '')) AS ends_sha256
    FROM nodes n JOIN sums s USING (prefix) LEFT JOIN kids k ON k.above = n.prefix LEFT JOIN ends e ON e.prefix = n.prefix
    LEFT JOIN nodes u ON u.prefix = left(n.prefix, -64) AND u.depth = n.depth - 1"""


def manifest(levels: int = 13, top: int = 8) -> str:
    """For up to 3**levels rows of a source and 3**top sources; a tree that is done earlier stays as it is."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda t: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", t))) + ")"
    steps = [
        f"""rows0 AS (
        SELECT doc_id, source, {leaf("text")} AS leaf, {leaf("replace(text, chr(10), '')")} AS other,
               {CRC32.format("coalesce(doc_id::VARCHAR, '')")} % 2 = 0 AS drawn
        FROM documents)""",
        """rows1 AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
               count(*) OVER (PARTITION BY source) AS n
        FROM rows0)""",
        "a0 AS (SELECT source AS tree, place AS idx, leaf AS node, n FROM rows1)",
    ]

    def climb(name: str, n: int) -> None:
        for k in range(n):
            steps.append(f"""{name}{k + 1} AS (
        SELECT tree, idx // 3 AS idx, CASE WHEN n = 1 THEN min(node) ELSE sha256(string_agg(node, '' ORDER BY idx)) END AS node,
               (n + 2) // 3 AS n
        FROM {name}{k} GROUP BY tree, idx // 3, n)""")

    climb("a", levels)
    steps.append(f"""b0 AS (
        SELECT 'all' AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS idx, node, count(*) OVER () AS n, tree AS source
        FROM a{levels})""")
    climb("b", top)
    steps.append("""p0 AS (
        SELECT r.doc_id, r.leaf, r.source, r.place AS a_idx, b0.idx AS b_idx, b0.node AS subroot, '' AS proof,
               CASE WHEN drawn THEN other ELSE leaf END AS fold
        FROM rows1 r JOIN b0 ON r.source IS NOT DISTINCT FROM b0.source)""")
    last = 0
    for name, tree, n in (("a", "p.source", levels), ("b", "'all'", top)):
        own = f"p.{name}_idx"
        left = f"coalesce(string_agg(s.node, '' ORDER BY s.idx) FILTER (s.idx < {own}), '')"
        right = f"coalesce(string_agg(s.node, '' ORDER BY s.idx) FILTER (s.idx > {own}), '')"
        places = ", ".join(f"p.{x}_idx // 3 AS {x}_idx" if x == name else f"p.{x}_idx" for x in "ab")
        for k in range(n):
            steps.append(f"""p{last + 1} AS (
        SELECT p.doc_id, p.leaf, p.source, {places}, p.subroot, p.proof || {left} || {right} AS proof,
               CASE WHEN s.n = 1 THEN p.fold ELSE sha256({left} || p.fold || {right}) END AS fold
        FROM (SELECT *, row_number() OVER () AS one FROM p{last}) p
        JOIN {name}{k} s ON s.tree IS NOT DISTINCT FROM {tree} AND s.idx // 3 = {own} // 3
        GROUP BY p.one, p.doc_id, p.leaf, p.source, p.a_idx, p.b_idx, p.subroot, p.proof, p.fold, s.n)""")
            last += 1
    return (
        "WITH " + ",\n     ".join(steps) + f"""
        SELECT p.doc_id, p.leaf, p.subroot, t.node AS root, sha256(p.proof) AS proof_sha256, p.fold AS folded_root,
               p.fold = t.node AS verified, p.source
        FROM p{last} p, b{top} t"""
    )
