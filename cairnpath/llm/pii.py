"""Personal data by bootstrapped contextual extraction.

Regular expressions find the seeds. What stands before a seed, or before another string that could be an identifier, is a
lexical pattern: the two words before it, the label that a colon or an equals sign joins to it, and that sign with the
kind of letters that follow. Patterns and strings form a graph. Patterns are scored by how many of their strings are known, strings by the patterns that they follow, in
turns, as aggregates over the whole corpus, until no score changes any more. Strings that patterns of high confidence
discover are added; the seeds stay as they are.

Besides the four base kinds there are secrets (keys, tokens, passwords), whose seeds are known by their shape, and digests,
which look like secrets, compete with them for patterns and are never reported. Secrets are seeds in three texts of four,
drawn by a hash of the text; in the others their shape says nothing, so that it takes a pattern to discover them and
it shows how many it finds. Those that no pattern finds are reported by their shape in the end.

A string could be an identifier if it has a digit, an at sign, an underscore or a dot or colon inside, is a group of
numbers over several words or a spelt-out address, or follows a label, whatever it is then. Confidence is the share of the
known among these; words of plain prose are neither claimed nor counted. Spelling alone says nothing of a string that no
seed speaks against, so behind a sign the unknown ones count for UNKNOWN each.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnpath.llm.common import durable, forget, spread, whole

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Words of a pattern; known strings that it needs, and their share of all its strings and one more.
CONTEXT, SUPPORT, CONFIDENCE, PRIOR, UNKNOWN = 2, 3, 0.8, 1, 0.1
#: Of so many texts one has no secrets as seeds.
HELD = 4
#: Longer patterns and strings are told apart by their hashes.
LONG = 200

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Possessive: what stands after a run of digits decides, so a run is never entered in its middle.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SPACES = re.compile(r"[\x20\x09-\x0D]")
_EDGE = ".,;:!?()[]{}<>\"'|*%#&$=/\\"
#: Published shapes of access keys, and hexadecimal strings of 128 bits and more.
_SECRET = re.compile(r"(?<![0-9A-Za-z_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,}+)(?![0-9A-Za-z_])")
#: Words before a hexadecimal string that make it a digest.
DIGESTS = frozenset("checksum commit crc digest etag guid hash md5 rev revision sha sha1 sha256 sha512 uuid".split())
_CODED = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@_=:.]*+[0-9@_=:.][^\x20\x09-\x0D]*+")
_NUMBERS = re.compile(r"(?<![^\x20\x09-\x0D\"'\[<{=])\(?[0-9]++(?:[\x20().\-/]{1,3}[0-9]++)+(?![A-Za-z])")
_SPELT = re.compile(r"(?i)(?<![^\x20\x09-\x0D])[\w.+-]++\x20?[\[({]\x20?at\x20?[\])}]\x20?[\w-]++(?:\x20?(?:\.|[\[({]\x20?dot\x20?[\])}])\x20?[\w-]++)*")
_LABEL = re.compile(r"[=:]")
_ADDRESS = re.compile(r"[0-9A-Fa-f]*(?::[0-9A-Fa-f]*){2,}")
_SPELLING = [("hex", re.compile(r"(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{16,}+")), ("upper", re.compile(r"(?=[0-9]*+[A-Z])(?=[A-Z]*+[0-9])[0-9A-Z]{16,}+")), ("mixed", re.compile(r"(?=[^0-9]*+[0-9])(?=[^A-Z]*+[A-Z])(?=[^a-z]*+[a-z])[0-9A-Za-z_+/-]{16,}+"))]
_NEXT = re.compile(r"[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    before, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > before and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        before = m.end() if m else at + 1
        at = text.find("@", before)


def seeds(text: str) -> list[tuple[str, int, int]]:
    """kind, start and end of the base matches, by kind and start."""
    out = [("email", *span) for span in _emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _words_before(text: str, start: int) -> list[str]:
    """The last words before a position, as they stand; more than a pattern has, or all there are."""
    width = 64
    while True:
        found = text[max(0, start - width) : start].split()
        if start <= width or len([w for w in found[1:] if w.strip(_EDGE)]) >= CONTEXT:
            return found
        width *= 4


def _short(s: str) -> str:
    return s if len(s) <= LONG else "sha256 " + hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def patterns(text: str, start: int, end: int) -> list[str]:
    """What stands before a string, digits masked: the label that belongs to it, how it is spelt behind that, and the words of its context."""
    before = _words_before(text, start)
    lead = " ".join(before).rstrip("\"'([{< ")
    clean = [w for w in (re.sub("[0-9]", "0", t.strip(_EDGE).lower()) for t in before) if w]
    out = []
    if clean and lead.endswith(("=", ":")) and re.search("[^\\W\\d_]", clean[-1]):
        out.append(_short(re.split("[=:]", clean[-1])[-1] + "="))
        out += [f"=<{name}>" for name, spelling in _SPELLING if spelling.fullmatch(text, start, end)][:1]
    if len(clean) >= CONTEXT:
        out.append(_short(" ".join(clean[-CONTEXT:])))
    return out


def secret_seeds(text: str) -> list[tuple[str, int, int]]:
    """secret or digest, start and end of the strings whose shape is that of a key."""
    out = []
    for m in _SECRET.finditer(text) if _DIGIT.search(text) else ():
        before = [w for w in re.split(r"[^0-9a-z]+", " ".join(_words_before(text, m.start())[-2:]).lower()) if w]
        out.append(("digest" if before and before[-1] in DIGESTS else "secret", *m.span()))
    return out


def fits(value: str, spelt: bool) -> list[str]:
    """The kinds that a string could be of by its shape."""
    digits = sum("0" <= c <= "9" for c in value)
    plain = not value.strip("0123456789 ().-/+")
    out = []
    if spelt or "@" in value:
        out.append("email")
    if not value.strip("0123456789abcdefABCDEF.:") and (value.count(".") == 3 or value.count(":") >= 2):
        out.append("ip")
    if plain and 12 <= digits <= 19:
        out.append("card")
    if plain and 6 <= digits <= 15:
        out.append("phone")
    if len(value) >= 4 and not _SPACES.search(value):
        out += ["secret", "digest"]
    return out


def strings(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str | None, list[str], str, list[str], int, int]]:
    """Seeds (with kind) and other strings that could be identifiers: kind, patterns, text, the kinds that it fits, place."""
    known = sorted(spans, key=lambda s: s[1])
    out: list[tuple] = [(kind, patterns(text, a, b), _short(text[a:b].lower()), [kind], a, b) for kind, a, b in known]
    found: list[tuple[int, int, bool]] = []
    if "[" in text or "(" in text or "{" in text:
        found += [(*m.span(), True) for m in _SPELT.finditer(text)]
    if _DIGIT.search(text):
        found += [(*m.span(), False) for m in _NUMBERS.finditer(text) if sum("0" <= c <= "9" for c in m[0]) >= 7]
    for m in _CODED.finditer(text):
        a, b = m.span()
        inner = text[a:b].rstrip(_EDGE)
        sign = None if _ADDRESS.fullmatch(inner.strip(_EDGE)) else _LABEL.search(inner)
        if sign and re.search(r"[^\W\d_]", inner[: sign.start()]) and not inner.startswith("//", sign.end()) and inner[sign.end() :].strip(_EDGE):
            found.append((a + sign.end(), b, False))  # the value of a label in the same word
        elif text[b - 1] in "=:" and (after := _NEXT.match(text, b)):
            found.append((*after.span(1), False))  # the word after a label
        elif re.search("[0-9@_.:]", inner.strip(_EDGE)):
            found.append((a, b, False))
    taken, end = known + [("", len(text) + 1, len(text) + 1)], 0
    k = 0
    for a, b, spelt in sorted(found, key=lambda f: (f[0], -f[1])):
        if not spelt and not text[a:b].startswith("("):
            whole_, a = text[a:b], a + len(text[a:b]) - len(text[a:b].lstrip(_EDGE))
            b = a + len(whole_.strip(_EDGE))
        while taken[k][2] <= a:
            k += 1
        if a < end or b <= a or taken[k][1] < b:
            continue
        end = b
        if p := patterns(text, a, b):
            out.append((None, p, _short(text[a:b].lower()), fits(text[a:b], spelt), a, b))
    return out


_FOUND = "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base string, strings array<struct<kind:string,patterns:array<string>,text:string,fits:array<string>,start:long,end:long,held:boolean,seeded:boolean>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = pa.list_(pa.string())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("patterns", names), ("text", pa.string()), ("fits", names), ("start", pa.int64()), ("end", pa.int64()), ("held", pa.bool_()), ("seeded", pa.bool_())]))
    keys = ("kind", "patterns", "text", "fits", "start", "end")
    for batch in batches:
        counts, base, found = {k: [] for k in BASE_KINDS}, [], []
        for text in batch.column(2):
            text = text.as_py()
            spans = seeds(text)
            for k in BASE_KINDS:
                counts[k].append(sum(s[0] == k for s in spans))
            base.append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
            seeded = zlib.crc32(text.encode("utf-8", "surrogatepass")) % HELD != 0
            own = [dict(zip(keys, s, strict=True), held=False, seeded=seeded) for s in strings(text, spans + secret_seeds(text))]
            found.append([x | {"kind": None, "held": True} if not seeded and x["kind"] == "secret" else x for x in own])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(base, pa.string()), pa.array(found, kind)], names=["doc_id", "row", *(f"n_{k}" for k in BASE_KINDS), "base", "strings"])


def discover(edges: DataFrame) -> DataFrame:
    """Edges (pattern, text, kind or null, fits, held, seeded) -> text, kind and score of the strings that good patterns find.

    A pattern's confidence for a kind is the sum of its distinct strings' scores over that sum, its seeds of other kinds,
    PRIOR and its unknown strings; a string's score for a kind that it fits is the chance that not all patterns it follows
    are wrong about it. Seeds have score 1 for their own kind. Scores only grow from round to round, and rounds end once they
    stay the same to three places. A string that several kinds claim goes to the highest score, then to the last kind by
    name but digest; digests are left out. Strings that are held back count neither for nor against a
    pattern, and for secrets it is judged by the texts alone that have them as seeds.
    """
    graph = durable(edges.groupBy("pattern", "text").agg(F.max("kind").alias("kind"), F.first("fits").alias("fits"), F.max("held").alias("held"), F.max("seeded").alias("seeded")), "graph")
    sizes = graph.filter("kind IS NOT NULL OR NOT held").groupBy("pattern").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.expr("kind IS NOT NULL OR seeded")).alias("size_in"), F.count("kind").alias("seeds"))
    known = graph.filter("kind IS NOT NULL").select("pattern", "text", "kind", F.lit(1.0).alias("score"), F.lit(1).alias("seed"))
    fresh = graph.filter("kind IS NULL").select("pattern", "text", "fits", "held", "seeded")
    scores, mark, claims = known, None, None
    while True:
        support = scores.groupBy("pattern", "kind").agg(F.sum("score").alias("support"), F.sum("seed").alias("own")).filter(F.col("support") >= SUPPORT).join(sizes, "pattern")
        others = F.col("seeds") - F.col("own")
        unknown = F.greatest(F.lit(0.0), F.when(F.col("kind") == "secret", F.col("size_in")).otherwise(F.col("size")) - F.col("support") - others) * F.when(F.startswith("pattern", F.lit("=<")), UNKNOWN).otherwise(1.0)
        good = support.withColumn("confidence", F.col("support") / (F.col("support") + others + PRIOR + unknown)).filter(F.col("confidence") >= CONFIDENCE).select("pattern", "kind", "confidence")
        met = fresh.join(spread(good), "pattern").filter(F.array_contains("fits", F.col("kind")))
        score = 1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        old, claims = claims, durable(met.groupBy("text", "kind").agg(F.round(score, 3).alias("score")), "claims")
        if old is not None:
            forget(old)
        now = tuple(claims.agg(F.count(F.lit(1)), F.round(F.sum("score"), 3)).first())
        if now == mark or not now[0]:
            break
        mark = now
        scores = known.unionByName(fresh.filter("NOT held").join(claims, "text").filter("seeded OR kind <> 'secret'").select("pattern", "text", "kind", "score", F.lit(0).alias("seed")))
    forget(graph)
    best = claims.groupBy("text").agg(F.max_by(F.struct("kind", "score"), F.struct("score", F.col("kind") != "digest", "kind")).alias("best"))
    return best.select("text", "best.kind", "best.score").filter("kind <> 'digest'")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans, n_secret, n_found, n_spans.

    spans holds the base spans, the secrets and what was discovered, as kind:start:end in code points, by kind and start;
    n_found counts what patterns discovered. Null and empty texts have none. Repeated rows are repeated; an empty table
    gives no rows; further columns are ignored.
    """
    numbered = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), whole("text").alias("text"))
    rows = durable(numbered.mapInArrow(_find, _FOUND), "strings")
    places = rows.select("row", F.inline("strings"))
    found = discover(places.select(F.explode("patterns").alias("pattern"), "text", "kind", "fits", "held", "seeded"))
    secrets = places.filter("kind = 'secret'").select("row", "start", "end", "kind", F.lit(0).alias("found"))
    unseen = places.filter("kind IS NULL").drop("kind").join(found, "text", "left").filter("held OR kind IS NOT NULL")
    spans = secrets.unionByName(unseen.select("row", "start", "end", F.coalesce("kind", F.lit("secret")).alias("kind"), F.col("kind").isNotNull().cast("int").alias("found")))
    order = F.element_at(F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i)))), F.col("kind"))
    more = spans.groupBy("row").agg(F.collect_list(F.struct(order.alias("n"), "start", "end", "kind")).alias("more"), F.count_if(F.col("kind") == "secret").alias("n_secret"), F.sum("found").alias("n_found"))  # of one text
    base = F.expr("transform(filter(split(base, ','), s -> s <> ''), s -> named_struct('n', array_position(array('email', 'ip', 'card', 'phone'), split(s, ':')[0]) - 1, 'start', cast(split(s, ':')[1] as long), 'end', cast(split(s, ':')[2] as long), 'kind', split(s, ':')[0]))")
    both = F.expr("array_join(transform(array_sort(concat(base_spans, transform(more, m -> named_struct('n', cast(m.n as long), 'start', m.start, 'end', m.end, 'kind', m.kind)))), s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
    joined = rows.drop("strings").join(more, "row", "left").withColumn("base_spans", base)
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        "doc_id", *(f"n_{k}" for k in BASE_KINDS), F.sha2("base", 256).alias("base_sha256"), F.when(F.col("more").isNull(), F.col("base")).otherwise(both).alias("spans"),
        none("n_secret"), none("n_found"), (F.size("base_spans") + F.coalesce(F.size("more"), F.lit(0))).cast("long").alias("n_spans"),
    )
