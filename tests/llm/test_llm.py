"""The pipeline operators against brute force, exact round trips and held-out accuracy, and on odd inputs."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from fractions import Fraction
from itertools import islice

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnpath.llm import byte_bpe, components, exact_dedup, hd_language, html_text, license_scan, mixing, pii, simhash, spotsigs, toxicity
from cairnpath.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WS = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    long = " ".join(f"word{i}" for i in range(6000))
    rows = [
        (1, None, None, None, 0), (2, "", "en", "a", 0), (3, "  \t", "en", "a", 3), (4, "a  b", "en", None, 4), (5, "a\tb", "fr", "a", 3), (5, "a\tb", "fr", "a", 3),
        (6, long, "en", "b", 1), (7, long + " ", "en", "b", 1), (8, long + " tail", "en", "b", 1), (9, "é\U0001f642 \x1c 12", "de", "b", 5), (None, "lost row", "en", "c", 8), (None, None, None, None, None),
    ]
    extra = ["keep_id", "name", "fp", "row", "spot", "key", "score", "position", "block"]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in extra})


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def exact_brute(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(WS.sub(" ", t), []).append(i)
    out = []
    for i, t in pairs:
        own = groups[WS.sub(" ", t)]
        keep = min((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(WS.sub(" ", t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1024, 4096])
def test_exact_groups(spark, documents, odd, block):
    for df in (odd,) if block == 1024 else (documents,):
        got = sorted((tuple(r) for r in exact_dedup.exact_groups(df, block).collect()), key=str)
        assert got == exact_brute(texts(df))
    assert exact_dedup.exact_groups(odd.limit(0), block).count() == 0


def test_blocks_that_cross_tasks_have_one_name(spark):
    rows = spark.range(4000).select("id", F.encode(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))), "UTF-8").alias("key"))
    named = exact_dedup.name_keys(rows, "t").join(rows, "id")
    assert named.select("key", "name").distinct().count() == named.select("key").distinct().count() == named.select("name").distinct().count()


def test_one_copy_stays(odd):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(WS.sub(" ", t) for _, t in texts(kept)) == sorted({WS.sub(" ", t) for _, t in texts(odd)})


def test_spot_signatures(spark, documents, odd):
    for df in (documents.limit(80), odd.filter("doc_id <> 5 AND doc_id IS NOT NULL")):
        pairs = sorted(texts(df), reverse=True)
        got = {r.doc_id: r for r in spotsigs.fingerprints(df).collect()}
        assert len(got) == len(pairs)
        for k, (i, t) in enumerate(pairs):
            after = pairs[(k + 1) % len(pairs)][1]
            edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
            own, other, changed = spotsigs.spots(t), spotsigs.spots(after), spotsigs.spots(edited)
            r = got[i]
            assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), spotsigs.as_text(own))
            assert r.edited_fingerprint == spotsigs.as_text(changed)
            same = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
            assert (r.near_edited, r.near_next) == (same(own, changed), same(own, other))
    assert spotsigs.fingerprints(odd).count() == odd.count()
    assert spotsigs.fingerprints(odd.limit(0)).count() == 0


def test_pruned_likeness_is_jaccard_from_the_limit_on():
    rng = random.Random(5)
    for _ in range(300):
        a, b = (sorted(rng.sample(range(40), rng.randint(0, 30))) for _ in "ab")
        exact = len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0
        for least in (0.0, 0.5, 0.8):
            assert spotsigs.likeness(a, b, least) == (exact if exact >= least else 0.0)


def test_similar_sets(spark, documents):
    docs = documents.limit(150)
    found = {(r.a, r.b) for r in spotsigs.similar(docs, 0.5).collect()}
    sets = {spotsigs.as_text(s): s for s in (spotsigs.spots(t) for _, t in texts(docs)) if s}
    assert found == {(a, b) for a in sets for b in sets if a < b and spotsigs.likeness(sets[a], sets[b], 0.5) >= 0.5}


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p><p>no';</script></head><body><header><a href='/'>Home</a></header><nav><ul><li><a>x</a></li></ul></nav>"
    "<div class='cookie-notice'>We use cookies</div>{body}<aside>Related</aside><section id='comments'><p>First!</p></section><form><label>Mail</label><input></form><footer>&copy; 2024</footer></body></html>"
)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), ("   ", ""), ("<p>", ""), ("a < b & c", "a < b & c"),
        (PAGE.replace("{body}", "<article><h1>Title</h1><p>One &amp; <b>two\n  words</b><p>Third&nbsp;line<div class='ad'>Buy</div><p>Last</article>"), "Title\nOne & two words\nThird line\nLast"),
        (PAGE.replace("{body}", "<div><h1>Long enough headline here</h1><p>" + "Prose goes on. " * 20 + "</p><p>The end.</p></div>"), "Long enough headline here\n" + ("Prose goes on. " * 20).strip() + "\nThe end."),
        ("<article><p>open <b>never closed<p>second <!-- gone --> part", "open never closed\nsecond part"),
        ("<article><p title='a > b'>kept</p></article", "kept"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


PROSE = ("Prose. " * 30).strip()
LINKS = [f"Another story to read {k}" for k in range(4)]


@pytest.mark.parametrize(
    ("article", "text"),
    [
        ("<h2><a href='/x'>Linked headline</a></h2><p>" + PROSE + "</p>", ["Linked headline", PROSE]),
        ("<p>" + PROSE + "</p><p><a href='/x'>A paragraph that is a link</a></p>", [PROSE, "A paragraph that is a link"]),
        ("<p>" + PROSE + "</p><ul>" + "".join(f"<li><a href='/'>{t}</a></li>" for t in LINKS) + "</ul><p>Short tail.</p>", [PROSE, *LINKS, "Short tail."]),
        ("<h1>Title</h1><p>" + PROSE + "</p><div class='ad'><p>Buy</p><p>Buy</p><p>Buy</p><p>Buy</p></div><p>End.</p>", ["Title", PROSE, "End."]),
        ("<p>Hi.</p>", ["Hi."]),
        ("<h1>Method</h1><p>" + PROSE + "</p><h2>Discussion</h2><p>It held.</p>", ["Method", PROSE, "Discussion", "It held."]),
    ],
)
def test_nothing_of_an_article_is_lost(html_around, article, text):
    assert html_text.main_text(html_around(f"<article>{article}</article>")) == "\n".join(text)


@pytest.fixture(params=["{}", "<body><header><a href='/'>Home</a></header>{}<footer>&copy; all</footer></body>", "<body><div><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li></ul></div>{}</body>"])
def html_around(request):
    return request.param.format


def test_windows_and_surges_decide_outside_articles():
    links = "".join(f"<p><a href='/{k}'>{t}</a></p>" for k, t in enumerate(LINKS))
    page = f"<div><h1>Title</h1><p>{PROSE}</p>{links}<p>Short tail.</p></div>"
    assert html_text.main_text(page) == f"Title\n{PROSE}"
    assert html_text.main_text(page, window=8) == "\n".join(["Title", PROSE, *LINKS, "Short tail."])
    assert html_text.main_text(page, surge=10) == f"Title\n{PROSE}\nShort tail."
    one = f"<div><h1>Title</h1><p>{PROSE}</p><p><a href='/'>Linked between</a></p><p>{PROSE}</p></div>"
    assert html_text.main_text(one) == "\n".join(["Title", PROSE, "Linked between", PROSE])


@pytest.mark.parametrize(
    "comments",
    [
        "<div class='thread'><h3>Readers say</h3><p>I think so too, at some length and more.</p><p>Not me.</p></div>",
        "<section><h2>12 comments</h2><div><b>Jo</b><p>I think so too, at some length and more.</p></div></section>",
        "<div><div><div>Jo, 3 hours ago</div><p>I think so too, at some length.</p></div><div><div>Al, a day ago</div><p>Not me at all.</p></div></div>",
        "<ol><li><p>Jo says:</p><p>I think so too, at some length and more.</p></li><li><p>Al says:</p><p>No.</p></li></ol>",
    ],
)
@pytest.mark.parametrize("page", ["<article><h1>Title</h1><p>{p}</p>{c}</article>", "<article><h1>Title</h1><p>{p}</p></article>{c}", "<div><div><h1>Title</h1><p>{p}</p></div>{c}</div>"])
def test_comments_by_their_form(page, comments):
    assert html_text.main_text(page.format(p=PROSE, c=comments)) == f"Title\n{PROSE}"


@pytest.mark.parametrize("wrap", ["<div class='content-sidebar-wrap'>{}</div>", "<div class='page has-sidebar'>{}</div>", "<div id='widget'><div class='menu-layout'>{}</div></div>"])
def test_marks_do_not_count_on_wrappers(wrap):
    inner = f"<h1>Headline</h1><p>{'Plain words here. ' * 20}</p><p>More of it.</p>"
    comments = f"<div class='comments'>{'<p>I think so too and say it at length.</p>' * 4}</div>"
    want = "Headline\n" + ("Plain words here. " * 20).strip() + "\nMore of it."
    for core in (f"<main>{inner}</main>", inner):
        assert html_text.main_text("<body>" + wrap.format(f"<div class='sidebar'>Other</div>{core}{comments}") + "</body>") == want
    # Comments that are longer than the article hold no headline.
    assert html_text.main_text(f"<body><article>{inner}</article>{comments * 9}</body>") == want


def test_pages_without_their_article_tags_give_nearly_the_same(spark, data):
    html = [r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    same = sum(html_text.main_text(re.sub("</?article>", "", h)) == html_text.main_text(h) for h in html)
    assert same >= 0.98 * len(html)


@pytest.mark.parametrize("html", ["<b>" * 150_000 + "</i>" * 150_000, "<p><button>" + "<b>" * 100_000 + "<div></div>" * 60_000, "<div class='ad'>" * 60_000, "<p>" * 300_000])
def test_long_pages_take_linear_time(html):
    began = time.perf_counter()
    assert html_text.main_text(html) == ""
    assert time.perf_counter() - began < 12


def test_pages_query(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html_text.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|div)>", article.replace("<br>", " "))]
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (want, len(want))
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 1), (1, "u", "", 1)], "page_id long, url string, html string, text long")
    assert [r.text for r in html_text.extract(odd).collect()] == ["", "", ""]
    assert html_text.extract(odd.limit(0)).count() == 0


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op4_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hit / (got.toxic == 1).sum() > 0.8 and hit / (got.predicted == 1).sum() > 0.9


def test_chosen_features_and_weights_by_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        toxic = int(rng.random() < 0.3)
        words = [f"w{rng.randrange(60)}" for _ in range(12)] + (["scum"] if toxic and rng.random() < 0.7 else []) + (["muslim"] if rng.random() < (0.6 if toxic else 0.2) else [])
        rows.append((i, " ".join(words), toxic))
    training = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    has = [(toxicity.features(toxicity.words(t)), y) for _, t, y in rows]
    n, ones = len(rows), sum(y for *_, y in rows)
    want = set(toxicity.SWAP)
    for f in {f for found, _ in has for f in found}:
        p, both = sum(f in found for found, _ in has), sum(f in found and y for found, y in has)
        width = (p * (n - p) * ones * (n - ones)) ** 0.5
        if p >= 3 and width and abs(both * n - p * ones) / width >= toxicity.EFFECT and (abs(both * n - p * ones) - n / 2) / width * n**0.5 >= toxicity.SIGNIFICANCE:
            want.add(f)
    assert toxicity.choose(training) == sorted(want) and "scum" in want and "muslim" in want
    weights, bias = toxicity.fit(training, sample=n)
    # At the minimum no weight can be moved for the better; sums and scores are those of the formula.
    names = sorted(want)
    at = lambda t, swap: [names.index(f) for f in toxicity.features({toxicity.SWAP.get(w, w) if swap else w for w in toxicity.words(t)}) if f in want]

    def cost(w):
        total = toxicity.RIDGE / 2 * sum(x * x for x in w[:-1]) + 5e-4 * (w[-1] - np.log(ones / (n - ones))) ** 2
        for _, t, y in rows:
            own = sum(w[k] for k in at(t, False)) + w[-1]
            total += np.logaddexp(0, own) - y * own
            if toxicity.words(t) & toxicity.SWAP.keys():
                other = sum(w[k] for k in at(t, True)) + w[-1]
                total += toxicity.COUNTERFACTUAL / 2 * (1 / (1 + np.exp(-own)) - 1 / (1 + np.exp(-other))) ** 2
        return total

    w = np.array([weights.get(f, 0.0) for f in names] + [bias])
    low = cost(w)
    for k in [names.index("scum"), names.index("muslim"), names.index("christian"), len(names)]:
        for move in (-0.02, 0.02):
            assert cost(w + move * np.eye(len(w))[k]) > low
    scored = {r.doc_id: r.score for r in toxicity.score(training, weights, bias).collect()}
    for i, t, _ in rows[:50]:
        assert abs(scored[i] - 1 / (1 + np.exp(-(sum(weights.get(f, 0.0) for f in toxicity.features(toxicity.words(t))) + bias)))) < 1e-9


def test_swapped_groups_have_like_scores(spark):
    rows = [(i, ("muslim people are nice " if i % 2 else "christian people are awful scum ") + "w" * (i % 5 + 1), int(i % 2 == 0)) for i in range(200)]
    training = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights, bias = toxicity.fit(training)
    gap = abs(weights.get("muslim", 0.0) - weights.get("christian", 0.0))
    assert gap < 0.3 and weights["scum"] > 0.5


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity.toxicity(odd.limit(0), labels.limit(0)).count() == 0


def simhash_brute(pairs):
    fps = []
    for _, t in pairs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
        fps.append(sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles)))
    return fps


def joined(fps, ids):
    low = [10**9 if i is None else i for i in ids]
    near = [[b for b in range(len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 2] for a in range(len(fps))]
    while True:
        after = [min(low[b] for b in near[a]) for a in range(len(fps))]
        if after == low:
            return [None if x == 10**9 else x for x in low]
        low = after


def test_near_groups(documents, odd):
    for df in (odd, documents):
        pairs = texts(df)
        fps = simhash_brute(pairs)
        want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(pairs, fps, joined(fps, [i for i, _ in pairs]), strict=True)), key=str)
        assert sorted((tuple(r) for r in simhash.near_groups(df).collect()), key=str) == want
    assert simhash.near_groups(odd.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(8)]
    # Unlike texts without an id and with one id; a copy without an id of a text that has one; copies without any.
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (None, texts[2]), (9, texts[4]), (7, texts[4]), (None, texts[5]), (None, texts[5]), (None, None), (None, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row_key string")
    got = simhash.drop_near_copies(docs)
    assert got.columns == docs.columns
    want = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (7, texts[4]), (None, texts[5]), (None, "")]
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str) == sorted(want, key=str)


def test_columns_of_any_name_stay(spark):
    """The names that the helpers use inside, in either case, with nulls, ties and rows without ids."""
    names = ["near_row_key", "MIX_POSITION", "mix_id", "text_sha", "kept_id", "Kept_Sha", "row", "lang_pred", "score", "stay_id", "cairn_sha", "fp", "name", "edge_spot"]
    rows = [(1, "alpha beta gamma delta", "en", "a"), (2, "alpha  beta gamma delta", "en", "a"), (None, "other words altogether here", None, None), (None, None, "en", "b"), (7, "lorem ipsum dolor", "la", "b"), (7, "quite different words", "en", "b")]
    docs = spark.createDataFrame([(*r, *(f"{r[0]}{n}" for n in names)) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for stage, n in ((exact_dedup.drop_copies, 5), (simhash.drop_near_copies, 5), (mixing.in_mixed_order, 6), (hd_language.keep_identified, None)):
        got = stage(docs)
        found = [tuple(r) for r in got.collect()]
        assert got.columns == docs.columns and set(found) <= {tuple(r) for r in docs.collect()}
        assert n is None or len(found) == n
        assert stage(docs.limit(0)).count() == 0


@pytest.mark.parametrize("crowd", [1, 3, 32])
def test_links_of_crowded_keys_lose_nothing(spark, crowd):
    rng = random.Random(7)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(30)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = components.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), crowd), "t")
    root = {r.node: r.root for r in got.collect()}
    unsigned = [s % (1 << 64) for s in signed]
    brute = joined(unsigned, list(range(len(unsigned))))
    mine = [root.get(s, s) for s in signed]
    assert len({*zip(mine, brute, strict=True)}) == len(set(mine)) == len(set(brute))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 199), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(links, "t").collect()}
    assert got == {**{i: 0 for i in range(61)}, 199: 199, 200: 199}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii_brute(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and total % 10 == 0) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@given(st.text(alphabet="a1.2@-+ (5)%_9é,", max_size=60))
@settings(max_examples=600, deadline=None)
def test_seeds(text):
    assert pii.seeds(text) == pii_brute(text)


def test_personal_data(spark, documents, odd):
    got = {r.doc_id: r for r in pii.personal_data(documents).collect()}
    for i, t in texts(documents):
        spans = pii_brute(t)
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) - {""} <= set(got[i].spans.split(","))
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
    assert pii.personal_data(odd).count() == odd.count() and pii.personal_data(odd.limit(0)).count() == 0


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"{'so ' * (i % 3)}please call me +1 555 0100 {i:02d}{i:02d} today") for i in range(9)] + [(50, "please call me 0043-5550-777 now"), (51, "the year 20240101 was good")]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == "phone:15:28" and got[51] == ""


def test_recall_of_planted_identifiers(spark):
    """Seeds of every kind in contexts of their own; unseen identifiers in the same contexts, in shapes that no seed has."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    contexts = {"email": "please write to ", "phone": "you can call ", "ip": "the host at ", "secret": "my password="}
    known = {
        "email": lambda: f"{word()}.{word()}@{word()}.org", "phone": lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", "ip": lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4)),
        "secret": lambda: "%040x" % (rng.getrandbits(156) | 0xA << 156),
    }
    unseen = {
        "email": lambda: f"{word()} [at] {word()}.org", "phone": lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", "ip": lambda: f"fe80::{rng.randint(1, 9999):x}:{rng.randint(1, 9999):x}", "secret": lambda: word() + word(),
    }
    rows, want = [], {}
    for kind, context in contexts.items():
        for k in range(60):
            value = (unseen if k % 6 == 0 else known)[kind]()
            text = f"{prose(rng.randint(2, 30))} {context}"
            if k % 6 == 0:
                want[len(rows)] = f"{kind}:{len(text)}:{len(text) + len(value)}"
            rows.append((len(rows), f"{text}{value} {prose(5)}"))
    clean = range(len(rows), len(rows) + 200)
    # Ordinary words, numbers and digests, some of them behind the words of a pattern.
    rows += [(i, f"{prose(10)} {rng.choice(['in', 'call', 'write to the'])} {rng.choice([word(), str(rng.randint(1, 99999)), '12:30', 'commit ' + '%040x' % rng.getrandbits(160)])} {prose(10)}") for i in clean]
    got = {r.doc_id: set(r.spans.split(",")) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(span in got[i] for i, span in want.items())
    assert caught >= 0.9 * len(want), [(rows[i][1], span, got[i]) for i, span in want.items() if span not in got[i]]
    assert all(got[i] == {""} for i in clean)


def test_scores_by_brute_force(spark):
    rng = random.Random(3)
    kinds = {}
    edges = []
    for _ in range(400):
        text = f"t{rng.randrange(80)}"
        kinds.setdefault(text, rng.choice(["phone", "phone", "phone", "secret", None]))
        edges.append((rng.choice(["p1", "p2", "p3", "p4 =", "=<hex>"]) if kinds[text] != "secret" else rng.choice(["p5", "=<hex>", "p4 ="]), text, kinds[text], ["phone", "secret"]))
    edges += [("p6", f"t{k}", "phone", ["phone"]) for k in range(100, 120)] + [("p6", "u", None, ["phone"]), ("p7", "u", None, ["phone"]), *(("p7", f"t{k}", "phone", ["phone"]) for k in range(100, 103)), ("p6", "v", None, ["secret"])]
    held = {f"h{k}" for k in range(200)}
    unseeded = held | {f"t{k}" for k in range(0, 80, 3)}
    edges += [(rng.choice(["p1", "p5", "p6", "p9"]), t, None, ["phone", "secret"]) for t in sorted(held)]
    graph = {}
    for p, t, k, fits in edges:
        graph[p, t] = (k, fits)
    score = {}
    while True:
        conf = {}
        for p in {p for p, _ in graph}:
            texts = [t for q, t in graph if q == p and t not in held]
            seeds = [graph[p, t][0] for t in texts if graph[p, t][0]]
            for kind in ("phone", "secret"):
                judged = [t for t in texts if graph[p, t][0] or kind != "secret" or t not in unseeded]
                support = seeds.count(kind) + sum(score.get((t, kind), 0) for t in judged if not graph[p, t][0])
                others = len(seeds) - seeds.count(kind)
                unknown = max(0, len(judged) - support - others) * (pii.UNKNOWN if p.startswith("=<") else 1)
                if support >= pii.SUPPORT and support / (support + others + pii.PRIOR + unknown) >= pii.CONFIDENCE:
                    conf[p, kind] = support / (support + others + pii.PRIOR + unknown)
        after = {}
        for (p, t), (k, fits) in graph.items():
            for kind in fits if k is None else ():
                if (p, kind) in conf:
                    after[t, kind] = 1 - (1 - after.get((t, kind), 0)) * (1 - conf[p, kind])
        after = {k: round(v, 3) for k, v in after.items()}
        if after == score:
            break
        score = after
    got = {(r.text, r.kind): r.score for r in pii.discover(spark.createDataFrame([(*e, e[1] in held, e[1] not in unseeded) for e in edges], "pattern string, text string, kind string, fits array<string>, held boolean, seeded boolean")).collect()}
    assert any(t in held for t, _ in got) and not all(("p9", t) in graph and (t, "phone") in got for t in held)
    assert ("u", "phone") in got and ("v", "phone") not in got
    best = {t: max((s, k) for (x, k), s in score.items() if x == t) for t, _ in score}
    assert set(got) == {(t, k) for t, (_, k) in best.items()}
    assert all(abs(got[t, k] - s) < 0.002 for t, (s, k) in best.items())


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 0.05), ("sf0.1", 0.25)])
def test_patterns_discover_secrets_that_are_no_seeds(spark, sf, least):
    """A fourth of the texts have their secrets held back; patterns find nearly all of these, and nothing that has not a secret's label."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = pii.personal_data(docs).agg(F.sum("n_found").alias("found"), F.sum("n_secret").alias("secrets")).first()
    assert got.found >= least * got.secrets > 0


@pytest.mark.parametrize("text", ["a" * 10**6, "1 " * 10**5, "a=b " * 10**4, "a@" * 10**5, "(" * 10**6, "+" * 10**5 + "[at]", "12:" * 10**5, "a: " * 10**4])
def test_long_texts_take_linear_time(text):
    began = time.perf_counter()
    pii.strings(text, pii.seeds(text) + pii.secret_seeds(text))
    assert time.perf_counter() - began < 10


def test_languages(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_language_id"](spark, sf)
    right = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_language_vectors():
    space = hd_language.Space(64, 3)
    grams, counts = hd_language.trigrams("Ab a")
    want = np.zeros(64)
    for g, n in zip(grams.tolist(), counts.tolist(), strict=True):
        a, b, c = g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF
        want += n * np.roll(space.letter(a), 2) * np.roll(space.letter(b), 1) * space.letter(c)
    assert counts.sum() == 4 and np.allclose(space.bundle([(grams, counts)])[0], want)


def test_predictions_by_brute_force(spark):
    """Profiles, cosines and the choice, computed without Spark from the definition."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    space = hd_language.Space()
    vector = lambda t: space.bundle([hd_language.trigrams(t or "")])[0].astype(np.float64)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    sums = {}
    for r in rows:
        if r.lang is not None and r.text is not None and not held(r.doc_id):
            sums[r.lang] = sums.get(r.lang, 0) + vector(r.text)
    got = {r.doc_id: r for r in hd_language.languages(docs).collect()}
    for r in rows:
        v = vector(r.text)
        cosine = {lang: v @ s / np.linalg.norm(v) / np.linalg.norm(s) if v.any() else 0.0 for lang, s in sums.items()}
        best = max(sorted(cosine), key=cosine.get) if v.any() else "und"
        assert (got[r.doc_id].held_out, got[r.doc_id].lang_pred) == (held(r.doc_id), best)
        assert abs(got[r.doc_id].score - max(0.0, cosine.get(best, 0.0))) < 1e-3


def test_a_text_like_no_language_goes(spark, documents):
    rng = random.Random(6)
    noise = [(10**6 + k, "".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(200)), "en", "x", 200) for k in range(3)]
    kept = hd_language.keep_identified(documents.union(spark.createDataFrame(noise, SCHEMA)))
    assert kept.filter("doc_id >= 1000000").count() == 0 and kept.count() >= 0.99 * documents.count()
    german = hd_language.keep_identified(documents, wanted={"de"})
    assert 0 < german.count() < kept.count() and german.filter("lang = 'de'").count() >= 0.95 * german.count()


def test_a_long_text_of_rare_letters_takes_bounded_memory():
    rng = random.Random(1)
    text = "".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(60_000))
    counted = [hd_language.trigrams(text)] * 64
    tracemalloc.start()
    rows = hd_language.Space().bundle(counted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows.shape == (64, 1024) and peak < 300e6


def test_more_languages_than_there_are(spark, monkeypatch):
    monkeypatch.setattr(hd_language, "MOST_LANGUAGES", 2)
    docs = spark.createDataFrame([(k, "some words here", f"l{k}") for k in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(Exception, match="distinct values of lang"):
        hd_language.prototypes(docs)


def test_languages_of_odd_rows(odd):
    got = hd_language.languages(odd).collect()
    assert len(got) == odd.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert hd_language.languages(odd.limit(0)).count() == 0
    kept = hd_language.keep_identified(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {4, 5, 6, 7, 8}
    assert {r.lang_pred for r in hd_language.languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_license_scan(spark, documents, odd):
    def brute(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text))
        starts, labels = [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            for k in range(len(words)):
                if words[k : k + len(p)] == p:
                    starts.append(k)
                    labels.add(label)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))

    planted = spark.createDataFrame([(900, "All Rights Reserved. all rights reserved, CC-BY x; the GNU General Public License, version 3"), (901, "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.")], "doc_id long, text string")
    for df in (documents, odd, planted):
        for r, (_, t) in zip(license_scan.scan(df).collect(), texts(df), strict=True):
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert [r.labels for r in license_scan.scan(planted).orderBy("doc_id").collect()] == ["cc-by,gpl,gpl-3.0,reserved", "apache-2.0,mit"]
    assert license_scan.scan(odd.limit(0)).count() == 0


def test_whole_licences_with_changed_wording(spark):
    wording = {label: text for label, text, _ in license_scan.TEMPLATES if len(text.split()) > 50}
    mit, bsd = wording["mit"], wording["bsd"]
    changed = {
        1: ("mit", "Copyright (c) 2024 Some One\n\n" + mit.replace("the authors or copyright holders", "Some One and all who helped them")),
        2: ("mit", mit.replace("and to permit persons to whom the software is furnished to do so subject to the following conditions", "")),
        3: ("", "permission is hereby granted free of charge to whoever comes. sublicense and or sell copies of the software was what they said"),
        4: ("", mit.replace("sublicense and or sell copies of the software", "")),
        5: ("bsd,isc", f"{bsd}\n{'and so on ' * 400}\n{wording['isc']}"),
        6: ("", " ".join(random.Random(1).sample(mit.split(), len(mit.split())))),
        7: ("", "the mit license"), 8: ("mit", "This was RELEASED under the MIT licence; released under the MIT License."),
    }
    docs = spark.createDataFrame([(k, t) for k, (_, t) in changed.items()], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(docs).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in changed.items()}
    assert 0.75 <= got[2][1] < 1 and got[3][1] == 0


def test_places_by_brute_force():
    """A template is laid wherever enough of its rare words agree; every start that brute force would accept is proposed."""
    index = license_scan.Index({"": 100, **{w.decode(): 50 for w in license_scan._vocabulary()}})
    rng = random.Random(2)
    for template in index.templates:
        found = [f"x{rng.randrange(50)}".encode() for _ in range(300)] + template.words + [f"x{rng.randrange(50)}".encode() for _ in range(100)]
        scores = [template.laid(found, k) for k in range(len(found))]
        places = {w: [i for i, x in enumerate(found) if x == w] for w in set(found)}
        assert max(scores) == 1.0 and any(template.laid(found, k) == 1.0 for k in template.starts(places))


@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 40), min_size=1))
@settings(max_examples=150, deadline=None)
def test_every_prefix_of_a_cycle_is_near_its_weights(share):
    slots = mixing.cycle_slots(share)
    length = sum(share.values())
    order = sorted((x[2], s) for s, found in slots.items() for x in found)
    assert [k for k, _ in order] == list(range(length))
    had = dict.fromkeys(share, 0)
    for k, s in order:
        had[s] += 1
        assert all(abs(had[x] - (k + 1) * a / length) < 1 for x, a in share.items())
    assert all(r <= t < e for found in slots.values() for r, e, t in found)


@given(st.lists(st.one_of(st.integers(1, 40), st.sampled_from([Fraction(1, 3), 0.00001, 7.3, 1e-3])), min_size=1, max_size=9), st.integers(1, 300))
@settings(max_examples=150, deadline=None)
def test_every_prefix_is_near_its_exact_weights_across_spans(weights, least):
    whole = list(mixing.whole_weights(dict(enumerate(weights))).values())
    total = sum(whole)
    span = max(least, total // min(whole) + 3)
    if span > 3000:
        span = None
    found = [x for k in range(5 if span else 1) for x in islice(mixing.span_slots(whole, k * (span or 0), span), 3000)]
    had = [0] * len(whole)
    for k, (slot, i, j, release, deadline) in enumerate(found):
        assert (slot, j) == (k, had[i]) and release <= slot < deadline
        had[i] += 1
        assert all(abs(n * total - (k + 1) * w) < total for n, w in zip(had, whole, strict=True))


def test_mix_keeps_exact_weights_over_many_slots(spark):
    # Thirds as 333 and 667 of a cycle of 1000 are a block off after 3,000 slots.
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    slots = {r.slot: r.source for r in mixing.mix(docs, {"a": Fraction(1, 3), "b": Fraction(2, 3)}, block_docs=1).collect()}
    had = 0
    for k in range(9000):
        had += slots[k] == "a"
        assert abs(3 * had - (k + 1)) < 3


def test_mix_of_many_sources(spark):
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 300).alias("source"))
    got = mixing.mix(docs, block_docs=2).collect()
    assert len(got) == len({r.position for r in got}) == 1200
    assert sorted({r.slot for r in got}) == list(range(600)) and all(r.release <= r.slot < r.deadline for r in got)


def test_mix_gives_each_row_one_place(spark, documents, odd):
    for df, weights in ((documents, None), (odd, None), (odd, {"a": 3.0, "zz": 1.0}), (documents, {"src0": 5.0, "src1": 1.0})):
        got = mixing.mix(df, weights, block_docs=2).collect()
        assert len(got) == df.count() == len({r.position for r in got})
        assert all(r.release <= r.slot < r.deadline for r in got)
        slots = {}
        for r in got:
            assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
        assert sorted(slots) == list(range(len(slots)))
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.in_mixed_order(odd).columns == odd.columns and mixing.in_mixed_order(odd).count() == odd.count()


@pytest.fixture(scope="session")
def codecs():
    tokens = byte_bpe.read_ranks(RANKS)
    return byte_bpe.Codec(tokens, public_tokenizers.PATTERN), tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


PIECES = st.lists(st.one_of(st.sampled_from(["the", " ", "  ", "\n", "'s", "é", "12", "aaaa", "<|endoftext|>", "\x1c", " ", "½"]), st.text(max_size=4)), max_size=14).map("".join)


def test_bpe_is_tiktoken(codecs):
    own, library = codecs

    @given(PIECES, st.booleans())
    @settings(max_examples=800, deadline=None)
    def check(text, prepared):
        if prepared:
            own.prepare([text, text[::-1]])
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text) and own.decode(ids) == text.encode()

    check()
    long = "x" * 30000 + "é" * 5000
    assert own.encode(long) == library.encode_ordinary(long)


def test_prefixes_appends_and_edits(codecs):
    own, library = codecs
    last = [-1]
    own.extend(b"internation", last)
    own.extend(b"internationalisation", last)
    whole = [-1]
    own.extend(b"internationalisation", whole)
    assert last == whole
    data, table = bytes(random.Random(9).choices(b"abcdeinrst", k=20_000)), [-1]
    own.extend(data, table)
    rng = random.Random(12)
    for _ in range(60):
        at = rng.randint(0, len(data))
        cut, new = rng.randint(0, min(40, len(data) - at)), bytes(rng.choices(b"abcdeinrst", k=rng.randint(0, 40)))
        data, table, fresh = own.refill(data, table, at, cut, new)
        whole = [-1]
        own.extend(data, whole)
        assert table == whole and fresh <= len(new) + 40 * own.longest
    rng = random.Random(2)
    draft, text = byte_bpe.Draft(own, "A first draft of it."), "A first draft of it."
    for _ in range(400):
        at = rng.randint(0, len(text))
        cut, new = rng.randint(0, min(5, len(text) - at)), "".join(rng.choice("ab \n'sté2") for _ in range(rng.randint(0, 5)))
        draft.replace(at, cut, new)
        text = text[:at] + new + text[at + cut :]
        assert draft.text() == text and draft.encoding() == library.encode_ordinary(text)
    draft.append(" and more")
    assert draft.encoding() == library.encode_ordinary(text + " and more")


def test_round_trip(documents, odd, codecs):
    for df in (documents, odd):
        for r, (i, t) in zip(byte_bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect(), texts(df), strict=True):
            ids = codecs[1].encode_ordinary(t)
            assert (r.doc_id, r.n_tokens) == (i, len(ids))
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert byte_bpe.encode(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_pipeline(spark, data, codecs):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, data)
        assert after.columns == docs.columns, name
        before = after
    pairs = texts(hd_language.keep_identified(docs))
    kept = [(i, t) for (i, t), row in zip(sorted(pairs), exact_brute(sorted(pairs, key=lambda p: p[0])), strict=False)]
    first = {}
    for i, t in sorted(kept):
        first.setdefault(WS.sub(" ", t), (i, t))
    kept = list(first.values())
    stay = [p for p, c in zip(kept, joined(simhash_brute(kept), [i for i, _ in kept]), strict=True) if p[0] == c]
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, data).collect()}
    assert got == {i: (len(codecs[1].encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in stay}
