"""Text rules as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters with accents and what they fold to.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def folded(c: Column) -> Column:
    """Lower case without accents, for names that match however they are spelt."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def has_all_words(c: Column, words: list[str]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.contains(folded(c), F.lit(w))
    return out


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def elevation_m(c: Column) -> Column:
    """Metres, to a tenth, of texts such as "1629", "1629.5 m" or "5344 ft"; null if out of range or anything else.

    A comma may part thousands or decimals, so a text with one says nothing.
    """
    shape = r"(?i)^(-?[0-9]+(?:\.[0-9]+)?)\s*(m|meters?|metres?|ft|feet|')?$"
    value, unit = (F.regexp_extract(F.trim(c), shape, k) for k in (1, 2))
    metres = F.when(value != "", value.try_cast("double")) * F.when(F.lower(unit).isin("ft", "feet", "'"), 0.3048).otherwise(1.0)
    return F.when(metres.between(-430, 8900), F.round(metres, 1))


#: What words of a request mean, as field -> value -> phrases; hyphens are read as spaces.
VOCABULARY = {
    "difficulty": {
        "easy": "easy, simple, gentle, mellow, leisurely, beginner",
        "moderate": "moderate, moderately hard, medium, intermediate, average",
        "hard": "hard, strenuous, tough, demanding, challenging, difficult, rugged",
    },
    "route_type": {
        "loop": "loop, loops, circuit, round trip loop",
        "out_and_back": "out and back, there and back, up and back",
        "point_to_point": "point to point, end to end, one way, shuttle, traverse, thru hike, through hike",
    },
    "region": {
        "adirondacks": "adirondack, adirondacks, adk, high peaks",
        "white-mountains-nh": "white mountain, white mountains, whites, new hampshire",
        "green-mountains-vt": "green mountain, green mountains, vermont",
        "maine": "maine",
    },
    "has_campsites": {"yes": "campsite, campsites, camp, camping, tent, tents, tenting, backpack, backpacking, lean to, lean tos, leanto, leantos"},
    "water_view": {"yes": "lake, lakes, lakeside, lakefront, pond, ponds, river, rivers, riverside, stream, streams, brook, creek, shore, waterfront, waterside, by the water, near water, water view, water views"},
    "sheltered": {"yes": "sheltered, out of the wind, protected, wind protected, no wind"},
    "unsupported": {
        "crowding": "quiet, crowd, crowds, crowded, uncrowded, busy, solitude, popular",
        "dog rules": "dog, dogs, pet, pets, puppy",
        "fishing": "fish, fishing",
        "swimming": "swim, swimming, swimmable",
        "permits": "permit, permits, reservation, reservations",
        "easy access from the road": "road, roadside, parking, short drive, easy access",
        "bugs": "bug, bugs, mosquito, mosquitoes, blackflies, black flies",
        "cell signal": "cell, signal, reception, cell service",
        "campfires": "fire, fires, campfire, campfires",
        "kid-friendliness": "kid, kids, child, children, toddler, family",
        "seasonal scenery": "foliage, fall colors, autumn colors, wildflowers, leaves",
    },
}
NUMBER_WORDS = dict(zip("one two three four five six seven eight nine ten eleven twelve".split(), map(float, range(1, 13)), strict=True)) | {"a": 1.0, "an": 1.0, "couple": 2.0, "few": 3.0, "dozen": 12.0}
UNITS = {"mi": "mi", "mile": "mi", "miles": "mi", "ft": "ft", "foot": "ft", "feet": "ft", "night": "night", "nights": "night", "day": "day", "days": "day"}
#: Phrases that end before a figure, or begin behind its unit, and make it a limit.
AT_MOST = ("under", "below", "within", "maximum", "max", "up to", "at most", "less than", "fewer than", "shorter than", "no more than", "not more than")
AT_LEAST = ("over", "above", "minimum", "min", "at least", "more than", "longer than")
MOST_BEHIND, LEAST_BEHIND = ("max", "maximum", "tops", "or less", "or under", "or fewer"), ("min", "minimum", "plus", "or more", "or longer")
FILLERS = ("of", "or", "more", "full", "long")
#: A lone length stands for this share less and more; a flat walk climbs at most so many feet.
ABOUT, FLAT_FT = 0.2, 500.0


def _mapped(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def tokens(c: Column) -> Column:
    """The words and figures of a request: signs of comparison as words, ranges with "to", units apart from their figures."""
    out = F.lower(c)
    for shape, word in ((r",(?=\d{3}\b)", ""), ("[<\u2264]", " under "), ("[>\u2265]", " over "), (r"(?<=\d)\s*[-\u2013]\s*(?=\d)", " to "), (r"(?<=\d)(?=[a-z])", " "), (r"\.(?!\d)|[^a-z0-9. ]", " ")):
        out = F.regexp_replace(out, shape, word)
    return F.filter(F.split(out, " +"), lambda t: t != "")


def _any(phrases: Iterable[str]) -> str:
    return "(?:" + "|".join(phrases) + ")"


def figures(words: Column) -> Column:
    """Figures with a unit behind them, in order: value, unit, low (where a range begins) and kind (most, least or null).

    Places with a figure are found first, so that words around are read for these alone.
    """
    number = lambda t: F.coalesce(F.when(F.rlike(t, F.lit(r"^\d")), t.try_cast("double")), _mapped(NUMBER_WORDS)[t])
    unit = lambda t: _mapped(UNITS)[t]
    # Behind a figure, or a filler behind it.
    skip = lambda i: F.when(unit(F.get(words, i + 1)).isNull() & F.get(words, i + 1).isin(*FILLERS), 1).otherwise(0)

    def read(i: Column) -> Column:
        at = lambda k: F.get(words, i + k)
        ranged = (at(-1) == "to") | ((at(-1) == "and") & (at(-3) == "between"))
        before = F.concat(F.lit(" "), F.concat_ws(" ", at(-3), at(-2), at(-1)))
        behind = F.concat(F.concat_ws(" ", F.get(words, i + 2 + skip(i)), F.get(words, i + 3 + skip(i))), F.lit(" "))
        says = lambda ends, begins: F.rlike(before, F.lit(f" {_any(ends)}\\z")) | F.rlike(behind, F.lit(f"^{_any(begins)} "))
        kind = F.when(says(AT_MOST, MOST_BEHIND), "most").when(says(AT_LEAST, LEAST_BEHIND), "least")
        return F.struct(number(at(0)).alias("value"), unit(F.get(words, i + 1 + skip(i))).alias("unit"), F.when(ranged, number(at(-2))).alias("low"), kind.alias("kind"))

    places = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.transform(F.filter(places, lambda i: number(F.get(words, i)).isNotNull() & unit(F.get(words, i + 1 + skip(i))).isNotNull()), read)


def bounds(found: Column, unit: str) -> tuple[Column, Column]:
    """From and to of a quantity: a range, limits, or a lone figure with ABOUT either side."""
    first = lambda keep: F.get(F.filter(found, lambda f: (f["unit"] == unit) & keep(f)), F.lit(0))
    span = first(lambda f: f["low"].isNotNull())
    least, most = (first(lambda f, k=k: f["kind"] == k)["value"] for k in ("least", "most"))
    lone, limited = first(lambda f: f["kind"].isNull())["value"], least.isNotNull() | most.isNotNull()
    return (
        F.when(span.isNotNull(), F.least(span["low"], span["value"])).when(limited, least).otherwise(F.round(lone * (1 - ABOUT), 1)),
        F.when(span.isNotNull(), F.greatest(span["low"], span["value"])).when(limited, most).otherwise(F.round(lone * (1 + ABOUT), 1)),
    )


def requests(df: DataFrame, phrase: Column) -> DataFrame:
    """df and what a phrase asks for, field by field: nothing that its words don't state. Fields that may have several values list them, comma-joined.

    Words and figures are columns of their own on the way, so that they are worked out once a row.
    """
    has = lambda phrases: F.rlike(F.col("_said"), F.lit(f" {_any(phrases.split(', '))} "))
    lists = {f"_{field}": F.array_compact(F.array(*(F.when(has(p), v) for v, p in VOCABULARY[field].items()))) for field in ("difficulty", "route_type", "region", "unsupported")}
    joined = lambda field: F.nullif(F.array_join(F.col(f"_{field}"), ","), F.lit(""))
    flag = lambda field: F.when(has(VOCABULARY[field]["yes"]), True)
    found = F.col("_found")
    count = lambda unit: F.get(F.filter(found, lambda f: f["unit"] == unit), F.lit(0))["value"].cast("int")
    nights = F.when(has("day hike, day hikes, day trip, day walk"), 0).when(F.col("_nights").isNotNull(), F.col("_nights")).when(F.col("_days") >= 2, F.col("_days") - 1).when(has("weekend, weekends"), 2).when(has("overnight, overnighter, overnights"), 1)
    (low, high), (up, most_up) = bounds(found, "mi"), bounds(found, "ft")
    fields = {
        "min_mi": low, "max_mi": high, "min_climb_ft": up, "max_climb_ft": F.coalesce(most_up, F.when(up.isNull() & has("flat, level"), FLAT_FT)), "nights": nights,
        "difficulty": joined("difficulty"), "route_type": joined("route_type"), "region": F.when(F.size("_region") == 1, F.get("_region", F.lit(0))),
        "has_campsites": flag("has_campsites"), "water_view": flag("water_view"), "sheltered": flag("sheltered"), "unsupported": joined("unsupported"),
    }
    staged = df.withColumn("_words", tokens(phrase)).withColumn("_found", figures(F.col("_words"))).withColumn("_said", F.concat(F.lit(" "), F.concat_ws(" ", "_words"), F.lit(" ")))
    staged = staged.withColumns(lists | {"_nights": count("night"), "_days": count("day")})
    return staged.select(*df.columns, *(c.alias(n) for n, c in fields.items()))
