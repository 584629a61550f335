"""What requests in words ask for, phrase by phrase."""

import pytest
from pyspark.sql import functions as F

from cairnpath.functions import text

PHRASES = {
    "two nights, lakeside, moderate climb": {"nights": 2, "water_view": True, "difficulty": "moderate"},
    "an easy 5 mile loop near a lake": {"min_mi": 4.0, "max_mi": 6.0, "difficulty": "easy", "route_type": "loop", "water_view": True},
    "under 10 miles with less than 2,000 ft of climbing": {"max_mi": 10.0, "max_climb_ft": 2000.0},
    "quiet overnight in the High Peaks, dog friendly": {"nights": 1, "region": "adirondacks", "unsupported": "crowding,dog rules"},
    "a weekend point-to-point in Vermont": {"nights": 2, "route_type": "point_to_point", "region": "green-mountains-vt"},
    "flat day hike, out and back, close to the road": {"max_climb_ft": 500.0, "nights": 0, "route_type": "out_and_back", "unsupported": "easy access from the road"},
    "strenuous 3 day backpacking trip in the White Mountains with at least 3000 ft of gain": {"min_climb_ft": 3000.0, "difficulty": "hard", "nights": 2, "has_campsites": True, "region": "white-mountains-nh"},
    "8-12 mi loop with a lean-to, sheltered from the wind": {"min_mi": 8.0, "max_mi": 12.0, "route_type": "loop", "has_campsites": True, "sheltered": True},
    "sheltered campsite by a river, good fishing, no bugs please": {"has_campsites": True, "water_view": True, "sheltered": True, "unsupported": "fishing,bugs"},
    "somewhere nice": {},
    "Adirondacks or Vermont, a loop": {"route_type": "loop"},
    "between 5 and 8 miles, <1500ft, a couple of nights": {"min_mi": 5.0, "max_mi": 8.0, "max_climb_ft": 1500.0, "nights": 2},
    "easy or moderate, at least 4 miles and no more than 9.5 miles": {"min_mi": 4.0, "max_mi": 9.5, "difficulty": "easy,moderate"},
    "12 miles max, > 900 feet": {"max_mi": 12.0, "min_climb_ft": 900.0},
    "6 miles or more": {"min_mi": 6.0},
    "10 to 6 miles": {"min_mi": 6.0, "max_mi": 10.0},
    "hardly a hardware shop": {},
    "": {},
}


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([(p,) for p in PHRASES] + [(None,)], "phrase string")
    return {r.phrase: r.asDict() for r in text.requests(df, F.col("phrase")).collect()}


@pytest.mark.parametrize("phrase", [*PHRASES, None])
def test_phrase(read, phrase):
    got = {k: v for k, v in read[phrase].items() if v is not None and k != "phrase"}
    assert got == PHRASES.get(phrase, {})
