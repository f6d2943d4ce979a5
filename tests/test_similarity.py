"""Similarities: examples and properties."""

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinmesh.functions import similarity as sim


def two(spark, a, b, f):
    return spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b")).alias("o")).first()["o"]


def test_examples(spark):
    assert two(spark, "siemens ag", "siemens gmbh", sim.word_jaccard) == 1 / 3
    assert round(two(spark, "siemens ag", "siemens gmbh", sim.indel_ratio), 6) == 0.818182
    assert round(two(spark, "kitten", "sitting", sim.indel_ratio), 6) == 0.615385
    assert two(spark, "", "", sim.indel_ratio) == 1.0
    assert two(spark, None, "x", sim.indel_ratio) is None
    assert spark.range(1).select(sim.inverse_difference(F.lit(3), F.lit(7))).first()[0] == 0.2
    km = spark.range(1).select(sim.haversine_km(*map(F.lit, (48.2082, 16.3738, 50.8503, 4.3517)))).first()[0]
    assert round(km, 3) == 914.803


def test_phonetic():
    assert sim.phonetic_key("philips") == sim.phonetic_key("filips")
    assert sim.phonetic_key("") == ""


@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_lcs_properties(a, b):
    n = sim.lcs_length(a, b)
    assert n == sim.lcs_length(b, a) and 0 <= n <= min(len(a), len(b))
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    assert n == table[-1][-1]


def test_set_cosine(spark):
    sets = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["c"]), (4, ["a", "c"])], "id long, s array<string>")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "id_a long, id_b long")
    got = {(r[0], r[1]): r[2] for r in sim.set_cosine(pairs, sets, "id", "s").collect()}
    assert abs(got[1, 2] - 1) < 1e-9 and got[1, 3] == 0


def test_double_metaphone():
    from kinmesh.functions.metaphone import double_metaphone

    known = {"smith": "SM0", "schmidt": "XMT", "thomas": "TMS", "knight": "NT", "michael": "MKL", "wright": "RT", "xavier": "SF", "school": "SKL", "physics": "FSKS", "accident": "AKST", "caesar": "SSR", "church": "XRX", "laugh": "LF", "czerny": "SRN", "filipowicz": "FLPT", "architect": "ARKT", "nation": "NXN", "jose": "HS", "": "", "12 !": ""}
    assert {k: double_metaphone(k) for k in known} == known and double_metaphone("architect", 3) == "ARK"


def test_affine_gaps_of_many():
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 30)))
    pairs = [(word(), word()) for _ in range(200)]
    assert all(abs(g - sim.affine_gap(a, b)) < 1e-9 for g, (a, b) in zip(sim.affine_gaps(pairs), pairs))
