"""Queries that once looked at a part of their pairs only, against brute force on fixtures."""

import math
from collections import Counter

import pytest

from kinmesh.plans import texts


@pytest.fixture
def tables(spark, monkeypatch):
    """Sets the tables that the queries read."""

    def put(**rows):
        made = {k: spark.createDataFrame(v, s) for k, (v, s) in rows.items()}
        monkeypatch.setattr(texts, "table", lambda _, __, n: made[n])
        monkeypatch.setattr(texts, "leuven", lambda _, __: made["leuven_name"].distinct())

    return put


LEUVEN = "person_id long, person_name string, person_address string"


def test_pairs_with_common_and_short_words(spark, tables):
    left = [(i, n, None) for i, n in enumerate(["Optik Berger GmbH", "Ada GmbH", "ADA  Berger", "solo", None, "Ada GmbH"])]
    right = [(i, f"N{i} GMBH") for i in range(15)] + [(50, "ADA BERGER"), (51, "BERGER"), (51, "BERGER"), (52, None), (53, "OTHER  WORD")]
    tables(leuven_name=(left, LEUVEN), han_name=(right, "HAN_ID long, Person_name_clean string"))
    words = lambda n: set(n.lower().split(" ")) - {""}
    want = sorted({(a, b) for a, n, _ in left if n for b, m in right if m and words(n) & words(m)})
    for q in (texts.lcs_ratio_pairs, texts.word_jaccard_all, texts.char_jaccard_all):
        assert sorted((r["person_id"], r["han_id"]) for r in q(spark, "").collect()) == want
    parts = texts.spread(spark.createDataFrame([(1, x) for x in range(30)], "k long, x long"), spark.createDataFrame([(1, y) for y in range(20)], "k long, y long"), "k", most=50)
    assert sorted((r["x"], r["y"]) for r in parts.collect()) == [(x, y) for x in range(30) for y in range(20)]


def test_cosine_with_frequent_values(spark, tables):
    """Pairs whose only common value is held by more than 20 records have a row."""
    sets = {i: {"hot", f"own{i % 7}"} if i < 25 else {f"x{i}", "own1"} for i in range(30)}
    schema = "record_id long, Person long, country string, Name string, Coauthor array<string>, Class array<string>, Lat double, Lng double, patent_ct int"
    tables(patstat_dedupe_input=([(i, i, "de", "n", sorted(s), [], None, None, 1) for i, s in sets.items()], schema))
    n = Counter(v for s in sets.values() for v in s)
    dot = lambda vs: sum(math.log(len(sets) / n[v]) ** 2 for v in vs)
    want = {(a, b): round(dot(sets[a] & sets[b]) / math.sqrt(dot(sets[a]) * dot(sets[b])), 5) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    got = {(r[0], r[1]): round(r[2], 5) for r in texts.tfidf_cosine_all(spark, "").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-5 for k in want) and (0, 1) in got


def test_names_and_addresses_of_any_script(spark, tables):
    """Accents, other scripts and line breaks are cleaned as well."""
    left = [(1, "Müller  und Söhne GmbH", "Gärtnerei Größe 12 Österweg\nGraz at"), (2, "Иван  Петров", "A,\nБ, Graz, AT"), (3, "Öl, Fett, Zoë, AG", None), (4, None, "")]
    tables(leuven_name=(left, LEUVEN))
    q = lambda n: {r["person_id"]: r for r in texts.QUERIES[n](spark, "").collect()}
    assert {k: (r["name"], r["plain"]) for k, r in q("clean_case_space").items()} == {1: ("MÜLLER UND SÖHNE GMBH", "müller und söhne gmbh"), 2: ("ИВАН ПЕТРОВ", "иван петров"), 3: ("ÖL, FETT, ZOË, AG", "öl fett zoë ag")}
    assert q("clean_ampersand")[1]["name"] == "MÜLLER & SÖHNE GMBH"
    assert q("legal_ids").keys() == {1, 2, 3} and "GMBH" in q("legal_ids")[1]["legal_ids"]
    assert q("sorted_name_key")[2]["key"] == "Иван Петров"
    assert q("parse_name_address")[1]["name"] == "gärtnerei größe"
    assert {k: r["country"] for k, r in q("country_tails").items()} == {1: "at", 2: "at"}
    assert (q("comma_split")[2]["name"], q("comma_split")[2]["address"]) == ("A,\nБ", "Graz, AT")
    assert q("addresses_in_names")[3]["name"] == "Öl, Fett"


def test_similar_sets_against_brute_force(spark):
    """Threshold joins lose no pair, with hot values, repeated rows, empty sets and clashing sizes."""
    import random

    from kinmesh.functions import similarity as sim

    rng = random.Random(3)
    make = lambda n: [(i, rng.sample("abcdefgh", rng.randrange(0, 5)) + (["hot"] if rng.random() < 0.7 else [])) for i in range(n)]
    a, b = make(60), make(50)
    x, y = spark.createDataFrame(a + a[:3], "x long, va array<string>"), spark.createDataFrame(b, "y long, vb array<string>")
    for t in (0.3, 0.5, 0.75, 1.0):
        want = {(i, j) for i, u in a for j, v in b if u and v and len({*u} & {*v}) / len({*u} | {*v}) >= t - 1e-9}
        got = [(r["x"], r["y"]) for r in sim.similar_sets(x, y, "va", "vb", t).collect()]
        assert set(got) == want and len(got) == len(want)
    n = len(a)
    df = Counter(v for _, vs in a for v in vs)
    idf = {v: math.log(sum(1 for _, vs in a) / c) for v, c in df.items()}
    norm = lambda vs: math.sqrt(sum(idf[v] ** 2 for v in vs))
    want = {(i, j): sum(idf[v] ** 2 for v in {*u} & {*w}) / (norm(u) * norm(w)) for i, u in a for j, w in a if i < j and norm(u) * norm(w) > 0}
    for t in (0.2, 0.6, 0.9):
        got = {(r[0], r[1]): r[2] for r in sim.near_cosine(spark.createDataFrame(a, "x long, va array<string>"), "x", "va", t).collect()}
        assert got.keys() == {k for k, c in want.items() if c >= t - 1e-6} and all(abs(got[k] - want[k]) < 1e-9 for k in got) and n
