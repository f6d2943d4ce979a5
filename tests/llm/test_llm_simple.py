"""Consistent text, components, tokenizer, similar sets and survivors on small frames and against brute force."""

import os
import random

import pytest
from pyspark.sql import functions as F

from kinmesh.llm import components, setjoin, survivor, tokenize, unify


def test_unify_forms(spark):
    cases = {
        "Ｒｅｆｏ GmbH": "Refo GmbH", "Müller": "Müller", "A​B": "AB", "A B": "A B", "A‑B": "A-B", "Laurenсе": "Laurence", "ЩИЛЛИАМ НИЛ": "ЩИЛЛИАМ НИЛ", "Βικτορια": "Βικτορια",
        "Ännchen  x ": "Ännchen  x ", "": "", "Vӧrlen, Hans": "Vörlen, Hans", "Олаф Щeн": "Олаф Щен",
    }
    t = spark.createDataFrame([(k, 1) for k in cases] + [(None, 1), ("A​B", 1)], "name string, consistent int")
    got = unify.forms(t.drop("consistent"), "name").collect()
    assert len(got) == len(cases) + 2
    for r in got:
        if r["name"] is None:
            assert r["consistent_form"] is None and r["is_changed"] is False
        else:
            assert r["consistent_form"] == cases[r["name"]] and r["is_changed"] == (cases[r["name"]] != r["name"])
    assert unify.comparable("ＳＴＲＡẞＥ  x") == "strasse x"
    assert unify.changed(t.limit(0), "name").count() == 0


def brute_components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(15)] + [(200, i) for i in range(201, 230)] + [(7, 7), (None, 1), (300, 300), (5, None)]
    t = spark.createDataFrame(pairs + pairs[:5], "a long, b long")
    assert dict(map(tuple, components.components(t).collect())) == brute_components(pairs)
    assert components.components(t.limit(0)).count() == 0
    keyed = spark.createDataFrame([(1, 9), (2, 9), (2, 9), (3, None), (4, 8)], "n long, k long")
    assert [tuple(r) for r in components.key_links(keyed, "n", "k").collect()] == [(2, 1)]


@pytest.mark.skipif(not os.path.exists(tokenize.VOCABULARIES), reason="no vocabularies")
def test_tokenizer(spark):
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(f"{tokenize.VOCABULARIES}/byte_bpe_50k.json")
    enc.encode_special_tokens = True
    texts = ["Hello  world's 12x", "", None, " \n\t ", "複数のガラス層 Ünïcödé", "a b　c\u0085d", "<|endoftext|>x", "é ͏ ٣٤ 😀👍🏽", "x " * 5000, "don't DON'T we'll  \n\n end ", "".join(chr(c) for c in range(32, 3000) if not 0xD800 <= c < 0xE000)]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("word", F.lit("w"))
    got = {r[0]: r[1] for r in tokenize.encode(t, "doc_id", "text").collect()}
    assert got == {i: enc.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(texts)}
    back = tokenize.decode(tokenize.encode(t, "doc_id", "text"), "doc_id")
    assert {r[0]: r[1] for r in back.collect()} == {i: x or "" for i, x in enumerate(texts)}
    assert tokenize.encode(t.limit(0), "doc_id", "text").count() == 0


def test_similar_sets(spark):
    rng = random.Random(9)
    rows = []
    for i in range(260):
        kind = rng.random()
        base = [f"v{rng.randrange(25 if kind < 0.5 else 400)}" for _ in range(rng.randrange(3, 16))]
        if kind > 0.6 and rows and rows[rng.randrange(len(rows))][2]:
            base = list(rows[rng.randrange(len(rows))][2] or [])
            if base and rng.random() < 0.7:
                base[rng.randrange(len(base))] = f"n{i}"
        rows.append((i, rng.randrange(90), [f" {v.upper()} " if v and rng.random() < 0.2 else v for v in base] + ([None, " "] if rng.random() < 0.3 else [])))
    rows += [(1000 + i, i if i % 4 else None, ["a", "b", "c", "d", "e"]) for i in range(12)] + [(2000, 1, None), (2001, 1, []), (2002, 5, [f"z{i}" for i in range(150)]), (2003, 6, [f"z{i}" for i in range(20, 150)])]
    sets = {k: (o, frozenset(v.strip().lower() for v in s if v and v.strip())) for k, o, s in rows if s is not None}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a][0] is not None and sets[b][0] is not None and sets[a][0] != sets[b][0] and min(len(sets[a][1]), len(sets[b][1])) >= 5 and 10 * len(sets[a][1] & sets[b][1]) >= 7 * len(sets[a][1] | sets[b][1])}
    t = spark.createDataFrame(rows, "record_id long, Person long, s array<string>").withColumn("sid", F.lit(1)).withColumn("mark", F.lit("m"))
    got = [tuple(r) for r in setjoin.similar_records(t, "record_id", "s", "Person").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    assert setjoin.similar_records(t.limit(0), "record_id", "s", "Person").count() == 0


GAZ = [("Graz", "DE", 50.0, 10.0, 1, "r")]


def survivors_of(spark, rows):
    t = spark.createDataFrame([(i, 1, n, la, ln, "DE", f"2010-01-{d:02d} 00:00:00") for i, (n, la, ln, d) in enumerate(rows)], "record_id long, Person long, Name string, Lat double, Lng double, country string, loaded_at string")
    full = [(100 + i, 2 + i % 3, "anna maria gross", 50.1, 10.1, "DE", "2009-01-01 00:00:00") for i in range(12)]
    t = t.unionByName(spark.createDataFrame(full, t.schema)).withColumn("loaded_at", F.to_timestamp("loaded_at")).withColumn("value", F.lit(0))
    out = survivor.survivors(t, spark.createDataFrame(GAZ, "city string, country string, lat double, lng double, population long, region string"))
    return next(tuple(r)[1:3] for r in out.collect() if r["person"] == 1)


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("edward g nozehorde", 50.0, 10.0, 1), ("nozehorde", None, 10.0, 2), ("e. nozehorde", 0.0, 0.0, 3)], (0, 0)),
        ([("optik bau gmbh", 50.0, 10.0, 1), ("optik bau ag", 10.0, 50.0, 2), ("optik b", 50.5, 10.0, 3)], (1, 2)),
        ([("optik bau gmbh", -50.0, 10.0, 1), ("unbekannt", 500.0, 10.0, 2), ("optik b_u gmbh", None, None, 3), ("optik bau gmbh 12 mill st us", 50.0, -10.0, 4)], (0, -1)),
        ([("vera stein", 50.0, 10.0, 1), ("vera stein", 50.0, 10.0, 1), (None, None, None, 2), ("vera st", None, None, 3)], (0, 0)),
        ([("w. optik &. s. ltd", None, None, 3), ("welt optik & sons ltd", None, None, 1), ("optik", None, None, 2)], (1, -1)),
    ],
)
def test_survivors(spark, rows, want):
    assert survivors_of(spark, rows) == want


def test_survivors_need_discovery(spark, monkeypatch):
    """With equal trust in all sources the latest claim of any kind would survive: reliabilities decide."""
    rows = [("optik bau gmbh", 50.0, 10.0, 1), ("unbekannt", 10.0, 10.0, 2), ("optik b", 11.0, 10.0, 3)]
    assert survivors_of(spark, rows) == (0, 0)
    real = survivor.discover
    monkeypatch.setattr(survivor, "discover", lambda c: (lambda best, trust: (best, dict.fromkeys(trust, 1.0)))(*real(c)))
    assert survivors_of(spark, rows) == (2, 2)


def test_shorter_forms_against_brute_force(spark):
    """Beginnings and other shorter forms are found in a group of any size, also where the order is cut into ranges; very long names are read whole."""
    rng = random.Random(31)
    pool = ["anna", "an", "berg", "b", "c.", "mai", "maier", "x", "ab"]
    names = {" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 5))) for _ in range(120)} | {"zeta " * 400 + "omega", "zeta zeta omega"}
    t = spark.createDataFrame([(e, n) for e in (1, 2) for n in sorted(names) if e == 1 or len(n) % 2], "entity long, core string").withColumn("base", F.col("core")).repartition(5)
    groups = {e: {r["core"] for r in t.where(f"entity = {e}").collect()} for e in (1, 2)}
    texts = t.select("entity", F.col("core").alias("s"), F.lit(0).alias("kind")).unionByName(t.select("entity", F.col("core").alias("s"), F.lit(1).alias("kind")))
    got = {(r["entity"], r["s"]): r["next_core"] for r in survivor._following(texts).where("kind = 0").collect()}
    assert got == {(e, n): min((m for m in g if m > n), default=None) for e, g in groups.items() for n in g}

    def form(x, y):
        w = y.split(" ")
        return x != y and len(w) > 1 and not y.startswith(x) and (f" {x} " in f" {y} " or x == f"{w[0]} {w[-1]}" or x == w[0] + " " + " ".join(v[0] + "." for v in w[1:]))

    want = {(e, x) for e, g in groups.items() for x in g if any(form(x, y) for y in g)}
    assert {tuple(r) for r in survivor._shortened(t, t).collect()} == want and len(want) > 20


def test_survivors_of_nothing(spark):
    t = spark.createDataFrame([], "record_id long, Person long, Name string, Lat double, Lng double, country string, loaded_at timestamp")
    assert survivor.survivors(t, spark.createDataFrame(GAZ, "city string, country string, lat double, lng double, population long, region string")).count() == 0


def test_discover(spark):
    claims = [(e, "good", "x") for e in range(6)] + [(e, "also", "x") for e in range(6)] + [(e, "bad", f"y{e}") for e in range(6)]
    best, trust = survivor.discover(spark.createDataFrame(claims, "entity long, source string, value string"))
    assert {r["value"] for r in best.collect()} == {"x"} and trust["good"] > 0.9 > 0.3 > trust["bad"]
