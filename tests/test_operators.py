"""Operators on small frames: aggregates, samples, blocks, quality, sources."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh.operators import aggregate, blocking, evaluate, geocode, link, pairs, select, skew
from kinmesh.sources import readers, sinks


def test_skew(spark, rows):
    t = spark.createDataFrame([("a", i % 7, 1) for i in range(60)] + [("b", 1, 1), (None, 2, 1), ("c", None, 1)], "k string, v int, key int")
    assert rows(skew.key_counts(t, "k")) == [("a", 60), ("b", 1), ("c", 1)]
    assert rows(skew.heavy_keys(t, "k", 0.05)) == [("a", 60)]
    assert rows(skew.salted_stats(t, "k", {"n_v": "v"})) == [("a", 60, 7, True), ("b", 1, 1, False), ("c", 1, 0, False)]
    assert rows(skew.salted_stats(t.limit(0), "k", {"n_v": "v"})) == []
    right = spark.createDataFrame([("a", 10), ("b", 20), ("d", 30)], "k string, w int")
    for least in (1, 10**9):
        assert skew.skew_join(t, right, "k", least=least).count() == 61
        assert skew.skew_join(t, right, "k", "left", least=least).count() == t.count()


def test_stages_are_cleared(spark):
    from kinmesh import session

    session.stored(spark.range(3), "mine")
    assert session.clear_stages(spark) >= 1 and session.clear_stages(spark) == 0


def test_dealt_join(spark, rows):
    a = spark.createDataFrame([(1, x) for x in range(30)] + [(2, 9), (None, 1), (3, 3)], "k long, x long")
    b = spark.createDataFrame([(1, y) for y in range(40)] + [(1, 5), (2, 7), (None, 2)], "k long, y long")
    want = sorted((k, x, y) for k, x in rows(a) for l, y in rows(b) if k is not None and k == l)
    for part in (1, 7, 1000):
        assert sorted(map(tuple, skew.dealt_join(a, b, ["k"], part).collect())) == want
    assert skew.dealt_join(a, b.limit(0), ["k"]).count() == 0


def test_aggregates(spark, rows):
    t = spark.createDataFrame([(1, "x", 0.0), (1, "y", 48.2), (1, "y", 48.2), (1, None, 47.1), (2, "b", 0.0), (2, "a", None)], "k int, v string, lat double")
    assert rows(aggregate.mode_by(t, ["k"], "v", "v")) == [(1, "y"), (2, "a")]
    assert rows(aggregate.mode_of_pair(t.withColumn("lng", F.col("lat")), ["k"], "lat", "lng")) == [(1, 48.2, 48.2), (2, 0.0, 0.0)]
    s = spark.createDataFrame([(1, "a**b"), (1, "b**c"), (1, None)], "k int, v string")
    assert rows(aggregate.set_union(s, ["k"], F.split("v", r"\*\*"), "s")) == [(1, ["a", "b", "c"])]
    many = spark.createDataFrame([(1, f"v{i}") for i in range(150)], "k int, v string")
    assert len(aggregate.set_union(many, ["k"], F.array("v"), "s").first()["s"]) == 100
    lists = spark.createDataFrame([(["a", "b", "c"],), ([str(i) for i in range(12)],), ([],)], "v array<string>")
    assert [len(r[0]) for r in lists.select(aggregate.capped_less_one(F.col("v"))).collect()] == [2, 9, 0]
    f = spark.createDataFrame([(1, "A", "AT"), (1, "B", "AT"), (1, "C", "BE")], "u int, p string, c string")
    assert {r["c"]: round(r["share"], 6) for r in aggregate.fractional_counts(f, "u", "p", "c").collect()} == {"AT": 0.666667, "BE": 0.333333}


def test_quality(spark):
    t = spark.createDataFrame([(1, 5, 1, 1), (2, 1, 1, 1), (3, 3, 1, 2), (4, 7, 2, 3)], "person int, patents int, cluster int, ref int")
    assert tuple(evaluate.precision_recall(t, "cluster", "ref").first()) == (0.75, 1.0)
    assert tuple(evaluate.precision_recall(t, "cluster", "ref", "patents").first()) == (13 / 16, 1.0)
    assert tuple(evaluate.precision_recall(t, "ref", "ref").first()) == (1.0, 1.0)
    assert tuple(evaluate.pairwise(t, "cluster", "ref").first()) == (1 / 3, 1.0)


def test_sequential_ids(spark, rows):
    t = spark.createDataFrame([(0, None), (1, 7), (2, 9), (3, 7), (4, 9)], "r int, c int")
    assert rows(select.sequential_ids(t, "r", "c")) == [(0, 2), (1, 3), (2, 4), (3, 3), (4, 4)]
    assert rows(select.sequential_ids(t, "r", "c", first="zero")) == [(0, 0), (1, 1), (2, 2), (3, 1), (4, 2)]
    assert rows(select.sequential_ids(t.limit(0), "r", "c")) == []


def test_many_sequential_ids(spark):
    """As many ids as groups, in an unbroken row, over many partitions."""
    t = spark.range(12000).withColumn("c", F.when(F.col("id") % 3 == 0, F.pmod(F.xxhash64("id"), F.lit(3000)))).repartition(8)
    groups = t.select(F.coalesce(F.concat(F.lit("c"), "c"), F.concat(F.lit("r"), "id"))).distinct().count()
    got = select.sequential_ids(t, "id", "c", first="zero")
    assert groups > 5000 and got.count() == 12000
    assert tuple(got.agg(F.countDistinct("cluster_id"), F.min("cluster_id"), F.max("cluster_id")).first()) == (groups, 0, groups - 1)


def test_others_and_ranks(spark, rows):
    pairs_ = [(u, p, f"n{p % 17}") for u, size in ((1, 40), (2, 2), (3, 1)) for p in range(size)]
    got = {(r["u"], r["p"]): r["others"] for r in aggregate.others(spark.createDataFrame(pairs_, "u int, p int, n string"), "u", "p", "n", 9).collect()}
    want = {(u, p): sorted({n for v, q, n in pairs_ if v == u and q != p})[:9] for u, p, _ in pairs_}
    assert got == want
    t = spark.createDataFrame([(i, float(i * 7 % 23)) for i in range(300)], "i int, v double")
    import pandas as pd

    want = pd.Series([float(i * 7 % 23) for i in range(300)]).rank().tolist()
    assert [r["v_rank"] for r in sorted(evaluate.average_ranks(t, ["v"]).collect(), key=lambda r: r["i"])] == want


def test_reference_pairs_are_bounded(spark):
    rows_ = [(i, 1 if i < 30 else i // 2) for i in range(60)]
    t = spark.createDataFrame(rows_, "r long, c long")
    groups = {c: sorted(r for r, x in rows_ if x == c) for _, c in rows_}
    order = sorted(groups)
    same = [(a, b) for c in order for a in groups[c] for b in groups[c] if a < b]
    other = [(a, b) for c, d in zip(order, order[1:]) for a in groups[c] for b in groups[d]]
    for most in (5, 40, 100_000):
        got = pairs.reference_pairs(t, "r", "c", most).collect()
        assert sorted((x, y) for x, y, label in got if label == 1) == sorted(same[:most]) and sorted((x, y) for x, y, label in got if label == 0) == sorted(other[:most])


def test_addresses_in_tiers(spark):
    g = spark.createDataFrame([("Graz", "AT", 47.0, 15.4, 100), ("Linz", "AT", 48.3, 14.3, 50)], "city string, country string, lat double, lng double, population long")
    t = spark.createDataFrame([(1, "optik bau 12 hauptweg, graz at", "AT"), (2, "a very long name of a firm that goes on, and on, street of the post, linz at", "AT"), (3, "optik berger linz at", "AT"), (4, "optik berger", None)], "id int, n string, c string")
    got = {r["id"]: tuple(r)[1:5] for r in geocode.tiered_addresses(t, "id", "n", "c", g).collect()}
    assert got == {1: ("optik bau", " 12 hauptweg, graz at", "graz", 47.0), 2: ("a very long name of a firm that goes on, and on", ", street of the post, linz at", "linz", 48.3), 3: ("optik berger", "linz at", "linz", 48.3), 4: ("optik berger", "", "", 0.0)}
    p = spark.createDataFrame([(1, "Graz Werke", "Weg 1, Linz", "DE"), (2, None, "Weg 1 Linz at", "DE"), (3, None, None, None)], "id int, n string, a string, c string")
    assert {r["id"]: (r["city"], r["source"]) for r in geocode.preferred(p, "id", "n", "a", "c", g).collect()} == {1: (None, None), 2: ("Linz", "address"), 3: (None, None)}


def test_blocks(spark, rows):
    t = spark.createDataFrame([(1, "siemens ag", ["a"]), (2, "siemens gmbh", ["a", "b"]), (3, "bosch", []), (4, "", None), (5, None, ["b"])], "id long, name string, s array<string>")
    preds = [blocking.prefix("name", 4), blocking.common_element("s")]
    blocks = blocking.block_map(t, "id", preds)
    assert rows(blocking.candidates(blocks, "id")) == [(1, 2), (2, 5)]
    assert rows(blocking.candidates(blocks, "id", most=1)) == [(1, 2)]
    assert blocking.shared_blocks(blocks).count() == 6
    rules = blocking.learn_rules(t, "id", preds, spark.createDataFrame([(1, 2), (2, 5)], "id_a long, id_b long"), ppc=1.0)
    assert rules == ["element of s"]
    calls = []
    got = blocking.learn_with_retries(lambda p, u: calls.append(p), 0.001, 5)
    assert got[0] is None and got[2] == 0 and abs(got[1] - 0.001 * 1.5**5) < 1e-12


def test_connected(spark, rows):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3)]
    got = dict(rows(blocking.connected(spark.createDataFrame(chain, "a long, b long"), "a", "b")))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_theta_matches(spark, rows):
    names = ["solanvutrer optics", "solanvutrr optics", "solanvutrer opticz", "bosch", "b", "completely other name"]
    left = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    right = spark.createDataFrame([(0, "solanvutrer optics"), (1, "bosh")], "id int, name string")
    from kinmesh.functions.similarity import lcs_length

    want = {i for i, a in enumerate(names) for b in ("solanvutrer optics", "bosh") if 2 * lcs_length(a, b) / (len(a) + len(b)) >= 0.8}
    assert {r[0] for r in pairs.theta_matches(left, right, "id", "name", 0.8).collect()} == want


def test_threshold_and_links(spark, rows):
    p = spark.createDataFrame([(0.9,), (0.8,), (0.1,)], "p double")
    assert pairs.expected_threshold(p, 1.0).first()["threshold"] == 0.8
    a = spark.createDataFrame([(1, "acme works", 1.0, 2.0, "AT"), (2, None, 0.0, 0.0, "AT")], "id int, name string, lat double, lng double, country string")
    b = spark.createDataFrame([(7, "acme work", 1.0, 2.0, "AT"), (8, "acme works", 0.0, 0.0, "AT"), (9, "acme works", 1.0, 2.0, "BE")], "id int, name string, lat double, lng double, country string")
    got = link.phonetic_links(a, b).collect()
    assert [(r["left_id"], r["right_id"], r["geo_dist"]) for r in sorted(got, key=lambda r: r["lev_dist"])] == [(1, 8, None), (1, 7, 0.0)]


def test_geocode(spark):
    g = spark.createDataFrame([("Wien", "AT", 48.2, 16.4, 100), ("Linz", "AT", 48.3, 14.3, 50), ("Bad Ischl", "AT", 47.7, 13.6, 5)], "city string, country string, lat double, lng double, population long")
    t = spark.createDataFrame([("Hauptstr 5, Linz, Wien", "AT"), ("x Bad Ischel", "at"), (None, "AT"), ("nowhere", "AT")], "a string, c string")
    got = {r["address"]: r["city"] for r in geocode.by_ngrams(t, "a", "c", g).collect()}
    assert got == {"Hauptstr 5, Linz, Wien": "Wien", "x Bad Ischel": "Bad Ischl"}
    last = {r["address"]: r["city"] for r in geocode.last_town(t, "a", g).collect()}
    assert last == {"Hauptstr 5, Linz, Wien": "Wien", "x Bad Ischel": "NONE", "nowhere": "NONE"}


def test_samples(spark):
    t = spark.range(500).withColumn("c", F.col("id") % 2)
    a = [r[0] for r in select.hash_sample(t, "id", 10).collect()]
    assert a == [r[0] for r in select.hash_sample(t.repartition(7), "id", 10).collect()]
    assert select.hash_sample(t, "id", 10, "c").count() == 20
    p = select.pair_sample(t, "id", 3)
    assert p.where("id_a >= id_b").count() == 0 and p.count() > 1000


def test_sources(spark, rows, tmp_path):
    (tmp_path / "cleaned_output_AT.tsv").write_text("person_id\tname\n1\ta\n2\tNA\n")
    (tmp_path / "cleaned_output_BE.tsv").write_text("3\tc\n")
    schema = T.StructType([T.StructField("person_id", T.LongType()), T.StructField("name", T.StringType())])
    assert rows(readers.table_with_doubtful_header(spark, str(tmp_path / "*.tsv"), schema)) == [(1, "a"), (2, "NA"), (3, "c")]
    assert {r["country"] for r in readers.country_files(spark, str(tmp_path / "*_BE.tsv"), schema).collect()} == {"BE"}
    (tmp_path / "codes.txt").write_text("NAMIBIA;NA\n")
    assert rows(readers.lookup(spark, str(tmp_path / "codes.txt"), ["name", "code"])) == [("NAMIBIA", "NA")]
    (tmp_path / "links.txt").write_text("7###0.99###3,4,\n\n")
    assert rows(readers.links(spark, str(tmp_path / "links.txt"))) == [(7, 0.99, 3), (7, 0.99, 4)]
    (tmp_path / "ragged.txt").write_text("0\t1\ta\nb\tc\n")
    assert rows(readers.ragged(spark, str(tmp_path / "ragged.txt"), ["x", "y"])) == [("1", "a"), ("b", "c")]
    (tmp_path / "bulk.csv").write_bytes(b'id,name\r\n1,"a\\b"\r\n')
    assert rows(readers.bulk(spark, str(tmp_path / "bulk.csv"), T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))) == [(1, "a\\b")]
    t = spark.createDataFrame([(1, "AT", ["a", "b"]), (2, "BE", [])], "id long, country string, s array<string>")
    sinks.partitioned(t, str(tmp_path / "p"), "country")
    assert spark.read.parquet(str(tmp_path / "p")).where("country = 'AT'").count() == 1
    sinks.delimited(t, str(tmp_path / "d"), index="id")
    assert rows(readers.csv(spark, str(tmp_path / "d"), "id long, country string, s string", sep="\t")) [0][2] == "a**b"
    sinks.pair_json(spark.createDataFrame([(1, 2, 1.0)], "record_id_a long, record_id_b long, label double"), str(tmp_path / "j"))
    assert rows(readers.pair_json(spark, str(tmp_path / "j"))) == [(1, 2, 1.0)]
    assert r"\hline" in sinks.latex(t.select("id"))
    assert rows(readers.query(spark, "SELECT id, country FROM t", ["a", "b"], t=t)) == [(1, "AT"), (2, "BE")]
    assert readers.unique_rows(t.unionByName(t), "id").count() == 2
