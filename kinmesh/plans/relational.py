"""Extraction, joins, aggregates, samples and set operations over the registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmesh.operators import aggregate, select
from kinmesh.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def leuven(spark: SparkSession, d: str) -> DataFrame:
    """The register, each person_id once."""
    return table(spark, d, "leuven_name").distinct()


def person_appln(spark: SparkSession, d: str) -> DataFrame:
    """(person_id, appln_id), each once: suppliers of orders."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("person_id"), F.col("l_orderkey").alias("appln_id")).distinct()


PA = "pa AS (SELECT DISTINCT l_suppkey AS person_id, l_orderkey AS appln_id FROM lineitem)"
L = "l AS (SELECT DISTINCT * FROM leuven_name)"


@query(f"WITH {PA} SELECT p.appln_id, p.person_id, s_name AS person_name, n_name AS country FROM pa p JOIN orders ON appln_id = o_orderkey JOIN supplier ON person_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE year(o_orderdate) = 1997")
def extract_person_appln(spark, d):
    o = table(spark, d, "orders").where((F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")))
    p = person_appln(spark, d).join(o.select(F.col("o_orderkey").alias("appln_id")), "appln_id")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("person_name"), "s_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"))
    return p.join(s, "person_id").join(F.broadcast(n), "s_nationkey").select("appln_id", "person_id", "person_name", "country")


@query("SELECT l_orderkey AS appln_id, string_agg(DISTINCT p_type, '**' ORDER BY p_type) AS ipc_code FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def ipc_group_concat(spark, d):
    li, p = table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    codes = li.join(p, "l_partkey").groupBy(F.col("l_orderkey").alias("appln_id")).agg(F.collect_set("p_type").alias("c"))
    return codes.select("appln_id", F.array_join(F.array_sort("c"), "**").alias("ipc_code"))


@query(f"""WITH {PA}, n AS (SELECT appln_id, person_id, s_name FROM pa JOIN supplier ON person_id = s_suppkey),
  o AS (SELECT DISTINCT a.appln_id, a.person_id, b.s_name FROM n a JOIN n b ON a.appln_id = b.appln_id AND a.person_id <> b.person_id),
  r AS (SELECT *, row_number() OVER (PARTITION BY appln_id, person_id ORDER BY s_name) AS k FROM o),
  c AS (SELECT appln_id, person_id, string_agg(s_name, '**' ORDER BY s_name) AS coauthors FROM r WHERE k <= 9 GROUP BY ALL)
  SELECT n.appln_id, n.person_id, coalesce(coauthors, '') AS coauthors FROM n LEFT JOIN c USING (appln_id, person_id)""")
def coauthor_lists(spark, d):
    """The first nine other persons of each application, by person and not by name."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), "s_name")
    all_ = person_appln(spark, d).join(s, "person_id")
    return aggregate.others(all_, "appln_id", "person_id", "s_name", 9).select("appln_id", "person_id", F.array_join("others", "**").alias("coauthors"))


@query("""WITH c AS (SELECT Person, Name, count(*) AS n FROM patstat_dedupe_input WHERE Name IS NOT NULL AND Person IS NOT NULL GROUP BY ALL),
  g AS (SELECT Person, Lat, Lng, count(*) AS n FROM patstat_dedupe_input WHERE Lat <> 0 AND Lng <> 0 AND NOT isnan(Lat) AND NOT isnan(Lng) GROUP BY ALL),
  a AS (SELECT Person, Name, row_number() OVER (PARTITION BY Person ORDER BY n DESC, Name) AS k FROM c),
  b AS (SELECT Person, Lat, Lng, row_number() OVER (PARTITION BY Person ORDER BY n DESC, Lat, Lng) AS k FROM g)
  SELECT p.Person, a.Name, coalesce(b.Lat, 0.0) AS Lat, coalesce(b.Lng, 0.0) AS Lng FROM (SELECT DISTINCT Person FROM patstat_dedupe_input WHERE Person IS NOT NULL) p
  LEFT JOIN a ON p.Person = a.Person AND a.k = 1 LEFT JOIN b ON p.Person = b.Person AND b.k = 1""")
def consolidate_mode(spark, d):
    t = table(spark, d, "patstat_dedupe_input").where("Person IS NOT NULL")
    return aggregate.mode_of_pair(t, ["Person"], "Lat", "Lng").join(aggregate.mode_by(t, ["Person"], "Name", "Name"), "Person", "left").select("Person", "Name", "Lat", "Lng")


@query("""WITH v AS (SELECT DISTINCT Person, lower(trim(v)) AS v FROM (SELECT Person, unnest(Class) AS v FROM patstat_dedupe_input WHERE Person IS NOT NULL) WHERE v IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY Person ORDER BY v) AS k FROM v)
  SELECT Person, string_agg(v, '**' ORDER BY v) AS classes FROM r WHERE k <= 100 GROUP BY Person""")
def consolidate_set_capped(spark, d):
    """At most 100 distinct classes per Person, the least ones."""
    sets = aggregate.set_union(table(spark, d, "patstat_dedupe_input").where("Person IS NOT NULL"), ["Person"], F.transform("Class", lambda v: F.lower(F.trim(v))), "classes")
    return sets.select("Person", F.array_join("classes", "**").alias("classes"))


@query("SELECT Person, CAST(sum(patent_ct) AS BIGINT) AS patent_ct, max(loaded_at) AS loaded_at, count(*) AS n_rows FROM patstat_dedupe_input WHERE Person IS NOT NULL GROUP BY Person")
def consolidate_by_dict(spark, d):
    return aggregate.consolidate(table(spark, d, "patstat_dedupe_input").where("Person IS NOT NULL"), ["Person"], {"patent_ct": "sum", "loaded_at": "max"})


@query(f"WITH {PA} SELECT person_id, count(*) AS patent_ct FROM pa GROUP BY person_id")
def person_appln_counts(spark, d):
    """Distinct applications per person."""
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("person_id")).agg(F.countDistinct("l_orderkey").alias("patent_ct"))


@query("SELECT l_orderkey AS appln_id, string_agg(p_brand, '**' ORDER BY p_brand) AS codes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def concat_all_codes(spark, d):
    li, p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("appln_id"), "l_partkey"), table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return aggregate.concat_all(li.join(p, "l_partkey"), ["appln_id"], "p_brand", "codes")


@query("WITH b AS (SELECT DISTINCT l_suppkey AS person_id, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey), r AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY p_brand) AS k FROM b) SELECT person_id, string_agg(p_brand, '**' ORDER BY p_brand) AS codes FROM r WHERE k <= 9 GROUP BY ALL")
def first_nine_codes(spark, d):
    li, p = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("person_id"), "l_partkey"), table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return aggregate.first_concat(li.join(p, "l_partkey"), ["person_id"], "p_brand", "codes")


@query("""SELECT person_ctry_code AS country, count(*) AS n, sum(CASE WHEN person_name IS NOT NULL AND person_name <> '' THEN 1 ELSE 0 END) / count(*) AS with_name,
  sum(CASE WHEN person_address <> '' THEN 1 ELSE 0 END) / count(*) AS with_address, count(hrm_l2_id) / count(*) AS with_level2 FROM leuven_name WHERE person_ctry_code IS NOT NULL GROUP BY ALL""")
def summary_completeness(spark, d):
    t = table(spark, d, "leuven_name").where("person_ctry_code IS NOT NULL")
    share = lambda c: F.coalesce(F.sum(F.when(F.col(c) != "", 1).otherwise(0)), F.lit(0)) / F.count("*")
    return t.groupBy(F.col("person_ctry_code").alias("country")).agg(F.count("*").alias("n"), share("person_name").alias("with_name"), share("person_address").alias("with_address"), (F.count("hrm_l2_id") / F.count("*")).alias("with_level2"))


@query("SELECT person_ctry_code AS country, count(DISTINCT person_id) AS n_ids FROM leuven_name WHERE person_ctry_code IS NOT NULL GROUP BY ALL")
def count_distinct_by_country(spark, d):
    return table(spark, d, "leuven_name").where("person_ctry_code IS NOT NULL").groupBy(F.col("person_ctry_code").alias("country")).agg(F.countDistinct("person_id").alias("n_ids"))


@query(f"""WITH {L}, p AS (SELECT DISTINCT htm_l1, hrm_l2_id FROM l WHERE htm_l1 IS NOT NULL AND hrm_l2_id IS NOT NULL), a AS (SELECT count(*) AS n FROM p GROUP BY htm_l1), b AS (SELECT count(*) AS n FROM p GROUP BY hrm_l2_id)
  SELECT max(n) AS max_value, min(n) AS min_value, avg(n) AS mean_value, median(n) AS median_value, 'hrm_l2_id per htm_l1' AS direction FROM a
  UNION ALL SELECT max(n), min(n), avg(n), median(n), 'htm_l1 per hrm_l2_id' FROM b""")
def id_map_cardinality(spark, d):
    return aggregate.map_cardinality(leuven(spark, d), "htm_l1", "hrm_l2_id")


@query("SELECT sector, count(*) AS n, round(count(*) / (SELECT count(*) FROM leuven_name WHERE sector IS NOT NULL), 3) AS share, count(*) = max(count(*)) OVER () AS is_top FROM leuven_name WHERE sector IS NOT NULL GROUP BY sector")
def value_share(spark, d):
    counts = table(spark, d, "leuven_name").where("sector IS NOT NULL").groupBy("sector").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.max("n").alias("m"))
    return counts.join(F.broadcast(total)).select("sector", "n", F.round(F.col("n") / F.col("t"), 3).alias("share"), (F.col("n") == F.col("m")).alias("is_top"))


CATEGORIES = {"metal": "BRASS|STEEL|NICKEL|COPPER", "coated": "PLATED|COATED|ANODIZED", "small": "SMALL|MINI", "widget": "WIDGET|GADGET|BOLT"}


@query("SELECT year(o_orderdate) AS filed, count(*) AS n, " + ", ".join(f"CAST(sum(CASE WHEN regexp_matches(upper(p_type || ' ' || p_name), '{p}') THEN 1 ELSE 0 END) AS BIGINT) AS {k}" for k, p in CATEGORIES.items()) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def category_year_counts(spark, d):
    li, o = table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("filed"))
    words = F.upper(F.concat_ws(" ", "p_type", "p_name"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), *[words.rlike(r).cast("int").alias(k) for k, r in CATEGORIES.items()])
    return li.join(o, "l_orderkey").join(p, "l_partkey").groupBy("filed").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in CATEGORIES])


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_suppkey, s_nationkey, p_brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
  s AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM r GROUP BY ALL) SELECT s_nationkey AS country, p_brand AS class, round(sum(1.0 / n), 6) AS share FROM r JOIN s USING (l_orderkey) GROUP BY ALL""")
def fractional_counts(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("country"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("class"))
    return aggregate.fractional_counts(li.join(s, "l_suppkey").join(p, "l_partkey"), "l_orderkey", "l_suppkey", "country", "class").withColumn("share", F.round("share", 6))


@query("""WITH g AS (SELECT hrm_l2_id, count(*) AS n, count(DISTINCT person_name) AS u FROM leuven_name WHERE hrm_l2_id IS NOT NULL GROUP BY ALL)
  SELECT count(*) AS n_groups, max(n) AS max_size, avg(n) AS mean_size, CAST(sum(CASE WHEN u > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_over, avg(u) AS mean_names FROM g""")
def group_overaggregation(spark, d):
    g = table(spark, d, "leuven_name").where("hrm_l2_id IS NOT NULL").groupBy("hrm_l2_id").agg(F.count("*").alias("n"), F.countDistinct("person_name").alias("u"))
    return g.agg(F.count("*").alias("n_groups"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"), F.sum((F.col("u") > 1).cast("int")).alias("n_over"), F.avg("u").alias("mean_names"))


@query("SELECT Person, avg(patent_ct) AS mean_patents, avg(len(Class)) AS mean_codes, avg(len(Coauthor)) AS mean_coauthors FROM patstat_dedupe_input WHERE Person IS NOT NULL GROUP BY ALL")
def group_list_means(spark, d):
    size = lambda c: F.avg(F.when(F.col(c).isNotNull(), F.size(c)))
    return table(spark, d, "patstat_dedupe_input").where("Person IS NOT NULL").groupBy("Person").agg(F.avg("patent_ct").alias("mean_patents"), size("Class").alias("mean_codes"), size("Coauthor").alias("mean_coauthors"))


@query("""WITH a AS (SELECT s_nationkey AS country, count(*) AS na FROM supplier GROUP BY ALL), b AS (SELECT c_nationkey AS country, count(*) AS nb FROM customer GROUP BY ALL),
  f AS (SELECT coalesce(a.country, b.country) AS country, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM a FULL JOIN b ON a.country = b.country)
  SELECT country, na + nb AS n_sum, greatest(na - nb, 0) AS n_minus, greatest(na, nb) AS n_union, least(na, nb) AS n_both FROM f""")
def multiset_ops(spark, d):
    a, b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("country")), table(spark, d, "customer").select(F.col("c_nationkey").alias("country"))
    return aggregate.counters(a, b, "country")


@query(f"""WITH {L}, h AS (SELECT DISTINCT HAN_ID, Person_name_clean FROM han_name WHERE Person_name_clean IS NOT NULL)
  SELECT l.person_id, l.person_name, h.HAN_ID AS han_id, h.Person_name_clean AS han_name FROM (SELECT * FROM l WHERE person_name IS NOT NULL) l FULL JOIN h ON upper(l.person_name) = h.Person_name_clean""")
def outer_reference_map(spark, d):
    """Both registers side by side on equal names; both keys stay."""
    l_ = leuven(spark, d).where("person_name IS NOT NULL").select("person_id", "person_name", F.upper("person_name").alias("k"))
    h = table(spark, d, "han_name").select(F.col("HAN_ID").alias("han_id"), F.col("Person_name_clean").alias("han_name")).where("han_name IS NOT NULL").distinct()
    return l_.join(h, l_["k"] == h["han_name"], "full").select("person_id", "person_name", "han_id", "han_name")


@query("SELECT record_id FROM patstat_dedupe_input WHERE Person IN (SELECT person_id FROM leuven_name)")
def semi_join(spark, d):
    return table(spark, d, "patstat_dedupe_input").join(table(spark, d, "leuven_name").select(F.col("person_id").alias("Person")), "Person", "left_semi").select("record_id")


@query("SELECT record_id FROM patstat_dedupe_input p WHERE NOT EXISTS (SELECT 1 FROM leuven_name WHERE person_id = p.Person)")
def anti_join(spark, d):
    return table(spark, d, "patstat_dedupe_input").join(table(spark, d, "leuven_name").select(F.col("person_id").alias("Person")), "Person", "left_anti").select("record_id")


@query("SELECT l_orderkey AS appln_id, l_linenumber AS line, p_type AS code FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) ON l_partkey = p_partkey WHERE l_quantity > 45")
def left_join_codes(spark, d):
    p = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("code"))
    return table(spark, d, "lineitem").where("l_quantity > 45").join(p, "l_partkey", "left").select(F.col("l_orderkey").alias("appln_id"), F.col("l_linenumber").alias("line"), "code")


@query("SELECT p.appln_auth AS auth, count(*) AS n FROM documents d JOIN appln p USING (appln_id) WHERE d.text IS NOT NULL AND d.text <> '' GROUP BY ALL")
def count_texts_by_authority(spark, d):
    """Texts by authority; an application delivered twice counts its texts twice, as the join does."""
    return table(spark, d, "documents").where("text IS NOT NULL AND text <> ''").select("appln_id").join(table(spark, d, "appln").select("appln_id", F.col("appln_auth").alias("auth")), "appln_id").groupBy("auth").agg(F.count("*").alias("n"))


@query("SELECT n.class, n.country, num * 1.0 / div AS ratio FROM (SELECT l_orderkey AS k, p_brand AS class, s_nationkey AS country, count(*) AS num FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) n JOIN (SELECT l_orderkey AS k, count(*) AS div FROM lineitem GROUP BY ALL) d USING (k) WHERE num > 1")
def derived_table_join(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", "l_suppkey")
    p, s = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("class")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("country"))
    num = li.join(p, "l_partkey").join(s, "l_suppkey").groupBy("k", "class", "country").agg(F.count("*").alias("num")).where("num > 1")
    return num.join(li.groupBy("k").agg(F.count("*").alias("div")), "k").select("class", "country", (F.col("num") / F.col("div")).alias("ratio"))


@query("SELECT s_suppkey AS id, s_name AS company, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN ('FRANCE', 'GERMANY', 'JAPAN') OR s_acctbal >= 9000")
def in_list_filter(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"))
    t = table(spark, d, "supplier").join(F.broadcast(n), "s_nationkey")
    return t.where(F.col("country").isin("FRANCE", "GERMANY", "JAPAN") | (F.col("s_acctbal") >= 9000)).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("company"), "country")


@query("SELECT person_id, person_name FROM (SELECT DISTINCT * FROM leuven_name) WHERE regexp_matches(upper(person_name), 'GMBH|AKTIENGESELLSCHAFT') AND length(person_name) > 30")
def name_matches(spark, d):
    return leuven(spark, d).where(F.upper("person_name").rlike("GMBH|AKTIENGESELLSCHAFT") & (F.length("person_name") > 30)).select("person_id", "person_name")


@query("WITH g AS (SELECT hrm_l2_id, count(*) AS n_rows FROM leuven_name WHERE hrm_l2_id IS NOT NULL GROUP BY ALL), t AS (SELECT * FROM g ORDER BY n_rows DESC, hrm_l2_id LIMIT 10) SELECT hrm_l2_id, n_rows, (SELECT sum(n_rows) FROM t) / (SELECT sum(n_rows) FROM g) AS coverage FROM t")
def top_n_groups(spark, d):
    return select.top_groups(table(spark, d, "leuven_name"), "hrm_l2_id", 10)


@query("SELECT s_suppkey AS id, s_name AS name, 'supplier' AS source, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, 'customer', c_acctbal, c_mktsegment FROM customer")
def union_registers(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("source"), F.col("s_acctbal").alias("balance"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("source"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return select.union_all(s, c)


@query("SELECT Person FROM (SELECT Person FROM patstat_dedupe_input EXCEPT SELECT person_id FROM leuven_name)")
def set_difference(spark, d):
    return table(spark, d, "patstat_dedupe_input").select("Person").subtract(table(spark, d, "leuven_name").select("person_id"))


@query("SELECT country FROM (SELECT s_nationkey AS country FROM supplier WHERE s_acctbal > 5000 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)")
def block_key_intersection(spark, d):
    return table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("country")).intersect(table(spark, d, "customer").where("c_acctbal > 9000").select("c_nationkey"))


@query(f"""WITH {L}, g AS (SELECT person_id, coalesce('c' || CAST(hrm_l2_id AS VARCHAR), 'r' || CAST(person_id AS VARCHAR)) AS g FROM l), h AS (SELECT g, min(person_id) AS head FROM g GROUP BY g),
  i AS (SELECT g, row_number() OVER (ORDER BY head) - 1 + (SELECT count(DISTINCT hrm_l2_id) FROM l) AS cluster_id FROM h) SELECT person_id, cluster_id FROM g JOIN i USING (g)""")
def sequential_cluster_ids(spark, d):
    return select.sequential_ids(leuven(spark, d).select("person_id", "hrm_l2_id"), "person_id", "hrm_l2_id")


@query("""SELECT person_id, person_ctry_code, person_address FROM (SELECT person_id, person_ctry_code, person_address, row_number() OVER (PARTITION BY person_ctry_code ORDER BY md5(CAST(person_id AS VARCHAR)), person_id) AS k
  FROM (SELECT DISTINCT * FROM leuven_name) WHERE person_address <> '' AND person_ctry_code IS NOT NULL) WHERE k <= 200""")
def hash_sample(spark, d):
    """Two hundred addresses per country, the same on every run."""
    t = leuven(spark, d).where("person_address <> '' AND person_ctry_code IS NOT NULL").select("person_id", "person_ctry_code", "person_address")
    return select.hash_sample(t, "person_id", 200, "person_ctry_code")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE ('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 7))::BIGINT < CASE c_mktsegment WHEN 'BUILDING' THEN 134217728 WHEN 'MACHINERY' THEN 53687091 ELSE 0 END")
def stratified_sample(spark, d):
    return select.stratified_sample(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", {"BUILDING": 0.5, "MACHINERY": 0.2}, "c_custkey")


@query("""WITH r AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY md5(CAST(s_suppkey AS VARCHAR)), s_suppkey) - 1 AS i FROM supplier),
  d AS (SELECT id AS x, ('0x' || substr(md5(CAST(id AS VARCHAR) || '/' || k || '/11'), 1, 7))::BIGINT % (SELECT count(*) FROM r) AS i FROM r, unnest(range(1, 11)) AS u(k))
  SELECT DISTINCT least(x, id) AS id_a, greatest(x, id) AS id_b FROM d JOIN r USING (i) WHERE x <> id""")
def pair_sample(spark, d):
    return select.pair_sample(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")), "id")


@query("SELECT word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(person_name), ' ')) AS word FROM leuven_name) WHERE word <> '' GROUP BY word) ORDER BY n DESC, word LIMIT 25")
def most_common_words(spark, d):
    w = table(spark, d, "leuven_name").select(F.explode(F.split(F.lower("person_name"), " ")).alias("word")).where("word <> ''")
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(25)


@query("SELECT b.hrm_l2_id, count(DISTINCT p.person_name) AS n_ids FROM leuven_name p JOIN leuven_name b USING (person_id) WHERE b.hrm_l2_id IS NOT NULL AND p.person_name IS NOT NULL GROUP BY ALL HAVING count(DISTINCT p.person_name) > 1")
def compare_id_maps(spark, d):
    """Ids of one map that have several ids in another."""
    t = table(spark, d, "leuven_name").distinct()
    return select.compare_maps(t.select("person_id", "hrm_l2_id"), t.select("person_id", "person_name"), "person_id", "hrm_l2_id", "person_name")


@query("SELECT country, coalesce(src_s, 0) AS suppliers, coalesce(src_c, 0) AS customers FROM (SELECT s_nationkey AS country, count(*) AS src_s FROM supplier GROUP BY ALL) FULL JOIN (SELECT c_nationkey AS country, count(*) AS src_c FROM customer GROUP BY ALL) USING (country)")
def pivot_sources(spark, d):
    """Cast: sources as columns."""
    return union_registers_by_country(spark, d).groupBy("country").pivot("source", ["supplier", "customer"]).count().na.fill(0).select("country", F.col("supplier").alias("suppliers"), F.col("customer").alias("customers"))


def union_registers_by_country(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("country"), F.lit("supplier").alias("source"))
    return s.unionByName(table(spark, d, "customer").select(F.col("c_nationkey").alias("country"), F.lit("customer").alias("source")))


@query("SELECT sector, measure, value FROM (UNPIVOT (SELECT sector, count(*)::DOUBLE AS n_rows, count(DISTINCT person_id)::DOUBLE AS n_ids, count(hrm_l2_id)::DOUBLE AS n_level2 FROM leuven_name WHERE sector IS NOT NULL GROUP BY sector) ON n_rows, n_ids, n_level2 INTO NAME measure VALUE value)")
def melt_metrics(spark, d):
    g = table(spark, d, "leuven_name").where("sector IS NOT NULL").groupBy("sector").agg(F.count("*").cast("double").alias("n_rows"), F.countDistinct("person_id").cast("double").alias("n_ids"), F.count("hrm_l2_id").cast("double").alias("n_level2"))
    return g.unpivot("sector", ["n_rows", "n_ids", "n_level2"], "measure", "value")


@query("SELECT vec_id, label, round((n - avg(n) OVER ()) / stddev_pop(n) OVER (), 6) AS z FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS n FROM embeddings)")
def z_scores(spark, d):
    """Scaled with the population's standard deviation."""
    t = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("n"))
    m = t.agg(F.avg("n").alias("m"), F.stddev_pop("n").alias("s"))
    return t.join(F.broadcast(m)).select("vec_id", "label", F.round((F.col("n") - F.col("m")) / F.col("s"), 6).alias("z"))


@query("SELECT record_id, coalesce(Name, '') AS name, CASE WHEN Lat IS NULL OR isnan(Lat) THEN 0.0 ELSE Lat END AS lat, coalesce(patent_ct, 0) AS patent_ct FROM patstat_dedupe_input")
def fill_defaults(spark, d):
    t = table(spark, d, "patstat_dedupe_input")
    return t.select("record_id", F.coalesce("Name", F.lit("")).alias("name"), F.coalesce(F.nanvl("Lat", F.lit(0.0)), F.lit(0.0)).alias("lat"), F.coalesce("patent_ct", F.lit(0)).alias("patent_ct"))


@query("SELECT record_id, round(CASE WHEN Lat IS NULL OR isnan(Lat) THEN (SELECT avg(Lat) FROM patstat_dedupe_input WHERE NOT isnan(Lat)) ELSE Lat END, 6) AS lat FROM patstat_dedupe_input")
def mean_impute(spark, d):
    from pyspark.ml.feature import Imputer

    t = table(spark, d, "patstat_dedupe_input").select("record_id", "Lat")
    return Imputer(inputCols=["Lat"], outputCols=["lat_f"]).fit(t).transform(t).select("record_id", F.round("lat_f", 6).alias("lat"))


@query("SELECT Person, count(*) AS n FROM patstat_dedupe_input WHERE Person IS NOT NULL GROUP BY Person HAVING count(*) > 1")
def groups_of_several(spark, d):
    return table(spark, d, "patstat_dedupe_input").where("Person IS NOT NULL").groupBy("Person").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT record_id, Person, k FROM (SELECT record_id, Person, row_number() OVER (PARTITION BY Person ORDER BY patent_ct DESC, record_id) AS k FROM patstat_dedupe_input WHERE Person IS NOT NULL) WHERE k <= 3")
def top_three_records(spark, d):
    w = Window.partitionBy("Person").orderBy(F.desc("patent_ct"), "record_id")
    return table(spark, d, "patstat_dedupe_input").where("Person IS NOT NULL").select("record_id", "Person", "patent_ct").withColumn("k", F.row_number().over(w)).where("k <= 3").select("record_id", "Person", "k")


@query("WITH c AS (SELECT l_suppkey, p_brand, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey), a AS (SELECT l_suppkey AS person_id, string_agg(p_brand, ' ' ORDER BY p_brand) AS codes FROM (SELECT DISTINCT l_suppkey, p_brand FROM c) GROUP BY ALL) SELECT s_nationkey AS cluster_id, string_agg(codes, ' ' ORDER BY codes) AS codes FROM a JOIN supplier ON person_id = s_suppkey GROUP BY ALL")
def two_level_concat(spark, d):
    """Codes per person, then per cluster."""
    li, p = table(spark, d, "lineitem").select("l_suppkey", "l_partkey"), table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    a = li.join(p, "l_partkey").select(F.col("l_suppkey").alias("s_suppkey"), "p_brand").distinct().groupBy("s_suppkey").agg(F.array_join(F.array_sort(F.collect_list("p_brand")), " ").alias("codes"))
    return aggregate.concat_all(a.join(table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("cluster_id")), "s_suppkey"), ["cluster_id"], "codes", "codes", " ")


@query("""WITH t AS (SELECT CAST(s_acctbal AS DOUBLE) AS v FROM supplier WHERE s_acctbal IS NOT NULL ORDER BY v DESC LIMIT 100), l AS (SELECT list(v ORDER BY v DESC) AS vs FROM t),
  p AS (SELECT draw, vs[('0x' || substr(md5('7/' || draw || '/' || k), 1, 7))::BIGINT % len(vs) + 1] AS v FROM l, unnest(range(0, 1000)) AS a(draw), unnest(range(1, len(vs) + 1)) AS b(k)), m AS (SELECT avg(v) AS m FROM p GROUP BY draw)
  SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def bootstrap_ci(spark, d):
    out = aggregate.bootstrap_mean(table(spark, d, "supplier"), "s_acctbal")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])
