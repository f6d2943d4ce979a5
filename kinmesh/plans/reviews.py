"""Company joins, crosswalks, positions joined back, reference pairs and review tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmesh.functions import rules, text
from kinmesh.functions import similarity as sim
from kinmesh.operators import aggregate, blocking, evaluate, geocode, link, pairs, select
from kinmesh.plans import quality
from kinmesh.plans.relational import leuven, person_appln
from kinmesh.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


L = "l AS (SELECT DISTINCT * FROM leuven_name)"
PP = "p AS (SELECT record_id, Person, Name, Coauthor, Class, Lat, Lng, patent_ct, country, loaded_at FROM patstat_dedupe_input WHERE Person IS NOT NULL)"


def persons(spark, d):
    return table(spark, d, "patstat_dedupe_input").where("Person IS NOT NULL")


# companies


CODES = "string_agg(DISTINCT lower(trim(v)), ' ' ORDER BY lower(trim(v)))"


@query(f"""WITH {PP}, c AS (SELECT Person AS cluster_id, {CODES} AS ipc_codes FROM (SELECT Person, unnest(Class) AS v FROM p) WHERE v IS NOT NULL AND trim(v) <> '' GROUP BY Person),
  n AS (SELECT Person AS cluster_id, Name FROM (SELECT Person, Name, row_number() OVER (PARTITION BY Person ORDER BY record_id) AS k FROM p WHERE Name IS NOT NULL) WHERE k = 1)
  SELECT DISTINCT l.person_name AS company_name, l.sector, n.cluster_id, coalesce(ipc_codes, '') AS ipc_codes FROM n LEFT JOIN c USING (cluster_id) JOIN leuven_name l ON l.person_name = n.Name WHERE l.sector IS NOT NULL""")
def company_codes(spark, d):
    """Consolidated clusters joined to the company register by exact name: sector and class codes, each row once, rows that lack a sector left out."""
    p = persons(spark, d)
    codes = F.transform("Class", lambda v: F.lower(F.trim(v)))
    sets = aggregate.set_union(p, ["Person"], F.filter(codes, lambda v: v != ""), "codes", cap=1000).select("Person", F.array_join("codes", " ").alias("ipc_codes"))
    names = aggregate.first_value(p, ["Person"], "Name", ["record_id"], "Name").join(sets, "Person", "left")
    firms = table(spark, d, "leuven_name").select(F.col("person_name").alias("company_name"), "sector").where("company_name IS NOT NULL").na.drop().distinct()
    met = link.exact_names(firms, names, "company_name", "Name")
    return met.select("company_name", "sector", F.col("Person").alias("cluster_id"), F.coalesce("ipc_codes", F.lit("")).alias("ipc_codes")).distinct()


@query("""WITH k AS (SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey), c AS (SELECT l_suppkey, string_agg(p_type, '**' ORDER BY p_type) AS codes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
  SELECT s_name AS company_name, n_name AS country, replace(codes, '**', ' ') AS ipc_codes, s_suppkey AS cluster_id FROM k JOIN c ON s_suppkey = l_suppkey""")
def company_eight_digit(spark, d):
    """Companies of all countries with the whole codes of their applications, separators as spaces."""
    li, p = table(spark, d, "lineitem").select("l_suppkey", "l_partkey"), table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    codes = aggregate.concat_all(li.join(p, "l_partkey"), ["l_suppkey"], "p_type", "codes")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"))
    firms = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("company_name"), "s_nationkey").join(F.broadcast(n), "s_nationkey")
    return firms.join(codes, "l_suppkey").select("company_name", "country", text.delimiter_to_space(F.col("codes")).alias("ipc_codes"), F.col("l_suppkey").alias("cluster_id"))


@query("SELECT d.doc_id, string_agg(p_brand, '**' ORDER BY p_brand) AS codes FROM documents d JOIN lineitem ON appln_id = l_orderkey JOIN part ON l_partkey = p_partkey WHERE text_kind = 'abstract' AND d.text IS NOT NULL AND p_size IN (1, 2, 3, 5, 8, 13, 21, 34) GROUP BY d.doc_id")
def abstract_codes(spark, d):
    """Abstracts with the joined class codes of their application, for some schemes only."""
    docs = table(spark, d, "documents").where("text_kind = 'abstract' AND text IS NOT NULL").select("doc_id", "appln_id")
    p = table(spark, d, "part").where(F.col("p_size").isin(1, 2, 3, 5, 8, 13, 21, 34)).select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("appln_id"), "l_partkey")
    return aggregate.concat_all(docs.join(li, "appln_id").join(p, "l_partkey"), ["doc_id"], "p_brand", "codes")


@query("SELECT p.record_id, p.Name AS name, g.lat, g.lng FROM patstat_dedupe_input p LEFT JOIN (SELECT lower(country) AS country, min(lat) AS lat, min(lng) AS lng FROM gazetteer WHERE population = (SELECT max(population) FROM gazetteer x WHERE x.country = gazetteer.country) GROUP BY ALL) g ON lower(trim(p.country)) = g.country")
def capital_positions(spark, d):
    """Left join to one row per key: the right side is made unique first, so no row fans out."""
    g = table(spark, d, "gazetteer").select(F.lower("country").alias("cc"), "lat", "lng", "population")
    best = g.groupBy("cc").agg(F.max("population").alias("population")).join(g, ["cc", "population"]).groupBy("cc").agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    p = table(spark, d, "patstat_dedupe_input").select("record_id", F.col("Name").alias("name"), F.lower(F.trim("country")).alias("cc"))
    return p.join(F.broadcast(best), "cc", "left").select("record_id", "name", "lat", "lng")


# maps between ids


@query(f"""WITH {L}, h AS (SELECT DISTINCT hrm_l2_id, person_name FROM l WHERE hrm_l2_id IS NOT NULL AND person_name IS NOT NULL), m AS (SELECT hrm_l2_id FROM l WHERE hrm_l2_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT htm_l1) > 1)
  SELECT hrm_l2_id, count(*) AS n_names FROM h WHERE hrm_l2_id IN (SELECT hrm_l2_id FROM m) GROUP BY ALL HAVING count(*) > 2""")
def multimapped_names(spark, d):
    """Ids that stand against several ids of the other register, with more than two different names."""
    t = leuven(spark, d).where("hrm_l2_id IS NOT NULL")
    multi = select.compare_maps(t.select("person_id", "hrm_l2_id"), t.select("person_id", "htm_l1"), "person_id", "hrm_l2_id", "htm_l1").select("hrm_l2_id")
    names = t.where("person_name IS NOT NULL").select("hrm_l2_id", "person_name").distinct().join(multi, "hrm_l2_id", "left_semi")
    return names.groupBy("hrm_l2_id").agg(F.count("*").alias("n_names")).where("n_names > 2")


@query(f"""WITH {L}, {PP}, c AS (SELECT Person, min(record_id) AS cluster_id FROM p GROUP BY Person), h AS (SELECT DISTINCT HAN_ID AS han_id, Person_name_clean AS han_name FROM han_name WHERE Person_name_clean IS NOT NULL)
  SELECT l.person_id, l.person_name, c.cluster_id, h.han_id, h.han_name FROM (SELECT * FROM l WHERE person_name IS NOT NULL) l FULL JOIN c ON l.person_id = c.Person FULL JOIN h ON upper(replace(l.person_name, 'ß', 'ss')) = h.han_name""")
def crosswalk(spark, d):
    """The register, the clusters of its records and the harmonised names side by side; every side keeps its rows."""
    l_ = leuven(spark, d).where("person_name IS NOT NULL").select("person_id", "person_name", F.upper("person_name").alias("k"))
    c = persons(spark, d).groupBy("Person").agg(F.min("record_id").alias("cluster_id"))
    h = table(spark, d, "han_name").select(F.col("HAN_ID").alias("han_id"), F.col("Person_name_clean").alias("han_name")).where("han_name IS NOT NULL").distinct()
    both = l_.join(c, l_["person_id"] == c["Person"], "full")
    return both.join(h, both["k"] == h["han_name"], "full").select("person_id", "person_name", "cluster_id", "han_id", "han_name")


@query(f"""WITH {L}, g AS (SELECT hrm_level, count(*) AS n_ids, count(DISTINCT hrm_l2_id) AS n_groups FROM l GROUP BY ALL), s AS (SELECT l.hrm_level, avg(patent_ct) AS mean_patents, avg(len(Class)) AS mean_codes, avg(len(Coauthor)) AS mean_coauthors FROM l JOIN patstat_dedupe_input p ON p.Person = l.person_id GROUP BY ALL)
  SELECT CASE WHEN g.hrm_level IS NULL THEN 'none' ELSE 'level ' || g.hrm_level END AS part, n_ids, n_groups, round(mean_patents, 6) AS mean_patents, round(mean_codes, 6) AS mean_codes, round(mean_coauthors, 6) AS mean_coauthors FROM g LEFT JOIN s ON g.hrm_level IS NOT DISTINCT FROM s.hrm_level""")
def level_split(spark, d):
    """Ids split by the level at which they were matched, with mean patents, codes and coauthors of each part."""
    part = F.when(F.col("hrm_level").isNull(), "none").otherwise(F.concat(F.lit("level "), F.col("hrm_level").cast("string"))).alias("part")
    t = leuven(spark, d).select("person_id", "hrm_l2_id", part)
    size = lambda c: F.round(F.avg(F.when(F.col(c).isNotNull(), F.size(c))), 6)
    recs = persons(spark, d).select(F.col("Person").alias("person_id"), "patent_ct", "Class", "Coauthor")
    stats = t.join(recs, "person_id").groupBy("part").agg(F.round(F.avg("patent_ct"), 6).alias("mean_patents"), size("Class").alias("mean_codes"), size("Coauthor").alias("mean_coauthors"))
    return t.groupBy("part").agg(F.count("*").alias("n_ids"), F.countDistinct("hrm_l2_id").alias("n_groups")).join(stats, "part", "left")


@query(f"""WITH {L}, n AS (SELECT hrm_l2_id AS ref_id, htm_l1 AS cluster_id, person_name, count(*) AS n FROM l WHERE hrm_l2_id IS NOT NULL AND htm_l1 IS NOT NULL AND person_name IS NOT NULL GROUP BY ALL)
  SELECT ref_id, cluster_id, person_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY ref_id, cluster_id ORDER BY n DESC, person_name) AS k FROM n) WHERE k = 1""")
def canonical_names(spark, d):
    """The most frequent name of each pair of reference and cluster."""
    t = leuven(spark, d).where("hrm_l2_id IS NOT NULL AND htm_l1 IS NOT NULL").select(F.col("hrm_l2_id").alias("ref_id"), F.col("htm_l1").alias("cluster_id"), "person_name")
    return aggregate.mode_by(t, ["ref_id", "cluster_id"], "person_name", "name")


# pairs for training


_SAME = "(SELECT a.Person AS c, a.record_id AS a, b.record_id AS b FROM p a JOIN p b ON a.Person = b.Person AND a.record_id < b.record_id ORDER BY ALL LIMIT 50000)"


@query(f"""WITH {PP}, o AS (SELECT Person AS c, lead(Person) OVER (ORDER BY Person) AS d FROM (SELECT DISTINCT Person FROM p)),
  x AS (SELECT o.c, a.record_id AS a, b.record_id AS b FROM o JOIN p a ON a.Person = o.c JOIN p b ON b.Person = o.d ORDER BY ALL LIMIT 50000)
  SELECT a AS record_id_a, b AS record_id_b, 1.0::DOUBLE AS label FROM {_SAME} UNION ALL SELECT a, b, 0.0 FROM x""")
def reference_pairs(spark, d):
    """All pairs within reference clusters and across neighbouring ones, at most 50,000 of each."""
    return pairs.reference_pairs(table(spark, d, "patstat_dedupe_input"), "record_id", "Person")


@query("""WITH t AS (SELECT DISTINCT person_id, lower(person_name) AS v FROM leuven_name WHERE person_name IS NOT NULL), w AS (SELECT person_id AS r, unnest(list_distinct(string_split(v, ' '))) AS w FROM t), c AS (SELECT w FROM w WHERE w <> '' GROUP BY w HAVING count(*) > 1 AND count(*) <= greatest(2, 0.001 * (SELECT count(*) FROM t)))
  SELECT DISTINCT a.r AS person_id_a, b.r AS person_id_b FROM w a JOIN w b USING (w) JOIN c USING (w) WHERE a.r < b.r""")
def canopy_pairs(spark, d):
    """Records that meet at a word of high inverse document frequency."""
    t = leuven(spark, d).where("person_name IS NOT NULL").select("person_id", F.lower("person_name").alias("v")).distinct()
    return pairs.rare_token_pairs(t.select("person_id", F.split("v", " ").alias("w")), "person_id", "w", 0.001)


@query("SELECT rule, key, person_id FROM (SELECT 'first 6 of name' AS rule, substr(lower(person_name), 1, 6) AS key, person_id, count(*) OVER (PARTITION BY substr(lower(person_name), 1, 6)) AS n FROM (SELECT DISTINCT person_id, person_name FROM leuven_name WHERE length(person_name) >= 6)) WHERE n > 1 AND key <> ''")
def shared_blocks(spark, d):
    """The blocks of equal beginnings with more than one record."""
    t = leuven(spark, d).where("person_name IS NOT NULL").select("person_id", F.lower("person_name").alias("name")).distinct()
    return blocking.shared_blocks(blocking.block_map(t, "person_id", [blocking.prefix("name", 6)])).select("rule", "key", "person_id")


@query("SELECT s_nationkey AS country FROM supplier WHERE s_acctbal > 5000 UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def block_key_union(spark, d):
    return table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("country")).unionByName(table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("country"))).distinct()


@query("SELECT a.c_custkey AS id_a, b.c_custkey AS id_b, a.c_mktsegment = b.c_mktsegment AS same FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey AND a.c_acctbal > 8000 AND b.c_acctbal > 8000")
def same_or_not(spark, d):
    """The comparator of two equal values, on pairs of one country."""
    t = table(spark, d, "customer").where("c_acctbal > 8000").select("c_custkey", "c_nationkey", "c_mktsegment")
    p = t.toDF("id_a", "k", "x").join(t.toDF("id_b", "k", "y"), "k").where("id_a < id_b")
    return p.select("id_a", "id_b", (F.col("x") == F.col("y")).alias("same"))


_W = ", ".join(f"('{c}', {w})" for c, w in pairs.RECALL_WEIGHTS.items())


@query(f"""WITH w(country, weight) AS (VALUES {_W}), s AS (SELECT lower(trim(p.country)) AS country, m.score AS p FROM person_match m JOIN (SELECT Person, min(country) AS country FROM patstat_dedupe_input GROUP BY Person) p ON m.person_a = p.Person WHERE score IS NOT NULL AND country IS NOT NULL),
  b AS (SELECT country, CAST(floor(p * 1000) AS INT) AS bin, sum(p) AS hits, count(*) AS n FROM s GROUP BY ALL),
  r AS (SELECT country, bin, sum(hits) OVER (PARTITION BY country ORDER BY bin DESC) AS tp, sum(n) OVER (PARTITION BY country ORDER BY bin DESC) AS k, sum(hits) OVER (PARTITION BY country) AS a FROM b),
  f AS (SELECT r.country, bin, coalesce(weight, 1.5) AS weight, (1 + coalesce(weight, 1.5) * coalesce(weight, 1.5)) * tp / (k + coalesce(weight, 1.5) * coalesce(weight, 1.5) * a) AS f FROM r LEFT JOIN w ON r.country = w.country)
  SELECT country, CAST(weight AS DOUBLE) AS recall_weight, bin / 1000 AS threshold, round(f, 6) AS expected_f FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY round(f, 9) DESC, bin DESC) AS k FROM f) WHERE k = 1""")
def country_thresholds(spark, d):
    """The best threshold of each country under its own recall weight."""
    own = persons(spark, d).groupBy(F.col("Person").alias("person_a")).agg(F.lower(F.trim(F.min("country"))).alias("country"))
    s = table(spark, d, "person_match").where("score IS NOT NULL").select("person_a", F.col("score").alias("p")).join(own, "person_a").where("country IS NOT NULL")
    return pairs.country_thresholds(s, "country").withColumn("expected_f", F.round("expected_f", 6))


# positions joined back


@query(f"""WITH {L}, g AS (SELECT city, lower(country) AS cc, lat, lng, population FROM gazetteer WHERE NOT contains(city, ' ')),
  a AS (SELECT person_id, person_address, lower(trim(person_ctry_code)) AS cc FROM l WHERE person_address IS NOT NULL), w AS (SELECT DISTINCT person_address, i, string_split(person_address, ' ')[i] AS w FROM a, unnest(range(1, len(string_split(person_address, ' ')) + 1)) AS u(i)),
  h AS (SELECT person_address, city, lat, lng, row_number() OVER (PARTITION BY person_address ORDER BY i DESC, population DESC, cc) AS k FROM w JOIN g ON w.w = g.city)
  SELECT person_id, city, lat, lng FROM a LEFT JOIN (SELECT * FROM h WHERE k = 1) USING (person_address)""")
def geocoded_back(spark, d):
    """Distinct addresses are looked up for a town's name as written, the last one wins, and the position comes back to every row."""
    t = leuven(spark, d).where("person_address IS NOT NULL").select("person_id", "person_address")
    found = geocode.exact_town(t, "person_address", table(spark, d, "gazetteer"))
    return geocode.joined_back(t, found, "person_address").select("person_id", "city", "lat", "lng")


@query()
def geocoded_names_and_addresses(spark, d):
    """Each row's position: from its name (likeness 0.5), else from its address (0.8); the country is the code at the end of the address, else that of the row."""
    t = leuven(spark, d).select("person_id", "person_name", "person_address", "person_ctry_code")
    return geocode.preferred(t, "person_id", "person_name", "person_address", "person_ctry_code", table(spark, d, "gazetteer"))


@query()
def addresses_by_tiers(spark, d):
    """Name, address and position of names that hold their address: by number, by commas, by a town's name."""
    t = leuven(spark, d).where("person_name IS NOT NULL").select("person_id", F.lower("person_name").alias("name"), F.lower(F.trim("person_ctry_code")).alias("cc")).distinct()
    return geocode.tiered_addresses(t, "person_id", "name", "cc", table(spark, d, "gazetteer"))


@query(f"""WITH {L} SELECT person_id, coalesce(nullif(regexp_extract(lower(person_address), '[ \\t\\n\\r\\f\\v]([a-z]{{2}})$', 1), ''), lower(trim(person_ctry_code))) AS country, regexp_replace(regexp_replace(lower(person_address), '[ \\t\\n\\r\\f\\v][a-z]{{2}}$', ''), '[ \\t\\n\\r\\f\\v]+', '', 'g') AS rest FROM l WHERE person_address IS NOT NULL""")
def trailing_countries(spark, d):
    """The code at the end of an address, else the filing country, and the address without it and without white space."""
    t = leuven(spark, d).where("person_address IS NOT NULL")
    c = text.country_tail(F.lower("person_address"))
    return t.select("person_id", F.coalesce(c["country"], F.lower(F.trim("person_ctry_code"))).alias("country"), F.regexp_replace(c["rest"], r"\s+", "").alias("rest"))


@query(f"""WITH {L} SELECT person_id, CASE WHEN hit THEN array_to_string(parts[:-3], ',') ELSE person_name END AS name, CASE WHEN hit THEN trim(array_to_string(parts[-2:], ',')) ELSE person_address END AS address
  FROM (SELECT *, string_split(person_name, ',') AS parts, person_address IS NULL AND len(string_split(person_name, ',')) > 2 AND lower(person_name) LIKE '% ' || lower(trim(person_ctry_code)) AS hit FROM l WHERE person_name IS NOT NULL AND person_ctry_code IS NOT NULL)""")
def addresses_from_names(spark, d):
    """Rows without an address whose name ends with their country: what follows the second comma from the end is the address."""
    t = leuven(spark, d).where("person_name IS NOT NULL AND person_ctry_code IS NOT NULL")
    c = text.split_at_comma(F.col("person_name"))
    hit = F.col("person_address").isNull() & c["address"].isNotNull() & F.lower("person_name").endswith(F.concat(F.lit(" "), F.lower(F.trim("person_ctry_code"))))
    return t.select("person_id", F.when(hit, c["name"]).otherwise(F.col("person_name")).alias("name"), F.when(hit, c["address"]).otherwise(F.col("person_address")).alias("address"))


# review tables


@query("SELECT Person, Name FROM (SELECT Person, Name, row_number() OVER (PARTITION BY Person ORDER BY record_id) AS k FROM patstat_dedupe_input WHERE Person IS NOT NULL AND Name IS NOT NULL) WHERE k = 1")
def first_names(spark, d):
    """The first value per key in the order of records."""
    return aggregate.first_value(persons(spark, d), ["Person"], "Name", ["record_id"], "Name")


@query(f"WITH {PP}, s AS (SELECT country, CAST(sum(patent_ct) AS BIGINT) AS patents FROM p WHERE country IS NOT NULL GROUP BY ALL) SELECT country, patents, patents / (SELECT sum(patents) FROM s) AS share, (SELECT max(patents) / sum(patents) FROM s) AS max_share FROM s")
def patent_shares(spark, d):
    """Each country's part of all patents, and the largest part."""
    return aggregate.share_of_total(persons(spark, d).select("country", F.col("patent_ct").cast("long").alias("patents")), "country", "patents")


@query("SELECT year(o_orderdate) AS filed, n_name AS country, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def year_country_counts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("appln_id"), F.year("o_orderdate").alias("filed"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), "s_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"))
    return person_appln(spark, d).join(o, "appln_id").join(s, "person_id").join(F.broadcast(n), "s_nationkey").groupBy("filed", "country").agg(F.count("*").alias("n"))


@query("SELECT max(l_quantity) AS l_quantity, max(l_discount * 100) AS l_discount, max(l_tax * 100) AS l_tax, max(greatest(l_quantity, l_discount * 100, l_tax * 100)) AS overall FROM lineitem")
def column_maxima(spark, d):
    t = table(spark, d, "lineitem").select("l_quantity", (F.col("l_discount") * 100).alias("l_discount"), (F.col("l_tax") * 100).alias("l_tax"))
    return aggregate.max_over(t, ["l_quantity", "l_discount", "l_tax"])


_WORST = "b AS (SELECT DISTINCT person_id, person_name, htm_l1 AS cluster_id, hrm_l2_id AS ref_id FROM leuven_name WHERE htm_l1 IS NOT NULL AND hrm_l2_id IS NOT NULL)"
_SIDE = "SELECT '{w}' AS direction, CAST(g AS VARCHAR) AS group_id, n_others, name FROM (SELECT {a} AS g, count(DISTINCT {b}) AS n_others FROM b GROUP BY ALL ORDER BY n_others DESC, g LIMIT 5) JOIN (SELECT {a} AS g, min(person_name) AS name FROM b GROUP BY ALL) USING (g)"


@query(f"WITH {_WORST} {_SIDE.format(w='split', a='ref_id', b='cluster_id')} UNION ALL {_SIDE.format(w='clumped', a='cluster_id', b='ref_id')}")
def worst_cases(spark, d):
    """The references that are split most and the clusters that clump most, five of each, with a name."""
    t = leuven(spark, d).where("htm_l1 IS NOT NULL AND hrm_l2_id IS NOT NULL").select("person_id", "person_name", F.col("htm_l1").alias("cluster_id"), F.col("hrm_l2_id").alias("ref_id")).distinct()
    sides = []
    for what, a, b in (("split", "ref_id", "cluster_id"), ("clumped", "cluster_id", "ref_id")):
        worst = evaluate.worst_groups(t, a, b)
        names = t.join(F.broadcast(worst), a).groupBy(a, "n_others").agg(F.min("person_name").alias("name"))
        sides.append(names.select(F.lit(what).alias("direction"), F.col(a).cast("string").alias("group_id"), "n_others", "name"))
    return sides[0].unionByName(sides[1])


@query(f"""WITH b AS (SELECT DISTINCT person_id, upper(trim(person_ctry_code)) AS country, htm_l1 AS cluster_id, hrm_l2_id AS ref_id FROM leuven_name WHERE htm_l1 IS NOT NULL AND hrm_l2_id IS NOT NULL AND person_ctry_code IS NOT NULL), {quality._PT},
  r AS (SELECT country, ref_id, CAST(sum(patents) AS DOUBLE) AS a FROM b JOIN pt USING (person_id) GROUP BY ALL), c AS (SELECT country, cluster_id, CAST(sum(patents) AS DOUBLE) AS b FROM b JOIN pt USING (person_id) GROUP BY ALL),
  j AS (SELECT DISTINCT country, ref_id, cluster_id, a, c.b AS b FROM b JOIN r USING (country, ref_id) JOIN c USING (country, cluster_id) WHERE a IS NOT NULL AND c.b IS NOT NULL),
  k AS (SELECT country, a, b, rank() OVER (PARTITION BY country ORDER BY a) + (count(*) OVER (PARTITION BY country, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY country ORDER BY b) + (count(*) OVER (PARTITION BY country, b) - 1) / 2 AS rb FROM j)
  SELECT country, round(corr(a, b), 5) AS pearson, round(corr(ra, rb), 5) AS spearman FROM k GROUP BY country HAVING count(*) > 2 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0""")
def country_correlations(spark, d):
    """Patents by reference and by cluster, correlated within each country."""
    t = leuven(spark, d).where("htm_l1 IS NOT NULL AND hrm_l2_id IS NOT NULL AND person_ctry_code IS NOT NULL")
    t = t.select("person_id", F.upper(F.trim("person_ctry_code")).alias("country"), F.col("htm_l1").alias("cluster_id"), F.col("hrm_l2_id").alias("ref_id")).distinct()
    rows = t.join(quality.patents(spark, d), "person_id")
    a = rows.groupBy("country", "ref_id").agg(F.sum("patents").cast("double").alias("a"))
    b = rows.groupBy("country", "cluster_id").agg(F.sum("patents").cast("double").alias("b"))
    j = t.select("country", "ref_id", "cluster_id").distinct().join(a, ["country", "ref_id"]).join(b, ["country", "cluster_id"]).where("a IS NOT NULL AND b IS NOT NULL")
    size = j.groupBy("country").agg(F.count("*").alias("n"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb")).where("n > 2 AND sa > 0 AND sb > 0").select("country")
    out = evaluate.correlations(j.join(F.broadcast(size), "country"), "a", "b", "country")
    return out.select("country", F.round("pearson", 5).alias("pearson"), F.round("spearman", 5).alias("spearman"))


@query("SELECT CAST(regexp_extract(v, '\\((-?[0-9.]+), (-?[0-9.]+)\\)', 1) AS DOUBLE) AS r, CAST(regexp_extract(v, '\\((-?[0-9.]+), (-?[0-9.]+)\\)', 2) AS DOUBLE) AS p, v AS written FROM (SELECT DISTINCT '(' || round(l_discount, 2) || ', ' || round(l_tax, 2) || ')' AS v FROM (SELECT CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax FROM lineitem)) ORDER BY r DESC, p LIMIT 20")
def parsed_correlations(spark, d):
    """Correlations written as "(r, p)" read back as numbers, the largest first."""
    t = table(spark, d, "lineitem").select(F.round(F.col("l_discount").cast("double"), 2).cast("string").alias("a"), F.round(F.col("l_tax").cast("double"), 2).cast("string").alias("b")).distinct()
    v = F.concat(F.lit("("), "a", F.lit(", "), "b", F.lit(")"))
    number = lambda i: F.regexp_extract("written", r"\((-?[0-9.]+), (-?[0-9.]+)\)", i).cast("double")
    return t.select(v.alias("written")).select(number(1).alias("r"), number(2).alias("p"), "written").orderBy(F.desc("r"), "p").limit(20)


@query("WITH n AS (SELECT DISTINCT person_id, length(person_name) AS n FROM leuven_name WHERE person_name IS NOT NULL) SELECT min(n) AS min_value, max(n) AS max_value, avg(n) AS mean_value, median(n) AS median_value FROM n")
def length_summary(spark, d):
    t = leuven(spark, d).where("person_name IS NOT NULL").select("person_id", F.length("person_name").alias("n")).distinct()
    return aggregate.summary(t, "n")


@query("WITH n AS (SELECT DISTINCT person_id, length(person_name) AS n FROM leuven_name WHERE person_name IS NOT NULL) SELECT n, count(*) AS n_names FROM n GROUP BY ALL")
def name_length_counts(spark, d):
    return leuven(spark, d).where("person_name IS NOT NULL").select("person_id", F.length("person_name").alias("n")).distinct().groupBy("n").agg(F.count("*").alias("n_names"))


@query("WITH c AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(person_name), ' ')) AS word FROM leuven_name) WHERE word <> '' GROUP BY word), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, word) AS k FROM c WHERE n >= 3) SELECT word, n FROM r WHERE k > (SELECT count(*) FROM r) - ceil((SELECT count(*) FROM c) * 0.01)")
def rare_slice(spark, d):
    """The hundredth part of all words that ends the list of those with at least three places, most frequent first."""
    w = table(spark, d, "leuven_name").select(F.explode(F.split(F.lower("person_name"), " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    return select.tail_slice(w, "n", "word", 3, 0.01)


_H = "('0x' || substr(md5(CAST({c} AS VARCHAR)), 1, 7))::BIGINT"


@query(f"SELECT c_custkey, c_mktsegment FROM customer, unnest(range(0, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 0 ELSE 0 END + CASE WHEN {_H.format(c='c_custkey')} < CASE c_mktsegment WHEN 'BUILDING' THEN 134217728 WHEN 'MACHINERY' THEN 53687091 ELSE 0 END THEN 1 ELSE 0 END AS BIGINT))) AS u(i)")
def oversample(spark, d):
    """Two and a half times the rows of one source beside a fifth of another."""
    return select.stratified_sample(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", {"BUILDING": 2.5, "MACHINERY": 0.2}, "c_custkey")


@query("WITH g AS (SELECT hrm_l2_id, count(*) AS ref_ct FROM leuven_name WHERE hrm_l2_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1) SELECT hrm_l2_id, ref_ct FROM g ORDER BY md5(CAST(hrm_l2_id AS VARCHAR)), hrm_l2_id LIMIT 10000")
def down_sample(spark, d):
    """At most 10,000 references with more than one row, by hash."""
    g = table(spark, d, "leuven_name").where("hrm_l2_id IS NOT NULL").groupBy("hrm_l2_id").agg(F.count("*").alias("ref_ct")).where("ref_ct > 1")
    return select.hash_sample(g, "hrm_l2_id", 10_000)


@query("WITH r AS (SELECT Person, record_id, Name FROM patstat_dedupe_input WHERE Person IS NOT NULL), g AS (SELECT Person FROM r GROUP BY Person ORDER BY md5(CAST(Person AS VARCHAR)), Person LIMIT 50) SELECT Person, record_id, Name FROM r WHERE Person IN (SELECT Person FROM g)")
def random_groups(spark, d):
    """All records of fifty groups, for review."""
    r = persons(spark, d).select("Person", "record_id", "Name")
    return r.join(F.broadcast(select.hash_sample(r.select("Person").distinct(), "Person", 50)), "Person", "left_semi")


@query("SELECT record_id, Lat, Lng FROM patstat_dedupe_input WHERE Lat IS NOT NULL AND Lng IS NOT NULL AND Name IS NOT NULL")
def drop_incomplete(spark, d):
    return table(spark, d, "patstat_dedupe_input").select("record_id", "Lat", "Lng", "Name").na.drop(subset=["Name"]).where("Lat IS NOT NULL AND Lng IS NOT NULL").select("record_id", "Lat", "Lng")


@query("WITH a AS (SELECT record_id, patent_ct FROM patstat_dedupe_input), b AS (SELECT record_id, len(Class) AS codes FROM patstat_dedupe_input WHERE Class IS NOT NULL) SELECT a.record_id, patent_ct, codes FROM a LEFT JOIN b USING (record_id)")
def aligned_columns(spark, d):
    """Columns worked out apart and put side by side by record."""
    t = table(spark, d, "patstat_dedupe_input")
    return t.select("record_id", "patent_ct").join(t.where("Class IS NOT NULL").select("record_id", F.size("Class").alias("codes")), "record_id", "left")


# small functions


_PUNCT = "[!-/:-@\\[-`{-~]"


@query(f"""WITH n AS (SELECT DISTINCT person_id, lower(person_name) AS v FROM leuven_name WHERE person_name IS NOT NULL AND length(person_name) >= 2), t AS (SELECT person_id, v, string_split(v, ' ') AS w FROM n)
  SELECT person_id, array_to_string(list_sort(CASE WHEN len(list_filter(w, lambda x: length(x) >= 2)) > 0 THEN list_filter(w, lambda x: length(x) >= 2) ELSE w END), ' ') AS formatted, regexp_replace(v, '{_PUNCT}', ' ', 'g') AS spaced,
  regexp_replace(v, '[a-z]+$', 'reformat') AS reformatted, split_part(v, 'c/o', 1) AS before_co FROM t""")
def name_forms(spark, d):
    t = leuven(spark, d).where("person_name IS NOT NULL AND length(person_name) >= 2").select("person_id", F.lower("person_name").alias("v")).distinct()
    v = F.col("v")
    return t.select("person_id", text.format_name(v).alias("formatted"), text.translate_punctuation(v).alias("spaced"), text.reformat_file_name(v).alias("reformatted"), text.strip_co(v).alias("before_co"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(' ' || p_name || ' phd ', '\\b(?:ing|phd)\\b', '', 'g'), ' +', ' ', 'g')) AS name, replace(p_type, ' ', '**') AS joined, p_type AS apart FROM part")
def titles_and_delimiters(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_type", F.concat(F.lit(" "), "p_name", F.lit(" phd ")).alias("n"))
    joined = F.replace("p_type", F.lit(" "), F.lit("**"))
    return t.select("p_partkey", text.strip_titles(F.col("n")).alias("name"), joined.alias("joined"), text.delimiter_to_space(joined).alias("apart"))


@query("""WITH n AS (SELECT count(*) AS n FROM (SELECT DISTINCT p_name FROM part)), w AS (SELECT w, count(*) AS c FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM (SELECT DISTINCT p_name FROM part)) GROUP BY w)
  SELECT a.w AS word_a, b.w AS word_b, round(ln(floor((SELECT n FROM n) / greatest(a.c, b.c))), 6) AS weight FROM w a JOIN w b ON a.w < b.w AND substr(a.w, 1, 1) = substr(b.w, 1, 1)""")
def word_weights(spark, d):
    """The logarithm of all names by the larger count of two words of one first letter."""
    names = table(spark, d, "part").select("p_name").distinct()
    n = names.agg(F.count("*").alias("n"))
    w = names.select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("c")).withColumn("k", F.substring("w", 1, 1))
    p = w.toDF("word_a", "ca", "k").join(w.toDF("word_b", "cb", "k"), "k").where("word_a < word_b").join(F.broadcast(n))
    return p.select("word_a", "word_b", F.round(sim.inverse_max_idf(F.col("n"), F.col("ca"), F.col("cb")), 6).alias("weight"))


@query("""WITH h AS (SELECT DISTINCT upper(p_name) AS x FROM part), c AS (SELECT DISTINCT upper(p_type) AS y FROM part), s AS (SELECT x, y, len(list_intersect(list_distinct(string_split(x, '')), list_distinct(string_split(y, '')))) / len(list_distinct(list_concat(string_split(x, ''), string_split(y, '')))) AS s FROM h JOIN c ON substr(x, 1, 1) = substr(y, 1, 1))
  SELECT x AS name, y AS best, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y DESC) AS k FROM s WHERE s > 0.3) WHERE k = 1""")
def best_in_list(spark, d):
    """The text of a list whose letters are likest, above a threshold; ties go to the last in order."""
    t = table(spark, d, "part")
    x, y = t.select(F.upper("p_name").alias("name")).distinct(), t.select(F.upper("p_type").alias("best")).distinct()
    return sim.best_in_list(x, y, "name", "best", 0.3).withColumn("score", F.round("score", 6))


_HAN = "n AS (SELECT DISTINCT HAN_ID, Person_name_clean AS v FROM han_name WHERE Person_name_clean IS NOT NULL)"


def _nested(c: str, words) -> str:
    """SQL that replaces the texts of a word table in order."""
    for short, texts in words:
        c = f"regexp_replace({c}, '{'|'.join(t.replace('/', '/') for t in texts)}', '{short}', 'g')" if len(texts) > 1 else f"replace({c}, '{texts[0]}', '{short}')"
    return c


@query(f"WITH {_HAN} SELECT HAN_ID AS han_id, {_nested('v', rules.abbreviation_words())} AS name FROM n")
def abbreviated_names(spark, d):
    """The harmonised names under the whole table of abbreviations."""
    t = table(spark, d, "han_name").where("Person_name_clean IS NOT NULL").select(F.col("HAN_ID").alias("han_id"), F.col("Person_name_clean").alias("v")).distinct()
    return t.select("han_id", text.abbreviate(F.col("v")).alias("name"))


@query(f"WITH n AS (SELECT p_partkey, upper(p_name || ' ' || p_type) AS v FROM part) SELECT p_partkey, {_nested('v', rules.spelling_words())} AS british, {_nested(_nested('v', rules.spelling_words()), rules.spelling_words(back=True))} AS american FROM n")
def spelling_both_ways(spark, d):
    """American spellings in British ones under the whole table, and back."""
    t = table(spark, d, "part").select("p_partkey", text.us_uk(F.upper(F.concat_ws(" ", "p_name", "p_type"))).alias("british"))
    return t.select("p_partkey", "british", text.uk_us(F.col("british")).alias("american"))


def _chain_sql(c: str) -> str:
    """SQL of the name chain on text in upper case."""
    ands = ", ".join(f"'{w}'" for w in rules.AND_WORDS)
    c = f"array_to_string(list_transform(string_split({c}, ' '), lambda x, i: CASE WHEN i > 1 AND i < len(string_split({c}, ' ')) AND x IN ({ands}) THEN '&' ELSE x END), ' ')"
    c = f"regexp_replace({c}, '{rules.CONVERT_SGML[0][0]}', '', 'g')"
    c = f"regexp_replace({c}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')"
    c = _nested(_nested(c, rules.spelling_words()), rules.abbreviation_words())
    c = f"regexp_replace({c}, '[^ \\p{{L}}\\p{{M}}\\p{{N}}_.,;&-]', '', 'g')"
    for _ in (1, 2):  # neighbours share a letter, which one pass takes for one of them
        c = f"regexp_replace({c}, '([a-zA-Z0-9])[-.,;]([a-zA-Z0-9])', '\\1 \\2', 'g')"
    return f"regexp_replace(regexp_replace({c}, '([a-zA-Z0-9])[-.,;]( )', '\\1\\2', 'g'), '^[-.,;]|[-.,;]$', '', 'g')"


@query(f"WITH {_HAN}, c AS (SELECT HAN_ID AS han_id, {_chain_sql('upper(v)')} AS c FROM n) SELECT han_id, regexp_replace(c, '{rules.legal_pattern()}', '', 'g') AS name, array_to_string(regexp_extract_all(c, '{rules.legal_pattern()}'), '**') AS legal_ids FROM c")
def han_name_chain(spark, d):
    """The harmonised names under the whole chain of rules, with their legal forms apart."""
    t = table(spark, d, "han_name").where("Person_name_clean IS NOT NULL").select(F.col("HAN_ID").alias("han_id"), F.col("Person_name_clean").alias("v")).distinct()
    c = t.select("han_id", text.name_chain(F.upper("v")).alias("c"))
    return c.select("han_id", text.without_legal_ids(F.col("c")).alias("name"), text.legal_ids(F.col("c")).alias("legal_ids"))


def _ascii_sql(c: str) -> str:
    for k, v in text.ASCII.items():
        c = "replace({}, chr({}), '{}')".format(c, ord(k), v.replace("'", "''"))
    return c


_GAPS = "[ \\t\\n\\r\\f\\v]+"


@query(f"""WITH n AS (SELECT DISTINCT person_id, person_name AS v FROM leuven_name WHERE person_name IS NOT NULL), a AS (SELECT person_id, {_ascii_sql('v')} AS v FROM n)
  SELECT person_id, v AS ascii_name, lower(trim(regexp_replace(trim(regexp_replace(v, '{_GAPS}', ' ', 'g')), '^["'']+|["'']+$', '', 'g'))) AS plain, lower(regexp_replace(regexp_replace(v, '[,.]', ' ', 'g'), '{_GAPS}', ' ', 'g')) AS series FROM a""")
def ascii_forms(spark, d):
    """Names in ASCII, as the preprocessing and the series cleaner give them."""
    t = leuven(spark, d).where("person_name IS NOT NULL").select("person_id", F.col("person_name").alias("v")).distinct()
    v = F.col("v")
    return t.select("person_id", text.ascii_fold(v).alias("ascii_name"), text.preprocess(v).alias("plain"), text.ascii_series(v).alias("series"))


@query()
def cleaned_addresses(spark, d):
    """Addresses under diacritics, case and the chain of rules, legal forms left in."""
    t = leuven(spark, d).where("person_address IS NOT NULL").select("person_id", "person_address")
    done = t.select("person_address").distinct().withColumn("address", text.clean_full_name(F.col("person_address")))
    return t.join(done, "person_address").select("person_id", "address")


@query("SELECT person_a AS record_id_a, person_b AS record_id_b, score AS p FROM person_match WHERE score IS NOT NULL AND person_a IS NOT NULL AND person_b IS NOT NULL ORDER BY abs(score - 0.5), person_a, person_b, score LIMIT 20")
def uncertain_pairs(spark, d):
    """The pairs that a person should label next."""
    s = table(spark, d, "person_match").where("score IS NOT NULL AND person_a IS NOT NULL AND person_b IS NOT NULL")
    return pairs.most_uncertain(s.select(F.col("person_a").alias("record_id_a"), F.col("person_b").alias("record_id_b"), F.col("score").alias("p")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS code, encode(p_name) AS bytes, p_name AS back FROM part")
def byte_forms(spark, d):
    """Texts as bytes in UTF-8, and those bytes read as Latin-1 (the same for ASCII)."""
    t = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("code"), text.encode_utf8(F.col("p_name")).alias("b"))
    return t.select("code", F.col("b").alias("bytes"), text.decode_latin1(F.col("b")).alias("back"))
