"""Cleaning, keys and similarities of names and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmesh.functions import rules, text
from kinmesh.functions import similarity as sim
from kinmesh.operators import blocking, geocode, link, pairs, select
from kinmesh.plans.relational import leuven
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


def names(spark, d):
    return leuven(spark, d).select("person_id", "person_name").where("person_name IS NOT NULL")


N = "n AS (SELECT person_id, person_name FROM (SELECT DISTINCT * FROM leuven_name) WHERE person_name IS NOT NULL)"
WS = "[ \\t\\n\\r\\f\\v]"
PLAIN = "lower(trim(regexp_replace(regexp_replace({c}, '[!-/:-@\\[-`{{-~]', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))"
UP = "upper(replace({c}, 'ß', 'ss'))"  # as Unicode has it; DuckDB keeps the letter


@query(f"WITH {N} SELECT person_id, upper(regexp_replace(replace(person_name, 'ß', 'ss'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS name, {PLAIN.format(c='person_name')} AS plain FROM n")
def clean_case_space(spark, d):
    t = names(spark, d)
    return t.select("person_id", text.stdize_case(text.single_space(F.col("person_name"))).alias("name"), text.punctuation_to_space(F.col("person_name")).alias("plain"))


_AND = ", ".join(f"'{w}'" for w in rules.AND_WORDS)


@query(f"""WITH {N}, t AS (SELECT person_id, string_split(regexp_replace({UP.format(c='person_name')}, '{WS}+', ' ', 'g'), ' ') AS w FROM n)
  SELECT person_id, array_to_string(list_transform(w, lambda x, i: CASE WHEN i > 1 AND i < len(w) AND x IN ({_AND}) THEN '&' ELSE x END), ' ') AS name FROM t""")
def clean_ampersand(spark, d):
    """The word for "and" of many languages between two spaces becomes &."""
    return names(spark, d).select("person_id", text.ampersand(text.single_space(F.upper("person_name"))).alias("name"))


@query()
def clean_diacritics(spark, d):
    return names(spark, d).select("person_id", text.remove_diacritics("person_name").alias("name"), text.ascii_fold(F.col("person_name")).alias("ascii_name"))


@query()
def clean_full_chain(spark, d):
    """Diacritics, case and the whole rule chain, then legal forms on their own: once per distinct name, joined back."""
    t = names(spark, d)
    done = t.select("person_name").distinct().select("person_name", text.clean_full_name(F.col("person_name")).alias("c"))
    done = done.select("person_name", text.without_legal_ids(F.col("c")).alias("name"), text.legal_ids(F.col("c")).alias("firm_legal_id"))
    return t.join(done, "person_name").select("person_id", "name", "firm_legal_id")


@query(f"WITH {N} SELECT person_id, " + UP.format(c="person_name") + " AS full_name, array_to_string(regexp_extract_all(regexp_replace(regexp_replace(" + UP.format(c="person_name") + ", '[^\\x00-\\x7F\\p{L}\\p{N}\\p{M}]', ' ', 'g'), '[^\\x00-\\x7F]', 'x', 'g'), '" + rules.legal_pattern() + "'), '**') AS legal_ids FROM n")
def legal_ids(spark, d):
    t = names(spark, d)
    return t.select("person_id", F.upper("person_name").alias("full_name"), text.legal_ids(F.upper("person_name")).alias("legal_ids"))


@query("""SELECT p_partkey, regexp_replace(p_type, '\\s|/', '', 'g') AS code, upper(substr(p_type, 1, 1)) AS section, substr(p_type, 1, 3) AS class3,
  CASE WHEN substr(CAST(p_size AS VARCHAR), 1, 1) IN ('2', '3', '4', '5') THEN CAST(p_size AS VARCHAR) ELSE substr(CAST(p_size AS VARCHAR), 1, 2) END AS sector FROM part""")
def ipc_normalise(spark, d):
    size = F.col("p_size").cast("string")
    return table(spark, d, "part").select(
        "p_partkey", text.ipc_clean(F.col("p_type")).alias("code"), F.upper(F.substring("p_type", 1, 1)).alias("section"), F.substring("p_type", 1, 3).alias("class3"),
        F.when(F.substring(size, 1, 1).isin("2", "3", "4", "5"), size).otherwise(F.substring(size, 1, 2)).alias("sector"),
    )


@query("SELECT record_id, array_to_string(list_sort(list_distinct(list_transform(string_split(array_to_string(Class, '**'), '**'), lambda v: lower(substr(v, 1, 4))))), '**') AS class FROM patstat_dedupe_input WHERE Class IS NOT NULL AND len(list_filter(Class, lambda v: v IS NOT NULL)) > 0")
def sorted_classes(spark, d):
    t = table(spark, d, "patstat_dedupe_input").where(F.size(F.filter("Class", lambda v: v.isNotNull())) > 0)
    return t.select("record_id", text.sort_class(F.array_join("Class", "**")).alias("class"))


@query(f"WITH {N} SELECT person_id, trim(regexp_replace(array_to_string(list_sort(list_filter(string_split(person_name, ' '), lambda t: length(t) >= 2)), ' '), '[,.]', '', 'g')) AS key FROM n")
def sorted_name_key(spark, d):
    return names(spark, d).select("person_id", text.sort_name(F.col("person_name")).alias("key"))


@query(f"""WITH {N}, p AS (SELECT person_id, person_name, string_split(person_name, ',') AS parts FROM n),
  s AS (SELECT person_id, CASE WHEN len(parts) > 1 AND len(list_filter(parts, lambda p: len(list_filter(string_split(p, ' '), lambda t: t <> '')) = 1)) = 0 THEN parts ELSE [person_name] END AS parts FROM p)
  SELECT person_id, i - 1 AS pos, parts[i] AS piece FROM s, unnest(range(1, len(parts) + 1)) AS u(i)""")
def split_multi_name(spark, d):
    """Fields that hold several names, one row per name."""
    return names(spark, d).select("person_id", F.posexplode(text.split_multi_names(F.col("person_name"))).alias("pos", "piece"))


@query("""WITH a AS (SELECT person_id, lower(person_address) AS addr FROM (SELECT DISTINCT * FROM leuven_name) WHERE person_address IS NOT NULL)
  SELECT person_id, regexp_extract(addr, '(?s)^(.*?[\\p{L}\\p{M}\\p{N}_])[ \\t\\n\\r\\f\\v]+[0-9]{2,}[ \\t\\n\\r\\f\\v]+[\\p{L}\\p{N}_]', 1) AS name, addr LIKE '% gb' AS is_gb,
  regexp_matches(right(addr, CAST(ceil(length(addr) / 2) AS INT)), '[0-9]{2,}') AS late_number FROM a WHERE regexp_matches(addr, '[\\p{L}\\p{M}\\p{N}_][ \\t\\n\\r\\f\\v]+[0-9]{2,}[ \\t\\n\\r\\f\\v]+[\\p{L}\\p{N}_]')""")
def parse_name_address(spark, d):
    t = leuven(spark, d).where("person_address IS NOT NULL").select("person_id", F.lower("person_address").alias("addr"))
    return t.where(text.parse_name(F.col("addr"))["address"].isNotNull()).select("person_id", text.parse_name(F.col("addr"))["name"].alias("name"), F.col("addr").endswith(" gb").alias("is_gb"), text.has_late_number(F.col("addr")).alias("late_number"))


@query("SELECT person_id, CASE WHEN regexp_extract(lower(person_address), '\\s([a-z]{2})$', 1) <> '' THEN regexp_extract(lower(person_address), '\\s([a-z]{2})$', 1) END AS country, regexp_replace(lower(person_address), '\\s[a-z]{2}$', '') AS rest FROM (SELECT DISTINCT * FROM leuven_name) WHERE person_address <> ''")
def country_tails(spark, d):
    t = leuven(spark, d).where("person_address <> ''").select("person_id", text.country_tail(F.lower("person_address")).alias("c"))
    return t.select("person_id", "c.country", "c.rest")


@query("SELECT person_id, CASE WHEN len(string_split(person_address, ',')) > 2 THEN array_to_string(string_split(person_address, ',')[:-3], ',') ELSE person_address END AS name, CASE WHEN len(string_split(person_address, ',')) > 2 THEN trim(array_to_string(string_split(person_address, ',')[-2:], ',')) END AS address FROM (SELECT DISTINCT * FROM leuven_name) WHERE person_address <> ''")
def comma_split(spark, d):
    """Split at the second comma from the end."""
    t = leuven(spark, d).where("person_address <> ''").select("person_id", text.split_at_comma(F.col("person_address")).alias("c"))
    return t.select("person_id", "c.name", "c.address")


@query(f"WITH {N} SELECT person_id, trim(regexp_replace(lower(person_name), ' +', ' ', 'g')) AS lower_name, split_part(lower(person_name), 'c/o', 1) AS before_co, replace(person_name, ' ', '**') AS starred, array_to_string(list_filter(range(0, CAST(greatest(length(lower(person_name)) - 1, 1) AS BIGINT)), lambda i: substr(lower(person_name), CAST(i + 1 AS BIGINT), 2) = 'an'), ' ') AS at FROM n WHERE length(person_name) >= 2")
def small_functions(spark, d):
    c = F.lower("person_name")
    return names(spark, d).where(F.length("person_name") >= 2).select("person_id", F.trim(F.regexp_replace(c, " +", " ")).alias("lower_name"), text.strip_co(F.col("person_name")).alias("before_co"), F.replace("person_name", F.lit(" "), F.lit("**")).alias("starred"), F.array_join(F.transform(text.positions(c, "an"), lambda i: i.cast("string")), " ").alias("at"))


SPELL_SQL = "SELECT p_partkey, replace(replace(upper(p_name), 'COLOR', 'COLOUR'), 'ALUMINUM', 'ALUMINIUM') AS name FROM part"


@query(SPELL_SQL)
def spelling(spark, d):
    """American spellings in British ones."""
    return table(spark, d, "part").select("p_partkey", text.us_uk(F.upper("p_name")).alias("name"))


# pairs of register names and harmonised names that share a word


def word_pairs(spark, d):
    """Pairs of names that share at least half of their words, exactly, however common the words are."""
    words = lambda c: F.filter(F.array_distinct(F.split(c, " ")), lambda w: w != "")
    a = names(spark, d).select("person_id", F.lower("person_name").alias("a")).distinct().withColumn("wa", words("a"))
    b = table(spark, d, "han_name").select(F.col("HAN_ID").alias("han_id"), F.lower("Person_name_clean").alias("b")).where("b IS NOT NULL").distinct().withColumn("wb", words("b"))
    return sim.similar_sets(a, b, "wa", "wb", 0.5).select("person_id", "han_id", "a", "b")


def spread(a, b, key, most=200_000):
    """Equi-join that stays spread over as many partitions as cores have use for, since few rows give many pairs; a key that would give over ``most`` pairs has the rows of ``a`` dealt into parts, and those of ``b`` repeated in each."""
    n = a.groupBy(key).agg(F.count("*").alias("na")).join(b.groupBy(key).agg(F.count("*").alias("nb")), key)
    n = n.select(key, F.least("na", F.ceil(F.col("na") * F.col("nb") / F.lit(most))).cast("long").alias("parts"))
    a = a.withColumn("part", F.xxhash64(*a.columns)).join(n, key).withColumn("part", F.pmod("part", "parts")).drop("parts")
    b = b.join(n, key).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    slots = a.sparkSession.sparkContext.defaultParallelism * 8  # a given number, else small inputs end in one task
    return a.repartition(slots, key, "part").join(b.repartition(slots, key, "part").hint("merge"), [key, "part"]).drop("part")


def all_word_pairs(spark, d):
    """Every pair of names with any word in common, once: at the least common word, so that no pairs are shuffled to be told apart."""
    words = lambda c: F.filter(F.array_distinct(F.split(c, " ")), lambda w: w != "")
    a = names(spark, d).select("person_id", F.lower("person_name").alias("a")).distinct().withColumn("wa", words("a")).withColumn("w", F.explode("wa"))
    b = table(spark, d, "han_name").select(F.col("HAN_ID").alias("han_id"), F.lower("Person_name_clean").alias("b")).where("b IS NOT NULL").distinct().withColumn("wb", words("b")).withColumn("w", F.explode("wb"))
    return spread(a, b, "w").where(F.col("w") == F.array_min(F.array_intersect("wa", "wb"))).select("person_id", "han_id", "a", "b")


WP = f"""{N}, a AS (SELECT DISTINCT person_id, lower(person_name) AS a, list_filter(list_distinct(string_split(lower(person_name), ' ')), lambda w: w <> '') AS wa FROM n),
  b AS (SELECT DISTINCT HAN_ID AS han_id, lower(Person_name_clean) AS b, list_filter(list_distinct(string_split(lower(Person_name_clean), ' ')), lambda w: w <> '') AS wb FROM han_name WHERE Person_name_clean IS NOT NULL),
  la AS (SELECT person_id, a, len(wa) AS n, unnest(wa) AS w FROM a), lb AS (SELECT han_id, b, len(wb) AS n, unnest(wb) AS w FROM b),
  wp AS (SELECT person_id, a, han_id, b, count(*) AS o, any_value(la.n) AS na, any_value(lb.n) AS nb FROM la JOIN lb USING (w) GROUP BY ALL HAVING 2 * count(*) >= any_value(la.n) + any_value(lb.n) - count(*))"""


@query(f"WITH {WP} SELECT person_id, han_id, o / (na + nb - o) AS jaccard FROM wp")
def word_jaccard(spark, d):
    """Pairs of names with at least half of their words in common."""
    words = lambda c: F.filter(F.array_distinct(F.split(c, " ")), lambda w: w != "")
    return word_pairs(spark, d).select("person_id", "han_id", sim.set_jaccard(words("a"), words("b")).alias("jaccard"))


@query(f"WITH {WP} SELECT person_id, han_id, len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, '')))) / len(list_distinct(list_concat(string_split(a, ''), string_split(b, '')))) AS jaccard FROM wp")
def char_jaccard(spark, d):
    """The likeness of letters of the pairs with at least half of their words in common."""
    return word_pairs(spark, d).select("person_id", "han_id", sim.char_jaccard(F.col("a"), F.col("b")).alias("jaccard"))


@query()
def word_jaccard_all(spark, d):
    """The likeness of words of all pairs with any word in common."""
    return all_word_pairs(spark, d).select("person_id", "han_id", sim.word_jaccard(F.col("a"), F.col("b")).alias("jaccard"))


@query()
def char_jaccard_all(spark, d):
    """The likeness of letters of all pairs with any word in common."""
    return all_word_pairs(spark, d).select("person_id", "han_id", sim.char_jaccard(F.col("a"), F.col("b")).alias("jaccard"))


@query()
def lcs_ratio_pairs(spark, d):
    return all_word_pairs(spark, d).select("person_id", "han_id", F.round(sim.indel_ratio("a", "b"), 6).alias("ratio"), F.round(sim.affine_gap_distance("a", "b"), 6).alias("affine"))


@query("""WITH s AS (SELECT record_id, list_distinct(list_filter(list_transform(Coauthor, lambda v: lower(trim(v))), lambda v: v IS NOT NULL AND v <> '')) AS s FROM patstat_dedupe_input), x AS (SELECT record_id, s FROM s WHERE len(s) > 0),
  l AS (SELECT record_id, unnest(s) AS v FROM x), i AS (SELECT v, ln((SELECT count(*) FROM x) / count(*)) AS idf FROM l GROUP BY v), w AS (SELECT record_id, v, idf FROM l JOIN i USING (v)), n AS (SELECT record_id, sqrt(sum(idf * idf)) AS norm FROM w GROUP BY ALL),
  c AS (SELECT a.record_id AS ra, b.record_id AS rb, sum(a.idf * b.idf) AS dot FROM w a JOIN w b ON a.v = b.v AND a.record_id < b.record_id GROUP BY ALL)
  SELECT ra AS record_id_a, rb AS record_id_b, round(dot / (na.norm * nb.norm), 6) AS cosine FROM c JOIN n na ON na.record_id = ra JOIN n nb ON nb.record_id = rb WHERE round(dot / (na.norm * nb.norm), 6) >= 0.5""")
def tfidf_cosine(spark, d):
    """All pairs of records whose lists of coauthors have a cosine of at least 0.5, whatever the frequency of what they share."""
    sets = pairs.records(table(spark, d, "patstat_dedupe_input")).where(F.size("coauthor") > 0).select("record_id", "coauthor")
    return sim.near_cosine(sets, "record_id", "coauthor", 0.5).withColumn("cosine", F.round("cosine", 6)).where("cosine >= 0.5")


@query()
def tfidf_cosine_all(spark, d):
    """The cosine of all pairs that share any value, whatever their cosine."""
    sets = pairs.records(table(spark, d, "patstat_dedupe_input")).where(F.size("coauthor") > 0).select("record_id", "coauthor")
    long = sets.select("record_id", F.explode("coauthor").alias("v"))
    idf = sim.document_frequency(sets, "coauthor").select(F.col("value").alias("v"), "idf")
    w = long.join(idf, "v")
    w = w.join(w.groupBy("record_id").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm")), "record_id")
    met = spread(w.select(F.col("record_id").alias("record_id_a"), "v", "idf", F.col("norm").alias("na")), w.select(F.col("record_id").alias("record_id_b"), "v", F.col("norm").alias("nb")), "v").where("record_id_a < record_id_b")
    dot = met.groupBy("record_id_a", "record_id_b", "na", "nb").agg(F.sum(F.col("idf") * F.col("idf")).alias("dot"))
    return dot.select("record_id_a", "record_id_b", F.round(F.coalesce(F.try_divide("dot", F.col("na") * F.col("nb")), F.lit(0.0)), 6).alias("cosine"))


@query("""WITH g AS (SELECT city, country, lat, lng FROM gazetteer) SELECT a.city AS city_a, b.city AS city_b, round(2 * 6371.0 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2), 1.0))), 4) AS km
  FROM g a JOIN g b ON a.country = b.country AND a.city < b.city""")
def haversine_pairs(spark, d):
    g = table(spark, d, "gazetteer").select("country", "city", "lat", "lng")
    p = g.toDF("country", "city_a", "la", "na").join(g.toDF("country", "city_b", "lb", "nb"), "country").where("city_a < city_b")
    return p.select("city_a", "city_b", F.round(sim.haversine_km(F.col("la"), F.col("na"), F.col("lb"), F.col("nb")), 4).alias("km"))


@query("SELECT record_id, round(1.0 / (abs(patent_ct - 3) + 1), 6) AS inverse_difference FROM patstat_dedupe_input WHERE patent_ct IS NOT NULL")
def count_distances(spark, d):
    return table(spark, d, "patstat_dedupe_input").where("patent_ct IS NOT NULL").select("record_id", F.round(sim.inverse_difference(F.col("patent_ct"), F.lit(3)), 6).alias("inverse_difference"))


# blocks and candidate pairs


@query(f"""WITH {N}, b AS (SELECT person_id, lower(person_name) AS name, substr(lower(person_name), 1, 8) AS block FROM n WHERE length(person_name) >= 8)
  SELECT a.person_id AS person_id_a, c.person_id AS person_id_b FROM b a JOIN b c ON a.block = c.block AND a.person_id < c.person_id
  WHERE len(list_intersect(list_distinct(string_split(a.name, '')), list_distinct(string_split(c.name, '')))) / len(list_distinct(list_concat(string_split(a.name, ''), string_split(c.name, '')))) > 0.8""")
def prefix_block_pairs(spark, d):
    """Pairs within the block of equal beginnings whose letters are alike."""
    t = names(spark, d).select("person_id", F.lower("person_name").alias("name"))
    p = blocking.candidates(blocking.block_map(t, "person_id", [blocking.prefix("name", 8)]), "person_id")
    p = p.join(t.toDF("person_id_a", "na"), "person_id_a").join(t.toDF("person_id_b", "nb"), "person_id_b")
    return p.where(sim.char_jaccard(F.col("na"), F.col("nb")) > 0.8).select("person_id_a", "person_id_b")


@query("""WITH g AS (SELECT p_partkey AS k, unnest(list_distinct(list_transform(range(0, CAST(length(p_name) - 3 AS BIGINT), 3), lambda i: substr(p_name, CAST(i + 1 AS BIGINT), 3)))) AS gram FROM part),
  b AS (SELECT DISTINCT p_name FROM part), h AS (SELECT p_name, unnest(list_distinct(list_transform(range(0, CAST(length(p_name) - 3 AS BIGINT), 3), lambda i: substr(p_name, CAST(i + 1 AS BIGINT), 3)))) AS gram FROM b)
  SELECT k AS p_partkey, p_name AS other, count(*) AS n_shared FROM g JOIN h USING (gram) GROUP BY ALL HAVING count(*) > 2""")
def ngram_overlap_join(spark, d):
    """Names that share more than two of the non-overlapping 3-grams."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    g = p.select("p_partkey", F.explode(text.ngrams(F.col("p_name"), 3, overlapping=False)).alias("gram"))
    h = p.select(F.col("p_name").alias("other")).distinct().withColumn("gram", F.explode(text.ngrams(F.col("other"), 3, overlapping=False)))
    return g.join(h, "gram").groupBy("p_partkey", "other").agg(F.count("*").alias("n_shared")).where("n_shared > 2")


@query(f"""WITH {N}, b AS (SELECT person_id, 'p' || substr(lower(person_name), 1, 4) AS k FROM n WHERE length(person_name) >= 4 UNION SELECT person_id, 'w' || w FROM (SELECT person_id, unnest(string_split(lower(person_name), ' ')) AS w FROM n) WHERE length(w) >= 6),
  c AS (SELECT k, count(*) AS n FROM b GROUP BY k) SELECT count(*) AS n_blocks, max(n) AS max_size, median(n) AS median_size, avg(n) AS mean_size FROM c""")
def block_summary(spark, d):
    t = names(spark, d).select("person_id", F.lower("person_name").alias("name"))
    return blocking.block_summary(blocking.block_map(t, "person_id", [blocking.prefix("name", 4), blocking.token("name", 6)]))


@query(f"""WITH {N}, t AS (SELECT DISTINCT person_id, lower(person_name) AS name FROM n), h AS (SELECT person_id, name, list_sort(list_transform(list_filter(string_split(name, ' '), lambda x: length(x) >= 3), lambda x: md5(x)))[:3] AS h FROM t),
  l AS (SELECT person_id, name, i AS place, h[i] AS h FROM h, unnest(range(1, len(h) + 1)) AS u(i)),
  m AS (SELECT a.person_id AS ra, b.person_id AS rb, a.name AS na, b.name AS nb, count(DISTINCT a.place) AS n_hashes FROM l a JOIN l b ON a.place = b.place AND a.h = b.h AND a.person_id < b.person_id GROUP BY ALL)
  SELECT ra AS person_id_a, rb AS person_id_b, len(list_intersect(list_distinct(string_split(na, '')), list_distinct(string_split(nb, '')))) / len(list_distinct(list_concat(string_split(na, ''), string_split(nb, '')))) AS similarity, n_hashes FROM m
  WHERE len(list_intersect(list_distinct(string_split(na, '')), list_distinct(string_split(nb, '')))) / len(list_distinct(list_concat(string_split(na, ''), string_split(nb, '')))) > 0.7""")
def multihash_pairs(spark, d):
    return link.multihash_pairs(names(spark, d).select("person_id", F.lower("person_name").alias("name")).distinct(), "person_id", "name")


def register_rows(spark, d):
    return leuven(spark, d).select(F.col("person_id").alias("id"), F.col("person_name").alias("name"), "person_address", F.upper(F.trim("person_ctry_code")).alias("country")).where("name IS NOT NULL AND country <> ''")


def registers(spark, d):
    """Both sides of a linkage: the register, with the position of the town in its address (0, 0 without one), and the records."""
    t = register_rows(spark, d)
    placed = geocode.joined_back(t, geocode.exact_town(t, "person_address", table(spark, d, "gazetteer")), "person_address")
    left = placed.select("id", "name", F.coalesce("lat", F.lit(0.0)).alias("lat"), F.coalesce("lng", F.lit(0.0)).alias("lng"), "country")
    return left, record_rows(spark, d)


def record_rows(spark, d):
    return table(spark, d, "patstat_dedupe_input").select(F.col("record_id").alias("id"), F.col("Name").alias("name"), F.col("Lat").alias("lat"), F.col("Lng").alias("lng"), "country").where("name IS NOT NULL")


@query()
def phonetic_topk_link(spark, d):
    return link.phonetic_links(*registers(spark, d))


@query()
def best_affine_link(spark, d):
    left, right = registers(spark, d)
    return link.best_affine(left, right, 8)


@query()
def theta_name_matches(spark, d):
    """Register names as near as 0.9 to a harmonised name."""
    a = names(spark, d).select("person_id", "person_name")
    b = table(spark, d, "han_name").select(F.col("HAN_ID").alias("person_id"), F.col("Person_name_clean").alias("person_name")).where("person_name IS NOT NULL")
    return pairs.theta_matches(a, b, "person_id", "person_name", 0.9)


def graph_pairs(spark, d):
    return table(spark, d, "person_match").where("score >= 0.8").select("person_a", "person_b")


@query("""WITH RECURSIVE e AS (SELECT person_a AS a, person_b AS b FROM person_match WHERE score >= 0.8 AND person_a <> person_b UNION SELECT person_b, person_a FROM person_match WHERE score >= 0.8 AND person_a <> person_b),
  r AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a) SELECT x AS record, min(y) AS cluster FROM r WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY x""")
def connected_components(spark, d):
    return blocking.connected(graph_pairs(spark, d), "person_a", "person_b")


@query("""WITH s AS (SELECT score AS p FROM person_match WHERE score IS NOT NULL), b AS (SELECT CAST(floor(p * 1000) AS INT) AS bin, sum(p) AS hits, count(*) AS n FROM s GROUP BY ALL),
  r AS (SELECT bin, sum(hits) OVER (ORDER BY bin DESC) AS tp, sum(n) OVER (ORDER BY bin DESC) AS k, (SELECT sum(p) FROM s) AS a FROM b)
  SELECT bin / 1000 AS threshold, round((1 + 2.25) * tp / (k + 2.25 * a), 9) AS expected_f FROM r ORDER BY expected_f DESC, threshold DESC LIMIT 1""")
def expected_threshold(spark, d):
    return pairs.expected_threshold(table(spark, d, "person_match").where("score IS NOT NULL").select(F.col("score").alias("p")), 1.5)


@query()
def geocode_ngrams(spark, d):
    return geocode.by_ngrams(leuven(spark, d), "person_address", "person_ctry_code", table(spark, d, "gazetteer"))


@query()
def geocode_sound(spark, d):
    return geocode.by_sound(leuven(spark, d), "person_address", "person_ctry_code", table(spark, d, "gazetteer"))


@query("""WITH g AS (SELECT city, lower(trim(country)) AS cc, trim(regexp_replace(lower(strip_accents(city)), '[^\\p{L}]+', ' ', 'g')) AS plain, lat, lng, population FROM gazetteer), one AS (SELECT * FROM g WHERE NOT contains(plain, ' ')),
  a AS (SELECT DISTINCT person_address AS address, string_split(trim(regexp_replace(lower(strip_accents(person_address)), '[^\\p{L}]+', ' ', 'g')), ' ') AS w FROM leuven_name WHERE person_address IS NOT NULL),
  h AS (SELECT address, city, lat, lng, row_number() OVER (PARTITION BY address ORDER BY i DESC, population DESC, city, cc) AS k FROM a, unnest(range(1, len(w) + 1)) AS u(i) JOIN one ON one.plain = w[i])
  SELECT a.address, coalesce(city, 'NONE') AS city, coalesce(lat, 0.0) AS lat, coalesce(lng, 0.0) AS lng FROM a LEFT JOIN (SELECT * FROM h WHERE k = 1) h ON a.address = h.address""")
def geocode_last_town(spark, d):
    return geocode.last_town(leuven(spark, d), "person_address", table(spark, d, "gazetteer"))


_LETTER, _GAP = "[\\p{L}\\p{M}\\p{N}_]", "[ \\t\\n\\r\\f\\v]+"
_SPLIT = f"(?s)^(.*?{_LETTER}){_GAP}[0-9]{{2,}}{_GAP}([\\p{{L}}\\p{{N}}_].*)$"


@query(f"""WITH a AS (SELECT person_id, lower(person_address) AS c, string_split(lower(person_address), ',') AS parts FROM (SELECT DISTINCT * FROM leuven_name) WHERE person_address IS NOT NULL)
  SELECT person_id, CASE WHEN regexp_matches(c, '{_SPLIT}') THEN regexp_extract(c, '{_SPLIT}', 1) WHEN length(c) > 60 AND len(parts) > 2 THEN array_to_string(parts[:-3], ',') ELSE c END AS name,
  CASE WHEN regexp_matches(c, '{_SPLIT}') THEN regexp_extract(c, '{_SPLIT}', 2) WHEN length(c) > 60 AND len(parts) > 2 THEN trim(array_to_string(parts[-2:], ',')) END AS address FROM a""")
def found_addresses(spark, d):
    a = leuven(spark, d).where("person_address IS NOT NULL").select("person_id", geocode.find_address(F.lower("person_address")).alias("f"))
    return a.select("person_id", "f.name", "f.address")


@query()
def geocode_rate(spark, d):
    """The share of distinct addresses with a town, per country."""
    got = geocode.by_ngrams(leuven(spark, d), "person_address", "person_ctry_code", table(spark, d, "gazetteer")).select("address", "country").withColumn("hit", F.lit(1))
    every = leuven(spark, d).where("person_address IS NOT NULL").select(F.col("person_address").alias("address"), F.lower(F.trim("person_ctry_code")).alias("country")).distinct()
    return every.join(got, ["address", "country"], "left").groupBy("country").agg(F.count("*").alias("n"), (F.count("hit") / F.count("*")).alias("rate"))


@query(f"""WITH {N}, p AS (SELECT person_id, person_name, string_split(person_name, ',') AS parts FROM n WHERE length(person_name) > 30),
  s AS (SELECT person_id, parts FROM p WHERE len(parts) > 1 AND len(list_filter(parts, lambda p: len(list_filter(string_split(p, ' '), lambda t: t <> '')) = 1)) = 0),
  r AS (SELECT person_id, i - 1 AS pos, trim(parts[i]) AS piece FROM s, unnest(range(1, len(parts) + 1)) AS u(i))
  SELECT person_id AS old_id, piece, (SELECT max(person_id) FROM n) + row_number() OVER (ORDER BY person_id, pos) AS new_id FROM r""")
def multi_name_rows(spark, d):
    """Long fields that hold several names become rows with new ids after the largest one."""
    t = names(spark, d)
    top = t.agg(F.max("person_id")).first()[0] or 0
    parts = text.split_multi_names(F.col("person_name"))
    rows = t.where((F.length("person_name") > 30) & (F.size(parts) > 1)).select(F.col("person_id").alias("old_id"), F.posexplode(parts).alias("pos", "piece"))
    return select.number_rows(rows.withColumn("piece", F.trim("piece")), ["old_id", "pos"], "new_id", top + 1).select("old_id", "piece", "new_id")


@query("SELECT DISTINCT person_id, CASE WHEN len(string_split(person_name, ',')) > 2 AND (person_address IS NULL OR person_address = '') THEN array_to_string(string_split(person_name, ',')[:-3], ',') ELSE person_name END AS name FROM leuven_name WHERE person_name IS NOT NULL")
def addresses_in_names(spark, d):
    """Names without an address that hold two commas give away what follows the second one from the end."""
    t = leuven(spark, d).where("person_name IS NOT NULL")
    lacks = F.col("person_address").isNull() | (F.col("person_address") == "")
    return t.select("person_id", F.when(lacks, text.split_at_comma(F.col("person_name"))["name"]).otherwise(F.col("person_name")).alias("name")).distinct()


@query(f"WITH {N} SELECT person_id, length(person_name) AS n_letters, len(list_filter(string_split(person_name, ','), lambda p: len(list_filter(string_split(p, ' '), lambda t: t <> '')) = 1)) > 0 AND contains(person_name, ',') AS has_single FROM n JOIN (SELECT DISTINCT person_id, sector FROM leuven_name) USING (person_id) WHERE length(person_name) > 40 AND coalesce(sector, '') NOT IN ('UNIVERSITY', 'GOV NON-PROFIT')")
def name_checks(spark, d):
    """Long names outside institutions, and whether a piece between commas is a single word."""
    t = leuven(spark, d).where((F.length("person_name") > 40) & ~F.coalesce("sector", F.lit("")).isin("UNIVERSITY", "GOV NON-PROFIT"))
    single = F.exists(F.split("person_name", ","), lambda p: F.size(F.filter(F.split(p, " "), lambda x: x != "")) == 1)
    return t.select("person_id", F.length("person_name").alias("n_letters"), (single & F.contains("person_name", F.lit(","))).alias("has_single"))


@query("SELECT s_suppkey AS id, n_name AS country_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 20")
def long_country(spark, d):
    """The long name of a country code, null if unknown."""
    n = table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country_name"))
    return table(spark, d, "supplier").join(F.broadcast(n), "s_nationkey", "left").select(F.col("s_suppkey").alias("id"), "country_name")


@query("""WITH g AS (SELECT DISTINCT p_name, substr(p_name, 1, 2) AS block FROM part), r AS (SELECT p_name, block, i FROM g, unnest(range(0, CAST(length(p_name) - 2 AS BIGINT))) AS u(i)), c AS (SELECT p_name, block, substr(p_name, CAST(i + 1 AS BIGINT), 2) AS gram FROM r GROUP BY ALL),
  n AS (SELECT p_name, sqrt(count(*)) AS norm FROM c GROUP BY p_name)
  SELECT a.p_name AS name_a, b.p_name AS name_b, round(count(*) / any_value(na.norm * nb.norm), 6) AS cosine FROM c a JOIN c b ON a.block = b.block AND a.gram = b.gram AND a.p_name < b.p_name JOIN n na ON na.p_name = a.p_name JOIN n nb ON nb.p_name = b.p_name GROUP BY a.p_name, b.p_name HAVING round(count(*) / any_value(na.norm * nb.norm), 6) > 0.6""")
def gram_cosine(spark, d):
    """Names within the block of the first two letters whose vectors of 2-grams are near."""
    t = table(spark, d, "part").select("p_name").distinct().withColumn("g", text.ngrams(F.col("p_name"), 2)).withColumn("norm", F.sqrt(F.size("g").cast("double")))
    long = t.select("p_name", F.substring("p_name", 1, 2).alias("block"), "norm", F.explode("g").alias("gram"))
    a, b = long.toDF("name_a", "block", "na", "gram"), long.toDF("name_b", "block", "nb", "gram")
    dot = a.join(b, ["block", "gram"]).where("name_a < name_b").groupBy("name_a", "name_b", "na", "nb").agg(F.count("*").alias("dot"))
    return dot.select("name_a", "name_b", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("cosine")).where("cosine > 0.6")


@query(f"""WITH {N}, t AS (SELECT DISTINCT person_id, substr(lower(person_name), 1, 6) AS key FROM n WHERE length(person_name) >= 6), c AS (SELECT key FROM t WHERE key <> '' GROUP BY key HAVING count(*) > 1 ORDER BY md5('first 6 of name/' || key), key LIMIT 100)
  SELECT person_id, 'first 6 of name' AS rule, key FROM t WHERE key IN (SELECT key FROM c)""")
def sampled_blocks(spark, d):
    """Records of a hundred blocks, for choosing a threshold."""
    t = names(spark, d).select("person_id", F.lower("person_name").alias("name"))
    return select.sampled_blocks(blocking.block_map(t, "person_id", [blocking.prefix("name", 6)]), ["rule", "key"], 100)


@query("SELECT l_orderkey AS appln_id, count(DISTINCT l_suppkey) AS persons, count(DISTINCT substr(p_type, 1, 3)) AS classes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def class_breadth(spark, d):
    li, p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("appln_id"), "l_suppkey", "l_partkey"), table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.substring("p_type", 1, 3).alias("c"))
    return li.join(p, "l_partkey").groupBy("appln_id").agg(F.countDistinct("l_suppkey").alias("persons"), F.countDistinct("c").alias("classes"))
