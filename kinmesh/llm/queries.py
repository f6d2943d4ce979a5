"""Queries of the operators in this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.llm import addresses, components, languages, leaks, names, setjoin, survivor, tokenize, unify
from kinmesh.session import table


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    match = table(spark, sf_dir, "person_match").select(F.col("person_a").alias("a"), F.col("person_b").alias("b"))
    hand = table(spark, sf_dir, "leuven_name").where("hrm_level = 2").select("person_id", "hrm_l2_id")
    return match.unionByName(components.key_links(hand, "person_id", "hrm_l2_id"))


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivors of every Person with several records, with the best supported values."""
    return survivor.survivors(table(spark, sf_dir, "patstat_dedupe_input"), table(spark, sf_dir, "gazetteer"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_survivors(spark, sf_dir).select("person", "name_record_id", "geo_record_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of person_ids whose addresses denote the same location."""
    t = table(spark, sf_dir, "leuven_name").select("person_id", "person_address", "person_ctry_code")
    return addresses.same_location(t, "person_id", "person_address", table(spark, sf_dir, "gazetteer"), "person_ctry_code")


def p2_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person_id, location, n_notations): every person_id with its location's notation and how many other notations denote the same; as many rows as addresses, whatever their groups."""
    t = table(spark, sf_dir, "leuven_name").select("person_id", "person_address", "person_ctry_code")
    links, members = addresses.location_classes(t, "person_id", "person_address", table(spark, sf_dir, "gazetteer"), "person_ctry_code")
    ends = links.select(F.col("loc_a").alias("loc")).unionByName(links.select(F.col("loc_b").alias("loc"))).groupBy("loc").agg(F.count("*").alias("n"))
    return members.join(ends.hint("merge"), "loc", "left").select(F.col("id").alias("person_id"), F.col("loc").alias("location"), F.coalesce("n", F.lit(0)).alias("n_notations"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each person_id with the HAN_ID of the same person or organisation."""
    han, leuven = table(spark, sf_dir, "han_name"), table(spark, sf_dir, "leuven_name")
    out = names.linked(han, "HAN_ID", "Person_name_clean", "Person_ctry_code", leuven, "person_id", "person_name", "person_ctry_code")
    return out.select(F.col("HAN_ID").alias("han_id"), "person_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each linked id with the least id reachable from it."""
    return components.components(_links(spark, sf_dir)).select(F.col("node").alias("person_id"), F.col("component").alias("group_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of names that must change to reach the consistent form."""
    names = table(spark, sf_dir, "leuven_name").select("person_id", "person_name")
    return unify.changed(names, "person_name").select("person_id").where("person_id IS NOT NULL").distinct()


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivered name, once per person_id and name, in its consistent form and the form for comparisons."""
    return unify.forms(table(spark, sf_dir, "leuven_name").select("person_id", "person_name").distinct(), "person_name")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of different Persons with similar sets, for each of the two fields."""
    t = table(spark, sf_dir, "patstat_dedupe_input")
    parts = [setjoin.similar_records(t, "record_id", f, "Person").withColumn("set_field", F.lit(f)) for f in ("Coauthor", "Class")]
    return parts[0].unionByName(parts[1]).select("set_field", "record_id_a", "record_id_b")


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with a set of at least five values: its class of equal sets and how many other classes are similar, for each of the two fields."""
    t = table(spark, sf_dir, "patstat_dedupe_input")
    parts = [setjoin.record_classes(t, "record_id", f, "Person").withColumn("set_field", F.lit(f)) for f in ("Coauthor", "Class")]
    return parts[0].unionByName(parts[1]).select("set_field", "record_id", "class_id", "n_similar")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text decoded again from its ids."""
    return tokenize.decode(p8_ids(spark, sf_dir), "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each evaluation item that it gives away."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")
    return leaks.leaks(docs, "doc_id", "text", items, "item_id", "text")


def p9_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``p9_found``, with the longest verbatim run of words and where it begins in the document and in the item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")
    return leaks.matches(docs, "doc_id", "text", items, "item_id", "text")


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the documents that give away nothing."""
    docs = table(spark, sf_dir, "documents")
    return leaks.clean_corpus(docs.select("doc_id"), "doc_id", p9_found(spark, sf_dir))


def p10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with each language in it and a confidence value."""
    return languages.text_languages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every text with its language and a confidence value."""
    return languages.segment_languages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with a missing or wrong label and those in several languages, with each language present."""
    return languages.label_cases(p10_languages(spark, sf_dir), "doc_id")


QUERIES = {"p1_found": p1_found, "p1_survivors": p1_survivors, "p2_found": p2_found, "p2_locations": p2_locations, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_forms": p5_forms, "p7_found": p7_found, "p7_classes": p7_classes, "p8_ids": p8_ids, "p8_roundtrip": p8_roundtrip, "p9_found": p9_found, "p9_matches": p9_matches, "p9_clean": p9_clean, "p10_found": p10_found, "p10_languages": p10_languages, "p10_segments": p10_segments}

ORACLE = {
    "p4_found": """
      WITH RECURSIVE hand AS (SELECT DISTINCT person_id, hrm_l2_id FROM leuven_name WHERE hrm_level = 2 AND hrm_l2_id IS NOT NULL),
      links AS (SELECT person_a AS a, person_b AS b FROM person_match WHERE person_a <> person_b
                UNION SELECT person_id, min(person_id) OVER (PARTITION BY hrm_l2_id) FROM hand),
      edges AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
      reach AS (SELECT a AS person_id, a AS seen FROM edges UNION SELECT r.person_id, e.b FROM reach r JOIN edges e ON r.seen = e.a)
      SELECT person_id, min(seen) AS group_id FROM reach GROUP BY person_id""",
    "p7_found": " UNION ALL ".join(
        f"""
      (WITH sets AS (SELECT record_id, Person, list_distinct(list_filter(list_transform({f}, lambda v: lower(trim(v))), lambda v: v IS NOT NULL AND v <> '')) AS s FROM patstat_dedupe_input),
      big AS (SELECT * FROM sets WHERE len(s) >= 5), long AS (SELECT record_id, Person, len(s) AS n, unnest(s) AS v FROM big),
      pairs AS (SELECT a.record_id AS ra, b.record_id AS rb, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o
                FROM long a JOIN long b ON a.v = b.v AND a.record_id < b.record_id AND a.Person <> b.Person GROUP BY a.record_id, b.record_id)
      SELECT '{f}' AS set_field, ra AS record_id_a, rb AS record_id_b FROM pairs WHERE o * 10 >= 7 * (na + nb - o))"""
        for f in ("Coauthor", "Class")
    ),
    "p8_roundtrip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
