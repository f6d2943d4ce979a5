"""The surviving values of each group of duplicates by iterative truth discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.functions.similarity import haversine_km
from kinmesh.operators.skew import dealt_join, skew_join
from kinmesh.session import stored

NEAR_KM = 100.0
#: Rounds that truth discovery may take at most, its tolerance, and the reliability from which a claim counts as sound.
ROUNDS, TOLERANCE, SOUND = 50, 1e-3, 0.5
#: Share of all entities, and their least number, from which on a name counts as held by many.
MANY_SHARE, MANY = 0.005, 4

#: Features of records that claim nothing; they neither vote nor survive.
NOTHING = ["blank", "absent", "zero"]
# Words that stand where a name is missing.
FILLERS = ["anonym", "anonyme", "anonymous", "desconocido", "inconnu", "ismeretlen", "keine angabe", "n n", "n.n.", "n.a.", "n/a", "na", "nn", "nil", "no name", "none", "not available", "not known", "null", "onbekend", "okand", "sconosciuto", "tbd", "test", "unbekannt", "unknown", "unnamed", "without name", "xx", "xxx", "xxxx"]
# Legal forms; a name that ends with one is complete though a longer form may follow it.
LEGAL_FORMS = ["ab", "ag", "aktiebolag", "aktiengesellschaft", "bv", "corp", "gmbh", "inc", "kg", "lda", "limited", "llc", "ltd", "nv", "oy", "plc", "sa", "sarl", "sas", "sl", "spa", "srl"]
# Words that come between or after legal forms.
LEGAL_LINKS = ["&", "and", "cie", "co", "et", "fils", "sons", "und"]
LEGAL_END = r"\s(?:" + "|".join(LEGAL_FORMS) + r")\.?$"
LEGAL_TAIL = r"(?:\s(?:" + "|".join(LEGAL_FORMS + LEGAL_LINKS) + r")\.?)+$"
# Places where a name stops and an address begins.
TAIL = r"\s+(?:\S*\d.*|p\.?\s?o\.?\s?box.*|c/o.*)$"
DAMAGE = r"[_?�\u0080-\u009f�]|[ãÃâÂïÏ][\u0080-¿]|[^\p{L}\p{M}\p{N}\s.,&'’()/+-]"


def discover(claims: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, dict[str, float]]:
    """Truth discovery over (entity, source, value): the winning value of each entity, and the reliability of each source.

    ``source`` is a name or an array of names: a claim of several sources is as reliable as the least of them. Alternates
    between the sum of its claims' squared reliabilities as a value's vote (squared, so that what is often wrong fades in few rounds) and the share of votes that a source's claims get within
    their entities as its reliability, until no reliability moves by more than the tolerance; raises if ``rounds`` do not
    suffice. Ties go to the smaller value. Claims are first counted per (entity, value, source), so an entity with a third of all
    claims is only as wide as its distinct values. Only the reliabilities of the sources reach the driver.
    """
    source = F.col("source") if dict(claims.dtypes)["source"].startswith("array") else F.array("source")
    counted = claims.groupBy("entity", "value", source.alias("source")).agg(F.count("*").alias("n"))
    counted = stored(counted.groupBy("entity", "value").agg(F.collect_list(F.struct("source", "n")).alias("claims")), "claims")
    names = counted.select(F.explode("claims").alias("c")).select(F.explode("c.source").alias("s")).distinct().limit(1001).collect()
    if len(names) > 1000:
        raise ValueError("truth discovery takes at most 1000 sources")
    trust = dict.fromkeys(sorted(r["s"] for r in names), 1.0)

    def votes() -> DataFrame:
        vote = F.aggregate("claims", F.lit(0.0), lambda acc, c: acc + F.pow(reliability(c["source"], trust), F.lit(2.0)) * c["n"])
        return counted.withColumn("vote", vote)

    for _ in range(rounds):
        if not trust:
            break
        by = votes()
        total = by.groupBy("entity").agg(F.sum("vote").alias("total"))
        share = by.join(total, "entity").select("claims", F.coalesce(F.try_divide("vote", "total"), F.lit(0.0)).alias("share"))
        flat = share.select("share", F.explode("claims").alias("c")).groupBy("c.source").agg(F.sum(F.col("share") * F.col("c.n")).alias("w"), F.sum("c.n").alias("n"))
        mean = flat.select(F.explode("source").alias("s"), "w", "n").groupBy("s").agg((F.sum("w") / F.sum("n")).alias("t"))
        new = {r["s"]: r["t"] for r in mean.collect()}
        moved = max(abs(new[s] - trust[s]) for s in trust)
        trust = new
        if moved <= TOLERANCE:
            break
    else:
        raise RuntimeError(f"no agreement after {rounds} rounds")
    best = votes().groupBy("entity").agg(F.min(F.struct(-F.col("vote"), F.col("value"))).alias("b")).select("entity", F.col("b.value").alias("value"), (-F.col("b.col1")).alias("vote"))
    return best, trust


def reliability(source: Column, trust: dict[str, float]) -> Column:
    """The reliability of a claim of several sources: that of the least reliable one; unknown sources count 0."""
    if not trust:
        return F.lit(0.0)
    table = F.create_map(*[x for s, t in sorted(trust.items()) for x in (F.lit(s), F.lit(float(t)))])
    return F.array_min(F.transform(source, lambda s: F.coalesce(F.try_element_at(table, s), F.lit(0.0))))


def _following(texts: DataFrame) -> DataFrame:
    """(entity, s, kind, next_core, next_base): of every text of kind 0 (core) or 1 (base) the next greater core and base of its entity in binary order.

    All texts are ordered by ranges; each range looks at its own rows, and for its end at the first rows of the later
    ranges, of which there are as many as ranges. So an entity with a third of all names is cut like any other.
    """
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, 1)
    rows = stored(texts.distinct().repartitionByRange(parts, "entity", "s", "kind").withColumn("p", F.spark_partition_id()), "ordered")
    first = rows.groupBy("p").agg(*[F.min(F.when(F.col("kind") == k, F.struct("entity", "s"))).alias(n) for k, n in ((0, "core"), (1, "base"))]).collect()
    later, ahead = [], {"core": None, "base": None}
    for r in sorted(first, key=lambda r: -r["p"]):
        later.append((r["p"], ahead["core"], ahead["base"]))
        ahead = {n: r[n] or ahead[n] for n in ahead}
    kind = dict(rows.dtypes)["entity"]
    end = rows.sparkSession.createDataFrame(later, f"p int, later_core struct<entity:{kind},s:string>, later_base struct<entity:{kind},s:string>")
    w = Window.partitionBy("p").orderBy(F.desc("entity"), F.desc("s"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda k: F.last(F.when(F.col("kind") == k, F.struct("entity", "s")), ignorenulls=True).over(w)
    out = rows.withColumn("c", seen(0)).withColumn("b", seen(1)).join(F.broadcast(end), "p", "left")
    own = lambda c, later: F.when(F.coalesce(F.col(c), F.col(later))["entity"] == F.col("entity"), F.coalesce(F.col(c), F.col(later))["s"])
    return out.select("entity", "s", "kind", own("c", "later_core").alias("next_core"), own("b", "later_base").alias("next_base"))


def _shortened(given: DataFrame, named: DataFrame) -> DataFrame:
    """(entity, core) of the given names that are another shorter form of a name of the entity: some of its words in a row, its first and last word, or its other words as initials.

    A name is looked up by the word that the fewest names of its entity have; initials are no such word unless there is no other.
    """
    tokens = stored(named.select("entity", F.col("core").alias("of_core"), F.col("base").alias("of_base"), F.explode(F.array_distinct(F.split("core", " "))).alias("tok")), "tokens")
    counts = tokens.groupBy("entity", "tok").agg(F.count("*").alias("c"))
    words = F.split(F.when(F.col("base") != "", F.col("base")).otherwise(F.col("core")), " ")
    long = F.filter(words, lambda t: F.length(t) > 1 + t.endswith(".").cast("int"))
    key = given.select("entity", "core", "base", F.explode(F.array_distinct(F.when(F.size(long) > 0, long).otherwise(F.slice(words, 1, 1)))).alias("tok"))
    rare = key.join(counts.hint("merge"), ["entity", "tok"]).groupBy("entity", "core", "base").agg(F.min(F.struct("c", "tok")).alias("m")).where("m.c > 1").select("entity", F.col("m.tok").alias("tok"), "core", "base")
    met = dealt_join(rare, tokens, ["entity", "tok"]).where(F.col("core") != F.col("of_core"))

    def is_form(f: str, g: str) -> Column:
        x, y, t = F.col(f), F.col(g), F.split(g, " ")
        ends = F.concat_ws(" ", t[0], F.element_at(t, -1))
        initials = F.concat_ws(" ", t[0], F.array_join(F.transform(F.slice(t, 2, F.size(t)), lambda v: F.concat(F.substring(v, 1, 1), F.lit("."))), " "))
        inside = F.contains(F.concat(F.lit(" "), y, F.lit(" ")), F.concat(F.lit(" "), x, F.lit(" ")))
        return (x != "") & ~y.startswith(x) & (F.size(t) > 1) & (inside | (x == ends) | (x == initials))

    hit = is_form("core", "of_core") | is_form("core", "of_base") | is_form("base", "of_core") | is_form("base", "of_base")
    return met.where(hit).select("entity", "core").distinct()


def name_claims(df: DataFrame, entity: str, record: str, name: str) -> DataFrame:
    """(entity, record, value, source): each record's name with what can be seen of it; these features are the sources that make the claim.

    plain, or some of: blank (null, blank, without letters), filler (a word that stands for no name), damaged (foreign
    characters), extended (a number or what looks like an address follows), cut (another name of the entity begins with it),
    short (another shorter form of one), initial (its first word is an initial where the entity has it written out),
    open (ends with "and"), many (several other entities have the same name, as with words that stand for no name). Which of
    them a sound name can have is left to truth discovery.
    """
    norm = F.lower(F.trim(F.regexp_replace(F.col(name), r"(?U)\s+", " ")))
    rows = df.select(F.col(entity).alias("entity"), F.col(record).alias("record"), F.coalesce(norm, F.lit("")).alias("value"))
    rows = rows.withColumn("core", F.regexp_replace("value", TAIL, "")).withColumn("base", F.regexp_replace("core", LEGAL_TAIL, ""))
    blank, damaged = ~F.col("core").rlike(r"\p{L}"), F.col("value").rlike(DAMAGE)
    extended = (F.col("core") != F.col("value")) | F.col("core").rlike(r"\d")
    rows = rows.withColumn("blank", blank).withColumn("filler", F.col("value").isin(FILLERS)).withColumn("damaged", damaged).withColumn("extended", extended)
    rows = stored(rows, "names")
    named = stored(rows.where("NOT blank AND NOT filler").select("entity", "core", "base").distinct(), "named")
    head = F.split(F.col("core"), " ")[0]
    given = rows.where("NOT (blank OR filler OR damaged OR extended)").select("entity", "core", "base").distinct()
    given = given.withColumn("legal", F.col("core").rlike(LEGAL_END)).withColumn("initial", F.when(head.rlike(r"^\p{L}\.?$"), F.substring(head, 1, 1))).withColumn("open", F.col("core").rlike(r"\s(?:&|and|et|und)$"))
    given = stored(given, "given")
    texts = named.select("entity", F.col("core").alias("s"), F.lit(0).alias("kind")).unionByName(named.where("base <> ''").select("entity", F.col("base").alias("s"), F.lit(1).alias("kind")))
    after = _following(texts).where("kind = 0").select("entity", F.col("s").alias("core"), "next_core", "next_base")
    # behind a legal form only a longer name proper is another name; a longer legal form is not
    nxt = F.when(F.col("legal"), F.col("next_base")).otherwise(F.col("next_core"))
    cut = given.join(after.hint("merge"), ["entity", "core"]).where(F.coalesce(nxt.startswith(F.col("core")), F.lit(False))).select("entity", "core", F.lit(True).alias("cut"))
    short = _shortened(given.select("entity", "core", "base"), named).withColumn("short", F.lit(True))
    written = named.where(F.length(head) > 2).select("entity", F.substring("core", 1, 1).alias("initial")).distinct().withColumn("written", F.lit(True))
    forms = given.join(cut.hint("merge"), ["entity", "core"], "left").join(short.hint("merge"), ["entity", "core"], "left").join(written.hint("merge"), ["entity", "initial"], "left")
    forms = forms.select("entity", "core", "open", "cut", "short", F.col("written").alias("initial"))
    held = rows.select("value", "entity").distinct().groupBy("value").agg(F.count("*").alias("holders"))
    flagged = rows.join(forms.hint("merge"), ["entity", "core"], "left")
    bound = rows.agg(F.greatest(F.lit(MANY), F.count_distinct("entity") * F.lit(MANY_SHARE)).alias("bound"))
    flagged = skew_join(stored(flagged, "flagged"), held, "value").join(F.broadcast(bound)).withColumn("many", F.col("holders") >= F.col("bound"))
    seen = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in ("blank", "filler", "damaged", "extended", "cut", "short", "initial", "open", "many")]))
    return flagged.select("entity", "record", "value", F.when(F.size(seen) > 0, seen).otherwise(F.array(F.lit("plain"))).alias("source"))


def place_claims(df: DataFrame, towns: DataFrame, entity: str, record: str, lat: str, lng: str, country: str, km: float = NEAR_KM) -> DataFrame:
    """(entity, record, value, source): each record's position as text with what can be seen of it.

    absent (a part missing or not a number), zero (0/0), placed (within ``km`` of a town of the record's country) and
    elsewhere. Towns are copied to the cells of one degree of latitude and longitude that their circle touches; a position
    looks at the towns of its own cell only, once per distinct position and country, however many records have it.
    """
    la, ln = F.col(lat), F.col(lng)
    absent = la.isNull() | ln.isNull() | F.isnan(la) | F.isnan(ln)
    rows = df.select(F.col(entity).alias("entity"), F.col(record).alias("record"), F.upper(F.trim(country)).alias("cc"), la.alias("la"), ln.alias("ln"), absent.alias("absent"), ((la == 0) & (ln == 0)).alias("zero"))
    rows = stored(rows, "positions")
    spots = rows.where("NOT absent AND NOT zero AND cc IS NOT NULL").select("cc", "la", "ln").distinct().withColumn("ca", F.floor("la")).withColumn("cn", F.floor("ln"))
    dlat = km / 111.0
    width = F.lit(dlat) / F.greatest(F.cos(F.radians(F.least(F.abs("tla") + dlat, F.lit(89.0)))), F.lit(0.0175))
    t = towns.select(F.upper(F.trim("country")).alias("cc"), F.col("lat").alias("tla"), F.col("lng").alias("tln")).where("tla IS NOT NULL AND tln IS NOT NULL")
    t = t.withColumn("ca", F.explode(F.sequence(F.floor(F.col("tla") - dlat), F.floor(F.col("tla") + dlat))))
    t = t.withColumn("cn", F.explode(F.sequence(F.floor(F.col("tln") - width), F.floor(F.col("tln") + width)))).distinct()
    near = dealt_join(spots, t, ["cc", "ca", "cn"]).where(haversine_km(F.col("la"), F.col("ln"), F.col("tla"), F.col("tln")) <= km)
    placed = near.select("cc", "la", "ln").distinct().withColumn("placed", F.lit(True))
    source = F.when(F.col("absent"), "absent").when(F.col("zero"), "zero").when(F.col("placed"), "placed").otherwise("elsewhere")
    value = F.concat_ws(" ", F.round("la", 2).cast("string"), F.round("ln", 2).cast("string"))
    return rows.join(placed.hint("merge"), ["cc", "la", "ln"], "left").select("entity", "record", value.alias("value"), F.array(source).alias("source"))


def survivors(df: DataFrame, towns: DataFrame, entity: str = "Person", record: str = "record_id", name: str = "Name", lat: str = "Lat", lng: str = "Lng", country: str = "country", at: str = "loaded_at") -> DataFrame:
    """One row per entity with at least two records: person, name_record_id, geo_record_id, best_name, best_place.

    Truth discovery over all entities gives each source, that is each observable feature of a claim, its reliability; a claim
    has that of its least reliable feature. Per entity and field the value with the highest support survives: a value is
    supported by claims of at least half reliability, the latest of them first, since an entity may have changed (at equal
    times the smallest id; without a time last). The record ids are those of the survivors' claims, -1 if no claim is supported;
    then best_name and best_place are null. Rows without an entity are left out. ``record`` must be unique.
    """
    many = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("c")).where("c >= 2").select(entity)
    rows = stored(df.select(entity, record, name, lat, lng, country, at).join(many, entity, "left_semi"), "groups")
    when = rows.select(F.col(record).alias("record"), F.col(at).alias("at"))
    out = rows.select(F.col(entity).alias("entity")).distinct()
    for what, claims in (("name", name_claims(rows, entity, record, name)), ("place", place_claims(rows, towns, entity, record, lat, lng, country))):
        claims = stored(claims, what)
        _, trust = discover(claims.where(~F.arrays_overlap("source", F.array(*map(F.lit, NOTHING)))))
        kept = claims.where(reliability(F.col("source"), trust) >= SOUND)
        latest = F.struct(F.col("at").isNull(), -F.unix_micros(F.col("at").cast("timestamp")), F.col("record"))
        support = kept.join(when.hint("merge"), "record").groupBy("entity").agg(F.min(F.struct(latest.alias("o"), "record", "value")).alias("m"))
        out = out.join(support.select("entity", F.col("m.record").alias(f"{what}_record"), F.col("m.value").alias(f"best_{what}")).hint("merge"), "entity", "left")
    return out.select(
        F.col("entity").alias("person"), F.coalesce("name_record", F.lit(-1)).alias("name_record_id"), F.coalesce("place_record", F.lit(-1)).alias("geo_record_id"), "best_name", "best_place"
    )
