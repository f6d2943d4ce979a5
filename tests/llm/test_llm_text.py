"""Addresses, names, leaked passages and languages: examples, brute force and held-out accuracy."""

import random

import pytest
from pyspark.sql import functions as F

from kinmesh.llm import addresses, languages, leaks, names

TOWNS = ["Trorzördorf", "Gutânmcourt", "Bokruano", "Pustéhford", "Vamérti-sur-Lac"]


@pytest.fixture(scope="module")
def towns():
    return addresses.Towns(TOWNS)


@pytest.mark.parametrize(
    "text, want",
    [
        ("Brilvinilaplatz 37, Trorzördorf 10007", ("trorzordorf", "10007", "37", "brilvinila", "square")),
        ("BRILVINILA-PL. NR. 37; DE-10007 TRORZOERDORF (DE)", ("trorzordorf", "10007", "37", "brilvinila", "square")),
        ("c/o Max B. Muster, Werk 3, Brilvinilaplatz 37\nTrorzrödorf, Germany", ("trorzordorf", "", "37", "brilvinila", "square")),
        ("B.P. 492, 51, boul. de Denbriwanor, 2e étage, 13752 Gutanmcourt - FR", ("gutanmcourt", "13752", "51", "denbriwanor", "boulevard")),
        ("28035 Vamerti-sur-Lac; avenue Korvikraler 117; Bât. C", ("vamertisurlac", "28035", "117", "korvikraler", "avenue")),
        ("P.zza Manlalvilgor 176, Bokruano", ("bokruano", "", "176", "manlalvilgor", "square")),
        ("72 Dakerleki Ave Pustéhford", ("pustehford", "", "72", "dakerleki", "avenue")),
    ],
)
def test_parse_address(towns, text, want):
    assert addresses.parse(text, towns) == want


@pytest.mark.parametrize("text", [None, "", "  ", "?", "Germany", "Pustéhford (GB)", "Zone Industrielle"])
def test_no_street(towns, text):
    assert addresses.parse(text, towns) is None


def test_same_location(spark):
    rows = [(1, "Brilvinilaplatz 37, 10007 Trorzördorf"), (2, "37 Brilvinlapl., DE-10007"), (2, "37 Brilvinlapl., DE-10007"), (3, "Brilvinilaplatz 38, Trorzördorf"), (4, "Brilvinilastr. 37, Trorzördorf"), (5, "Brilvinilaplatz 37, Bokruano"), (6, None), (7, "Trorzördorf"), (8, "Trorzördorf"), (9, "brilvinilaplatz 37 werk 3 trorzoerdorf"), (None, "Brilvinilaplatz 37, Trorzördorf")]
    t = spark.createDataFrame(rows, "person_id long, person_address string").withColumn("stem", F.lit("x"))
    g = spark.createDataFrame([(x, "DE") for x in TOWNS], "city string, country string")
    assert sorted(tuple(r) for r in addresses.same_location(t, "person_id", "person_address", g).collect()) == [(1, 2), (1, 9), (2, 9)]
    assert addresses.same_location(t.limit(0), "person_id", "person_address", g).count() == 0


def test_same_location_by_tokens(spark):
    """Initials, exchanged and missing words of a street; other first names, initials and qualifiers are other streets."""
    places = ["Jean Moulin 12, Bokruano", "J. Moulin 12, Bokruano", "Moulin Jean 12, Bokruano", "Paul Moulin 12, Bokruano", "Karl Lueger Ring 5, Bokruano", "K. Lueger Ring 5, Bokruano", "Lueger Ring 5, Bokruano", "Alte Post 5, Bokruano", "Post 5, Bokruano"]
    t = spark.createDataFrame(list(enumerate(places)), "k long, a string")
    g = spark.createDataFrame([(x,) for x in TOWNS], "city string")
    assert sorted(tuple(r) for r in addresses.same_location(t, "k", "a", g).collect()) == [(0, 1), (0, 2), (1, 2), (4, 5), (4, 6), (5, 6)]


def test_equal_texts_with_a_street(spark):
    """Streets without a number, of two letters or in another script match by equal texts; towns and fillers don't."""
    places = ["Via Po 12, Bokruano", "VIA PO  12, Bokruano", "улица Ленина 5, Bokruano", "улица Ленина 5, Bokruano", "Hauptstraße, Bokruano", "Hauptstraße, Bokruano", "Bokruano 12", "Bokruano 12", "Zone Industrielle, Bokruano", "Zone Industrielle, Bokruano", "?", "?"]
    t = spark.createDataFrame(list(enumerate(places)), "k long, a string")
    g = spark.createDataFrame([(x,) for x in TOWNS], "city string")
    assert sorted(tuple(r) for r in addresses.same_location(t, "k", "a", g).collect()) == [(0, 1), (2, 3), (4, 5)]


def test_edits_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(7)))
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(7)))
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        assert addresses.edits(a, b, 9) == d[-1][-1] and addresses.edits(a, b, 1) == min(d[-1][-1], 2)


@pytest.mark.parametrize(
    "a, b, verdict",
    [
        ("DABRILKEKAL LABORATOIRES", "LABORATOIRES DABRILKEKAL S.A.S.", "same"), ("DABRILKEKAL LABORATOIRES", "Dabrilkekal Hydr. SAS", "other"), ("DABRILKEKAL LABORATOIRES", "Dabrilkekal Labos", "same"),
        ("EDWARD TRALNORWUMIL", "TRALNORWUMIL, TED", "same"), ("EDWARD TRALNORWUMIL", "Y. Tralnorwumil", "other"), ("EDWARD TRALNORWUMIL", "E. Tralnorwumil Dr.", "weak"), ("KRORPILTRERDUM OPTICS PLC", "KRORPIL TRERDUM OPT. PUBLIC LIMITED COMPANY", "same"),
        ("KRORPILTRERDUM OPTICS PLC", "Krorpiltrerdum P.L.C.", "weak"), ("ANTONIO KUNVOR", "Antonio Belgas", "other"),
    ],
)
def test_compare_names(a, b, verdict):
    got = names.compare(names.parse(a), names.parse(b))[0]
    assert got == verdict or (verdict == "other" and got == "")


def test_linked_names(spark):
    han = spark.createDataFrame([(1, "DABRILKEKAL LABORATOIRES", "FR"), (2, "DABRILKEKAL HYDRAULIQUE", "FR"), (3, "EDWARD TRALNORWUMIL", ""), (4, None, "FR"), (5, "", None)], "HAN_ID long, n string, c string")
    leu = spark.createDataFrame([(10, "Dabrilkekal Labos SAS", "FR"), (10, "Dabrilkekal Labos SAS", "FR"), (11, "Dabrilkekal", "FR"), (12, "Tralnorwumil, Ted", "IT"), (13, "Dabrilkekal Hydr.", "DE"), (14, None, "FR"), (15, " ", "FR"), (16, "x" * 3000, "FR")], "person_id long, n string, c string").withColumn("words", F.lit(1))
    got = sorted(tuple(r) for r in names.linked(han, "HAN_ID", "n", "c", leu, "person_id", "n", "c").collect())
    assert got == [(1, 10), (3, 12)]
    assert names.linked(han.limit(0), "HAN_ID", "n", "c", leu, "person_id", "n", "c").count() == 0


def test_linked_names_of_common_words(spark):
    """Over twenty reference names end and begin alike: slips inside, initials, nicknames and equal spellings are still found."""
    given = [f"{a}{b}" for a in "BCDFGKLMNPRT" for b in ("ORA", "IVO")]
    han = [(i, f"MULLENBACH {g}") for i, g in enumerate(given)] + [(100, "WILLIAM MULLENBACH"), (101, "HARTENBACH H"), (102, "HUBER H"), (103, "MULLENBACH X"), (104, "PETRONELLA HUBER")] + [(200 + i, f"HUBER {g}") for i, g in enumerate(given)]
    leu = [(1, "Bill Mulelnbach"), (2, "Huber H"), (3, "X. Muxlenbach"), (4, "Mullenbach Bora"), (5, "P. Huber"), (6, "Petronela Huber")]
    t = lambda rows, c: spark.createDataFrame([(i, n, "DE") for i, n in rows], f"{c} long, n string, c string")
    got = {r["k"]: r["r"] for r in names.linked(t(han, "r"), "r", "n", "c", t(leu, "k"), "k", "n", "c").collect()}
    assert got[1] == 100 and got[2] == 102 and got[3] == 103 and got[4] == 0 and got[6] == 104


def test_word_index_against_brute_force(spark):
    """No pair of words within the allowed edits is missed, whatever their length."""
    rng = random.Random(4)
    words = {"".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 24))) for _ in range(60)}
    for w in list(words):
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randrange(1, 3)):
                i = rng.randrange(len(v) - 1)
                v[i : i + 2] = rng.choice([[v[i + 1], v[i]], [v[i]], [v[i], "k", v[i + 1]], ["k", v[i + 1]]]) if len(v) > 3 else v[i : i + 2]
            words.add("".join(v))
    want = {(a, b) for a in words for b in words if abs(len(a) - len(b)) <= 2 and names.edits(a, b, m := names.allowed(min(len(a), len(b)))) <= m}
    t = spark.createDataFrame([(w, names._mask(w)[0]) for w in sorted(words)], "w string, m long")
    got = {tuple(r) for r in names._near(t, t).collect()}
    assert want <= got and len(want) > 300


def passage_words(rng, n):
    return ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(n)]


def test_words_meet_in_packed_parts(spark, monkeypatch):
    """The same pairs whatever the sizes of parts, none lost against brute force, and no row for each key of a word."""
    rng = random.Random(27)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randrange(3, 20))) for _ in range(60)}
    for w in list(words):
        for _ in range(6):
            i = rng.randrange(len(w) - 1)
            words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + "x" + w[i + 1 :], w[: i + 1] + "y" + w[i + 1 :], w[:i] + "z" + w[i + 1 : -1]]))
    t = spark.createDataFrame([(w, names._mask(w)[0]) for w in sorted(words) if len(w) > 2], "w string, m long")
    near = names._near(t, t)
    assert "Generate" not in near._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, near.collect()))
    assert len(set(got)) == len(got)
    for a in words:
        for b in words:
            if min(len(a), len(b)) > 2 and abs(len(a) - len(b)) <= 2 and addresses.edits(a, b, m := addresses.allowed(min(len(a), len(b)))) <= m:
                assert (a, b) in set(got)
    monkeypatch.setattr(names, "PART_KEYS", 200)
    monkeypatch.setattr(names, "MOST_PAIRS", 7)
    assert sorted(map(tuple, names._near(t, t).collect())) == got


def test_common_words_by_country(spark, monkeypatch):
    """Common words link the same names as when all are compared, whether countries are known or not."""
    given = ["hans", "hanz", "peter", "petra", "karl", "ulrich"]
    ref = [(i, f"{given[i % 6]} mullerstein{'abc'[i % 3]}", ["DE", "FR", None, "??"][i % 4]) for i in range(48)]
    df = [(i, f"{given[i % 6].title()} Mullerstein{'abc'[i // 6 % 3]}", [None, "DE", "fr", ""][i // 18 % 4]) for i in range(72)]
    a, b = spark.createDataFrame(ref, "r long, n string, c string"), spark.createDataFrame(df, "k long, n string, c string")
    link = lambda: sorted(map(tuple, names.linked(a, "r", "n", "c", b, "k", "n", "c").collect()))
    got = link()
    monkeypatch.setattr(names, "COMMON", 10**9)
    assert got == link() and len(got) > 20


def test_leaks(spark):
    rng = random.Random(6)
    item, other = passage_words(rng, 80), passage_words(rng, 60)
    fill = lambda n: " ".join(passage_words(rng, n))
    near = item[10:40]
    near[5] = "replaced"
    near.insert(15, "added")
    del near[22]
    docs = [
        (1, fill(50) + " " + " ".join(item[5:30]) + " " + fill(20)), (2, fill(50) + " " + " ".join(item[5:17])), (3, fill(10) + " <b>" + " ".join(near).upper() + "</b>. " + fill(10)), (4, None), (5, ""), (6, fill(3000)),
        (7, fill(20) + " " + " ".join(w if i % 4 else "zz" + w for i, w in enumerate(item[20:60]))), (8, " ".join(item[40:65]).replace(item[50], item[50][:2] + "-\n" + item[50][2:])), (9, " ".join(item + other)),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(7))
    e = spark.createDataFrame([(100, " ".join(item)), (101, " ".join(other)), (102, "too short"), (103, None)], "item_id long, text string")
    got = sorted(tuple(r) for r in leaks.leaks(d, "doc_id", "text", e, "item_id", "text").collect())
    assert got == [(1, 100), (3, 100), (8, 100), (9, 100), (9, 101)]
    assert leaks.leaks(d.limit(0), "doc_id", "text", e, "item_id", "text").count() == 0
    assert leaks.leaks(d, "doc_id", "text", e.limit(0), "item_id", "text").count() == 0
    found = leaks.leaks(d, "doc_id", "text", e, "item_id", "text")
    assert sorted(r["doc_id"] for r in leaks.clean_corpus(d, "doc_id", found).collect()) == [2, 4, 5, 6, 7]


def test_blocks_and_shards_change_nothing(spark, monkeypatch):
    """The same rows whatever the sizes of blocks and shards, and whether items are broadcast; copies and runs are told."""
    rng = random.Random(16)
    items = [passage_words(rng, 40) for _ in range(12)]
    docs = [(i, " ".join(passage_words(rng, 15) + items[i % 12][i % 7 : 12 + i % 25] + passage_words(rng, 15))) for i in range(60)]
    docs += [(100 + i, docs[13][1]) for i in range(4)]
    d = spark.createDataFrame(docs, "doc_id string, text string").repartition(2)
    e = spark.createDataFrame([(f"e{i}", " ".join(t)) for i, t in enumerate(items)], "item_id string, text string")
    seen = []
    for shard, block, most in ((4_000_000, 2_000_000, 64_000_000), (300, 500, 64_000_000), (1, 1, 0), (2000, 200, 0)):
        monkeypatch.setattr(leaks, "SHARD_CHARS", shard)
        monkeypatch.setattr(leaks, "BLOCK_CHARS", block)
        monkeypatch.setattr(leaks, "MOST_BROADCAST", most)
        seen.append(sorted(tuple(r) for r in leaks.matches(d, "doc_id", "text", e, "item_id", "text").collect()))
    assert all(s == seen[0] for s in seen)
    want = {(str(k), f"e{i % 12}", len(items[i % 12][i % 7 : 12 + i % 25]), 15, i % 7) for k, i in [(i, i) for i in range(60)] + [(100 + i, 13) for i in range(4)] if len(items[i % 12][i % 7 : 12 + i % 25]) >= 20}
    assert set(seen[0]) == want and len(want) > 20


def test_a_task_holds_one_shard_at_a_time(spark, monkeypatch):
    """Each stored shard is a row group of its own, and takes less than thrice its letters: memory doesn't follow the size of a partition."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(leaks, "SHARD_CHARS", 1_500_000)
    rng = random.Random(26)
    some = passage_words(rng, 5000)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(some) for _ in range(2000))) for i in range(500)], "doc_id long, text string").coalesce(1)
    shards = leaks.corpus_shards(docs, "doc_id", "text")
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in shards.inputFiles()]
    groups = [f.row_group(i) for f in files for i in range(f.num_row_groups)]
    assert len(groups) >= 4 and all(g.num_rows == 1 for g in groups)
    letters = sum(len(r["text"]) for r in docs.collect())
    assert sum(g.total_byte_size for g in groups) < 3 * letters


def test_words_against_a_plain_pattern():
    import html
    import re
    import unicodedata

    texts = ["A_b<i>c</i> d&amp;e\u00adf", "Öl-Straße №5 ½ ﬁ Ωmega’s", "漢字。かな ガ", "e\u0301\u0489x ٣٤ a\u200bb", "", None, "x\x00y", "İI ǅ"]
    for t in texts:
        u = html.unescape(re.sub("<[^<>]{1,200}>", " ", t)) if t else ""
        u = unicodedata.normalize("NFKD", u.replace("\u00ad", "").casefold())
        assert leaks.words(t) == re.findall(r"[^\W_]+", "".join(c for c in u if not unicodedata.combining(c)))


def test_suffix_array_against_scan():
    """The order is the full one, with copies and long repeats; ranges and longest matches are those of a scan."""
    rng = random.Random(8)
    texts = [[rng.choice(["ab", "abc", "b", "ca"]) for _ in range(60)] for _ in range(5)] + [["ab"] * 400, ["ab"] * 390 + ["b"], ["ü"]]
    texts.append(list(texts[0]))
    shard = leaks.Shard.of([" ".join(t).encode() for t in texts])
    suffixes = [(d, w, "".join(t[w:]).encode()) for d, t in enumerate(texts) for w in range(len(t))]
    got = [shard.suffix(p, 9999) for p in range(len(shard.order))]
    assert got == sorted(s for _, _, s in suffixes) and [shard.words_of(i) for i in range(len(texts))] == texts
    again = leaks.Shard(shard.letters, shard.begins, shard.first, shard.order)
    seeds = ["".join(texts[0][i : i + 3]).encode() for i in range(20)] + [b"zz", "".join(texts[1][:40]).encode(), b"ab" * 300, b"ab" * 500]
    lo, hi = again.ranges(seeds)
    for s, a, b in zip(seeds, lo, hi):
        places = {(int(again.text[p]), int(again.order[p] - again.first[again.text[p]])) for p in range(a, b)}
        assert places == {(d, w) for d, w, x in suffixes if x.startswith(s)}
    for s in seeds + [b"abcabz", b"q", b"cab" * 30]:
        assert again.longest(s)[0] == max(next((k for k in range(min(len(x), len(s))) if x[k] != s[k]), min(len(x), len(s))) for _, _, x in suffixes)


LANGS = {
    "en": "the wheel turns because the shaft is driven and the pump moves water through this old pipe while nobody looks at them".split(),
    "de": "das rad dreht sich weil die welle angetrieben wird und die pumpe bewegt wasser durch dieses alte rohr während niemand zusieht".split(),
    "fr": "la roue tourne parce que cet arbre est entraîné et la pompe déplace une eau dans ce vieux tuyau pendant que personne ne regarde".split(),
}


def sentence(rng, lang):
    return " ".join(rng.choice(LANGS[lang]) for _ in range(12)).capitalize() + "."


def test_languages(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(sentence(rng, lang) for _ in range(4)), lang if i % 9 else "fr") for i in range(150) for lang in [["en", "de", "fr"][i % 3]]]
    rows += [(900, sentence(rng, "en") + " " + sentence(rng, "de"), "en"), (901, None, "en"), (902, "", None), (903, "12 34 | 5", None), (904, sentence(rng, "de"), None), (905, sentence(rng, "fr"), "fr-CA"), (906, sentence(rng, "fr"), "??"), (907, sentence(rng, "en") + " („das alte Rohr“)", "EN")]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_langs", F.lit(5))
    found = languages.text_languages(t, "doc_id", "text", "lang")
    got = {(r["doc_id"], r["lang"]) for r in languages.label_cases(found, "doc_id").collect()}
    want = {(i, ["en", "de", "fr"][i % 3]) for i in range(0, 150, 9) if i % 3 != 2} | {(900, "en"), (900, "de"), (904, "de"), (906, "fr")}
    assert got == want
    assert languages.label_cases(languages.text_languages(t.limit(0).union(t.where("doc_id < 30")), "doc_id", "text", "lang"), "doc_id").count() > 0


def test_held_out_accuracy():
    rng = random.Random(5)
    train = {k: [languages.letters(sentence(rng, k)) for _ in range(60)] for k in LANGS}
    train["en"] += [languages.letters(sentence(rng, "de")) for _ in range(6)]  # wrong labels
    models = languages.train(train)
    held = [(k, languages.letters(sentence(rng, k))) for k in LANGS for _ in range(40)]
    right = sum(name == k for (k, _), (name, _) in zip(held, models.label([p for _, p in held])))
    assert right / len(held) > 0.95


def test_scores_against_a_plain_model():
    """The merged arrays give what the interpolation says, letter by letter, also for letters and contexts nobody has."""
    rng = random.Random(15)
    samples = {k: [languages.letters(sentence(rng, k)) for _ in range(12)] for k in LANGS}
    models = languages.Models(samples, calibrate=False)

    def chance(lang, gram):
        texts = [" " * languages.ORDER + p + " " for p in samples[lang]]
        grams = {n: [t[i - n + 1 : i + 1] for t in texts for i in range(languages.ORDER, len(t))] for n in range(1, languages.ORDER + 1)}
        counts = {languages.ORDER: {g: grams[languages.ORDER].count(g) for g in set(grams[languages.ORDER])}}
        for n in range(languages.ORDER - 1, 0, -1):
            counts[n] = {}
            for g in counts[n + 1]:
                counts[n][g[1:]] = counts[n].get(g[1:], 0) + 1

        def p(g):
            if not g:
                return models.floor
            own = {x: c for x, c in counts[len(g)].items() if x[:-1] == g[:-1]}
            if not own:
                return p(g[1:])
            total = sum(own.values())
            return max(own.get(g, 0) - languages.DISCOUNT, 0) / total + languages.DISCOUNT * len(own) / total * p(g[1:])

        return p(gram)

    import math

    for text in ("das rad the", "qq weil", "é"):
        padded = " " * languages.ORDER + text + " "
        for k, lang in enumerate(models.langs):
            bits = [min(-math.log2(max(chance(lang, padded[i - languages.ORDER + 1 : i + 1]), 1e-9)), languages.MOST_BITS) for i in range(languages.ORDER, len(padded))]
            assert abs(sum(bits) / len(bits) - models.score([text])[0, k]) < 1e-4


def test_confidence_on_held_out_pieces():
    """Pieces of a few letters of sentences that nobody trained on: the mean confidence is near the share that is right."""
    rng = random.Random(25)
    models = languages.train({k: [languages.letters(sentence(rng, k)) for _ in range(120)] for k in LANGS})
    held = [(k, languages.letters(sentence(rng, k))[a : a + 10]) for k in LANGS for _ in range(150) for a in (0, 20)]
    bits = models.score([p for _, p in held])
    shares = models._shares(bits, languages.np.array([len(p) for _, p in held]), models.heat)
    right = sum(models.langs[b] == k for (k, _), b in zip(held, bits.argmin(axis=1))) / len(held)
    assert abs(shares.max(axis=1).mean() - right) < 0.1


def test_training_sample_is_bounded(spark):
    """The least hashes of all, as many as asked, whatever the copies and the partitions."""
    rows = spark.createDataFrame([(i, "en" if i % 3 else None, 0, f"sentence number {i % 700}") for i in range(4000)], "key long, code string, pos int, plain string")
    a, b = languages.training_sample(rows.repartition(9), 50), languages.training_sample(rows.coalesce(1), 50)
    assert a == b and len(a["en"]) == 50 == len(set(a["en"]))
    assert len(languages.training_sample(rows, 5000)["en"]) == 700 and languages.training_sample(rows.limit(0), 5) == {}


def test_texts_without_language(spark):
    t = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "12 | 5", "??")], "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in languages.text_languages(t, "doc_id", "text", "lang").select("doc_id", "lang", "n_langs", "given").collect()) == [(1, None, 0, "en"), (2, None, 0, None), (3, None, 0, None)]
    assert languages.segment_languages(t, "doc_id", "text", "lang").count() == 0


def test_labels(spark):
    t = spark.createDataFrame([("EN",), ("deu",), ("fr-CA",), ("??",), ("",), (None,), ("en_US",)], "l string")
    assert [r[0] for r in t.select(languages.label(F.col("l"))).collect()] == ["en", "de", "fr", None, None, None, "en"]


def test_neighbouring_localities_and_countries(spark):
    """A postcode that several towns share asks the one that answers; the hot location and towns of one name in two countries."""
    rows = [(1, "Brilvinilaplatz 37, 10001 Trorzördorf", "DE"), (2, "Korvikraler weg 4, 10002 Bokruano", "DE"), (3, "Korvikraler weg 4, 10002", "DE"), (4, "Brilvinilaplatz 37, 10003", "DE"), (5, "Brilvinilaplatz 37", "DE"), (6, "BRILVINILAPLATZ  37", "DE")]
    rows += [(10, "Rue Dakerleki 7, Twin", "FR"), (11, "Rue Dakerleki 7, Twin", "BE"), (12, "R. Dakerleki 7, Twin", "fr"), (13, "Rue Dakerleki 7, Twin", None)]
    rows += [(100 + i, "Manlalvilgor Avenue 9, Bokruano", "DE") for i in range(40)]
    t = spark.createDataFrame(rows, "k long, a string, c string")
    g = spark.createDataFrame([(x, "DE") for x in TOWNS] + [("Twin", "FR"), ("Twin", "BE")], "city string, country string")
    got = {tuple(r) for r in addresses.same_location(t, "k", "a", g, "c").collect()}
    hot = {(100 + i, 100 + j) for i in range(40) for j in range(i + 1, 40)}
    # the one of unknown country may be in either, but not in both
    assert hot <= got and got - hot in ({(2, 3), (1, 4), (5, 6), (10, 12)} | x for x in ({(11, 13)}, {(10, 13), (12, 13)}))


def test_near_keys_against_brute_force(spark):
    rng = random.Random(12)
    words = {"".join(rng.choice("abcdef") for _ in range(rng.randrange(3, 20))) for _ in range(80)}
    for w in list(words):
        for _ in range(5):
            v = list(w)
            for _ in range(rng.randrange(1, 3)):
                i = rng.randrange(len(v) - 1)
                v[i : i + 2] = rng.choice([[v[i + 1], v[i]], [v[i]], [v[i], "k", v[i + 1]], ["k", v[i + 1]]]) if len(v) > 3 else v[i : i + 2]
            words.add("".join(v))
    hashed = {r["w"]: set(r["k"]) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", addresses._near_keys(F.col("w")).alias("k")).collect()}
    n = 0
    for a in words:
        for b in words:
            if a < b and abs(len(a) - len(b)) <= 2 and addresses.edits(a, b, m := addresses.allowed(min(len(a), len(b)))) <= m:
                n += 1
                assert addresses.near_keys(a) & addresses.near_keys(b) and hashed[a] & hashed[b], (a, b)
    assert n > 300
