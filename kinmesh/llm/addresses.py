"""Address records that denote the same location: parsing, a deletion-neighbourhood index and component assignment."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh.llm.unify import comparable
from kinmesh.session import stored

#: Most towns that are sent to the executors; a larger gazetteer must be cut by country first.
MOST_TOWNS = 200_000
#: Length from which a street or town may differ by two edits, and by one.
TWO_EDITS, ONE_EDIT = 8, 5
#: Rows of one location that meet in one part of the last join.
PART = 1000
#: Share of the letters of a street's tokens that must be assigned to the other's.
ASSIGNED = 0.6

# Street words by kind, written out and abbreviated, as words of their own.
STREET_WORDS = {
    "street": ["st", "str", "street", "strasse", "straat", "strt", "gata", "gatan", "gat", "gade", "rue", "r", "via", "v", "calle", "c", "cl", "rua", "ulica", "ul", "utca", "u"],
    "road": ["rd", "road"],
    "lane": ["la", "lane", "laan", "ln"],
    "avenue": ["av", "ave", "avd", "avda", "avenida", "avenue", "viale", "vle"],
    "boulevard": ["bd", "blvd", "boul", "boulevard", "bld"],
    "square": ["pl", "place", "platz", "plaza", "plein", "pln", "piazza", "pza", "pzza", "praca", "pca", "pz", "square", "sq", "torg"],
    "way": ["way", "weg", "wg", "vag", "vagen", "vej"],
    "alley": ["all", "allee"],
    "drive": ["drive", "dr"],
    "course": ["corso", "cso"],
}
# Street words that are written at the end of the name, longest first within a kind.
STREET_ENDS = {
    "street": ["strasse", "straat", "gatan", "gade", "gata", "gat", "strt", "str"],
    "lane": ["laan", "ln"],
    "square": ["platz", "plein", "torg", "pln", "pl"],
    "way": ["vagen", "weg", "vag", "vej", "wg"],
    "alley": ["allee", "all"],
}
# Ends that only count when a full stop followed them.
DOTTED_ENDS = {"g": "street", "v": "way"}
# Small words between a street word and the name.
LINKS = ["da", "de", "del", "della", "des", "di", "do", "du"]
# Words before a part of a building, a box or an addressee, and words that stand alone.
PART_WORDS = ["apartment", "appartement", "apt", "bat", "batiment", "bau", "block", "bloc", "building", "bldg", "edificio", "edif", "etage", "etg", "floor", "fl", "gebaude", "gebaeude", "gebouw", "geb", "haus", "interno", "level", "lokal", "plan", "piano", "piso", "po box", "pob", "p o box", "bp", "b p", "box", "postbus", "postfach", "apartado", "casella postale", "cp", "c p", "planta", "puerta", "room", "scala", "stock", "suite", "tr", "trappa", "unit", "van", "vaning", "werk", "wing", "entrance"]
ALONE = ["zone industrielle", "patent department", "patent dept", "patentabteilung", "industriegebiet", "industrial estate", "service brevets", "zona industriale", "z i", "poligono industrial", "legal department", "research department", "abt patente", "rez de chaussee"]
TO_WHOM = r"(?:c/o|c/-|attn\.?:?|z\.\s?hd\.(?:\s?v\.)?|zu handen|att\.|chez|p/a|co\.?/|presso|hd\.)"
# Countries as they are written behind an address.
COUNTRIES = "austria belgium bulgaria cyprus czech republic denmark deutschland germany estonia finland france greece great britain hungary ireland italy italia latvia lithuania luxembourg malta namibia netherlands osterreich poland portugal romania schweiz slovakia slovenia spain espana suisse sweden sverige switzerland uk united kingdom england the netherlands nederland belgique danmark suomi polska".split()
CODES = "at be bg ch cy cz de dk ee es fi fr gb gr hu ie it lt lu lv mt na nl no pl pt ro se si sk uk us".split()

_ENDS = sorted(((e, k) for k, es in STREET_ENDS.items() for e in es), key=lambda x: -len(x[0]))
_SEP = r"(?:[,;\n|]|\s[-–]\s|$)"
_TO = re.compile(rf"(?:^|(?<=[\s,;]))(?:{TO_WHOM})\s*([^,;\n|]*?)(?={_SEP})")
_FIRM_END = re.compile(r".*(?<![\w])(?:" + "|".join(re.escape(w) for w in ("gmbh", "ag", "kg", "ab", "bv", "nv", "sa", "sas", "sarl", "spa", "srl", "ltd", "plc", "limited", "sl", "lda", "inc", "aktiebolag", "oy")) + r")(?![\w])\.?")
_PERSON = re.compile(r"(?:(?:dr|prof|mr|mrs|ing|dipl\.-ing)\.?\s)*[^\s]+(?:\s[a-z]\.?(?=\s))?\s[^\s]+")
_PART = re.compile(r"(?:\b\d{1,2}\s?(?:e|er|eme|o|st|nd|rd|th|\.|:a)?\s(?:etage|floor|stock|piano|piso|vaning|og)\b\.?)|(?:(?<![\w-])(?:" + "|".join(w.replace(" ", r"\.?\s?") for w in sorted(PART_WORDS, key=len, reverse=True)) + r")\.?\s(?:n[or]?\.?\s)?(?:\d+\w?|[a-z])(?![\w]))")
_SIDE = re.compile(r"(?<!\w)\d{1,2}\.?[ºo]?\s(?:izq|izda|esq|dto|dir|dcha|der|gauche|droite|links|rechts)(?!\w)\.?")
_ALONE = re.compile(r"(?<!\w)(?:(?:z\.\s?hd\.|attn\.?:?)\s)?(?:" + "|".join(w.replace(" ", r"[\s.]{1,2}") for w in ALONE) + r")(?!\w)")
_POST = re.compile(r"(?<![\w.])(?:[a-z]{1,3}-)?(\d{4,6})(?![\w])")
_HOUSE = re.compile(r"(?<![\w-])(?:(?:nr|no|n|num|numero|n°|nº|#)\.?\s?)?(\d{1,3})([a-z])?(?!\w)")
_NUMBER_WORD = re.compile(r"(?<!\w)(?:nr|no|n|num|numero)\.?\s(?=\d)")


def fold(text: str) -> str:
    """Lower case without accents."""
    text = comparable(text).replace("ø", "o").replace("æ", "ae").replace("œ", "oe").replace("ł", "l").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def squeeze(text: str) -> str:
    """Letters only, with written-out umlauts as single letters."""
    return re.sub(r"(?:ae|oe|ue)", lambda m: m[0][0], re.sub(r"[^a-z]", "", text))


_KIND = {squeeze(w): k for k, ws in STREET_WORDS.items() for w in ws}


def edits(a: str, b: str, most: int = 2) -> int:
    """Edits, exchanges of neighbours included, between two strings; ``most`` + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev2, prev = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if prev2 is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        prev2, prev = prev, row
    return min(prev[-1], most + 1)


def allowed(n: int) -> int:
    return 2 if n >= TWO_EDITS else 1 if n >= ONE_EDIT else 0


def near_keys(word: str) -> set[str]:
    """Texts that two words with at most as many edits as ``allowed`` for the shorter have in common.

    Up to eight letters: the word with none or one letter left out. From eight letters, where two edits are allowed: of two
    edits at most one falls into the first or the last letters, so these are kept with one letter left out: four up to 13
    letters, six from 12 letters (lengths differ by two at most).
    """
    n, out = len(word), {word}
    if ONE_EDIT <= n <= TWO_EDITS:
        out |= {word[:i] + word[i + 1 :] for i in range(n)}
    for k, fits in ((4, TWO_EDITS <= n <= 13), (6, n >= 12)):
        if fits:
            for sign, part in (("<", word[:k]), (">", word[-k:])):
                out |= {sign + part} | {sign + part[:i] + part[i + 1 :] for i in range(k)}
    return out


class Towns:
    """A deletion-neighbourhood index of town names."""

    def __init__(self, names: list[str]):
        self.exact = {squeeze(fold(n)): n for n in names}
        self.near: dict[str, set[str]] = {}
        for key in self.exact:
            for d in near_keys(key):
                self.near.setdefault(d, set()).add(key)
        self.longest = max((len(re.split(r"[\s-]+", fold(n))) for n in names), default=1)

    @lru_cache(maxsize=100_000)  # noqa: B019
    def find(self, word: str) -> tuple[str, int] | None:
        """(town, edits) of the nearest town, if it is near enough and no other is as near."""
        if word in self.exact:
            return word, 0
        best: list[tuple[int, str]] = []
        if len(word) >= ONE_EDIT:
            seen = set().union(*[self.near.get(d, ()) for d in near_keys(word)])
            best = sorted((e, t) for t in seen if abs(len(t) - len(word)) <= 2 and (e := edits(word, t)) <= min(allowed(len(word)), allowed(len(t))))
        return (best[0][1], best[0][0]) if best and (len(best) == 1 or best[1][0] > best[0][0]) else None


def _addressee(m: re.Match) -> str:
    """What stays of a part that begins with an addressee: nothing, or what follows the name if a number does."""
    name = _FIRM_END.match(m[1]) or _PERSON.match(m[1])
    rest = m[1][name.end():] if name else m[1]
    words = [(w[1], bool(w[2])) for w in re.finditer(r"([^\s.]+)(\.?)", rest)]
    return f" , {rest}" if re.search(r"\d", rest) or len(words) > 1 and street_of(words)[1] else " , "


def street_of(words: list[tuple[str, bool]]) -> tuple[str, str]:
    """(stem, kind) of a street's words, each with whether a full stop followed."""
    return tokens_of(words)[:2]


def tokens_of(words: list[tuple[str, bool]]) -> tuple[str, str, tuple[str, ...]]:
    """(stem, kind, tokens) of a street's words; parts of a hyphened word are tokens of their own."""
    kind, stem, tokens = "", [], []
    for w, dot in words:
        bare = squeeze(w)
        if bare in _KIND and not kind and (len(bare) > 1 or dot or len(words) > 1):
            kind = _KIND[bare]
        elif bare and bare not in LINKS:
            stem.append((bare, dot))
            tokens += [b for part in re.split(r"[-–]", w) if (b := squeeze(part)) and b not in LINKS]
    if not kind and stem:
        last, dot = stem[-1]
        for end, k in _ENDS:
            if last.endswith(end) and len(last) > len(end) + 2:
                kind, stem[-1] = k, (last[: -len(end)], False)
                break
        else:
            if dot and last[-1] in DOTTED_ENDS and len(last) > 4:
                kind, stem[-1] = DOTTED_ENDS[last[-1]], (last[:-1], False)
        # the last token loses the kind of street as the stem did
        cut = len(last) - len(stem[-1][0])
        if cut and tokens:
            tokens[-1:] = [tokens[-1][:-cut]] if len(tokens[-1]) > cut else []
    return squeeze("".join(w for w, _ in stem)), kind, tuple(tokens)


def parse(text: str | None, towns: Towns) -> tuple[str, str, str, str, str] | None:
    """(town, postcode, number, stem, kind) of an address with a street and a number, else None. Missing parts are empty."""
    got = parse_tokens(text, towns)
    return got[:5] if got and got[3][:1] != "=" else None


def parse_tokens(text: str | None, towns: Towns) -> tuple[str, str, str, str, str, tuple[str, ...]] | None:
    """As ``parse``, with the street's tokens. An address that has a street but cannot be parsed has only a stem: = and its folded text."""
    if not text or not text.strip():
        return None
    whole = ("", "", "", "=" + " ".join(fold(text).split()), "", ())
    t = fold(text.replace("\n", " , ")).replace("/", " / ").replace("c / o", "c/o")
    t = re.sub(r"\bc / (?=[a-z])", "calle ", t)
    t = _TO.sub(_addressee, _ALONE.sub(" , ", t))
    t = re.sub(r"(?<!\w)p\.?\s?(zz?)a(?!\w)\.?", r"piazza", t)
    t = re.sub(r"(?<!\w)v\.?le(?!\w)", "viale", t)
    t = re.sub(r"(?<!\w)c\.so(?!\w)", "corso", t)
    t = _SIDE.sub(" , ", _PART.sub(" , ", t))
    t = re.sub(r"\(([^)]*)\)", r" , \1 , ", t)
    posts = _POST.findall(t)
    t = _POST.sub(" , ", t)
    houses = [m for m in _HOUSE.finditer(t)]
    number = ""
    if houses:
        house = houses[0]
        number = house[1].lstrip("0") + (house[2] or "")
        t = _NUMBER_WORD.sub(" ", t[: house.start()] + " # " + t[house.end():])
    parts = []
    for seg in re.split(r"[,;|]|\s[-–]\s", t):
        words = [(m[1], bool(m[2])) for m in re.finditer(r"([^\s.]+)(\.?)", seg)]
        if words:
            parts.append(words)
    parts = [[w for w in p] for p in parts]
    # countries and codes at an end of a part
    clean = []
    for p in parts:
        bare = " ".join(w for w, _ in p)
        if bare in CODES or re.sub(r"[^a-z ]", "", bare) in COUNTRIES or bare in ("united kingdom", "great britain", "czech republic", "the netherlands"):
            continue
        while len(p) > 1 and (p[-1][0] in COUNTRIES or p[-1][0] in CODES and p[-1][0] not in _KIND):
            p = p[:-1]
            if p and p[-1][0] in ("united", "great", "czech", "the"):
                p = p[:-1]
        clean.append(p)
    town, where, best = "", None, 9
    for i, p in enumerate(clean):
        for n in range(min(towns.longest, len(p)), 0, -1):
            for a in range(len(p) - n + 1):
                ws = [w for w, _ in p[a : a + n]]
                if "#" in ws:
                    continue
                key = squeeze("".join(ws))
                found = towns.find(key) if len(key) >= 3 else None
                if found and (found[1], -n) < (best, 0 if where is None else -where[2]):
                    town, best, where = found[0], found[1], (i, a, n)
    if where:
        i, a, n = where
        clean[i] = clean[i][:a] + [("|", False)] + clean[i][a + n :]
    street: list[tuple[str, bool]] = []
    pools = []
    for p in clean:
        run: list[tuple[str, bool]] = []
        for w in [*p, ("|", False)]:
            if w[0] == "|":
                if run:
                    pools.append(run)
                run = []
            else:
                run.append(w)
    for p in pools:  # the part with the number, else the one with a street word
        if any(w == "#" for w, _ in p) and len(p) > 1:
            street = [w for w in p if w[0] != "#"]
            break
    if not street:
        named = [p for p in pools if street_of([w for w in p if w[0] != "#"])[1]]
        rest = [p for p in pools if any(len(w) > 3 for w, _ in p)]
        street = (named or rest or [[]])[0]
    words = [w for w in street if w[0] != "#"]
    stem, kind, tokens = tokens_of(words)
    if not houses or len(stem) < 3:
        letters = sum(c.isalpha() for w, _ in words for c in w if squeeze(w) not in _KIND)
        return whole if kind and letters > 1 or houses and letters > 2 else None
    return town, posts[0] if posts else "", number, stem, kind, tokens


def _parsed(distinct: DataFrame, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        towns = Towns(names)
        for pdf in batches:
            got = [parse_tokens(a, towns) for a in pdf["address"]]
            rows = [(a, *g[:5], " ".join(g[5]), " ".join(fold(a).split())) for a, g in zip(pdf["address"], got) if g]
            yield pd.DataFrame(rows, columns=["address", "town", "post", "number", "stem", "kind", "tokens", "folded"])

    return distinct.mapInPandas(run, "address string, town string, post string, number string, stem string, kind string, tokens string, folded string")


def _like(x: str, y: str) -> int:
    """Letters of the longer token that the shorter stands for: all within the allowed edits or for an initial, else 0."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) == 1:
        return len(y) if x == y[0] else 0
    most = allowed(len(x))
    return len(y) if edits(x, y, most) <= most else 0


def _best(like: list[list[int]]) -> list[int]:
    """The column of each row in the one-to-one assignment with the greatest sum; at most as many rows as columns (Hungarian method)."""
    n, m = len(like), len(like[0])
    u, v, row, way = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row[0], j = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while row[j]:
            used[j], at, delta, to = True, row[j], float("inf"), 0
            for k in range(1, m + 1):
                if not used[k]:
                    if (c := -like[at - 1][k - 1] - u[at] - v[k]) < least[k]:
                        least[k], way[k] = c, j
                    if least[k] < delta:
                        delta, to = least[k], k
            for k in range(m + 1):
                if used[k]:
                    u[row[k]] += delta
                    v[k] -= delta
                else:
                    least[k] -= delta
            j = to
        while j:
            row[j], j = row[way[j]], way[j]
    out = [0] * n
    for k in range(1, m + 1):
        if row[k]:
            out[row[k] - 1] = k - 1
    return out


def assigned(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """The share of the longer list's letters in the best one-to-one assignment of two lists of tokens; 0 if a token of the shorter has no partner, or none of three letters has."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    like = [[_like(x, y) for y in b] for x in a]
    pairs = list(enumerate(_best(like)))
    if any(not like[i][j] for i, j in pairs) or not any(min(len(a[i]), len(b[j])) > 2 for i, j in pairs):
        return 0.0
    found = sum(like[i][j] for i, j in pairs)
    return found / (found + sum(len(y) for j, y in enumerate(b) if j not in {k for _, k in pairs}))


def _same(a: tuple, b: tuple) -> bool:
    """Whether two parsed locations of one block and number are one: near street stems or tokens that can be assigned, no conflict of street kinds."""
    (stem_a, kind_a, tokens_a), (stem_b, kind_b, tokens_b) = a, b
    if kind_a and kind_b and kind_a != kind_b:
        return False
    most = min(allowed(len(stem_a)), allowed(len(stem_b)))
    return edits(stem_a, stem_b, most) <= most or len(tokens_a) + len(tokens_b) > 2 and assigned(tokens_a, tokens_b) >= ASSIGNED


def _verified(pairs: DataFrame) -> DataFrame:
    """The pairs of locations that are one. Streets within the allowed plain edits are settled in the JVM; only pairs that need exchanged letters or an assignment of tokens reach Python, each pair of streets once."""
    agree = (F.col("kind_a") == "") | (F.col("kind_b") == "") | (F.col("kind_a") == F.col("kind_b"))
    n = F.least(F.length("stem_a"), F.length("stem_b"))
    most = F.when(n >= TWO_EDITS, 2).when(n >= ONE_EDIT, 1).otherwise(0)
    far = F.levenshtein("stem_a", "stem_b", 4)
    far = F.when(far < 0, 9).otherwise(far)
    several = F.contains("tokens_a", F.lit(" ")) | F.contains("tokens_b", F.lit(" "))
    judged = stored(pairs.where(agree).withColumn("sure", far <= most).where(F.col("sure") | (far <= 2 * most) | several), "street-pairs")
    street = ["stem_a", "kind_a", "tokens_a", "stem_b", "kind_b", "tokens_b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [_same((a, b, tuple(x.split())), (c, d, tuple(y.split()))) for a, b, x, c, d, y in zip(*(pdf[c] for c in street))]
            yield pdf.loc[keep, street]

    kinds = ", ".join(f"{c} string" for c in street)
    doubtful = judged.where("NOT sure")
    right = doubtful.select(*street).distinct().mapInPandas(run, kinds)
    return judged.where("sure").select("loc_a", "loc_b").unionByName(doubtful.join(right.hint("merge"), street, "left_semi").select("loc_a", "loc_b"))


def _near_keys(word: Column) -> Column:
    """As ``near_keys``, as hashes."""
    n = F.length(word)
    less = lambda s, k, sign: F.transform(F.sequence(F.lit(0), k), lambda i: F.xxhash64(F.lit(sign), F.when(i == 0, s).otherwise(F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))))
    ends = lambda k: F.concat(less(F.substring(word, F.lit(1), F.lit(k)), F.lit(k), "<"), less(F.substring(word, n - k + 1, F.lit(k)), F.lit(k), ">"))
    none = F.array().cast("array<bigint>")
    short = F.when(n < ONE_EDIT, F.array(F.xxhash64(F.lit("="), word))).when(n <= TWO_EDITS, less(word, n, "=")).otherwise(none)
    return F.array_distinct(F.concat(short, F.when((n >= TWO_EDITS) & (n <= 13), ends(4)).otherwise(none), F.when(n >= 12, ends(6)).otherwise(none)))


SPOT = ["block", "number", "stem", "kind", "tokens"]


def locations(df: DataFrame, key: str, address: str, towns: DataFrame, country: str | None = None) -> DataFrame:
    """(key, place, block, number, stem, kind, tokens, named, share) of the rows whose address has a street; without a number that can be read, the stem is = and the folded text.

    The block is the town, with the record's country where towns of several countries bear the name (all of these countries
    where it is unknown). An address that names no town gets the towns of its postcode, else those of the neighbouring
    localities: the towns that other addresses name with the longest known beginning of the postcode, each with its share; a
    postcode that nobody else has is a block of its own. An address with neither is only equal to the same text (stem =).
    """
    listed = towns.where("city IS NOT NULL").select("city", F.upper(F.trim("country")).alias("cc") if "country" in towns.columns else F.lit("").alias("cc")).distinct().limit(MOST_TOWNS + 1).collect()
    if len(listed) > MOST_TOWNS:
        raise ValueError(f"more than {MOST_TOWNS} towns")
    names = sorted({r["city"] for r in listed})
    lands: dict[str, set[str]] = {}
    for r in listed:
        lands.setdefault(squeeze(fold(r["city"])), set()).add(r["cc"] or "")
    shared = {t: sorted(ccs) for t, ccs in lands.items() if len(ccs) > 1}
    own = F.upper(F.trim(F.col(country))) if country else F.lit("")
    rows = df.select(F.col(key).alias("id"), F.col(address).alias("address"), F.coalesce(own, F.lit("")).alias("cc")).where("id IS NOT NULL AND address IS NOT NULL").distinct()
    rows = stored(rows, "addresses")
    parsed = stored(_parsed(rows.select("address").distinct().repartition(rows.sparkSession.sparkContext.defaultParallelism * 2), names), "parsed")
    begins = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat(F.length("post"), F.lit(":"), F.substring("post", 1, n)).alias("begin")) for i, n in enumerate((6, 4, 3))])
    seen = parsed.where("town <> '' AND post <> ''").select("town", F.explode(begins).alias("b")).groupBy("b.rank", "b.begin", "town").agg(F.count("*").alias("c"))
    seen = seen.join(seen.groupBy("rank", "begin").agg(F.sum("c").alias("all")), ["rank", "begin"]).select("rank", "begin", "town", (F.col("c") / F.col("all")).alias("share"))
    lost = parsed.where("town = '' AND post <> ''").drop("town")
    met = lost.select("address", "post", "number", "stem", "kind", "tokens", F.explode(begins).alias("b")).select("*", "b.rank", "b.begin").drop("b").join(seen, ["rank", "begin"])
    nearest = met.groupBy("address").agg(F.min("rank").alias("rank"))
    placed = met.join(nearest, ["address", "rank"]).select("address", "post", "number", "stem", "kind", "tokens", F.col("town").alias("block"), "share")
    alone = lost.join(nearest, "address", "left_anti").select("address", "post", "number", "stem", "kind", "tokens", F.concat(F.lit("#"), "post").alias("block"), F.lit(1.0).alias("share"))
    nowhere = parsed.where("town = '' AND post = ''").select("address", "post", "number", F.when(F.col("stem").startswith("="), F.col("stem")).otherwise(F.concat(F.lit("="), "folded")).alias("stem"), F.lit("").alias("kind"), F.lit("").alias("tokens"), F.lit("").alias("block"), F.lit(1.0).alias("share"))
    sure = parsed.where("town <> ''").select("address", "post", "number", "stem", "kind", "tokens", F.col("town").alias("block"), F.lit(1.0).alias("share"))
    every = sure.withColumn("named", F.lit(True)).unionByName(placed.unionByName(alone).unionByName(nowhere).withColumn("named", F.lit(False)))
    every = every.withColumn("place", F.when(F.col("named"), F.xxhash64("block", *SPOT[1:])).otherwise(F.xxhash64(F.lit("#"), "post", *SPOT[1:])))
    out = rows.join(every.hint("merge"), "address")
    if shared:
        table = F.create_map(*[x for t, ccs in sorted(shared.items()) for x in (F.lit(t), F.array(*map(F.lit, ccs)))])
        ccs = F.try_element_at(table, F.col("block"))
        fits = F.when(ccs.isNull(), F.array(F.lit(""))).when(F.array_contains(ccs, F.col("cc")), F.array("cc")).otherwise(ccs)
        out = out.withColumn("lands", fits).withColumn("one", F.size("lands") == 1).withColumn("land", F.explode("lands"))
        out = out.withColumn("place", F.xxhash64("place", F.when(F.col("one"), F.col("land")))).withColumn("named", F.col("named") & F.col("one"))
        out = out.withColumn("block", F.when(F.col("land") == "", F.col("block")).otherwise(F.concat_ws("/", "block", "land")))
    return out.select(F.col("id").alias(key), "place", *SPOT, "named", "share")


def location_classes(df: DataFrame, key: str, address: str, towns: DataFrame, country: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, members): the pairs (loc_a, loc_b) of different notations of one location, and (loc, key) of every row with a location.

    As many rows as there are addresses and notations, not their pairs. A place that names no town may lie in several; it
    stays in the one where a named location answers to it, else in that with the greatest share of its postcode.
    """
    rows = stored(locations(df, key, address, towns, country), "located")
    locs = rows.groupBy(*SPOT).agg(F.max("named").alias("named")).withColumn("loc", F.xxhash64(*SPOT))
    locs = stored(locs, "locations")
    parts = F.array_distinct(F.concat(F.array("stem"), F.filter(F.split("tokens", " "), lambda t: F.length(t) > 2)))
    words = locs.where(~F.col("stem").startswith("=")).select("loc", "block", "number", F.explode(parts).alias("word"))
    small = stored(words.select(F.explode(F.transform(_near_keys(F.col("word")), lambda h: F.xxhash64("block", "number", h))).alias("k"), "loc").distinct(), "index")
    several = small.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    small = small.join(several.hint("merge"), "k")
    cand = small.toDF("k", "loc_a").hint("merge").join(small.toDF("k", "loc_b"), "k").where("loc_a < loc_b").select("loc_a", "loc_b").distinct()
    side = lambda s: locs.select(F.col("loc").alias(f"loc_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("stem", "kind", "tokens")])
    cand = cand.join(side("a").hint("merge"), "loc_a").join(side("b").hint("merge"), "loc_b")
    linked = stored(_verified(cand).distinct(), "same")

    at = rows.select("place", F.xxhash64(*SPOT).alias("loc"), "named", "share").distinct()
    open_ = at.groupBy("place").agg(F.count_distinct("loc").alias("c")).where("c > 1").select("place")
    known = locs.where("named").select("loc")
    answered = linked.join(known.withColumnRenamed("loc", "loc_b").hint("merge"), "loc_b").select(F.col("loc_a").alias("loc")).unionByName(linked.join(known.withColumnRenamed("loc", "loc_a").hint("merge"), "loc_a").select(F.col("loc_b").alias("loc"))).unionByName(known).distinct().withColumn("answered", F.lit(True))
    choice = at.join(open_.hint("merge"), "place").join(answered.hint("merge"), "loc", "left").groupBy("place").agg(F.max(F.struct(F.coalesce("answered", F.lit(False)), "share", "loc")).alias("m")).select("place", F.col("m.loc").alias("chosen"))
    member = rows.select(F.col(key).alias("id"), "place", F.xxhash64(*SPOT).alias("loc")).distinct().join(choice.hint("merge"), "place", "left")
    member = stored(member.where("chosen IS NULL OR chosen = loc").select("loc", "id").distinct(), "members")
    return linked, member


def same_location(df: DataFrame, key: str, address: str, towns: DataFrame, country: str | None = None) -> DataFrame:
    """(key_a, key_b), smaller first, each once: different keys with an address at the same location.

    Same block (town), same house number (a hard veto), no two different kinds of street, and near street stems or tokens
    that can be assigned to each other, initials and missing ones allowed. Candidates come from a deletion-neighbourhood
    index of the stems and of the tokens of three letters inside (block, number); addresses that parse alike
    are one location while compared. Floors, buildings, boxes and addressees are left out before. Null and empty
    addresses and those without a street and number denote no location, unless two with a street are equal but for case, accents and spaces.
    No side of a join is broadcast: the index is many times its input. The pairs of a hot location are spread over its rows.
    """
    linked, member = location_classes(df, key, address, towns, country)
    both_ways = linked.unionByName(linked.select(F.col("loc_b").alias("loc_a"), F.col("loc_a").alias("loc_b"))).unionByName(member.select(F.col("loc").alias("loc_a"), F.col("loc").alias("loc_b")).distinct())
    near = both_ways.toDF("loc", "other").hint("merge").join(member, "loc").select("other", F.col("id").alias("ia"))
    # a location of many rows is cut into parts of its own rows; the rows that look for it are repeated in each part
    sizes = member.groupBy("loc").agg(F.count("*").alias("c")).select("loc", F.ceil(F.col("c") / F.lit(PART)).cast("int").alias("parts"))
    right = member.join(sizes.hint("merge"), "loc").select(F.col("loc").alias("other"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("ib"))
    left = near.join(sizes.select(F.col("loc").alias("other"), "parts").hint("merge"), "other").select("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "ia")
    pairs = left.hint("merge").join(right, ["other", "part"]).where("ia < ib")
    return pairs.select(F.col("ia").alias(f"{key}_a"), F.col("ib").alias(f"{key}_b")).distinct()
