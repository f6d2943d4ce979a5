"""Variant spellings of names typed by people: an index of words within the allowed edits and comparison by longest common subsequence."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh.llm.addresses import ONE_EDIT, TWO_EDITS, allowed, edits, fold
from kinmesh.operators.skew import dealt_join, skew_join
from kinmesh.session import stored

#: Names of the reference side that a word could mean from which their other words are looked at first.
COMMON = 20
#: Likeness (twice the longest common subsequence by both lengths) from which two words are one misspelt word.
ALIKE = 0.8
#: Keys of words that one part holds, and pairs of words that are looked at at once. Neither changes the result.
PART_KEYS, MOST_PAIRS = 1_000_000, 2_000_000
#: Odd factors of the hashes of words.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

# Legal forms as written out, and the short form they stand for.
LEGAL_PHRASES = {
    "gesellschaft mit beschrankter haftung": "gmbh", "aktiengesellschaft": "ag", "kommanditgesellschaft": "kg", "public limited company": "plc", "limited": "ltd",
    "societe anonyme": "sa", "societe a responsabilite limitee": "sarl", "societe par actions simplifiee": "sas", "societa per azioni": "spa", "societa a responsabilita limitata": "srl",
    "besloten vennootschap": "bv", "naamloze vennootschap": "nv", "aktiebolaget": "ab", "aktiebolag": "ab", "sociedad limitada": "sl", "sociedad anonima": "sa", "sociedade anonima": "sa",
    "sociedade limitada": "lda", "limitada": "lda", "gesmbh": "gmbh", "incorporated": "inc", "corporation": "corp", "aktieselskab": "as", "osakeyhtio": "oy",
}
LEGAL_CODES = ["ab", "ag", "as", "bv", "corp", "gmbh", "inc", "kg", "lda", "llc", "ltd", "nv", "oy", "plc", "sa", "sarl", "sas", "sl", "spa", "srl"]
# Words around a name that say nothing about who it is.
TITLES = ["dipl", "dr", "fa", "firm", "firma", "frau", "herr", "ing", "mag", "messrs", "miss", "mr", "mrs", "ms", "phd", "prof", "professor", "sir", "soc", "societe", "societa", "sociedad", "sociedade", "ste", "the"]
LINK_WORDS = ["and", "cie", "co", "et", "fils", "sons", "u", "und", "y"]
# Short forms of given names, and the names they stand for.
NICKNAMES = {
    "alex": ["alexander", "alexandra"], "andi": ["andreas"], "andy": ["andreas", "andrew"], "bea": ["beatrice"], "ben": ["benjamin"], "benny": ["benjamin"], "bert": ["albert", "robert"], "beth": ["elisabeth", "elizabeth"], "betty": ["elisabeth", "elizabeth"],
    "bill": ["william"], "billy": ["william"], "bob": ["robert"], "bobby": ["robert"], "chris": ["christian", "christine", "christopher"], "dan": ["daniel"], "danny": ["daniel"], "dick": ["richard"], "ed": ["edward"], "eddie": ["edward"], "ernie": ["ernest"],
    "fred": ["alfred", "frederick", "friedrich"], "fritz": ["friedrich"], "gerd": ["gerhard"], "gigi": ["luigi"], "hannes": ["johannes"], "hans": ["johann", "johannes"], "heini": ["heinrich"], "heinz": ["heinrich"], "inge": ["ingrid"], "jim": ["james"], "joe": ["josef", "joseph"],
    "john": ["johannes", "jonathan"], "jupp": ["josef"], "kate": ["katharina", "catherine"], "kathi": ["katharina"], "kathy": ["katharina", "catherine"], "kati": ["katharina"], "karl": ["carl"], "kit": ["christopher"], "larry": ["laurence", "lawrence"], "laurie": ["laurence"], "lisa": ["elisabeth"], "liz": ["elisabeth", "elizabeth"],
    "maggie": ["margaret"], "marg": ["margaret"], "marge": ["margaret"], "matt": ["matthias", "matthew"], "max": ["maximilian"], "meg": ["margaret"], "mick": ["michael"], "mike": ["michael"], "mitch": ["michael"], "nick": ["nicholas", "nicolas"], "nico": ["nicolas"], "paco": ["francisco"],
    "pancho": ["francisco"], "pat": ["patricia", "patrick"], "patty": ["patricia"], "peggy": ["margaret"], "peppe": ["giuseppe"], "beppe": ["giuseppe"], "pippo": ["giuseppe", "filippo"], "rich": ["richard"], "rick": ["richard"], "rob": ["robert"], "ron": ["ronald"], "sam": ["samuel"], "sepp": ["josef"], "sissi": ["elisabeth"], "steffen": ["stephan"],
    "steve": ["stephan", "stephen"], "ted": ["edward", "theodore"], "theo": ["theodor"], "tom": ["thomas"], "toni": ["antonio", "anton"], "tonio": ["antonio"], "tony": ["antonio", "anthony"], "ulli": ["ulrich"], "uli": ["ulrich"], "uschi": ["ursula"], "vicky": ["victoria"], "vic": ["victoria", "victor"], "will": ["william"], "willi": ["wilhelm", "william"], "xaver": ["francisco"], "zoli": ["zoltan"], "renie": ["renate"], "pete": ["peter", "pierre"], "dieter": ["dietrich"], "jo": ["johannes", "josef"], "sandro": ["alessandro", "alexander"], "sascha": ["alexander"], "wim": ["willem"], "kris": ["christopher"],
}
# Lines of business in the languages of the register.
LINES = [
    "automobiles", "automotive", "automobil", "biosystems", "biosysteme", "biosystemes", "ceramica", "ceramiche", "ceramics", "ceramique", "chemicals", "chemie", "chimica", "chimie", "electronica", "electronics", "electronique", "elektronica", "elektronik", "elettronica", "eletronica",
    "fahrzeugtechnik", "farmaceutici", "farmaceutica", "hydraulics", "hydraulik", "hydraulique", "industrias", "industrie", "industries", "instrumenten", "instruments", "kemi", "kunststoffen", "kunststofftechnik", "laboratoires", "laboratories", "laboratorios", "laboratorium", "lakemedel",
    "lasersysteme", "machines", "manufacturing", "maschinenbau", "maskin", "meccanica", "mecanica", "mecanique", "optica", "optics", "optiek", "optik", "optique", "ottica", "pharma", "pharmaceuticals", "plast", "plastics", "plasticos", "plastiques", "quimica", "technologies", "tecnologia",
    "tessile", "textiles", "umwelttechnik", "verktyg", "verrerie", "vidrios", "voeding", "werkzeugbau",
]

_PHRASES = [(p, re.compile(rf"(?<![a-z]){p}(?![a-z])")) for p in sorted(LEGAL_PHRASES, key=lambda p: -len(p))]
_LINE_SET = frozenset(LINES)
_GESMBH, _SIGNS = re.compile(r"ges\.?\s?m\.?\s?b\.?\s?h\.?"), re.compile(r"[^a-z0-9&]+")
_UMLAUTS, _NO_LETTERS = re.compile(r"(?:ae|oe|ue)"), re.compile(r"[^a-z]")
_DOTTED = re.compile(r"(?<![a-z])(?:[a-z]\.\s?){1,5}[a-z]?(?![a-z])\.?")
_NICK = {n: set(v) for n, v in NICKNAMES.items()}


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of machine words."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = (full := (1 << len(a)) - 1)
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


@lru_cache(maxsize=200_000)
def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def _letters(text: str) -> str:
    return _UMLAUTS.sub(lambda m: m[0][0], text) if "e" in text else text


@lru_cache(maxsize=200_000)
def _mask(word: str) -> tuple[int, int]:
    """The letters and digits of a word as bits, first and second occurrences apart, and how many signs have no bit."""
    mask = 0
    for c in word:
        i = ord(c) - 97 if "a" <= c <= "z" else ord(c) + 4 if "0" <= c <= "9" else -1
        if i >= 0 and not mask >> i & 1:
            mask |= 1 << i
        elif 0 <= i < 26 and not mask >> i + 36 & 1:
            mask |= 1 << i + 36
    return mask, len(word) - mask.bit_count()


#: For each first letter, the lines of business with their letters as bits, in the order of the list.
_LINES_OF = {c: [(w, len(w), _mask(w)[0]) for w in LINES if w[0] == c] for c in {w[0] for w in LINES}}
_FIRSTS = (1 << 36) - 1
#: Written-out legal forms of nine letters or more: words, letters, and kinds of letters as bits.
_LONG_PHRASES = [(p, p.count(" ") + 1, len(p), _mask(p)[0] & _FIRSTS) for p, _ in _PHRASES if len(p) >= 9]


@lru_cache(maxsize=100_000)
def _line(word: str) -> str | None:
    """The line of business that a word, cut short or misspelt, stands for; a word that several could be gets its first letters."""
    if word in _LINE_SET:
        return word
    if len(word) >= 3 and (lines := _LINES_OF.get(word[0])):
        if (n := len(word)) >= 5:
            m = _mask(word)[0]
            # letters that only one has are in no common subsequence
            near = [w for w, k, bits in lines if k >= n - 1 and (m ^ bits).bit_count() <= 0.16 * (n + k) + 1e-6 and ratio(w, word) >= 0.84]
            if near:
                return max(near, key=lambda w: ratio(w, word))
        short = [w for w, k, _ in lines if k > n and w[:3] == word[:3] and lcs(w, word) == n]
        if short:
            return short[0] if len(short) == 1 else min(short, key=len)
    return None


@lru_cache(maxsize=50_000)
def parse(name: str | None) -> tuple[tuple[str, ...], str, bool] | None:
    """(words, legal form, is_firm) of a name, or None if nothing of a name is left. Titles and legal forms are left out of the words."""
    if not name or not name.strip():
        return None
    t = fold(name)
    t = _DOTTED.sub(lambda m: f" {j} " if (j := _NO_LETTERS.sub("", m[0])) in LEGAL_CODES else m[0], _GESMBH.sub("gmbh", t))
    t = " ".join(_SIGNS.sub(" ", t.replace("'", "").replace("’", "")).split())
    legal = ""
    for p, alone in _PHRASES:
        if p in t and alone.search(t):
            t, legal = alone.sub(" ", t), LEGAL_PHRASES[p]
    words = t.split()
    # misspelt written-out legal forms: two to five words in a row that are near to one
    for p, k, n, bits in _LONG_PHRASES:
        for a in range(1, len(words) - k + 1):
            some = words[a : a + k]
            size = sum(map(len, some)) + k - 1
            if abs(size - n) > 3:
                continue
            m = 0
            for w in some:
                m |= _mask(w)[0]
            # kinds of letters that only one has are in no common subsequence
            if (m & _FIRSTS ^ bits).bit_count() <= 0.13 * (size + n) + 1e-6 and ratio(" ".join(some), p) >= 0.87:
                words, legal = words[:a] + words[a + k :], LEGAL_PHRASES[p]
                break
    firm, out = bool(legal), []
    for i, w in enumerate(words):
        if w in LEGAL_CODES and i > 0:
            legal, firm = (legal if legal == "gmbh" and w == "kg" else w if not legal or w == "gmbh" else legal), True
        elif w == "&":
            firm = True
        elif w in LINK_WORDS and i > 0 and (len(w) > 1 or firm):
            firm = firm or w in ("sons", "fils", "cie", "co")
        elif w in TITLES:
            firm = firm or w in ("fa", "firm", "firma", "messrs", "soc", "societe", "ste")
        else:
            out.append(_letters(w))
    if not any(len(w) > 2 for w in out):
        return None
    return tuple(out), legal, firm


def grouped(words: tuple[str, ...]) -> list[tuple[str, tuple[str, ...], bool]]:
    """Each word, and each two neighbours that may be one broken word, with the other words and whether it is joined."""
    one = [(w, words[:i] + words[i + 1 :], False) for i, w in enumerate(words) if len(w) > 2]
    two = [(words[i] + words[i + 1], words[:i] + words[i + 2 :], True) for i in range(len(words) - 1) if min(len(words[i]), len(words[i + 1])) > 1 and len(words[i] + words[i + 1]) > 5]
    return one + two


def _given(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, float]:
    """How the given names of two persons agree: same, weak (only initials or none) or other."""
    fa, fb = [w for w in a if len(w) > 1], [w for w in b if len(w) > 1]
    ia, ib = [w for w in a if len(w) == 1], [w for w in b if len(w) == 1]
    if fa and fb:
        x, y = fa[0], fb[0]
        near = max(ratio(p, q) for p in fa for q in fb)
        nick = any(q in _NICK.get(p, ()) or p in _NICK.get(q, ()) for p in fa for q in fb)
        short = (x.startswith(y) or y.startswith(x)) and min(len(x), len(y)) >= 3
        if not (near >= ALIKE or nick or short):
            return "other", near
        if ia and ib and ia[0] != ib[0]:
            return "other", near
        return "same", 1.0 if nick or short else near
    if fa or fb:
        f, i = (fa, ib) if fa else (fb, ia)
        if i:
            return ("weak", 0.7) if any(n[0] == f[0][0] for n in i) else ("other", 0.0)
        return "weak", 0.4
    return ("weak", 0.7) if ia and ib and ia[0] == ib[0] else ("weak", 0.4) if not ia or not ib else ("other", 0.0)


def _lines(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, float]:
    """How the lines of business of two firms agree."""
    x, y = "".join(w for w in a if len(w) > 1), "".join(w for w in b if len(w) > 1)
    if not x or not y:
        return ("weak", 0.5) if x or y else ("same", 1.0)
    if len(y) < len(x):
        x, y = y, x
    if ratio(x, y) >= ALIKE or (y.startswith(x[:3]) and len(x) >= 2 and lcs(x, y) == len(x)):
        return "same", max(ratio(x, y), 0.85)
    lx, ly = _line(x), _line(y)
    return ("same", 0.85) if lx and lx == ly else ("other", ratio(x, y))


def compare(a: tuple, b: tuple) -> tuple[str, float, str, str]:
    """(verdict, score, mark, word) of two parsed names: same, weak (nothing against it, but a part is missing) or other.

    The distinguishing word (family name, firm's own name) must be alike; mark is what tells the second name from others of
    that word: the first letter of its given name, or its line of business; word is the first name's distinguishing one.
    """
    (wa, la, fa), (wb, lb, fb) = a, b
    best = ("", 0.0, "", "")
    for x, ra, ja in grouped(wa):
        for y, rb, jb in grouped(wb):
            if ja and jb or _line(x) or _line(y) or abs(len(x) - len(y)) > 2:
                continue
            stem = ratio(x, y)
            most = allowed(min(len(x), len(y)))
            if stem < ALIKE or stem < 1 and edits(x, y, most) > most:
                continue
            firm = fa or fb or any(_line(w) for w in ra + rb)
            verdict, rest = _lines(ra, rb) if firm else _given(ra, rb)
            if firm and verdict == "weak" and la and lb and la != lb:
                verdict = "other"
            score = stem * 2 + rest + (0.1 if la and la == lb else 0.0)
            rank = {"same": 2, "weak": 1, "other": 0}[verdict]
            if (rank, score) > ({"same": 2, "weak": 1, "other": 0, "": -1}[best[0]], best[1]):
                text = "".join(w for w in rb if len(w) > 1)
                mark = (_line(text) or text[:4]) if firm else (rb[0][0] if rb else "")
                best = (verdict, score, mark, x)
    return best


def _keys(words: tuple[str, ...], firm: bool) -> list[dict]:
    """The index entries of a name: each word that may be the distinguishing one, with what the other words say.

    ``t`` has the other full words, and all of them in one, with the names and lines they could stand for (``cls``);
    ``ini`` the other initials, ``f0`` the first letter of the first other full word.
    """
    out = {}
    for w, rest, joined in grouped(words):
        if _line(w):
            continue
        full = [o for o in rest if len(o) > 1]
        texts = sorted({*full, "".join(full)} - {""}) or [""]
        t = []
        for o in texts:
            mask, over = _mask(o)
            t.append({"p": o, "n": len(o), "m": mask, "o": over, "cls": sorted({o, *_NICK.get(o, ()), *([f"line {_line(o)}"] if _line(o) else [])})})
        is_firm = firm or any(_line(o) for o in rest)
        out[w, rest] = {"w": w, "m": _mask(w)[0], "j": joined, "firm": is_firm, "ini": "".join(o for o in rest if len(o) == 1), "f0": full[0][0] if full else "", "t": t}
    return list(out.values())


def _hashes(letters: np.ndarray, drops: int) -> list[np.ndarray]:
    """Hashes of words of one length (a row for each place) with none, one or two letters left out, from hashes of their beginnings."""
    n = len(letters)
    power = [np.uint64(pow(BASE, k, 1 << 64)) for k in range(n + 1)]
    begin = [np.zeros(letters.shape[1], dtype=np.uint64)]
    for row in letters:
        begin.append(begin[-1] * power[1] + row)
    part = lambda i, j: begin[j] - begin[i] * power[j - i]
    out = [begin[n]]
    if drops:
        out += [begin[i] * power[n - 1 - i] + part(i + 1, n) for i in range(n)]
    if drops > 1:
        out += [begin[i] * power[n - 2 - i] + part(i + 1, j) * power[n - 1 - j] + part(j + 1, n) for j in range(n) for i in range(j)]
    return out


def _word_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, place of the word of each) that two words with at most as many edits as ``allowed`` have in common.

    Words of up to 15 letters: with none, one or two letters left out, as many as may differ at their length. Words from 14
    letters: the first and the last seven with one letter left out at most, since of two edits at most one falls into one of
    both. Lengths differ by two at most.
    """
    sizes, keys, of = np.fromiter(map(len, words), dtype=np.int64, count=len(words)), [], []
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        letters = np.ascontiguousarray(np.array([words[i] for i in at], dtype=f"U{n}").view(np.uint32).reshape(-1, n).T).astype(np.uint64) + np.uint64(1)
        got = _hashes(letters, 2 if n >= TWO_EDITS else 1 if n >= ONE_EDIT else 0) if n <= 15 else []
        if n >= 14:
            got += [h ^ np.uint64(mark) for half, mark in ((letters[:7], 1 << 61), (letters[-7:], 1 << 62)) for h in _hashes(half, 1)]
        keys += got
        of += [at] * len(got)
    if not keys:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    k = np.concatenate(keys)
    k = (k ^ (k >> np.uint64(32))) * np.uint64(MIX)
    return k ^ (k >> np.uint64(29)), np.concatenate(of)


def _dealt_keys(words: DataFrame, ref: bool, parts: int) -> DataFrame:
    """(part, ref, keys, ids, masks): the keys of words (i, w, m), packed by the part that their hashes fall into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, masks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "m"))
            keys, of = _word_keys(batch.column("w").to_pylist())
            part = ((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, keys, of = part[order], keys[order].astype(np.uint32), of[order]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, dtype=np.int64)
            packed = [(keys[a:b].tobytes(), ids[of[a:b]].tobytes(), masks[of[a:b]].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(part)])]
            data = [pa.array(part[cuts], pa.int32()), pa.array([ref] * len(cuts)), *(pa.array([p[c] for p in packed], pa.binary()) for c in range(3))]
            yield pa.RecordBatch.from_arrays(data, names=["part", "ref", "keys", "ids", "masks"])

    return words.select("i", "w", "m").mapInArrow(run, "part int, ref boolean, keys binary, ids binary, masks binary")


def _meet(table: pa.Table) -> pa.Table:
    """(hi, hm, fi, fm): the different words of both sides that have a key of a part in common, each pair once; letters of which over four differ are left out."""
    refs = table.column("ref").to_pylist()

    def side(of: bool) -> list[np.ndarray]:
        cells = lambda c: [x.as_buffer() for x, r in zip(table.column(c), refs) if r == of]
        keys, ids, masks = (np.concatenate([np.zeros(0, dtype=t), *(np.frombuffer(x, dtype=t) for x in cells(c))]) for c, t in (("keys", np.uint32), ("ids", np.int32), ("masks", np.int64)))
        order = np.argsort(keys)
        return [keys[order], ids[order], masks[order]]

    (hk, hi, hm), (fk, fi, fm) = side(True), side(False)
    low, high = np.searchsorted(hk, fk, "left"), np.searchsorted(hk, fk, "right")
    met = np.flatnonzero(high > low)
    low, n = low[met], (high - low)[met]
    ends, out, a = np.cumsum(n), [], 0
    while a < len(met):
        # some million pairs at a time
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MOST_PAIRS, "right")))
        f = np.repeat(met[a:b], n[a:b])
        h = np.repeat(low[a:b] - (ends[a:b] - n[a:b] - (ends[a - 1] if a else 0)), n[a:b]) + np.arange(n[a:b].sum())
        odd = hm[h] ^ fm[f]
        near = (np.bitwise_count(odd) <= 4) & ((odd != 0) | (hi[h] != fi[f]))
        h, f = h[near], f[near]
        pair = (hi[h].astype(np.uint64) << np.uint64(32) | fi[f].astype(np.uint32)) * np.uint64(BASE) ^ hm[h].astype(np.uint64) * np.uint64(MIX) ^ fm[f].astype(np.uint64)
        once = np.unique(pair, return_index=True)
        out.append((once[0], h[once[1]], f[once[1]]))
        a = b
    if out:
        once = np.unique(np.concatenate([o[0] for o in out]), return_index=True)[1]
        h, f = (np.concatenate([o[c] for o in out])[once] for c in (1, 2))
    else:
        h = f = np.zeros(0, dtype=np.int64)
    return pa.table({"hi": hi[h], "hm": hm[h], "fi": fi[f], "fm": fm[f]})


def _near(ref: DataFrame, seen: DataFrame) -> DataFrame:
    """(hw, fw): the pairs of different words' spellings that may be within the allowed edits, exactly equal ones included.

    Words meet by their keys, packed into parts of about ``PART_KEYS`` keys, and by number (a hash) and letters; then they are joined back.
    """
    a, b = (stored(t.select("w", "m").distinct().withColumn("i", F.hash("w")), "words") for t in (ref, seen))
    slots = a.sparkSession.sparkContext.defaultParallelism * 2
    # a word has about fifty keys
    parts = max(slots, -(-50 * (a.count() + b.count()) // PART_KEYS))
    keys = _dealt_keys(a.repartition(slots), True, parts).unionByName(_dealt_keys(b.repartition(slots), False, parts))
    met = keys.groupBy("part").applyInArrow(_meet, "hi int, hm long, fi int, fm long").distinct()
    met = met.join(a.select(F.col("i").alias("hi"), F.col("m").alias("hm"), F.col("w").alias("hw")).hint("shuffle_hash"), ["hi", "hm"])
    met = met.join(b.select(F.col("i").alias("fi"), F.col("m").alias("fm"), F.col("w").alias("fw")).hint("shuffle_hash"), ["fi", "fm"])
    n = F.least(F.length("hw"), F.length("fw"))
    most = F.when(n >= TWO_EDITS, 2).when(n >= ONE_EDIT, 1).otherwise(0)
    far, odd = F.levenshtein("hw", "fw"), F.bit_count(F.col("hm").bitwiseXOR(F.col("fm")))
    # levenshtein counts an exchange of neighbours twice; exchanges keep the letters
    fits = (far <= most) | ((far <= most + 1) & (odd <= 2)) | ((far <= most + 2) & (odd == 0))
    apart = F.abs(F.length("hw") - F.length("fw")) <= 2
    equal = a.select(F.col("w").alias("hw")).hint("merge").join(b.select(F.col("w").alias("fw")), F.col("hw") == F.col("fw"))
    return met.where(apart).where(fits & (F.col("hw") != F.col("fw"))).select("hw", "fw").unionByName(equal)


def _agreeing(a: str, b: str) -> Column:
    """Whether the other words of two entries (columns of these prefixes) may agree: never false where ``compare`` finds same or weak."""
    c = lambda s, n: F.col(f"{s}{n}")
    firm = c(a, "firm") | c(b, "firm")
    lacks = lambda x, y: (c(x, "p") == "") & (firm | (c(x, "ini") == "") | (c(y, "p") == "") | (F.instr(c(x, "ini"), c(y, "f0")) > 0))
    full = (c(a, "p") != "") & (c(b, "p") != "")
    begins = c(a, "p").startswith(F.substring(c(b, "p"), 1, 3)) | c(b, "p").startswith(F.substring(c(a, "p"), 1, 3))
    both = (c(a, "n") + c(b, "n")).cast("double")
    letters = 2 * (F.bit_count(c(a, "m").bitwiseAND(c(b, "m"))) + F.least(c(a, "o"), c(b, "o"))) >= ALIKE * both - 1e-6
    alike = letters & (F.levenshtein(c(a, "p"), c(b, "p")) <= (1 - ALIKE) * both + 1e-6)
    return lacks(a, b) | lacks(b, a) | (full & (begins | alike | F.arrays_overlap(c(a, "cls"), c(b, "cls"))))


_REST = "struct<p:string,n:int,m:bigint,o:int,cls:array<string>>"
_ENTRY = f"struct<w:string,m:bigint,j:boolean,firm:boolean,ini:string,f0:string,t:array<{_REST}>>"
_PARSED = f"name string, cc string, words array<string>, legal string, firm boolean, entries array<{_ENTRY}>"


def _parsed(distinct: DataFrame) -> DataFrame:
    text = pa.string()
    rest = pa.struct([("p", text), ("n", pa.int32()), ("m", pa.int64()), ("o", pa.int32()), ("cls", pa.list_(text))])
    entry = pa.struct([("w", text), ("m", pa.int64()), ("j", pa.bool_()), ("firm", pa.bool_()), ("ini", text), ("f0", text), ("t", pa.list_(rest))])
    kinds = [text, text, pa.list_(text), text, pa.bool_(), pa.list_(entry)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(n, c, *p, _keys(p[0], p[2])) for n, c in zip(batch.column("name").to_pylist(), batch.column("cc").to_pylist()) if (p := parse(n))]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], kind) for i, kind in enumerate(kinds)], names=["name", "cc", "words", "legal", "firm", "entries"])

    return distinct.mapInArrow(run, _PARSED)


def _side(df: DataFrame, key: str, name: str, country: str) -> tuple[DataFrame, DataFrame]:
    """(rows of key, name and country; distinct names with country, parsed). Unknown countries are empty."""
    cc = F.upper(F.trim(F.col(country)))
    cc = F.when(cc.rlike("^[A-Z]{2}$"), cc).otherwise(F.lit(""))
    rows = df.select(F.col(key).alias("id"), F.col(name).alias("name"), cc.alias("cc")).where("id IS NOT NULL AND name IS NOT NULL").distinct()
    rows = stored(rows, "names")
    slots = rows.sparkSession.sparkContext.defaultParallelism * 2
    # by name, so that one worker has all countries of a name and keeps what it parsed
    distinct = rows.select("name", "cc").distinct().repartition(slots, "name")
    return rows, stored(_parsed(distinct).withColumn("f", F.xxhash64("name", "cc")), "forms")


def _judged(cand: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h, f, wa, la, fa, wb, lb, fb in zip(pdf["h"], pdf["f"], pdf["wa"], pdf["la"], pdf["fa"], pdf["wb"], pdf["lb"], pdf["fb"]):
                verdict, score, mark, word = compare((tuple(wa), la, fa), (tuple(wb), lb, fb))
                if verdict:
                    out.append((h, f, verdict, round(score, 4), mark, word, bool(fa or fb)))
            yield pd.DataFrame(out, columns=["h", "f", "verdict", "score", "mark", "word", "firm"])

    return cand.mapInPandas(run, "h long, f long, verdict string, score double, mark string, word string, firm boolean")


def linked(reference: DataFrame, ref_key: str, ref_name: str, ref_country: str, df: DataFrame, key: str, name: str, country: str) -> DataFrame:
    """(ref_key, key): each row's key with the reference entry that its name denotes; at most one entry per key.

    Candidates have a word within the allowed edits (``_near``). Where over twenty reference names could be meant by a
    word, only those are compared of which the other words may agree too (``_agreeing``, which loses no link). Names are compared by the longest
    common subsequence; known countries must not differ. A name that lacks the given name or the line of business is linked
    only if no other entry and no other name of the table could be meant. Null and empty names denote nobody; equal
    spellings are compared once; ties go to the smaller reference key.
    """
    ref_rows, ref_forms = _side(reference, ref_key, ref_name, ref_country)
    rows, forms = _side(df, key, name, country)
    e = stored(ref_forms.select(F.col("f").alias("h"), F.col("cc").alias("hc"), F.explode("entries").alias("e")).select("h", "hc", "e.*"), "entries")
    seen = stored(forms.select("f", F.col("cc").alias("fc"), F.explode("entries").alias("e")).select("f", "fc", "e.*"), "seen")
    near = stored(_near(e, seen), "near")
    held = e.groupBy(F.col("w").alias("hw")).agg(F.count_distinct("h").alias("c"))
    common = near.join(held, "hw").groupBy("fw").agg(F.sum("c").alias("c")).where(F.col("c") > COMMON).select("fw", F.lit(True).alias("common"))
    near = near.join(common, "fw", "left")
    agree = ((F.col("hc") == F.col("fc")) | (F.col("hc") == "") | (F.col("fc") == "")) & ~(F.col("hj") & F.col("fj"))
    once = near.where("common IS NULL").join(e.select("h", "hc", F.col("w").alias("hw"), F.col("j").alias("hj")), "hw")
    once = once.join(seen.select("f", "fc", F.col("w").alias("fw"), F.col("j").alias("fj")), "fw").where(agree).select("h", "f")
    # names with a common word meet by country too; known ones meet unknown ones as "?", unknown ones meet all as "*"
    side = lambda t, s, *own: t.select(*own, *[F.col(c).alias(f"{s}{c}") for c in ("w", "j", "firm", "ini", "f0")], F.explode("t").alias("r")).select("*", *[F.col(f"r.{c}").alias(f"{s}{c}") for c in ("p", "n", "m", "o", "cls")]).drop("r")
    where = lambda c, known, unknown: F.explode(F.when(F.col(c) == "", F.array(*map(F.lit, unknown))).otherwise(F.array(F.col(c), F.lit(known)))).alias("place")
    right = seen.join(common.select(F.col("fw").alias("w")).hint("merge"), "w", "left_semi")
    right = stored(side(right, "f", "f", "fc").select("*", where("fc", "*", ["?", "*"])), "common")
    left = side(near.where("common").hint("merge").join(e.withColumnRenamed("w", "hw"), "hw").withColumn("w", F.col("hw")), "h", "h", "hc", "fw").select("*", where("hc", "?", ["*"]))
    refined = dealt_join(left, right, ["fw", "place"]).where(agree & _agreeing("h", "f")).select("h", "f")
    cand = once.unionByName(refined).distinct()
    cand = cand.join(ref_forms.select(F.col("f").alias("h"), F.col("words").alias("wa"), F.col("legal").alias("la"), F.col("firm").alias("fa")), "h")
    cand = cand.join(forms.select("f", F.col("words").alias("wb"), F.col("legal").alias("lb"), F.col("firm").alias("fb")), "f")
    judged = stored(_judged(cand), "judged")

    usual = ref_forms.select("f", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("c")).where(F.col("c") > COMMON).select("word")
    owners = ref_rows.withColumn("h", F.xxhash64("name", "cc")).groupBy("h").agg(F.min("id").alias("ref"))
    rivals = judged.where("verdict = 'other'").join(usual, "word", "left_anti").select("h", F.col("mark").alias("rival"), "firm").distinct()
    yes = judged.where("verdict <> 'other'").join(owners, "h").select("f", "h", "ref", "score", "mark", "firm", (F.col("verdict") == "same").alias("same"))
    best = yes.groupBy("f").agg(F.max("same").alias("any_same"), F.max(F.when(~F.col("same"), F.col("score"))).alias("top"))
    sure = yes.where("same").groupBy("f").agg(F.min(F.struct(-F.col("score"), F.col("ref"))).alias("m")).select("f", F.col("m.ref").alias("ref"))
    weak = yes.join(best.where("NOT any_same").select("f", "top"), "f").where(F.col("score") >= F.col("top") - 0.15)
    alone = weak.groupBy("f").agg(F.count_distinct("ref").alias("c"), F.min("ref").alias("ref")).where("c = 1").select("f", "ref")
    against = weak.join(rivals, ["h", "firm"]).where(F.col("firm") | (F.col("mark") == "") | (F.col("mark") == F.col("rival"))).select("f").distinct()
    decided = sure.unionByName(alone.join(against, "f", "left_anti"))
    out = rows.withColumn("f", F.xxhash64("name", "cc"))
    return skew_join(out, decided, "f").groupBy("id").agg(F.min("ref").alias("ref")).select(F.col("ref").alias(ref_key), F.col("id").alias(key))
