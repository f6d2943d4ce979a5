"""Languages of texts and of their segments by interpolated Kneser-Ney character models."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.session import stored

#: Longest n-gram, and the discount of Kneser-Ney.
ORDER, DISCOUNT = 4, 0.75
#: Bound of the training sample: sentences per labelled language (the least by hash of the sentence, over all labelled texts).
SAMPLE_SENTENCES = 1500
#: Letters from which a segment counts: in scripts with spaces, and in those without; and the words of a full sentence.
LEAST_LETTERS, LEAST_DENSE, LEAST_WORDS = 18, 7, 4
#: Bits that one letter costs at most: a made-up word then weighs alike in every language, however small its sample.
MOST_BITS = 7.0
#: Every so many-th sentence of a language is held out to calibrate its models.
HOLD = 8
#: A segment is rejected if its best language finds it stranger than this share of the other languages' held-out sentences.
REJECT_SHARE = 0.5
#: Tempers of the likelihoods to choose from, the one without held-out sentences, and the letters that count as evidence at most.
HEATS, HEAT, MOST_EVIDENCE = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7, 1.0), 0.25, 60

# Forms of language labels and the two-letter code they stand for.
LABELS = {
    "de": "de deu ger german deutsch", "en": "en eng english", "es": "es spa spanish espanol", "fr": "fr fra fre french francais", "it": "it ita italian italiano",
    "ja": "ja jpn jp japanese", "nl": "nl nld dut dutch nederlands", "pt": "pt por portuguese portugues", "ru": "ru rus russian", "sv": "sv swe swedish svenska", "zh": "zh zho chi cmn chinese",
}
_CODE = {form: code for code, forms in LABELS.items() for form in forms.split()}

_TAG = re.compile(r"<[^<>]{1,200}>")
_END = re.compile(r"(?<=[.!?…])[\"'»”’)]*\s+(?=[^\s\d(]|\d+\.\s|\()|(?<=[。！？])|[\r\n]+|(?<=[:;])\s+(?=[A-ZÀ-ÖØ-ÞА-Я])|(?<=[:;])\s*(?=[぀-ヿ㐀-鿿])")
_QUOTE = re.compile(r"[(\[]?\s?(?:„[^„“”\"]{1,80}[“”\"]|“[^“”]{1,80}”|«[^«»]{1,80}»|»[^«»]{1,80}«|\"[^\"]{1,80}\"|「[^「」]{1,40}」|『[^『』]{1,40}』|《[^《》]{1,40}》|‹[^‹›]{1,80}›)\s?[)\]]?")
_MARK = re.compile("[„“«»\"「『《‹›]")
_CITED = re.compile(r"[^.!?\n]{0,80}\bet al\b[^:\n]{0,80}:")
_WRAP = re.compile(r"-\s*[\r\n]+\s*(?=[^\W\d_])")
_LINE = re.compile(r"(?<![.!?:;。！？…\n])[ \t]*\r?\n[ \t]*(?=[^\W\d_A-ZÀ-ÖØ-ÞА-ЯЁ぀-ヿ㐀-鿿])")
_DROP = re.compile(r"(?<![A-Za-z\d])[A-Za-z]*\d[A-Za-z\d]*|(\w)\1{4,}|[^\w\s'’-]|[\d_]")
_DENSE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")


def label(c: Column) -> Column:
    """The two-letter code that a label stands for, null if it is unusable. ``EN``, ``deu`` and ``fr-CA`` are fine labels."""
    head = F.split(F.lower(F.trim(c)), "[-_]")[0]
    table = F.create_map(*[F.lit(x) for kv in sorted(_CODE.items()) for x in kv])
    return F.when(c.isNotNull() & (F.trim(c) != ""), F.try_element_at(table, head))


def segments(text: str | None) -> list[str]:
    """The sentences of a text, without markup, quoted words and heads of citations; lines broken inside a sentence are joined."""
    if not text or not text.strip():
        return []
    t = html.unescape(_TAG.sub(" ", text)) if "<" in text or "&" in text else text
    t = unicodedata.normalize("NFKC", t)
    if _MARK.search(t):
        t = _QUOTE.sub(" ", t)
    if "et al" in t:
        t = _CITED.sub("\n", t)
    if "\n" in t or "\r" in t:
        t = _LINE.sub(" ", _WRAP.sub("", t))
    return [s.strip() for s in _END.split(t) if s and s.strip()]


def letters(segment: str) -> str:
    """A segment as the models read it: lower case, single spaces, no digits, signs, formulas and runs of one letter."""
    return " ".join(_DROP.sub(" ", segment.replace("’", "'")).lower().split())


def weighs(plain: str) -> bool:
    """Whether a segment is long enough for a full sentence."""
    dense = len(_DENSE.findall(plain))
    if dense * 2 >= len(plain.replace(" ", "")) > 0:
        return dense >= LEAST_DENSE
    return len(plain) >= LEAST_LETTERS and sum(len(w) > 1 for w in plain.split()) >= LEAST_WORDS


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(points: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 0..order: the hash of the n letters that end at each position."""
    out = [np.zeros(len(points), dtype=np.uint64)]
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            h = np.full(len(points), n, dtype=np.uint64)
            for back in range(n - 1, -1, -1):
                moved = np.zeros(len(points), dtype=np.uint64)
                moved[back:] = points[: len(points) - back]
                h = (h ^ moved) * _MIX
                h ^= h >> np.uint64(29)
            out.append(h)
    return out


def _points(plain: str) -> np.ndarray:
    return np.frombuffer((" " * (ORDER - 1) + " " + plain + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


class _Sorted:
    """A sorted array of hashes with a value per hash; the first bits of a hash say where to begin to look."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(1, min(22, int(len(keys)).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        heads = (keys >> self.shift).astype(np.int64)
        self.start = np.searchsorted(heads, np.arange((1 << bits) + 1))
        self.most = int(np.diff(self.start).max(initial=0))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it is none of the keys."""
        head = (hashes >> self.shift).astype(np.int64)
        at, end = self.start[head], self.start[head + 1]
        out = np.full(len(hashes), -1, dtype=np.int64)
        open_ = np.flatnonzero(at < end)
        for _ in range(self.most):
            if not len(open_):
                break
            here = at[open_]
            hit = self.keys[here] == hashes[open_]
            out[open_[hit]] = here[hit]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


class Models:
    """One interpolated Kneser-Ney model per language; the n-grams of all lie in sorted hash arrays with a column per language.

    The arrays hold the interpolated probability of every n-gram that any language has, so that a letter whose n-gram is
    known costs one look; only the others look up what their context leaves to the shorter n-gram.

    Held-out sentences (every ``HOLD``-th of a language) calibrate what the models say: how strange a language may find a
    sentence that it accepts, and how a margin in bits becomes a confidence (``heat``), on pieces as short as a segment may be.
    """

    def __init__(self, samples: dict[str, list[str]], calibrate: bool = True):
        self.langs = sorted(samples)
        self.floor = 1.0 / 20000
        held = {lang: samples[lang][::HOLD] for lang in self.langs} if calibrate else {}
        kept = {lang: [p for i, p in enumerate(samples[lang]) if not calibrate or i % HOLD] or samples[lang] for lang in self.langs}
        tables = [self._count(kept[lang]) for lang in self.langs]
        self.grams: list[_Sorted] = []
        self.contexts: list[_Sorted] = []
        for n in range(1, ORDER + 1):
            leave = self._merge([t[n - 1][1] for t in tables], 1.0)
            share = self._merge([t[n - 1][0] for t in tables], 0.0)
            keys, first = np.unique(np.concatenate([t[n - 1][0][0] for t in tables]), return_index=True)
            ctx, end = (np.concatenate([t[n - 1][2][i] for t in tables])[first] for i in (0, 1))
            lower = self.grams[-1].values[self.grams[-1].places(end)] if n > 1 else self.floor
            self.contexts.append(leave)
            self.grams.append(_Sorted(keys, (share.values + leave.values[leave.places(ctx)] * lower).astype(np.float32)))
        self.bits = self._bits(self.grams[-1].values)
        self.strange, self.heat = np.full(len(self.langs), 99.0), HEAT
        if calibrate:
            self._calibrate({lang: v for lang, v in held.items() if v})

    @staticmethod
    def _bits(p: np.ndarray) -> np.ndarray:
        return np.minimum(-np.log2(np.maximum(p, 1e-9)), MOST_BITS).astype(np.float32)

    def _calibrate(self, held: dict[str, list[str]]) -> None:
        got = {lang: self.score(v) for lang, v in held.items()}
        for k, lang in enumerate(self.langs):
            others = np.concatenate([v[:, k] for other, v in got.items() if other != lang] or [np.array([99.0])])
            self.strange[k] = np.quantile(others, REJECT_SHARE)
        pieces = [(self.langs.index(lang), p[: LEAST_DENSE if _DENSE.search(p) else LEAST_LETTERS]) for lang, v in held.items() for p in v]
        bits, sizes = self.score([p for _, p in pieces]), np.array([len(p) for _, p in pieces])
        losses = {}
        for heat in HEATS:
            losses[heat] = -np.log(np.maximum(self._shares(bits, sizes, heat)[np.arange(len(pieces)), [k for k, _ in pieces]], 1e-9)).mean() if pieces else 0.0
        self.heat = min(losses, key=losses.get) if pieces else HEAT

    @staticmethod
    def _shares(bits: np.ndarray, sizes: np.ndarray, heat: float) -> np.ndarray:
        """Each language's share in the tempered likelihoods of a text."""
        odds = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) * np.minimum(sizes, MOST_EVIDENCE)[:, None] * heat)
        return odds / odds.sum(axis=1, keepdims=True)

    @staticmethod
    def _count(sentences: list[str]) -> list:
        """Per order: the discounted share of each n-gram, the weight that each context leaves to the shorter one, and the context and the shorter end of each n-gram."""
        pts = [_points(x) for x in sentences] or [_points("")]
        sizes = np.array([len(p) for p in pts])
        hs = _hashes(np.concatenate(pts), ORDER)
        at = np.concatenate([np.arange(e - n + ORDER, e) for e, n in zip(np.cumsum(sizes), sizes)])
        uniq = [np.unique(hs[n][at], return_index=True, return_counts=True) for n in range(1, ORDER + 1)]
        out: list = [None] * ORDER
        counts = uniq[-1][2].astype(float)
        for n in range(ORDER, 0, -1):
            keys, first, _ = uniq[n - 1]
            of = hs[n - 1][at - 1][first]
            ctx, place = np.unique(of, return_inverse=True)
            total, kinds = np.bincount(place, weights=counts), np.bincount(place)
            share = np.maximum(counts - DISCOUNT, 0) / total[place]
            out[n - 1] = ((keys, share), (ctx, DISCOUNT * kinds / total), (of, hs[n - 1][at][first]))
            if n > 1:  # continuation counts: of how many longer n-grams a shorter one is the end
                ends = np.searchsorted(uniq[n - 2][0], hs[n - 1][at][first])
                counts = np.bincount(ends, minlength=len(uniq[n - 2][0])).astype(float)
        return out

    @staticmethod
    def _merge(tables: list[tuple[np.ndarray, np.ndarray]], missing: float) -> _Sorted:
        keys = np.unique(np.concatenate([k for k, _ in tables]))
        values = np.full((len(keys), len(tables)), missing, dtype=np.float32)
        for k, (own, v) in enumerate(tables):
            values[np.searchsorted(keys, own), k] = v
        return _Sorted(keys, values)

    def _chance(self, hs: list[np.ndarray], at: np.ndarray, n: int) -> np.ndarray:
        """The probability of the letters at some positions by n-grams of up to ``n``."""
        if n == 0:
            return np.full((len(at), len(self.langs)), self.floor, dtype=np.float32)
        place = self.grams[n - 1].places(hs[n][at])
        p = self.grams[n - 1].values[place]
        if len(lost := np.flatnonzero(place < 0)):
            ctx = self.contexts[n - 1].places(hs[n - 1][at[lost] - 1])
            lower = self._chance(hs, at[lost], n - 1)
            lower[ctx >= 0] *= self.contexts[n - 1].values[ctx[ctx >= 0]]
            p[lost] = lower
        return p

    def score(self, plains: list[str]) -> np.ndarray:
        """Cross-entropy in bits per letter of each plain text under each language."""
        if not plains:
            return np.zeros((0, len(self.langs)))
        pad = " " * ORDER
        pts = np.frombuffer((pad + (" " + pad).join(plains) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, plains), dtype=np.int64, count=len(plains)) + 1
        ends = np.cumsum(sizes + ORDER)
        real = np.ones(len(pts), dtype=bool)
        for k in range(ORDER):
            real[ends - sizes - ORDER + k] = False
        at = np.flatnonzero(real)
        hs = _hashes(pts, ORDER)
        place = self.grams[-1].places(hs[ORDER][at])
        bits = self.bits[place]
        if len(lost := np.flatnonzero(place < 0)):
            bits[lost] = self._bits(self._chance(hs, at[lost], ORDER))
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        return np.add.reduceat(bits, starts, axis=0, dtype=np.float64) / sizes[:, None]

    def label(self, plains: list[str]) -> list[tuple[str | None, float]]:
        """(language, confidence) of each plain text; None where even the best model finds the text too strange.

        The confidence is the share of the best language in the likelihoods of a text of this length, tempered as the
        held-out pieces ask.
        """
        got = self.score(plains)
        if not len(got):
            return []
        best = got.argmin(axis=1)
        low = got[np.arange(len(got)), best]
        sure = self._shares(got, np.array([len(p) for p in plains]), self.heat).max(axis=1)
        return [(self.langs[b] if v <= self.strange[b] else None, float(c)) for b, v, c in zip(best, low, sure)]


def sentences(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, pos, code, plain) of every segment that is long enough, as the models read it; code is the label given, null if unusable.

    The texts are split here and nowhere else. Null, empty and blank texts and those without running text give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, c, i, plain) for k, t, c in zip(pdf["key"], pdf["t"], pdf["code"]) for i, s in enumerate(segments(t)) if weighs(plain := letters(s))]
            if rows:
                yield pd.DataFrame({"key": [r[0] for r in rows], "code": [r[1] for r in rows], "pos": [r[2] for r in rows], "plain": [r[3] for r in rows]})

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"), label(F.col(lang)).alias("code")).where("key IS NOT NULL AND t IS NOT NULL")
    return stored(rows.mapInPandas(run, f"key {kind}, code string, pos int, plain string"), "sentences")


def training_sample(rows: DataFrame, most: int = SAMPLE_SENTENCES) -> dict[str, list[str]]:
    """At most ``most`` sentences per language of the texts labelled with it, those with the least hashes of all.

    Every labelled text takes part: partial counts of distinct sentences give a bound on the hash that about twice ``most``
    sentences of a language fall under; only these are told apart and ordered, so no task holds a language.
    """
    h = F.pmod(F.xxhash64("plain"), F.lit(1 << 40))
    given = rows.where("code IS NOT NULL").select("code", "plain", h.alias("h"))
    counts = given.groupBy("code").agg(F.approx_count_distinct("plain", 0.02).alias("n"))
    bound = F.when(F.col("n") <= 2 * most, F.lit(1 << 40)).otherwise(F.lit(2.0 * most * (1 << 40)) / F.col("n"))
    few = given.join(F.broadcast(counts.select("code", bound.alias("bound"))), "code").where("h < bound").select("code", "plain", "h").distinct()
    kept = few.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("h", "plain"))).where(F.col("r") <= most)
    out: dict[str, list[str]] = defaultdict(list)
    for r in kept.select("code", "plain").collect():
        out[r[0]].append(r[1])
    return {c: sorted(v, key=hash_of) for c, v in out.items()}


def hash_of(plain: str) -> tuple[int, str]:
    """An order of sentences that has nothing to do with what they say."""
    return crc32(plain.encode("utf-8", "surrogatepass")), plain


def train(samples: dict[str, list[str]], rounds: int = 2, folds: int = 3) -> Models:
    """Models of a sample with wrong labels in it: what models trained on the other folds give to another language is left out."""
    samples = {lang: v for lang, v in samples.items() if v}
    for _ in range(rounds):
        kept: dict[str, list[str]] = {lang: [] for lang in samples}
        for fold in range(folds):
            models = Models({lang: [p for i, p in enumerate(v) if i % folds != fold] or v for lang, v in samples.items()}, calibrate=False)
            for lang, plains in samples.items():
                own = plains[fold::folds]
                kept[lang] += [p for p, best in zip(own, models.score(own).argmin(axis=1)) if models.langs[best] == lang]
        samples = {lang: sorted(v, key=hash_of) if len(v) >= max(3, len(samples[lang]) // 5) else samples[lang] for lang, v in kept.items()}
    return Models(samples)


def labelled_segments(rows: DataFrame, models: Models) -> DataFrame:
    """(key, pos, n_letters, lang, confidence) of every sentence; lang is null where every model rejects it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes, distinct = pd.factorize(pdf["plain"])
            names: list[tuple[str | None, float]] = []
            for a in range(0, len(distinct), 2000):
                names += models.label(list(distinct[a : a + 2000]))
            got = [names[c] for c in codes]
            yield pd.DataFrame({"key": pdf["key"], "pos": pdf["pos"], "n_letters": pdf["plain"].str.len().astype("int32"), "lang": pd.Series([g[0] for g in got], dtype=object, index=pdf.index), "confidence": [g[1] for g in got]})

    kind = dict(rows.dtypes)["key"]
    return rows.select("key", "pos", "plain").mapInPandas(run, f"key {kind}, pos int, n_letters int, lang string, confidence double")


def segment_languages(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, pos, n_letters, lang, confidence) of every segment that is long enough, pos counted over all segments of its text; lang is null where every model rejects it. An empty table, or one without a usable label, gives no languages."""
    rows = sentences(docs, key, text, lang)
    samples = training_sample(rows)
    if not samples:
        return rows.select(F.col("key").alias(key), "pos", F.length("plain").alias("n_letters"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"))
    return labelled_segments(rows, train(samples)).withColumnRenamed("key", key)


def text_languages(docs: DataFrame, key: str, text: str, lang: str, least_confidence: float = 0.8) -> DataFrame:
    """(key, lang, confidence, n_segments, n_langs, given): a row per text and language with at least one sure full sentence.

    Sentences below ``least_confidence`` count only where the text has no other. ``given`` is the code of the label as
    delivered, null if missing or unusable. Null, empty and blank texts, those without sentences and those whose sentences
    are all rejected have one row with a null language and no languages.
    """
    seg = stored(segment_languages(docs, key, text, lang).where("lang IS NOT NULL").withColumnRenamed(key, "key"), "segments")
    by = seg.groupBy("key", "lang").agg(
        F.sum((F.col("confidence") >= least_confidence).cast("int")).alias("n_segments"), F.max("confidence").alias("best"),
        (F.sum(F.col("confidence") * F.col("n_letters")) / F.sum("n_letters")).alias("confidence"),
    )
    top = by.groupBy("key").agg(F.sum((F.col("n_segments") > 0).cast("int")).alias("sure"), F.max(F.struct("best", "lang")).alias("m"))
    kept = by.join(top, "key").where((F.col("n_segments") > 0) | ((F.col("sure") == 0) & (F.col("lang") == F.col("m.lang"))))
    given = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), label(F.col(lang)).alias("given"))
    out = given.join(kept.select("key", "lang", "confidence", F.col("n_segments").cast("long"), F.greatest("sure", F.lit(1)).cast("long").alias("n_langs")), "key", "left")
    out = out.select("key", "lang", "confidence", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.coalesce("n_langs", F.lit(0)).alias("n_langs"), "given")
    return out.withColumnRenamed("key", key)


def label_cases(found: DataFrame, key: str) -> DataFrame:
    """(key, lang) of the texts whose label is missing, unusable or another language, and of all texts in several languages."""
    return found.where(F.col("lang").isNotNull()).where((F.col("n_langs") > 1) | F.col("given").isNull() | (F.col("given") != F.col("lang"))).select(key, "lang")
