"""Evaluation texts that leak into training texts, found through suffix arrays over shards of the corpus."""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.session import stored

#: Words of a passage that count as a leak, and the share of words that may be replaced, dropped or added.
LEAST_WORDS, EDIT_SHARE = 20, 1 / 7
#: Words of a verbatim seed: a passage of 20 words with 3 edits has a run of at least 5 words; one less for words broken at a line's end.
SEED_WORDS = 4
#: Seeds that any passage has: 20 words less 3 edits are 17 words in at most 4 runs, so 17 - 4 * 3 = 5; two may be lost to words run together.
LEAST_SEEDS = 3
#: Letters of corpus text in one shard (one suffix array), and of evaluation text in one block. Neither changes the result.
SHARD_CHARS, BLOCK_CHARS = 4_000_000, 2_000_000
#: Letters of evaluation text that are broadcast at most; more are joined to the shards by shuffle.
MOST_BROADCAST = 64_000_000
#: Parquet options of the stored shards: the size of a row group is looked at after every row, not after a hundred.
ROW_GROUPS = {"parquet.block.size": 1 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
#: Letters of a suffix that are sorted at once; suffixes that agree in them are sorted on by what follows.
HEAD = 24

_TAG = re.compile(r"<[^<>]{1,200}>")
_MARKS = re.compile("[\u0300-\u036f]+")
#: Bytes of ASCII signs as spaces, letters and digits as they are, and bytes of other characters as they are.
_SIGNS = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def coded_words(text: str | None) -> list[bytes]:
    """Words of letters and digits without case, accents and markup, in UTF-8."""
    if not text:
        return []
    t = html.unescape(_TAG.sub(" ", text)) if "<" in text or "&" in text else text
    if t.isascii():
        t = t.lower()
    else:
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t.replace("\u00ad", "").casefold()))
        if not t.isascii():
            for c in set(t):
                if c > "\x7f" and (unicodedata.combining(c) or not c.isalnum()):
                    t = t.replace(c, "" if unicodedata.combining(c) else " ")
    return t.encode("utf-8", "surrogatepass").translate(_SIGNS).split()


def words(text: str | None) -> list[str]:
    """As ``coded_words``, decoded."""
    return [w.decode("utf-8", "surrogatepass") for w in coded_words(text)]


def _heads(letters: bytes, begins: np.ndarray) -> np.ndarray:
    """The first letters of the suffixes, up to the end of their text."""
    grid = np.frombuffer(letters + b"\x00" * HEAD, dtype=np.uint8)
    # windows are views: places of single letters would take eight bytes for each
    keys = np.lib.stride_tricks.sliding_window_view(grid, HEAD)[begins] if len(begins) else np.zeros((0, HEAD), dtype=np.uint8)
    keys = np.ascontiguousarray(keys)
    # few suffixes end inside their head; eight letters at once tell which
    parts = keys.view(np.uint64)
    ending = np.flatnonzero((((parts - np.uint64(0x0101010101010101)) & ~parts & np.uint64(0x8080808080808080)) != 0).any(axis=1))
    few = keys[ending]
    few[np.logical_or.accumulate(few == 0, axis=1)] = 0
    keys[ending] = few
    return keys.view(f"S{HEAD}").ravel()


class Shard:
    """A suffix array: all suffixes of some texts that begin at a word, in the full order of their letters without spaces."""

    def __init__(self, letters: bytes, begins: np.ndarray, first: np.ndarray, order: np.ndarray | None = None):
        """``begins``: where each word begins; ``first``: the number of each text's first word. Every text ends with a zero."""
        self.letters, self.begins, self.first = letters, begins, first
        heads = _heads(letters, begins)
        if order is None:
            order = np.argsort(heads, kind="stable")
            heads = heads[order]
            self._refine(order, heads)
            self.order, self.heads = order, heads
        else:
            self.order, self.heads = order, heads[order]
        self.text = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(begins))))[self.order]

    @classmethod
    def of(cls, texts: list[bytes]) -> Shard:
        """The array of texts given as their words with single spaces between."""
        return cls.read(b"".join(t + b"\x00" for t in texts))

    @classmethod
    def read(cls, joined: bytes, order: np.ndarray | None = None) -> Shard:
        """The array of texts that each end with a zero, with its order if that is known already."""
        grid = np.frombuffer(joined, dtype=np.uint8)
        apart = (grid == 32) | (grid == 0)
        starts = np.flatnonzero(np.concatenate([[True], apart[:-1]]) & (grid != 0)) if len(grid) else np.zeros(0, dtype=np.int64)
        spaces = np.cumsum(grid == 32, dtype=np.int32)
        first = np.searchsorted(starts, np.concatenate([[0], np.flatnonzero(grid == 0) + 1])[:-1], "left")
        return cls(joined.replace(b" ", b""), (starts - spaces[starts] if len(starts) else starts).astype(np.int64), first.astype(np.int64), order)

    def _refine(self, order: np.ndarray, heads: np.ndarray, rounds: int = 6) -> None:
        """Puts suffixes that agree in all letters of their head in order: in a few rounds by the next letters of all of them at once, and what then still agrees one group at a time."""
        keys, at, skip = heads, np.arange(len(order)), HEAD
        group = np.zeros(len(order), dtype=np.int64)
        for turn in range(rounds + 1):
            parts = keys.view(np.uint64).reshape(-1, HEAD // 8)
            same = (parts[1:] == parts[:-1]).all(axis=1) & (group[1:] == group[:-1])
            tied = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(at) else np.zeros(0, bool)
            new = np.cumsum(np.concatenate([[True], ~same])) if len(at) else group
            tied &= keys.view(np.uint8).reshape(-1, HEAD)[:, -1] != 0
            at, group = at[tied], new[tied]
            if not len(at):
                return
            if turn == rounds:
                cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1), len(at)]
                for a, b in zip(cuts, cuts[1:]):
                    order[at[a:b]] = self._sorted(order[at[a:b]].tolist(), skip, 1024)
                return
            keys = _heads(self.letters, self.begins[order[at]] + skip)
            turned = np.lexsort((keys, group))
            order[at], keys = order[at][turned], keys[turned]
            skip += HEAD

    def _sorted(self, group: list[int], skip: int, size: int) -> list[int]:
        """Suffixes that agree in their first ``skip`` letters in the order of what follows, looked at in growing pieces."""
        text, begins = self.letters, self.begins
        piece = {i: text[begins[i] + skip : begins[i] + skip + size].split(b"\x00", 1)[0] for i in group}
        group.sort(key=piece.__getitem__)
        out, a = [], 0
        while a < len(group):
            b = a + 1
            while b < len(group) and piece[group[b]] == piece[group[a]]:
                b += 1
            tied = group[a:b]
            out += self._sorted(tied, skip + size, size * 8) if b - a > 1 and len(piece[group[a]]) == size else tied
            a = b
        return out

    def suffix(self, place: int, size: int) -> bytes:
        b = self.begins[self.order[place]]
        return self.letters[b : b + size].split(b"\x00", 1)[0]

    def ranges(self, seeds: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the first place of the array whose suffix begins with it, and the place behind the last."""
        low = np.array([s[:HEAD] for s in seeds], dtype=f"S{HEAD}")
        high = np.array([s[:HEAD] + b"\xff" * (HEAD - len(s[:HEAD])) for s in seeds], dtype=f"S{HEAD}")
        lo, hi = np.searchsorted(self.heads, low, "left"), np.searchsorted(self.heads, high, "right")
        for i in np.flatnonzero(hi > lo):
            if len(s := seeds[i]) > HEAD:
                n = len(s)
                a = bisect_left(range(int(lo[i]), int(hi[i])), s, key=lambda p: self.suffix(p, n)) + int(lo[i])
                b = bisect_left(range(a, int(hi[i])), True, key=lambda p: self.suffix(p, n) > s) + a
                lo[i], hi[i] = a, b
        return lo, hi

    def longest(self, suffix: bytes) -> tuple[int, int]:
        """(letters, place) of the longest beginning of a text that stands somewhere in the shard: it is at one of the two neighbours in the order."""
        at = bisect_left(range(len(self.order)), suffix, key=lambda p: self.suffix(p, len(suffix)))
        best = (0, -1)
        for p in (at - 1, at):
            if 0 <= p < len(self.order):
                other = self.suffix(p, len(suffix))
                n = next((k for k, (x, y) in enumerate(zip(other, suffix)) if x != y), min(len(other), len(suffix)))
                best = max(best, (n, p))
        return best

    def letters_of(self, text: int) -> bytes:
        a = self.begins[self.first[text]]
        return self.letters[a : self.letters.index(b"\x00", a)]

    def words_of(self, text: int) -> list[str]:
        a, b = self.first[text], self.first[text + 1] if text + 1 < len(self.first) else len(self.begins)
        cuts = self.begins[a:b].tolist()
        end = self.letters.index(b"\x00", cuts[-1])
        return [self.letters[x:y].decode("utf-8", "surrogatepass") for x, y in zip(cuts, cuts[1:] + [end])]


def _mended(text: list[str], known: set[str], pairs: dict[str, tuple[str, str]]) -> list[str]:
    """The words of a window, with words of the item that a line's end broke joined again, and two that run together parted."""
    out, j = [], 0
    while j < len(text):
        for k in (2, 3):
            if j + k <= len(text) and "".join(text[j : j + k]) in known and not all(w in known for w in text[j : j + k]):
                out.append("".join(text[j : j + k]))
                j += k
                break
        else:
            out += pairs[text[j]] if text[j] in pairs and text[j] not in known else [text[j]]
            j += 1
    return out


def passage(item: list[str], text: list[str], at: np.ndarray, rare: set[str], least: int = LEAST_WORDS, share: float = EDIT_SHARE) -> bool:
    """Whether ``text`` holds ``least`` successive words of ``item`` with at most that share of edits.

    ``at``: rows (text word, item word) of seeds, sorted; the text near each group of seeds is aligned with the item by edits.
    ``rare``: the item's words that few other items have. A passage that keeps none of its rare words, or under a third of
    them, has the wording of the item but speaks of something else.
    """
    known, pairs = set(item), {a + b: (a, b) for a, b in zip(item, item[1:])}
    covered = 0
    for j, i in at.tolist():
        if j < covered:
            continue
        a = max(0, j - i - len(item) // 4 - 8)
        covered = min(len(text), max(j - i, 0) + len(item) + len(item) // 2 + 16)
        near = at[np.searchsorted(at[:, 0], a, "left") : np.searchsorted(at[:, 0], covered, "left"), 1]
        if len(np.unique(near)) < LEAST_SEEDS:
            continue
        window = _mended(text[a:covered], known, pairs)
        if (not rare or rare & set(window)) and _aligned(item, window, rare, least, share):
            return True
    return False


def _aligned(x: list[str], y: list[str], rare: set[str], least: int, share: float, gap: float = -1.6) -> bool:
    """Local alignment of the item ``x`` with the window ``y``, then a scan of the steps behind every end of a matching run for a passage that is good enough."""
    n, m = len(x), len(y)
    ids = {w: k for k, w in enumerate(set(x) | set(y))}
    same = np.array([ids[w] for w in x])[:, None] == np.array([ids[w] for w in y])[None, :]
    score, slope = np.zeros((n + 1, m + 1)), gap * np.arange(m)
    for i in range(1, n + 1):
        up = score[i - 1]
        row = np.maximum(np.maximum(up[:-1] + np.where(same[i - 1], 1.0, gap), up[1:] + gap), 0.0)
        score[i, 1:] = np.maximum(row, np.maximum.accumulate(row - slope) + slope)
    # a passage ends with a kept word; behind the last word of a run of kept ones no longer run can begin
    ends = same.copy()
    ends[:-1, :-1] &= ~same[1:, 1:]
    ends &= score[1:, 1:] >= least * (1 - share) + gap * (least * share + 1)
    rows, cols = np.nonzero(ends)
    kept_rare = np.array([w in rare for w in x])
    for e in np.argsort(-score[rows + 1, cols + 1], kind="stable"):
        i, j = int(rows[e]) + 1, int(cols[e]) + 1
        steps: list[tuple[int, int, int, int]] = []  # item words, edits, kept rare and lost rare words, from the end
        while i > 0 and j > 0 and score[i, j] > 1e-9:
            v, w = score[i, j], bool(kept_rare[i - 1])
            if same[i - 1, j - 1] and abs(v - score[i - 1, j - 1] - 1) < 1e-6:
                steps.append((1, 0, w, 0))
                i, j = i - 1, j - 1
            elif abs(v - score[i - 1, j - 1] - gap) < 1e-6:
                steps.append((1, 1, 0, w))
                i, j = i - 1, j - 1
            elif abs(v - score[i - 1, j] - gap) < 1e-6:
                steps.append((1, 1, 0, w))
                i -= 1
            else:
                steps.append((0, 1, 0, 0))
                j -= 1
        run = np.concatenate([np.zeros((1, 4), dtype=np.int64), np.cumsum(np.array(steps, dtype=np.int64), axis=0)])
        exact = np.array([s[1] == 0 for s in steps])
        part = run[None, 1:, :] - run[:-1, None, :]  # from step a to step b
        good = (part[..., 0] >= least) & (part[..., 1] <= part[..., 0] * share + 0.5) & exact[:, None] & exact[None, :]
        if rare:
            good &= 2 * part[..., 2] >= np.maximum(part[..., 3], 1)
        if good.any():
            return True
    return False


def corpus_shards(docs: DataFrame, key: str, text: str, least: int = LEAST_WORDS, chars: int | None = None) -> DataFrame:
    """The stored suffix arrays of a corpus, one row per shard: keys, the text of each key, the texts, order.

    Texts stay in the partition that reads them: nothing is shuffled. Copies of a text inside a shard stand in its array
    once. A text above the bound is a shard of its own; null texts and those of under half a passage are left out.
    Each shard is a row group of its own: a task holds one at a time, however many its partition has.
    """
    chars = chars or SHARD_CHARS
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row() -> pd.DataFrame:
            joined = b"".join(t + b"\x00" for t in seen)
            data = [np.array(of, dtype=np.int32).tobytes(), joined, Shard.read(joined).order.astype(np.int32).tobytes()]
            return pd.DataFrame([[keys, *data]], columns=["keys", "of", "texts", "order"])

        keys, of, size = [], [], 0
        seen: dict[bytes, int] = {}
        for pdf in batches:
            for k, t in zip(pdf[key], pdf[text]):
                coded = coded_words(t)
                if len(coded) < max(least // 2, 1):
                    continue
                ws = b" ".join(coded)
                if ws not in seen:
                    seen[ws] = len(seen)
                    size += len(t)
                keys.append(k)
                of.append(seen[ws])
                if size >= chars:
                    yield row()
                    keys, of, size, seen = [], [], 0, {}
        if keys:
            yield row()

    given = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)
    return stored(given.mapInPandas(run, f"keys array<{kind}>, of binary, texts binary, order binary"), "shards", **ROW_GROUPS)


def item_blocks(items: DataFrame, item_key: str, item_text: str, least: int = LEAST_WORDS, chars: int | None = None) -> tuple[DataFrame, int]:
    """((block, ids, texts, rares), n): the items of at least ``least`` words in ``n`` blocks of about ``chars`` letters, with the rare words of each.

    Rare are words (not numbers) that at most two items, or a hundredth of all, have; they are counted over all items, whatever the blocks.
    """
    kind = dict(items.dtypes)[item_key]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(i, ws) for i, t in zip(pdf["i"], pdf["t"]) if len(ws := words(t)) >= least]
            if got:
                yield pd.DataFrame({"id": [i for i, _ in got], "ws": [ws for _, ws in got]})

    given = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).alias("i"), F.col(item_text).alias("t"))
    rows = stored(given.mapInPandas(split, f"id {kind}, ws array<string>").withColumn("u", F.xxhash64("id", "ws")), "items")
    n, size = rows.agg(F.count("*"), F.sum(F.length(F.array_join("ws", "")))).first()
    blocks = max(1, -(-(size or 0) // (chars or BLOCK_CHARS)))
    held = rows.select("u", F.explode(F.array_distinct("ws")).alias("w")).where(~F.col("w").rlike(r"^\p{N}+$"))
    few = held.groupBy("w").agg(F.count("*").alias("c")).where(F.col("c") <= max(2, n // 100)).select("w")
    rare = held.join(few, "w").groupBy("u").agg(F.collect_list("w").alias("rare"))
    rows = rows.join(rare, "u", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<string>")))
    block = F.pmod(F.col("u"), F.lit(blocks)).cast("int").alias("block")
    return rows.select(block, "id", "ws", "rare").groupBy("block").agg(F.collect_list(F.struct("id", "ws", "rare")).alias("items")), blocks


def matches(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = LEAST_WORDS) -> DataFrame:
    """(key, item_key, n_words, doc_word, item_word): every text that holds a passage of an item, once, with the longest run of words that it has verbatim from it and where that begins in both.

    The corpus is cut into shards whose suffix arrays are stored once; every item suffix is looked up in every array by
    binary search, runs of verbatim words are joined to the longest ones, and the places are aligned with the item. Null and empty texts hold nothing; items with fewer than ``least`` words leak nowhere.
    """
    shards = corpus_shards(docs, key, text, least)
    blocks, n = item_blocks(items, item_key, item_text, least)
    blocks = stored(blocks, "blocks")
    small = n * BLOCK_CHARS <= MOST_BROADCAST
    wide = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = wide.join(F.broadcast(blocks) if small else blocks.hint("merge"), "block")
    kinds, item_kind = dict(docs.dtypes), dict(items.dtypes)[item_key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one shard at a time becomes Python objects, and the items of a block once
        ready: dict[int, tuple] = {}
        for batch in batches:
            columns = {c: batch.column(c) for c in ("block", "items", "keys", "of", "texts", "order")}
            id_kind = columns["items"].type.value_type.field("id").type
            for at in range(batch.num_rows):
                if (block := columns["block"][at].as_py()) not in ready:
                    ready = {block: _ready(columns["items"][at].as_py())}
                rows = _search(Shard.read(columns["texts"][at].as_py(), np.frombuffer(columns["order"][at].as_buffer(), dtype=np.int32)), *ready[block], least)
                if not rows:
                    continue
                owners: dict[int, list[int]] = {}
                for j, d in enumerate(np.frombuffer(columns["of"][at].as_buffer(), dtype=np.int32).tolist()):
                    owners.setdefault(d, []).append(j)
                keys = columns["keys"][at].values
                out = [(j, *r[1:]) for r in rows for j in owners[r[0]]]
                data = [keys.take(pa.array([r[0] for r in out])), pa.array([r[1] for r in out], id_kind), *(pa.array([r[c] for r in out], pa.int32()) for c in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays(data, names=[key, item_key, "n_words", "doc_word", "item_word"])

    return met.mapInArrow(run, f"{key} {kinds[key]}, {item_key} {item_kind}, n_words int, doc_word int, item_word int")


def _ready(items: list) -> tuple:
    """(ids, words, rare words, distinct seeds, seed of each item word, item of each, place of each) of a block of items."""
    ids, texts, rare = [r["id"] for r in items], [list(r["ws"]) for r in items], [set(r["rare"]) for r in items]
    numbers: dict[bytes, int] = {}
    entries = [(numbers.setdefault("".join(ws[k : k + SEED_WORDS]).encode(), len(numbers)), n, k) for n, ws in enumerate(texts) for k in range(len(ws) - SEED_WORDS + 1)]
    return ids, texts, rare, list(numbers), np.array(sorted(entries), dtype=np.int64).reshape(-1, 3)


def _search(shard: Shard, ids: list, texts: list[list[str]], rare: list[set[str]], seeds: list[bytes], entries: np.ndarray, least: int) -> list[tuple]:
    """(text, item id, words, text word, item word) of the texts of a shard that hold a passage of an item."""
    if not seeds or not len(shard.order):
        return []
    lo, hi = shard.ranges(seeds)
    found = entries[(hi > lo)[entries[:, 0]]]
    n = (hi - lo)[found[:, 0]]
    place = np.repeat(lo[found[:, 0]] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
    item, at = np.repeat(found[:, 1], n), np.repeat(found[:, 2], n)
    doc = shard.text[place]
    word = shard.order[place] - shard.first[doc]
    order = np.lexsort((at, word, item, doc))
    doc, item, word, at = doc[order], item[order], word[order], at[order]
    cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])) if len(doc) else np.zeros(0, int)
    out, coded = [], [[w.encode() for w in ws] for ws in rare]
    last, held = -1, b""
    for a, b in zip(cuts, [*cuts[1:], len(doc)]):
        if b - a < LEAST_SEEDS:
            continue
        d, i = int(doc[a]), int(item[a])
        # the rare words that a passage must keep stand in the letters of its text, however it is broken
        if d != last:
            last, held = d, shard.letters_of(d)
        if coded[i] and not any(w in held for w in coded[i]):
            continue
        spots = np.stack([word[a:b], at[a:b]], axis=1)
        if passage(texts[i], shard.words_of(d), spots, rare[i], least):
            out.append((d, ids[i], *_longest_run(spots)))
    return out


def _longest_run(spots: np.ndarray) -> tuple[int, int, int]:
    """(words, text word, item word) of the longest run of seeds that follow each other in both."""
    order = np.lexsort((spots[:, 0], spots[:, 0] - spots[:, 1]))
    w, k = spots[order, 0], spots[order, 1]
    start = np.flatnonzero(np.concatenate([[True], (w[1:] - w[:-1] != 1) | (k[1:] - k[:-1] != 1)]))
    size = np.diff(np.concatenate([start, [len(w)]]))
    best = int(np.argmax(size))
    return int(size[best]) + SEED_WORDS - 1, int(w[start[best]]), int(k[start[best]])


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = LEAST_WORDS) -> DataFrame:
    """(key, item_key) of every text that holds a passage of an item, each pair once."""
    return matches(docs, key, text, items, item_key, item_text, least).select(key, item_key).distinct()


def clean_corpus(docs: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """The texts that give away nothing."""
    return docs.join(found.select(key).distinct(), key, "left_anti")
