"""Problem 7: passages of held-out items inside documents, by size-partitioned MinHash containment and exact shingle containment."""

import html
import re
import unicodedata
from difflib import SequenceMatcher
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
#: Items and characters of items in one pass over the documents; what is beyond is searched in further passes, so the broadcast index stays bounded.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 16_000_000
#: Upper bounds of the size partitions, in shingles; an item above the last is divided into overlapping parts of that size.
PARTITIONS = (32, 64, 128, 256)
#: The chance that MinHash misses the least similar passage that is allowed, were that the document's only window with it.
MISS = 1e-4
TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>")
BROKEN = re.compile(r"(?<=\w)[-‐‑][ \t]*\r?\n[ \t]*(?:[>#*/|;%]+[ \t]*)?(?=\w)")
#: Scripts written without blanks between words: every letter is a word of its own.
UNSPACED = "฀-໿က-႟ក-៿⺀-꓏豈-﫿\U00020000-\U0003ffff"
WORD = re.compile(rf"\d+(?:[.,]\d+)+|[^\W_{UNSPACED}]+(?:['’-][^\W_{UNSPACED}]+)*|(?=\w)[{UNSPACED}]")
ALONE = re.compile(f"[{UNSPACED}]")
JOINERS = re.compile(r"['’-]")
INVISIBLE = re.compile(r"[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")


def words_of(text: str) -> list[str]:
    """The words of a text whatever its case, punctuation, markup, line layout, broken words or form of characters; in scripts
    written without blanks between words (Chinese, Japanese, Thai ...) every letter is a word."""
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\n" in text:
        text = BROKEN.sub("", text)
    text = text.casefold()
    found = WORD.findall(text)
    return [w if w.isalnum() else JOINERS.sub("", w) for w in found] if "-" in text or "'" in text or "’" in text else found


def shingle_hashes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of SHINGLE word numbers; 0 where one of them is 0 (a word of no item, or a text's end)."""
    n = len(ids) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h, good = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(SHINGLE):
        part = ids[k : k + n]
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        good &= part > 0
    h[h == 0] = 1
    h[~good] = 0
    return h


def signatures(h: np.ndarray, starts: np.ndarray, minima: int) -> np.ndarray:
    """The MinHash signatures of consecutive sets of shingle hashes, set i from starts[i] on: (sets, minima), the number of
    the minimum mixed in, so that values of different places of a signature never meet."""
    draw = np.random.default_rng(5).integers(0, 2**63, (minima, 2), np.uint64)
    out = np.empty((len(starts), minima), np.uint64)
    for i in range(minima):
        least = np.minimum.reduceat((h ^ draw[i, 0]) * (draw[i, 1] | np.uint64(1)), starts)
        out[:, i] = (least ^ (least >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + draw[i, 0]
    return out


class ItemIndex:
    """The items' words, shingles and MinHash signatures, partitioned by size.

    A passage of n >= `words` words with at most one in `per_edit` changed always contains one of fewer than 2 * `words` words
    that is allowed too (cut it into stretches of that size: not all can be worse than the whole), and of such a stretch at
    least `least` shingles are left unchanged. So an item of s shingles and a stretch of a document with w shingles of any item
    have a Jaccard similarity of at least least / (s + w - least) if the stretch holds a passage: in a partition of items of at
    most s shingles, a signature of that many minima finds it but for a chance of MISS. Long items (parts of the largest
    partition, which overlap by 2 * `words` words) and long documents (stretches that overlap by as much) are thereby
    compared with sets of like size, though the containment of a short item in a whole document says little by itself.
    """

    def __init__(self, items: list[tuple[int, str]], words: int, per_edit: int):
        self.words, self.per_edit = words, per_edit
        self.least = max(1, min(n - SHINGLE + 1 - SHINGLE * (n // per_edit) for n in range(words, 2 * words)))
        # a stretch of `stride` + 1 words at least lies whole in one of the windows of two strides
        self.stride = 2 * words + -(-2 * words // per_edit)
        self.vocabulary: dict[str, int] = {}
        self.items = []
        hashes, owner = [], []
        parts: dict[int, list[tuple[int, np.ndarray]]] = {p: [] for p in PARTITIONS}
        for key, text in items:
            ids, at, place = [], [], 0
            # the place of a token counts the words between blanks, so that signs standing alone count as in the text
            for blank in text.split():
                for w in words_of(blank):
                    place += ALONE.match(w) is not None
                    ids.append(self.vocabulary.setdefault(w, len(self.vocabulary) + 1))
                    at.append(place)
                place += 1
            k = len(self.items)
            self.items.append((key, ids, at))
            h = shingle_hashes(np.array(ids, np.int64))
            hashes.append(h), owner.append(np.full(len(h), k))
            step = PARTITIONS[-1] - 2 * words
            for a in range(0, max(1, len(h) - 2 * words), step):
                part = np.unique(h[a : a + PARTITIONS[-1]])
                if len(part) >= self.least:
                    parts[next(p for p in PARTITIONS if len(part) <= p)].append((k, part))
        self.hash, self.owner = self._sorted(hashes, owner)
        self.known = np.zeros(1 << max(12, (16 * len(self.hash)).bit_length()), bool)
        self.known[self.hash & np.uint64(len(self.known) - 1)] = True
        self.partitions = []
        for p, members in parts.items():
            if members:
                jaccard = self.least / (p + 2 * self.stride - self.least)
                minima = ceil(log(MISS) / log(1 - jaccard))
                starts = np.cumsum([0] + [len(h) for _, h in members[:-1]])
                sign = signatures(np.concatenate([h for _, h in members]), starts, minima)
                self.partitions.append((minima, *self._sorted(list(sign), [np.full(minima, k) for k, _ in members])))

    @staticmethod
    def _sorted(hashes, owner):
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        o = np.concatenate(owner).astype(np.int64) if owner else np.empty(0, np.int64)
        pair = np.unique(np.rec.fromarrays([h, o])) if len(h) else None
        return (pair.f0.copy(), pair.f1.copy()) if pair is not None else (h, o)

    @staticmethod
    def _owners(keys: np.ndarray, owner: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `wanted`, owner) of every entry of the sorted `keys` that equals a wanted one."""
        first, last = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        n = last - first
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(np.arange(len(wanted)), n), owner[at]

    def candidates(self, doc: np.ndarray, pos: np.ndarray, h: np.ndarray) -> np.ndarray:
        """doc * items + item of the pairs whose signatures meet, from the places in order that hold a shingle of any item."""
        # windows of two strides: place p lies in number p // stride and in the one before
        window = np.concatenate([pos // self.stride, pos // self.stride - 1])
        by = np.lexsort((window, np.concatenate([doc, doc])))
        window, of, sets = window[by], np.concatenate([doc, doc])[by], np.concatenate([h, h])[by]
        starts = np.flatnonzero(np.r_[True, (np.diff(window) != 0) | (np.diff(of) != 0)])
        held = np.diff(np.r_[starts, len(sets)])
        # fewer shared shingles than every allowed passage has: no passage
        ok = held >= self.least
        sets, of, held = sets[np.repeat(ok, held)], of[starts[ok]], held[ok]
        starts, out = np.cumsum(held) - held, []
        for a in range(0, len(starts), 4096):
            some = starts[a : a + 4096]
            end = starts[a + 4096] if a + 4096 < len(starts) else len(sets)
            sign = signatures(sets[some[0] : end], some - some[0], max(m for m, _, _ in self.partitions))
            for minima, keys, owner in self.partitions:
                at, k = self._owners(keys, owner, sign[:, :minima].ravel())
                out.append(np.unique(of[a + at // minima] * len(self.items) + k))
        return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)

    def passage(self, ids: list[int], at: list[int], region: list[int]) -> bool:
        """Whether `region` holds a passage of the item, by the chain of the words they share. Changed words count as often as
        there are words between blanks, and also at a passage's ends, where they are needed to reach its least length."""
        blocks = [b for b in SequenceMatcher(None, ids, region, autojunk=False).get_matching_blocks() if b.size]
        for i, first in enumerate(blocks):
            edits = 0
            for j in range(i, len(blocks)):
                b = blocks[j]
                if j > i:
                    p = blocks[j - 1]
                    gone, new = at[p.a + p.size : b.a], b.b - p.b - p.size
                    edits += len(set(gone)) + max(0, new - len(gone))
                span = at[b.a + b.size - 1] - at[first.a] + 1
                more = max(0, self.words - span)
                if more <= at[-1] + 1 - span and (edits + more) * self.per_edit <= span + more:
                    return True
        return False

    def search(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(text number, item key) of every passage found in `texts`."""
        if not self.partitions:
            return []
        get, ids, starts = self.vocabulary.get, [], [0]
        for text in texts:
            if text:
                ids += [get(w, 0) for w in words_of(text)]
            ids.append(0)
            starts.append(len(ids))
        ids, starts = np.array(ids, np.int64), np.array(starts)
        h = shingle_hashes(ids)
        pos = np.flatnonzero(self.known[h & np.uint64(len(self.known) - 1)])
        pos = pos[self.hash[np.minimum(np.searchsorted(self.hash, h[pos]), len(self.hash) - 1)] == h[pos]]
        if len(pos) < self.least:
            return []
        doc = np.searchsorted(starts, pos, "right") - 1
        pairs = self.candidates(doc, pos - starts[doc], h[pos])
        # exact shingle containment: the shingles that the candidate pairs share, in order
        at, which = self._owners(self.hash, self.owner, h[pos])
        doc, pos = doc[at], pos[at]
        pair = doc * len(self.items) + which
        ok = np.isin(pair, pairs)
        doc, which, pos, pair = doc[ok], which[ok], pos[ok], pair[ok]
        by = np.lexsort((pos, pair))
        doc, which, pos, pair = doc[by], which[by], pos[by], pair[by]
        reach = 3 * self.words
        cut = np.flatnonzero((np.diff(pair) != 0) | (np.diff(pos) > reach)) + 1
        out = set()
        for seg in np.split(np.arange(len(pos)), cut):
            if len(seg) < self.least:
                continue
            d, k = int(doc[seg[0]]), int(which[seg[0]])
            key, item, places = self.items[k]
            if (d, key) in out:
                continue
            a, b = max(int(starts[d]), int(pos[seg[0]]) - reach), min(int(starts[d + 1]), int(pos[seg[-1]]) + SHINGLE + reach)
            if self.passage(item, places, ids[a:b].tolist()):
                out.add((d, key))
        return sorted(out)


def find_leaks(
    docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, words: int = 20, per_edit: int = 8, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc, item): documents that hold at least `words` consecutive words of an item, at most one in `per_edit` changed.

    Words are compared whatever their case, punctuation, markup, line layout, hyphenation or form of characters; in scripts
    without blanks between words every letter is a word. MinHash containment search over items partitioned by size gives the
    candidates (see ItemIndex), exact containment of 5-word shingles and the chain of shared words decide. Items are
    broadcast in blocks of at most about `block_items` items and `block_chars` characters (one block reads the documents
    once; only larger item sets need further passes); a document is read, never shuffled, so hot sources or mirrored texts
    don't matter.

    Null or blank texts and ids give no rows; an item that recurs under several ids is reported under each; an item too short
    to leave `least` shingles unchanged is never found. Repeated document ids give one row. A document is searched whole.
    Equal column names and further columns don't matter. Empty inputs give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(doc_text).cast("string").alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    wanted = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where(F.col("item").isNotNull() & F.col("text").isNotNull())
    n, chars = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-chars // block_chars))
    out = None
    for block in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item").collect()
        state = spark.sparkContext.broadcast(vars(ItemIndex([(r["item"], r["text"]) for r in rows], words, per_edit)))

        def search(batches, state=state):
            index = ItemIndex.__new__(ItemIndex)
            index.__dict__.update(state.value)
            for batch in batches:
                ids, body = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                found = index.search(body)
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _ in found], pa.int64()), pa.array([k for _, k in found], pa.int64())], names=["doc", "item"])

        part = texts.mapInArrow(search, "doc long, item long")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
