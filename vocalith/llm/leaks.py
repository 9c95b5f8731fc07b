"""Evaluation texts leaking into training text: a generalised suffix automaton of the evaluation items.

Items become rows of words: prose is split at white space and each part loses its punctuation ("graph.thresh" and
"graphthresh" are one word), code is split at everything that is no letter, digit or underscore, and underscores are lost.
Case and accents are dropped. All items of a kind go into one automaton; each document is streamed through it, the state
holding the longest match that ends at a word. Where a match of at least RUN words cannot be extended it is a seed: its state
tells every item and place it stands at. The seeds of an item are chained; between the seeds and beyond their ends shorter matches are
counted too. A passage is a leak if it reaches over enough of the item and most of its words match.

Items are held in shards of at most about SHARD_WORDS words, so the automaton that every executor gets has a fixed bound; with more
items the documents are streamed once per shard, one shard after the other.

Defined results: documents and items without id or text, and items without words, are left out; an item of fewer than WHOLE
words is a leak only where all its words stand in a row, as two fifths of it are everyday phrases; a repeated item counts once by
its id; a repeated document is a document; long texts are streamed whole.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

RUN = 4  # words of a seed
WHOLE = 12  # words from which on part of an item counts
HOLD = 0.4  # share of an item's words that a passage must reach over
EDGE = 3  # words that edits may hide at the ends of a passage, but no more than a tenth of it
EDIT = 2.0  # matching words that an edited or added one undoes
WORTH = 0.45  # least worth of a passage, as a share of the words it must reach over: with one word in eight edited it is 0.62 on average
SEEDED = 0.2  # share of an item's words that must stand in seeds within a stretch of the item's length; on average 0.32 do
GAP = 64  # words between two seeds of a passage
SHARD_WORDS = 1_000_000
PLACES = 1 << 20  # places of seeds looked at together
_WORD = re.compile(r"\w+")
_DROP = re.compile(r"[\W_]+")


def plain(word: str) -> str:
    """A word without case, accents and punctuation."""
    if word.isascii():
        return _DROP.sub("", word.lower())
    return _DROP.sub("", "".join(c for c in unicodedata.normalize("NFKD", word.casefold()) if not unicodedata.combining(c)))


def split_prose(text: str) -> list[str]:
    return text.split()


def split_code(text: str) -> list[str]:
    return _WORD.findall(text)


SPLIT = {"prose": split_prose, "code": split_code}
SPAN = {"prose": re.compile(r"\S+"), "code": _WORD}


class Automaton:
    """A generalised suffix automaton over rows of words, with the items and places of each state of RUN words or more. States with
    one way on, most of them, are in arrays; those with several have a dictionary."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int = RUN) -> None:
        self.run = run
        self.ids = np.array([i for i, _ in items], np.int64)
        self.size = np.array([len(w) for _, w in items], np.int64)
        self.vocabulary: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.link, self.longest = array("i", [-1]), array("i", [0])
        self.by, self.to = array("i", [-9]), array("i", [0])  # the first way on of each state
        self.more: dict[int, dict[int, int]] = {0: {}}  # all ways on of the states with several
        self.short: dict[int, dict[tuple, list[int]]] = {}  # items of fewer than WHOLE words, by length
        ends: list[tuple[int, int, int]] = []
        for k, (_, words) in enumerate(items):
            last = 0
            row = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            self.rows.append(np.array(row, np.int32))
            if len(row) < WHOLE:
                if row:
                    self.short.setdefault(len(row), {}).setdefault(tuple(row), []).append(k)
                continue
            for p, c in enumerate(row):
                last = self._add(last, c)
                ends.append((last, k, p))
        state, item, place = array("i"), array("i"), array("i")
        for s, k, p in ends:
            while s > 0 and self.longest[s] >= run:
                state.append(s), item.append(k), place.append(p)
                s = self.link[s]
        order = np.argsort(np.array(state, np.int32), kind="stable")
        self.count = np.bincount(np.array(state, np.int64), minlength=len(self.link))
        self.start = np.concatenate([[0], np.cumsum(self.count)])
        self.item, self.place = np.array(item, np.int32)[order], np.array(place, np.int32)[order]

    def _go(self, s: int, c: int) -> int:
        if self.by[s] == c:
            return self.to[s]
        m = self.more.get(s)
        return -1 if m is None else m.get(c, -1)

    def _set(self, s: int, c: int, t: int) -> None:
        m = self.more.get(s)
        if m is not None:
            m[c] = t
            if self.by[s] == c:
                self.to[s] = t
        elif self.by[s] in (-9, c):
            self.by[s], self.to[s] = c, t
        else:
            self.more[s] = {self.by[s]: self.to[s], c: t}

    def _new(self, longest: int, link: int) -> int:
        self.link.append(link), self.longest.append(longest), self.by.append(-9), self.to.append(0)
        return len(self.link) - 1

    def _add(self, last: int, c: int) -> int:
        link, longest, go = self.link, self.longest, self._go
        q = go(last, c)
        if q >= 0:
            return q if longest[q] == longest[last] + 1 else self._clone(last, c, q)
        new = self._new(longest[last] + 1, 0)
        p = last
        while p >= 0 and (q := go(p, c)) < 0:
            self._set(p, c, new)
            p = link[p]
        if p >= 0:
            link[new] = q if longest[q] == longest[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._new(self.longest[p] + 1, self.link[q])
        self.by[new], self.to[new] = self.by[q], self.to[q]
        if q in self.more:
            self.more[new] = dict(self.more[q])
        self.link[q] = new
        while p >= 0 and self._go(p, c) == q:
            self._set(p, c, new)
            p = self.link[p]
        return new

    def runs(self, words: list[int]) -> list[tuple[int, int, int]]:
        """(end, length, state) of each match of a row of word numbers that cannot be extended, of self.run words or more."""
        link, longest, run, by, to, more = self.link, self.longest, self.run, self.by, self.to, self.more
        root = more[0]
        out = []
        s = n = 0
        for i, c in enumerate(words):
            if s:
                if by[s] == c:
                    s = to[s]
                    n += 1
                    continue
                m = more.get(s)
                t = m.get(c) if m is not None else None
                if t is not None:
                    s = t
                    n += 1
                    continue
                if n >= run:
                    out.append((i - 1, n, s))
                if c < 0:
                    s = n = 0
                    continue
                while s > 0:
                    s = link[s]
                    t = self._go(s, c)
                    if t >= 0:
                        s, n = t, longest[s] + 1
                        break
                else:
                    s = n = 0
            else:
                t = root.get(c)
                if t is not None:
                    s, n = t, 1
        if n >= run:
            out.append((len(words) - 1, n, s))
        return out

    def whole(self, words: list[int]) -> list[tuple[int, int]]:
        """(item, first word) of each short item that stands in a row of word numbers."""
        out = []
        for n, rows in self.short.items():
            for i in range(len(words) - n + 1):
                for k in rows.get(tuple(words[i : i + n]), ()):
                    out.append((k, i))
        return out


Seed = tuple[int, int, int]  # end in the document, end in the item, length


def chain(runs: list[Seed]) -> list[Seed]:
    """The best row of seeds, each after the one before in document and item: most words, less a quarter of each gap's."""
    score, back = [], []
    for x, (end, at, n) in enumerate(runs):  # sorted by their end in the document
        first, top, of = end - n + 1, float(n), -1
        for y in range(x - 1, -1, -1):
            e2, a2, _ = runs[y]
            if e2 < first - GAP - 1:
                break
            if e2 < end and a2 < at and at - n - a2 <= GAP:
                new = min(n, end - e2, at - a2)
                v = score[y] + new - 0.25 * max(0, end - e2 - new, at - a2 - new)
                if v > top:
                    top, of = v, y
        score.append(top), back.append(of)
    x = max(range(len(runs)), key=score.__getitem__)
    out = []
    while x >= 0:
        out.append(runs[x])
        x = back[x]
    return out[::-1]


def common(a: list[int], b: list[int]) -> int:
    """Words that two short rows have in common, in order."""
    if not a or not b:
        return 0
    if len(a) == 1 or len(b) == 1:
        return int(a[0] in b if len(a) == 1 else b[0] in a)
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


_SKIPS = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2))


def reach(words: list[int], item: list[int], i: int, j: int, step: int) -> tuple[int, int, int]:
    """How far a match that stands at words[i], item[j] goes on in a direction over edits of up to two words that two matching
    words, or the end of the item, follow: (last place in words, in item, words matched)."""
    n = 0
    same = lambda x, y: 0 <= x < len(words) and 0 <= y < len(item) and words[x] == item[y]
    while True:
        while same(i + step, j + step):
            i, j, n = i + step, j + step, n + 1
        for a, b in _SKIPS:
            x, y = i + step * (a + 1), j + step * (b + 1)
            if same(x, y) and (same(x + step, y + step) or not 0 <= y + step < len(item)):
                i, j, n = x, y, n + 1
                break
        else:
            return i, j, n


def passage(words: list[int], item: list[int], seeds: list[Seed]) -> tuple[bool, int, int, int, int]:
    """(is a leak, words of the item reached over, words matched, first and last word in the document) of the best stretch of a row
    of seeds: matching words count one, edited and added ones are taken off EDIT times."""
    best = here = None  # (worth, matched, index of the first seed, of the last)
    last = (0, 0)
    for x, (end, at, n) in enumerate(seeds):
        if here is not None:
            new = min(n, end - last[0], at - last[1])
            a, b = words[last[0] + 1 : end - new + 1], item[last[1] + 1 : at - new + 1]
            m = common(a, b)
            worth = here[0] + m - EDIT * (max(len(a), len(b)) - m)
            here = (worth + new, here[1] + m + new, here[2], x) if worth > 0 else None
        if here is None:
            here = (float(n), n, x, x)
        if best is None or here[0] > best[0]:
            best = here
        last = (end, at)
    worth, matched, x, y = best
    first, start, n = reach(words, item, seeds[x][0] - seeds[x][2] + 1, seeds[x][1] - seeds[x][2] + 1, -1)
    end, stop, m = reach(words, item, seeds[y][0], seeds[y][1], 1)
    matched += n + m
    over = stop - start + 1
    need = HOLD * len(item)
    worth = matched - EDIT * (max(over, end - first + 1) - matched)
    return over >= need - min(EDGE, 0.1 * need) and worth >= WORTH * need, over, matched, first, end


def passages(auto: Automaton, rows: list[list[int]]) -> list[tuple[int, int, float, int, int, int]]:
    """(row, item, share of the item reached over, words matched, first word, last word) of each leaked passage of a batch."""
    out = []
    if auto.short:
        for r, words in enumerate(rows):
            out += [(r, k, 1.0, int(auto.size[k]), i, i + int(auto.size[k]) - 1) for k, i in auto.whole(words)]
    at, ends, lens, states = [], [], [], []
    for r, words in enumerate(rows):
        for e, n, s in auto.runs(words):
            at.append(r), ends.append(e), lens.append(n), states.append(s)
    if not at:
        return out
    row, end, n, st = (np.array(x, np.int64) for x in (at, ends, lens, states))
    c = auto.count[st]
    # seeds with about PLACES places at once, those of a row of words together
    fresh = np.nonzero(np.diff(row))[0] + 1
    block = np.cumsum(c) // PLACES
    edges = [0, *fresh[np.diff(block[fresh], prepend=0) > 0].tolist(), len(st)]
    cuts = list(zip(edges[:-1], edges[1:]))
    far = 4 * (int(end.max()) + int(auto.size.max()) + GAP)

    def placed(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(seed, pair of row and item, place) of the places of some seeds."""
        rep = np.repeat(np.arange(lo, hi), c[lo:hi])
        src = auto.start[st[rep]] + np.arange(len(rep)) - np.repeat(np.cumsum(c[lo:hi]) - c[lo:hi], c[lo:hi])
        return rep, row[rep] * len(auto.ids) + auto.item[src], auto.place[src]

    # pairs with enough words in seeds within a stretch of the document; a seed counts once, wherever in the item it stands
    good = []
    for lo, hi in cuts:
        rep, pair, _ = placed(lo, hi)
        order = np.lexsort((end[rep], pair))
        rep, pair = rep[order], pair[order]
        once = np.ones(len(rep), bool)
        once[1:] = (rep[1:] != rep[:-1]) | (pair[1:] != pair[:-1])
        rep, pair = rep[once], pair[once]
        size = auto.size[pair % len(auto.ids)]
        total = np.concatenate([[0], np.cumsum(n[rep])])
        place = np.cumsum(np.concatenate([[0], (pair[1:] != pair[:-1]) * far])) + end[rep]
        since = np.searchsorted(place, place - np.int64(1.5 * size) - GAP)
        good.append(np.unique(pair[total[1:] - total[since] >= SEEDED * size]))
    good = np.unique(np.concatenate(good))
    if not len(good):
        return out
    got = [[x[np.isin(p, good)] for x in (rep, p, place)] for rep, p, place in (placed(lo, hi) for lo, hi in cuts)]
    rep, pair, place = (np.concatenate(x) for x in zip(*got))
    order = np.lexsort((place, end[rep], pair))
    rep, pair, place = rep[order], pair[order], place[order]
    edges = np.concatenate([np.searchsorted(pair, good), [len(pair)]])
    for k, lo, hi in zip(good.tolist(), edges[:-1], edges[1:]):
        r, i = divmod(k, len(auto.ids))
        seeds = list(zip(end[rep[lo:hi]].tolist(), place[lo:hi].tolist(), n[rep[lo:hi]].tolist()))
        item = auto.rows[i].tolist()
        while sum(x[2] for x in seeds) >= SEEDED * len(item):
            best = chain(seeds)
            if sum(x[2] for x in best) < SEEDED * len(item):
                break  # the best of the seeds that are left is too little
            ok, over, words, first, last = passage(rows[r], item, best)
            if ok:
                out.append((r, i, min(1.0, over / len(item)), words, first, last))
            used = set(best)
            seeds = [x for x in seeds if x not in used and not (ok and first <= x[0] <= last)]
    return out


FOUND = "doc_id long, item_id long, held double, n_words int, first_char int, last_char int"


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """documents(doc_id, text), items(item_id, kind 'prose' or 'code', text) -> (doc_id, item_id, held, n_words, first_char,
    last_char): every passage of an item in a document, its words and its place in the text."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    items = items.select("item_id", "kind", "text").where("item_id is not null and text is not null").groupBy("item_id", "kind").agg(F.min("text").alias("text"))
    words = items.agg(F.sum(F.length("text") / 6)).first()[0] or 0
    n_shards = max(1, -(-int(words) // SHARD_WORDS))
    out = None
    for shard in range(n_shards):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_shards)) == shard).collect()  # SHARD_WORDS words, about
        autos = {}
        for kind, split in SPLIT.items():
            rows = [(r["item_id"], [w for w in map(plain, split(r["text"])) if w]) for r in mine if r["kind"] == kind]
            rows = [x for x in rows if x[1]]
            if rows:
                autos[kind] = Automaton(rows)
        held = spark.sparkContext.broadcast(autos)
        got = docs.mapInArrow(_streamer(held), FOUND)
        if n_shards > 1:  # one automaton at a time in the executors
            got = cut(got)
            held.unpersist()
        out = got if out is None else out.unionByName(got)
    return out


def _streamer(held):  # noqa: ANN001, ANN202
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        autos = held.value
        known: dict[str, dict[str, int]] = {k: {} for k in autos}
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            out = []
            for kind, auto in autos.items():
                number, split, vocabulary = known[kind], SPLIT[kind], auto.vocabulary
                if len(number) > 300_000:
                    number.clear()
                rows, at = [], []
                for text in texts:
                    row = []
                    parts = split(text)
                    for w in parts:
                        k = number.get(w)
                        if k is None:
                            p = plain(w)
                            k = number[w] = vocabulary.get(p, -1) if p else -2
                        row.append(k)
                    rows.append(row)
                packed = [[k for k in row if k != -2] if -2 in row else row for row in rows]
                for r, i, share, n, first, last in passages(auto, packed):
                    places = [m.span() for m, k in zip(SPAN[kind].finditer(texts[r]), rows[r]) if k != -2]
                    out.append((ids[r], int(auto.ids[i]), share, n, places[first][0], places[last][1]))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "held", "n_words", "first_char", "last_char"])

    return stream
