"""Languages of documents and of their stretches: sparse multinomial logistic regression on TF-IDF character n-grams.

Prose is read line by line: marks before a line are skipped, fenced lines and lines that are code by their shape (brackets, operators,
calls, or a word of code before what is no sentence) are left out, and so are names with digits,
underscores, dots, inner capitals, call brackets or back ticks. What is left is words; a unit is the part of a sentence on a line. A unit's features are its words' hashed character n-grams, weighted by their inverse frequency over the
words of all documents and normalised to a sum of one, so that a unit's score is the weighted mean of its words' scores.

The model is trained on a bounded sample of labelled documents (at most about TRAIN_DOCS a language, UNITS_OF_DOC units of each, WORDS_OF_UNIT words of a unit)
with follow-the-regularised-leader and elastic-net penalties; units that the first model contradicts are left out of the second.
A temperature is fitted on the hand-labelled documents, which training never sees. Units get languages by the best path
with a price for each change, so that a few quoted words change nothing.

Defined results: rows without id or text, and documents without prose, have no segments; a repeated row counts once; labels
are read apart from case, region and kind of name; a label of no known language counts as missing.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGS = ("de", "en", "es", "fr", "it", "nl", "pt")
DIM = 1 << 16
TRAIN_DOCS = 400
UNITS_OF_DOC = 12
WORDS_OF_UNIT = 60  # of the training sample only
EPOCHS = 4
SCALE = 60.0  # of the features, whose sum is one
CHANGE = 20.0  # price of a change of language along the units, in nats of a word

# Names of the languages in labels (fixed values): two letters, three letters, English and own name
NAMES = {
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "espanol", "castellano", "castilian"),
    "fr": ("fr", "fra", "fre", "french", "francais"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "flemish"),
    "pt": ("pt", "por", "portuguese", "portugues"),
}

_MARKS = re.compile(r"[\s>+*#|•\-]*(?:\d+[.)]\s+)?")
_FENCE = re.compile(r"\s*[>+*\-\s]*(```|~~~)")
# lines that are code by their shape
_CODE = re.compile(
    r"(?:def \w+\s*\(|class \w+\s*(?:[(:{]|$|extends \w+\s*\{)|(?:export |default |async )*function\b[\s*]*\w*\s*[(<]|export (?:default |async )?(?:const|let|class|type|interface|enum|\{|\*)"
    r"|(?:const|let|var) [\w{\[][^=]*=|from \S+ import |import (?:[\w.]+(?: as \w+)?;?\s*$|[\w{*,}\s]+ from |[{*\"'])"
    r"|self\.\w|this\.\w|log\.\w+\(|console\.|[})\]]|//|/\*|@\w+\s*$|[\w.\[\]]+\s*[-+*/]?=\s*\S|[\w.]+\([^\n]*\)[;,]?\s*$)"
)
# lines that are code unless they read as a sentence
_MAYBE = re.compile(r"(?:def |class |export |import |function |const |let |var |async |await |return\b|assert |raise |throw |yield |try\s*[:{]|except\b.*:|catch\b|finally\s*[:{]|elif |else\s*[:{])")
_PLAIN = re.compile(r"[(\"'«„“]?[^\W\d_]{2,}(?:['’\-][^\W\d_]+)*[.,;:!?\"')»”…]*")
_QUOTED = re.compile(r"(?<!\w)([\"'`]).*?\1(?!\w)")
_BLOCK = ("if ", "for ", "while ", "with ", "switch ", "if(", "for(", "while(", "switch(")
# words of code that say nothing about a sentence (fixed values)
_KEYWORDS = frozenset("and as assert async await break case catch class const continue def default del elif else enum except export extends false finally for from function if import in instanceof is lambda let new none not null of or pass raise return self static super switch this throw true try typeof undefined var void while with yield".split())
_WORD = re.compile(r"[(\"'\[*_«“„]*([^\W\d_]+(?:['’\-][^\W\d_]+)*)[.,;:!?\"'*_)\]»”…]*")
_END = re.compile(r"[.!?]+[\"'*_)\]]*\s+")


def code_of(label: Column) -> Column:
    """The two letters of the language a label names, or null."""
    name = F.regexp_extract(F.translate(F.lower(F.trim(label)), "áàâãçéêèíñóôõúü", "aaaaceeeinooouu"), "^([a-z]+)", 1)
    known = F.create_map(*[F.lit(x) for k, names in NAMES.items() for n in names for x in (n, k)])
    return F.try_element_at(known, name)


def sentence(body: str) -> bool:
    """Whether a line reads as a sentence: at least three of its parts, and three in five, quotations apart, are plain words that are no
    words of code."""
    parts = _QUOTED.sub("", body).split()
    plain = sum(1 for p in parts if _PLAIN.fullmatch(p) and (p.islower() or p.istitle() or p[:-1].islower()) and p.strip(".,;:!?\"'()").lower() not in _KEYWORDS)
    return plain >= 3 and plain >= 0.6 * len(parts)


def code_line(body: str) -> bool:
    """Whether a line, without marks before it and spaces behind it, is code."""
    if _CODE.match(body):
        return True
    if body[-1] in ";{" or "=>" in body or (body[-1] == ":" and body.startswith(_BLOCK)) or _MAYBE.match(body):
        return not sentence(body)
    return False


def word_of(part: str) -> str | None:
    """The prose word, in small letters, of what stands between two white spaces; null for names, numbers and code."""
    m = _WORD.fullmatch(part)
    if m is None:
        return None
    w = m.group(1)
    return w.lower() if w.islower() or w.isupper() or w[1:].islower() or w.istitle() or "'" in w or "’" in w else None


class Reader:
    """Reads the units of texts; remembers what each part of a line is."""

    def __init__(self) -> None:
        self.known: dict[str, str | None] = {}

    def units(self, text: str) -> list[tuple[int, int, list[str]]]:
        """(start, end, words) of each unit of prose of a text."""
        out = []
        fenced = False
        at = 0
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for line in text.splitlines(keepends=True):
            start, at = at, at + len(line)
            if ("```" in line or "~~~" in line) and _FENCE.match(line):
                fenced = not fenced
                continue
            if fenced:
                continue
            k = _MARKS.match(line).end()
            body = line[k:].rstrip()
            if not body or code_line(body):
                continue
            base, pos = start + k, 0
            ends = [x.end() for x in _END.finditer(body)] if "." in body or "!" in body or "?" in body else []
            ends.append(len(body))
            for e in ends:
                words = []
                for part in body[pos:e].split():
                    try:
                        w = known[part]
                    except KeyError:
                        w = known[part] = word_of(part)
                    if w is not None:
                        words.append(w)
                if words:
                    out.append((base + pos, base + e if e == len(body) else base + pos + len(body[pos:e].rstrip()), words))
                pos = e
        if fenced and not out and "```" in text:  # a fence that is never closed hides nothing
            return self.units(text.replace("```", "   "))
        return out


def units(text: str) -> list[tuple[int, int, list[str]]]:
    return Reader().units(text)


def grams(word: str) -> list[int]:
    """The hashed character n-grams, of one to four characters, of a word with its edges; accents are kept."""
    w = f" {unicodedata.normalize('NFC', word).replace('’', chr(39))} "
    return [zlib.crc32(w[i : i + n].encode()) & (DIM - 1) for n in (1, 2, 3, 4) for i in range(len(w) - n + 1) if n > 1 or w[i] != " "]


class Words:
    """Known words as rows: with a model their scores and mass, without one their n-grams."""

    def __init__(self, idf: np.ndarray, weights: np.ndarray) -> None:
        self.idf, self.weights = idf, weights
        self.at: dict[str, int] = {}
        self.rows = np.zeros((4096, weights.shape[1] + 1))

    def row(self, word: str) -> int:
        k = self.at.get(word)
        if k is None:
            k = self.at[word] = len(self.at)  # emptied between batches
            if k >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            g = grams(word)
            v = self.idf[g]
            self.rows[k, :-1] = v @ self.weights[g]
            self.rows[k, -1] = v.sum()
        return k


def frequencies(documents: DataFrame) -> tuple[np.ndarray, int]:
    """How many words of all documents hold each n-gram, and how many words there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        total = np.zeros(DIM + 1, np.int64)
        reader = Reader()

        def add() -> None:
            for w, n in seen.items():
                total[np.unique(grams(w))] += n
                total[DIM] += n
            seen.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                for _, _, words in reader.units(t):
                    for w in words:
                        seen[w] = seen.get(w, 0) + 1
            if len(seen) > 200_000:
                add()
        add()
        k = np.nonzero(total)[0]
        yield pa.record_batch([pa.array(k), pa.array(total[k])], ["dim", "n"])

    rows = documents.where("text is not null").select("text").mapInArrow(count, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).toPandas()  # DIM + 1 rows at most
    out = np.zeros(DIM + 1)
    out[rows["dim"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return out[:DIM], int(out[DIM])


def sample(labelled: DataFrame, most: int, of_doc: int = UNITS_OF_DOC) -> list[tuple[str, str]]:
    """labelled(doc_id, text, lang) -> (lang, words of a unit) of about most documents a language, chosen by a hash of the id."""
    have = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not have:
        return []
    share = F.create_map(*[F.lit(x) for k, n in have.items() for x in (k, min(1.0, most / n))])
    u = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    picked = labelled.where(u < F.try_element_at(share, F.col("lang"))).select("lang", "text")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list] = ([], [])
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                us = [w for _, _, w in units(t) if len(w) >= 4]
                for w in us[:: max(1, -(-len(us) // of_doc))]:
                    out[0].append(lang), out[1].append(" ".join(w[:WORDS_OF_UNIT]))
            yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], ["lang", "words"])

    rows = picked.mapInArrow(cut_up, "lang string, words string").collect()
    return sorted((r["lang"], r["words"]) for r in rows)


def train(rows: list[tuple[str, str]], idf: np.ndarray, epochs: int = EPOCHS, alpha: float = 0.5, l1: float = 0.02, l2: float = 1e-3) -> np.ndarray:
    """Weights (DIM, languages) of a multinomial logistic regression, by follow-the-regularised-leader with elastic net."""
    k = len(LANGS)
    z, n, w = np.zeros((DIM, k)), np.zeros((DIM, k)), np.zeros((DIM, k))
    if not rows:
        return w
    index = {x: i for i, x in enumerate(LANGS)}
    count = np.bincount([index[x] for x, _ in rows], minlength=k)
    weigh = len(rows) / k / np.maximum(count, 1)
    memo: dict[str, np.ndarray] = {}
    feats = []
    for lang, words in rows:
        g = np.concatenate([memo[x] if x in memo else memo.setdefault(x, np.array(grams(x))) for x in words.split(" ")])
        u, c = np.unique(g, return_counts=True)
        v = c * idf[u]
        feats.append((u, v / v.sum() * SCALE, index[lang]))
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(feats))
        for lo in range(0, len(order), 32):
            batch = [feats[i] for i in order[lo : lo + 32]]
            dims, inv = np.unique(np.concatenate([b[0] for b in batch]), return_inverse=True)
            x = np.zeros((len(batch), len(dims)))
            at = 0
            for i, (u, v, _) in enumerate(batch):
                x[i, inv[at : at + len(u)]] = v
                at += len(u)
            zz, nn = z[dims], n[dims]
            ww = np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((1.0 + np.sqrt(nn)) / alpha + l2))
            s = x @ ww
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = np.array([b[2] for b in batch])
            p[np.arange(len(y)), y] -= 1
            g = x.T @ (p * weigh[y][:, None]) / len(batch)
            sigma = (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha
            z[dims] = zz + g - sigma * ww
            n[dims] = nn + g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1.0 + np.sqrt(n)) / alpha + l2))


def logits(rows: list[list[str]], words: Words) -> np.ndarray:
    """The scores of units, a row each."""
    at, row = words.at, words.row
    flat = np.array([at[w] if w in at else row(w) for r in rows for w in r])
    if not len(flat):
        return np.zeros((0, len(LANGS)))
    s = np.add.reduceat(words.rows[flat], np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]]), 0)
    return s[:, :-1] / s[:, -1:] * SCALE


def log_softmax(s: np.ndarray) -> np.ndarray:
    s = s - s.max(-1, keepdims=True)
    return s - np.log(np.exp(s).sum(-1, keepdims=True))


class Model:
    def __init__(self, idf: np.ndarray, weights: np.ndarray, temperature: float) -> None:
        used = np.abs(weights).sum(1) > 0
        self.idf, self.dims, self.kept, self.temperature = idf.astype(np.float32), np.nonzero(used)[0], weights[used].astype(np.float32), temperature

    def words(self) -> Words:
        w = np.zeros((DIM, len(LANGS)))
        w[self.dims] = self.kept
        return Words(self.idf.astype(np.float64), w)


def fit(documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """documents(doc_id, text, lang), labels(doc_id, lang) by hand."""
    docs = documents.select("doc_id", "text", code_of(F.col("lang")).alias("lang")).where("doc_id is not null and text is not null")
    held = labels.select("doc_id", code_of(F.col("lang")).alias("hand")).where("doc_id is not null and hand is not null").groupBy("doc_id").agg(F.min("hand").alias("hand"))
    df, n = frequencies(docs)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    rows = sample(docs.where("lang is not null").join(held, "doc_id", "left_anti"), most)
    weights = train(rows, idf)
    if rows:
        p = log_softmax(logits([w.split(" ") for _, w in rows], Words(idf, weights)))
        at = [LANGS.index(x) for x, _ in rows]
        rows = [r for r, q, k in zip(rows, p, at) if q[k] >= q.max() - 1e-9]
        weights = train(rows, idf)
    hand = sample(docs.drop("lang").join(held, "doc_id").select("doc_id", "text", F.col("hand").alias("lang")), most)
    t = 1.0
    if hand:
        s = logits([w.split(" ") for _, w in hand], Words(idf, weights))
        y = np.array([LANGS.index(x) for x, _ in hand])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 61))
        t = float(min(grid, key=lambda x: -log_softmax(s / x)[np.arange(len(y)), y].mean()))
    return Model(idf, weights, t)


def path(score: np.ndarray, n: np.ndarray, change: float = CHANGE) -> np.ndarray:
    """The language of each unit on the best path: score holds log probabilities of a mean word, n the words of a unit."""
    gain = score * n[:, None]
    best = gain.argmax(1)
    if (best == best[0]).all():
        return best
    total, back = gain[0].copy(), []
    for g in gain[1:]:
        top = int(total.argmax())
        stay = total >= total[top] - change
        back.append(np.where(stay, np.arange(len(total)), top))
        total = np.where(stay, total, total[top] - change) + g
    out = [int(total.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return np.array(out[::-1])


SEGMENT = "doc_id long, seg_no long, lang string, confidence double, first_char int, last_char int, n_words int"


def segments(documents: DataFrame, model: Model) -> DataFrame:
    """documents(doc_id, text) -> the stretches of one language of each document, in reading order, with a confidence."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        words, reader = m.words(), Reader()
        for b in batches:
            if len(words.at) > 500_000:
                words.at.clear()
            out: list[list] = [[] for _ in range(7)]
            docs, us = [], []  # per document its id and where its units begin
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = reader.units(t)
                if got:
                    docs.append((doc, len(us)))
                    us += got
            s = logits([w for _, _, w in us], words)
            n = np.array([len(w) for _, _, w in us])
            p = log_softmax(s)
            edge = [a for _, a in docs] + [len(us)]
            for (doc, lo0), hi0 in zip(docs, edge[1:]):
                lang = path(p[lo0:hi0], n[lo0:hi0])
                cuts = [0, *(np.nonzero(lang[1:] != lang[:-1])[0] + 1).tolist(), hi0 - lo0]
                for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:]), 1):
                    x = slice(lo0 + lo, lo0 + hi)
                    q = n[x] @ s[x] / n[x].sum() / m.temperature
                    q = np.exp(q - q.max())
                    for c, v in zip(out, (doc, k, LANGS[lang[lo]], float(q[lang[lo]] / q.sum()), us[lo0 + lo][0], us[lo0 + hi - 1][1], int(n[x].sum()))):
                        c.append(v)
            types = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], [x.split()[0] for x in SEGMENT.split(", ")])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return docs.mapInArrow(find, SEGMENT).distinct()  # a repeated row gives the same segments
