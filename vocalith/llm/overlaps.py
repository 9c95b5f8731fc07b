"""Same or nearly same records across splits: an edit-distance segment join over code tokens.

Contents are reduced to code tokens (no layout, comments or quotes); equal token rows form a class, and only classes are
joined. An evaluation class of n tokens may differ from a partner in k of them, so of k + 1 disjoint segments one at least is
untouched: the segments are looked up among the training windows of the same width, at positions and lengths the
distance allows, and every pair found so, unless its bags of tokens differ too much, is verified by a banded dynamic program.

Segments are shifted, within the slack that their number leaves, off windows made of everyday tokens only, so that no
segment value is met by a large part of all rows. A Bloom filter of the segments, of bounded size, keeps the other
training windows from being shuffled; its false hits only cost rows.

Defined results: an entry without id or with a null label of its split is left out; a repeated entry counts once; contents
without tokens count as no content, and such entries agree when scope, file and both lines do, none of them null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVERYDAY = 0.05  # a token in this share of all classes is an everyday one; there are at most (tokens of a class) / 0.05 of them
BLOOM_BITS = 1 << 26  # at most


def tokens(content: Column, file: Column) -> Column:
    """The code tokens of a content; the file's ending says which marks open a comment, without it all do."""
    ending = F.lower(F.regexp_extract(F.coalesce(F.trim(file), F.lit("")), "\\.([A-Za-z]+)$", 1))
    hash_mark = F.regexp_replace(content, "(?m)(^|\\s)#[^\\n\\r]*", "$1")
    slashes = lambda c: F.regexp_replace(F.regexp_replace(c, "(?s)/\\*.*?\\*/", " "), "(?<!:)//[^\\n\\r]*", " ")
    plain = F.when(ending.isin("py", "pyi"), hash_mark).when(ending.isin("ts", "tsx", "js", "jsx", "mjs"), slashes(content)).otherwise(slashes(hash_mark))
    return F.regexp_extract_all(F.regexp_replace(plain, "[\"'`]", " "), F.lit("[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\p{Z}\\p{C}]"), 0)


def most(n: int) -> int:
    """The most edits an evaluation row of n tokens may need towards any partner: one in eight of the longer row."""
    return n // 7


def width(n: int) -> int:
    return n // (most(n) + 1)


def segments(row: np.ndarray, rare: np.ndarray) -> list[int]:
    """Starts of the k + 1 disjoint segments of a row, shifted off everyday windows as far as there is slack."""
    n = len(row)
    w, m = width(n), most(n) + 1
    slack, at, out = n - w * m, 0, []
    for _ in range(m):
        while slack and not rare[at : at + w].any():
            at, slack = at + 1, slack - 1
        out.append(at)
        at += w
    return out


def _powers(w: int) -> np.ndarray:
    p = np.empty(w, np.uint64)
    p[0] = 1
    for i in range(1, w):
        p[i] = (int(p[i - 1]) * 0x9E3779B97F4A7C15) & (2**64 - 1)
    return p


def window_hashes(flat: np.ndarray, w: int) -> np.ndarray:
    """A 64-bit hash of each window of w tokens of a flat row of token hashes."""
    x, p = flat.view(np.uint64), _powers(w)
    out = np.zeros(max(0, len(x) - w + 1), np.uint64)
    for i in range(w):
        out += x[i : len(x) - w + 1 + i] * p[i]
    out ^= out >> np.uint64(29)
    return (out * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(w)


def within(a: list[np.ndarray], b: list[np.ndarray], k: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most its k: a banded dynamic program over all pairs at once."""
    if not len(a):
        return np.zeros(0, bool)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    band, big = int(k.max()), 1 << 20
    A = np.full((len(a), la.max()), -1, np.int64)
    B = np.full((len(a), la.max() + 2 * band + 1), -2, np.int64)
    for i, (x, y) in enumerate(zip(a, b)):
        A[i, : len(x)] = x
        m = min(len(y), B.shape[1] - band)
        B[i, band : band + m] = y[:m]
    wide = 2 * band + 1
    off = np.arange(wide) - band
    row = np.where((off >= 0)[None, :] & (off[None, :] <= lb[:, None]), off[None, :], big).astype(np.int64)
    dist = np.where(np.abs(lb - la) <= band, 0, big)
    final = np.full(len(a), big)
    end = lb - la + band
    inside = (end >= 0) & (end < wide)
    ends = np.clip(end, 0, wide - 1)
    ix = np.arange(len(a))
    done = la == 0
    final[done & inside] = row[ix, ends][done & inside]
    for i in range(1, la.max() + 1):
        j = i + off
        sub = row + (A[:, i - 1, None] != B[:, i - 1 : i - 1 + wide])
        dele = np.concatenate([row[:, 1:], np.full((len(a), 1), big)], 1) + 1
        new = np.minimum(sub, dele)
        new = np.where((j >= 0)[None, :] & (j[None, :] <= lb[:, None]), new, big)
        if -band <= -i <= band:
            new[:, band - i] = i
        new = np.minimum.accumulate(new - off, 1) + off  # insertions along the row
        new = np.where((j >= 0)[None, :] & (j[None, :] <= lb[:, None]), new, big)
        row = new
        hit = (la == i) & inside
        final[hit] = row[ix, ends][hit]
    return (final <= k) & (dist == 0)


BUCKETS = 256


def near_bags(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Pairs of rows (flat values, offsets) whose bags of tokens may be within k edits: an edit changes two counts by one at most."""
    n = len(k)

    def counts(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
        slot = np.repeat(np.arange(n), np.diff(off)) * BUCKETS + (flat[off[0] : off[-1]] & (BUCKETS - 1))
        return np.bincount(slot, minlength=n * BUCKETS).reshape(n, BUCKETS)

    return np.abs(counts(a, at) - counts(b, bt)).sum(1) <= 2 * k


def _each(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    col = batch.column(name)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    n = np.diff(col.offsets.to_numpy())
    return flat, np.concatenate([[0], np.cumsum(n)])


def _bits(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(3)) % np.uint64(size), (h * np.uint64(0x94D049BB133111EB) >> np.uint64(17)) % np.uint64(size)


def near(evaluation: DataFrame, training: DataFrame, everyday: list[int]) -> DataFrame:
    """evaluation(cls string, toks array<long>), training(cls, toks), hashes of everyday tokens -> (ecls, tcls), the pairs of
    classes whose distance is at most one token in eight of the longer one. Classes that are equal are among them."""
    spark = evaluation.sparkSession
    known = np.array(sorted(everyday), np.int64)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at = _each(b, "toks")
            rare = ~np.isin(flat, known)
            ids = b.column("cls").to_pylist()
            out: tuple[list, list, list, list] = ([], [], [], [])
            for i, c in enumerate(ids):
                row = flat[at[i] : at[i + 1]]
                if not len(row):  # classes have tokens
                    continue
                h = window_hashes(row, width(len(row)))
                for s in segments(row, rare[at[i] : at[i + 1]]):
                    out[0].append(c), out[1].append(h[s]), out[2].append(s), out[3].append(len(row))
            yield pa.record_batch([pa.array(out[0], pa.string()), pa.array(np.array(out[1], np.uint64).view(np.int64)), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], ["ecls", "h", "epos", "en"])

    segs = evaluation.mapInArrow(cut_up, "ecls string, h long, epos int, en int").persist()
    # the Bloom filter: words of bits, gathered from at most BLOOM_BITS / 64 groups
    count = segs.count()
    size = max(1 << 16, min(BLOOM_BITS, 1 << int(np.ceil(np.log2(max(1, count) * 12)))))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = _bits(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size)
            p = np.unique(np.concatenate([one, two]).astype(np.int64))
            yield pa.record_batch([pa.array(p >> 6), pa.array(np.left_shift(np.int64(1), p & 63))], ["word", "bit"])

    words = segs.select("h").mapInArrow(positions, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(size // 64, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    bloom = spark.sparkContext.broadcast(table)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value
        for b in batches:
            flat, at = _each(b, "toks")
            n = np.diff(at)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            fits: dict[int, list[int]] = {}  # by width, the rows that may have a partner cut to it
            for i, m in enumerate(n):
                if m:
                    for w in {width(x) for x in range(max(1, m - m // 8 - 1), m + m // 7 + 2)} - {0}:
                        fits.setdefault(w, []).append(i)
            for w, rows in fits.items():
                h = window_hashes(flat, w)
                if not len(h):
                    continue
                one, two = _bits(h, size)
                hit = ((bits[(one >> np.uint64(6)).astype(np.int64)] >> (one & np.uint64(63)).astype(np.int64)) & (bits[(two >> np.uint64(6)).astype(np.int64)] >> (two & np.uint64(63)).astype(np.int64)) & 1).astype(bool)
                p = np.nonzero(hit)[0]
                r = np.searchsorted(at, p, "right") - 1
                ok = (p + w <= at[r + 1]) & np.isin(r, rows)
                found.append((r[ok], p[ok] - at[r[ok]], h[p[ok]]))
            r, p, h = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
            yield pa.record_batch([b.column("cls").take(pa.array(r)), pa.array(h.view(np.int64)), pa.array(p.astype(np.int32)), pa.array(n[r].astype(np.int32))], ["tcls", "h", "tpos", "tn"])

    wins = training.select("cls", "toks").mapInArrow(look_up, "tcls string, h long, tpos int, tn int")
    k = F.floor(F.greatest("en", "tn") / 8)
    pairs = segs.join(wins, "h").where((F.abs(F.col("en") - F.col("tn")) <= k) & (F.abs(F.col("epos") - F.col("tpos")) <= k)).select("ecls", "tcls").distinct()
    both = pairs.join(evaluation.select(F.col("cls").alias("ecls"), F.col("toks").alias("e")), "ecls").join(training.select(F.col("cls").alias("tcls"), F.col("toks").alias("t")), "tcls")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                (e, ea), (t, ta) = _each(b, "e"), _each(b, "t")
                limit = np.maximum(np.diff(ea), np.diff(ta)) // 8
                like = np.nonzero(near_bags(e, ea, t, ta, limit))[0]
                ok = np.zeros(b.num_rows, bool)
                ok[like] = within([e[ea[i] : ea[i + 1]] for i in like], [t[ta[i] : ta[i + 1]] for i in like], limit[like])
                ok = pa.array(ok)
                yield pa.record_batch([b.column("ecls").filter(ok), b.column("tcls").filter(ok)], ["ecls", "tcls"])

    return both.mapInArrow(verify, "ecls string, tcls string")


def entries(manifest: DataFrame) -> DataFrame:
    """(entry_id, side, label, scope, cls, toks, place): each entry once, its side of the split and what it is compared by."""
    label = F.lower(F.trim("set"))
    m = manifest.select("entry_id", "scope", "file", "hunk_start_line", "hunk_end_line", "set", "hunk_content").where("entry_id is not null").dropDuplicates(["entry_id"])
    path = F.regexp_replace(F.regexp_replace(F.lower(F.trim("file")), "[/\\\\]+", "/"), "^(\\.?/)+", "")
    m = m.select("entry_id", label.alias("label"), "scope", tokens(F.col("hunk_content"), F.col("file")).alias("words"), F.concat_ws("\u0001", F.lower(F.trim("scope")), path, "hunk_start_line", "hunk_end_line").alias("place"), (F.col("scope").isNotNull() & F.col("file").isNotNull() & F.col("hunk_start_line").isNotNull() & F.col("hunk_end_line").isNotNull()).alias("placed"))
    m = m.where("label is not null").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    has = F.size("words") > 0
    return m.select(
        "entry_id", F.when(F.col("label").startswith("train"), "train").otherwise("evaluation").alias("side"), "label", "scope",
        F.when(has, F.md5(F.array_join("words", "\n"))).alias("cls"), F.when(has, F.transform("words", lambda x: F.xxhash64(x))).alias("toks"),
        F.when(~has & F.col("placed"), F.col("place")).alias("place"),
    )


def classes(e: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """The distinct contents of each side, and the everyday tokens."""
    whole = e.where("cls is not null").groupBy("cls").agg(F.first("toks").alias("toks"), F.bool_or(F.col("side") == "train").alias("train"), F.bool_or(F.col("side") != "train").alias("held"))
    whole = whole.persist()
    n = whole.count()
    common = whole.select(F.explode(F.array_distinct("toks")).alias("tok")).groupBy("tok").count().where(F.col("count") >= max(2, EVERYDAY * n)).select("tok")
    everyday = [r["tok"] for r in common.collect()]  # at most tokens of a class / EVERYDAY
    return whole.where("held").select("cls", "toks"), whole.where("train").select("cls", "toks"), everyday


def overlaps(manifest: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, linked classes(ecls, tcls), entries(evaluation id, training id) that agree by place)."""
    e = entries(manifest).persist()
    linked = near(*classes(e))
    at = e.where("place is not null").select("entry_id", "side", "place")
    by_place = at.where("side <> 'train'").select(F.col("entry_id").alias("eid"), "place").join(at.where("side = 'train'").select(F.col("entry_id").alias("tid"), "place"), "place").select("eid", "tid")
    return e, linked, by_place
