"""Filling containers of fixed capacity: Karmarkar-Karp multiway differencing.

Texts are sized in tokens of a public tokenizer. A text larger than a container is cut into full containers and a rest;
all other items stay whole. Items are dealt by hash to blocks of about WINDOWS containers. Within a block every item starts
as a partial partition with one filled window; the two partitions with the greatest difference between their fullest and
emptiest window are merged, the fullest windows of one onto the emptiest of the other, until one partition with
nearly equal windows is left. If a window exceeds the capacity the number of windows rises and the block is dealt again.

Defined results: rows without id or text are left out; a repeated id counts once; an empty text is an item of size 0; no
container exceeds its capacity.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

CAPACITY = 2048
WINDOWS = 128  # containers of a block, about
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the published pattern of this vocabulary (fixed value)
PIECE = 200_000  # characters encoded at once, about; longer texts are cut where no token can cross
_SEAM = re.compile(r"(?<=\S)(?=\s)")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """text in pieces of size characters and more, cut before white space, where no token crosses; what has none is one piece."""
    at = 0
    while len(text) - at > size:
        m = _SEAM.search(text, at + size)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n_tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if len(t) <= PIECE else sum(len(encode(p)) for p in pieces(t)) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return docs.mapInArrow(count, "doc_id long, n_tokens long").dropDuplicates(["doc_id"])


def difference(items: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: the window of each item among k, and the sums of the windows."""
    n = len(items)
    left, right = [-1] * n, [-1] * n  # windows as trees whose leaves are items
    heap = []
    for i, s in enumerate(items.tolist()):
        heap.append((-s, i, np.array([s]), np.array([i])))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, sa, na = heapq.heappop(heap)
        _, _, sb, nb = heapq.heappop(heap)
        # each keeps only its filled windows, fullest first; opposite ends meet where together there are more than k
        la, lb = len(sa), len(sb)
        meet = max(0, la + lb - k)
        if meet:
            # the emptiest filled windows of both meet: the least of one with the greatest among the meeting of the other
            ia, ib = np.arange(la - meet, la), np.arange(lb - meet, lb)[::-1]
            both = sa[ia] + sb[ib]
            nodes = np.arange(len(left), len(left) + meet)
            left.extend(na[ia].tolist()), right.extend(nb[ib].tolist())
            s = np.concatenate([sa[: la - meet], sb[: lb - meet], both])
            m = np.concatenate([na[: la - meet], nb[: lb - meet], nodes])
        else:
            s, m = np.concatenate([sa, sb]), np.concatenate([na, nb])
        order = np.argsort(-s, kind="stable")
        s, m = s[order], m[order]
        serial += 1
        heapq.heappush(heap, (-(int(s[0]) - (int(s[-1]) if len(s) == k else 0)), serial, s, m))
    _, _, s, m = heap[0]
    window = np.zeros(n, np.int64)
    for w, node in enumerate(m.tolist()):
        stack = [node]
        while stack:
            x = stack.pop()
            if x < n:
                window[x] = w
            else:
                stack += (left[x], right[x])
    return window, s


def windows(items: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, none above capacity, as few windows as differencing allows."""
    if not len(items):
        return np.zeros(0, np.int64)
    k = max(1, -(-int(items.sum()) // capacity))
    while True:
        w, s = difference(items, k)
        if s.max() <= capacity:
            return w
        k += max(1, k // 100)


def pack(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sized(doc_id, n_tokens) -> (doc_id, part_no, n_parts, first_token, n_tokens, container): each part in one container."""
    sized = cut(sized.select("doc_id", "n_tokens").where("doc_id is not null and n_tokens >= 0"))
    cap = F.lit(capacity).cast("long")
    full = F.floor(F.col("n_tokens") / cap)
    rest = F.col("n_tokens") % cap
    n_parts = full + F.when((rest > 0) | (full == 0), 1).otherwise(0)
    parts = sized.select("doc_id", n_parts.alias("n_parts"), F.explode(F.sequence(F.lit(1).cast("long"), n_parts)).alias("part_no"), "n_tokens")
    parts = parts.select("doc_id", "part_no", "n_parts", ((F.col("part_no") - 1) * cap).alias("first_token"), F.least(cap, F.col("n_tokens") - (F.col("part_no") - 1) * cap).alias("n_tokens"))
    whole = parts.where(F.col("n_tokens") == cap).withColumn("container", F.concat_ws(".", F.lit("full"), "doc_id", "part_no"))
    loose = parts.where(F.col("n_tokens") < cap)
    # a block holds about WINDOWS containers' worth, and at most 16 items for each of them
    t = loose.agg(F.sum("n_tokens").alias("s"), F.count(F.lit(1)).alias("n")).first()
    n_blocks = max(1, -(-int(t["s"] or 0) // (capacity * WINDOWS)), -(-int(t["n"] or 0) // (WINDOWS * 16)))
    block = F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(n_blocks))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "part_no"], ascending=[False, True, True], ignore_index=True)
        w = windows(pdf["n_tokens"].to_numpy(np.int64), capacity)
        pdf["container"] = [f"{b}.{x}" for b, x in zip(pdf["block"], w)]
        return pdf.drop(columns="block")

    schema = "doc_id long, part_no long, n_parts long, first_token long, n_tokens long, container string"
    # blocks are work, not bytes: they get a task each, which adaptive execution would merge
    return loose.withColumn("block", block).repartition(n_blocks, "block").groupBy("block").applyInPandas(fill, schema).unionByName(whole)
