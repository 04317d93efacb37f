"""Filling fixed-capacity containers with texts.

Lengths are tokens of a public tokenizer. A text longer than a container is cut into full containers' worth of tokens
and a rest; every other text stays whole. Items are dealt by hash into blocks, and each block is divided into windows
by Karmarkar-Karp multiway differencing: the two partial partitions of widest spread are merged so that the fullest
window of one meets the emptiest of the other, which ends in windows of nearly equal sums. A block starts with the
fewest windows its tokens allow, and the count rises while the fullest window exceeds the capacity.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.runtime import materialise, ship, ship_file

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of texts before byte-pair merges that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents per block, on average; windows are filled within a block.
BLOCK_DOCUMENTS = 2_000


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every document with an id; null and empty texts have 0 tokens."""

    shipped = ship_file(documents.sparkSession, vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(SparkFiles.get(shipped))
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [len(enc.encode_to_numpy(t)) if t else 0 for t in pdf["text"]]})

    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(count, "doc_id long, tokens long")


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each item under multiway differencing into ``windows`` windows.

    A partial partition is a list of (sum, items), emptiest first, with the common part of the sums taken off;
    windows still empty are not listed.
    """
    owner = np.zeros(len(sizes), np.int64)
    if windows <= 1 or not len(sizes):
        return owner
    # links[i]: the item that joined i's window before it; a window is a chain of items
    link = np.full(len(sizes), -1, np.int64)
    tail = np.arange(len(sizes))  # first item of a chain -> last item
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i in np.argsort(-sizes, kind="stable"):
        heap.append((-int(sizes[i]), len(heap), np.array([sizes[i]], np.int64), np.array([i], np.int64)))
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a, ia = heapq.heappop(heap)
        _, _, b, ib = heapq.heappop(heap)
        over = len(a) + len(b) - windows
        if over > 0:
            # a: ascending; its emptiest listed windows meet b's fullest. Empty windows of either side take the rest.
            # With e empty windows in a, b's fullest len(b) - over go there; b's other windows meet a's emptiest ones.
            meet_a, meet_b = ia[:over], ib[:over][::-1]
            link[meet_b] = tail[meet_a]
            tail[meet_a] = tail[meet_b]
            sums = np.concatenate([a[:over] + b[:over][::-1], a[over:], b[over:]])
            items = np.concatenate([meet_a, ia[over:], ib[over:]])
        else:
            sums, items = np.concatenate([a, b]), np.concatenate([ia, ib])
        by = np.argsort(sums, kind="stable")
        sums, items = sums[by], items[by]
        if len(sums) == windows:
            sums = sums - sums[0]
            spread = int(sums[-1])
        else:
            spread = int(sums[-1])
        serial += 1
        heapq.heappush(heap, (-spread, serial, sums, items))
    for w, first in enumerate(heap[0][3]):
        i = tail[first]
        while i >= 0:
            owner[i] = w
            i = link[i] if i != first else -1
    return owner


def filled(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows of at most ``capacity``: the count starts at the least possible and rises until all fit.

    The rise doubles while windows overflow and is then halved back to the smallest count found to fit.
    """
    if not len(sizes):
        return np.zeros(0, np.int64)
    least = max(1, -(-int(sizes.sum()) // capacity))
    fits = lambda owner: np.bincount(owner, weights=sizes).max() <= capacity
    step, low, k = 1, least - 1, least
    owner = differencing(sizes, k)
    while not fits(owner):
        low, k, step = k, min(k + step, len(sizes)), step * 2
        owner = differencing(sizes, k) if k < len(sizes) else np.arange(len(sizes))
    while k - low > 1:
        middle = (low + k) // 2
        trial = differencing(sizes, middle)
        if fits(trial):
            k, owner = middle, trial
        else:
            low = middle
    return np.unique(owner, return_inverse=True)[1]


def pack(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """container_class, container_id, doc_id, first_token, tokens of every document in every class.

    Texts without tokens need no container and have no row; a repeated document id is packed as often as it stands;
    classes without a positive capacity hold nothing. ``container_id`` is "block-window" (or "whole-n" for full
    pieces of a text longer than its container).
    """
    spark = documents.sparkSession
    ship(spark)
    classes = [(r.container_class, int(r.capacity_tokens)) for r in containers.where("container_class is not null and capacity_tokens > 0").distinct().collect()]  # a handful
    # rows are dealt by id and place, so that no number of rows of one id ends up in one block
    counted = materialise(token_counts(documents, vocabulary).withColumn("deal", F.xxhash64("doc_id", F.monotonically_increasing_id())), "token-counts")
    blocks = max(1, -(-counted.count() // BLOCK_DOCUMENTS))
    schema = "container_class string, container_id string, doc_id long, first_token long, tokens long"
    if not classes:
        return spark.createDataFrame([], schema)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        name, capacity, block = pdf["container_class"].iat[0], int(pdf["capacity_tokens"].iat[0]), int(pdf["block"].iat[0])
        tokens, docs = pdf["tokens"].to_numpy(np.int64), pdf["doc_id"].to_numpy(np.int64)
        by = np.lexsort((docs, -tokens))
        tokens, docs = tokens[by], docs[by]
        full = np.where(tokens > capacity, tokens // capacity, 0)
        rest = tokens - full * capacity
        item = np.flatnonzero(rest > 0)
        owner = filled(rest[item], capacity)
        long = np.repeat(np.arange(len(tokens)), full)
        piece = np.arange(len(long)) - np.repeat(np.concatenate([[0], np.cumsum(full)[:-1]]), full) if len(long) else np.zeros(0, np.int64)
        return pd.DataFrame({
            "container_class": name,
            "container_id": [f"whole-{block}-{i}" for i in range(len(long))] + [f"{block}-{w}" for w in owner],
            "doc_id": np.concatenate([docs[long], docs[item]]),
            "first_token": np.concatenate([piece * capacity, full[item] * capacity]).astype(np.int64),
            "tokens": np.concatenate([np.full(len(long), capacity, np.int64), rest[item]]),
        })

    sizes = F.explode(F.array(*[F.struct(F.lit(n).alias("container_class"), F.lit(c).alias("capacity_tokens")) for n, c in classes])).alias("c")
    dealt = counted.where("tokens > 0").select("doc_id", "tokens", F.pmod("deal", F.lit(blocks)).alias("block"), sizes).select("doc_id", "tokens", "block", "c.*")
    return dealt.groupBy("container_class", "block").applyInPandas(fill, schema)
