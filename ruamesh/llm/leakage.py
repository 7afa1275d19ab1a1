"""Evaluation passages inside training texts: greedy string tiling over seeds, by running Karp-Rabin.

Both sides become words (longest runs of letters and digits, case and accents dropped, markup removed), and each word
a 64-bit hash, once a text. Every window of ``seed`` words of an item is a seed; a document and an item that share one
are a candidate pair, no more. The pair's tiles decide: runs of equal windows along a diagonal are the common runs;
the longest is marked first, what a mark leaves of the others goes back into the queue, tiles never overlap, and runs
of fewer words than a seed are no tiles. Tiles may stand in any order, so their summed length shows an item
whose parts were moved.

The items' seeds are looked up in the Python worker while there are at most ``MAX_SEEDS`` of them (a sorted array of
64-bit hashes, so 16 MB); beyond that the documents' windows are exploded and equi-joined. Both give the same pairs.
Pairs are dealt evenly to tasks before they are tiled, so that a boilerplate document or item is no task of its own.

Defined results: null texts and texts or items of fewer words than a seed give no row; repeated texts are reported
under each of their ids, items likewise; repeated rows come once; a document of any length is read whole.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruamesh.common import cut, lookup

#: Words of a seed, and of the shortest tile; words of a tile that is a leak.
SEED, LEAK = 8, 12
#: Equal windows of a pair that are held at once.
MAX_EQUAL = 4_000_000
MAX_SEEDS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD, _MARKS, _TAG = re.compile(r"[^\W_]+"), re.compile("[̀-ͯ]+"), re.compile(r"</?[A-Za-z][^<>]*>|<\|\w+\|>")


def words(text: str | None) -> list[str]:
    """Words of a text as they are compared."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(text.casefold() if text.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", text)).casefold())


_HASHES: dict[str, int] = {}


def hashes(tokens: list[str]) -> np.ndarray:
    """64-bit hash of each word; those of some 500,000 words are kept."""
    if len(_HASHES) > 500_000:
        _HASHES.clear()
    out = np.empty(len(tokens), dtype=np.uint64)
    for k, w in enumerate(tokens):
        h = _HASHES.get(w)
        if h is None:
            h = _HASHES[w] = xxhash.xxh3_64_intdigest(w)
        out[k] = h
    return out


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin value of each window of ``size`` words, modulo 2**64."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _BASE + h[k : k + n]
    return out


def common_runs(item: np.ndarray, text: np.ndarray, shortest: int) -> np.ndarray:
    """Rows (words, text position, item position) of the longest common runs of at least ``shortest`` words."""
    wi, wt = windows(item, shortest), windows(text, shortest)
    order = np.argsort(wi, kind="stable")
    lo, hi = np.searchsorted(wi[order], wt, "left"), np.searchsorted(wi[order], wt, "right")
    n = hi - lo
    at = np.flatnonzero(n)
    parts, done = [], 0
    upto = np.cumsum(n[at])
    while done < len(at):
        # As many text positions as keep the pairs within bounds, at least one.
        last = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + MAX_EQUAL, "right")))
        t = at[done:last]
        k = np.repeat(lo[t], n[t]) + np.arange(n[t].sum()) - np.repeat(np.cumsum(n[t]) - n[t], n[t])
        i, t = order[k], np.repeat(t, n[t])
        line = np.lexsort((t, t - i))
        i, t = i[line], t[line]
        begin = np.flatnonzero(np.r_[True, (np.diff(t - i) != 0) | (np.diff(t) != 1)])
        parts.append(np.column_stack([np.diff(np.r_[begin, len(t)]), t[begin], i[begin]]))
        done = last
    if not parts:
        return np.empty((0, 3), dtype=np.int64)
    runs = np.concatenate(parts)
    if len(parts) > 1:  # runs that go on in the next part
        runs = runs[np.lexsort((runs[:, 1], runs[:, 1] - runs[:, 2]))]
        diagonal, end = runs[:, 1] - runs[:, 2], runs[:, 1] + runs[:, 0]
        begin = np.flatnonzero(np.r_[True, (np.diff(diagonal) != 0) | (runs[1:, 1] != end[:-1])])
        runs = np.column_stack([np.add.reduceat(runs[:, 0], begin), runs[begin, 1], runs[begin, 2]])
    runs[:, 0] += shortest - 1
    return runs


def tiles(item: list[str], text: list[str], shortest: int) -> list[tuple[int, int, int]]:
    """(item position, text position, words) of the tiles, longest first; ties: first in the text, then in the item."""
    return tiles_of(hashes(item), hashes(text), shortest)


def tiles_of(item: np.ndarray, text: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """``tiles`` of hashed words."""
    queue = [(-n, t, i) for n, t, i in common_runs(item, text, shortest).tolist()]
    if not queue:
        return []
    heapq.heapify(queue)
    used_i, used_t, out, free = np.zeros(len(item), bool), np.zeros(len(text), bool), [], len(item)
    while queue and free >= shortest:
        n, t, i = heapq.heappop(queue)
        n = -n
        used = used_i[i : i + n] | used_t[t : t + n]
        if not used.any():
            used_i[i : i + n] = used_t[t : t + n] = True
            free -= n
            out.append((i, t, n))
            continue
        edge = np.flatnonzero(np.diff(np.r_[True, used, True].astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= shortest:
                heapq.heappush(queue, (a - b, t + a, i + a))
    return out


def leaks(docs: DataFrame, items: DataFrame, seed: int = SEED, least: int = LEAK, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """(doc_id, item_id, n_words, longest, covered) for each document and item with a tile of ``least`` words or more.

    n_words is the item's; longest is its longest tile and covered the sum of all tiles of at least ``seed`` words.
    """
    spark = docs.sparkSession
    # Keys go as text: pandas would turn whole numbers beside a null into floats.
    d = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), F.xxhash64("text").alias("th"), "text").filter("text IS NOT NULL")
    i = items.select(F.col("item_id").cast("bigint").cast("string").alias("item_id"), F.xxhash64("text").alias("ih"), F.col("text").alias("item")).filter("item IS NOT NULL").distinct()

    def item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, h, t in zip(pdf["item_id"], pdf["ih"], pdf["item"]):
                w = hashes(words(t))
                out.append((k, h, w.astype(np.int64), np.unique(windows(w, seed)).astype(np.int64)))
            yield pd.DataFrame(out, columns=["item_id", "ih", "item", "seeds"])

    hashed = cut(i.mapInPandas(item_seeds, "item_id string, ih bigint, item array<bigint>, seeds array<bigint>"))
    seeds = hashed.select("item_id", "ih", F.explode("seeds").alias("seed"))
    known = None
    if (hashed.agg(F.sum(F.size("seeds"))).first()[0] or 0) <= max_seeds:
        known = spark.sparkContext.broadcast(np.unique(np.fromiter((r[0] for r in seeds.select("seed").toLocalIterator()), dtype=np.int64)))

    def doc_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, h, t in zip(pdf["doc_id"], pdf["th"], pdf["text"]):
                all_words = hashes(words(t))
                w = windows(all_words, seed).astype(np.int64)
                if known is not None and len(w):
                    at = np.searchsorted(known.value, w)
                    at[at == len(known.value)] = 0
                    w = w[known.value[at] == w] if len(known.value) else w[:0]
                if len(w):
                    out.append((k, h, all_words.astype(np.int64), np.unique(w)))
            yield pd.DataFrame(out, columns=["doc_id", "th", "words", "seeds"])

    # Only documents that hold a seed are written and move on with their words.
    hits = cut(d.mapInPandas(doc_seeds, "doc_id string, th bigint, words array<bigint>, seeds array<bigint>"))
    pairs = lookup(hits.select("doc_id", "th", F.explode("seeds").alias("seed")), seeds, ["seed"]).select("doc_id", "th", "item_id", "ih").distinct()

    def tile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, q, t, x in zip(pdf["doc_id"], pdf["item_id"], pdf["words"], pdf["item"]):
                got = tiles_of(np.asarray(x, np.int64).view(np.uint64), np.asarray(t, np.int64).view(np.uint64), seed)
                out.append((k, q, len(x), max((g[2] for g in got), default=0), sum(g[2] for g in got)))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words", "longest", "covered"])

    # A null key must find itself.
    h, g = hits.alias("h"), hashed.alias("g")
    both = pairs.alias("p").join(h, F.col("p.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("p.th") == F.col("h.th"))).select("p.*", "h.words")
    both = both.alias("p").join(g, F.col("p.item_id").eqNullSafe(F.col("g.item_id")) & (F.col("p.ih") == F.col("g.ih"))).select("p.*", "g.item")
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    got = both.repartition(width, "doc_id", "th", "item_id", "ih").mapInPandas(tile, "doc_id string, item_id string, n_words bigint, longest bigint, covered bigint")
    return got.withColumns({"doc_id": F.col("doc_id").cast("bigint"), "item_id": F.col("item_id").cast("bigint")}).filter(F.col("longest") >= least).distinct()
