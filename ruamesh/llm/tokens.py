"""Encoding of a corpus with a public byte-level BPE vocabulary, long texts by tree concatenation.

A text of more than ``split_chars`` characters is halved again and again; its pieces are encoded as rows of their own
wherever Spark puts them, and neighbours are then merged level by level. At a join only the pre-tokens that end
within ``LOOK`` characters of the left side's end are uncertain. From their start the text is scanned anew over a
window that doubles until the new scan ends a pre-token exactly where the right side's scan ended one. The scan has no
memory beyond its position, so from there on both sides agree for good.

A pre-token across the join may itself be long (text without any break). Its ids on both sides are known; only a
window of ids around the join is encoded anew, and it doubles on both sides until its outermost ids agree with the
ids beyond: two ids side by side stand in an encoding exactly if encoding their joint text gives these two, and a
sequence in which all neighbours do is the encoding. So the result equals that of the whole text, whatever the text.

Defined results: null and empty texts have an empty list; special-token strings are ordinary text; every row comes by
itself, repeated ones too. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruamesh.common import cut

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that parts text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest text, in characters, that is encoded in one go; first window at a join.
SPLIT_CHARS, WINDOW = 4096, 64
#: Ids on each side of a join inside one pre-token that are encoded anew at first.
IDS = 8
#: A pre-token is certain when this many characters follow it ("'re" needs two behind the apostrophe).
LOOK = 3

_SCAN = regex.compile(PATTERN)


_BUILT: dict[str, tiktoken.Encoding] = {}


def encoding(path: str, ranks: bytes | None = None) -> tiktoken.Encoding:
    """The encoding of a rank file (or of its content), built once in each Python process."""
    if path not in _BUILT:
        if ranks is None:
            with open(path, "rb") as f:
                ranks = f.read()
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _BUILT[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _BUILT[path]


def encode_part(enc: tiktoken.Encoding, text: str) -> tuple[list[int], list[int], list[int]]:
    """Ids, ends of the pre-tokens in characters, and how many ids there are up to each end."""
    ids, ends, upto = [], [], []
    for m in _SCAN.finditer(text):
        ids += enc.encode_ordinary(m.group())
        ends.append(m.end())
        upto.append(len(ids))
    return ids, ends, upto


def join_ids(enc: tiktoken.Encoding, left: list[int], right: list[int], first: int = IDS) -> list[int]:
    """Ids of one pre-token from those of its two parts, by a window around the join that grows until both sides agree."""
    if not left or not right:
        return left or right
    text = enc.decode_single_token_bytes
    size = first
    while True:
        a, b = max(0, len(left) - size), min(len(right), size)
        mid = enc._encode_single_piece(b"".join(map(text, left[a:] + right[:b])))
        stands = lambda x, y: enc._encode_single_piece(text(x) + text(y)) == [x, y]
        if (a == 0 or stands(left[a - 1], mid[0])) and (b == len(right) or stands(mid[-1], right[b])):
            return left[:a] + mid + right[b:]
        size *= 2


def merge(enc: tiktoken.Encoding, left: tuple, right: tuple, window: int = WINDOW) -> tuple:
    """(text, ids, ends, upto) of two neighbours as one."""
    (lt, li, le, lu), (rt, ri, re_, ru) = left, right
    if not le or not re_:
        return (lt + rt, *((ri, re_, ru) if not le else (li, le, lu)))
    certain = bisect.bisect_right(le, len(lt) - LOOK)
    keep, ids_kept = (le[certain - 1], lu[certain - 1]) if certain else (0, 0)
    tail, known, size = lt[keep:], {e: k for k, e in enumerate(re_)}, window
    while True:
        text = tail + rt[:size]
        whole = size >= len(rt)
        met, new = None, []
        for m in _SCAN.finditer(text):
            if m.end() > len(text) - LOOK and not whole:
                break  # more text might change it
            new.append(m.span())
            k = known.get(m.end() - len(tail))
            if k is not None:
                met = k
                break
        if met is not None:
            break
        size *= 2
    ids, ends, upto = li[:ids_kept], le[:certain], lu[:certain]
    for a, b in new:
        # Parts of a pre-token across the join that each side has encoded as a pre-token of its own.
        own = a == 0 and certain < len(le) and le[certain] == len(lt) and b > len(tail) and b - len(tail) == re_[0]
        ids = ids + (join_ids(enc, li[ids_kept : lu[certain]], ri[: ru[0]]) if own else enc.encode_ordinary(text[a:b]))
        ends = [*ends, keep + b]
        upto = [*upto, len(ids)]
    shift, base = len(ids) - ru[met], len(lt)
    return lt + rt, ids + ri[ru[met] :], ends + [base + e for e in re_[met + 1 :]], upto + [shift + u for u in ru[met + 1 :]]


def halves(text: str, most: int) -> list[str]:
    """The text in 2**k parts, each of at most ``most`` characters."""
    parts = 1
    while -(-len(text) // parts) > most:
        parts *= 2
    step = -(-len(text) // parts) or 1
    return [text[k : k + step] for k in range(0, len(text), step)]


_NODE = "_rm_doc string, _rm_hash bigint, _rm_part bigint, text string, ids array<int>, ends array<int>, upto array<int>"


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{FOLDER}/{VOCABULARY}", split_chars: int = SPLIT_CHARS) -> DataFrame:
    """(key, ids) of every document. The rank file is read on the driver and broadcast (some 1 MB)."""
    with open(path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    # The key goes as text: pandas would turn whole numbers beside a null into floats.
    base = docs.select(F.col(key).cast("bigint").cast("string").alias("_rm_doc"), F.col(text).alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path, ranks.value)
        for pdf in batches:
            yield pd.DataFrame({"_rm_doc": pdf["_rm_doc"], "ids": [enc.encode_ordinary(t) if t else [] for t in pdf["text"]]})

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(d, h, k, p) for d, h, t in zip(pdf["_rm_doc"], pdf["_rm_hash"], pdf["text"]) for k, p in enumerate(halves(t, split_chars))]
            yield pd.DataFrame(out, columns=["_rm_doc", "_rm_hash", "_rm_part", "text"])

    def encode_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path, ranks.value)
        for pdf in batches:
            pdf["ids"], pdf["ends"], pdf["upto"] = zip(*(encode_part(enc, t) for t in pdf["text"])) if len(pdf) else ([], [], [])
            yield pdf

    def join_parts(pdf: pd.DataFrame) -> pd.DataFrame:
        enc, rows = encoding(path, ranks.value), pdf.sort_values("_rm_part")
        node = None
        for t, i, e, u in zip(rows["text"], rows["ids"], rows["ends"], rows["upto"]):
            one = (t, list(i), list(e), list(u))
            node = one if node is None else merge(enc, node, one)
        first = rows.iloc[0]
        return pd.DataFrame([(first["_rm_doc"], first["_rm_hash"], first["_rm_part"] // 2, *node)], columns=["_rm_doc", "_rm_hash", "_rm_part", "text", "ids", "ends", "upto"])

    out = base.filter(size <= split_chars).mapInPandas(whole, "_rm_doc string, ids array<int>")
    long = base.filter(size > split_chars).withColumn("_rm_hash", F.xxhash64("text"))
    copies = cut(long.groupBy("_rm_doc", "_rm_hash").agg(F.count(F.lit(1)).alias("_rm_n"), F.max(F.length("text")).alias("_rm_len")))
    longest = copies.agg(F.max("_rm_len")).first()[0] or 0
    nodes = long.dropDuplicates(["_rm_doc", "_rm_hash"]).mapInPandas(parts, "_rm_doc string, _rm_hash bigint, _rm_part bigint, text string")
    nodes = nodes.repartition("_rm_doc", "_rm_hash", "_rm_part").mapInPandas(encode_parts, _NODE)
    while longest > split_chars:
        nodes = cut(nodes.groupBy("_rm_doc", "_rm_hash", F.floor(F.col("_rm_part") / 2).alias("_rm_pair")).applyInPandas(join_parts, _NODE))
        longest = -(-longest // 2)
    # A null key must find itself.
    nodes = nodes.alias("a").join(copies.alias("b"), F.col("a._rm_doc").eqNullSafe(F.col("b._rm_doc")) & (F.col("a._rm_hash") == F.col("b._rm_hash"))).select("a._rm_doc", "ids", "_rm_n").withColumn("_rm_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_rm_n")))
    return out.unionByName(nodes.select("_rm_doc", "ids")).select(F.col("_rm_doc").cast("bigint").alias(key), "ids")
