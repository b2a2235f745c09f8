"""Byte-level BPE by monoid tree reduction.

A text is halved until its pieces are short; leaves are encoded directly. Two neighbours are joined by encoding a window around their border
anew: it grows on both sides until it ends where the tokens outside are proven to stay. A place where white space follows another character is
such a proof: no alternative of the pattern matches a character followed by white space, so every segmentation is cut there whatever lies to
the left, and what lies to the right of a cut is segmented without looking back. Where a half has no such place the window takes the whole half.
Decoding concatenates up the same kind of tree.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfabric.llm.shared import release

#: Characters, or token ids, that a leaf holds at most, the first window on each side of a border, and values that are made at once.
LEAF, WINDOW, RUN = 512, 64, 256
_BLANK = " \n\t\r"


@lru_cache(maxsize=4)
def load(path: str, pattern: str):
    """Encoder of a file of base64 tokens and ranks, and its tokens by rank."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), tokens


def _cut_before(text: str, low: int, mid: int) -> int:
    """The last proven cut inside text[low:mid], or low."""
    width = WINDOW
    while True:
        floor = max(low, mid - width)
        for p in range(mid - 1, floor, -1):
            if text[p] in _BLANK and not text[p - 1].isspace():
                return p
        if floor == low:
            return low
        width *= 2


def _cut_after(text: str, mid: int, high: int) -> int:
    """The first proven cut inside text[mid:high], or high."""
    width = WINDOW
    while True:
        roof = min(high, mid + width)
        for q in range(mid + 1, roof):
            if text[q] in _BLANK and not text[q - 1].isspace():
                return q
        if roof == high:
            return high
        width *= 2


def encode_tree(text: str, encode: Callable[[str], list[int]], leaf: int = LEAF) -> np.ndarray:
    """Token ids of a text."""
    def node(low: int, high: int) -> np.ndarray:
        if high - low <= leaf:
            return np.array(encode(text[low:high]), dtype=np.uint32)
        mid = (low + high) // 2
        left, right = node(low, mid), node(mid, high)
        p, q = _cut_before(text, low, mid), _cut_after(text, mid, high)
        kept = len(left) - len(encode(text[p:mid]))
        gone = len(encode(text[mid:q]))
        return np.concatenate([left[:kept], np.array(encode(text[p:q]), dtype=np.uint32), right[gone:]])

    return node(0, len(text))


def decode_tree(ids: np.ndarray, tokens: list[bytes], leaf: int = LEAF) -> bytes:
    """Bytes of token ids."""
    if len(ids) <= leaf:
        return b"".join([tokens[i] for i in ids.tolist()])
    mid = len(ids) // 2
    return decode_tree(ids[:mid], tokens, leaf) + decode_tree(ids[mid:], tokens, leaf)


def _values(made: Iterator[bytes]) -> pa.Array:
    """Binary values as they are made, in runs, so that they are not held twice."""
    runs = [pa.array(run, pa.binary()) for run in iter(lambda: list(islice(made, RUN)), [])]
    out = pa.concat_arrays(runs) if runs else pa.array([], pa.binary())
    del runs
    release()
    return out


def encode(documents: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", leaf: int = LEAF) -> DataFrame:
    """All columns plus `ids`: the token ids of the whole text as little-endian unsigned 32-bit integers, in one binary value.

    Equal to encoding each match of the pattern by the ranks, without special tokens. A missing or empty text has no tokens. A column of the name of
    `ids` is replaced; rows are neither moved nor joined, so ties, repeated rows and empty tables need no rule.
    """
    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        encoder, _ = load(vocabulary, pattern)
        return _values(encode_tree(t.as_py(), encoder.encode_ordinary, leaf).astype("<u4").tobytes() if t.is_valid else b"" for t in texts)

    return documents.withColumn(ids, run(F.col(text).cast("string")))


def decode(documents: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", decoded: str = "decoded", leaf: int = LEAF) -> DataFrame:
    """All columns plus `decoded`: the bytes of the ids that `encode` writes; missing ids have none."""
    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        _, tokens = load(vocabulary, pattern)
        return _values(decode_tree(np.frombuffer(v.as_buffer(), "<u4"), tokens, leaf) if v.is_valid else b"" for v in values)

    return documents.withColumn(decoded, run(F.col(ids)))
