"""Byte-level BPE ids of many texts at once.

No pre-token of the vocabulary's pattern reaches over a single space between two characters that are not white space,
so a text's ids are those of its parts between such spaces, one after the other.  Of the parts of a chunk only the
distinct ones are encoded, by an encoder of the same ranks where a file of them lies beside the tokenizer's; texts with
a special token, and all texts of tokenizers without such a file, are encoded by the tokenizers library itself.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import textvec as tv

_CODES = tv._CODES | np.uint64(1)
SPECIAL = "<|endoftext|>"


@lru_cache(1)
def library(json_path: str):
    """The library's tokenizer of this file; most tasks never need it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


@lru_cache(1)
def encoder(json_path: str):
    """An encoder of the tokenizer's ranks, and the bytes that each id stands for; None without a file of the ranks."""
    path = json_path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(path):
        return None
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts can be cut: text starts, and spaces between two characters that can't be white space of any kind."""
    n = len(data)
    at = np.flatnonzero(data[1:-1] == 0x20) + 1 if n > 2 else np.zeros(0, np.int64)
    risky = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3]) | tv.WHITE | (np.arange(256) < 0x20)
    ok = ~risky[data[at + 1]] & ~(tv.WHITE | (np.arange(256) < 0x20))[data[at - 1]]
    for back in (2, 3):
        ok &= ~((data[at - 1] >= 0x80) & risky[data[np.maximum(at - back, 0)]] & (data[np.maximum(at - back, 0)] >= 0x80))
    starts = offsets[:-1][np.diff(offsets) > 0]
    marks = np.zeros(n + 1, bool)
    marks[at[ok]] = True
    marks[starts] = True
    return np.flatnonzero(marks[:n])


def encode(texts: tv.Texts, json_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and the offsets of each text's ids."""
    data, offsets = texts.data, texts.offsets
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    known = encoder(json_path)
    if known is None or SPECIAL.encode() in data.tobytes():  # the library takes this string as one id
        lists = [library(json_path).encode(bytes(data[a:b]).decode(), add_special_tokens=False).ids for a, b in zip(offsets, offsets[1:], strict=False)]
        return np.fromiter((i for x in lists for i in x), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    fast, sizes = known
    starts = _cuts(data, offsets)
    ends = np.append(starts[1:], len(data))
    _, index, inverse = np.unique(tv.hash_spans(data, _CODES, starts, ends), return_index=True, return_inverse=True)
    # parts that begin with a space keep their borders when they are joined; the others, first in a text, are encoded alone
    spaced = data[starts[index]] == 0x20
    joined = data[tv.ragged(starts[index[spaced]], (ends - starts)[index[spaced]])].tobytes()
    at_end = _ends_open(data, ends[index])
    if at_end[spaced].any():
        spaced &= ~at_end
        joined = data[tv.ragged(starts[index[spaced]], (ends - starts)[index[spaced]])].tobytes()
    ids = np.array(fast.encode_ordinary(joined.decode()), np.uint32)
    firsts = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum((ends - starts)[index[spaced]]), "left") + 1
    n_ids = np.zeros(len(index), np.int64)
    n_ids[spaced] = np.diff(np.concatenate([[0], firsts]))
    alone = [fast.encode_ordinary(bytes(data[starts[i] : ends[i]]).decode()) for i in index[~spaced]]
    n_ids[~spaced] = [len(x) for x in alone]
    begin = np.zeros(len(index), np.int64)
    begin[spaced] = np.cumsum(n_ids[spaced]) - n_ids[spaced]
    begin[~spaced] = len(ids) + np.cumsum(n_ids[~spaced]) - n_ids[~spaced]
    pool = np.concatenate([ids, np.fromiter((i for x in alone for i in x), np.uint32)])
    lengths = n_ids[inverse]
    out = pool[tv.ragged(begin[inverse], lengths)]
    total = np.concatenate([[0], np.cumsum(lengths)])
    return out, total[np.searchsorted(starts, offsets)]


def _ends_open(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Parts that end in white space of any kind, as a text's last part may: a part joined behind would join it."""
    last = data[ends - 1]
    return (last <= 0x20) | (last == 0x7F) | ((last >= 0x80) & np.isin(data[np.maximum(ends - 2, 0)], [0xC2])) | ((last >= 0x80) & np.isin(data[np.maximum(ends - 3, 0)], [0xE1, 0xE2, 0xE3]))


def encode_column(column: pa.Array, json_path: str):
    for chunk in tv.chunks(column):
        yield chunk, *encode(chunk, json_path)
