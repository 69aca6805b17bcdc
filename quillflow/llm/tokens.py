"""Token ids of a byte-level BPE, with a memo of space-delimited pieces.

The pre-tokenizer's pattern always starts a token at a space before a non-space, so
a text's ids are those of its pieces cut there, one after the other. Pieces repeat,
so each is encoded once and found again by its hash.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quillflow.llm import textops as T

TOKENIZER = "byte_bpe_50k.json"
SPECIAL = b"<|endoftext|>"
#: Pieces that the memo of a worker holds at most; it starts anew beyond that, which changes no result.
MEMO = 1_000_000
_OPEN: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def encoder(path: str) -> Encoder:
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


def ranked(path: str):
    """An encoder of the same vocabulary from a file of ranks beside the tokenizer's; it gives the same ids with less work for each piece. None without one."""
    if not os.path.exists(path):
        return None
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe


def grown(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


class Encoder:
    """encode() of a column of texts; one for each Python worker."""

    def __init__(self, path: str):
        self.path = path
        self.quick = ranked(path.removesuffix(".json") + ".tiktoken")
        self.clear()

    @functools.cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def clear(self) -> None:
        #: Hashes of pieces in ascending order, and where the ids of each begin and how many there are.
        self.keys, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 19, np.int32), 0

    def _add(self, keys: np.ndarray, pieces: list[str]) -> None:
        if self.quick is not None:
            got = list(map(self.quick.encode_ordinary, pieces))
        else:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        count = np.fromiter(map(len, got), np.int32, len(got))
        ids = np.fromiter(itertools.chain.from_iterable(got), np.int32, int(count.sum()))
        self.flat = grown(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.keys, keys)
        self.start = np.insert(self.start, at, self.used + np.cumsum(count) - count)
        self.keys, self.count = np.insert(self.keys, at, keys), np.insert(self.count, at, count)
        self.used += len(ids)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets per row) for runs of rows; null is empty."""
        for at, data, off in T.chunks(column, 1 << 20):
            if SPECIAL in data.tobytes():
                got = [e.ids for e in self.tokenizer.encode_batch_fast([data[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:], strict=True)], add_special_tokens=False)]
                yield at, np.concatenate([np.array(x, np.int32) for x in got]), np.concatenate([[0], np.cumsum([len(x) for x in got])])
                continue
            if not len(data):
                yield at, np.zeros(0, np.int32), np.zeros(len(off), np.int64)
                continue
            after, before = np.append(data[1:], 32), np.append(np.uint8(32), data[:-1])
            cut = (data == 32) & ((~T.SPACE[after] & (after < 128)) | ((after > 127) & (before < 128) & ~T.SPACE[before]))
            cut[off[:-1][off[:-1] < len(data)]] = True
            starts = np.flatnonzero(cut)
            keys, first, which = np.unique(T.hash_runs(data, starts), return_index=True, return_inverse=True)
            if len(self.keys) + len(keys) > MEMO:
                self.clear()
            at_key = np.searchsorted(self.keys, keys)
            new = np.flatnonzero(np.append(self.keys, np.uint64(0))[at_key] != keys) if len(self.keys) else np.arange(len(keys))
            if len(new):
                raw, ends = data.tobytes(), np.append(starts[1:], len(data))
                places = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
                self._add(keys[new], [raw[a:b].decode() for a, b in places])
                at_key = np.searchsorted(self.keys, keys)
            index = at_key[which]
            count = self.count[index].astype(np.int64)
            total = np.concatenate([[0], np.cumsum(count)])
            yield at, T.gather(self.flat, self.start[index], count), total[np.searchsorted(starts, off)]
