"""Token counts of a public byte-level BPE, from cached counts of space-separated chunks."""

from __future__ import annotations

import base64
import re
import zlib
from array import array

import numpy as np

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that this public vocabulary was trained with.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks kept between batches, at most.
CACHE_LIMIT = 1_000_000

_WORD = re.compile(r"\w+")


def load_encoding(data: bytes):
    """The tokenizer of a file of ranks; its content is handed on, since workers may not have the file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
    return tiktoken.Encoding("public", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


class ChunkTable(dict):
    """Numbers distinct chunks, and keeps of each its token count and the hashes of its words.

    The split pattern always parts a text before a single space that follows a visible character or a
    line end, so such a text has as many tokens as its chunks ``" " + c`` have. Texts with runs of
    spaces, or a space at the end, are tokenized whole.
    """

    def __init__(self, encoding):
        super().__init__()
        self.encode = encoding.encode_ordinary
        self._empty()

    def _empty(self) -> None:
        self.clear()
        # of each chunk its tokens, and where its terms end in the terms of all
        self.n_tokens, self.ends, self.terms = array("q"), array("q", [0]), array("q")

    def __missing__(self, chunk: str) -> int:
        at = self[chunk] = len(self.n_tokens)
        self.n_tokens.append(len(self.encode(" " + chunk)))
        self.terms.extend(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in _WORD.findall(chunk.lower()))
        self.ends.append(len(self.terms))
        return at

    def measure(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token counts of the texts, and their distinct terms as ``(offsets, hashes, frequencies)``."""
        if len(self.n_tokens) > CACHE_LIMIT:
            self._empty()
        ids: list[int] = []
        starts = np.zeros(len(texts) + 1, np.int64)
        whole = np.full(len(texts), -1, np.int64)  # counts of texts that were tokenized whole
        fix = np.zeros(len(texts), np.int64)  # the first chunk has no space before it
        number = self.__getitem__
        for k, text in enumerate(texts):
            if text:
                chunks = text.split(" ")
                ids.extend(map(number, chunks))
                if "" in chunks[1:]:
                    whole[k] = len(self.encode(text))
                else:
                    fix[k] = len(self.encode(chunks[0])) - self.n_tokens[self[chunks[0]]]
            starts[k + 1] = len(ids)
        at = np.fromiter(ids, np.int64, len(ids))
        # copies, since an array that lends its memory can't grow
        tokens, ends, flat = (np.array(a, np.int64) for a in (self.n_tokens, self.ends, self.terms))
        summed = np.diff(np.concatenate([[0], np.cumsum(tokens[at])])[starts])
        counts = np.where(whole >= 0, whole, summed + fix)
        first, size = ends[at], np.diff(ends)[at]
        last = np.cumsum(size)
        take = np.arange(last[-1] if len(last) else 0) - np.repeat(last - size - first, size)
        doc = np.repeat(np.repeat(np.arange(len(texts)), np.diff(starts)), size)
        key, freq = np.unique(doc << 32 | flat[take], return_counts=True) if len(take) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        offsets = np.searchsorted(key, np.arange(len(texts) + 1) << 32)
        return counts, offsets, (key & 0xFFFFFFFF).astype(np.uint32).view(np.int32), freq
