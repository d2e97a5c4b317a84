"""Exact byte-level BPE encoding with bounded memory, shared by token counts and packing.

``Encoder`` gives the ids that the ``tokenizers`` library gives for a ``.json`` file. Where a text
holds only characters below U+0250 and no special string, a second implementation of the same
vocabulary (``tiktoken``, built from the same file) is used, which is some four times faster; the
tests hold both against each other on every such character in many contexts, and the file is
checked to be of the kind for which both agree.

``Encoder.encode`` takes a huge text in overlapping chunks. A place where a character that is not
white space meets white space ends a pre-token whatever stands further left or right, so no token
crosses it: if both chunks have a token boundary at such a place in their overlap, the ids before
it are taken from the left chunk and those after it from the right one. An overlap that has no such
place is widened until there is one or the text ends.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

_WIDE = re.compile("[^\x00-ɏ]")
_EDGE = re.compile(r"\S(?=\s)")
# The split pattern that the ByteLevel pre-tokenizer applies.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """ByteLevel vocabularies write a printable byte as itself, any other as U+0100 and on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of one ``.json`` tokenizer file, without added special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._second(spec)
        #: Bytes that each id stands for; a vocabulary of another kind has no such table.
        self.n_bytes = None
        if (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel":
            vocab = self.lib.get_vocab(with_added_tokens=True)
            self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, i in vocab.items():
                self.n_bytes[i] = len(token.encode()) if token in self.special else len(token)

    def _second(self, spec: dict):
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        same = model["type"] == "BPE" and not spec.get("normalizer") and not model.get("ignore_merges") and not model.get("dropout")
        if not (plain and same):
            return None
        vocab, added = model["vocab"], set(self.special)
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            return None
        import tiktoken

        byte = _byte_of_char()
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}
        return tiktoken.Encoding("second", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bool:
        return (text.isascii() or not _WIDE.search(text)) and not any(s in text for s in self.special)

    def ids(self, text: str) -> np.ndarray:
        """The ids of one chunk."""
        if self.fast is not None and self._plain(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str, chunk: int = 1 << 15, overlap: int = 1 << 8) -> np.ndarray:
        """The ids of a text of any length: those of ``ids(text)``, but with ``chunk`` characters at a time."""
        if len(text) <= chunk + overlap or self.n_bytes is None:
            return self.ids(text)
        out: list[np.ndarray] = []
        start, since, width = 0, 0, overlap  # the chunk's first character; ids count from ``since`` on
        left = self.ids(text[: chunk + overlap])
        end = chunk + overlap
        while end < len(text):
            right_start = max(start, end - width)
            right_end = min(len(text), right_start + chunk + width)
            right = self.ids(text[right_start:right_end])
            at = self._splice(text, start, end, left, right_start, right, max(since, right_start))
            if at is None and right_end - right_start < len(text) - start:
                # No proven common boundary: a wider overlap on both sides.
                width *= 2
                end = min(len(text), end + width)
                left = self.ids(text[start:end])
                continue
            if at is None:
                left, end = self.ids(text[start:]), len(text)
                break
            out.append(self._between(text, start, left, since, at))
            start, end, left, since, width = right_start, right_end, right, at, overlap
        out.append(self._between(text, start, left, since, None))
        return np.concatenate(out)

    def _offsets(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.n_bytes[ids])])

    def _splice(self, text, start, end, left, right_start, right, after):
        """The first place past ``after`` where both chunks have a boundary that nothing outside can move."""
        a, b = self._offsets(left), self._offsets(right)
        for m in _EDGE.finditer(text, after, end):
            p = m.end()
            in_a = len(text[start:p].encode())
            in_b = len(text[right_start:p].encode())
            if _has(a, in_a) and _has(b, in_b):
                return p
        return None

    def _between(self, text, start, ids, since, to):
        at = self._offsets(ids)
        lo = np.searchsorted(at, len(text[start:since].encode()))
        hi = len(ids) if to is None else np.searchsorted(at, len(text[start:to].encode()))
        return ids[lo:hi]


def _has(offsets: np.ndarray, value: int) -> bool:
    i = np.searchsorted(offsets, value)
    return i < len(offsets) and offsets[i] == value


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)
