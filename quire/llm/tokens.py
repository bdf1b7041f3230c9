"""Byte-level BPE ids of whole texts, with the BPE of the ``tokenizers`` library run
once per distinct pre-token that a worker meets.

The pre-tokens of such a vocabulary are runs of letters, of digits or of other signs,
each with the one space before it. Where a word has nothing but ASCII and the
letters U+00C0 to U+00FF and no apostrophe, those runs are found for a whole block of
documents with numpy, and the library's BPE model gives the ids of each distinct run;
any other word goes as one chunk through the library's whole encoder. Documents with
special-token strings or other white space than single spaces and line feeds between
words go through it whole.

Runs are recognised by a 64-bit hash of their bytes and kind.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd

from quire.llm.textvec import blocks, mix, running_hash

#: Distinct runs that a worker remembers before it starts afresh (about 40 bytes each).
REMEMBER = 1_000_000
#: Bytes of text, about, that one call encodes with some 100 bytes of arrays each.
ENCODE_BYTES = 1 << 18
_ODD_SPACE = re.compile(r"\s\s|[^\S \n]|^\s|\s\Z")
#: Bytes that may stand in white space other than a space or a line feed.
_MAYBE_SPACE = np.zeros(256, dtype=bool)
_MAYBE_SPACE[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[0x20, 0x0A]] = _SPACE
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
#: What stands before a run: nothing, one space, a line feed of its own.
_BARE, _SPACED, _FED, _WHOLE_WORD = 0, 1, 2, 4


def default_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE uses for bytes: printable Latin-1 signs stand
    for themselves, all others for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    out.update((b, chr(256 + i)) for i, b in enumerate(b for b in range(256) if b not in out))
    return out


class Encoder:
    """Encodes texts to unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._specials = sorted(t.content for t in self._tokenizer.get_added_tokens_decoder().values())
        self._letters = _byte_letters()
        self._feed = self.plain(["\n"])[0]
        self._forget()

    def _forget(self) -> None:
        self._key = np.zeros(0, dtype=np.uint64)
        self._at = np.zeros(0, dtype=np.int64)
        self._n = np.zeros(0, dtype=np.int64)
        self._pool = np.zeros(0, dtype=np.uint32)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """The library's own ids of whole texts."""
        return [np.array(e.ids, dtype=np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, n + 1 offsets); a null is an empty text."""
        parts, sizes = [], []
        for first, encoded in blocks(texts, ENCODE_BYTES):
            odd = self._odd(encoded)
            ids, count = self._block([b"" if i in odd else b for i, b in enumerate(encoded)] if odd else encoded)
            if odd:
                order = sorted(odd)
                whole = dict(zip(order, self.plain([texts[first + i] for i in order]), strict=True))
                ends, at, pieces = np.cumsum(count), 0, []
                for i in order:  # such a text has no ids so far
                    pieces += [ids[at : ends[i]], whole[i]]
                    at = ends[i]
                    count[i] = len(whole[i])
                ids = np.concatenate([*pieces, ids[at:]])
            parts.append(ids)
            sizes.append(count)
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        if sizes:
            np.cumsum(np.concatenate(sizes), out=offsets[1:])
        return (np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)), offsets

    def _odd(self, encoded: list[bytes]) -> set[int]:
        """Documents that must go through the library whole."""
        data = np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)
        last = np.cumsum([len(b) + 1 for b in encoded]) - 1  # the line feed after each
        gap = _CLASS[data] == _SPACE
        twice = np.flatnonzero(gap[1:] & gap[:-1])
        is_last = np.zeros(len(data), dtype=bool)
        is_last[last] = True
        twice = twice[~(is_last[twice] & is_last[twice + 1])]
        out = set(np.searchsorted(last, twice + is_last[twice]).tolist())
        if gap[0] and not is_last[0]:
            out.add(0)
        for i in np.unique(np.searchsorted(last, np.flatnonzero(_MAYBE_SPACE[data]))).tolist():
            if i not in out and _ODD_SPACE.search(encoded[i].decode("utf-8", "surrogatepass")):
                out.add(i)
        for mark in (m.encode() for m in self._specials):
            out.update(i for i, b in enumerate(encoded) if mark in b)
        return out

    def _block(self, encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b"\n".join(encoded) + b"\n"
        data = np.frombuffer(raw, dtype=np.uint8)
        kind = _CLASS[data]
        high = data >= 0x80
        strange = data == 0x27
        if high.any():
            lead = np.flatnonzero(data == 0xC3)
            sign = (data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)
            value = np.where(sign, _OTHER, _LETTER).astype(np.uint8)
            kind[lead] = value
            kind[lead + 1] = value
            high[lead] = high[lead + 1] = False
            strange |= high
        gap = kind == _SPACE
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate(([0], edge))
        word_start, word_end = edge[0::2], edge[1::2]
        doc_start = np.zeros(len(encoded) + 1, dtype=np.int64)
        np.cumsum([len(b) + 1 for b in encoded], out=doc_start[1:])
        if not len(word_start):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(encoded), dtype=np.int64)
        begins = np.zeros(len(data), dtype=bool)
        begins[1:] = (kind[1:] != kind[:-1]) & ~gap[1:]
        begins[word_start] = True
        if strange.any():  # such words are not cut
            odd = np.unique(np.searchsorted(word_start, np.flatnonzero(strange), side="right") - 1)
            depth = np.zeros(len(data) + 1, dtype=np.int32)
            depth[word_start[odd]] += 1
            depth[word_end[odd]] -= 1
            begins[np.cumsum(depth[:-1]) > 0] = False
            begins[word_start[odd]] = True
        start = np.flatnonzero(begins)
        of = np.searchsorted(word_start, start, side="right") - 1
        end = word_end[of].copy()
        inner = of[1:] == of[:-1]
        end[:-1][inner] = start[1:][inner]
        before = data[np.maximum(start - 1, 0)]
        flag = np.where(before == 0x20, _SPACED, np.where(before == 0x0A, _FED, _BARE))
        flag[start != word_start[of]] = _BARE
        flag[np.isin(start, doc_start)] = _BARE
        if strange.any():
            flag = flag + _WHOLE_WORD * np.isin(of, odd)
        key = mix(running_hash(data, start, end) + (flag.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
        back, uniq = pd.factorize(key)
        where = np.zeros(len(uniq), dtype=np.int64)
        where[back[::-1]] = np.arange(len(back) - 1, -1, -1)
        if len(self._key) > REMEMBER:
            self._forget()
        slot = np.searchsorted(self._key, uniq)
        known = np.zeros(len(uniq), dtype=bool)
        inside = slot < len(self._key)
        known[inside] = self._key[slot[inside]] == uniq[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            new = new[np.argsort(uniq[new])]
            at_run = where[new]
            ids = self._learn(raw, start[at_run].tolist(), end[at_run].tolist(), flag[at_run].tolist())
            n = np.array([len(x) for x in ids], dtype=np.int64)
            at = len(self._pool) + np.cumsum(n) - n
            self._pool = np.concatenate([self._pool, np.array([x for one in ids for x in one], dtype=np.uint32)])
            self._key = np.insert(self._key, slot[new], uniq[new])
            self._at = np.insert(self._at, slot[new], at)
            self._n = np.insert(self._n, slot[new], n)
            slot = np.searchsorted(self._key, uniq)
        n, at = self._n[slot][back], self._at[slot][back]
        total = np.zeros(len(n) + 1, dtype=np.int64)
        np.cumsum(n, out=total[1:])
        ids = self._pool[np.repeat(at - total[:-1], n) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(start, doc_start)])

    def _learn(self, raw: bytes, start: list[int], end: list[int], flag: list[int]) -> list[list[int]]:
        letters, model, feed = self._letters, self._tokenizer.model.tokenize, self._feed.tolist()
        whole = {i: self.plain([(" " if f & _SPACED else "") + raw[a:b].decode("utf-8", "surrogatepass")])[0].tolist() for i, (a, b, f) in enumerate(zip(start, end, flag, strict=True)) if f & _WHOLE_WORD}
        out = []
        for i, (a, b, f) in enumerate(zip(start, end, flag, strict=True)):
            if i in whole:
                ids = whole[i]
            else:
                run = (b" " + raw[a:b]) if f & _SPACED else raw[a:b]
                ids = [t.id for t in model(run.decode("latin-1").translate(letters))]
            out.append(feed + ids if f & _FED else ids)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file in a Python process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
