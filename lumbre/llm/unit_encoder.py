"""Encodes whole texts with the tokenizers library, once per distinct unit rather than per text.

The byte-level tokenizer splits a text before it merges, and never across a single space that precedes a non-space: such
a space always starts a new piece. Cut there, a text is a list of units whose encodings joined are the text's encoding.
A batch of texts is cut and its distinct units found in Arrow; a bounded memory answers most of them, and the library
encodes the others. Texts in which a space meets other white space are cut by a pattern instead, and texts that hold a
special token's string, or a separator that Python and the tokenizer's pattern class differently, go to the library whole.
"""

from __future__ import annotations

import functools
import re
from array import array
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from lumbre.llm import _shared as S

#: Units that a Python worker keeps; once they are reached, further units are learnt for one batch only.
CACHE_UNITS = 600_000
CACHE_PIECES = 300_000
_ID = attrgetter("id")
_CUT = re.compile(r" (?=\S)")
#: Our marks, and the separators that are white space to Python but not to the tokenizer's pattern.
_ODD = "\0\1\x1c\x1d\x1e\x1f"
#: Texts that a plain split at each space would not cut rightly (RE2).
_NOT_PLAIN_TEXT = r" (?:[\t\n\v\f\r \x{85}\p{Z}]|$)|[\x00\x01\x1c-\x1f]"
#: Plain units: no space within, none of the marks, nothing beyond Latin letters.
_NOT_PLAIN_UNIT = re.compile("[ \0\1]|[^\0-ɏ]").search
#: The pattern by which the byte-level tokenizer cuts a text.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
#: The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_ALPHABET = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class UnitEncoder:
    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cache_units = cache_units
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.vocab_size = self.library.get_vocab_size(with_added_tokens=True)
        #: Ids of pieces as 32-bit words, a quarter of what tuples of numbers take.
        self.pieces: dict[str, bytes] = {}
        #: A unit is named without its leading space; "\1" leads a text's first unit, which has none, "\0" a whole text.
        self.index: dict[str, int] = {}
        self.flat = np.empty(1 << 20, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 16, np.int32)
        self.size = np.zeros(1 << 16, np.int32)

    def units(self, text: str) -> list[str]:
        if any(c in text for c in _ODD) or any(x in text for x in self.specials):
            return ["\0" + text]
        cut = _CUT.split(text)
        cut[0] = "\1" + cut[0]
        return cut

    def _encode_plain(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Side by side, each unit starts with the one space that it has; the tokenizer's own pattern cuts them, and its BPE model encodes each distinct piece."""
        cut = _PATTERN(" " + " ".join(units))
        known, fresh, bpe = self.pieces, {}, self.library.model.tokenize
        for p in dict.fromkeys(cut):
            if p not in known:
                if p.isascii() and p[1:].isalpha() and p[0] == " ":
                    name = "Ġ" + p[1:]
                else:
                    name = p.encode().decode("latin-1").translate(_BYTE_ALPHABET)
                fresh[p] = array("I", map(_ID, bpe(name))).tobytes()
        if len(known) + len(fresh) <= CACHE_PIECES:
            known.update(fresh)
            ids = list(map(known.__getitem__, cut))
        else:
            ids = [fresh[p] if p in fresh else known[p] for p in cut]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first = np.flatnonzero(np.fromiter((p[0] == " " for p in cut), bool, len(cut)))
        return np.frombuffer(b"".join(ids), np.uint32), np.add.reduceat(sizes, first)

    def _learn(self, missing: list[str], keep: bool) -> np.ndarray:
        """The numbers of units that the memory lacks. Those not to be kept have numbers beyond it until the next call."""
        easy = [u.isascii() and " " not in u and u[:1] > "\1" or not (not u or _NOT_PLAIN_UNIT(u)) for u in missing]
        plain = [u for u, e in zip(missing, easy) if e]
        rest = [u for u, e in zip(missing, easy) if not e]
        flats, sizes = [], []
        for i in range(0, len(plain), 50_000):
            f, s = self._encode_plain(plain[i : i + 50_000])
            flats.append(f)
            sizes.append(s)
        if rest:
            encoded = [e.ids for e in self.library.encode_batch_fast([u[1:] if u[:1] in ("\0", "\1") else " " + u for u in rest], add_special_tokens=False)]
            flats.append(np.array(list(chain.from_iterable(encoded)), np.uint32))
            sizes.append(np.fromiter(map(len, encoded), np.int64, len(encoded)))
        flat, size = np.concatenate(flats), np.concatenate(sizes)
        n, total, used = len(self.index), len(flat), self.used
        assert len(size) == len(missing)
        while n + len(missing) > len(self.start):
            self.start, self.size = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.size, np.zeros_like(self.size)])
        while used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[used : used + total] = flat
        self.size[n : n + len(missing)] = size
        self.start[n : n + len(missing)] = used + np.cumsum(size) - size
        if keep:
            self.used += total
            self.index.update(zip(chain(plain, rest), range(n, n + len(missing))))
        flags, out = np.array(easy, bool), np.empty(len(missing), np.int64)
        out[flags] = n + np.arange(len(plain))
        out[~flags] = n + len(plain) + np.arange(len(rest))
        return out

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(names of all units, units per text)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, _NOT_PLAIN_TEXT)
        for x in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, x))
        odd = np.asarray(odd.to_numpy(zero_copy_only=False), bool)
        # An odd text's cell is emptied for the split and its units are put in its place.
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts, " ")
        counts = np.diff(lists.offsets.to_numpy())
        names = lists.flatten()
        heads = np.cumsum(counts) - counts
        first = pc.binary_join_element_wise("\1", names.take(pa.array(heads)), "")
        mask = np.zeros(len(names), bool)
        mask[heads] = True
        names = pc.replace_with_mask(names, pa.array(mask), first)
        if odd.any():
            parts, done = [], 0
            for i in np.flatnonzero(odd).tolist():
                own = self.units(texts[i].as_py())
                parts += [names.slice(done, int(heads[i]) - done), pa.array(own, pa.string())]
                done = int(heads[i]) + 1
                counts[i] = len(own)
            names = pa.concat_arrays([*parts, names.slice(done)])
        return names, counts

    def _numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each unit's ids start in self.flat, how many they are, units per text)."""
        names, counts = self._cut(texts)
        coded = names.dictionary_encode()
        distinct = S.strings(coded.dictionary)
        numbers = np.fromiter(map(self.index.get, distinct, repeat(-1)), np.int64, len(distinct))
        gaps = np.flatnonzero(numbers < 0)
        if len(gaps):
            numbers[gaps] = self._learn([distinct[i] for i in gaps.tolist()], len(self.index) + len(gaps) <= self.cache_units)
        at = coded.indices.to_numpy()
        return self.start[numbers][at], self.size[numbers][at], counts

    def lengths(self, texts: pa.Array) -> np.ndarray:
        _, sizes, counts = self._numbers(texts)
        cum = np.append(0, np.cumsum(sizes))
        ends = np.cumsum(counts)
        return cum[ends] - cum[ends - counts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, length of each text's). Null counts as empty."""
        starts, sizes, counts = self._numbers(texts)
        cum = np.append(0, np.cumsum(sizes))
        ends = np.cumsum(counts)
        kind = np.int32 if cum[-1] + len(self.flat) < 1 << 31 else np.int64
        starts = (starts - cum[:-1]).astype(kind)
        at = np.repeat(starts, sizes)
        at += np.arange(cum[-1], dtype=kind)
        del starts, sizes
        return self.flat[at], cum[ends] - cum[ends - counts]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> UnitEncoder:
    """One per Python worker and tokenizer; workers are reused from task to task."""
    return UnitEncoder(path)
