"""BPE encoding by prefix-sharing trie traversal, and decoding.

Every prefix of a word has a BPE encoding of its own, and all that is needed of it is its last token: the encoding of a
prefix is that of the prefix before its last token, plus that token. The last token of a prefix is the one vocabulary
entry ending there whose left neighbour, the last token of the prefix before it, would not have merged across the
border. So the distinct words of a batch form a trie; walking it depth first, each node's state (its last token) comes
from the states on the path above it, and a prefix that many words share is computed once. The words are visited in
sorted order, which is the depth-first order of their trie; the stack of states is the path from the root.

A word's last symbol carries the end-of-word mark, so the word's end is an edge of its own.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.llm import _shared as S

#: Chunks kept per Python worker (some 300 bytes each); beyond that they are learnt for one batch only.
CACHE_CHUNKS = 300_000
#: The pattern by which the tokenizer cuts lower-cased text; what it doesn't match (white space) goes.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+").findall
#: Up to U+024F, but for two kinds of white space, lower-casing and the classes of characters are the same here and in the
#: library, and nothing composes. All other text is normalised and cut by the library itself, whose tables are its own.
_OTHER_TABLES = regex.compile(r"[\x85\xA0\u0250-\U0010FFFF]").search
_OTHER_TABLES_RE2 = r"[\x{85}\x{A0}\x{250}-\x{10FFFF}]"
#: The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class TrieBpe:
    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalise, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.specials.items()})
        self.rank: dict[tuple[int, int], int] = {}
        #: Of a token that a merge makes: the merge's rank and the two parts.
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank.setdefault((x, y), r)
            self.made.setdefault(z, (r, x, y))
        self.longest = max(map(len, self.vocab))
        self.borders: dict[tuple[int, int], bool] = {}
        self.cache_chunks = cache_chunks
        #: The number of a chunk, under which stand its ids joined by a space, its tokens likewise, and how many they are.
        self.chunks: dict[str, int] = {}
        self.ids_text: list[str] = []
        self.names_text: list[str] = []
        self.sizes: list[int] = []
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def holds(self, left: int, right: int) -> bool:
        """Whether BPE keeps the border between two neighbouring tokens.

        The merges that made the two are taken back, latest first (of equal ranks the right one came later). While a
        pair of tokens stood at the border, their own merge would have come first if its rank is lower than that of
        the merge which ended the pair; at equal ranks the leftmost goes first.
        """
        found = self.borders.get((left, right))
        if found is not None:
            return found
        rank, made = self.rank, self.made
        x, y, until, strict = left, right, len(self.rank), True
        while True:
            r = rank.get((x, y))
            if r is not None and (r < until or r == until and not strict):
                ok = False
                break
            a, b = made.get(x), made.get(y)
            if a is None and b is None:
                ok = True
                break
            if b is None or a is not None and a[0] > b[0]:
                until, strict, x = a[0], True, a[2]
            else:
                until, strict, y = b[0], False, b[1]
        if len(self.borders) > 2_000_000:
            self.borders.clear()
        self.borders[left, right] = ok
        return ok

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of each distinct word (in the byte-level alphabet), over their trie."""
        vocab, holds, longest, end = self.vocab, self.holds, self.longest, self.end
        out: dict[str, list[int]] = {}
        # States on the path: the last token of each prefix and the length of the prefix before it.
        last, before = [-1], [0]
        path = ""
        for word in sorted(words):
            n = len(word)
            if not n:
                out[word] = []
                continue
            top = min(n - 1, len(last) - 1)
            d = 0
            while d < top and path[d] == word[d]:
                d += 1
            del last[d + 1 :], before[d + 1 :]
            for i in range(d + 1, n):
                for j in range(max(0, i - longest), i):
                    t = vocab.get(word[j:i])
                    if t is not None and (not j or holds(last[j], t)):
                        last.append(t)
                        before.append(j)
                        break
            path = word[: n - 1]
            marked = word + end
            for j in range(max(0, n - longest), n):
                t = vocab.get(marked[j:])
                if t is not None and (not j or holds(last[j], t)):
                    break
            ids = [t]
            while j:
                ids.append(last[j])
                j = before[j]
            ids.reverse()
            out[word] = ids
        return out

    def lowered(self, texts: list[str]) -> pa.Array:
        """Normalised texts without special tokens; their white space is that of ASCII."""
        plain = pa.array(texts, pa.string())
        other = pc.match_substring_regex(plain, _OTHER_TABLES_RE2).to_pylist()
        return pa.array([self.normalise(t) if o else t.lower() for t, o in zip(texts, other)], pa.string())

    def pieces(self, chunk: str) -> list[str]:
        """The words of a chunk of lowered text, in the byte-level alphabet."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk]
            if chunk[:-1].isalpha() and chunk[-1] in ".,;:?!":
                return [chunk[:-1], chunk[-1]]
        elif _OTHER_TABLES(chunk):
            return [p for p, _ in self.cut(chunk)]
        return [p if p.isascii() and p.isalnum() else p.encode().decode("latin-1").translate(_ALPHABET) for p in _PIECES(chunk)]

    def _learn(self, missing: list[str]) -> None:
        """Appends what is known of chunks to the lists."""
        cut = [self.pieces(c) for c in missing]
        ids = self.encode_words(list({w for ws in cut for w in ws}))
        names = self.names
        text = {w: (" ".join(map(str, own)), " ".join([names[i] for i in own]), len(own)) for w, own in ids.items()}
        for words in cut:
            if len(words) == 1:
                a, b, n = text[words[0]]
            else:
                got = [text[w] for w in words]
                a, b, n = " ".join([g[0] for g in got]), " ".join([g[1] for g in got]), sum([g[2] for g in got])
            self.ids_text.append(a)
            self.names_text.append(b)
            self.sizes.append(n)

    def _segments(self, texts: list[str | None]) -> tuple[list[str], list[int], list[tuple[int, int, str]]]:
        """(segments between special tokens, the text of each, special tokens as (text, segments before it in all, token))."""
        out, owner, special = [], [], []
        for k, text in enumerate(texts):
            parts = self._split.split(text) if text and self._split is not None and "<|" in text else [text or ""]
            for i, part in enumerate(parts):
                if i % 2:
                    special.append((k, len(out), part))
                else:
                    out.append(part)
                    owner.append(k)
        return out, owner, special

    def batch(self, texts: list[str | None], with_ids: bool = False) -> tuple[pa.Array, pa.Array, np.ndarray, pa.Array | None]:
        """(ids joined by a space, decoded text, number of ids, ids if asked for) of each text."""
        segments, owner, special = self._segments(texts)
        lists = pc.ascii_split_whitespace(self.lowered(segments))
        coded = lists.flatten().dictionary_encode()
        distinct = S.strings(coded.dictionary)
        known, kept = self.chunks, len(self.sizes)
        numbers = [known.get(c, -1) for c in distinct]
        missing = [c for c, k in zip(distinct, numbers) if k < 0]
        if missing:
            self._learn(missing)
            fresh = iter(range(kept, len(self.sizes)))
            numbers = [k if k >= 0 else next(fresh) for k in numbers]
            if len(self.sizes) <= self.cache_chunks:
                known.update(zip(missing, range(kept, len(self.sizes))))
                kept = len(self.sizes)
        ids_text, names_text, sizes = ([values[k] for k in numbers] for values in (self.ids_text, self.names_text, self.sizes))
        for values in (self.ids_text, self.names_text, self.sizes):
            del values[kept:]
        at, ends = coded.indices.to_numpy(), lists.offsets.to_numpy()
        owner = np.repeat(np.array(owner, np.int64), np.diff(ends))
        if special:
            # A special token stands as a chunk of its own between its neighbours' chunks.
            place = ends[[n for _, n, _ in special]]
            at = np.insert(at, place, np.arange(len(sizes), len(sizes) + len(special)))
            owner = np.insert(owner, place, [k for k, _, _ in special])
            for _, _, t in special:
                ids_text.append(str(self.specials[t]))
                names_text.append(t)
                sizes.append(1)
        n = np.array(sizes, np.int64)
        if not n.all():
            at, owner = at[n[at] > 0], owner[n[at] > 0]
        offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
        cum = np.append(0, np.cumsum(n[at]))
        taken = lambda values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.take(pa.array(at)))
        joined, decoded = (pc.binary_join(taken(pa.array(values, pa.string())), " ") for values in (ids_text, names_text))
        ids = None
        if with_ids:
            own = pa.array([[int(i) for i in t.split()] for t in ids_text], pa.list_(pa.int32()))
            ids = pa.ListArray.from_arrays(pa.array(cum[offsets], pa.int32()), own.take(pa.array(at)).flatten())
        return joined, decoded, np.diff(cum[offsets]), ids


def _sha256(strings: pa.Array) -> pa.Array:
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].tolist()
    data = memoryview(strings.buffers()[2] or b"")
    return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string())


@functools.lru_cache(maxsize=2)
def coder(path: str) -> TrieBpe:
    """One per Python worker and tokenizer."""
    return TrieBpe(path)


def _run(path: str, full: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for b in S.batches_of(batches, 4 << 20):
            joined, decoded, n, ids = bpe.batch(b.column(1).to_pylist(), full)
            columns = [b.column(0), pa.array(n), _sha256(joined), _sha256(decoded)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                columns += [ids, decoded]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            del joined, decoded, ids, columns
            pa.default_memory_pool().release_unused()

    return run


def encode_decode(docs: DataFrame, tokenizer: str | None = None, full: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; with full also ids and decoded.

    Works row by row, without a shuffle. A null text counts as empty and has no tokens; null ids are carried; repeated
    rows are each returned; an empty table gives no rows; extra columns are ignored. Strings of special tokens in a
    text become those tokens, as in the library.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")
    return rows.mapInArrow(_run(tokenizer or default_path(), full), schema)
