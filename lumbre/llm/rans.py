"""Static range asymmetric numeral system (rANS) over NumPy lanes.

Symbol i of a block belongs to lane i mod LANES; all lanes share one stream of 32-bit words, which the decoder reads in
lane order within each row of LANES symbols. States lie in [2^31, 2^63). A checkpoint holds the lanes' states and the
place in the stream before a row, from which decoding can start.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LANES = 4096
LOW = np.uint64(1 << 31)
W32 = np.uint64(32)


@dataclass
class Table:
    """Frequencies that sum to 2^bits; `slots` names the symbol of each slot."""

    bits: int
    freq: np.ndarray
    start: np.ndarray
    slots: np.ndarray


def scaled(counts: np.ndarray, bits: int) -> np.ndarray:
    """Counts scaled to sum to 2^bits with at least 1 for each symbol that occurs."""
    counts = np.asarray(counts, np.int64)
    total, room = int(counts.sum()), 1 << bits
    out = np.zeros(len(counts), np.int64)
    seen = np.flatnonzero(counts)
    if not len(seen):
        out[0] = room
        return out
    if len(seen) > room:
        raise ValueError("more symbols than slots")
    # Every seen symbol gets one slot, the rest go in proportion; what rounding leaves goes to the largest.
    share = counts[seen].astype(np.float64) / total * (room - len(seen))
    out[seen] = 1 + np.floor(share).astype(np.int64)
    left = room - int(out.sum())
    order = seen[np.lexsort((seen, -(share - np.floor(share))))]
    out[order[:left]] += 1
    return out


def table(freq: np.ndarray, bits: int) -> Table:
    freq = np.asarray(freq, np.uint64)
    ends = np.cumsum(freq, dtype=np.uint64)
    return Table(bits, freq, ends - freq, np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64)))


def encode(symbols: np.ndarray, t: Table, every_rows: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """(words, checkpoints), each checkpoint (row, word, states). The first is that of row 0."""
    n = len(symbols)
    rows = -(-n // LANES)
    state = np.full(LANES, LOW, np.uint64)
    bits, freq, start = np.uint64(t.bits), t.freq, t.start
    limit_shift = np.uint64(63 - t.bits)
    parts: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []
    written = 0
    for r in range(rows - 1, -1, -1):
        s = symbols[r * LANES : (r + 1) * LANES]
        x = state[: len(s)]
        f = freq[s]
        over = x >= (f << limit_shift)
        if over.any():
            out = x[over]
            parts.append(out.astype(np.uint32))
            written += len(out)
            x = np.where(over, x >> W32, x)
        q = x // f
        state[: len(s)] = (q << bits) + (x - q * f) + start[s]
        if r % every_rows == 0:
            marks.append((r, written, state.copy()))
    words = np.concatenate(parts[::-1]) if parts else np.empty(0, np.uint32)
    if not marks:
        marks.append((0, 0, state.copy()))
    return words, [(r, written - w, st) for r, w, st in reversed(marks)]


def decode(words: np.ndarray, t: Table, n: int, states: np.ndarray, row: int = 0, word: int = 0, until: int | None = None) -> np.ndarray:
    """Symbols from a checkpoint's row on, up to symbol `until` (default n) of the n of the block."""
    stop = n if until is None else min(until, n)
    out = np.empty(max(0, stop - row * LANES), np.uint32)
    state = states.copy()
    bits, mask, freq, start, slots = np.uint64(t.bits), np.uint64((1 << t.bits) - 1), t.freq, t.start, t.slots
    at = word
    for a in range(row * LANES, stop, LANES):
        m = min(LANES, n - a)
        x = state[:m]
        slot = x & mask
        s = slots[slot]
        x = freq[s] * (x >> bits) + slot - start[s]
        low = x < LOW
        k = int(np.count_nonzero(low))
        if k:
            x[low] = (x[low] << W32) | words[at : at + k]
            at += k
        state[:m] = x
        out[a - row * LANES : a - row * LANES + m] = s[: len(out) - (a - row * LANES)]
    return out
