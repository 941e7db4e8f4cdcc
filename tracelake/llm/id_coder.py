"""Context-mixing range coder for token ids, in independently reset, checksummed blocks.

A segment's distinct ids are its alphabet. The ids are cut into blocks of BLOCK;
no block depends on another, and LANES of them are coded in step as numpy arrays.
Three models share the line of a range coder:

* order 2: what followed the last two ids in the block,
* order 1: what followed the last id in the block,
* order 0: the whole alphabet by its frequencies in the segment.

Orders 1 and 2 learn from every id, and each knows whether its context is new, was
seen, or has been followed by the same id twice in a row. These two states together
select the weights, which are the shares of the segment's ids that each order names
in that state. An id takes one coding step: in the part of the highest order that
names it, else in that of order 0.

An encoder has the whole block, so what followed a context last is a stable sort
away, and only the coder itself walks along the blocks. A decoder keeps the tables.

Layout of a segment (little-endian): magic, number of blocks, number of ids, bytes
of the head; the head (zlib): the alphabet's steps, its frequencies, the weights;
per block the number of ids, the number of 16-bit words, the crc32 of its ids; then
the blocks' words, one after the other.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TLID0002"
BLOCK, LANES = 1024, 3072
#: Blocks whose contexts are looked up at once by the encoder.
ROWS = 256
#: Context table slots of a block, for each order; states of a slot (new, seen, -, repeated), and of two.
SLOTS, SEEN, REPEATED, STATES = 512, 1, 3, 16
_TOTAL = 28
_TOP, _BOTTOM, _LOW32 = np.uint64(1 << 48), np.uint64(1 << 32), np.uint64((1 << 32) - 1)
_U16, _U48, _UTOTAL = np.uint64(16), np.uint64(48), np.uint64(_TOTAL)


def _blocks(n: int) -> np.ndarray:
    full, rest = divmod(n, BLOCK)
    return np.array([BLOCK] * full + [rest] * (rest > 0), np.int64)


def _chunks(lanes: int) -> list[tuple[int, int]]:
    """(first, number) of lanes that go together: parts of about equal size, of LANES at most."""
    parts = -(-lanes // LANES)
    edges = [lanes * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _frequencies(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Counts scaled to a sum of 2 ** bits, each 1 or more."""
    bits = max(16, int(len(counts)).bit_length() + 4)
    out = 1 + counts * ((1 << bits) - len(counts)) // counts.sum()
    out[counts.argmax()] += (1 << bits) - out.sum()
    return out, bits


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids in order, the place of each id among them, their counts."""
    if int(ids.max()) > 1 << 22:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    alphabet = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int32)
    place[alphabet] = np.arange(len(alphabet))
    return alphabet.astype(np.uint32), place[ids], counts[alphabet]


def _slot_of_two(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    return (last * 773 + before * 509) & (SLOTS - 1)


def _followers(ids: np.ndarray, slots: np.ndarray, none: int) -> np.ndarray:
    """For each place of each row: what followed the last use of its slot in the row, times 4, plus the slot's state; ``none`` at the first use."""
    order = np.argsort(slots, axis=1, kind="stable")
    order += np.arange(len(ids))[:, None] * ids.shape[1]
    s, x = slots.ravel()[order], ids.ravel()[order]
    same = s[:, 1:] == s[:, :-1]
    found = np.full_like(ids, none * 4)
    np.copyto(found[:, 1:], x[:, :-1] * 4 + SEEN, where=same)
    found[:, 2:] += (same[:, 1:] & same[:, :-1] & (x[:, 1:-1] == x[:, :-2])) * np.int32(REPEATED - SEEN)
    out = np.empty_like(ids)
    out.ravel()[order] = found
    return out


def _parts(weights: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By state: where order 2's part of the line ends, where order 1's ends, and the unit of order 0's, which has the rest."""
    most = (1 << _TOTAL) - (1 << bits)
    two = (most >> 16) * weights[0].astype(np.int64)
    both = two + ((most - two) >> 16) * weights[1].astype(np.int64)
    return two, both, ((1 << _TOTAL) - both) >> bits


def _shift(low: np.ndarray, span: np.ndarray):
    """Lanes whose leading 16 bits are settled or whose span is too small, again and again; the caller moves a word for each before the next round."""
    end = low + span
    todo = np.flatnonzero(((low ^ end) < _TOP) | (span < _BOTTOM))
    while len(todo):
        a, s = low[todo], span[todo]
        s = np.where((a ^ (a + s)) < _TOP, s, (~a + np.uint64(1)) & _LOW32)
        yield todo, a
        a, s = a << _U16, s << _U16
        low[todo], span[todo] = a, s
        todo = todo[((a ^ (a + s)) < _TOP) | (s < _BOTTOM)]


def _code_lanes(starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The words of each lane, from the intervals of its ids (a row for each place, a column for each lane)."""
    lanes = starts.shape[1]
    width = 2 * BLOCK + 64
    words, row = np.zeros(lanes * width, "<u2"), np.arange(lanes, dtype=np.int64) * width
    at = row.copy()
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    for start, size in zip(starts, sizes, strict=True):
        span >>= _UTOTAL
        low += span * start.astype(np.uint64)
        span *= size.astype(np.uint64)
        for todo, a in _shift(low, span):
            words[at[todo]] = a >> _U48
            at[todo] += 1
    for shift in (48, 32, 16, 0):
        words[at] = (low >> np.uint64(shift)) & np.uint64(0xFFFF)
        at += 1
    return [words[a:b] for a, b in zip(row.tolist(), at.tolist(), strict=True)]


def encode_segment(ids: np.ndarray) -> bytes:
    """Code an array of unsigned 32-bit ids."""
    ids = np.ascontiguousarray(ids, "<u4")
    lengths = _blocks(len(ids))
    if not len(ids):
        return MAGIC + struct.pack("<III", 0, 0, 0)
    alphabet, place, counts = _alphabet(ids)
    sizes, bits = _frequencies(counts.astype(np.int64))
    starts = np.cumsum(sizes) - sizes
    lanes = len(lengths)
    grid = np.full(lanes * BLOCK, place[-1], np.int32)  # the last block is filled up with its last id
    grid[: len(ids)] = place
    grid = grid.reshape(lanes, BLOCK)
    states, orders, seen = np.empty_like(grid, np.uint8), np.empty_like(grid, np.uint8), np.zeros((3, STATES), np.int64)
    for at in range(0, lanes, ROWS):
        x = grid[at : at + ROWS]
        last, before = np.zeros_like(x), np.zeros_like(x)
        last[:, 1:], before[:, 2:] = x[:, :-1], x[:, :-2]
        two = _followers(x, _slot_of_two(last, before).astype(np.uint16), len(alphabet))
        one = _followers(x, (last & (SLOTS - 1)).astype(np.uint16), len(alphabet))
        state, order = (two & 3) * 4 + (one & 3), np.where(two >> 2 == x, 2, one >> 2 == x)
        seen += np.bincount((order * STATES + state).ravel(), minlength=3 * STATES).reshape(3, STATES)
        states[at : at + ROWS], orders[at : at + ROWS] = state, order
    share = lambda hit, n: np.clip(hit * 65536 // np.maximum(n, 1), 16, 65520)
    weights = np.stack([share(seen[2], seen.sum(0)), share(seen[1], seen[0] + seen[1])]).astype("<u2")
    ends2, both, unit = (x.astype(np.uint32) for x in _parts(weights, bits))
    starts32, sizes32 = starts.astype(np.uint32), sizes.astype(np.uint32)
    body: list[np.ndarray] = []
    for at, some in _chunks(lanes):
        first, size = np.empty((2, min(BLOCK, len(ids) - at * BLOCK), some), np.uint32)
        for row in range(0, some, ROWS):
            here = slice(at + row, min(at + row + ROWS, at + some))
            x, s, o = (np.ascontiguousarray(a[here, : len(first)].T) for a in (grid, states, orders))
            u, w2, w = unit[s], ends2[s], both[s]
            f, n = starts32[x] * u + w, sizes32[x] * u
            for order, a, b in ((1, w2, w), (2, np.zeros_like(w2), w2)):
                np.copyto(f, a, where=o == order)
                np.copyto(n, b - a, where=o == order)
            first[:, row : row + ROWS], size[:, row : row + ROWS] = f, n
        body += _code_lanes(first, size)
    head = zlib.compress(np.diff(alphabet, prepend=np.uint32(0)).astype("<u4").tobytes() + sizes.astype("<u4").tobytes() + weights.tobytes())
    table = np.empty((lanes, 3), "<u4")
    ends = np.cumsum(lengths)
    data = memoryview(ids).cast("B")
    table[:, 0], table[:, 1] = lengths, [len(w) for w in body]
    table[:, 2] = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
    return b"".join([MAGIC, struct.pack("<III", lanes, len(ids), len(head)), head, table.tobytes(), *(w.tobytes() for w in body)])


def _decode_lanes(words: np.ndarray, at: np.ndarray, steps: int, weights: np.ndarray, starts: np.ndarray, sizes: np.ndarray, symbol: np.ndarray, bits: int) -> np.ndarray:
    """Places in the alphabet, a column for each lane."""
    lanes = len(at)
    low, span, code = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64), np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = (code << _U16) | words[at]
        at = at + 1
    ends2, ends1, units = _parts(weights, bits)
    two, one = np.full((2, lanes * SLOTS), len(sizes) * 4, np.int64)
    lane = np.arange(lanes, dtype=np.int64) * SLOTS
    last = before = np.zeros(lanes, np.int64)
    out = np.empty((steps, lanes), np.int32)
    for t in range(steps):
        at2, at1 = _slot_of_two(last, before) + lane, (last & (SLOTS - 1)) + lane
        e2, e1 = two[at2], one[at1]
        p2, p1 = e2 >> 2, e1 >> 2
        state = (e2 & 3) * 4 + (e1 & 3)
        w2, both, unit = ends2[state], ends1[state], units[state]
        span >>= _UTOTAL
        value = ((code - low) // span).view(np.int64)
        named = np.flatnonzero(value < both)
        v = value[named]
        value -= both
        value //= unit
        x = symbol.take(value, mode="clip")
        start = starts[x] * unit
        start += both
        size = sizes[x] * unit
        w = w2[named]
        by2 = v < w
        x[named] = np.where(by2, p2[named], p1[named])
        start[named] = np.where(by2, 0, w)
        size[named] = np.where(by2, w, both[named] - w)
        low += span * start.view(np.uint64)
        span *= size.view(np.uint64)
        for todo, _ in _shift(low, span):
            code[todo] = (code[todo] << _U16) | words[at[todo]]
            at[todo] += 1
        out[t] = x
        new = x * 4 + SEEN
        two[at2] = np.where(p2 == x, e2 | REPEATED, new)
        one[at1] = np.where(p1 == x, e1 | REPEATED, new)
        before, last = last, x
    return out


def decode_segment(data: bytes) -> np.ndarray:
    """The ids of a segment; raises ValueError where a block does not fit its checksum."""
    if data[:8] != MAGIC:
        raise ValueError("not a segment of coded ids")
    lanes, total, n_head = struct.unpack_from("<III", data, 8)
    if not lanes:
        return np.empty(0, "<u4")
    try:
        head = np.frombuffer(zlib.decompress(data[20 : 20 + n_head]), "<u4")
    except zlib.error as e:
        raise ValueError("the head of a segment can't be read") from e
    n = (len(head) - STATES) // 2
    alphabet, sizes, weights = np.cumsum(head[:n], dtype=np.uint32), head[n : 2 * n].astype(np.int64), head[2 * n :].view("<u2").reshape(2, STATES)
    starts, symbol = np.cumsum(sizes) - sizes, np.repeat(np.arange(n), sizes)
    table = np.frombuffer(data, "<u4", 3 * lanes, 20 + n_head).reshape(lanes, 3).astype(np.int64)
    words = np.frombuffer(data, "<u2", int(table[:, 1].sum()), 20 + n_head + 12 * lanes)
    # A damaged block may read beyond its words; its checksum tells.
    words = np.concatenate([words, np.zeros(2 * BLOCK + 64, "<u2")]).astype(np.uint64)
    at = np.cumsum(table[:, 1]) - table[:, 1]
    bits = max(16, n.bit_length() + 4)
    out = []
    for i, some in _chunks(lanes):
        steps = min(BLOCK, total - i * BLOCK)
        out.append(np.ascontiguousarray(_decode_lanes(words, at[i : i + some], steps, weights, starts, sizes, symbol, bits).T).ravel())
    ids = np.ascontiguousarray(alphabet[np.concatenate(out)[:total]], "<u4")
    view = memoryview(ids).cast("B")
    for i, (a, b) in enumerate(zip((np.cumsum(table[:, 0]) - table[:, 0]).tolist(), np.cumsum(table[:, 0]).tolist(), strict=True)):
        if zlib.crc32(view[4 * a : 4 * b]) != table[i, 2]:
            raise ValueError(f"block {i} does not fit its checksum")
    return ids
