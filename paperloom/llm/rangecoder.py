"""An adaptive context-mixing range coder for token ids, many blocks in step.

A segment of ids is cut into blocks of one length. Every block starts from the same state and is
coded by itself; the blocks advance together, one id each, as the lanes of numpy arrays.

Three models predict the next id. Order 2 and order 1 remember, in a hashed table of the block,
the id that last followed the same two ids or one id, and how often it proved right since; their
weights adapt to their success at each level of confidence. Order 0 is the segment's table of id
frequencies. An id is the order-2 guess, the order-1 guess or, for the rest of 4096, a place in
the order-0 table: two steps of a 64-bit range coder of the asymmetric kind (rANS), the second
one open to the rest only. Its state is a stack: the shares are found front to back and coded
back to front, so that decoding goes front to back, by shifts and products alone.

Bytes of a block, all little endian: number of ids (u32), CRC-32 of the ids as u32 (u32), code
words (u32 each), of which the first two are the state. A segment's order-0 table: ids (u16) and
frequencies minus one (u16).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 2048
LEAST_BLOCK = 512
_TABLE_BITS = 10
_MASK = (1 << _TABLE_BITS) - 1
_ID = (1 << 17) - 1
_NONE = 4 << 17 | _ID
_LEAST, _MOST = 31, 3944  # of a weight, so that every guess and the rest have a share; 31 >> 5 is 0: no weight stays none
_CHUNK = 64
_U = np.uint64
_WORD = _U(32)
_LOW = _U(0xFFFFFFFF)
_HEADER = "<II"


def order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and frequencies that add up to 65536."""
    if len(ids) and (ids.max() >= 1 << 16 or ids.min() < 0):
        raise ValueError("ids are from 0 to 65535")
    counts = np.bincount(ids, minlength=1)
    seen = np.flatnonzero(counts)
    if not len(seen):
        seen, counts = np.zeros(1, np.int64), np.ones(1, np.int64)
    n = counts[seen]
    freq = 1 + n * (65536 - len(seen)) // n.sum()
    freq[np.argmax(n)] += 65536 - freq.sum()
    return seen, freq


class _Model:
    """The state of all lanes, the same in both directions: order 2's entries, then order 1's.

    An entry of a table is an id with its confidence, 0 to 3, above bit 17; ``_NONE``, which is no
    id, has confidence 4. A lane has eight weights for each order, by confidence, and those from 4
    stay 0. Arrays are made once and written in place; what is true of a lane is -1 in an array of
    int32, else 0.
    """

    def __init__(self, lanes: int):
        self.lanes, n = lanes, 2 * lanes
        self.base = np.arange(n, dtype=np.int64) << _TABLE_BITS
        self.row = np.arange(n, dtype=np.int64) << 3
        self.table = np.full(n << _TABLE_BITS, _NONE, np.int32)
        # By confidence: order 2's share of 4096, and order 1's of what order 2 leaves.
        self.weight = np.concatenate([np.tile(np.array([*w, 0, 0, 0, 0], np.int32), lanes) for w in ((300, 1500, 2500, 3000), (150, 800, 1500, 2500))])
        self.at, self.slot = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.entry, self.guess, self.sure, self.own, self.both, self.same = np.zeros((6, n), np.int32)
        self.most, (self.one, self.differ) = np.full(n, 3, np.int32), np.zeros((2, lanes), np.int32)
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The shares of order 2 and order 1 of 4096; 0 where there is no guess."""
        n, at, one = self.lanes, self.at, self.one
        np.multiply(self.last, 0x9E3779B1, out=at[n:])
        np.multiply(self.before, 0x85EBCA6B, out=at[:n])
        at[:n] ^= at[n:]
        at >>= 14
        at &= _MASK
        at += self.base
        self.table.take(at, mode="clip", out=self.entry)
        np.bitwise_and(self.entry, _ID, out=self.guess)
        np.right_shift(self.entry, 17, out=self.sure)
        np.add(self.row, self.sure, out=self.slot)
        self.weight.take(self.slot, mode="clip", out=self.own)
        np.subtract(4096, self.own[:n], out=one)
        one *= self.own[n:]
        one >>= 12
        np.bitwise_xor(self.guess[:n], self.guess[n:], out=self.differ)
        one &= -self.differ >> 31
        return self.own[:n], one

    def match(self, ids: np.ndarray) -> np.ndarray:
        """Whether order 2's guess is the lane's id, then order 1's."""
        self.both[: self.lanes] = self.both[self.lanes :] = ids
        np.bitwise_xor(self.both, self.guess, out=self.same)
        self.same -= 1
        self.same >>= 31
        return self.same

    def learn(self, hits: np.ndarray) -> None:
        """After ``match``. ``hits``, which is overwritten: whether order 2 coded the lane's id, and whether order 1 did."""
        sure = self.sure
        sure += 1
        np.minimum(sure, self.most, out=sure)
        sure &= self.same
        sure <<= 17
        sure |= self.both
        self.table[self.at] = sure
        hits &= _MOST - _LEAST
        hits += _LEAST
        hits -= self.own
        hits >>= 5
        hits += self.own
        self.weight[self.slot] = hits
        self.before, self.last = self.last, self.before
        self.last[:] = self.both[: self.lanes]


def _turned(table: np.ndarray) -> np.ndarray:
    """Rows as columns, by tiles that stay in the cache."""
    turned = np.empty(table.shape[::-1], table.dtype)
    for a in range(0, table.shape[0], 64):
        for b in range(0, table.shape[1], 256):
            turned[b : b + 256, a : a + 64] = table[a : a + 64, b : b + 256].T
    return turned


def _shares(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each id's share of 4096; that of the rest ends at 4096, others do not."""
    steps, lanes = rows.shape
    model, hits = _Model(lanes), np.zeros(2 * lanes, np.int32)
    starts, sizes = np.empty(rows.shape, np.uint16), np.empty(rows.shape, np.uint16)
    rest, other = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    for x, start, size in zip(rows, starts, sizes, strict=True):
        w2, w1 = model.predict()
        hits[:] = model.match(x)
        two, one = hits[:lanes], hits[lanes:]
        np.invert(two, out=other)
        one &= other
        np.subtract(4096, w2, out=rest)
        rest -= w1
        # (0, w2), (w2, w1) or what both leave.
        other &= w2 + (w1 & ~one)
        start[:] = other
        rest &= ~(two | one)
        rest |= w2 & two
        rest |= w1 & one
        size[:] = rest
        model.learn(hits)
    return starts, sizes


def encode(ids: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], list[bytes]]:
    """A segment's order-0 table and its blocks."""
    seen, freq = order0(ids)
    if not len(ids):
        return (seen, freq), []
    lanes = max(1, min(LANES, len(ids) // LEAST_BLOCK))
    steps = -(-len(ids) // lanes)
    lanes = -(-len(ids) // steps)
    padded = np.full(lanes * steps, seen[0], np.int32)
    padded[: len(ids)] = ids
    checks = [zlib.crc32(padded[a : min(a + steps, len(ids))].astype("<u4").tobytes()) for a in range(0, lanes * steps, steps)]
    rows = _turned(padded.reshape(lanes, steps))
    del padded
    starts, sizes = _shares(rows)
    of_id = np.zeros((2, 1 << 16), _U)
    of_id[0, seen], of_id[1, seen] = np.cumsum(freq) - freq, freq
    state, kept, whole = np.full(lanes, 1 << 32, _U), np.zeros(lanes, _U), np.zeros(lanes, _U)
    words = np.zeros((steps // 2 + 64, lanes), np.uint32)
    used = np.zeros(lanes, np.int64)
    for first in range((steps - 1) // _CHUNK * _CHUNK, -1, -_CHUNK):
        start, size = starts[first : first + _CHUNK].astype(_U), sizes[first : first + _CHUNK].astype(_U)
        rest, x = start + size == _U(4096), rows[first : first + _CHUNK]
        place = of_id[0].take(x, mode="clip") * rest
        wide = np.where(rest, of_id[1].take(x, mode="clip"), _U(1 << 16))
        most = size * wide
        if used.max() + _CHUNK + 3 >= len(words):
            words = np.concatenate([words, np.zeros_like(words), np.zeros((_CHUNK, lanes), np.uint32)])
        for k in range(len(start) - 1, -1, -1):
            np.right_shift(state, _U(36), out=whole)
            at = (whole >= most[k]).nonzero()[0]
            if len(at):
                full = state.take(at, mode="clip")
                words[used.take(at, mode="clip"), at] = full
                used[at] += 1
                full >>= _WORD
                state[at] = full
            for begin, n, bits in ((place[k], wide[k], _U(16)), (start[k], size[k], _U(12))):
                np.floor_divide(state, n, out=whole)
                np.multiply(whole, n, out=kept)
                state -= kept
                state += begin
                whole <<= bits
                state += whole
    lane = np.arange(lanes)
    words[used, lane], words[used + 1, lane] = state & _LOW, state >> _WORD
    used += 2
    words, blocks = _turned(words[: used.max()]), []
    for k in range(lanes):
        blocks.append(struct.pack(_HEADER, min(steps, len(ids) - k * steps), checks[k]) + words[k, : used[k]][::-1].astype("<u4").tobytes())
    return (seen, freq), blocks


def decode(table: tuple[np.ndarray, np.ndarray], blocks: list[bytes]) -> np.ndarray:
    """The ids of a segment; a block whose checksum differs raises."""
    if not blocks:
        return np.zeros(0, np.int32)
    seen, freq = table
    id_at, of_id = np.repeat(seen, freq).astype(np.int32), np.zeros((2, 1 << 16), np.int64)
    of_id[0, seen], of_id[1, seen] = np.cumsum(freq) - freq, freq
    heads = [struct.unpack_from(_HEADER, b) for b in blocks]
    lanes, steps = len(blocks), max(n for n, _ in heads)
    counts = np.array([len(b) // 4 - 2 for b in blocks])
    words = np.frombuffer(b"".join(b[8:] for b in blocks) + b"\0" * 16, "<u4")
    next_at = np.cumsum(counts) - counts
    model, hits = _Model(lanes), np.zeros(2 * lanes, np.int32)
    state = words[next_at].astype(_U) << _WORD | words[next_at + 1]
    next_at += 2
    out = np.empty((steps, lanes), np.int32)
    two, one, part, size = hits[:lanes], hits[lanes:], np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    for x in out:
        w2, w1 = model.predict()
        np.copyto(part, state, casting="unsafe")
        part &= 4095
        taken = w2 + w1
        np.subtract(part, w2, out=two)
        np.subtract(part, taken, out=one)
        hits >>= 31
        known = one.copy()
        one ^= two
        np.subtract(4096, taken, out=size)
        size &= ~known
        size |= w2 & two
        size |= w1 & one
        # Less the share's start: what stands before it.
        part -= w2 & ~two
        part -= w1 & ~known
        state >>= _U(12)
        state *= size.astype(_U)
        state += part.astype(_U)
        np.bitwise_and(model.differ, two, out=x)
        x ^= model.guess[lanes:]
        rest = (known == 0).nonzero()[0]
        own = state.take(rest, mode="clip")
        place = (own & _U(0xFFFF)).view(np.int64)
        found = id_at.take(place, mode="clip")
        x[rest] = found
        own >>= _U(16)
        own *= of_id[1].take(found, mode="clip").view(_U)
        place -= of_id[0].take(found, mode="clip")
        own += place.view(_U)
        state[rest] = own
        at = (state <= _LOW).nonzero()[0]
        if len(at):
            place = next_at.take(at, mode="clip")
            state[at] = state.take(at, mode="clip") << _WORD | words.take(place, mode="clip")
            next_at[at] = place + 1
        model.match(x)
        model.learn(hits)
    parts = [part[:n] for part, (n, _) in zip(_turned(out), heads, strict=True)]
    for k, (part, (_, crc)) in enumerate(zip(parts, heads, strict=True)):
        if zlib.crc32(part.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {k}: the checksum differs")
    return np.concatenate(parts)
