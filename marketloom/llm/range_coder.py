"""An adaptive context-mixing range coder for token ids, many blocks in step (numpy).

Every block starts from the same state and is coded by itself; the blocks of a
batch are the lanes of numpy arrays, so one step codes one id of each block.

Model of a block: the id that last followed the previous two ids (order 2) and
the one that last followed the previous id (order 1), each with a confidence;
how often candidates of that confidence were right, as adaptive probabilities;
and their mixture with the overall hit rate (order 0 of the hits) in the logistic
domain, with weights that learn from every id. The mixed probability codes
whether the candidate is right. If not, the id is coded by the order-0
frequencies of the block so far, which start from a rank-like prior and are
renewed every `RENEW` ids. All arithmetic is in integers, so a reader on another
machine, or with another number of lanes, gets the same numbers.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
TOP, BOT = U(1 << 48), U(1 << 40)
SLOTS, MOST, RENEW, GAIN, BITS = 4096, 7, 2048, 96, 12
ONE = 1 << BITS


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """squash: stretched value + 2047 -> probability in 1..4095; stretch: its inverse. From a rational curve, in integers only."""
    x = np.arange(-2047, 2048, dtype=np.int64)
    y = np.abs(x)
    # 1 / (1 + 2^(-y/177)) by linear pieces between powers of two.
    whole, part = y // 177, y % 177
    power = (177 * 2 - part) * (1 << 20) // 354 >> whole  # 2^(-y/177) in 20 bits
    up = ((1 << 32) // ((1 << 20) + power)) * ONE >> 12
    p = np.where(x >= 0, up, ONE - up)
    squash = np.clip(np.maximum.accumulate(p), 1, ONE - 1)
    stretch = np.searchsorted(squash, np.arange(ONE), side="left") - 2047
    return squash, np.clip(stretch, -2047, 2047)


class Model:
    """The state of all lanes."""

    def __init__(self, lanes: int, vocab: int) -> None:
        self.n, self.vocab = lanes, vocab
        self.squash, self.stretch = _tables()
        self.lane = np.arange(lanes)
        self.slot = self.lane * SLOTS
        self.pred = [np.full(lanes * SLOTS, -1, dtype=np.int32) for _ in range(2)]
        self.conf = [np.zeros(lanes * SLOTS, dtype=np.int8) for _ in range(2)]
        self.right = [np.full(lanes * (MOST + 1), ONE // 2, dtype=np.int64) for _ in range(2)]
        self.rate = np.full(lanes, ONE // 4, dtype=np.int64)
        self.weight = [np.full(lanes, w, dtype=np.int64) for w in (26_000, 20_000, 20_000)]
        self.prev1, self.prev2 = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
        prior = 1 + (1 << 16) // (np.arange(vocab, dtype=np.int64) + 64)
        self.base = np.concatenate([[0], np.cumsum(prior)]).astype(np.uint32)
        self.cum = np.empty((lanes, vocab + 1), dtype=np.uint32)
        self.cum[:] = self.base
        self.flat = self.cum.reshape(-1)
        self.row = self.lane * (vocab + 1)
        self.seen = np.zeros((lanes, vocab), dtype=np.uint16)
        self.total = np.full(lanes, self.base[-1], dtype=np.uint64)
        # A search starts at every far-th id, and halves from there.
        self.far = -(-vocab // 64)
        self.depth, self.end = (self.far - 1).bit_length(), self.row + (vocab - 1)
        self.coarse = np.ascontiguousarray(self.cum[:, :-1:self.far])

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """(candidate, probability of it in 1..4095); the candidate is -1 where there is none."""
        h1 = self.prev1 * 2654435761
        self.at = [self.slot + ((h1 + self.prev2 * 40503 >> 7) & (SLOTS - 1)), self.slot + (h1 >> 9 & (SLOTS - 1))]
        self.got = [self.pred[k].take(self.at[k]) for k in (0, 1)]
        self.sure = [self.conf[k].take(self.at[k]) for k in (0, 1)]
        high = self.sure[0] > 0
        self.guess = np.where(high, self.got[0], self.got[1])
        self.cell = [self.lane * (MOST + 1) + self.sure[k] for k in (0, 1)]
        self.chance = [self.right[k].take(self.cell[k]) for k in (0, 1)]
        s2 = self.stretch.take(self.chance[0]) * high
        s1 = self.stretch.take(self.chance[1])
        s1 = np.where(self.got[1] == self.guess, s1, -np.abs(s1) >> 1)
        s0 = self.stretch.take(self.rate)
        self.inputs = [s2, s1, s0]
        mixed = (self.weight[0] * s2 + self.weight[1] * s1 + self.weight[2] * s0) >> 16
        self.p = self.squash.take(np.minimum(np.maximum(mixed, -2047), 2047) + 2047)
        return self.guess, self.p

    def update(self, x: np.ndarray) -> None:
        hit = x == self.guess
        err = np.where(hit, ONE, 0) - self.p
        for w, s in zip(self.weight, self.inputs, strict=True):
            w += s * err >> 10
        self.rate += (np.where(hit, ONE - 16, 16) - self.rate) >> 5
        for k in (0, 1):
            ok = self.got[k] == x
            self.right[k][self.cell[k]] = self.chance[k] + ((np.where(ok, ONE - 16, 16) - self.chance[k]) >> 4)
            c = self.sure[k]
            c = np.where(ok, np.minimum(c + 1, MOST), c >> 1).astype(np.int8)
            new = ~ok & (c == 0)
            self.pred[k][self.at[k]] = np.where(new, x, self.got[k])
            self.conf[k][self.at[k]] = np.where(new, 1, c)
        self.prev2, self.prev1 = self.prev1, x

    def renew(self, ids: np.ndarray, lanes: np.ndarray) -> None:
        """Count the last ids (of the given lanes) into the order-0 frequencies."""
        np.add.at(self.seen.reshape(-1), lanes * self.vocab + ids, 1)
        for i in range(0, self.n, 32):
            part = np.cumsum(self.seen[i:i + 32], axis=1, dtype=np.uint32)
            part *= GAIN
            part += self.base[1:]
            self.cum[i:i + 32, 1:] = part
        self.total = self.cum[:, -1].astype(np.uint64)
        self.coarse = np.ascontiguousarray(self.cum[:, :-1:self.far])

    def interval(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.row + x
        low = self.flat.take(at)
        return low.astype(np.uint64), (self.flat.take(at + 1) - low).astype(np.uint64)

    def find(self, v: np.ndarray) -> np.ndarray:
        """The ids whose interval holds v."""
        v = v.astype(np.uint32)
        at = self.row + ((self.coarse <= v[:, None]).sum(axis=1) - 1) * self.far
        for k in range(self.depth - 1, -1, -1):
            to = np.minimum(at + (1 << k), self.end)
            at = np.where(self.flat.take(to) <= v, to, at)
        return at - self.row


def _narrow(m: Model, low, rng, x, hit, p):
    """The interval after coding x."""
    bound = (rng >> U(BITS)) * p.astype(np.uint64)
    q = (rng - bound) // m.total
    start, size = m.interval(x)
    return np.where(hit, low, low + bound + q * start), np.where(hit, bound, q * size)


def encode(blocks: list[np.ndarray], vocab: int) -> list[bytes]:
    """One byte string for each block of ids below `vocab`."""
    n, lens = len(blocks), np.array([len(b) for b in blocks])
    if not n:
        return []
    most = int(lens.max())
    ids = np.zeros((n, most), dtype=np.int64)
    for i, b in enumerate(blocks):
        ids[i, :len(b)] = b
    m = Model(n, vocab)
    low, rng = np.zeros(n, dtype=np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    out, pos = np.zeros((n, 3 * most + 8), dtype=np.uint16), np.zeros(n, dtype=np.int64)
    ragged = bool((lens < most).any())
    for t in range(most):
        x = ids[:, t]
        guess, p = m.predict()
        nlow, nrng = _narrow(m, low, rng, x, x == guess, p)
        if ragged:  # lanes that have ended keep their interval
            live = lens > t
            nlow, nrng = np.where(live, nlow, low), np.where(live, nrng, rng)
        low, rng = nlow, nrng
        while True:
            settled = (low ^ (low + rng)) < TOP
            todo = np.flatnonzero(settled | (rng < BOT))
            if not len(todo):
                break
            a, r = low[todo], rng[todo]
            r = np.where(settled[todo], r, (U(0) - a) & (BOT - U(1)))
            out[todo, pos[todo]] = a >> U(48)
            pos[todo] += 1
            low[todo], rng[todo] = a << U(16), r << U(16)
        m.update(x)
        if (t + 1) % RENEW == 0 and t + 1 < most:
            part = ids[:, t + 1 - RENEW:t + 1]
            lanes = np.repeat(m.lane, RENEW)
            ok = (np.arange(t + 1 - RENEW, t + 1)[None, :] < lens[:, None]).ravel()
            m.renew(part.ravel()[ok], lanes[ok])
    for k in range(4):  # the rest of low names a point of the interval
        out[m.lane, pos + k] = low >> U(48)
        low <<= U(16)
    return [out[i, :pos[i] + 4].astype("<u2").tobytes() for i in range(n)]


def decode(data: list[bytes], lens: list[int], vocab: int) -> list[np.ndarray]:
    """The blocks of ids that `encode` was given, from their bytes and lengths."""
    n = len(data)
    if not n:
        return []
    size = np.array(lens)
    most = int(size.max())
    words = np.zeros((n, max(len(d) // 2 for d in data) + 8), dtype=np.uint64)
    for i, d in enumerate(data):
        words[i, :len(d) // 2] = np.frombuffer(d, dtype="<u2")
    m = Model(n, vocab)
    low, rng = np.zeros(n, dtype=np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    code, pos = np.zeros(n, dtype=np.uint64), np.full(n, 4)
    for k in range(4):
        code = (code << U(16)) | words[:, k]
    ids = np.zeros((n, most), dtype=np.int64)
    ragged, last = bool((size < most).any()), words.shape[1] - 1
    for t in range(most):
        guess, p = m.predict()
        bound = (rng >> U(BITS)) * p.astype(np.uint64)
        off = code - low
        hit = off < bound
        q = (rng - bound) // m.total
        v = np.where(hit, U(0), np.minimum((off - bound) // q, m.total - U(1)))
        x = np.where(hit, guess, m.find(v)).astype(np.int64)
        if ragged:
            live = size > t
            x = np.where(live, x, 0)
        start, width = m.interval(x)
        nlow, nrng = np.where(hit, low, low + bound + q * start), np.where(hit, bound, q * width)
        if ragged:
            nlow, nrng = np.where(live, nlow, low), np.where(live, nrng, rng)
        low, rng = nlow, nrng
        while True:
            settled = (low ^ (low + rng)) < TOP
            todo = np.flatnonzero(settled | (rng < BOT))
            if not len(todo):
                break
            a, r = low[todo], rng[todo]
            r = np.where(settled[todo], r, (U(0) - a) & (BOT - U(1)))
            code[todo] = (code[todo] << U(16)) | words[todo, np.minimum(pos[todo], last)]
            pos[todo] += 1
            low[todo], rng[todo] = a << U(16), r << U(16)
        ids[:, t] = x
        m.update(x)
        if (t + 1) % RENEW == 0 and t + 1 < most:
            part = ids[:, t + 1 - RENEW:t + 1]
            lanes = np.repeat(m.lane, RENEW)
            ok = (np.arange(t + 1 - RENEW, t + 1)[None, :] < size[:, None]).ravel()
            m.renew(part.ravel()[ok], lanes[ok])
    return [ids[i, :size[i]] for i in range(n)]
