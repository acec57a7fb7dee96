"""Online logistic context mixing over the bits of texts, many texts at a time.

A text is its lower-cased words with one blank between and one line end. Bytes become symbols of five bits (rare bytes two or
three symbols). Three bit predictors, for the last two symbols, the last four and the word so far, each give a logit: a hashed
table of the corpus plus what this text has taught the same context so far. A set of weights, gated by the bit's place and by
how well the longer contexts are known, mixes them; an adaptive map over the bit's node and the mixed logit refines the sum.
After every bit the predictors, the weights and the map of the text learn. A symbol's bits have nodes of their own, so that
learning from its five bits at once is the same as learning bit by bit.

Lanes hold texts one after another and move by one symbol a step; a new text begins with the starting state, so that what
shares its lane does not count.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np

ORDERS = 3
BITS = 5
SYMBOLS = 1 << BITS
GATES = 9
CELLS = 16  #: of the map, for each node
SLOTS = 1 << 11  #: what a text remembers, for each predictor
LANES = 512
STRETCH = 1 << 17  #: a text of more symbols goes on in a further stretch, with a fresh state
STEPS = 64
HALO = 4
SCALE = 16  #: steps of a stored logit

_CODE = np.arange(SYMBOLS)
NODE = np.stack([1 << d | _CODE >> (BITS - d) for d in range(BITS)])
BIT = np.stack([_CODE >> (BITS - 1 - d) & 1 for d in range(BITS)]).astype(np.float32)
#: apart for any two nodes, so that the bits of one symbol never share a slot
SPREAD = NODE * 661 % SLOTS


class Alphabet:
    """The symbols of every byte, by how often a byte occurs: 29 bytes have one, 64 have two, the rest three."""

    def __init__(self, counts: np.ndarray):
        self.code, self.size = np.zeros((256, 3), np.uint8), np.ones(256, np.int64)
        for r, b in enumerate(np.lexsort((np.arange(256), -counts))):
            rest = r - 29
            if rest < 0:
                self.code[b, 0] = r
            elif rest < 64:
                self.code[b, :2], self.size[b] = (29 + rest // 32, rest % 32), 2
            else:
                self.code[b], self.size[b] = (31, (rest - 64) // 32, (rest - 64) % 32), 3
        self.blank = int(self.code[32, 0]) if self.size[32] == 1 else SYMBOLS

    def symbols(self, text: bytes) -> np.ndarray:
        a = np.frombuffer(text, np.uint8)
        n, out = self.size[a], self.code[a, 0]
        if int(n.sum()) == len(a):
            return out
        at = np.cumsum(n) - n
        found = np.zeros(int(n.sum()), np.uint8)
        found[at] = out
        for more in (1, 2):
            there = n > more
            found[at[there] + more] = self.code[a[there], more]
        return found


def plain(text: str) -> bytes:
    """The bytes of which a text's probability is that of its words and its end."""
    return b" ".join(text.encode().lower().split()) + b"\n"


def scattered(v: np.ndarray) -> np.ndarray:
    v = v ^ (v >> np.uint32(15))
    v *= np.uint32(0x85EBCA6B)
    v ^= v >> np.uint32(13)
    v *= np.uint32(0xC2B2AE35)
    return v ^ (v >> np.uint32(16))


def prefixes(x: np.ndarray, age: np.ndarray, blank: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for the word so far at each step of each lane, and the last of them; word: the one before."""
    before = x[HALO - 1 : HALO - 1 + len(age)].astype(np.uint32)
    going = ((before != blank + 1) & (age > 0)).astype(np.uint32)
    out = np.empty(age.shape, np.uint32)
    for t in range(len(age)):
        word = word * np.uint32(0x01000193)
        word += before[t]
        word *= going[t]
        out[t] = word
    return out, word


def context_hashes(x: np.ndarray, age: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """The contexts of each step of each lane; x: symbols + 1 with HALO steps before; symbols before a text's start are 0."""
    t = len(age)
    back = [np.where(age >= k, x[HALO - k : HALO - k + t], 0).astype(np.uint32) for k in range(1, HALO + 1)]
    two = back[0] + back[1] * np.uint32(33)
    four = two + back[2] * np.uint32(33**2) + back[3] * np.uint32(33**3)
    return [scattered(c * np.uint32(0x9E3779B1) + np.uint32(n + 1)) for n, c in enumerate((two, four, word))]


def rows_of(hashed: np.ndarray, bits: int) -> np.ndarray:
    return (hashed >> np.uint32(32 - bits)).astype(np.int64)


class Lanes:
    """Texts, as symbols, dealt to lanes of about equal length; the longest lane comes first."""

    def __init__(self, texts: Sequence[np.ndarray], lanes: int = LANES):
        pieces = [(i, a, min(a + STRETCH, len(t))) for i, t in enumerate(texts) for a in range(0, len(t), STRETCH)]
        pieces.sort(key=lambda p: p[1] - p[2])
        load = [(0, k) for k in range(min(lanes, len(pieces)))]
        dealt: list[list] = [[] for _ in load]
        for p in pieces:
            n, k = load[0]
            dealt[k].append(p)
            heapq.heapreplace(load, (n + p[2] - p[1], k))
        dealt.sort(key=lambda q: -sum(b - a for _, a, b in q))
        self.sizes = np.array([sum(b - a for _, a, b in q) for q in dealt], np.int64)
        steps = int(self.sizes[0]) if len(dealt) else 0
        x, age = np.zeros((len(dealt), steps + HALO), np.uint8), np.full((len(dealt), steps), HALO, np.uint8)
        self.starts: dict[int, list[tuple[int, int]]] = {}
        for k, q in enumerate(dealt):
            at = 0
            for i, a, b in q:
                x[k, HALO + at : HALO + at + b - a] = texts[i][a:b] + np.uint8(1)
                age[k, at : at + min(HALO, b - a)] = np.arange(min(HALO, b - a))
                self.starts.setdefault(at, []).append((k, i))
                at += b - a
        self.x, self.age = np.ascontiguousarray(x.T), np.ascontiguousarray(age.T)

    def blocks(self) -> Iterator[tuple[int, int, int]]:
        """(first step, last step, lanes that still hold symbols) of every run of steps."""
        for t in range(0, len(self.age), STEPS):
            yield t, min(len(self.age), t + STEPS), int((self.sizes > t).sum())


def context_counts(texts: Sequence[bytes], alphabet: Alphabet, bits: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(predictor, cell, count): how often a symbol followed a context; a cell is a table row << 5 | the symbol."""
    lanes = Lanes([alphabet.symbols(t) for t in texts])
    cells: list[list[np.ndarray]] = [[] for _ in range(ORDERS)]
    word = np.zeros(lanes.x.shape[1], np.uint32)
    for t, u, n in lanes.blocks():
        x, age = lanes.x[t : u + HALO, :n], lanes.age[t:u, :n]
        so_far, word = prefixes(x, age, alphabet.blank, word[:n])
        now = x[HALO:]
        for k, h in enumerate(context_hashes(x, age, so_far)):
            cell = (h >> np.uint32(32 - bits[k])) << np.uint32(BITS) | (now - np.uint8(1))
            cells[k].append(cell[now > 0])
    for k, found in enumerate(cells):
        flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
        flat.sort()
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
        yield k, flat[first], np.diff(np.r_[first, len(flat)])


def table_logits(counts: np.ndarray) -> np.ndarray:
    """Rows of symbol counts as rows of node logits, times SCALE; node 0 holds how well the row is known."""
    out = np.zeros(counts.shape, np.int8)
    level = counts.astype(np.float32)
    out[:, 0] = np.digitize(level.sum(1), [1, 16])
    for d in range(BITS - 1, -1, -1):
        zero, one = level[:, 0::2], level[:, 1::2]
        out[:, 1 << d : 2 << d] = np.clip(np.rint(np.log((one + 0.4) / (zero + 0.4)) * SCALE), -127, 127)
        level = zero + one
    return out


class Mixer:
    """Tables of the corpus, and the state with which every text begins."""

    def __init__(self, tables: list[np.ndarray], alphabet: Alphabet, rate: float = 0.008, memory_rate: float = 0.2, map_rate: float = 0.02):
        self.tables, self.alphabet = [t.reshape(-1) for t in tables], alphabet
        self.bits = [(len(t) >> BITS).bit_length() - 1 for t in self.tables]
        self.rate, self.memory_rate, self.map_rate = np.float32(rate), np.float32(memory_rate), np.float32(map_rate)
        self.weights = np.full((GATES, ORDERS * BITS), 0.3, np.float32)
        self.map = np.zeros(SYMBOLS * CELLS, np.float32)

    def bits_of(self, texts: Sequence[bytes], lanes: int = LANES, learned: list | None = None, least: int = 500) -> np.ndarray:
        """Total bits of each text. `learned` gets the weights and maps with which texts of `least` symbols on end."""
        dealt = Lanes([self.alphabet.symbols(t) for t in texts], lanes)
        n_lanes = len(dealt.sizes)
        out = np.zeros(len(texts))
        memory = np.zeros((n_lanes, ORDERS * SLOTS), np.float32)
        weights, maps = np.tile(self.weights, (n_lanes, 1)), np.tile(self.map, (n_lanes, 1))
        memory_flat, map_flat = memory.reshape(-1), maps.reshape(-1)
        lane, word = np.arange(n_lanes), np.zeros(n_lanes, np.uint32)
        of, since = np.zeros(n_lanes, np.int64), np.zeros(n_lanes, np.int64)
        half, middle, zero, last, one = map(np.float32, (0.75, CELLS / 2, 0, CELLS - 1, 1))

        def ended(k: int, step: int) -> None:
            if learned is not None and step - since[k] >= least:
                learned.append((weights[k * GATES : (k + 1) * GATES].copy(), maps[k].copy()))

        for t, u, n in dealt.blocks():
            x, age = dealt.x[t : u + HALO, :n], dealt.age[t:u, :n]
            so_far, word = prefixes(x, age, self.alphabet.blank, word[:n])
            real = x[HALO:] > 0
            now = np.where(real, x[HALO:] - np.uint8(1), 0).astype(np.int64)
            node, bit, spread = np.empty((u - t, BITS, n), np.int64), np.empty((u - t, BITS, n), np.float32), np.empty((u - t, BITS, n), np.int64)
            for d in range(BITS):
                node[:, d], bit[:, d], spread[:, d] = NODE[d].take(now), BIT[d].take(now), SPREAD[d].take(now)
            logit, slot = np.empty((u - t, ORDERS * BITS, n), np.float32), np.empty((u - t, ORDERS * BITS, n), np.int64)
            gate = np.broadcast_to(lane[:n] * GATES, now.shape).copy()
            for k, h in enumerate(context_hashes(x, age, so_far)):
                row = rows_of(h, self.bits[k]) << BITS
                part = slice(k * BITS, (k + 1) * BITS)
                logit[:, part] = self.tables[k].take(row[:, None] + node)
                if k:
                    gate += self.tables[k].take(row) * np.int64(3 ** (k - 1))
                np.bitwise_xor((h & np.uint32(SLOTS - 1)).astype(np.int64)[:, None], spread, out=slot[:, part])
                slot[:, part] += lane[:n] * (ORDERS * SLOTS) + k * SLOTS
            logit *= np.float32(1 / SCALE)
            node *= CELLS
            node += lane[:n] * (SYMBOLS * CELLS)
            wrong = np.empty((u - t, BITS, n), np.float32)
            of_step = np.broadcast_to(of[:n], now.shape).copy()
            for step in range(t, u):
                i = step - t
                for k, text in dealt.starts.get(step, ()):
                    ended(k, step)
                    memory[k], weights[k * GATES : (k + 1) * GATES], maps[k] = 0, self.weights, self.map
                    of[k], since[k] = text, step
                    of_step[i:, k] = text
                at, own = slot[i], gate[i]
                seen = memory_flat.take(at)
                inputs = logit[i]
                inputs += seen
                w = weights.take(own, 0).T
                mixed = (inputs * w).reshape(ORDERS, BITS, n).sum(0)
                place = mixed * half
                place += middle
                np.maximum(place, zero, out=place)
                np.minimum(place, last, out=place)
                cell = place.astype(np.int64)
                cell += node[i]
                refined = map_flat.take(cell)
                mixed += refined
                np.exp(np.negative(mixed, out=mixed), out=mixed)
                mixed += one
                error = np.subtract(bit[i], np.reciprocal(mixed, out=mixed), out=wrong[i])
                refined += error * self.map_rate
                map_flat[cell] = refined
                parts = seen.reshape(ORDERS, BITS, n)
                parts += error * self.memory_rate
                memory_flat[at] = seen
                parts = inputs.reshape(ORDERS, BITS, n)
                parts *= error * self.rate
                weights[own] = (w + inputs).T
            cost = -np.log2(np.maximum(np.float32(1e-7), 1 - np.abs(wrong))).sum(1)
            out += np.bincount(of_step[real], cost[real], len(texts))
        for k in range(n_lanes):
            ended(k, int(dealt.sizes[k]))
        return out
