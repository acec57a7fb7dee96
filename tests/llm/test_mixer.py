"""The mixer of many texts at a time against one that takes a text bit by bit."""

import math
import random

import numpy as np

from cratebind.llm import mixer as M


def a_mixer(rng, texts, bits=(11, 12, 12)):
    alphabet = M.Alphabet(np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256))
    tables = []
    for k, cell, n in M.context_counts(texts, alphabet, bits):
        counts = np.zeros(M.SYMBOLS << bits[k], np.int64)
        counts[cell] = n
        tables.append(M.table_logits(counts.reshape(-1, M.SYMBOLS)))
    out = M.Mixer(tables, alphabet)
    out.weights = rng.normal(0.3, 0.1, out.weights.shape).astype(np.float32)
    out.map = rng.normal(0, 0.1, out.map.shape).astype(np.float32)
    return out


def scatter(v):
    v = v & 0xFFFFFFFF
    v ^= v >> 15
    v = v * 0x85EBCA6B & 0xFFFFFFFF
    v ^= v >> 13
    v = v * 0xC2B2AE35 & 0xFFFFFFFF
    return v ^ v >> 16


def scalar_bits(m, text):
    """One text, bit by bit, with dictionaries for what it has learned."""
    codes = [int(c) + 1 for c in m.alphabet.symbols(text)]
    memory, weights, maps, total = {}, m.weights.astype(float).copy(), m.map.astype(float).copy(), 0.0
    for t, c in enumerate(codes):
        before = [codes[t - k] if t >= k else 0 for k in range(1, 5)]
        start = t
        while start > 0 and codes[start - 1] != m.alphabet.blank + 1:
            start -= 1
        word = 0
        for x in codes[start:t]:
            word = (word * 0x01000193 + x) & 0xFFFFFFFF
        two = before[0] + before[1] * 33
        hashes = [scatter(v * 0x9E3779B1 + k + 1) for k, v in enumerate((two, two + before[2] * 33**2 + before[3] * 33**3, word))]
        rows = [h >> (32 - b) for h, b in zip(hashes, m.bits)]
        gate = sum(int(m.tables[k][rows[k] * 32]) * 3 ** (k - 1) for k in (1, 2))
        node = 1
        for d in range(5):
            bit = (c - 1) >> (4 - d) & 1
            slots = [(k, h % M.SLOTS ^ node * 661 % M.SLOTS) for k, h in enumerate(hashes)]
            inputs = [m.tables[k][rows[k] * 32 + node] / M.SCALE + memory.get(slots[k], 0.0) for k in range(3)]
            at = [k * 5 + d for k in range(3)]
            mixed = sum(x * weights[gate, a] for x, a in zip(inputs, at))
            cell = node * M.CELLS + int(min(M.CELLS - 1, max(0, mixed * 0.75 + M.CELLS / 2)))
            p = 1 / (1 + math.exp(-(mixed + maps[cell])))
            total -= math.log2(p if bit else 1 - p)
            error = bit - p
            maps[cell] += error * m.map_rate
            for k in range(3):
                memory[slots[k]] = memory.get(slots[k], 0.0) + error * m.memory_rate
                weights[gate, at[k]] += error * m.rate * inputs[k]
            node = node * 2 | bit
    return total


def some_texts(rng, n):
    bag = ["alpha", "beta", "gamma", "delta", "épsilon", "日本", "x9", "{}"]
    return [M.plain(" ".join(rng.choice(bag) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


def test_many_texts_as_bit_by_bit():
    rng = random.Random(1)
    texts = [b"\n", *some_texts(rng, 25)]
    m = a_mixer(np.random.default_rng(2), texts)
    want = np.array([scalar_bits(m, t) for t in texts])
    for lanes in (1, 4, 256):  # what shares a lane or a batch does not count
        assert np.allclose(m.bits_of(texts, lanes), want, rtol=1e-3)
    assert np.allclose(m.bits_of(texts[::-1], 3)[::-1], want, rtol=1e-3)


def test_a_text_learns_while_it_goes_on():
    rng = random.Random(3)
    m = a_mixer(np.random.default_rng(2), some_texts(rng, 30))
    once, twice = b"qwzy kvxq jjkz ", b"qwzy kvxq jjkz " * 12
    a, b = m.bits_of([once + b"\n", twice + b"\n"])
    assert b < 7 * a
    learned: list = []
    m.bits_of([twice * 10 + b"\n", once + b"\n"], learned=learned)
    assert len(learned) == 1 and not np.allclose(learned[0][0], m.weights)


def test_next_symbols_add_up_to_one():
    rng = random.Random(4)
    m = a_mixer(np.random.default_rng(5), some_texts(rng, 30))
    head = b"alpha ga"
    start = m.bits_of([head])[0]
    ones = [bytes([b]) for b in range(256) if m.alphabet.size[b] == 1]
    assert abs(sum(2 ** (start - x) for x in m.bits_of([head + o for o in ones])) + escapes(m, head, start) - 1) < 1e-3


def escapes(m, head, start):
    """The probability of the symbols that begin a rare byte."""

    class Raw:
        blank, symbols = m.alphabet.blank, staticmethod(lambda t: t)

    raw = M.Mixer(m.tables, Raw)
    raw.weights, raw.map, raw.bits = m.weights, m.map, m.bits
    known = m.alphabet.symbols(head)
    return sum(2 ** (start - x) for x in raw.bits_of([np.r_[known, np.uint8(s)] for s in (29, 30, 31)]))


def test_long_texts_go_on_in_stretches(monkeypatch):
    rng = random.Random(6)
    m = a_mixer(np.random.default_rng(7), some_texts(rng, 20))
    text = M.plain(" ".join(["alpha beta delta"] * 60))
    monkeypatch.setattr(M, "STRETCH", 100)
    cut = m.alphabet.symbols(text)
    want = sum(m_raw(m, cut[i : i + 100]) for i in range(0, len(cut), 100))
    assert abs(m.bits_of([text])[0] - want) < 1e-2 * want and m.bits_of([]).shape == (0,)


def m_raw(m, symbols):
    class Raw:
        blank, symbols = m.alphabet.blank, staticmethod(lambda t: t)

    raw = M.Mixer(m.tables, Raw)
    raw.weights, raw.map, raw.bits = m.weights, m.map, m.bits
    return raw.bits_of([symbols])[0]


def test_counts_of_contexts():
    texts = [b"ab ab\n", b"ab\n"]
    alphabet = M.Alphabet(np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256))
    found = {k: (cell, n) for k, cell, n in M.context_counts(texts, alphabet, (11, 12, 12))}
    assert all(n.sum() == 9 and (np.diff(cell.astype(np.int64)) > 0).all() for cell, n in found.values())
    a = int(alphabet.code[ord("a"), 0])
    assert sum(int(n) for cell, n in zip(*found[2], strict=True) if cell & 31 == a) == 3 == max(int(n) for cell, n in zip(*found[2], strict=True) if cell & 31 == a)
    assert list(M.context_counts([], alphabet, (11, 12, 12)))[0][1].size == 0
