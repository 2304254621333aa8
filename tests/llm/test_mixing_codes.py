import numpy as np

from unifold.llm import mixing


def lexicon(text, known=()):
    buf, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    low, starts, ends, h, _, _ = mixing.tokens(buf, offs)
    words = [low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    own = {int(x): words.count(w) for x, w in zip(h, words, strict=False) if w in known}
    hashes, counts = np.array(list(own), np.uint64), np.array(list(own.values()), np.int64)
    return buf, offs, words, mixing.Lexicon(hashes, counts, 1, len(words), mixing.pair_counts(low, starts, ends))


def test_spellings_take_few_decisions_and_can_be_read_back():
    rng = np.random.default_rng(4)
    odd = bytes(rng.integers(0, 256, 40, dtype=np.uint8).tolist())
    text = b" ".join(bytes(rng.choice(list(b"eeeeeetttaaoinshrdlu"), int(rng.integers(1, 12))).tolist()) for _ in range(2000)) + b" \x00\x00 " + odd
    buf, offs, words, lex = lexicon(text)
    _, (slots, bit, gate, edges) = mixing.decisions(lex, buf, offs)
    spelled = sum(map(len, words)) + len(words)
    assert len(bit) == edges[-1] == len(slots[0]) < 4.5 * spelled  # bit by bit it were 8
    assert gate.min() >= mixing.GATES - 8 and gate.max() < mixing.GATES
    codes = lex.spellings
    tree = {(s >> 8, codes.bits[a : a + n].tobytes()): s & 255 for s, (a, n) in enumerate(zip(codes.at.tolist(), codes.size.tolist(), strict=True))}
    got, path, before = [b""], b"", 0
    for b in bit:
        path += bytes([b])
        if (byte := tree.get((before, path))) is not None:
            path, before = b"", 0 if byte == 32 else byte
            got = [*got, b""] if byte == 32 else [*got[:-1], got[-1] + bytes([byte])]
    assert got == [*words, b""] and path == b""


def test_words_of_the_lexicon_are_not_spelled():
    buf, offs, _, lex = lexicon(b"one two one three one two", (b"one", b"two"))
    (_, bit, _, edges), (_, spelled, _, _) = mixing.decisions(lex, buf, offs)
    assert edges[-1] == len(bit) and len(spelled) == lex.spellings.size[[ord("t"), *(256 * a + b for a, b in zip(b"three", b"hree ", strict=True))]].sum()


def test_pairs_of_bytes():
    text = b" ab\tb  abA"
    low, starts, ends, *_ = mixing.tokens(np.frombuffer(text, np.uint8), np.array([0, 4, len(text)]))
    want = np.zeros(1 << 16, np.int64)
    for w in (b"ab", b"b", b"aba"):
        for before, byte in zip(b"\0" + w, w + b" ", strict=True):
            want[256 * before + byte] += 1
    assert (mixing.pair_counts(low, starts, ends) == want).all()
    assert not mixing.pair_counts(*(np.zeros(0, k) for k in (np.uint8, np.int64, np.int64))).any()


def test_index_finds_what_is_there():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 1000):
        have = np.unique(np.concatenate([rng.integers(0, 2**64 - 1, n, dtype=np.uint64), np.array([0, 5, 2**64 - 1][: n // 2], np.uint64)]))
        ask = np.concatenate([have, rng.integers(0, 2**64 - 1, 50, dtype=np.uint64), np.array([0, 4, 2**64 - 1], np.uint64)])
        at, known = mixing.Index(have).find(ask)
        assert (known == np.isin(ask, have)).all() and (have[at[known]] == ask[known]).all()


def test_costs_are_those_of_the_rows_alone():
    rng = np.random.default_rng(11)
    texts = [b" ".join(b"w%d" % k for k in rng.integers(0, 50, n)) for n in (3000, 1, 40, 0, 700)]
    whole = b"".join(texts)
    _, _, _, lex = lexicon(b" ".join(texts), {b"w%d" % k for k in range(20)})
    table = rng.normal(0, 2, (mixing.TABLES, 1 << mixing.BITS)).astype(np.float32)

    def costs(buf, offs):
        return sum(mixing.cost(table, s, mixing.START[k], mixing.RATE[k]) for k, s in enumerate(mixing.decisions(lex, buf, offs)))

    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    alone = [costs(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    np.testing.assert_allclose(costs(np.frombuffer(whole, np.uint8), offs), alone, rtol=1e-5)
