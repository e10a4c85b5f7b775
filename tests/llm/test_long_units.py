"""Units of any length have one lattice: no border every 48 characters."""

import numpy as np

from recordweave.llm import pieces


def ends(p, ids):
    """Offsets where pieces end."""
    return set(np.cumsum([len(p.bytes[i].decode()) for i in ids]).tolist())


def test_pieces_cross_any_place():
    p, n = pieces.pieces(), 400
    text = "thenightriver" * 9
    got = p.encode_many([text] * n, np.arange(n))
    assert all(p.decode(x).decode() == text for x in got)
    share = np.array([sum(at in ends(p, x) for x in got) / n for at in range(1, len(text))])
    # place 48 is the 9th of a repeated word, like 61 and 74 (the text's ends are far from all of them)
    assert share[47] < 1 and abs(share[47] - share[60]) < 0.1 and abs(share[47] - share[73]) < 0.1


def test_blocks_are_the_lattice(monkeypatch):
    p = pieces.pieces()
    text = "".join(f"thenight{i}é你好\nriver▁🎉" for i in range(60))
    texts, keys = [text, "a " + text, text, "short"], np.array([1, 2, 3, 4])
    want = p.encode_many(texts, keys)
    monkeypatch.setattr(pieces, "_LENGTHS", (4, 48))
    monkeypatch.setattr(pieces, "_BLOCK", 64)
    got = p.encode_many(texts, keys)
    assert all((a == b).all() for a, b in zip(want, got, strict=True))
    assert [p.decode(x).decode() for x in got] == texts


def test_very_long_unit():
    p, text = pieces.pieces(), "好thenight" * 1000
    assert p.decode(p.encode_many([text], np.array([7]))[0]).decode() == text
