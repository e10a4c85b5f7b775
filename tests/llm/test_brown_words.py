"""Every training word is clustered by its own contexts, not by its last two bytes."""

import numpy as np
import pytest

from recordweave.llm import brown_lm
from recordweave.llm.common import signed


def likelihood(tokens, of):
    """Of class bigrams, up to what no class changes; ``tokens`` are texts with their ends."""
    k = max(of.values()) + 1
    m = np.zeros((k, k))
    for t in tokens:
        for a, b in zip(["</s>", *t[:-1]], t, strict=True):
            m[of[a], of[b]] += 1
    return brown_lm._f(m).sum() - brown_lm._f(m.sum(1)).sum() - brown_lm._f(m.sum(0)).sum()


def texts(seed=5):
    rng = np.random.default_rng(seed)
    nouns, verbs = [f"n{i}x" for i in range(6)], [f"v{i}x" for i in range(6)]
    out = []
    for i in range(240):
        t = []
        for _ in range(8):
            t += ["the", str(rng.choice(nouns)), "will", str(rng.choice(verbs))]
        rare = f"r{i % 60}ab"  # one suffix for all: even ones in a noun's place, odd ones in a verb's
        t[1 if i % 2 == 0 else 3] = rare
        if i % 9 == 0:
            t += [f"s{i % 5}ab"] * 2 + [f"once{i}zz"]  # words that follow themselves, words seen once
        out.append(" ".join(t))
    return out


@pytest.fixture(scope="module")
def made(spark):
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    c = brown_lm.core(spark.createDataFrame([(0, int(w), int(n)) for w, n in counts(rows).items()], "chunk int, w long, n long"), docs, 12, 4)
    got = brown_lm.assign(docs, spark.sparkContext.broadcast(c), 3).collect()
    return rows, c, {r.w: (r.c, r.k) for r in got}


def hashed(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(signed(brown_lm.Words(np.array([0, len(raw)]), raw).hashes(lower=True))[0])


def counts(rows):
    out = {}
    for t in rows:
        for w in t.split():
            out[hashed(w)] = out.get(hashed(w), 0) + 1
    return out


def test_each_word_has_its_best_class(made):
    rows, c, got = made
    words, n = sorted({w for t in rows for w in t.split()}), counts(rows)
    top = {int(w): int(c.of[i]) for i, w in enumerate(signed(c.top))}
    rest = [w for w in words if hashed(w) not in top]
    assert set(got) == {hashed(w) for w in rest} and all(got[hashed(w)][0] == n[hashed(w)] for w in rest)
    suffix = lambda w: len(c.top) + (ord(w[-2]) * 31 + ord(w[-1]) * 7) % brown_lm.SUFFIXES
    start = {w: top.get(hashed(w), int(c.of[suffix(w)])) for w in words} | {"</s>": int(c.of[-1])}
    tokens = [[*t.split(), "</s>"] for t in rows]
    for w in rest[::4]:
        by = [likelihood(tokens, start | {w: k, "": c.classes - 1}) for k in range(c.classes)]
        assert by[got[hashed(w)][1]] >= max(by) - 1e-6, w


def test_equal_endings_part_by_context(made):
    _, _, got = made
    noun, verb = ({got[hashed(f"r{i}ab")][1] for i in range(j, 60, 2)} for j in (0, 1))
    assert not noun & verb
