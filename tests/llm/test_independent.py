"""Fingerprints, padding and packing against versions written another way."""
import random

import pytest
import xxhash

from lakebuild.llm import simhash_dedup, vector_packing
from lakebuild.llm.queries import tokenizer_path

from .conftest import LONG, ODD


def plain_fingerprint(text, k=4):
    """Bit by bit: more than half of the shingles' hashes have it."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", ["", " \t", "one", "One two", "a b c d", "a b c d e", "Ä Ö ß Ü é", "x y z　w v", "A\x1cB c d e", "the the the the the the", LONG[:5000]])
def test_fingerprint(text):
    assert simhash_dedup.fingerprint(text, 4) == plain_fingerprint(text)


def test_fingerprints_and_components(make_docs):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choices(words, k=400) for _ in range(6)]
    rows = list(ODD)
    for i in range(120):
        t = list(base[i % 6])
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((100 + i, " ".join(t), "s"))
    rows = [r for r in rows if r[0] is not None]
    got = {(r.doc_id, r.fp & (1 << 64) - 1): r.component_id for r in simhash_dedup.simhash_groups(make_docs(rows)).collect()}
    prints = [(i, plain_fingerprint(t)) for i, t, _ in rows]
    assert set(got) == set(prints)
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                parent[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(prints):
        smallest[find(k)] = min(smallest.get(find(k), i), i)
    assert all(got[p] == smallest[find(k)] for k, p in enumerate(prints))


def test_packing_leaves_little_padding(make_docs):
    """Padded to 1024 or a power of two, the sequences hold at most a hundredth of padding; no plain first-fit does better by more."""
    rng = random.Random(2)
    docs = make_docs([(i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=int(rng.paretovariate(1.1) * 20))), "s") for i in range(1500)])
    got = vector_packing.pack(vector_packing.pieces(docs, tokenizer_path()), 1500).collect()
    used = {}
    for r in got:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    total = sum(used.values())
    padded = sum(vector_packing.padded_length(n) for n in used.values())
    assert all(n <= vector_packing.LIMIT for n in used.values())
    assert (padded - total) / padded < 0.01
    bins = []  # first fit over the pieces, longest first
    for n in sorted((r.length for r in got), reverse=True):
        for k, room in enumerate(bins):
            if n <= room:
                bins[k] -= n
                break
        else:
            bins.append(vector_packing.LIMIT - n)
    assert len(used) <= len(bins) * 1.02 + 1
