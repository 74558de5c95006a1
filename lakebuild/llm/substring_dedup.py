"""Duplicate passages by their windows, looked up in an indexed reference.

The reference of a document is every document with a smaller id. It is indexed by the hashes
of its windows of ``window`` words in reference blocks: a window belongs to the block of its
minimizer (the least hash of the ``anchor``-word runs in it), so equal windows meet in one
block and neighbouring windows mostly travel together. The windows of every document are
looked up in their blocks; found windows that follow one another are joined, from left to
right, into factors, the longest stretches all of whose windows occur in the reference. Each
factor is at least ``window`` words long; a window across the border of two factors counts
only if it was found itself. The words under the factors are the duplicate spans. No
Lempel-Ziv parse against reference texts is made: a longest match would cover the same
windows, and would need the texts of every reference block beside every document.

Traffic. Documents are dealt by a hash into groups of about ``GROUP_BYTES`` of text. Within a
group a window found under a smaller id is settled at once and not sent, so a passage that
many documents share is sent once per group, however often it occurs. A sent window is 5
bytes of its hash; 3 bytes of its minimizer's hash, the position and the document are stored
once per run. The block, minimizer and window bytes together identify a window (64 bits and
the block's). A block answers each group in one row, and the group, whose texts lie where
they were dealt to, joins the answers into factors.

Defined results: null and empty texts have no words; a document of under ``window`` words is
kept whole; rows with a null id are kept whole and are no reference; rows with equal ids are
no reference for each other, and equal rows give equal results; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakebuild.llm.common import group_count, text_of, words_of

WINDOW, ANCHOR = 13, 5
GROUP_BYTES, BLOCK_BYTES, MEMO = 6 << 20, 16 << 20, 300_000
_LOW40 = np.uint64((1 << 40) - 1)


class WordHashes(dict):
    """Word to 64-bit hash, computed once per word."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every run of k words."""
    odd = np.random.default_rng(seed).integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(h) - k + 1
    out = h[:n] * odd[0]
    for j in range(1, k):
        out += h[j:j + n] * odd[j]
    return _mixed(out)


def window_hashes(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(window hash, minimizer hash) for every window of the word hashes ``h``."""
    a = _runs(h, anchor, 1)
    n, low = len(h) - window + 1, None
    for j in range(window - anchor + 1):
        part = a[j:j + n]
        low = part.copy() if low is None else np.minimum(low, part, out=low)
    return _runs(h, window, 2), low


def stretches(at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of first, length) of the maximal runs of consecutive positions with equal ``same``."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.r_[True, np.diff(at) != 1]
    for s in same:
        new[1:] |= s[1:] != s[:-1]
    first = np.nonzero(new)[0]
    return first, np.diff(np.r_[first, len(at)])


_SENT = "block int, part int, ids binary, doc binary, start binary, length binary, anchor binary, hash binary"
_FOUND = "part int, doc binary, start binary, length binary"


def _ordered(t: pa.Table) -> pa.Table:
    """The documents of a group in the order in which they are numbered."""
    return t.sort_by([("doc_id", "ascending"), ("row_key", "ascending")])


def _send(n_blocks: int, window: int, anchor: int):
    names = [c.split()[0] for c in _SENT.split(", ")]

    def rows(part: int, t: pa.Table) -> Iterator[tuple]:
        memo, no, hashed = WordHashes(), [], []
        for i, (doc_id, text) in enumerate(zip(t["doc_id"].to_pylist(), t["t"])):
            w = words_of(text.as_py()) if doc_id is not None else []
            if len(w) >= window:
                no.append(i)
                hashed.append(np.fromiter(map(memo.__getitem__, w), np.uint64, len(w)))
                if len(memo) > MEMO:
                    memo.clear()
        if not no:
            return
        ids = t["doc_id"].fill_null(0).to_numpy()[no]
        no, size = np.array(no, np.int32), np.array([len(x) for x in hashed])
        h = np.concatenate(hashed)
        doc = np.repeat(np.arange(len(no)), size)
        base = np.cumsum(size) - size
        wh, low = window_hashes(h, window, anchor)
        at = np.nonzero(doc[:len(wh)] == doc[window - 1:])[0]  # windows within one document
        wh, low, doc = wh[at], low[at], doc[at]
        order = np.argsort(wh, kind="stable")  # documents ascend, so the first of equal windows has the least id
        s = wh[order]
        head = np.r_[True, s[1:] != s[:-1]]
        first_id = ids[doc[order[np.nonzero(head)[0]]]][np.cumsum(head) - 1]
        settled = np.empty(len(wh), bool)
        settled[order] = ids[doc[order]] > first_id
        pos = (at - base[doc]).astype(np.int32)

        i = np.nonzero(settled)[0]  # known here already: a block of no windows carries them through
        f, n = stretches(at[i], doc[i])
        if len(f):
            yield (part % n_blocks, part, b"", no[doc[i][f]].tobytes(), pos[i][f].tobytes(), n.astype(np.int32).tobytes(), b"", b"")

        i = np.nonzero(~settled)[0]
        block = (low[i] >> np.uint64(32)) % np.uint64(n_blocks)
        f, n = stretches(at[i], doc[i], low[i])
        order = np.argsort(block[f], kind="stable")
        used, cuts = np.unique(block[f][order], return_index=True)
        small = (wh[i] & _LOW40).view(np.uint8).reshape(-1, 8)[:, :5]
        for b, x, y in zip(used.tolist(), cuts.tolist(), [*cuts.tolist()[1:], len(order)]):
            r = order[x:y]
            rf, rn = f[r], n[r]
            each = np.repeat(rf - np.r_[0, np.cumsum(rn)[:-1]], rn) + np.arange(rn.sum())
            own = doc[i][rf]
            yield (int(b), part, ids[own].tobytes(), no[own].tobytes(), pos[i][rf].tobytes(), rn.astype(np.int32).tobytes(),
                   low[i][rf].view(np.uint8).reshape(-1, 8)[:, :3].tobytes(), small[each].tobytes())

    def run(t: pa.Table) -> pa.Table:
        out = list(rows(t["part"][0].as_py(), _ordered(t)))
        return pa.table([pa.array([o[k] for o in out], pa.int32() if k < 2 else pa.binary()) for k in range(8)], names=names)

    return run


def _look_up(t: pa.Table) -> pa.Table:
    """One reference block: per group, the stretches of windows (document, first, number) that are duplicates."""
    read = lambda c, kind: [np.frombuffer(x, kind) for x in t[c].to_pylist()]
    parts, hashes = t["part"].to_pylist(), t["hash"].to_pylist()
    docs, starts, lengths, ids = read("doc", np.int32), read("start", np.int32), read("length", np.int32), read("ids", np.int64)
    out = [(p, d, s, n) for p, d, s, n, h in zip(parts, docs, starts, lengths, hashes) if not h]  # settled before
    rows = [i for i, h in enumerate(hashes) if h]
    if rows:
        anchors = t["anchor"].to_pylist()
        size = np.array([len(docs[i]) for i in rows])
        length = np.concatenate([lengths[i] for i in rows])
        wide = np.zeros((length.sum(), 8), np.uint8)
        wide[:, :5] = np.frombuffer(b"".join([hashes[i] for i in rows]), np.uint8).reshape(-1, 5)
        wide[:, 5:] = np.repeat(np.frombuffer(b"".join([anchors[i] for i in rows]), np.uint8).reshape(-1, 3), length, axis=0)
        key = wide.view(np.uint64).ravel()
        owner = np.repeat(np.concatenate([ids[i] for i in rows]), length)
        order = np.argsort(key)
        key = key[order]
        head = np.r_[True, key[1:] != key[:-1]]
        least = np.minimum.reduceat(owner[order], np.nonzero(head)[0])[np.cumsum(head) - 1]
        hit = np.zeros(len(key), bool)
        hit[order] = owner[order] > least
        run = np.repeat(np.arange(len(length)), length)
        place = np.arange(len(key)) - np.repeat(np.cumsum(length) - length, length)
        at = np.nonzero(hit)[0]
        f, n = stretches(at, run[at])
        run_of, first = run[at[f]], place[at[f]]
        doc, start = np.concatenate([docs[i] for i in rows]), np.concatenate([starts[i] for i in rows])
        row_of = np.repeat(np.arange(len(rows)), size)[run_of]
        cuts = np.searchsorted(row_of, np.arange(len(rows) + 1))
        for i, x, y in zip(rows, cuts.tolist(), cuts.tolist()[1:]):
            if y > x:
                r = run_of[x:y]
                out.append((parts[i], doc[r], (start[r] + first[x:y]).astype(np.int32), n[x:y].astype(np.int32)))
    return pa.table({"part": pa.array([o[0] for o in out], pa.int32()),
                     **{c: pa.array([o[k].tobytes() for o in out], pa.binary()) for k, c in ((1, "doc"), (2, "start"), (3, "length"))}})


def factors(starts: np.ndarray, lengths: np.ndarray, n_words: int, window: int = WINDOW) -> np.ndarray:
    """Which words the factors cover: windows found in any block, joined greedily."""
    covered = np.zeros(n_words + 1, np.int32)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + lengths + window - 1, -1)
    return np.cumsum(covered[:-1]) > 0


def removed(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` are the kept words joined by spaces."""
    size = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    part = F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(group_count(size, GROUP_BYTES))).cast("int")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"),
                        text_of().alias("t")).withColumn("part", part)
    sent = dealt.groupBy("part").applyInArrow(_send(group_count(size, BLOCK_BYTES), window, anchor), _SENT)
    found = sent.groupBy("block").applyInArrow(_look_up, _FOUND)

    def join(texts: pa.Table, answers: pa.Table) -> pa.Table:
        t = _ordered(texts)
        doc, start, length = (np.frombuffer(b"".join(answers[c].to_pylist()), np.int32) for c in ("doc", "start", "length"))
        order = np.argsort(doc, kind="stable")
        cuts = np.searchsorted(doc[order], np.arange(len(t) + 1)).tolist()
        total, gone, kept = [], [], []
        for i, text in enumerate(t["t"]):
            w = words_of(text.as_py())
            total.append(len(w))
            if cuts[i + 1] > cuts[i]:
                mine = order[cuts[i]:cuts[i + 1]]
                cover = factors(start[mine], length[mine], len(w), window)
                w = [w[k] for k in np.nonzero(~cover)[0].tolist()]
            gone.append(total[-1] - len(w))
            kept.append(b" ".join(w).decode())
        return pa.table({"doc_id": t["doc_id"], "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()),
                         "kept": pa.array(kept, pa.string())})

    return dealt.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(
        join, "doc_id long, n_words long, n_removed long, kept string")


SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
g as (select doc_id, i, list_aggregate(ws[i:i+12], 'string_agg', ' ') as x from (select doc_id, ws, unnest(generate_series(1, len(ws) - 12)) as i from w where len(ws) >= 13)),
k as (select doc_id, i, min(doc_id) over (partition by x) as f from g),
c as (select distinct doc_id, unnest(generate_series(i, i + 12)) as p from k where f < doc_id),
l as (select doc_id, len(ws) as n, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
j as (select l.doc_id, l.p, l.word from l anti join c on l.doc_id = c.doc_id and l.p = c.p),
s as (select doc_id, count(*) as m, string_agg(word, ' ' order by p) as t from j group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(m, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join s using (doc_id)"""
