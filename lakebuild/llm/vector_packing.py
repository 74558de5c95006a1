"""Packing: documents become token pieces, and pieces become full sequences.

Tokens. A whole text is tokenized with the vocabulary of a public tokenizer file
and closed by one separator id. With ``special`` the file's added tokens inside a text
become their one id, as ``tokenizers`` does by default; without, they are ordinary text.

Pieces. A document of n tokens gives ``n // limit`` whole pieces, which fill a
sequence each, and one rest.

Bins. The rests are packed by the dot-product heuristic of vector bin packing:
a bin has room for tokens, segments and loss-bearing tokens; while something
fits, the bin takes the fitting kind of piece whose demand vector has the
largest dot product with the bin's remaining capacities, each dimension scaled
by its limit and weighted by its total demand. Equal demand vectors are one
kind, so a choice looks at the kinds left, not at the pieces. Rests are dealt
into groups of about ``group_pieces`` by a hash; each group is packed alone.

Defined results: a null or empty text is one separator id; rows with equal or
null ids are packed like any others; an empty table gives no pieces; further
columns are ignored. The result does not depend on the partitioning of the
input, as a group's pieces are sorted before packing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakebuild.llm.common import crc, group_count, text_of

LIMIT = 1024
MAX_SEGMENTS = 128

# Fixed value: the pattern that byte-level BPE tokenizers of this kind split text by.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: White space runs from here on go to ``tokenizers`` itself: the pattern's look-ahead backtracks
#: over a run, and tiktoken's regex gives up at about a million steps.
LONG_RUN = 100_000
_LONG_RUN = re.compile(rf"\s{{{LONG_RUN}}}")


def _byte_of() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary: printable Latin-1
    bytes stand for themselves, the others take the code points from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts under the vocabulary of a byte-level BPE tokenizer file.

    The ids are the merge ranks, so tiktoken's encoder gives the tokenizer's own ids (tested)
    at a quarter of its CPU time. Added tokens are found by ``ids(text, True)`` only."""

    def __init__(self, path: str):
        import json

        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in or look at their surroundings are not known here")
        special = {t["content"]: t["id"] for t in added}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One encoder per Python worker and file."""
        import sys
        import types

        kept = sys.modules.setdefault("_lakebuild_worker_cache", types.ModuleType("_lakebuild_worker_cache")).__dict__
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def ids(self, text: str, special: bool = False) -> np.ndarray:
        if len(text) >= LONG_RUN and _LONG_RUN.search(text):
            found = self.slow(special).encode(text, add_special_tokens=False).ids
        else:
            found = self.encoding.encode(text, allowed_special="all") if special else self.encoding.encode_ordinary(text)
        return np.array(found, "<u4")

    def slow(self, special: bool):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(self.path)
        tok.encode_special_tokens = not special
        return tok


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, separator: int = 0,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, special: bool = True,
           prompt_col: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, loss, key[, ids]): ids as little-endian 32-bit.

    ``loss``: tokens of the piece that carry loss, all but the separator. With ``prompt_col`` (instruction data) a row is
    its prompt's tokens, which carry no loss, then its text's; a null prompt is empty. ``key`` identifies the row's content."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long, key long" + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path)
        end = np.array([separator], "<u4")
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.slice(at, 1000)
                row, cols = [], [[] for _ in range(4 + with_ids)]
                free = []  # tokens of the prompt
                for i, text in enumerate(b.column(2).to_pylist()):
                    ids = np.concatenate([encoder.ids(text, special), end])
                    if prompt_col:
                        prompt = encoder.ids(b.column(3)[i].as_py(), special)
                        ids = np.concatenate([prompt, ids])
                        free.append(len(prompt))
                    for s in range(0, len(ids), limit):
                        data = ids[s:s + limit].tobytes()
                        row.append(i)
                        for c, v in zip(cols, (s, len(data) // 4, crc(data), len(ids), data)):
                            c.append(v)
                start, length, sums, total = (np.array(c, np.int64) for c in cols[:4])
                loss = length - (start + length == total)
                if prompt_col:
                    loss -= np.clip(np.array(free, np.int64)[row] - start, 0, length)
                take = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), *map(pa.array, (start, length, sums, total, loss)), b.column(1).take(take),
                     *(pa.array(c, pa.binary()) for c in cols[4:])], names)

    parts = [text_col, *([prompt_col] if prompt_col else [])]
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, *parts).alias("key"),
                      *[text_of(c).alias(f"t{i}") for i, c in enumerate(parts)])
    return src.mapInArrow(run, schema)


def pack_bins(demand: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place) per row of ``demand`` (items x dimensions). An item that alone breaks a limit raises."""
    n = len(demand)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if (demand > limits).any():
        raise ValueError("a piece alone exceeds the limits of a sequence")
    kinds, kind_of = np.unique(demand, axis=0, return_inverse=True)
    kind_of = kind_of.ravel()
    queue = np.argsort(kind_of, kind="stable")
    left = np.bincount(kind_of, minlength=len(kinds))
    head = np.concatenate([[0], np.cumsum(left)[:-1]])
    weight = demand.sum(axis=0) / (demand.sum(axis=0) / limits).max() / limits**2
    scaled = kinds * weight
    bins, places = np.empty(n, np.int64), np.empty(n, np.int64)
    live = np.arange(len(kinds))
    k, done = 0, 0
    while done < n:
        live = live[left[live] > 0]
        room, place, fit = limits.astype(np.int64).copy(), 0, live
        while True:
            fit = fit[(left[fit] > 0) & (kinds[fit] <= room).all(axis=1)]
            if not len(fit):
                break
            best = fit[int(np.argmax(scaled[fit] @ room))]
            item = queue[head[best]]
            head[best] += 1
            left[best] -= 1
            bins[item], places[item] = k, place
            room -= kinds[best]
            place += 1
            done += 1
        k += 1
    return bins, places


def pack(parts: DataFrame, rows: int, limit: int = LIMIT, max_segments: int = MAX_SEGMENTS,
         max_loss: int = LIMIT, group_pieces: int = 8192) -> DataFrame:
    """``parts`` plus sequence_id and offset. ``rows``: how many rests there are, about."""
    groups = group_count(rows, group_pieces)
    limits = np.array([limit, max_segments, max_loss], np.int64)
    schema = parts.drop("loss", "key").schema.add("sequence_id", "long").add("offset", "long")

    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("key", "start", "ids_crc32")])
        length = t["length"].to_numpy()
        bins, places = pack_bins(np.column_stack([length, np.ones(len(t), np.int64), t["loss"].to_numpy()]), limits)
        order = np.lexsort((places, bins))
        ends = np.cumsum(length[order])
        begins = ends - length[order]
        first = np.r_[True, np.diff(bins[order]) > 0]
        offset = np.empty(len(t), np.int64)
        offset[order] = begins - np.maximum.accumulate(np.where(first, begins, 0))
        sequence = t["group"][0].as_py() * (1 << 32) + bins
        t = t.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        return t.select(schema.names)

    # whole pieces go round the groups by their start, so one very long document is spread as well
    dealt = parts.withColumn("group", F.pmod(F.xxhash64("key", F.col("start")), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(place, schema)


def padded_length(used: int, limit: int = LIMIT) -> int:
    """The padded length of a sequence: a power of two stays as it is."""
    return used if used & (used - 1) == 0 else limit
