"""A hashed maximum-entropy language model, trained and scored by Spark jobs.

Tokens are lower-cased (A-Z) words and one end per text, known by 64-bit hashes.

Counts. Every task sends, per hash shard of the tokens, the distinct tokens of a chunk of
texts with their training counts and which document holds them how often. A shard adds the
counts up and answers with sums per document, so no dictionary of all tokens exists anywhere.

Model. The ``head`` most frequent training tokens (a parameter, as are all table sizes) are
outputs of their own, grouped into ``classes`` classes by the square root of their frequency;
all others are the last class, within which a token has its add-one share of that class's
training tokens. log P(token | h) = log P(class | h) + log P(token | class, h):

* P(class | h) is a softmax over a bias and the weights of three hashed features: the token
  before, the token before that (a skip feature), and both together (an n-gram feature);
* P(token | class, h) is a softmax over the class's tokens of a bias and the weight of the
  hashed token before.

Training covers all training tokens in every round: tasks sum observed feature counts (once, as
no weight changes them) and expected ones (in the first round, where all weights are zero, they
follow from the observed), the difference of which is the gradient of the log likelihood; the
sums are added up in blocks and every weight moves by ``log((observed + prior) / (expected + prior))`` over the
number of features (the gradient scaled per weight, as in generalized iterative scaling, which
does not overshoot). What the driver and the broadcasts hold is the model: about
(3 x ``buckets`` + 1) x classes + ``word_buckets`` x head floats, whatever the input's size.

Scores are sums of log10 probabilities over whole texts, in numpy batches that gather the
weights of the few active features.

Defined results: a null or empty text is its end alone; a null id counts as the text '' for
the split and is null in the result; repeated rows count and are scored each; without
training texts nothing is known, and all scores are zero; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakebuild.llm.common import cut, group_count, text_of

HEAD, CLASSES, BUCKETS, WORD_BUCKETS, ROUNDS = 16_384, 64, 2048, 16, 2
PRIOR = 2.0
CHUNK_TOKENS, SHARD_BYTES, MEMO, BATCH = 1_000_000, 32 << 20, 500_000, 32_768
#: Partial sums that meet in one group: FAN_IN, up to FAN_IN ** (LEVELS + 1) tasks.
FAN_IN, LEVELS = 64, 2
FOLDS, HELD_OUT = 7, 2
END = xxhash.xxh64_intdigest(b"", 11)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


class TokenHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 11)
        return h


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"),
                       held_out().alias("held_out"), text_of().alias("t"))


def indexed(docs: DataFrame, model: "Model") -> DataFrame:
    """The source with every text as head places (two bytes a token), written once for all rounds and the scoring."""
    if len(model.head) >= 1 << 16:
        raise ValueError("head places take two bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, size, tokens in chunks(batches, HeadIndex(model.head), CHUNK_TOKENS // 4):
            ends = np.cumsum(size)
            flat = tokens.astype("<u2")
            parts = [flat[a:b].tobytes() for a, b in zip((ends - size).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(3)), pa.array(parts, pa.binary())], names)

    schema = "doc_id long, row_key long, held_out boolean, places binary"
    names = [c.split()[0] for c in schema.split(", ")]
    return cut(_source(docs).mapInArrow(run, schema))


def place_chunks(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple]:
    """Like ``chunks``, from indexed rows."""
    for whole in batches:
        size = np.array([len(x.as_py()) // 2 for x in whole.column(3)], np.int64)
        first, upto = 0, np.cumsum(size)
        while first < len(size):
            done = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, done + tokens)))
            part = whole.slice(first, last - first)
            yield part, size[first:last], np.frombuffer(b"".join(part.column(3).to_pylist()), "<u2")
            first = last


def chunks(batches: Iterator[pa.RecordBatch], memo: dict, tokens: int) -> Iterator[tuple]:
    """(record batch of the other columns, token counts, token values) in chunks of about ``tokens`` tokens.
    ``memo`` maps words (and b"", the end) to integers."""
    for whole in batches:
        first, size, parts, total = 0, [], [], 0
        for i, t in enumerate(whole.column(whole.num_columns - 1)):
            w = t.as_py().encode().lower().split()
            w.append(b"")
            parts.append(np.fromiter(map(memo.__getitem__, w), np.uint64, len(w)))
            size.append(len(w))
            total += len(w)
            if total >= tokens or i + 1 == len(whole):
                yield whole.slice(first, len(size)), np.array(size), np.concatenate(parts)
                first, size, parts, total = i + 1, [], [], 0
                if len(memo) > MEMO:
                    memo.clear()


# ------------------------------------------------------------------- counts

def token_counts(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: (token, count) for training tokens, and per document and shard (doc_id, row_key, log_sum,
    n_known, count): the sum of log10(count + 1), the number of its tokens that occur in training, and of all."""
    size = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    n = group_count(size, SHARD_BYTES)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, count, tokens in chunks(batches, TokenHashes(), CHUNK_TOKENS):
            doc = np.repeat(np.arange(len(count)), count)
            train = ~rows.column(2).to_numpy(zero_copy_only=False)
            known, token = np.unique(tokens, return_inverse=True)
            in_training = np.bincount(token, weights=train[doc], minlength=len(known)).astype(np.int64)
            pair, often = np.unique(doc * len(known) + token, return_counts=True)
            doc, token = pair // len(known), pair % len(known)
            shard = ((known >> np.uint64(40)) % np.uint64(n)).astype(np.int64)
            local = np.empty(len(known), np.int64)  # place of a token among those of its shard
            by = np.argsort(shard, kind="stable")
            at = np.searchsorted(shard[by], np.arange(n + 1))
            local[by] = np.arange(len(by)) - np.repeat(at[:-1], np.diff(at))
            order = np.argsort(shard[token], kind="stable")
            cuts = np.searchsorted(shard[token][order], np.arange(n + 1))
            out = []
            for s in np.nonzero(np.diff(cuts))[0].tolist():
                o, k = order[cuts[s]:cuts[s + 1]], by[at[s]:at[s + 1]]
                used, own = np.unique(doc[o], return_inverse=True)
                out.append((s, known[k].tobytes(), in_training[k].tobytes(), used, own.astype(np.int32).tobytes(),
                            local[token[o]].astype(np.int32).tobytes(), often[o].astype(np.int32).tobytes()))
            flat = [pa.array([o[i] for o in out], pa.int32() if i == 0 else pa.binary()) for i in (0, 1, 2, 4, 5, 6)]
            lists = [pa.array([rows.column(c).take(pa.array(o[3])).to_pylist() for o in out], pa.list_(pa.int64())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*flat, *lists], names)

    schema = "shard int, tokens binary, counts binary, doc binary, token binary, often binary, ids array<long>, keys array<long>"
    names = [c.split()[0] for c in schema.split(", ")]

    def add(t: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x, kind) for x in t[c].to_pylist()]
        tokens, counts = read("tokens", np.uint64), read("counts", np.int64)
        known, place = np.unique(np.concatenate(tokens), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
        logs, seen, at = np.log10(total + 1.0), total > 0, 0
        sums, hits, every = [], [], []
        for k, d, w, n_ in zip(tokens, read("doc", np.int32), read("token", np.int32), read("often", np.int32)):
            p = place[at:at + len(k)][w]
            sums.append(np.bincount(d, weights=n_ * logs[p]))
            hits.append(np.bincount(d, weights=n_ * seen[p]))
            every.append(np.bincount(d, weights=n_))
            at += len(k)
        ids, keys = ([x for xs in t[c].to_pylist() for x in xs] for c in ("ids", "keys"))
        m, used = len(ids), np.nonzero(seen)[0]
        none, skip = pa.nulls(len(used)), pa.nulls(m)
        a = pa.table([pa.array(known[used].view(np.int64)), pa.array(total[used]), none.cast(pa.int64()), none.cast(pa.int64()),
                      none.cast(pa.float64()), none.cast(pa.int64())], names=found)
        b = pa.table([skip.cast(pa.int64()), pa.array(np.concatenate(every).astype(np.int64)), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()),
                      pa.array(np.concatenate(sums)), pa.array(np.concatenate(hits).astype(np.int64))], names=found)
        return pa.concat_tables([a, b])

    result = "token long, count long, doc_id long, row_key long, log_sum double, n_known long"
    found = [c.split()[0] for c in result.split(", ")]
    return _source(docs).mapInArrow(send, schema).groupBy("shard").applyInArrow(add, result)


# -------------------------------------------------------------------- model

class Model:
    """Weights and their use on token streams; small enough to broadcast."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, rare_tokens: int, rare_kinds: int):
        self.head, self.counts, n = head, counts, len(head)
        root = np.sqrt(counts.astype(np.float64))
        share = (np.cumsum(root) - root) / max(1.0, root.sum())
        self.n_classes = CLASSES + 1
        self.class_of = np.r_[np.minimum((share * CLASSES).astype(np.int64), CLASSES - 1), CLASSES]  # the last: all others
        self.starts = np.searchsorted(self.class_of[:n], np.arange(CLASSES + 1))
        mass = np.bincount(self.class_of, weights=np.r_[counts, rare_tokens], minlength=self.n_classes)
        mass[CLASSES] += 1  # tokens never seen in training
        with np.errstate(divide="ignore"):
            self.bias = np.log(mass / mass.sum()).astype(np.float32)  # minus infinity for classes without tokens
        self.word_bias = np.log(np.maximum(counts, 1)).astype(np.float64)
        self.rare = float(rare_tokens + rare_kinds + 1)
        self.weights = np.zeros((3 * BUCKETS, self.n_classes), np.float32)
        self.word_weights = np.zeros((WORD_BUCKETS, n), np.float32)
        self.settle()

    def settle(self) -> None:
        """Log probabilities of the head tokens within their classes, per hashed token before."""
        raw = self.word_bias + self.word_weights
        used = np.unique(self.class_of[:-1])
        norm = np.zeros((WORD_BUCKETS, self.n_classes))
        if len(used):
            top = np.maximum.reduceat(raw, self.starts[used], axis=1)
            total = np.add.reduceat(np.exp(raw - top[:, np.searchsorted(used, self.class_of[:-1])]), self.starts[used], axis=1)
            norm[:, used] = top + np.log(total)
        self.within = np.c_[raw - norm[:, self.class_of[:-1]], np.zeros(WORD_BUCKETS)]

    def features(self, tokens: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``weights`` that are active per token (three columns), and the bucket of the token before."""
        t = tokens.astype(np.uint64) + np.uint64(2)
        one, two = np.r_[np.uint64(0), t[:-1]], np.r_[np.zeros(2, np.uint64), t[:-2]][:len(t)]
        first = np.cumsum(size) - size
        one[first] = 0
        two[first] = 0
        second = (first + 1)[size > 1]
        two[second] = 1
        mix = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        b = np.uint64(BUCKETS)
        rows = np.column_stack([mix(one) % b, mix(two + np.uint64(977)) % b + b, mix(one * np.uint64(1_000_003) + two) % b + b + b])
        return rows.astype(np.int64), (mix(one) % np.uint64(WORD_BUCKETS)).astype(np.int64)

    def class_odds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per token the classes' unnormalized log probabilities and their exponentials (bounded, see ``update``)."""
        z = self.weights[rows[:, 0]]
        z += self.weights[rows[:, 1]]
        z += self.weights[rows[:, 2]]
        z += self.bias
        return z, np.exp(z)

    def log_probability(self, tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Natural log probability per token; of the last class only the class's."""
        rows, before = self.features(tokens, size)
        out = np.empty(len(tokens))
        for i in range(0, len(tokens), BATCH):
            e = slice(i, i + BATCH)
            t = tokens[e].astype(np.int64)
            z, odds = self.class_odds(rows[e])
            out[e] = z[np.arange(len(t)), self.class_of[t]] - np.log(odds.sum(axis=1)) + self.within[before[e], t]
        return out

    def statistics(self, tokens: np.ndarray, size: np.ndarray, sums: dict) -> None:
        """Adds to ``sums`` the counts that it names: those observed, which no weight changes, or those expected."""
        rows, before = self.features(tokens, size)
        if "observed" in sums:
            k, n = self.n_classes, len(self.head)
            t = tokens.astype(np.int64)
            observed = (rows * k + self.class_of[t][:, None]).ravel()
            sums["observed"] += np.bincount(observed, minlength=sums["observed"].size).reshape(-1, k)
            is_head = t < n
            sums["word"] += np.bincount(before[is_head] * n + t[is_head], minlength=sums["word"].size).reshape(-1, n)
        if "expected" not in sums:
            return
        for i in range(0, len(tokens), BATCH):
            r = rows[i:i + BATCH].astype(np.uint16)
            r = r[np.argsort(r[:, 0], kind="stable")]
            _, p = self.class_odds(r)
            p /= p.sum(axis=1, keepdims=True)
            for f in range(3):
                order = np.argsort(r[:, f], kind="stable") if f else slice(None)
                at = r[order, f]
                first = np.nonzero(np.r_[True, at[1:] != at[:-1]])[0]
                sums["expected"][at[first]] += np.add.reduceat(p[order], first, axis=0)

    def zero_sums(self, names: Iterable[str] = ("observed", "expected", "word")) -> dict:
        return {x: np.zeros(self.word_weights.shape if x == "word" else self.weights.shape) for x in names}

    def expected_at_start(self, observed: np.ndarray) -> np.ndarray:
        """The expected counts while all weights are zero: every token then has the same odds, so the tokens that a row
        is active for are all that counts, and each of them is observed in one class."""
        odds = np.exp(self.bias)
        return observed.sum(axis=1, keepdims=True) * (odds / odds.sum())

    def update(self, sums: dict) -> None:
        self.weights += (np.log((sums["observed"] + PRIOR) / (sums["expected"] + PRIOR)) / 3).astype(np.float32)
        np.clip(self.weights, -25, 25, out=self.weights)  # keeps the exponentials in range
        seen = np.zeros((WORD_BUCKETS, self.n_classes))
        for c in np.unique(self.class_of[:-1]).tolist():
            seen[:, c] = sums["word"][:, self.class_of[:-1] == c].sum(axis=1)
        expected = np.exp(self.within[:, :-1]) * seen[:, self.class_of[:-1]]
        self.word_weights += np.log((sums["word"] + PRIOR) / (expected + PRIOR)).astype(np.float32)
        self.settle()


class HeadIndex(dict):
    """Word to its place in the head, or the head's size for all others."""

    def __init__(self, head: np.ndarray):
        super().__init__()
        self.place = {h: i for i, h in enumerate(head.tolist())}

    def __missing__(self, word: bytes) -> int:
        i = self[word] = self.place.get(xxhash.xxh64_intdigest(word, 11), len(self.place))
        return i


def _sums(places: DataFrame, model: Model, counts: Sequence[str]) -> dict:
    """The named counts over all training tokens, added up in levels of ``FAN_IN`` tasks."""
    piece = 1 << 16

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_row = model.zero_sums(counts), False
        for _, size, tokens in place_chunks(batches, CHUNK_TOKENS // 4):
            model.statistics(tokens, size, sums)
            any_row = True
        if any_row:
            task = TaskContext.get().partitionId()
            for name, x in sums.items():
                flat = x.astype(np.float32).ravel()
                parts = [flat[i:i + piece].tobytes() for i in range(0, flat.size, piece)]
                yield pa.RecordBatch.from_arrays([pa.array([task] * len(parts)), pa.array([name] * len(parts)),
                                                  pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], ["task", "name", "part", "sums"])

    def add(kind):
        def run(t: pa.Table) -> pa.Table:
            total = 0
            for x in t["sums"]:
                total = total + np.frombuffer(x.as_py(), kind).astype(np.float64)
            return pa.table({**{c: t[c].slice(0, 1) for c in ("task", "name", "part")}, "sums": pa.array([total.tobytes()], pa.binary())})
        return run

    schema = "task long, name string, part long, sums binary"
    got, kind = places.where(~F.col("held_out")).mapInArrow(gather, schema), np.float32
    for _ in range(LEVELS):
        got = got.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("name", "part", "task").applyInArrow(add(kind), schema)
        kind = np.float64
    sums = model.zero_sums(counts)
    for r in got.groupBy("name", "part").applyInArrow(add(kind), schema).collect():  # as many rows as the model has blocks
        part = np.frombuffer(bytes(r["sums"]))
        sums[r["name"]].reshape(-1)[r["part"] * piece:r["part"] * piece + len(part)] = part
    return sums


def _most_frequent(tokens: DataFrame, head: int) -> list:
    """The ``head`` most frequent tokens (all, if fewer), equal counts by token.

    Three narrowing aggregates, so that no task sends more than about ``head`` rows and flat vocabularies fill the head
    as well: the step (an eighth of an octave) in which the last count lies, that count within the step, and of the
    tokens with just that count, by the leading bits of their hash, those that can still be among the first."""
    step = F.floor(8 * F.log2("count"))
    left, whole = head, None
    for r in tokens.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # some hundreds of steps
        if r["n"] > left:
            whole = r["step"]
            break
        left -= r["n"]
    if whole is None:
        return tokens.orderBy(F.desc("count"), "token").select("token", "count").collect()
    inside = tokens.where(step == whole)
    last = None
    for r in inside.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).collect():  # the counts of one step
        if r["n"] > left:
            last = r["count"]
            break
        left -= r["n"]
    ties = tokens.where(F.col("count") == last)
    lead = F.shiftright("token", 48)  # 65,536 ranges in the order of the tokens
    bound, seen = None, 0
    for r in ties.groupBy(lead.alias("lead")).agg(F.count("*").alias("n")).orderBy("lead").collect():
        bound, seen = r["lead"], seen + r["n"]
        if seen >= left:
            break
    more = ties.where(lead <= bound).orderBy("token").limit(left) if left and bound is not None else ties.limit(0)
    above = tokens.where(F.col("count") > last)
    return [*above.orderBy(F.desc("count"), "token").select("token", "count").collect(), *more.select("token", "count").collect()]


def train(docs: DataFrame, counted: DataFrame, head: int = HEAD, rounds: int = ROUNDS) -> tuple[Model, DataFrame, int, int]:
    """(model, indexed texts, training tokens, distinct training tokens)."""
    tokens = counted.where("token is not null")
    n, v = tokens.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    top = _most_frequent(tokens, head)
    h = np.array([r[0] for r in top], np.int64).view(np.uint64)
    c = np.array([r[1] for r in top], np.int64)
    model = Model(h, c, n - int(c.sum()), v - len(h))
    places = indexed(docs, model)
    seen = _sums(places, model, ("observed", "word")) if len(h) and rounds else {}  # the same in every round
    for i in range(rounds if seen else 0):
        expected = _sums(places, model, ("expected",))["expected"] if i else model.expected_at_start(seen["observed"])
        model.update(seen | {"expected": expected})
    return model, places, n, v


def scores(docs: DataFrame, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per document."""
    counted = cut(token_counts(docs))
    model, places, n, v = train(docs, counted, head, rounds)
    sums = counted.where("token is null").groupBy("doc_id", "row_key").agg(
        F.sum("log_sum").alias("log_sum"), F.sum("n_known").alias("n_known"), F.sum("count").alias("n_all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_log = np.r_[np.log10(model.counts + 1.0), 0.0]
        for rows, size, tokens in place_chunks(batches, CHUNK_TOKENS // 4):
            doc = np.repeat(np.arange(len(size)), size)
            t = tokens.astype(np.int64)
            total = lambda x: pa.array(np.bincount(doc, weights=x, minlength=len(size)))
            yield pa.RecordBatch.from_arrays([
                *(rows.column(i) for i in range(3)), pa.array(size.astype(np.int64)), total(model.log_probability(tokens, size) / np.log(10)),
                total(head_log[t]), total((t == len(model.head)).astype(np.float64))], names)

    schema = "doc_id long, row_key long, held_out boolean, n_tokens long, model_sum double, head_sum double, n_rare double"
    names = [c.split()[0] for c in schema.split(", ")]
    scored = places.mapInArrow(run, schema)
    b = sums.alias("b")
    own = F.col("n_tokens") / F.col("n_all")  # below one only where equal rows share their sums
    return scored.alias("a").join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row_key") == F.col("b.row_key"))).select(
        "a.doc_id", "held_out", "n_tokens", F.expr("n_known * n_tokens div n_all").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_sum") * own - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("model_sum") + F.col("log_sum") * own - F.col("head_sum") - F.col("n_rare") * float(np.log10(model.rare))).alias("score"))
