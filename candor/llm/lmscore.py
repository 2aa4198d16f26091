"""LM scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of orders `order` down to 1 and a uniform share 1/(V+1). The weights
depend on how often the longest context was seen: contexts fall into buckets by the logarithm of their count, and each
bucket's weights are learned by expectation-maximisation on the tokens of held-out training documents (one in DEV),
judged by counts, and shares of the tokens, from which those documents are deleted. The final estimates use all training
counts.

Texts are read once, into blocks of about BLOCK_CHARS characters of whole documents in the order in which a task meets
them, so rows that are alike are dealt out like any others. A block keeps its tokens as numbers beside 64-bit hashes of
its distinct words. It sorts the hashes of its distinct n-grams and sends each shard of the key space its share, with
how often it holds them; the shard adds up equal keys of all blocks and answers every block with totals in the order
asked. So counting and looking up is one exchange, an n-gram that all documents hold costs a row a block and no task
more than its shard, and no model has to fit in memory. Unigrams and bigrams come first. Each longer order has an
exchange of its own, for which a block asks only where both shorter n-grams inside occur twice or more in the whole
table: any other n-gram occurs just here, so its count is known without asking. A block works through SLICE tokens at a
time, so its memory is some dozens of bytes a distinct n-gram.

Defined cases
* null or empty text: the end token alone.
* null id: counts as the empty string in the split, so it is learned from.
* no training document: N = V = 0, every base term is log10(1/1) = 0, and the score is that of the uniform share.
* no held-out training token in a bucket, or none at all: the weights stay equal.
* repeated rows: each is learned from and scored. Empty table: no rows. Only the id is carried over.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_crc, written

ORDER = 3
#: Characters a block holds, or more if its last document is long.
BLOCK_CHARS = 8_000_000
#: Characters whose n-grams a shard adds up, on average.
SHARD_CHARS = 8_000_000
#: Tokens whose n-grams a block sorts at a time.
SLICE = 1 << 19
#: One training document in so many lends its tokens to weight learning.
DEV = 50
BUCKETS = 24
ROUNDS = 15

#: Keys of tokens are odd, keys of longer n-grams and of the mark before a text are even.
_ODD, _EVEN = np.uint64(1), np.uint64(2**64 - 2)
_END, _BEGIN = np.uint64(xxhash.xxh64_intdigest(b"\x00end")) | _ODD, np.uint64(xxhash.xxh64_intdigest(b"\x00begin")) & _EVEN
_MUL, _MUL2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * _MUL + b
    x = (x ^ (x >> np.uint64(32))) * _MUL2
    return (x ^ (x >> np.uint64(29))) & _EVEN


def packed(x: np.ndarray) -> bytes:
    """The numbers byte plane by byte plane, as the high planes are nearly all zero, compressed behind their size."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class _Ids(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Dealer:
    """Gathers the tokens of documents until they are a block."""

    def __init__(self) -> None:
        self.words, self.flat, self.rows, self.sizes, self.chars = _Ids(), [], [], [], 0

    def add(self, row: int, text: bytes) -> None:
        own = np.array(list(map(self.words.__getitem__, text.lower().split())), np.int32)
        self.flat.append(own)
        self.rows.append(row)
        self.sizes.append(len(own) + 1)
        self.chars += len(text) + 1

    def payload(self) -> tuple[bytes, bytes]:
        """Token numbers, and the hashes that they stand for."""
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words)) | _ODD
        return packed(np.concatenate(self.flat).astype("<i4")), packed(hashes.astype("<u8"))


def blocked(docs: DataFrame, id_col: str, text_col: str, train: Column, dev: Column, block_chars: int) -> DataFrame:
    """A row a block: block, dev (all of it is held-out training documents, or nothing), chars, and its documents' ids, train and tokens; written."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(train & dev, F.lit(False)).alias("dev"))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("dev", T.BooleanType()), T.StructField("chars", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("train", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.BinaryType()), T.StructField("tokens", T.BinaryType()), T.StructField("words", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_: dict[bool, Dealer] = {}
        held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}

        def take(which: bool, batch: pa.RecordBatch | None) -> None:
            dealer = open_.get(which)
            if dealer and dealer.rows and batch is not None:
                held[which].append(batch.select([0, 2]).take(pa.array(dealer.rows)))
                dealer.rows = []

        def close(which: bool) -> pa.RecordBatch:
            nonlocal number
            dealer, own = open_.pop(which), pa.Table.from_batches(held[which]).combine_chunks()
            held[which] = []
            tokens, words = dealer.payload()
            whole = [pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(c).combine_chunks() if own.column(c).num_chunks != 1 else own.column(c).chunk(0)) for c in (0, 1)]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([which]), pa.array([dealer.chars], pa.int64()), *whole, pa.array([packed(np.array(dealer.sizes, "<i8"))], pa.binary()), pa.array([tokens], pa.binary()), pa.array([words], pa.binary())], names=schema.names)

        for batch in batches:
            texts, devs = batch.column(1).cast(pa.large_binary()), batch.column(3).to_pylist()
            for i, which in enumerate(devs):
                dealer = open_.setdefault(which, Dealer())
                dealer.add(i, texts[i].as_py())
                if dealer.chars >= block_chars:
                    take(which, batch)
                    yield close(which)
            for which in (False, True):
                take(which, batch)
        for which in list(open_):
            yield close(which)

    return written(rows.mapInArrow(run, schema), "lm-blocks")


class Block:
    """The tokens of a block: line holds the documents one after the other, each behind order - 1 marks of its beginning."""

    def __init__(self, table: pa.Table, order: int):
        row = table.slice(0, 1)
        self.order, self.dev = order, bool(row["dev"][0].as_py())
        self.ids, self.trained = row["ids"].combine_chunks().flatten(), pc.list_flatten(row["train"]).combine_chunks()
        sizes = unpacked(row["sizes"][0].as_py(), "<i8")  # tokens of each document, its end counted
        words = unpacked(row["words"][0].as_py(), "<u8")
        self.kinds = np.append(words, [_END, _BEGIN])
        self.ends = np.cumsum(sizes)
        self.first = self.ends - sizes
        pad, n = order - 1, len(sizes)
        self.line = np.full(int(self.ends[-1]) + pad * n, len(words) + 1, np.int32)
        self.token = np.ones(len(self.line), bool)
        starts = self.first + pad * np.arange(n)
        for p in range(pad):
            self.token[starts + p] = False
        last = self.ends + pad * np.arange(1, n + 1) - 1
        self.token[last] = False
        self.line[self.token] = unpacked(row["tokens"][0].as_py(), "<i4")
        self.line[last] = len(words)
        self.token[last] = True
        self.learned = np.repeat(self.trained.to_numpy(zero_copy_only=False).astype(bool), sizes)

    def slices(self) -> Iterator[tuple[int, int, slice]]:
        """From and to in the line, and the tokens between."""
        done, pad = 0, self.order - 1
        for a in range(pad, len(self.line), SLICE):
            b = min(a + SLICE, len(self.line))
            n = int(np.count_nonzero(self.token[a:b]))
            yield a, b, slice(done, done + n)
            done += n

    def grams(self, k: int, a: int, b: int) -> np.ndarray:
        """Keys of the k-grams that end in the tokens between a and b."""
        spelled = self.kinds[self.line[a - k + 1 : b]]
        rolled = spelled
        for i in range(1, k):
            rolled = _mixed(rolled[:-1], spelled[i:])
        return rolled[self.token[a:b]]

    def distinct(self, levels: tuple[int, ...], alive: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of the n-grams (of the living tokens), how often each occurs, and how often in training documents."""
        parts = []
        for a, b, own in self.slices():
            for k in levels:
                keys, learned = self.grams(k, a, b), self.learned[own]
                if alive is not None:
                    keys, learned = keys[alive[own]], learned[alive[own]]
                parts.append(_added_up(keys, np.ones(len(keys), np.int32), learned.astype(np.int32)))
        return parts[0] if len(parts) == 1 else _added_up(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def totals(self, k: int, alive: np.ndarray | None, keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        """What stands beside its k-gram's key, for every (living) token in order."""
        out = [[] for _ in values]
        for a, b, own in self.slices():
            of = self.grams(k, a, b)
            at = _places(keys, of if alive is None else of[alive[own]])
            for found, value in zip(out, values, strict=True):
                found.append(value[at])
        return [np.concatenate(x) for x in out]

    def before(self, x: np.ndarray, at_first: int) -> np.ndarray:
        """Of each token the value of the one before it in the document."""
        out = np.concatenate([x[:1], x[:-1]])
        out[self.first] = at_first
        return out


def _added_up(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], *[np.add.reduceat(v[order], starts) for v in values]


def _places(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Where each key stands among the sorted distinct keys. Looking up in order is far faster than at random."""
    order = np.argsort(of)
    out = np.empty(len(of), np.int64)
    out[order] = np.searchsorted(keys, of[order])
    return out


def _shards(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's share of the sorted keys begins."""
    edges = np.array([(s << 64) // shards for s in range(shards)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


@dataclass(frozen=True)
class Corpus:
    """Documents and tokens: of all training documents, of those that are not held out, and distinct training tokens."""

    documents: int
    kept_documents: int
    n: int = 0
    kept_n: int = 0
    v: int = 0


@dataclass(frozen=True)
class Mixture:
    order: int
    corpus: Corpus
    weights: np.ndarray  # buckets x (order + 1), from the uniform share up


def _levels(order: int) -> list[tuple[int, ...]]:
    """The orders that each exchange counts."""
    return [tuple(range(1, min(order, 2) + 1)), *((k,) for k in range(3, order + 1))]


def _looked_up(block: Block, answers: pa.Table, stages: int, column: str) -> tuple[list[np.ndarray], np.ndarray | None]:
    """Counts of the tokens' n-grams by order, as far as the first stages tell, and the tokens whose next longer n-gram has to be asked for."""
    found, alive = [], None
    by = answers.sort_by([("stage", "ascending"), ("shard", "ascending")])
    number = by["stage"].to_numpy()
    for stage, levels in enumerate(_levels(block.order)[:stages]):
        own = by.filter(pa.array(number == stage))
        keys = block.distinct(levels, alive)[0]
        told = np.concatenate([unpacked(x.as_py(), "<u8") for x in own[column]] or [np.zeros(0, np.uint64)]).astype(np.int64)
        alone = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8))[:n] for x, n in zip(own["alone"], own["n"].to_pylist(), strict=True)] or [np.zeros(0, np.uint8)]).astype(bool)
        for k in levels:
            count, single = block.totals(k, alive, keys, told, alone)
            if alive is not None:
                # an n-gram that is not asked for stands here and nowhere else
                whole, whole_single = (block.learned & (column == "every")).astype(np.int64), np.ones(len(alive), bool)
                whole[alive], whole_single[alive] = count, single
                count, single = whole, whole_single
            found.append(count)
        alive = ~single & ~block.before(single, 0)
    return found, alive


def _requests(order: int, stage: int, shards: int) -> Callable[[pa.Table, pa.Table | None], pa.Table]:
    def run(table: pa.Table, answers: pa.Table | None) -> pa.Table:
        block = Block(table, order)
        alive = _looked_up(block, answers, stage, "every")[1] if stage else None
        keys, seen, learned = block.distinct(_levels(order)[stage], alive)
        cuts = _shards(keys, shards)
        full = [s for s in range(shards) if cuts[s + 1] > cuts[s]]
        part = lambda x: pa.array([packed(x[cuts[s] : cuts[s + 1]].astype("<u4")) for s in full], pa.binary())
        steps = pa.array([packed(np.diff(keys[cuts[s] : cuts[s + 1]], prepend=np.uint64(0)).astype("<u8")) for s in full], pa.binary())
        return pa.table({"shard": pa.array(full, pa.int32()), "block": pa.array([table["block"][0].as_py()] * len(full), pa.int64()), "dev": pa.array([block.dev] * len(full), pa.bool_()), "keys": steps, "seen": part(seen), "learned": part(learned)})

    return run


def _answer(table: pa.Table) -> pa.Table:
    """A shard's totals for every block: over all training documents, for held-out blocks also over those not held out, and whether the n-gram occurs once only.

    The first row also has the shard's training tokens, those of them not held out, and distinct ones.
    """
    parts = [np.cumsum(unpacked(k.as_py(), "<u8"), dtype=np.uint64) for k in table["keys"]]
    seen, learned = (np.concatenate([unpacked(x.as_py(), "<u4") for x in table[c]]) for c in ("seen", "learned"))
    dev = table["dev"].to_numpy(zero_copy_only=False)
    sizes = np.array([len(p) for p in parts])
    asked = np.concatenate(parts)
    del parts
    keys = _added_up(asked)[0]
    at = _places(keys, asked)
    del asked
    every = np.bincount(at, learned, len(keys)).astype(np.int64)
    kept = np.bincount(at, np.where(np.repeat(dev, sizes), 0, learned), len(keys)).astype(np.int64)
    alone = np.bincount(at, seen, len(keys)) < 2
    token = (keys & _ODD) == _ODD
    ends = np.cumsum(sizes)
    pieces = [at[e - k : e] for e, k in zip(ends, sizes, strict=True)]
    first = lambda x: pa.array([int(x), *[0] * (len(pieces) - 1)], pa.int64())
    return pa.table({
        "shard": table["shard"], "block": table["block"], "dev": table["dev"], "n": pa.array(sizes, pa.int64()), "every": pa.array([packed(every[p].astype("<u8")) for p in pieces], pa.binary()),
        "kept": pa.array([packed(kept[p].astype("<u8")) if d else None for p, d in zip(pieces, dev, strict=True)], pa.binary()), "alone": pa.array([np.packbits(alone[p]).tobytes() for p in pieces], pa.binary()),
        "tokens": first(every[token].sum()), "kept_tokens": first(kept[token].sum()), "kinds": first((every[token] > 0).sum()),
    })


def _log_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1)


def _estimates(block: Block, counts: list[np.ndarray], documents: int, n: int, v: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """SLICE tokens at a time: probabilities by order, uniform first (rows), and the bucket of each token. The longest context decides the bucket."""
    contexts = [block.before(c, documents) for c in counts[:-1]]
    for a in range(0, len(counts[0]), SLICE):
        own, before = [c[a : a + SLICE] for c in counts], [c[a : a + SLICE] for c in contexts]
        rows = [np.full(len(own[0]), 1 / (v + 1)), own[0] / max(n, 1)]
        rows += [np.where(c > 0, k / np.maximum(c, 1), 0.0) for k, c in zip(own[1:], before, strict=True)]
        yield np.array(rows), _log_bucket(before[-1]) if before else np.zeros(len(own[0]), np.int64)


def count_grams(blocks: DataFrame, order: int, shard_chars: int) -> tuple[DataFrame, Corpus]:
    """What the shards answer the blocks, by stage, and the size of the corpus."""
    trained = F.size(F.filter("train", lambda x: x))
    size, documents, kept = blocks.agg(F.sum("chars"), F.sum(trained), F.sum(F.when(~F.col("dev"), trained))).first()
    answers, corpus = None, Corpus(documents or 0, kept or 0)
    for stage, levels in enumerate(_levels(order)):
        shards = 1 + (size or 0) * len(levels) // (2 * shard_chars)
        ask = _requests(order, stage, shards)
        schema = "shard int, block long, dev boolean, keys binary, seen binary, learned binary"
        if answers is None:
            asked = blocks.mapInArrow(_each(ask), schema)
        else:
            asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, schema)
        told = "shard int, block long, dev boolean, n long, every binary, kept binary, alone binary, tokens long, kept_tokens long, kinds long"
        new = written(asked.groupBy("shard").applyInArrow(_answer, told), "ngram-answers")
        if answers is None:
            corpus = Corpus(documents or 0, kept or 0, *(x or 0 for x in new.agg(F.sum("tokens"), F.sum("kept_tokens"), F.sum("kinds")).first()))
        new = new.select(F.lit(stage).alias("stage"), "shard", "block", "dev", "n", "every", "kept", "alone")
        answers = new if answers is None else answers.union(new)
    return answers, corpus


def _each(f: Callable[[pa.Table, pa.Table | None], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from f(pa.Table.from_batches([batch.slice(i, 1)]), None).to_batches()

    return run


def learn_weights(dev: DataFrame, answers: DataFrame, corpus: Corpus, order: int, rounds: int) -> np.ndarray:
    """Expectation-maximisation over held-out tokens; Spark adds up every round by bucket."""
    weights = np.full((BUCKETS, order + 1), 1 / (order + 1))

    def situations(_key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(own, order)
        counts, _ = _looked_up(block, answers, len(_levels(order)), "kept")
        told = [pa.table({"bucket": bucket.astype(np.int32), **{f"p{k}": p[k] for k in range(order + 1)}}) for p, bucket in _estimates(block, counts, corpus.kept_documents, corpus.kept_n, corpus.v)]
        return pa.concat_tables(told)

    schema = "bucket int, " + ", ".join(f"p{k} double" for k in range(order + 1))
    seen = written(dev.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(situations, schema), "held-out")
    for _ in range(rounds):
        lam = [F.get(F.array(*[F.lit(float(x)) for x in weights[:, k]]), F.col("bucket")) for k in range(order + 1)]
        parts = seen.select("bucket", *[(w * F.col(f"p{k}")).alias(f"m{k}") for k, w in enumerate(lam)])
        total = sum((F.col(f"m{k}") for k in range(1, order + 1)), F.col("m0"))
        sums = parts.groupBy("bucket").agg(*[F.sum(F.col(f"m{k}") / total).alias(f"s{k}") for k in range(order + 1)]).collect()  # at most BUCKETS rows
        last = weights.copy()
        for r in sums:
            s = np.array([r[f"s{k}"] for k in range(order + 1)])
            weights[r["bucket"]] = s / s.sum()
        if np.abs(weights - last).max() < 1e-4:
            break
    # a share of nothing for the uniform part would make unseen words impossible
    weights[:, 0] = np.maximum(weights[:, 0], 1e-6)
    return weights / weights.sum(axis=1, keepdims=True)


def score(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, dev: Column | None = None, block_chars: int = BLOCK_CHARS, shard_chars: int = SHARD_CHARS, rounds: int = ROUNDS) -> DataFrame:
    """The id, train, n_tokens, n_known, train_tokens, base_score and score of every row."""
    dev = F.pmod(F.floor(doc_crc(F.col(id_col)) / 7), F.lit(DEV)) == 0 if dev is None else dev
    blocks = blocked(docs, id_col, text_col, train, dev, block_chars)
    answers, corpus = count_grams(blocks, order, shard_chars)
    mixture = Mixture(order, corpus, learn_weights(blocks.filter("dev"), answers.filter("dev"), corpus, order, rounds))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, t) for c, t in (("train", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())))])

    def judge(_key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(own, mixture.order)
        counts, _ = _looked_up(block, answers, len(_levels(mixture.order)), "every")
        known, n, v = counts[0], mixture.corpus.n, mixture.corpus.v
        base = np.log10((known + 1) / (n + 1 * (v + 1)))
        mixed = np.concatenate([np.log10((mixture.weights[bucket].T * p).sum(axis=0)) for p, bucket in _estimates(block, counts, mixture.corpus.documents, n, v)])
        sums = [np.add.reduceat(x, block.first) for x in ((known > 0).astype(np.int64), base, mixed)]
        return pa.table([block.ids, block.trained, pa.array(np.diff(block.ends, prepend=0)), pa.array(sums[0]), pa.array(np.full(len(block.ids), n)), pa.array(sums[1]), pa.array(sums[2])], names=schema.names)

    return blocks.drop("chars").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, schema)


def perplexity(log10_score: float, tokens: int) -> float:
    return math.pow(10, -log10_score / tokens)
