"""Best-fit packing: bin completion by branch and bound.

Documents become token pieces of at most `capacity` tokens, and pieces fill sequences of `capacity` tokens. How a
sequence is filled depends on lengths alone, and there are at most `capacity` different lengths, so the search runs
over the histogram of lengths: it is as small for 100 TB as for one file. Its result is a list of fillings with how
often each is used; every piece then finds its place from its rank among the pieces of its length.

The search takes the largest length left and a filling around it. A first pass tries a few fillings that no other
dominates, fullest first, each as often as the counts allow; a second pass tries all fillings to which no piece can be
added, each as often as the counts allow, once less, and half as often; a third does so too but leaves at least half of
the decisions for the other choices of each step, so that the first steps are varied as well. A branch ends where its sequences plus the least
that the rest can take reach the incumbent. The first incumbent is the best-fit-decreasing solution; a pass ends when the
lower bound is met or after NODES decisions, so the result is never worse than best fit.

Defined cases
* null or empty text: the end token alone, one piece of length 1.
* very long text: cut into pieces of `capacity` tokens, the last may be shorter.
* repeated rows, null ids: every row is packed; ties between equal rows go to any of them.
* empty table: no rows. Only the id is carried over, so other columns cannot clash.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXT_BYTES, released, sized_broadcast, written

CAPACITY = 2048
#: Decisions of the search after which the incumbent stands.
NODES = 4000
#: Fillings tried around a largest length in the first pass.
WIDTH = 6
#: Steps of enumerating fillings in the second pass, a decision.
STEPS = 250
#: Pieces of a length are ranked in parts of about so many, so a length that most pieces share is no single task.
RANKED = 1000
#: Parts of texts whose ids a worker remembers.
CACHED = 700_000
#: Bytes of text that are tokenized at a time, where no single text is longer; beside the words met, a worker needs some 70 times as many.
SLICE_CHARS = 1 << 19


# How one vocabulary's file says that it normalizes and splits texts.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PARTS = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
#: What that comes to for lower-cased Latin-1 text; each part is encoded by itself.
_SPLIT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\s\x85\xa00-9a-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\xff]+").findall
_DIGITS = {bytes([b]) for b in b"0123456789\xb2\xb3\xb9\xbc\xbd\xbe"}
_LOWER = bytes(ord(c.lower()) for c in map(chr, range(256)))


class _Parts(dict):
    """Token ids, as little-endian 32-bit integers, of the parts met so far.

    Where the vocabulary's file says that it splits texts as _SPLIT does, Latin-1 texts without special tokens are split
    here; parts not met before are encoded together, as one text. Any other text, and every text of another vocabulary,
    goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._encode = lambda texts: tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        told = json.loads(tokenizer.to_str())
        first = (told["pre_tokenizer"] or {}).get("pretokenizers", [None])[0]
        self._splits = told["normalizer"] == _NORMALIZER and first == _PARTS and all(t["content"].startswith("<|") for t in told["added_tokens"])
        if self._splits:
            (self._zero,) = self._encode(["0"])[0].ids

    def tokenize(self, texts: list[str]) -> list[bytes]:
        if not self._splits:
            return [np.array(got.ids, "<u4").tobytes() for got in self._encode(texts)]
        split, whole = [], []
        for i, text in enumerate(texts):
            try:
                plain = text.encode("latin-1").translate(_LOWER)
            except UnicodeEncodeError:
                plain = None
            if plain is None or b"<|" in plain:
                whole.append(i)
                split.append([])
            else:
                split.append(_SPLIT(plain))
        if len(self) > CACHED:
            self.clear()
        parts = list(chain.from_iterable(split))
        ids = list(map(self.get, parts))
        holes, at = [], -1
        for _ in range(ids.count(None)):
            at = ids.index(None, at + 1)
            holes.append(at)
        if holes:
            self._learn(list({parts[i] for i in holes}))
            for i in holes:
                ids[i] = self[parts[i]]
        out = [b"".join(ids[s:e]) for s, e in pairwise(accumulate(map(len, split), initial=0))]
        for i, got in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = np.array(got.ids, "<u4").tobytes()
        return out

    def _learn(self, new: list[bytes]) -> None:
        """Encodes the parts with a 0 between them: its token is part of no other part."""
        digits, words = [p for p in new if p in _DIGITS], [p for p in new if p not in _DIGITS]
        for part, got in zip(digits, self._encode([p.decode("latin-1") for p in digits]), strict=True):
            self[part] = np.array(got.ids, "<u4").tobytes()
        ids = np.array(self._encode([" 0 ".join([w.decode("latin-1") for w in words]) + " 0"])[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self._zero)
        starts, flat = (4 * np.append(0, cuts[:-1] + 1)).tolist(), ids.tobytes()
        self.update(zip(words, [flat[s:e] for s, e in zip(starts, (4 * cuts).tolist(), strict=True)], strict=bool(words)))


#: By path; a worker process keeps the tokenizers from task to task, and the parts that it has met for a task.
_KNOWN: dict[str, _Parts] = {}


def known_parts(path: str) -> _Parts:
    if path not in _KNOWN:
        _KNOWN[path] = _Parts(path)
    return _KNOWN[path]


def cut(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: the id, piece, start, length, tokens (little-endian unsigned 32-bit ids)."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("tokens", T.BinaryType())])
    mark = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = known_parts(tokenizer_path)
        for batch in batches:
            texts = batch.column(1)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.flatnonzero(np.diff(sizes // SLICE_CHARS, prepend=0)) + 1
            for at, end in pairwise(sorted({0, *cuts.tolist(), batch.num_rows})):
                row, number, length, tokens = [], [], [], []
                for i, ids in enumerate(parts.tokenize([t.as_py() or "" for t in texts[at:end]]), at):
                    ids += mark
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        row.append(i)
                        number.append(k)
                        tokens.append(ids[s : s + 4 * capacity])
                        length.append(len(tokens[-1]) // 4)
                n = np.array(number, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(n), pa.array(n.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(tokens, pa.binary())], names=schema.names)
        parts.clear()  # the worker waits for its next task beside others, which need the memory
        released()

    return docs.select(id_col, text_col).mapInArrow(pieces, schema)


@dataclass(frozen=True)
class Plan:
    """Fillings (lengths, largest first) with how many sequences use each."""

    fillings: list[tuple[tuple[int, ...], int]]
    capacity: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.fillings)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: equal sequences are filled together."""
    open_by_room: dict[int, Counter] = defaultdict(Counter)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r, c in open_by_room.items() if r >= length and c), default=None)
            if room is None:
                here, have, room = (), left, capacity
            else:
                here, have = next(iter(open_by_room[room].items()))
            each = min(room // length, left)
            use = min(have, left // each)
            if here:
                open_by_room[room][here] -= use
                open_by_room[room] += Counter()  # drops zeros
                if not open_by_room[room]:
                    del open_by_room[room]
            open_by_room[room - each * length][here + (length,) * each] += use
            left -= use * each
    return [(f, n) for c in open_by_room.values() for f, n in c.items()]


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """Waste bound: what the total needs, and what pieces over half a sequence leave unusable for pieces of at least k."""
    sizes = np.arange(capacity + 1)
    weight = counts * sizes
    best, half = -(-int(weight.sum()) // capacity), capacity // 2
    cum_n, cum_w = np.cumsum(counts), np.cumsum(weight)
    for k in range(1, half + 1):
        alone = int(cum_n[capacity] - cum_n[capacity - k])
        big_n, big_w = int(cum_n[capacity - k] - cum_n[half]), int(cum_w[capacity - k] - cum_w[half])
        small = int(cum_w[half] - cum_w[k - 1])
        best = max(best, alone + big_n + max(0, -(-(small - (big_n * capacity - big_w)) // capacity)))
    return best


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether b's pieces fit into a's places: then a, which leaves the smaller pieces for later, is at least as good."""
    room = sorted(a)
    for x in b:
        at = next((i for i, r in enumerate(room) if r >= x), None)
        if at is None:
            return False
        room[at] -= x
    return True


def fillings(counts: np.ndarray, first: int, capacity: int) -> list[tuple[int, ...]]:
    """Undominated ways to fill up around the largest length, fullest first, at most WIDTH."""
    room = capacity - first

    def complete(r: int, top: int, used: Counter) -> tuple[int, ...]:
        """Fills r with lengths of at most top: exactly by one or two if it can, else by the largest that fits."""
        got: list[int] = []
        while r > 0:
            top = min(top, r)
            if top == r and counts[r] > used[r]:
                return (*got, r)
            lens = np.nonzero(counts[: top + 1])[0]
            lens = lens[lens > 0]
            pair = lens[(lens >= r - lens) & (lens < r)]
            pair = pair[counts[r - pair] > 0][::-1]
            for x in pair[:WIDTH].tolist():
                need = used + Counter((x, r - x))
                if counts[x] >= need[x] and counts[r - x] >= need[r - x]:
                    return (*got, x, r - x)
            x = next((v for v in lens[::-1].tolist() if counts[v] > used[v]), 0)
            if not x:
                break
            k = int(min(max(1, r // x - 1), counts[x] - used[x]))
            got += [x] * k
            used = used + Counter({x: k})
            r -= k * x
            top = x
        return tuple(got)

    start = Counter((first,))
    if room and counts[room] > start[room]:
        return [(first, room)]
    found = {complete(room, room, start)}
    lens = np.nonzero(counts[: room + 1])[0]
    for x in lens[lens > 0][::-1][: 2 * WIDTH].tolist():
        if counts[x] > start[x]:
            found.add((x, *complete(room - x, x, start + Counter((x,)))))
    kept: list[tuple[int, ...]] = []
    for f in sorted(found, key=lambda f: (-sum(f), tuple(-x for x in f))):
        if len(kept) < WIDTH and not any(_dominates(k, f) for k in kept):
            kept.append(f)
    return [(first, *sorted(f, reverse=True)) for f in kept]


def every_filling(counts: np.ndarray, first: int, capacity: int, steps: Iterator[int]) -> Iterator[tuple[int, ...]]:
    """All ways to fill up around a largest length to which no piece can be added, while there are steps."""
    room = capacity - first
    lens = [int(x) for x in np.nonzero(counts[: room + 1])[0][::-1] if x]
    have = {x: int(counts[x]) - (x == first) for x in lens}
    rest = [*accumulate((x * have[x] for x in reversed(lens)), initial=0)][::-1]

    def go(i: int, r: int, got: tuple[int, ...], spare: int) -> Iterator[tuple[int, ...]]:
        """spare: the least length passed by of which a piece is left."""
        for j in range(i, len(lens)):
            x = lens[j]
            if r - rest[j] >= spare or next(steps, None) is None:
                return
            if x > r or not have[x]:
                continue
            for k in range(min(r // x, have[x]), 0, -1):
                yield from go(j + 1, r - k * x, got + (x,) * k, x if k < have[x] else spare)
            spare = x
        if r < spare:
            yield got

    return go(0, room, (first,), capacity + 1)


def _choices(counts: np.ndarray, first: int, capacity: int, steps: Iterator[int] | None) -> Iterator[tuple[tuple[int, ...], int]]:
    """Fillings around the largest length with how often to use them; with steps all of them, and also fewer times than counts allow."""
    few = fillings(counts, first, capacity)
    exact = len(few[0]) <= 2 and sum(few[0]) == capacity  # as good as any other, as often as it can be had
    for f in few if exact or not steps else chain(few, (f for f in every_filling(counts, first, capacity, steps) if f not in few)):
        most = min(int(counts[x]) // k for x, k in Counter(f).items())
        for times in [most] if exact or not steps else sorted({most, most - 1, most // 2} - {0}, reverse=True):
            yield f, times


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Branch and bound over the histogram: first over few fillings, then over all, then over all with the decisions shared out."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    done = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    best = best_fit({int(k): int(left[k]) for k in np.nonzero(left)[0]}, capacity)
    least = least_sequences(left, capacity)
    for every, shared in ((False, False), (True, False), (True, True)):
        best = _search(left.copy(), capacity, best, least, nodes, iter(range(STEPS * nodes)) if every else None, shared)
    return Plan(done + best, capacity)


def _search(left: np.ndarray, capacity: int, best: list[tuple[tuple[int, ...], int]], least: int, nodes: int, steps: Iterator[int] | None, shared: bool) -> list[tuple[tuple[int, ...], int]]:
    """The incumbent, or what at most `nodes` decisions find that is better; if shared, no decision has more than half of those left for what follows it."""
    best_n, total = sum(n for _, n in best), int((left * np.arange(capacity + 1)).sum())
    path: list[tuple[tuple[int, ...], int]] = []
    stack: list[Iterator[tuple[tuple[int, ...], int]]] = []
    ends: list[int] = []
    used = seen = 0
    down = True
    while best_n > least and seen < nodes:
        if down:
            if not total:
                if used < best_n:
                    best_n, best = used, list(path)
                down = False
                continue
            stack.append(iter(()) if used + -(-total // capacity) >= best_n else _choices(left, int(np.nonzero(left)[0][-1]), capacity, steps))
            ends.append((seen + ends[-1] + 1) // 2 if shared and ends else nodes)
        if not stack:
            break
        if not down and len(path) == len(stack):
            filling, times = path.pop()
            for x, k in Counter(filling).items():
                left[x] += k * times
            used -= times
            total += times * sum(filling)
        filling, times = next(stack[-1], ((), 0)) if seen < ends[-1] else ((), 0)
        if not times:
            stack.pop()
            ends.pop()
            down = False
            continue
        for x, k in Counter(filling).items():
            left[x] -= k * times
        used += times
        total -= times * sum(filling)
        path.append((filling, times))
        seen += 1
        down = True
    return best


def _slots(plan: Plan) -> pa.Table:
    """A row a filling and length in it: the ranks it takes, its first sequence, pieces a sequence, and first offset."""
    rows: list[tuple[int, ...]] = []
    rank: Counter = Counter()
    base = 0
    for filling, times in plan.fillings:
        offset = 0
        for x, k in sorted(Counter(filling).items(), reverse=True):
            rows.append((x, rank[x], rank[x] + k * times, base, k, offset))
            rank[x] += k * times
            offset += x * k
        base += times
    names = ["_length", "_from", "_to", "_base", "_each", "_at"]
    return pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})


def assign(pieces: DataFrame, *, capacity: int = CAPACITY, nodes: int = NODES, ranked: int = RANKED) -> DataFrame:
    """The pieces (any frame with a length from 1 to capacity) with sequence_id and offset. Written once to the shared folder."""
    pieces = written(pieces.drop("sequence_id", "offset"), "pieces", batch_bytes=TEXT_BYTES)
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = plan_sequences(histogram, capacity, nodes)
    # a piece that fills a sequence needs no rank, only a number beyond those of the plan
    full = pieces.filter(F.col("length") == capacity).select(*pieces.columns, (F.monotonically_increasing_id() + plan.sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # split() and the cast fold to one literal array: of each length, in how many parts it is ranked
    salts = F.get(F.split(F.lit(",".join(str(1 + histogram.get(x, 0) // ranked) for x in range(capacity + 1))), ",").cast("array<long>"), F.col("length").cast("int"))
    salted = pieces.filter(F.col("length") < capacity).withColumn("_salt", F.pmod(F.xxhash64(*pieces.columns), salts).cast("long"))
    counted = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    by_length = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("length", "_salt", F.coalesce(F.sum("_n").over(by_length), F.lit(0)).alias("_before"))
    before = sized_broadcast(written(before, "ranks-before"), 40)  # a row a length, and one more for each `ranked` pieces
    # a row for each length of each filling, of which a plan over so few lengths has thousands at most
    slots = F.broadcast(pieces.sparkSession.createDataFrame(_slots(plan)))
    within = Window.partitionBy("length", "_salt").orderBy(F.xxhash64(*pieces.columns), *[c for c in pieces.columns if c != "length"])
    placed = salted.withColumn("_rank", F.row_number().over(within)).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_rank") - 1)
    placed = placed.join(slots, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    nth = F.col("_rank") - F.col("_from")
    placed = placed.select(*pieces.columns, (F.col("_base") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"), (F.col("_at") + nth % F.col("_each") * F.col("length")).alias("offset"))
    return placed.union(full)


def pack(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES) -> DataFrame:
    """All documents as pieces with their tokens, sequence and place in it."""
    return assign(cut(docs, tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), capacity=capacity, nodes=nodes)
