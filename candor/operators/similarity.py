"""The most similar other review of the same group, by TF-IDF terms or by embedding.

Nothing is compared on the driver, and no pair of texts is a row. Identical texts are folded into one, and a text's terms
are made once, however many groups it stands in. Groups whose terms fit TERMS are dealt out to tasks by their key, and a
task gets each text that its groups need once, not once a group; where even so many terms must travel, keys take turns, so
that the disk in use does not grow with the rows. A larger group is cut into blocks; its terms are counted slice by slice, and
a task has one block meet others, one at a time, so its memory does not depend on the group. Inside, terms that many texts share
are multiplied as dense columns, the others by their holders.
Vectors are compared by blocks of BLOCK rows in the same way; few vectors that many rows share go to every task once. The work of comparing stays quadratic in a group, as that of
any exact answer that looks at all of its pairs.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.sources.staging import BROADCAST_BYTES, sized_broadcast, written

TOKEN = r"(?U)\b\w\w+\b"
BLOCK = 1024
#: Terms, repeats counted, of a group that one task may hold with others.
TERMS = 1 << 21
#: Texts of a block of a larger group, on average, and its terms as a multiple of TERMS: with another block some 300 MB in a worker.
TEXTS, MORE_TERMS = 1 << 14, 2
#: Texts of a block that are compared at a time; frequent terms by which a block's texts are put in order, and kinds of texts told apart.
TILE, TELLING, KINDS = 1 << 11, 128, 8
#: Blocks that a block meets in a task, slices of a group's terms for each of its blocks, and bytes of blocks that travel at a time.
STRIP, SLICES, SENT = 8, 4, 1 << 29
#: Products of terms that are made at a time: they stay in a core's cache.
PRODUCTS = 1 << 18
#: Terms of the different texts of a task, and of the slice of them that it looks at, repeats counted: some 200 MB in a worker.
HELD, SLICE = 1 << 23, 1 << 22
#: Rows of a task, on average, and the least that are worth a task of their own.
ROWS, LEAST_ROWS = 1 << 19, 1 << 12
#: Pairs of texts of a task, 8 bytes each, on average.
SUMS = 1 << 22
#: Terms that travel at a time, 8 bytes each, or half of all texts' terms if those are more.
ROUND = 1 << 26
#: Places of a group's dense columns.
WIDE = 1 << 21


def terms(text: Column) -> Column:
    """Lower-case words of two characters or more, and pairs of neighbours."""
    return _of_words(text, lambda words, first, second: F.concat(words, F.zip_with(first, second, lambda a, b: F.concat_ws(" ", a, b))))


def _of_words(text: Column, f: Callable[[Column, Column, Column], Column]) -> Column:
    """f of a text's words, and of the first and second words of its pairs of neighbours. The words are bound to a variable, so they are found once."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))

    def bound(w: Column) -> Column:
        pairs = F.greatest(F.size(w) - 1, F.lit(0))
        return f(w, F.slice(w, F.lit(1), pairs), F.slice(w, F.lit(2), pairs))

    return F.element_at(F.transform(F.array(words), bound), 1)


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every element."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return np.repeat(np.arange(len(sizes)), sizes), pc.list_flatten(lists).to_numpy()


def products(own: tuple[np.ndarray, np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, m: int) -> np.ndarray:
    """Dot products (n x m) of sparse rows, given as (row, term, weight), each sorted by term."""
    shared = np.intersect1d(own[1], other[1])
    sides = []
    for r, t, w in (own, other):
        keep = np.isin(t, shared)
        sides.append((r[keep], np.searchsorted(shared, t[keep]), w[keep]))
    return _numbered_products(*sides, *(np.bincount(t, minlength=len(shared)) for _, t, _ in sides), n, m)


def _numbered_products(own: tuple, other: tuple, c1: np.ndarray, c2: np.ndarray, n: int, m: int) -> np.ndarray:
    """products, with terms numbered from 0; c1, c2: the rows that have each."""
    out = np.zeros((n, m))
    (r1, t1, w1), (r2, t2, w2) = own, other
    dense = c1.astype(np.int64) * c2 * 200 >= max(1, n * m)  # a product of dense columns is some hundred times cheaper than one by holders
    many = np.flatnonzero(dense)
    if len(many):
        place = np.full(len(dense), -1, np.int32)
        place[many] = np.arange(len(many), dtype=np.int32)
        sides = [(r[here], at[here], w[here]) for r, t, w in (own, other) for at in [place[t]] for here in [np.flatnonzero(at >= 0)]]
        for s in range(0, len(many), 1024):
            wides = []
            for (r, at, w), k in zip(sides, (n, m), strict=True):
                wide, i = np.zeros((k, min(1024, len(many) - s))), slice(*np.searchsorted(at, [s, s + 1024]))
                wide[r[i], at[i] - s] = w[i]
                wides.append(wide)
            out += wides[0] @ wides[1].T
    each = np.where(dense, 0, c2)[t1]
    left = np.flatnonzero(each)
    left = left[np.argsort(r1[left].astype(np.min_scalar_type(max(n, 1))), kind="stable")]  # by row, so that a part's sums lie close together
    first, each, row, w1 = (np.cumsum(c2) - c2)[t1[left]], each[left], r1[left].astype(np.int64), w1[left]
    ends, r2 = np.cumsum(each), r2.astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // PRODUCTS)) + 1).tolist(), len(left)]
    for s, e in zip(cuts, cuts[1:], strict=False):
        if s < e:
            k, low, high = each[s:e], row[s], row[e - 1] + 1
            j = np.repeat(first[s:e] - (ends[s:e] - k - ends[s] + k[0]), k)
            j += np.arange(len(j))
            at = r2[j]
            at += np.repeat((row[s:e] - low) * m, k)
            w = w2[j]
            w *= np.repeat(w1[s:e], k)
            out[low:high] += np.bincount(at, w, (high - low) * m).reshape(-1, m)
    return out


class Groups:
    """Whole groups: the products of their texts' weights, summed up over slices of the terms, and the similarities that follow."""

    def __init__(self, rows: pa.Table):
        """rows: key, id, copy."""
        self.ids, names = rows["id"], rows["copy"].combine_chunks().dictionary_encode()
        group = rows["key"].combine_chunks().dictionary_encode().indices.to_numpy()
        self.names, at = names.dictionary, names.indices.to_numpy()
        self.order = np.lexsort((at, group))
        at, group = at[self.order], group[self.order]
        starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (group[1:] != group[:-1])]))
        self.copies = np.diff(np.append(starts, len(at)))
        self.at, group = at[starts], group[starts]
        self.cuts = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group))
        sizes = np.diff(self.cuts)
        self.places = np.concatenate([[0], np.cumsum(sizes * sizes)])
        self.sums, self.squares = np.zeros(self.places[-1]), np.zeros(len(starts))

    def _spans(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """From, to and sums of every group of more than one row."""
        cuts, places = self.cuts.tolist(), self.places.tolist()
        for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if e - s > 1 or self.copies[s] > 1:
                yield s, e, self.sums[places[k] : places[k + 1]].reshape(e - s, e - s)

    def add(self, texts: pa.Table) -> None:
        """A slice of the terms. texts: copy, and terms in order, each text once. Terms of a single text only count for its length."""
        found = pc.index_in(self.names, value_set=texts["copy"].combine_chunks()).fill_null(len(texts)).to_numpy()[self.at]
        row, term = _flat(texts["terms"])
        starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])]) if len(row) else np.zeros(0, bool))
        tf = np.diff(np.append(starts, len(row))).astype(float)
        row, term = row[starts], term[starts]
        order = np.argsort(term)
        term = term[order]
        kinds = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]) if len(term) else np.zeros(0, bool))
        holders = np.diff(np.append(kinds, len(term)))
        rank = np.empty(len(kinds), np.int32)
        rank[np.argsort(-holders, kind="stable")] = np.arange(len(kinds), dtype=np.int32)  # the most frequent first
        number = np.empty(len(term), np.int32)
        number[order] = np.repeat(rank, holders)
        several = int((holders > 1).sum())
        del term, order, kinds, holders, rank
        kept = number < several
        alone = np.bincount(row[~kept], tf[~kept] ** 2, len(texts) + 1)  # the text behind the last is empty
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(texts) + 1))])
        number, tf = number[kept], tf[kept]
        held, copied, place = (np.zeros(several, np.int32) for _ in range(3))
        for s, e, sums in self._spans():
            m, copies = e - s, self.copies[s:e]
            n = int(copies.sum())
            idf = np.log((1 + n) / (1 + np.arange(n + 1))) + 1
            own = found[s:e]
            spans = [slice(ends[i], ends[i + 1]) for i in own.tolist()]
            parts = [number[x] for x in spans]
            term = np.concatenate(parts)
            for p in parts:
                held[p] += 1  # a text has a term once
            have = df = held[term]
            if n > m:
                for p, c in zip(parts, copies.tolist(), strict=True):
                    copied[p] += c
                df = copied[term]
                copied[term] = 0
            held[term] = 0
            row, w = np.repeat(np.arange(m), [len(p) for p in parts]), np.concatenate([tf[x] for x in spans]) * idf[df]
            self.squares[s:e] += np.bincount(row, w * w, m) + alone[own] * idf[copies] ** 2
            shared = np.flatnonzero(have > 1)
            if not len(shared):
                continue
            term, row, w = term[shared], row[shared], w[shared]
            each = np.arange(len(term), dtype=np.int32)
            place[term] = each
            at = place[term]
            columns = np.cumsum(at == each)
            if m * columns[-1] <= WIDE:
                wide = np.zeros((m, columns[-1]))
                wide[row, columns[at] - 1] = w
                sums += wide @ wide.T
            else:
                order = np.argsort(term, kind="stable")
                sparse = row[order], term[order], w[order]
                sums += products(sparse, sparse, m, m)

    def nearest(self) -> pa.RecordBatch:
        """id and max_sim of every row."""
        best = np.zeros(len(self.at))
        for s, e, sums in self._spans():
            norm = np.sqrt(self.squares[s:e])
            whole = np.where(norm > 0, norm, 1.0)
            sims = sums / whole[:, None] / whole
            np.fill_diagonal(sims, 0.0)
            best[s:e] = np.where(self.copies[s:e] > 1, norm > 0, sims.max(axis=1))
        out = np.empty(len(self.order))
        out[self.order] = np.repeat(best, self.copies)
        return pa.RecordBatch.from_arrays([self.ids.combine_chunks(), pa.array(out)], names=["id", "max_sim"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and max_sim. Of each task come the rows of its groups, as slice -1, and then slice by slice the texts that they refer to."""
    here, held, groups = None, [], None
    for batch in batches:
        at = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
        cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            now = tuple(at[:, s].tolist())
            if held and now != here:
                groups = _taken(groups, here, held)
                held = []
            if here is not None and now[0] != here[0]:
                yield groups.nearest()
            here = now
            held.append(batch.slice(s, e - s))
    if held:
        yield _taken(groups, here, held).nearest()
    pa.default_memory_pool().release_unused()


def _taken(groups: Groups | None, at: tuple[int, int], held: list[pa.RecordBatch]) -> Groups:
    table = pa.Table.from_batches(held)
    if at[1] < 0:
        return Groups(table)
    groups.add(table)
    return groups


def _runs(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[tuple, pa.Table]]:
    """The values of by, and the rows of each run of equal ones: one run is held at a time."""
    here, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = np.stack([batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in by])
        cuts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            now = tuple(batch.column(c)[s].as_py() for c in by)
            if held and now != here:
                done, held = [held], []
                yield here, pa.Table.from_batches(done.pop())  # which is not kept here
            here = now
            held.append(batch.slice(s, e - s))
    if held:
        yield here, pa.Table.from_batches(held)


def _released() -> None:
    """Gives freed memory back to the system: an idle worker else keeps it beside the next one's."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _bytes(a: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0)))).tobytes()


def _numbers(b: bytes, n: int) -> np.ndarray:
    """What _bytes was given: n numbers."""
    return np.frombuffer(b, f"u{len(b) // n}") if n else np.zeros(0, np.uint8)


def _distinct(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and number of times of each different term of lists in order."""
    sizes, term = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), pc.list_flatten(lists).to_numpy()
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    starts = np.flatnonzero(new)
    return row[starts], term[starts], np.diff(np.append(starts, len(row))).astype(np.int32)


def _summed(term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms in order, each once, and the sums of their counts."""
    order = np.argsort(term)
    term = term[order]
    starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]) if len(term) else np.zeros(0, bool))
    return term[starts], np.add.reduceat(count[order], starts) if len(starts) else count[:0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From key, slices, copies and terms in order to key, slice, and the terms of a part of the texts with the number of those that have them."""

    def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
        codes = table["key"].combine_chunks().dictionary_encode()
        group = codes.indices.to_numpy()
        for i, key in enumerate(codes.dictionary):
            own = table.filter(pa.array(group == i))
            row, term, _ = _distinct(own["terms"])
            term, df = _summed(term, own["copies"].to_numpy()[row])
            slices = own["slices"][0].as_py()
            cuts = np.searchsorted(((term >> 32) + (1 << 31)) * slices >> 32, np.arange(slices + 1)).tolist()
            parts = [(k, s, e) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)) if s < e]
            columns = [pa.array([key.as_py()] * len(parts), table["key"].type), pa.array([k for k, _, _ in parts], pa.int32())]
            columns += [pa.array([f(a[s:e]) for _, s, e in parts], pa.binary()) for a, f in ((term, np.ndarray.tobytes), (df, _bytes))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "slice", "terms", "df"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(pc.list_flatten(batch.column("terms")))
        if size > TERMS:
            yield from told(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield from told(pa.Table.from_batches(held))
    held = batch = None
    _released()


def _merged(table: pa.Table) -> pa.Table:
    """The terms of a slice that more than one text has, with their number."""
    terms = [np.frombuffer(x.as_py(), np.int64) for x in table["terms"]]
    term, df = _summed(np.concatenate(terms), np.concatenate([_numbers(x.as_py(), len(t)).astype(np.int64) for x, t in zip(table["df"], terms, strict=True)]))
    term, df = term[df > 1], df[df > 1]
    return pa.table([table["key"][:1], table["slice"][:1], pa.array([term.tobytes()], pa.binary()), pa.array([_bytes(df)], pa.binary())], names=["key", "slice", "terms", "df"])


def _alike(row: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """An order of n texts in which those with the same frequent terms stand together; place: of the term, or -1."""
    have = place >= 0
    v = np.zeros((n, TELLING), np.float32)
    v[row[have], place[have]] = 1
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1)
    near = v @ v[0]
    centers = [v[0]]
    for _ in range(KINDS - 1):  # the text that is least like those taken
        centers.append(v[int(near.argmin())])
        near = np.maximum(near, v @ centers[-1])
    for _ in range(5):
        kind = (v @ np.stack(centers).T).argmax(axis=1)
        centers = [c if not (kind == k).any() else (x := v[kind == k].sum(axis=0)) / max(np.linalg.norm(x), 1e-9) for k, c in enumerate(centers)]
    return np.argsort(kind, kind="stable")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block come its texts, as slice -1, and then slice by slice the terms that several texts of the group have. Out come
    the same slices with the block's own terms, their holders, df, and each holder's place and tf, and last, as slice -1, copies and lengths."""
    names = ["key", "block", "texts", "n", "slice", "terms", "holders", "df", "rows", "tf", "copies", "norms"]

    def told(key: pa.Scalar, block: int, texts: int, n: int, at: int, *parts: bytes | None) -> pa.RecordBatch:
        columns = [pa.array([key.as_py()], key.type), *(pa.array([x], t) for x, t in ((block, pa.int32()), (texts, pa.int32()), (n, pa.int64()), (at, pa.int32()))), *(pa.array([x], pa.binary()) for x in parts)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    here = None

    def ended() -> pa.RecordBatch:
        key, block, n, total, copies, copy, squares, alone = here
        return told(key, block, n, total, -1, b"".join(copy), None, None, None, None, _bytes(copies), np.sqrt(squares + alone * (np.log((1 + total) / (1 + copies)) + 1) ** 2).tobytes())

    for (_, block, at), table in _runs(batches, "key", "block", "slice"):
        if at < 0:
            if here:
                yield ended()
            n, texts, (row, term, tf) = len(table), table.drop_columns(["terms", "common", "df"]), _distinct(table["terms"])
            del table
            order = np.argsort(term)
            term = term[order]
            row, tf = row[order], tf[order]
            starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]) if len(term) else np.zeros(0, bool))
            term, holders = term[starts], np.diff(np.append(starts, len(term)))
            rank = np.full(len(term), -1, np.int32)
            top = np.argsort(-holders, kind="stable")[:TELLING]
            rank[top] = np.arange(len(top), dtype=np.int32)
            order = _alike(row, np.repeat(rank, holders), n)
            place = np.empty(n, np.int32)
            place[order] = np.arange(n, dtype=np.int32)
            row = place[row]
            copies, copy = texts["copies"].to_numpy()[order], texts["copy"].take(pa.array(order)).to_pylist()
            # as if no text of another block had its terms; a slice puts right those that some have
            here = [texts["key"][0], block, n, texts["n"][0].as_py(), copies, copy, np.zeros(n), np.bincount(row, tf.astype(float) ** 2, n)]
        else:
            several, df = np.frombuffer(table["common"][0].as_py(), np.int64), table["df"][0].as_py()
            df = _numbers(df, len(several)).astype(np.int64)
            s, e = np.searchsorted(term, [several[0], several[-1]], "left") + [0, 1] if len(several) else (0, 0)
            e = min(e, len(term))
            found = np.searchsorted(several, term[s:e])
            found[found == len(several)] = 0
            known = several[found] == term[s:e] if len(several) else np.zeros(0, bool)
            own = np.concatenate([np.zeros(s, bool), known])
            kept, df = np.flatnonzero(own), df[found[known]]
            first, last = (starts[s], starts[e] if e < len(starts) else len(row)) if e > s else (0, 0)
            those = first + np.flatnonzero(np.repeat(known, holders[s:e][: len(known)])) if e > s else np.zeros(0, int)
            r, f = row[those], tf[those].astype(float)
            w = f * np.repeat(np.log((1 + here[3]) / (1 + df)) + 1, holders[kept])
            here[6] += np.bincount(r, w * w, n)
            here[7] = here[7] - np.bincount(r, f * f, n)
            yield told(here[0], block, n, here[3], at, term[kept].tobytes(), _bytes(holders[kept]), _bytes(df), _bytes(r), _bytes(tf[those]), None, None)
    if here:
        yield ended()
    here = table = None
    _released()


class Block:
    """A block's texts: the terms that it has, their holders, and row and weight of each holder, by term."""

    def __init__(self, table: pa.Table):
        """table: what _packed gives for a block, as slice -1 and the others in order."""
        rest, *parts = table.to_pylist()
        self.key, self.block, self.texts = table["key"][:1], rest["block"], rest["texts"]
        terms = [np.frombuffer(p["terms"], np.int64) for p in parts]
        holders = [_numbers(p["holders"], len(t)).astype(np.int32) for p, t in zip(parts, terms, strict=True)]
        self.terms, self.holders = (np.concatenate([np.zeros(0, k), *x]) for x, k in ((terms, np.int64), (holders, np.int32)))
        norm = np.frombuffer(rest["norms"])
        norm = np.where(norm > 0, norm, 1.0)
        self.row, self.weight, at = np.empty(self.holders.sum(), np.int32), np.empty(self.holders.sum()), 0
        for p, h in zip(parts, holders, strict=True):
            own = slice(at, at := at + int(h.sum()))
            self.row[own] = _numbers(p["rows"], own.stop - own.start)
            idf = np.log((1 + rest["n"]) / (1 + _numbers(p["df"], len(h)).astype(np.int64))) + 1
            self.weight[own] = _numbers(p["tf"], own.stop - own.start) * np.repeat(idf, h)
        self.weight /= norm[self.row]
        self.best = np.zeros(self.texts)

    def tiles(self, kept: np.ndarray) -> list[tuple]:
        """From, to, what products needs, and holders of the kept terms, of each TILE of texts."""
        here = np.repeat(kept, self.holders)
        number = np.cumsum(kept, dtype=np.int32) - 1
        row, term, weight = self.row[here], np.repeat(number, self.holders)[here], self.weight[here]
        n = -(-self.texts // TILE)
        ends = [self.texts * k // n for k in range(n + 1)]
        out = []
        for s, e in zip(ends, ends[1:], strict=False):
            own = np.flatnonzero((row >= s) & (row < e))
            out.append((s, e, (row[own] - s, term[own], weight[own]), np.bincount(term[own], minlength=int(kept.sum()))))
        return out

    def meet(self, other: Block) -> None:
        """Both sides' best become the greatest product with a text of the other block, or another one of the same."""
        if other is self:
            left = right = self.tiles(self.holders > 1)
        else:
            at = np.searchsorted(other.terms, self.terms)
            at[at == len(other.terms)] = 0
            shared = other.terms[at] == self.terms if len(other.terms) else np.zeros(len(at), bool)
            theirs = np.zeros(len(other.terms), bool)
            theirs[at[shared]] = True
            left, right = self.tiles(shared), other.tiles(theirs)
        for i, (s, e, own, c1) in enumerate(left):
            for a, b, their, c2 in right[i if other is self else 0 :]:
                if len(own[0]) and len(their[0]):
                    sims = _numbered_products(own, their, c1, c2, e - s, b - a)
                    if other is self and a == s:
                        np.fill_diagonal(sims, 0.0)
                    self.best[s:e] = np.maximum(self.best[s:e], sims.max(axis=1))
                    other.best[a:b] = np.maximum(other.best[a:b], sims.max(axis=0))

    def told(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.key.combine_chunks(), pa.array([self.block], pa.int32()), pa.array([self.best.tobytes()], pa.binary())], names=["key", "block", "best"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, block and best of the blocks that meet. Of each task comes its own block, as far 0, and then those that it meets; the first strip has it meet itself."""
    own, here = None, None
    for (task, strip, far), table in _runs(batches, "task", "strip", "far"):
        block = Block(table)
        del table
        _released()
        if task != here:
            if own:
                yield own.told()
            own, here = block, task
            if strip == 0:
                own.meet(own)
        else:
            own.meet(block)
            yield block.told()
    if own:
        yield own.told()
    own = block = None
    _released()


def _nearest_in(table: pa.Table) -> pa.Table:
    """key, copy and max_sim of a block's texts, from its copies and lengths and all that its meetings gave."""
    rest = next(x for x in table.to_pylist() if x["best"] is None)
    copies = _numbers(rest["copies"], rest["texts"])
    best = np.max([np.frombuffer(x.as_py()) for x in table["best"] if x.is_valid], axis=0)
    best = np.where(copies > 1, np.frombuffer(rest["norms"]) > 0, best)
    names = [rest["terms"][i : i + 16] for i in range(0, 16 * rest["texts"], 16)]
    return pa.table([pa.array([rest["key"]] * len(names), table["key"].type), pa.array(names, pa.binary()), pa.array(best.astype(float))], names=["key", "copy", "max_sim"])


def _in_pairs(placed: DataFrame) -> DataFrame:
    """Every row (block of blocks) once for each block that its own meets: as lo and hi."""
    sent = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return sent.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks")


def _copy(text: Column) -> Column:
    """128 bits that stand for a whole text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def text_similarity(df: DataFrame, key: str, id_col: str, text_col: str = "text", most_terms: int = TERMS) -> DataFrame:
    """id and max_sim: cosine of TF-IDF vectors (weights fitted within the group) with the nearest other text of it; 0 if there is none."""
    rows = df.select(F.col(key), F.col(id_col), _copy(F.col(text_col)).alias("_ref"), F.coalesce(text_col, F.lit("")).alias("_text"))
    texts = written(rows.groupBy("_ref").agg(F.first("_text").alias("_text")), "texts", 1 << 12)
    return referred_similarity(rows.drop("_text"), texts, key, id_col, "_ref", "_text", most_terms)


def _sorted_terms(text: str) -> Column:
    """64 bits that stand for each of the terms, in order: of a pair, without making its string."""
    hashes = lambda words, first, second: F.concat(F.transform(words, lambda w: F.xxhash64(w)), F.zip_with(first, second, lambda a, b: F.xxhash64(a, b)))
    return F.sort_array(_of_words(F.col(text), hashes))


def referred_similarity(df: DataFrame, texts: DataFrame, key: str, id_col: str, ref: str, text_col: str = "text", most_terms: int = TERMS) -> DataFrame:
    """As text_similarity, for rows that refer by ref to a table of texts; a row without one has the empty text."""
    named = texts.select(F.col(ref).alias("ref"), _copy(F.col(text_col)).alias("copy"), F.coalesce(text_col, F.lit("")).alias("text"))
    words = F.regexp_count(F.lower("text"), F.lit(TOKEN))
    names = written(named.select("ref", "copy", F.greatest(2 * words - 1, F.lit(0)).alias("size")), "text-names")
    few = names.count() <= 1 << 18
    near = F.broadcast if few else lambda x: x
    one = written(names.groupBy("copy").agg(F.min("ref").alias("ref"), F.first("size").alias("size")), "text-copies")
    rows = df.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(ref).alias("ref")).join(near(names.select("ref", "copy")), "ref", "left")
    rows = written(rows.select("key", "id", F.coalesce("copy", _copy(F.lit(""))).alias("copy")), "text-rows")
    known = rows.filter("key is not null").join(near(one.select("copy", "size")), "copy", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    by_key = written(known.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).filter("n > 1"), "text-groups")
    # only a group that is large with its copies can be so without them
    folded = known.join(by_key.filter((F.col("n") > BLOCK) | (F.col("size") > most_terms)).select("key", "n"), "key").groupBy("key", "n", "copy").agg(F.first("size").alias("size"))
    sizes = folded.groupBy("key", "n").agg(F.count(F.lit(1)).alias("texts"), F.sum("size").alias("size")).filter((F.col("texts") > BLOCK) | (F.col("size") > most_terms))
    blocks = F.ceil(F.greatest(F.col("texts") / TEXTS, F.col("size") / (MORE_TERMS * most_terms))).cast("int")
    sizes = written(sizes.select("key", "n", "size", blocks.alias("blocks")), "large-groups")
    found = rows.filter("key is null").select("id", F.lit(0.0).alias("max_sim"))
    if not sizes.isEmpty():
        small = rows.filter("key is not null").join(sizes, "key", "left_anti")
        wanted = one.join(small.select("copy").distinct(), "copy", "left_semi")
        if not small.isEmpty():
            found = found.union(_of_small(small, _told(named, wanted, near), by_key.join(sizes, "key", "left_anti")))
        return _shown(found.union(_of_large(rows.join(sizes, "key"), named, one, sizes)), id_col)
    return _shown(found.union(_of_small(rows.filter("key is not null"), _told(named, one, near), by_key)), id_col)


def _shown(found: DataFrame, id_col: str) -> DataFrame:
    return found.select(F.col("id").alias(id_col), F.greatest(F.lit(0.0), F.coalesce("max_sim", F.lit(0.0))).alias("max_sim"))


def _told(named: DataFrame, one: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """copy, terms and size of the texts of one, each once."""
    told = written(named.join(near(one.select("ref", "copy")), ["ref", "copy"]).select("copy", _sorted_terms("text").alias("terms")).withColumn("size", F.size("terms")), "text-terms")
    n, different = told.agg(F.count(F.lit(1)), F.count_distinct("copy")).first()
    if n > different:  # rows alike in id and text
        told = written(told.groupBy("copy").agg(F.first("terms").alias("terms"), F.first("size").alias("size")), "text-terms")
    return told


def _of_small(rows: DataFrame, told: DataFrame, by_key: DataFrame) -> DataFrame:
    """id and max_sim of the rows (key, id, copy) of groups that a task can hold."""
    spark = rows.sparkSession
    n, sent = by_key.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    whole, squares = told.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], by_key.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()[0]
    tasks = max(1, -(-n // ROWS), -(-squares // SUMS), min(spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)), -(-sent // HELD) if whole > HELD else 1)
    turns = min(tasks, max(1, -(-min(tasks * whole, sent) // max(ROUND, whole // 2))))
    cores, a_turn = spark.sparkContext.defaultParallelism, -(-tasks // turns)
    if turns > 1 and a_turn > cores:  # no core waits for the last tasks of a turn
        a_turn -= a_turn % cores
        turns = -(-tasks // a_turn)
    slices = max(1, -(-min(whole, HELD) // SLICE))
    kind = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("max_sim", T.DoubleType())])
    dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(tasks)).cast("int").alias("task"), F.lit(-1).alias("slice"), "key", "id", "copy")
    parts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda i: F.struct(i.alias("slice"), F.filter("terms", lambda t: F.pmod(t, F.lit(slices)) == i).alias("terms"))))
    parted = told.select("copy", parts.alias("p")).select("copy", "p.slice", "p.terms") if slices > 1 else told.select("copy", F.lit(0).alias("slice"), "terms")
    found = []
    for turn in range(turns):
        mine = dealt.filter(F.col("task") % turns == turn)
        wanted = mine.select("task", "copy").distinct()
        sent_texts = parted.join(F.broadcast(wanted) if n // turns <= 1 << 20 else wanted, "copy")
        both = mine.unionByName(sent_texts, allowMissingColumns=True).select("task", "slice", "key", "id", "copy", "terms")
        dealt_out = both.repartitionById(-(-tasks // turns), F.floor(F.col("task") / turns).cast("int"))  # by a hash two tasks may share a partition
        found.append(written(dealt_out.sortWithinPartitions("task", "slice").mapInArrow(_together, kind), "text-nearest"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _of_large(rows: DataFrame, named: DataFrame, one: DataFrame, sizes: DataFrame) -> DataFrame:
    """id and max_sim of the rows (key, id, copy, n, blocks) of groups that are cut into blocks; sizes: key, n, size, blocks.

    Terms are counted slice by slice, blocks get the counts of terms that several texts have and are written as packed arrays,
    and then blocks meet. Blocks, and what travels to the tasks, take turns, so that not all of it lies on disk at once.
    """
    key, cores = f"key {rows.schema['key'].dataType.simpleString()}", rows.sparkSession.sparkContext.defaultParallelism
    before = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)  # a row a large group
    strips = F.floor(F.floor(F.col("blocks") / 2) / STRIP) + 1
    sizes = sizes.withColumn("strips", strips.cast("int")).withColumns({"at": F.coalesce(F.sum("blocks").over(before), F.lit(0)), "tasks_at": F.coalesce(F.sum(F.col("blocks") * F.col("strips")).over(before), F.lit(0))})
    sizes = written(sizes, "large-groups")
    size, blocks, tasks = sizes.agg(F.sum("size"), F.sum("blocks"), F.sum(F.col("blocks") * F.col("strips"))).first()

    copies = written(rows.groupBy("key", "n", "copy").agg(F.count(F.lit(1)).alias("copies")), "large-copies")
    n_copies = copies.count()
    small = sizes.select("key", "blocks", "at")
    texts = copies.join(sized_broadcast(small, 100), "key").withColumn("block", F.pmod(F.xxhash64("copy"), F.col("blocks")).cast("int")).join(one.select("copy", "ref"), "copy")
    if n_copies <= 1 << 20:  # the texts stay where they are
        texts = named.join(F.broadcast(written(texts, "large-texts")), ["ref", "copy"])
    else:
        texts = written(named.join(texts, ["ref", "copy"]), "large-texts", 1 << 12)
    counted = texts.select("key", (F.col("blocks") * SLICES).alias("slices"), "copies", _sorted_terms("text").alias("terms")).mapInArrow(_counted, f"{key}, slice int, terms binary, df binary")
    merged = counted.groupBy("key", "slice").applyInArrow(_merged, f"{key}, slice int, terms binary, df binary")
    common = written(merged.select("key", "slice", F.col("terms").alias("common"), "df"), "term-counts", batch_bytes=1 << 22)

    kind = f"{key}, block int, texts int, n bigint, slice int, terms binary, holders binary, df binary, rows binary, tf binary, copies binary, norms binary"
    turns = max(1, min(-(-8 * size // SENT), blocks // cores))
    sent = common.join(sized_broadcast(small, 100), "key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    packed = []
    for turn in range(turns):
        mine = (F.col("at") + F.col("block")) % turns == turn
        own = texts.filter(mine).select("key", "block", "at", F.lit(-1).alias("slice"), "n", "copies", "copy", _sorted_terms("text").alias("terms"))
        both = own.unionByName(sent.filter(mine).drop("blocks"), allowMissingColumns=True)
        dealt = both.repartitionById(-(-blocks // turns), F.floor((F.col("at") + F.col("block")) / turns).cast("int")).drop("at")
        packed.append(written(dealt.sortWithinPartitions("key", "block", "slice").mapInArrow(_packed, kind), "blocks", batch_bytes=1 << 22))
    packed = functools.reduce(DataFrame.union, packed)

    half, far = F.floor(F.col("blocks") / 2).cast("int"), lambda d: F.pmod(F.col("block") - d, F.col("blocks"))
    meets = lambda d: (d > 0) & ((d * 2 < F.col("blocks")) | (far(d) < half))  # noqa: E731  each two blocks meet once
    as_own = F.transform(F.sequence(F.lit(0), F.col("strips") - 1), lambda s: F.struct((F.col("tasks_at") + F.col("block") * F.col("strips") + s).alias("task"), s.alias("strip"), F.lit(0).alias("far")))
    as_other = F.transform(F.filter(F.sequence(F.lit(0), half), meets), lambda d: F.struct((F.col("tasks_at") + far(d) * F.col("strips") + F.floor(d / STRIP)).alias("task"), F.floor(d / STRIP).cast("int").alias("strip"), d.alias("far")))
    placed = packed.join(sized_broadcast(sizes.select("key", "blocks", "strips", "tasks_at"), 100), "key").withColumn("to", F.explode(F.concat(as_own, as_other)))
    placed = placed.select("to.*", *packed.columns).drop("copies")
    weight = sum((F.coalesce(F.length(c), F.lit(0)) for c in ("terms", "holders", "df", "rows", "tf")), F.lit(0))
    travels = placed.agg(F.sum(weight)).first()[0]
    turns = max(1, min(-(-travels // SENT), tasks // cores))
    a_turn = -(-tasks // turns)
    turns = -(-tasks // a_turn)
    found = []
    for turn in range(turns):
        dealt = placed.filter(F.col("task") % turns == turn).repartitionById(a_turn, F.floor(F.col("task") / turns).cast("int"))
        met = dealt.sortWithinPartitions("task", "strip", "far", "slice").mapInArrow(_met, f"{key}, block int, best binary")
        found.append(written(met, "blocks-met", batch_bytes=1 << 22))
    best = functools.reduce(DataFrame.union, found)
    rest = packed.filter("slice = -1").select("key", "block", "texts", "terms", "copies", "norms")
    nearest = best.unionByName(rest, allowMissingColumns=True).groupBy("key", "block").applyInArrow(_nearest_in, f"{key}, copy binary, max_sim double")
    return rows.select("key", "id", "copy").join(written(nearest, "large-nearest"), ["key", "copy"], "left").select("id", "max_sim")


def vector_similarity(df: DataFrame, key: str, id_col: str, vector_col: str) -> DataFrame:
    """id and max_sim: the largest dot product with another vector of the group; 0 for a group of one."""
    rows = df.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def nearest(table: pa.Table) -> pa.Table:
        v = pc.list_flatten(table["v"]).to_numpy().astype(np.float64).reshape(len(table), -1)
        sims = v @ v.T
        np.fill_diagonal(sims, -np.inf)
        block = table["block"].to_numpy()
        if table["lo"][0].as_py() != table["hi"][0].as_py():
            sims[block[:, None] == block[None, :]] = -np.inf  # compared where the block meets itself
        return pa.table([table["id"], pa.array(sims.max(axis=1))], names=["id", "sim"])

    found = _in_pairs(placed).groupBy("key", "lo", "hi").applyInArrow(nearest, f"id {df.schema[id_col].dataType.simpleString()}, sim double")
    best = found.filter(F.col("sim") > F.lit(float("-inf"))).groupBy("id").agg(F.max("sim").alias("max_sim"))
    return rows.select("id").join(best, "id", "left").select(F.col("id").alias(id_col), F.coalesce("max_sim", F.lit(0.0)).alias("max_sim"))


def _nearest_of(refs: np.ndarray, vectors: np.ndarray):
    """From batches of key, id and place of a vector, in order of the keys, to id and max_sim; vectors: of all places."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, wide = None, vectors.astype(np.float64)
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            code = table["key"].combine_chunks().dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist()]  # the last group may go on
            if len(cuts) > 1:
                yield whole(table.slice(0, cuts[-1]), cuts, wide)
            rest = table.slice(cuts[-1]).combine_chunks().to_batches()[0] if len(table) else None
        if rest is not None:
            yield whole(pa.Table.from_batches([rest]), [0, rest.num_rows], wide)

    def whole(table: pa.Table, cuts: list[int], wide: np.ndarray) -> pa.RecordBatch:
        at, best = np.searchsorted(refs, table["ref"].to_numpy()), np.zeros(len(table))
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e - s > 1:
                v = wide[at[s:e]]
                sims = v @ v.T
                np.fill_diagonal(sims, -np.inf)
                best[s:e] = sims.max(axis=1)
        return pa.RecordBatch.from_arrays([table["id"].combine_chunks(), pa.array(best)], names=["id", "max_sim"])

    return nearest


def referred_vector_similarity(df: DataFrame, vectors: DataFrame, key: str, id_col: str, ref: str, vector_col: str, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """As vector_similarity, for rows that refer by ref, a number, to a table of vectors; rows without a vector are left out.

    If the vectors are counted and fit most_bytes, every task gets them once, and only keys and ids are shuffled. Else, and
    for groups of more than BLOCK rows, each row takes its vector along.
    """
    size = F.size(vector_col)
    n, refs, least, most, none = vectors.agg(F.count(F.lit(1)), F.count_distinct(ref), F.min(size), F.max(size), F.count_if(F.col(vector_col).isNull())).first()
    if not n or refs < n or none or least != most or least < 1 or n * (8 * most + 16) > most_bytes:
        return vector_similarity(df.select(key, id_col, ref).join(vectors, ref), key, id_col, vector_col)
    held = vectors.select(ref, vector_col).orderBy(ref).toArrow()
    names, values = held[ref].to_numpy(), pc.list_flatten(held[vector_col]).to_numpy().reshape(n, -1)
    found = df.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(ref).alias("ref")).join(F.broadcast(vectors.select(F.col(ref).alias("ref"))), "ref", "left_semi")
    large = written(found.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("key"), "large-groups")
    kind = T.StructType([T.StructField("id", found.schema["id"].dataType), T.StructField("max_sim", T.DoubleType())])
    small = found.filter("key is not null").join(sized_broadcast(large, 100), "key", "left_anti").select("key", "id", "ref")
    out = small.repartition("key").sortWithinPartitions("key").mapInArrow(_nearest_of(names, values), kind)
    out = out.union(found.filter("key is null").select("id", F.lit(0.0).alias("max_sim")))
    if not large.isEmpty():
        rows = found.join(large, "key", "left_semi").join(vectors.select(F.col(ref).alias("ref"), F.col(vector_col).alias("v")), "ref")
        out = out.union(vector_similarity(rows, "key", "id", "v").select("id", "max_sim"))
    return out.select(F.col("id").alias(id_col), "max_sim")


def hashed_embedding(df: DataFrame, text_col: str, size: int = 256) -> DataFrame:
    """Adds embedding: a unit vector of hashed word counts, for use where no encoder is supplied.

    A word's hash names its place by the low bits and its sign by a high one. Words are hashed by Spark; numpy adds up a batch.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"\s+"), lambda w: w != "")

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hashes in batches:
            sizes = hashes.map(len).to_numpy()
            h = np.concatenate([*hashes, np.zeros(0, np.int64)]).astype(np.int64)
            v = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * size + h % size, 1.0 - 2 * (h >> 40 & 1), len(sizes) * size).reshape(-1, size)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list((v / np.where(norm > 0, norm, 1)).astype(np.float32)))

    return df.withColumn("embedding", F.pandas_udf(encode, "array<float>")(F.transform(words, lambda w: F.xxhash64(w))))


def encoded(df: DataFrame, text_col: str, encoder=None) -> DataFrame:
    """Adds embedding: by the encoder, a function of no arguments that a worker calls once and that gives a function from a list of texts to unit vectors; or hashed words."""
    if encoder is None:
        return hashed_embedding(df, text_col)

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for texts in batches:
            yield pd.Series(list(np.asarray(model([t or "" for t in texts]), np.float32)))

    return df.withColumn("embedding", F.pandas_udf(encode, "array<float>")(F.col(text_col)))
