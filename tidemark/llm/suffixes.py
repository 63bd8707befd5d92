"""Suffix-array dedup of byte strings, by deep-shallow sorting.

Every ``length``-byte string that also starts earlier (in a smaller doc_id, or before in the document)
is removed with all bytes that it covers. Equal strings are found as neighbours in sorted suffixes:

1. The least hash among the ``CORE``-byte cores of a window is its anchor. Windows are equal only if their anchors
   lie at the same distance from their starts and the bytes around the anchors are equal. A run of windows with one anchor, whose
   starts are within ``STEP`` bytes, is a segment; all its windows hold the same ``length - STEP + 1`` bytes, its key.
2. Each chunk of documents finds equal segments by their bytes; all but the first repeat it. A count-min sketch tells
   how many different segments have a key. One alone is done; those that share a key go to the key's shard.
3. Keys with more than ``HOT`` segments, as at the edges of a passage that very many documents share, are dealt out
   window by window, by a hash of the whole window, so that none of them fills a shard.
4. A shard sorts the suffixes that start in its segments: multikey quicksort, with eight bytes as a character, to a
   shallow depth, then a blind trie for each group that is still alike. Neighbours that are equal repeat each other.

Hashes only bring together what may be equal; equality is decided by the bytes.

Defined cases: a null text is empty; texts shorter than ``length`` stay; a very long text is a chunk of its own and is
worked off in blocks, whole; rows with the same doc_id count as one document that has their bytes at the same places; a
null doc_id is smaller than all others; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ranges
from .exchange import BLOCK_BYTES, CHUNK_BYTES, FIRST, MAIL, Sketch, U, chunks, divided, least, loaded, mail, mixed, opened, packed, unpacked

#: Bytes of a core, starts in a segment, and the depth to which multikey quicksort goes.
CORE, STEP, SHALLOW = 20, 32, 32
#: Segments in a shard of the sorting step, about, if all were repeated; segments of a key that one shard gets.
SHARD, HOT = 1 << 18, 1 << 12
_PLACE = U((1 << 20) - 1)  # a block is shorter than this


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; beyond the end come zeros."""
    return np.ndarray(len(data) + 1, dtype=">u8", buffer=np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def hashed(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each slice, block by block; the slices lie in order of where they begin."""
    out = np.empty(len(begins), U)
    cuts = [0, *(np.flatnonzero(np.diff(begins // BLOCK_BYTES)) + 1).tolist(), len(begins)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            base = int(begins[a])
            out[a:b] = FIRST.slices(FIRST.sums(data[base : int(ends[a:b].max())]), begins[a:b] - base, ends[a:b] - base)
    return out


def leaders(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, by: np.ndarray) -> np.ndarray:
    """For each slice, the first one, in the order ``by``, of the same bytes. ``hashes``: equal for equal slices."""
    order = by[np.argsort(hashes[by], kind="stable")]
    out = order.copy()
    rest = order  # those whose leader isn't found; in a round each is compared with the first of its hash
    while len(rest):
        head = np.concatenate(([True], hashes[rest[1:]] != hashes[rest[:-1]]))
        lead = rest[np.maximum.accumulate(np.where(head, np.arange(len(rest)), 0))]
        some = np.flatnonzero(rest != lead)
        x, y = rest[some], lead[some]
        differ = sizes[x] != sizes[y]
        size = np.minimum(sizes[x], sizes[y])
        for k in range(0, int(size.max(initial=0)), 8):
            own = np.flatnonzero(size > k)
            differs = words[begins[x[own]] + k].astype(U) ^ words[begins[y[own]] + k].astype(U)
            beyond = np.maximum(k + 8 - size[own], 0).astype(U) * U(8)
            differ[own] |= differs >> beyond != 0
        out[rest] = lead
        rest = x[differ]
    return out


class Segments:
    """The segments of a chunk: doc (its place), start, count of windows, rel (of the anchor), and key."""

    def __init__(self, texts: list[np.ndarray], length: int) -> None:
        fields = ("doc", "start", "count", "rel", "key")
        found: dict[str, list[np.ndarray]] = {f: [np.zeros(0, U if f == "key" else np.int64)] for f in fields}
        # Pieces of texts that fill a block: doc, from, to. Windows that start in [from, from + BLOCK_BYTES).
        pieces: list[tuple[int, int, int]] = []
        for d, t in enumerate(texts):
            for a in range(0, len(t) - length + 1, BLOCK_BYTES):
                pieces.append((d, a, min(len(t), a + BLOCK_BYTES + length - 1)))
        at = 0
        while at < len(pieces):
            to, size = at, 0
            while to < len(pieces) and (to == at or size + pieces[to][2] - pieces[to][1] < BLOCK_BYTES):
                size += pieces[to][2] - pieces[to][1]
                to += 1
            self._block(texts, pieces[at:to], length, found)
            at = to
        for f, parts in found.items():
            setattr(self, f, np.concatenate(parts))
        self.length = length
        # The texts end to end.
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.data = np.concatenate([*texts, np.zeros(0, np.uint8)])

    @staticmethod
    def _block(texts, pieces, length, found) -> None:
        data = np.concatenate([texts[d][a:b] for d, a, b in pieces])
        begins = np.cumsum([0, *(b - a for _, a, b in pieces)])
        sums = FIRST.sums(data)
        core = min(CORE, length)
        spots = np.arange(len(data) - core + 1)
        low = (FIRST.slices(sums, spots, spots + core) & ~_PLACE) | spots.astype(U)
        wide = least(low, length - core + 1)
        valid = np.ones(len(wide), bool)
        for e in begins[1:-1].tolist():
            valid[e - length + 1 : e] = False
        starts = np.flatnonzero(valid)
        place = (wide[starts] & _PLACE).astype(np.int64)
        part = (place - starts) // STEP
        at = np.flatnonzero(np.concatenate(([True], (np.diff(place) != 0) | (np.diff(starts) != 1) | (np.diff(part) != 0)))[: len(starts)])
        start, count, anchor, part = starts[at], np.diff(np.append(at, len(starts))), place[at], part[at]
        owner = np.searchsorted(begins, start, side="right") - 1
        shift = np.array([a for _, a, _ in pieces]) - begins[:-1]
        found["doc"].append(np.array([d for d, _, _ in pieces])[owner])
        found["start"].append(start + shift[owner])
        found["count"].append(count)
        found["rel"].append(anchor - start)
        shared = anchor - part * STEP
        found["key"].append(mixed(FIRST.slices(sums, shared, shared + max(length - STEP + 1, 1)) + part.astype(U)))

    def leaders(self) -> np.ndarray:
        """For each segment the first equal one."""
        begins, sizes = self.begins[self.doc] + self.start, self.count + self.length - 1
        every = np.arange(len(begins))
        return leaders(words_of(self.data), begins, sizes, hashed(self.data, begins, begins + sizes), every)

    def own(self, ids: np.ndarray) -> np.ndarray:
        """Segments that aren't repeated before in the chunk: first ones, and those of rows that share their doc_id and place."""
        lead = self.leaders()
        return np.flatnonzero((ids[self.doc] == ids[self.doc[lead]]) & (self.start == self.start[lead]))


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Sort strings of one length by a blind trie: places of equal strings, in order.

    A node keeps only how long the common prefix is and the next byte of each branch. A string goes down
    blindly, is compared with the one leaf that it reaches, and is put in where the two first differ.
    """
    root: list = [None, [0]]  # [length of the common prefix or None for a leaf, places or branches]
    for place in range(1, len(strings)):
        s, node = strings[place], root
        while node[0] is not None:
            branch = node[1].get(s[node[0]])
            node = branch if branch is not None else next(iter(node[1].values()))
        t = strings[node[1][0]]
        if s == t:
            node[1].append(place)
            continue
        x = int.from_bytes(s) ^ int.from_bytes(t)
        differ = len(s) - (x.bit_length() + 7) // 8
        node = root
        while node[0] is not None and node[0] < differ:
            node = node[1][s[node[0]]]
        if node[0] == differ:
            node[1][s[differ]] = [None, [place]]
        else:
            other = strings[_leaf(node)]
            node[:] = [differ, {other[differ]: [node[0], node[1]], s[differ]: [None, [place]]}]
    out, open_ = [], [root]
    while open_:
        node = open_.pop()
        if node[0] is None:
            out.append(node[1])
        else:
            open_ += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def _leaf(node: list) -> int:
    while node[0] is not None:
        node = next(iter(node[1].values()))
    return node[1][0]


def multikey_quicksort(words: np.ndarray, at: np.ndarray, order: np.ndarray, new: np.ndarray, length: int, depth: int) -> None:
    """Sort groups of strings (``order``; a group begins where ``new``) by their first ``depth`` bytes; in place.

    Eight bytes are a character. Each open group is cut in three by a pivot's character: smaller, equal, greater; the
    equal ones go on with the next character. All open groups take their steps side by side.
    """
    heads = np.flatnonzero(new)
    sizes, depths = np.diff(np.append(heads, len(order))), np.zeros(len(heads), np.int64)
    while True:
        open_ = (sizes > 1) & (depths < depth)
        heads, sizes, depths = heads[open_], sizes[open_], depths[open_]
        if not len(heads):
            return
        group = np.repeat(np.arange(len(heads)), sizes)
        pos, own = ranges(heads, sizes), np.cumsum(sizes) - sizes
        strings = order[pos]
        char = words[at[strings] + depths[group]].astype(U)
        char >>= np.maximum(depths + 8 - length, 0).astype(U)[group] * U(8)  # bytes beyond the string don't count
        three = np.sort(np.stack([char[own], char[own + sizes // 2], char[own + sizes - 1]]), axis=0)
        pivot = three[1][group]
        side = (char > pivot).astype(np.int8) + (char >= pivot)
        counts = np.bincount(group * 3 + side, minlength=3 * len(heads)).reshape(-1, 3)
        begin = heads[:, None] + np.cumsum(counts, 1) - counts
        for k in range(3):
            mine = np.flatnonzero(side == k)
            of = group[mine]
            nth = np.arange(len(mine)) - (np.cumsum(counts[:, k]) - counts[:, k])[of]
            order[begin[of, k] + nth] = strings[mine]
        new[begin[counts > 0]] = True
        heads, sizes, depths = begin.ravel(), counts.ravel(), (depths[:, None] + np.array([0, 8, 0])).ravel()


def deep_shallow(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort the ``length``-byte strings at ``at`` within their groups.

    Returns their order, and for each place in it whether the string differs from the one before.
    """
    n = len(at)
    order = np.argsort(group, kind="stable")
    if not n:
        return order, np.zeros(0, bool)
    new = np.concatenate(([True], group[order][1:] != group[order][:-1]))
    multikey_quicksort(words_of(data), at, order, new, length, min(shallow, length))
    if shallow < length:
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, n))
        view = memoryview(data)
        for a, size in zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            own = order[a : a + size].tolist()
            classes = blind_trie([bytes(view[b + shallow : b + length]) for b in at[order[a : a + size]].tolist()])
            if len(classes) > 1:
                order[a : a + size] = [own[i] for c in classes for i in c]
                new[a : a + size] = np.concatenate([np.arange(len(c)) == 0 for c in classes])
    return order, new


def later(order: np.ndarray, new: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which strings have an equal one that starts earlier."""
    cls = np.empty(len(order), np.int64)
    cls[order] = np.cumsum(new)
    by = np.lexsort((start, doc, cls))
    first = np.concatenate(([True], cls[by][1:] != cls[by][:-1]))[: len(by)]
    lead = by[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))] if len(by) else by
    out = np.zeros(len(order), bool)
    out[by] = (doc[by] != doc[lead]) | (start[by] != start[lead])
    return out


def repeats(rel, count, doc, start, data, length) -> np.ndarray:
    """For the windows of segments, one after another: whether an equal window starts earlier. ``data``: their bytes, in order."""
    sizes = count + length - 1
    begins = np.cumsum(sizes) - sizes
    words = words_of(data)
    window = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), bool)
    # Equal segments: all but the earliest repeat it.
    lead = leaders(words, begins, sizes, hashed(data, begins, begins + sizes), np.lexsort((start, doc)))
    same = (doc == doc[lead]) & (start == start[lead])
    copies = np.flatnonzero(~same)
    out[ranges(window[copies], count[copies])] = True
    # Of equal segments one remains. Windows of different ones can only be equal if the segments have a key in common.
    own = np.flatnonzero(lead == np.arange(len(lead)))
    part = rel[own] // STEP
    shared = begins[own] + rel[own] - part * STEP
    key = hashed(data, shared, shared + max(length - STEP + 1, 1)) + part.astype(U)
    _, key, n = np.unique(key, return_inverse=True, return_counts=True)
    own, key = own[n[key] > 1], key[n[key] > 1]
    k = ranges(np.zeros(len(own), np.int64), count[own])
    spread = lambda x: np.repeat(x, count[own])
    order, new = deep_shallow(data, spread(begins[own]) + k, spread(key) * STEP + (spread(rel[own]) - k) % STEP, length)
    out[ranges(window[own], count[own])] = later(order, new, spread(doc[own]), spread(start[own]) + k)
    # Rows that share a doc_id may hold a segment at the same place: they fare alike.
    twin = np.flatnonzero(same & (lead != np.arange(len(lead))))
    out[ranges(window[twin], count[twin])] = out[ranges(window[lead[twin]], count[lead[twin]])]
    return out


def runs(flags: np.ndarray, count: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flagged windows of segments, one after another, as runs: segment, start of the first, how many."""
    owner = np.repeat(np.arange(len(count)), count)
    step = owner[1:] != owner[:-1]
    edges = np.flatnonzero(flags & np.concatenate(([True], ~flags[:-1] | step))[: len(flags)])
    ends = np.flatnonzero(flags & np.concatenate((~flags[1:] | step, [True]))[: len(flags)])
    segment = owner[edges]
    return segment, start[segment] + edges - (np.cumsum(count) - count)[segment], ends - edges + 1


def remove_repeated(docs: DataFrame, length: int = 100, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept, its other bytes."""
    dealt, n_chunks, total = chunks(docs.select("doc_id", "text"), chunk_bytes)
    segments = total // 10 + 1  # about: only sizes of sketch and shards hang on it
    sketch = Sketch(segments, 1, 8, HOT)
    shards = max(1, -(-segments // SHARD))

    def ask(table: pa.Table) -> pa.Table:
        ids, texts = loaded(table)
        s = Segments(texts, length)
        return mail(sketch.ask(table.column("chunk")[0].as_py(), s.key[s.own(ids)]))

    def candidates(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return mail([])
        chunk = table.column("chunk")[0].as_py()
        ids, texts = loaded(table)
        s = Segments(texts, length)
        own = s.own(ids)
        level = sketch.levels(s.key[own], answers)
        some, hot = own[level == 1], own[level == 2]
        # Hot segments window by window.
        n = s.count[hot]
        k = ranges(np.zeros(len(hot), np.int64), n)
        begin = np.repeat(s.begins[s.doc[hot]] + s.start[hot], n) + k
        deal = np.concatenate((s.key[some], hashed(s.data, begin, begin + length)))
        doc = np.concatenate((s.doc[some], np.repeat(s.doc[hot], n)))
        start = np.concatenate((s.start[some], np.repeat(s.start[hot], n) + k))
        count = np.concatenate((s.count[some], np.ones(len(begin), np.int64)))
        rel = np.concatenate((s.rel[some], np.repeat(s.rel[hot], n) - k))
        shard = divided(mixed(deal * U(5)), shards)
        order = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[order], np.arange(shards + 1)).tolist()
        out = []
        for to, (x, y) in enumerate(zip(bounds, bounds[1:])):
            if y > x:
                e = order[x:y]
                data = s.data[ranges(s.begins[doc[e]] + start[e], count[e] + length - 1)]
                out.append((to, chunk, packed(rel[e].astype(np.uint16), count[e].astype(np.uint8), doc[e].astype(np.uint32), start[e], ids[doc[e]], data)))
        return mail(out)

    def resolve(table: pa.Table) -> pa.Table:
        """For each chunk, runs of windows that repeat: place of the document, start, number."""
        asked = [(shard, chunk, unpacked(body)) for shard, chunk, body in opened(table)]
        rel, count, place, start, doc, data = (np.concatenate([x[2][i] for x in asked]) for i in range(6))
        rel, count = rel.astype(np.int64), count.astype(np.int64)
        segment, begin, n = runs(repeats(rel, count, doc, start, data, length), count, start)
        bounds = np.searchsorted(segment, np.cumsum([0, *(len(x[2][0]) for x in asked)])).tolist()
        return mail([(shard, chunk, packed(place[segment[a:b]], begin[a:b], n[a:b].astype(np.uint8))) for (shard, chunk, _), a, b in zip(asked, bounds, bounds[1:]) if b > a])

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _kept.empty_table()
        ids, texts = loaded(table)
        s = Segments(texts, length)
        copies = np.ones(len(s.doc), bool)
        copies[s.own(ids)] = False
        found = [(s.doc[copies], s.start[copies], s.count[copies]), *(unpacked(body) for _, _, body in opened(answers))]
        doc, start, count = (np.concatenate([np.asarray(r[i], np.int64) for r in found]) for i in range(3))
        cover = np.zeros(len(s.data) + 1, np.int32)
        np.add.at(cover, s.begins[doc] + start, 1)
        np.add.at(cover, s.begins[doc] + start + count + length - 1, -1)
        gone = np.cumsum(cover, dtype=np.int32)[:-1] > 0
        removed, spans, kept = [], [], []
        for text, b, n in zip(texts, s.begins.tolist(), s.sizes.tolist()):
            g = gone[b : b + n]
            removed.append(int(g.sum()))
            spans.append(int(np.count_nonzero(g[1:] & ~g[:-1]) + (n > 0 and bool(g[0]))) if removed[-1] else 0)
            kept.append((text[~g] if removed[-1] else text).tobytes())
        void = ids == np.iinfo(np.int64).min
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=void), "n_bytes": s.sizes, "n_removed": removed, "n_spans": spans, "kept": pa.array(kept, pa.binary())}, schema=_kept)

    by_chunk = lambda mail_: dealt.groupBy("chunk").cogroup(mail_.groupBy("chunk"))
    sketched = dealt.groupBy("chunk").applyInArrow(ask, MAIL).groupBy("shard").applyInArrow(lambda asked: sketch.answer(asked), MAIL)
    told = by_chunk(sketched).applyInArrow(candidates, MAIL).groupBy("shard").applyInArrow(resolve, MAIL)
    return by_chunk(told).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


_kept = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
