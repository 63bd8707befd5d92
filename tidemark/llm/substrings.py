"""Substring dedup of word windows with a count-min prefilter.

A window is ``window`` consecutive words of one document. Documents are dealt to chunks of bounded size:

1. Each chunk makes a count-min sketch of its windows; the merged sketches overestimate how often each occurs.
2. Of the windows estimated to be repeated, chunks exchange 64-bit hashes, which tells those that several chunks have.
3. Those are grouped exactly, by their words: a chunk sends each distinct one once, as text, neighbours that share
   an anchor (their least hash of ``CORE`` words) together; the shard of the anchor finds the least doc_id of each.
4. A chunk groups its own windows by their words, too, and removes every word covered by a window that also starts
   in a document with a smaller doc_id.

Hashes only bring windows together; nothing is removed but by comparing words, and no repeated window is lost.
A passage that a third of all documents share is sent once by a chunk in each step.

Defined cases: a null text has no words; texts shorter than a window keep all words; a very long text is a chunk
of its own and is taken whole; rows with the same doc_id don't remove from one another; a null doc_id is smaller
than all others; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import ranges
from .exchange import CHUNK_BYTES, MAIL, Met, Sketch, U, chunks, divided, least, loaded, mail, mixed, opened, packed, sliding, unpacked

#: Rows of the sketch, and its cells for each window.
ROWS, CELLS_A_WINDOW = 2, 4
#: Words of an anchor; words of the text in a shard of the exact step, about, if all were repeated.
CORE, SHARD = 4, 1 << 21


class Words:
    """The words of documents as numbers, equal for equal words, and their windows: owner (its document), first word, hash."""

    def __init__(self, texts: Iterable[np.ndarray | bytes], window: int) -> None:
        self.window = window
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        counts, ids = [], [np.zeros(0, np.int32)]
        for text in texts:
            words = bytes(text).split()
            counts.append(len(words))
            ids.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        self.words, self.counts, self.ids = list(known), np.array(counts, np.int64), np.concatenate(ids)
        self.terms = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), U, len(self.words))[self.ids]
        self.begins = np.cumsum(self.counts) - self.counts
        n = np.maximum(self.counts - window + 1, 0)
        self.owner = np.repeat(np.arange(len(n)), n)
        self.first = ranges(self.begins, n)
        self.hash = sliding(self.terms, window)[self.first]

    def leaders(self, some: np.ndarray) -> np.ndarray:
        """For chosen windows, in order, the number of the first chosen one with the same words."""
        order = np.argsort(self.hash[some], kind="stable")
        own = some[order]
        head = np.concatenate(([True], self.hash[own[1:]] != self.hash[own[:-1]]))[: len(own)]
        top = np.maximum.accumulate(np.where(head, np.arange(len(own)), 0)) if len(own) else own
        lead = own[top]
        rest = np.flatnonzero(~head)
        a, b = self.first[own[rest]], self.first[lead[rest]]
        differ = np.zeros(len(rest), bool)
        for k in range(self.window):
            differ |= self.ids[a + k] != self.ids[b + k]
        for t in np.unique(top[rest[differ]]).tolist():  # windows of one hash and other words
            seen: dict[bytes, int] = {}
            for i in range(t, int(np.searchsorted(top, t, side="right"))):
                at = self.first[own[i]]
                lead[i] = seen.setdefault(self.ids[at : at + self.window].tobytes(), int(own[i]))
        out = np.empty(len(own), np.int64)
        out[order] = lead
        return out

    def text(self, a: int, b: int) -> bytes:
        return b" ".join([self.words[i] for i in self.ids[a:b].tolist()])

    def anchors(self) -> np.ndarray:
        """The least hash of ``CORE`` neighbouring words of each window."""
        core = min(CORE, self.window)
        return least(sliding(self.terms, core), self.window - core + 1)[self.first]


def remove_repeated(docs: DataFrame, window: int = 13, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and kept, its other words joined by one space."""
    dealt, n_chunks, total = chunks(docs.select("doc_id", "text"), chunk_bytes)
    windows = total // 6 + 1  # about: only sizes of sketch and shards hang on it
    sketch, met = Sketch(windows, ROWS, CELLS_A_WINDOW), Met(windows // 2)
    shards = max(1, -(-windows // SHARD))

    def ask(table: pa.Table) -> pa.Table:
        _, texts = loaded(table)
        return mail(sketch.ask(table.column("chunk")[0].as_py(), Words(texts, window).hash))

    def candidates(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return mail([])
        _, texts = loaded(table)
        h = Words(texts, window).hash
        return mail(met.ask(table.column("chunk")[0].as_py(), h[sketch.levels(h, answers) > 0]))

    def passages(table: pa.Table, answers: pa.Table) -> pa.Table:
        """Distinct windows that other chunks may have, as runs: number of the first window, doc_id, and text."""
        if not table.num_rows or not answers.num_rows:
            return mail([])
        chunk = table.column("chunk")[0].as_py()
        ids, texts = loaded(table)
        w = Words(texts, window)
        some = np.flatnonzero(met.shared(w.hash, answers))
        own = some[w.leaders(some) == some]
        anchor = w.anchors()[own]
        head = np.concatenate(([True], (np.diff(own) != 1) | (np.diff(w.owner[own]) != 0) | (anchor[1:] != anchor[:-1])))[: len(own)]
        at = np.flatnonzero(head)
        number, n = own[at], np.diff(np.append(at, len(own)))
        # Anchors are least hashes, so they are spread anew before they are dealt out.
        shard = divided(mixed(anchor[at] * U(5)), shards)
        order = np.argsort(shard, kind="stable")
        number, n, shard = number[order], n[order], shard[order]
        bounds = np.searchsorted(shard, np.arange(shards + 1)).tolist()
        out = []
        for s, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if b > a:
                begin = w.first[number[a:b]]
                data = b"\n".join([w.text(x, y) for x, y in zip(begin.tolist(), (begin + n[a:b] + window - 1).tolist())])
                out.append((s, chunk, packed(number[a:b], ids[w.owner[number[a:b]]], np.frombuffer(data, np.uint8))))
        return mail(out)

    def resolve(table: pa.Table) -> pa.Table:
        """For each chunk, runs of windows that start in a document with a smaller doc_id: number of the first, how many, that doc_id."""
        asked = [(shard, chunk, unpacked(body)) for shard, chunk, body in opened(table)]
        number, doc = (np.concatenate([x[2][i] for x in asked]) for i in range(2))
        w = Words([t for x in asked for t in x[2][2].tobytes().split(b"\n")], window)
        lead = w.leaders(np.arange(len(w.first)))
        own = doc[w.owner]
        smallest = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(smallest, lead, own)
        smallest = smallest[lead]
        told = np.flatnonzero(smallest < own)
        head = np.concatenate(([True], (np.diff(told) != 1) | (np.diff(w.owner[told]) != 0) | (np.diff(smallest[told]) != 0)))[: len(told)]
        at = np.flatnonzero(head)
        n, at = np.diff(np.append(at, len(told))), told[at]
        row = w.owner[at]
        begin = number[row] + w.first[at] - w.begins[row]
        bounds = np.searchsorted(row, np.cumsum([0, *(len(x[2][0]) for x in asked)])).tolist()
        return mail([(shard, chunk, packed(begin[a:b], n[a:b], smallest[at[a:b]])) for (shard, chunk, _), a, b in zip(asked, bounds, bounds[1:]) if b > a])

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _kept.empty_table()
        ids, texts = loaded(table)
        w = Words(texts, window)
        smallest = ids[w.owner]  # of the chunk's own windows; a leader comes first, so its doc_id is the least of the chunk
        lead = w.leaders(np.arange(len(w.first)))
        for _, _, body in opened(answers):
            begin, n, doc = unpacked(body)
            at = ranges(begin, n)
            smallest[at] = np.minimum(smallest[at], np.repeat(doc, n))
        first = w.first[smallest[lead] < ids[w.owner]]
        cover = np.zeros(len(w.ids) + 1, np.int64)
        np.add.at(cover, first, 1)
        np.add.at(cover, first + window, -1)
        gone = np.cumsum(cover)[:-1] > 0
        n_removed, kept = [], []
        for a, n in zip(w.begins.tolist(), w.counts.tolist()):
            g = gone[a : a + n]
            n_removed.append(int(g.sum()))
            kept.append(b" ".join([w.words[i] for i in w.ids[a : a + n][~g].tolist()]))
        void = ids == np.iinfo(np.int64).min
        return pa.table(
            {"doc_id": pa.array(ids, pa.int64(), mask=void), "n_words": w.counts, "n_removed": n_removed, "kept": pa.array(kept, pa.binary()).cast(pa.string())}, schema=_kept
        )

    by_chunk = lambda mail_: dealt.groupBy("chunk").cogroup(mail_.groupBy("chunk"))
    sketched = dealt.groupBy("chunk").applyInArrow(ask, MAIL).groupBy("shard").applyInArrow(lambda asked: sketch.answer(asked), MAIL)
    shared = by_chunk(sketched).applyInArrow(candidates, MAIL).groupBy("shard").applyInArrow(Met.answer, MAIL)
    told = by_chunk(shared).applyInArrow(passages, MAIL).groupBy("shard").applyInArrow(resolve, MAIL)
    return by_chunk(told).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


_kept = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
