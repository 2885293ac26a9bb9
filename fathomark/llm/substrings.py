"""Removal of repeated word spans with suffix automata of reference shards.

A window is ``length`` consecutive words of one document. A word is removed when a window covers it whose
word sequence also starts in a document with a smaller id.

1. Every window has an anchor: its sub-window of ``SEED`` words with the least hash. Equal windows have equal
   anchors, so an anchor seen in one document only rules out all its windows. The first document of a repeated
   anchor is the anchor's *home*; homes are the reference shards.
2. Documents cut out the runs of windows whose anchors are repeated, and send each run to its home. All
   occurrences of a window meet there.
3. A shard holds one suffix automaton. The runs of a document are streamed through it for matching
   statistics; a window is repeated where the longest match reaches ``length``. What did not match is then
   added, so the automaton holds each reference passage once.
4. A home whose runs exceed ``shard_words`` words would not fit one task. Its anchors are dealt to as many shards as
   hold about that many words each, by hash; its runs are cut where the shard changes, and each shard has an automaton.
   Only an anchor that exceeds the bound by itself is settled by an aggregate over exact window hashes instead,
   which combines map side: the exact way for very hot passages.
5. The covered words are cut out of the documents, whole texts at a time.

Nothing is collected; what a task holds is bounded by ``shard_words`` and by one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomark.llm.names import free_names
from fathomark.llm.words import Flat, chunks, split_words, window_hashes, window_starts
from fathomark.sources.scratch import materialise

LENGTH = 13
SEED = 5
SHARD_WORDS = 400_000


class SuffixAutomaton:
    """Suffix automaton of several word sequences; a state keeps one successor inline and more in a dict."""

    def __init__(self) -> None:
        self.length, self.link = [0], [-1]
        self.word, self.goto, self.more = [None], [0], [None]

    def step(self, state: int, word) -> int:
        """The state after ``word``, or -1."""
        if self.word[state] == word:
            return self.goto[state]
        more = self.more[state]
        return more.get(word, -1) if more else -1

    def _point(self, state: int, word, to: int) -> None:
        if self.word[state] is None or self.word[state] == word:
            self.word[state], self.goto[state] = word, to
        elif self.more[state] is None:
            self.more[state] = {word: to}
        else:
            self.more[state][word] = to

    def _new(self, length: int, like: int = -1) -> int:
        self.length.append(length)
        if like < 0:
            self.link.append(0)
            self.word.append(None)
            self.goto.append(0)
            self.more.append(None)
        else:
            self.link.append(self.link[like])
            self.word.append(self.word[like])
            self.goto.append(self.goto[like])
            self.more.append(dict(self.more[like]) if self.more[like] else None)
        return len(self.length) - 1

    def _split(self, parent: int, word, state: int) -> int:
        """The state for ``parent`` + ``word`` alone, taken out of ``state``."""
        if self.length[state] == self.length[parent] + 1:
            return state
        clone = self._new(self.length[parent] + 1, like=state)
        self.link[state] = clone
        while parent >= 0 and self.step(parent, word) == state:
            self._point(parent, word, clone)
            parent = self.link[parent]
        return clone

    def add(self, words) -> None:
        last = 0
        for word in words:
            known = self.step(last, word)
            if known >= 0:
                last = self._split(last, word, known)
                continue
            new, at = self._new(self.length[last] + 1), last
            while at >= 0 and self.step(at, word) < 0:
                self._point(at, word, new)
                at = self.link[at]
            if at >= 0:
                target = self._split(at, word, self.step(at, word))
                self.link[new] = target
            last = new

    def matching_statistics(self, words) -> list[int]:
        """For each word, the length of the longest stored sequence that ends there."""
        out, state, size = [], 0, 0
        first, goto, more, link, length = self.word, self.goto, self.more, self.link, self.length
        for word in words:
            while True:
                if first[state] == word:
                    state = goto[state]
                    size += 1
                    break
                others = more[state]
                to = others.get(word, -1) if others else -1
                if to >= 0:
                    state = to
                    size += 1
                    break
                if state == 0:
                    size = 0
                    break
                state = link[state]
                size = length[state]
            out.append(size)
        return out


def _anchors(flat: Flat, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, the anchor hash of each) of all windows of a chunk."""
    grams = window_hashes(flat.hashes, seed)
    span = length - seed + 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = grams[:n].copy()
    for k in range(1, span):
        np.minimum(least, grams[k : k + n], out=least)
    starts = np.flatnonzero(window_starts(flat.first, length)[:n])
    return starts, least[starts]


def _version(text: bytes) -> int:
    """Tells apart rows that share an id."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _anchor_rows(length: int, seed: int):
    schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in chunks(batch.column("text")):
                flat = split_words(data, offsets)
                starts, anchor = _anchors(flat, length, seed)
                doc = np.searchsorted(flat.first, starts, "right") - 1
                change = np.ones(len(anchor), bool)
                change[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                anchor, doc = anchor[change], doc[change]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(ids[lo + doc])], schema=schema)

    return run


RUN_SCHEMA = pa.schema([("home", pa.int64()), ("hot", pa.bool_()), ("doc_id", pa.int64()), ("version", pa.int64()), ("start", pa.int64()), ("words", pa.string())])


def _run_rows(length: int, seed: int):
    """Runs of windows with repeated anchors, cut where the home (for split homes, its shard) changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            marks = batch.column("marks")
            for lo, hi, data, offsets in chunks(batch.column("text")):
                flat = split_words(data, offsets)
                starts, anchor = _anchors(flat, length, seed)
                cuts = np.searchsorted(starts, flat.first)
                out: list[tuple] = []
                for k in range(hi - lo):
                    a, b = cuts[k], cuts[k + 1]
                    if a == b:
                        continue
                    mark = marks[lo + k].values
                    key = mark.field("anchor").to_numpy().view(np.uint64)
                    order = np.argsort(key)
                    at = np.minimum(np.searchsorted(key[order], anchor[a:b]), len(key) - 1)
                    row = order[at]
                    known = key[row] == anchor[a:b]
                    home = np.where(known, mark.field("home").to_numpy()[row], -1)
                    hot = mark.field("hot").to_numpy(zero_copy_only=False)[row] & known
                    change = np.flatnonzero(np.r_[True, (home[1:] != home[:-1]) | (known[1:] != known[:-1])])
                    version = _version(data[offsets[k] : offsets[k + 1]].tobytes())
                    for i, j in zip(change.tolist(), [*change[1:].tolist(), b - a]):
                        if known[i]:
                            first, last = int(starts[a + i]), int(starts[a + j - 1]) + length
                            text = flat.join(np.arange(first, last)).decode("utf-8", "surrogateescape")
                            out.append((int(home[i]), bool(hot[i]), int(ids[lo + k]), version, first - int(flat.first[k]), text))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), RUN_SCHEMA)], schema=RUN_SCHEMA)

    return run


SPAN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


class _Shard:
    """The runs of one home or part of it, streamed in document order; what was new is stored when the document ends."""

    def __init__(self, home: int, length: int) -> None:
        self.home, self.length = home, length
        self.automaton, self.known = SuffixAutomaton(), {}
        self.document, self.pending = None, []

    def settle(self, document: int, text: str) -> Iterator[tuple[int, int]]:
        """Word ranges of ``text`` whose windows are stored already."""
        if document != self.document:
            for words in self.pending:
                self.automaton.add(words)
            self.document, self.pending = document, []
        number = self.known.setdefault
        words = [number(w, len(self.known)) for w in text.split(" ")]
        seen = np.array(self.automaton.matching_statistics(words)[self.length - 1 :]) >= self.length
        edge = [0, *(np.flatnonzero(seen[1:] != seen[:-1]) + 1).tolist(), len(seen)]
        for i, j in zip(edge, edge[1:]):
            if seen[i]:
                yield i, j + self.length - 1
            else:
                self.pending.append(words[i : j + self.length - 1])


def _settle(length: int):
    """Rows sorted by home, document, version and start -> spans to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            out: list[tuple] = []
            for home, doc, version, start, text in zip(*(batch.column(c).to_pylist() for c in ("home", "doc_id", "version", "start", "words"))):
                if shard is None or shard.home != home:
                    shard = _Shard(home, length)
                out += [(doc, version, start + i, start + j) for i, j in shard.settle(doc, text)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=SPAN_SCHEMA)

    return run


def _hot_windows(length: int):
    schema = pa.schema([("window", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int64()), ("start", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions, begins = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "version", "start"))
            for lo, hi, data, offsets in chunks(batch.column("words")):
                flat = split_words(data, offsets)
                starts = np.flatnonzero(window_starts(flat.first, length)[: max(0, len(flat.hashes) - length + 1)])
                doc = np.searchsorted(flat.first, starts, "right") - 1
                window = window_hashes(flat.hashes, length)[starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(window.view(np.int64)), pa.array(ids[lo + doc]), pa.array(versions[lo + doc]), pa.array(begins[lo + doc] + starts - flat.first[doc])],
                    schema=schema,
                )

    return run


KEPT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _cut(as_digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            rows: list[list] = [[], [], []]
            for lo, hi, data, offsets in chunks(batch.column("text")):
                for k in range(hi - lo):
                    raw = data[offsets[k] : offsets[k + 1]].tobytes()
                    words = raw.split()
                    removed, mine = 0, spans[lo + k]
                    if mine.is_valid and len(mine):
                        part = mine.values
                        own = part.field("version").to_numpy() == _version(raw)
                        keep = np.ones(len(words), bool)
                        for a, b in zip(part.field("start").to_numpy()[own].tolist(), part.field("stop").to_numpy()[own].tolist()):
                            keep[a:b] = False
                        removed = len(words) - int(keep.sum())
                        kept = b" ".join([w for w, k_ in zip(words, keep.tolist()) if k_])
                    else:
                        kept = b" ".join(words)
                    rows[0].append(len(words))
                    rows[1].append(removed)
                    # Without as_digest, a text that lost nothing keeps its own white space.
                    rows[2].append(hashlib.sha256(kept).hexdigest() if as_digest else (raw if removed == 0 else kept).decode("utf-8", "surrogateescape"))
            if rows[0]:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], schema=KEPT_SCHEMA)

    return run


def candidate_runs(docs: DataFrame, length: int = LENGTH, seed: int = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Runs of words that may be repeated, with the home, or the part of it, they are settled at; ``docs`` has no null ids."""
    anchors = docs.mapInArrow(_anchor_rows(length, seed), "anchor long, doc_id long")
    repeated = (
        anchors.groupBy("anchor").agg(F.min("doc_id").alias("home"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
        .filter("home < last").select("anchor", "home", "n")
    )
    # A repeated anchor stands for about half a seed span of windows, and a run has a margin at either end.
    words = F.col("n") * length
    load = repeated.groupBy("home").agg(F.sum(words).alias("load")).filter(F.col("load") > shard_words)
    split = F.col("load").isNotNull()
    # A shard's hash may equal a document's id or another's: the two shards are then one, which loses nothing.
    shard = F.pmod(F.xxhash64("anchor"), F.ceil(F.col("load") / shard_words))
    home = F.when(split, F.xxhash64("home", shard)).otherwise(F.col("home"))
    homes = repeated.join(load, "home", "left").select("anchor", home.alias("home"), (split & (words > shard_words)).alias("hot"))
    marks = anchors.join(homes, "anchor").groupBy("doc_id").agg(F.collect_set(F.struct("anchor", "home", "hot")).alias("marks"))
    return docs.join(marks, "doc_id").mapInArrow(_run_rows(length, seed), "home long, hot boolean, doc_id long, version long, start long, words string")


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id and spans (version, start, stop in words) of every document that loses words; no null ids."""
    runs = materialise(candidate_runs(docs, length, seed, shard_words), "repeat-runs")
    cold = runs.filter("not hot").select("home", "doc_id", "version", "start", "words").repartition("home").sortWithinPartitions("home", "doc_id", "version", "start")
    cold = cold.mapInArrow(_settle(length), "doc_id long, version long, start long, stop long")
    windows = runs.filter("hot").select("doc_id", "version", "start", "words").mapInArrow(_hot_windows(length), "window long, doc_id long, version long, start long")
    first = windows.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("window", "first")
    hot = windows.join(first, "window").filter("doc_id > first").select("doc_id", "version", "start", (F.col("start") + length).alias("stop"))
    return cold.unionByName(hot).groupBy("doc_id").agg(F.collect_list(F.struct("version", "start", "stop")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, shard_words: int = SHARD_WORDS, as_digest: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the text without repeated spans).

    ``as_digest`` gives the SHA-256 of the kept words instead of the text. A text that loses nothing stays as
    it is; in others the kept words are joined by one space. A null text has no words. Rows with a null id
    take no part and lose nothing. Rows that share an id do not remove each other's words. Other columns of
    ``docs`` are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.filter("doc_id is not null")
    spans = repeated_spans(known, length, seed, shard_words)
    cut = "doc_id long, n_words long, n_removed long, kept string"
    out = known.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_cut(as_digest), cut)
    empty = F.array().cast("array<struct<version:long,start:long,stop:long>>")
    return out.unionByName(docs.filter("doc_id is null").select("doc_id", "text", empty.alias("spans")).mapInArrow(_cut(as_digest), cut))


def cut_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs``, all columns, with repeated spans cut out of ``text`` (rules of ``remove_repeats``; a null stays null)."""
    spans = repeated_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null"), length, seed, shard_words)
    names = docs.columns
    cut_id, cut_spans = free_names(names, "cut_id", "cut_spans")
    spans = spans.select(F.col("doc_id").alias(cut_id), F.col("spans").alias(cut_spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cut(False)
        for batch in batches:
            few = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text"), batch.column(cut_spans)], names=["doc_id", "text", "spans"])
            for done in cutter(iter([few])):
                kept = done.column("kept")
                null = batch.column("text").is_null()
                text = pa.array([None if n else v for n, v in zip(null.to_pylist(), kept.to_pylist())], batch.column("text").type)
                yield pa.RecordBatch.from_arrays([text if c == "text" else batch.column(c) for c in names], names=names)

    joined = docs.join(spans, docs["doc_id"] == spans[cut_id], "left").select(*[docs[c] for c in names], spans[cut_spans])
    return joined.mapInArrow(run, docs.schema)
