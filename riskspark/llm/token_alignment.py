"""Alignment of two tokenizers over a corpus, with corpus-wide counts of token pairs by minimal perfect hashing.

Both tokenizers cut the same bytes, so tokens align where both end: these offsets cut a text into groups, and all tokens
of A and of B in one group are linked. Every text is encoded once, into a table of ids. Encoding cuts texts into chunks at
white space that neither tokenizer's tokens span; a chunk's tokens depend on the chunk alone and are kept per worker.

The count of a pair is the number of documents that hold it linked. First pass: tasks align their documents and write
pairs with partial counts. The distinct pairs are dealt into shards by hash; each shard gets a minimal perfect hash of
its pairs. Partial counts become dense vectors indexed by that hash, keys verified, and the vectors of a shard are summed
in a tree. Second pass: documents are aligned again and look their pairs up, the most frequent ones (a bounded number) in
a perfect hash that every task gets, all others by a join with the counts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.perfect_hash import PerfectHash
from riskspark.llm.sentencepiece_codec import MARK
from riskspark.llm.slices import written
from riskspark.llm.textblocks import RUN_BYTES, in_batches

#: Pairs in a shard, partial counts that become one vector, and vectors summed at a time.
SHARD_PAIRS, VECTOR_ROWS, FAN = 1 << 17, 1 << 20, 8
#: Pairs that a task holds before it writes them.
HELD_PAIRS = 1 << 20
#: Most frequent pairs that every task gets: 12 bytes each.
FREQUENT = 1 << 20
#: Bytes of chunks that a worker remembers, chunks that A encodes at a time, tokens of A that are aligned at a time.
CACHE_BYTES, TOGETHER, RUN_TOKENS = 3_000_000, 64, 1 << 18
#: Pairs are below this power of two; the row stands above.
PAIR_BITS = 32

#: White space in Unicode, and characters that some regular expressions count as such.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
_DOUBTFUL = "\x1c\x1d\x1e\x1f᠎​﻿"


def _alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... start + size - 1 for each entry, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Chunks:
    """What a worker remembers: numbered chunks and their tokens under A and B."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.chars = 0
        self.tokens = [np.zeros(0, np.int32)] * 2
        self.starts = [np.zeros(1, np.int64)] * 2

    def add(self, new: list[str], chars: int, sides: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """`sides` has the flat ids and the number of ids per chunk."""
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.chars += chars
        for side, (ids, sizes) in enumerate(sides):
            self.tokens[side] = np.concatenate([self.tokens[side], ids])
            self.starts[side] = np.concatenate([self.starts[side], self.starts[side][-1] + np.cumsum(sizes)])

    def gather(self, side: int, chunks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a list of chunks, and where each text's ids begin, given where its chunks do."""
        starts = self.starts[side]
        sizes = starts[chunks + 1] - starts[chunks]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return self.tokens[side][_expanded(starts[chunks], sizes)], before[bounds]


class Tokens(NamedTuple):
    """Ids of several texts, flat, and where each text's begin (one bound more than texts)."""

    a: np.ndarray
    a_bounds: np.ndarray
    b: np.ndarray
    b_bounds: np.ndarray


class Groups(NamedTuple):
    """Where groups begin among the tokens of A and of B, and where each text's groups begin (one bound more each)."""

    a: np.ndarray
    b: np.ndarray
    rows: np.ndarray


class Aligner:
    """Tokens, groups and links of texts under a byte-level tokenizer (A) and a SentencePiece model (B)."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        bytes_of = _alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(bytes_of[c] for c in token)
        size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.lengths = [np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes)]
        self.types = [np.uint16 if len(table) <= 1 << 16 else np.uint32 for table in (self.a_bytes, self.b_bytes)]
        self.width = size
        self.mark = self.b.piece_to_id(MARK)
        # Chunks begin with white space that no piece of B has behind another character, after a character that is none.
        inside = {c for p in pieces for before, c in zip(p, p[1:], strict=False) if (before, c) != (MARK, MARK)}
        opens = [c for c in _WHITE if (MARK if c == " " else c) not in inside]
        self.quick = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
        self.careful = re.compile(f"(?<=[^{_WHITE}{_DOUBTFUL}])(?=[{''.join(opens)}])") if opens else re.compile("(?!)")
        self.odd = re.compile(f"[{''.join(c for c in _WHITE if c not in opens)}{_DOUBTFUL}]")
        self.memory = Chunks()
        self.digits = [self._digits(len(table)) for table in (self.a_bytes, self.b_bytes)]

    @staticmethod
    def _digits(n: int) -> np.ndarray:
        """The decimal digits of 0..n-1 and a place for a separator, zeros in front."""
        return np.array([list(f"{i}".rjust(10, "\0").encode()) + [0] for i in range(n)], np.uint8)[:, -len(str(n)) - 1:]

    def chunks(self, text: str) -> list[str]:
        """Space and text, cut. A text with the mark itself has none: B can't tell the mark from a space."""
        if not text or MARK in text:
            return []
        text = " " + text
        return self.careful.split(text) if self.odd.search(text) else self.quick.findall(text)

    def learn(self, new: list[str]) -> None:
        """Encodes chunks. Their tokens don't span chunks, so A may encode several at once and is cut by bytes after that."""
        wholes = [c.encode() for c in new]
        ends = np.cumsum([len(w) for w in wholes])
        joined = ["".join(new[k:k + TOGETHER]) for k in range(0, len(new), TOGETHER)]
        ours = np.concatenate([np.array(e.ids, np.int32) for e in self.a.encode_batch_fast(joined, add_special_tokens=False)])
        n_ours = np.diff(np.searchsorted(np.cumsum(self.lengths[0][ours]), ends, side="right"), prepend=0)
        # B puts a mark first: it stands for the space that a chunk begins with, or is taken off again.
        spaced = [c.startswith(" ") for c in new]
        theirs = self.b.encode([c[1:] if s else c for c, s in zip(new, spaced, strict=True)], num_threads=1)
        theirs = [(ids or [self.mark]) if s else ids[1:] for ids, s in zip(theirs, spaced, strict=True)]
        n_theirs = np.array(list(map(len, theirs)), np.int64)
        flat = np.fromiter(chain.from_iterable(theirs), np.int32, n_theirs.sum())
        whole = b"".join(wholes)
        if whole != b"".join([self.a_bytes[i] for i in ours.tolist()]):
            raise ValueError("the byte-level tokenizer does not keep its text")
        if whole != b"".join([self.b_bytes[i] for i in flat.tolist()]):  # those that differ have no tokens under B
            kept = np.array([b"".join([self.b_bytes[i] for i in ids]) == w for ids, w in zip(theirs, wholes, strict=True)])
            flat, n_theirs = flat[np.repeat(kept, n_theirs)], np.where(kept, n_theirs, 0)
        self.memory.add(new, len(whole), [(ours, n_ours), (flat, n_theirs)])

    def encode(self, texts: list[str | None]) -> Tokens:
        """The ids of texts, none for those whose tokens don't give back their bytes."""
        if self.memory.chars > CACHE_BYTES:
            self.memory = Chunks()
        cut = [self.chunks(t or "") for t in texts]
        known = self.memory.known
        if new := set(chain.from_iterable(cut)).difference(known):
            self.learn(sorted(new))
        bounds = np.cumsum([0, *map(len, cut)])
        chunks = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64, bounds[-1])
        bad = np.diff(self.memory.starts[1])[chunks] == 0
        if bad.any():
            row = np.repeat(np.arange(len(cut)), np.diff(bounds))
            kept = ~np.isin(row, row[bad])
            chunks, bounds = chunks[kept], np.concatenate([[0], np.cumsum(kept)])[bounds]
        return Tokens(*self.memory.gather(0, chunks, bounds), *self.memory.gather(1, chunks, bounds))

    def groups(self, tokens: Tokens) -> Groups:
        """Cuts tokens where both tokenizers end one. All texts are one run of bytes, which both end in turn."""
        ours, theirs = np.cumsum(self.lengths[0][tokens.a]), np.cumsum(self.lengths[1][tokens.b])
        size = int(ours[-1]) + 1 if len(ours) else 1
        starts = []
        for one, other in ((ours, theirs), (theirs, ours)):
            ends = np.zeros(size, bool)
            ends[other] = True
            starts.append(np.concatenate([[0], np.flatnonzero(ends[one]) + 1]))
        return Groups(*starts, np.searchsorted(starts[0], tokens.a_bounds))

    def links(self, tokens: Tokens, groups: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pair, times) of every text's distinct links, by row and pair; a pair is A id * width + B id."""
        ours, theirs = np.diff(groups.a), np.diff(groups.b)
        often = np.repeat(theirs, ours)
        pair = np.repeat(tokens.a.astype(np.int64) * self.width, often) + tokens.b[
            _expanded(np.repeat(groups.b[:-1], ours), often)]
        per_row = np.add.reduceat(np.append(ours * theirs, 0), groups.rows[:-1]) if len(groups.rows) > 1 else ours[:0]
        per_row = np.where(np.diff(groups.rows) > 0, per_row, 0)
        pair += np.repeat(np.arange(len(per_row), dtype=np.int64) << PAIR_BITS, per_row)
        distinct, times = np.unique(pair, return_counts=True)
        return distinct >> PAIR_BITS, distinct & ((1 << PAIR_BITS) - 1), times

    def texts(self, tokens: Tokens, groups: Groups) -> list[bytes]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
        ours, theirs = np.diff(groups.a), np.diff(groups.b)
        width = max(d.shape[1] for d in self.digits)
        flat = np.zeros((len(tokens.a) + len(tokens.b), width), np.uint8)
        for ids, digits, starts, mark, at in (
                (tokens.a, self.digits[0], groups.a, b"|", np.arange(len(tokens.a)) + np.repeat(groups.b[:-1], ours)),
                (tokens.b, self.digits[1], groups.b, b";", np.arange(len(tokens.b)) + np.repeat(groups.a[1:], theirs))):
            rows = digits[ids]
            rows[:, -1] = ord(",")
            rows[starts[1:] - 1, -1] = mark[0]
            flat[at, width - rows.shape[1]:] = rows
        used = flat != 0
        bounds = np.concatenate([[0], np.cumsum(used.sum(1))])[tokens.a_bounds + tokens.b_bounds].tolist()
        data = flat[used].tobytes()
        return [data[x:y - 1] if y > x else b"" for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    """One per worker and pair of files."""
    if (a_file, b_file) not in _aligners:
        _aligners[a_file, b_file] = Aligner(a_file, b_file)
    return _aligners[a_file, b_file]


def _runs(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first, texts) of about RUN_BYTES each."""
    texts, first, size = [], 0, 0
    for k, value in enumerate(column):
        texts.append(value.as_py())
        size += len(texts[-1] or "")
        if size >= RUN_BYTES:
            yield first, texts
            texts, first, size = [], k + 1, 0
    if texts:
        yield first, texts


def tokenized(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(part, place, doc_id, a, b) row by row: the ids under both tokenizers as unsigned numbers of two bytes (four, where
    a vocabulary needs them); part and place name a row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, place = aligner(a_file, b_file), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, texts in _runs(batch.column("text")):
                tokens, n = own.encode(texts), len(texts)
                packed = []
                for ids, bounds, kind in ((tokens.a, tokens.a_bounds, own.types[0]), (tokens.b, tokens.b_bounds, own.types[1])):
                    data, size = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                    packed.append(pa.array([data[x * size:y * size] for x, y in zip(
                        bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part), pa.int32()), pa.array(place + np.arange(n)),
                     batch.column("doc_id").slice(first, n), *packed], ["part", "place", "doc_id", "a", "b"])
                place += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(
        in_batches, work, "part int, place bigint, doc_id bigint, a binary, b binary")


def _unpacked(batch: pa.RecordBatch, own: Aligner) -> Iterator[tuple[int, Tokens]]:
    """(first, tokens) of runs of rows with about RUN_TOKENS tokens of A."""
    sides = []
    for name, kind in (("a", own.types[0]), ("b", own.types[1])):
        column = batch.column(name).cast(pa.large_binary())
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
        ids = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]].view(kind) if data is not None and bounds[-1] else np.zeros(
            0, kind)
        sides.append((ids, (bounds - bounds[0]) // np.dtype(kind).itemsize))
    (a, a_bounds), (b, b_bounds) = sides
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(a_bounds, a_bounds[first] + RUN_TOKENS, side="right")) - 1)
        x, y = a_bounds[first:last + 1], b_bounds[first:last + 1]
        yield first, Tokens(a[x[0]:x[-1]].astype(np.int32), x - x[0], b[y[0]:y[-1]].astype(np.int32), y - y[0])
        first = last


def _sums(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Exact totals by row, for rows in order."""
    before = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(before[np.searchsorted(row, np.arange(rows + 1))])


def _summed(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate(counts), len(keys)).astype(np.int64)


def partial_counts(tokens: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(part, pair, n): in how many documents of a part each pair is linked; a pair may have several rows in a part."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = aligner(a_file, b_file), TaskContext.get().partitionId()
        pairs, counts, held = [], [], 0

        def out() -> pa.RecordBatch:
            keys, n = _summed(pairs, counts)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), part), pa.int32()), pa.array(keys), pa.array(n)], ["part", "pair", "n"])

        for batch in batches:
            for _, some in _unpacked(batch, own):
                keys, n = np.unique(own.links(some, own.groups(some))[1], return_counts=True)
                pairs.append(keys)
                counts.append(n)
                held += len(keys)
                if held > 4 * HELD_PAIRS:
                    keys, n = _summed(pairs, counts)
                    pairs, counts, held = [keys], [n], len(keys)
                    if held > HELD_PAIRS:
                        yield out()
                        pairs, counts, held = [], [], 0
        if pairs:
            yield out()

    return tokens.select("a", "b").transform(in_batches, work, "part int, pair bigint, n bigint")


HASHES = "shard int, sizes array<bigint>, bits binary, keys binary"
VECTORS = "shard int, branch int, vector binary"


def _hashed(table: pa.Table) -> PerfectHash:
    row = table.slice(0, 1).to_pylist()[0]
    return PerfectHash(row["sizes"], np.frombuffer(row["bits"], np.uint64), np.frombuffer(row["keys"], np.int64))


def pair_counts(partial: DataFrame, shard_pairs: int = SHARD_PAIRS, vector_rows: int = VECTOR_ROWS) -> DataFrame:
    """(pair, n) with n the sum of the partial counts of each pair, by perfect hashing; `partial` is read twice."""
    distinct, rows = partial.agg(F.approx_count_distinct("pair", 0.02), F.count("*")).first()
    shards = max(1, -(-distinct // shard_pairs))
    branches = max(1, -(-rows // (shards * vector_rows)))
    shard = F.pmod(F.xxhash64("pair"), F.lit(shards)).cast("int").alias("shard")

    def build(table: pa.Table) -> pa.Table:
        made = PerfectHash.of(table.column("pair").to_numpy())
        return pa.Table.from_pylist([{
            "shard": table.column("shard")[0].as_py(), "sizes": made.sizes, "bits": made.bits.tobytes(),
            "keys": made.keys.tobytes()}], pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int64())),
                                                      ("bits", pa.binary()), ("keys", pa.binary())]))

    def vector(key: tuple, numbers: np.ndarray, counts: np.ndarray, size: int) -> pa.Table:
        total = np.zeros(size, np.int64)
        np.add.at(total, numbers, counts)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()),
                         pa.array([total.tobytes()], pa.binary())], names=["shard", "branch", "vector"])

    def dense(key: tuple, counted: pa.Table, hashes: pa.Table) -> pa.Table:
        if not counted.num_rows:
            return vector(key, np.zeros(0, np.int64), np.zeros(0, np.int64), len(_hashed(hashes).keys))
        made = _hashed(hashes)
        numbers = made.numbers(counted.column("pair").to_numpy())
        if (numbers < 0).any():
            raise ValueError("a pair is missing from the hash of its shard")
        return vector(key, numbers, counted.column("n").to_numpy(), len(made.keys))

    def added(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py(), np.int64) for v in table.column("vector"))
        return vector(key, np.arange(len(total)), total, len(total))

    def listed(key: tuple, totals: pa.Table, hashes: pa.Table) -> pa.Table:
        return pa.table([pa.array(_hashed(hashes).keys), pa.array(
            np.frombuffer(totals.column("vector")[0].as_py(), np.int64))], names=["pair", "n"])

    hashes = written(partial.select("pair").distinct().select("pair", shard).groupBy("shard").applyInArrow(build, HASHES))
    spread = hashes.withColumn("branch", F.explode(F.sequence(F.lit(0), F.lit(branches - 1))))
    branch = F.pmod(F.xxhash64("part", "pair"), F.lit(branches)).cast("int").alias("branch")
    totals = partial.select("pair", "n", shard, branch).groupBy("shard", "branch").cogroup(
        spread.groupBy("shard", "branch")).applyInArrow(dense, VECTORS)
    while branches > 1:
        branches = -(-branches // FAN)
        totals = totals.withColumn("branch", F.floor(F.col("branch") / FAN).cast("int")).groupBy(
            "shard", "branch").applyInArrow(added, VECTORS)
    return totals.groupBy("shard").cogroup(hashes.groupBy("shard")).applyInArrow(listed, "pair bigint, n bigint")


ALIGNED = ("part int, place bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
           "n_best bigint, count_sum bigint, groups_sha256 string, groups string, "
           "rest array<struct<pair:bigint,times:bigint,best:bigint>>")


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Pairs that are frequent enough that at most `most` of them are, on a scale of eighths of a power of two."""
    step = F.floor(F.log2("n") * 8).cast("int")
    reached, least = 0, None
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        reached += row.n
        if reached > most:
            break
        least = row.step
    return counts.where(step >= least) if least is not None else counts.limit(0)


def aligned(docs: DataFrame, a_file: str, b_file: str, frequent: int = FREQUENT, with_groups: bool = False) -> DataFrame:
    """Per row (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and `groups`, null unless asked for.

    `n_best` counts links whose pair is linked in as many documents as any pair of its A id, ties included; `count_sum`
    adds up the counts over all links. Null and empty texts, and texts whose tokens don't give back their bytes (those
    with U+2581), have zeros and an empty digest. Repeated rows are documents of their own and repeat; a null doc_id
    stays null; other columns are left out, whatever their names. An empty table gives an empty one.
    """
    local = aligner(a_file, b_file)
    tokens = written(tokenized(docs, a_file, b_file))
    counts = written(pair_counts(written(partial_counts(tokens, a_file, b_file))))
    best = np.zeros(len(local.a_bytes), np.int64)
    highest = counts.groupBy(F.floor(F.col("pair") / local.width).alias("a")).agg(F.max("n").alias("n")).toArrow()
    best[highest.column("a").to_numpy()] = highest.column("n").to_numpy()  # one number per entry of A
    top = _most_frequent(counts, frequent).toArrow()
    hashed = PerfectHash.of(top.column("pair").to_numpy())
    dense = np.zeros(len(hashed.keys) + 1, np.int64)  # the last one for pairs that aren't there
    dense[hashed.numbers(top.column("pair").to_numpy())] = top.column("n").to_numpy()
    width = local.width

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_file, b_file)
        for batch in batches:
            for first, some in _unpacked(batch, own):
                rows = len(some.a_bounds) - 1
                groups = own.groups(some)
                row, pair, times = own.links(some, groups)
                number = hashed.numbers(pair)
                count, most = dense[number], best[pair // width]
                total = lambda values, row=row, rows=rows: pa.array(_sums(row, values, rows))
                texts = own.texts(some, groups)
                rare = np.flatnonzero(number < 0)
                bounds = np.searchsorted(row[rare], np.arange(rows + 1))
                rest = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(pair[rare]), pa.array(times[rare]), pa.array(most[rare])], ["pair", "times", "best"]))
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(c).slice(first, rows) for c in ("part", "place", "doc_id")],
                    *[pa.array(np.diff(bounds)) for bounds in (some.a_bounds, some.b_bounds, groups.rows)],
                    total(times), total(np.where((number >= 0) & (count == most), times, 0)), total(count * times),
                    pa.array([sha256(t).hexdigest() if t else "" for t in texts]),
                    pa.array([t.decode() for t in texts] if with_groups else [None] * rows, pa.string()), rest],
                    [c.split()[0] for c in ALIGNED.split(", ")])

    rows = written(tokens.transform(in_batches, work, ALIGNED))
    rare = rows.select("part", "place", F.explode("rest").alias("_")).select("part", "place", "_.*")
    more = rare.join(counts, "pair").groupBy("part", "place").agg(
        F.sum(F.col("n") * F.col("times")).alias("_sum"),
        F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
    plus = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
    return rows.join(more, ["part", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "_best"), plus("count_sum", "_sum"), "groups_sha256",
        "groups")
