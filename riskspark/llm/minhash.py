"""Document fingerprints by MinHash, near-duplicate pairs by signature bands.

A text's shingles are every five words in a row, hashed to 32 bits. Component j of its signature is the least value of
a_j * x + b_j modulo 2 ** 32 over the shingles x: with odd a_j each is a permutation of the 32-bit numbers, drawn from a
universal family. All documents of a run are hashed at once in numpy. The share of equal components estimates the Jaccard
similarity of two shingle sets. For pairs, signatures are cut into bands; texts that agree in a whole band are joined in
Spark and verified by the Jaccard similarity of their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.slices import written
from riskspark.llm.textblocks import in_batches, mixed, runs, shingle_hashes, word_hashes, words
from riskspark.operators.skew import with_groups
from riskspark.session import checkpoint_dir

WIDTH = 5
COMPONENTS = 128
ROWS_PER_BAND = 5
#: Classes of a bucket that are all compared with each other, and leaders of a larger bucket.
SMALL, LEADERS = 16, 6
#: Shingles in a block of set comparisons, about, and what each set adds to its own, so that small ones don't pile up.
BLOCK, EACH = 200_000, 200
#: Shingles of the vocabulary per matrix product.
COLUMNS = 2_048
SIMILARITY = 0.8
EMPTY = np.uint32(0xFFFFFFFF)
_draw = np.random.Generator(np.random.PCG64(7))
_A = _draw.integers(0, 1 << 31, COMPONENTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _draw.integers(0, 1 << 32, COMPONENTS, dtype=np.uint32)


def shingles(column: pa.Array, width: int = WIDTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per run of documents their 64-bit shingle hashes and the bounds by document."""
    for run in runs(column):
        found = words(run)
        yield shingle_hashes(word_hashes(run, found, lower=False), found.before, width)


def signatures(column: pa.Array, width: int = WIDTH) -> np.ndarray:
    """(documents, COMPONENTS) uint32; a text without words has EMPTY everywhere."""
    out = []
    for hashes, bounds in shingles(column, width):
        signed = np.full((len(bounds) - 1, COMPONENTS), EMPTY, np.uint32)
        some = np.flatnonzero(np.diff(bounds))
        if len(some):
            x, starts = (hashes >> np.uint64(32)).astype(np.uint32), bounds[some]
            value = np.empty_like(x)
            for j in range(COMPONENTS):
                np.multiply(x, _A[j], out=value)
                np.add(value, _B[j], out=value)
                signed[some, j] = np.minimum.reduceat(value, starts)
        out.append(signed)
    return np.concatenate(out) if out else np.zeros((0, COMPONENTS), np.uint32)


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The similarity that two fingerprints, a byte of each component, tell: the share of equal bytes, less what agrees by
    chance, which is one byte in 256 of those that differ."""
    return np.clip(((left == right).mean(1) * 256 - 1) / 255, 0, 1)


def prints(column: pa.Array) -> np.ndarray:
    """The fingerprints of texts: the low byte of each component of their signatures."""
    return signatures(column).astype(np.uint8)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many (or all) of the first of another text."""
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


PAIRED = ("kind string, part int, doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, "
          "edited_fingerprint binary, near_edited double, near_next double, text string")


def _paired(ids: list, texts: list[str]) -> list[pa.Array]:
    """The result columns for all but the last of texts in order."""
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    own, other = prints(pa.array(texts, pa.large_string())), prints(pa.array(changed, pa.large_string()))
    n = len(changed)
    return [pa.array(ids[:n], pa.int64()), pa.array(list(map(len, texts[:n])), pa.int64()),
            pa.array([sha256(t.encode()).hexdigest() for t in changed]), pa.array([row.tobytes() for row in own[:n]], pa.binary()),
            pa.array([row.tobytes() for row in other], pa.binary()), pa.array(likeness(own[:n], other)),
            pa.array(likeness(own[:n], own[1:]))]


def _ends(kind: str, part: int, key: int | None, text: str) -> pa.RecordBatch:
    schema = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()),
                        ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
    row = {"kind": kind, "part": part, "doc_id": key, "text": text}
    return pa.RecordBatch.from_pylist([row], schema)


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row: each text and
    the text that results from editing it with the next document by descending doc_id; the first comes after the last.

    A null text counts as empty; a null doc_id comes after all others; rows that share a doc_id are ordered by text. One
    row alone is its own next. Extra columns are left out.

    Documents are dealt out by range of doc_id and sorted there, texts move once; each task walks its range as a stream
    with one document held back. The last document of a range and the first of the next meet in a second, small step: one
    pair of texts per range.
    """
    checkpoint_dir(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last()]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    names = [c.split()[0] for c in PAIRED.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                ids, texts = piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()
                if held is None:
                    yield _ends("head", part, ids[0], texts[0])
                else:
                    ids, texts = [held[0], *ids], [held[1], *texts]
                held = ids[-1], texts[-1]
                n = len(ids) - 1
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(["done"] * n), pa.array([part] * n, pa.int32()), *_paired(ids, texts),
                         pa.nulls(n, pa.string())], names)
        if held:
            yield _ends("tail", part, *held)

    walked = ordered.transform(in_batches, walk, PAIRED).checkpoint()
    heads = walked.where("kind = 'head'")
    parts = heads.select("part")
    every = Window.orderBy("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(every), F.first("part").over(
        every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("then"))
    pairs = walked.where("kind = 'tail'").select("part", "doc_id", "text").join(following, "part").join(
        heads.select(F.col("part").alias("then"), F.col("text").alias("next")), "then").select("doc_id", "text", "next")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays(_paired([row["doc_id"]], [row["text"], row["next"]]), names[2:9])

    done = walked.where("kind = 'done'").select(*names[2:9])
    met = pairs.transform(in_batches, meet, ", ".join(PAIRED.split(", ")[2:9]))
    return done.unionByName(met).select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, print, bands): a hash of the shingle set, and one key per band of the signature."""
    bands = COMPONENTS // ROWS_PER_BAND

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            prints = [sha256(np.unique(h[a:b]).tobytes()).digest()[:16] for h, bounds in shingles(column, width)
                      for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            signed = signatures(column, width)[:, :bands * ROWS_PER_BAND].astype(np.uint64).reshape(-1, bands, ROWS_PER_BAND)
            keys = signed[:, :, 0].copy()
            for r in range(1, ROWS_PER_BAND):
                keys = mixed(keys) + signed[:, :, r]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints, pa.binary()),
                 pa.array(list(keys.view(np.int64)), pa.list_(pa.int64()))], ["doc_id", "print", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_batches, 
        work, "doc_id bigint, print binary, bands array<bigint>")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, set): the distinct shingle hashes of the documents `ids`; a doc_id with several texts has its least set."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(h[a:b]).view(np.int64) for h, bounds in shingles(batch.column("text"), width)
                    for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))],
                                             ["doc_id", "set"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    sets = chosen.transform(in_batches, work, "doc_id bigint, set array<bigint>")
    return sets.groupBy("doc_id").agg(F.min("set").alias("set"))


def _linked(ids: np.ndarray, component: np.ndarray, second: np.ndarray, sizes: np.ndarray, flat: np.ndarray,
            similarity: float) -> list[tuple[int, int, float]]:
    """A spanning forest (left_id, right_id, jaccard) of the pairs with different labels and that similarity: between
    the rows that are `second` and the others, or among all rows if none is. Every pair's common shingles are counted, as
    products of 0-1 matrices over the shingles that occur twice."""
    a, b = (np.flatnonzero(~second), np.flatnonzero(second)) if second.any() else [np.arange(len(ids))] * 2
    if not len(a):
        return []
    row = np.repeat(np.arange(len(ids)), sizes)
    column, times = np.unique(flat, return_inverse=True, return_counts=True)[1:]
    kept = times[column] > 1
    row, column = row[kept], (np.cumsum(times > 1) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        has = np.zeros((len(ids), COLUMNS), np.float32)
        has[row[low:high], column[low:high] - start] = 1
        common += has[a] @ has[b].T
    jaccard = common.astype(float)
    jaccard /= np.maximum(sizes[a][:, None] + sizes[b][None, :] - jaccard, 1)
    near = np.zeros((len(ids), len(ids)), bool)
    alike = np.zeros((len(ids), len(ids)))
    near[np.ix_(a, b)] = (jaccard >= similarity) & (component[a][:, None] != component[b][None, :])
    alike[np.ix_(a, b)] = jaccard
    near, alike = near | near.T, np.maximum(alike, alike.T)
    unseen, out = np.ones(len(ids), bool), []
    for root in range(len(ids)):
        todo = [root] if unseen[root] else []
        unseen[root] = False
        while todo:
            at = todo.pop()
            found = np.flatnonzero(near[at] & unseen)
            unseen[found] = False
            todo += found.tolist()
            out += [(*sorted((int(ids[at]), int(ids[f]))), float(alike[at, f])) for f in found]
    return out


def _led(pairs: DataFrame) -> DataFrame:
    """(class_id, leader, jaccard) of verified `pairs` in each direction in which one side led a large bucket."""
    towards = lambda flag, a, b: F.when(F.col(flag), F.struct(
        F.col(a).alias("class_id"), F.col(b).alias("leader")))
    return pairs.where("left_leads or right_leads").select(F.explode(F.array_compact(F.array(
        towards("right_leads", "left_id", "right_id"), towards("left_leads", "right_id", "left_id")))).alias("_")).select("_.*")


def _labels(led: DataFrame) -> DataFrame:
    """(class_id, label): the leader that most classes are alike to, of a class's leaders and itself. The links class -
    label, one per class, hold a cloud together."""
    degrees = led.groupBy("leader").agg(F.count("*").alias("degree"))
    seen = with_groups(led, degrees, ["leader"], "degree").unionByName(
        degrees.select(F.col("leader").alias("class_id"), "leader", "degree"))
    return seen.groupBy("class_id").agg(F.max_by("leader", F.struct("degree", "leader")).alias("label"))


def _rest(big: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs that link what leaders leave apart in the buckets `big` (class_id, band, key, n): within each, any two
    classes with different labels are compared by their full sets, block against block.

    Classes with a bucket's most frequent label need no comparison with each other, only with the bucket's other classes.
    """
    info = sets.select(F.col("doc_id").alias("class_id"), F.size("set").alias("size")).join(
        labels, "class_id", "left").select("class_id", "size", F.coalesce("label", "class_id").alias("component"))
    placed = big.join(info, "class_id").checkpoint()
    parts = placed.groupBy("band", "key", "component").agg(
        F.count("*").alias("m"), F.sum(F.col("size") + EACH).alias("w"))
    most = F.struct("m", "component")
    split = parts.groupBy("band", "key").agg(
        F.sum("m").alias("members"), F.count("*").alias("parts"), F.sum("w").alias("all_w"),
        F.max_by("component", most).alias("main"), F.max_by("w", most).alias("main_w")).where("parts > 1").select(
        "band", "key", "members", "main", F.ceil((F.col("all_w") - F.col("main_w")) / BLOCK).cast("int").alias("others"),
        F.ceil(F.col("main_w") / BLOCK).cast("int").alias("mains")).checkpoint()
    numbered = with_groups(placed.select("class_id", "component", "band", "key"), split, ["band", "key"], "members").withColumn(
        "own", F.col("component") == F.col("main")).withColumn("block", F.pmod(
            F.xxhash64("class_id"), F.when(F.col("own"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    # Cell (i, j): block i, of the other classes, against block j >= i; blocks of the main component come last.
    at = F.col("block") + F.when(F.col("own"), F.col("others")).otherwise(0)
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    before = F.transform(F.sequence(F.lit(0), F.least(at, F.col("others") - 1)), lambda i: cell(i, at))
    after = F.when(~F.col("own") & (at < F.col("others") + F.col("mains") - 1), F.transform(
        F.sequence(at + 1, F.col("others") + F.col("mains") - 1), lambda j: cell(at, j))).otherwise(F.array())
    dealt = numbered.select("class_id", "component", "band", "key", at.alias("at"), F.explode(F.concat(before, after)).alias(
        "cell")).select("class_id", "component", "band", "key", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"),
                        (F.col("at") > F.col("cell.i")).alias("second"))
    cells = ["band", "key", "i", "j"]
    stream = dealt.join(sets.select(F.col("doc_id").alias("class_id"), "set"), "class_id").repartition(
        *cells).sortWithinPartitions(*cells, "class_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done() -> pa.RecordBatch:
            ids, component, second, sizes, flat = (np.concatenate(c) for c in zip(*held, strict=True))
            # A cell of two blocks of which one is empty has nothing to compare.
            lone = current[2] != current[3] and (second.all() or not second.any())
            found = [] if lone else _linked(ids, component, second, sizes, flat, similarity)
            return pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                 pa.array([f[2] for f in found], pa.float64())], ["left_id", "right_id", "jaccard"])

        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in cells])
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))) if len(keys) else []
            for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                key = tuple(keys[start].tolist())
                if held and key != current:
                    yield done()
                    held = []
                current, piece = key, batch.slice(start, end - start)
                held.append((*[piece.column(c).to_numpy(zero_copy_only=False) for c in ("class_id", "component", "second")],
                             piece.column("set").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
                             piece.column("set").flatten().to_numpy(zero_copy_only=False)))
        if held:
            yield done()

    return stream.transform(in_batches, work, "left_id bigint, right_id bigint, jaccard double").dropDuplicates(
        ["left_id", "right_id"])


def near_pairs(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members gives each row's class, (doc_id, class_id), where a class is the texts with one shingle
    set; pairs has (left_id, right_id, jaccard) of distinct classes with at least that similarity, left_id < right_id.

    Candidates agree in a band of ROWS_PER_BAND components; a pair at 0.8 is missed with a chance of 5e-5, and every
    candidate is verified on the full shingle sets of whole texts. A class takes its smallest doc_id as name; null texts
    count as empty; rows without doc_id are left out; the classes of texts with equal doc_id are one. Copies collapse
    before the join, so they are never paired. In a bucket of up to SMALL classes all are compared with each other and
    every pair is listed. Larger ones, which only a large cloud of near copies or a common text can fill, have too many
    pairs to list; there the pairs link any two classes that chains of pairs link. Each class is first compared with
    LEADERS others, the first by one hash for all bands, so that buckets of one cloud share them, and with the one that
    shares most buckets; of these a class keeps one link, to the leader that most classes are alike to. What is still
    apart is then compared in full, so work grows with the square only of what these links leave apart.
    """
    checkpoint_dir(docs.sparkSession)
    rows = _sketches(docs.where("doc_id is not null"), width).checkpoint()
    classes = rows.groupBy("print").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("n"), F.first("bands").alias("bands")).checkpoint()
    members = with_groups(rows.select("doc_id", "print"), classes.select("print", "class_id", "n"), ["print"], "n").select(
        "doc_id", "class_id")
    keyed = classes.select("class_id", F.posexplode("bands").alias("band", "key")).withColumn(
        "draw", F.xxhash64("class_id"))
    buckets = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    inside = with_groups(keyed, buckets, ["band", "key"], "n").select("class_id", "band", "key", "draw", "n").checkpoint()
    buckets = inside.groupBy("band", "key").agg(F.first("n").alias("n"))
    # The smallest draws of a bucket: below a bound that leaves several times as many, found without a sort.
    lead = inside.where((F.col("n") <= SMALL) | (
        F.col("draw").cast("double") / 2.0 ** 64 + 0.5 < F.lit(4.0 * LEADERS) / F.col("n")))
    most = F.when(F.first("n") <= SMALL, F.lit(SMALL)).otherwise(F.lit(LEADERS))
    heads = lead.groupBy("band", "key").agg(
        F.array_sort(F.collect_list(F.struct("draw", "class_id"))).alias("all"), most.alias("most")).select(
        "band", "key", F.slice("all", 1, F.col("most"))["class_id"].alias("leaders"))
    big = inside.where(F.col("n") > SMALL).select("class_id", "band", "key", "n")
    weights = big.groupBy("class_id").agg(F.sum("n").alias("weight"))
    central = big.join(weights, "class_id").groupBy("band", "key").agg(
        F.max_by("class_id", F.struct("weight", "class_id")).alias("central"))
    heads = buckets.join(heads, ["band", "key"], "left").join(central, ["band", "key"], "left").select(
        "band", "key", "n", F.array_compact(F.array_append(F.coalesce("leaders", F.array()), F.col("central"))).alias("leaders"))
    larger = (F.col("n") > SMALL) & (F.col("class_id") != F.col("leader"))
    near = with_groups(inside.select("class_id", "band", "key"), heads, ["band", "key"], "n").select(
        "class_id", F.explode("leaders").alias("leader"), "n").where("class_id <> leader").groupBy(
        F.least("class_id", "leader").alias("left_id"), F.greatest("class_id", "leader").alias("right_id")).agg(
        F.bool_or(F.col("n") <= SMALL).alias("listed"),
        F.bool_or(larger & (F.col("leader") < F.col("class_id"))).alias("left_leads"),
        F.bool_or(larger & (F.col("leader") > F.col("class_id"))).alias("right_leads")).checkpoint()
    ids = written(near.select(F.explode(F.array("left_id", "right_id")).alias("doc_id")).distinct())
    sets = _sets(docs, ids, width).checkpoint()
    sides = [sets.select(F.col("doc_id").alias(f"{s}_id"), F.col("set").alias(f"{s}_set")) for s in ("left", "right")]
    common = F.size(F.array_intersect("left_set", "right_set"))
    jaccard = F.when(F.size("left_set") + F.size("right_set") == 0, 1.0).otherwise(
        common / (F.size("left_set") + F.size("right_set") - common))
    verified = near.join(sides[0], "left_id").join(sides[1], "right_id").select(
        "left_id", "right_id", jaccard.alias("jaccard"), "listed", "left_leads", "right_leads").where(
        F.col("jaccard") >= similarity)
    names = ["left_id", "right_id", "jaccard"]
    if big.isEmpty():
        return members, verified.select(names)
    verified = verified.checkpoint()
    labels = _labels(_led(verified)).checkpoint()
    held = labels.where("class_id <> label").select(
        F.least("class_id", "label").alias("left_id"), F.greatest("class_id", "label").alias("right_id")).distinct()
    kept = verified.join(held.withColumn("held", F.lit(True)), ["left_id", "right_id"], "left").where("listed or held")
    rest = _rest(big, labels, sets, similarity)
    return members, kept.select(names).unionByName(rest).dropDuplicates(["left_id", "right_id"])
