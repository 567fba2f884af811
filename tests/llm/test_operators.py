"""Every operator against a plain version, on documents with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import fixtures as fx
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from riskspark.llm import (
    labelled, minhash, mixing, poly_dedup, quality_pu, secret_scan, sentencepiece_codec, sharding, simhash_bk, slices,
    suffix_tree, textblocks, toxicity_knn)
from riskspark.llm.queries import model_file
from riskspark.operators.skew import with_groups


@pytest.fixture(scope="module")
def docs(spark):
    return fx.documents(spark).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return fx.documents(spark, [])


def labels_of(spark, some):
    return spark.createDataFrame(some, "doc_id long, quality int, toxic int")


# Helpers


def test_words_end_at_documents():
    column = pa.array(["ab cd", "ef", "", None, " \tgh\n"])
    (run,) = textblocks.runs(column)
    found = textblocks.words(run)
    assert [bytes(run.data[a:b]) for a, b in zip(found.starts, found.ends)] == [b"ab", b"cd", b"ef", b"gh"]
    assert found.before.tolist() == [0, 2, 3, 3, 3, 4]


def test_word_hashes_depend_on_the_word_alone():
    texts = ["x " * 50 + "Harbour", "harbour", "HARBOUR bells", "Harbour"]
    (run,) = textblocks.runs(pa.array(texts))
    found = textblocks.words(run)
    lower, exact = (textblocks.word_hashes(run, found, lower=x) for x in (True, False))
    at = [50, 51, 52, 54]
    assert len(set(lower[at].tolist())) == 1 and len(set(exact[at].tolist())) == 3


def test_running_totals_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, ""]), rng.choice([0.25, rng.random()]), i, rng.randrange(5)) for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, p double, i int, v int")
    out = slices.running(frame, ["g"], "p", ["i"], {"rank": F.lit(1), "sum": F.col("v")}, per_slice=20).collect()
    for r in out:
        before = [x for x in rows if x[0] == r.g and (x[1], x[2]) < (r.p, r.i)]
        assert (r["rank"], r["sum"]) == (len(before), sum(x[3] for x in before))
    assert len(out) == 500


def test_hot_and_cold_keys_join_alike(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 600, 1).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    out = with_groups(rows, groups, ["k"], "n", hot_share=10).groupBy("n").count().collect()
    assert {r.n: r["count"] for r in out} == {600: 600, 1: 400}


# 1


def test_suffix_tree_base_and_counts(spark, docs):
    taught = suffix_tree.taught(docs, 5, 1)
    tree, vocabulary = suffix_tree.learn(taught)
    out = suffix_tree.score(docs, tree, vocabulary).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(w for r in fx.rows() if not held(r[0]) for w in [*fx.words(r[1]), None])
    n, v = sum(count.values()), len(count)
    assert (tree.tokens, tree.distinct) == (n, v)

    def plain(r):
        tokens = [*fx.words(r[1]), None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        return r[0] or 0, len(tokens), sum(count[w] > 0 for w in tokens), round(base, 6)

    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == sorted(map(plain, fx.rows()))
    assert all(r.score < 0 for r in out)
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_suffix_tree_distributions_sum_to_one(spark):
    rng = random.Random(5)
    follow = {w: rng.choices("abcdefgh", k=3) for w in "abcdefgh"}

    def text():
        w, out = "a", []
        for _ in range(200):
            w = rng.choice(follow[w]) if rng.random() < 0.9 else rng.choice("abcdefgh")
            out.append(w)
        return " ".join(out)

    frame = spark.createDataFrame([(i, text()) for i in range(40)], "doc_id long, text string")
    tree, vocabulary = suffix_tree.learn(frame)
    rows = vocabulary.toPandas()
    names = rows.word.to_numpy().astype(np.int64).view(np.uint64)
    base = tree.root(rows.n.to_numpy())
    unknown = math.log(0.5 / (tree.tokens + 0.5 * (tree.distinct + 1)))
    assert sum(int(x.keep.sum()) for x in tree.levels) > 5
    for k, level in enumerate(tree.levels, 1):
        for h in level.hashes[level.keep][:20]:
            known = np.exp(tree.log_p(k, np.full(len(names), h), names, base)).sum()
            other = np.exp(tree.log_p(k, np.array([h]), np.array([1], np.uint64), np.array([unknown])))[0]
            assert known + other == pytest.approx(1)
    out = suffix_tree.score(frame, tree, vocabulary).toPandas()
    assert (out.score - out.base_score).sum() > 0.1 * out.n_tokens.sum()
    # Without broadcast words all terms come through the join and the base stays the same.
    bare = tree._replace(words=tree.words[:0], counts=tree.counts[:0], levels=[])
    suffix_tree.FREQUENT, usual = 2.0, suffix_tree.FREQUENT
    try:
        again = suffix_tree.score(frame, bare, vocabulary).toPandas()
    finally:
        suffix_tree.FREQUENT = usual
    both = out.merge(again, on="doc_id")
    assert np.allclose(both.base_score_x, both.base_score_y) and (both.n_known_x == both.n_known_y).all()


def test_suffix_tree_by_brute_force_with_nothing_broadcast(spark, monkeypatch):
    rng = random.Random(9)
    follow = {(a, b): rng.choice("abcd") for a in "abcd" for b in "abcd"}

    def text():
        out = ["a", "b"]
        for _ in range(rng.randrange(60)):
            usual = follow.get(tuple(out[-2:]))
            out.append(usual if usual and rng.random() < 0.8 else rng.choice([*"abcdabcd", f"w{rng.randrange(400)}"]))
        return " ".join(out)

    rows = [(i, text()) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    # The sequences of the whole tree, as plain dictionaries: context and next word.
    tokens = {i: [None, *t.split(), None] for i, t in rows}
    seen = [Counter(tuple(x[p - k:p + 1]) for x in tokens.values() for p in range(max(k, 1), len(x))) for k in range(4)]
    n, v = sum(seen[0].values()), len(seen[0])
    states = {}

    def logp(context, word):
        while context and context not in states:
            context = context[1:]
        if not context:
            return math.log((seen[0][(word,)] + 0.5) / (n + 0.5 * (v + 1)))
        left, listed = states[context]
        return listed[word] if word in listed else left + logp(context[1:], word)

    for k in (1, 2, 3):
        nexts, kept = defaultdict(dict), {}
        for (*c, w), m in seen[k].items():
            if m >= 2:
                nexts[tuple(c)][w] = m
        for c, found in nexts.items():
            of = sum(m for (*d, _), m in seen[k].items() if tuple(d) == c)
            below = {w: logp(c[1:], w) for w in found}
            listed = {w: math.log((m - 0.5) / of) for w, m in found.items()}
            room = lambda p: math.log(max(1 - sum(math.exp(x) for x in p.values()), 1e-12))
            left = room(listed) - room(below)
            gain = sum(m * (listed[w] - below[w]) for w, m in found.items()) + (of - sum(found.values())) * left
            if gain > 0.5 * math.log(n) * len(found):
                kept[c] = left, listed
        states.update(kept)
    asked = [*rows, (100, "never seen w1 a b"), (101, None)]
    want = {i: sum(logp(tuple([None, *(t or "").split()][max(0, p - 2):p + 1]), w) for p, w in enumerate([*(t or "").split(), None]))
            / math.log(10) for i, t in asked}
    assert {1, 2} <= {len(c) for c in states}
    docs = spark.createDataFrame(asked, "doc_id long, text string")
    for frequent, share in ((2.0, 2.0), (0.01, 0.01)):
        monkeypatch.setattr(suffix_tree, "FREQUENT", frequent)
        tree, vocabulary = suffix_tree.learn(frame, frequent=frequent, context=share, pair=share)
        got = {r.doc_id: r.score for r in suffix_tree.score(docs, tree, vocabulary).collect()}
        assert got == pytest.approx(want)


def test_suffix_tree_leaves_no_shuffle_files(spark, docs):
    """What each query shuffled goes when it ends; the scores are whole all the same, and can be read again."""
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files() -> set[str]:
        every = store.getAllFiles()
        return {name for i in range(every.size()) if (name := every.apply(i).getName()).startswith("shuffle_")}

    rows = docs.count()  # they are cached from here on
    before = files()
    tree, vocabulary = suffix_tree.learn(docs)
    out = suffix_tree.score(docs, tree, vocabulary)
    for _ in range(40):  # they go in the background
        if not (left := files() - before):
            break
        time.sleep(0.25)
    assert not {name.split("_")[1] for name in left}
    assert out.count() == rows and out.count() == rows
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_suffix_tree_of_nothing(spark, docs, nothing):
    tree, vocabulary = suffix_tree.learn(nothing)
    assert suffix_tree.score(nothing, tree, vocabulary).count() == 0
    assert {r.n_known for r in suffix_tree.score(docs, tree, vocabulary).collect()} == {0}


# 2


def test_interleaving(docs, nothing):
    out = sharding.interleave(docs, 7).collect()
    rows = fx.rows()
    size = lambda r: len((r[1] or "").encode()) + 16
    crc = lambda r: zlib.crc32((r[1] or "").encode())
    assert Counter((r.doc_id, r.source, r["size"], r.text_crc32) for r in out) == Counter(
        (r[0], r[3], size(r), crc(r)) for r in rows)
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append(r)
    counts = [len(shards[k]) for k in range(7)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in shards.values())
    for source in {r[3] for r in rows}:
        per = [sum(r.source == source for r in shards[k]) for k in range(7)]
        assert max(per) - min(per) <= 2
    assert sharding.interleave(nothing, 7).count() == 0
    again = sharding.interleave(docs.repartition(2), 7).collect()
    key = lambda r: (r.shard, r.slot, r.doc_id or 0, r["size"])
    assert sorted(map(key, again)) == sorted(map(key, out))


# 3


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_file())


def test_encoding_equals_the_library(docs, library, nothing):
    out = sentencepiece_codec.encode_documents(docs, model_file()).collect()
    want = Counter((r[0], tuple(library.encode(r[1] or "")), library.decode(library.encode(r[1] or ""))) for r in fx.rows())
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in out) == want
    digests = sentencepiece_codec.digest_documents(docs, model_file()).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == Counter({
        (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
         hashlib.sha256(text.encode()).hexdigest()): n for (i, ids, text), n in want.items()})
    assert sentencepiece_codec.encode_documents(nothing, model_file()).count() == 0


def test_codec_on_random_texts(library):
    codec, rng = sentencepiece_codec.codec(model_file()), random.Random(11)
    alphabet = ["a", "the", "ing", " ", "  ", "\n", "é", "漢", "😀", "1", "_", "▁", "==", "----", "\x7f", "²", "."]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(800)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 800)])) for _ in range(25)) for _ in range(400)]
    for text in texts:
        assert codec.encode(text) == library.encode(text)
    for _ in range(800):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(0, 259)]) for _ in range(rng.randint(0, 9))]
        assert codec.decode(ids) == library.decode(ids)


def test_long_words_cross_windows(library, monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "WINDOW", 7)
    codec, rng = sentencepiece_codec.Codec(model_file()), random.Random(2)
    for _ in range(60):
        text = "".join(rng.choices(["ab", "er", "tion", "q", "ß", "="], k=40))
        assert codec.encode(text) == library.encode(text)


def test_frequent_chunks_outlast_a_full_memory(library, monkeypatch):
    """Pairs and chunks overflow many times; the frequent word is encoded once and all texts like the library's."""
    monkeypatch.setattr(sentencepiece_codec, "CACHE_CHUNKS", 40)
    codec, rng, asked = sentencepiece_codec.Codec(model_file()), random.Random(4), []
    pieces = codec.pieces
    monkeypatch.setattr(codec, "pieces", lambda text: asked.append(text) or pieces(text))
    for _ in range(60):
        rare = " ".join("".join(rng.choices("abdehinorst漢", k=9)) for _ in range(10))
        text = f"harbour {rare} harbour"
        ids = library.encode(text)
        assert codec.digest(text) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert asked.count("▁harbour") == 1
    assert len(codec.known) <= 20 and len(codec.older) <= 20 and sum(map(len, codec.apart.values())) <= 40


# 4


def junk(rng):
    return " ".join(w + rng.choice(["%%%", "&&&", " |"]) for w in rng.choices(fx.PROSE.split(), k=60))


def prose(rng):
    return " ".join(rng.choices(fx.PROSE.split(), k=60))


def test_quality_separates(spark, docs, nothing):
    rng = random.Random(1)
    rows = [(i, junk(rng) if i % 5 == 0 else prose(rng)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = labels_of(spark, [(i, int(i % 5 > 0), None) for i in range(0, 400, 2)] + [(None, 1, 0), (7, None, None)])
    model = quality_pu.train(frame, labels, 4, 2)
    assert 0.7 < model.prior < 0.9
    out = {r.doc_id: r.score for r in quality_pu.scored(frame, model).collect()}
    assert np.mean([(out[i] >= 0.7) == (i % 5 > 0) for i in range(400)]) > 0.97
    kept = quality_pu.accepted(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(s >= 0.7 for s in out.values())
    odd = quality_pu.scored(docs, model).collect()
    assert len(odd) == len(fx.rows()) and all(0 <= r.score <= 1 for r in odd)
    empty = {r.doc_id: r.score for r in odd}
    assert empty[4] == empty[5] == empty[6] == 0
    assert quality_pu.scored(nothing, quality_pu.train(nothing, labels, 4, 2)).count() == 0
    quality_pu.scored(docs, quality_pu.train(docs, labels_of(spark, []), 4, 2)).collect()


# 5


def test_edit_fingerprints(docs, nothing):
    out = minhash.edit_fingerprints(docs).collect()
    rows = sorted(((r[0], r[1] or "") for r in fx.rows()), key=lambda r: (-(r[0] if r[0] is not None else -2**63), r[1]))
    want = Counter()
    for k, (i, text) in enumerate(rows):
        changed = minhash.edited(text, rows[(k + 1) % len(rows)][1])
        want[i, len(text), hashlib.sha256(changed.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    by = {r.doc_id: r for r in out if r.doc_id in (1, 2, 3, 4, 5, 7)}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint  # words alone count
    assert by[4].fingerprint == by[5].fingerprint != by[7].fingerprint
    assert by[2].near_next == 1.0 and by[5].near_next == 1.0
    for r in out:  # what is returned is what was compared
        same = sum(x == y for x, y in zip(bytes.fromhex(r.fingerprint), bytes.fromhex(r.edited_fingerprint), strict=True)) / 128
        assert r.near_edited == pytest.approx(max(0, (same * 256 - 1) / 255))
    assert minhash.edit_fingerprints(nothing).count() == 0
    (lonely,) = minhash.edit_fingerprints(docs.where("doc_id = 1")).collect()
    assert lonely.near_next == 1.0


def near_copies():
    rng = random.Random(8)
    rows = []
    for i in range(60):
        base = rng.choices([f"w{k}" for k in range(500)], k=120)
        rows.append(" ".join(base))
        for _ in range(i % 4):
            other = list(base)
            for k in rng.sample(range(120), rng.choice([1, 2, 4])):
                other[k] = "new"
            rows.append(" ".join(other))
    return [(i, t) for i, t in enumerate([*rows, rows[0], rows[5], rows[5], "", ""])]


def test_near_pairs_by_brute_force(spark):
    rows = near_copies()
    members, pairs = minhash.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    first = {}
    for i, t in rows:
        first.setdefault(frozenset(fx.shingles(t, 5)), i)
    assert {r.doc_id: r.class_id for r in members.collect()} == {i: first[frozenset(fx.shingles(t, 5))] for i, t in rows}
    sets = {i: s for s, i in first.items()}
    want = {(a, b) for a in sets for b in sets if a < b and fx.jaccard(sets[a], sets[b]) >= 0.8}
    assert {(r.left_id, r.right_id) for r in pairs.collect()} == want and len(want) > 20


def linked(ids, pairs):
    home = {i: i for i in ids}
    for a, b in pairs:
        old, new = max(home[a], home[b]), min(home[a], home[b])
        home = {i: new if h == old else h for i, h in home.items()} if old != new else home
    return home


def template_texts():
    """A star of copies, alike to their original only, and variants of one text, few of which have a near copy."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    original, form = [word() for _ in range(400)], [word() for _ in range(400)]

    def changed(text, n):
        out = list(text)
        for at in rng.sample(range(5, 395, 6), n):
            out[at] = word()
        return out

    rows = [original] + [changed(original, 6) for _ in range(200)] + [changed(form, 6) for _ in range(1000)]
    rows += [changed(text, 8) for text in rng.sample(rows[201:], 120)]
    rng.shuffle(rows)
    return [(i, " ".join(t)) for i, t in enumerate(rows)]


def test_large_buckets_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 60_000, raising=False)
    rows = template_texts()
    _, pairs = minhash.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    number = {}
    sets = {i: {number.setdefault(s, len(number)) for s in fx.shingles(t, 5)} for i, t in rows}
    got = {(r.left_id, r.right_id): r.jaccard for r in pairs.collect()}
    assert all(v == fx.jaccard(sets[a], sets[b]) and v >= 0.8 for (a, b), v in got.items())
    want = [(a, b) for a in sets for b in sets if a < b and fx.jaccard(sets[a], sets[b]) >= 0.8]
    assert linked(sets, got) == linked(sets, want)
    assert 100 < len(set(linked(sets, want).values())) < len(rows) - 200


# 6


def test_exact_groups(docs, nothing):
    rows = fx.rows()
    groups = defaultdict(list)
    for r in rows:
        groups[fx.squeezed(r[1])].append(r[0])
    least = lambda v: min([i for i in v if i is not None], default=None)
    want = Counter((r[0], least(groups[fx.squeezed(r[1])]), len(groups[fx.squeezed(r[1])]),
                    r[0] == least(groups[fx.squeezed(r[1])]), hashlib.sha256(fx.squeezed(r[1]).encode()).hexdigest())
                   for r in rows)
    out = poly_dedup.exact_groups(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out) == want
    kept = poly_dedup.first_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(fx.squeezed(r.text) for r in kept.collect()) == sorted(groups)
    assert poly_dedup.exact_groups(nothing).count() == 0 and poly_dedup.first_rows(nothing).count() == 0


def test_fingerprints_compose():
    rng = random.Random(4)
    data = np.frombuffer(rng.randbytes(20_000), np.uint8)
    for cut in (0, 1, 4095, 4096, 4097, 13_000, 20_000):
        parts = poly_dedup.fingerprint(data[:cut]), poly_dedup.fingerprint(data[cut:])
        assert poly_dedup.combine(*parts) == poly_dedup.fingerprint(data)
    value = 0
    for b in data.tolist():
        value = (value * poly_dedup.RADIX[0] + b) % poly_dedup.PRIMES[0]
    assert poly_dedup.fingerprint(data)[1] == value


def test_equal_fingerprints_of_different_texts(spark, monkeypatch):
    """With a fingerprint that collides always, the comparison of texts has to tell groups apart."""
    real = poly_dedup.fingerprints
    monkeypatch.setattr(poly_dedup, "fingerprints", lambda d: real(d).withColumn("h0", F.lit(0).cast("long")).withColumn(
        "h1", F.lit(0).cast("long")))
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "bb"), (5, "cc"), (6, "dd d"), (2, "aa")]
    out = poly_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out) == [
        (1, 1, 3), (2, 1, 3), (2, 2, 2), (3, 1, 3), (4, 2, 2), (5, 5, 1), (6, 6, 1)]


# 7


def spans_of(text):
    import re

    assign = re.compile("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(found)


def test_secret_spans(docs, nothing):
    out = secret_scan.scan(docs).collect()
    key = lambda i, spans: (i, tuple(map(tuple, spans)))
    assert Counter(key(r.doc_id, r.base) for r in out) == Counter(key(r[0], spans_of(r[1] or "")) for r in fx.rows())
    assert all(set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in out)
    assert secret_scan.scan(nothing).count() == 0


def test_markov_models_find_random_tokens(spark):
    rng = random.Random(6)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    draw = lambda n: "".join(rng.choices(chars, k=n))
    rows = [(i, f"{fx.PROSE} my_{rng.choice(fx.PROSE.split()).lower()}_value and password={draw(24)}") for i in range(150)]
    hidden = draw(32)
    rows += [(1000, f"{fx.PROSE} look: {hidden} there"), (1001, f"{fx.PROSE} the_harbour_lies_below_the_hill here")]
    out = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    start = len(fx.PROSE) + len(" look: ")
    assert [tuple(s) for s in out[1000].spans] == [(start, 3, start + 32)]
    assert not out[1001].spans


def test_short_random_tokens_and_ordinary_ones(spark):
    """Keys of 8 to 19 characters are found without a keyword; words, numbers and dates among 120,000 tokens are not."""
    rng = random.Random(8)
    draw = lambda chars, n: "".join(rng.choices(chars, k=n))
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rng.choice(["an", "er", "tion", "ve", "lo", "ma", "sti", "ghe"]) for _ in range(rng.randint(2, 7)))
                  for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", "", "_id", "-2024-05"]) for _ in range(400))
             + f" secret={draw(letters + letters.upper() + '0123456789', 24)}") for i in range(300)]
    hidden = {1000 + n: draw(letters + letters.upper() + "0123456789", n) for n in (8, 12, 16, 19)}
    rows += [(i, f"lovetion {key} anversti") for i, key in hidden.items()]
    out = {r.doc_id: [s for s in r.spans if s.kind == 3] for r in secret_scan.scan(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [key for i, key in hidden.items() if [(s.start, s.end) for s in out[i]] == [(9, 9 + len(key))]]
    assert len(found) >= 3, found
    assert sum(len(out[i]) for i in range(300)) <= 12


def test_every_text_teaches_the_secret_models(spark):
    """Models of 2,500 texts differ from those of the 2,000 with the smallest hashes."""
    rng = random.Random(9)
    rows = [(i, f"the harbour {i} password={''.join(rng.choices('abcXYZ0123456789', k=12))}") for i in range(2500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    some = frame.orderBy(F.xxhash64("doc_id")).limit(2000)
    assert secret_scan.train(frame).ratio != secret_scan.train(some).ratio


def test_places_of_many_matches(spark):
    text = "x1y2z3a4 " * 1000 + "é" + " Q7w8E9r0T1" * 3
    frame = spark.createDataFrame([(text,), ("",), ("none here",)], "text string")
    matches, gaps = secret_scan._found(F.col("text"), secret_scan.JUDGED)
    lengths = F.zip_with(F.transform(matches, F.length), F.slice(gaps, 1, F.size(matches)), lambda o, g: F.struct(
        F.length(g).alias("gap"), o.alias("own")))
    chunked = frame.select("text", lengths.alias("lengths")).select("text", secret_scan._chunks(F.col("lengths")).alias("c"))
    got = {r.text: r.starts for r in chunked.select("text", secret_scan._inside(
        F.col("c"), secret_scan._heads(F.col("c"))).alias("starts")).collect()}
    import re
    assert {t: [m.start() for m in re.finditer(secret_scan.JUDGED, t)] for t in got} == got


# 8


def plain_simhash(text, width=3):
    found = fx.words(text)
    parts = [" ".join(found[k:k + width]) for k in range(len(found) - width + 1)] if len(found) >= width else (
        [" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints, radius):
    todo, out = set(prints), {}
    while todo:
        near, queue = set(), [todo.pop()]
        while queue:
            a = queue.pop()
            near.add(a)
            more = {b for b in todo if (a ^ b).bit_count() <= radius}
            todo -= more
            queue += more
        for p in near:
            out[p] = min((i for q in near for i in prints[q] if i is not None), default=None)
    return out


def test_simhash_groups(docs, nothing):
    rows = fx.rows()
    prints = defaultdict(list)
    for r in rows:
        prints[plain_simhash(r[1])].append(r[0])
    home = components_of(prints, 2)
    out = simhash_bk.near_groups(docs).collect()
    assert Counter((r.doc_id, r["print"] % 2**64, r.component_id) for r in out) == Counter(
        (r[0], plain_simhash(r[1]), home[plain_simhash(r[1])]) for r in rows)
    assert simhash_bk.near_groups(nothing).count() == 0
    kept = simhash_bk.first_rows(docs)
    assert kept.columns == docs.columns


@pytest.mark.parametrize("tree", [4, 4000])
def test_links_by_brute_force(spark, monkeypatch, tree):
    """Clouds of fingerprints around few centres, in small and large trees."""
    monkeypatch.setattr(simhash_bk, "TREE", tree)
    rng = random.Random(9)
    values = {0, 2**64 - 1}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(12):
            v = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                v ^= 1 << b
            values.add(v)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "print long")
    for radius in (1, 2, 3):
        want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= radius}
        assert {tuple(r) for r in simhash_bk.links(frame, radius).collect()} == want


# 9


def test_mixing(docs, nothing):
    out = mixing.mix(docs, [3.0, 1.0, 2.0], 1.5).collect()
    size = lambda r: len(fx.WORD.findall(r[1] or ""))
    assert Counter((r.doc_id, r.source, r["size"]) for r in out) == Counter((r[0], r[3], size(r)) for r in fx.rows())
    total = defaultdict(int)
    for r in fx.rows():
        total[r[3]] += size(r)
    sources = sorted(total, key=lambda s: (s is None, s or ""))
    weights = {s: [3.0, 1.0, 2.0][k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(total.values())
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] >= 2 * total[s]}
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else level * weights[s]
        left -= sum(2 * total[s] for s in full)
        open_ = open_ - full if full else set()
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 64 for s in sources)
    again = mixing.mix(docs.repartition(3), [3.0, 1.0, 2.0], 1.5).collect()
    key = lambda r: (r.doc_id or 0, str(r.source), r["size"], r.taken)
    assert sorted(map(key, again)) == sorted(map(key, out))
    assert mixing.mix(nothing, [1.0], 1.5).count() == 0
    rows = mixing.copies(docs, [3.0, 1.0, 2.0], 1.5)
    assert rows.columns == docs.columns
    assert max(Counter((r.doc_id, r.text) for r in rows.where("doc_id in (1, 2, 7, 11)").collect()).values()) <= 2
    assert mixing.copies(nothing, [1.0], 1.5).count() == 0


def test_shards_of_the_mix_keep_their_quotas(spark, docs, nothing):
    """Each word of a source goes to the shards that the runs of the seeded order give it; shards add up to their quotas."""
    rows = docs.unionByName(docs.select(*docs.columns)).unionByName(docs.withColumn("source", F.lit(None).cast("string")))
    for shards, block in ((1, 32), (5, 4)):
        out = mixing.sharded(rows, [3.0, 1.0, 2.0], 1.5, block_tokens=block, shards=shards).collect()
        plain = mixing.mix(rows, [3.0, 1.0, 2.0], 1.5, block_tokens=block, shards=shards).collect()
        seen = lambda rs: Counter((r.doc_id, r.source, r["size"], r.source_size, r.target, r.taken) for r in rs)
        assert seen(out) == seen(plain)
        ids = {s: k for k, s in enumerate(sorted({r.source for r in out}, key=lambda s: (s is None, s or "")))}
        aimed = spark.createDataFrame([(str(ids[r.source]), False, ids[r.source], r.target, r.source_size) for r in out],
                                      "k string, none boolean, rank int, target double, source_size long").distinct()
        sizes, quota = {str(ids[r.source]): r.source_size for r in out}, defaultdict(dict)
        for r in mixing.quotas(aimed, block, shards).collect():
            quota[r.k][r.shard] = r.blocks * block
        held = defaultdict(Counter)
        for r in out:
            spans = [(s.shard, s.start, s.words) for s in r.stretches]
            assert r.taken == sum(w for _, _, w in spans) and all(w > 0 and 0 <= a <= a + w <= r["size"] for _, a, w in spans)
            assert spans == sorted(spans, key=lambda s: s[0])
            times = Counter(i for _, a, w in spans for i in range(a, a + w))
            assert not times or max(times.values()) - min(times[i] for i in range(r["size"])) <= 1
            for shard, _, w in spans:
                held[str(ids[r.source])][shard] += w
        for k, wanted in quota.items():
            room = 2 * sizes[k]
            for shard in range(shards):
                assert held[k][shard] == min(wanted.get(shard, 0), room)
                room -= held[k][shard]
    assert mixing.sharded(nothing, [1.0], 1.5).count() == 0


def test_quotas_are_sainte_lague(spark):
    rng = random.Random(12)
    targets = [round(rng.random() * 4000, 3) for _ in range(9)] + [500.0, 500.0, 0.0]
    frame = spark.createDataFrame([(f"s{k:02}", False, k, t) for k, t in enumerate(targets)],
                                  "k string, none boolean, rank int, target double")
    out = {(r.k, r.shard): r.blocks for r in mixing.quotas(frame, 10, 4).collect()}
    seats, held = round(sum(targets) / 10), [0] * len(targets)
    marks = [seats * h // 4 for h in range(1, 5)]
    before, house = [0] * len(targets), 0
    for seat in range(1, seats + 1):
        k = max(range(len(targets)), key=lambda j: (targets[j] / (2 * held[j] + 1), -j))
        held[k] += 1
        while house < 4 and seat == marks[house]:
            for j in range(len(targets)):
                assert out[f"s{j:02}", house] == held[j] - before[j]
            before, house = list(held), house + 1
    assert house == 4


# 10


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(3)
    names = rng.integers(-2**62, 2**62, 40)
    ids, occurrences = np.arange(300) * 7, []
    for i in ids.tolist():
        for t in rng.choice(40, rng.integers(0, 6), replace=False):
            occurrences.append((i, int(names[t]), int(rng.integers(1, 4))))
    df = np.array([sum(o[1] == t for o in occurrences) for t in names.tolist()])
    y = (rng.random(300) < 0.2).astype(float)
    index = toxicity_knn.build(names, df, occurrences, ids, y, 0.2)
    vectors = {i: {} for i in ids.tolist()}
    for i, t, n in occurrences:
        vectors[i][t] = (1 + math.log(n)) * (math.log(301 / (1 + df[names.tolist().index(t)])) + 1)
    unit = {i: {t: w / math.sqrt(sum(x * x for x in v.values())) for t, w in v.items()} for i, v in vectors.items()}
    for i in ids[:80].tolist():
        if not unit[i]:
            continue
        t, w = index.vector(np.sort(np.array(list(vectors[i]), np.int64).view(np.uint64)), np.ones(len(vectors[i]), int))
        query = dict(zip(index.hashes[t].view(np.int64).tolist(), w, strict=True))
        found, similar = index.nearest(t, w)
        want = sorted((sum(query[t] * v.get(t, 0.0) for t in query) for v in unit.values()), reverse=True)[:15]
        assert np.allclose(similar, [x for x in want if x > 0])
        assert len(set(found.tolist())) == len(found)


def test_toxicity_separates(spark, docs, nothing):
    rng = random.Random(2)
    bad = lambda i: i % 6 == 0
    rows = [(i, f"{prose(rng)} {rng.choice(['Idiot!', 'scum,', 'trash']) if bad(i) else ''} {prose(rng)}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = labels_of(spark, [(i, None, int(bad(i))) for i in range(0, 600)] + [(None, 1, 1)])
    index = toxicity_knn.train(frame, labels, 5, 0)
    out = toxicity_knn.scored(frame, index).collect()
    assert np.mean([(r.score >= 0.5) == bad(r.doc_id) for r in out]) > 0.99
    assert all(set(r.evidence) <= set(range(600)) and not any(zlib.crc32(str(e).encode()) % 5 == 0 for e in r.evidence)
               for r in out)
    odd = toxicity_knn.scored(docs, index).collect()
    assert len(odd) == len(fx.rows()) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity_knn.scored(nothing, index).count() == 0
    empty = toxicity_knn.train(nothing, labels, 5, 0)
    assert {r.score for r in toxicity_knn.scored(docs, empty).collect()} == {0.0}


def test_folds(spark):
    frame = spark.createDataFrame([(None,), (1,), (77,)], "doc_id long")
    got = [r[0] for r in frame.select(labelled.held_out(5, zlib.crc32(b"77") % 5)).collect()]
    assert got[0] is False and got[2] is True


def test_links_of_a_cloud_of_near_copies(spark):
    """However many near copies a text has, a class has a few links, and they are all one group."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    for n in (300, 1200):
        rows = []
        for i in range(n):
            changed = list(words)
            for _ in range(rng.randrange(1, 9)):
                changed[rng.randrange(400)] = f"x{rng.random()}"
            rows.append((i, " ".join(changed)))
        members, pairs = minhash.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
        got = [(r.left_id, r.right_id) for r in pairs.collect()]
        assert len(set(linked(range(n), got).values())) == 1
        assert len(got) <= 8 * n


def test_rows_without_ids_are_not_one_key(spark):
    """Many rows without doc_id, in groups with and without another row that has one."""
    rows = [(None, f"text  number {i % 400}") for i in range(2400)] + [(i, f"text number\t{i}") for i in range(200)]
    rows += [(None, None)] * 700
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    sizes = Counter(fx.squeezed(t) for _, t in rows)
    out = poly_dedup.exact_groups(frame).collect()
    want = Counter((i, int(k) if (k := fx.squeezed(t).rpartition(" ")[2]) and int(k) < 200 else None, sizes[fx.squeezed(t)])
                   for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in out) == want
    stay = Counter((r.doc_id, fx.squeezed(r.text)) for r in poly_dedup.first_rows(frame).collect())
    assert stay == Counter([(i, f"text number {i}") for i in range(200)] + [(None, f"text number {i}") for i in range(200, 400)]
                           + [(None, "")])


def test_all_examples_and_terms_count(spark, monkeypatch):
    """More examples than one block and more terms than once fitted: neighbours, votes and scores by brute force."""
    rng = random.Random(17)
    bad = lambda i: i % 4 == 0
    # Every toxic text has one of 60 words that no other text has, and harmless ones have a word of their own kind.
    rows = [(i, " ".join([f"plain{rng.randrange(900)}" for _ in range(4)] + (
        rng.sample([f"bad{k}" for k in range(60)], 6) if bad(i) else rng.sample([f"good{k}" for k in range(60)], 6)))) for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = labels_of(spark, [(i, None, int(bad(i))) for i in range(1500)])
    monkeypatch.setattr(toxicity_knn, "ASKED_ROWS", 200)
    monkeypatch.setattr(toxicity_knn, "EXAMPLE_ROWS", 150)
    model = toxicity_knn.train(frame, labels, 5, 0)
    taught = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    assert model.examples.agg({"n": "sum"}).first()[0] == len(taught) and len(model.hashes) >= 60
    texts = dict(rows)
    df = Counter(w for i in taught for w in set(texts[i].split()))
    n = len(taught)
    known = {w for w in df if not w.startswith("plain")}
    assert len(model.hashes) == len(known)

    def vector(text):
        v = {w: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in Counter(text.split()).items() if w in known}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = {i: vector(texts[i]) for i in texts}
    out = {r.doc_id: r for r in toxicity_knn.scored(frame, model).collect()}
    for i in range(0, 1500, 60):
        like = lambda j: sum(x * vectors[j].get(w, 0.0) for w, x in vectors[i].items())
        want = sorted((like(j) for j in taught), reverse=True)[:15]
        assert np.allclose([like(j) for j in out[i].evidence], want)
        near = [1 / (1.1 - min(like(j), 1.0)) for j in out[i].evidence]
        vote = sum(x for x, j in zip(near, out[i].evidence, strict=True) if bad(j)) / sum(near)
        assert out[i].score == pytest.approx(1 / (1 + math.exp(-(model.slope * vote + model.offset))))
    assert np.mean([(r.score >= 0.5) == bad(i) for i, r in out.items()]) > 0.99
