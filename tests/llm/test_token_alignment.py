"""Alignment of two tokenizers against the whole texts' own ids, and perfect hashing."""

import hashlib
import random
from bisect import bisect
from collections import Counter

import fixtures as fx
import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from riskspark.llm import token_alignment
from riskspark.llm.perfect_hash import PerfectHash

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = ["a  b", "\n\nab \r\n c", "x  y z　", "漢字 é<|endoftext|> <s> a\x00b \x1c z", "a" * 5000, "  ", " ",
        "a▁b", " \tq\r", "\x85 z\x0b\x0c q'll don't", "=" * 3000, "naïve—“quotes” 😀😀 \U0001f468‍\U0001f469", "1234567 ½ 0x1F",
        "if (x) {\r\n\t\treturn;\r\n}\r\n", "﻿bom  two", "tab\tsep\tvalues  end ", "<unk></s> ▁▁ <0x0A>"]


def plain(texts):
    """Groups and links per text, by the libraries on whole texts and sets of byte offsets."""
    ours = Tokenizer.from_file(A)
    ours.encode_special_tokens = True
    theirs = sentencepiece.SentencePieceProcessor(model_file=B)
    own = token_alignment.Aligner(A, B)
    out = []
    for text in texts:
        a = ours.encode(" " + text, add_special_tokens=False).ids if text else []
        b = theirs.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        ends = [np.cumsum([len(table[i]) for i in ids]).tolist() for table, ids in ((own.a_bytes, a), (own.b_bytes, b))]
        if any(b"".join(table[i] for i in ids) != whole for table, ids in ((own.a_bytes, a), (own.b_bytes, b))):
            a, b, ends = [], [], [[], []]
        groups, last = [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            groups.append([ids[bisect(es, last):bisect(es, end)] for ids, es in zip((a, b), ends)])
            last = end
        out.append((a, b, groups, Counter((x, y) for ga, gb in groups for x in ga for y in gb)))
    return out


def expected(texts):
    rows = plain(texts)
    counts = Counter(pair for *_, links in rows for pair in links)
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    for a, b, groups, links in rows:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        yield (len(a), len(b), len(groups), sum(links.values()),
               sum(n for pair, n in links.items() if counts[pair] == best[pair[0]]),
               sum(n * counts[pair] for pair, n in links.items()),
               hashlib.sha256(text.encode()).hexdigest() if text else "")


def got(frame):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
                   for r in frame.collect())


@pytest.mark.parametrize("frequent", [1 << 20, 300, 0])
def test_alignment_by_brute_force(spark, frequent):
    some = fx.rows()
    some += [(1000 + i, t, None, None, 0, *["x"] * len(fx.EXTRA)) for i, t in enumerate(HARD)]
    out = token_alignment.aligned(fx.documents(spark, some), A, B, frequent=frequent)
    assert got(out) == Counter((r[0], *e) for r, e in zip(some, expected([r[1] for r in some])))


def test_documents_of_the_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in rows.collect()}
    out = got(token_alignment.aligned(rows, A, B))
    assert out == Counter((i, *e) for i, e in zip(texts, expected(list(texts.values()))))


def test_groups_are_given_and_tables_may_be_empty(spark):
    frame = spark.createDataFrame([(1, "the harbour wall")], "doc_id long, text string")
    row = token_alignment.aligned(frame, A, B, with_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256
    assert row.groups.count(";") == row.n_groups - 1
    assert token_alignment.aligned(frame.limit(0), A, B).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (None, "a▁")], "doc_id long, text string")
    assert {tuple(r)[1:8] for r in token_alignment.aligned(nothing, A, B).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_memory_is_forgotten_without_a_trace(monkeypatch):
    own = token_alignment.Aligner(A, B)
    monkeypatch.setattr(token_alignment, "CACHE_BYTES", 50)
    for texts in (HARD[:6], HARD[6:], HARD[3:9]):
        tokens = own.encode(texts)
        found = [t.decode() for t in own.texts(tokens, own.groups(tokens))]
        assert found == [";".join("|".join(",".join(map(str, s)) for s in g) for g in groups) for _, _, groups, _ in plain(texts)]


def test_partial_counts_are_summed_in_trees(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(300), int(rng.paretovariate(0.3)) % 5000, rng.randrange(1, 9)) for _ in range(20_000)]
    partial = spark.createDataFrame(rows, "part int, pair long, n long")
    out = token_alignment.pair_counts(partial, shard_pairs=100, vector_rows=20).collect()
    plain_ = Counter()
    for _, pair, n in rows:
        plain_[pair] += n
    assert {r.pair: r.n for r in out} == plain_ and len(out) == len(plain_)


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 60, n))
        made = PerfectHash.of(keys)
        assert sorted(made.numbers(keys).tolist()) == list(range(len(keys)))
        others = np.setdiff1d(rng.integers(0, 1 << 60, 500), keys)
        assert (made.numbers(others) == -1).all()
        assert len(made.bits) * 64 <= 4 * len(keys) + 64 * 24
