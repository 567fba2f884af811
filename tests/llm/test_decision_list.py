"""Counts by brute force, decision lists as numpy and as Spark expressions, and held-out labels."""

import random
import zlib
from collections import Counter

import fixtures as fx
import numpy as np
import pyarrow as pa

from riskspark.llm import decision_list
from riskspark.llm.queries import op11_quality_rules


def plain(text):
    text = text or ""
    words = fx.WORD.findall(text)
    lines = [line for line in text.split("\n") if fx.WORD.search(line)]
    windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    covered = {k + d for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for d in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(lines), len(set(words)), sum("A" <= c <= "Z" for c in text), sum("0" <= c <= "9" for c in text),
            sum(33 <= ord(c) < 127 and not c.isalnum() for c in text))


def random_texts(n):
    rng = random.Random(9)
    for _ in range(n):
        yield "".join(rng.choices(["a", "b ", "\n", "a b c d e f\n", "é ", "# ", " ", "\t", "\r\n", "1,", "X"],
                                  k=rng.choice([0, 1, 5, 40])))


def test_counts_by_brute_force(spark):
    rows = fx.rows() + [(100 + i, t, None, None, 0, *["x"] * len(fx.EXTRA)) for i, t in enumerate(random_texts(300))]
    out = decision_list.statistics(fx.documents(spark, rows)).collect()
    assert Counter((r.doc_id, *r[1:]) for r in out) == Counter((r[0], *plain(r[1])) for r in rows)


def test_counts_do_not_depend_on_neighbours():
    texts = [*random_texts(60), "", None, "\n", "a\nb\n\n a"]
    together = decision_list.count(pa.array(texts, pa.string()))
    alone = np.concatenate([decision_list.count(pa.array([t], pa.string())) for t in texts])
    assert (together == alone).all()
    assert decision_list.count(pa.array([], pa.string())).shape == (0, 10)


def test_covering_finds_planted_rules(spark):
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 200, (3000, 10))
    x = decision_list.shares(counts)
    names = list(decision_list.SHARES)
    bad = (x[:, names.index("symbols_per_char")] > 2) | (
        (x[:, names.index("upper_per_char")] > 1) & (x[:, names.index("digits_per_char")] < 0.5))
    rules = decision_list.learn(counts[:2000], bad[:2000])
    assert (rules.keeps(x[2000:]) != bad[2000:]).mean() > 0.93
    frame = spark.createDataFrame([tuple(map(int, c)) for c in counts[2000:]], ", ".join(f"{c} long" for c in decision_list.COUNTS))
    as_column = [r[0] for r in frame.select(rules.column()).collect()]
    assert as_column == rules.keeps(x[2000:]).tolist()
    assert str(rules).endswith("else: keep") and "reject" in str(rules)
    # Labels that the statistics don't explain give no rules.
    assert decision_list.learn(counts, rng.random(3000) < 0.3).rules == []
    assert decision_list.learn(counts[:0], bad[:0]).rules == decision_list.learn(counts, bad | True).rules == []


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    verdict = {r.doc_id: r for r in op11_quality_rules(spark, folder).collect()}
    known = [(verdict[r.doc_id], r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()
             if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    good = [v.kept for v, q in known if q == 1 and not v.base_failed]
    bad = [v.kept for v, q in known if q == 0]
    print(len(good), np.mean(good), len(bad), np.mean(bad))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_edge_tables(spark):
    docs = fx.documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    rules = decision_list.train(docs, labels, 4, 2)
    out = decision_list.judged(docs, rules)
    assert rules.rules == [] and out.count() == len(fx.rows())
    assert {r.doc_id for r in out.where("base_failed").collect()} >= {4, 5, 6, 7}
    assert out.where("kept and base_failed").count() == 0
    assert decision_list.judged(docs.limit(0), decision_list.train(docs.limit(0), labels.limit(0), 4, 2)).count() == 0
