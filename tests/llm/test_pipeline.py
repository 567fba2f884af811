"""The pipeline's stages, each against what plain Python keeps of its own input."""

import hashlib
from collections import Counter, defaultdict

import fixtures as fx
import sentencepiece

import corpus_pipeline
from riskspark.llm.queries import model_file
from test_operators import plain_simhash

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "encoding":
            assert out.columns == docs.columns
        seen[name] = docs.collect(), out.collect()
        docs = spark.createDataFrame(seen[name][1], out.schema)
    before, after = seen["quality"]
    marks = lambda r: sum(r.text.count(c) for c in "%&$#*!|") / max(1, len(r.text))
    varied = lambda r: len(set(r.text.split())) > 0.3 * len(r.text.split())
    assert {r.doc_id for r in before if marks(r) < 0.005 and varied(r)} <= {r.doc_id for r in after}
    before, after = seen["exact_dedup"]
    least = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        least.setdefault(fx.squeezed(r.text), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(least.values())
    before, after = seen["near_dedup"]
    sets = {r.doc_id: fx.shingles(r.text, 5) for r in before}
    prints = {r.doc_id: plain_simhash(r.text) for r in before}
    home = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and ((prints[a] ^ prints[b]).bit_count() <= 2 or fx.jaccard(sets[a], sets[b]) >= 0.8):
                old, new = max(home[a], home[b]), min(home[a], home[b])
                home = {i: new if h == old else h for i, h in home.items()}
    assert sorted(r.doc_id for r in after) == sorted(set(home.values()))
    before, after = seen["mixing"]
    size = lambda r: len(fx.WORD.findall(r.text))
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}
    assert max(Counter(r.doc_id for r in after).values()) <= 2
    total, taken = defaultdict(int), defaultdict(int)
    for r in before:
        total[r.source] += size(r)
    for r in after:
        taken[r.source] += size(r)
    assert abs(sum(taken.values()) / sum(total.values()) - 1.5) < 0.15
    before, after = seen["encoding"]
    library = sentencepiece.SentencePieceProcessor(model_file=model_file())
    want = Counter((r.doc_id, hashlib.sha256(",".join(map(str, library.encode(r.text))).encode()).hexdigest()) for r in before)
    assert Counter((r.doc_id, r.ids_sha256) for r in after) == want


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), docs.schema if stage is not
                                     corpus_pipeline.encode else stage(spark, docs, FOLDER).schema)
    assert docs.count() == 0
