import hashlib
import zlib

import corpus_pipeline
import pyarrow as pa

from stringloom.llm import bpe, decontamination, minhash, toxicity
from tests.llm.test_minhash import brute
from tests.llm.test_pii import PLAIN, base


def plain_redaction(text):
    out, at = [], 0
    for span in filter(None, base(text).split(",")):
        kind, a, b = span.split(":")
        if int(a) < at:
            at = max(at, int(b))
            continue
        out += [text[at : int(a)], f"<{kind.upper()}>"]
        at = int(b)
    return "".join(out) + text[at:]


def test_against_plain_stages(spark, sf):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    labels = {(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = dict(docs)
    train = sorted((i, y, texts[i]) for i, y in labels if i in texts and zlib.crc32(str(i).encode()) % 5)
    field = toxicity.train([t for _, _, t in train], [y for _, y, _ in train])
    scores, _ = toxicity.judge(pa.array([t for _, t in docs]), field)
    docs = [d for d, s in zip(docs, scores) if s < 0.5]
    component = brute(docs, 5)
    docs = [d for d in docs if component[d[0]] == d[0]]
    bench = sorted((r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect())
    items = decontamination.items_of([i for i, _ in bench], [t for _, t in bench])
    leaked = {row for row, *_ in decontamination.leaks(pa.array([t for _, t in docs]), items)}
    docs = [d for k, d in enumerate(docs) if k not in leaked]
    ids = bpe.ChunkEncoder().library([plain_redaction(t) for _, t in docs])
    want = {d[0]: (len(x) // 4, hashlib.sha256(x).hexdigest()) for d, x in zip(docs, ids)}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 0 < len(got) < spark.read.parquet(f"{sf}/documents.parquet").count()
    assert PLAIN and minhash


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_stages_begin_with_a_collected_heap(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = whole()
    corpus_pipeline.STAGES[-2][1](spark, docs, sf)
    assert whole() > before
