"""The pipeline's stages, each on its own input, against SQL, brute force and the library."""

import hashlib
from collections import Counter

import corpus_pipeline
from sentencepiece import SentencePieceProcessor

from tests.compare import SMALL, oracle
from tests.llm.test_llm import plain_fingerprint, plain_groups
from tickloom.llm import linededup, mixing, queries, toxicity


def test_stages(spark, tmp_path):
    docs = queries.table(spark, SMALL, "documents")
    held, names = [docs], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1], SMALL).write.parquet(f"{tmp_path}/{k}")
        held.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(h.columns == names for h in held[:-1])
    rows = [h.collect() for h in held]

    bad = {r.doc_id for r in toxicity.scored(docs, queries.table(spark, SMALL, "labels")).collect() if r.predicted}
    assert {r.doc_id for r in rows[1]} == {r.doc_id for r in rows[0]} - bad

    duck = oracle(SMALL)
    duck.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/0/*.parquet')")
    want = {r[0]: r[1] for r in duck.execute(linededup.LINES_SQL).fetchall()}
    assert {r.doc_id: r.text or "" for r in rows[2]} == {k: v or "" for k, v in want.items()}

    groups = plain_groups({r.doc_id: plain_fingerprint(r.text) for r in rows[2]})
    assert sorted(r.doc_id for r in rows[3]) == sorted(set(groups.values()))

    duck.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/2/*.parquet')")
    cursor = duck.execute(mixing.MIX_SQL)
    order = [d[0] for d in cursor.description]
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in (dict(zip(order, x)) for x in cursor.fetchall()) if r["size"]}
    assert Counter(r.doc_id for r in rows[4] if (r.text or "").split()) == Counter({k: n for k, n in taken.items() if n})

    sp = SentencePieceProcessor(model_file=queries.PIECES)
    texts = {r.doc_id: sp.encode(r.text or "", num_threads=1) for r in rows[4]}
    assert len(rows[5]) == len(rows[4])
    assert all((r.n_tokens, r.ids_sha256) == (len(texts[r.doc_id]), hashlib.sha256(",".join(map(str, texts[r.doc_id])).encode()).hexdigest()) for r in rows[5])


def test_rerun_gives_the_same_rows(spark):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == Counter(map(tuple, corpus_pipeline.run(spark, SMALL).collect()))
