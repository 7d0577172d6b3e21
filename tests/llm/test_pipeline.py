import duckdb

import corpus_pipeline
from candidata.llm.queries import SQL
from odd_data import SMALL, documents, empty, odd  # noqa: F401
from test_decontamination import normal
from test_sharding import brute
from test_simhash import brute_fingerprint, brute_roots, close
from candidata.llm import sharding


def test_stages_against_brute_force(spark, documents):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({SQL['op1_quality_rules']}) WHERE kept").fetchall()}
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["quality rules"](spark, documents, SMALL)
    assert docs.columns == documents.columns
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    assert {r["doc_id"] for r in rows} == kept and all(r["n_chars"] == len(r["text"]) for r in rows)

    docs = stages["near duplicates"](spark, docs, SMALL)
    roots = brute_roots([brute_fingerprint(r["text"]) for r in rows], close)
    rows = [r for k, r in enumerate(rows) if roots[k] == k]
    assert sorted(docs.collect()) == sorted(rows)

    docs = stages["decontamination"](spark, docs, SMALL)
    items = [normal(r[0]) for r in con.execute(f"SELECT text FROM '{SMALL}/benchmark.parquet'").fetchall()]
    rows = [r for r in rows if not any(i in normal(r["text"]) for i in items)]
    assert sorted(docs.collect()) == sorted(rows)

    docs = stages["mixing"](spark, docs, SMALL)
    mixed = docs.collect()
    assert set(mixed) <= set(rows) and all(mixed.count(r) <= 2 for r in set(mixed))
    words = sum(len(r["text"].split()) for r in rows)
    assert abs(sum(len(r["text"].split()) for r in mixed) - 1.5 * words) < 0.15 * words

    final = stages["sharding"](spark, docs, SMALL).collect()
    assert sorted(r["doc_id"] for r in final) == sorted(r["doc_id"] for r in mixed)
    assert all(r["shard"] == brute(str(r["doc_id"]), sharding.tree_of(8)) for r in final)
    whole = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, final))


def test_odd_and_empty(spark, odd, empty):
    for df in (odd, empty):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == df.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
