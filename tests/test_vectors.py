"""Similarities of single vectors against brute force."""

import numpy as np
import pytest

from marlstone.operators import collection_queries as cq, graph


def test_vectors_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cq, "VECTOR_BLOCK", 9)  # several blocks
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 8))
    x = np.vstack([centres[i % 4] + rng.normal(scale=0.2, size=8) for i in range(40)]).astype(np.float32)
    spark.createDataFrame([(i, x[i].tolist(), i % 4) for i in range(40)] + [(40, None, 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = (u @ u.T).round(6)
    pairs = s[np.triu_indices(40, 1)]
    t = round(float(np.quantile(pairs, 0.75)), 6)
    d = str(tmp_path)
    assert cq.vector_threshold(spark, d).first()[0] == pytest.approx(t, abs=2e-6)
    every = graph.document_similarities(cq._vectors(spark, d), 5)
    assert every.count() == len(pairs) and graph.similarity_threshold(every).first()[0] == cq.vector_threshold(spark, d).first()[0]
    assert graph.histogram_threshold(graph.similarity_histogram(cq._vectors(spark, d).limit(0))).first()[0] is None
    links = {r["vec_id"]: (r["label"], r["links"]) for r in cq.vector_links(spark, d).collect()}
    assert links == {i: (i % 4, int((s[i] >= t).sum() - (s[i, i] >= t))) for i in range(40)}
    near = {tuple(sorted((i, j))) for i in range(40) for j in sorted((j for j in range(40) if j != i), key=lambda j: (-s[i, j], j))[:3]}
    assert {(r["a"], r["b"]) for r in cq.vector_edges(spark, d).collect()} == near
    found = cq.vector_communities(spark, d).collect()
    assert sum(r["size"] for r in found) == 40 and sorted((r["size"], r["name"]) for r in found) == [(10, f"label {k}") for k in range(4)]
