import numpy as np

from cohesia.llm import embed_dedup


def test_links_at_the_threshold_are_found(spark):
    """Pairs whose cosine is barely above the threshold, among unrelated vectors, against brute force."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((400, 48))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal(base.shape)
    noise -= (noise * base).sum(axis=1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    twin = 0.951 * base + np.sqrt(1 - 0.951**2) * noise
    apart = 0.949 * base + np.sqrt(1 - 0.949**2) * noise
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, twin[:200], apart[200:]]))]
    out = {r.id: r for r in embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found = sum(out[i].n_links == 1 for i in range(200))
    assert found == 200
    assert all(out[i].n_links == 0 for i in range(200, 400))
