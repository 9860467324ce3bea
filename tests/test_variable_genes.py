"""Variable genes of raw counts against dense numpy."""

import numpy as np
import pytest

from tallgene.operators import stats, variable_genes


def loess(x, y, span):
    """Local quadratic fit at every point, by least squares over its q nearest."""
    n, out = len(x), []
    q = min(n, max(3, int(n * span + 1e-5)))
    for x0 in x:
        d = np.abs(x - x0)
        h = np.sort(d)[q - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0) if h > 0 else (d == 0) * 1.0
        u = (x - x0) / (h or 1)
        near = w > 1e-12
        degree = min(2, len(np.unique(x[near])) - 1)
        a = np.stack([u**k for k in range(degree + 1)], 1)[near] * np.sqrt(w[near])[:, None]
        out.append(np.linalg.lstsq(a, y[near] * np.sqrt(w[near]), rcond=None)[0][0])
    return np.array(out)


@pytest.mark.parametrize("n", [1, 2, 5, 90])
def test_local_quadratic(spark, n, monkeypatch):
    monkeypatch.setattr(variable_genes, "TILE", 16)
    rng = np.random.default_rng(n)
    rows, want = [], {}
    for b in (None, "p"):
        x = np.round(rng.normal(size=n), 1 if b else 6)  # many equal x in one of the groups
        y = x * x + rng.normal(size=n)
        rows += [(b, f"g{i}", float(x[i]), float(y[i])) for i in range(n)]
        want |= {(b, f"g{i}"): v for i, v in enumerate(loess(x, y, 0.3))}
    got = variable_genes.local_quadratic(spark.createDataFrame(rows, "batch string, gene string, x double, y double"), ["batch"], "gene", 0.3).collect()
    assert len(got) == 2 * n
    for r in got:
        assert r["fit"] == pytest.approx(want[r["batch"], r["gene"]], rel=1e-6, abs=1e-6)


def test_local_quadratic_meets_few_tiles(spark, monkeypatch):
    """Tiles inside a window come as sums of nodes: the points that meet one another follow the points, not the windows."""
    monkeypatch.setattr(variable_genes, "TILE", 8)
    monkeypatch.setattr(variable_genes, "LEVELS", 3)
    rng = np.random.default_rng(5)
    met, tile_moments = spark.sparkContext.accumulator(0), variable_genes._tile_moments

    def counted(by):
        inner = tile_moments(by)

        def run(targets, sources):
            met.add(1)
            return inner(targets, sources)

        return run

    monkeypatch.setattr(variable_genes, "_tile_moments", counted)
    x = np.concatenate([rng.normal(size=500), np.full(60, 0.25), rng.normal(size=40) * 1e-7 + 3])
    y = np.sin(x) + rng.normal(size=600)
    rows = [(f"g{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    got = variable_genes.local_quadratic(spark.createDataFrame(rows, "gene string, x double, y double"), [], "gene", 0.5).collect()
    want = loess(x, y, 0.5)
    assert len(got) == 600
    for r in got:
        assert r["fit"] == pytest.approx(want[int(r["gene"][1:])], rel=1e-6, abs=1e-6)
    assert met.value < 75 * 12  # 75 tiles; all that windows reach would be 75 * 38


@pytest.fixture(scope="module")
def counts():
    rng = np.random.default_rng(3)
    m = rng.poisson(rng.gamma(0.3, 2, 40)[None] * rng.uniform(0.2, 3, 120)[:, None])
    m[5, 7] = 5000  # one entry far beyond every clip
    m[9] = 0  # a cell without counts
    return m


def tables(spark, m):
    expr = [(f"c{i}", f"g{j}", int(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(expr, "cell_id string, gene string, value int"), spark.createDataFrame([(f"c{i}", "b") for i in range(len(m))], "cell_id string, batch string")


def test_standardized_variance(spark, counts):
    n = len(counts)
    mean, var = counts.mean(0), counts.var(0, ddof=1)
    sd = np.ones(counts.shape[1])
    sd[var > 0] = np.sqrt(10 ** loess(np.log10(mean[var > 0]), np.log10(var[var > 0]), 0.3))
    clipped = np.minimum(counts, sd * np.sqrt(n) + mean)
    norm = ((clipped - mean) ** 2).sum(0) / ((n - 1) * sd**2)
    got = {r["gene"]: r for r in variable_genes.standardized_variance(*tables(spark, counts)).collect()}
    assert got.keys() == {f"g{j}" for j in np.flatnonzero(counts.any(0))}
    assert all(got[g]["variance_norm"] == pytest.approx(norm[int(g[1:])], rel=1e-6) for g in got)


@pytest.mark.parametrize("theta,clip", [(100.0, None), (5.0, 2.0)])
def test_residual_variance(spark, counts, theta, clip, monkeypatch):
    monkeypatch.setattr(variable_genes, "TILE", 16)
    n, total = len(counts), counts.sum(1, keepdims=True)
    mu = total * counts.sum(0) / counts.sum()
    with np.errstate(all="ignore"):
        r = np.nan_to_num((counts - mu) / np.sqrt(mu + mu * mu / theta))
    want = np.clip(r, -(clip or np.sqrt(n)), clip or np.sqrt(n)).var(0)
    got = {x["gene"]: x for x in variable_genes.residual_variance(*tables(spark, counts), theta=theta, clip=clip).collect()}
    assert all(got[g]["variance_norm"] == pytest.approx(want[int(g[1:])], rel=1e-6, abs=1e-9) for g in got)


def test_top_genes_and_empty_tables(spark, counts):
    expr, obs = tables(spark, counts)
    for flavor in ("seurat_v3", "pearson_residuals"):
        out = stats.highly_variable_genes(expr, obs, flavor=flavor, n_top_genes=7, batch_key="batch")
        assert out.where("highly_variable").count() == 7
        assert stats.highly_variable_genes(expr.limit(0), obs.limit(0), flavor=flavor, n_top_genes=7).count() == 0
        with pytest.raises(ValueError, match="n_top_genes"):
            stats.highly_variable_genes(expr, obs, flavor=flavor)


@pytest.mark.parametrize("batch", [[], ["batch"]])
def test_tiles_without_genes_or_totals(spark, counts, batch, monkeypatch):
    """With tiles of one row many tiles are empty on one side."""
    expr, obs = tables(spark, counts[:12, :9])
    want = {r["gene"]: r["variance_norm"] for r in variable_genes.residual_variance(expr, obs, batch).collect()}
    monkeypatch.setattr(variable_genes, "TILE", 1)
    got = {r["gene"]: r["variance_norm"] for r in variable_genes.residual_variance(expr, obs, batch).collect()}
    assert got == pytest.approx(want) and len(got) == len(want) > 0
