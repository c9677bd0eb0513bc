"""Solvers against closed answers and NumPy."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import construct
from latticework.plans import catalogue
from latticework.plans.matrix import Vector
from latticework.plans.scratch import scratch_dir
from latticework.solvers import graphs, integrate, linalg, multigrid, quantum

from .test_matrix import sample, sparse, values


def test_krylov(spark):
    s = sample(8, 8)
    a = (s + s.T) / 2 + 20 * np.eye(8)
    x = np.arange(1.0, 9.0)
    m, b = sparse(spark, a), construct.vector(spark, a @ x)
    assert np.allclose(values(linalg.cg(m, b, conv_test_iters=2)[0]), x)
    assert np.allclose(values(linalg.bicgstab(m, b, tol=1e-9)), x, atol=1e-4)
    assert np.allclose(values(linalg.gmres(m, b, tol=1e-9)[0]), x, atol=1e-4)


def test_long_krylov(spark):
    a = construct.poisson2d(spark, 5)
    x = np.arange(25.0) % 7 + 1
    b = a @ construct.vector(spark, x)
    assert np.allclose(values(linalg.spsolve(a, b)), x)
    got, steps = linalg.cg(a, b, tol=0.0, maxiter=60)
    assert np.allclose(values(got), x) and steps < 60
    assert np.allclose(values(linalg.cgs(a, b, tol=1e-8)), x, atol=1e-5)
    assert np.allclose(values(linalg.bicg(a, b, tol=1e-8)), x, atol=1e-5)
    with pytest.raises(RuntimeError):
        linalg.spsolve(construct.diags(spark, [[1.0, -1.0, 0.0]], [0], (3, 3)), construct.vector(spark, [1.0, 1.0, 1.0]))


def test_multigrid(spark):
    a = construct.poisson2d(spark, 8)
    x = np.arange(64.0) % 5 + 1
    b = a @ construct.vector(spark, x)
    for levels in (multigrid.geometric(spark, a, 8, coarsest=20), multigrid.algebraic(a, coarsest=20)):
        assert len(levels) > 1
        got, steps = linalg.cg(a, b, tol=1e-8, M=multigrid.preconditioner(levels), conv_test_iters=1)
        assert np.allclose(values(got), x) and steps < 25


def test_rotated_diffusion(spark):
    def dense(*of):
        return construct.rotated_diffusion(spark, 3, *of).df.toPandas().pivot(index="i", columns="j", values="v").fillna(0).to_numpy()

    assert np.allclose(dense(1.0, 0.0)[4], dense(1.0, 0.7)[4]) and np.allclose(dense(0.1, 0.4)[4].sum(), 0)
    assert np.allclose(dense(0.0, 0.0)[4].reshape(3, 3), np.outer([-1, 2, -1], [1, 4, 1]) / 6)


def test_least_squares(spark):
    a = sample(9, 4) + np.eye(9, 4)
    b = np.arange(9.0)
    got = linalg.lsqr(sparse(spark, a), construct.vector(spark, b), atol=1e-10, btol=1e-10)
    assert np.allclose(values(got[0]), np.linalg.lstsq(a, b, rcond=None)[0], atol=1e-5) and got[1] in (1, 2)


def test_damped_least_squares(spark):
    a = sample(9, 4) + np.eye(9, 4)
    b, start, damp = np.arange(9.0), np.array([1.0, 0.0, -1.0, 2.0]), 0.5
    inverse = np.linalg.inv(a.T @ a + damp**2 * np.eye(4))
    change = inverse @ a.T @ (b - a @ start)
    x, istop, itn, r1, r2, *_, xnorm, var = linalg.lsqr(sparse(spark, a), construct.vector(spark, b), damp, atol=1e-10, btol=1e-10, calc_var=True, x0=construct.vector(spark, start))
    assert istop == 2 and itn <= 6 and np.allclose(values(x), start + change, atol=1e-6)
    left = np.linalg.norm(b - a @ (start + change))
    assert np.isclose(r1, left, rtol=1e-5) and np.isclose(r2, np.hypot(left, damp * np.linalg.norm(change)), rtol=1e-5)
    assert np.isclose(xnorm, np.linalg.norm(change), rtol=1e-5) and (itn != 4 or np.allclose(values(var), np.diag(inverse), rtol=1e-4))


def test_eigenvalues(spark):
    s = sample(9, 9)
    a = s + s.T
    got = linalg.eigsh(sparse(spark, a), 2, which="LA", ncv=8, return_eigenvectors=False)
    assert np.allclose(got, np.linalg.eigvalsh(a)[-2:], atol=1e-6)


def test_integration(spark):
    y0 = construct.vector(spark, [1.0, 2.0])
    out = integrate.solve_ivp(lambda t, y: y.selectExpr("i", "-v as v"), (0.0, 0.5), y0, t_eval=[0.25, 0.5], rtol=1e-5, atol=1e-8)
    assert out.success and np.allclose(values(out.y[0]), np.exp(-0.25) * np.array([1, 2]), atol=1e-4)
    assert np.allclose(values(out.y[1]), np.exp(-0.5) * np.array([1, 2]), atol=1e-4)
    assert np.isclose(integrate.brent(lambda x: x * x - 2, 0, 2), np.sqrt(2))


def test_graphs(spark):
    a = construct.poisson2d(spark, 4)
    members = graphs.maximal_independent_set(a)
    assert graphs.violations(a, members).first().asDict() == {"adjacent": 0, "uncovered": 0}


def test_sets(spark):
    path = [(k, k + 1) for k in range(4)]
    assert quantum.independence_polynomial(spark, path, 5) == [1, 5, 6, 1]
    states = quantum.States(spark, path, 5)
    assert states.count == 13 and states.optimum() == 3.0 and states.driver().nnz == 2 * (5 + 12 + 3)


@pytest.mark.parametrize("method", integrate.METHODS.values(), ids=integrate.METHODS)
def test_tableaus_integrate_powers_of_time(method):
    """y' = t^k is solved exactly below the order, at the end of the step and, less one order or more, inside of it."""
    c, b = np.array(method.c), np.array(method.b)
    nodes = np.array([*method.c, 1.0, *(node for node, _ in method.extra)])
    for stages, node in [*zip(method.a, method.c, strict=True), *((row, node) for node, row in method.extra)]:
        assert sum(stages) == pytest.approx(node, abs=1e-14)
    for k in range(method.order):
        assert b @ c**k == pytest.approx(1 / (k + 1), abs=1e-14)
    inside = {"RK23": 3, "RK45": 4, "DOP853": 7}[method.name]
    for x in (0.2, 0.5, 0.9, 1.0):
        weights = np.array(method.weights(x))
        for k in range(inside):
            assert weights @ nodes[: len(weights)] ** k == pytest.approx(x ** (k + 1) / (k + 1), abs=1e-13)
    for estimate in (method.e, method.e_low or [0.0]):
        assert sum(estimate) == pytest.approx(0, abs=1e-14)


def test_eighth_order_stops_at_a_terminal_event_and_interpolates(spark):
    def rotate(t, y):
        return y.select((1 - F.col("i")).alias("i"), F.when(F.col("i") == 0, -F.col("v")).otherwise(F.col("v")).alias("v"))

    def entries(y):
        return {r.i: r.v for r in y.df.collect()}

    def half(t, y):
        return entries(y)[0] - 0.5

    half.terminal = True
    y0 = Vector(spark.createDataFrame([(0, 1.0), (1, 0.0)], "i long, v double"), 2)
    out = integrate.solve_ivp(rotate, (0.0, 3.0), y0, method="DOP853", rtol=1e-8, atol=1e-10, first_step=0.5, dense_output=True, events=half)
    assert out.status == 1 and out.success
    assert out.t[-1] == out.t_events[0][0] == pytest.approx(np.pi / 3, abs=1e-6)
    assert entries(out.sol(0.3))[0] == pytest.approx(np.cos(0.3), abs=1e-6)
    assert entries(out.y_events[0][0])[1] == pytest.approx(-np.sin(np.pi / 3), abs=1e-6)


def test_a_span_of_no_length_has_a_constant_solution(spark):
    y0 = Vector(spark.createDataFrame([(0, 2.0)], "i long, v double"), 1)
    out = integrate.solve_ivp(lambda t, y: y, (1.0, 1.0), y0, method="DOP853", dense_output=True)
    assert out.status == 0 and [r.v for r in out.sol(1.0).df.collect()] == [2.0]


def test_sets_of_several_words(spark):
    """A graph of 130 nodes against plain Python, and that words change nothing for a small one."""
    n, rng = 130, np.random.default_rng(4)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, n, (4000, 2)) if a < b}
    apart = {(a, b) for a in range(n) for b in range(a + 1, n)} - edges
    table = spark.createDataFrame([*edges, *((b, a) for a, b in list(edges)[:50])], "a long, b long")
    sets = quantum.sets_to_sizes(quantum.independent_sets(spark, table, n, most=3), n).collect()
    low = 1 << quantum.WORD
    got = sorted((r["size"], r["mask"]["w0"] + low * r["mask"]["w1"] + low**2 * r["mask"]["w2"]) for r in sets)
    threes = [(a, b, c) for a, b in apart for c in range(b + 1, n) if (a, c) in apart and (b, c) in apart]
    assert got == sorted([(0, 0), *((1, 1 << u) for u in range(n)), *((2, 1 << a | 1 << b) for a, b in apart), *((3, 1 << a | 1 << b | 1 << c) for a, b, c in threes)])
    assert quantum.independence_polynomial(spark, table, n, most=2) == [1, n, len(apart)]
    states = quantum.States(spark, table, n, most=2)
    assert states.optimum() == 2.0 and states.driver().nnz == 2 * (n + 2 * len(apart))
    path = [(63 + k, 64 + k) for k in range(4)] + [(a, b) for a in range(63) for b in range(a + 1, 68)]  # the first 63 nodes exclude all others
    assert quantum.independence_polynomial(spark, path, 68) == [1, 5 + 63, 6, 1]


def test_conjugate_gradients_take_one_job_a_step(spark):
    rng = np.random.default_rng(2)
    s = rng.normal(size=(30, 12))
    a, x = s.T @ s + np.eye(12), np.arange(12.0) - 4
    m, b = sparse(spark, a), construct.vector(spark, a @ x)
    m = m.over(m.df.coalesce(1).persist())
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for steps in (3, 7):
        group = f"cg-{steps}"
        spark.sparkContext.setJobGroup(group, group)
        linalg.cg(m, b, tol=0.0, maxiter=steps)
        jobs.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("others", "others")
    per_step = (jobs[1] - jobs[0]) / 4
    assert per_step <= 3, jobs  # stages of one query that are run apart (a broadcast, an exchange) count as jobs
    got, _ = linalg.cg(m, b, tol=1e-9, conv_test_iters=1)
    assert np.linalg.norm(a @ values(got) - a @ x) <= 1e-9
    assert np.allclose(values(linalg.cg(m, b, tol=1e-30, maxiter=200, conv_test_iters=1)[0]), x)


def test_solvers_leave_few_tables(spark):
    """What is left behind does not grow with the steps that were taken."""
    folder = Path(scratch_dir(spark))

    def left(run) -> int:
        before = set(folder.iterdir())
        run()
        return len(set(folder.iterdir()) - before)

    a = construct.poisson2d(spark, 4)
    x = construct.vector(spark, np.arange(16.0))
    levels = multigrid.geometric(spark, a, 4, coarsest=5)
    m = multigrid.preconditioner(levels)
    few, more = (left(lambda n=n: linalg.cg(a, a @ x, M=m, tol=0.0, maxiter=n)) for n in (2, 5))
    assert more <= few + 1
    y0 = Vector(spark.createDataFrame([(0, 1.0)], "i long, v double"), 1)

    def steps(n):
        solver = integrate.METHODS["RK45"]
        out = integrate.solve_ivp(lambda t, y: y.select("i", (-F.col("v")).alias("v")), (0.0, 1.0), y0, method=solver.name, first_step=1.0 / n, max_step=1.0 / n, rtol=1e-2, atol=1e-2)
        assert len(out.t) == n + 1

    two, four = (left(lambda n=n: steps(n)) for n in (2, 4))
    assert four - two == 2  # one table a step, which the solution reads
    assert left(lambda: graphs.maximal_independent_set(a)) == 1 and left(lambda: graphs.colouring(a).count()) <= 1 + 6


def test_reflected_balances_is_no_table(spark):
    """The operator keeps no cell for each two suppliers, and does what the matrix does."""
    op = catalogue.reflected_balances(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").orderBy("s_suppkey").collect()
    d, u = np.array([r["s_acctbal"] for r in rows]), np.array([r["s_suppkey"] % 5 + 1.0 for r in rows])
    mirror = np.eye(len(d)) - 2 * np.outer(u, u) / (u @ u)
    x = np.arange(len(d)) + 1.0
    got = op.matvec(construct.vector(spark, x).df)
    assert np.allclose(values(Vector(got, len(d))), mirror @ np.diag(d) @ mirror @ x)
