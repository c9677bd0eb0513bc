"""Explicit Runge-Kutta integration of systems whose state is a distributed vector, real or complex.

The state and the stages of a step are columns of one table; a step is a few applications of the right-hand side, and
one aggregate for its error norm. Times, step sizes and events are numbers on the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as num
from ..plans.matrix import Vector, check
from ..plans.scratch import Chain, materialize, remove, written
from . import order8

SAFETY, MIN_FACTOR, MAX_FACTOR = 0.9, 0.2, 10.0
EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Tableau:
    name: str
    order: int
    error_order: int
    c: list[float]
    a: list[list[float]]
    b: list[float]
    e: list[float]
    #: Dense output: y(t + x h) = y + h sum_s k_s sum_p dense[s][p] x^(p+1)
    dense: list[list[float]] = field(default_factory=list)
    #: A second, cruder error estimate that tempers the first.
    e_low: list[float] | None = None
    #: Nodes and rows of stages that only the interpolant needs; they follow the stage at the end of the step.
    extra: list[tuple[float, list[float]]] = field(default_factory=list)

    def weights(self, x: float) -> list[float]:
        """What each stage adds to the state, in units of the step, at the share x of it."""
        return [sum(p * x ** (k + 1) for k, p in enumerate(row)) for row in self.dense]

    def error(self, high: float, low: float) -> float:
        return high**2 / float(np.hypot(high, low / 10)) if high else 0.0


@dataclass(frozen=True)
class HermiteTableau(Tableau):
    """A method whose interpolant is the cubic through states and slopes at both ends, plus x^2 (1 - x)^2 times a cubic
    in the basis 1, x, x (1 - x), x^2 (1 - x), one row of `upper` for each."""

    upper: list[list[float]] = field(default_factory=list)

    def weights(self, x: float) -> list[float]:
        rest, end = 1 - x, len(self.c)
        bump = (x * rest) ** 2
        factors = [bump * f for f in (1, x, x * rest, x * x * rest)]
        out = [sum(f * row[s] for f, row in zip(factors, self.upper, strict=True)) for s in range(end + 1 + len(self.extra))]
        for s, b in enumerate(self.b):
            out[s] += b * x * x * (3 - 2 * x)
        out[0] += x * rest**2
        out[end] -= x * x * rest
        return out


# The published coefficients of Bogacki and Shampine and of Dormand and Prince.
RK23 = Tableau(
    "RK23", 3, 2, [0, 1 / 2, 3 / 4], [[], [1 / 2], [0, 3 / 4]], [2 / 9, 1 / 3, 4 / 9], [5 / 72, -1 / 12, -1 / 9, 1 / 8],
    [[1, -4 / 3, 5 / 9], [0, 1, -2 / 3], [0, 4 / 3, -8 / 9], [0, -1, 1]],
)
RK45 = Tableau(
    "RK45", 5, 4, [0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1],
    [
        [],
        [1 / 5],
        [3 / 40, 9 / 40],
        [44 / 45, -56 / 15, 32 / 9],
        [19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729],
        [9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656],
    ],
    [35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84],
    [-71 / 57600, 0, 71 / 16695, -71 / 1920, 17253 / 339200, -22 / 525, 1 / 40],
    [
        [1, -8048581381 / 2820520608, 8663915743 / 2820520608, -12715105075 / 11282082432],
        [0, 0, 0, 0],
        [0, 131558114200 / 32700410799, -68118460800 / 10900136933, 87487479700 / 32700410799],
        [0, -1754552775 / 470086768, 14199869525 / 1410260304, -10690763975 / 1880347072],
        [0, 127303824393 / 49829197408, -318862633887 / 49829197408, 701980252875 / 199316789632],
        [0, -282668133 / 205662961, 2019193451 / 616988883, -1453857185 / 822651844],
        [0, 40617522 / 29380423, -110615467 / 29380423, 69997945 / 29380423],
    ],
)


def _row(values: dict[int, float], length: int) -> list[float]:
    return [values.get(k, 0.0) for k in range(length)]


DOP853 = HermiteTableau(
    "DOP853", 8, 7, order8.NODES, [_row(r, s) for s, r in enumerate(order8.STAGES)], _row(order8.SOLUTION, 12), _row(order8.ERROR, 13),
    e_low=[order8.SOLUTION.get(s, 0.0) - order8.LOW_ORDER.get(s, 0.0) for s in range(13)],
    extra=[(c, _row(r, 13 + k)) for k, (c, r) in enumerate(zip(order8.EXTRA_NODES, order8.EXTRA_STAGES, strict=True))],
    upper=[_row(r, 16) for r in order8.INTERPOLANT],
)
METHODS = {"RK23": RK23, "RK45": RK45, "DOP853": DOP853}


@dataclass
class OdeResult:
    t: list[float]
    y: list[Vector]
    sol: Callable[[float], Vector] | None
    t_events: list[list[float]] | None
    y_events: list[list[Vector]] | None
    nfev: int
    status: int
    message: str
    success: bool = field(init=False)

    def __post_init__(self):
        self.success = self.status >= 0


@dataclass
class StepControl:
    """Sizes of steps for a method whose error estimate shrinks as the power order + 1 of the size."""

    order: int
    size: float
    largest: float
    #: The last try was too long; the next one that is good enough does not grow.
    shrunk: bool = False

    @staticmethod
    def starting(order: int, size: float, slope: float, curvature: Callable[[float], float], most: float) -> float:
        """A first size from scaled norms of the state, of its slope, and of the change of slope over a trial step."""
        trial = min(most, 0.01 * size / slope if min(size, slope) >= 1e-5 else 1e-6)
        bend = max(slope, curvature(trial))
        fitted = (0.01 / bend) ** (1 / (order + 1)) if bend > 1e-15 else max(1e-6, trial / 1000)
        return min(100 * trial, fitted, most)

    def length(self, t: float, end: float) -> float | None:
        """The signed length of the next try, none beyond the end; None when tries have shrunk to the spacing of numbers."""
        left = end - t
        grain = 10 * abs(np.nextafter(t, np.copysign(np.inf, left)) - t)
        if self.shrunk and self.size < grain:
            return None
        reach = min(max(self.size, grain), self.largest)
        return left if reach >= abs(left) else float(np.copysign(reach, left))

    def accepts(self, length: float, error: float) -> bool:
        """Whether the scaled error is small enough; sets the size of the next try either way."""
        ideal = SAFETY * error ** (-1 / (self.order + 1)) if error else MAX_FACTOR
        good = error < 1
        factor = min(ideal, 1.0 if self.shrunk else MAX_FACTOR) if good else max(MIN_FACTOR, ideal)
        self.size, self.shrunk = abs(length) * factor, not good
        return good


class _Values:
    """Arithmetic on the state's columns."""

    def __init__(self, dtype: str):
        self.dtype = "complex128" if num.is_complex(dtype) else "float64"

    def combine(self, terms: list[tuple[float, str]], base: str | None = None) -> Column:
        terms = [(w, c) for w, c in terms if w]
        if num.is_complex(self.dtype):
            re, im = (sum((F.lit(float(w)) * F.col(c)[part] for w, c in terms), F.col(base)[part] if base else F.lit(0.0)) for part in ("re", "im"))
            return num.pair(re, im)
        return sum((F.lit(float(w)) * F.col(c) for w, c in terms), F.col(base) if base else F.lit(0.0))

    def size(self, x: Column) -> Column:
        return F.hypot(x["re"], x["im"]) if num.is_complex(self.dtype) else F.abs(x)


class OdeSolver:
    """Steps of one method from t0 to t_bound; step() advances, status is running, finished or failed."""

    def __init__(self, fun, t0: float, y0: Vector, t_bound: float, tableau: Tableau = RK45, rtol: float = 1e-3, atol: float = 1e-6, max_step: float = np.inf, first_step: float | None = None):
        check(rtol > 0 and atol >= 0, "tolerances are positive")
        check(max_step > 0, "max_step is positive")
        if rtol < 100 * EPS:
            warnings.warn(f"rtol is raised to {100 * EPS}", stacklevel=2)
            rtol = 100 * EPS
        check(first_step is None or 0 < first_step <= abs(t_bound - t0), "first_step is positive and within the span")
        self.tableau, self.values, self.n = tableau, _Values(y0.dtype), y0.size
        self._fun, self.nfev = fun, 0
        self.t, self.t_old, self.t_bound = t0, None, t_bound
        self.direction = 1.0 if t_bound == t0 else float(np.sign(t_bound - t0))
        self.rtol, self.atol, self.max_step = rtol, atol, max_step
        self.status = "running"
        self.frame = materialize(y0.astype(self.values.dtype).filled().select("i", F.col("v").alias("y")), "ode")
        self.frame = materialize(self._stage(self.frame, "y", self.t, "f"), "ode")
        self.control = StepControl(tableau.error_order, first_step or self._starting_size(), max_step)
        self.interpolant = None

    def fun(self, t: float, y: DataFrame) -> DataFrame:
        self.nfev += 1
        return self._fun(t, y)

    def _stage(self, frame: DataFrame, source: str, t: float, target: str) -> DataFrame:
        k = self.fun(t, frame.select("i", F.col(source).alias("v"))).select("i", F.col("v").alias(target))
        return frame.join(k, "i", "left").withColumn(target, F.coalesce(target, num.zero(self.values.dtype)))

    def _rms(self, frame: DataFrame, *columns: Column) -> list[float]:
        row = frame.agg(*(F.sqrt(F.avg(c * c)).alias(f"c{k}") for k, c in enumerate(columns))).first()
        return [x or 0.0 for x in row]

    def _scale(self, *names: str) -> Column:
        sizes = [self.values.size(F.col(x)) for x in names]
        return F.lit(self.atol) + (F.greatest(*sizes) if len(sizes) > 1 else sizes[0]) * self.rtol

    def _starting_size(self) -> float:
        if self.t == self.t_bound:
            return 0.0
        size, scale = self.values.size, self._scale("y")

        def curvature(h: float) -> float:
            ahead = self.frame.withColumn("ys", self.values.combine([(h * self.direction, "f")], "y"))
            ahead = self._stage(ahead, "ys", self.t + h * self.direction, "fs").withColumn("change", self.values.combine([(1.0, "fs"), (-1.0, "f")]))
            return self._rms(ahead, size(F.col("change")) / scale)[0] / h

        state, slope = self._rms(self.frame, size(F.col("y")) / scale, size(F.col("f")) / scale)
        return StepControl.starting(self.tableau.error_order, state, slope, curvature, min(abs(self.t_bound - self.t), self.max_step))

    def _attempt(self, h: float) -> DataFrame:
        """The stages k0, k1, ... and y_new of one step of length h; the last stage is the slope at y_new. The tables of the
        stages before go as they are replaced; that of the attempt stays, for results and interpolants read it."""
        tab, last = self.tableau, len(self.tableau.c)
        stages = Chain(self.frame.sparkSession)
        frame = self.frame.withColumn("k0", F.col("f"))
        for s in range(1, last):
            frame = frame.withColumn("ys", self.values.combine([(h * w, f"k{j}") for j, w in enumerate(tab.a[s])], "y"))
            # a stage refers to the frame before twice, so that a plan which is not cut would double
            frame = stages.next(self._stage(frame, "ys", self.t + tab.c[s] * h, f"k{s}").drop("ys"), "stage")
        frame = frame.withColumn("y_new", self.values.combine([(h * w, f"k{s}") for s, w in enumerate(tab.b)], "y"))
        frame, self._attempted = written(self._stage(frame, "y_new", self.t + h, f"k{last}"), "ode")
        stages.drop()
        return frame

    def step(self) -> None:
        check(self.status == "running", f"the solver is {self.status}")
        if self.n == 0 or self.t == self.t_bound:
            self.t_old, self.t, self.status = self.t, self.t_bound, "finished"
            return
        accepted = False
        while not accepted:
            h = self.control.length(self.t, self.t_bound)
            if h is None:
                self.status = "failed"
                return
            frame = self._attempt(h)
            accepted = self.control.accepts(h, self._error(frame, h))
            if not accepted:
                remove(frame.sparkSession, self._attempted)
        at_end = h == self.t_bound - self.t
        self.t_old, self.t = self.t, self.t_bound if at_end else self.t + h
        self.interpolant = Interpolant(self.t_old, self.t, frame, self)
        self.frame = frame.select("i", F.col("y_new").alias("y"), F.col(f"k{len(self.tableau.c)}").alias("f"))
        self.status = "finished" if at_end else "running"

    def _error(self, frame: DataFrame, h: float) -> float:
        tab, scale = self.tableau, self._scale("y", "y_new")
        estimates = [tab.e] if tab.e_low is None else [tab.e, tab.e_low]
        for k, weights in enumerate(estimates):
            frame = frame.withColumn(f"_e{k}", self.values.combine([(h * w, f"k{s}") for s, w in enumerate(weights)]))
        high, *low = self._rms(frame, *(self.values.size(F.col(f"_e{k}")) / scale for k in range(len(estimates))))
        return tab.error(high, *low) if low else high

    @property
    def y(self) -> Vector:
        return Vector(self.frame.select("i", F.col("y").alias("v")), self.n, self.values.dtype)


class Interpolant:
    """The state inside the last step; stages that it needs beside those of the step are computed when first asked for."""

    def __init__(self, t_old: float, t: float, frame: DataFrame, solver: OdeSolver):
        self.t_old, self.t, self._frame, self._solver = t_old, t, frame, solver
        self._complete = not solver.tableau.extra

    def _stages(self) -> DataFrame:
        if not self._complete:
            solver, h, first = self._solver, self.t - self.t_old, len(self._solver.tableau.c) + 1
            stages = Chain(self._frame.sparkSession)
            for k, (c, row) in enumerate(solver.tableau.extra):
                ahead = self._frame.withColumn("ys", solver.values.combine([(h * w, f"k{s}") for s, w in enumerate(row)], "y"))
                self._frame = stages.next(solver._stage(ahead, "ys", self.t_old + c * h, f"k{first + k}").drop("ys"), "stage")
            self._complete = True
        return self._frame

    def __call__(self, t: float) -> Vector:
        h, solver = self.t - self.t_old, self._solver
        weights = [(h * w, f"k{s}") for s, w in enumerate(solver.tableau.weights((t - self.t_old) / h))]
        return Vector(self._stages().select("i", solver.values.combine(weights, "y").alias("v")), solver.n, solver.values.dtype)


def brent(f: Callable[[float], float], a: float, b: float, tol: float = 4 * EPS, steps: int = 100) -> float:
    """A root of f between a and b, where f changes its sign: secants and parabolas, with bisection as a safeguard."""
    fa, fb = f(a), f(b)
    check(fa * fb <= 0, "the signs at both ends are equal")
    if fa == 0:
        return a
    c, fc, d = a, fa, b - a
    e = d
    for _ in range(steps):
        if fb * fc > 0:
            c, fc, d = a, fa, b - a
            e = d
        if abs(fc) < abs(fb):
            a, b, c, fa, fb, fc = b, c, b, fb, fc, fb
        bound, middle = 2 * EPS * abs(b) + tol / 2, (c - b) / 2
        if abs(middle) <= bound or fb == 0:
            return b
        if abs(e) >= bound and abs(fa) > abs(fb):
            s = fb / fa
            if a == c:
                p, q = 2 * middle * s, 1 - s
            else:
                q, r = fa / fc, fb / fc
                p = s * (2 * middle * q * (q - r) - (b - a) * (r - 1))
                q = (q - 1) * (r - 1) * (s - 1)
            p, q = (p, -q) if p > 0 else (-p, q)
            if 2 * p < min(3 * middle * q - abs(bound * q), abs(e * q)):
                e, d = d, p / q
            else:
                d = e = middle
        else:
            d = e = middle
        a, fa = b, fb
        b += d if abs(d) > bound else np.copysign(bound, middle)
        fb = f(b)
    return b


def solve_ivp(fun, t_span: tuple[float, float], y0: Vector, method: str = "RK45", t_eval=None, dense_output: bool = False, events=None, args=None, iteration_limit: int | None = None, **options) -> OdeResult:
    """Solves y' = fun(t, y), fun mapping a table (i, v) to another. iteration_limit stops after so many steps with status 0.

    Events are functions of t and a Vector; their attributes `terminal` and `direction` are honoured."""
    check(method in METHODS, f"methods are {', '.join(METHODS)}, not {method}")
    t0, t1 = map(float, t_span)
    if args is not None:
        plain = fun
        fun = lambda t, y: plain(t, y, *args)
    if t_eval is not None:
        t_eval = np.asarray(t_eval, float)
        check(t_eval.ndim == 1 and np.all((t_eval >= min(t0, t1)) & (t_eval <= max(t0, t1))), "t_eval lies within the span")
        steps = np.diff(t_eval)
        check(np.all(steps > 0) if t1 >= t0 else np.all(steps < 0), "t_eval is ordered in the direction of integration")
    solver = OdeSolver(fun, t0, y0, t1, METHODS[method], **options)
    events = [events] if callable(events) else list(events or [])
    before = [e(t0, solver.y) for e in events]
    t_events, y_events = [[] for _ in events], [[] for _ in events]
    ts, ys, pieces = [], [], []
    if t_eval is None or (len(t_eval) and t_eval[0] == t0):
        ts, ys = [t0], [solver.y]
    at, status, message, done = len(ts) if t_eval is not None else 0, None, "", 0
    while status is None:
        solver.step()
        done += 1
        if solver.status == "failed":
            status, message = -1, "the step size fell below the spacing of numbers"
            break
        if solver.status == "finished":
            status, message = 0, "the end of the span was reached"
        part = solver.interpolant
        t, y = solver.t, solver.y
        if part is None:
            break
        pieces.append(part)
        if events:
            now = [e(t, y) for e in events]
            found = []
            for k, (e, old, new) in enumerate(zip(events, before, now, strict=True)):
                up, down = old <= 0 <= new, old >= 0 >= new
                way = getattr(e, "direction", 0)
                if (up and way >= 0 or down and way <= 0) and not old == new == 0 and old != 0:
                    root = brent(lambda x, e=e: e(x, part(x)), part.t_old, t)
                    found.append((solver.direction * root, root, k))
            for _, root, k in sorted(found):
                t_events[k].append(root)
                y_events[k].append(part(root))
                if getattr(events[k], "terminal", False):
                    status, message, t, y = 1, "an event ended the integration", root, part(root)
                    break
            before = now
        if t_eval is None:
            ts.append(t)
            ys.append(y)
        else:
            while at < len(t_eval) and solver.direction * (t_eval[at] - t) <= 0:
                ts.append(float(t_eval[at]))
                ys.append(part(t_eval[at]))
                at += 1
        if status is None and iteration_limit is not None and done >= iteration_limit:
            status, message = 0, "the limit of steps was reached"

    def solution(x: float) -> Vector:
        if not pieces:
            return solver.y
        piece = next((p for p in pieces if min(p.t_old, p.t) <= x <= max(p.t_old, p.t)), pieces[-1] if abs(x - t0) > abs(t1 - x) else pieces[0])
        return piece(x)

    return OdeResult(ts, ys, solution if dense_output else None, t_events if events else None, y_events if events else None, solver.nfev, status if status is not None else 0, message)
