"""Steps of expectation-maximisation on packs of sessions, as Arrow batches: responsibilities of all components of a context's mixtures,
and the sums that new parameters are made from.  Spark joins the packs with the parameters and adds up the sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Sessions of a pack at most.
PACK = 2048
PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
SUMS = ["mass", "sum_", "w_", *(f"s{i}" for i in range(3)), *(f"s{i}{j}" for i, j in PAIRS)]
Batches = Iterator[pa.RecordBatch]


def packed(by: list[str], values: list[str]) -> Callable[[Batches], Batches]:
    """Neighbouring rows with the same ``by`` as one row: ``by, pack``, of which pack is their ``values`` as doubles, row by row."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            if not b.num_rows:
                continue
            edge = np.zeros(b.num_rows, bool)
            edge[::PACK] = True
            for c in map(b.column, by):
                edge[1:] |= pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(edge)
            rows = np.column_stack([b.column(v).to_numpy(zero_copy_only=False) for v in values])
            packs = [part.tobytes() for part in np.split(rows, at[1:])]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in by), pa.array(packs, pa.binary())], [*by, "pack"])

    return run


def _stepped(by: list[str], sums_of: Callable[[np.ndarray, np.ndarray, dict], np.ndarray]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for b in batches:
            if not b.num_rows:
                continue
            found, kks, ks, at = [], [], [], []
            models = {c: b.column(c).to_pylist() for c in b.schema.names if c not in (*by, "pack")}
            for i, pack in enumerate(b.column("pack").to_pylist()):
                rows = np.frombuffer(pack).reshape(-1, 4)
                x, count = rows[:, :3], rows[:, 3]
                wide = np.column_stack([np.ones(len(x)), x, *(x[:, p] * x[:, q] for p, q in PAIRS)])
                model = {c: v[i] for c, v in models.items()}
                found.append(sums_of(wide, count, model))
                kks += model["kks"]
                ks += model["ks"]
                at += [i] * len(model["ks"])
            sums = np.concatenate(found)
            keys = [b.column(c).take(pa.array(at, pa.int64())) for c in by]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(kks, pa.int32()), pa.array(ks, pa.int32()), *(pa.array(s) for s in sums.T)], [*by, "kk", "k", *SUMS])

    return run


def quadratic_forms(parts: np.ndarray) -> np.ndarray:
    """Of weighted components (weight, m0-m2, c00-c22) the log densities as ten factors, which go with 1, x and the products of x."""
    weight, mean, c = parts[:, 0], parts[:, 1:4], parts[:, 4:].T
    minors = np.stack([c[3] * c[5] - c[4] ** 2, c[2] * c[4] - c[1] * c[5], c[1] * c[4] - c[2] * c[3], c[0] * c[5] - c[2] ** 2, c[1] * c[2] - c[0] * c[4], c[0] * c[3] - c[1] ** 2])
    det = c[0] * minors[0] + c[1] * minors[1] + c[2] * minors[2]
    inverse = np.empty((len(parts), 3, 3))
    for (i, j), a in zip(PAIRS, minors / det):
        inverse[:, i, j] = inverse[:, j, i] = a
    linear = np.einsum("nij,nj->ni", inverse, mean)
    at = np.log(weight) - 0.5 * (np.log(det) + 3 * np.log(2 * np.pi)) - 0.5 * (mean * linear).sum(1)
    return np.column_stack([at, linear, *(inverse[:, i, j] * (-0.5 if i == j else -1.0) for i, j in PAIRS)])


def started(by: list[str]) -> Callable[[Batches], Batches]:
    """Sums over sessions that belong to the component in whose range of energy they lie (``kks, ks``, and ``lows``: above this; ``highs``: up to this)."""

    def sums_of(wide: np.ndarray, count: np.ndarray, model: dict) -> np.ndarray:
        energy = wide[:, 3, None]
        r = ((energy > np.array(model["lows"])) & (energy <= np.array(model["highs"]))) * count[:, None]
        mass = r.sum(0)
        return np.column_stack([mass, np.zeros(len(mass)), r.T @ wide])

    return _stepped(by, sums_of)


def expected(by: list[str]) -> Callable[[Batches], Batches]:
    """Sums over sessions weighted by how likely each component made them.  ``kks, ks``: the components, by mixture; ``forms``: each
    one's weight, mean and covariances."""

    def sums_of(wide: np.ndarray, count: np.ndarray, model: dict) -> np.ndarray:
        ll = wide @ quadratic_forms(np.array(model["forms"]).reshape(-1, 10)).T
        kks, out = np.array(model["kks"]), np.empty((len(model["kks"]), 12))
        first = np.flatnonzero(np.r_[True, kks[1:] != kks[:-1]])
        for lo, hi in zip(first, [*first[1:], len(kks)]):
            part = ll[:, lo:hi]
            top = part.max(1, keepdims=True)
            r = np.exp(part - top)
            total = r.sum(1, keepdims=True)
            r /= total
            mean = (top + np.log(total))[:, 0]
            out[lo:hi, 0] = count @ r
            out[lo:hi, 1] = (count * mean) @ r
            out[lo:hi, 2:] = (np.maximum(r, 1e-12) * count[:, None]).T @ wide
        return out

    return _stepped(by, sums_of)
