"""The revision loop inside tasks: regions that nothing connects settle each on its own, many in one block of arrays.

A round of the loop costs an array step here, not a job; a row is dealt out once, by its region.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows from which on whole regions are worked off together.
BLOCK = 200_000
BASE, RULE, HYPOTHESIS, FIXED, EDGE = range(5)
#: Kinds of rows that come out; a block ends with one of its rounds.
VALUE, RETRACTED, VERDICT, ROUNDS = range(4)
ROWS = "home long, kind byte, a string, b string, c string, x double, y double, flag boolean"
FOUND = "kind byte, node string, x double, support double, attack double, rounds int, settled boolean"


@dataclass(frozen=True)
class Rules:
    """Policies over arrays and the limits of the loops."""

    fold: np.ufunc
    sums: Callable
    influence: Callable
    supported: float
    same: float
    tolerance: float
    max_sweeps: int
    max_rounds: int


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all rows of several runs of rows, run by run."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _codes(columns: list[pa.ChunkedArray]) -> tuple[list[np.ndarray], pa.Array]:
    """Whole numbers for the texts of several columns, -1 for null, and the texts by number."""
    coded = pa.concat_arrays([pa.array([], pa.string()), *[chunk for c in columns for chunk in c.chunks]]).dictionary_encode()
    numbers = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(numbers, np.cumsum([len(c) for c in columns])[:-1]), coded.dictionary


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(float)


def _signs(column: pa.ChunkedArray) -> np.ndarray:
    """1 of true, 0 of false, -1 of null."""
    return column.cast(pa.int8()).fill_null(-1).to_numpy()


class _Values:
    """Values of nodes by ascent over rules, as ``fixpoint.valuate``; a node has one exactly if it is supported."""

    def __init__(self, fold, same, n, base, confidence, rule, head, atom, strength, names):
        self.fold, self.same, self.n = fold, same, n
        ok = (base >= 0) & ~np.isnan(confidence)
        self.base, self.confidence = base[ok], confidence[ok]
        ok = (rule >= 0) & (head >= 0)
        rule, head, atom, strength = rule[ok], head[ok], atom[ok], strength[ok]
        keys, of = np.unique(rule * n + head, return_inverse=True)
        self.heads = keys % n
        lead = self._leads(keys // n, of, atom, names)
        order = np.argsort(of, kind="stable")
        order = order[atom[order] >= 0]
        of_link, self.atoms = of[order], atom[order]
        self.need = np.bincount(of_link, minlength=len(keys))
        self.starts = np.cumsum(self.need) - self.need
        # Rules without antecedents hold at once; one whose rows differ in strength is never whole.
        self.strength = np.full(len(keys), np.nan)
        bare = self.need[of] == 0
        np.fmax.at(self.strength, of[bare], strength[bare])
        full, rows = self.need > 0, np.nan_to_num(strength[order], nan=-np.inf)
        if len(rows):
            least = np.minimum.reduceat(rows, self.starts[full])
            most = np.maximum.reduceat(rows, self.starts[full])
            self.strength[full] = np.where(most == -np.inf, np.nan, most)
            lead[np.flatnonzero(full)[least != most]] = False
        self.live = lead
        by_atom = np.argsort(self.atoms, kind="stable")
        self.rule_of = of_link[by_atom]
        self.uses = np.bincount(self.atoms, minlength=n)
        self.use_starts = np.cumsum(self.uses) - self.uses

    def _leads(self, rules, of, atom, names) -> np.ndarray:
        """Of rules of one head and equal bodies the last by id; a rule that leads anywhere does so everywhere."""
        many = np.bincount(self.heads, minlength=self.n)[self.heads] > 1
        if not many.any():
            return np.ones(len(rules), bool)
        bodies: dict[int, set] = {int(r): set() for r in np.flatnonzero(many)}
        rows = many[of] & (atom >= 0)
        for r, a in zip(of[rows].tolist(), atom[rows].tolist()):
            bodies[r].add(a)
        last: dict[tuple, tuple] = {}
        for r, body in bodies.items():
            key, mine = (int(self.heads[r]), frozenset(body)), (names[int(rules[r])].as_py(), int(rules[r]))
            last[key] = max(last.get(key, mine), mine)
        leading = {rule for _, rule in last.values()}
        return ~many | np.isin(rules, list(leading)) | np.isin(rules, rules[~many])

    def of(self, gone: np.ndarray) -> np.ndarray:
        value = np.full(self.n, np.nan)
        kept = ~gone[self.base]
        np.fmax.at(value, self.base[kept], self.confidence[kept])
        live = self.live & ~gone[self.heads]
        axioms = live & (self.need == 0)
        np.fmax.at(value, self.heads[axioms], self.strength[axioms])
        changed = np.flatnonzero(~np.isnan(value))
        while len(changed):
            rules = np.unique(self.rule_of[_spans(self.use_starts[changed], self.uses[changed])])
            rules = rules[live[rules]]
            if not len(rules):
                break
            sizes = self.need[rules]
            met = value[self.atoms[_spans(self.starts[rules], sizes)]]
            runs = np.cumsum(sizes) - sizes
            ready = np.logical_and.reduceat(~np.isnan(met), runs)
            now = self.fold(self.fold.reduceat(met, runs), self.strength[rules])
            heads = self.heads[rules]
            touched = np.unique(heads[ready])
            before = value[touched]
            np.fmax.at(value, heads[ready], now[ready])
            after = value[touched]
            risen = ~np.isnan(after) & ~(np.abs(after - before) <= self.same * np.abs(before))
            value[touched[~risen]] = before[~risen]
            changed = touched[risen]
        return value


def _block(t: pa.Table, p: Rules) -> pa.Table:
    """Revise all regions of one block."""
    part = [t.filter(pc.equal(t["kind"], k)) for k in range(5)]
    base, rule, hyp, fixed, edge = part
    (bnode, head, atom, hnode, fdst, esrc, edst), names = _codes([base["a"], rule["b"], rule["c"], hyp["a"], fixed["b"], edge["a"], edge["b"]])
    (rule_id,), rule_names = _codes([rule["a"]])
    n = len(names)
    values = _Values(p.fold, p.same, max(n, 1), bnode, _numbers(base["x"]), rule_id, head, atom, _numbers(rule["x"]), rule_names)
    # As in a plan, a null id is no argument that anything meets.
    stored, is_arg, governed, allowed = np.full(n, np.nan), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
    for node, x in ((bnode, _numbers(base["x"])), (hnode, _numbers(hyp["x"]))):
        np.fmax.at(stored, node[node >= 0], x[node >= 0])
        is_arg[node[node >= 0]] = True
    governed[head[head >= 0]] = True
    times = np.bincount(hnode[hnode >= 0], minlength=n)
    allowed[hnode[(hnode >= 0) & (_signs(hyp["flag"]) == 1)]] = True

    strength, sign = _numbers(fixed["x"]), _signs(fixed["flag"])
    met = (esrc >= 0) & (edst >= 0)
    met[met] = is_arg[esrc[met]] & is_arg[edst[met]]
    esrc, edst, estrength, esign = esrc[met], edst[met], _numbers(edge["x"])[met], _signs(edge["flag"])[met]
    for x in (strength, estrength):
        if not ((x >= 0) & (x <= 1)).all():
            raise ValueError("strength outside 0..1")
    push = strength * _numbers(fixed["y"])
    order = np.lexsort((push, fdst))  # products and sums come out alike whatever order rows come in
    fdst, push, sign = fdst[order], push[order], sign[order]
    gone = np.zeros(n, bool)
    still = {s: p.sums(fdst[k], push[k], n) for s in (1, 0) for k in [(sign == s) & ~np.isnan(push)]}

    def inward(sigma: np.ndarray, alive: np.ndarray, s: int) -> np.ndarray:
        use = (esign == s) & alive[esrc] & alive[edst]
        if not use.any():
            return still[s]
        k = sign == s
        of, x = np.concatenate([fdst[k], edst[use]]), np.concatenate([push[k], estrength[use] * sigma[esrc[use]]])
        return p.sums(of[~np.isnan(x)], x[~np.isnan(x)], n)

    settled = False
    for done in range(1, p.max_rounds + 1):
        value, alive = values.of(gone)[:n], is_arg & ~gone
        score = np.where(np.isnan(value), np.where(governed, 0.0, stored), value)
        sigma = np.where(alive, score, 0.0)
        for _ in range(p.max_sweeps):
            now = np.where(alive, p.influence(score, inward(sigma, alive, 1), inward(sigma, alive, 0)), 0.0)
            moving = (np.abs(now - sigma) > p.tolerance).any()
            sigma = now
            if not moving or not len(esrc):
                break
        support, attack = inward(sigma, alive, 1), inward(sigma, alive, 0)
        judged = alive & (times > 0)
        if ((sigma < 0) | (sigma > 1))[judged].any():
            raise ValueError("acceptability outside 0..1")
        out = judged & ~(sigma >= p.supported) & (attack > support) & allowed
        if not out.any():
            settled = True
            break
        gone = gone | out

    valued, lost, shown = np.flatnonzero(~np.isnan(value)), np.flatnonzero(gone), np.repeat(np.flatnonzero(judged), times[judged])
    at = np.concatenate([valued, lost, shown])
    none = lambda k: np.full(k, np.nan)
    real = lambda *xs: pa.array(np.concatenate([*xs, none(1)]), pa.float64(), from_pandas=True)
    kinds = np.repeat(np.array([VALUE, RETRACTED, VERDICT, ROUNDS], np.int8), [len(valued), len(lost), len(shown), 1])
    beside = none(len(valued) + len(lost))
    blank = pa.nulls(len(at), pa.int32())
    return pa.table({
        "kind": kinds, "node": pa.chunked_array([names.take(pa.array(at, pa.int64())), pa.nulls(1, pa.string())]),
        "x": real(value[valued], none(len(lost)), sigma[shown]), "support": real(beside, support[shown]), "attack": real(beside, attack[shown]),
        "rounds": pa.chunked_array([blank, pa.array([done], pa.int32())]), "settled": pa.chunked_array([blank.cast(pa.bool_()), pa.array([settled])]),
    })


def revise_sorted(p: Rules) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over rows of ``ROWS`` sorted by ``home``: whole regions, together up to a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            home = batch.column(0).to_numpy()
            cut = int(np.searchsorted(home, home[-1]))
            if rows + cut >= BLOCK and (cut or home[0] != last):
                yield from _block(pa.Table.from_batches([*pending, batch.slice(0, cut)]), p).to_batches()
                pending, rows, batch = [], 0, batch.slice(cut)
            pending.append(batch)
            rows, last = rows + batch.num_rows, home[-1]
        if pending:
            yield from _block(pa.Table.from_batches(pending), p).to_batches()

    return run
