"""Whole payloads at once: numpy code for programs that read fixed records in a loop.

The shape is: reads of numbers and assignments, then one loop whose body reads fixed
numbers, assigns values that depend on the same round alone, and emits one row; nothing
behind it. Other programs run as generated Python code, row by row.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from blockstrata.plans.program import Expr, Loop, Num, Op, Program, Read, Sample, Set, Var, walk

_CODES = {"B": "u1", "H": "u2", "I": "u4", "Q": "u8", "b": "i1", "h": "i2", "i": "i4", "q": "i8", "f": "f4", "d": "f8"}


def _used(e: Expr | None) -> set[str]:
    if isinstance(e, Var):
        return {e.name}
    return set().union(*map(_used, e.args)) if isinstance(e, Op) else set()


def _u64(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    out = np.zeros(x.shape, np.uint64)
    ok = (x > 0) & (x < 18446744073709551616.0)
    out[ok] = x[ok].astype(np.uint64)
    out[x >= 18446744073709551616.0] = np.iinfo(np.uint64).max
    return out


def evaluate(e: Expr, known: dict) -> np.ndarray | float:
    """An expression over arrays, as the program language defines it."""
    if isinstance(e, Num):
        return e.value
    if isinstance(e, Var):
        return known.get(e.name, 0.0)
    a, *rest = (np.asarray(evaluate(x, known), float) for x in e.args)
    if e.op == "!":
        return (a == 0).astype(float)
    b = rest[0]
    if e.op == "/":
        return np.where(b != 0, a / np.where(b != 0, b, 1), 0.0)
    if e.op in "&|" or e.op in ("<<", ">>"):
        x, y = np.broadcast_arrays(_u64(a), _u64(b))
        if e.op in ("<<", ">>"):
            y = np.minimum(y, np.uint64(63))
        return {"&": np.bitwise_and, "|": np.bitwise_or, "<<": np.left_shift, ">>": np.right_shift}[e.op](x, y).astype(float)
    if e.op in ("&&", "||"):
        return ((a != 0) & (b != 0) if e.op == "&&" else (a != 0) | (b != 0)).astype(float)
    simple = {"+": np.add, "-": np.subtract, "*": np.multiply, "<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal, "==": np.equal, "!=": np.not_equal}
    return simple[e.op](a, b).astype(float)


@dataclass
class Kernel:
    """The head's statements, the loop, its record type, and how many columns a row has."""

    head: tuple
    loop: Loop
    record: np.dtype
    columns: int

    def columns_of(self, payload: bytes) -> list[np.ndarray] | None:
        """Arrays of v0, v1 and so on, or None where the generated code must decide (the head already ends the payload)."""
        known, at = {}, 0
        for s in self.head:
            if isinstance(s, Set):
                known[s.var] = float(evaluate(s.value, known))
                continue
            width = struct.calcsize(f"<{s.letter}")
            if at + width > len(payload):
                return [np.zeros(0)] * self.columns
            known[s.var] = float(np.frombuffer(payload, (">" if s.big else "<") + _CODES[s.letter], 1, at)[0])
            at += width
        loop = self.loop
        step = loop.step.value if loop.var is not None else 0.0
        start = float(evaluate(loop.start, known)) if loop.start is not None else known.get(loop.var, 0.0)
        n = (len(payload) - at) // self.record.itemsize
        if loop.end is not None:
            end = float(evaluate(loop.end, known))
            if not np.isfinite([start, end]).all():
                return None
            rounds = np.ceil((end - start) / step)
            n = min(n, max(0, int(rounds)))
        rows = np.frombuffer(payload, self.record, n, at)
        if loop.var is not None:
            known[loop.var] = start + step * np.arange(n)
        for k, s in enumerate(loop.body):
            if isinstance(s, Read):
                known[s.var] = rows[f"f{k}"].astype(float)
            elif isinstance(s, Set):
                known[s.var] = evaluate(s.value, known)
        return [np.broadcast_to(np.asarray(known.get(f"v{i}", 0.0), float), (n,)) for i in range(self.columns)]


def kernel(program: Program) -> Kernel | None:
    """The numpy form of a program, if it has the shape."""
    *head, loop = program.body or (None,)
    if not isinstance(loop, Loop) or any(program.raw) or not program.columns:
        return None
    if any(not isinstance(s, Read | Set) or isinstance(s, Read) and (s.letter == "raw" or s.value is not None) for s in head):
        return None
    body = loop.body
    if [type(s) for s in body].count(Sample) != 1 or not isinstance(body[-1], Sample) or len(list(walk(body))) != len(body):
        return None
    reads = [s for s in body if isinstance(s, Read)]
    if not reads or any(s.letter == "raw" or s.value is not None for s in reads) or any(not isinstance(s, Read | Set | Sample) for s in body):
        return None
    assigned = [s.var for s in body if isinstance(s, Read | Set)]
    if loop.var is not None:
        if not isinstance(loop.step, Num) or loop.step.value == 0 or loop.var in assigned or abs(loop.step.value) != int(abs(loop.step.value)):
            return None
        if loop.end is not None and _used(loop.end) & {loop.var, *assigned}:
            return None
    done: set[str] = set()
    for s in body:  # a value from the round before would have to be carried
        if isinstance(s, Set) and _used(s.value) & (set(assigned) - done):
            return None
        if isinstance(s, Read | Set):
            done.add(s.var)
    record = np.dtype([(f"f{k}", (">" if s.big else "<") + _CODES[s.letter]) for k, s in enumerate(body) if isinstance(s, Read)])
    return Kernel(tuple(head), loop, record, program.columns)
