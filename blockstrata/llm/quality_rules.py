"""Quality rules: counts over whole texts, and a calibrated n-gram classifier held against a fixed threshold.

Words are runs of anything but space, tab, newline, vertical tab, form feed and
carriage return. A text fails the base rules with fewer than 20 words, or when more
than 30 in 100 of its words lie in windows of eight words that it has twice or more.
What passes is kept if the classifier's calibrated probability reaches the threshold.

Defined results: null counts as empty, and an empty text fails; without labelled rows
of both classes all that passes the base rules is kept; columns named like an output
column are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from blockstrata.llm._base import AT_ONCE, clashing, text_chunks, tidied, with_text
from blockstrata.llm._ngrams import Model, sigmoid
from blockstrata.llm._words import U64, Texts, mix, runs

#: Fixed values.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
THRESHOLD = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
ADDED = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("probability", T.DoubleType()), ("kept", T.BooleanType())]


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def counts(t: Texts) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    texts = len(t.offs) - 1
    out = {"n_words": np.diff(t.first), "word_chars": t.per_text(t.solid & ((t.raw & 0xC0) != 0x80)), "n_symbols": t.per_text(_SYMBOL[t.raw])}
    breaks = np.flatnonzero(t.raw == 10)
    starts, ends = np.sort(np.concatenate([t.offs[:-1], breaks + 1])), np.sort(np.concatenate([breaks, t.offs[1:]]))
    solid = np.zeros(len(t.raw) + 1, np.int64)
    np.cumsum(t.solid, out=solid[1:])
    full = solid[ends] > solid[starts]
    starts, ends = starts[full], ends[full]
    owner = np.searchsorted(t.offs, starts, side="right") - 1
    key = mix(t.spans(starts, ends) ^ mix(owner.astype(np.uint64) + U64(1)))
    first = np.unique(key, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(owner, minlength=texts) - np.bincount(owner[first], minlength=texts)
    windows = runs(t.words(), WINDOW)
    owner = np.searchsorted(t.first, np.arange(len(windows)), side="right") - 1
    inside = np.arange(len(windows)) + WINDOW <= t.first[owner + 1] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    at = at[_repeats(mix(windows[at] ^ mix(owner[at].astype(np.uint64) + U64(1))))]
    cover = np.zeros(len(t.starts) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.subtract.at(cover, at + WINDOW, 1)
    covered = np.zeros(len(t.starts) + 1, np.int64)
    np.cumsum(np.cumsum(cover)[:-1] > 0, out=covered[1:])
    out["n_repeat_words"] = covered[t.first[1:]] - covered[t.first[:-1]]
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
    return out


def judge(docs: DataFrame, model: Model | None, keep: list[str] | None = None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (its ``keep`` columns) with the counts, ``base_failed``, ``probability`` and ``kept``."""
    names = [name for name, _ in ADDED]
    passed = clashing(docs.select(*(keep if keep is not None else docs.columns)), *names)
    own = passed.columns
    rows, at = with_text(docs, own, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, e, raw, offs in text_chunks(batch.column(at), AT_ONCE):
                t = Texts(raw, offs)
                found = counts(t)
                found["probability"] = sigmoid(model.logits(t)) if model is not None else np.ones(e - a)
                found["kept"] = ~found["base_failed"] & (found["probability"] >= threshold)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, e - a) for i in range(len(own))), *(pa.array(found[n]) for n in names)], [*own, *names])

    return rows.mapInArrow(tidied(run), T.StructType([*passed.schema, *(T.StructField(n, k) for n, k in ADDED)]))
