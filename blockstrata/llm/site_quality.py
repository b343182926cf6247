"""Quality classifier: a document's own evidence, weighed against what is known of its host and path.

A calibrated classifier gives each document a log-likelihood ratio. Grouped sums of
its probabilities give each host and each path in it a Beta posterior: paths shrink
toward their host and hosts toward the global mean, as strongly as the variance
between groups (by moments) says. A document's prior is its path's posterior without
the document's own share, so that its evidence counts once; its posterior is the prior's
odds times its own ratio. Texts are scored twice, for the sums and for the result, instead
of being written in between. Groups are only summed, so a host with a third of all rows
costs no more than its partial sums.

Defined results: null text is empty and tells nothing; null host or path is a group
of its own, apart from the empty string's; without labelled rows of both classes all
evidence is neutral and everything is kept; columns named like an output column are
replaced, all others pass whatever their names; repeated rows count each; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockstrata.llm._base import AT_ONCE, Staged, clashing, private, text_chunks, tidied, with_text
from blockstrata.llm._ngrams import Model, sigmoid
from blockstrata.llm._words import Texts

ADDED = ("evidence", "host_posterior", "path_posterior", "prior", "posterior", "kept")
#: Evidence counts up to this many nats either way.
MOST_EVIDENCE = 12.0
#: A text of so many words counts half of what a long one would; a wordless one tells nothing.
FEW_WORDS = 8.0
#: Sites whose posteriors are handed to every task; beyond, they are joined by shuffle.
MOST_BROADCAST = 100_000


def evidence(docs: DataFrame, model: Model | None, text: str, names: tuple[str, str], keep: list[str]) -> DataFrame:
    """``docs`` (its ``keep`` columns) with, under ``names``, the log-likelihood ratio and the probability."""
    rows, at = with_text(docs, keep, text)
    rate = model.rate if model is not None else 0.5
    base = float(np.log(rate / (1 - rate)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, e, raw, offs in text_chunks(batch.column(at), AT_ONCE):
                ratio = np.zeros(e - a)
                if model is not None:
                    t = Texts(raw, offs)
                    words = np.diff(t.first)
                    ratio = np.clip(model.logits(t) - base, -MOST_EVIDENCE, MOST_EVIDENCE) * (words / (words + FEW_WORDS))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, e - a) for i in range(len(keep))), pa.array(ratio), pa.array(sigmoid(ratio + base))], [*keep, *names])

    return rows.mapInArrow(tidied(run), T.StructType([*docs.select(*keep).schema, *(T.StructField(n, T.DoubleType()) for n in names)]))


def _strength(groups: DataFrame, toward: Column | str) -> float:
    """Pseudo-counts of a Beta prior by moments: binomial variance over the variance between groups beyond it."""
    m = F.col(toward) if isinstance(toward, str) else toward
    mean, n = F.col("s") / F.col("n"), F.col("n")
    got = groups.agg(F.sum(n * (mean - m) ** 2).alias("between"), F.sum(m * (1 - m)).alias("chance"), F.sum(n).alias("rows"), F.sum(n * m * (1 - m)).alias("within")).first()
    if not got.rows or not got.within:
        return 1.0
    spread = max((got.between - got.chance) / got.rows, 1e-9)
    return float(min(max(got.within / got.rows / spread - 1, 1.0), 1e6))


def site_sums(scored: DataFrame) -> tuple[DataFrame, float, float, float, int]:
    """From (h, w, p), host, path and probability of each document: a row a path (h, w, s and n, hs and hn of its host, host_posterior, path_posterior), the global mean, both strengths, the count of paths."""
    paths = Staged(scored.groupBy("h", "w").agg(F.sum("p").alias("s"), F.count("*").alias("n")), "site_paths").read()
    total = paths.agg(F.sum("s"), F.sum("n"), F.count("*")).first()
    mean = float(total[0] / total[1]) if total[1] else 0.5
    hosts = paths.groupBy("h").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    by_host = _strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("h").alias("of"), F.col("s").alias("hs"), F.col("n").alias("hn"), ((F.col("s") + by_host * mean) / (F.col("n") + by_host)).alias("host_posterior"))
    paths = paths.join(hosts, F.col("h").eqNullSafe(F.col("of"))).drop("of")
    by_path = _strength(paths, "host_posterior")
    return paths.withColumn("path_posterior", (F.col("s") + by_path * F.col("host_posterior")) / (F.col("n") + by_path)), mean, by_host, by_path, total[2] or 0


def judge(docs: DataFrame, model: Model | None, host: str = "source", path: str = "lang", keep: list[str] | None = None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` (its ``keep`` columns) with evidence, host_posterior, path_posterior, prior, posterior and kept."""
    passed = clashing(docs.select(*(keep if keep is not None else docs.columns)), *ADDED)
    own = passed.columns
    site = docs.select(docs[host].cast("string").alias("h"), docs[path].cast("string").alias("w"), docs[text].alias("t"))
    sites, mean, by_host, by_path, count = site_sums(evidence(site, model, "t", ("r", "p"), ["h", "w"]))
    h, w, t, r, p = private(docs.select(*docs.columns, *(F.lit(0).alias(a) for a in (*ADDED, "s", "n", "hs", "hn") if a not in docs.columns)), "h", "w", "t", "r", "p")
    rows = docs.select(*own, docs[host].cast("string").alias(h), docs[path].cast("string").alias(w), *([] if text in own else [docs[text].alias(t)]))
    scored = evidence(rows, model, text if text in own else t, (r, p), [*own, h, w])
    if count <= MOST_BROADCAST:
        sites = F.broadcast(sites)
    on = scored[h].eqNullSafe(sites["h"]) & scored[w].eqNullSafe(sites["w"])
    # what is known without the document itself
    of_host = (sites["hs"] - scored[p] + by_host * mean) / (sites["hn"] - 1 + by_host)
    prior = (sites["s"] - scored[p] + by_path * of_host) / (sites["n"] - 1 + by_path)
    prior = F.greatest(F.least(prior, F.lit(1 - 1e-6)), F.lit(1e-6))
    posterior = 1 / (1 + F.exp(-(scored[r] + F.ln(prior / (1 - prior)))))
    kept = posterior >= threshold if model is not None else F.lit(True)
    return scored.join(sites, on).select(*(scored[c] for c in own), scored[r].alias("evidence"), sites["host_posterior"], sites["path_posterior"], prior.alias("prior"), posterior.alias("posterior"), kept.alias("kept"))
