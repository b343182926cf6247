import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from blockstrata.llm import _ngrams, quality_rules, queries, site_quality

SF = "/root/testdata/sf0.01"


def _brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    hit = set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            hit.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (6, 1, 0), (5, 0, 0), (12, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")


def test_counts_by_brute_force(spark, odd, labels, as_dir):
    extra = [(100 + i, " ".join("abcdefgh"[(j * j + i) % 8] for j in range(60 + i)) + "\nsame line\n\nsame line\n " * (i % 4)) for i in range(30)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("KEPT", F.lit("clash"))
    out = queries.op3_quality_rules(spark, as_dir(documents=docs, labels=labels)).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == sorted((r.doc_id is not None, r.doc_id or 0, *_brute(r.text)) for r in docs.collect())
    assert all(not (r.base_failed and r.kept) for r in out)


def test_counts_on_real_texts(spark):
    out = {r.doc_id: r for r in queries.op3_quality_rules(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").limit(200).collect():
        o = out[r.doc_id]
        assert (o.n_words, o.word_chars, o.n_symbols, o.n_dup_lines, o.n_repeat_words, o.base_failed) == _brute(r.text)


@pytest.mark.parametrize("judge", [quality_rules.judge, site_quality.judge])
def test_agrees_with_labels_held_out(spark, judge):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = _ngrams.train(docs.where("doc_id % 3 <> 0"), labels)
    out = judge(docs, model, keep=["doc_id"]).where("doc_id % 3 = 0").join(labels, "doc_id").collect()
    good, bad = [r.kept for r in out if r.quality == 1], [r.kept for r in out if r.quality == 0]
    assert sum(good) > 0.95 * len(good) and sum(bad) < 0.15 * len(bad)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = _ngrams.train(docs.where("doc_id % 3 <> 0"), labels)
    rest = docs.where("doc_id % 3 = 0").join(labels, "doc_id")
    out = [(r.probability >= 0.5) == (r.quality == 1) for r in quality_rules.judge(rest, model, keep=["quality"]).collect()]
    assert sum(out) > 0.95 * len(out)


def test_nothing_to_learn_keeps_what_passes(spark, odd, none, as_dir, labels):
    docs = odd.select("doc_id", "text", "lang", "source")
    folder = as_dir(documents=docs, labels=labels.limit(0))
    assert all(r.kept != r.base_failed for r in queries.op3_quality_rules(spark, folder).collect())
    assert all(r.kept for r in queries.op10_site_quality(spark, folder).collect())
    folder = as_dir(documents=none, labels=labels)
    assert queries.op3_quality_rules(spark, folder).collect() == [] and queries.op10_site_quality(spark, folder).collect() == []


def _posteriors(rows, ratio, base):
    """(host, path, prior, posterior) of each (host, path, text), row by row."""
    p = [1 / (1 + math.exp(-(ratio[t] + base))) for _, _, t in rows]
    groups, hosts = defaultdict(list), defaultdict(list)
    for (h, w, _), x in zip(rows, p, strict=True):
        groups[h, w].append(x)
        hosts[h].append(x)
    mean = sum(p) / len(p)

    def strength(parts):
        n = sum(k for _, k, _ in parts)
        within = sum(k * m * (1 - m) for _, k, m in parts) / n
        spread = max((sum(k * (s / k - m) ** 2 for s, k, m in parts) - sum(m * (1 - m) for _, _, m in parts)) / n, 1e-9)
        return min(max(within / spread - 1, 1.0), 1e6)

    a = strength([(sum(x), len(x), mean) for x in hosts.values()])
    host = {h: (sum(x) + a * mean) / (len(x) + a) for h, x in hosts.items()}
    b = strength([(sum(x), len(x), host[h]) for (h, _), x in groups.items()])
    out = []
    for (h, w, t), x in zip(rows, p, strict=True):
        own, all_of = groups[h, w], hosts[h]
        of_host = (sum(all_of) - x + a * mean) / (len(all_of) - 1 + a)
        prior = min(max((sum(own) - x + b * of_host) / (len(own) - 1 + b), 1e-6), 1 - 1e-6)
        out.append((host[h], (sum(own) + b * host[h]) / (len(own) + b), prior, 1 / (1 + math.exp(-(ratio[t] + math.log(prior / (1 - prior)))))))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return _ngrams.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_sites_by_brute_force(spark, model):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()] + ["", None]
    rows = [(h, w, texts[(i * 7 + len(h or "")) % 62]) for i, (h, w) in enumerate([("a", "x")] * 60 + [("a", "y")] * 9 + [("b", "x")] * 30 + [("", "x")] * 3 + [(None, "x")] * 4 + [(None, None)] * 2 + [("c", None), ("d", "")])]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, lang string, text string").repartition(3)
    out = {r.doc_id: r for r in site_quality.judge(docs, model).collect()}
    ratio = {r.text: r.evidence for r in out.values()}
    assert abs(ratio[""]) == abs(ratio[None]) == 0 and max(map(abs, ratio.values())) > 1
    for i, want in enumerate(_posteriors(rows, ratio, math.log(model.rate / (1 - model.rate)))):
        got = out[i]
        assert (got.host_posterior, got.path_posterior, got.prior, got.posterior) == pytest.approx(want, rel=1e-6, abs=1e-9)
        assert got.kept == (got.posterior >= 0.5)
    assert out[102].host_posterior != out[99].host_posterior  # a null host is not the empty one


def test_sites_shrink_toward_priors(spark):
    """A site with little of its own stands near its host, one with much near its own share, and hosts near the whole."""
    rows = [("h", "much", 0.9)] * 400 + [("h", "less", 0.1)] * 400 + [("h", "one", 1.0)] + [("g", "x", 0.2)] * 300 + [("alone", "x", 1.0)]
    sites, mean, by_host, by_path, count = site_quality.site_sums(spark.createDataFrame(rows, "h string, w string, p double"))
    got = {(r.h, r.w): r for r in sites.collect()}
    assert count == 5 and 1 <= by_host < 1e6 and 1 <= by_path < 1e6 and 0.4 < mean < 0.5
    assert abs(got["h", "much"].path_posterior - 0.9) < 0.02 and abs(got["h", "less"].path_posterior - 0.1) < 0.02
    host = got["h", "one"].host_posterior
    assert abs(host - 0.5) < 0.02 and got["h", "one"].path_posterior == pytest.approx((1 + by_path * host) / (1 + by_path))
    assert mean < got["alone", "x"].host_posterior < 1


def test_rows_that_repeat_a_labelled_document(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").orderBy("doc_id").limit(200)
    some = docs.join(labels.select("doc_id"), "doc_id")
    first = some.orderBy("doc_id").first()
    again = spark.range(8000).select(F.lit(first.doc_id).alias("doc_id"), F.lit(first.text).alias("text"))
    a, b = _ngrams.train(some, labels), _ngrams.train(some.select("doc_id", "text").unionByName(again), labels)
    assert a is not None and b is not None
    assert a.bias == b.bias and a.slope == b.slope and (a.weights == b.weights).all()
    one_class = labels.where("quality = 1")
    assert _ngrams.train(some, one_class) is None


def test_own_names_may_clash(spark, odd, model):
    names = ["_host", "_path", "_p", "_ratio", "_t", "_text", "text_", "h", "w", "t", "r", "p", "s", "n", "hs", "hn", "of", "places", "good"]
    clash = odd.select("doc_id", "text", "source", "lang", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    for out in (quality_rules.judge(clash, model), site_quality.judge(clash, model), site_quality.judge(clash, model, keep=names)):
        rows = out.collect()
        assert len(rows) == 18 and all([r[n] for n in names] == list(range(len(names))) for r in rows)


def test_all_columns_pass(spark, odd, model):
    out = quality_rules.judge(odd, model)
    assert set(odd.columns) < set(out.columns) and out.count() == 18
    out = site_quality.judge(odd.withColumn("Posterior", F.lit("clash")), model)
    assert set(odd.columns) < set(out.columns) and out.count() == 18 and dict(out.dtypes)["posterior"] == "double"
