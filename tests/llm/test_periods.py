"""Periodic runs of words, against a search by every start and period."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.llm import op12, periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, copies=4, words=6):
    """Every period and every stretch over which it holds, if no smaller one holds there."""
    ids, out = np.unique(np.array(w, str), return_inverse=True)[1] if w else np.zeros(0, int), []
    for q in range(1, len(w) // copies + 1):
        edge = np.diff(np.r_[False, ids[:-q] == ids[q:], False].astype(np.int8))
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            n = j + q - i
            if n >= max(words, copies * q) and not any((ids[i:i + n - r] == ids[i + r:i + n]).all() for r in range(1, q)):
                out.append((i, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(text):
    w = WORD.findall(text or "")
    found = brute(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


@pytest.mark.parametrize("rule", [periods.Rule(), periods.Rule(2, 2), periods.Rule(3, 4), periods.Rule(2, 9)])
def test_runs_equal_a_search_by_start_and_period(rule):
    rng = random.Random(5)
    for _ in range(300):
        rows = []
        for _ in range(rng.randint(1, 4)):
            kinds, n = rng.choice([1, 2, 3, 5]), rng.choice([0, 1, 5, 6, 7, 30, 60])
            w = [rng.randrange(kinds) for _ in range(n)]
            if rng.random() < 0.6 and n > 6:
                p, s = rng.randint(1, 8), rng.randrange(n)
                w[s:] = [w[s + i % p] if s + i % p < n else 0 for i in range(n - s)]
            rows.append(w)
        h = np.array([x + 1 for r in rows for x in r], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        got = periods.runs_of(h, np.cumsum([0, *map(len, rows)]), rule)
        assert [tuple(r) for r in got.tolist()] == [(i, *x) for i, w in enumerate(rows) for x in brute(w, rule.copies, rule.words)]


def test_report_and_find_agree_with_the_search(spark, awkward, empty):
    extra = [(20, "a b " * 3 + "a", "en", "c", 1), (21, " x  y\tz " * 4 + "\n", "en", "c", 1), (22, "q " * 6 + "r s t " * 5 + "q", "en", "c", 1), (23, "one two three " * 5, "en", "c", 1)]
    docs = awkward.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"), True)
    got = sorted(map(tuple, periods.report(docs).collect()), key=str)
    assert got == sorted(((r.doc_id, *expected(r.text)) for r in docs.collect()), key=str)
    for r in periods.find(docs.withColumn("start", F.lit(1)).withColumn("runs", F.lit("gone"))).collect():
        want = expected(r.text)
        assert (len(r.runs), hashlib.sha256(r.collapsed.encode()).hexdigest(), r.key, r.start) == (want[0], want[-1], r.key, 1)
    assert periods.report(empty).count() == 0 and periods.find(empty).count() == 0


def test_query_plants_as_stated(spark, small, texts):
    import zlib

    def planted(i, text):
        w, h = WORD.findall(text or ""), zlib.crc32(str(i).encode())
        n, g = len(w), h // 10
        if h % 10 or not n:
            return w
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [w[a + (j - a) % p] if j >= a else w[j] for j in range(n)]

    docs = spark.createDataFrame([(None, "a b c d"), (5, None), (7, "")], "doc_id long, text string").unionByName(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    for r in op12.planted(docs).collect():
        source = {None: "a b c d", 5: r.text, 7: r.text}.get(r.doc_id) if r.doc_id not in texts or r.text in ("", None) else texts[r.doc_id]
        if r.doc_id is not None:
            assert WORD.findall(r.text or "") == planted(r.doc_id, source)
    assert sum(r.n_runs > 0 for r in op12.op12_periods(spark, small).collect()) > 5
