"""Top-k search, runs and source divergence against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sensevec.llm import divergence, runs, topk
from sensevec.llm.queries import op11_topk, op12_runs, op13_divergence


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def best_of(rows, top, every):
    """All exact scores of each query, sorted."""
    whole = []
    for at, (i, v) in enumerate(rows):
        if v is not None and None not in v and all(map(math.isfinite, v)):
            whole.append((at, i, [math.floor(256 * x) for x in v]))
    out = Counter()
    for at, i, q in whole:
        if i is None or i % every:
            continue
        scored = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), j is None, j or 0, j) for k, j, v in whole if k != at and len(v) == len(q)]
        for rank, (score, _, _, j) in enumerate(sorted(scored, key=lambda x: x[:3])[:top], 1):
            out[i, rank, j, -score] += 1
    return out


def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(int(k), (centres[k % 12] + rng.normal(size=8) * 0.05).tolist()) for k in range(600)]
    same = [0.5] * 8
    rows += [(1000 + k, same) for k in range(200)]  # a third of the rows are one vector
    rows += [rows[50], rows[50], rows[100]]  # repeated rows, queries among them
    rows += [(50, [9.0] * 8), (7, None), (8, [float("nan")] * 8), (10, [None] * 8), (None, same), (None, [1.0] * 8)]
    rows += [(0, []), (3, []), (50, [1.0, 2.0]), (51, [2.0, 1.0]), (100, [5.0] * 3), (150, [-1e30, 2e9, 1.0, 0.0]), (151, [1e30, 1e9, -3.0, -0.0])]
    return rows + [(200, [0.001, -0.001] * 4), (250, [1e-300] * 8), (300, [0.0] * 8), (350, [-0.0] * 8)]


@pytest.mark.parametrize("top, pivots, group", [(5, 256, 1 << 16), (3, 8, 4), (700, 5, 100)])
def test_topk_equals_brute_force(spark, monkeypatch, top, pivots, group):
    monkeypatch.setattr(topk, "SLICE_ROWS", 150)
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, key string, row int")
    found = topk.search(df, F.col("vec_id") % 50 == 0, top, pivots=pivots, group_queries=group).collect()
    assert Counter(map(tuple, found)) == best_of(rows, top, 50)


def test_topk_sends_rows_only_where_bounds_ask_for_them():
    rng = np.random.default_rng(1)
    centres = (rng.normal(size=(16, 32)) * 256).astype(np.int64)
    rows = np.concatenate([c + rng.integers(-6, 7, (80, 32)) for c in centres])
    pivots = topk.Pivots(centres)
    cell, distance = pivots.nearest(rows)
    nearest = [{"cell": c, "nearest": np.sort(distance[cell == c])[:6].tolist()} for c in range(16)]
    reach = [{"cell": c, "rows": 4, "radius": distance[cell == c][:4].max()} for c in range(16)]
    pivots.bound(nearest, reach, 6, 4)
    at, group = pivots.wanted(rows)
    assert pivots.groups() == 16 and len(at) < 3 * len(rows)
    scores = rows @ rows.T
    for c in range(16):  # what was not sent is below the sixth best of each query
        sent = set(at[group == pivots.group[c]].tolist())
        for q in np.flatnonzero(cell == c)[:4]:
            assert set(np.flatnonzero(scores[q] >= np.sort(scores[q])[-6]).tolist()) <= sent


def test_topk_of_nothing_and_of_the_table(spark, folder):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.search(none, F.col("vec_id") % 50 == 0).count() == 0
    duckdb.sql(f"create or replace view embeddings as select * from '{folder}/embeddings.parquet'")
    assert sorted(map(tuple, op11_topk(spark, folder).collect())) == sorted(duckdb.sql(topk.oracle()).fetchall())


def runs_of(words, shortest=12):
    """From the definition: for each period the stretches of equal words that far apart, smallest periods first."""
    seen = {}
    for q in range(1, len(words) // 2 + 1):
        at = 0
        while at + q < len(words):
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            length = end - at + q
            if length >= max(shortest, 2 * q):
                seen.setdefault((at, length), q)
            at = end
    return sorted((s, n, q) for (s, n), q in seen.items())


def digest_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = sorted(runs_of(words), key=lambda r: (r[0], r[2]))
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return doc_id, len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], sha(listed), sha(kept)


def test_runs_of_random_words():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, k, n) for k in (1, 2, 3) for n in (0, 1, 11, 12, 13, 40, 90, 200)]
    for _ in range(60):
        unit = rng.integers(0, 3, rng.integers(1, 20))
        texts.append(np.concatenate([rng.integers(0, 4, rng.integers(0, 30)), np.resize(unit, rng.integers(1, 120)), rng.integers(0, 4, 9)]))
    for part in (texts, texts[::7]):
        for text, found in zip(part, runs.find_runs(part), strict=True):
            assert [tuple(map(int, r)) for r in found] == runs_of(text.tolist())


def test_extensions_of_the_grammar():
    rng = np.random.default_rng(4)
    text = np.concatenate([rng.integers(0, 2, 300), np.zeros(200, int), np.resize([0, 1, 1], 150)])
    words = np.concatenate([[2], text, [3]]).astype(np.int32)
    grammar = runs.Grammar(words, np.array([0, len(words) - 1]))
    i, j = np.sort(rng.integers(1, len(words) - 1, (2, 3000)), axis=0)
    i, j = i[i < j], j[i < j]
    for forward in (True, False):
        step = 1 if forward else -1
        for a, b, n in zip(i, j, grammar.extend(i, j, forward)):
            k = 0
            while words[a + step * k] == words[b + step * k]:
                k += 1
            assert n == k


def test_runs_of_odd_rows(spark, odd, none, monkeypatch):
    extra = [(200 + k, t) for k, t in enumerate(["x " * 2_000, "a b c\x0b a b c\x1f " * 9, "\x00 " * 14, "ä ö " * 6 + "x", "a b " * 5 + "a\nb"])]
    extra += [(k, " ".join(f"w{(k * j * j) % 7}" for j in range(150))) for k in range(300, 420)]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"))
    expected = sorted([digest_row(i, t) for i, t in df.collect() if len(t or "") < 200_000], key=str)
    long = {i for i, t in df.collect() if len(t or "") >= 200_000}
    for at_once in (400_000, 500):
        monkeypatch.setattr(runs, "WORDS_AT_ONCE", at_once)
        found = runs.digests(df.repartition(1)).drop("n_words").collect()
        assert sorted([tuple(r) for r in found if r.doc_id not in long], key=str) == expected
        assert len(found) == len(expected) + len(long)
    assert runs.digests(none).count() == 0
    assert sum(r.n_runs for r in found) > 100


def test_runs_of_the_table(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    short = [(i, t) for i, t in rows if len(t) < 6000]
    found = {r[0]: tuple(r)[:8] for r in op12_runs(spark, folder).collect()}
    assert len(found) == len(rows) and all(found[i] == digest_row(i, t) for i, t in short)


def test_divergence_of_the_table(spark, folder):
    duckdb.sql(f"create or replace view documents as select * from '{folder}/documents.parquet'")
    assert sorted(map(tuple, op13_divergence(spark, folder).collect())) == sorted(duckdb.sql(divergence.oracle()).fetchall())


def audit_of(rows, fewest, top):
    docs = [(a or "", b or "", [w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]) for t, a, b in rows]
    out = []
    for lang in {a for a, _, _ in docs}:
        mine = [(s, w) for a, s, w in docs if a == lang]
        having = Counter(t for _, w in mine for t in set(w))
        kept = [t for t, n in having.items() if n >= fewest]
        sums = {s: Counter() for s, _ in mine} | {None: Counter()}
        for s, w in mine:
            here = Counter(t for t in w if t in set(kept))
            sums[s] += here
            sums[None] += here
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in sums.items()}
        for s in sums:
            if s is None:
                continue
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sums if o not in (s, None)]
            terms = [(p[s][t] - p[None][t], t) for t in kept if sums[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, t, v, r) for r, (v, t) in enumerate(ordered, 1) if part == "pair" or r <= top]
    return sorted(out)


LOWER = {65 + k: 97 + k for k in range(26)}


@pytest.mark.parametrize("group_block, term_block", [(64, 4096), (2, 3)])
def test_divergence_equals_brute_force(spark, odd, group_block, term_block):
    rng = np.random.default_rng(7)
    rows = [(" ".join(f"w{chr(97 + x)}" for x in rng.geometric(0.15, rng.integers(0, 40)) % 26), f"l{k % 3}", f"s{k % 7}" if k % 3 else f"t{k}") for k in range(90)]
    rows += [("ÄÖ İx été Z😀 a_b", "l0", "s1"), (None, "l9", None), ("x", None, "s1"), ("", "l1", "only"), ("A" * 100_000, "l1", "long")] * 3
    rows += [(r.text, r.lang, r.source) for r in odd.collect() if len(r.text or "") < 1000]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "text string, lang string, source string, p int, term string")
    found = divergence.audit(df, 3, 6, group_block, term_block).collect()
    assert sorted(map(tuple, found)) == audit_of(rows, 3, 6)


def test_divergence_without_terms(spark, none):
    assert divergence.audit(none).count() == 0
    df = spark.createDataFrame([("1 2", "en", "a"), ("3", "en", "b")], "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(df).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
