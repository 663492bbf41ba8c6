import numpy as np

from sensevec.llm import near_text
from sensevec.llm.alignment import similar


def test_drifting_texts_of_one_bucket(spark, monkeypatch):
    """Several hundred texts share a bucket; links run along chains, and classes have more than 32 members."""
    rng = np.random.default_rng(11)
    texts, passage = [], [f"p{k}" for k in range(60)]
    for chain in range(3):
        words = [f"c{chain}w{k}" for k in range(140)]
        for step in range(110):
            texts.append([*passage, *words])
            for at in rng.choice(140, 34, replace=False):
                words[at] = f"c{chain}s{step}x{at}"
    docs = [(int(i), " ".join(texts[k])) for k, i in enumerate(rng.permutation(len(texts)))]
    split = {i: np.array([hash(w) for w in t.split()]) for i, t in docs}
    pairs = [(a, b) for a in split for b in split if a < b]
    root = {i: i for i in split}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), linked in zip(pairs, similar([(split[a], split[b]) for a, b in pairs], 0.8)):
        if linked:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert len({find(i) for i in root}) < 100
    monkeypatch.setattr(near_text, "BLOCK_ROWS", 100, raising=False)
    texts = spark.createDataFrame([(str(i), [hash(w) for w in t.split()]) for i, t in docs], "text_key string, words array<bigint>")
    buckets = texts.selectExpr("1L as bucket", "text_key")
    found = {r.node: r.root for r in near_text._classes(buckets, texts, 0.8).collect()}
    named = {i: found.get(str(i), str(i)) for i in root}
    wanted = {i: min(str(x) for x in root if find(x) == find(i)) for i in root}
    assert named == wanted


def test_bounds_never_exclude_a_link():
    rng = np.random.default_rng(2)
    pairs = []
    for _ in range(400):
        a = rng.integers(0, 1 << 40, rng.integers(1, 60))
        b = a.copy()
        for at in rng.integers(0, len(b), rng.integers(0, 14)):
            b[at] = rng.integers(0, 1 << 40)
        pairs.append((a, np.delete(b, rng.integers(0, len(b), rng.integers(0, 4)))))
    linked = similar(pairs, 0.8)
    sides = [(np.array([len(p[k]) for p in pairs]), near_text._bins([p[k] for p in pairs])) for k in (0, 1)]
    possible = near_text._possible(*sides, 0.8)
    assert 50 < linked.sum() < 350 and not (linked & ~possible).any() and not possible.all()


def test_scattered_edits_share_a_sketch():
    """Recall of candidates at the similarity that links ask for."""
    rng = np.random.default_rng(3)
    for size in (5, 7, 10, 13, 15, 20, 40, 100, 126, 200, 1000):
        for similarity in (0.8, 0.85, 0.9):
            shared, times = 0, 100
            for _ in range(times):
                a = rng.integers(0, 1 << 62, size).astype(np.uint64)
                b = a.copy()
                b[rng.choice(size, int((1 - similarity) * size + 1e-9), replace=False)] = rng.integers(0, 1 << 62)
                shared += len(np.intersect1d(near_text.all_sketches(a), near_text.all_sketches(b))) > 0
            assert shared >= 97, (size, similarity, shared)


def test_short_texts_with_one_other_word(spark):
    rows = [(0, "the old cat sat on my mat"), (1, "the old dog sat on my mat"), (2, "a quite different text of seven words")]
    found = near_text.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == {0: 0, 1: 0, 2: 2}


def test_candidates_after_insertions_and_deletions():
    """Recall of candidates at the lowest similarity that links, for words put in, taken out, and both with substitutions."""
    rng = np.random.default_rng(8)

    def fresh(n):
        return rng.integers(0, 1 << 62, n).astype(np.uint64)

    for size in (10, 20, 46, 61, 130, 400):
        edits = int(0.2 * size + 1e-9)
        for kind in ("out", "in", "mixed"):
            shared = 0
            for _ in range(60):
                a = fresh(size)
                if kind == "out":
                    b = np.delete(a, rng.choice(size, edits, replace=False))
                elif kind == "in":
                    more = int(size / 0.8 - size + 1e-9)
                    b = np.insert(a, rng.choice(size + 1, more), fresh(more))
                else:
                    b = np.delete(a, rng.choice(size, edits // 3, replace=False))
                    b[rng.choice(len(b), edits // 3, replace=False)] = rng.integers(0, 1 << 62)
                    b = np.insert(b, rng.choice(len(b) + 1, edits // 3), fresh(edits // 3))
                shared += len(np.intersect1d(near_text.all_sketches(a), near_text.all_sketches(b))) > 0
            assert shared >= 57, (size, kind, shared)


def test_sketches_keep_order():
    """Every sketch is of two k-mers at least, and a text whose words stand the other way round shares none."""
    rng = np.random.default_rng(9)
    for size in (40, 300):
        words = rng.integers(0, 1 << 62, size).astype(np.uint64)
        turned = np.concatenate([words[size // 2 :], words[: size // 2]])
        assert len(np.intersect1d(near_text.all_sketches(words), near_text.all_sketches(words[::-1]))) == 0
        same = len(np.intersect1d(near_text.all_sketches(words), near_text.all_sketches(turned)))
        assert same < len(near_text.all_sketches(words)) * 0.7
    assert all(kmers >= 2 for _, _, _, kmers, _ in near_text.FURTHER) and near_text.KMERS >= 2
