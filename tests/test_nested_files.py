"""The nested line format of weighted sense-induction files, against a plain reader, and what is computed from it."""

import random

import pytest
from pyspark.sql import functions as F

from sensevec.operators import metrics, wsi
from sensevec.operators import model as M
from sensevec.plans import evaluate as EV
from sensevec.sources import nested
from sensevec.sources import wsi as sources


def plain_rows(lines):
    """Rows of one file, read line by line; ``record`` is the line of the word in the file."""
    at, out = 0, []
    while at < len(lines):
        record, (plain, word, weight, n) = at, lines[at].strip().split("\t")
        at += 1
        for sense_no in range(1, int(n) + 1):
            if at >= len(lines):
                break
            label, sense_weight, size = lines[at].strip().split("\t")
            at += 1
            for c in range(1, int(size) + 1):
                if at + 1 >= len(lines):
                    at = len(lines)
                    break
                words = lines[at + 1].strip().lower().split(" ")
                ascii_label = "".join(ch for ch in label.lower() if ord(ch) < 128)
                out.append(
                    (record, plain, word.lower(), int(weight), sense_no, ascii_label, int(sense_weight), not label.isascii(), c, int(lines[at]), words)
                )
                at += 2
    return out


def made_file(rng, records):
    lines = []
    for _ in range(records):
        word = rng.choice(["Bank", "bank", "plant", "sérac"])
        senses = rng.randrange(0, 5)
        lines.append(f"{word.lower()}\t{word}\t{rng.randrange(400, 900)}\t{senses}")
        for _ in range(senses):
            contexts = rng.choice([0, 1, 2, 3, 40])
            lines.append(f"{rng.choice(['bét', 'büt', 'money', 'River'])}\t{rng.randrange(9)}\t{contexts}")
            for _ in range(contexts):
                # words that look like a sense or a word line
                words = rng.choice(["a B c", "x\t1\t2", "p\tq\t5\t1", "", "one", "t\t3\t0", "u\t2\t-1"])
                lines += [str(rng.randrange(0, 4)), words]
    return lines


@pytest.mark.parametrize("block", [7, 64, 65_536])
def test_files_parse_like_a_plain_reader(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(nested, "LINE_BLOCK", block)
    rng = random.Random(block)
    wanted, before = [], 0
    for k in range(3):
        lines = made_file(rng, 12)
        if k == 1:  # ends inside a sense that promises more than all files hold
            lines += ["late\tlate\t700\t2", "cut\t1\t5000", "0", "some words", "1"]
        (tmp_path / f"part-{k}.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
        wanted += [(record + before, *rest) for record, *rest in plain_rows(lines)]
        before += len(lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        found = [tuple(r) for r in nested.read_nested(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(found) == sorted(wanted) and len(wanted) > 100


def test_written_records_come_back(spark, tmp_path):
    contexts = [(0, ["bank", "a"]), (1, ["b", "bank"])]
    senses = [("bét", 3, contexts), ("büt", 4, contexts[:1]), ("none", 5, [])]
    rows = [("bank", "Bank", 900, senses), ("bank", "Bank", 800, senses[:1]), ("alone", "alone", 10, [])]
    data = spark.createDataFrame(rows, sources.NESTED_SCHEMA)
    nested.write_nested(data, str(tmp_path / "out"))
    columns = ["word", "weight", "sense_no", "sense", "sense_weight", "has_utf", "context_id", "position", "words"]
    back = nested.read_nested(spark, str(tmp_path / "out")).select(*columns).collect()
    flat = sources.flatten_weighted(data, numbered=True).select(*columns).collect()
    assert sorted(map(tuple, back)) == sorted(map(tuple, flat)) and len(back) == 5


def planted_model(spark):
    """One ambiguous word ``bank``: sense 1 goes with ``a``, sense 2 with ``b``."""
    vocab = spark.createDataFrame([(1, "bank", 1000), (2, "a", 500), (3, "b", 500)], "word_id int, word string, freq long")
    model = M.new_model(vocab, 2, 2)
    paths = {(r.word_id, r.node_id): r.code for r in model.tree.collect()}
    split = next(n for w, n in paths if w == 2 and (3, n) in paths and paths[2, n] != paths[3, n])
    toward = 4.0 if paths[2, split] == 0 else -4.0
    vectors = [(w, s, [toward if s == 1 else -toward, 0.0]) for w in (1, 2, 3) for s in (1, 2)]
    nodes = [(r.node_id, [1.0 if r.node_id == split else 0.0, 0.0]) for r in model.out_vec.collect()]
    counts = [(1, [500.0, 500.0]), (2, [500.0, 0.0]), (3, [500.0, 0.0])]
    return model.with_tables(
        in_vec=spark.createDataFrame(vectors, "word_id int, sense int, vec array<float>"),
        out_vec=spark.createDataFrame(nodes, "node_id int, vec array<float>"),
        sense_counts=spark.createDataFrame(counts, "word_id int, counts array<double>"),
    )


def test_equal_labels_and_repeated_words_are_judged_apart(spark, tmp_path):
    model = planted_model(spark)
    near_a, near_b = [(0, ["bank", "a", "a"])] * 4, [(2, ["b", "b", "bank"])] * 4
    rows = [
        ("bank", "bank", 900, [("bét", 1, near_a), ("büt", 1, near_b)]),  # one label when stripped
        ("bank", "bank", 900, [("x", 1, near_a[:2] + near_b[:2]), ("y", 1, near_a[:2] + near_b[:2])]),
        ("bank", "bank", 100, [("x", 1, near_a), ("y", 1, near_b)]),  # too light
        ("a", "a", 900, [("x", 1, near_a), ("y", 1, near_b)]),  # one induced sense: counts with 0
    ]
    data = spark.createDataFrame(rows, sources.NESTED_SCHEMA)
    nested.write_nested(data, str(tmp_path / "weighted"))
    flat = nested.read_nested(spark, str(tmp_path / "weighted"))
    cells = wsi.weighted_contingency(flat, model).collect()
    by_record = {}
    for r in cells:
        by_record.setdefault(r.record, {})[r.truth, r.pred] = r.n
    assert sorted(map(lambda c: sorted(c.values()), by_record.values())) == [[2, 2, 2, 2], [4, 4]]
    even = spark.createDataFrame([("k", "x", 1, 2), ("k", "x", 2, 2), ("k", "y", 1, 2), ("k", "y", 2, 2)], "word string, truth string, pred int, n long")
    none = metrics.totals(even, "word").select(metrics.ari_column().alias("ari")).first().ari
    out = wsi.mean_ari(flat, model).first()
    assert out.words == 3 and out.mean_ari == pytest.approx((1.0 + none + 0.0) / 3)

    (tmp_path / "contexts.txt").write_text("bank.n 4\na\ta\nb\tb\n\ta a\nb b\t\n")
    (tmp_path / "key.txt").write_text("bank.n bank.n.1 s1\nbank.n bank.n.2 s2\nbank.n bank.n.3 s1\nbank.n bank.n.4 s2\n")
    files = {"labelled": (str(tmp_path / "contexts.txt"), str(tmp_path / "key.txt"))}
    job = {r.dataset: r for r in EV.evaluation_job(spark, model, files, {"weighted": str(tmp_path / "weighted")}).collect()}
    assert job["labelled"].mean_ari == pytest.approx(1.0) and job["labelled"].words is None
    assert job["weighted"].words == 3 and job["weighted"].mean_ari == pytest.approx(out.mean_ari)


def test_contexts_beyond_the_limit(spark):
    rows = spark.createDataFrame(
        [(r, "bank", s, "x", c) for r in (0, 1) for s in (1, 2) for c in range(1, 8)],
        "record long, word string, sense_no int, sense string, context_id long",
    )
    kept = wsi.capped_contexts(rows, 3).groupBy("record", "sense_no").agg(F.max("context_id").alias("m"), F.count("*").alias("n")).collect()
    assert len(kept) == 4 and all(r.m == r.n == 3 for r in kept)
