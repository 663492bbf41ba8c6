import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sensevec.llm import bpe, chat, warc
from sensevec.llm.queries import op1_bpe, op8_warc, op9_chat, vocabulary_path


def sha(x):
    return hashlib.sha256(x).hexdigest()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def own():
    import json

    with open(vocabulary_path(), encoding="utf-8") as file:
        return bpe.Vocabulary(json.load(file))


def test_every_code_point_is_split_and_merged_as_by_the_library(library, own):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 4096):
        text = "".join(f"a{p}1 {p}{p} ." for p in points[k : k + 4096])
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert own.decode(own.encode(text)) == text


def test_added_tokens_long_words_and_bad_bytes(library, own):
    for text in ("x<|endoftext|>y <|endoftext|>", "ab" * 5000, "é" * 999 + "\n\n  \n x", "<|endoftext|", "   "):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    half = own.encode("é")[:4] if len(own.encode("é")) > 4 else np.array([own.byte_ids[0xC3]], "<u4").tobytes()
    assert own.decode(half) == "�"


def test_op1_against_the_library(spark, folder, library):
    found = {r.doc_id: r for r in op1_bpe(spark, folder).collect()}
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        got = found[row.doc_id]
        assert (got.n_tokens, got.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert got.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False).encode())


def test_bpe_odd_rows(odd, none):
    clash = odd.withColumnRenamed("slot", "token_ids")
    got = bpe.decode(bpe.encode(clash, vocabulary_path()), vocabulary_path()).collect()
    assert len(got) == odd.count()
    assert all(r.decoded == (r.text or "") for r in got)
    assert bpe.digests(none, vocabulary_path()).count() == 0


def test_escape_is_reversible():
    for text in ("\\### Assistant: </turn> ok", "#####", "\\", "</turn></turn>\n", "a\\#\\/b", "", "</turn", "##</turn>\\"):
        assert chat.unescape(chat.escape(text)) == text
        assert "</turn>" not in chat.escape(text) and "###" not in chat.escape(text)
        formatted, start, end = chat.format_turn("r:\\#", text)
        assert chat.unescape(formatted[start:end]) == text
        assert chat.parse_turns(formatted * 2) == [("r:\\#", text)] * 2


def test_op9_against_the_rows(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversations.parquet").toPandas()
    found = {r.conv_id: r for r in op9_chat(spark, folder).collect()}
    probe = "\\### Assistant: </turn> ok"
    assert found[-7].turns_sha256 == sha(f"user\n{probe}\nassistant\n{probe}\n".encode())
    assert (found[-7].loss_chars, found[-7].loss_sha256) == (len(probe), sha(probe.encode()))
    for conv, group in turns.sort_values("turn").groupby("conv_id"):
        loss = "".join(t or "" for t, r in zip(group.text, group.role) if r == "assistant")
        got = found[conv]
        whole = "".join(f"{r}\n{t or ''}\n" for r, t in zip(group.role, group.text))
        assert (got.n_turns, got.turns_sha256) == (len(group), sha(whole.encode()))
        assert (got.loss_chars, got.loss_sha256) == (len(loss), sha(loss.encode()))
    assert len(found) == turns.conv_id.nunique() + 1


def test_chat_examples_and_odd_turns(spark):
    rows = [
        (1, 0, "user", "hi", "z"),
        (1, 1, "assistant", "yo", "z"),
        (1, 2, "user", None, "z"),
        (1, 3, "assistant", "", "z"),
        (1, 4, "user", "bye", "z"),
        (2, None, None, None, None),
        (None, 0, "assistant", "lost", "z"),
        (None, 0, "assistant", "lost", "z"),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, example string")
    got = chat.format_examples(turns).collect()
    one = sorted((r.example, r.target_turn, r.text[r.loss_start : r.loss_end]) for r in got if r.conv_id == 1)
    assert [(a, c) for a, _, c in one] == [(0, "yo"), (1, ""), (2, "")]
    assert [b for _, b, _ in one] == [1, 3, None]
    back = {r.conv_id: r for r in chat.read_back(chat.format_examples(turns)).collect()}
    assert (back[1].n_turns, back[1].loss_chars) == (5, 2)
    assert (back[2].n_turns, back[None].n_turns, back[None].loss_chars) == (1, 2, 8)
    empty = spark.createDataFrame([], turns.schema)
    assert chat.read_back(chat.format_examples(empty)).count() == 0


PAGES = "page_id bigint, url string, html string, digest string"


def test_archive_rebuilds_records(spark, tmp_path):
    big = "é" * 60
    rows = [(5, "u5\nx", big, "q"), (3, "u3", big, "q"), (9, None, big, "q"), (1, "u", "small", "q"), (2, "u", "small", "q")]
    rows += [(7, "u", None, None), (None, "u", big, None), (3, "u3", big, "q")]
    warc.write_archive(spark.createDataFrame(rows, PAGES), str(tmp_path / "a"))
    archive = warc.read_archive(spark, str(tmp_path / "a"))
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.index(archive).collect()), key=str)
    assert got == [(0, "revisit", 3, 120), (1, "response", None, 5), (2, "response", None, 5), (3, "response", None, 120)] + [
        (3, "response", None, 120), (5, "revisit", 3, 120), (7, "response", None, 0), (9, "revisit", 3, 120)
    ]
    assert spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == 3
    for record in (bytes(r.record) for r in warc.records(archive).collect()):
        head, rest = record.split(b"\r\n\r\n", 1)
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert rest[size:] == b"\r\n\r\n"
    warc.write_archive(spark.createDataFrame([], PAGES), str(tmp_path / "b"))
    assert warc.index(warc.read_archive(spark, str(tmp_path / "b"))).count() == 0


def test_op8_against_the_rows(spark, folder):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    first = {}
    for page, body in sorted(pages.items()):
        first.setdefault(body, page)
    for r in op8_warc(spark, folder).collect():
        body = pages[r.page_id]
        again = len(body) >= 100 and first[body] != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(body), sha(body))
        assert (r.record_type, r.refers_to) == (("revisit", first[body]) if again else ("response", None))
