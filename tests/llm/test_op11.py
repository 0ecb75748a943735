import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpus import documents, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import op11_token_ids as op11

TEXTS = ["Hello, World! don't", "", None, "ünï çödé ÉTÉ ﬁn", "a b\x1cc d", "x" * 3000, "<|endoftext|> is text<|startoftext|>", "é ́x", "tab\tnew\r\nline\x0b\x0c ", "日本語 テキスト 🙂🙂", "1234 5.6'll we've"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(op11.tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=70))
def test_code_round_trip(ranks):
    ranks = np.array(ranks, dtype=np.uint32)
    control, data = op11.encode_ranks(ranks)
    assert len(control) == -(-len(ranks) // 4)
    assert len(data) == sum(1 + (r > 255) + (r > 65535) + (r > 2**24 - 1) for r in ranks.tolist())
    assert op11.decode_ranks(control, data, len(ranks)).tolist() == ranks.tolist()
    assert op11.unpack(op11.pack(ranks)).tolist() == ranks.tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\r'.,aB1é́\x1c\x85 <|>")), max_size=40), max_size=5))
def test_words_apart_give_the_ids_of_whole_texts(plain, texts):
    encoder = op11.Encoder()
    for _ in range(2):  # the second time from memory
        assert [ids.tolist() for ids in encoder.encode(pa.array(texts, pa.string()))] == [plain(t) for t in texts]


def test_encoder(plain, monkeypatch):
    for apart in (True, False):
        assert [ids.tolist() for ids in op11.Encoder(words_apart=apart).encode(pa.array(TEXTS))] == [plain(t) for t in TEXTS]
    monkeypatch.setattr(op11, "CACHE_WORDS", 5)  # it forgets each time
    encoder = op11.Encoder()
    for t in TEXTS:
        assert encoder.encode(pa.array([t], pa.string()))[0].tolist() == plain(t)


def test_documents_over_several_blocks(monkeypatch):
    monkeypatch.setattr(op11, "BLOCK_IDS", 7)
    docs = [(None, []), (1, [5] * 3), (2, list(range(40))), (3, []), (3, [1] * 7), (4, [9])]
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs], "ids": [op11.pack(np.array(v, dtype=np.uint32)) for _, v in docs]})
    made = [b for out in op11._to_blocks(np.arange(50, dtype=np.uint32))(iter([batch])) for b in out.column("block").to_pylist()]
    assert len(made) > 7
    content = b"".join(b + op11.BREAK for b in made)
    files = pa.RecordBatch.from_pydict({"part": [0], "content": [content]})
    found = [r for out in op11._decode(np.arange(50, dtype=np.uint32), True)(iter([files])) for r in out.to_pylist()]
    assert [(r["doc_id"], r["ids"]) for r in found] == docs
    assert [r["start"] for r in found] == [0, 0, 3, 43, 43, 50]
    sizes = [r for out in op11._sizes(iter([files])) for r in out.to_pylist()]
    assert sizes == [{"part": 0, "n_docs": 6, "n_ids": 51}]


def test_damage_is_found():
    content = op11.block([(1, 5, op11.BEGINS | op11.ENDS)], np.arange(5)) + op11.BREAK
    assert len(list(op11.blocks(content))) == 1
    for bad in (content[:-1], content[:10], b"XXXX" + content[4:], content[:-3] + b"\xff" + content[-2:], content + b"rest"):
        with pytest.raises(op11.FormatError):
            list(op11.blocks(bad))


@pytest.mark.parametrize("file_ids", [8_000_000, 2000])
def test_round_trip_of_a_table(spark, plain, tmp_path, file_ids):
    rows = documents(80) + [(5000 + i, t, None, None, None) for i, t in enumerate(TEXTS)]
    path = f"{tmp_path}/ids"
    op11.write(frame(spark, rows), path, file_ids=file_ids)
    found = op11.read(spark, path).collect()
    assert len(found) == len(rows)
    order = sorted(found, key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)
    want = sorted((-1 if r[0] is None else r[0], plain(r[1]) + [1]) for r in rows)
    assert sorted((d, r.ids) for d, r in zip(ids, order, strict=True)) == want
    place = 0
    for r in order:
        assert (r.start, r.n_tokens) == (place, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        place += r.n_tokens
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    counts = [r["n"] for r in ranks]
    assert counts == sorted(counts, reverse=True) and sum(counts) == place
    n_files = len([n for n in os.listdir(f"{path}/data") if n.startswith("part-")])
    assert n_files > 10 if file_ids == 2000 else n_files == 1


def test_empty_and_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", 3, 4)], "doc_id long, text string, row int, ids int")
    op11.write(docs.limit(0), f"{tmp_path}/none")
    assert op11.read(spark, f"{tmp_path}/none").collect() == []
    op11.write(docs, f"{tmp_path}/one", end_id=None)
    assert op11.read(spark, f"{tmp_path}/one", ids=False).first()["n_tokens"] == 2
