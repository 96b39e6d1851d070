import random
import zlib

import numpy as np
import pytest

from pagelens.llm import packing, records, tokens
from pagelens.llm.common import checkpoint_folder

SCHEMA = "doc_id long, text string"


def texts():
    rng = random.Random(3)
    odd = ["".join(rng.choice(" \t\n \x1c\x85 　ab1.'s<|é漢\r") for _ in range(60)) for _ in range(300)]
    return [None, "", " ", "the end", "it's  we'll　x\x0b\x0c y\r\n\r\nz", "a<|endoftext|><|endoftext|>b <|endoftext |>", "word" * 40_000, " " * 3_000_000 + "x", "\n" * 3_000_000, "\t" * 1_000_001, "Ñandú, näive — “quoted” text. " * 9_000, *odd]


def slow_crc32c(data):
    state = 0xFFFFFFFF
    for byte in data:
        state ^= byte
        for _ in range(8):
            state = (state >> 1) ^ (0x82F63B78 if state & 1 else 0)
    return state ^ 0xFFFFFFFF


def test_checksums():
    rng = random.Random(1)
    data = [b"123456789", *(rng.randbytes(n) for n in (0, 1, 2, 3, 4, 5, 7, 8, 9, 100, 1001, 4096, 33))]
    got = records.crc32c(data)
    assert got.tolist() == [slow_crc32c(x) for x in data] and got[0] == 0xE3069283
    assert records.crc32c([]).tolist() == [] and records.masked(got)[0] == (((0xE3069283 >> 15) | (0xE3069283 << 17)) + 0xA282EAD8) % 2**32
    frames = list(records.framed(data))
    assert records.unframed(frames) == data
    for at in (0, 9, 14, -1):
        broken = bytearray(frames[-1])
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframed([bytes(broken)])


def test_ids_of_pieces_are_those_of_whole_texts(monkeypatch):
    whole = tokens.tokenizer(tokens.vocabulary())
    monkeypatch.setattr(tokens, "STRETCH", 50)
    monkeypatch.setattr(tokens, "KNOWN", 100)
    ids = tokens.Ids(tokens.vocabulary(), 4)
    for text in [*texts(), "a   b", "a \t b", "x\u00a0  y", "x  ", " x", "a\u3000 \u3000b", "\x1c \x1cx", "a.' 's b's", "1 2 3,4 5"]:
        want = whole.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids.of(text or ""), "<u4").tolist() == want
    for text in (" " * 3_000_000, "\n" * 3_000_000, "\t" * 3_000_000 + "x"):  # the packer takes them too
        assert packing.ids_of(text, packing.encoder(packing.public_tokenizers.path("byte_bpe_50k.tiktoken"))) == whole.encode(text, add_special_tokens=False).ids


def test_records_round_trip(spark, tmp_path):
    rows = [(i * 7 % 400, t) for i, t in enumerate(texts())] + [(5, "twice"), (5, "twice"), (5, "other"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, file string, shard int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows go to one file
    try:
        index = records.write(docs, f"{checkpoint_folder(spark)}/records-test")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = tokens.tokenizer(tokens.vocabulary())
    got = [(r.doc_id, r.start, r.ids) for r in records.read(index).orderBy("start").collect()]
    ids = lambda t: np.array([*whole.encode(t or "", add_special_tokens=False).ids, records.END], "<u4").tobytes()
    assert sorted(((i is None, i or 0, zlib.crc32(x)) for i, _, x in got)) == sorted((i is None, i or 0, zlib.crc32(ids(t))) for i, t in rows)
    assert [(i is not None, i or 0) for i, _, _ in got] == sorted((i is not None, i or 0) for i, _ in rows)
    at = 0
    for _, start, x in got:
        assert start == at
        at += len(x) // 4
    assert index.select("file").distinct().count() > 1
    short = {(r.start, r.n_tokens, r.ids_crc32) for r in records.read(index, digests=True).collect()}
    assert short == {(s, len(x) // 4, zlib.crc32(x)) for _, s, x in got}
    # In any order, the same records.
    mixed = records.read(records.shuffled(index, 7)).collect()
    assert [r.start for r in mixed] != sorted(r.start for r in mixed)
    assert sorted((r.start, r.ids) for r in mixed) == [(s, x) for _, s, x in got]
    # A file that changed is noticed.
    name = index.orderBy("start").first().file.removeprefix("file:")
    with open(name, "r+b") as file:
        file.seek(13)
        old = file.read(1)
        file.seek(13)
        file.write(bytes([old[0] ^ 1]))
    with pytest.raises(Exception, match="checksum is wrong"):
        records.read(index).count()


def test_no_documents_no_files(spark):
    assert records.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
