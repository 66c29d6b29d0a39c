"""Packing against the vocabulary's library: every id in one piece, no gap, no padding; related documents share windows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

P = pytest.importorskip("public_tokenizers")
from quadrille.llm import lexical_packing, queries, token_ids  # noqa: E402

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_of_the_library(library):
    coder, rng = token_ids.TokenIds(PATH, token_ids.character_classes()), random.Random(1)
    bits = ["a", "bc", "I", "'", "'s", "'re", "'ll", "'ve", "'t", "'m", "'d", "'S", " ", "  ", "\n", "\t", " \n", "\r\n", "1", "23", "!", "...", "é", "漢", "　", "\xa0", " ", "\x85", "\x1c", "\x1f", "́", "\U0001f600", "½", "<|endoftext|>", "<|endof", "_", "\x00", "ǅ", "٣", " '", "᠎", "​", "﻿"]
    for _ in range(500):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(8)]
        raw = [t.encode() for t in texts]
        ids, first = coder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_hash_table_of_numbers():
    rng, table, all_of = np.random.default_rng(1), token_ids.Numbers(4), np.zeros(0, np.uint64)
    for _ in range(40):
        new = np.setdiff1d(np.unique(rng.integers(1, 2000, 30).astype(np.uint64) << np.uint64(53)), all_of)
        new = new[new != 0]
        table.add(new)
        all_of = np.concatenate([all_of, new])
        assert (table.find(all_of) == np.arange(len(all_of))).all() and (table.find(all_of + np.uint64(1)) == -1).all()


def test_packs_of_random_lengths():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, window = rng.integers(1, 40), int(rng.choice([8, 16, 64]))
        size = rng.integers(1, rng.choice([4, 50, 300]), n)
        bounds = np.concatenate([[0], np.cumsum(size)])
        check(lexical_packing.pack(rng.integers(0, rng.choice([3, 50]), bounds[-1]).astype(np.uint16), bounds, window)[:, [0, 1, 2, 3, 4]].tolist(), size, window)


def check(pieces, size, window):
    """Every id in one piece, sequences without gaps, full or of a power of two."""
    covered, sequences = {}, {}
    for doc, start, length, sequence, offset in pieces:
        covered.setdefault(doc, []).append((start, length))
        sequences.setdefault(sequence, []).append((offset, length))
    assert set(covered) == set(range(len(size)))
    for places, total in [(covered[d], size[d]) for d in covered] + [(v, None) for v in sequences.values()]:
        end = 0
        for at, length in sorted(places):
            assert at == end and length > 0
            end += length
        assert end == total if total is not None else end == window or (end < window and end & (end - 1) == 0)


def test_query_on_real_documents(spark, library):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op11_packing"](spark, SF).collect()
    order = {i: k for k, i in enumerate(rows)}
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows.items()}
    check([(order[r.doc_id], r.start, r.length, r.sequence_id, r.offset) for r in got], [len(ids[i]) for i in rows], 2048)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())


def test_odd_rows_and_small_shards(spark, library):
    long = " ".join(f"word{i % 977}" for i in range(9000))
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (4, long), (5, "same text"), (5, "same text"), (5, "other"), (None, "no id"), (None, None), (6, " \n"), *((100 + i, "copied words " * 50) for i in range(300))]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, mark="m", ids=1, part="p") for i, t in rows], "doc_id long, text string, mark string, ids int, part string")
    runs = [sorted(map(str, map(tuple, lexical_packing.packed(docs, PATH, shard_tokens=4000).collect()))) for _ in range(2)]
    assert runs[0] == runs[1]  # the same packing each time
    got = lexical_packing.packed(docs, PATH, shard_tokens=4000).collect()
    assert sum(r.length for r in got) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert len({r.sequence_id >> 32 for r in got}) > 5  # the copies are dealt over shards
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in by_sequence.values():
        end = sum(length for _, length in v)
        assert sorted(v)[0][0] == 0 and (end == 2048 or end & (end - 1) == 0)
    four = b"".join(bytes(r.ids) for r in sorted((r for r in got if r.doc_id == 4), key=lambda r: r.start))
    assert np.frombuffer(four, "<u4").tolist() == [*library.encode(long, add_special_tokens=False).ids, 1]
    assert lexical_packing.packed(docs.limit(0), PATH).collect() == []


def test_related_documents_share_windows():
    rng = np.random.default_rng(2)
    topics = [rng.integers(100 * t, 100 * t + 60, (20, 40)) for t in range(10)]  # ten topics of twenty documents
    docs = [(t, d) for t, rows in enumerate(topics) for d in rows]
    rng.shuffle(order := np.arange(len(docs)))
    docs = [docs[i] for i in order]
    ids = np.concatenate([d for _, d in docs]).astype(np.uint16)
    pieces = lexical_packing.pack(ids, np.arange(len(docs) + 1) * 40, 200)
    windows = {}
    for doc, _, _, sequence, _ in pieces.tolist():
        windows.setdefault(sequence, []).append(docs[doc][0])
    assert np.mean([len(set(v)) == 1 for v in windows.values()]) > 0.8
