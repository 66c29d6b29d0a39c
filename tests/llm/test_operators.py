"""Each operator against a plain computation on small tables with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from quadrille.llm import _bitmap, byte_runs, components, fm_index, language_id, line_dedup, matroska, phrase_index, quote_threads, sentence_pieces, simhash, substring_dedup, token_counts, toxicity

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
SPACE_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(raw: bytes) -> bytes:
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw)


@pytest.fixture(scope="module")
def docs(spark):
    """Real rows, and rows of every odd kind; the extra columns have names that operators use inside."""
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(3)
    long = " ".join(rng.choice(base)[1] for _ in range(40))
    odd = [(1000, None), (1001, ""), (1002, " \n\t\r\n "), (1003, "word"), (1004, base[3][1]), (1005, base[3][1] + " end"), (1006, "start " + base[7][1]), (1007, long), (1008, "x" * 3000), (1009, "a b c d " * 300), (1010, "a b c d " * 200 + "tail"), (1011, "é漢\U0001f600▁ <|endoftext|> \x00\x1f"), (1012, "!!! ... ???"), (1003, "word")]
    rows = base + odd
    rows.append(rows[5])
    return spark.createDataFrame([(i, t, "k", 1, "z") for i, t in rows], "doc_id long, text string, key string, fp int, anchor string"), rows


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs[0].schema)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def find(parent, a):
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    return a


# ---- line dedup ----


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, line, edits):
    s = list(line)
    for _ in range(edits):
        at = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        if kind == 0 or not s:
            s.insert(at, rng.choice("abzé"))
        elif kind == 1:
            s.pop(min(at, len(s) - 1))
        else:
            s[min(at, len(s) - 1)] = rng.choice("abzé")
    return "".join(s)


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 16)))
        b = changed(rng, a, rng.randint(0, 4))
        for t in range(4):
            assert line_dedup.edit_distance_within(a, b, t) == (edit_distance(a, b) <= t)


def test_line_pairs_within_their_threshold_share_a_key():
    rng = random.Random(2)
    for _ in range(400):
        a = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(8, 60)))
        b = changed(rng, a, rng.randint(0, 2))
        t = line_dedup.threshold(min(len(a), len(b)))
        if a == b or not t or edit_distance(a, b) > t:
            continue
        key, who, probes = line_dedup.join_keys([a, b])
        sides = [{(k, p) for k, w, p in zip(key.tolist(), who.tolist(), probes.tolist()) if w == side} for side in (0, 1)]
        assert any((k, not p) in sides[1] for k, p in sides[0])


def plain_lines(rows):
    at = {}
    for i, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if line.strip():
                at.setdefault(line.strip(), set()).add((i, n))
    lines = sorted(at, key=len)
    parent = {x: x for x in lines}
    for i, a in enumerate(lines):
        t = line_dedup.threshold(len(a))
        for b in lines[i + 1 :] if t else []:
            if len(b) - len(a) > t:
                break
            if find(parent, a) != find(parent, b) and line_dedup.edit_distance_within(a, b, t):
                parent[find(parent, a)] = find(parent, b)
    groups = {}
    for x in lines:
        groups.setdefault(find(parent, x), set()).update(at[x])
    gone = {}
    for places in groups.values():
        for i, n in sorted(places)[1:]:
            gone.setdefault(i, set()).add(n)
    return gone


def test_line_dedup(spark, docs, empty, monkeypatch):
    rng = random.Random(5)
    rows = list(docs[1])
    base = [x for _, t in rows[:60] for x in (t or "").split("\n") if x.strip()]
    hot = max(base, key=len)[:90]
    for k in range(40):
        rows.append((2000 + k, "\n".join([changed(rng, rng.choice(base), rng.randint(0, 3)), f"short line {k}", f"tiny{k % 7}", "", changed(rng, hot, rng.randint(0, 3))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_lines(rows)
    for block, held in ((512, 200_000), (8, 5)):  # few members a block: large groups are dealt in pairs of blocks; few rows held: they are streamed
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        monkeypatch.setattr(line_dedup, "HELD", held)
        got = line_dedup.line_report(df).collect()
        assert len(got) == len(rows)
        assert all(set(r.removed) == want.get(r.doc_id, set()) for r in got)
    assert line_dedup.line_report(empty).count() == 0


def test_texts_without_duplicate_lines(spark):
    rows = [(1, "one line that is long enough\nother", "en", 9), (2, "one line that is long enouch\nmore text stands here", "en", 9), (3, None, "en", 0), (4, "other", "de", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got = by_id(line_dedup.without_duplicate_lines(df))
    assert got[2].text == "more text stands here" and got[2].n_chars == 21 and got[1].text == rows[0][1] and got[3].text is None and got[4].text == "" and got[4].n_chars == 0


# ---- toxicity ----


def test_toxicity_separates(spark, empty):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["ba", "ko", "ri", "tu", "sen"]) for _ in range(3))
    rows, labels = [], []
    for i in range(900):
        w = [word() for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(60)] = "grumz" + rng.choice(["a", "el", "ist", "or"])
        rows.append((i, " ".join(w), "x"))
        labels.append((i, 1, int(toxic)))
    rows += [(9000, None, "x"), (9001, "", "x")]
    df, lb = spark.createDataFrame(rows, "doc_id long, text string, toxic string"), spark.createDataFrame(labels + [(9000, 1, None)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.toxicity(df, lb))
    held = [(got[i].score, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got) and len(got) == len(rows)
    assert min(s for s, t in held if t) > max(s for s, t in held if not t)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert toxicity.toxicity(empty, lb).count() == 0
    assert {r.score for r in toxicity.toxicity(df, lb.filter("toxic = 0")).collect()} == {0.0}


def plain_ratio(toxic, ordinary, length):
    """log P(last byte | others) under the two classes, said plainly."""
    import math

    def grams(texts, n):
        out = {}
        for t in texts:
            raw = b" " * (length - 1) + lower(t.encode())
            for i in range(length - 1, len(raw)):
                g = raw[i - n + 1 : i + 1]
                out[g] = out.get(g, 0) + 1
        return out

    d, counts = 0.75, [grams(c, length) for c in (toxic, ordinary)]
    suffixes = [{} for _ in counts]
    for c, s in zip(counts, suffixes):
        for g in c:
            s[g[1:]] = s.get(g[1:], 0) + 1
    shared = {}
    for g in set(suffixes[0]) | set(suffixes[1]):
        shared[g[1:]] = shared.get(g[1:], 0) + 1

    def share(table, g, backoff):
        row = [n for x, n in table.items() if x[:-1] == g[:-1]]
        return (max(table.get(g, 0) - d, 0) + sum(min(n, d) for n in row) * backoff) / sum(row) if row else backoff

    def ratio(run):
        end = run[2:]
        z = (shared.get(end, 0) + 1 / 256) / (sum(n for x, n in shared.items() if x[:-1] == end[:-1]) + 1)
        t, o = (share(c, run, share(s, run[1:], z)) for c, s in zip(counts, suffixes))
        return math.log(t / o)

    return ratio


@pytest.mark.parametrize("length", [3, 4])
def test_log_ratios_are_those_of_the_formula(spark, length):
    import numpy as np

    rng = random.Random(9)
    toxic, ordinary = ["".join(rng.choice("abq ") for _ in range(90)) for _ in range(3)], ["".join(rng.choice("abcé ") for _ in range(150)) for _ in range(5)]
    df = spark.createDataFrame([(t, 1, k % 2) for k, t in enumerate(toxic)] + [(t, 0, k % 2) for k, t in enumerate(ordinary)], "text string, toxic int, part int")
    part, whole = toxicity.train_ratios(df, length)
    raw = [(b" " * length + lower(t.encode()))[i : i + length] for t in toxic + ordinary for i in (0, 1, 5, 17, 40)] + [b"zzzz"[:length], b"abzq"[-length:], b"qqqq"[:length]]
    for got, texts in ((part, (toxic[::2], ordinary[::2])), (whole, (toxic, ordinary))):
        ratio = plain_ratio(*texts, length)
        want = np.clip([ratio(r) for r in raw], -toxicity.LIMIT, toxicity.LIMIT)
        found = got.of(np.array([int.from_bytes(r, "big") for r in raw]))
        assert np.abs(found - want).max() < 1e-5
    assert not toxicity.train_ratios(df.filter("toxic = 1"), length)[1].of(np.array([1, 2, 3])).any()


def test_scores_follow_from_the_ratios(spark):
    """Features, worst passages and scores of whole texts against plain loops."""
    import numpy as np

    rng = random.Random(12)
    rows = [(i, "".join(rng.choice("abq " if i % 4 == 0 else "abc ") for _ in range(rng.choice([0, 3, 47, 48, 49, 330, 1024, 1500, 3700]))), int(i % 4 == 0)) for i in range(160)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got = by_id(toxicity.toxicity(df, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")))
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    ratios = toxicity.train_ratios(spark.createDataFrame([(t, y, int(zlib.crc32(str(i).encode()) % 4 == 3)) for i, t, y in train], "text string, toxic int, part int"))

    def features(v):
        out = [v.mean() if len(v) else 0.0]
        for span in toxicity.SPANS:
            at = list(range(0, max(len(v) - span, 0), span // 2)) + [max(len(v) - span, 0)] if len(v) else []
            means = sorted((v[a : a + span].sum() / span for a in at), reverse=True)
            top = means[: -(-len(means) // 8)]
            out.append(sum(top) / len(top) if top else 0.0)
        return [*out, len(v)]

    def values(t, r):
        raw = t.encode()
        x = byte_runs.runs(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), toxicity.LENGTH) if raw else np.zeros(0, np.int64)
        return r.of(x)

    curve = [(toxicity.design([np.array([c]) for c in features(values(t, ratios[0]))])[0], y) for i, t, y in train if zlib.crc32(str(i).encode()) % 4 == 3]
    w = toxicity.fit_curve(np.array([c for c, _ in curve]), np.array([y for _, y in curve], dtype=float))
    for i, t, _ in rows:
        v = values(t, ratios[1])
        f = features(v)
        assert np.allclose(f[:3], [got[i].mean_ratio, got[i].top_short, got[i].top_long], atol=1e-6)
        odds = lambda f: float(toxicity.design([np.array([c]) for c in f])[0] @ w)
        z = odds(f)
        if len(v) > toxicity.PASSAGE:
            at = list(range(0, len(v) - toxicity.PASSAGE, toxicity.PASSAGE // 2)) + [len(v) - toxicity.PASSAGE]
            z = max(z, max(odds(features(v[a : a + toxicity.PASSAGE])) for a in at) - toxicity.CAUTION * np.log(len(at)))
        p = 1 / (1 + np.exp(-z))
        assert abs(got[i].score - p) < 1e-4 and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and (got[i].predicted == int(p >= 0.3) or abs(p - 0.3) < 1e-4)


# ---- token counts ----


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    df, rows = docs
    got = by_id(token_counts.token_counts(df, path, limit=300))
    for i, text in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 300)
    assert token_counts.token_counts(empty, path).count() == 0


def test_token_counts_of_random_texts():
    from tokenizers import Tokenizer

    path, rng = P.path("byte_bpe_50k.json"), random.Random(1)
    t, m = Tokenizer.from_file(path), token_counts.MergeTable.load(path)
    letters = " \t\n\r\x0b\x0c\x1c\x1f\x85 　​aAbé'sdtllreve1٣Ⅷ!?.<|endoftext|>ß漢\U0001f600"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + ["<|endoftext|>" * 3, "a" * 2000, "ab" * 700 + " " * 600, "".join(rng.choice("etaoin") for _ in range(3000))]
    assert token_counts.count_texts(m, texts, {}) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


# ---- sentence pieces ----


def test_sentence_pieces(docs, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    df, rows = docs
    coded = sentence_pieces.encode_texts(df, path)
    got = by_id(coded)
    for i, text in rows:
        assert got[i].ids == m.encode(text or "") and got[i].n_tokens == len(got[i].ids) and got[i].round_trip
    for r in sentence_pieces.decode_texts(coded, path).collect():
        assert r.text == m.decode(got[r.doc_id].ids)
    assert sentence_pieces.encode_texts(empty, path).count() == 0


def test_sentence_pieces_of_random_texts():
    import sentencepiece

    path, rng = P.path("piece_bpe_32k.model"), random.Random(2)
    m, e = sentencepiece.SentencePieceProcessor(model_file=path), sentence_pieces.Encoder(sentence_pieces.Pieces.load(path))
    letters = "  ▁abcdeétrinsolhu.,;:!'\"()012\n\t漢梦ß\U0001f600\x00ﬁ①"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [" " * k for k in range(40)] + ["a" * 300, "(" * 50 + "=" * 77 + "-" * 130, "".join(rng.choice("etaoinshr") for _ in range(1500))]
    flat, b = e.encode(texts)
    assert [flat[x:y].tolist() for x, y in zip(b, b[1:])] == m.encode(texts)
    ids = [[rng.randrange(3, 32000) for _ in range(20)] for _ in range(200)]
    assert [sentence_pieces.decode_ids(e.p.text, x) for x in ids] == [m.decode(x) for x in ids]


# ---- media ----


def test_media(docs, empty):
    df, rows = docs
    got = by_id(matroska.media_digests(df))
    for i, text in rows:
        raw = (text or "").encode()
        pad = raw + b" " * (-len(raw) % 192 if raw else 192)
        media = matroska.mux(pad)
        assert matroska.demux(media) == pad
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32, got[i].media_bytes, got[i].media_sha256) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]), len(media), hashlib.sha256(media).hexdigest())
    assert matroska.media_digests(empty).count() == 0


def test_packet_table(spark):
    payload = bytes(range(256)) * 1200
    media = matroska.mux(payload)
    df = spark.createDataFrame([(1, bytearray(media)), (2, None), (3, bytearray(b"nonsense")), (4, bytearray(media[:-7]))], "doc_id long, media binary")
    rows = matroska.packet_table(df).orderBy("doc_id", "offset").collect()
    own = [r for r in rows if r.doc_id == 1]
    assert b"".join(media[r.offset : r.offset + r.size] for r in own) == payload
    assert [r.timestamp_ms for r in own] == [i * 240 for i in range(len(own))] and own[-1].cluster > 0
    assert [r.ok for r in rows if r.doc_id != 1] == [False, False]
    assert matroska.seek(media, 4000) == max(c for t, c in matroska.packets(media)[1]["cues"] if t <= 4000)
    assert media[matroska.seek(media, 0) :][:4] == bytes.fromhex("1f43b675")


def test_foreign_lacing_and_unknown_sizes():
    M = matroska
    xiph = M.put_size(1) + b"\x00\x05" + bytes([0x02, 2, 255, 1, 3]) + b"a" * 256 + b"b" * 3 + b"c" * 7
    fixed = M.put_size(1) + b"\x00\x09" + bytes([0x04, 1]) + b"d" * 4 + b"e" * 4
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, fixed))
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + M.number(M.TIMESTAMP, 100) + M.element(M.SIMPLE_BLOCK, xiph) + group
    buf = M._HEAD + M.SEGMENT.to_bytes(4, "big") + b"\xff" + M._TRACKS + cluster + cluster
    got = M.packets(buf)[0]
    assert [p.size for p in got] == [256, 3, 7, 4, 4] * 2 and [p.cluster for p in got] == [0] * 5 + [1] * 5
    assert got[0].timestamp_ms == 105 and got[3].timestamp_ms == 109


def test_broken_headers_are_rows_without_packets(spark):
    import struct

    M = matroska
    block = M.element(M.SIMPLE_BLOCK, M.put_size(1) + b"\x00\x00\x80" + b"abcd")
    head = M._HEAD + M.SEGMENT.to_bytes(4, "big") + b"\xff"
    rate = lambda x: M.element(M.TRACKS, M.element(M.ENTRY, M.element(M.AUDIO, M.element(M.RATE, struct.pack(">d", x)))))
    cluster = M.element(M.CLUSTER, M.number(M.TIMESTAMP, 7) + block)
    late = M.element(M.CLUSTER, M.element(M.TIMESTAMP, b"\xff" * 8) + block)
    odd_rate = M.element(M.TRACKS, M.element(M.ENTRY, M.element(M.AUDIO, M.element(M.RATE, b"\x01\x02\x03"))))
    files = [head + rate(8000.0) + cluster, head + rate(0.0) + cluster, head + rate(float("nan")) + cluster, head + M._TRACKS + late, head + odd_rate + cluster, b"", None, head + rate(-1.0) + cluster]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(files)], "doc_id long, media binary")
    got = sorted((r.doc_id, r.ok, r.size) for r in matroska.packet_table(df).collect())
    assert got == [(0, True, 4), *((i, False, None) for i in (1, 2, 3, 4, 5, 7))]
    rng = random.Random(5)
    whole = M.mux(M.pad(b"some text " * 200))
    bad = []
    for i in range(400):
        b = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            b[rng.randrange(min(400, len(b)))] = rng.randrange(256)
        bad.append((i, b))
    assert matroska.packet_table(spark.createDataFrame(bad, "doc_id long, media binary")).count() >= 1
    assert matroska.packet_table(df.limit(0)).count() == 0


# ---- decontamination ----


def test_decontamination(spark, docs, empty):
    df, rows = docs
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "Word"), (901, None), (902, " . "), (903, "a b c d a b c d a b"), (904, "Word")]
    it = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(lower((t or "").encode()).decode())
    windows = {}
    for k, t in items:
        w = split(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(k))
    one, many = (by_id(phrase_index.contamination(df, it, block_bytes=b)) for b in (1 << 22, 3000))
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[k]
        want = (len(w), len(hit), len(found), phrase_index.items_digest(list(found)), bool(hit))
        for got in (one, many):
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == want
    assert phrase_index.contamination(empty, it).count() == 0
    assert phrase_index.contamination(df, it.limit(0)).filter("contaminated").count() == 0


def test_decontamination_keeps_rows_of_one_id_apart(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "x y z w"), (None, "a b"), (None, "q"), (2, "a b x y"), (1, "a b c")], "doc_id long, text string")
    it = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "x y", "z w", "q q"])], "item_id long, text string")
    runs = [sorted(map(str, phrase_index.contamination(df, it, block_bytes=b).collect())) for b in (1 << 22, 1)]
    assert runs[0] == runs[1] and len(runs[0]) == 6
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in phrase_index.contamination(df, it, block_bytes=1).collect())
    assert got == [(0, 1, 0, 0), (0, 2, 2, 1), (1, 3, 2, 1), (1, 3, 2, 1), (1, 4, 4, 2), (2, 4, 4, 2)]


def test_proximity(spark):
    df = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha x x x x x beta"), (3, "alpha"), (4, "beta alpha"), (5, None)], "doc_id long, text string")
    index = phrase_index.store_index(df)
    assert sorted({r.doc_id for r in phrase_index.proximity(index, ["alpha", "beta"], 3).collect()}) == [1, 4]


# ---- near duplicates ----


def test_simhash(docs, empty):
    df, rows = docs
    got = by_id(simhash.near_duplicates(df))
    fps = {}
    for i, t in rows:
        w = SPACE_WORD.findall(lower((t or "").encode()))
        h = [xxhash.xxh64_intdigest(b" ".join(w[j : j + 4]), 42) for j in range(max(1, len(w) - 3))] if w else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {i: i for i in fps}
    for a in fps:
        for b in fps:
            if a > b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(parent, a), find(parent, b)))
                parent[y] = x
    assert all((got[i].fingerprint, got[i].component_id) == (f"{fps[i]:016x}", find(parent, i)) for i in fps)
    assert got[1000].component_id == got[1001].component_id == 1000
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [4096, 16])
def test_near_links_connect_all_near_fingerprints(spark, block):
    rng = random.Random(block)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(4):
        c = rng.getrandbits(64)
        for _ in range(120):
            x = c
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    links = [(r.fa & (1 << 64) - 1, r.fb & (1 << 64) - 1) for r in simhash.near_links(df, 4, block).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    got, want = {x: x for x in fps}, {x: x for x in fps}
    for a, b in links:
        got[find(got, a)] = find(got, b)
    every = sorted(fps)
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= 4:
                want[find(want, a)] = find(want, b)
    assert len({(find(got, x), find(want, x)) for x in fps}) == len({find(got, x) for x in fps}) == len({find(want, x) for x in fps})


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(120)] + [(7, 7), (None, 3)]
    parent = {}
    for a, b in edges:
        if a is not None and a != b:
            parent.setdefault(a, a), parent.setdefault(b, b)
            x, y = sorted((find(parent, a), find(parent, b)))
            parent[y] = x
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(parent, n) for n in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- quotes ----


def test_quote_threads(spark):
    rows = [
        (1, 0, "user", "Hello there\nHow are  you?"), (1, 1, "assistant", "> how are you?\nFine thanks"), (1, 2, "user", "On Monday, Bob wrote:\n> > How are you?\n> Fine thanks\n\nGood."), (1, 3, "user", "New topic"), (1, 4, "assistant", ">Hello there\n>How are you?\nagain"),
        (1, 5, "user", "> nothing known\nok"), (2, 0, "user", None), (2, 1, "user", "> Hello there\nx"), (3, 0, "u", "dup"), (3, 1, "u", "dup"), (3, 2, "u", "> dup\nreply"), (3, 3, "u", "> reply\nr2"), (3, 4, "u", "> r2\nr3"), (None, 1, "u", "> r2"), (4, None, None, "a"), (5, 0, "u", "> self\nself")]
    got = {(r.conv_id, r.turn): r for r in quote_threads.format_messages(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, level int")).collect()}
    assert len(got) == len(rows)
    link = {k: (r.reply_to, r.thread, r.depth) for k, r in got.items() if r.reply_to is not None}
    assert link == {(1, 1): (0, 0, 1), (1, 2): (1, 0, 2), (1, 4): (0, 0, 1), (3, 2): (1, 1, 1), (3, 3): (2, 1, 2), (3, 4): (3, 1, 3)}
    assert got[1, 2].formatted == "<|user|>\nGood.<|end|>" and got[1, 2].n_quoted == 2 and got[2, 0].formatted == "<|user|>\n<|end|>" and got[5, 0].reply_to is None


def test_conversations_are_written_in_reply_order(spark, tmp_path):
    rows = [(1, 0, "u", "one"), (1, 1, "a", "two"), (1, 2, "u", "> one\nthree")]
    quote_threads.write_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), f"{tmp_path}/c")
    got = [r.turn for r in spark.read.parquet(f"{tmp_path}/c").orderBy("conv_id", "thread", "turn").collect()]
    assert got == [0, 2, 1]


# ---- language ----


def test_language_id(spark, empty):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows += [(5000, None, "en"), (5001, "", "en"), (5002, "123 !? ", "de"), (5003, "漢", "en"), (5004, "die und das ist", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(language_id.language_id(df))
    held = [(got[i].lang_pred, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0 and i < 5000]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert [got[i].lang_pred for i in (5000, 5001, 5002)] == ["und"] * 3 and got[5003].lang_pred != "und" and all(0 <= r.score <= 1 for r in got.values())
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.language_id(none).count() == 0
    assert {r.lang_pred for r in language_id.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def plain_costs(texts, order, cut=1):
    """Bits of a run under one language by the formula; runs counted less than `cut` times are left out."""
    import math

    counts = [{} for _ in range(order + 1)]
    for t in texts:
        raw = b" " * order + re.sub(rb"[\t-\r]", b" ", lower(t.encode()))
        for i in range(order, len(raw)):
            for k in range(order + 1):
                c = counts[k].setdefault(raw[i - k : i], {})
                c[raw[i]] = c.get(raw[i], 0) + 1

    def bits(run):
        cost = 0.0
        for k in range(order, -1, -1):
            c = counts[k].get(run[order - k : order], {})
            kept = {b: n for b, n in c.items() if n >= cut}
            if not kept:
                continue
            size = sum(c.values()) + len(c)
            if run[order] in kept:
                return cost + math.log2(size / kept[run[order]])
            cost += math.log2(size / (size - sum(kept.values())))
        return cost + 8

    return bits


@pytest.mark.parametrize("most, large", [(1 << 22, 4), (40, 4), (40, 1000)])
def test_code_lengths_are_those_of_the_formula(spark, monkeypatch, most, large):
    import numpy as np

    rng = random.Random(3)
    texts = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(6)] for lang, letters in (("x", "abc "), ("y", "aAbé\n"))}
    df = spark.createDataFrame([(t, lang) for lang, ts in texts.items() for t in ts] + [(None, "x"), ("zzz", None)], "text string, lang string")
    monkeypatch.setattr(byte_runs, "KEPT", large)
    langs, levels = language_id.train(df, 3, most)
    assert langs == ["x", "y"] and (len(levels[3].runs.pieces) > 4) == (most == 40)
    runs = [b"abca", b"  ab", b"    ", b"qqqq", b"abcz", "aé".encode() + b"a", b"bb\xc3\xa9", b"aaaa"]
    got = language_id.costs(levels, np.array([int.from_bytes(r, "big") for r in runs]), 2)
    for i, lang in enumerate(langs):
        bits = plain_costs(texts[lang], 3)
        assert np.allclose(got[i], [bits(r) for r in runs], atol=1e-3)


def test_a_tree_is_a_proper_code(spark):
    import numpy as np

    rng = random.Random(4)
    texts = ["".join(rng.choice("aaabbc de") for _ in range(200)) for _ in range(5)]
    _, levels = language_id.train(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string"), 2)
    for ctx in (b"aa", b"ab", b"zz", b" a"):
        every = np.array([int.from_bytes(ctx + bytes([b]), "big") for b in range(256)])
        assert np.exp2(-language_id.costs(levels, every, 1)[0].astype(float)).sum() <= 1 + 1e-6


def test_predictions_are_the_shortest_codes(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abcd " if i % 2 else "cdef ") for _ in range(rng.randint(0, 40))), "xy"[i % 2]) for i in range(60)]
    got = by_id(language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    train = {k: [t for i, t, lang in rows if lang == k and zlib.crc32(str(i).encode()) % 5] for k in "xy"}
    bits = {k: plain_costs(ts, language_id.ORDER) for k, ts in train.items()}
    for i, t, _ in rows:
        raw = b" " * language_id.ORDER + t.encode()
        cost = {k: sum(f(raw[j - language_id.ORDER : j + 1]) for j in range(language_id.ORDER, len(raw))) for k, f in bits.items()}
        if re.search("[a-z]", t):
            assert abs(got[i].bits - min(cost.values())) < 0.05 and (got[i].lang_pred == min("xy", key=cost.get) or abs(cost["x"] - cost["y"]) < 0.05)
            best = 1 / sum(2 ** (min(cost.values()) - c) for c in cost.values())
            assert abs(got[i].score - best) < 0.02
        else:
            assert got[i].lang_pred == "und" and got[i].score == 0


# ---- substrings ----


def plain_substrings(rows):
    words = {}
    for i, t in rows:
        words[i] = (t or "").encode().split()
    first = {}
    for i in sorted(words):
        for s in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][s : s + 50]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


@pytest.mark.parametrize("shard, hot", [(400_000, 4000), (600, 4000), (400_000, 6), (400_000, 1), (400_000, 40)])
def test_substring_dedup(spark, docs, empty, monkeypatch, shard, hot):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(shard)
    rows = list(docs[1])
    vocab = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(45, 130))] for _ in range(12)]
    for k in range(60):
        w = []
        for _ in range(rng.randint(1, 4)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
            if rng.random() < 0.3:
                p = p[rng.randrange(10) :]
            w += p + [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        rows.append((3000 + k, " ".join(w)))
    # one document has a passage twice, and a smaller one holds it in other surroundings
    seed, lead = [f"s{i}" for i in range(60)], [f"l{i}" for i in range(30)]
    rows += [(4000, " ".join(lead + seed)), (4001, " ".join(["x"] + seed + ["y", "x"] + seed + ["y"])), (4002, " ".join(["x"] + seed + ["y", "x"] + seed + ["y", "x"] + seed + ["y"]))]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, pos int")
    want = plain_substrings(rows)
    for r in substring_dedup.substring_dedup(df, with_text=True).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) == want[r.doc_id]
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_fm_ranks_and_search():
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.integers(0, 37, 1000)
    m = fm_index.WaveletMatrix(v, 37)
    s, i = rng.integers(0, 37, 500), rng.integers(0, 1001, 500)
    assert m.rank(s, i).tolist() == [int((v[:b] == a).sum()) for a, b in zip(s, i)]
    texts = [rng.integers(1, 5, n) for n in (30, 1, 80, 45)]
    lengths = np.array([len(t) for t in texts])
    f = fm_index.FMIndex(np.concatenate(texts), lengths, np.array([3, 1, 0, 2]), 100)
    for _ in range(200):
        pattern = rng.integers(1, 5, rng.integers(1, 5))
        low, high = np.array([0]), np.array([f.n])
        for c in pattern[::-1]:
            low, high = f.prepend(np.array([c]), low, high)
        hits = [o for t, o in zip(texts, (3, 1, 0, 2)) for k in range(len(t) - len(pattern) + 1) if (t[k : k + len(pattern)] == pattern).all()]
        assert int(high[0] - low[0]) == len(hits)
        if hits:
            assert int(f.least_owner(low, high)[0]) == min(hits)


def test_bitmap_loses_nothing(spark):
    import numpy as np

    values = [(i * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63) for i in range(1, 2000)]
    bits = _bitmap.build(spark.createDataFrame([(v,) for v in values], "h long"))
    assert _bitmap.holds(bits, np.array(values)).all() and _bitmap.holds(bits, np.arange(1 << 40, (1 << 40) + 5000)).sum() < 50


def test_null_ids_and_empty_conversations(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, None), (1, None), (2, "one two three four five six seven")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (toxicity.toxicity(df, labels), phrase_index.contamination(df, items), phrase_index.contamination(df, items, block_bytes=1), simhash.near_duplicates(df), line_dedup.line_report(df), substring_dedup.substring_dedup(df), matroska.media_digests(df)):
        assert out.count() == 4
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quote_threads.format_messages(none).count() == 0
    odd = spark.createDataFrame([(None, None, None, None), (1, None, None, "> q"), (None, 2, "u", "x")], none.schema)
    assert quote_threads.format_messages(odd).count() == 3


def test_long_pre_tokens_merge_like_the_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, table = Tokenizer.from_file(path), token_counts.MergeTable.load(path)
    rng = random.Random(8)
    texts = ["a" * 2049, "ab" * 1500, "ha" * 700 + "h"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(513, 6000))) for letters in ("ab", "theinga", "abcdefghijklmnopqrstuvwxyz", "éèaßñ", "漢字語") for _ in range(4)]
    texts += ["".join(rng.choice(["the", "ing", "station", "q", "zz"]) for _ in range(2000))]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.count_texts(table, texts, {}) == want


def test_models_of_other_kinds_are_refused():
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        raw = f.read()
    sentence_pieces.check_model(raw)
    for trainer, normaliser in ((b"\x18\x01", b""), (b"", b"\x12\x02ab"), (b"\x98\x02\x00", b""), (b"", b"\x20\x01")):
        # the last value of a field counts, so that appended fields change the model's kind
        spec = sentence_pieces._fields(raw)
        wrap = lambda tag, body: bytes([tag]) + message_size(len(body)) + body
        changed = wrap(0x12, spec[2] + trainer) + wrap(0x1A, spec[3] + normaliser)
        with pytest.raises(ValueError):
            sentence_pieces.check_model(changed)


def message_size(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])
