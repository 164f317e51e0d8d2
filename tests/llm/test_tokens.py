import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import chunked_bpe, piece_table, token_frames, word_bpe

from .fixtures import AWKWARD, documents, empty

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|endoftext|>a b<|startoftext|>", "á ́b", "Σας ΌΣΟΣ.", "x!!, y...z it's can't I'LL", " a  b c\x1cd\x85e", "J̌ T̈x J̌B", "<|ENDOFTEXT|> <|endoftext|>X", "THE Quick. BROWN!!", "x" * 5000, "é" * 70_000 + " a"]


def mixed(n, size=400):
    r = random.Random(9)
    return ["".join(r.choice("abcdefgh   '.,!?;: ̧́ééß　\n中9²Ⅷ<|>AJ") for _ in range(size)) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_words_and_chunks_equal_the_library(spark, library):
    df = documents(spark, [*AWKWARD, *ODD, *mixed(60)])
    texts = {r.doc_id: r.text for r in df.collect()}
    got = chunked_bpe.digest(df, PATH).collect()
    assert len(got) == df.count()
    for r in got:
        ids = ids_of(library, texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert chunked_bpe.digest(empty(spark), PATH).collect() == []


def test_general_interface(spark, library):
    df = documents(spark, [*AWKWARD[:6], *ODD]).withColumnRenamed("source", "ids")
    got = chunked_bpe.decode(chunked_bpe.encode(df, PATH), PATH).collect()
    assert len(got) == df.count() and "source" not in got[0]
    for r in got:
        assert r.ids == ids_of(library, r.text) and r.decoded == library.decode(r.ids, skip_special_tokens=False)


def laid_out(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def test_chunks_are_shared_and_found_again_after_a_shift():
    shared = " ".join(f"token{i * i % 7919}" for i in range(3000))
    codec = chunked_bpe.ChunkCodec(word_bpe.WordEncoder(PATH))
    codec.encode(*laid_out([shared.encode(), b"a shift " + shared.encode(), shared.encode()]))
    assert codec.hits > 1.5 * codec.misses and codec.regrown == 0
    before = codec.misses
    codec.encode(*laid_out([b"later " + shared.encode()]))
    assert codec.misses <= before + 2


class Joining:
    """An encoder whose ids reach over blanks: runs of words that begin with `j` are one id (their number + 1000)."""

    width = np.dtype("<u2")

    def encode(self, data, offsets):
        ids, at, starts, ends, word_at = [], [0], [], [], []
        for a, b in zip(offsets[:-1], offsets[1:]):
            row, run = bytes(data[a:b]), 0
            for m in re.finditer(rb"[^ ]+", row):
                starts.append(a + m.start())
                ends.append(a + m.end())
                if m[0][:1] == b"j":
                    if run:
                        ids[-1] += 1
                    else:
                        ids.append(1001)
                    word_at.append(len(ids) - 1)
                    run = 1
                else:
                    word_at.append(len(ids))
                    ids.append(sum(m[0]) % 997)
                    run = 0
            at.append(len(ids))
        word_at.append(len(ids))
        return word_bpe.Encoded(np.array(ids, self.width), np.array(at), np.array(starts, np.int64), np.array(ends, np.int64), np.array(word_at))


def test_windows_grow_until_both_sides_agree(monkeypatch):
    monkeypatch.setattr(chunked_bpe, "MEAN_BYTES", 64)
    r = random.Random(3)
    texts = [" ".join(("j" if r.random() < share else "w") + str(r.randrange(50)) for _ in range(900)).encode() for share in (0.1, 0.5, 0.9, 1.0)]
    codec = chunked_bpe.ChunkCodec(Joining())
    data, offsets = laid_out(texts)
    whole = Joining().encode(data, offsets)
    got = codec.encode(data, offsets)
    assert codec.regrown and codec.misses > 20
    for i, ids in enumerate(got):
        assert np.frombuffer(ids, "<u2").tolist() == whole.ids[whole.at[i] : whole.at[i + 1]].tolist()


def test_pieces_of_one_hash_are_told_apart(monkeypatch, library):
    monkeypatch.setattr(piece_table, "hashes", lambda data, start, end: (end - start).astype(np.uint64) % np.uint64(3))
    words = word_bpe.WordEncoder(PATH)
    for t in [*ODD, *mixed(5)]:
        assert words.texts_of([t.encode()])[0] == ids_of(library, t)


def test_long_texts_are_rendered_in_spans(monkeypatch, library):
    monkeypatch.setattr(chunked_bpe, "RENDERED", 7)
    monkeypatch.setattr(word_bpe, "SPAN_BYTES", 50)
    texts = ["", *mixed(10), "a", ""]
    ids = [ids_of(library, t) for t in texts]
    words = word_bpe.WordEncoder(PATH)
    assert words.texts_of([t.encode() for t in texts]) == ids
    flat, at = np.array([i for x in ids for i in x], "<u2"), np.cumsum([0, *map(len, ids)])
    out = chunked_bpe.Renderer(words.texts)
    assert out.decimals(flat, at) == [hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in ids]
    assert out.decoded(flat, at) == [hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest() for x in ids]


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        word_bpe.checked(public_tokenizers.path("byte_bpe_50k.json"))


def test_a_full_cache_starts_anew(library):
    words = word_bpe.WordEncoder(PATH, pieces=50)
    for t in mixed(20) + ODD:
        assert words.texts_of([t.encode()])[0] == ids_of(library, t)
    assert words.known.n < 500


def test_shards(spark, library, tmp_path):
    df = documents(spark, [*AWKWARD, *ODD[:6]]).repartition(3)
    manifest = token_frames.write_shards(df, PATH, f"file://{tmp_path}/s", shards=4)
    got = token_frames.read_shards(manifest).collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text) for r in df.collect()), key=lambda r: r[:2])
    start, want = 0, []
    for has, i, t in rows:
        ids = [*ids_of(library, t), token_frames.END_ID]
        want.append((i if has else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    shard = manifest.orderBy("shard").collect()[-1]
    wanted = max(i for _, i, _ in rows)
    found = token_frames.read_documents(shard["path"], [wanted])
    assert found[wanted][0].tolist()[:-1] == ids_of(library, rows[-1][2])
    assert token_frames.digest(empty(spark), PATH).collect() == []
    texts = spark.createDataFrame([("7", "a"), ("x", "b"), ("11", "a b")], "doc_id string, text string")
    assert [(r.doc_id, r.start, r.n_tokens) for r in token_frames.digest(texts, PATH).orderBy("start").collect()] == [(None, 0, 2), (7, 2, 2), (11, 4, 3)]


def test_only_wanted_frames_are_read_and_damage_is_found(tmp_path):
    path = tmp_path / "x.zst"
    with open(path, "wb") as f:
        w = token_frames.FrameWriter(f, 2)
        for i in range(20):
            w.add(i, np.full(50_000, i, "<u2").tobytes())
        w.close()
    raw = path.read_bytes()

    class Counting:
        def __init__(self, data):
            self.data, self.at, self.read_bytes = data, 0, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            self.read_bytes += n
            return self.data[self.at : self.at + n]

    file = Counting(raw)
    reader = token_frames.FrameReader(file, len(raw))
    before = file.read_bytes
    (one,) = reader.documents(np.array([7]))
    assert one[0] == 7 and (one[1] == 7).all() and file.read_bytes - before == reader.table[reader.index["frame"][7], 0]
    at = int(reader.at[reader.index["frame"][7]]) + 12
    broken = raw[:at] + bytes([raw[at] ^ 0xFF]) + raw[at + 1 :]
    with pytest.raises(Exception):  # noqa: B017
        list(token_frames.FrameReader(Counting(broken), len(raw)).documents(np.array([7])))


def test_long_texts_without_blanks(library):
    """A text without words to join by is one window: its cost has to stay in proportion to its length."""
    codec = chunked_bpe.ChunkCodec(word_bpe.WordEncoder(PATH))
    r = random.Random(3)
    block = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(1 << 20)).encode()
    times = []
    for n in (2, 8):
        data = b"".join(block[k * 977 :] + block[: k * 977] for k in range(n))
        began = time.process_time()
        at = chunked_bpe.cuts(np.frombuffer(data, np.uint8), np.array([0, len(data)])).tolist()
        codec._parted(0, len(at) - 1, [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], [None] * (len(at) - 1))
        times.append(time.process_time() - began)
    assert times[1] < 12 * times[0] + 0.5
    text = block[: 1 << 18].decode()
    (got,) = codec.encode(*laid_out([text.encode()]))
    assert np.frombuffer(got, codec.words.width).tolist() == ids_of(library, text)


def test_windows_that_regrow_many_times(library, monkeypatch):
    """Joins that never agree grow to the whole text in a few rounds."""
    codec = chunked_bpe.ChunkCodec(word_bpe.WordEncoder(PATH))
    text = " ".join(f"word{i * i % 7919}" for i in range(40_000))
    rounds, joined = [], chunked_bpe.ChunkCodec._joined

    def disagree(self, windows):
        rounds.append(len(windows))
        found = joined(self, windows)
        return found if len(windows) == 1 else {w: b"" for w in found}

    monkeypatch.setattr(chunked_bpe.ChunkCodec, "_joined", disagree)
    (got,) = codec.encode(*laid_out([text.encode()]))
    assert np.frombuffer(got, codec.words.width).tolist() == ids_of(library, text) and len(rounds) <= 12


def test_the_largest_ids_have_a_shard(spark):
    ids = [2**63 - 1 - i for i in range(40)] + [-(2**63) + i for i in range(40)] + [0, None]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(4)
    got = token_frames.digest(df, PATH).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(i for i in ids if i is not None) and len(got) == len(ids)
    starts = [r.start for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0))]
    assert starts == sorted(starts)
