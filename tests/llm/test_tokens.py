import io
import random
import zlib

import numpy as np
import pytest

from fieldglass.llm import packing, token_files
from fieldglass.llm.tokens import _encode, encode_all, splits_at_spaces, tokenizer
from fieldglass.llm.wavelet import BLOCK, WaveletFile, build


def rows_of(docs):
    rows = docs.selectExpr("doc_id", "text", "xxhash64(text) AS hash").collect()
    return [(r.doc_id, r.text) for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.hash))]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000, BLOCK + 5, 2 * BLOCK])
def test_wavelet_round_trip_rank_select(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(max=49000).astype(np.uint32)
    wave = WaveletFile(io.BytesIO(build(ids, [5, None], [n, 0])))
    assert (wave.decode() == ids).all() and wave.doc_ids == [5, None]
    rng = random.Random(n)
    for i in [rng.randrange(n) for _ in range(20)] if n else []:
        token = int(ids[i])
        assert wave.access(i) == token
        assert wave.rank(token, i) == int((ids[:i] == token).sum())
        assert wave.count(token) == int((ids == token).sum())
        places = np.flatnonzero(ids == token)
        k = rng.randrange(len(places))
        assert wave.select(token, k) == places[k]
    assert wave.count(65000) == 0 and wave.count(-1) == 0 and wave.count(1 << 20) == 0


def test_words_give_the_tokenizers_own_ids():
    """Word by word as the library does on whole texts, on every kind of oddity."""
    rng = random.Random(8)
    parts = ["The", "it's", "IT'S.", "don't,", "3.5", "a.b", "x...", "?!", "é", "École.", "J\u030c", "e\u0301.", "\u0301x", "<|endoftext|>", "<|ENDOFTEXT|>", "a\u00a0b", "\x1c", "\u2028", "ΑΣ", "ΑΣ.", "日本語。", "№5,", "🙂!", "$$$", "w%%%", "'s", "l'été;", "\u200b", "ŉ", "İ.", "ﬁ", "x.'s", "'.s", "!'t", "a.b'll;c", "Ünë.", "(ß)", "a_b-c", "<|x|>", "a.Σ", "²"]
    texts = ["", " ", "\n\t", *(rng.choice(["", " "]).join(rng.choice([" ", "\n", "  ", "\x0b", ""]) + rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(600))]
    model = tokenizer(None)
    assert splits_at_spaces(model)
    for text, got, want in zip(texts, encode_all(texts, None, 2), _encode(model, texts, 2)):
        assert got.tolist() == want.tolist(), text


def test_wavelet_rejects_other_files_and_places():
    with pytest.raises(ValueError):
        WaveletFile(io.BytesIO(b"x" * 100))
    wave = WaveletFile(io.BytesIO(build(np.array([3, 4], np.uint32), [1], [2])))
    with pytest.raises(IndexError):
        wave.access(2)
    with pytest.raises(IndexError):
        wave.select(3, 1)
    assert wave.locate(4) == [1]


def test_token_files_round_trip(spark, odd_docs):
    shards = token_files.write(odd_docs, shard_tokens=500)
    assert shards.count() > 2
    want, start = [], 0
    for (d, _), ids in zip(rows_of(odd_docs), encode_all([t for _, t in rows_of(odd_docs)], None, 2)):
        want.append((d, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        start += len(ids)
    got = sorted(((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in token_files.read(shards).collect()), key=lambda x: x[1])
    assert got == want
    everything = np.concatenate(list(encode_all([t for _, t in rows_of(odd_docs)], None, 2)))
    token = int(everything[3])
    assert sorted(r.position for r in token_files.locate_token(shards, token).collect()) == np.flatnonzero(everything == token).tolist()
    assert sum(r.n for r in token_files.count_token(shards, token).collect()) == int((everything == token).sum())
    assert token_files.token_at(spark, shards, 700) == int(everything[700])
    with pytest.raises(IndexError):
        token_files.token_at(spark, shards, len(everything))


def test_token_files_empty(no_docs):
    shards = token_files.write(no_docs)
    assert shards.count() == 0 and token_files.read(shards).count() == 0


@pytest.mark.parametrize("length", [7, 4096])
def test_pack_every_id_once_without_gaps(odd_docs, length):
    pieces = packing.pack(odd_docs, length).toPandas().sort_values(["sequence_id", "offset"])
    ends = pieces.groupby("sequence_id").length.sum()
    assert (ends.iloc[:-1] == length).all() and ends.iloc[-1] <= length
    assert (pieces.offset == pieces.groupby("sequence_id").length.cumsum() - pieces.length).all()
    assert all(len(i) == 4 * n for i, n in zip(pieces.ids, pieces.length)) and (pieces.length > 0).all()
    stream = b"".join(pieces.ids)
    docs = [x.astype("<u4").tobytes() for x in encode_all([t for _, t in rows_of(odd_docs)], None, 2)]
    assert len(stream) == sum(map(len, docs))
    found, at = [], 0
    for n in pieces.loc[pieces.start == 0, "doc_tokens"]:
        found.append(stream[at : at + 4 * n])
        at += 4 * n
    assert sorted(found) == sorted(docs)


def test_pack_empty(no_docs):
    assert packing.pack(no_docs).count() == 0
