"""BPE, token counts and token files against the tokenizer library."""

import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pytest

from faultscope.llm import bpe, token_file, transducer
from faultscope.llm.queries import tokenizer_file
from tests.llm.conftest import EDGE_TEXTS

tokenizers = pytest.importorskip("tokenizers")
WORDS, BYTES = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")


def odd_texts():
    rnd = random.Random(5)
    texts = [t or "" for t in EDGE_TEXTS]
    texts += ["don't we're 're'ra !'s ''s 'S I'M x'r 'll 'l 'v 'd'd '", "<|endoftext|>hi <|startoftext|><|endoftext|> <|END|> <|endoftext", "a b　c\x85d\x1ce", "ab" * 1000 + "the" * 500, "İ ẞ ǅ é"]
    texts += ["".join(rnd.choice("ab'sre tldmvΣé́ \n!?.12ß<|>") for _ in range(50)) for _ in range(300)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(1, 0x250), rnd.randrange(1, 0x3000), rnd.randrange(1, 0xD7FF), rnd.randrange(0xE000, 0x1FFFF)])) for _ in range(40)) for _ in range(300)]
    return texts


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def words():
    return bpe.loaded(open(WORDS, encoding="utf-8").read())


def test_ids_and_decoding_are_the_library_s(library, words):
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(words.encode(text), "<u4").astype(int)
        assert got.tolist() == want, text
        assert words.decode(got) == library.decode(want, skip_special_tokens=False), text


def test_backtracking_equals_plain_merging(words):
    def plain(word):
        parts = [words.vocab[c] for c in word[:-1]]
        parts[-1:] = [words.vocab[word[-2:]]]
        while True:
            ranks = [(words.merged.get(p, 1 << 30), k) for k, p in enumerate(zip(parts, parts[1:]))]
            if not ranks or min(ranks)[0] == 1 << 30:
                return parts
            k = min(ranks)[1]
            parts[k:k + 2] = [words.vocab[words.texts[parts[k]] + words.texts[parts[k + 1]]]]

    rnd = random.Random(3)
    for _ in range(500):
        word = "".join(rnd.choice("abeinorst") for _ in range(rnd.randint(1, 30))) + bpe.END
        assert words.encode_word(word) == plain(word)


def test_counts_are_lengths_of_encodings(library):
    texts = odd_texts()
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    counter = transducer.Counter(bpe.loaded(open(WORDS, encoding="utf-8").read()))
    assert counter.count(texts).tolist() == want
    assert [int(counter.count([t])[0]) for t in texts[:40]] == want[:40]


def test_chunks_compose_whatever_their_length(words, monkeypatch):
    counter = transducer.Counter(words)
    texts = ["x" * 3000, "interesting words " * 30, "", "supercalifragilistic" * 40]
    want = counter.count(texts).tolist()
    monkeypatch.setattr(transducer, "SHORTEST", 7)
    monkeypatch.setattr(transducer, "LANES", 100_000)
    assert counter.count(texts).tolist() == want
    monkeypatch.setattr(transducer, "STATES", 10)
    assert counter.count(texts).tolist() == want


def test_edge_rows(spark, edge_docs, no_docs, library):
    rows = edge_docs.select("doc_id", "text").collect()
    got = bpe.round_trip(edge_docs, WORDS, with_ids=True).collect()
    want = []
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    counts = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in transducer.count_tokens(edge_docs, WORDS).collect()}
    assert counts == {(r.doc_id, len((r.text or "").encode()), w[1], w[1] > 2048) for r, w in zip(rows, want)}
    assert bpe.round_trip(no_docs, WORDS).count() == transducer.count_tokens(no_docs, WORDS).count() == 0
    encoded = bpe.encode_documents(edge_docs, WORDS)
    assert sorted(r.text for r in bpe.decode_documents(encoded, WORDS).collect()) == sorted(library.decode(w[4], skip_special_tokens=False) for w in want)


def test_token_files_round_trip(spark, edge_docs, no_docs, tmp_path):
    library = tokenizers.Tokenizer.from_file(BYTES)
    rows = sorted(edge_docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    spec = open(BYTES, encoding="utf-8").read()
    manifest = token_file.write_token_files(edge_docs, spec, str(tmp_path / "shards"), shard_bytes=20_000)
    assert manifest.count() > 1
    got = token_file.read_token_files(manifest).collect()
    want, start = [], 0
    by_id = {}
    for r in rows:
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
        by_id.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        by_id[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(by_id.values())
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [r.doc_id for r in rows]
    assert token_file.token_files(no_docs, BYTES).count() == 0


class _File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_a_reader_takes_only_the_frames_it_needs_and_checks_them():
    import zstandard

    out = io.BytesIO()
    writer = token_file.SeekableWriter(out, frame=400)
    docs = {k: np.arange(k, 3 * k, dtype="<u4") for k in range(40)}
    for k, ids in docs.items():
        writer.add(k, ids.tobytes())
    writer.close()
    data = out.getvalue()
    reader = token_file.SeekableReader(_File(data))
    assert len(reader.table) > 10
    assert all((reader.read(k) == ids).all() for k, ids in docs.items())
    assert [(k, v.tolist()) for k, v in reader] == [(k, v.tolist()) for k, v in docs.items()]
    # Frames are independent, the rest is skippable: any zstandard reader gives all the ids.
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(v.tobytes() for v in docs.values())
    assert struct.unpack("<I", data[-4:])[0] == 0x8F92EAB1
    broken = bytearray(data)
    last = int(reader.starts[-2]) - 3
    broken[last] ^= 255
    other = token_file.SeekableReader(_File(bytes(broken)))
    assert (other.read(5) == docs[5]).all()
    with pytest.raises(Exception):
        other.read(39)
