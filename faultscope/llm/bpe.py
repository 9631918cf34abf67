"""BPE encoding and decoding by backtracking over longest token matches.

A sequence of tokens is the result of the merges exactly when every two neighbours are
*compatible*: encoding their joined text would keep them apart. So a word is encoded from
left to right: an Aho-Corasick automaton gives the longest token at every position, a
token incompatible with the one before it gives way to its next shorter prefix, and where
none is left the last token is taken back and its end is never tried again. Each position
is given up at most once, which makes the time linear in the word. Compatibility is
decided from the two tokens' merge histories and kept in a table as pairs come up.

Decoding is a gather through an offset table: token i owns ``blob[offsets[i]:offsets[i+1]]``.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultscope.llm.common import slices, texts_of

#: Stands for the end-of-word suffix inside words; no byte is written like it.
END = "\x00"
#: Distinct pieces of text whose ids a worker keeps; beyond it the table starts anew.
CACHE = 300_000
#: Text bytes that one decoding step takes.
STEP = 1 << 20

#: White space of the tokenizer files' patterns (fixed values: Unicode White_Space).
SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: The first character whose class is left to the tokenizer library.
BEYOND_LATIN = chr(0x250)
_ODD = re.compile("[\x1c-\x1f]")
_SPACES = re.compile(f"[{SPACE}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    stands for itself, the others in turn for the letters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """Vocabulary and merges of a tokenizer file with word ends, and what follows from them."""

    def __init__(self, spec: dict):
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = {self._marked(t, suffix): i for t, i in model["vocab"].items()}
        self.texts = {i: t for t, i in self.vocab.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            pair = self.vocab[self._marked(a, suffix)], self.vocab[self._marked(b, suffix)]
            whole = self.vocab[self.texts[pair[0]] + self.texts[pair[1]]]
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = pair, rank
            self.merged.setdefault(pair, rank)
        self.names = {**{i: t for t, i in model["vocab"].items()}, **{t["id"]: t["content"] for t in spec["added_tokens"]}}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: Pairs met so far, as ``left << 16 | right``; a vocabulary has fewer than 65,536 tokens.
        self.table: dict[int, bool] = {}
        if max(self.names) >= 1 << 16:
            raise ValueError("ids of 65,536 and more don't fit the table of pairs")

    @staticmethod
    def _marked(token: str, suffix: str) -> str:
        return token[:-len(suffix)] + END if token.endswith(suffix) else token

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at one end of a token while it is merged, and the rank that ends it."""
        steps, until = [(token, float("inf"))], token
        while until in self.parts:
            rank, until = self.rank[until], self.parts[until][side]
            steps.append((until, rank))
        return steps[::-1]

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge joins the two while each is being built.

        Both ends are replayed in the order of ranks. At equal rank the merge further
        left comes first: the left token's own step before the joint, the joint before
        the right token's own step. The answer goes into the table of pairs.
        """
        a, b = self._spine(left, 1), self._spine(right, 0)
        i = j = 0
        answer = True
        while True:
            joint = self.merged.get((a[i][0], b[j][0]))
            ends_a, ends_b = a[i][1], b[j][1]
            if joint is not None and joint < ends_a and joint <= ends_b:
                answer = False
                break
            if i + 1 == len(a) and j + 1 == len(b):
                break
            if ends_a <= ends_b:
                i += 1
            else:
                j += 1
        if len(self.table) >= 4 * CACHE:
            self.table.clear()
        self.table[left << 16 | right] = answer
        return answer


class WordBpe(Merges):
    """Encoder and decoder of a tokenizer file whose pattern drops white space."""

    def __init__(self, spec: dict):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        super().__init__(spec)
        self.automaton = ahocorasick.Automaton()
        for text, token in self.vocab.items():
            self.automaton.add_word(text, (token, len(text)))
        self.automaton.make_automaton()
        self.length = [len(self.texts.get(i, "")) for i in range(max(self.names) + 1)]
        shorter = {i: next((self.vocab[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.vocab), -1) for i, t in self.texts.items()}
        self.shorter = [shorter.get(i, -1) for i in range(len(self.length))]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", SPACE)).findall
        self.letters = byte_letters()
        self.byte_of = {letter: b for b, letter in enumerate(self.letters)}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.word_ids = Remembered(self._word)
        self.pieces = Remembered(self.encode_piece)
        self.rare = Tokenizer.from_str(json.dumps({**spec, "added_tokens": []}))
        names = [self.names.get(i, "") for i in range(max(self.names) + 1)]
        self.names_table = offset_table([n.encode() + b" " for n in names])
        self.digits_table = offset_table([b"%d " % i for i in range(len(names))])

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of byte letters, its end marked."""
        longest = [-1] * len(word)
        for stop, (token, length) in self.automaton.iter(word):
            longest[stop - length + 1] = token
        length, shorter, table = self.length, self.shorter, self.table
        closed = bytearray(len(word) + 1)
        taken: list[int] = []
        at, end, before, token = 0, len(word), -1, longest[0]
        while at < end:
            while token >= 0:
                if not closed[at + length[token]]:
                    if before < 0:
                        break
                    fits = table.get(before << 16 | token)
                    if fits or fits is None and self.compatible(before, token):
                        break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                at += length[token]
                before, token = token, longest[at] if at < end else -1
            else:
                closed[at] = 1
                token = taken.pop()
                at -= length[token]
                before = taken[-1] if taken else -1
        return taken

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])
        return struct.pack(f"<{len(ids)}I", *ids) if (ids := self.encode_word(letters + END)) else b""

    def words_of(self, text: str) -> list[str]:
        """Words of text without white space, normalised: composed, lower-cased letter by
        letter, cut by the file's pattern. Beyond Latin letters the tokenizer library
        normalises and cuts, so that its Unicode version holds.
        """
        if text.isascii():
            text = text.lower()
            if text.isalpha():
                return [text]
            return [text[:-1], text[-1]] if text[:-1].isalpha() and text[-1] in ".," else self.words(text)
        if max(text) < BEYOND_LATIN:
            return self.words(unicodedata.normalize("NFC", text).lower())
        cut = self.rare.pre_tokenizer.pre_tokenize_str(self.rare.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, letters)).decode(errors="surrogateescape") for letters, _ in cut]

    def encode_piece(self, piece: str) -> bytes:
        """Ids, little-endian, of text without white space; special strings are tokens."""
        word = self.word_ids.__getitem__
        if "<|" in piece:
            return b"".join([struct.pack("<I", self.special[p]) if p in self.special else b"".join(map(word, self.words_of(p))) for p in self.cut.split(piece) if p])
        return b"".join(map(word, self.words_of(piece)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers."""
        pieces = _SPACES.split(text) if _ODD.search(text) else text.split()
        return b"".join(map(self.pieces.__getitem__, pieces))

    def decode(self, ids: np.ndarray) -> str:
        """Token names joined by one blank: the file names no decoder."""
        return render(ids, self.names_table).tobytes()[:-1].decode()


class Remembered(dict):
    """Results of a function of text. Those not asked for again fade out: a full table
    becomes the old one, from which results still in use move into the new one."""

    def __init__(self, fn: Callable[[str], bytes], limit: int = CACHE):
        super().__init__()
        self.fn, self.limit, self.old = fn, limit, {}

    def __missing__(self, text: str) -> bytes:
        found = self.old.get(text)
        if found is None:
            found = self.fn(text)
        if len(text) < 100:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[text] = found
        return found


def offset_table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All parts in one array, and where each begins (with one more entry for the end)."""
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


def render(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The bytes of the tokens ``ids``, one after the other."""
    blob, offsets = table
    start, size = offsets[ids], offsets[ids + 1] - offsets[ids]
    stops = np.cumsum(size)
    total = int(stops[-1]) if len(stops) else 0
    return blob[np.repeat(start - (stops - size), size) + np.arange(total)]


@functools.lru_cache(maxsize=2)
def loaded(spec: str) -> WordBpe:
    return WordBpe(json.loads(spec))


def _spec(docs: DataFrame, path: str):
    """The tokenizer file, some megabytes, read by the driver and sent to the workers."""
    with open(path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids`` (array of int) of every row.

    A null or empty text has no ids. Every row is encoded whole, however long; rows that
    repeat are encoded one by one. Other columns are not read.
    """
    spec = _spec(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [bpe.encode(t) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), "<i4")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    rows = texts_of(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and ``text``, the decoded token names; null or no ids give the empty text."""
    spec = _spec(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            texts = [bpe.decode(np.asarray(ids or [], np.int64)) for ids in (x.as_py() for x in batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def _sha256_parts(data: np.ndarray, ends: np.ndarray) -> list[str]:
    """Hash of each part of ``data`` without the blank that ends it."""
    view, out, start = memoryview(data), [], 0
    for end in ends.tolist():
        out.append(hashlib.sha256(view[start:max(start, end - 1)]).hexdigest())
        start = end
    return out


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, its ids decoded.

    ``with_ids`` adds the ids (array of int). Hashes are of the decimal ids joined by one blank and of the decoded text. As
    ``encode_documents``; an empty text has the hash of nothing in both columns.
    """
    spec = _spec(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            for part in slices(batch, "text", STEP):
                ids = [bpe.encode(t) for t in part.column("text").to_pylist()]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
                hashes = []
                for table in (bpe.digits_table, bpe.names_table):
                    sizes = np.concatenate(([0], np.cumsum(table[1][flat + 1] - table[1][flat])))
                    hashes.append(_sha256_parts(render(flat, table), sizes[np.cumsum(n)]))
                columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(n), "ids_sha256": pa.array(hashes[0], pa.string()), "decoded_sha256": pa.array(hashes[1], pa.string())}
                if with_ids:
                    ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    rows = texts_of(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
