"""Token counts by a finite-state transducer compiled from a tokenizer's merges.

*The transducer* reads the byte letters of words, each word closed by an end mark. Its
state after some letters holds, for every suffix that may still grow into a token, the
last token of the encoding that ends where the suffix begins and how many tokens fewer
that encoding has. One letter more completes exactly one token compatible with the token
before it, which decides the new last token and the number that the transition emits:
the change of the token count (it may be negative). The end mark leads back to the start.
States and transitions are compiled when first met, into one dense table.

*Chunks.* The letters of a batch are cut into equal chunks that run in lock-step, a numpy
gather per letter for all of them. What a chunk does to the state is a map: constant from
its first end mark on, open before it. Maps compose from left to right in a scan: the
last constant to the left gives each chunk the state it starts in; heads, the letters up
to the first end mark, then run from that state, again all at once. A chunk without any
end mark (a word longer than a chunk) hands the state on in another round.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.bpe import BEYOND_LATIN, END, SPACE, Merges, WordBpe, _spec, loaded
from faultscope.llm.common import slices, texts_of

LIMIT = 2048
#: Chunks that run in lock-step, and the shortest chunk.
LANES, SHORTEST = 2048, 64
#: Compiled states beyond which a worker starts its table anew, between batches.
STATES = 250_000
#: Text bytes of one batch of chunks.
STEP = 2 << 20
END_MARK = 256
_LOW, _BIAS = 6, 32
_RARE = re.compile(f"[^{SPACE}]*[{BEYOND_LATIN}-{chr(0x10FFFF)}][^{SPACE}]*")
_SPACE_CLASS, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


def _character_classes(n: int = 0x3001) -> np.ndarray:
    kinds = np.full(n, _OTHER, np.uint8)
    for c in range(n):
        kind = unicodedata.category(chr(c))[0]
        kinds[c] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    kinds[np.array([ord(c) for c in SPACE if ord(c) < n])] = _SPACE_CLASS
    return kinds


class Transducer:
    """States, transitions and emitted counts, compiled on demand."""

    def __init__(self, merges: Merges, letters: list[str]):
        self.merges = merges
        self.letter = [*letters, END]
        # A trie of the vocabulary: node -> {letter: node}, and the token a node completes.
        self.child: list[dict[str, int]] = [{}]
        self.token = [-1]
        for text, token in merges.vocab.items():
            node = 0
            for c in text:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][c]
            self.token[node] = token
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.number = {start: 0}
        self.states = [start]
        self.column = np.full(257, -1, np.int64)
        self.table = np.full((1024, 64), -1, np.int32)
        self.columns = 0

    def _columns_for(self, symbols: np.ndarray) -> None:
        new = np.unique(symbols)
        new = new[self.column[new] < 0]
        self.column[new] = np.arange(self.columns, self.columns + len(new))
        self.columns += len(new)
        if self.columns > self.table.shape[1]:
            self.table = np.pad(self.table, ((0, 0), (0, max(64, self.columns - self.table.shape[1]))), constant_values=-1)

    def step(self, state: tuple, letter: str) -> tuple[tuple, int]:
        """Next state and emitted count."""
        grown, last, emit = [], -1, 0
        for node, before, fewer in state:
            to = self.child[node].get(letter)
            if to is None:
                continue
            token = self.token[to]
            if token >= 0 and last < 0:
                fits = before < 0 or self.merges.table.get(before << 16 | token)
                if fits or fits is None and self.merges.compatible(before, token):
                    last, emit = token, fewer + 1
            if self.child[to]:
                grown.append((to, before, fewer))
        if letter == END:
            return self.states[0], emit
        return (*((to, before, fewer - emit) for to, before, fewer in grown), (0, last, 0)), emit

    def _compile(self, state: int, symbol: int) -> int:
        to, emit = self.step(self.states[state], self.letter[symbol])
        number = self.number.get(to)
        if number is None:
            number = self.number[to] = len(self.states)
            self.states.append(to)
            if number >= len(self.table):
                self.table = np.pad(self.table, ((0, len(self.table)), (0, 0)), constant_values=-1)
        packed = number << _LOW | emit + _BIAS
        self.table[state, self.column[symbol]] = packed
        return packed

    def _run(self, grid: np.ndarray, state: np.ndarray, emitted: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Run rows of symbols in lock-step from ``state``, row i up to ``stop[i]`` letters.

        Fills ``emitted`` and returns the last states.
        """
        state = state.copy()
        order = np.argsort(-stop, kind="stable")
        lengths = stop[order]
        for k in range(int(lengths[0]) if len(lengths) else 0):
            rows = order[:np.searchsorted(-lengths, -k, side="left")]
            symbols, at = grid[k, rows], state[rows]
            packed = self.table[at, self.column[symbols]]
            missing = np.flatnonzero(packed < 0)
            if len(missing):
                made: dict[tuple[int, int], int] = {}
                for m, key in zip(missing.tolist(), zip(at[missing].tolist(), symbols[missing].tolist())):
                    if key not in made:
                        made[key] = self._compile(*key)
                    packed[m] = made[key]
            state[rows] = packed >> _LOW
            emitted[k, rows] = (packed & (1 << _LOW) - 1) - _BIAS
        return state

    def counts(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens emitted up to and including each symbol; every word ends with the mark."""
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int64)
        if len(self.states) > STATES:
            self.reset()
        self._columns_for(symbols)
        size = max(SHORTEST, -(-n // LANES))
        lanes = -(-n // size)
        grid = np.full(lanes * size, END_MARK, np.int64)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(lanes, size).T)
        self._columns_for(grid[-1:, -1])
        marks = grid == END_MARK
        closed = marks.any(axis=0)
        head = np.where(closed, marks.argmax(axis=0) + 1, size)
        emitted = np.zeros((size, lanes), np.int8)
        # The constant part of every chunk's map: from its first end mark on, the start state is known.
        tail_of = np.flatnonzero(closed)
        exits = np.zeros(lanes, np.int64)
        shifted = np.full((size, lanes), END_MARK, np.int64)
        position = np.arange(size)[:, None] + head[None, :]
        inside = position < size
        shifted[inside] = grid[position[inside], np.broadcast_to(np.arange(lanes), position.shape)[inside]]
        tails = np.zeros((size, lanes), np.int8)
        exits[tail_of] = self._run(shifted, np.zeros(lanes, np.int64), tails, np.where(closed, size - head, 0))[tail_of]
        emitted[position[inside], np.broadcast_to(np.arange(lanes), position.shape)[inside]] = tails[inside]
        # Scan: a chunk whose left neighbour's exit is known runs its head; an open chunk then knows its exit.
        known, waiting = closed.copy(), np.ones(lanes, bool)
        while waiting.any():
            ready = waiting & np.concatenate(([True], known[:-1]))
            entry = np.concatenate(([0], exits[:-1]))
            after = self._run(grid, entry, emitted, np.where(ready, head, 0))
            exits = np.where(ready & ~closed, after, exits)
            known |= ready
            waiting &= ~ready
        return np.cumsum(emitted.T.reshape(-1)[:n], dtype=np.int64)


class Counter:
    """Token counts of batches of texts for one tokenizer file."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.transducer = Transducer(bpe, bpe.letters)
        self.kinds = _character_classes()
        self.special = re.compile("|".join(map(re.escape, sorted(bpe.special, key=len, reverse=True))))

    def _simple(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words of texts in Latin letters, and where each text's symbols end."""
        line = "\n".join(texts).lower() + "\n"
        data = np.frombuffer(line.encode(), np.uint8)
        if line.isascii():
            code, lead = data, np.arange(len(data))
        else:
            code, lead = np.frombuffer(line.encode("utf-32-le"), "<u4"), np.flatnonzero(data & 0xC0 != 0x80)
        kind = self.kinds[code]
        before = np.concatenate(([_SPACE_CLASS], kind[:-1]))
        start = (kind != before) | (kind == _NUMBER)
        # Contractions: an apostrophe that begins a match takes one or two letters along.
        mark = np.flatnonzero((code == 39) & (before != _OTHER))
        if len(mark):
            after = np.concatenate((code, np.zeros(3, code.dtype)))
            one, two = after[mark + 1], after[mark + 2]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            start[mark[short | long] + 1] = False
            start[mark[long] + 2] = False
            start[mark[short] + 2] = True
            start[np.minimum(mark[long] + 3, len(start) - 1)] = True
        word = kind != _SPACE_CLASS
        closes = word & np.concatenate((start[1:] | ~word[1:], [True]))
        # Every byte of a word is a symbol, the last byte of its last character has the mark after it.
        bytes_in = np.diff(np.append(lead, len(data)))
        wide = np.repeat(word, bytes_in)
        last = np.zeros(len(data), bool)
        last[(lead + bytes_in - 1)[closes]] = True
        place = np.cumsum(wide + last.astype(np.int64))
        symbols = np.full(int(place[-1]), END_MARK, np.int64)
        symbols[(place - last - 1)[wide]] = data[wide]
        # Lower-casing keeps line feeds, but a text may have its own: find each text's end by length.
        lengths = np.array([len(t.lower().encode()) + 1 for t in texts], np.int64)
        return symbols, place[np.cumsum(lengths) - 1]

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        extra = np.zeros(len(texts), np.int64)
        plain, rare, owner = [], [], []
        for k, text in enumerate(texts):
            if "<|" in text:
                text, found = self.special.subn(" ", text)
                extra[k] = found
            if not text.isascii() and max(text) >= BEYOND_LATIN:
                pieces = _RARE.findall(text)
                text = _RARE.sub(" ", text)
                words = [w for p in pieces for w in self.bpe.words_of(p)]
                rare += words
                owner += [k] * len(words)
            plain.append(text)
        symbols, ends = self._simple(plain)
        if rare:
            more = [np.frombuffer(w.encode(errors="surrogateescape"), np.uint8).astype(np.int64) for w in rare]
            stops = np.cumsum([len(m) + 1 for m in more])
            tail = np.full(int(stops[-1]), END_MARK, np.int64)
            tail[np.setdiff1d(np.arange(len(tail)), stops - 1, assume_unique=True)] = np.concatenate(more)
            total = self.transducer.counts(np.concatenate([symbols, tail]))
            each = np.diff(np.concatenate(([0], total))[np.concatenate(([0], stops)) + len(symbols)])
            extra += np.bincount(owner, weights=each, minlength=len(texts)).astype(np.int64)
        else:
            total = self.transducer.counts(symbols)
        upto = np.concatenate(([0], total))
        return extra + np.diff(np.concatenate(([0], upto[ends])))


@functools.lru_cache(maxsize=2)
def counter(spec: str) -> Counter:
    return Counter(loaded(spec))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row.

    A null or empty text has no bytes and no tokens. Texts are counted whole, however
    long; special strings count as one token. Repeated rows count one by one; other
    columns are not read; an empty table gives an empty result.
    """
    spec = _spec(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(spec.value).count
        for batch in batches:
            for part in slices(batch, "text", STEP):
                texts = part.column("text").to_pylist()
                sizes = pc.binary_length(part.column("text")).cast("int64")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array(count(texts))], names=["doc_id", "n_bytes", "n_tokens"])

    rows = texts_of(docs, id_col, text_col)
    counted = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
