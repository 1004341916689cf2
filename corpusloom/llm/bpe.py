"""Byte-level BPE encoding and decoding.

Encoding runs each match of the split pattern through a finite-state transducer compiled from
the merge ranks and determinised lazily. It rests on two facts of rank-ordered BPE: the
encoding of a prefix that ends at a token boundary is the same tokens, and a token sequence is
an encoding if each two neighbours are the encoding of their joined bytes. So after each byte
the transducer knows the last token of the encoding of the prefix; a start position stays alive
while some token begins with the bytes since then and is longer, and tokens before the point where the
back-pointers of all live positions meet are final and emitted. Lookahead is bounded by
the longest token. A state is the shape of the live positions and the pending tokens, so pieces whose
bytes differ only where nothing can ask for them share it; its moves are computed on first use and cached within a bound (an overfull cache is emptied, which costs
time, never results). A Python worker keeps its transducer for its next tasks.

Decoding concatenates token bytes in pieces; a UTF-8 state machine holds back the bytes of an
unfinished character until its rest arrives.

Defined results: a null text encodes to no tokens; ids_sha256 of no tokens is that of the empty
string; repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import threading
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import in_batches, pairs, table, texts

BYTES = [bytes((i,)) for i in range(256)]
STATES, WORDS = 220_000, 180_000
#: Seconds after which an idle Python worker lets its encoder go.
IDLE = 4.0
NEITHER = -1, False
#: A space between white space or the text's ends.
LONE_SPACE = re.compile(r" (?!\S)(?<!\S )").search


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The defining algorithm, quadratic: join the neighbours of the lowest rank, leftmost first. For short pieces and tests."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return tuple(ranks[p] for p in parts)


class Transducer:
    """Bytes in, token ids out, both a step at a time."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks, self.most = ranks, states
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        # of each token and each prefix of one: the token or -1, and whether a longer token begins with it
        self.known = {token[:k]: (-1, True) for token in ranks for k in range(1, len(token))}
        for token, rank in ranks.items():
            self.known[token] = rank, token in self.known
        self.proper: dict[int, bool] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.splits: dict[int, tuple[int, int]] = {}
        # the trie of the tokens with its ways back, as far as it has been asked for
        self.nodes: dict[bytes, int] = {b"": 0}
        self.names = [b""]
        self.arcs: dict[int, tuple[tuple[tuple[int, int], ...], tuple[int, ...], int]] = {}
        self.clear()

    def clear(self) -> None:
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.shapes: list[tuple[int, tuple[int, ...]]] = []
        self.numbers: dict[tuple[int, tuple[int, ...]], int] = {}
        if len(self.arcs) > self.most:
            self.nodes, self.names, self.arcs = {b"": 0}, [b""], {}
        # The node of the bytes since the first live start, and for each position since the last final token the last
        # token of the prefix: -1 stands for the beginning, or where no live start can ask for it.
        self.number((0, (-1,)))

    def number(self, shape: tuple[int, tuple[int, ...]]) -> int:
        if (n := self.numbers.get(shape)) is None:
            n = self.numbers[shape] = len(self.shapes)
            self.shapes.append(shape)
        return n

    def arc(self, node: int, byte: int) -> tuple[tuple[tuple[int, int], ...], tuple[int, ...], int]:
        """Tokens that end with this byte and their lengths, lengths since the starts that stay alive (both longest first), and the next node."""
        text = self.names[node] + BYTES[byte]
        found = [(k, *self.known.get(text[len(text) - k :], NEITHER)) for k in range(len(text), 0, -1)]
        lives = (*[k for k, _, longer in found if longer], 0)
        rest = text[len(text) - lives[0] :]
        if (next_ := self.nodes.get(rest)) is None:
            next_ = self.nodes[rest] = len(self.names)
            self.names.append(rest)
        known = self.arcs[node << 8 | byte] = tuple((token, k) for k, token, _ in found if token >= 0), lives, next_
        return known

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; of a single byte, itself twice."""
        if (known := self.splits.get(token)) is None:
            text = self.tokens[token]
            if len(text) == 1:
                known = token, token
            else:
                parts = merge(text, {t: r for k in range(len(text)) for n in range(1, len(text)) if (r := self.ranks.get(t := text[k : k + n])) is not None})
                known = parts if len(parts) == 2 else (token, token)
            self.splits[token] = known
        return known

    def joined(self, left: int, right: int) -> bool:
        """Whether the tokens left, right are the encoding of their bytes.

        Undoes merges at the border, the latest first: they are no encoding if at some time a
        merge over the border came before those that were undone.
        """
        if (known := self.fits.get((left, right))) is not None:
            return known
        if len(self.fits) > 500_000:
            self.fits.clear()
        a, b, before = left, right, 1 << 60
        while True:
            over = self.ranks.get(self.tokens[a] + self.tokens[b])
            if over is not None and over < before:
                known = False
                break
            inner_a, inner_b = self.halves(a)[1], self.halves(b)[0]
            if inner_a == a and inner_b == b:
                known = True
                break
            # of the two, the token of the higher rank was made last (on a tie the right one: merges run from the left)
            if inner_b == b or inner_a != a and a > b:
                a, before = inner_a, a
            else:
                b, before = inner_b, b + 1
        self.fits[left, right] = known
        return known

    def whole(self, token: int) -> bool:
        """Whether a token's own bytes encode to it alone (true of every token that merges can make)."""
        if (known := self.proper.get(token)) is None:
            known = self.proper[token] = merge(self.tokens[token], self.ranks) == (token,)
        return known

    def step(self, shape: tuple[int, tuple[int, ...]], byte: int) -> tuple[tuple[int, tuple[int, ...]], tuple[int, ...]]:
        """The next shape, and the tokens that have become final."""
        node, lasts = shape
        ends, lives, node = self.arcs.get(node << 8 | byte) or self.arc(node, byte)
        fits, size, end = self.fits, self.size, len(lasts)
        for token, length in ends:  # the longest first: exactly one candidate fits
            before = lasts[-length]
            fit = fits.get((before, token)) if before >= 0 else self.whole(token)
            if fit is None:
                fit = self.joined(before, token)
            if fit:
                break
        else:
            raise ValueError("single bytes must be tokens")
        lasts += (token,)
        # go back from the live starts until their ways meet: what lies before is final
        final = end
        for length in lives:
            start = end - length
            while start != final:
                if start > final:
                    start -= size[lasts[start]]
                else:
                    final -= size[lasts[final]]
        # positions on no live start's way are forgotten, and the last final token unless something may begin right behind it
        kept = [-1] * (end - final + 1)
        for length in lives:
            start = end - length
            while start > final and kept[start - final] < 0:
                kept[start - final] = last = lasts[start]
                start -= size[last]
        if lives[0] == end - final:
            kept[0] = lasts[final]
        return (node, tuple(kept)), self.back(lasts, final) if final else ()

    def back(self, lasts: tuple[int, ...], at: int) -> tuple[int, ...]:
        """The tokens up to a position."""
        out = []
        while at:
            out.append(lasts[at])
            at -= self.size[lasts[at]]
        return tuple(out[::-1])

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a piece, byte by byte through the cached moves."""
        if len(self.shapes) > self.most or len(self.moves) > 2 * self.most:
            self.clear()
        state, ids, moves = 0, [], self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                shape, out = self.step(self.shapes[state], byte)
                move = moves[state << 8 | byte] = self.number(shape), out
            state, out = move
            if out:
                ids += out
        lasts = self.shapes[state][1]
        ids += self.back(lasts, len(lasts) - 1)
        return ids


class Memory(dict):
    """A bounded memory: when `most` entries are new, the older ones are kept only if they are asked for again."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


class Encoder:
    """Texts to ids: the pattern's matches, each through the transducer, with a bounded memory of frequent words.

    No match of the byte-level patterns holds a space behind other characters, except in a run of
    white space. So where no space stands between white space, the text can be cut before each
    space, and what lies between two spaces can be looked up as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, words: int = WORDS, states: int = STATES):
        self.fst, self.find = Transducer(ranks, states), regex.compile(pattern).findall
        self.matches, self.words = Memory(words), Memory(words)

    def match(self, piece: str) -> list[int]:
        found = self.matches[piece]
        if found is None:
            found = self.fst.encode(piece.encode("utf-8", "surrogatepass"))
            if len(piece) < 64:
                self.matches.put(piece, found)
        return found

    def plain(self, text: str) -> list[int]:
        """A list to read only: that of a single match is the memory's own."""
        pieces = self.find(text)
        if len(pieces) == 1:
            return self.match(pieces[0])
        ids: list[int] = []
        for piece in pieces:
            ids += self.match(piece)
        return ids

    def encode(self, text: str) -> list[int]:
        if LONE_SPACE(text):
            return list(self.plain(text))
        first, *rest = text.split(" ")
        ids, words = list(self.plain(first)), self.words
        for word in rest:
            found = words[word]
            if found is None:
                found = self.plain(" " + word)
                if len(word) < 24 and "\n" not in word:
                    words.put(word, found)
            ids += found
        return ids


class Utf8:
    """Holds back the bytes of an unfinished character; what can't begin a character passes through."""

    def __init__(self) -> None:
        self.tail = b""

    def feed(self, piece: bytes) -> bytes:
        data = self.tail + piece
        for back in range(1, min(4, len(data) + 1)):
            byte = data[-back]
            if byte < 0x80:
                break
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4 if byte < 0xF8 else 1
                if need > back:
                    self.tail = data[-back:]
                    return data[:-back]
                break
        self.tail = b""
        return data

    def end(self) -> bytes:
        rest, self.tail = self.tail, b""
        return rest


def decode(ids: Iterable[int], tokens: list[bytes], piece: int = 4096) -> Iterator[bytes]:
    """The bytes of ids, in pieces that end where a character ends."""
    ids, state = list(ids), Utf8()
    for k in range(0, len(ids), piece):
        yield state.feed(b"".join([tokens[i] for i in ids[k : k + piece]]))
    yield state.end()


#: The encoder that this Python worker used last, by name, and the timer that lets it go.
_LAST: dict[tuple[str, str], Encoder] = {}
_TIMERS: list[threading.Timer] = []


def worker_encoder(name: str, ranks: dict[bytes, int], pattern: str, words: int = WORDS, states: int = STATES) -> Encoder:
    """An encoder that tasks of one Python worker share, since only the first of them finds its caches empty."""
    while _TIMERS:
        _TIMERS.pop().cancel()
    encoder = _LAST.get((name, pattern))
    if encoder is None:
        _LAST.clear()
        encoder = _LAST[name, pattern] = Encoder(ranks, pattern, words, states)
    return encoder


def release(after: float = IDLE) -> None:
    """Let the worker's encoder go unless its next task comes soon: other work of this process needs the memory."""
    timer = threading.Timer(after, _LAST.clear)
    timer.daemon = True
    timer.start()
    _TIMERS.append(timer)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False, words: int = WORDS, states: int = STATES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and its ids where asked for.

    The ranks (a fixed, small vocabulary) go to the executors as a broadcast; words and states bound a worker's memory.
    """
    spark = docs.sparkSession
    shared, name = spark.sparkContext.broadcast(load_ranks(ranks_path)), uuid.uuid4().hex
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def rows(batches):
        encoder = worker_encoder(name, shared.value, pattern, words, states)
        try:
            tokens = [b""] * (max(shared.value.values(), default=-1) + 1)
            for token, rank in shared.value.items():
                tokens[rank] = token
            names = [str(i) for i in range(len(tokens))]
            for doc_id, text in pairs(batches):
                ids = encoder.encode(text.decode("utf-8", "replace"))
                digest = hashlib.sha256()
                for part in decode(ids, tokens):
                    digest.update(part)
                yield (doc_id, len(ids), hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest(), digest.hexdigest()) + ((ids,) if with_ids else ())
        finally:  # a task that fails or is cut short lets it go as well
            release()

    weigh = (lambda row: 200 + 4 * row[1]) if with_ids else (lambda row: 200)
    return texts(docs).mapInArrow(lambda b: in_batches(rows(b), schema, weigh), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def production() -> tuple[str, str]:
    """Path of the ranks and the split pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), *production())
