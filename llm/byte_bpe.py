"""Byte-level BPE: texts to token ids and back.

Encoding runs a transducer over the bytes of a piece of text. A nondeterministic state is a place in the trie of tokens
together with the token that ends where this place began; a determinised state is the tuple of all such places that are
still open. Determinised states and their transitions are made when first met and kept. Each transition names the one
token that ends the encoding of the bytes read so far: of the tokens that end here, the one that the merges leave beside
its left neighbour. As soon as no token is open across a position, all tokens before it are final and are emitted, so the
lookahead is bounded by the longest token.

Decoding is a state machine over the bytes of tokens. Its state is the incomplete UTF-8 sequence so far, and a step
(state, token) to (state, characters) is computed once.
"""

import base64
import gc
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from llm.frames import add_columns, keep_only

RANKS = "byte_bpe_multi_50k.tiktoken"
ROOT, NONE = 0, -1
#: Entries of a worker's tables; a full table is emptied, which only costs time.
MOST_STATES, MOST_PAIRS, MOST_PIECES, MOST_STEPS = 300_000, 400_000, 250_000, 300_000
#: Positions kept before final tokens are emitted.
FLUSH = 4096
#: A place is one number: a trie node, and behind it the token before this place, plus one.
SHIFT = 32
MASK = (1 << SHIFT) - 1


def place(node: int, before: int) -> int:
    return node << SHIFT | before + 1


class Steps(dict):
    """Of a transducer: from a state's number, shifted by a byte, with a byte in its place, to the next state's and the last token.

    One flat table for all states takes a third of the memory that a table in each state would.
    """

    __slots__ = ("owner",)

    def __init__(self, owner: "Transducer"):
        self.owner = owner

    def __missing__(self, key: int) -> tuple[int, int]:
        out = self[key] = self.owner.move(self.owner.places[key >> 8], key & 0xFF)
        return out


class Transducer:
    """The merges of a rank file as a lazily determinised transducer."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.lengths = {i: len(t) for t, i in ranks.items()}
        self.trie: dict[int, int] = {}
        #: Does a node of the trie have another below it?
        self.inner: dict[int, bool] = {}
        self.ends: list[int] = [NONE]
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                after = self.trie.get(node << 8 | byte)
                if after is None:
                    after = self.trie[node << 8 | byte] = len(self.ends)
                    self.ends.append(NONE)
                node = after
            self.ends[node] = rank
        self.side_by_side: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        """Only the state at the start of a piece, number 0, stays."""
        start = (place(ROOT, NONE),)
        #: Open places of each state; of the states, their numbers shifted by a byte and their last tokens.
        self.places, self.states = [start], {start: (0, NONE)}
        self.steps = Steps(self)

    def merged(self, data: bytes) -> list[int]:
        """The merges done one by one, lowest rank first, then leftmost."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [(self.ranks[p + q], i) for i, (p, q) in enumerate(zip(parts, parts[1:])) if p + q in self.ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def stays(self, left: int, token: int) -> bool:
        """Do the merges leave ``token`` whole beside ``left`` (NONE: at the start)?"""
        key = place(left, token)
        known = self.side_by_side.get(key)
        if known is None:
            if len(self.side_by_side) >= MOST_PAIRS:
                self.side_by_side.clear()
            if left == NONE:
                known = self.merged(self.tokens[token]) == [token]
            else:
                known = self.merged(self.tokens[left] + self.tokens[token]) == [left, token]
            self.side_by_side[key] = known
        return known

    def move(self, places: tuple[int, ...], byte: int) -> tuple[int, int]:
        """The next state and the last token after ``byte``."""
        open_places, last = [], NONE
        for packed in places:
            after = self.trie.get(packed >> SHIFT << 8 | byte)
            if after is None:
                continue
            before = (packed & MASK) - 1
            if self.grows(after):
                open_places.append(place(after, before))
            token = self.ends[after]
            if last == NONE and token != NONE and self.stays(before, token):
                last = token
        places = (*open_places, place(ROOT, last))
        out = self.states.get(places)
        if out is None:
            out = self.states[places] = len(self.places) << 8, last
            self.places.append(places)
        return out

    def grows(self, node: int) -> bool:
        known = self.inner.get(node)
        if known is None:
            known = self.inner[node] = any(node << 8 | byte in self.trie for byte in range(256))
        return known

    def encode(self, data: bytes) -> list[int]:
        """The token ids of one piece of text."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.states) >= MOST_STATES:
            self.forget()
            gc.collect()
        out: list[int] = []
        lasts: list[int] = []
        state, steps, places = 0, self.steps, self.places
        if len(data) < FLUSH:
            for byte in data:
                state, last = steps[state | byte]
                lasts.append(last)
            return self.final(lasts)
        for byte in data:
            state, last = steps[state | byte]
            lasts.append(last)
            if len(lasts) >= FLUSH and len(places[state >> 8]) == 1:  # what follows depends on the last token only
                out += self.final(lasts)
                lasts = []
        return out + self.final(lasts)

    def final(self, lasts: list[int]) -> list[int]:
        """The tokens on the way back from the last position."""
        out, at, lengths = [], len(lasts), self.lengths
        while at:
            token = lasts[at - 1]
            out.append(token)
            at -= lengths[token]
        out.reverse()
        return out


class Pieces(dict):
    """Ids of the pieces met lately."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= MOST_PIECES:
            self.clear()
        ids = tuple(self.transducer.encode(piece.encode()))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Decoder:
    """Token ids to text, a token at a time; ``end`` closes the stream.

    Bytes that are not UTF-8 become U+FFFD, one for each longest start of a sequence. Ids without a token raise KeyError.
    """

    #: Lead bytes, the number of bytes that follow, and what the first of these may be.
    SEQUENCES = (
        (range(0xC2, 0xE0), 1, range(0x80, 0xC0)),
        (range(0xE0, 0xE1), 2, range(0xA0, 0xC0)),
        (range(0xE1, 0xED), 2, range(0x80, 0xC0)),
        (range(0xED, 0xEE), 2, range(0x80, 0xA0)),
        (range(0xEE, 0xF0), 2, range(0x80, 0xC0)),
        (range(0xF0, 0xF1), 3, range(0x90, 0xC0)),
        (range(0xF1, 0xF4), 3, range(0x80, 0xC0)),
        (range(0xF4, 0xF5), 3, range(0x80, 0x90)),
    )
    LEADS = {lead: (n, first) for leads, n, first in SEQUENCES for lead in leads}

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.forget()

    def forget(self) -> None:
        self.known = 0
        self.steps: dict[bytes, Decoded] = {}
        self.now = self.after(b"")

    def after(self, pending: bytes) -> "Decoded":
        steps = self.steps.get(pending)
        if steps is None:
            steps = self.steps[pending] = Decoded(self, pending)
        return steps

    @classmethod
    def advance(cls, pending: bytes, data: bytes) -> tuple[bytes, str]:
        """Incomplete sequence and characters after ``data``."""
        out: list[str] = []
        for byte in data:
            if pending:
                n, first = cls.LEADS[pending[0]]
                if byte in (first if len(pending) == 1 else range(0x80, 0xC0)):
                    pending += bytes([byte])
                    if len(pending) == n + 1:
                        out.append(pending.decode())
                        pending = b""
                    continue
                out.append("\ufffd")
                pending = b""
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in cls.LEADS:
                pending = bytes([byte])
            else:
                out.append("\ufffd")
        return pending, "".join(out)

    def decode(self, ids) -> str:
        """The characters that ``ids`` complete, following what came before."""
        now, out = self.now, []
        for i in ids:
            now, characters = now[i]
            out.append(characters)
        self.now = now
        return "".join(out)

    def end(self) -> str:
        out, self.now = ("\ufffd" if self.now.pending else ""), self.after(b"")
        if self.known >= MOST_STEPS:
            self.forget()
        return out


class Decoded(dict):
    """From a token to the next steps and the completed characters, given the incomplete sequence ``pending``."""

    __slots__ = ("owner", "pending")

    def __init__(self, owner: Decoder, pending: bytes):
        self.owner, self.pending = owner, pending

    def __missing__(self, token: int) -> tuple["Decoded", str]:
        pending, characters = Decoder.advance(self.pending, self.owner.tokens[token])
        self.owner.known += 1
        out = self[token] = self.owner.after(pending), characters
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Transducer:
    with open(path, "rb") as file:
        return Transducer({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)})


@lru_cache(maxsize=2)
def newer_characters(path: str) -> dict[int, int]:
    """Letters and numbers of this pattern library that the tokenizer's own Unicode tables don't know yet, to an unassigned one."""
    everything = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    classes = r"[\p{L}\p{N}]"
    theirs = tiktoken.Encoding("classes", pat_str=classes, mergeable_ranks=load(path).ranks, special_tokens={})
    known = set(theirs.decode(theirs.encode_ordinary(everything)))
    return {ord(c): 0x378 for c in regex.findall(classes, everything) if c not in known}


@lru_cache(maxsize=2)
def tools(path: str, pattern: str):
    transducer = load(path)
    newer = newer_characters(path)
    finder = regex.compile(pattern)
    # A maximum is found faster than a class of many ranges.
    first = chr(min(newer, default=0x110000 - 1))

    def split(text: str) -> list[str]:
        if text.isascii() or max(text) < first or not newer.keys() & set(map(ord, text)):
            return finder.findall(text)
        return [text[m.start() : m.end()] for m in finder.finditer(text.translate(newer))]

    return split, Pieces(transducer), Decoder(transducer.tokens)


def release() -> None:
    """Free the tables: a worker lives on, and later tasks need its memory for other things."""
    tools.cache_clear()
    load.cache_clear()
    gc.collect()


def _strings(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


IDS = T.StructField("token_ids", T.ArrayType(T.IntegerType(), False), False)
DECODED = T.StructField("decoded", T.StringType(), False)


def _lists(ids: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    values = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(offsets[-1]))
    kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), type=kind)


def encode(
    docs: DataFrame, text: str = "text", carry: list[str] | None = None, path: str | None = None, pattern: str = public_tokenizers.PATTERN, decoded: bool = False
) -> DataFrame:
    """``docs`` with ``token_ids`` of every whole text; with ``decoded``, also the text that the ids decode to.

    ``path`` is a rank file on every executor; each match of ``pattern`` is encoded separately, without special tokens.
    Null and empty texts have no ids. Repeated rows are encoded each. Other columns (``carry``; None: all) stay, except
    columns named like the new ones, which are replaced. An empty table gives an empty table.
    """
    path = path or public_tokenizers.path(RANKS)

    def rows():
        split, pieces, decoder = tools(path, pattern)

        def compute(column: pa.Array) -> list[pa.Array]:
            gc.disable()  # the tables are large and hold no garbage until they are emptied
            try:
                ids = [list(chain.from_iterable(map(pieces.__getitem__, split(x)))) for x in _strings(column)]
                out = [_lists(ids)]
                if decoded:
                    out.append(pa.array([decoder.decode(x) + decoder.end() for x in ids], pa.string()))
            finally:
                gc.enable()
            return out

        return compute

    return add_columns(docs, text, carry, [IDS, *[DECODED] * decoded], rows, release)


def decode(df: DataFrame, ids: str = "token_ids", path: str | None = None) -> DataFrame:
    """``df`` with ``decoded``, the text of its arrays of token ids. A null array or one with a null in it gives null."""
    path = path or public_tokenizers.path(RANKS)
    kept = [c for c in df.columns if c.lower() != "decoded"]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField("decoded", T.StringType())])
    at = kept.index(ids)

    def run(batches):
        keep_only(release)
        decoder = Decoder(load(path).tokens)
        for batch in batches:
            lists = batch.column(at).to_pylist()
            texts = [None if x is None or None in x else decoder.decode(x) + decoder.end() for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.select(*kept).mapInArrow(run, schema)
