"""SentencePiece encoding and decoding for BPE ("merge type") models.

Encoding walks a text once, left to right, over an Aho-Corasick automaton of
the vocabulary, instead of running merges from a priority queue:

* at each place the longest matching piece is tried first, then its shorter
  prefixes;
* a piece may follow the previous one only if the two are *compatible*: merging
  the characters of both from scratch must give back exactly these two pieces;
* where nothing fits, the last piece is taken back, its end is marked in a
  bitfield of failed positions and a shorter one is tried.

A sequence whose neighbours are all compatible is the one the merge procedure
gives, so the first complete walk is the encoding.

Normalisation follows the model: white space becomes U+2581, one is put before
a non-empty text. Characters outside the vocabulary become byte pieces. If no piece has
U+2581 after another character, nothing can merge across the start of a word,
and each word is encoded on its own and remembered in a bounded table.

Defined results: null or empty text has no ids and decodes to the empty text;
other columns pass by name only; repeated rows give repeated rows; a text of
any length is processed whole.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capaflow.llm.common import in_batches, kept_beside

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
WORD_MEMORY = 250_000    # words remembered in a task, twice; others are encoded again
PAIR_MEMORY = 1_000_000  # compatibility answers remembered by a worker


class PieceModel:
    """Pieces, scores and byte pieces of a BPE model file."""

    def __init__(self, serialized: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb
        proto = pb.ModelProto()
        proto.ParseFromString(serialized)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2:
            raise ValueError("a BPE model is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisation with white space kept as prefix is supported")
        if any(p.type in (USER_DEFINED, UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.dummy_prefix = spec.add_dummy_prefix
        self.byte_fallback = proto.trainer_spec.byte_fallback
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}


class Encoder:
    def __init__(self, model: PieceModel):
        self.model = model
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}  # the table before it was last full
        ids = model.ids
        # pieces that merging their own characters gives back; others never come out
        self.usable = {p: i for p, i in ids.items() if self.merged(p) == [p]}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.usable.items():
            self.automaton.add_word(piece, (i, len(piece) - 1))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.usable), default=1)
        # for each piece, the next shorter usable piece that it starts with
        self.shorter = {}
        for piece, i in self.usable.items():
            for k in range(len(piece) - 1, 0, -1):
                if piece[:k] in self.usable:
                    self.shorter[i] = self.usable[piece[:k]]
                    break
        self.length = {i: len(p) for p, i in self.usable.items()}
        # what each id decodes to: a piece's text, a byte, nothing for control pieces
        self.piece_bytes = [
            bytes([model.byte_of[i]]) if kind == BYTE else b"" if kind == CONTROL
            else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode()
            for i, (piece, kind) in enumerate(zip(model.pieces, model.types, strict=True))]
        self.characters = {p for p in self.usable if len(p) == 1}
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in ids)

    def merged(self, text: str) -> list[str]:
        """Pieces of ``text`` by merging: the best-scored adjacent pair first, leftmost among equals."""
        ids, scores = self.model.ids, self.model.scores
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: int, b: int) -> bool:
        got = self.pairs.get(a << 32 | b)
        if got is None:
            x, y = self.model.pieces[a], self.model.pieces[b]
            got = self.merged(x + y) == [x, y]
            if len(self.pairs) >= PAIR_MEMORY:
                self.pairs.clear()
            self.pairs[a << 32 | b] = got
        return got

    def longest_matches(self, text: str) -> list[int]:
        """For each place the id of the longest usable piece that starts there, -1 if none."""
        found = [-1] * len(text)
        for end, (i, back) in self.automaton.iter(text):
            found[end - back] = i  # matches come by their ends, so the last for a start is the longest
        return found

    def known(self, text: str) -> list[int]:
        """Ids of a run of characters that all are pieces, by backtracking."""
        if text in self.usable:
            return [self.usable[text]]
        size = len(text)
        longest, length, shorter, pairs = self.longest_matches(text), self.length, self.shorter, self.pairs
        failed = bytearray(size // 8 + 1)
        token = longest[0]
        out, at = [token], length[token]
        last, token = token, longest[at]
        while True:
            while token >= 0:
                end = at + length[token]
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = pairs.get(last << 32 | token)
                    if fits or fits is None and self.compatible(last, token):
                        break
                token = shorter.get(token, -1)
            if token >= 0:
                out.append(token)
                if end == size:
                    return out
                at, last, token = end, token, longest[end]
                continue
            while token < 0:  # take pieces back until one has a shorter form
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= length[last]
                token = shorter.get(last, -1)
            if out:
                last = out[-1]
            else:  # any first piece will do whose end has not failed
                while failed[length[token] >> 3] >> (length[token] & 7) & 1:
                    token = shorter[token]
                out, at, last = [token], length[token], token
                token = longest[at]

    def chunk(self, text: str) -> list[int]:
        """Ids of normalised text; a character outside the vocabulary becomes its bytes (or unknown)."""
        if self.characters.issuperset(text):
            return self.known(text)
        usable, out, run = self.usable, [], 0
        strange = [k for k, c in enumerate(text) if c not in usable]
        for k in strange:
            if k > run:
                out += self.known(text[run:k])
            if self.model.byte_fallback:
                out += [self.model.bytes[b] for b in text[k].encode()]
            elif not (out and out[-1] == self.model.unknown and k == run):
                out.append(self.model.unknown)
            run = k + 1
        if run < len(text):
            out += self.known(text[run:])
        return out

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)

    _WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def words_of(self, text: str) -> list[tuple[str, bytes]]:
        """For each word of a text, with the spaces before it: its ids as decimal text and the bytes they stand for."""
        known, made = self.words, self.word
        if self.model.dummy_prefix and "  " not in text and SPACE not in text and text[:1] != " " != text[-1:]:
            return [known.get(w) or made(w, SPACE + w) for w in text.split(" ")]  # one space before each word
        return [known.get(w) or made(w, w) for w in self._WORD.findall(self.normalise(text))]

    def word(self, key: str, chunk: str) -> tuple[str, bytes]:
        """Ids of a chunk and their bytes, remembered if it is not too long."""
        got = self.older.get(key)
        if got is None:
            ids = self.chunk(chunk)
            got = (",".join(map(str, ids)), b"".join(map(self.piece_bytes.__getitem__, ids)))
        if len(key) <= 64:
            if len(self.words) >= WORD_MEMORY:
                self.older = dict(self.words)
                self.words.clear()
            self.words[key] = got
        return got

    def encode_decode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids as decimal text joined by commas, and the text they decode to.

        A word's bytes do not depend on its neighbours, so the decoded text is the words' bytes in a row.
        """
        if not text:
            return 0, "", ""
        if not self.by_word:
            ids = self.chunk(self.normalise(text))
            return len(ids), ",".join(map(str, ids)), self.decode(ids)
        words = self.words_of(text)
        joined = ",".join(map(itemgetter(0), words))
        raw = b"".join(map(itemgetter(1), words))
        return joined.count(",") + 1, joined, self.text_of(raw, self.starts_with_space(int(words[0][0].partition(",")[0])))

    def encode(self, text: str | None) -> list[int]:
        joined = self.encode_decode(text or "")[1]
        return [int(x) for x in joined.split(",")] if joined else []

    def forget(self) -> None:
        """Give up the remembered words."""
        self.words, self.older = {}, {}

    def starts_with_space(self, first: int) -> bool:
        """Whether the space that normalisation adds is the start of this first piece."""
        return self.model.dummy_prefix and self.model.types[first] == NORMAL and self.piece_bytes[first][:1] == b" "

    def text_of(self, raw: bytes, added_space: bool) -> str:
        if added_space:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _utf8(raw)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the bytes of all pieces read as UTF-8, the added first space taken off. Bytes on either side of a
        control symbol are not read together."""
        out, first = [], True
        for control, run in groupby(ids, lambda i: self.model.types[i] == CONTROL):
            if not control:
                run = list(run)
                out.append(self.text_of(b"".join(map(self.piece_bytes.__getitem__, run)), first and self.starts_with_space(run[0])))
                first = False
        return "".join(out)


def _utf8(raw: bytes) -> str:
    """Each byte that no character can use becomes one U+FFFD."""
    out, k = [], 0
    while k < len(raw):
        try:
            out.append(raw[k:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[k:k + e.start].decode())
            out.append("�")
            k += e.start + 1
    return "".join(out)


_encoders: dict[str, Encoder] = {}


def load(serialized: bytes) -> Encoder:
    """The encoder of a model, made once in each worker."""
    key = hashlib.sha256(serialized).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(PieceModel(serialized))
    return _encoders[key]


def encode_decode(docs: DataFrame, model_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  digests: bool = False) -> DataFrame:
    """Per row: the kept columns, n_tokens, the ids joined by commas and the decoded text.

    The model file (about half a MB) goes to the workers with the task. With
    ``digests`` the two texts are given as lowercase SHA-256 hex (ids_sha256,
    decoded_sha256) so that the long strings never leave the worker.
    """
    with open(model_file, "rb") as f:
        serialized = f.read()
    names = ("n_tokens", "ids_sha256", "decoded_sha256") if digests else ("n_tokens", "ids", "decoded")
    keep = kept_beside(keep, names)
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[1:]), f"{names[0]} long", f"{names[1]} string", f"{names[2]} string"])

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def encoded(encoder: Encoder, part: pa.RecordBatch) -> pa.RecordBatch:
        n, ids, back = [], [], []
        for t in part.column(0):
            count, joined, decoded = encoder.encode_decode(t.as_py() or "")
            n.append(count)
            ids.append(sha(joined) if digests else joined)
            back.append(sha(decoded) if digests else decoded)
        return pa.RecordBatch.from_arrays(
            [*part.columns[1:], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
            names=[*keep, *names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(serialized)
        gc.disable()  # nothing here is cyclic, and the remembered words are many to walk through
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    yield encoded(encoder, batch.slice(lo, 1000))
        finally:
            encoder.forget()  # the worker lives on for other tasks
            gc.enable()

    return in_batches(rows, work, schema)
