"""SentencePiece encoding and decoding by a Viterbi search that words with a common prefix share.

A text's marked words (each starts with the space mark) are encoded apart: no piece of the models
served spans a mark that follows another character. Of a batch's distinct words, those new to the task
are sorted, which makes their sequence a depth-first walk of their trie: from one word to the next only
the places past the common prefix are searched, and the forward states before them are reused.

A forward state is the best path that ends at a place. Unigram models add up piece scores and keep
the largest sum. In BPE models scores rank merges and sums mean nothing: there a path is legal if
each two neighbouring pieces are such that the merge order leaves them apart, exactly one legal path
ends at each place, and its state is its last piece. Both equal the library's own encoding.

Of a place, its state, last piece and (unigram models) score are held, so an unbroken word of n characters
takes about 300 n bytes and time in proportion to n; one of 200,000 characters takes under 100 MB.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ._spark import tidy

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Encoded words, and pairs of pieces tried, that a task keeps; beyond that it forgets them all and goes on.
CACHE = 400_000


class Model:
    """A parsed model file: identity normalisation, marks kept as they are, bytes for unknown characters."""

    def __init__(self, body: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.body = body
        m = proto.ModelProto()
        m.ParseFromString(body)
        norm, spec = m.normalizer_spec, m.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.treat_whitespace_as_suffix or spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with identity normalisation are served")
        if any(p.type == USER for p in m.pieces) or any(MARK in p.piece.lstrip(MARK) for p in m.pieces if p.type == NORMAL):
            raise ValueError("a piece spans words")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.bpe = spec.model_type == BPE
        self.pieces = [p.piece for p in m.pieces]
        self.types = [p.type for p in m.pieces]
        self.scores = [p.score for p in m.pieces]
        self.unknown = self.types.index(UNKNOWN)
        self.unknown_surface = spec.unk_surface
        bytes_of = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        self.byte = [bytes_of[i] for i in range(256)] if spec.byte_fallback else None
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.floor = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self.longest = max(map(len, self.ids), default=1)
        self._spine: dict[str, tuple] = {}
        self._prefixes = {p[:i] for p in self.ids for i in range(len(p) + 1)}
        self._bytes = [self._surface(i) for i in range(len(self.pieces))]
        # Of each place in a word all that matters is its tail, the longest end that some piece begins with. By number of the tail:
        self._tails = [""]
        self._tail_number = {"": 0}
        self._onward: list[dict[str, int]] = [{}]  # next character to next tail
        self._ending: list[list[tuple[int, int]]] = [[]]  # (length, number) of the pieces that end here, the longest first
        self._names = list(self.pieces)  # pieces by number, then characters that are none
        self._char_number: dict[str, int] = {}
        self._worth = list(self.scores)
        self._coded = [np.int32(i).tobytes() for i in range(len(self.pieces))]
        self._apart: dict[int, bool] = {}

    # -- merge order of BPE models

    def _merged(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces that merging leaves of ``text``, and the last two that were merged."""
        parts, last = list(text), None
        while len(parts) > 1:
            ranked = [(-self.scores[self.ids[x + y]], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.ids]
            if not ranked:
                break
            _, i = min(ranked)
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    def _sides(self, piece: str) -> tuple:
        """(left edge, right edge): the pieces that have stood there while this one was built, each with the rank at which it was merged away."""
        got = self._spine.get(piece)
        if got is None:
            forever = float("inf")
            whole, split = self._merged(piece)
            if len(piece) == 1 or len(whole) > 1:
                got = (((piece, forever),), ((piece, forever),))
            else:
                at = -self.scores[self.ids[piece]]
                left, right = self._sides(split[0])[0], self._sides(split[1])[1]
                got = ((*left[:-1], (left[-1][0], at), (piece, forever)), (*right[:-1], (right[-1][0], at), (piece, forever)))
            self._spine[piece] = got
        return got

    def _stay_apart(self, first: str, second: str) -> bool:
        """Whether merging ``first + second`` ends in these two pieces."""
        if first + second not in self._prefixes and len(first) + len(second) <= 2:
            return True
        for x, x_gone in self._sides(first)[1]:
            for y, y_gone in self._sides(second)[0]:
                i = self.ids.get(x + y)
                # Merging happens by rank, then from the left: x goes with its left neighbour before it would go with y.
                if i is not None and -self.scores[i] < x_gone and -self.scores[i] <= y_gone:
                    return False
        return True

    def _reachable(self, piece: str) -> bool:
        return not self.bpe or len(piece) == 1 or len(self._merged(piece)[0]) == 1

    # -- search

    def _number(self, piece: str) -> int:
        """Number of a piece, or of a character that is none: it stands for its bytes, or is unknown."""
        i = self.ids.get(piece, self._char_number.get(piece))
        if i is None:
            i = self._char_number[piece] = len(self._names)
            self._names.append(piece)
            self._worth.append(self.floor)
            self._coded.append(np.array([self.byte[b] for b in piece.encode("utf-8")], np.int32).tobytes() if self.byte else np.int32(self.unknown).tobytes())
        return i

    def _go(self, state: int, char: str) -> int:
        """Number of the tail after one more character."""
        tail = self._tails[state] + char
        while tail not in self._prefixes and len(tail) > 1:
            tail = tail[1:]
        to = self._tail_number.get(tail)
        if to is None:
            to = self._tail_number[tail] = len(self._tails)
            self._tails.append(tail)
            self._onward.append({})
            ends = [tail[i:] for i in range(len(tail)) if i == len(tail) - 1 or (tail[i:] in self.ids and self._reachable(tail[i:]))]
            self._ending.append([(len(x), self._number(x)) for x in ends])
        self._onward[state][char] = to
        return to

    def _try(self, left: int, piece: int) -> bool:
        got = self._apart[left << 32 | piece] = self._stay_apart(self._names[left], self._names[piece])
        return got

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each distinct word, as 32-bit numbers."""
        out: dict[str, bytes] = {}
        if len(self._apart) > CACHE:
            self._apart.clear()
        if len(self._tails) + len(self._names) > len(self._prefixes) + len(self.pieces) + CACHE:  # strange characters without end
            self.__init__(self.body)
        onward, ending, apart, coded, worth = self._onward, self._ending, self._apart, self._coded, self._worth
        bpe, first_char = self.bpe, len(self.pieces)
        # The last piece before each place and its length; the path is traced back at the end of a word.
        before, states, last, sizes, score = "", [0], [-1], [0], [0.0]
        for word in sorted(words):
            keep = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                keep += 1
            del states[keep + 1 :], last[keep + 1 :], sizes[keep + 1 :], score[keep + 1 :]
            state = states[keep]
            at = keep
            for char in word[keep:]:
                at += 1
                state = onward[state].get(char) or self._go(state, char)
                states.append(state)
                if bpe:
                    for size, piece in ending[state]:
                        left = last[at - size]
                        if left < 0:
                            break
                        ok = apart.get(left << 32 | piece)
                        if ok or (ok is None and self._try(left, piece)):
                            break
                else:
                    best = -1e300
                    for n, i in ending[state]:
                        total = score[at - n] + worth[i]
                        if total > best:
                            best, size, piece = total, n, i
                    score.append(best)
                last.append(piece)
                sizes.append(size)
            before = word
            parts, at = [], len(word)
            while at:
                piece = last[at]
                at -= sizes[at]
                # Unknown characters in a row are one unknown id.
                if not piece >= first_char <= last[at] or self.byte:
                    parts.append(coded[piece])
            parts.reverse()
            out[word] = b"".join(parts)
        return out

    def marked_words(self, text: str) -> list[str]:
        """The text with marks for spaces, cut before each mark that follows another character."""
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", self.prefix + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        words = self.marked_words(text)
        found = self.encode_words(set(words))
        return np.frombuffer(b"".join(found[w] for w in words), np.int32).tolist()

    def _surface(self, i: int) -> bytes:
        kind = self.types[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        if kind == CONTROL:
            return b""
        return (self.unknown_surface if kind == UNKNOWN else self.pieces[i].replace(MARK, " ")).encode()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become the replacement character."""
        text = b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _text_parts(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes of text."""
    first, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if i > first and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if len(texts):
        yield first, len(texts)


def _encode_rows(body: bytes, text_at: int, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = Model(body), {}
        for batch in batches:
            texts = batch.column(text_at)
            for a, b in _text_parts(texts):
                part = texts.slice(a, b - a)
                marked = [model.marked_words(t or "") for t in part.to_pylist()]
                new = {w for words in marked for w in words if w not in known}
                if len(known) + len(new) > CACHE:
                    known.clear()
                    new = {w for words in marked for w in words}
                known.update(model.encode_words(new))
                lists = [b"".join(map(known.__getitem__, words)) for words in marked]
                bounds = np.zeros(b - a + 1, dtype=np.int32)
                np.cumsum([len(x) // 4 for x in lists], out=bounds[1:])
                more = {"ids": pa.ListArray.from_arrays(bounds, np.frombuffer(b"".join(lists), np.int32))}
                if decoded:
                    more["decoded"] = pa.array([model.decode(np.frombuffer(x, np.int32).tolist()) for x in lists], pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), *more.values()], names=[*batch.schema.names, *more])

    return tidy(run)


def _decode_rows(body: bytes, ids_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(body)
        for batch in batches:
            lists = batch.column(ids_at)
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for first in range(0, batch.num_rows, 512):
                end = min(first + 512, batch.num_rows)
                texts = [model.decode(flat[a:b].tolist()) for a, b in zip(bounds[first:end], bounds[first + 1 : end + 1], strict=True)]
                texts = pa.array(texts, pa.string(), mask=lists.slice(first, end - first).is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in batch.columns), texts], names=[*batch.schema.names, "decoded"])

    return tidy(run)


def read_model(path: str | None = None) -> bytes:
    """The model file at ``path``, read by the driver (half a MB) and sent with the tasks; by default the public 32k one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def _with(df: DataFrame, more: str) -> str:
    taken = set(df.columns) & {x.split()[0] for x in more.split(", ")}
    if taken:
        raise ValueError(f"there is a column {taken.pop()}")
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", {more}"


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` and ``ids``, the pieces of the whole text; a null text has none, like an empty one. A column ``ids`` of ``docs`` is an error (ValueError)."""
    return docs.mapInArrow(_encode_rows(model, docs.columns.index("text"), False), _with(docs, "ids array<int>"))


def code(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``, the text that the ids stand for: both in one pass. Columns of these names in ``docs`` are an error (ValueError)."""
    return docs.mapInArrow(_encode_rows(model, docs.columns.index("text"), True), _with(docs, "ids array<int>, decoded string"))


def decode(rows: DataFrame, model: bytes) -> DataFrame:
    """``rows`` and ``decoded``, the text of ``ids``; null ids give null. A column ``decoded`` of ``rows`` is an error (ValueError)."""
    return rows.mapInArrow(_decode_rows(model, rows.columns.index("ids")), _with(rows, "decoded string"))
