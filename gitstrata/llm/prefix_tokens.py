"""SentencePiece byte-pair encoding by a table of last tokens, and decoding.

Merging pairs by rank has one encoding per text, and cutting its last token off leaves the
encoding of the shorter prefix. So one token per prefix says everything: an automaton over
all pieces reports the tokens that end at a place, and the one that fits behind the last
token of what comes before it is the prefix's. Two tokens fit when merging their joint text
gives these two again. That is read off the merge trees: from the two letters at the cut,
the left token's right edge and the right token's left edge grow in the order of their
merges, and no merge across the cut may come before the next growth (on equal rank the
place further left goes first). The ids are then read from the end back.

Spark deals out the texts; a task works on slices of whole texts. A text is taken apart
where no piece can reach across (between two characters that stand side by side in no piece, such as
before a blank behind a letter), and a worker encodes each such part once and remembers at most
``REMEMBERED`` of them.

The model must be of the merging kind with byte fallback, unchanged characters, a blank put
before every text and no user symbols; others are refused. ``ids`` follow the library's.
Decoding takes any ids: pieces of control give nothing, unknown ones the model's mark, bytes
that form no character one replacement mark each.

Defined cases: a NULL or empty text has no ids; NULL ids decode to the empty text; U+2581 is
a blank; an id outside the vocabulary is an error; every row, repeated or without id, gets
its own result; other columns are left out by ``encode`` and ``decode`` unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gitstrata.llm.words import slices

REMEMBERED = 1 << 18
BLANK, MARK = "▁", "�"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_STRANGER = -1


class Pieces:
    """The vocabulary of one model with its merge trees; one per worker process."""

    _known: dict[str, Pieces] = {}

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        how, made = model.normalizer_spec, model.trainer_spec
        plain = how.add_dummy_prefix and how.escape_whitespaces and not (how.remove_extra_whitespaces or how.precompiled_charsmap)
        if made.model_type != 2 or not made.byte_fallback or made.treat_whitespace_as_suffix or not plain:
            raise ValueError("only byte-pair models with byte fallback and unchanged text are known")
        if {p.type for p in model.pieces} - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} or any("\0" in p.piece for p in model.pieces):
            raise ValueError("models with user symbols are not known")
        self.texts = [p.piece for p in model.pieces]
        self.types = np.array([p.type for p in model.pieces])
        self.ranks = [-p.score for p in model.pieces]
        self.token = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.size = [len(t) for t in self.texts]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        # Letters that only occur inside longer pieces take part in merges and end as bytes.
        self.n = len(self.texts)
        for letter in sorted({c for t in self.token for c in t} - set(self.token)):
            self.token[letter] = len(self.texts)
            self.texts.append(letter)
            self.ranks.append(float("inf"))
            self.size.append(1)
        self._trees()
        self.automaton = ahocorasick.Automaton()
        for text, i in self.token.items():
            if self.size[i] == 1 or i in self.parts:
                self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        # Texts are cut between bytes that no piece has side by side where one character ends and the next begins.
        self.cuts = np.ones((256, 256), bool)
        self.cuts[:, 0x80:0xC0] = False
        for text in self.token:
            letters = [c.encode() for c in text.replace(BLANK, " ")]
            for x, y in zip(letters, letters[1:], strict=False):
                self.cuts[x[-1], y[0]] = False
        surface = [t.replace(BLANK, " ").encode() for t in self.texts[: self.n]]
        for b, i in self.bytes.items():
            surface[i] = bytes([b])
        for i in np.flatnonzero(self.types != _NORMAL).tolist():
            if self.types[i] != _BYTE:
                surface[i] = made.unk_surface.encode() if self.types[i] == _UNKNOWN else b""
        self.length = np.array([len(s) for s in surface])
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.span = len(self.texts)
        self.fits: dict[int, bool] = {}
        self.forget()

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def forget(self) -> None:
        """Starts anew with the one part that ``encode`` cannot hold."""
        self.row: dict[str, int] = {"\0": 0}
        self.starts, self.counts = np.zeros(1 << 12, np.int64), np.ones(1 << 12, np.int64)
        self.ids, self.used = np.full(1 << 14, self.bytes[0], np.int32), 1

    def merged(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """Merging by definition: the tokens left over, and the last pair that was joined."""
        tokens, last = [self.token[c] for c in text], None
        while True:
            best = None
            for i in range(len(tokens) - 1):
                joint = self.token.get(self.texts[tokens[i]] + self.texts[tokens[i + 1]])
                if joint is not None and (best is None or self.ranks[joint] < self.ranks[best[1]]):
                    best = (i, joint)
            if best is None:
                return tokens, last
            i, joint = best
            last = (tokens[i], tokens[i + 1])
            tokens[i : i + 2] = [joint]

    def _trees(self) -> None:
        """The last merge of every piece that merging reaches, and the pieces whose parts merge later than they do."""
        self.parts: dict[int, tuple[int, int]] = {}
        self.odd: set[int] = set()
        for text, i in self.token.items():
            if self.size[i] > 1:
                tokens, last = self.merged(text)
                if tokens == [i]:
                    self.parts[i] = last
        for i, pair in sorted(self.parts.items(), key=lambda p: self.size[p[0]]):
            if any(x in self.odd or (x in self.parts and self.ranks[x] > self.ranks[i]) for x in pair):
                self.odd.add(i)
        # Edges from the letter at the cut up to the whole piece, with the rank of each growth.
        self.right_edge, self.left_edge = {}, {}
        for i in self.token.values():
            for side, edges in ((1, self.right_edge), (0, self.left_edge)):
                edge = [i]
                while edge[-1] in self.parts:
                    edge.append(self.parts[edge[-1]][side])
                edges[i] = edge[::-1]

    def fit(self, left: int, right: int) -> bool:
        """Whether merging the joint text of two tokens gives the two again."""
        if left in self.odd or right in self.odd:
            return self.merged(self.texts[left] + self.texts[right])[0] == [left, right]
        token, texts, ranks, never = self.token, self.texts, self.ranks, float("inf")
        xs, ys = self.right_edge[left], self.left_edge[right]
        i = j = 0
        while True:
            joint = token.get(texts[xs[i]] + texts[ys[j]])
            grow_left = ranks[xs[i + 1]] if i + 1 < len(xs) else never
            grow_right = ranks[ys[j + 1]] if j + 1 < len(ys) else never
            if joint is not None and ranks[joint] < grow_left and ranks[joint] <= grow_right:
                return False
            if i + 1 < len(xs) and grow_left <= grow_right:
                i += 1
            elif j + 1 < len(ys):
                j += 1
            else:
                return True

    def encode(self, parts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some parts whose blanks are written as U+2581, end to end, and the number of ids of each."""
        # Parts stand in one text, each behind a character that no piece has: the table is a list of it all.
        text = "\0".join(["", *parts])
        fits, size, span, last, settled = self.fits, self.size, self.span, [_STRANGER] * (len(text) + 1), 0
        known = fits.get
        for end, token in self.automaton.iter(text):
            if end >= settled:
                before = last[end + 1 - size[token]]
                if before >= 0:
                    key = before * span + token
                    good = known(key)
                    if good is None:
                        good = fits[key] = self.fit(before, token)
                    if not good:
                        continue
                last[end + 1] = token
                settled = end + 1
        if len(fits) > REMEMBERED * 2:
            fits.clear()
        out, counts, at, n = [], [], len(text), self.n
        put, here = out.append, 0
        while at:
            token = last[at]
            if 0 <= token < n:
                put(token)
                at -= size[token]
                continue
            at -= 1
            if text[at] == "\0":
                counts.append(len(out) - here)
                here = len(out)
            else:
                out.extend(self.bytes[b] for b in reversed(text[at].encode()))
        return np.array(out[::-1], np.int32), np.array(counts[::-1], np.int64)

    def parts_of(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Byte starts of the parts of all texts."""
        cut = np.zeros(len(data), bool)
        if len(data):
            cut[1:] = self.cuts[data[:-1], data[1:]]
            cut[bounds[:-1][np.diff(bounds) > 0]] = True
        return np.flatnonzero(cut)

    def ids_of(self, parts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts end to end, and the number of ids of each."""
        if len(self.row) > REMEMBERED:
            self.forget()
        new = [p for p in parts if p not in self.row]
        if new:
            ids, counts = self.encode([p.replace(" ", BLANK) for p in new])
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
            starts = self.used + np.cumsum(counts) - counts
            rows = len(self.row)
            if rows > len(self.counts):
                self.starts, self.counts = (np.resize(x, rows * 2) for x in (self.starts, self.counts))
            self.starts[rows - len(new) : rows], self.counts[rows - len(new) : rows] = starts, counts
            if self.used + len(ids) > len(self.ids):
                self.ids = np.resize(self.ids, (self.used + len(ids)) * 2)
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
        rows = np.fromiter(map(self.row.__getitem__, parts), np.int64, len(parts))
        counts = self.counts[rows]
        return self.ids[ranges(self.starts[rows], counts)], counts

    def decoded(self, ids: np.ndarray, raw: bytes) -> str:
        """The text of ids, given the bytes of their pieces; one mark per byte that forms no character."""
        try:
            text = None if (self.types[ids] == _CONTROL).any() else raw.decode()
        except UnicodeDecodeError:
            text = None
        if text is None:
            out, run = [], bytearray()
            for i in [*ids.tolist(), -1]:
                if i >= 0 and self.types[i] == _BYTE:
                    run.append(int(self.surface[self.offset[i]]))
                    continue
                at = 0
                while at < len(run):
                    lead = run[at]
                    width = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
                    try:
                        out.append(run[at : at + width].decode())
                    except UnicodeDecodeError:
                        out.append(MARK)
                        width = 1
                    at += width
                run.clear()
                if i >= 0:
                    out.append(self.surface[self.offset[i] : self.offset[i + 1]].tobytes().decode())
            text = "".join(out)
        # The blank put before the text goes again, if a piece that gives text has it in front.
        shown = ids[self.types[ids] != _CONTROL][:1]
        return text[1:] if len(shown) and self.texts[shown[0]].startswith(BLANK) else text


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``starts[i] .. starts[i] + counts[i] - 1``, one range behind the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _encoded(column: pa.Array, pieces: Pieces) -> Iterator[tuple[int, int, pa.Array]]:
    """First row, rows and lists of ids of the slices of a column."""
    column = pc.replace_substring(pc.fill_null(column, "").cast(pa.large_string()), BLANK, " ")
    column = pc.replace_substring_regex(column, r"\A(?s:(.))", r" \1")
    for t in slices(column):
        start = pieces.parts_of(t.data, t.bounds)
        offsets = np.append(start, len(t.data)).astype(np.int64)
        parts = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(t.data)))
        coded = parts.dictionary_encode()
        flat, lengths = pieces.ids_of(coded.dictionary.to_pylist())
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        use = np.asarray(coded.indices)
        counts = lengths[use]
        ids = flat[ranges(first[use], counts)]
        sums = np.concatenate([[0], np.cumsum(counts)])
        cuts = sums[np.searchsorted(start, t.bounds)].astype(np.int32)
        yield t.row, len(t), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))


def _decoded(column: pa.Array, pieces: Pieces) -> pa.Array:
    """The texts of lists of ids."""
    column, texts = pc.if_else(pc.is_valid(column), column, pa.scalar([], column.type)), []
    for low in range(0, len(column), 256):
        part = column.slice(low, 256)
        flat, cuts = np.asarray(part.flatten()), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(part)))])
        if len(flat) and (flat.min() < 0 or flat.max() >= pieces.n):
            raise ValueError("an id is outside the vocabulary")
        lengths = pieces.length[flat]
        raw = pieces.surface[ranges(pieces.offset[flat], lengths)]
        sums = np.concatenate([[0], np.cumsum(lengths)])[cuts]
        texts.extend(pieces.decoded(flat[a:b], raw[c:d].tobytes()) for a, b, c, d in zip(cuts, cuts[1:], sums, sums[1:], strict=False))
    return pa.array(texts, pa.string())


def encode(docs: DataFrame, model: str, keep: Sequence[str] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``ids``, the token ids of ``text``; with ``decoded`` also the ``text`` of these ids."""
    made = ["ids", "text"] if decoded else ["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in batches:
            for row, n, ids in _encoded(batch.column(batch.num_columns - 1), pieces):
                mine = [batch.column(i).slice(row, n) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*mine, ids, *([_decoded(ids, pieces)] if decoded else [])], [*keep, *made])

    rows = docs.select(*[f"`{c}`" for c in keep], F.col("text").cast("string"))
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join([*fields, "ids array<int>", *["text string"] * decoded]))


def decode(encoded: DataFrame, model: str, keep: Sequence[str] = ("doc_id", "ids")) -> DataFrame:
    """The columns ``keep`` of ``encoded`` and ``text``, the text of its ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model)
        for batch in batches:
            last = batch.num_columns - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], _decoded(batch.column(last), pieces)], [*keep, "text"])

    rows = encoded.select(*[f"`{c}`" for c in keep], F.col("ids").cast("array<int>").alias("_ids"))
    fields = [f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join([*fields, "text string"]))


def report(docs: DataFrame, model: str) -> DataFrame:
    """Per document: number of ids, and the SHA-256 of the ids' decimal list and of the text decoded from them."""
    # One pass does both, so a task runs one Python worker.
    return encode(docs, model, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
