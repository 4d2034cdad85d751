"""SentencePiece encoding and decoding by a weighted finite-state transducer (operator 6)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from shortlist.llm.common import byte_chunks, process_cache, texts_of

#: Different word forms whose paths a Python process remembers.
CACHE_WORDS = 400_000
#: Bytes of text whose parts are told apart together, and rows of a batch that is sent on.
PART_BYTES, SEND_ROWS = 2_000_000, 256
NO_LIMIT = 1 << 62
ENCODED = "doc_id long, ids array<int>, n_ids int"
SPACE = "▁"
INFINITE = float("inf")
#: More than any piece costs: bytes are taken where no piece goes on.
FALLBACK_COST = 1e6


class PieceTransducer:
    """Normaliser, pieces and byte fallback compiled to one machine; its shortest paths are the encodings.

    * Normaliser: a blank becomes the space mark and one mark is put first, as the model says. Models with a character
      map or with removal of white space are refused.
    * Pieces: an arc for each piece, from the state before its characters to the state behind them.
    * Byte fallback: a character that is no piece has one arc, to the ids of its UTF-8 bytes.

    Weights are in the tropical semiring. In a unigram model an arc costs minus its score. In a merge (BPE) model no
    sum of scores gives the model's own segmentation, so the state also holds the last piece and an arc weighs 0 where
    merging the two pieces from scratch gives just these two, and infinity elsewhere: exactly one path stays finite.
    """

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models that keep characters and white space as they are")
        if model.trainer_spec.model_type not in (1, 2) or not model.trainer_spec.byte_fallback:
            raise ValueError("only unigram and merge models with byte fallback")
        self.merges = model.trainer_spec.model_type == 2
        self.prefix = rules.add_dummy_prefix
        kinds = schema.ModelProto.SentencePiece
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.scores = [p.score for p in model.pieces]
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.out = [bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else
                    b"" if p.type in (kinds.CONTROL, kinds.UNKNOWN) else p.piece.replace(SPACE, " ").encode()
                    for p in model.pieces]
        self.trie: dict = {}
        for piece, number in self.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[None] = number
        # no piece holds a mark behind another character, so paths through the parts below never depend on each other
        self.separate = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.split: dict[int, tuple[int, int] | None] = {}
        self.finite: dict[int, dict[int, bool]] = {}
        self.arcs = 0
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.text = [p.piece for p in model.pieces]
        self.spelled = pa.array(self.out, pa.large_binary())

    def halves(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes this one: None for a character, (-1, -1) if merging never makes it."""
        known = self.split.get(piece, 0)
        if known == 0:
            parts = list(self.text[piece])
            known = None
            while len(parts) > 1:
                best, at = -INFINITE, -1
                for i in range(len(parts) - 1):
                    found = self.ids.get(parts[i] + parts[i + 1])
                    if found is not None and self.scores[found] > best:
                        best, at = self.scores[found], i
                if at < 0:
                    known = (-1, -1)
                    break
                known = (self.ids[parts[at]], self.ids[parts[at + 1]]) if len(parts) == 2 else None
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.split[piece] = known
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether merging the characters of both pieces gives just the two.

        Undo their merges, the latest first; at no time may the pieces that then meet have an earlier merge of their own.
        """
        bar = INFINITE
        while True:
            joined = self.ids.get(self.text[left] + self.text[right])
            if joined is not None and -self.scores[joined] < bar:
                return False
            of_left, of_right = self.halves(left), self.halves(right)
            if of_left is None and of_right is None:
                return True
            if of_right is None or of_left is not None and self.scores[left] < self.scores[right]:
                bar, left = -self.scores[left], of_left[1]
            else:
                bar, right = -self.scores[right] + 1e-9, of_right[0]

    def weight(self, before: int, piece: int) -> float:
        """Cost of the arc of `piece` from a state whose last piece is `before` (-1: none, or a fallback character)."""
        if not self.merges:
            return -self.scores[piece]
        if self.halves(piece) == (-1, -1):
            return INFINITE
        return 0.0 if before < 0 or self.apart(before, piece) else INFINITE

    def shortest_path(self, text: str) -> list[int]:
        """Compose with one part and take the shortest path; one state is kept for each position.

        In a unigram model only the cheapest state of a position can go on. In a merge model every position has exactly
        one state with a finite path, the segmentation of the text before it; so the first one found is taken.
        """
        n = len(text)
        last, came = [-2] * (n + 1), [0] * (n + 1)
        last[0] = -1
        if self.merges:
            finite = self.finite
            for i in range(n):
                known, node, j = finite.get(last[i]), self.trie.get(text[i]), i
                if known is None:
                    known = finite[last[i]] = {}
                if node is None or None not in node:
                    last[i + 1], came[i + 1] = -1, i
                while node is not None:
                    j += 1
                    arc = node.get(None)
                    if arc is not None and last[j] == -2:
                        good = known.get(arc)
                        if good is None:
                            good = known[arc] = self.weight(last[i], arc) < INFINITE
                            self.arcs += 1
                        if good:
                            last[j], came[j] = arc, i
                    if j == n:
                        break
                    node = node.get(text[j])
        else:
            cost = [0.0] + [INFINITE] * n
            for i in range(n):
                node, j = self.trie.get(text[i]), i
                if (node is None or None not in node) and cost[i] + FALLBACK_COST < cost[i + 1]:
                    cost[i + 1], last[i + 1], came[i + 1] = cost[i] + FALLBACK_COST, -1, i
                while node is not None:
                    j += 1
                    arc = node.get(None)
                    if arc is not None and (total := cost[i] + self.weight(last[i], arc)) < cost[j]:
                        cost[j], last[j], came[j] = total, arc, i
                    if j == n:
                        break
                    node = node.get(text[j])
        ids: list[int] = []
        while n:
            piece, i = last[n], came[n]
            if piece >= 0:
                ids.append(piece)
            else:
                ids.extend([self.bytes[x] for x in reversed(text[i:n].encode())])
            n = i
        ids.reverse()
        return ids

    def path(self, part: bytes) -> bytes:
        """The ids of a part, from memory or from the machine. Two generations are kept, so frequent parts stay in bounded memory."""
        path = self.words.get(part)
        if path is None:
            path = self.older.get(part)
            if path is None:
                path = np.array(self.shortest_path(part.decode().replace(" ", SPACE)), "<i4").tobytes()
            if len(self.words) > CACHE_WORDS:
                self.older, self.words = self.words, {}
            if self.arcs > 4 * CACHE_WORDS:
                self.finite, self.arcs = {}, 0
            self.words[part] = path
        return path

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, given as bytes with blanks for space marks, and where those of each begin.

        A part begins where a text does and with each run of blanks. Equal parts are looked up once.
        """
        begins = np.zeros(len(data) + 1, bool)
        if self.separate:
            blank = data == 32
            begins[1:-1] = blank[1:] & ~blank[:-1]
        begins[offsets] = True
        begins[-1] = True
        edges = np.flatnonzero(begins)
        if len(edges) < 2:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        parts = pa.Array.from_buffers(
            pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        paths = [self.path(p) for p in parts.dictionary.to_pylist()]
        which = parts.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(np.array([len(p) // 4 for p in paths])[which])])
        _, _, ids = pa.array(paths, pa.large_binary()).take(parts.indices).buffers()
        return np.frombuffer(ids, "<i4", ends[-1]), ends[np.searchsorted(edges, offsets)]

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text."""
        text = text.replace(SPACE, " ")
        data = np.frombuffer((" " + text if self.prefix and text else text).encode(), np.uint8)
        return self.encode_texts(data, np.array([0, len(data)]))[0]

    def decode_texts(self, ids: pa.Array, offsets: np.ndarray) -> pa.Array:
        """The inverse, for lists of ids between offsets: bytes of all pieces, without the mark that was put first; broken bytes become U+FFFD."""
        if ids.null_count:
            raise ValueError("an id is null")
        spelled = self.spelled.take(ids)
        _, ends, data = spelled.buffers()
        ends = np.frombuffer(ends, np.int64, len(ids) + 1)[offsets]
        data = np.frombuffer(data, np.uint8, ends[-1]) if ends[-1] else np.zeros(0, np.uint8)
        if self.prefix:
            full = ends[:-1][ends[1:] > ends[:-1]]
            marks = full[data[full] == 32]
            ends = ends - np.searchsorted(marks, ends)
            data = np.delete(data, marks)
        texts = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
        try:
            return texts.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.large_string())

    def decode(self, ids: Iterable[int]) -> str:
        """The text of one list of ids."""
        ids = pa.array(ids, pa.int32())
        return self.decode_texts(ids, np.array([0, len(ids)]))[0].as_py()


def transducer(model_file: str) -> PieceTransducer:
    """Compiled once in each Python process."""
    known = process_cache("pieces")
    if model_file not in known:
        known[model_file] = PieceTransducer(model_file)
    return known[model_file]


def encode_pieces(docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids and n_ids of every whole text.

    A null or empty text has no ids. Null ids and repeated rows keep their rows; other columns are ignored; an empty
    table gives no rows. `model_file` is read where the tasks run.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_file)
        blank, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        for batch in batches:
            for start, end, _, _ in byte_chunks(batch.column(1), PART_BYTES):   # copies are made of so much only
                part = batch.slice(start, end - start)
                texts = pc.replace_substring(texts_of(part.column(1)), SPACE, " ")
                if machine.prefix:
                    texts = pc.if_else(pc.equal(texts, none), texts, pc.binary_join_element_wise(blank, texts, none))
                (_, _, data, offsets), = byte_chunks(texts, NO_LIMIT)
                ids, bounds = machine.encode_texts(data, offsets)
                for at in range(0, len(texts), SEND_ROWS):
                    own = bounds[at:at + SEND_ROWS + 1]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(at, SEND_ROWS),
                         pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(ids[own[0]:own[-1]])),
                         pa.array(np.diff(own).astype(np.int32))], names=["doc_id", "ids", "n_ids"])

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text")).mapInArrow(run, ENCODED)


def decode_pieces(encoded: DataFrame, model_file: str, ids_column: str = "ids", out_column: str = "decoded") -> DataFrame:
    """All columns of `encoded` and the text of its ids; null and empty ids give the empty text.

    An id that the model does not have fails the task; `out_column` must be a new name.
    """
    if out_column in encoded.columns:
        raise ValueError(f"there is a column {out_column} already")
    place = encoded.columns.index(ids_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_file)
        for batch in batches:
            for at in range(0, batch.num_rows, SEND_ROWS):
                part = batch.slice(at, SEND_ROWS)
                lists = part.column(place)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                texts = machine.decode_texts(lists.flatten(), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
                yield pa.RecordBatch.from_arrays([*part.columns, texts.cast(pa.string())], names=[*part.schema.names, out_column])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(out_column, StringType())]))
