"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

Texts are cut into marked words (white space is the mark before a word), which no piece crosses. The distinct words of a
slice are sorted, which is a depth-first walk of their trie: the search keeps its forward scores for each character of
the current word and goes on from the longest prefix it shares with the next one. The pieces that end at a character are
read off the trie of pieces, whose nodes know their longest suffix in it. Equal scores prefer the longer last
piece. A character that no piece covers is written as its UTF-8 byte pieces.

The vocabulary file is a parameter and is read once by the driver; tasks get its bytes (under ``MODEL_BYTES``). Scores
come from the file. Where they are merge ranks (0, -1, -2, ...), as in files of merges, they are read as log
probabilities of Zipf's law, -log(1 + rank); ``zipf=False`` takes them as they stand.

Defined results: a null or empty text has no pieces and decodes to the empty text; the mark itself in a text counts as a
space, as the format has it; repeated rows get equal results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import gc
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import common

#: Where the query and the pipeline take the vocabulary from.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Texts encoded together, in bytes: more of them share more words.
SLICE_BYTES = 3 << 20
#: A vocabulary file sent to the tasks may have so many bytes.
MODEL_BYTES = 64 << 20
MARK = "▁"
#: Characters that end a marked word wherever no piece holds them.
CUTS = "\n\t"
#: Stands for a piece where a character goes as its bytes.
BYTES = -1
#: Scores below this mark pieces that are not for use.
UNUSED = -1e8


class Pieces:
    """A vocabulary as a trie of nested nodes, with what decoding needs."""

    def __init__(self, model: bytes, zipf: bool = True) -> None:
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = lib.get_piece_size()
        self.byte_id: dict[int, int] = {}
        self.output: list[bytes] = []
        usable = []
        for i in range(size):
            text, score = lib.id_to_piece(i), lib.get_score(i)
            if lib.is_byte(i):
                self.byte_id[int(text[1:-1], 16)] = i
                self.output.append(bytes([int(text[1:-1], 16)]))
            elif lib.is_control(i):
                self.output.append(b"")
            elif lib.is_unknown(i):
                self.unknown = i
                self.output.append(" ⁇ ".encode())
            else:
                self.output.append(text.encode())
                if score > UNUSED and not lib.is_unused(i):
                    usable.append((text, i, score))
        # A lone character marked so is still needed where no other piece covers it.
        known = {t for t, _, _ in usable}
        low = min((s for _, _, s in usable), default=0.0)
        usable += [(t, i, low - 1.0) for i, t in enumerate(map(lib.id_to_piece, range(size)))
                   if len(t) == 1 and t not in known and not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        ranks = all(s <= 0 and s == int(s) for _, _, s in usable)
        if zipf and ranks:
            usable = [(t, i, -math.log1p(-s)) for t, i, s in usable]
        # What an unknown character costs: more than any piece.
        self.unknown_score = min((s for _, _, s in usable), default=0.0) - 10.0
        self.root = Node()
        for text, i, score in usable:
            node = self.root
            for c in text:
                node = node.next.setdefault(c, Node())
            node.out = ((len(text), score, i),)
        self.link()
        self.cuts = "".join(c for c in CUTS if not any(c in t for t, _, _ in usable))

    def link(self) -> None:
        """Each node learns its longest proper suffix in the trie, and all pieces that end there, longest first."""
        row = [self.root]
        while row:
            below = []
            for node in row:
                for c, child in node.next.items():
                    suffix = node.suffix
                    while suffix is not None and c not in suffix.next:
                        suffix = suffix.suffix
                    child.suffix = self.root if suffix is None else suffix.next[c]
                    child.out += child.suffix.out
                    below.append(child)
            row = below

    def step(self, node: Node, c: str) -> Node:
        """The longest suffix of what was read that begins a piece; kept with the node."""
        seen = node
        while seen is not None and c not in seen.next:
            seen = seen.suffix
        to = node.after[c] = self.root if seen is None else seen.next[c]
        return to

    def encode_sorted(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all given words, which must be sorted, end to end, and how many each has."""
        # Of each character read: the best score, and the last piece of the best path and its length.
        best, piece_at, size_at, nodes, last = [0.0], [0], [0], [self.root], ""
        ids, sizes = array("i"), []
        collecting = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and there are very many small objects
        try:
            for word in words:
                shared = 0
                for a, b in zip(word, last):
                    if a != b:
                        break
                    shared += 1
                del best[shared + 1:], piece_at[shared + 1:], size_at[shared + 1:], nodes[shared + 1:]
                node = nodes[-1]
                for c in word[shared:] if shared else word:
                    node = node.after.get(c) or self.step(node, c)
                    score, size = -math.inf, 0
                    for length, gain, piece in node.out:
                        this = best[-length] + gain
                        if this > score:
                            score, size, found = this, length, piece
                    if not (node.out and node.out[-1][0] == 1) and score < best[-1] + self.unknown_score:
                        score, size, found = best[-1] + self.unknown_score, 1, BYTES
                    best.append(score)
                    piece_at.append(found)
                    size_at.append(size)
                    nodes.append(node)
                last = word
                at, back = len(word), []
                while at:
                    if piece_at[at] == BYTES:
                        back += self.byte_ids(word[at - 1])[::-1]
                    else:
                        back.append(piece_at[at])
                    at -= size_at[at]
                back.reverse()
                ids.extend(back)
                sizes.append(len(back))
        finally:
            if collecting:
                gc.enable()
        return np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32), np.array(sizes, np.int64)

    def byte_ids(self, character: str) -> tuple[int, ...]:
        return tuple(self.byte_id.get(b, self.unknown) for b in character.encode())


class Node:
    """A prefix of pieces: what may follow, the longest suffix that is also a prefix, the pieces that end here."""

    __slots__ = ("next", "after", "suffix", "out")

    def __init__(self) -> None:
        self.next: dict[str, Node] = {}
        self.after: dict[str, Node] = {}
        self.suffix: Node | None = None
        self.out: tuple[tuple[int, float, int], ...] = ()


def marked_words(texts: pa.Array, cuts: str) -> tuple[pa.Array, np.ndarray]:
    """All marked words of the texts (a space stands for the mark), and the text of each."""
    texts = pc.replace_substring(texts, MARK, " ")
    some = np.flatnonzero(pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    # One space is set before each text, as the format does.
    raw, ends = common.offsets_of(pc.binary_join_element_wise("", texts.take(pa.array(some)).cast(pa.string()), " "))
    if not len(raw):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    is_cut = np.zeros(256, bool)
    is_cut[list(cuts.encode())] = True
    space, cut = raw == 32, is_cut[raw]
    begins = np.zeros(len(raw), bool)
    begins[1:] = space[1:] & ~space[:-1] | cut[1:] | cut[:-1]
    begins[ends[:-1]] = True
    start = np.flatnonzero(begins)
    offsets = pa.py_buffer(np.append(start, len(raw)).astype(np.int32))
    words = pa.Array.from_buffers(pa.string(), len(start), [None, offsets, pa.py_buffer(raw)])
    return words, some[np.searchsorted(ends, start, side="right") - 1]


def encode_slice(texts: pa.Array, pieces: Pieces) -> pa.Array:
    """Lists of piece ids, one for each text."""
    words, owner = marked_words(texts, pieces.cuts)
    coded = words.dictionary_encode()
    distinct = pc.replace_substring(coded.dictionary, " ", MARK)
    order = pc.array_sort_indices(distinct).to_numpy().astype(np.int64)
    flat, sorted_size = pieces.encode_sorted(distinct.take(pa.array(order)).to_pylist())
    size, begin = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    size[order], begin[order] = sorted_size, np.cumsum(sorted_size) - sorted_size
    codes = coded.indices.to_numpy()
    each = size[codes] if len(codes) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(each)])
    ids = flat[np.repeat(begin[codes] - total[:-1], each) + np.arange(total[-1])] if len(codes) else flat
    per_text = np.bincount(owner, weights=each, minlength=len(texts)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))


def decode_slice(ids: pa.Array, output: pa.Array) -> pa.Array:
    """The text of each list of ids; null for null, and ids outside the vocabulary raise."""
    filled = pc.fill_null(ids, pa.scalar([], ids.type)) if ids.null_count else ids
    parts = pa.ListArray.from_arrays(filled.offsets.cast(pa.int32()), output.take(filled.values))
    joined = pc.binary_join(parts, b"")
    texts = [raw.decode(errors="replace").replace(MARK, " ") for raw in joined.to_pylist()]
    return pa.array([None if missing else t[1:] if t.startswith(" ") else t
                     for t, missing in zip(texts, ids.is_null().to_pylist())], pa.string())


_LOADED: dict[tuple[int, bool], Pieces] = {}


def loaded(model: bytes, zipf: bool) -> Pieces:
    """The vocabulary, read once by each Python worker."""
    key = (hash(model), zipf)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model, zipf)
    return _LOADED[key]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        model = file.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError(f"{path} has more than {MODEL_BYTES} bytes")
    return model


def encode(docs: DataFrame, carry: list[str], path: str = MODEL_PATH, zipf: bool = True,
           text: str = "text") -> DataFrame:
    """``carry`` and ``ids``; no shuffle."""
    given = docs.select(*dict.fromkeys([*carry, text]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*carry).schema.fields),
                        "ids array<int>"])
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model.value, zipf)
        for part in common.slices(batches, text, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in carry), encode_slice(common.texts_of(part, text), pieces)],
                names=[*carry, "ids"])

    return given.mapInArrow(run, schema)


def decode(rows: DataFrame, carry: list[str], path: str = MODEL_PATH, ids: str = "ids") -> DataFrame:
    """``carry`` and ``decoded``; no shuffle."""
    given = rows.select(*dict.fromkeys([*carry, ids]))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*carry).schema.fields),
                        "decoded string"])
    model = rows.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        output = pa.array(loaded(model.value, True).output, pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carry), decode_slice(_own(part.column(ids)), output)],
                    names=[*carry, "decoded"])

    return given.mapInArrow(run, schema)


def _own(ids: pa.Array) -> pa.ListArray:
    """The lists with offsets and values of their own."""
    lists = ids.cast(pa.list_(pa.int32()))
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, lists.flatten(), mask=lists.is_null() if lists.null_count else None)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its piece ids and a digest of what they decode to."""
    ids = encode(common.table(spark, sf_dir, "documents"), ["doc_id"])
    both = decode(ids, ["doc_id", "ids"])
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                       F.sha2("decoded", 256).alias("decoded_sha256"))
