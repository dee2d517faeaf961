"""Operator 4, SentencePiece encoding and decoding: a score-ordered agenda of adjacent symbol pairs for merge-type vocabularies.

The text becomes symbols, one a character; an agenda (a heap ordered by score, then by place from the left) holds the adjacent
pairs that the vocabulary has as a piece; the best pair merges and brings its new neighbours' pairs. No piece of such a
vocabulary goes on after a word's end with a further space, so a text falls apart into chunks that cannot influence each other:
equal chunks are encoded once for a while (a cache of bounded size), and a chunk without a space may have any length.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from roadloom.llm.common import need, read

SPACE = "▁"
SENTENCE_MARKS = ".,!?;:"
#: Chunks kept by a worker, at most, in each of two generations.
CACHE_CHUNKS = 150_000


class PieceVocabulary:
    """Pieces, scores and special ids of a merge-type model, as plain values that can be sent to executors."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], bos: int, eos: int, texts: list[str], byte_of: dict[int, int]):
        self.pieces, self.byte_ids, self.bos, self.eos, self.texts, self.byte_of = pieces, byte_ids, bos, eos, texts, byte_of

    @classmethod
    def load(cls, path: str) -> PieceVocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: dict[str, tuple[int, float]] = {}
        texts, byte_of, byte_ids = [], {}, [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_of[i] = int(piece[1:-1], 16)
                byte_ids[byte_of[i]] = i
                texts.append("")
            elif model.is_control(i) or model.is_unknown(i):
                texts.append("")
            else:
                pieces[piece] = (i, model.get_score(i))
                texts.append(piece.replace(SPACE, " "))
        if len(byte_of) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        return cls(pieces, byte_ids, model.bos_id(), model.eos_id(), texts, byte_of)

    def chunk_pattern(self) -> re.Pattern:
        """What splits a text into chunks that no piece bridges: before a run of spaces; where the vocabulary has no piece across
        them, also around a newline and between a letter or digit and a sentence mark."""
        multi = [p for p in self.pieces if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in multi):
            raise ValueError("a piece goes on after a word's end")
        newline = "" if any("\n" in p for p in multi) else "\n"
        whole = f"{SPACE}*[^{SPACE}{newline}]+|{SPACE}+" + (f"|{newline}" if newline else "")
        across = re.compile(rf"([^\W_])[{SENTENCE_MARKS}]")
        bridged = re.escape("".join(sorted({c for p in multi for c in across.findall(p)})))
        return re.compile(rf"{SPACE}*[^\W_{bridged}]+(?=[{SENTENCE_MARKS}])|{whole}")


def agenda(chunk: str, pieces: dict[str, tuple[int, float]]) -> list[str]:
    """The symbols that remain when every pair on the agenda has merged or gone stale."""
    symbols: list[str] = list(chunk)
    n = len(symbols)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[float, int, int, str]] = []
    for i in range(n - 1):
        joined = symbols[i] + symbols[i + 1]
        if joined in pieces:
            heap.append((-pieces[joined][1], i, i + 1, joined))
    heapq.heapify(heap)
    while heap:
        _, i, j, joined = heapq.heappop(heap)
        a, b = symbols[i], symbols[j]
        if not a or not b or len(a) + len(b) != len(joined) or right[i] != j:
            continue
        symbols[i], symbols[j] = joined, ""
        after = right[i] = right[j]
        if after < n:
            left[after] = i
            if (wide := joined + symbols[after]) in pieces:
                heapq.heappush(heap, (-pieces[wide][1], i, after, wide))
        if (before := left[i]) >= 0 and (wide := symbols[before] + joined) in pieces:
            heapq.heappush(heap, (-pieces[wide][1], before, i, wide))
    return [s for s in symbols if s]


class Codec:
    """Encodes and decodes texts in one worker."""

    def __init__(self, vocabulary: PieceVocabulary):
        self.v, self.split = vocabulary, vocabulary.chunk_pattern().findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.text_of = vocabulary.texts

    def _encode_chunk(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            ids: list[int] = []
            for symbol in agenda(chunk, self.v.pieces):
                if symbol in self.v.pieces:
                    ids.append(self.v.pieces[symbol][0])
                else:
                    ids.extend(self.v.byte_ids[b] for b in symbol.encode())
            found = np.array(ids, "<u4").tobytes()
        if len(chunk) <= 64:
            if len(self.young) >= CACHE_CHUNKS:
                self.old, self.young = self.young, {}
            self.young[chunk] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """All ids as little-endian unsigned 32-bit integers, with begin and end."""
        parts = [np.array([self.v.bos], "<u4").tobytes()]
        if text:
            young, slow, add = self.young.get, self._encode_chunk, parts.append
            for chunk in self.split(SPACE + text.replace(" ", SPACE)):
                add(young(chunk) or slow(chunk))
                if not self.young:  # a new generation
                    young = self.young.get
        parts.append(np.array([self.v.eos], "<u4").tobytes())
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: spaces for their signs without the one before the text, byte pieces joined to characters, a
        replacement character for each byte that fits none."""
        at, texts = ids.tolist(), self.text_of
        if not np.isin(ids, self._bytes()).any():
            out = "".join([texts[i] for i in at])
        else:
            parts, run = [], bytearray()
            for i in at:
                if i in self.v.byte_of:
                    run.append(self.v.byte_of[i])
                    continue
                if run:
                    parts.append(_characters(bytes(run)))
                    run.clear()
                parts.append(texts[i])
            if run:
                parts.append(_characters(bytes(run)))
            out = "".join(parts)
        first = next((i for i in at if i not in (self.v.bos, self.v.eos)), None)
        return out[1:] if first is not None and first not in self.v.byte_of and out[:1] == " " else out

    def _bytes(self) -> np.ndarray:
        if not hasattr(self, "_byte_array"):
            self._byte_array = np.array(sorted(self.v.byte_of), "<u4")
        return self._byte_array


#: This worker's codec, by its broadcast: a later task finds the chunks of an earlier one.
_CODECS: dict[int, Codec] = {}


def _characters(raw: bytes) -> str:
    """UTF-8 with a replacement character for each byte that is part of no character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                i += 1
        return "".join(out)


def encode_pieces(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True) -> DataFrame:
    """Rows (id, ids array<int>, decoded string, n_tokens, ids_sha256, decoded_sha256): each whole text encoded with begin and
    end ids and decoded again. Null and empty texts give the two ids and an empty text. Rows, ids or null ids that repeat are
    each encoded; further columns play no part. keep_ids=False leaves out ids and decoded, for digests alone."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(PieceVocabulary.load(model_path))  # as many pieces as the vocabulary file has
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>, decoded string"

    number = sent._jbroadcast.id()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _CODECS:
            _CODECS.clear()
            _CODECS[number] = Codec(sent.value)
        codec = _CODECS[number]
        for batch in batches:
            rows, all_ids, texts = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                decoded = codec.decode(ids)
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                if keep_ids:
                    all_ids.append(ids)
                    texts.append(decoded)
            n, encoded, round_trip = zip(*rows, strict=True) if rows else ([], [], [])
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(round_trip, pa.string())]
            if keep_ids:
                bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                flat = np.concatenate(all_ids).astype(np.int32) if all_ids else np.zeros(0, np.int32)
                columns += [pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return need(docs, id_column, text_column).mapInArrow(work, schema)


def differs_from_library(docs: DataFrame, model_path: str, text_column: str = "text") -> DataFrame:
    """The check in Arrow batches: the texts whose ids or decoded text are not the sentencepiece library's (text, ours, theirs).
    The model's path has to be there on every executor."""
    sent = docs.sparkSession.sparkContext.broadcast(PieceVocabulary.load(model_path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library, codec = sentencepiece.SentencePieceProcessor(model_file=model_path), Codec(sent.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            theirs = library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
            ours = [codec.encode(x) for x in texts]
            bad = [i for i, x in enumerate(texts) if ours[i].tolist() != theirs[i] or codec.decode(ours[i]) != library.decode(theirs[i])]
            yield pa.RecordBatch.from_arrays([pa.array([texts[i] for i in bad], pa.string()), pa.array([str(ours[i].tolist()) for i in bad], pa.string()), pa.array([str(theirs[i]) for i in bad], pa.string())], ["text", "ours", "theirs"])

    return need(docs, text_column).mapInArrow(work, "text string, ours string, theirs string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(read(spark, sf_dir, "documents"), default_model(), keep_ids=False)
