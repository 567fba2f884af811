"""SentencePiece BPE encoding and decoding: exact merges by backtracking over longest matches.

The library merges, again and again, the neighbours whose joined piece scores best (the leftmost of equals). Its result is
the one sequence of pieces in which every piece re-merges to itself and every two neighbours stay apart when merged
together. So an encoder need not merge whole texts: it takes the longest piece that matches (Aho-Corasick), checks it
against the piece before by re-merging these two alone, takes a shorter one where they are incompatible, and steps back
where none is left, marking the position as failed in a bitfield, so that no position is tried twice.

Characters without a piece are pieces of their own while merging and become bytes in the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.textblocks import in_batches

MARK = "▁"
#: Chunks, and pairs of pieces, that a worker remembers for one task; about 60 MB in all.
CACHE_CHUNKS = 200_000
CACHE_CHARS = 64
WINDOW = 4096
#: Latin letters, and everything else.
LETTER, OTHER = r"[A-Za-z\u00C0-\u024F]", r"[^A-Za-z\u00C0-\u024F]"
#: What a text is cut into, and the pieces that would span such cuts.
CUTS = [
    (f"{MARK}*(?:{LETTER}+|(?:(?!{MARK}){OTHER})+)|{MARK}+", f"(?!{MARK}){OTHER}{LETTER}|{LETTER}{OTHER}|[^{MARK}]{MARK}"),
    (f"{MARK}*[^{MARK}]+|{MARK}+", f"[^{MARK}]{MARK}"),
]
ENCODED = "doc_id bigint, ids array<int>, decoded string"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Encoder and decoder for one model file: BPE type with byte fallback and no normalisation but the space mark."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
        self.surface = {i: model.id_to_piece(i) for i in range(size) if not special(i)}
        self.ids = {piece: i for i, piece in self.surface.items()}
        self.scores = {piece: model.get_score(i) for piece, i in self.ids.items()}
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.bytes = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.unknown_id, self.unknown = model.unk_id(), model.decode([model.unk_id()]).encode()
        self.longest = max(map(len, self.ids))
        if len(self.byte_ids) != 256:
            raise ValueError(f"{model_file} has no byte fallback")
        probe = "a  ﬁ  b"
        if model.decode(model.encode(probe)) != probe:
            raise ValueError(f"{model_file} normalises texts; only models that keep them are supported")
        self.spoken = {i: piece.replace(MARK, " ") for i, piece in self.surface.items()}
        #: Texts are cut where no piece can span: before a mark that follows another character and, if the model keeps
        #: letters apart from other characters, between these.
        self.cut = next((re.compile(c) for c, spans in CUTS if not any(re.search(spans, p) for p in self.ids)), None)
        self.whole = ahocorasick.Automaton()
        for piece in self.ids:
            # Others can never come out. Where nothing longer matches, one character is tried without being looked up.
            if len(piece) > 1 and self.history(piece)[0] == [piece]:
                self.whole.add_word(piece, len(piece))
        self.whole.make_automaton()
        #: The next shorter match where a piece matches; 1 stands for a character without a piece too.
        self.shorter = {p: next((n for n in range(len(p) - 1, 0, -1) if p[:n] in self.whole), 1)
                        for p in self.whole if len(p) > 1}
        self.printed = {i: str(i) for i in self.surface}
        self.forget()

    def forget(self) -> None:
        """Drop what a task has remembered: what may follow a piece, and the ids of chunks. Chunks have two generations;
        when the younger one is full, it takes the place of the older one, so frequent chunks stay."""
        self.apart: dict[str, dict[str, int]] = {}
        self.pairs = 0
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.merges: dict[str, list[tuple[float, str, str]]] = {}

    def history(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """The pieces of a short text by merging, best score first, then leftmost; and per merge its score, and what
        was the first and the last part after it."""
        parts, events = list(text), []
        get = self.scores.get
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            events.append((best, parts[0], parts[-1]))
        return parts, events

    def steps(self, piece: str) -> list[tuple[float, str, str]]:
        """The merges of a piece, and a last one that never comes."""
        if piece not in self.merges:
            parts, events = self.history(piece)
            self.merges[piece] = [(0.0, piece[0], piece[-1]), *events, (float("-inf"), "", "")]
            if len(parts) > 1:
                raise ValueError(f"{piece!r} does not merge")
        return self.merges[piece]

    def compatible(self, left: str, right: str) -> bool:
        """Whether these pieces stay as they are when merged together: both are merged again side by side, always the
        better of their next merges, until a merge across the border would come first or both are whole."""
        ours, theirs = self.steps(left), self.steps(right)
        i = j = 0
        while True:
            mine, other = ours[i + 1][0], theirs[j + 1][0]
            across = self.scores.get(ours[i][2] + theirs[j][1])
            if across is not None and across > mine and across >= other:
                return False
            if mine == other == float("-inf"):
                return True
            if mine >= other:
                i += 1
            else:
                j += 1

    def fitting(self, left: str, right: str) -> int:
        """Length of the longest piece that `right` begins with, itself included, and that stays apart from `left`; 0 if
        none does."""
        length, piece = len(right), right
        while length and not self.compatible(left, piece):
            length = self.shorter[piece] if length > 1 else 0
            piece = right[:length]
        if self.pairs >= CACHE_CHUNKS:
            self.apart.clear()
            self.pairs = 0
        self.apart.setdefault(left, {})[right] = length
        self.pairs += 1
        return length

    def longest_matches(self, text: str, start: int) -> list[int]:
        """For WINDOW positions from start: the length of the longest piece that matches there, 1 where none does."""
        size = min(WINDOW, len(text) - start)
        out = [1] * size
        part = text if size == len(text) else text[start:start + WINDOW + self.longest]
        for end, length in self.whole.iter(part):  # by end, so that a longer match at a place comes later
            if (at := end + 1 - length) < size:
                out[at] = length
        return out

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text of any length. Memory: the result, a bit per character, matches of two windows."""
        size, begin = len(text), 0
        found = self.longest_matches(text, 0)
        failed: bytearray | None = None  # a bit per position from which no sequence leads to the end
        apart, shorter, nothing = self.apart, self.shorter, {}
        out: list[str] = []
        at, last, length = 0, "", found[0] if size else 0
        after = nothing  # of each piece, what may follow the last one
        while at < size:
            while length:
                piece = text[at:at + length]
                if last:
                    fits = after.get(piece)
                    if fits is None:
                        fits = self.fitting(last, piece)
                    if fits != length:
                        length, piece = fits, piece[:fits]
                        if not length:
                            break
                end = at + length
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    break
                length = shorter[piece] if length > 1 else 0
            if length:
                out.append(piece)
                at, last = end, piece
                if at == size:
                    break
                after = apart.get(piece, nothing)
                if not begin <= at < begin + WINDOW:
                    begin = at - at % WINDOW
                    found = self.longest_matches(text, begin)
                length = found[at - begin]
                continue
            if not out:
                raise ValueError("no sequence of pieces")
            if failed is None:
                failed = bytearray(size // 8 + 1)
            failed[at >> 3] |= 1 << (at & 7)
            piece = out.pop()
            at -= len(piece)
            last = out[-1] if out else ""
            after = apart.get(last, nothing)
            length = shorter[piece] if len(piece) > 1 else 0
        return out

    def chunks(self, text: str) -> Iterator[str]:
        """A text with its marks, cut where no piece can span."""
        marked = MARK + text.replace(" ", MARK)
        return iter(self.cut.findall(marked) if self.cut else [marked])

    def piece_ids(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.byte_ids[b] for b in piece.encode()]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return [i for chunk in self.chunks(text) for piece in self.pieces(chunk) for i in self.piece_ids(piece)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces with marks as spaces, bytes as UTF-8 (a byte that is none becomes U+FFFD), control
        pieces nothing, and no space for the mark that encoding puts first."""
        text, held = [], b""
        for i in [*ids, -1]:
            if i in self.bytes:
                held += self.bytes[i]
                continue
            if held:
                text.append(utf8(held))
                held = b""
            if i in self.surface:
                piece = self.spoken[i]
                text.append(piece[1:] if not text and piece.startswith(" ") else piece)
            elif i == self.unknown_id:
                text.append(self.unknown.decode())
        return "".join(text)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of the ids joined by commas and of the decoded text. Chunks are encoded once and
        decoded from their ids once; each begins with a piece that holds a mark, so no run of bytes spans two."""
        if not text:
            return 0, sha256(b"").hexdigest(), sha256(b"").hexdigest()
        marked = MARK + text.replace(" ", MARK)
        chunks = self.cut.findall(marked) if self.cut else [marked]
        ids, decoded = list(map(self.known.get, chunks)), {}
        if None in ids:
            for k, found in enumerate(ids):
                if found is None:
                    ids[k], back = self.chunk(chunks[k])
                    if back is not None:
                        decoded[k] = back
        if decoded:
            back = "".join(decoded.get(k, chunk.replace(MARK, " ")) for k, chunk in enumerate(chunks))
        else:
            back = marked.replace(MARK, " ")
        joined = ",".join(ids)
        return joined.count(",") + 1, sha256(joined.encode()).hexdigest(), sha256(back[1:].encode()).hexdigest()

    def chunk(self, chunk: str) -> tuple[str, str | None]:
        """The ids of a chunk joined by commas, and what they decode to unless that is the chunk itself. A chunk is
        remembered only if it is short and decodes to itself."""
        if (entry := self.known.get(chunk)) is not None:
            return entry, None
        if (entry := self.older.get(chunk)) is None:
            pieces = self.pieces(chunk)
            try:
                found = [self.ids[piece] for piece in pieces]
                back = "".join([self.spoken[i] for i in found])
                entry = ",".join([self.printed[i] for i in found])
            except KeyError:  # bytes
                found = [i for piece in pieces for i in self.piece_ids(piece)]
                back = " " * chunk.startswith(MARK) + self.decode(found)
                entry = ",".join(map(str, found))
            if back != chunk.replace(MARK, " "):
                return entry, back
        if len(chunk) <= CACHE_CHARS:
            if len(self.known) >= CACHE_CHUNKS // 2:
                self.older, self.known = self.known, {}
            self.known[chunk] = entry
        return entry, None


def utf8(data: bytes) -> str:
    """Bytes as text; every byte outside a whole UTF-8 character becomes U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at:at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                if n == 4:
                    out.append("�")
                    at += 1
    return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """One codec per worker and model file."""
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    for value in batch.column("text"):
        yield value.as_py() or ""


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids, decoded) of every whole text.

    Rows are independent: nothing is shuffled, each row gives one row, repeated rows repeat. A null or empty text has no
    ids and decodes to the empty text. A null doc_id stays null. Other columns are left out, whatever their names.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            ids = [own.encode(t) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([own.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])
        own.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_batches, work, ENCODED)


def digest_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what `encode_documents` gives, as digests."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            n, ids, decoded = zip(*map(own.digest, _texts(batch)), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                 pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_batches, work, DIGESTS)
