"""Operator 3: SentencePiece BPE encoding and decoding, exact, by backtracking.

A unit (a run of spaces with the word after it) is encoded without running its merges: Aho-Corasick gives
the longest piece at each position, a piece is accepted if re-merging it with the piece before it yields
just these two, and positions from which no encoding goes on are cleared in a bitfield so that they are
never tried again. No piece of a vocabulary that qualifies holds a space mark after another character, and
characters outside the vocabulary never merge, so units are independent and are remembered.

Null text counts as empty (begin and end ids only). Any valid Unicode text of any length has a result;
repeated rows, ties and other columns do not matter, and an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
import struct

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from veilspark.llm.common import held_cache, trim

MARK = "▁"
UNITS_KEPT = 700_000  # units remembered by one worker
TASK_UNITS = 150_000  # units remembered where none outlive a task
PAIRS_KEPT = 300_000


def load_vocabulary(model_file: str) -> dict:
    """Pieces, scores and special ids of a model file, as plain values that can be sent to executors."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(sp.get_piece_size())
    pieces = [sp.id_to_piece(i) for i in ids]
    out = {
        "pieces": pieces,
        "scores": [sp.get_score(i) for i in ids],
        "special": [i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)],
        "bytes": {int(pieces[i][3:5], 16): i for i in ids if sp.is_byte(i)},
        "bos": sp.bos_id(),
        "eos": sp.eos_id(),
        "unk": sp.unk_id(),
    }
    normal = set(ids) - set(out["special"]) - set(out["bytes"].values())
    if any(MARK in pieces[i].lstrip(MARK) for i in normal):
        raise ValueError("a piece holds a space mark after another character: units would not be independent")
    if any("\n" in pieces[i] and len(pieces[i]) > 1 for i in normal):
        raise ValueError("a piece holds a line end beside other characters: units would not be independent")
    if len(out["bytes"]) != 256:
        raise ValueError("the model has no byte fallback")
    return out


#: Characters of the longest unit that is remembered.
UNIT_KEPT = 64


class _Memo(dict):
    """A dictionary that makes missing values, and starts anew when it is full (results do not depend on it)."""

    def __init__(self, make, most: int, longest: int | None = None):
        super().__init__()
        self._make, self._most, self._longest = make, most, longest

    def __missing__(self, key):
        if self._longest and len(key) > self._longest:
            return self._make(key)
        if len(self) >= self._most:
            self.clear()
        value = self[key] = self._make(key)
        return value


class PieceCodec:
    def __init__(self, vocabulary: dict, units_kept: int = UNITS_KEPT):
        skip = set(vocabulary["special"]) | set(vocabulary["bytes"].values())
        self._pieces = vocabulary["pieces"]
        self._ids = {p: i for i, p in enumerate(self._pieces) if i not in skip}
        self._scores = vocabulary["scores"]
        self._bytes = vocabulary["bytes"]
        self._byte_of = {i: b for b, i in self._bytes.items()}
        self._special = set(vocabulary["special"])
        self._unk = vocabulary["unk"]
        self._bos, self._eos = struct.pack("<I", vocabulary["bos"]), struct.pack("<I", vocabulary["eos"])
        self._automaton = ahocorasick.Automaton()
        for p, i in self._ids.items():
            self._automaton.add_word(p, (len(p), i))
        self._automaton.make_automaton()
        self._known = {p for p in self._ids if len(p) == 1}
        self._shorter = _Memo(self._shorter_of, len(self._pieces) + 1)
        self._pair = _Memo(self._pair_holds, PAIRS_KEPT)
        self._unit = _Memo(self._encode_unit, units_kept, UNIT_KEPT)
        self._plain = [b"" if i in self._special else p.replace(MARK, " ").encode("utf-8") for i, p in enumerate(self._pieces)]
        for b, i in self._bytes.items():
            self._plain[i] = bytes([b])
        self._cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")

    def _shorter_of(self, i: int) -> int:
        """The longest piece that is a proper prefix of piece i, or -1."""
        p = self._pieces[i]
        return next((self._ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self._ids), -1)

    def merge(self, text: str) -> list[str]:
        """The defining procedure: merge the adjacent pair of the best score, leftmost first, to the end."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self._ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self._scores[i] > best):
                    best, at = self._scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair_holds(self, key: int) -> bool:
        a, b = (self._pieces[i] for i in divmod(key, 1 << 20))
        return self.merge(a + b) == [a, b]

    def backtrack(self, run: str) -> list[int]:
        """Piece ids of a run of known characters."""
        n = len(run)
        longest = [-1] * n
        for end, (size, i) in self._automaton.iter(run):
            longest[end - size + 1] = i  # ends come in order, so the longest of a start comes last
        alive = bytearray(b"\xff") * (n // 8 + 1)  # a bit for each position that has not failed
        taken: list[int] = []
        pos, token = 0, longest[0] if n else -1
        pieces, pair = self._pieces, self._pair
        while pos < n or token >= 0:
            while token >= 0:
                end = pos + len(pieces[token])
                if alive[end >> 3] >> (end & 7) & 1 and (not taken or pair[taken[-1] << 20 | token]):
                    break
                token = self._shorter[token]
            if token >= 0:
                taken.append(token)
                pos = end
                if pos == n:
                    break
                token = longest[pos]
            else:
                alive[pos >> 3] &= ~(1 << (pos & 7))
                token = taken.pop()
                pos -= len(pieces[token])
        return taken

    def _encode_unit(self, unit: str) -> bytes:
        if self._known.issuperset(unit):
            whole = self.backtrack(unit)
            return struct.pack(f"<{len(whole)}I", *whole)
        ids: list[int] = []
        run = ""
        for ch in unit:
            if ch in self._known:
                run += ch
                continue
            if run:
                ids += self.backtrack(run)
                run = ""
            ids += [self._bytes[b] for b in ch.encode("utf-8")]
        if run:
            ids += self.backtrack(run)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_units(self, text: str) -> list[bytes]:
        """Little-endian ids of each unit of ``text``, without begin and end."""
        if not text:
            return []
        return list(map(self._unit.__getitem__, self._cut.findall(MARK + text.replace(" ", MARK))))

    def encode(self, text: str | None) -> list[int]:
        raw = self._bos + b"".join(self.encode_units(text or "")) + self._eos
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def _decode_slowly(self, ids: list[int]) -> str:
        out: list[str] = []
        held = bytearray()

        def flush():
            while held:  # as the library does: a valid character, or one replacement for each byte
                for size in range(min(4, len(held)), 0, -1):
                    try:
                        ch = bytes(held[:size]).decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    if len(ch) == 1:
                        out.append(ch)
                        del held[:size]
                        break
                else:
                    out.append("�")
                    del held[:1]

        for i in ids:
            if i in self._byte_of:
                held.append(self._byte_of[i])
                continue
            flush()
            if i == self._unk:
                out.append(" ⁇ ")
            elif i not in self._special:
                out.append(self._pieces[i].replace(MARK, " "))
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of any ids. Where bytes and pieces join to valid text at once, that is the answer."""
        first = next((i for i in ids if i not in self._special), None)
        if first is None:
            return ""
        try:
            if self._unk in ids:
                raise ValueError("the unknown piece has a text of its own")
            text = b"".join(map(self._plain.__getitem__, ids)).decode("utf-8")
        except ValueError:
            text = self._decode_slowly(ids)
        return text[1:] if self._pieces[first].startswith(MARK) else text

    def row(self, text: str) -> tuple[int, str, str, int]:
        units = self.encode_units(text)
        raw = self._bos + b"".join(units) + self._eos
        decoded = self.decode(memoryview(raw).cast("I").tolist()).encode("utf-8")
        return len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest(), len(decoded)


_CODECS: dict[int, PieceCodec] = held_cache({})


def _codec(vocabulary: dict) -> PieceCodec:
    """One codec for a worker's life: what it remembers serves later tasks of this operator too."""
    key = hash(tuple(vocabulary["pieces"]) + tuple(vocabulary["scores"]))
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(vocabulary)
    return _CODECS[key]


def encode_documents(docs: DataFrame, model_file: str, id_column: str = "doc_id", ids: bool = False, remember: bool = True) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, decoded_bytes; with ``ids`` also the ids themselves.

    Row-local: no shuffle. The vocabulary is read on the driver and sent once to each executor. With ``remember``
    a worker keeps its units for later tasks; without, as in a pipeline whose other stages need the room, a task
    keeps fewer and none outlive it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_file))
    id_type = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, decoded_bytes bigint" + ", ids array<int>" * ids

    def run(batches):
        trim()
        codec = _codec(shared.value) if remember else PieceCodec(shared.value, TASK_UNITS)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [codec.row(t) for t in texts]
            cols = [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.string(), pa.string(), pa.int64())))]
            if ids:
                cols.append(pa.array([codec.encode(t) for t in texts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256", "decoded_bytes"] + ["ids"] * ids)

    return docs.select(id_column, "text").mapInArrow(run, schema)
