"""SentencePiece BPE encoding by backtracking, and decoding.

A text is cut where no piece can cross: before a run of word marks, and around characters that no piece holds.  Each part is
encoded by trying, from the left, the longest piece (Aho-Corasick) and its shorter prefixes; a piece may follow
another only if re-merging the two gives just those two; positions from which nothing fits are remembered in a
bitfield.  A part's ids do not depend on its neighbours, so parts are kept in a bounded table per worker.

Pieces made only of word marks often share one score below all others; the leftmost then wins at each step, which pair
checks cannot express.  Such runs are merged last, by direct simulation, exactly as the library does.

Nulls count as empty text.  Texts of any length are read whole; repeated rows give equal rows; an empty table gives none; other columns
travel along, but for those of the names that ``encode`` and ``decode`` add.  The vocabulary file's path is a parameter; its bytes (of fixed size) go to the workers.
"""

import heapq
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
KEPT_PARTS, KEPT_CHARS, KEPT_PAIRS = 250_000, 64, 600_000
_MODELS: dict = {}


class PieceModel:
    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        self.bytes_at, self.id, self.score = {}, {}, {}
        self.surface: list[bytes] = [b""] * n
        self.byte_of = [-1] * n
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_at[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
                self.surface[i] = bytes([int(p[3:5], 16)])
            elif sp.is_unknown(i):
                self.unknown = i
                self.surface[i] = " ⁇ ".encode()
            elif not sp.is_control(i):
                self.id[p], self.score[p] = i, sp.get_score(i)
                self.surface[i] = p.replace(MARK, " ").encode()
        self.piece = {i: p for p, i in self.id.items()}
        self.length = {i: len(p) for p, i in self.id.items()}
        chars = {c for p in self.id for c in p}
        self.single = {c for c in chars if c in self.id}
        if chars - self.single:
            raise ValueError("a piece holds a character that is no piece of its own")
        marks = [s for p, s in self.score.items() if len(p) > 1 and set(p) == {MARK}]
        rest = [s for p, s in self.score.items() if len(p) > 1 and set(p) != {MARK}]
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has a word mark after other characters")
        if len(set(rest)) < len(rest) or (marks and rest and max(marks) >= min(rest)):
            raise ValueError("scores tie outside the runs of word marks")
        self.lines = "\n" not in chars
        self.parts = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        # only pieces that their own characters merge to can occur; runs of marks are handled apart
        usable = {p: i for p, i in self.id.items() if len(p) == 1 or set(p) != {MARK} and self.merged(p) == [p]}
        self.find = ahocorasick.Automaton()
        for p, i in usable.items():
            self.find.add_word(p, (i, len(p)))
        self.find.make_automaton()
        self.shorter_of = {i: next((usable[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in usable), -1) for p, i in usable.items()}
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}  # two generations, so that frequent parts stay
        self.older: dict[str, bytes] = {}
        # a string of a known text maps to known characters, everything else goes by bytes
        self.known = re.compile("[" + re.escape("".join(sorted(self.single))) + "]+")

    def merged(self, text: str) -> list[str]:
        """Best score first, the leftmost of equals: what training's merges give."""
        part, nxt, prev = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap = []

        def offer(i: int) -> None:
            j = nxt[i] if i >= 0 else len(part)
            if i >= 0 and j < len(part) and (s := self.score.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, len(part[i]) + len(part[j]), j))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, size, j = heapq.heappop(heap)
            if not part[i] or j >= len(part) or not part[j] or nxt[i] != j or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = ""
            nxt[i] = nxt[j]
            if nxt[i] < len(part):
                prev[nxt[i]] = i
            offer(i)
            offer(prev[i])
        return [p for p in part if p]

    def fits(self, a: int, b: int) -> bool:
        """True if b may follow a (a < 0: if it may come first): re-merging both gives both again."""
        ok = a < 0 or self.merged(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]]
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[(a + 1) * 1_000_003 + b] = ok
        return ok

    def backtrack(self, text: str) -> list[int]:
        """Longest pieces first.  ``longest`` is filled from the automaton's matches, ``failed`` is the bitfield."""
        pairs, fits, length, less = self.pairs, self.fits, self.length, self.shorter_of
        longest = [0] * len(text)
        for end, (i, k) in self.find.iter(text):  # at one start, later ends are longer
            longest[end - k + 1] = i
        out: list[int] = []
        pos, failed, n, token, last = 0, 0, len(text), longest[0], -1
        while pos < n:
            while True:
                end = pos + length[token]
                if not failed >> end & 1:
                    ok = pairs.get((last + 1) * 1_000_003 + token)
                    if ok or ok is None and fits(last, token):
                        out.append(token)
                        pos, last = end, token
                        if pos < n:
                            token = longest[pos]
                        break
                token = less[token]
                if token < 0:
                    failed |= 1 << pos
                    token = out.pop()
                    pos -= length[token]
                    last = out[-1] if out else -1
                    break
        return out

    def _tail(self, text: str) -> list[int]:
        """Known characters by backtracking, others by their bytes."""
        if self.known.fullmatch(text):
            return self.backtrack(text)
        out: list[int] = []
        at = 0
        for m in self.known.finditer(text):
            out += [self.bytes_at[b] for b in text[at : m.start()].encode()] + self.backtrack(m[0])
            at = m.end()
        return out + [self.bytes_at[b] for b in text[at:].encode()]

    def part_ids(self, part: str) -> list[int]:
        rest = part.lstrip(MARK)
        marks = len(part) - len(rest)
        if not marks:
            return self._tail(part)
        if not rest:
            return [self.id[p] for p in self.merged(part)]
        tail = self._tail(MARK + rest)
        if marks == 1:
            return tail
        if tail[0] == self.id[MARK]:
            return [self.id[p] for p in self.merged(MARK * marks)] + tail[1:]
        return [self.id[p] for p in self.merged(MARK * (marks - 1))] + tail

    def _encode_part(self, part: str) -> bytes:
        got = self.older.get(part)
        if got is None:
            ids = self.part_ids(part)
            got = struct.pack(f"<{len(ids)}i", *ids)
        if len(part) <= KEPT_CHARS:
            if len(self.kept) >= KEPT_PARTS:
                self.older, self.kept = self.kept, {}
            self.kept[part] = got
        return got

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian 32-bit numbers."""
        if not text:
            return b""
        parts = self.parts.findall(MARK + text.replace(" ", MARK)) if self.lines else [MARK + text.replace(" ", MARK)]
        make = self._encode_part
        return b"".join([self.kept.get(p) or make(p) for p in parts])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<i4").tolist()

    def decode(self, ids) -> str:
        """Pieces joined, word marks as spaces, without the leading one; bytes that are no UTF-8 become U+FFFD each."""
        surface = self.surface
        raw = b"".join([surface[i] for i in ids])
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_slowly(ids)
        first = next((i for i in ids if surface[i]), None)
        return text[1:] if first is not None and self.byte_of[first] < 0 and self.piece.get(first, "").startswith(MARK) else text

    def _decode_slowly(self, ids) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + k]).decode())
                        at += k
                        break
                    except UnicodeDecodeError:
                        if k == 4 or at + k >= len(run):
                            out.append("�")
                            at += 1
                            break
            run.clear()

        for i in ids:
            if self.byte_of[i] >= 0:
                run.append(self.byte_of[i])
            else:
                flush()
                out.append(self.surface[i].decode())
        flush()
        return "".join(out)


def model_of(proto: bytes) -> PieceModel:
    """One model per worker process."""
    key = hash(proto)
    if key not in _MODELS:
        _MODELS[key] = PieceModel(proto)
    return _MODELS[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """Adds ``piece_ids array<int>`` and, if asked for, ``piece_text string`` (the ids decoded again) to ``docs``.

    Columns of these names that ``docs`` already has are replaced.  No shuffle: a scan and one Arrow pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(path))
    docs = docs.drop("piece_ids", "piece_text")
    schema = docs.select("*", F.lit(None).cast("array<int>").alias("piece_ids"), *([F.lit("").alias("piece_text")] if decoded else [])).schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):  # bounds what is held beside the batch itself
                batch = whole.slice(lo, 256)
                got = [model.encode_bytes(t.as_py()) for t in batch.column(at)]
                ends = np.cumsum([0, *(len(g) // 4 for g in got)], dtype=np.int32)
                ids = np.frombuffer(b"".join(got), dtype="<i4")
                cols = [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
                if decoded:
                    cols.append(pa.array([model.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "piece_ids") -> DataFrame:
    """Adds ``piece_text`` for a column of ids; null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(read_model(path))
    rows = rows.drop("piece_text")
    schema = rows.select("*", F.lit(None).cast("string").alias("piece_text")).schema
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        for b in batches:
            text = pa.array([None if x is None else model.decode(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """The digest columns of encoded documents, inside the JVM."""
    ids = F.col("piece_ids")
    return encoded.select(
        "doc_id", F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("piece_text").cast("binary"), 256).alias("decoded_sha256"),
    )
