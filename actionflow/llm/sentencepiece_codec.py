"""SentencePiece encoding by suffix-array matching, and decoding.

The model here is byte-pair encoding with byte fallback, and that decides what
"relaxing" an edge means. The texts of a batch are cut where no piece can reach
across (before a space that doesn't follow a space, and around characters the model
has no piece for); the distinct chunks are laid end to end. A suffix array of
that text is made by prefix doubling; every piece is binary-searched in it, which
gives the range of its occurrences. These are edges of a lattice, sorted by where
they end and relaxed in that order: an edge is taken if its piece may follow the last
piece of the best path to its start. Merging by priority leaves exactly one such
path: a sequence of pieces is the encoding of its text if and only if each two
neighbours are the encoding of theirs. So each position keeps one last piece, and
walking back from the end gives the ids. Characters without a piece become the ids
of their UTF-8 bytes.

A worker remembers the ids of up to ``MEMO_CHUNKS`` chunks that came out of this (a word
and the space before it, mostly), so a chunk that comes again isn't laid into the text
anew. Most chunks of common prose do come again.

Defined results: a null or empty text has no ids; equal rows get equal ids; texts of
any length are cut up whole, the batch text being filled in blocks of bounded size;
an empty table gives no rows. The model must be a byte-pair encoding with a piece for
each byte that puts a space before a text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actionflow.llm.rawtext import U, mix
from actionflow.llm.scratch import picked

SPACE = "▁"
BLOCK_CHARS = 400_000
BATCH_BYTES = 8 << 20  # of texts that are encoded together
PAIR_PLACES = 1 << 21
MEMO_CHUNKS, MEMO_CHARS = 150_000, 24  # chunks of earlier batches that a worker remembers


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """The pieces of a BPE model and which two of them may stand next to each other."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)  # reads the file; its encoder isn't used
        size = library.get_piece_size()
        self.text = [library.id_to_piece(i) for i in range(size)]
        self.byte_id = {int(self.text[i][3:5], 16): i for i in range(size) if library.is_byte(i)}
        if len(self.byte_id) != 256 or library.encode("a", out_type=str)[:1] not in (["▁a"], ["▁"]):
            raise ValueError("the model must have a piece for each byte and put a space before a text")
        self.silent = frozenset(i for i in range(size) if library.is_control(i))
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.spoken = [None if i in self.byte_of else "" if i in self.silent else t.replace(SPACE, " ") for i, t in enumerate(self.text)]
        plain = [i for i in range(size) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))]
        self.rank = {self.text[i]: -library.get_score(i) for i in plain}
        self.id_of = {self.text[i]: i for i in plain}
        self.letters = frozenset("".join(self.id_of))
        self.whole = {p for p in self.id_of if self.merge(p) == [p]}  # the others are never made by merging
        ordered = sorted(self.whole)
        self.pieces = ordered
        self.longest = max(map(len, ordered))
        assert not any(SPACE in p.lstrip(SPACE) for p in ordered), "a piece reaches over a space: chunks would cut it"
        self.piece_ids = np.array([self.id_of[p] for p in ordered])
        self.lengths = np.array([len(p) for p in ordered])
        self.table = np.zeros((len(ordered), self.longest), np.int64)
        for i, p in enumerate(ordered):
            self.table[i, : len(p)] = [ord(c) for c in p]
        self.pair_key = np.full(PAIR_PLACES, (1 << 64) - 1, np.uint64)
        self.pair_answer = np.zeros(PAIR_PLACES, bool)
        self.memo: dict[str, list[int]] = {}
        self.outside = re.compile(f"[^{re.escape(''.join(sorted(self.letters)))}]")

    def merge(self, text: str) -> list[str]:
        """Encoding by its definition: the best adjacent pair is merged until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pieces a and b (indexes into ``pieces``) are the encoding of their text.

        Answers are kept in a table with a place for each hash; one that is pushed out
        is worked out again when it is asked for.
        """
        key = (a.astype(np.uint64) << U(32)) | b.astype(np.uint64)
        place = (mix(key) & U(PAIR_PLACES - 1)).astype(np.int64)
        hit = self.pair_key[place] == key
        out = self.pair_answer[place]
        if not hit.all():
            miss = np.flatnonzero(~hit)
            new, back = np.unique(key[miss], return_inverse=True)
            pieces, merge = self.pieces, self.merge
            left, right = (new >> U(32)).tolist(), (new & U(0xFFFFFFFF)).tolist()
            answer = np.fromiter((merge(pieces[x] + pieces[y]) == [pieces[x], pieces[y]] for x, y in zip(left, right, strict=True)), bool, len(new))
            out[miss] = answer[back]
            place = (mix(new) & U(PAIR_PLACES - 1)).astype(np.int64)
            self.pair_key[place], self.pair_answer[place] = new, answer
            wrong = self.pair_key[place] != new  # two new ones of one place: numpy keeps the last
            self.pair_answer[place[~wrong]] = answer[~wrong]
        return out


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the first ``depth`` codes from them on, by prefix doubling. Codes are over 0."""
    n = len(codes)
    rank = codes.astype(np.int64)
    reach = 1
    while True:
        after = np.zeros(n, np.int64)
        if reach < n:
            after[: n - reach] = rank[reach:]
        key = rank * (int(rank.max(initial=0)) + 1) + after if reach > 1 or n == 0 else rank * (1 << 21) + after
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        sorted_key = key[order]
        new[order] = np.cumsum(np.concatenate([[1], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)])) if n else 0
        rank, reach = new, reach * 2
        if reach >= depth or n == 0 or rank.max() == n:
            return order


def occurrences(codes: np.ndarray, order: np.ndarray, table: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, piece) of every place where a piece stands: all pieces are binary-searched together, code by code."""
    n, count = len(codes), len(table)
    low, high = np.zeros(count, np.int64), np.full(count, n, np.int64)
    padded = np.concatenate([codes.astype(np.int64), np.zeros(int(sizes.max()) + 1, np.int64)])

    def bound(which: np.ndarray, depth: int, upper: bool) -> np.ndarray:
        lo, hi, want = low[which].copy(), high[which].copy(), table[which, depth]
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            here = padded[order[np.minimum(mid, n - 1)] + depth]
            go = open_ & ((here <= want) if upper else (here < want))
            lo = np.where(go, mid + 1, lo)
            hi = np.where(open_ & ~go, mid, hi)
        return lo

    for depth in range(table.shape[1]):
        which = np.flatnonzero((sizes > depth) & (low < high))
        if not len(which):
            break
        first, last = bound(which, depth, False), bound(which, depth, True)
        low[which], high[which] = first, last
    many = np.maximum(high - low, 0)
    which = np.repeat(np.arange(count), many)
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return order[np.repeat(low, many) + within], which


def encode_chunks(m: Model, chunks: list[str]) -> list[list[int]]:
    """The ids of each chunk; chunks have only letters of the model."""
    out: list[list[int]] = []
    block: list[str] = []
    size = 0
    for c in [*chunks, None]:
        if c is None or (block and size + len(c) > BLOCK_CHARS):
            out += _encode_block(m, block) if block else []
            block, size = [], 0
        if c is not None:
            block.append(c)
            size += len(c) + 1
    return out


def _encode_block(m: Model, chunks: list[str]) -> list[list[int]]:
    text = "\x01".join(chunks)  # no piece has the separator, so no edge crosses it
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    start, piece = occurrences(codes, suffix_array(codes, m.longest), m.table, m.lengths)
    sizes = np.array([len(c) for c in chunks])
    first = np.cumsum(sizes + 1) - sizes - 1
    own = np.repeat(np.arange(len(chunks)), sizes + 1)[start]  # the chunk of an edge
    end = start + m.lengths[piece]
    offset = end - first[own]
    by_end = np.argsort((offset << 32) | start)
    start, end, piece, offset, head = start[by_end], end[by_end], piece[by_end], offset[by_end], first[own[by_end]]
    last = np.full(len(text) + 1, -1, np.int64)
    level = np.searchsorted(offset, np.arange(1, int(sizes.max()) + 2))
    for a, b in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):  # all edges that end so far into their chunks
        s, e, p = start[a:b], end[a:b], piece[a:b]
        ok = s == head[a:b]  # a piece from the start on is the encoding of itself
        later = np.flatnonzero(~ok)
        if len(later):
            q = last[s[later]]
            ok[later] = (q >= 0) & m.follow(np.maximum(q, 0), p[later])
        last[e[ok]] = p[ok]
    return _walked_back(m, last, first, first + sizes)


def _walked_back(m: Model, last: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[list[int]]:
    """The ids of each chunk, from its end back to its start; one step for all chunks at a time while they are many."""
    at, live = end.copy(), np.arange(len(end))
    owners, pieces = [], []
    while len(live) > 64:
        p = last[at[live]]
        owners.append(live)
        pieces.append(p)
        at[live] -= m.lengths[p]
        live = live[at[live] > first[live]]
    size, rest = m.lengths, []
    for c in live.tolist():  # the few that are long
        here, start = int(at[c]), int(first[c])
        while here > start:
            p = int(last[here])
            rest.append((c, p))
            here -= int(size[p])
    if rest:
        own, p = np.array(rest).T
        owners.append(own)
        pieces.append(p)
    own, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, pieces))
    order = np.argsort(own, kind="stable")[::-1]  # chunks from the last on, each in reading order
    ids = m.piece_ids[p[order]].tolist()
    many = np.bincount(own, minlength=len(end))[::-1].tolist()
    out, k = [], 0
    for n in many:
        out.append(ids[k : k + n])
        k += n
    return out[::-1]


class _Numbers(dict):
    """Numbers chunks as they are asked for."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


def encode_batch(m: Model, texts: list[str | None]) -> list[np.ndarray]:
    """The ids of every text of a batch. A space is put before a text, as the model was made with."""
    cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    number = _Numbers()
    numbered = number.__getitem__
    rows: list[list[int]] = []
    strange: dict[int, list[int]] = {}
    for t in texts:
        row: list[int] = []
        if t:
            t = SPACE + t.replace(" ", SPACE)
            at = 0
            for hit in m.outside.finditer(t):
                row += map(numbered, cut.findall(t[at : hit.start()]))
                k = number["\0" + hit[0]]
                strange[k] = [m.byte_id[b] for b in hit[0].encode()]
                row.append(k)
                at = hit.end()
            row += map(numbered, cut.findall(t[at:] if at else t))
        rows.append(row)
    done: list[list[int]] = [m.memo.get(c) for c in number]  # type: ignore[misc]
    todo = [c for c, k in number.items() if done[k] is None and k not in strange]
    for c, ids in zip(todo, encode_chunks(m, todo), strict=True):
        done[number[c]] = ids
        if len(m.memo) < MEMO_CHUNKS and len(c) <= MEMO_CHARS:
            m.memo[c] = ids
    for k, ids in strange.items():
        done[k] = ids
    size = np.fromiter(map(len, done), np.int64, len(done))
    flat = np.fromiter(chain.from_iterable(done), np.int32, int(size.sum()))
    at = np.cumsum(size) - size
    out = []
    for row in rows:
        r = np.array(row, np.int64)
        n = size[r] if len(r) else np.zeros(0, np.int64)
        take = np.repeat(at[r] - (np.cumsum(n) - n), n) + np.arange(n.sum()) if len(r) else np.zeros(0, np.int64)
        out.append(flat[take])
    return out


def decode_one(m: Model, ids: list[int]) -> str:
    """Pieces joined, byte ids as UTF-8 (what is no UTF-8 becomes the replacement sign, byte by byte), the leading space dropped."""
    spoken = m.spoken
    try:
        return "".join(map(spoken.__getitem__, ids)).removeprefix(" ")
    except TypeError:  # there are byte ids among them
        pass
    out: list[str] = []
    held = bytearray()

    def flush() -> None:
        while held:
            try:
                out.append(held.decode())
                held.clear()
            except UnicodeDecodeError as e:
                out.append(held[: e.start].decode() + "\ufffd")
                del held[: e.start + 1]

    for i in ids:
        piece = spoken[i]
        if piece is None:
            held.append(m.byte_of[i])
            continue
        if held:
            flush()
        out.append(piece)
    flush()
    return "".join(out).removeprefix(" ")


def encoded(text: Column, path: str | None = None) -> Column:
    """array<int> of a text's ids."""
    path = path or default_model()

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(text: pa.Array) -> pa.Array:
        found = encode_batch(model(path), text.to_pylist())
        sizes = np.array([0] + [len(x) for x in found])
        flat = np.concatenate(found) if found else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(flat))

    return ids(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    path = path or default_model()

    @F.arrow_udf(T.StringType())
    def text(ids: pa.Array) -> pa.Array:
        m = model(path)
        return pa.array([decode_one(m, x or []) for x in ids.to_pylist()], pa.string())

    return text(ids)


def gathered(batches: Iterator[pa.RecordBatch], column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches joined until a column of theirs has about ``most`` bytes: what comes together shares its chunks."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit ids) and if decoding gives the text back."""
    path = path or default_model()
    read = picked(docs, doc_id=doc_id, text=text)
    kind = T.StructType([read.schema["doc_id"], T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in gathered(batches, 1):
            n, crc, same = [], [], []
            texts = batch.column(1).to_pylist()
            for t, ids in zip(texts, encode_batch(m, texts), strict=True):
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<i4").tobytes()))
                same.append(decode_one(m, ids.tolist()) == (t or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], kind.names)

    return read.mapInArrow(digest, kind)
