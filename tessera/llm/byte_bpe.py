"""Byte-level BPE encoding and decoding, with pre-tokenisation by a scan instead of a regular expression.

A text becomes an array of codepoint classes (with the little look-ahead that the pattern has folded into the class).
Each class is a transition function of a small automaton; functions compose associatively, so a block's transitions
are combined first, the few block results are scanned, and every block is then walked from its own start state.
All of it are table look-ups on whole arrays: the functions that can arise are numbered once (a transition
monoid), with a composition table. Boundaries fall where the automaton says so; the slices of UTF-8 between them
are merged pair by pair, lowest rank first, with a bounded cache, and their offsets are kept for decoding.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tessera.llm.common import chunks, map_arrow, utf8

# Classes of codepoints, and what look-ahead turns them into.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, JOINED, LAST, SPACE = range(8)
# States: at a boundary, in letters, in numbers, in others, after a joined space, in space, contraction with 1 or 2 letters left.
EDGE, IN_L, IN_N, IN_O, IN_J, IN_S, LEFT1, LEFT2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a token begins at this character)."""
    if symbol == SPACE:
        return IN_S, state != IN_S
    if symbol == LAST:  # the last of a run of white space before something else, unless it is ' '
        return EDGE, True
    if symbol == JOINED:  # a ' ' before something else belongs to that
        return IN_J, True
    if symbol == LETTER:
        if state == LEFT2:
            return LEFT1, False
        return (EDGE, False) if state == LEFT1 else (IN_L, state not in (IN_L, IN_J))
    if symbol == NUMBER:
        return IN_N, state not in (IN_N, IN_J)
    if symbol == OTHER or state in (IN_O, IN_J):
        return IN_O, state not in (IN_O, IN_J)
    return (LEFT1 if symbol == QUOTE1 else LEFT2), True


@lru_cache(maxsize=1)
def monoid():
    """(functions, index of each symbol's function, composition table, whether a token begins by [state, symbol]).
    Symbols 8-15 are the classes at the start of a document: they forget the state before."""
    n = 8
    generators = [tuple(_step(s, c)[0] for s in range(n)) for c in range(n)] + [(_step(EDGE, c)[0],) * n for c in range(n)]
    functions = {tuple(range(n)): 0}
    work = [tuple(range(n))]
    while work:
        f = work.pop()
        for g in generators:
            if (h := tuple(g[x] for x in f)) not in functions:
                functions[h] = len(functions)
                work.append(h)
    table = np.array(list(functions), np.uint8)
    compose = np.zeros((len(table), 256), np.uint8)
    for f, i in functions.items():
        for g, j in functions.items():
            compose[i, j] = functions[tuple(g[x] for x in f)]
    begins = np.array([[_step(s, c)[1] for c in range(n)] + [True] * n for s in range(n)])
    return table, np.array([functions[g] for g in generators], np.uint8), compose, begins


# Letters and digits of Unicode 16.0 (the version of the pattern's definition) that tables of 15.1 lack.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_DIGITS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
# Codepoints of Unicode's White_Space property.
WHITE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every codepoint: letters (L*), numbers (N*), white space, others."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(cp))[0], OTHER) for cp in range(0x110000)], np.uint8)
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_DIGITS), (SPACE, WHITE)):
        for low, high in ranges:
            out[low : high + 1] = kind
    return out


def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """classes() as runs (where each begins, its class): made by the driver and sent with each task, so that all
    executors agree whatever their Python."""
    kinds = classes()
    begin = np.concatenate([[0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1])
    return begin, kinds[begin]


def symbols(cps: np.ndarray, first: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
    """Symbols 0-15 of the codepoints of documents that begin at `first`."""
    kind = (classes() if kinds is None else kinds)[cps]
    n = len(kind)
    starts = np.zeros(n + 1, bool)
    starts[first] = True
    starts[n] = True
    space = kind == SPACE
    out = kind.copy()
    before = np.zeros(n, bool)  # white space with something else right after it in the same document
    before[:-1] = space[:-1] & ~space[1:] & ~starts[1:n]
    out[before] = np.where(cps[before] == 0x20, JOINED, LAST)
    quote = np.flatnonzero(cps == 0x27)
    if len(quote):
        padded = np.concatenate([cps, np.zeros(2, cps.dtype)])
        a, b = padded[quote + 1], padded[quote + 2]
        one = ~starts[quote + 1]
        two = one & ~starts[np.minimum(quote + 2, n)]
        single = np.isin(a, [ord(c) for c in "stmd"])
        double = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        out[quote[two & double]] = QUOTE2
        out[quote[one & single]] = QUOTE1
    out[first] += 8
    return out


def boundaries(symbol: np.ndarray, width: int = 256) -> np.ndarray:
    """Whether a token begins at each character: combine within blocks, scan the blocks, walk each from its state."""
    table, of, compose, begins = monoid()
    n = len(symbol)
    if not n:
        return np.zeros(0, bool)
    rows = -(-n // width)
    grid = np.zeros((rows, width), np.uint8)
    grid.ravel()[:n] = symbol
    grid = np.ascontiguousarray(grid.T)  # one row per step
    acc = np.zeros(rows, np.uint8)
    for step in grid:
        acc = compose[acc, of[step]]
    shift, scan = 1, acc.copy()
    while shift < rows:  # inclusive scan of the blocks' functions by doubling
        scan[shift:] = compose[scan[:-shift], scan[shift:]]
        shift *= 2
    state = np.concatenate([[EDGE], table[scan[:-1], EDGE]]).astype(np.uint8)
    nexts = table[of].T.copy()  # [state, symbol]
    out = np.empty((width, rows), bool)
    for i, step in enumerate(grid):
        out[i] = begins[state, step]
        state = nexts[state, step]
    return out.T.ravel()[:n]


class Vocabulary:
    """Ranks of a tiktoken file; encodes batches of texts and decodes ids."""

    def __init__(self, lines: bytes, cache: int = 200_000):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)}
        self.limit, self.kinds = cache, None  # the classes of codepoints, once the driver's are there
        size = max(self.ranks.values()) + 1
        self.token = [b""] * size
        for k, v in self.ranks.items():
            self.token[v] = k
        self.token_len = np.array([len(t) for t in self.token], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_raw = np.frombuffer(b"".join(self.token), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.piece: dict[bytes, int] = {}
        self.flat, self.begin, self.size = array("q"), array("q"), array("q")  # ids of all cached pieces

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the lowest-ranked adjacent pair merges first, the leftmost of equals."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))  # a part is piece[i:right[i]]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, i, end = heapq.heappop(heap)
            if gone[i] or (j := right[i]) >= n or gone[j] or right[j] != end:
                continue
            right[i] = end
            gone[j] = 1
            if end < n:
                left[end] = i
                if (r := ranks.get(piece[i : right[end]])) is not None:
                    heapq.heappush(heap, (r, i, right[end]))
            if (p := left[i]) >= 0 and (r := ranks.get(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : right[i]]])
            i = right[i]
        return out

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents raw[at[i]:at[i+1]] (UTF-8), one after the other, and their n + 1 offsets."""
        data = raw.tobytes()
        cps = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)  # the byte at which each codepoint starts
        first = np.searchsorted(lead, at[:-1][at[:-1] < at[1:]])
        starts = lead[boundaries(symbols(cps, first, self.kinds))] if len(cps) else np.zeros(0, np.int64)
        if len(self.piece) > self.limit:
            self.clear()
        piece = self.piece
        edges = starts.tolist()
        slices = [data[a:b] for a, b in zip(edges, [*edges[1:], len(data)], strict=True)] if edges else []
        found = [piece.get(s, -1) for s in slices]
        for i, k in enumerate(found):
            if k < 0:
                if (s := slices[i]) not in piece:
                    piece[s] = len(self.size)
                    self.begin.append(len(self.flat))
                    self.flat.extend(merged := self.merge(s))
                    self.size.append(len(merged))
                found[i] = piece[s]
        nth = np.array(found, np.int64)
        if not len(nth):
            return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        flat, begin, size = (np.frombuffer(x, np.int64) for x in (self.flat, self.begin, self.size))
        out = gather(flat, begin[nth], size[nth])
        before = np.concatenate([[0], np.cumsum(size[nth])])
        return out, before[np.searchsorted(starts, at)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, one document after the other, and the documents' n + 1 offsets."""
        lens = self.token_len[ids]
        before = np.concatenate([[0], np.cumsum(lens)])
        return gather(self.token_raw, self.token_at[ids], lens), before[at]


def gather(flat: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[begin[0]:begin[0]+lens[0]], flat[begin[1]:...], ... in one array."""
    shift = begin - (np.cumsum(lens) - lens)
    return flat[np.repeat(shift, lens) + np.arange(int(lens.sum()))]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path] = Vocabulary(f.read())
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _encode(path: str, digest: bool):
    begin, kinds = class_runs()

    def run(batches):
        import pyarrow as pa

        vocab = vocabulary(path)
        if vocab.kinds is None:
            vocab.kinds = np.repeat(kinds, np.diff(np.concatenate([begin, [0x110000]])))
        for batch in batches:
            raw, at = utf8(batch.column(1))
            for lo, hi, part, offsets in chunks(raw, at):
                ids, ends = vocab.encode(part, offsets)
                docs = batch.column(0).slice(lo, hi - lo)
                if not digest:
                    yield pa.RecordBatch.from_arrays([docs, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])
                    continue
                back, edges = vocab.decode(ids, ends)
                packed, plain = ids.astype("<u4").tobytes(), back.tobytes()
                sha = [hashlib.sha256(packed[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                own = [hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([docs, pa.array(np.diff(ends)), pa.array(sha), pa.array(own)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _decode(path: str):
    def run(batches):
        import pyarrow as pa

        vocab = vocabulary(path)
        for batch in batches:
            texts = [b"".join(vocab.token[i] for i in ids or ()).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: the tokens of each whole text of docs (doc_id, text). Null and empty texts have none; repeated rows
    give repeated results; special tokens aren't recognised; other columns of docs, whatever their names, are left out;
    an empty table gives an empty result. path: a vocabulary file that every executor has."""
    return map_arrow(docs.select("doc_id", "text"), _encode(path or default_path(), False), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of tokens (doc_id, ids); the inverse of encode."""
    return map_arrow(tokens.select("doc_id", "ids"), _decode(path or default_path()), "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs; rules as for encode."""
    return map_arrow(docs.select("doc_id", "text"), _encode(path or default_path(), True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
