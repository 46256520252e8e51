"""Byte-level BPE encoding and decoding.

Encoding does not replay the merges.  Per piece of text an Aho-Corasick automaton over the vocabulary gives the longest
token that starts at each byte; tokens are then laid end to end, and a token may follow another only if the pair is
compatible, i.e. if merging the two tokens' bytes by the merge list would give this very pair.  An incompatible token
falls back to its next shorter prefix token; where none is left, the walk steps back and marks the position as dead.
Each position dies at most once, so the walk is linear in the piece, and the result equals the merges exactly.
Pieces that are not known yet are encoded together: one run of the automaton over all of them, then one step of the walk
for all at once.
Decoding gathers byte ranges of one vocabulary blob by an offset table.

Rows: a null text counts as empty and gives an empty id list; an empty text likewise.  Null id lists decode to the
empty text, ids outside the vocabulary to nothing, invalid UTF-8 to U+FFFD.  Other columns, also repeated rows, pass
through untouched; the output column replaces one of the same name.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm._shared import ship_package

PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{l}{n}]+|\s+(?!\S)|\s+"
#: The classes as far as Latin-1 goes; the standard library's engine is several times faster on them.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
LATIN_PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
#: Bounds of the per-process memos; a full memo starts anew.
MEMO_PIECES, MEMO_PAIRS, MEMO_LEN = 600_000, 400_000, 64
#: Characters of texts that are split at once, and of unknown pieces that are encoded at once.
SPLIT_CHARS, BULK_CHARS = 2_000_000, 1_000_000


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-in character of each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _newer_characters() -> str:
    """Letters and numbers of the regex library that the running Unicode table does not assign yet."""
    kind = regex.compile(r"\p{L}|\p{N}")
    return "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and kind.match(c))


def load_vocabulary(path: str) -> dict:
    """Tables of a byte-level BPE file as plain values, bounded by the vocabulary: bytes, merges, special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
        raise ValueError(f"{path}: a byte-level BPE file without a prefix space is needed")
    alphabet = _byte_alphabet()
    size = 1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
    tokens = [b""] * size
    for text, i in model["vocab"].items():
        tokens[i] = bytes(alphabet[c] for c in text)
    merges = []
    for pair in model["merges"]:
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((model["vocab"][left], model["vocab"][right], model["vocab"][left + right]))
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for text, i in special.items():
        tokens[i] = text.encode()
    return {"tokens": tokens, "merges": merges, "special": special, "newer": _newer_characters()}


class Codec:
    """Encoder and decoder over the tables of one vocabulary; built once per worker process."""

    def __init__(self, tables: dict):
        self.tokens, self.special = tables["tokens"], tables["special"]
        size = len(self.tokens)
        self.size = size
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.pairs: dict[int, int] = {}
        for rank, (left, right, made) in enumerate(tables["merges"]):
            self.left[made], self.right[made], self.rank[made] = left, right, rank
            self.pairs[left * size + right] = rank
        special = set(self.special.values())
        self.ids = {t: i for i, t in enumerate(self.tokens) if t and i not in special}
        self.compatible: dict[int, bool] = {}
        # A token counts only if its own last merge is what the merge list makes of its bytes.
        for made in [i for t, i in self.ids.items() if len(t) > 1]:
            if self.left[made] < 0 or not self._reachable(made):
                del self.ids[self.tokens[made]]
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.shorter[i] = next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), -1)
            if len(t) > 1:  # what is longer than a byte
                self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.byte_ids = [self.ids.get(bytes([b]), -1) for b in range(256)] + [-1]  # and for the mark between pieces
        self.byte_id = np.array(self.byte_ids, np.int64)
        self.by_bytes = {t.decode("latin-1"): i for t, i in self.ids.items()}
        self.length = [len(t) for t in self.tokens]
        self.pair_keys, self.pair_ok = np.full(1, -1, np.int64), np.ones(1, bool)
        self.lengths, self.shorter_of = np.array(self.length, np.int64), np.array(self.shorter, np.int64)
        plain = PIECES.format(L=r"\p{L}", N=r"\p{N}", l=r"\p{L}", n=r"\p{N}")
        self.pieces = regex.compile(plain).findall
        newer = f"[{regex.escape(tables['newer'])}]" if tables["newer"] else ""
        self.newer = frozenset(tables["newer"])
        self.exact_pieces = regex.compile("(?V1)" + PIECES.format(
            L=rf"[\p{{L}}--{newer}]", N=rf"[\p{{N}}--{newer}]", l=rf"[\p{{L}}--{newer}]", n=rf"[\p{{N}}--{newer}]")
        ).findall if newer else self.pieces
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")").split if marks else None
        self.memo = _Memo(self)
        lengths = np.array(self.length, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)

    def _reachable(self, made: int) -> bool:
        return self.fits(self.left[made], self.right[made], self.rank[made])

    def fits(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether the merges of a's and b's bytes leave the boundary between them: undo the latest merge on either
        side again and again and see whether the pair that stood there then would have been merged before it.
        below: only merges before this rank count (for the pair that is itself a merge)."""
        limit = len(self.pairs) if below is None else below
        while True:
            rank = self.pairs.get(a * self.size + b)
            if rank is not None and rank < limit:
                return False
            if self.rank[a] > self.rank[b]:
                limit, a = min(limit, self.rank[a]), self.right[a]  # the left one merged earlier in a tie
            elif self.rank[b] >= 0:
                limit, b = min(limit, self.rank[b] + 1), self.left[b]
            else:
                return True

    def _judge(self, a: int, b: int) -> bool:
        if len(self.compatible) >= MEMO_PAIRS:
            self.compatible.clear()
        known = self.compatible[a * self.size + b] = self.fits(a, b)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        s = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")  # one character for each byte
        whole = self.by_bytes.get(s)
        if whole is not None:
            return [whole]
        n = len(s)
        longest = [*map(self.byte_ids.__getitem__, s.encode("latin-1")), -1]
        size, length, shorter, judged = self.size, self.length, self.shorter, self.compatible.get
        for end, token in self.automaton.iter(s):
            longest[end + 1 - length[token]] = token  # later ends come later: the longest stays
        alive = bytearray(b"\1" * (n + 1))
        out: list[int] = []
        pos, token, last = 0, longest[0], -1
        while pos < n:
            while token >= 0:
                end = pos + length[token]
                if alive[end]:
                    fits = last < 0 or judged(last * size + token)
                    if fits is None:
                        fits = self._judge(last, token)
                    if fits:
                        out.append(token)
                        pos, last, token = end, token, longest[end]
                        break
                token = shorter[token]
            else:
                alive[pos] = 0
                token = out.pop()
                pos -= length[token]
                last = out[-1] if out else -1
        return out

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of many pairs, each new one judged once; a = -1 stands for the start of a piece."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        known = (self.pair_keys[at] == keys) | (a < 0)
        if not known.all():
            new = np.unique(keys[~known])
            ok = np.array([self.fits(*divmod(k, self.size)) for k in new.tolist()], bool)
            if len(self.pair_keys) > MEMO_PAIRS:
                self.pair_keys, self.pair_ok = self.pair_keys[:1], self.pair_ok[:1]
            every = np.concatenate([self.pair_keys, new])
            order = np.argsort(every, kind="stable")
            self.pair_keys, self.pair_ok = every[order], np.concatenate([self.pair_ok, ok])[order]
            if len(new) < len(keys):  # some were known before, and may have been dropped
                return self._compatible(a, b)
            at = np.searchsorted(self.pair_keys, keys)
        return self.pair_ok[np.minimum(at, len(self.pair_keys) - 1)] | (a < 0)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of non-empty pieces: `encode_piece` for all of them, a step of every walk at a time."""
        raw = [p if p.isascii() else p.encode("utf-8").decode("latin-1") for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        joined = "\u0100".join(raw)  # no token holds it
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        token = found[:, 1]
        longest = np.append(self.byte_id[np.frombuffer(joined.encode("utf-16-le"), np.uint16)], -1)
        longest[found[:, 0] + 1 - self.lengths[token]] = token  # later ends come later: the longest stays
        ends = np.cumsum(sizes + 1) - 1
        came = np.full(len(joined) + 1, -1, np.int64)  # the token of the walk that ends at a position
        alive = np.ones(len(joined) + 1, bool)
        pos, stop = ends - sizes, ends
        token = longest[pos]
        while len(pos):
            to = pos + self.lengths[token]
            fits = alive[to]
            fits[fits] = self._compatible(came[pos[fits]], token[fits])
            came[to[fits]] = token[fits]
            pos, token = np.where(fits, to, pos), np.where(fits, longest[to], self.shorter_of[token])
            open_ = pos < stop
            pos, token, stop = pos[open_], token[open_], stop[open_]
            while (stuck := np.flatnonzero(token < 0)).size:  # step back, and never come here again
                alive[pos[stuck]] = False
                undone = came[pos[stuck]]
                pos[stuck] -= self.lengths[undone]
                token[stuck] = self.shorter_of[undone]
        owners, ids, left, pos = [], [], np.arange(len(raw)), ends.copy()
        while len(left):
            token = came[pos]
            owners.append(left)
            ids.append(token)
            pos = pos - self.lengths[token]
            more = pos > (ends - sizes)[left]
            left, pos = left[more], pos[more]
        owner, flat = np.concatenate(owners)[::-1], np.concatenate(ids)[::-1]  # last tokens came first
        order = np.argsort(owner, kind="stable")
        packed = flat[order].astype(np.int32).tobytes()
        at = (np.searchsorted(owner[order], np.arange(len(raw) + 1)) * 4).tolist()
        return [packed[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the pieces of some texts at a time are looked up together."""
        out, row = [], 0
        while row < len(texts):
            stop, chars = row, 0
            while stop < len(texts) and (stop == row or chars + len(texts[stop]) <= SPLIT_CHARS):
                chars += len(texts[stop])
                stop += 1
            plain = [not (self.special and any(s in t for s in self.special)) for t in texts[row:stop]]
            split = [self._cut(t)(t) if p else [] for t, p in zip(texts[row:stop], plain, strict=True)]
            known = [list(map(self.memo.get, s)) for s in split]
            gaps = [[n for n, packed in enumerate(k) if packed is None] for k in known]
            self.memo.learn({s[n] for s, g in zip(split, gaps, strict=True) for n in g})
            for s, k, g in zip(split, known, gaps, strict=True):
                for n in g:
                    k[n] = self.memo[s[n]]
            out += [np.frombuffer(b"".join(k), np.int32) if p else self.encode(t) for t, k, p in zip(texts[row:stop], known, plain, strict=True)]
            row = stop
        return out

    def encode(self, text: str) -> np.ndarray:
        memo = self.memo.__getitem__
        if self.special and any(s in text for s in self.special):
            parts = [np.array([self.special[p]], np.int32).tobytes() if p in self.special else self._encode_plain(p, memo)
                     for p in self.marks(text) if p]
            return np.frombuffer(b"".join(parts), np.int32)
        return np.frombuffer(self._encode_plain(text, memo), np.int32)

    def _encode_plain(self, text: str, memo) -> bytes:
        return b"".join(map(memo, self._cut(text)(text)))

    def _cut(self, text: str):
        """The splitter for this text: both Unicode tables agree on Latin-1, elsewhere on most characters."""
        try:
            text.encode("latin-1")
            return LATIN_PIECES
        except UnicodeEncodeError:
            return self.pieces if self.newer.isdisjoint(text) else self.exact_pieces

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < self.size)]
        if not len(ids):
            return ""
        first = self.offsets[ids]
        lengths = self.offsets[ids + 1] - first
        ends = np.cumsum(lengths)
        at = np.repeat(first - ends + lengths, lengths) + np.arange(ends[-1])
        return self.blob[at].tobytes().decode("utf-8", "replace")


class _Memo(dict):
    """Piece -> packed ids; bounded."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def learn(self, pieces: set[str]) -> None:
        """Takes in those of the pieces that are short; a full memo is emptied first."""
        if len(self) >= MEMO_PIECES:
            self.clear()
        new, chars = [], 0
        for piece in pieces:
            if len(piece) <= MEMO_LEN:
                new.append(piece)
                chars += len(piece)
                if chars >= BULK_CHARS:
                    self.update(zip(new, self.codec.encode_pieces(new), strict=True))
                    new, chars = [], 0
        if new:
            self.update(zip(new, self.codec.encode_pieces(new), strict=True))

    def __missing__(self, piece: str) -> bytes:
        packed = array("i", self.codec.encode_piece(piece)).tobytes()
        if len(piece) <= MEMO_LEN and len(self) < 2 * MEMO_PIECES:
            self[piece] = packed
        return packed


_CODECS: dict[str, Codec] = {}


class Tokenizer:
    """A vocabulary on the cluster: the tables travel once per executor; their size is that of the vocabulary file."""

    def __init__(self, spark: SparkSession, path: str):
        ship_package(spark)
        tables = load_vocabulary(path)
        key = hashlib.sha256(repr(sorted(tables.items())).encode()).hexdigest()
        shared = spark.sparkContext.broadcast(tables)

        def codec() -> Codec:
            if key not in _CODECS:
                _CODECS.clear()
                _CODECS[key] = Codec(shared.value)
            return _CODECS[key]

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            coder = codec()
            rows = coder.encode_texts([t or "" for t in texts.to_pylist()])
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))

        @F.arrow_udf("string")
        def decode(ids: pa.Array) -> pa.Array:
            coder = codec()
            return pa.array([coder.decode(np.asarray(row.values.fill_null(-1)).astype(np.int64)) if row.is_valid else "" for row in ids], pa.string())

        self._encode, self._decode = encode, decode

    def encode(self, texts: str | Column) -> Column:
        return self._encode(texts)

    def decode(self, ids: str | Column) -> Column:
        return self._decode(ids)


def encode_texts(df: DataFrame, tokenizer: Tokenizer, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Adds the token ids of each whole text."""
    return df.withColumn(out, tokenizer.encode(F.col(f"`{text}`")))


def decode_ids(df: DataFrame, tokenizer: Tokenizer, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds the text that each id list stands for."""
    return df.withColumn(out, tokenizer.decode(F.col(f"`{ids}`")))


def round_trip_digests(df: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """doc_id, number of ids, SHA-256 of the decimal ids joined by commas and of the decoded text."""
    rows = encode_texts(df.select("doc_id", F.col(f"`{text}`").alias("text")), tokenizer)
    rows = decode_ids(rows.select("doc_id", "token_ids"), tokenizer)
    return rows.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
