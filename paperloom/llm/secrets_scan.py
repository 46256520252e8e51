"""Secret scan: fixed patterns, and a randomness test battery with false-discovery control.

Patterns give the base spans (kinds assign, access, hex).  Candidates are the runs of at least MIN_RUN characters of
[A-Za-z0-9+/_=-], what base spans leave of a run to their left and right, and the parts of both between separators:
between "=", then "/" or "-" and "_", then all of them and "+".  So a token is tested on its own, whatever label or path
it is glued to.  A part is reported only where nothing that holds it is.  A candidate's encoding is inferred from its
characters (hex, base32, base36, base64);
over the symbols' values in that encoding a battery asks whether they could be random: chi-squared uniformity of the
alphabet, by symbols and by classes of characters, runs about the alphabet's middle, and serial correlation.  The
p-values combine by Fisher's method.

False discoveries are controlled by decoys, separately for ranges of lengths, as short strings pass the battery more
easily: every document contributes, for each range, its own words strung together to strings of that length, one for
each stretch of 128 letters over its whole length.  Equal decoys count once in the corpus, so a header that many
documents share weighs as one.  Over the whole corpus the least level is taken at which the decoys' pass rate, applied
to the candidates, makes up at most fdr of the candidates that pass; those are added as spans of kind random.  Decoys
are told apart by 56-bit hashes; the counts are tables of LENGTHS x LEVELS cells; nothing else is gathered.

Spans are code points of the whole text, end exclusive.  Null and empty texts have no spans; documents of any length
are read whole; repeated rows give repeated results; only doc_id and text are read.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm._shared import ship_package, stored

MIN_RUN = 20
LENGTHS = (20, 28, 40, 64, 128)  # least length of each range
LEVELS = 40  # levels of the combined p-value, four to a power of ten
KINDS = ("assign", "access", "hex", "random")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_RUN_BYTE = np.zeros(256, bool)
_RUN_BYTE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_LETTER = np.zeros(256, np.uint8)  # lower case, 0 for all that is no letter
_LETTER[65:91] = _LETTER[97:123] = np.arange(97, 123)
_ALPHABETS = {
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz", "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
_VALUES = {k: {c: i for i, c in enumerate(a)} for k, a in _ALPHABETS.items()}
_VALUES["base64"] |= {"-": 62, "_": 63}


def _classes(alphabet: str) -> tuple[list[int], list[float]]:
    """Class of each symbol (digits, upper, lower case; signs count with the digits) and the classes' shares."""
    kinds = ["u" if c.isupper() else "l" if c.islower() else "d" for c in alphabet]
    names = sorted(set(kinds))
    return [names.index(k) for k in kinds], [kinds.count(k) / len(kinds) for k in names]


_CLASSES = {k: _classes(a) for k, a in _ALPHABETS.items()}


def _chi_tail(x: float, df: int) -> float:
    """P(chi-squared >= x): exact for even df, by the cube-root approximation for odd ones."""
    if df == 1:
        return math.erfc(math.sqrt(x / 2))
    if df % 2 == 0:
        term = total = math.exp(-x / 2)
        for i in range(1, df // 2):
            term *= x / 2 / i
            total += term
        return min(total, 1.0)
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer_encoding(s: str) -> tuple[str, list[int]]:
    """The smallest alphabet that holds all characters but the padding, and the values in it."""
    body = s.strip("=-_+/") if s.strip("=-_+/") else s
    for name, values in _VALUES.items():
        try:
            return name, [values[c] for c in body]
        except KeyError:
            continue
    return "base64", [_VALUES["base64"][c] for c in body if c != "="]


def battery(s: str) -> float:
    """Combined p-value of the tests; small for strings that are not random."""
    name, v = infer_encoding(s)
    n, size = len(v), len(_ALPHABETS[name])
    if n < 8:
        return 0.0
    bins = max(2, min(size, n // 4))
    counts = [0] * bins
    for x in v:
        counts[x * bins // size] += 1
    widths = [0] * bins
    for x in range(size):
        widths[x * bins // size] += 1
    uniform = _chi_tail(sum((c - n * w / size) ** 2 / (n * w / size) for c, w in zip(counts, widths, strict=True)), bins - 1)
    classes, share = _CLASSES[name]
    by_class = [0] * len(share)
    for x in v:
        by_class[classes[x]] += 1
    mixed = _chi_tail(sum((c - n * w) ** 2 / (n * w) for c, w in zip(by_class, share, strict=True)), len(share) - 1)
    high = [2 * x >= size for x in v]
    above = sum(high)
    below = n - above
    if above == 0 or below == 0:
        runs = 2.0 ** (1 - n)
    else:
        expected = 1 + 2 * above * below / n
        spread = math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
        seen = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
        runs = math.erfc(abs(seen - expected) / spread / math.sqrt(2))
    mean = sum(v) / n
    power = sum((x - mean) ** 2 for x in v)
    if power == 0:
        serial = 0.0
    else:
        r = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:] + v[:1], strict=True)) / power
        serial = math.erfc(abs(r + 1 / (n - 1)) * math.sqrt(n) / math.sqrt(2))
    logs = sum(math.log(max(p, 1e-300)) for p in (uniform, mixed, runs, serial))
    return _chi_tail(-2 * logs, 8)


def level(p: float) -> int:
    """0: p is 1, LEVELS - 1: p is tiny; monotone."""
    return min(int(-4 * math.log10(max(p, 1e-30))), LEVELS - 1)


def length_range(n: int) -> int:
    return max(i for i, least in enumerate(LENGTHS) if n >= least)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    if not any(w in low for w in _WORDS):
        return []
    return [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]


def run_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Access keys and hex strings lie within the runs; each run is as long as it can be, so no match is cut."""
    out = []
    for a, b in runs:
        out += [("access", a + m.start(), a + m.end()) for m in _ACCESS.finditer(text[a:b]) if len(m[0]) >= 20]
        out += [("hex", a + m.start(), a + m.end()) for m in _HEX.finditer(text[a:b]) if len(m[0]) >= 24]
    return out


def _long_runs(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Text -> byte spans of its long runs."""
    inside = np.concatenate([[False], _RUN_BYTE[data], [False]])
    edge = inside[1:] != inside[:-1]
    cut = np.zeros(len(edge), bool)
    cut[offsets] = True  # a run ends with its text
    at = np.flatnonzero(edge | (cut & inside[1:] & inside[:-1]))
    a, b = at[:-1], at[1:]
    take = (b - a >= MIN_RUN) & inside[a + 1]
    out: dict[int, list[tuple[int, int]]] = {}
    for row, x, y in zip((np.searchsorted(offsets, a[take], side="right") - 1).tolist(), a[take].tolist(), b[take].tolist(), strict=True):
        out.setdefault(row, []).append((x - int(offsets[row]), y - int(offsets[row])))
    return out


def _code_points(raw: bytes, spans: list[tuple[int, int]], ascii_only: bool) -> list[tuple[int, int]]:
    if ascii_only:
        return spans
    starts = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(starts[a]), int(starts[b])) for a, b in spans]


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all texts in lower case, and starts and lengths of stretches of them: each begins with a word (a
    word that is longer than a stretch is cut) and holds at most the last range's least length.  Lower case passes the
    battery most easily, so it makes the control strict."""
    low = _LETTER[data]
    inside = low > 0
    bounds = np.concatenate([[0], np.cumsum(inside)])[offsets].tolist()
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[offsets < len(data)]
    first[at] = inside[at]
    letters, words = low[inside], memoryview(np.flatnonzero(first[inside]))
    starts, lengths, size = [], [], LENGTHS[-1]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        while b - a >= LENGTHS[0]:
            starts.append(a)
            lengths.append(min(b - a, size))
            a += size
            word = bisect_left(words, a)
            following = words[word] if word < len(words) else len(letters)
            a = following if following - a < size else a
    return letters, np.array(starts, np.int64), np.array(lengths, np.int64)


@functools.lru_cache
def _runs_tail(n: int) -> np.ndarray:
    """log of the runs test's p-value, by the number of symbols above the middle and the number of runs."""
    out = np.zeros((n + 1, n + 1))
    for above in range(n + 1):
        below = n - above
        if not above or not below:
            out[above] = math.log(2.0 ** (1 - n))
            continue
        expected = 1 + 2 * above * below / n
        spread = math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
        for seen in range(1, n + 1):
            out[above, seen] = math.log(max(math.erfc(abs(seen - expected) / spread / math.sqrt(2)), 1e-300))
    return out


def decoy_levels(rows: np.ndarray) -> np.ndarray:
    """level(battery()) of strings of lower case letters, all of one length."""
    m, n = rows.shape
    size, v = len(_ALPHABETS["base36"]), rows.astype(np.int64) - 87
    bins = max(2, min(size, n // 4))
    widths = np.bincount(np.arange(size) * bins // size, minlength=bins) * (n / size)
    counts = np.bincount((v * bins // size + np.arange(m)[:, None] * bins).ravel(), minlength=m * bins).reshape(m, bins)
    uniform = np.array([_chi_tail(x, bins - 1) for x in ((counts - widths) ** 2 / widths).sum(axis=1).tolist()])
    classes, share = _CLASSES["base36"]
    lower = [n * (classes[-1] == c) for c in range(len(share))]
    mixed = _chi_tail(sum((c - n * w) ** 2 / (n * w) for c, w in zip(lower, share, strict=True)), len(share) - 1)
    high = 2 * v >= size
    runs = _runs_tail(n)[high.sum(axis=1), 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)]
    total, square = v.sum(axis=1), n * (v * v).sum(axis=1)
    power = square - total * total
    near = n * (v * np.roll(v, -1, axis=1)).sum(axis=1) - total * total
    r = np.abs(near / np.maximum(power, 1) + 1 / (n - 1)) * math.sqrt(n / 2)
    serial = np.array([math.erfc(x) for x in r.tolist()]) * (power > 0)
    logs = np.log(np.maximum(uniform, 1e-300)) + math.log(max(mixed, 1e-300)) + runs + np.log(np.maximum(serial, 1e-300))
    half = -logs
    p = np.minimum(np.exp(-half) * (1 + half + half ** 2 / 2 + half ** 3 / 6), 1.0)
    out = np.minimum((-4 * np.log10(np.maximum(p, 1e-30))).astype(np.int64), LEVELS - 1)
    for i in np.flatnonzero((rows <= ord("f")).all(axis=1)):  # these are hexadecimal
        out[i] = level(battery(rows[i].tobytes().decode()))
    return out


def decoy_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The distinct decoys of some texts: 56 bits of the string's hash, and its cell.  Of each stretch, the first
    letters for each range."""
    letters, starts, lengths = stretches(data, offsets)
    keys = []
    for r, n in enumerate(LENGTHS):
        take = starts[lengths >= n]
        for at in range(0, len(take), 8192):
            rows = np.zeros((len(take[at:at + 8192]), -(-n // 8) * 8), np.uint8)
            rows[:, :n] = letters[take[at:at + 8192, None] + np.arange(n)]
            hashed = np.full(len(rows), r, np.uint64)
            for word in rows.view(np.uint64).T:
                hashed = W.mix(hashed * np.uint64(0x9FB21C651E98DF25) + word)
            hashed, once = np.unique(hashed & ~np.uint64(255), return_index=True)
            keys.append(hashed | (r * LEVELS + decoy_levels(rows[once, :n])).astype(np.uint64))
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def _decoys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = W.text_buffers(batch.column("text"))
        keys = []
        for at in range(0, len(offsets) - 1, 512):
            part = offsets[at:at + 513]
            keys.append(decoy_keys(data[part[0]:part[-1]], part - part[0]))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(keys)).view(np.int64))], ["key"])


#: Each cuts more finely than those before it, but for the third, which stands beside the second.
_CUTS = tuple(re.compile(rf"[^{c}]+") for c in ("=", "=/", "=_-", "=/_+-"))
_SIGNS = "=/_+-"


def free_parts(text: str, run: tuple[int, int], spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What sorted base spans leave of a run, without the signs next to them; the run itself where none touches it."""
    out, (at, b) = [], run
    for _, x, y in spans:
        if y > at and x < b:
            out.append((at, x))
            at = max(at, y)
    out.append((at, b))
    if len(out) == 1:
        return out
    parts = []
    for x, y in out:
        while x < y and x > run[0] and text[x] in _SIGNS:
            x += 1
        while x < y and y < run[1] and text[y - 1] in _SIGNS:
            y -= 1
        parts.append((x, y))
    return [(x, y) for x, y in parts if y - x >= MIN_RUN]


def candidates_of(text: str, a: int, b: int) -> list[tuple[int, int, int, list[int]]]:
    """(start, stop, cell, cells of the candidates that hold it) of text[a:b] and of its parts between separators."""
    cell = lambda x, y: length_range(y - x) * LEVELS + level(battery(text[x:y]))
    out = [(a, b, cell(a, b), [])]
    if not any(c in _SIGNS for c in text[a:b]):
        return out
    body = text[a:b].strip(_SIGNS)
    lead = a + (text.index(body, a, b) - a)
    seen = {(a, b), (lead, lead + len(body))}  # the same symbols as the whole run
    found: list[list[tuple[int, int, int, list[int]]]] = []
    for cut in _CUTS:
        level_parts = []
        for m in cut.finditer(text, a, b):
            x, y = m.span()
            if y - x < MIN_RUN or (x, y) in seen:
                continue
            seen.add((x, y))
            over = [out[0][2]]
            for parts in found:
                i = bisect_right(parts, x, key=lambda p: p[0]) - 1
                if i >= 0 and parts[i][1] >= y:
                    over.append(parts[i][2])
            level_parts.append((x, y, cell(x, y), over))
        found.append(level_parts)
    return out + [p for parts in found for p in parts]


_SPAN = "array<struct<kind:int,start:int,stop:int,cell:int,outer:array<int>>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = W.text_buffers(batch.column("text"))
        rows = []
        runs: dict[int, list[tuple[int, int]]] = {}
        for at in range(0, len(offsets) - 1, 512):
            part = offsets[at:at + 513]
            found = _long_runs(data[part[0]:part[-1]], part - part[0])
            runs |= {at + r: spans for r, spans in found.items()}
        for i, value in enumerate(batch.column("text")):
            text = value.as_py() or ""
            own = _code_points(data[offsets[i]:offsets[i + 1]].tobytes(), runs.get(i, []), text.isascii())
            spans = base_spans(text) + run_spans(text, own)
            cells = [(KINDS.index(k), a, b, -1, []) for k, a, b in spans]
            by_start = sorted(spans, key=lambda s: s[1])
            reach = list(accumulate((s[2] for s in by_start), max))
            for a, b in own:
                touching = by_start[bisect_right(reach, a):bisect_left(by_start, b, key=lambda s: s[1])]
                for x, y in free_parts(text, (a, b), touching):
                    cells += [(KINDS.index("random"), *c) for c in candidates_of(text, x, y)]
            rows.append([{"kind": k, "start": a, "stop": b, "cell": c, "outer": o} for k, a, b, c, o in cells])
        span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("cell", pa.int32()), ("outer", pa.list_(pa.int32()))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(span))], ["doc_id", "spans"])


def pass_levels(candidates: dict[int, int], decoy: dict[int, int], fdr: float) -> list[int]:
    """For each range of lengths the last level that passes; -1: none."""
    out = []
    for r in range(len(LENGTHS)):
        cells = range(r * LEVELS, (r + 1) * LEVELS)
        all_c, all_d = sum(candidates.get(c, 0) for c in cells), sum(decoy.get(c, 0) for c in cells)
        best, c, d = -1, 0, 0
        for lv, cell in enumerate(cells):
            c, d = c + candidates.get(cell, 0), d + decoy.get(cell, 0)
            # one more decoy than seen: no decoys at all are no evidence
            if c and (d + 1) / (all_d + 1) * all_c / c <= fdr:
                best = lv
        out.append(best)
    return out


def scan_secrets(docs: DataFrame, fdr: float = 0.01) -> DataFrame:
    """doc_id, spans(kind, start, stop) by start and kind, for every row."""
    ship_package(docs.sparkSession)
    types = dict(docs.dtypes)["doc_id"]
    found = stored(docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {types}, spans {_SPAN}"), "secret-spans")
    candidates = found.select(F.explode("spans.cell").alias("cell")).where("cell >= 0").groupBy("cell").count()
    decoy = docs.select("text").mapInArrow(_decoys, "key long").distinct()
    decoy = decoy.groupBy(F.col("key").bitwiseAND(255).cast("int").alias("cell")).count()
    last = pass_levels(dict(map(tuple, candidates.collect())), dict(map(tuple, decoy.collect())), fdr)  # at most LENGTHS x LEVELS rows
    limits = F.array(*map(F.lit, last))
    passes = lambda cell: cell % LEVELS <= F.get(limits, (cell / LEVELS).cast("int"))
    real = F.filter("spans", lambda s: (s["cell"] < 0) | (passes(s["cell"]) & ~F.exists(s["outer"], passes)))
    ordered = F.array_sort(F.transform(real, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("k"), s["stop"].alias("stop"))))
    names = F.array(*map(F.lit, KINDS))
    return found.select("doc_id", F.transform(ordered, lambda s: F.struct(F.get(names, s["k"]).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
