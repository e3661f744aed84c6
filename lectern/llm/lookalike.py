"""One form for texts that look the same but differ in their characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.fragments import bytes_of, slices

#: Letters of other scripts that are drawn like a Latin letter.
LOOKALIKES = {
    # Cyrillic capitals and small letters
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y",
    # Greek capitals and small letters
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    # other letters and signs
    "ı": "i", "ɡ": "g", "ɑ": "a", "ո": "n", "ս": "u", "օ": "o", "հ": "h", "µ": "μ", "Ω": "Ω", "ʼ": "'",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "‐": "-", "‑": "-", "−": "-", "﹣": "-", "⁃": "-",
}

#: Format characters that are drawn after all (signs of Arabic and other numbers, marks of annotations).
DRAWN = [*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, *range(0xFFF9, 0xFFFC), 0x110BD, 0x110CD]

#: Characters that are not drawn at all: format characters, variation selectors, tags, fillers of syllables.
UNSEEN = sorted(
    {c for c in (*range(0x80, 0x20000), *range(0xE0000, 0xE0200)) if unicodedata.category(chr(c)) == "Cf" and not 0x13430 <= c <= 0x1345F}.difference(DRAWN)
    | {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
)

#: Letters between which a zero-width non-joiner is seen, since they would join (Arabic, Syriac, N'Ko, Mongolian, scripts of India), and those between which a joiner is.
BOUND = "\u0900-\u0dff"
JOINED = "\u0620-\u064a\u066e-\u06d3\u06fa-\u06ff\u0710-\u074f\u0750-\u077f\u07ca-\u07ea\u08a0-\u08c9\u1820-\u1878" + BOUND

#: Compatibility forms that look the same as the plain letters; superscripts, fractions and the like do not.
SAME_FORMS = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")

TOP = 0x110000


def _ranges(listed: str) -> list[tuple[int, int]]:
    return [(ord(a), ord(b)) for a, b in zip(listed[::3], listed[2::3])]


def _within(points: np.ndarray, listed: str) -> np.ndarray:
    out = np.zeros(len(points), dtype=bool)
    for a, b in _ranges(listed):
        out |= (points >= a) & (points <= b)
    return out


_UNSEEN = frozenset(UNSEEN)


def _expansion(c: int, seen: frozenset[int] = frozenset()) -> list[int]:
    """The characters to which ``c`` is opened: canonical parts, plain forms, look-alikes."""
    char = chr(c)
    if c in _UNSEEN:
        return []
    if unicodedata.category(char) == "Zs":
        return [0x20]
    if char in LOOKALIKES and c not in seen:
        return [x for y in LOOKALIKES[char] for x in _expansion(ord(y), seen | {c})]
    parts = unicodedata.decomposition(char).split()
    if not parts or (parts[0][0] == "<" and parts[0] not in SAME_FORMS and not (0xFB00 <= c <= 0xFB06 or 0x2160 <= c <= 0x217F)):
        return [c]
    return [x for p in parts[parts[0][0] == "<" :] for x in _expansion(int(p, 16), seen | {c})]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lookup tables by code point, from Python's Unicode data: length, start and content of expansions; combining class; pairs that compose and what they give."""
    length, flat, change = np.ones(TOP, dtype=np.int64), [], []
    order = np.zeros(TOP, dtype=np.uint8)
    pairs: dict[int, int] = {}
    for c in (*range(0x30000), *range(0xE0000, 0xE0200)):  # nothing else is opened or composes
        if 0xAC00 <= c <= 0xD7A3:  # Hangul syllables stay composed
            continue
        char = chr(c)
        order[c] = unicodedata.combining(char)
        if c >= 0x80 and (e := _expansion(c)) != [c]:
            length[c] = len(e)
            change.append((c, e))
        d = unicodedata.decomposition(char)
        if d and d[0] != "<" and len(p := [int(x, 16) for x in d.split()]) == 2 and unicodedata.normalize("NFC", char) == char:
            pairs[p[0] << 21 | p[1]] = c
    start = np.zeros(TOP, dtype=np.int64)
    start[:] = -1
    for c, e in change:
        start[c] = len(flat)
        flat += e
    keys = np.array(sorted(pairs), dtype=np.int64)
    return length, start, np.array(flat, dtype=np.uint32), order, keys, np.array([pairs[k] for k in keys.tolist()], dtype=np.uint32)


def normal_points(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one form of the rows that lie in ``points`` (code points) between the offsets ``rows``."""
    length, start, flat, order, keys, composed = _tables()
    safe = np.where(points < TOP, points, 0).astype(np.int64)
    each = np.where(points < TOP, length[safe], 1)
    if (joiner := (points == 0x200C) | (points == 0x200D)).any():
        at = np.flatnonzero(joiner)
        at = at[(at > 0) & (at < len(points) - 1)]
        at = at[~np.isin(at, rows) & ~np.isin(at + 1, rows)]
        free = np.where(points[at] == 0x200C, _within(points[at - 1], JOINED) & _within(points[at + 1], JOINED), _within(points[at - 1], BOUND) & _within(points[at + 1], BOUND))
        drawn = at[free]
        each[drawn] = 1
    else:
        drawn = np.zeros(0, dtype=np.int64)
    each[(points == 0x0D) & (np.append(points[1:], 0) == 0x0A)] = 0  # a line end of two characters looks like one of one
    run = np.concatenate([[0], np.cumsum(each)])
    origin = np.repeat(np.arange(len(points)), each)
    within = np.arange(run[-1]) - np.repeat(run[:-1], each)
    out, first = points[origin].copy(), start[safe][origin]
    opened = (first >= 0) & (points[origin] < TOP) & ~np.isin(origin, drawn)
    out[opened] = flat[first[opened] + within[opened]]
    out[out == 0x0D] = 0x0A
    rows = run[rows]

    rank = np.where(out < TOP, order[np.where(out < TOP, out, 0)], 0)
    marked = rank > 0
    if marked.any():
        head = ~marked
        head[rows[rows < len(out)]] = True
        cluster = np.cumsum(head)
        if len(at := np.flatnonzero(marked[1:] & marked[:-1] & (rank[1:] < rank[:-1]) & (cluster[1:] == cluster[:-1]))):
            whole = np.flatnonzero(np.isin(cluster, cluster[at]))
            out[whole] = out[whole][np.lexsort((whole, rank[whole], cluster[whole]))]
            rank = np.where(out < TOP, order[np.where(out < TOP, out, 0)], 0)
            marked = rank > 0
        out, rows = _compose_marks(out, rows, np.flatnonzero(marked), rank, cluster, keys, composed)
    return _compose_starters(out, rows, keys, composed)


def _found(a: np.ndarray, b: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each pair stands among the pairs that compose, and whether it does."""
    key = a.astype(np.int64) << 21 | b.astype(np.int64)
    where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return where, keys[where] == key


def _compose_marks(out: np.ndarray, rows: np.ndarray, at: np.ndarray, rank: np.ndarray, cluster: np.ndarray, keys: np.ndarray, composed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compose marks with the character they stand on: the first mark of every cluster at once, then the second, and so on.

    A mark that stays blocks later ones of its own class, as in canonical composition.
    """
    heads = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]]))
    base = heads[cluster[at] - cluster[0]]
    turn, keep = at - base, np.ones(len(out), dtype=bool)
    last = np.zeros(len(heads), dtype=np.int64)
    for k in range(int(turn.min()) if len(turn) else 1, int(turn.max()) + 1 if len(turn) else 1):
        now = at[turn == k]
        own, on = cluster[now] - cluster[0], base[turn == k]
        where, hit = _found(out[on], out[now], keys)
        hit &= (rank[now] > last[own]) & (on != now)
        out[on[hit]] = composed[where[hit]]
        keep[now[hit]] = False
        last[own[~hit]] = rank[now[~hit]]
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[rows]


def _compose_starters(out: np.ndarray, rows: np.ndarray, keys: np.ndarray, composed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compose neighbours that are no marks: vowel signs of some scripts, and Hangul letters into syllables."""
    for _ in range(2):
        if len(out) < 2:
            break
        a, b = out[:-1].astype(np.int64), out[1:].astype(np.int64)
        lead = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        tail = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        wide = (b >= 0x9BE) & (b < 0x12000) & ~lead & ~tail
        where, hit = _found(np.where(wide, a, 0), np.where(wide, b, 0), keys)
        made = np.where(lead, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, np.where(tail, a + b - 0x11A7, composed[where]))
        can = lead | tail | (hit & wide)
        can[rows[(rows > 0) & (rows < len(out))] - 1] = False
        at = np.flatnonzero(can)
        if not len(at):
            break
        at = at[np.concatenate([[True], np.diff(at) > 1])]
        out = out.copy()
        out[at] = made[at]
        keep = np.ones(len(out), dtype=bool)
        keep[at + 1] = False
        out, rows = out[keep], np.concatenate([[0], np.cumsum(keep)])[rows]
    return out, rows


def normal_array(text: pa.Array) -> pa.Array:
    """The one form of every text of an Arrow array; nulls stay null.

    The column's bytes are decoded to code points in one call, changed by
    table lookups and written back in one call; no row is touched by itself.
    """
    parts = []
    for piece in slices(text):
        offsets, data = bytes_of(piece)
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        points, rows = normal_points(np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32), begins)
        body = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        ends = np.concatenate([[0], np.cumsum(width)])[rows].astype(np.int32)
        made = pa.Array.from_buffers(pa.string(), len(piece), [None, pa.py_buffer(ends), pa.py_buffer(body)])
        parts.append(made if not piece.null_count else pa.compute.if_else(piece.is_null(), pa.scalar(None, pa.string()), made))
    return pa.concat_arrays(parts) if parts else pa.array([], type=pa.string())


def one_form(df: DataFrame, columns: list[str], suffix: str = "_form") -> DataFrame:
    """``df`` with the one form of each named column beside it. Narrow.

    Two texts have equal forms exactly when they look equal: full-width and
    presentation forms and Latin ligatures become plain letters, every kind of
    single space a space, undrawn characters go, look-alike letters of other
    scripts become Latin, marks are composed, line ends are ``\\n``. Case,
    accents, raised digits and the number of spaces stay. Nulls stay null,
    empty texts empty; a column of the name ``<column><suffix>`` is replaced.
    """
    rest = df.drop(*[c + suffix for c in columns])
    schema = rest.select("*", *[F.col(c).alias(c + suffix) for c in columns]).schema
    at, names = [rest.columns.index(c) for c in columns], schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *[normal_array(b.column(i)) for i in at]], names=names)

    return rest.mapInArrow(run, schema)


def not_literal(text: str, part: str) -> Column:
    """Whether ``part`` is no literal part of ``text``; false where either is null."""
    return F.coalesce(~F.contains(text, part), F.lit(False))


def disguised_excerpts(df: DataFrame, keys: list[str], text: str, excerpt: str) -> DataFrame:
    """``keys`` of the rows whose excerpt is no literal part of the text but looks like a part of it.

    Literal containment is tested in the JVM on every row; only rows that fail
    it are brought to one form, and the comparison of the forms is again a JVM
    expression. Rows that are open need no Python unless they fail the first
    test. Null texts or excerpts and excerpts in which nothing is drawn make
    no case.
    """
    open_rows = df.select(*keys, F.col(text).alias("_text"), F.col(excerpt).alias("_part")).filter(not_literal("_text", "_part"))
    seen = one_form(open_rows, ["_text", "_part"])
    return seen.filter((F.trim("_part_form") != "") & F.contains("_text_form", "_part_form")).select(*keys)
