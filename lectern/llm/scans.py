"""Noise in text from scanned pages: which items carry it, and the text without it.

Lines are labelled by a hidden Markov model over the sequence of a page's
lines (body, body that ends in a broken word, running header, page number)
with layout features as observations; misread words are found against the
words of the texts that were not scanned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.fragments import slices
from lectern.operators.ordering import neighbours, number, running
from lectern.session import cut_lineage

BODY, BREAK, HEADER, NUMBER = range(4)

#: A hyphen, soft hyphen or not sign on the last letter of a line, one space allowed around it, before a line that goes on in small letters.
BROKEN = r"(?<=\p{L}) ?[-‐­¬] ?\n(?=\p{Ll})"
_ENDS_BROKEN = r"\p{L} ?[-‐­¬] ?$"

#: Words that name a page, and signs around a page number.
_NUMBER = r"^[\s\-–—·.\[(|*]*(?:page|pag|seite|página|pág|p|s|صفحة)?[\s.]*(\p{Nd}{1,5}|[ivxlc]{1,7})(?:\s*(?:/|of|de|von|sur)\s*\p{Nd}{1,5})?[\s\-–—·.\])|*]*$"
_ROMANS = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx"]

#: What a recogniser writes (left) for what stands on the page (right).
CONFUSIONS = [
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("h", "li"),
    ("g", "q"), ("q", "g"), ("vv", "w"), ("w", "vv"), ("9", "g"), ("9", "q"), ("5", "s"), ("1", "l"), ("1", "i"), ("6", "b"), ("6", "é"), ("8", "b"), ("3", "e"), ("0", "o"), ("@", "a"), ("4", "a"), ("7", "t"), ("2", "z"),
    ("!", "i"), ("|", "i"), ("!", "l"), ("|", "l"), ("l", "i"), ("i", "l"), ("l", "t"), ("o", "a"), ("a", "o"), ("b", "h"), ("h", "b"), ("u", "n"), ("n", "u"), ("ni", "m"), ("in", "m"), ("nn", "m"), ("m", "nn"), ("ß", "b"), ("b", "ß"), ("$", "s"), ("€", "e"),
]

#: A word is misread if it has so many characters at least and a reading that occurs so often and so many times as often.
LEAST_LENGTH, LEAST_USES, TIMES = 5, 5, 20

#: Places of a page that are labelled in one go, and those lent from either side, which carry the state in and out.
SEGMENT, MARGIN = 64, 16

_T, _N, _H, _P, _B = 2, 3, 2, 4, 4
SYMBOLS = _T * _N * _H * _P * _B


@dataclass(frozen=True)
class Model:
    """Log probabilities of a hidden Markov model with four states."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pseudo-counts of starts, moves and emissions from layout alone, before any text is seen."""
    features = {  # title match | number form: none, other, the page's | broken end | place in the item: inside, top, bottom, alone | height on the page: unknown, top, bottom, between
        BODY: ([0.999, 0.001], [0.998, 0.0018, 0.0002], [0.999, 0.001], [0.5, 0.2, 0.2, 0.1], [0.4, 0.1, 0.1, 0.4]),
        BREAK: ([0.999, 0.001], [0.999, 0.0005, 0.0005], [0.0005, 0.9995], [0.6, 0.3, 0.05, 0.05], [0.4, 0.1, 0.1, 0.4]),
        HEADER: ([0.002, 0.998], [0.98, 0.01, 0.01], [0.99, 0.01], [0.02, 0.48, 0.02, 0.48], [0.4, 0.3, 0.1, 0.2]),
        NUMBER: ([0.99, 0.01], [0.0001, 0.0499, 0.95], [0.999, 0.001], [0.02, 0.04, 0.47, 0.47], [0.4, 0.1, 0.3, 0.2]),
    }
    emit = np.zeros((4, SYMBOLS))
    for s, (t, n, h, p, b) in features.items():
        emit[s] = np.einsum("t,n,h,p,b->bphnt", t, n, h, p, b).reshape(-1)
    start = np.array([0.55, 0.05, 0.35, 0.05])
    move = np.array([[0.80, 0.15, 0.01, 0.04], [0.80, 0.19, 0.002, 0.008], [0.80, 0.15, 0.01, 0.04], [0.50, 0.05, 0.35, 0.10]])
    return start, move, emit


def _model(counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Model:
    log = lambda a: np.log(np.maximum(a / a.sum(-1, keepdims=True), 1e-12))
    return Model(*map(log, counts))


def viterbi(model: Model, rows: list[np.ndarray]) -> list[np.ndarray]:
    """The likeliest states of each sequence of symbols; all sequences advance together."""
    lengths = np.array([len(r) for r in rows])
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(rows)
    alive = np.flatnonzero(lengths)
    for part in np.array_split(alive[np.argsort(lengths[alive], kind="stable")], max(1, len(alive) // 256)):
        if not len(part):
            continue
        width, n = int(lengths[part].max()), lengths[part]
        seen = np.zeros((len(part), width), dtype=np.int64)
        for k, i in enumerate(part):
            seen[k, : lengths[i]] = rows[i]
        score = model.start + model.emit.T[seen[:, 0]]
        back = np.tile(np.arange(4), (len(part), width, 1))
        for j in range(1, width):
            path = score[:, :, None] + model.move
            best = path.argmax(1)
            on = n > j
            score[on] = path.max(1)[on] + model.emit.T[seen[on, j]]
            back[on, j] = best[on]
        state = score.argmax(1)
        labels = np.zeros((len(part), width), dtype=np.int32)
        for j in range(width - 1, -1, -1):
            labels[:, j] = state
            on = n > j
            state = np.where(on, back[np.arange(len(part)), j, state], state)
        for k, i in enumerate(part):
            out[i] = labels[k, : lengths[i]]
    return out


def _letters(x: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), r"[^\p{L}]+", "")


def page_lines(items: DataFrame, titles: DataFrame) -> DataFrame:
    """``document_id, origin, page, segment, items, symbols, lead, core``: the lines of each page with the symbol of each.

    ``items``: ``document_id, item_id, page, place, text`` (one row per item),
    and, where they are known, ``origin`` (items of different origin are
    different sequences) and ``top`` (distance from the page's upper edge);
    ``titles``: ``document_id, title``. A page is labelled by segments of
    ``SEGMENT`` places, so no group grows with a document; each is lent the
    ``MARGIN`` places before and after it, whose labels are dropped again:
    ``lead`` symbols stand before the segment's own ``core`` ones, and the state
    is carried through them. Items without a place are sequences of their own.
    The words "title" and "page number" are tested by letters only, so case,
    spacing and a number beside the title do not matter; a title may have one
    letter in ten misread. ``top`` is held against the greatest of the
    document: the upper and the lower tenth of it are the edges of a page.
    """
    for name, kind in (("origin", "string"), ("top", "double")):
        items = items if name in items.columns else items.withColumn(name, F.lit(None).cast(kind))
    lines = F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")
    own = items.filter("text is not null").select("document_id", "origin", "item_id", "page", "place", "top", "text")
    heights = own.filter("top is not null").groupBy("document_id").agg(F.max("top").alias("height"))
    i = own.join(titles.select("document_id", "title"), "document_id", "left").join(heights, "document_id", "left").withColumns({"lines": lines, "head": _letters(F.col("title"))})
    band = F.when(F.col("top").isNull() | (F.col("height") <= 0), 0).when(F.col("top") <= 0.1 * F.col("height"), 1).when(F.col("top") >= 0.9 * F.col("height"), 2).otherwise(3)

    def symbol(x: Column, at: Column) -> Column:
        own, last = _letters(x), F.size("lines") - 1
        near = F.col("head").isNotNull() & (F.length("head") >= 6) & (F.abs(F.length(own) - F.length("head")) <= 1 + F.length("head") / 10)
        title = (F.coalesce(F.col("page"), F.lit(0)) > 1) & near & ((own == F.col("head")) | (F.levenshtein(own, F.col("head")) <= F.length("head") / 10))
        value = F.regexp_extract(F.lower(F.trim(x)), _NUMBER, 1)
        roman = F.array_position(F.array(*[F.lit(r) for r in _ROMANS]), value)
        number = F.when(value == "", 0).when(F.coalesce(F.try_to_number(value, F.lit("99999")).cast("int"), roman.cast("int")) == F.col("page"), 2).when(value.rlike(r"^\p{Nd}+$") | (roman > 0), 1).otherwise(0)
        broken = x.rlike(_ENDS_BROKEN) & (at < last) & F.get(F.col("lines"), at + 1).rlike(r"^\p{Ll}")
        place = F.when(last == 0, 3).when(at == 0, 1).when(at == last, 2).otherwise(0)
        bit = lambda c: F.coalesce(c, F.lit(False)).cast("int")
        return (bit(title) + number * _T + bit(broken) * _T * _N + place * _T * _N * _H + F.col("band") * _T * _N * _H * _P).cast("int")

    home, inside = F.floor(F.col("place") / SEGMENT), F.pmod("place", F.lit(SEGMENT))
    homes = F.array_compact(F.array(home, F.when(inside < MARGIN, home - 1), F.when(inside >= SEGMENT - MARGIN, home + 1)))
    lent = F.when(F.col("place").isNull(), F.array(F.struct(F.concat(F.lit("item "), "item_id").alias("segment"), F.lit(0).alias("side")))).otherwise(F.transform(homes, lambda h: F.struct(h.cast("string").alias("segment"), F.signum(home - h).cast("int").alias("side"))))
    g = (
        i.withColumn("band", band)
        .select("document_id", "origin", "page", F.struct("place", "item_id", "lines", F.transform("lines", symbol).alias("symbols")).alias("item"), F.explode(lent).alias("at"))
        .select("document_id", "origin", "page", F.col("at.segment").alias("segment"), F.struct("item.place", "item.item_id", "at.side", F.when(F.col("at.side") == 0, F.col("item.lines")).alias("lines"), "item.symbols").alias("item"))
        .groupBy("document_id", "origin", "page", "segment")
        .agg(F.array_sort(F.collect_list("item")).alias("items"), F.max(F.col("item.side") == 0).alias("own"))
        .filter("own")
    )
    count = lambda side: F.aggregate(F.filter("items", lambda x: x["side"] == side), F.lit(0), lambda n, x: n + F.size(x["symbols"]))
    return g.select("document_id", "origin", "page", "segment", F.filter("items", lambda x: x["side"] == 0).alias("items"), F.flatten("items.symbols").alias("symbols"), count(-1).alias("lead"), count(0).alias("core"))


def fit(segments: DataFrame, rounds: int = 2) -> Model:
    """Re-estimate the model over all segments by Viterbi training.

    A round labels every sequence and adds up starts, moves and emissions of
    the segments' own places (a fixed number of sums per task, of which the
    driver gets the totals); the layout's pseudo-counts, a hundredth of the
    weight at least, keep the meaning of the states.
    """
    prior = first_model()
    model = _model(prior)
    size = 4 + 16 + 4 * SYMBOLS
    for _ in range(rounds):

        def count(batches: Iterator[pa.RecordBatch], m: Model = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for b in batches:
                rows = _sequences(b.column(0))
                for seen, labels, lead, core in zip(rows, viterbi(m, rows), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    own, end = labels[lead : lead + core], lead + core
                    if not core:
                        continue
                    if not lead:
                        total[own[0]] += 1
                    first = max(lead, 1)
                    np.add.at(total, 4 + labels[first - 1 : end - 1] * 4 + labels[first:end], 1)
                    np.add.at(total, 20 + own * SYMBOLS + seen[lead:end], 1)
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["i", "n"])

        sums = np.zeros(size)
        for r in segments.select("symbols", "lead", "core").mapInArrow(count, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).toLocalIterator():
            sums[r["i"]] = r["n"]
        parts = (sums[:4], sums[4:20].reshape(4, 4), sums[20:].reshape(4, SYMBOLS))
        model = _model(tuple(c + p * np.maximum(100.0, 0.01 * c.sum(-1, keepdims=True)) for c, p in zip(parts, prior)))
    return model


def _sequences(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list column of integers as views of one array."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def label_lines(segments: DataFrame, model: Model) -> DataFrame:
    """``document_id, origin, page, place, item_id, lines, labels`` of every item."""

    @F.pandas_udf("array<int>")
    def labels(symbols: pd.Series) -> pd.Series:
        return pd.Series(viterbi(model, [np.asarray(s, dtype=np.int64) for s in symbols]))

    begin = lambda i: F.aggregate(F.slice("items", 1, i), F.col("lead") + 1, lambda n, x: n + F.size(x["lines"]))
    each = F.transform("items", lambda x, i: F.struct(x["place"].alias("place"), x["item_id"].alias("item_id"), x["lines"].alias("lines"), F.slice("labels", begin(i), F.size(x["lines"])).alias("labels")))
    return segments.withColumn("labels", labels("symbols")).select("document_id", "origin", "page", F.explode(each).alias("x")).select("document_id", "origin", "page", "x.*")


def _tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


_SEEN = r"[\p{L}\p{Nd}@!|$€]+"


def body_text(labels: str = "labels", lines: str = "lines") -> Column:
    """The running text of an item: its body lines, broken words joined, other line ends kept."""
    body = F.filter(F.arrays_zip(F.col(lines).alias("line"), F.col(labels).alias("label")), lambda x: x["label"] < HEADER)
    return F.regexp_replace(F.array_join(body["line"], "\n"), BROKEN, "")


def word_uses(texts: DataFrame, text: str = "text") -> DataFrame:
    """``word, uses``: how often each word (three or more letters, lower case) stands in all texts.

    Words are counted by Arrow kernels within a task and added up by one
    aggregation; a task hands on a word once for each million distinct words
    it has met.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        held: list[pa.RecordBatch] = []

        def merged() -> pa.Table:
            whole = pa.Table.from_batches(held).group_by("word").aggregate([("uses", "sum")])
            return whole.select(["word", "uses_sum"]).rename_columns(["word", "uses"])

        for b in batches:
            for piece in slices(b.column(0)):
                words = pc.list_flatten(pc.split_pattern_regex(pc.utf8_lower(piece), pattern=r"[^\p{L}]+"))
                counts = pc.value_counts(words)
                counts = counts.filter(pc.greater_equal(pc.utf8_length(counts.field(0)), 3))
                held.append(pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], names=["word", "uses"]))
            if sum(len(h) for h in held) > 1_000_000:
                held = merged().combine_chunks().to_batches()
                if len(held[0]) > 1_000_000:
                    yield from held
                    held = []
        if held:
            yield from merged().combine_chunks().to_batches()

    return texts.select(text).filter(F.col(text).isNotNull()).mapInArrow(run, "word string, uses bigint").groupBy("word").agg(F.sum("uses").alias("uses"))


def readings(words: DataFrame, uses: DataFrame) -> DataFrame:
    """``word, reading`` of every misread word in ``words`` (column ``word``).

    A reading undoes one confusion at one place. It holds if it is a word of
    the clean texts, used often enough and many times as often as the word
    itself; the most used reading is taken. Words are reduced to distinct ones
    first, and those that are longer by more than a confusion than any word of
    the clean texts are left out, since nothing can be read for them: a run of
    signs without end makes no candidates. Candidates are rows of their own
    and compared by equi-joins.
    """
    known = cut_lineage(uses.filter(F.col("uses") >= LEAST_USES).withColumnRenamed("word", "reading"))
    longest = (known.agg(F.max(F.length("reading")).alias("n")).first()["n"] or 0) + 1
    letters = F.length(F.regexp_replace("word", r"[^\p{L}]", ""))
    once = words.filter(F.length("word").between(LEAST_LENGTH, longest) & (letters >= 3)).select("word").distinct().join(uses.withColumnRenamed("uses", "own"), "word", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in CONFUSIONS])
    present = F.filter(pairs, lambda p: F.contains(F.col("word"), p["a"]))
    at = once.select("word", "own", F.explode(present).alias("p")).select("word", "own", "p", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")).filter(F.substring("word", F.col("i"), F.length("p.a")) == F.col("p.a"))
    made = F.concat(F.substring("word", F.lit(1), F.col("i") - 1), F.col("p.b"), F.substring("word", F.col("i") + F.length("p.a"), F.length("word")))
    good = at.select("word", "own", made.alias("reading")).join(known, "reading").filter(F.col("uses") >= TIMES * F.col("own"))
    return good.groupBy("word").agg(F.max_by("reading", F.struct("uses", "reading")).alias("reading"))


def _mend(text: pd.Series, fixes: pd.Series) -> pd.Series:
    """Texts with the misread words of ``fixes`` (maps) replaced; a capital stays one."""
    import regex

    find = regex.compile(_SEEN)

    def one(t: str | None, f) -> str | None:
        if t is None or not f:
            return t
        f = dict(f)

        def put(m) -> str:
            r = f.get(m.group(0).lower())
            return m.group(0) if r is None else r.capitalize() if m.group(0)[0].isupper() else r

        return find.sub(put, t)

    return pd.Series([one(t, f) for t, f in zip(text, fixes)], dtype=object)


#: A hyphen on the last letter of a text; a sentence, list or quotation that has ended; what goes on in the middle of a sentence.
_HANGS, _ENDED, _GOES_ON = r"\p{L} ?[-‐­¬]$", r"[.!?:;…؟。][\"'»”)\]]*$", r"^[\p{Ll}\p{Nd}(]"


@dataclass(frozen=True)
class ScanText:
    """Labelled items and the misread words of their running text."""

    items: DataFrame
    misread: DataFrame

    def noise(self) -> DataFrame:
        """``document_id, item_id, noise``: a row for each kind of noise in an item."""
        kinds = F.array_compact(F.array(*[F.when(F.array_contains("labels", s), F.lit(n)) for s, n in ((BREAK, "split_word"), (HEADER, "running_header"), (NUMBER, "page_number"))]))
        by_label = self.items.select("document_id", "item_id", F.explode(kinds).alias("noise"))
        return by_label.unionByName(self._words().join(self.misread, "word", "left_semi").select("document_id", "item_id", F.lit("misread_char").alias("noise")).distinct())

    def _words(self) -> DataFrame:
        return self.items.select("document_id", "item_id", F.explode(F.array_distinct(_tokens(body_text(), _SEEN))).alias("word"))

    def repaired(self) -> DataFrame:
        """``document_id, item_id, origin, page, place, text``: each item's running text.

        Headers and page numbers are gone, broken words joined, misread words
        replaced, line ends within a paragraph are spaces and blank lines part
        paragraphs. An item that was nothing but furniture has an empty text.
        """
        fixes = self._words().join(self.misread, "word").groupBy("document_id", "item_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "reading"))).alias("fixes"))
        parts = F.transform(F.split(body_text(), r"\n[^\S\n]*\n\s*"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
        flat = F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")
        mend = F.pandas_udf(_mend, "string")
        return self.items.join(fixes, ["document_id", "item_id"], "left").select("document_id", "item_id", "origin", "page", "place", mend(flat, "fixes").alias("text"))

    def paragraphs(self) -> DataFrame:
        """``document_id, origin, paragraph_no, first_item, items, page, last_page, text``: the continuous paragraphs of each document, in order.

        Paragraphs are read in the order of pages and places. One that breaks
        off (no closing mark, or a hyphen on its last letter) is joined with the
        next of its document if that goes on in the middle of a sentence, over
        items and pages, whatever furniture stood between them; so a sentence
        over two pages is one text. Items are cut at blank lines. What is
        gathered in one row is one paragraph.
        """
        parts = self.repaired().filter("text <> ''").select("document_id", "origin", "item_id", "page", "place", F.posexplode(F.split("text", "\n\n")).alias("at", "text"))
        ordered = cut_lineage(number(parts, ["document_id", "origin"], ["page"], ["place", "item_id", "at"]))
        flags = ordered.select("document_id", "origin", "ordinal", F.col("text").rlike(_HANGS).alias("hangs"), (~F.col("text").rlike(_ENDED)).alias("open"), F.col("text").rlike(_GOES_ON).alias("goes_on"), F.col("text").rlike(r"^\p{Ll}").alias("small"))
        back = neighbours(flags, ["document_id", "origin"], "ordinal", {"b_hangs": ("hangs", -1), "b_open": ("open", -1)})
        joined = F.coalesce((F.col("b_hangs") & F.col("small")) | (F.col("b_open") & F.col("goes_on")), F.lit(False))
        runs = running(back.withColumn("joined", joined), ["document_id", "origin"], "ordinal", (~F.col("joined")).cast("bigint"), "paragraph_no").withColumn("glued", F.coalesce(F.col("b_hangs") & F.col("small"), F.lit(False)))
        key = F.struct("document_id", "origin", "ordinal").alias("key")
        whole = ordered.select(key, "ordinal", "item_id", "text", "page").join(runs.select(key, "paragraph_no", "glued"), "key").select("key.document_id", "key.origin", "paragraph_no", F.struct("ordinal", "item_id", "glued", "text").alias("x"), "page")
        g = whole.groupBy("document_id", "origin", "paragraph_no").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.min("page").alias("page"), F.max("page").alias("last_page"))
        text = F.aggregate("xs", F.lit(""), lambda t, x: F.when(t == "", x["text"]).when(x["glued"], F.concat(F.regexp_replace(t, " ?[-‐­¬]$", ""), x["text"])).otherwise(F.concat(t, F.lit(" "), x["text"])))
        return g.select("document_id", "origin", "paragraph_no", F.col("xs")[0]["item_id"].alias("first_item"), F.size(F.array_distinct("xs.item_id")).alias("items"), "page", "last_page", text.alias("text"))


def scan_text(items: DataFrame, titles: DataFrame, clean: DataFrame, rounds: int = 2) -> ScanText:
    """Label all lines of scanned items and find their misread words.

    ``items``: ``document_id, item_id, page, place, text`` and, where known,
    ``origin`` and ``top`` (see :func:`page_lines`), one row per item;
    ``clean``: texts (column ``text``) that were not scanned, of which all
    words are counted. Null texts carry no noise; an empty text is one empty
    body line; a null page can have no running header; documents without a
    title have none either. The labelled items are written to the checkpoint
    folder once, since the model is fitted over them before they are read
    again.
    """
    segments = cut_lineage(page_lines(items, titles))
    labelled = cut_lineage(label_lines(segments, fit(segments, rounds)))
    words = labelled.select(F.explode(F.array_distinct(_tokens(body_text(), _SEEN))).alias("word"))
    return ScanText(labelled, cut_lineage(readings(words, word_uses(clean.select("text")))))
