"""Benchmark decontamination by template windows.

Words become canonical: punctuation at the edges goes, letters are lower-cased, and numbers, units and
names (capitalised inside a sentence) become typed placeholders. Windows of 8 canonical words are hashed on
both sides: with names as words, with names as placeholders, and so that capitalised words at the start of a
sentence, but for function words, are placeholders too. A bitmap of fixed size over
the benchmark's windows drops nearly all windows of the documents; the rest meet the benchmark in a hash
join. A document and an item are aligned by the distance of their windows' places. Along an alignment each value of the item stands for
one value of the document, and the other way round: that which most of its windows hold (ties: the greatest); units and
numbers of one digit may vary, so a question with other numbers is caught. A window that contradicts the binding
does not count; the other windows of the alignment still do.

An item leaks into a document if half of its windows are matched, or six (13 words in a row or more).

Defined results: a null or empty text has no leaks; items of three to seven words are matched as a whole, those of
one or two only by texts that consist of them, null ones never; windows with more placeholders than words are matched by their literal
values only, and an item may also leak by half of its other windows; repeated rows
and ties of items each give their rows once per doc_id; empty tables give an empty result; only ``doc_id``,
``text`` and ``item_id`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import bound_batches, in_bitmap, key_bitmap, materialize, row_key, share_value, without

WINDOW, SHORTEST = 8, 3
LEAST_SHARE, LEAST_WINDOWS = 0.5, 6
#: Benchmark windows up to which the join's smaller side is broadcast; more are joined by shuffle.
BROADCAST_WINDOWS = 500_000
MEMO = 250_000
#: Tells the hashes of literal windows from the others.
LITERAL = 1 << 16
#: Words that count as units.
UNITS = frozenset(
    "mm cm m km inch inches ft feet foot yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur percent degree degrees celsius fahrenheit kmh mph hz khz mhz ghz kb mb gb tb w kw v volt volts".split()
)
#: Words that are no names at the start of a sentence.
FUNCTION_WORDS = frozenset(
    "a an the this that these those he she it we you they his her its our your their there here who what when where which why how if then else so but and "
    "or nor not no yes each every all both some any many much more most few one two in on at of for to from by with without into onto over under after before "
    "during until while since because although though as than is are was were be been am do does did has have had can could will would shall should may might must let".split()
)
_NUMBER = regex.compile(r"[+-]?[$€£]?\d[\d.,:/]*[%°]?")
_QUANTITY = regex.compile(r"[+-]?\d[\d.,]*\p{L}{1,4}")
_EDGE = regex.compile(r"^[^\p{L}\p{N}+$€£-]+|[^\p{L}\p{N}%°]+$")
_PLAIN, _SLOT, _NAME, _DROP, _CAPITAL = 0, 1, 2, 3, 4
#: Letters that every library lower-cases alike, and marks that ``_EDGE`` takes off at either end: words of these are read by column.
_UPPER, _LOWER = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_MARKS = "!\"#&'()*,./:;<=>?@[\\]^_`{|}~«»‘’“”–—…"
_MARK = "[" + "".join("\\" + c if c in "\\[]^" else c for c in _MARKS) + "]*"
_LETTERS = f"^{_MARK}[{_UPPER}{_LOWER}]+{_MARK}$"
_CAPITALISED = f"^{_MARK}[{_UPPER}][{_LOWER}]+{_MARK}$"
_ENDS = "[.!?:;][\"')\\]}»”’]*$"


def literal(word: str) -> str:
    return _EDGE.sub("", word).lower()


def canonical(word: str) -> tuple[str, int, bool]:
    """(canonical word, kind, ends a sentence). A name keeps its lower-case word; its place decides whether it is used."""
    ends = word.rstrip("\"')]}»”’")[-1:] in tuple(".!?:;")
    core = _EDGE.sub("", word)
    if not core or not any(c.isalnum() for c in core):
        return "", _DROP, ends
    low = core.lower()
    if _NUMBER.fullmatch(core):
        return "<number>", _SLOT, ends
    if _QUANTITY.fullmatch(core):
        return "<quantity>", _SLOT, ends
    if low in UNITS:
        return "<unit>", _SLOT, ends
    core = core.lstrip("+$€£-")
    low = core.lower()
    if not (len(core) > 1 and core[0].isupper() and core[1:].islower()):
        return low, _PLAIN, ends
    return low, _CAPITAL if low in FUNCTION_WORDS else _NAME, ends


class Canon:
    """Canonical words of a chunk of texts: both codes of each, slot marks, values, and the words of each text."""

    def __init__(self) -> None:
        self.memo: dict[str, tuple[int, int, bool, int]] = {}
        self.name, self.unit = W.hash_strings(["<name>", "<unit>"]).tolist()

    def _told(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code, kind, end of a sentence and value of each distinct word: ``canonical`` by column for words of common letters, one by one for the others."""
        n = len(distinct)
        code, kind, ends = np.zeros(n, np.uint64), np.zeros(n, np.int8), np.zeros(n, bool)
        plain = pc.match_substring_regex(distinct, _LETTERS)
        at, words = np.flatnonzero(np.asarray(plain)), distinct.filter(plain)
        low = pc.utf8_lower(pc.utf8_trim(words, _MARKS))
        hashes = W.hash_strings(low.to_numpy(zero_copy_only=False))
        one_of = lambda known: np.asarray(pc.is_in(low, pa.array(sorted(known), low.type)))
        capital, unit = np.asarray(pc.match_substring_regex(words, _CAPITALISED)), one_of(UNITS)
        kind[at] = np.where(unit, _SLOT, np.where(capital, np.where(one_of(FUNCTION_WORDS), _CAPITAL, _NAME), _PLAIN))
        ends[at] = np.asarray(pc.match_substring_regex(words, _ENDS))
        code[at] = np.where(unit, np.uint64(self.unit), hashes)
        value = np.zeros(n, np.uint64)
        value[at] = hashes

        odd = np.flatnonzero(~np.asarray(plain))
        others = distinct.take(pa.array(odd)).to_pylist()
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = [w for w in others if w not in self.memo]
        told = [canonical(w) for w in new]
        for w, t, h in zip(new, told, W.hash_strings([t[0] for t in told]).tolist(), strict=True):
            self.memo[w] = (h, t[1], t[2], h)
        valued = [w for w, t in zip(new, told, strict=True) if t[1] == _SLOT]
        for w, h in zip(valued, W.hash_strings([literal(w) for w in valued]).tolist(), strict=True):
            self.memo[w] = (*self.memo[w][:3], h)
        if others:
            code[odd], kind[odd], ends[odd], value[odd] = (np.array(x, own.dtype) for x, own in zip(zip(*map(self.memo.__getitem__, others), strict=True), (code, kind, ends, value), strict=True))
        return code, kind, ends, value

    def read(self, text: pa.Array) -> None:
        flat, counts = W.split(text)
        coded = flat.dictionary_encode()
        index = np.asarray(coded.indices) if len(flat) else np.zeros(0, np.int64)
        code, kind, ends, value = (x[index] for x in self._told(coded.dictionary))
        first = np.zeros(len(index), bool)
        begin = (np.cumsum(counts) - counts)[counts > 0]
        first[begin] = True
        if len(index):
            first[1:] |= ends[:-1]
        keep = kind != _DROP
        name, leading = ((kind == _NAME) | (kind == _CAPITAL)) & ~first, (kind == _NAME) & first
        before = np.concatenate([[0], np.cumsum(keep)])
        edges = np.concatenate([[0], np.cumsum(counts)])
        self.counts = np.diff(before[edges])
        self.plain, self.literal = code[keep], value[keep]
        self.slot, self.is_name, self.leads = (kind == _SLOT)[keep], name[keep], leading[keep]
        self.raw = flat.filter(pa.array(keep)) if len(index) else flat
        self.base = np.cumsum(self.counts) - self.counts

    def windows(self, size: int) -> Iterator[tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]]:
        """(words that are slots, hash, text index, first word) of all windows: plain, with names as slots, with leading names too, and literal (no slots)."""
        n = len(self.plain) - size + 1
        if n <= 0:
            return
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        at = np.flatnonzero(text[:n] == text[size - 1 :])
        total = sum_windows(self.plain, size, n)
        held = lambda mark: (lambda c: c[at + size] - c[at])(np.concatenate([[0], np.cumsum(mark)]))
        dense = 2 * held(self.slot) > size
        some = at[~dense]
        yield self.slot, W.mix(W.mix(total[some]) + np.uint64(size)), text[some], some
        # Without such a name an earlier pass has the window.
        for marked, new in ((self.is_name, self.is_name), (self.is_name | self.leads, self.leads)):
            slot, has = self.slot | marked, held(new) > 0
            some = at[has & (2 * held(slot) <= size)]
            yield slot, W.mix(W.mix(self._replaced(total, marked, size)[some]) + np.uint64(size)), text[some], some
        some = at[dense]
        whole = np.zeros(len(some), np.uint64)
        for k in range(size):
            whole = whole * W._MULTIPLIER + self.literal[some + k]
        yield None, W.mix(W.mix(whole) + np.uint64(size + LITERAL)), text[some], some

    def whole(self, size: int) -> Iterator[tuple[None, np.ndarray, np.ndarray, np.ndarray]]:
        """All texts of ``size`` words, by their literal values."""
        of = np.flatnonzero(self.counts == size)
        total = np.zeros(len(of), np.uint64)
        for k in range(size):
            total = total * W._MULTIPLIER + self.literal[self.base[of] + k]
        yield None, W.mix(W.mix(total) + np.uint64(size + 2 * LITERAL)), of, self.base[of]

    def _replaced(self, total: np.ndarray, marked: np.ndarray, size: int) -> np.ndarray:
        """Polynomials of all windows with the marked words replaced by the name's placeholder."""
        out, where = total.copy(), np.flatnonzero(marked)
        change = np.uint64(self.name) - self.plain[where]
        for k in range(size):  # the marked word is the k-th from the end of the window that starts at ``first``
            first = where - (size - 1 - k)
            ok = (first >= 0) & (first < len(out))
            out[first[ok]] += change[ok]
            change = change * W._MULTIPLIER
        return out

    def values(self, at: int, size: int, slot: np.ndarray | None) -> list[str]:
        """The values in the slots of one window."""
        return [] if slot is None else [literal(self.raw[at + int(k)].as_py()) for k in np.flatnonzero(slot[at : at + size])]


def sum_windows(code: np.ndarray, size: int, n: int) -> np.ndarray:
    """Polynomials over ``n`` windows of ``size`` codes."""
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total *= W._MULTIPLIER
        total += code[k : k + n]
    return total


def _hits(part, canon: Canon, sizes: list[int], id_name: str, bitmap: np.ndarray | None) -> pa.RecordBatch:
    ids = part.column(part.schema.get_field_index(id_name))
    rows: list[tuple] = []
    for size in sizes:
        for slot, hashes, of, at in canon.windows(size) if size >= SHORTEST else canon.whole(size):
            ok = np.flatnonzero(in_bitmap(bitmap, hashes)) if bitmap is not None else np.arange(len(hashes))
            signed = hashes.view(np.int64)
            for k in ok.tolist():
                rows.append((ids[int(of[k])].as_py(), int(signed[k]), int(at[k] - canon.base[of[k]]), size, canon.values(int(at[k]), size, slot), slot is None))
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.bool_()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [id_name, "hash", "pos", "size", "slots", "literal"])


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, hash, pos, size, slots, literal): an item's windows of 8 words, or its whole if it has fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for part, text in W.chunks(batches):
            for k in range(len(text)):
                canon.read(text.slice(k, 1))
                size = min(WINDOW, int(canon.counts[0]))
                if size:
                    yield _hits(part.slice(k, 1), canon, [size], "item_id", None)

    schema = "item_id long, hash long, pos int, size int, slots array<string>, literal boolean"
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, schema)


def _bindings(pairs: DataFrame, along: list[str]) -> DataFrame:
    """(along, binding): of the values that the windows of an alignment pair, those that are each other's most frequent partner. An item's length bounds their number."""
    votes = pairs.select(*along, F.explode("bound").alias("s")).groupBy(*along, F.col("s.item_slots").alias("v"), F.col("s.slots").alias("w")).agg(F.count("*").alias("n"))
    best = votes.groupBy(*along, "v").agg(F.max(F.struct("n", "w")).alias("best")).select(*along, "v", "best.w")
    back = votes.groupBy(*along, "w").agg(F.max(F.struct("n", "v")).alias("best")).select(*along, "w", "best.v")
    both = best.join(back, [*along, "v", "w"])
    return both.groupBy(*along).agg(F.collect_list(F.struct(F.col("v").alias("item_slots"), F.col("w").alias("slots"))).alias("binding"))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, kind (``exact`` or ``reparameterised``): one row for each leak."""
    bound_batches(docs.sparkSession)
    items = materialize(item_windows(benchmark), "item-windows")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most eight values
    bitmap = share_value(docs.sparkSession, key_bitmap(items, "hash", 26))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for part, text in W.chunks(batches):
            canon.read(text)
            yield _hits(part, canon, sizes, "doc_id", bitmap.value)

    schema = "doc_id long, hash long, pos int, size int, slots array<string>, literal boolean"
    found = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), "doc-windows").drop("literal")
    side = items.select("hash", "item_id", "literal", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    n_items = items.count()
    side = F.broadcast(side) if n_items <= BROADCAST_WINDOWS else side
    pairs = found.join(side, "hash").where(F.size("slots") == F.size("item_slots")).withColumn("shift", F.col("pos") - F.col("item_pos")).drop("hash", "size", "pos").distinct()
    pairs = materialize(pairs, "window-pairs")
    zipped = F.arrays_zip("item_slots", "slots")
    bound = F.array_distinct(F.filter(zipped, lambda s: ~(s["item_slots"].isin(*sorted(UNITS)) | s["item_slots"].rlike("^[0-9]$"))))
    along = ["doc_id", "item_id", "shift"]
    pairs = pairs.select(*along, "item_pos", "literal", bound.alias("bound"), (F.col("item_slots") != F.col("slots")).alias("differs"))
    pairs = pairs.join(_bindings(pairs, along), along, "left")
    torn = F.exists("bound", lambda s: ~F.array_contains(F.coalesce("binding", F.array().cast("array<struct<item_slots:string,slots:string>>")), s))
    pairs = pairs.withColumn("torn", torn)
    checked = pairs.groupBy("doc_id", "item_id", "shift").agg(F.bool_or("differs").alias("other"))
    good = pairs.where("not torn").join(checked, ["doc_id", "item_id", "shift"])
    matched = good.groupBy("doc_id", "item_id").agg(F.countDistinct("item_pos").alias("n_matched"), F.countDistinct(F.when(~F.col("literal"), F.col("item_pos"))).alias("n_formed"), F.min("other").alias("other"))
    totals = items.groupBy("item_id").agg(F.countDistinct("pos").alias("n_windows"), F.countDistinct(F.when(~F.col("literal"), F.col("pos"))).alias("n_forms"))
    by_form = (F.col("n_formed") > 0) & (F.col("n_formed") >= LEAST_SHARE * F.col("n_forms"))
    leaks = matched.join(totals, "item_id").where((F.col("n_matched") >= LEAST_SHARE * F.col("n_windows")) | (F.col("n_matched") >= LEAST_WINDOWS) | by_form)
    return leaks.select("doc_id", "item_id", "n_windows", "n_matched", F.when(F.col("other"), "reparameterised").otherwise("exact").alias("kind"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a leaked item; other rows of the same doc_id stay."""
    return without(docs, find_leaks(docs.select(row_key().alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("row")))
