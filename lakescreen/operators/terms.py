"""Places of many listed terms in texts: an index of q-grams, so that no text is read once for each term.

A term is filed under one of its q-grams, of the greatest of a few widths that it has: the one that proposes the least, by
how often a sample of the texts holds it and how many terms do. Wide q-grams tell apart terms that begin alike. A text's
q-grams are hashed all at once, those that no term is filed under are passed over, and at the others the filed terms are
compared in place. An index of few enough measured bytes is sent to all executors, and texts stay where they are. Beyond
that only the terms go whose q-grams the sample holds most, as many as the bytes allow. For the rest a bitmap goes to the
executors, the few places that it lets through meet the index in a join by q-gram, and what they propose goes back to the
texts by document.

Terms are found whatever their case, by rules that keep the number of characters.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rx
from ..sources import shared

#: Widths of q-grams; the wider ones are hashed from two of half the width.
WIDTHS = (1, 2, 3, 4, 8, 16, 32)
#: Texts of the sample that tells which q-grams are rare. It decides where terms are filed, not what is found.
SAMPLE = 2048
#: Measured bytes of terms up to which their index is sent to all executors, and what a row takes besides.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 100
#: Bits of the bitmap of q-grams, as a power of two: of a list in memory, and the most of a longer one, which has 64 a term.
BITMAP, MOST_BITMAP = 26, 28
#: Slots of a q-gram in the bitmap: its bits from these on.
SLOTS = (0, 17, 34)
#: Hits that are told at once: a worker holds no more than these and those of one text.
TOLD_AT_ONCE = 4096
#: Characters of short texts that are hashed together, and a code point between them that no text holds.
TOGETHER, BETWEEN = 1 << 16, 0x110000
#: Letters that a search without case takes for others, besides those that lower-casing joins.
SAME_LETTERS = {"ς": "σ", "ſ": "s", "ı": "i", "µ": "μ", "İ": "i"}
#: Odd numbers that hash the characters of a q-gram by their place; what falls together is told apart by comparing.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
WORD = re.compile(r"\w")

PLACE = "k int, start int, end int, n int, m string, pre string, post string"


@functools.cache
def _letters() -> np.ndarray:
    """For each code point the one that it is compared as."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x1F000):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    for a, b in SAME_LETTERS.items():
        out[ord(a)] = ord(b)
    return out


def codes(text: str) -> np.ndarray:
    """Code points of a text for comparing without case, as many as its characters."""
    return _letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]


def folded(text: str) -> str:
    return codes(text).tobytes().decode("utf-32-le")


def _together(column: pa.Array) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """(first, texts, starts, codes): neighbouring texts of a column, where each begins, and their code points in one array."""
    first, texts, held = 0, [], 0
    for row, value in enumerate(column):
        text = value.as_py()
        texts.append(text)
        held += len(text) + 1
        if held >= TOGETHER or row == len(column) - 1:
            starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
            of = codes("\0".join(texts)).copy()
            of[starts[1:-1] - 1] = BETWEEN
            yield first, texts, starts[:-1], of
            first, texts, held = row + 1, [], 0


def _mixed(total: np.ndarray) -> np.ndarray:
    return total ^ (total >> np.uint64(29))


def all_grams(of: np.ndarray, widths: list[int]) -> list[np.ndarray]:
    """Hashes of all q-grams of code points, by place, for each of some rising ``WIDTHS``."""
    wide, out, last = of.astype(np.uint64), {}, None
    for q in (w for w in WIDTHS if w in widths or widths and 4 <= w < widths[-1]):
        if len(of) < q:
            out[q] = np.zeros(0, np.int64)
            continue
        total = np.full(len(of) - q + 1, q, np.uint64)
        if q <= 4:
            for k in range(q):
                total += wide[k : len(of) - q + 1 + k] * FACTORS[k]
        else:
            total += last[: len(total)] * FACTORS[0] + last[q // 2 : q // 2 + len(total)] * FACTORS[1]
        last = _mixed(total)
        out[q] = last.view(np.int64)
    return [out[q] for q in widths]


def width(size: int) -> int:
    """The q-grams under which a term of ``size`` characters is filed."""
    return max(w for w in WIDTHS if w <= size)


def listed(spark: SparkSession, terms: list[str] | DataFrame) -> DataFrame:
    """(k, term): terms with their order; of a table, one of rows (term) or (k, term)."""
    if isinstance(terms, DataFrame):
        own = terms if "k" in terms.columns else terms.withColumn("k", F.lit(0))
        return own.select(F.col("k").cast("int").alias("k"), "term").where("term <> ''").distinct()
    return spark.createDataFrame([(k, t) for k, t in enumerate(dict.fromkeys(terms)) if t], "k int, term string")


def _term_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for k, term in zip(batch.column("k").to_pylist(), batch.column("term").to_pylist(), strict=True):
            of = codes(term)
            t = of.tobytes().decode("utf-32-le")
            rows += [(k, t, len(of), off, g) for off, g in enumerate(all_grams(of, [width(len(of))])[0].tolist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["k", "t", "size", "off", "gram"])


def _bitmap(filed: DataFrame, n: int) -> np.ndarray:
    """A bitmap, as bytes, of the q-grams of ``filed`` (gram); of 64 bits for each of ``n``, as far as allowed."""
    power = min(MOST_BITMAP, max(16, (64 * n).bit_length()))
    slots = F.explode(F.array(*(F.shiftright("gram", shift).bitwiseAND((1 << power) - 1) for shift in SLOTS)))
    words = filed.select(slots.alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << power - 6, np.int64)
    bits[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return bits.view(np.uint8)


def index(terms: DataFrame, sample: DataFrame, lengths: list[int], n: int = 1 << 20) -> DataFrame:
    """(gram, off, seen, k, t, size): each term under its q-gram that proposes the least, seen ``seen`` times in ``sample`` (text)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, of in _together(batch.column("text")):
                found, times = np.unique(np.concatenate([_let_through(sent.value, g)[1] for g in all_grams(of, lengths)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times)], ["gram", "n"])

    own = terms.mapInArrow(_term_grams, "k int, t string, size int, off int, gram long").distinct()
    sent = terms.sparkSession.sparkContext.broadcast(_bitmap(own, n))
    held = own.groupBy("gram").agg(F.count("*").alias("terms"))
    seen = sample.mapInArrow(counted, "gram long, n long").join(held.select("gram"), "gram", "left_semi").groupBy("gram").agg(F.sum("n").alias("seen"))
    known = held.join(seen, "gram", "left").select("gram", "terms", F.coalesce("seen", F.lit(0)).alias("seen"))
    rarest = F.min_by(F.struct("gram", "off", "seen"), F.struct((F.col("seen") + 1) * F.col("terms"), "off"))
    return own.join(known, "gram").groupBy("k", "t", "size").agg(rarest.alias("at")).select("at.gram", "at.off", "at.seen", "k", "t", "size")


class _Filed:
    """An index in memory: q-grams in order, each with its terms."""

    def __init__(self, rows: pa.Table):
        gram = rows.column("gram").to_numpy()
        order = np.argsort(gram, kind="stable")
        self.gram, first = np.unique(gram[order], return_index=True)
        self.start = np.r_[first, len(gram)]
        self.k, self.off, self.size = (rows.column(c).to_numpy()[order] for c in ("k", "off", "size"))
        text = rows.column("t").to_pylist()
        self.text = [text[i] for i in order]
        self.bits = np.zeros(1 << BITMAP - 3, np.uint8)
        for shift in SLOTS:
            slot = (self.gram >> shift) & ((1 << BITMAP) - 1)
            np.bitwise_or.at(self.bits, slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8))

    def proposed(self, of: np.ndarray, lengths: list[int], begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, row, text): where in which of the texts that ``begin`` there which of the index's rows may be."""
        starts, rows, texts = [], [], []
        for all_ in all_grams(of, lengths):
            at, gram = _let_through(self.bits, all_)
            place = np.searchsorted(self.gram, gram)
            here = (place < len(self.gram)) & (self.gram[np.minimum(place, len(self.gram) - 1)] == gram) if len(self.gram) else np.zeros(len(gram), bool)
            at, place = at[here], place[here]
            count = self.start[place + 1] - self.start[place]
            row = np.repeat(self.start[place] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(count) else np.zeros(0, int)
            text = np.searchsorted(begin, at, "right") - 1
            starts.append(np.repeat(at - begin[text], count) - self.off[row])
            rows.append(row)
            texts.append(np.repeat(text, count))
        return np.concatenate(starts), np.concatenate(rows), np.concatenate(texts)


def _let_through(bits: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, q-gram) of those q-grams that have all their slots set in a bitmap of bytes."""
    at, mask = np.arange(len(gram)), 8 * len(bits) - 1
    for shift in SLOTS:
        slot = (gram >> shift) & mask
        here = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
        at, gram = at[here], gram[here]
    return at, gram


def _hits(text: str, proposed: list[tuple[int, int, str]], whole_words: bool) -> list[tuple]:
    """``PLACE`` rows of what is right among (k, start, term), in this order: a term's places do not overlap."""
    low, out, before, free = folded(text), [], None, 0
    for k, start, term in proposed:
        end = start + len(term)
        if start < 0 or not low.startswith(term, start):
            continue
        if whole_words and (start and WORD.match(text[start - 1]) or end < len(text) and WORD.match(text[end])):
            continue
        free = free if (k, term) == before else 0
        if start >= free:
            before, free = (k, term), end
            out.append((k, start, end, len(text), text[start:end], text[max(0, start - rx.AROUND) : start], text[end : end + rx.AROUND]))
    return out


_TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())


def _told(batch: pa.RecordBatch, of: Callable[[int], list[tuple]]) -> Iterator[pa.RecordBatch]:
    """``PLACE`` rows of the hits ``of`` each row of a batch, not too many at once."""
    ids, row, told = batch.column("doc_id"), [], []
    for i in range(batch.num_rows):
        hits = of(i)
        for at in range(0, len(hits), TOLD_AT_ONCE):
            part = hits[at : at + TOLD_AT_ONCE]
            row += [i] * len(part)
            told += part
            if len(row) >= TOLD_AT_ONCE:
                yield _rows(ids, row, told)
                row, told = [], []
    yield _rows(ids, row, told)


def _rows(ids: pa.Array, row: list[int], told: list[tuple]) -> pa.RecordBatch:
    columns = zip(*told, strict=True) if told else [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], ["doc_id", "k", "start", "end", "n", "m", "pre", "post"])


def find(docs: DataFrame, terms: list[str] | DataFrame, whole_words: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n, ord, k, start, end, m, pre, post): places of each term k in texts of n characters.

    A term's places do not overlap each other, as the leftmost is taken first; those of different terms may. Null and empty
    texts have none, empty terms are none. Terms that differ only in case are found each, unless they share k.
    """
    spark = docs.sparkSession
    own = listed(spark, terms)
    wide = F.array_max(F.filter(F.array(*map(F.lit, WIDTHS)), lambda w: w <= F.length("term")))
    size = own.agg(F.sum(_bytes("term")).alias("bytes"), F.collect_set(wide).alias("lengths"), F.count("*").alias("n")).first()
    lengths = sorted(size.lengths) or [1]
    texts = docs.where("text <> ''").select("doc_id", "text")
    filed = index(own, texts.select("text").limit(SAMPLE), lengths, size.n)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PLACE}"
    if (size.bytes or 0) <= broadcast_bytes:
        hits = _find_sent(texts, filed, lengths, whole_words, schema)
    else:
        at = shared.folder(spark, "terms")  # written, as another sample would file terms elsewhere
        filed.write.parquet(at)
        shared.remove_at_exit(spark, at)
        filed = spark.read.schema(filed.schema).parquet(at)
        least = _often(filed, broadcast_bytes)
        hits = _find_shuffled(texts, filed.where(F.col("seen") < least), size.n, lengths, whole_words, schema)
        if least < NEVER:
            hits = hits.unionByName(_find_sent(texts, filed.where(F.col("seen") >= least), lengths, whole_words, schema))
    return hits.select("doc_id", "n", F.col("start").alias("ord"), "k", "start", "end", "m", "pre", "post")


#: More than any q-gram is seen.
NEVER = 1 << 62


def _bytes(term: str) -> Column:
    return 2 * F.octet_length(term) + ROW_BYTES


def _often(filed: DataFrame, most_bytes: int) -> int:
    """How often, as a power of two, the sample must hold a q-gram so that all terms under such ones take ``most_bytes`` at most."""
    by = filed.where("seen > 0").groupBy(F.floor(F.log2("seen")).cast("int").alias("power")).agg(F.sum(_bytes("t")).alias("bytes"))
    least, total = NEVER, 0
    for row in sorted(by.collect(), key=lambda r: -r.power):
        total += row.bytes
        if total > most_bytes:
            break
        least = 1 << row.power
    return least


def _find_sent(texts: DataFrame, filed: DataFrame, lengths: list[int], whole_words: bool, schema: str) -> DataFrame:
    """``find`` for an index that is sent to all executors."""
    sent = texts.sparkSession.sparkContext.broadcast(filed.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = _Filed(sent.value)
        for batch in batches:
            for first, said, starts, of in _together(batch.column("text")):
                start, row, text = at.proposed(of, lengths, starts)
                order = np.lexsort((start, row, text))
                start, row, text = start[order], row[order], text[order]
                cut = np.searchsorted(text, np.arange(len(said) + 1))

                def hits(i: int, said: list = said, start: np.ndarray = start, row: np.ndarray = row, cut: np.ndarray = cut) -> list[tuple]:
                    here = slice(cut[i], cut[i + 1])
                    return _hits(said[i], [(at.k[r], s, at.text[r]) for s, r in zip(start[here].tolist(), row[here].tolist(), strict=True)], whole_words) if cut[i] < cut[i + 1] else []

                yield from _told(batch.slice(first, len(said)), hits)

    return texts.mapInArrow(run, schema)


def _find_shuffled(texts: DataFrame, filed: DataFrame, n: int, lengths: list[int], whole_words: bool, schema: str) -> DataFrame:
    """``find`` for an index of ``n`` terms at most that is joined by q-gram, and its proposals with texts by document."""
    sent = texts.sparkSession.sparkContext.broadcast(_bitmap(filed, n))
    key = texts.withColumn("h", F.xxhash64("text"))
    of = texts.schema["doc_id"].dataType.simpleString()

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, starts, letters in _together(batch.column("text")):
                for all_ in all_grams(letters, lengths):
                    at, gram = _let_through(sent.value, all_)
                    text = np.searchsorted(starts, at, "right") - 1
                    same = pa.array(text + first)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(same), batch.column("h").take(same), pa.array((at - starts[text]).astype(np.int32)), pa.array(gram)], ["doc_id", "h", "pos", "gram"])

    met = key.mapInArrow(places, f"doc_id {of}, h long, pos int, gram long").join(filed, "gram")
    proposed = met.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("k", "t", (F.col("pos") - F.col("off")).alias("start")))).alias("c"))
    joined = key.join(proposed.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "c"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, found = batch.column("text"), batch.column("c")
            yield from _told(batch, lambda i, text=text, found=found: _hits(text[i].as_py(), [(c["k"], c["start"], c["t"]) for c in found[i].as_py()], whole_words))

    return joined.select("doc_id", "text", "c").mapInArrow(verified, schema)
