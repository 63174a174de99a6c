"""Substring dedup by content-defined anchors.

A gear hash rolls over a text's UTF-8 bytes (each byte adds a table value to the doubled hash, which so
depends on the last 32 bytes). The anchor of a window of ``run`` bytes is the ``GRAM``-byte gram in it whose
end has the least hash, the first of equals; it depends on the window's content alone, so equal windows have equal
anchors wherever they stand. Only anchors that stand in several documents go on: their occurrences, with
all bytes of the windows they stand for, are extended to both sides against the first occurrence by exact
comparison, and where there are more than two, windows that differ from the first meet each other by
a 128-bit digest, beside the first occurrence or, where an anchor has several parts, over all of them. There, occurrences
with equal bytes are one class, whose windows go out once a part. Windows of one anchor all hold its gram, so a class has one
span, with all documents where its windows stand first. A task lists the occurrences of a class, those of one document at equal
distances as one entry, and a list meets its class in one row. Of the class's first occurrence
alone, windows may stand first in itself; it gets the span of the others. So the spans are exactly the bytes in windows of ``run`` bytes that stand in an earlier
document, whichever that is; shorter chance repeats stay. A text below ``run`` bytes is one window and a
repeat if an earlier document equals it. An anchor's occurrences are dealt out in parts of about ``PART``,
each beside the first occurrence, so no anchor's occurrences meet in one task.

Null and empty texts have no windows and stay as they are, as do rows without a doc_id. Rows that share a
doc_id count as one document: none repeats another, and spans found for one of them apply to all. A span
never ends inside a character. A very long text is held whole by one task. An empty table has no spans.
Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm import textkit as K
from lumenframe.plans.staging import Staged

MASK_BITS, LEAST, MOST, RUN = 5, 16, 192, 112
GRAM, PART = 32, 1024
#: Spans that a task joins before it passes them on.
HELD = 1 << 17
#: Entries of a list of occurrences.
PACK = 1024
MET = "doc_id long, begin int, stop int, source long, x long, y long, cx long, cy long, low int, last long, several boolean"
PACKED = "cx long, cy long, docs array<long>, lows array<long>, steps array<long>, times array<long>"
PLACED = "doc_id long, begin int, stop int, source long, sources array<long>"
_GEAR = (K.seeds(256, 0x6EA4) >> K.U(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after every byte, by doubling the span five times: 1, 2, ... 32 bytes."""
    h = _GEAR[data]
    for k in range(5):
        span = 1 << k
        out = h.copy()
        out[span:] += h[:-span] << np.uint32(span)
        h = out
    return h


def chunk_ends(data: np.ndarray, mask_bits: int = MASK_BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of one text."""
    n, ends, at = len(data), [], 0
    if not n:
        return ends
    solid = np.ones(n + 1, bool)
    solid[1:n] = (data[1:] & 0xC0) != 0x80
    cuts = np.flatnonzero((gear_hashes(data) >> np.uint32(32 - mask_bits)) == 0) + 1
    for cut in cuts[solid[cuts]].tolist():
        while cut - at > most:
            at += most
            while not solid[at]:
                at -= 1
            ends.append(at)
        if cut - at >= least:
            ends.append(cut)
            at = cut
    while n - at > most:
        at += most
        while not solid[at]:
            at -= 1
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def anchors(data: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram begins, first window, last window) of each anchor of a text of ``run`` bytes or more."""
    h = gear_hashes(data)[GRAM - 1 :].astype(np.uint64)
    least = (h << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    width, span = run - GRAM + 1, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    low = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[low], low, np.concatenate([low[1:], [len(at)]]) - 1


def _text_anchors(text: np.ndarray, run: int) -> tuple[list[int], np.ndarray]:
    """(key of each anchor, [gram begins, first window, last window]); a text below ``run`` bytes is its own anchor."""
    raw, digest = text.tobytes(), xxhash.xxh3_64_intdigest
    if len(raw) < run:
        return [digest(raw, 1)], np.zeros((3, 1), np.int64)
    found = np.stack(anchors(text, run))
    return [digest(raw[g : g + GRAM]) for g in found[0].tolist()], found


def _anchorer(run: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            for lo, hi in K.row_slices(offsets):
                keys, counts, sizes = [], [], []
                for a, b in zip(offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist(), strict=True):
                    key, n = np.unique(np.array(_text_anchors(data[a:b], run)[0], np.uint64), return_counts=True)
                    keys.append(key.view(np.int64))
                    counts.append(n)
                    sizes.append(len(key))
                at = pa.array(np.repeat(np.arange(lo, hi), sizes))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(0).take(at), pa.array(np.concatenate(counts))], ["k", "doc_id", "n"])

    return find


CONTEXT = "k long, part int, follows boolean, doc_id long, t long, low int, gram int, source long, many boolean, hot boolean, ctx binary"


def _contexts(run: int):
    """The bytes of all windows of the wanted anchors of each text; those of a leading document go to every part."""
    names = [c.split()[0] for c in CONTEXT.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc, t, raw = (batch.column(c)[i].as_py() for c in range(3))
                raw, wanted = raw.encode(), batch.column(3)[i].values
                key, (gram, low, high) = _text_anchors(np.frombuffer(raw, np.uint8), run)
                key = np.array(key, np.uint64).view(np.int64)
                known, lead, parts, many = (wanted.field(f).to_numpy(zero_copy_only=False) for f in ("k", "lead", "parts", "many"))
                order = np.argsort(known)
                known = known[order]
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                has = np.flatnonzero(known[at] == key)
                for lo in range(0, len(has), 4096):
                    mine = has[lo : lo + 4096]
                    row = order[at[mine]]
                    times = np.where(lead[row] == doc, parts[row], 1)
                    mine, row = np.repeat(mine, times), np.repeat(row, times)
                    part = np.where(lead[row] == doc, np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times), (doc * 0x9E3779B1 >> 9 & 0xFFFF) % parts[row])
                    ctx = [raw[p : q + run] for p, q in zip(low[mine].tolist(), high[mine].tolist(), strict=True)]
                    same = np.full(len(mine), 1)
                    columns = [key[mine], part.astype(np.int32), lead[row] != doc, same * doc, same * t, low[mine].astype(np.int32), (gram - low)[mine].astype(np.int32), lead[row], many[row], parts[row] > 1, pa.array(ctx, pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return cut


def _whole(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The range [a, b) without what it has of characters that it cuts."""
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    last = b - 1
    while last > a and raw[last] & 0xC0 == 0x80:
        last -= 1
    if b > a and last + (1 if raw[last] < 0x80 else 2 if raw[last] < 0xE0 else 3 if raw[last] < 0xF0 else 4) > b:
        b = last
    return a, b


def _common(a: bytes, b: bytes) -> int:
    """Bytes that two texts share from their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


def _window_keys(ctx: bytes, run: int, skip: tuple[int, int]) -> tuple[list[int], list[bytes]]:
    """Starts and digests of the windows of ``run`` bytes that don't lie in the range ``skip``."""
    at = [w for w in range(len(ctx) - run + 1) if not skip[0] <= w or not w + run <= skip[1]]
    return at, [xxhash.xxh3_128_digest(ctx[w : w + run]) for w in at]


def _extender(run: int):
    """Spans that repeat an earlier occurrence and, of anchors with several parts, the windows that differ from the first.

    Rows are sorted by leading document, part and anchor, the leading document's occurrences first, then by
    document. Spans come without a digest, windows of a class with theirs (x, y), the class's (cx, cy), its first
    document and occurrence in this part, its last document and whether it has several occurrences; their bounds
    count from the occurrence. Occurrences come with the digest of their class alone.
    """

    def halves(digest: bytes) -> tuple[int, int]:
        return tuple(int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))

    def spans(row: tuple, first: tuple[int, bytes], seen: dict[bytes, tuple], out: list, classes: dict, members: list) -> None:
        k, part, follows, doc, t, low, g, source, many, hot, ctx = row
        (sg, sctx), win, a, b = first, min(run, len(ctx)), 0, 0
        if g == sg and ctx == sctx:
            b = len(ctx)
        elif len(ctx) >= run and len(sctx) >= run:
            left, right = _common(ctx[:g][::-1], sctx[:sg][::-1]), _common(ctx[g:], sctx[sg:])
            if right >= GRAM and left + right >= run:
                a, b = g - left, g + right
        if b:
            out.append((doc, low, a, b, source, ctx))
        if not many:
            return
        if hot:
            cut = (a, b) if b else (0, 0)
            if cut[0] or b < len(ctx):  # else no window differs
                name = xxhash.xxh3_128_digest(k.to_bytes(8, "little", signed=True) + g.to_bytes(4, "little") + ctx)
                if name in classes:
                    one = classes[name]  # perhaps of another part
                    one[:4] = *min((one[0], one[1]), (doc, low)), max(one[2], doc), True
                else:
                    classes[name] = [doc, low, doc, False, ctx, *_window_keys(ctx, win, cut)]
                members.append((doc, low, *halves(name)))
            return
        held = None  # adjoining windows of one earlier document
        for w, key in zip(*_window_keys(ctx, win, (a, b) if b else (0, 0)), strict=True):
            earlier = seen.setdefault(key, (doc, low + w))
            if earlier == (doc, low + w):
                continue
            if held and held[1] == w + win - 1 and held[2] == earlier[0]:
                held[1] = w + win
                continue
            if held:
                out.append((doc, low, held[0], held[1], held[2], ctx))
            held = [w, w + win, earlier[0]]
        if held:
            out.append((doc, low, held[0], held[1], held[2], ctx))

    def table(**columns) -> pa.RecordBatch:
        kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        n = len(columns["doc_id"])
        fields = [f.split() for f in MET.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(columns[f], kinds[k]) if f in columns else pa.nulls(n, kinds[k]) for f, k in fields], [f for f, _ in fields])

    def known(classes: dict, members: list) -> Iterator[pa.RecordBatch]:
        """What is held of hot anchors; a class that comes again goes out again."""
        windows = []
        for name, (doc, low, last, several, ctx, at, keys) in classes.items():
            for w, key in zip(at, keys, strict=True):
                x, y = _whole(ctx, w, w + min(run, len(ctx)))
                if x < y:
                    windows.append((doc, x, y, *halves(key), *halves(name), low, last, several))
        if windows:
            yield table(**dict(zip(("doc_id", "begin", "stop", "x", "y", "cx", "cy", "low", "last", "several"), zip(*windows, strict=True), strict=True)))
        if members:
            yield table(**dict(zip(("doc_id", "low", "cx", "cy"), zip(*members, strict=True), strict=True)))
        classes.clear()
        members.clear()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, seen, held, classes, members = None, None, {}, [], {}, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                found: list = []
                for row in zip(*(c.to_pylist() for c in batch.slice(lo, 1000).columns), strict=True):
                    if row[:2] != now:
                        now, first, seen = row[:2], (row[6], row[10]), {}
                    elif row[2] or not row[1]:  # the leading document's other occurrences meet in part 0
                        spans(row, first, seen, found, classes, members)
                for doc, low, a, b, source, ctx in found:
                    x, y = _whole(ctx, a, b)
                    if x < y:
                        held.append((doc, source, low + x, low + y))
                if len(classes) >= 1 << 11 or len(members) >= HELD:
                    yield from known(classes, members)
                if len(held) >= HELD:
                    yield _joined(held, table)
                    held = []
        yield from known(classes, members)
        if held:
            yield _joined(held, table)

    return extend


def _touching(doc: np.ndarray, source: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans (document, source, begin, stop), those of one document and source that touch as one."""
    order = np.lexsort((begin, source, doc))
    doc, source, begin, stop = (c[order] for c in (doc, source, begin, stop))
    group = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (source[1:] != source[:-1])])) << 32
    reach = np.maximum.accumulate(stop + group)
    first = np.flatnonzero(np.concatenate([[True], begin[1:] + group[1:] > reach[:-1]]))
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], source[first], begin[first], reach[last] - group[last]


def _joined(held: list[tuple[int, int, int, int]], table) -> pa.RecordBatch:
    doc, source, begin, stop = _touching(*np.array(held, np.int64).T)
    return table(doc_id=doc, begin=begin, stop=stop, source=source)


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of the occurrences (cx, cy, document, low) of each class; those of a document at equal distances are one entry."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        cx, cy, doc, low = (rows.column(c).to_numpy().astype(np.int64) for c in range(4))
        order = np.lexsort((low, doc, cy, cx))
        cx, cy, doc, low = (c[order] for c in (cx, cy, doc, low))
        fresh = np.concatenate([[True], (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])])
        start = fresh | np.concatenate([[True], doc[1:] != doc[:-1]])
        step = np.diff(low, prepend=0)
        start[2:] |= ~start[1:-1] & ~start[2:] & (step[2:] != step[1:-1])
        first = np.flatnonzero(start)
        times = np.diff(np.append(first, len(low)))
        steps = np.where(times > 1, step[np.minimum(first + 1, len(step) - 1)], 0)
        edges = np.flatnonzero(fresh[first])
        cuts = np.concatenate([np.arange(a, z, PACK) for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(first)], strict=True)])
        lists = [pa.ListArray.from_arrays(pa.array(np.append(cuts, len(first)).astype(np.int32)), pa.array(x)) for x in (doc[first], low[first], steps, times)]
        return pa.RecordBatch.from_arrays([pa.array(cx[first][cuts]), pa.array(cy[first][cuts]), *lists], [f.split()[0] for f in PACKED.split(", ")])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= HELD:
            yield pack(held)
            held = []
    if held:
        yield pack(held)


def _placer(inside: bool):
    """The spans of listed occurrences: as ``all`` says, at the class's first occurrence as ``less`` says."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                docs, lows, steps, times = (batch.column(c)[row].values.to_numpy() for c in range(4))
                head, spans = batch.column(4)[row].as_py(), [batch.column(c)[row].as_py() for c in (5, 6)]
                entry = np.repeat(np.arange(len(docs)), times)
                doc, low = docs[entry], lows[entry] + steps[entry] * (np.arange(len(entry)) - (np.cumsum(times) - times)[entry])
                leads = (doc == head["doc_id"]) & ((low == head["low"]) | (not inside))
                for span, some in zip(spans, (~leads, leads), strict=True):
                    if span["begin"] is not None and some.any():
                        at, _, begin, stop = _touching(doc[some], np.zeros(int(some.sum()), np.int64), low[some] + span["begin"], low[some] + span["stop"])
                        sources = pa.array([span["sources"]], pa.list_(pa.int64())).take(pa.array(np.zeros(len(at), np.int64)))
                        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(begin.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.nulls(len(at), pa.int64()), sources], [f.split()[0] for f in PLACED.split(", ")])

    return place


def _class_spans(met: DataFrame, inside: bool) -> DataFrame:
    """(doc_id, begin, stop, source, sources): spans of occurrences as their classes have them, and where the windows stand first."""
    windows, key, name = met.where("x is not null"), ["x", "y"], ["cx", "cy"]
    if inside:
        place = F.struct("doc_id", (F.col("low") + F.col("begin")).alias("begin"))
        shared = windows.groupBy(key).agg(F.min(place).alias("at"), F.count("*").alias("n"), F.max("several").alias("several")).where("n > 1 or several")
        shared = shared.select(*key, F.col("at.doc_id").alias("first"), F.col("at.begin").alias("there"))
    else:
        shared = windows.groupBy(key).agg(F.min("doc_id").alias("first"), F.max("last").alias("last")).where("first <> last").drop("last")
    late = windows.select(*key, *name, "doc_id", F.col("low") if inside else F.lit(0).alias("low"), "begin", "stop").join(shared, key)
    late = late.withColumn("base", F.col("there") - F.col("begin") if inside else F.lit(0))  # where the first occurrence lies
    late = late.groupBy(*name, "first", "base").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"), F.min(F.struct("doc_id", "low")).alias("head"))
    late = late.groupBy(*name).agg(F.min("head").alias("head"), F.collect_list(F.struct("first", "base", "begin", "stop")).alias("all"))
    late = late.withColumn("less", F.filter("all", lambda s: (s["first"] != F.col("head.doc_id")) | (s["base"] != F.col("head.low"))))
    both = [F.struct(F.array_min(f"{c}.begin").alias("begin"), F.array_max(f"{c}.stop").alias("stop"), F.array_distinct(f"{c}.first").alias("sources")).alias(c) for c in ("all", "less")]
    late = late.select(*name, "head", *both)
    members = met.where("x is null and cx is not null").select(*name, "doc_id", "low").mapInArrow(_packer, PACKED).join(late, name)
    return members.select("docs", "lows", "steps", "times", "head", "all", "less").mapInArrow(_placer(inside), PLACED)


def repeated_spans(docs: DataFrame, run: int = RUN, inside: bool = False) -> DataFrame:
    """(doc_id, begin, stop, first_docs): byte spans that repeat text of a document before.

    ``inside`` adds spans that repeat earlier text of the same document.

    ``first_docs`` holds the doc_ids where the span's windows stand first.
    """
    if run <= GRAM:
        raise ValueError(f"run must be over {GRAM}")
    K.bounded_batches(docs)
    texts = docs.where("doc_id is not null and length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.mapInArrow(_anchorer(run), "k long, doc_id long, n long")
    counts = found.groupBy("k").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last"), F.count("*").alias("rows"), F.sum("n").alias("n"))
    seen = counts.where("n > 1" if inside else "lead <> last").select("k", "lead", F.ceil(F.col("rows") / PART).cast("int").alias("parts"), (F.col("n") > 2).alias("many"))
    wanted = found.select("k", "doc_id").join(seen, "k").groupBy("doc_id").agg(F.collect_list(F.struct("k", "lead", "parts", "many")).alias("wanted"))
    contexts = texts.join(wanted, "doc_id").select("doc_id", F.xxhash64("text").alias("t"), "text", "wanted").mapInArrow(_contexts(run), CONTEXT)
    order = ("source", "part", "k", "follows", "doc_id", "t", "low")
    sorted_ = contexts.repartition("source", "part").sortWithinPartitions(*order)  # a text's contexts stay side by side
    met = Staged(sorted_.mapInArrow(_extender(run), MET), "met").df
    docs.sparkSession._jvm.System.gc()  # shuffle files go with their plans
    again = met.where("x is null and cx is null").select("doc_id", "begin", "stop", "source", F.lit(None).cast("array<long>").alias("sources"))
    again = (again if inside else again.where("source <> doc_id")).union(_class_spans(met, inside))
    by_doc = Window.partitionBy("doc_id").orderBy("begin", "stop")
    before = F.max("stop").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = again.withColumn("fresh", F.coalesce((before < F.col("begin")).cast("int"), F.lit(1))).withColumn("run", F.sum("fresh").over(by_doc))
    sources = F.array_sort(F.array_distinct(F.concat(F.collect_set("source"), F.flatten(F.collect_set("sources")))))
    spans = runs.groupBy("doc_id", "run").agg(F.min("begin").cast("long").alias("begin"), F.max("stop").cast("long").alias("stop"), sources.alias("first_docs"))
    return spans.select("doc_id", "begin", "stop", "first_docs")


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if spans:
                raw, at, kept = text.encode(), 0, []
                for s in sorted(spans, key=lambda s: s["begin"]):
                    kept.append(raw[at : s["begin"]])
                    at = max(at, s["stop"])
                text = b"".join([*kept, raw[at:]]).decode()
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text): every row's text without its repeated spans."""
    spans = repeated_spans(docs, **options).groupBy("doc_id").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_cutter, "doc_id long, text string")


def op10_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    """All spans of documents that repeat earlier text, with the documents where that text stands first."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
