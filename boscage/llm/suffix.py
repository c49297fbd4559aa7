"""Repeated passages by a sparse suffix array.

Suffixes are retained at content-selected positions: a run of k words is a
minimiser if its hash is least among some w = least - k + 1 consecutive runs.
Each passage of ``least`` words holds one at the same place wherever it
stands, so equal passages meet at equal anchors.

1. Anchors that occur once are dropped by a count per hash.
2. Of the others the suffix (``least`` words) and what precedes it come from
   the text.  Suffixes are sorted, neighbours are compared word by word, and
   the longest common prefixes give the runs of suffixes that agree on r words.
   Inside a run a match is extended to the left by least - r words.
3. The windows of ``least`` words so found, joined, are the spans.

The result is exact: a window is in a span if and only if it occurs twice or
more (equality of words by 64-bit and 32-bit hashes).  Anchors that occur more
than ``hot`` times don't meet in one task: their windows are counted by a
map-side combined aggregate instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batches, ddl, fields, rows, thrifty
from .store import Scratch, join_groups, width
from .tables import parted, rewritten, table
from .words import U, Words, buffers, mix, pieces, signed

_ANCHORS = fields(kh="long", rk="long", pos="int")
_CONTEXTS = fields(kh="long", suffix="binary", left="binary", doc_id="long", rk="long", pos="int", near="int", far="int")
_MARKS = fields(rk="long", doc_id="long", lo="int", hi="int", drop="boolean", first_doc_id="long")
_WINDOWS = fields(w1="long", w2="long", doc_id="long", rk="long", pos="int")
_SPANS = fields(doc_id="long", rk="long", span_start="long", span_end="long", n_words="long", n_dropped="long", first_doc_id="long")

#: Bytes of text and number of anchors that a task works on at a time.
TEXTS, STEP = 1 << 19, 8_000


def _slide(x: np.ndarray, w: int, of) -> np.ndarray:
    """out[i] = of over x[i : i + w], for each i with a whole window."""
    span = 1
    while span * 2 <= w:
        x = of(x[: len(x) - span], x[span:])
        span *= 2
    rest = w - span
    return of(x[: len(x) - rest], x[rest:]) if rest else x


def _least(words: Words, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of k words (hash, index of the first word), and the least hash of
    each w consecutive ones, 0 where they cross a row's end."""
    h, at = words.grams(k)
    h = h | U(1)
    if len(h) < w:
        return h, at, h[:0]
    least = _slide(h, w, np.minimum)
    row = words.row[at]
    return h, at, np.where(row[: len(least)] == row[w - 1 :], least, U(0))


def minimisers(words: Words, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its first word) of each selected run of k words."""
    h, at, least = _least(words, k, w)
    if not len(least):
        return h[:0], at[:0]
    edge = np.zeros(w - 1, U)
    most = _slide(np.concatenate([edge, least, edge]), w, np.maximum)
    chosen = most == h
    return h[chosen], at[chosen]


def _anchors(k: int, w: int):
    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            for part in pieces(batch, "text", TEXTS):
                words = Words(part.column(1))
                h, at = minimisers(words, k, w)
                row = words.row[at]
                key = part.column(0).to_numpy()[row]
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(key), pa.array((at - words.row_ptr[row]).astype(np.int32))], schema=_ANCHORS)

    return run


def _ragged(matrix: np.ndarray, length: np.ndarray) -> pa.Array:
    """The first length[i] words of each row, big-endian, as binary values."""
    data = matrix[np.arange(matrix.shape[1]) < length[:, None]].astype(">u4").tobytes()
    offsets = np.zeros(len(length) + 1, np.int32)
    np.cumsum(length * 4, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _whole(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _matrix(column: pa.Array, wide: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(column)
    length = np.diff(offsets) // 4
    out = np.zeros((len(length), wide), np.uint32)
    out[np.arange(wide) < length[:, None]] = np.frombuffer(data.tobytes(), ">u4")
    return out, length


def _contexts(k: int, least: int):
    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            for part in pieces(batch, "text", TEXTS):
                words = Words(part.column(1))
                short = (words.hash >> U(32)).astype(np.uint32)
                w = least - k + 1
                gram, start, low = _least(words, k, w)
                lists = part.column(3)
                pos = lists.flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                # places of another text with the same hash aren't places of this one
                at = words.row_ptr[row] + pos
                q = np.minimum(np.searchsorted(start, at), max(len(start) - 1, 0))
                use = (pos < words.count[row]) & (start[q] == at if len(start) else False)
                pos, row, at, q = pos[use], row[use], at[use], q[use]
                # a window that holds its least run twice or more belongs to the first of them
                order = np.lexsort((at, gram[q]))
                again = (gram[q[order[1:]]] == gram[q[order[:-1]]]) & (row[order[1:]] == row[order[:-1]])
                alone = np.full(len(pos), w, np.int64)
                alone[order[1:][again]] = np.maximum(np.diff(at[order])[again], 1)
                for i in range(0, len(pos), STEP):
                    p, r = pos[i : i + STEP].astype(np.int64), row[i : i + STEP]
                    at = words.row_ptr[r] + p
                    right = np.minimum(words.row_ptr[r + 1] - at, least)
                    left = np.minimum(p, least - k)
                    last = max(len(short) - 1, 0)
                    after = short[np.minimum(at[:, None] + np.arange(least), last)]
                    before = short[np.maximum(at[:, None] - 1 - np.arange(least - k), 0)]
                    # the windows whose own minimiser this is begin near to far words before it
                    q = np.searchsorted(start, at)
                    begin = q[:, None] - np.arange(w)
                    own = (begin >= 0) & (begin < len(low)) & (low[np.clip(begin, 0, len(low) - 1)] == gram[q][:, None])
                    near, far = np.argmax(own, axis=1), w - 1 - np.argmax(own[:, ::-1], axis=1)
                    far = np.minimum(far, alone[i : i + STEP] - 1)
                    some = near <= far
                    kh = signed(gram[q[some]])
                    meta = [part.column(c).take(pa.array(r[some])) for c in (0, 2)]
                    yield pa.RecordBatch.from_arrays([pa.array(kh), _ragged(after[some], right[some]), _ragged(before[some], left[some]), meta[0], meta[1], *[pa.array(x[some].astype(np.int32)) for x in (p, near, far)]], schema=_CONTEXTS)

    return run


def _left_hashes(left: np.ndarray) -> np.ndarray:
    out = np.zeros((left.shape[0], left.shape[1] + 1), U)
    for j in range(left.shape[1]):
        out[:, j + 1] = mix(out[:, j] * U(0x9E3779B97F4A7C15) + left[:, j].astype(U) + U(1))
    return out


def _prefixes(column: pa.Array, kh: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words each suffix shares with the one before (0: of another run), and its length."""
    n = len(kh)
    lcp, length = np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
    for i in range(0, n, STEP):
        right, rl = _matrix(column.slice(max(i - 1, 0), STEP + (i > 0)), least)
        same = (right[1:] == right[:-1]) & (np.arange(least) < np.minimum(rl[1:], rl[:-1])[:, None])
        to = min(i + STEP, n)
        lcp[max(i, 1) : to] = np.where(same.all(axis=1), least, np.argmin(same, axis=1))
        length[i:to] = rl[1:] if i else rl
    lcp[1:n][kh[1:] != kh[:-1]] = 0
    return lcp, length


def _mark(table_: pa.Table, k: int, least: int) -> pa.RecordBatch | None:
    """Marks of a sorted table of contexts that holds whole runs of kh.  Beside the
    table itself it takes some numbers for each context, however long a run is."""
    kh, doc, rk, pos, near, far = (table_.column(c).to_numpy() if c != "doc_id" else table_.column(c).combine_chunks() for c in ("kh", "doc_id", "rk", "pos", "near", "far"))
    doc_null = doc.is_null().to_numpy(zero_copy_only=False).astype(bool)
    doc = doc.fill_null(0).to_numpy()
    again = np.zeros(len(kh), bool)  # one position of one text once: rows may repeat
    again[1:] = (kh[1:] == kh[:-1]) & (rk[1:] == rk[:-1]) & (pos[1:] == pos[:-1])
    if again.any():
        return _mark(table_.filter(pa.array(~again)), k, least)
    n = len(kh)
    lcp, rl = _prefixes(_whole(table_.column("suffix")), kh, least)
    ink, offsets = buffers(_whole(table_.column("left")))
    ink, first_word, ll = ink.view(">u4"), offsets[:-1] // 4, np.diff(offsets) // 4
    before = np.zeros(n, U)
    order = np.empty(n, np.int64)
    order[np.lexsort((pos, rk, doc, doc_null))] = np.arange(n)
    big = np.iinfo(np.int32).max
    lo, hi = np.full((2, n), big, np.int64), np.full((2, n), -1, np.int64)
    owner = np.full(n, -1, np.int64)
    for r in range(least, k - 1, -1):
        j = least - r
        if j:  # a hash of the j words before, where there are as many
            has = np.flatnonzero(ll >= j)
            before[has] = mix(before[has] * U(0x9E3779B97F4A7C15) + ink[first_word[has] + (j - 1)].astype(U) + U(1))
        run = np.cumsum(lcp[:n] < r).astype(U)
        use = np.flatnonzero((near <= j) & (j <= far) & (rl >= r) & (ll >= j) & ((lcp[:n] >= r) | (lcp[1:] >= r)))
        if len(use) < 2:
            continue
        key = mix(run[use] * U(0xC2B2AE3D27D4EB4F) ^ before[use])
        use = use[np.lexsort((order[use], key))]
        key = mix(run[use] * U(0xC2B2AE3D27D4EB4F) ^ before[use])
        new = np.ones(len(use), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(use)))
        twice = np.repeat(size > 1, size)
        first = np.repeat(use[start], size)[twice]
        use = use[twice]
        drop = (use != first).astype(np.int64)
        at = pos[use] - j
        lo[drop, use] = np.minimum(lo[drop, use], at)
        hi[drop, use] = np.maximum(hi[drop, use], at + least)
        better = (owner[use] < 0) | (order[first] < order[owner[use]])
        owner[use[better]] = first[better]
    out = []
    for drop in (0, 1):
        i = np.flatnonzero(hi[drop] >= 0)
        ids = [pa.array(doc[x], pa.int64(), mask=doc_null[x]) for x in (i, owner[i])]
        out.append(pa.RecordBatch.from_arrays([pa.array(rk[i]), ids[0], pa.array(lo[drop][i].astype(np.int32)), pa.array(hi[drop][i].astype(np.int32)), pa.array(np.full(len(i), bool(drop))), ids[1]], schema=_MARKS))
    return pa.concat_batches(out)


def _compare(k: int, least: int, chunk: int = 20_000):
    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in arriving:
            for i in range(0, batch.num_rows, chunk):
                part = batch.slice(i, chunk)
                kh = part.column(0).to_numpy()
                cut = int(np.searchsorted(kh, kh[-1]))  # the last run may go on
                if not cut and held and held[-1].column(0)[-1].as_py() != kh[0]:
                    held, size, whole = [], 0, held
                elif cut and size + cut >= chunk // 2:
                    held, size, whole, part = [], 0, [*held, part.slice(0, cut)], part.slice(cut)
                else:
                    whole = []
                if whole:
                    yield _mark(pa.Table.from_batches(whole), k, least)
                held.append(part)
                size += part.num_rows
        if size:
            yield _mark(pa.Table.from_batches(held), k, least)

    return run


def _windows(k: int, least: int):
    """Every window around an anchor, by two hashes."""

    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            for i in range(0, batch.num_rows, 5000):
                part = batch.slice(i, 5000)
                right, rl = _matrix(part.column(1), least)
                left, ll = _matrix(part.column(2), least - k)
                pos, near, far = (part.column(c).to_numpy() for c in (5, 6, 7))
                after, before = _left_hashes(right), _left_hashes(left)
                for j in range(least - k + 1):
                    use = np.flatnonzero((near <= j) & (j <= far) & (rl >= least - j) & (ll >= j))
                    w1 = mix(after[use, least - j] ^ mix(before[use, j] + U(j)))
                    w2 = mix(part.column(0).to_numpy()[use].view(U) ^ mix(w1 + before[use, j]))
                    meta = [part.column(c).take(pa.array(use)) for c in (3, 4)]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(w1)), pa.array(signed(w2)), *meta, pa.array((pos[use] - j).astype(np.int32))], schema=_WINDOWS)

    return run


def _counted(contexts: DataFrame, scratch: Scratch, k: int, least: int) -> DataFrame:
    """The marks of anchors that are too frequent for one task."""
    w = scratch.save(contexts.mapInArrow(thrifty(_windows(k, least)), ddl(_WINDOWS)).distinct(), "windows")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk", "pos")
    firsts = w.groupBy("w1", "w2").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = join_groups(w, scratch.save(firsts, "firsts"), ["w1", "w2"], "n")
    drop = ~(key.eqNullSafe(F.col("first")))
    return joined.select("rk", "doc_id", F.col("pos").alias("lo"), (F.col("pos") + least).alias("hi"), drop.alias("drop"), F.col("first.doc_id").alias("first_doc_id"))


def _union(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _without(spans: list[list[int]], kept: list[list[int]]) -> list[list[int]]:
    out = []
    for lo, hi in spans:
        for a, b in kept:
            if b <= lo or a >= hi:
                continue
            if a > lo:
                out.append([lo, a])
            lo = max(lo, b)
        if lo < hi:
            out.append([lo, hi])
    return out


def _merge(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a document from its marks: joined windows, and what of them goes."""

    def found():
        for rk, doc, marks in rows(arriving, 64):
            dropped = _union([(m["lo"], m["hi"]) for m in marks if m["drop"]])
            dropped = _without(dropped, _union([(m["lo"], m["hi"]) for m in marks if not m["drop"]]))
            marks.sort(key=lambda m: (m["lo"], m["hi"]))
            i = 0
            for lo, hi in _union([(m["lo"], m["hi"]) for m in marks]):
                first = None
                while i < len(marks) and marks[i]["lo"] < hi:
                    own = marks[i]["first_doc_id"]
                    first = own if first is None or own is not None and own < first else first
                    i += 1
                gone = sum(max(0, min(b, hi) - max(a, lo)) for a, b in dropped)
                yield doc, rk, lo, hi, hi - lo, gone, first, [x for a, b in dropped for x in (max(a, lo), min(b, hi)) if b > lo and a < hi]

    schema = _SPANS.append(pa.field("dropped", pa.list_(pa.int32())))
    yield from batches(found(), schema)


def repeated_spans(docs: DataFrame, least: int = 50, k: int = 16, text: str = "text", key: str = "doc_id", hot: int = 200_000) -> DataFrame:
    """One row per span of repeated words: doc_id, rk, span_start, span_end (word
    numbers), n_words, n_dropped, first_doc_id, dropped (start and end pairs).

    A span joins windows of ``least`` words that occur twice or more, in other
    documents or in the same one.  The first occurrence of each window, by
    doc_id and position, stays (null ids come last); other words of the span
    are dropped unless such a first window covers them.  Texts of fewer words,
    null and empty texts have no spans.  Rows equal in id and text are one
    document.  rk is a hash of id and text, which tells rows with equal ids apart.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    rk = F.xxhash64(F.col(key).cast("long"), F.col(text))
    own = docs.select(rk.alias("rk"), F.col(text).alias("text"), F.col(key).cast("long").alias("doc_id"))
    anchors = scratch.save(own.select("rk", "text").mapInArrow(thrifty(_anchors(k, least - k + 1)), ddl(_ANCHORS)), "anchors")
    at = F.struct("rk", "pos")
    counts = anchors.groupBy("kh").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("kh", "n")
    hits = join_groups(anchors, scratch.save(counts, "counts"), ["kh"], "n")
    hits = scratch.save(hits.select("rk", "pos", (F.col("n") > hot).alias("hot")), "hits")
    scratch.drop("anchors", "counts")
    lists = hits.groupBy("rk", "hot").agg(F.collect_set("pos").alias("positions"))
    joined = parted(own, "rk", hits, "rk")[0].join(lists, "rk").select("rk", "text", "doc_id", "positions", "hot")

    def contexts(df: DataFrame) -> DataFrame:
        return df.select("doc_id", "text", "rk", "positions").mapInArrow(thrifty(_contexts(k, least)), ddl(_CONTEXTS))

    some = contexts(joined.where(~F.col("hot"))).repartition(width(spark), "kh").sortWithinPartitions("kh", "suffix", "doc_id", "rk", "pos")
    marks = some.mapInArrow(thrifty(_compare(k, least)), ddl(_MARKS))
    if hits.where("hot").limit(1).count():
        marks = marks.unionByName(_counted(contexts(joined.where("hot")), scratch, k, least))
    grouped = marks.groupBy("rk", "doc_id").agg(F.collect_list(F.struct("lo", "hi", "drop", "first_doc_id")).alias("marks"))
    return grouped.mapInArrow(_merge, ddl(_SPANS) + ", dropped array<int>")


def _cut(text: pa.Array, dropped: pa.Array) -> pa.Array:
    out = []
    for part in pieces(pa.RecordBatch.from_arrays([text, dropped], names=["text", "dropped"]), "text", TEXTS):
        words = Words(part.column(0))
        for r, (own, spans) in enumerate(zip(part.column(0), part.column(1), strict=True)):
            own = own.as_py()
            if spans.is_valid:
                spans = spans.as_py()
                raw, base, ptr, at, left = own.encode(), words.offsets[r], words.row_ptr, 0, []
                for lo, hi in sorted(zip(spans[::2], spans[1::2], strict=True)):
                    left.append(raw[at : words.start[ptr[r] + lo] - base])
                    at = words.start[ptr[r] + hi] - base if hi < words.count[r] else len(raw)
                left.append(raw[at:])
                own = b"".join(left).decode()
            out.append(own)
    return pa.array(out, pa.string())


def remove_repeats(docs: DataFrame, least: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with dropped words cut out of the text; a document of which nothing
    is left goes.  Texts without dropped words are untouched, with all columns;
    n_chars, where there is one, follows the text."""
    scratch = Scratch(docs.sparkSession, "cut")
    spans = repeated_spans(docs, least=least, text=text, key=key).where("n_dropped > 0")
    gone = scratch.save(spans.groupBy("doc_id", "rk").agg(F.flatten(F.collect_list("dropped")).alias("dropped")), "spans")
    out = rewritten(docs, gone, "dropped", _cut, text, key)
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else out


def op2_suffix_dedup(spark, sf_dir):
    spans = repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "span_start", "span_end", "n_words", "n_dropped", "first_doc_id")
