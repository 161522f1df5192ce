"""Hierarchical Pitman-Yor word model, scored over all documents.

A context restaurant serves the words that follow words of one class (the hash of the word before, to CONTEXTS classes;
the start of a text is a word of its own); all context restaurants share one parent, whose own parent is the
uniform distribution over the known words and one unknown.  A table of a context restaurant is a customer of the parent.

Texts are cut into chunks of bounded size, inside tasks.  A chunk keeps its tokens as numbers of its distinct (word, context) pairs and
sends those pairs, each once, to the bucket of the word: there the counts of all chunks meet, so whole dishes of all restaurants lie
together, and what they need from elsewhere are totals of CONTEXTS restaurants.  A sweep of the Gibbs sampler is one pass over the
buckets; it seeds its draws by bucket and sweep, and replays earlier sweeps from their totals, so no seating is stored and a lost task comes out
alike.  Predictive probabilities, averaged over the sweeps after burn-in, go back to the chunks in the order in which these asked.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .near_dedup import _WordHashes

#: Classes of the word before: context restaurants, whose totals every task holds.
CONTEXTS = 1 << 16
#: UTF-8 bytes and rows in a chunk (a longer text is a chunk of its own), text bytes for each bucket of words, and pairs that are merged at once.
CHUNK_BYTES, CHUNK_ROWS, BUCKET_BYTES, GROUP_PAIRS = 8 << 20, 1 << 16, 8 << 20, 2_500_000
#: Sweeps of the sampler, each of which seats all customers anew, and those of them before samples count.
SWEEPS, BURN_IN = 3, 1
#: Customers of a dish whose tables are drawn at once, customers of a larger dish that leave together (and most tables that are drawn at once), and chances in memory.
DRAWN, BLOCK, CELLS = 2048, 512, 1 << 18
#: Strengths of the context restaurants and of their parent.
STRENGTH, PARENT_STRENGTH = 1.0, 10.0
#: Values that no word has, as no word holds white space.
START, END = xxhash.xxh64_intdigest(b"\t"), xxhash.xxh64_intdigest(b"\n")

_words = _WordHashes()
_PAIRS = "chunk long, bucket int, pairs long, w binary, n binary, ctx binary, cnt binary"


def pack(values: np.ndarray) -> bytes:
    """Bytes of an array, equal places of all values side by side, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes, dtype: type) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).reshape(-1).view(dtype)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text (A-Z lower-cased), and END."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter((*map(_words.__getitem__, words), END), np.uint64, len(words) + 1)


def context_class(before: np.ndarray) -> np.ndarray:
    return ((before * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a word: rises with its hash, so that words in the order of their hashes are in that of their buckets."""
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _chunk(ids: list, train: list[bool], texts: list[np.ndarray], buckets: int, kind: pa.DataType) -> pa.RecordBatch:
    size = np.array([len(t) for t in texts])
    words = np.concatenate(texts)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.cumsum(size) - size] = START
    own, at = np.unique(words, return_inverse=True)
    codes, seq = np.unique(at.astype(np.int64) << 16 | context_class(before), return_inverse=True)
    count = np.bincount(seq[np.repeat(np.array(train, bool), size)], minlength=len(codes)).astype(np.uint32)
    n = np.bincount(codes >> 16, minlength=len(own))
    ctx, ends = (codes & 0xFFFF).astype(np.uint16), np.concatenate([[0], np.cumsum(n)])
    where = bucket_of(own, buckets)
    starts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    name, rows = uuid.uuid4().int >> 65, []
    for a, b in zip(starts, [*starts[1:], len(own)], strict=True):
        i, j = ends[a], ends[b]
        rows.append((int(where[a]), int(j - i), pack(own[a:b]), pack(n[a:b].astype(np.uint32)), pack(ctx[i:j]), pack(count[i:j])))
    # Only sums over a text are wanted of its tokens: they are kept in order of their pairs, as differences, which take fewer bytes.
    kept = np.sort(np.repeat(np.arange(len(size)), size) << 32 | seq) & 0xFFFFFFFF
    cols = list(zip((-1, len(codes), pack(np.diff(kept, prepend=0).astype(np.int32)), b"", b"", b""), *rows, strict=True))
    lone = [None] * len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(cols[0]), pa.int64()), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:]),
         pa.array([ids, *lone], pa.list_(kind)), pa.array([train, *lone], pa.list_(pa.bool_())), pa.array([size.tolist(), *lone], pa.list_(pa.int64()))],
        ["chunk", "bucket", "pairs", "w", "n", "ctx", "cnt", "ids", "train", "tokens"])


def _chunks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, train, texts, size, kind = [], [], [], 0, pa.null()
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, known, text in zip(*batch.columns, strict=True):
                t = text.as_py()
                ids.append(i.as_py())
                train.append(known.as_py())
                texts.append(word_hashes(t))
                size += len(t or "")
                if size >= CHUNK_BYTES or len(ids) >= CHUNK_ROWS:
                    yield _chunk(ids, train, texts, buckets, kind)
                    ids, train, texts, size = [], [], [], 0
        if ids:
            yield _chunk(ids, train, texts, buckets, kind)

    return run


class Counts(NamedTuple):
    """Distinct words of a bucket (rising), contexts of each, and classes and counts of the pairs, in that order."""

    w: np.ndarray
    n: np.ndarray
    ctx: np.ndarray
    cnt: np.ndarray


def read_counts(row: dict) -> Counts:
    return Counts(unpack(row["w"], np.uint64), unpack(row["n"], np.uint32).astype(np.int64), unpack(row["ctx"], np.uint16), unpack(row["cnt"], np.uint32 if row["chunk"] is not None else np.int64).astype(np.int64))


def _merged(parts: list[Counts]) -> Counts:
    own, at = np.unique(np.concatenate([p.w for p in parts]), return_inverse=True)
    first = np.concatenate([[0], np.cumsum([len(p.w) for p in parts])])
    codes = np.concatenate([np.repeat(at[a:b].astype(np.int64), p.n) << 16 | p.ctx for p, a, b in zip(parts, first, first[1:], strict=False)])
    codes, place = np.unique(codes, return_inverse=True)
    cnt = np.zeros(len(codes), np.int64)
    np.add.at(cnt, place, np.concatenate([p.cnt for p in parts]))
    return Counts(own, np.bincount(codes >> 16, minlength=len(own)), (codes & 0xFFFF).astype(np.uint16), cnt)


def _trained(c: Counts) -> Counts:
    """Only what training has seen."""
    seen = c.cnt > 0
    n = np.bincount(np.repeat(np.arange(len(c.w)), c.n)[seen], minlength=len(c.w))
    return Counts(c.w[n > 0], n[n > 0], c.ctx[seen], c.cnt[seen])


def _merge(group: pa.Table) -> pa.Table:
    """One row of all that the chunks (or earlier merges, whose chunk is null) of a bucket counted in training."""
    rows = group.select(["chunk", "bucket", "salts", "w", "n", "ctx", "cnt"]).to_pylist()
    c = _merged([_trained(read_counts(r)) for r in rows])
    out = {"chunk": None, "bucket": rows[0]["bucket"], "salts": rows[0]["salts"], "pairs": len(c.ctx), "w": pack(c.w), "n": pack(c.n.astype(np.uint32)), "ctx": pack(c.ctx), "cnt": pack(c.cnt)}
    return pa.Table.from_pylist([out] if len(c.w) else [], pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("salts", pa.int32()), ("pairs", pa.int64()), *((k, pa.binary()) for k in ("w", "n", "ctx", "cnt"))]))


class Totals(NamedTuple):
    """After a sweep: tables of each context restaurant, customers and tables of the parent."""

    tables: np.ndarray
    customers: int
    parent_tables: int


class Model(NamedTuple):
    words: int
    tokens: int
    seated: np.ndarray  # customers of each context restaurant
    discount: float
    parent_discount: float
    sweeps: tuple[Totals, ...]  # the first one: before any sweep

    def parent(self, totals: Totals, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's predictive probability of dishes with these customers and tables."""
        left = PARENT_STRENGTH + self.parent_discount * totals.parent_tables
        return (customers - self.parent_discount * tables + left / (self.words + 1)) / (PARENT_STRENGTH + totals.customers)

    def predictive(self, totals: Totals, ctx: np.ndarray, cnt: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        return (cnt - self.discount * tables + (STRENGTH + self.discount * totals.tables[ctx]) * parent) / (STRENGTH + self.seated[ctx])


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating the customers of each dish one by one: a new table with `weight`, one of the dish's with its size less the
    discount.  From the 256th on in blocks of a sixteenth of those seated, so that a dish of any size takes few steps."""
    tables, i = np.minimum(customers, 1), 1
    active = np.flatnonzero(customers > 1)
    while len(active):
        step = 1 if i < 256 else i // 16
        w, t = weight[active], tables[active]
        tables[active] = t + rng.binomial(np.minimum(step, customers[active] - i), w / (w + i - discount * t))
        i += step
        active = active[customers[active] > i]
    return tables


@lru_cache(4)
def _law(discount: float, rows: int, cols: int) -> np.ndarray:
    """Logarithm of the weight of all seatings of c customers (row) at t tables (column), where a new table weighs 1 and one of the dish's its size less the discount."""
    out, t = np.full((rows + 1, cols + 1), -np.inf), np.arange(1, cols + 1)
    out[0, 0] = 0
    with np.errstate(divide="ignore"):
        for c in range(1, rows + 1):
            out[c, 1:] = np.logaddexp(out[c - 1, :-1], out[c - 1, 1:] + np.log(np.maximum(c - 1 - discount * t, 0)))
    return out


def _pick(log: np.ndarray, rng: np.random.Generator) -> int:
    sums = np.cumsum(np.exp(log - log.max()))
    return int(np.searchsorted(sums, rng.random() * sums[-1], "right"))


def _drawn(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes of 1..DRAWN customers, from their law given the weights; 0 where that goes on beyond BLOCK tables."""
    law, out = _law(discount, DRAWN, BLOCK), np.zeros(len(customers), np.int64)
    order = np.argsort(customers, kind="stable")
    sizes, a = customers[order], 0
    while a < len(order):
        most = int(sizes[a] + sizes[a] // 4)
        width = min(BLOCK, most)
        b = min(int(np.searchsorted(sizes, most, "right")), a + max(1, CELLS // width))
        x = law[sizes[a:b], 1 : width + 1] + np.log(weight[order[a:b]])[:, None] * np.arange(1, width + 1)
        x = np.exp(x - x.max(1, keepdims=True))
        # The law has one peak and its logarithm is concave, so what follows a chance as small is smaller still.
        whole = (sizes[a:b] <= width) | (x[:, -1] < 1e-17)
        np.cumsum(x, 1, out=x)
        out[order[a:b]] = np.where(whole, 1 + (x < (rng.random(b - a) * x[:, -1])[:, None]).sum(1), 0)
        a = b
    return out


def _apart(weight: np.ndarray, discount: float) -> np.ndarray:
    """Logarithm of the weight of all seatings of 0..BLOCK customers (columns) at new tables alone, over the factorial of their number, for each weight of a new table."""
    fall = np.cumprod(np.concatenate([[1.0], (np.arange(1, BLOCK) - discount) / np.arange(1, BLOCK)]))[::-1].copy()
    kept, scale = np.zeros((len(weight), BLOCK + 1)), np.zeros(len(weight))
    kept[:, 0] = 1
    out = np.zeros_like(kept)
    for i in range(1, BLOCK + 1):
        kept[:, i] = weight / i * (kept[:, :i] @ fall[BLOCK - i :])
        out[:, i] = np.log(kept[:, i]) + scale
        large = kept[:, i] > 1e100
        kept[large] *= 1e-100
        scale[large] += 100 * math.log(10)
    return out


def _sizes(c: int, t: int, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Sizes of the t tables of c customers: backwards, who opened a table, then forwards, where the others sat down."""
    law, left, opens = _law(discount, DRAWN, BLOCK), t, np.zeros(c, bool)
    for i, u in zip(range(c, 0, -1), rng.random(c).tolist(), strict=True):
        if u < math.exp(law[i - 1, left - 1] - law[i, left]):
            opens[i - 1] = True
            left -= 1
    out, t = np.zeros(t, np.int64), 0
    for i, new in enumerate(opens.tolist()):
        if new:
            out[t] = 1
            t += 1
        else:
            seats = np.cumsum(out[:t] - discount)
            out[min(int(np.searchsorted(seats, rng.random() * (i - discount * t), "right")), t - 1)] += 1
    return out


def _reseat_blocks(sizes: np.ndarray, weight: float, apart: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Sizes of a dish's tables after each of its customers has left once and been seated anew, BLOCK at a time, given all others."""
    law, old, new, ahead = _law(discount, DRAWN, BLOCK), sizes, np.zeros_like(sizes), int(sizes.sum())
    while ahead:
        m = min(BLOCK, ahead)
        gone = np.searchsorted(np.cumsum(old), rng.choice(ahead, m, replace=False, shuffle=False), "right")
        old, ahead = old - np.bincount(gone, minlength=len(old)), ahead - m
        stays = old + new > 0
        old, new = old[stays], new[stays]
        rest, at = old + new, np.arange(m)
        with np.errstate(divide="ignore"):
            join = np.cumsum(np.log((rest.sum() - discount * len(rest) + at) / (at + 1)))
        fresh = _pick(np.concatenate([join[::-1], [0]]) + apart[: m + 1], rng)
        if fresh < m:
            share = rng.standard_gamma(rest - discount)
            new = new + rng.multinomial(m - fresh, share / share.sum())
        if fresh:
            t = 1 + _pick(law[fresh, 1 : fresh + 1] + math.log(weight) * np.arange(1, fresh + 1), rng)
            old, new = np.concatenate([old, np.zeros(t, np.int64)]), np.concatenate([new, _sizes(fresh, t, discount, rng)])
    return new


def reseat(customers: np.ndarray, tables: np.ndarray, weight: np.ndarray, discount: float, passes: int, rng: np.random.Generator, held: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Tables after all customers of each dish have, `passes` times, left their tables and been seated anew (Gibbs).

    The tables of a dish of up to DRAWN customers are drawn at once from their law given the weights.  Those of a larger dish, or of one
    whose law goes on beyond BLOCK tables, leave in blocks, each customer once a pass.  held takes the sizes of such a dish's tables on to the next call;
    without them a pass starts from sizes dealt by gamma shares.
    """
    out, held = tables.copy(), {} if held is None else held
    for _ in range(passes):
        few = np.flatnonzero((customers > 1) & (customers <= DRAWN))
        drawn = _drawn(customers[few], weight[few], discount, rng)
        out[few] = np.where(drawn > 0, drawn, out[few])
        large = np.concatenate([few[drawn == 0], np.flatnonzero(customers > DRAWN)])
        for at in range(0, len(large), 256):
            part = large[at : at + 256]
            for k, apart in zip(part.tolist(), _apart(weight[part], discount), strict=True):
                if k not in held:
                    share = rng.standard_gamma(1 - discount, out[k]) + 1e-12
                    held[k] = 1 + rng.multinomial(customers[k] - out[k], share / share.sum())
                held[k] = _reseat_blocks(held[k], float(weight[k]), apart, discount, rng)
                out[k] = len(held[k])
    return out


def _start(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables from which reseat starts: one a dish, and a first seating of those dishes that may be seated in blocks."""
    tables, large = np.minimum(customers, 1), customers > BLOCK
    tables[large] = seat(customers[large], weight[large], discount, rng)
    return tables


def sweeps(bucket: int, c: Counts, model: Model, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tables of the pairs, and customers and tables of the parent's dishes, after each of the sweeps 1..upto; sweep k rests on the totals after k - 1."""
    word = np.repeat(np.arange(len(c.w)), c.n)
    tables, customers, parents = np.minimum(c.cnt, 1), c.n, np.minimum(c.n, 1)
    held: dict[int, np.ndarray] = {}
    for k in range(1, upto + 1):
        rng, last = np.random.default_rng((bucket, k)), model.sweeps[k - 1]
        weight = (STRENGTH + model.discount * last.tables[c.ctx]) * model.parent(last, customers, parents)[word]
        tables = _start(c.cnt, weight, model.discount, rng) if k == 1 else tables
        tables = reseat(c.cnt, tables, weight, model.discount, 1, rng, held)
        customers = np.bincount(word, tables, minlength=len(c.w)).astype(np.int64)
        above = np.full(len(c.w), (PARENT_STRENGTH + model.parent_discount * last.parent_tables) / (model.words + 1))
        parents = reseat(customers, _start(customers, above, model.parent_discount, rng), above, model.parent_discount, 1, rng)
        yield tables, customers, parents


def _sums(of: Callable[[int, Counts], np.ndarray]):
    """Per task, the sum over its buckets of an array of whole numbers, in blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                own = of(row["bucket"], read_counts(row | {"chunk": None}))
                total = own if total is None else total + own
        if total is not None:
            blocks = [total[i : i + 4096] for i in range(0, len(total), 4096)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.list_(pa.int64()))], ["block", "sums"])

    return run


def _add(group: pa.Table) -> pa.Table:
    sums = np.stack([np.asarray(s.values) for s in group["sums"].combine_chunks()]).sum(0)
    return pa.table({"block": group["block"][:1], "sums": pa.array([sums], pa.list_(pa.int64()))})


def _sum_arrays(buckets: DataFrame, of: Callable[[int, Counts], np.ndarray], size: int) -> np.ndarray:
    parts = buckets.select("bucket", "w", "n", "ctx", "cnt").mapInArrow(_sums(of), "block int, sums array<long>").groupBy("block").applyInArrow(_add, "block int, sums array<long>")
    rows = sorted(parts.collect(), key=lambda r: r["block"])
    return np.concatenate([r["sums"] for r in rows]) if rows else np.zeros(size, np.int64)


def fit_model(buckets: DataFrame, passes: int = SWEEPS) -> Model:
    """Run the sampler over bucket rows; what reaches the driver are totals, CONTEXTS numbers and some more for each pass."""
    by_ctx = lambda c, v: np.bincount(c.ctx, v, minlength=CONTEXTS).astype(np.int64)

    def count(_: int, c: Counts) -> np.ndarray:
        own = [len(c.w), c.cnt.sum(), len(c.cnt), *((v == k).sum() for v in (c.cnt, c.n) for k in (1, 2))]
        return np.concatenate([by_ctx(c, c.cnt), by_ctx(c, np.ones(len(c.ctx))), np.array(own, np.int64)])

    first = _sum_arrays(buckets, count, 2 * CONTEXTS + 7)
    words, tokens, pairs, one, two, p_one, p_two = (int(x) for x in first[2 * CONTEXTS :])
    # Discounts from the counts of counts.
    discount = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5
    model = Model(words, tokens, first[:CONTEXTS], discount(one, two), discount(p_one, p_two), (Totals(first[CONTEXTS : 2 * CONTEXTS], pairs, words),))
    for k in range(1, passes + 1):
        def after(bucket: int, c: Counts, model: Model = model, k: int = k) -> np.ndarray:
            *_, (tables, customers, parents) = sweeps(bucket, c, model, k)
            return np.concatenate([by_ctx(c, tables), [customers.sum(), parents.sum()]])

        total = _sum_arrays(buckets, after, CONTEXTS + 2)
        model = model._replace(sweeps=(*model.sweeps, Totals(total[:CONTEXTS], int(total[-2]), int(total[-1]))))
    return model


def _answers(model: Model, burn_in: int):
    """For the pairs that chunks ask of a bucket: log10 of the averaged predictive probability of each, and each word's count in training."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("pairs", pa.int64()), *((k, pa.binary()) for k in ("w", "n", "ctx", "cnt"))])
    samples = range(burn_in + 1, len(model.sweeps))

    def run(asked: pa.Table, trained: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return schema.empty_table()
        known = trained.select(["bucket", "w", "n", "ctx", "cnt"]).to_pylist()
        c = read_counts(known[0] | {"chunk": None}) if known else Counts(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint16), np.zeros(0, np.int64))
        word = np.repeat(np.arange(len(c.w)), c.n)
        seen, parents = np.zeros(len(c.ctx)), []
        for k, (tables, customers, own) in enumerate(sweeps(known[0]["bucket"] if known else 0, c, model, len(model.sweeps) - 1), 1):
            if k in samples:
                parents.append(model.parent(model.sweeps[k], customers, own))
                seen += model.predictive(model.sweeps[k], c.ctx, c.cnt, tables, parents[-1][word]) / len(samples)
        total = np.bincount(word, c.cnt, minlength=len(c.w)).astype(np.int64)
        codes = np.arange(len(c.w)).repeat(c.n) << 16 | c.ctx
        rows = []
        for row in asked.select(["chunk", "bucket", "w", "n", "ctx"]).to_pylist():
            w, n, ctx = unpack(row["w"], np.uint64), unpack(row["n"], np.uint32).astype(np.int64), unpack(row["ctx"], np.uint16)
            at = np.minimum(np.searchsorted(c.w, w), max(len(c.w) - 1, 0))
            is_known = c.w[at] == w if len(c.w) else np.zeros(len(w), bool)
            pair_word, pair_known = np.repeat(at, n), np.repeat(is_known, n)
            p = np.zeros(len(ctx))
            for k, own in zip(samples, parents or [np.zeros(0)] * len(samples), strict=True):
                fresh = model.parent(model.sweeps[k], np.zeros(1), np.zeros(1))[0]
                parent = np.where(pair_known, own[pair_word], fresh) if len(c.w) else np.full(len(ctx), fresh)
                p += model.predictive(model.sweeps[k], ctx, np.zeros(1), np.zeros(1), parent) / len(samples)
            if len(codes):
                code = pair_word.astype(np.int64) << 16 | ctx
                hit = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                p = np.where(pair_known & (codes[hit] == code), seen[hit], p)
            cw = np.where(is_known, total[at], 0) if len(c.w) else np.zeros(len(w), np.int64)
            rows.append((row["chunk"], row["bucket"], len(ctx), pack(np.log10(p).astype(np.float32)), row["n"], pack(cw), b""))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _scores(model: Model, id_type: pa.DataType | None = None):
    def run(group: pa.Table) -> pa.Table:
        own = group.filter(pc.equal(group["bucket"], -1))
        answers = group.select(["bucket", "w", "n", "ctx"]).filter(pc.not_equal(group["bucket"], -1)).sort_by("bucket").to_pylist()
        log_p = np.concatenate([unpack(r["w"], np.float32) for r in answers]).astype(np.float64)
        count = np.concatenate([np.repeat(unpack(r["ctx"], np.int64), unpack(r["n"], np.uint32)) for r in answers])
        base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
        seq, size = np.cumsum(unpack(own["w"][0].as_py(), np.int32)), np.asarray(own["tokens"].combine_chunks().values)
        start = np.cumsum(size) - size
        add = lambda v: np.add.reduceat(v[seq], start)
        return pa.Table.from_arrays(
            [own["ids"].combine_chunks().values, pc.invert(own["train"].combine_chunks().values), pa.array(size), pa.array(add((count > 0).astype(np.int64))),
             pa.array(np.full(len(size), model.tokens, np.int64)), pa.array(add(base)), pa.array(add(log_p))],
            ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", passes: int = SWEEPS, burn_in: int = BURN_IN) -> DataFrame:
    """(id_col, held_out boolean, n_tokens, n_known, train_tokens long, base_score, score double) for every row of docs.

    The model is learned from the rows for which `train` holds (null: they are held out) and gives log10 of the probability of each whole
    text: its words (A-Z lower-cased, parted by ASCII white space) and one end.  n_known are the tokens that training holds, train_tokens all tokens of training,
    base_score the sum of log10((c + 0.1) / (train_tokens + 0.1 * (distinct + 1))).  A null text counts as empty: its end alone.  Null and repeated ids
    are rows like any other, and repeated rows count as often as they stand.  With no rows to learn from every token has probability 1.  Very
    long texts are chunks of their own.  An empty table gives an empty result.  Other columns aren't read.  Words are told apart by 64-bit hashes.

    A word with very many pairs has its bucket's requests dealt over salts and its counts merged in two steps; a bucket holds CONTEXTS pairs
    for a word at most.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    size = base.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    extra = f", ids array<{kind}>, train array<boolean>, tokens array<long>"
    chunks = cut(base.mapInArrow(_chunks(max(1, -(-size // BUCKET_BYTES))), _PAIRS + extra))
    asked = chunks.where("bucket >= 0").select("chunk", "bucket", "pairs", "w", "n", "ctx", "cnt")
    large = cut(asked.groupBy("bucket").agg(F.ceil(F.sum("pairs") / GROUP_PAIRS).cast("int").alias("salts")).where("salts > 1"))
    asked = asked.join(large, "bucket", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.pmod("chunk", "salts").cast("int"))
    merged = "chunk long, bucket int, salts int, pairs long, w binary, n binary, ctx binary, cnt binary"
    part = cut(asked.groupBy("bucket", "salt").applyInArrow(_merge, merged))
    buckets = part.where("salts = 1")
    if not large.isEmpty():
        buckets = buckets.union(cut(part.where("salts > 1").groupBy("bucket").applyInArrow(_merge, merged)))
    model = fit_model(buckets, passes)
    spread = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    answers = asked.drop("cnt").groupBy("bucket", "salt").cogroup(spread.groupBy("bucket", "salt")).applyInArrow(_answers(model, burn_in), _PAIRS)
    own = chunks.where("bucket = -1")
    rows = own.unionByName(answers, allowMissingColumns=True).groupBy("chunk").applyInArrow(
        _scores(model), f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return rows.withColumnRenamed("id", id_col)
