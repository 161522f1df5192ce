"""MinHash near-dedup with SetSketch registers.

Every document's set of word shingles is sketched by exponentially spaced, truncated
minima (SetSketch registers: mergeable by maximum, equal with a probability close
to the Jaccard similarity).  Bands of register values make buckets; every member is
compared with its bucket's most central member (the leader), first by the joint
maximum-likelihood estimate from the registers, then exactly on the full sets.
Members that a leader does not link are compared exactly with the rest of that
leader's members, in blocks inside tasks, so large groups of near copies never
become a table of all pairs and no link between different texts is left out for
size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, likely_members, marked_members
from .components import connected_components

#: Parameters of the sketch: registers, base, rate and largest register value.
REGISTERS, BASE, RATE, TOP = 100, 1.001, 20.0, 2**16 - 2
#: Band width in registers.  At similarity 0.8 a pair shares none of the 25 bands with
#: probability 2e-6, at 0.85 with 1e-8.
BAND_ROWS = 4
#: A pair goes on to the exact comparison unless its likelihood estimate is this far below the threshold
#: (over six standard errors of 100 registers near 0.8).
SLACK = 0.25
#: Members in a block of the exact comparison inside a leader's group, and their shingles (both on average; a longer document has a block of its own size).
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Rows, hashes and shingles that a task works on at once: what it computes from them would else take some hundred MB in each Python worker.
ROWS, HASHES, COLUMNS = 1024, 512, 1024
#: A band or leader with more rows than LIGHT has its joins dealt over SALT tasks.
LIGHT, SALT = 512, 64

_MIX = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20240601).integers(1, 2**63, REGISTERS, dtype=np.uint64)


class _WordHashes(dict):
    """64-bit hash of each word, kept for words seen lately (some 15 MB of them)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _WordHashes()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    A-Z is lower-cased and words are runs without ASCII white space.  A text
    with fewer words than width has its whole sequence as its one shingle; without
    words (or null) the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.full(len(one) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(29))) * _STEP + one[i : len(one) - width + 1 + i]
    return np.unique(out)


def setsketch(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a set; the registers of a union are the element-wise maximum."""
    low = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for at in range(0, len(shingles), HASHES):
        h = (shingles[at : at + HASHES, None] ^ _SEEDS) * _MIX
        h ^= h >> np.uint64(32)
        h *= _MIX
        np.minimum(low, (h >> np.uint64(32)).astype(np.uint32).min(0), out=low)
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    x = -np.log1p(-(low + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, TOP + 1).astype(np.uint16)


def likelihood_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes (rows are pairs)."""
    return np.concatenate([np.zeros(0), *(_likelihood(*(x[at : at + ROWS] for x in (a, b, n_a, n_b))) for at in range(0, len(a), ROWS))])


def _likelihood(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    plus, minus = (a > b).sum(1), (a < b).sum(1)
    same = REGISTERS - plus - minus
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    score = plus[:, None] * log(up) + minus[:, None] * log(down) + same[:, None] * log(1 - up - down)
    return grid[np.arange(len(grid)), score.argmax(1)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ROWS; at the end, what Arrow holds unused goes back."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)
    pa.default_memory_pool().release_unused()


def _sketch_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, count, digest, regs, bands = [], [], [], [], []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                s = shingle_set(text.as_py(), width)
                k = setsketch(s)
                ids.append(doc.as_py())
                count.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                regs.append(k.tobytes())
                bands.append([
                    xxhash.xxh64_intdigest(k[i : i + BAND_ROWS].tobytes(), seed=i) - 2**63
                    for i in range(0, REGISTERS, BAND_ROWS)
                ] if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.binary()),
                 pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "registers", "bands"],
            )

    return run


def _set_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingle_set(t.as_py(), width).astype(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["rep", "shingles"])

    return run


def _estimate(a: str, b: str, n_a: str, n_b: str) -> Column:
    """likelihood_jaccard of two register columns and their set sizes."""

    @F.arrow_udf("double")
    def estimate(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
        left, right = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in (a, b))
        return pa.array(likelihood_jaccard(left, right, n_a.to_numpy(False).astype(float), n_b.to_numpy(False).astype(float)))

    return estimate(a, b, n_a, n_b)


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of sets."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, df = np.unique(flat, return_inverse=True, return_counts=True)
    keep = df[code] > 1
    owner, code = owner[keep], np.unique(code[keep], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for at in range(0, int(code.max(initial=-1)) + 1, COLUMNS):
        part = slice(*np.searchsorted(code, [at, at + COLUMNS]))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[part], code[part] - at] = 1
        out += m @ m.T
    return out


def _block_links(percent: int):
    """Links between members of different components in one pair of blocks; one for each newly joined pair of components."""

    def run(group: pa.Table) -> pa.Table:
        reps, comps = group["rep"].to_numpy(), group["component"].to_numpy()
        sets = [np.asarray(s.values.to_numpy()) for s in group["shingles"]]
        size = np.array([len(s) for s in sets], np.float64)
        both = _shared_counts(sets)
        hit = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        hit &= comps[:, None] != comps[None, :]
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        left, right = [], []
        for i, j in zip(*np.nonzero(np.triu(hit, 1)), strict=True):
            a, b = find(int(comps[i])), find(int(comps[j]))
            if a != b:
                parent[a] = b
                left.append(int(reps[i]))
                right.append(int(reps[j]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return run


def _salted(df: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """df(key, rep, ...) with salt: by rep for the keys that heavy lists (and the few others that its filter marks), else 0."""
    marked = marked_members(df, F.col(key), heavy, "heavy")
    return marked.withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("rep"), F.lit(SALT))).otherwise(0).cast("int")).drop("heavy")


def _join_salted(rows: DataFrame, info: DataFrame, spots: DataFrame) -> DataFrame:
    """rows(key, salt, rep, ...) joined with info (one row a key), which is repeated for the salts that the key has in spots(key, salt)."""
    key = spots.columns[0]
    return rows.join(info.join(spots, key), [key, "salt"])


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles long, component_id long, kept boolean) for every row of docs.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets
    of width-word shingles; component_id is the smallest id reachable over links,
    kept is doc_id = component_id.

    Null or word-less text: n_shingles 0, its own component.  Null id: the row takes
    no part in links, component_id null, kept true.  Rows that repeat an id are
    one document, linked where any of their texts is.  Equal sets (exact copies among them) are
    one class and compared once.  Very long texts are hashed in slices.  Other
    columns of docs are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = cut(base.mapInArrow(_sketch_batches(width), "doc_id long, n_shingles long, digest binary, registers binary, bands array<long>"))
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    reps = cut(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("registers", "n_shingles", "bands"), "doc_id").alias("r"))
               .select("digest", "rep", "r.registers", F.col("r.n_shingles").alias("n"), "r.bands"))
    classes = reps.select("digest", "rep")

    rows = reps.select("rep", F.explode("bands").alias("band"))
    many = cut(rows.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"))
    heavy = many.where(F.col("c") > LIGHT).select("band")
    copies = marked_members(many, F.col("band"), heavy, "heavy").withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("heavy"), SALT - 1).otherwise(0)))).drop("heavy")
    rows = cut(_salted(rows, "band", heavy).join(copies, ["band", "salt"]))
    support = rows.groupBy("rep").agg(F.sum("c").alias("support"))
    lead = rows.join(support, "rep").groupBy("band").agg(F.max(F.struct("support", (-F.col("rep")).alias("neg"))).alias("m"))
    stars = cut(_join_salted(rows, lead.select("band", (-F.col("m.neg")).alias("leader")), rows.select("band", "salt").distinct()).select("leader", "rep").distinct())
    heavy = cut(stars.groupBy("leader").agg(F.count("*").alias("c")).where(F.col("c") > LIGHT).select("leader"))
    stars = cut(_salted(stars, "leader", heavy))
    spots = cut(stars.select("leader", "salt").distinct())
    pairs = stars.where("leader <> rep")

    near = pairs.select("leader").union(pairs.select("rep")).distinct().toDF("rep")
    # An inner join with distinct ids: Spark would move a semi-join below the filter.
    wanted = likely_members(base, F.col("doc_id"), near).join(near, F.col("doc_id") == F.col("rep")).select("doc_id", "text")
    sets = cut(wanted.mapInArrow(_set_batches(width), "rep long, shingles array<long>"))

    info = reps.select("rep", "registers", "n")
    led = info.join(pairs.select("leader").distinct().toDF("rep"), "rep").toDF("leader", "registers_l", "n_l")
    judged = (_join_salted(pairs.join(info, "rep"), led, spots)
              .where((100 * F.least("n", "n_l") >= percent * F.greatest("n", "n_l")))
              .withColumn("estimate", _estimate("registers_l", "registers", "n_l", "n"))
              .where(F.col("estimate") >= percent / 100 - SLACK)
              .select("leader", "rep", "salt"))
    judged = cut(judged)
    both = F.size(F.array_intersect("shingles", "shingles_l"))
    leaders = sets.toDF("leader", "shingles_l").join(judged.select("leader").distinct(), "leader", "left_semi")
    linked = cut(_join_salted(judged.join(sets, "rep"), leaders, spots)
                 .where(100 * both >= percent * (F.size("shingles") + F.size("shingles_l") - both))
                 .select(F.col("leader").alias("a"), F.col("rep").alias("b")))
    first = cut(connected_components(linked))

    # What is left: leaders whose members lie in several components.
    placed = (stars.join(first, stars["rep"] == first["node"], "left").select("leader", "rep", "salt", F.coalesce("component", "rep").alias("component"))
              .join(reps.groupBy("rep").agg(F.sum("n").alias("n")), "rep"))
    groups = placed.groupBy("leader").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.when(F.col("leader") == F.col("rep"), F.col("component"))).alias("main"))
    open_ = cut(groups.where("lo <> hi").select("leader", "main"))
    rest = cut(_join_salted(placed, open_, spots).withColumn("loose", ~F.col("component").eqNullSafe(F.col("main"))).drop("main"))
    blocks = lambda loose: F.greatest(F.ceil(F.count_if(loose) / BLOCK), F.ceil(F.sum(F.when(loose, F.col("n")).otherwise(0)) / BLOCK_SHINGLES), F.lit(1)).cast("int")
    sizes = rest.groupBy("leader").agg(blocks(F.col("loose")).alias("bl"), blocks(~F.col("loose")).alias("bm"))
    spread = F.pmod(F.xxhash64("rep"), F.when(F.col("loose"), F.col("bl")).otherwise(F.col("bm"))).cast("int")
    loose_pairs = F.transform(F.sequence(F.lit(0), F.col("bl") - 1),
                              lambda k: F.struct(F.least(k, F.col("at")).alias("i"), F.greatest(k, F.col("at")).alias("j")))
    main_pairs = F.transform(F.sequence(F.lit(0), F.col("bm") - 1),
                             lambda k: F.struct(F.col("at").alias("i"), (-1 - k).alias("j")))
    back_pairs = F.transform(F.sequence(F.lit(0), F.col("bl") - 1),
                             lambda k: F.struct(k.alias("i"), (-1 - F.col("at")).alias("j")))
    tasks = (_join_salted(rest, sizes, spots).withColumn("at", spread)
             .withColumn("task", F.explode(F.when(F.col("loose"), F.concat(loose_pairs, main_pairs)).otherwise(back_pairs)))
             .select("leader", "rep", "component", "task.i", "task.j"))
    more = (tasks.join(sets, "rep").groupBy("leader", "i", "j").applyInArrow(_block_links(percent), "a long, b long"))
    more = cut(more)

    all_ = connected_components(linked.union(more))
    by_class = classes.join(all_, classes["rep"] == all_["node"], "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    whole = full.select("doc_id", "n_shingles", "digest").join(by_class, "digest")
    lone = sketch.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = whole.select("doc_id", "n_shingles", "component_id").union(lone)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
