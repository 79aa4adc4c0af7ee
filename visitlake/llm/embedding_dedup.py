"""Near-duplicate vectors: iterative quantisation and multi-index Hamming tables.

A rotation of the centred vectors is learned so that their signs make balanced
binary codes (Gong and Lazebnik, 2011), on a bounded sample; several rotations
from different starts give several codes. Each code is cut into substrings, and
each substring is the key of one table (Norouzi et al., 2012). A vector is stored
in every table under its substring and looked up under its own, and with RADIUS 1
also under those that differ in one bit: fewer rotations then do, but each costs
seventeen lookups instead of one. Pairs that meet and whose whole codes are near
are ranked again by their exact cosine in double precision; only pairs that reach
the threshold become links. How wide the substrings are, how many rotations there
are and how near codes have to be follows from pairs made at the threshold out of
the sample: a common component of the vectors moves the codes of such pairs apart,
and few dimensions give few substrings.

Equal vectors of one label are one *vertex*, with the number of its copies, so a
group of copies costs one row. A table entry is cut into blocks when it is large,
and only ids and codes travel to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlake.llm.components import components
from visitlake.sources.staging import Staging

SAMPLE_VECTORS = 20_000  # vectors that rotations are learned on
ROTATIONS, TURNS = 10, 30
SUBSTRING_BITS = (16, 12, 8, 6, 4)  # the first with which enough of the pairs made are found
LEAST_TABLES = 40
MADE_PAIRS, FOUND_SHARE = 2_000, 0.98
RADIUS = 0  # 0 or 1: bits in which a substring looked up may differ from the one stored
BLOCK = 512  # rows of a table entry that are compared at once
# Codes further apart than this, and than all but a few of the pairs made, are not
# ranked again. At a cosine of 0.93 signs of random projections differ in 12 % of the bits.
NEAR_SHARE, FAR_PAIRS = 0.20, 0.005


def learn_rotation(x: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Projection to ``bits`` dimensions whose signs lose little of the vectors."""
    _, directions = np.linalg.eigh(x.T @ x)
    projection = directions[:, ::-1][:, :bits]
    v = x @ projection
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    for _ in range(TURNS):
        codes = np.where(v @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ v)
        rotation = (left @ right).T
    return projection @ rotation


@dataclass
class Coder:
    mean: np.ndarray
    rotations: list[np.ndarray]
    width: int = 0  # of substrings
    most: int = 0  # bits in which near codes differ

    @property
    def bits(self) -> int:
        return self.rotations[0].shape[1]

    @property
    def strings(self) -> int:
        return self.bits // self.width

    def codes(self, x: np.ndarray) -> np.ndarray:
        """rows x rotations, each code a 64-bit number."""
        out = []
        for rotation in self.rotations:
            bits = np.zeros((len(x), 64), np.uint8)
            bits[:, : self.bits] = (x - self.mean) @ rotation >= 0
            out.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel())
        return np.stack(out, 1)


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _plain() -> Column:
    """The vector in double precision; adding zero makes -0.0 and 0.0 one value."""
    return F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))


def _usable() -> Column:
    """Rows that can link: label and id known, vector without null or non-finite
    parts and not zero."""
    v = _plain()
    fine = (
        F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
        & F.exists(v, lambda x: x != 0)
    )
    return F.coalesce(fine, F.lit(False))


def _made_pairs(x: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors with others at the cosine ``least``: away from them in any direction,
    and towards other vectors of the sample."""
    rng = np.random.default_rng(0)
    x = x[rng.integers(0, len(x), MADE_PAIRS)]
    out = []
    for z in (rng.standard_normal(x.shape), x[rng.permutation(len(x))] + 1e-9 * rng.standard_normal(x.shape)):
        z = z - (z * x).sum(1, keepdims=True) * x
        z /= np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-300)
        out.append((x, least * x + np.sqrt(max(1 - least * least, 0.0)) * z))
    return out


def _found(coder: Coder, differ: np.ndarray) -> float:
    """Share of pairs, by the differing bits of their codes, that a table brings together."""
    near = np.bitwise_count(differ) <= coder.most
    met = np.zeros(len(differ), bool)
    mask = np.uint64((1 << coder.width) - 1)
    for k in range(coder.strings):
        part = (differ >> np.uint64(k * coder.width)) & mask
        met |= (near & (np.bitwise_count(part) <= RADIUS)).any(1)
    return float(met.mean())


def _fitted(x: np.ndarray, mean: np.ndarray, least: float) -> Coder:
    """The coder with the widest substrings that finds enough of the pairs made, or the narrowest."""
    bits = min(64, len(mean))
    coder = Coder(mean, [])
    made = _made_pairs(x, least) if len(x) else []
    differ = [np.zeros((MADE_PAIRS, 0), np.uint64) for _ in made]
    for width in sorted({min(w, bits) for w in SUBSTRING_BITS}, reverse=True):
        coder.width = width
        tables = LEAST_TABLES if RADIUS == 0 else 0
        rotations = max(ROTATIONS, -(-tables // (bits // width)), len(coder.rotations))
        new = [learn_rotation(x - mean, bits, seed) for seed in range(len(coder.rotations), rotations)]
        coder.rotations += new
        if not made:
            break
        if new:
            added = Coder(mean, new)
            differ = [np.concatenate([d, added.codes(a) ^ added.codes(b)], 1) for d, (a, b) in zip(differ, made)]
        far = max(np.quantile(np.bitwise_count(d), 1 - FAR_PAIRS) for d in differ)
        coder.most = max(int(NEAR_SHARE * bits), int(np.ceil(far)))
        if min(_found(coder, d) for d in differ) >= FOUND_SHARE:
            break
    return coder


def train(vertices: DataFrame, n: int, least: float) -> Coder | None:
    """Rotations learned on a bounded sample, chosen by hash, of the most common length."""
    length = vertices.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return None
    same = vertices.filter(F.size("embedding") == length["d"])
    share = min(1.0, SAMPLE_VECTORS / n)
    sample = same.filter(F.pmod(F.col("vertex"), F.lit(1_000_000)) < int(1_000_000 * share))
    table = sample.select("vertex", "embedding").orderBy("vertex").toArrow()
    column = table.column("embedding").combine_chunks()
    x = _unit(column) if len(column) else np.zeros((0, length["d"]))
    mean = x.mean(0) if len(x) else np.zeros(length["d"])
    return _fitted(x, mean, least)


def _entries(vertices: DataFrame, coder: Coder) -> DataFrame:
    """(label, entry, vertex, code, probe): the tables' rows and the lookups in them."""
    shared = vertices.sparkSession.sparkContext.broadcast(coder)
    strings, width = coder.strings, coder.width

    def run(batches):
        coder = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            # Vectors of another length than the coder's all get one code.
            lengths = b.column("embedding").value_lengths().to_numpy()
            codes = np.zeros((b.num_rows, len(coder.rotations)), np.uint64)
            right = np.flatnonzero(lengths == len(coder.mean))
            if len(right):
                codes[right] = coder.codes(_unit(b.column("embedding").take(pa.array(right))))
            label = b.column("label").cast(pa.int64()).to_numpy()
            rows, tables, keys, probes, whole = [], [], [], [], []
            for r in range(len(coder.rotations)):
                for s in range(strings):
                    part = (codes[:, r] >> np.uint64(s * width)) & np.uint64((1 << width) - 1)
                    for flip in [None, *range(width * RADIUS)]:
                        key = part if flip is None else part ^ np.uint64(1 << flip)
                        rows.append(np.arange(b.num_rows))
                        keys.append(key)
                        tables.append(np.full(b.num_rows, r * strings + s))
                        probes.append(np.full(b.num_rows, flip is not None))
                        whole.append(codes[:, r].view(np.int64))
            at = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(label[at]),
                    pa.array(np.concatenate(tables) * (1 << width) + np.concatenate(keys).astype(np.int64)),
                    b.column("vertex").take(pa.array(at)),
                    pa.array(np.concatenate(whole)),
                    pa.array(np.concatenate(probes)),
                ],
                ["label", "entry", "vertex", "code", "probe"],
            )

    schema = "label bigint, entry bigint, vertex bigint, code bigint, probe boolean"
    return vertices.select("vertex", "label", "embedding").mapInArrow(run, schema)


def _near_pairs(entries: DataFrame, most: int) -> DataFrame:
    """Pairs that meet in an entry, one of them stored there, with near codes."""
    sizes = entries.groupBy("label", "entry").agg(
        F.count_if(~F.col("probe")).alias("n_stored"), F.count(F.lit(1)).alias("n_all")
    )
    sizes = sizes.filter("n_stored > 0 AND n_all > 1").withColumn(
        "blocks", F.ceil(F.col("n_all") / BLOCK).cast("int")
    )
    rows = entries.join(sizes.select("label", "entry", "blocks"), ["label", "entry"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.xxhash64("label", "entry", F.least("block", "other"), F.greatest("block", "other"))
    rows = rows.select(
        unit.alias("unit"), "vertex", "code", "probe", "block", (F.col("block") == F.col("other")).alias("diagonal")
    )

    def pairs_of(vertex, code, probe, block, diagonal) -> np.ndarray:
        stored = np.flatnonzero(~probe)
        if not len(stored) or len(vertex) < 2:
            return np.zeros((0, 2), np.int64)
        apart = np.bitwise_count(code[stored][:, None] ^ code[None, :])
        meet = (apart <= most) & (vertex[stored][:, None] != vertex[None, :])
        # Two stored rows meet once; a pair of blocks is only for pairs across them.
        meet &= probe[None, :] | (vertex[stored][:, None] < vertex[None, :])
        meet &= diagonal[None, :] | (block[stored][:, None] != block[None, :])
        i, j = np.nonzero(meet)
        found = np.sort(np.stack([vertex[stored[i]], vertex[j]], 1), axis=1)
        return np.unique(found, axis=0)

    def run(batches):
        held: list[pa.RecordBatch] = []
        done = []

        def close(parts: list[pa.RecordBatch]):
            t = pa.Table.from_batches(parts).combine_chunks()
            code = t.column("code").to_numpy().view(np.uint64)
            flags = [t.column(c).to_numpy(zero_copy_only=False) for c in ("probe", "block", "diagonal")]
            done.append(pairs_of(t.column("vertex").to_numpy(), code, *flags))

        for b in batches:
            units = b.column("unit").to_numpy()
            if not len(units):
                continue
            cuts = [0, *(np.flatnonzero(np.diff(units)) + 1).tolist(), len(units)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                part = b.slice(low, high - low)
                if held and held[0].column("unit")[0] != part.column("unit")[0]:
                    close(held)
                    held = []
                held.append(part)
            yield _pairs(done)
            done = []
        if held:
            close(held)
        yield _pairs(done)

    def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
        x = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], ["u", "v"])

    ordered = rows.repartition("unit").sortWithinPartitions("unit")
    return ordered.mapInArrow(run, "u bigint, v bigint").distinct()


def _exact(pairs: DataFrame, vertices: DataFrame, least: float) -> DataFrame:
    """Pairs whose cosine in double precision reaches ``least``."""
    out = pairs
    for end in ("u", "v"):
        out = out.join(vertices.select(F.col("vertex").alias(end), F.col("embedding").alias(f"x_{end}")), end)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            same = pc.equal(b.column("x_u").value_lengths(), b.column("x_v").value_lengths())
            b = b.filter(same)
            kept = []
            lengths = b.column("x_u").value_lengths().to_numpy()
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                x, y = (
                    b.column(c).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    for c in ("x_u", "x_v")
                )
                cosine = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                kept.append(at[cosine >= least])
            yield b.select(["u", "v"]).take(pa.array(np.concatenate(kept) if kept else np.zeros(0, int)))

    return out.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(vectors: DataFrame, staging: Staging, *, least: float = 0.93) -> DataFrame:
    """Classes of vectors linked by a cosine of at least ``least`` within a label.

    ``vectors`` has whole numbers vec_id and label, and embedding, an array of
    numbers; other columns are ignored. Returns a row per row: vec_id, n_links
    (other rows linked directly, equal vectors included), component_id (smallest
    vec_id of the class) and kept (whether that is its own). A row whose label,
    id or vector is null, or whose vector is empty, zero or holds null or
    non-finite parts, links with nothing. Every link has been checked exactly;
    the tables may miss a few. The result reads tables in ``staging``.
    """
    own = vectors.select(
        "vec_id", "label", _plain().alias("embedding"),
        F.when(_usable(), F.xxhash64("label", _plain())).alias("vertex"),
    )
    keyed = own.filter("vertex IS NOT NULL")
    vertices = staging.write(
        keyed.groupBy("vertex").agg(
            F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"),
            F.first("label").alias("label"), F.first("embedding").alias("embedding"),
        ),
        "vertices",
    )
    coder = train(vertices, vertices.count(), least)
    if coder is None:
        links = vectors.sparkSession.createDataFrame([], "u bigint, v bigint")
    else:
        entries = staging.write(_entries(vertices, coder), "entries")
        pairs = staging.write(_near_pairs(entries, coder.most), "pairs")
        links = staging.write(_exact(pairs, vertices, least), "links")
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    copies = vertices.select(F.col("vertex").alias("v"), "copies")
    linked = both.join(copies, "v").groupBy("u").agg(F.sum("copies").alias("others"))
    labels = components(links, staging)
    facts = vertices.join(linked, vertices["vertex"] == linked["u"], "left").join(labels, "vertex", "left")
    facts = facts.select(
        "vertex", "first_id",
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "vertex").alias("component"),
    )
    smallest = facts.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = staging.write(facts.join(smallest, "component").select("vertex", "n_links", "component_id"), "classes")
    return own.select("vec_id", "vertex").join(classes, "vertex", "left").select(
        F.col("vec_id").cast("bigint"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").cast("bigint").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
