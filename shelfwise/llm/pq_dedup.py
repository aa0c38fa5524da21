"""Near-duplicate vectors through product quantisation.

Vectors of length one are assigned to the nearest of a set of coarse centroids (inverted lists).
What is left after the centroid is cut into subspaces and coded by the nearest codeword of each.
Every vector probes every list that can hold a link of it. Members of a list are at least as near to its
centroid as to the vector's own one, so the plane between both centroids parts them from the vector; a list
is left out only if that plane is farther away than a link reaches. In a probed list a table of the vector's
products with all codewords gives its cosine to each member by table look-ups, up to the member's
quantisation error. Members that could reach the threshold within that error are compared exactly, in
double precision. A pair of vectors in two lists is compared from one side.

Equal vectors are one vector with a count from the start. Lists near each other form a zone, planned to hold
one block of members, and a vector travels once to each zone it probes. A zone is cut into blocks of members
and of queries of bounded size, and a task sees one block of each, so a list may hold any share of
all vectors. A block returns a link count per vector and one edge per linked vector to the smallest
id it is connected to inside the block; pairs are never emitted.

Only centroids and codewords travel with the tasks; their number is bounded by ``MAX_LISTS`` and
``CODEWORDS``. They are fitted on a sample of at most ``SAMPLE`` vectors by hash; all vectors are indexed.
No link is lost, whatever the sample. The price is that vectors spread over all directions probe nearly
every list: their comparisons grow with the square of their number (see README).

Defined cases: vectors that are NULL, empty, all zero, or hold NULL or non-finite components link with
nothing, and so do vectors of different length with each other. Rows of one id are one vector each for
itself in the links, and share the id in the result. Vectors of NULL id link and connect like others; a NULL id is never a
component's name (components without any id have NULL, and kept is NULL where the id is). Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import components, materialize, ship

THRESHOLD = 0.9
SAMPLE, SAMPLE_FLOATS = 20_000, 4_000_000
#: Vectors that a list is planned to hold, lists at most.
LIST_SIZE, MAX_LISTS = 500, 1024
SUBSPACES, CODEWORDS = 8, 64
#: Vectors of a block at most, and floats of its members (of its queries, twice as many).
MEMBER_BLOCK, QUERY_BLOCK, BLOCK_FLOATS = 16_384, 32_768, 1 << 20
#: Pairs that are compared at a time.
CELLS = 1 << 20
ROUNDS = 10


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    scale = np.abs(vectors).max(1, keepdims=True)
    vectors = vectors / scale
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = (x @ c.T - (0 if spherical else 0.5 * (c * c).sum(1))).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=k)[:, None]
        if spherical:
            length = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(length > 1e-12, total / np.maximum(length, 1e-12), c)
        else:
            c = np.where(count > 0, total / np.maximum(count, 1), c)
    return c


class Quantiser:
    """Coarse centroids, their zones, and subspace codewords."""

    def __init__(self, sample: np.ndarray, lists: int, zones: int = 1, threshold: float = THRESHOLD, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.centroids = _kmeans(sample, lists, rng, True)
        rest = sample - self.centroids[(sample @ self.centroids.T).argmax(1)]
        self.cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.words = [_kmeans(rest[:, a:b], CODEWORDS, rng, False) for a, b in zip(self.cuts, self.cuts[1:])]

        c = self.centroids
        heart = _kmeans(c, zones, rng, True)
        self.zones = (c @ heart.T).argmax(1)
        self.apart = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))
        self.apart[self.apart < 1e-6] = np.inf  # no plane between equal centroids
        # a vector is farther than a link from a plane if its sine is over this; rounding is far smaller than the margin
        self.reach = np.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-6 if threshold >= 0 else np.inf
        # of two lists one asks the other: which one alternates, so that no list asks all
        number = np.arange(len(c))
        same = self.zones[:, None] == self.zones
        a, b = (np.where(same, number.reshape(d), self.zones.reshape(d)) for d in ((-1, 1), (1, -1)))
        self.asks = ((a < b) == ((a + b) % 2 == 0)) | (number[:, None] == number)

    def probes(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector."""
        return (x @ self.centroids.T).argmax(1)[:, None]

    def probed(self, x: np.ndarray, home: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Whether each vector, of list ``home``, has to be compared with the members of each of ``lists``."""
        own = np.einsum("rd,rd->r", x, self.centroids[home])
        far = (own[:, None] - x @ self.centroids[lists].T) / self.apart[home[:, None], lists]
        return (far <= self.reach) & self.asks[home[:, None], lists]

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what the codes leave out."""
        rest = x - self.centroids[lists]
        codes, error = [], np.zeros(len(x))
        for (a, b), w in zip(zip(self.cuts, self.cuts[1:]), self.words):
            code = (rest[:, a:b] @ w.T - 0.5 * (w * w).sum(1)).argmax(1)
            codes.append(code)
            error += ((rest[:, a:b] - w[code]) ** 2).sum(1)
        return np.stack(codes, 1).astype(np.uint8), np.sqrt(error)

    def estimate(self, queries: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric cosines of queries to coded members of one list, by table look-ups."""
        out = np.empty((len(codes), len(queries)), np.float32)  # a member's products lie together: whole rows are looked up
        out[:] = queries @ self.centroids[number]
        for k, ((a, b), w) in enumerate(zip(zip(self.cuts, self.cuts[1:]), self.words)):
            table = (w @ queries[:, a:b].T).astype(np.float32)
            for at in range(0, len(codes), 64):
                out[at:at + 64] += table[codes[at:at + 64, k]]
        return out.T


def _matrix(blobs: pa.Array | pa.ChunkedArray) -> np.ndarray:
    parts = blobs.to_pylist()
    return np.frombuffer(b"".join(parts), "<f4").reshape(len(parts), -1)


def _valid(embedding):
    good = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & good & F.exists(embedding, lambda v: v != 0)


_ENTRY = "zone int, member boolean, id long, weight long, home int, vector binary"
_LINKS = "id long, n long, root long"


def _blocks(floats: int) -> tuple[int, int]:
    """Members and queries of a block, for vectors of so many floats."""
    most = max(1024, BLOCK_FLOATS // floats)
    return min(MEMBER_BLOCK, most), min(QUERY_BLOCK, 2 * most)


def _lowest(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Smallest value that each node is connected to by the links of ``a`` and ``b``."""
    low = values.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, b, low[a])
        np.minimum.at(new, a, new[b])
        if (new == low).all():
            return low
        low = new


def _spanning(close: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links that connect what ``close`` connects: query to member, and for dense parts query to query instead."""
    close, none = close.copy(), np.zeros(0, np.int64)
    q_a, q_b, m_a, m_b = [none], [none], [none], [none]
    while np.count_nonzero(close) * 64 > close.size:
        first = int(close.sum(1).argmax())
        member = close[first]
        while True:
            query = close[:, member].any(1)
            more = close[query].any(0)
            if (more == member).all():
                break
            member = more
        q, m = np.flatnonzero(query), np.flatnonzero(member)
        q_a, q_b = q_a + [q], q_b + [np.full(len(q), first)]
        m_a, m_b = m_a + [np.full(len(m), first)], m_b + [m]
        close[query] = False
    i, j = np.nonzero(close)
    return np.concatenate(q_a), np.concatenate(q_b), np.concatenate(m_a + [i]), np.concatenate(m_b + [j])


def _entries(vectors: DataFrame, quantiser: Quantiser) -> DataFrame:
    """A member entry in the zone of each vector's list and a query entry in every zone it probes."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(quantiser.zones, kind="stable")
        numbers, starts = np.unique(quantiser.zones[order], return_index=True)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                x = unit(_matrix(batch.column(2)))
                home = quantiser.probes(x)[:, 0]
                own, zone = np.nonzero(np.logical_or.reduceat(quantiser.probed(x, home, order), starts, axis=1))
                who = np.concatenate([np.arange(len(x)), own])
                zones = np.concatenate([quantiser.zones[home], numbers[zone]]).astype(np.int32)
                member = np.arange(len(who)) < len(x)
                for k in range(0, len(who), 8192):
                    some = slice(k, k + 8192)
                    take = pa.array(who[some])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(zones[some]), pa.array(member[some]), batch.column(0).take(take), batch.column(1).take(take),
                         pa.array(home[who[some]].astype(np.int32)), batch.column(2).take(take)],
                        names=[c.split()[0] for c in _ENTRY.split(", ")])

    return vectors.select("id", "weight", "vector").mapInArrow(index, _ENTRY)


def _dealt(entries: DataFrame, member_block: int, query_block: int) -> DataFrame:
    """Entries dealt to blocks: each member block of a zone meets each query block of it once."""
    sizes = entries.groupBy("zone").agg(
        F.ceil(F.count_if("member") / member_block).cast("int").alias("mb"),
        F.ceil(F.count_if(~F.col("member")) / query_block).cast("int").alias("qb")).where("mb > 0")
    spread = entries.join(F.broadcast(sizes), "zone")  # at most MAX_LISTS rows of three numbers
    salt = F.pmod(F.xxhash64("id", "vector"), F.when(F.col("member"), F.col("mb")).otherwise(F.col("qb")).cast("long")).cast("int")
    return spread.withColumn("salt", salt) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("member"), F.col("qb")).otherwise(F.col("mb")) - 1))) \
        .withColumn("m", F.when(F.col("member"), F.col("salt")).otherwise(F.col("other"))) \
        .withColumn("q", F.when(F.col("member"), F.col("other")).otherwise(F.col("salt"))) \
        .drop("mb", "qb", "salt", "other")


def _close(quantiser: Quantiser, threshold: float, number: int, xq: np.ndarray, xm: np.ndarray, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
    """Which queries reach the threshold with which members of one list."""
    maybe = quantiser.estimate(xq, number, codes) >= (threshold - 1e-4 - error).astype(np.float32)
    if np.count_nonzero(maybe) * 64 > maybe.size:
        return maybe & (xq @ xm.T >= threshold)
    j, i = np.nonzero(maybe.T)
    close = np.zeros_like(maybe)
    for k in range(0, len(i), 65_536):
        a, b = i[k:k + 65_536], j[k:k + 65_536]
        close[a, b] = np.einsum("rd,rd->r", xq[a], xm[b]) >= threshold
    return close


def _compare(quantiser: Quantiser, threshold: float):
    def block(table: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])
        is_member = table.column("member").to_numpy()
        members, queries = table.filter(pa.array(is_member)).sort_by("home"), table.filter(pa.array(~is_member))
        if not members.num_rows or not queries.num_rows:
            return schema.empty_table()
        m_id, q_id = (t.column("id").to_numpy() for t in (members, queries))
        m_weight, q_weight = (t.column("weight").to_numpy() for t in (members, queries))
        m_home, q_home = (t.column("home").to_numpy() for t in (members, queries))
        xm, xq = unit(_matrix(members.column("vector"))), unit(_matrix(queries.column("vector")))
        codes, error = quantiser.encode(xm, m_home)
        numbers, starts = np.unique(m_home, return_index=True)
        probed = quantiser.probed(xq, q_home, numbers)
        got_q, got_m = np.zeros(len(q_id), np.int64), np.zeros(len(m_id), np.int64)
        has_q, has_m = np.zeros(len(q_id), bool), np.zeros(len(m_id), bool)
        links = []
        for k, (start, end) in enumerate(zip(starts, [*starts[1:], len(m_id)])):
            mine, asking = slice(start, end), np.flatnonzero(probed[:, k])
            step = max(16, CELLS // (end - start))
            for at in range(0, len(asking), step):
                rows = asking[at:at + step]
                close = _close(quantiser, threshold, numbers[k], xq[rows], xm[mine], codes[mine], error[mine])
                hit = close.any(1)
                if not hit.any():
                    continue
                rows, close = rows[hit], close[hit]
                close &= q_id[rows][:, None] != m_id[mine]
                got_q[rows] += close @ m_weight[mine]
                has_q[rows] |= close.any(1)
                # a pair in one list meets from both sides; one in two lists from this side only
                other = q_home[rows] != numbers[k]
                got_m[mine] += (q_weight[rows] * other) @ close
                has_m[mine] |= close.any(0)
                q_a, q_b, m_a, m_b = _spanning(close)
                links.append((np.concatenate([rows[q_a], rows[m_a]]), np.concatenate([rows[q_b], len(q_id) + start + m_b])))
        if not links:
            return schema.empty_table()
        low = _lowest(*(np.concatenate(side) for side in zip(*links)), np.concatenate([q_id, m_id]))
        has = np.concatenate([has_q, has_m])
        return pa.Table.from_arrays([pa.array(np.concatenate(part)[has]) for part in ((q_id, m_id), (got_q, got_m))] + [pa.array(low[has])], schema=schema)

    return block


def _links(vectors: DataFrame, threshold: float) -> DataFrame | None:
    """Link counts and block roots of vectors of one length; ``vectors`` holds id, weight, vector."""
    n = vectors.count()
    size = vectors.select(F.length("vector")).first()
    if n < 2 or size is None:
        return None
    bound = min(SAMPLE, max(512, SAMPLE_FLOATS // (size[0] // 4)))
    sample = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, 1.1 * bound / n) * (1 << 20)) + 1) \
        .select("id", "vector").limit(bound).toPandas().sort_values("id")
    if len(sample) == 0:
        sample = vectors.select("id", "vector").limit(bound).toPandas()
    blocks = _blocks(size[0] // 4)
    quantiser = Quantiser(unit(_matrix(pa.array(sample["vector"], pa.binary()))), min(MAX_LISTS, max(1, n // LIST_SIZE)),
                          -(-n // blocks[0]), threshold)
    dealt = _dealt(_entries(vectors, quantiser), *blocks)
    return dealt.groupBy("zone", "m", "q").applyInArrow(_compare(quantiser, threshold), _LINKS)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    ship(vectors.sparkSession)
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("embedding"))
    raw = raw.withColumn("row", F.when(_valid(F.col("embedding")), F.xxhash64("embedding")))

    # Equal vectors: one of them stands for all. The key is the vector itself, pre-aggregated per task.
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            blobs = [np.asarray(v.values.to_numpy(zero_copy_only=False) + 0.0, "<f4").tobytes() for v in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], names=["id", "weight", "vector"])

    classes = raw.where(F.col("row").isNotNull()).groupBy("embedding").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("row").alias("id"))
    # a class goes by its vector's hash, so ids that are missing or repeat do not matter until components are named
    classes = materialize(classes, "pq-classes")
    packed = materialize(classes.select("id", "weight", "embedding").mapInArrow(pack, "id long, weight long, vector binary"), "pq-vectors")
    found = None
    for (length,) in sorted(tuple(r) for r in packed.select(F.length("vector")).distinct().collect()):
        part = _links(packed.where(F.length("vector") == length), threshold)
        found = part if found is None else found if part is None else found.unionAll(part)
    spark = vectors.sparkSession
    found = materialize(found, "pq-links") if found is not None else spark.createDataFrame([], _LINKS)
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    cc = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_class = classes.join(counts, "id", "left").join(cc.withColumnRenamed("node", "id"), "id", "left") \
        .withColumn("component", F.coalesce("component", "id"))
    names = of_class.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    of_class = of_class.join(names, "component").select(
        F.col("embedding").alias("e"), F.col("id").alias("r"), "component_id",
        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    # joined by the vector's hash and, exactly, by the vector
    return raw.join(of_class, (F.col("row") == F.col("r")) & (F.col("embedding") == F.col("e")), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"))
