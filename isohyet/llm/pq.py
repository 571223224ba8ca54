"""Near-duplicate embeddings: inverted lists, product-quantised residuals, table
lookups, exact cosines."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import components, groups, small, table
from isohyet.shipping import map_arrow

#: The index is fitted on at most so many vectors, and so many numbers in all.
SAMPLE_ROWS, SAMPLE_NUMBERS = 200_000, 16_000_000
SUBSPACES, CODES = 8, 256
#: A pair is found if its displacement across the border of its two lists is within so
#: many standard deviations of one by the whole radius in a random direction. One of the
#: two then is within half of that of the border, so that is how far a query probes.
REACH = 5.0
#: Members and queries of a tile: its rows are sent once, so both are large.
MEMBERS, QUERIES = 16_384, 131_072
#: Distances worked out at once.
AT_ONCE = 1 << 19


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, (4 << 20) // len(c))  # distances of 32 MB at once
    return np.concatenate([((c * c).sum(1) - 2 * x[i : i + step] @ c.T).argmin(1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k centres of the rows of x (fewer if there are fewer rows)."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.stack([np.bincount(at, col, len(c)) for col in x.T], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


@dataclass
class Index:
    centres: np.ndarray  # lists x dimensions
    books: list[np.ndarray]  # a subspace's codes x its dimensions
    cuts: list[int]

    @staticmethod
    def fit(x: np.ndarray, lists: int) -> Index:
        c = k_means(x, lists)
        rest = x - c[_nearest(x, c)]
        cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int).tolist()
        return Index(c, [k_means(rest[:50_000, a:b], CODES) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], cuts)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a:b] for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of residuals, and how far each is from what its codes stand for."""
        codes = np.stack([_nearest(p, b) for p, b in zip(self.parts(rest), self.books, strict=True)], 1)
        back = np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], 1)
        return codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """The nearest list of each row, and which lists it probes: those with the
        plane that parts them from the nearest one within reach."""
        d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(1), 0)
        home = d.argmin(1)
        gap = np.sqrt(np.maximum((self.centres**2).sum(1)[:, None] - 2 * self.centres @ self.centres.T + (self.centres**2).sum(1), 0))[home]
        near = d - d[np.arange(len(x)), home][:, None] <= 2 * reach * gap
        near[np.arange(len(x)), home] = True
        return home, near


def units(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows are vectors of that size that
    can have a direction: none for null, zero, or null or non-finite components."""
    out, ok = np.zeros((len(column), size)), np.zeros(len(column), bool)
    for i, v in enumerate(column):
        if v.is_valid and len(v.values) == size and not v.values.null_count:
            out[i] = v.values.to_numpy(zero_copy_only=False)
            ok[i] = True
    ok &= np.isfinite(out).all(1) & (np.abs(out).max(1, initial=0) > 0)
    out[~ok] = 1
    return _unit(out), ok


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no over- or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _short(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in steps of 16 bits, and how far each is from what they stand for."""
    steps = np.rint(x / np.abs(x).max(1, keepdims=True) * 32767).astype(np.int16)
    return steps, np.sqrt(((x - _unit(steps.astype(float))) ** 2).sum(1))


def _above(x: np.ndarray) -> pa.Array:
    """Numbers in single precision, none of them below what it was."""
    return pa.array((x * (1 + 1e-6)).astype(np.float32))


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same components as a-b, at most one a node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def near_vectors(vectors: DataFrame, cosine: float = 0.95, reach: float = REACH) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id,
    embedding); other columns are ignored.

    Vectors whose cosine, in double precision, is at least that are linked. Equal
    embeddings are one class (smallest vec_id) with a multiplicity. The index: about
    sqrt(n) / 8 lists around k-means centres, and codes of the residuals, fitted on a
    sample of at most SAMPLE_ROWS vectors by a hash of vec_id; every vector is in the
    list of its nearest centre. A query, which is every class, probes all lists whose
    border is near enough (REACH), however many. In a list the distances come from
    tables of the query's subspaces; no vector is passed over unless its approximate
    distance less its own coding error is beyond the radius; the rest is checked by
    the cosine. Lists get vectors in steps of 16 bits with a bound of the error; pairs
    for which that is too coarse are checked once more with the vectors themselves.
    A pair counts for both if either finds the other. Lists are cut
    in tiles of about MEMBERS x QUERIES. All this is done for each length of vectors by
    itself (lengths are few): vectors of different lengths do not link.

    Vectors without a direction (null, empty, zero, null or non-finite components) or
    without vec_id link with nothing. A row whose vec_id
    comes again is one of its class's copies. Empty input: an empty result."""
    rows = vectors.select("vec_id", "embedding")
    usable = rows.where("vec_id is not null and embedding is not null").withColumn("size", F.size("embedding")).where("size > 0")
    # a vector alone of its length has nothing to link with
    sizes = sorted(r[0] for r in usable.groupBy("size").count().where("count > 1").select("size").collect())
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")).withColumn("kept", F.lit(True))
    info = reduce(DataFrame.unionByName, [_linked(usable.where(F.col("size") == size), size, cosine, reach).withColumn("size", F.lit(size)) for size in sizes])
    keys = rows.select("vec_id", F.size("embedding").alias("size"), F.when(F.col("vec_id").isNotNull(), F.xxhash64("embedding")).alias("k1"), F.hash("embedding", F.lit(7)).alias("k2"))
    out = keys.join(info, ["size", "k1", "k2"], "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _linked(usable: DataFrame, size: int, cosine: float, reach: float) -> DataFrame:
    """k1, k2 (hashes of the embedding), n links and component of the classes of
    vectors of one length."""
    spark = usable.sparkSession
    keyed = usable.select("vec_id", F.xxhash64("embedding").alias("k1"), F.hash("embedding", F.lit(7)).alias("k2"), "embedding")
    parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the only shuffle of whole vectors
    least = keyed.repartition(parts, "k1", "k2").groupBy("k1", "k2").agg(F.min(F.struct("vec_id", "embedding")).alias("v"), F.count(F.lit(1)).alias("copies"))
    classes = table(least.select("k1", "k2", F.col("v.vec_id").alias("rep"), "copies", "v.embedding"), "classes")
    n = classes.count()
    step = max(1, -(-n // min(SAMPLE_ROWS, SAMPLE_NUMBERS // size)))
    some = classes.where(F.pmod("k1", F.lit(step)) == 0).select("rep", "embedding").toArrow().sort_by("rep")
    x, ok = units(some.column(1).combine_chunks() if some.num_rows else pa.array([], pa.list_(pa.float64())), size)
    if not ok.any():
        x, ok = np.eye(1, size), np.ones(1, bool)
    index = spark.sparkContext.broadcast(Index.fit(x[ok], int(np.clip(np.sqrt(n) / 8, 1, 16_384))))
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    within = min(reach / np.sqrt(size), 1.0) * radius / 2
    ids = usable.schema["vec_id"].dataType.simpleString()

    def code(batches):
        ix: Index = index.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                x, ok = units(b.column(2), size)
                take, x = np.flatnonzero(ok), x[ok]
                if not len(x):
                    continue
                home, near = ix.probes(x, within)
                codes, error = ix.encode(x - ix.centres[home])
                steps, blur = _short(x)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take)), b.column(1).take(pa.array(take)), pa.array([v.tobytes() for v in steps], pa.binary()), _above(blur), pa.array(home, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), _above(error), pa.array([np.flatnonzero(r).astype(np.int32) for r in near], pa.list_(pa.int32()))], ["id", "copies", "vec", "blur", "home", "codes", "error", "probes"])

    coded = table(map_arrow(classes.select(F.col("rep").alias("id"), "copies", "embedding"), code, f"id {ids}, copies long, vec binary, blur float, home int, codes binary, error float, probes array<int>"), "coded")
    # one row a list, as many as centres
    here = coded.groupBy(F.col("home").alias("list")).agg(F.count(F.lit(1)).alias("m"))
    asked = coded.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("q"))
    plan = F.broadcast(table(here.join(asked, "list").select("list", F.ceil(F.col("m") / MEMBERS).cast("int").alias("nm"), F.ceil(F.col("q") / QUERIES).cast("int").alias("nq")), "plan"))
    lot = lambda by: F.pmod(F.xxhash64("id"), F.col(by)).cast("int")
    spread = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    # side 0 are members that ask, too, 1 other members, 2 other queries
    members = coded.withColumn("list", F.col("home")).join(plan, "list").withColumn("i", lot("nm")).withColumn("j", spread("nq")).select("list", "i", "j", (F.col("j") != lot("nq")).cast("int").alias("side"), "id", "copies", "vec", "blur", "home", "codes", "error", "probes")
    asking = coded.withColumn("list", F.explode("probes")).join(plan, "list").withColumn("i", spread("nm")).where("list <> home or i <> pmod(xxhash64(id), nm)").select("list", "i", lot("nq").alias("j"), F.lit(2).alias("side"), "id", "copies", "vec", "blur", "home", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("error"), F.lit(None).cast("array<int>").alias("probes"))

    def search(batches):
        ix: Index = index.value
        for g in groups(batches, 3):
            t = g.combine_chunks()
            side = t.column("side").to_numpy()
            own, cut = int((side == 0).sum()), int((side < 2).sum())
            asks = np.concatenate([np.arange(own), np.arange(cut, len(side))])
            if not cut or not len(asks):
                continue
            id_, copies, home, blur = (t.column(c).to_numpy() for c in ("id", "copies", "home", "blur"))
            blur = blur.astype(np.float64)
            vec = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.int16).reshape(-1, size)
            here = int(t.column("list")[0].as_py())
            codes = np.frombuffer(b"".join(t.column("codes").slice(0, cut).to_pylist()), np.uint8).reshape(cut, -1)
            limit = ((radius + t.column("error").to_numpy()[:cut].astype(np.float64) + blur.max()) ** 2 + 1e-4).astype(np.float32)
            m = _unit(vec[:cut].astype(np.float64))
            # the member finds the query by itself if it probes the query's list
            probed = np.zeros((cut, len(ix.centres)), bool)
            lists = t.column("probes").slice(0, cut).to_pylist()
            probed[np.repeat(np.arange(cut), [len(p) for p in lists]), np.concatenate([np.array(p, np.int64) for p in lists])] = True
            links, x, y = np.zeros(len(id_)), np.zeros(0, np.int64), np.zeros(0, np.int64)
            unsure = []
            step = max(1, AT_ONCE // cut)
            for at in range(0, len(asks), step):
                who = asks[at : at + step]
                q = _unit(vec[who].astype(np.float64))
                # a table's row holds one code's distances to all queries: a member takes whole rows
                tables = [((b * b).sum(1)[:, None] - 2 * b @ p.T + (p * p).sum(1)).astype(np.float32) for p, b in zip(ix.parts(q - ix.centres[here]), ix.books, strict=True)]
                distance = np.zeros((cut, len(q)), np.float32)
                for j, lookup in enumerate(tables):
                    distance += lookup[codes[:, j]]
                b, a = np.divmod(np.flatnonzero(distance <= limit[:, None]), len(q))
                apart = id_[who[a]] != id_[b]
                a, b = a[apart], b[apart]
                if not len(a):
                    continue
                over = np.concatenate([(q[a[k : k + 65536]] * m[b[k : k + 65536]]).sum(1) for k in range(0, len(a), 65536)]) - cosine
                a, room = who[a], 1e-12 + blur[who[a]] + blur[b] + blur[who[a]] * blur[b]
                close = np.abs(over) <= room
                if close.any():
                    unsure.append((id_[a[close]], id_[b[close]], copies[b[close]], np.where(probed[b[close], home[a[close]]], 0, copies[a[close]])))
                good = over > room
                a, b = a[good], b[good]
                missed = ~probed[b, home[a]]
                links += np.bincount(a, copies[b], len(id_)) + np.bincount(b[missed], copies[a[missed]], len(id_))
                x, y = np.concatenate([x, a]), np.concatenate([y, b])
                if len(x) > AT_ONCE:
                    x, y = _spanning(x, y)
            x, y = _spanning(x, y)
            node = np.flatnonzero(links)
            none = np.zeros(len(x), np.int64)
            unsure.append((id_[node], id_[node], links[node].astype(np.int64), np.zeros(len(node), np.int64)))
            unsure.append((id_[x], id_[y], none, none))
            kind = g.schema.field("id").type
            for k, (a, b, to_a, to_b) in enumerate(unsure):
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(to_a, pa.int64()), pa.array(to_b, pa.int64()), pa.array(np.full(len(a), k >= len(unsure) - 2))], ["a", "b", "n", "m", "sure"])

    found = table(map_arrow(members.unionByName(asking).repartition("list", "i", "j").sortWithinPartitions("list", "i", "j", "side"), search, f"a {ids}, b {ids}, n long, m long, sure boolean"), "found")

    def check(batches):
        for b in batches:
            (p, _), (q, _) = units(b.column(0), size), units(b.column(1), size)
            good = pa.array((p * q).sum(1) >= cosine)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(good) for c in range(2, 6)], ["a", "b", "n", "m"])

    # of the vectors only those of such pairs are sent, unless these are very many
    pairs = found.where("not sure").drop("sure")
    need = table(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "need")
    some = table(classes.join(small(need), "rep", "left_semi").select("rep", "embedding"), "some").hint("merge")
    whole = lambda c: some.select(F.col("rep").alias(c), F.col("embedding").alias(f"v{c}"))
    pairs = pairs.join(whole("a"), "a").join(whole("b"), "b").select("va", "vb", "a", "b", "n", "m")
    checked = table(map_arrow(pairs, check, f"a {ids}, b {ids}, n long, m long"), "checked")
    each = found.where("sure and a = b").select("a", "n").unionByName(checked.select("a", "n")).unionByName(checked.select(F.col("b").alias("a"), F.col("m").alias("n")))
    linked = each.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = components(found.where("sure and a <> b").select("a", "b").unionByName(checked.select("a", "b")))
    info = coded.select(F.col("id").alias("rep")).distinct().join(linked, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "rep").alias("component"))
    return table(classes.select("k1", "k2", "rep", "copies").join(info, "rep").select("k1", "k2", (F.col("n") + F.col("copies") - 1).alias("n"), "component"), "info")
