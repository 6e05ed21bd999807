"""N-gram Jaccard join of a table with itself, by MinHash with Bayesian pruning.

Two texts are linked when the Jaccard similarity of their sets of five-word shingles (lower-cased
runs of word characters; a text of one to four words is one shingle) is at least `threshold`.

1. Texts with equal shingle sets form a class, represented by the least doc_id. Copies go no further.
2. Each class has N_HASHES MinHash values, cut into bands of BAND; classes that agree in a
   band are candidates. A pair at 0.8 is missed by all 40 bands of 5 with probability 1.3e-7.
   Only an edge from each class to the least of its bucket is made, never the pairs of a bucket.
3. Connected components of those edges hold every candidate pair. A component is dealt by hash
   into blocks of bounded weight, and each pair of blocks is one piece of work, so a group of
   any size is spread over tasks and no task holds it whole.
4. Within a piece of work, MinHash values are compared STEP at a time. A pair is dropped as soon
   as the posterior probability of reaching the threshold, given the agreements so far and a
   uniform prior, falls below TOLERANCE (or its sizes alone rule it out). What remains is
   verified by counting common shingles exactly.
5. Links are counted for each class within its piece of work; for groups only an edge from each
   class to the least of its linked set there is made, and components of those give the groups.

Result: a row a document: doc_id, class_id (least doc_id with the same shingle set), n_copies
(documents in the class, itself included), n_links (other classes linked to this one), n_linked_docs
(other documents linked to this one, copies included) and group_id (least doc_id reachable by links).

Nulls: a null text counts as empty; texts without words form one class. Documents with null
doc_id take part and are reported with null doc_id. Repeated rows are copies of each other. An
empty table gives an empty result. A text of any length is one row's work. Columns other than doc_id and text are ignored by
ngram_join; one_of_each returns all columns, whatever their names, of one row of each group.
"""

from __future__ import annotations

import re
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weir.llm.shared import bounded_batches, materialize, planned_bytes, scratch, settle, small
from weir.session import ship

THRESHOLD, SHINGLE = 0.8, 5
N_HASHES, BAND, STEP, TOLERANCE = 200, 5, 40, 1e-9
#: Texts of a block: BLOCK_ROWS, so that small groups are spread over SPREAD blocks first, then up to MOST_ROWS; shingles in all, at most.
BLOCK_ROWS, SPREAD, MOST_ROWS, BLOCK_SHINGLES = 150, 12, 1500, 2_000_000
BATCH_CHARS = 2_000_000
#: Bytes of signed rows for which the tables made of them get a file, beyond one for each core.
FILE_BYTES = 64_000_000
_WORD = re.compile(r"\w+")
_M = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 1 << 18:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 48:
            self[word] = value
        return value


_HASHES = WordHash()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = [_WORD.findall(x.lower()) for x in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((h for w in words for h in map(_HASHES.__getitem__, w)), np.uint64, int(sizes.sum()))
    n = len(flat)
    rolled = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        if n > k:
            rolled[: n - k] = mix(rolled[: n - k] * _M + flat[k:])
    out, at = [], 0
    for size in sizes.tolist():
        if size >= SHINGLE:
            out.append(np.unique(rolled[at : at + size - SHINGLE + 1]))
        elif size:
            one = np.zeros(1, np.uint64)
            for h in flat[at : at + size]:
                one = mix(one * _M + h)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _M)
    return x[:n] | np.uint64(1), x[n:]


def min_hashes(sets: list[np.ndarray], n: int = N_HASHES) -> np.ndarray:
    """uint32[len(sets), n]: the least of n hash functions over each set; sets must not be empty."""
    a, b = _seeds(n)
    out = np.empty((len(sets), n), np.uint32)
    starts, i = np.cumsum([0] + [len(s) for s in sets]), 0
    while i < len(sets):  # slices that stay in the cache
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + 16384, side="right")) - 1)
        flat, cuts = np.concatenate(sets[i:j]), starts[i:j] - starts[i]
        for k in range(n):
            out[i:j, k] = np.minimum.reduceat((flat * a[k] + b[k]) >> np.uint64(32), cuts)
        i = j
    return out


def least_agreements(threshold: float, tolerance: float, n: int = N_HASHES, step: int = STEP) -> dict[int, int]:
    """For each number k of values compared, the least agreements whose posterior P(J >= threshold) reaches tolerance.

    With a uniform prior the posterior is Beta(m + 1, k - m + 1), whose tail is P(Binomial(k + 1, threshold) <= m).
    """
    out = {}
    for k in range(step, n + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance and m < k:
            m += 1
            tail += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out[k] = m
    return out


def linked_pairs(
    a: tuple[list[np.ndarray], np.ndarray], b: tuple[list[np.ndarray], np.ndarray] | None, threshold: float, needs: dict[int, int]
) -> tuple[np.ndarray, np.ndarray]:
    """Places (i in a, j in b) of the linked pairs; b None: the pairs i < j within a."""
    same = b is None
    (sa, ma), (sb, mb) = a, (a if same else b)
    na, nb = np.array([len(s) for s in sa]), np.array([len(s) for s in sb])
    all_b, cuts = np.concatenate(sb), np.cumsum(nb) - nb
    vocabulary, spot = np.unique(all_b, return_inverse=True)
    found_i, found_j = [], []
    for i, s in enumerate(sa):
        j = np.arange(i + 1 if same else 0, len(sb))
        j = j[np.minimum(na[i], nb[j]) >= threshold * np.maximum(na[i], nb[j])]
        agree = np.zeros(len(j), np.int32)
        for k, least in needs.items():
            if not len(j):
                break
            agree += (mb[j, k - STEP : k] == ma[i, k - STEP : k]).sum(1)
            on = agree >= least
            j, agree = j[on], agree[on]
        if not len(j):
            continue
        k = np.searchsorted(vocabulary, s)
        k = k[(k < len(vocabulary))]
        mark = np.zeros(len(vocabulary), np.int32)
        mark[k[np.isin(vocabulary[k], s, assume_unique=True)]] = 1
        if len(j) * 4 > len(sb):
            common = np.add.reduceat(mark[spot], cuts)[j]
        else:
            common = np.array([mark[spot[cuts[x] : cuts[x] + nb[x]]].sum() for x in j])
        on = common >= threshold * (na[i] + nb[j] - common) - 1e-9
        found_j.append(j[on])
        found_i.append(np.full(int(on.sum()), i))
    empty = np.zeros(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (empty, empty)


def stars(edges: DataFrame) -> bool:
    """Whether the edges (a, b) are stars already: no node a has two edges, and none is the b of another."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.where("up + down > 1").agg(F.count("*")).first()[0]


def components(edges: DataFrame, files: int = 0) -> DataFrame:
    """(node, root): the least node of each component of the undirected edges (a, b), by large-star and small-star steps.

    Every step writes its edges to the shared folder; steps grow with the logarithm of the longest path.
    What is joined is written first, so that the join of a node with very many edges can be split.
    Stars are what the steps leave as it is, so they end there, without a round of four more tables that shows no change.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", files=files)
    while not stars(now):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", files=files)
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), "large", files=files)
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low", files=files)
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "edges", files=files)
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id long, text string, and the other columns of docs by place, so that no name clashes."""
    own = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*own, *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")))


def signatures(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, others) with row (a number for each row), set_hash, n and bands (empty without words)."""

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        settle("ngrams", _HASHES.clear)
        row = TaskContext.get().partitionId() << 36
        for batch in small(batches, 1):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            at, size = 0, 0
            for i, x in enumerate(texts):
                size += len(x)
                if size < BATCH_CHARS and i + 1 < len(texts):
                    continue
                sets = shingle_sets(texts[at : i + 1])
                full = [k for k, s in enumerate(sets) if len(s)]
                values = min_hashes([sets[k] for k in full]) if full else np.zeros((0, N_HASHES), np.uint32)
                keys = np.zeros((len(full), N_HASHES // BAND), np.uint64)
                for c in range(BAND):
                    keys = mix(keys * _M + values[:, c::BAND].astype(np.uint64))
                keys = mix(keys + np.arange(N_HASHES // BAND, dtype=np.uint64) * _M).view(np.int64)
                bands: list = [[]] * len(sets)
                for k, own in zip(full, keys):
                    bands[k] = own
                made = [
                    pa.array(np.arange(row, row + len(sets))),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                ]
                part = batch.slice(at, len(sets))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*names, "row", "set_hash", "n", "bands"])
                row, at, size = row + len(sets), i + 1, 0

    names, fields = docs.columns, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, row long, set_hash binary, n long, bands array<long>")


def few(signed: DataFrame) -> int:
    """Files for a table made of signed rows: each costs two processes that its executor starts, if the shared folder is a local one."""
    return max(signed.sparkSession.sparkContext.defaultParallelism, -(-planned_bytes(signed) // FILE_BYTES))


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The result is written before what it was made from is deleted."""
    ship(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        signed = materialize(signatures(numbered(docs.select("doc_id", "text"))), "signed")
        return materialize(_joined(signed, threshold).drop("row", "keeper"), "joined", keep=True, files=few(signed))


def _joined(signed: DataFrame, threshold: float) -> DataFrame:
    """The result for each row of signatures(), with row, and keeper: the row of the group's least doc_id."""
    files = few(signed)
    # A class is led by the row of its least doc_id; null ids come last.
    lead = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("d"), "row")).alias("lead")
    classes = signed.groupBy("set_hash").agg(
        lead, F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    classes = materialize(classes.withColumn("node", F.col("lead.row")).drop("lead"), "classes", files=files)
    keyed = classes.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("k")).where("k > 1").drop("k")
    buckets = materialize(buckets, "buckets", files=files)
    edges = keyed.join(buckets, "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    linked = _links(signed, classes, components(edges, files), threshold, files)
    counts = linked.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"), F.sum("docs").alias("d"))
    roots = materialize(components(linked.where("a <> b").select("a", "b"), files), "roots", files=files)
    # A class's node is its row of least doc_id, so the least class's node is the row that stands for the group.
    least = F.min(F.struct(F.coalesce("class_id", F.lit(2**63 - 1)).alias("d"), F.col("node").alias("keeper"))).alias("least")
    led = roots.join(classes.select("node", "class_id"), "node").groupBy("root").agg(least, F.min("class_id").alias("group_id"))
    led = materialize(led.select("root", "group_id", "least.keeper"), "led", files=files)
    groups = roots.join(led, "root").select("node", "group_id", "keeper")
    info = classes.select("set_hash", "node", "class_id", "n_copies").join(counts, "node", "left").join(groups, "node", "left")
    info = materialize(info.withColumn("keeper", F.coalesce("keeper", "node")).drop("node"), "info", files=files)
    return signed.select("doc_id", "row", "set_hash").join(info, "set_hash").select(
        "row",
        "keeper",
        "doc_id",
        "class_id",
        "n_copies",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        (F.coalesce("d", F.lit(0)) + F.col("n_copies") - 1).cast("bigint").alias("n_linked_docs"),
        F.coalesce("group_id", "class_id").alias("group_id"),
    )


def _links(signed: DataFrame, classes: DataFrame, grouped: DataFrame, threshold: float, files: int) -> DataFrame:
    """Verified links: rows (a, b) with a <> b to join groups, and rows (a, a, links, docs) to be summed for a class."""
    sized = materialize(grouped.join(classes.select("node", "n", "n_copies"), "node"), "sized", files=files)
    weight = sized.groupBy("root").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    parts = F.ceil(F.greatest(F.least(F.col("k") / BLOCK_ROWS, F.lit(SPREAD)), F.col("k") / MOST_ROWS, F.col("w") / BLOCK_SHINGLES)).cast("int")
    weight = materialize(weight.select("root", parts.alias("parts")), "weight", files=files)
    members = sized.join(weight, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    members = materialize(members.select("node", "root", "parts", "block", "n_copies"), "members", files=files)
    # By merge at every size: a small table's members would be broadcast, and the plan would change as they grow.
    texts = signed.select(F.col("row").alias("node"), "text").join(members.hint("merge"), "node")

    def shingled(batches):
        settle("ngrams", _HASHES.clear)
        for batch in batches:
            for part in small([batch], 0):
                sets = shingle_sets([x or "" for x in part.column(0).to_pylist()])
                offsets = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                held = pa.ListArray.from_arrays(offsets, np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], held], [*batch.schema.names[1:], "set"])

    fields = "node long, root long, parts int, block int, n_copies long, set array<long>"
    # Nodes are dealt evenly, so neighbouring partitions can share a task and a file.
    sets = texts.select("text", "node", "root", "parts", "block", "n_copies").coalesce(files).mapInArrow(shingled, fields)
    sets = materialize(sets, "sets")
    dealt = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "node", "root", "block", "n_copies", "set", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )
    # By ranges, so that the pieces of a large group are dealt evenly.
    dealt = dealt.repartitionByRange(int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "root", "i", "j")
    needs = least_agreements(threshold, TOLERANCE)

    def work(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        node, block, copies = (table.column(c).to_numpy() for c in ("node", "block", "n_copies"))
        held = pa.concat_arrays(table.column("set").chunks)
        sets = [x.values.to_numpy().view(np.uint64) for x in held]
        values = min_hashes(sets)
        x = np.flatnonzero(block == i)
        if i == j:
            p, q = linked_pairs((sets, values), None, threshold, needs)
            p, q = x[p], x[q]
        else:
            y = np.flatnonzero(block == j)
            p = q = np.zeros(0, np.int64)
            if len(x) and len(y):
                p, q = linked_pairs(([sets[k] for k in x], values[x]), ([sets[k] for k in y], values[y]), threshold, needs)
                p, q = x[p], y[q]
        links = np.bincount(p, minlength=len(node)) + np.bincount(q, minlength=len(node))
        docs = np.bincount(p, copies[q], len(node)) + np.bincount(q, copies[p], len(node))
        # The least node reachable within this piece of work: a star in place of its links.
        root = node.copy()
        while len(p):
            before = root.copy()
            np.minimum.at(root, p, root[q])
            np.minimum.at(root, q, root[p])
            if (before == root).all():
                break
        on = links > 0
        off = on & (root != node)
        none = np.zeros(int(off.sum()), np.int64)
        return pa.table(
            {
                "a": np.concatenate([node[on], node[off]]),
                "b": np.concatenate([node[on], root[off]]),
                "links": np.concatenate([links[on].astype(np.int64), none]),
                "docs": np.concatenate([docs[on].astype(np.int64), none]),
            }
        )

    links = dealt.groupBy("root", "i", "j").applyInArrow(work, "a long, b long, links long, docs long")
    return materialize(links.repartition(files), "links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group: one of least doc_id (null last), whatever rows share its doc_id or text; all columns of docs."""
    ship(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        signed = materialize(signatures(numbered(docs)), "signed", keep=True)
        dropped = _joined(signed, threshold).where("row <> keeper").select("row")
        dropped = materialize(dropped, "dropped", keep=True, files=few(signed))
    names = {f.name: f.name if f.name in ("doc_id", "text") else f"c{i}" for i, f in enumerate(docs.schema)}
    columns = [F.col(names[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema]
    return signed.join(dropped, "row", "left_anti").select(*columns)
