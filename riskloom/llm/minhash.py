"""MinHash near-duplicates: links of documents whose shingle sets are alike, and their groups.

1. Texts are lower-cased (A-Z), cut into words, and their distinct runs of five
   words hashed to 64 bits. ``HASHES`` universal hash functions give the signature.
2. Documents with equal sets are one class; one of them stands for all.
3. Signatures are cut into bands. Whoever shares a band with others is tied to the
   smallest of them, and the ties' components are the candidate groups: linked
   documents are in one candidate group (they miss every band with probability
   below 1e-7).
4. Inside a candidate group signatures are compared, and likely pairs are confirmed
   on their full sets, most alike first; pairs that are already in one component
   need no check. A group of more than ``BLOCK`` documents is cut into blocks that
   share a few pivots, which joins the bulk of the blocks; then whoever is outside
   its group's largest component is compared with everyone in it, block by block.
   So what is shuffled grows with the group, times the outsiders' blocks, and not
   with its pairs. Where outsiders are so many that this would cost more than the
   bands, they are compared within their bands instead.
5. The confirmed links' components are the result.

Null and empty texts have empty sets and are linked with nothing. Rows that repeat
are copies of each other like any equal texts; rows of one id are told apart by
an internal number. An empty table gives an empty result. Other columns are kept
out of the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import look_up, scratch, stored, unused, whole_text, words_of
from riskloom.llm.components import connected_components
from riskloom.operators.joins import many_to_one

WIDTH = 5
BANDS, ROWS = 28, 5
HASHES = BANDS * ROWS
# Five standard deviations of a signature's estimate at the threshold.
MARGIN = 0.15
BLOCK = 256
PIVOTS = 32

_random = np.random.default_rng(20240229)
_A = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word runs; fewer words are one run."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(n, width)
    run = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        run = (run * _P1) ^ (h[i:n - size + 1 + i] + _P2)
        run ^= run >> np.uint64(29)
    return np.unique(run * _P2)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each universal hash, 16 of its middle bits.

    Different least values agree in these bits once in 65,536 times, which only
    adds a few pairs to confirm.
    """
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 512):
        values = np.multiply.outer(_A, hashes[i:i + 512])
        values += _B[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return ((least >> np.uint64(24)) & np.uint64(0xFFFF)).astype("<u2")


def _sketch_udf():
    kind = pa.struct([("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])

    @F.arrow_udf("n bigint, digest binary, sig binary")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            s = shingles(t)
            rows.append({"n": len(s), "digest": xxhash.xxh3_128_digest(s.tobytes()),
                         "sig": signature(s).tobytes() if len(s) else None})
        return pa.array(rows, kind)

    return run


def _band_keys(sigs: DataFrame) -> DataFrame:
    """node and key of every band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = len(batch["sig"])
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), "<u2").reshape(m, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _P2, (m, BANDS)).copy()
            for r in range(ROWS):
                key = (key ^ sig[:, :, r]) * _P1
                key ^= key >> np.uint64(31)
            yield pa.RecordBatch.from_pydict({
                "node": np.repeat(batch["node"].to_numpy(), BANDS), "key": key.ravel().view(np.int64),
            })

    return sigs.mapInArrow(run, "node bigint, key bigint")


def _ties(bands: DataFrame) -> DataFrame:
    """Every node of a band that several share, tied to the band's smallest node."""
    least = bands.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("w"))
    shared = stored(least.where("v != w").select("key", "v"), "shared-bands")
    tied = look_up(bands, shared, ["key"])
    return tied.where("node != v").select(F.col("node").alias("u"), "v").distinct()


class _Forest:
    """Components of a block's rows."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        root = i
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[i] != root:
            self.parent[i], i = root, self.parent[i]
        return root


def link_block(nodes, sizes, sigs, sets, labels, percent: int, left=None, right=None) -> list[tuple[int, int]]:
    """Confirmed links that join the components of a block's rows.

    Rows with equal ``labels`` are joined already. With ``left`` and ``right``
    (row numbers) only pairs between the two are looked at.
    """
    forest, links = _Forest(len(nodes)), []
    first: dict[int, int] = {}
    for i, label in enumerate(labels.tolist()):
        forest.parent[i] = first.setdefault(label, i)
    left = np.arange(len(nodes)) if left is None else left
    right = np.arange(len(nodes)) if right is None else right
    likely = []
    for i in left.tolist():
        others = right[(labels[right] != labels[i]) & (right != i)]
        if left is right or len(left) == len(nodes):
            others = others[others > i]
        # Sets of too different a size can't reach the threshold.
        fits = 100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])
        others = others[fits]
        alike = (sigs[others] == sigs[i]).mean(axis=1)
        for k in np.flatnonzero(alike >= percent / 100 - MARGIN).tolist():
            likely.append((-alike[k], i, int(others[k])))
    for _, i, j in sorted(likely):
        a, b = forest.find(i), forest.find(j)
        if a == b:
            continue
        common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if 100 * common >= percent * (sizes[i] + sizes[j] - common):
            forest.parent[max(a, b)] = min(a, b)
            links.append((int(nodes[i]), int(nodes[j])))
    return links


def _link_units(units: DataFrame, percent: int) -> DataFrame:
    """Links inside each unit: columns u1, u2, u3, grp, node, label, outside, sig, hashes."""

    def run(batch: pa.Table) -> pa.Table:
        nodes, groups = batch["node"].to_numpy(), batch["grp"].to_numpy()
        labels, outside = batch["label"].to_numpy(), np.array(batch["outside"].to_pylist(), bool)
        sigs = np.frombuffer(b"".join(batch["sig"].to_pylist()), "<u2").reshape(len(nodes), HASHES)
        sets = [np.frombuffer(s, "<u8") for s in batch["hashes"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        order = np.lexsort((outside, nodes, groups))
        links = []
        for own in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1):
            out = outside[own]
            between = {} if not out.any() else {"left": np.flatnonzero(out), "right": np.flatnonzero(~out)}
            links += link_block(nodes[own], sizes[own], sigs[own], [sets[i] for i in own.tolist()],
                                labels[own], percent, **between)
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return units.groupBy("u1", "u2", "u3").applyInArrow(run, "u bigint, v bigint")


def _block(node: str, blocks) -> F.Column:
    return F.pmod(F.xxhash64(node, F.lit(5)), blocks)


def _within(members: DataFrame, percent: int) -> DataFrame:
    """Links inside small groups, and inside the blocks of large ones with their shared pivots."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("bigint")
    pivot = F.pmod(F.xxhash64("node", F.lit(7)), F.col("members")) < PIVOTS
    rows = members.withColumn("large", F.col("members") > BLOCK).withColumn(
        "u3",
        F.explode(F.when(~F.col("large"), F.array(F.lit(0).cast("bigint")))
                  .when(pivot, F.sequence(F.lit(0).cast("bigint"), blocks - 1))
                  .otherwise(F.array(_block("node", blocks)))),
    )
    # Small groups share a unit, about as many rows as a block.
    shared = max(1, members.where(F.col("members") <= BLOCK).count() // BLOCK)
    return _link_units(
        rows.select(
            F.col("large").cast("bigint").alias("u1"),
            F.when(F.col("large"), F.col("grp")).otherwise(F.pmod(F.xxhash64("grp"), F.lit(shared))).alias("u2"),
            "u3", "grp", "node", F.col("node").alias("label"), F.lit(False).alias("outside"), "sig", "hashes",
        ), percent)


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Links between the nodes outside their group's largest component and all others of the group.

    ``members``: grp, node, label, sig, hashes.
    """
    counts = members.groupBy("grp", "label").agg(F.count("*").alias("n"))
    largest = counts.groupBy("grp").agg(F.sum("n").alias("members"), F.max("n").alias("top"))
    main = many_to_one(counts, largest, ["grp"], "inner").where("n = top").groupBy("grp").agg(
        F.min("label").alias("main"), F.first("members").alias("members"), F.first("top").alias("top"))
    main = main.where("members > top").select(
        "grp", "main", F.ceil(F.col("members") / BLOCK).cast("bigint").alias("blocks"),
        F.ceil((F.col("members") - F.col("top")) / BLOCK).cast("bigint").alias("outer"),
    )
    rows = many_to_one(members, main, ["grp"], "inner")
    zero = F.lit(0).cast("bigint")
    # Everyone stands once in its block for each block of outsiders ...
    inside = rows.select(
        "*", F.lit(False).alias("outside"), _block("node", F.col("blocks")).alias("u2"),
        F.explode(F.sequence(zero, F.col("outer") - 1)).alias("u3"))
    # ... and an outsider once in its outsiders' block for each block.
    outside = rows.where("label != main").select(
        "*", F.lit(True).alias("outside"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("u2"),
        _block("node", F.col("outer")).alias("u3"))
    return _link_units(
        inside.unionByName(outside).select(
            F.col("grp").alias("u1"), "u2", "u3", "grp", "node", "label", "outside", "sig", "hashes"), percent)


def _links(rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between representatives that join whatever is alike."""
    # Nearly every row stands for a class, so both sides are shuffled at any size.
    sigs = rows.select("node", "sig").join(reps.select("node").hint("merge"), "node", "left_semi")
    bands = stored(_band_keys(sigs), "bands")
    groups = connected_components(_ties(bands)).withColumnRenamed("root", "grp")
    sizes = groups.groupBy("grp").agg(F.count("*").alias("members"))
    groups = stored(many_to_one(groups, sizes, ["grp"], "inner"), "sized-groups")

    @F.arrow_udf("binary")
    def hashes(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t).astype("<u8").tobytes() for t in texts.to_pylist()], pa.binary())

    chosen = look_up(rows.select("node", "sig", "text_"), groups, ["node"])
    members = stored(chosen.select("grp", "members", "node", "sig", hashes("text_").alias("hashes")), "members")
    links = stored(_within(members, percent), "links-within")
    large = members.where(F.col("members") > BLOCK)
    if large.isEmpty():
        return links
    labels = connected_components(links)
    labelled = stored(
        large.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"), "labelled")
    # Outsiders of a group, against what comparing them band by band would shuffle.
    per_label = labelled.groupBy("grp", "label").agg(F.count("*").alias("n"), F.first("members").alias("members"))
    cost = per_label.groupBy("grp").agg(F.max("n").alias("top"), F.first("members").alias("members")).select(
        "grp", ((F.col("members") - F.col("top")) * 2 > BLOCK * BANDS).alias("wide"))
    marked = stored(many_to_one(labelled, cost, ["grp"], "inner"), "marked")
    columns = ["grp", "node", "label", "sig", "hashes"]
    found = links.unionByName(_across(marked.where("not wide").select(*columns), percent))
    wide = marked.where("wide")
    if not wide.isEmpty():
        by_band = wide.select("node", "label", "sig", "hashes").join(bands, "node")
        found = found.unionByName(_across(by_band.withColumnRenamed("key", "grp").select(*columns), percent))
    return found


def _grouped(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The stored rows (all columns, then the node's number) and, per node, its group.

    The second has node, doc_id, n, component_id and ``grp``, the same number for
    all rows of a group.
    """
    name = unused(docs, "sketch_")
    kept = stored(docs.withColumns({
        f"{name}node": F.monotonically_increasing_id(), f"{name}s": _sketch_udf()(whole_text())}), "sketches")
    rows = kept.select(
        F.col(f"{name}node").alias("node"), F.col("doc_id").cast("bigint").alias("doc_id"),
        whole_text().alias("text_"), f"{name}s.*",
    )
    with scratch(docs.sparkSession):
        classes = stored(
            rows.where("n > 0").groupBy("digest").agg(
                F.min("node").alias("rep"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies")),
            "classes",
        )
        roots = connected_components(_links(rows, classes.select(F.col("rep").alias("node")), percent))
        joined = classes.join(roots, classes["rep"] == roots["node"], "left").select(
            "digest", "first_id", "copies", "rep", F.coalesce("root", "rep").alias("grp"),
            F.col("root").isNotNull().alias("linked"))
        # Only groups of several rows need looking up.
        joined = stored(joined.where("linked or copies > 1"), "groups")
        least = joined.groupBy("grp").agg(F.min("first_id").alias("component_id"))
        by_digest = many_to_one(joined, least, ["grp"], "inner").select("digest", "grp", "component_id")
        by_digest = stored(by_digest, "by-digest", leave=True)
    alone = rows.select("node", "doc_id", "n", "digest")
    out = look_up(alone, by_digest, ["digest"], "left").select(
        "node", "doc_id", "n",
        F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.coalesce("grp", "node")).otherwise(F.col("node")).alias("grp"),
    )
    return kept.drop(f"{name}s"), out


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked where 100 * |A & B| >= percent * |A | B|.
    """
    _, groups = _grouped(docs.select("doc_id", "text"), percent)
    return groups.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def deduplicate(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each group: the first row with the group's smallest id."""
    rows, groups = _grouped(docs, percent)
    number = rows.columns[-1]
    with scratch(docs.sparkSession):
        groups = stored(groups, "grouped")
        is_first = F.col("doc_id").eqNullSafe(F.col("component_id"))
        several = groups.groupBy("grp").agg(
            F.count("*").alias("rows"), F.min(F.when(is_first, F.col("node"))).alias("first")).where("rows > 1")
        # Those that go are fewer than those that stay.
        gone = many_to_one(groups.select("grp", "node"), several, ["grp"], "inner").where("node != first")
        gone = stored(gone.select(F.col("node").alias(number)), "gone", leave=True)
    return look_up(rows, gone, [number], "left_anti").select(*docs.columns)
