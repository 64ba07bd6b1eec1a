"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its word shingles (five words): weight = (1 + ln tf) * idf. Consistent
weighted sampling draws ``BANDS`` times ``ROWS`` shingles such that two documents draw the same one with
the probability of their weighted Jaccard similarity. Each band of ``ROWS`` draws of its own is a bucket;
documents that share a bucket and lie in one size class (weighted Jaccard cannot exceed the ratio of total
weights) are candidates, and every accepted link is verified by the exact weighted Jaccard similarity. A
pair of similarity s shares no band with the probability (1 - s**4)**15: 0.04 % at 0.80, 0.005 % at 0.85.

No pairs leave a task. Buckets with the same members are one. First, every member of a bucket is compared
with the bucket's leader, and leaves once the triangle inequality of the Jaccard distance rules out a link
to any document that is not linked to that leader, so a tight group costs one comparison per document.
What is left, where it is not connected already, is compared in blocks: a bucket's members are dealt to
chunks of bounded size, a task holds two chunks, and the similarities of all their documents are one
matrix product over the shingles that both have. The task tells a spanning forest of the links it finds,
at most one row per document. So rows follow the number of members; a bucket of n mutually unlike members
takes n * n multiplications in tasks of bounded size, and no cap drops any of them.

Documents with equal word sequences are one candidate; the copies join their representative's class
directly.

Document frequencies are counted over all documents in 2**IDF_BITS hashed buckets (their table is what
is broadcast, 1 MB). idf is 1 for shingles of one document and falls by at most ``IDF_SPAN`` for those
that are everywhere: a stronger span would drop links inside large groups of near copies, whose
shared shingles are frequent because of the group itself.

Defined results: documents without a word (null, empty, marks only) link with nothing; texts of fewer
than five words are one shingle of all their words; rows that share an id are one document, whose best
text counts; rows with a null id link with nothing and are kept; ties go to the smallest id; an empty
table gives an empty table. Words are those of benchmark decontamination (A-Z lower-cased).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacanta.llm.batches import blocks, flat, for_texts, mix, word_hashes
from vacanta.llm.components import components
from vacanta.sources.staging import stage

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 4
BANDS = 15
SAMPLES = ROWS * BANDS
IDF_BITS = 18
IDF_SPAN = 0.1
#: Documents, and shingles of them, that a chunk of a bucket has, about.
CHUNK = 1024
CHUNK_SHINGLES = 2_000_000
#: Shingles of a matrix product at once.
COLUMNS = 2048
#: Ratio of neighbouring size classes.
CLASS_RATIO = 1.6

_U = np.uint64
_TABLE_BITS = 14
_PLAN: list[tuple] = []


def sampling_plan() -> tuple:
    """Fixed random tables: quantiles of Gamma(2, 1), its logarithm, and the draws of each band."""
    if not _PLAN:
        q = (np.arange(1 << _TABLE_BITS) + 0.5) / (1 << _TABLE_BITS)
        low, high = np.zeros_like(q), np.full_like(q, 60.0)
        for _ in range(60):  # invert the distribution function 1 - (1 + x) exp(-x)
            x = (low + high) / 2
            above = 1 - (1 + x) * np.exp(-x) > q
            high, low = np.where(above, x, high), np.where(above, low, x)
        gamma = ((low + high) / 2).astype(np.float32)
        rng = np.random.default_rng(11)
        picks = np.arange(SAMPLES).reshape(BANDS, ROWS)
        seeds = rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | _U(1)
        _PLAN.append((gamma, np.log(gamma), (q * 1.0).astype(np.float32), picks, seeds))
    return _PLAN[0]


def shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 32-bit shingles of each text, sorted, flat; their counts; text starts (n + 1); word sequence hashes (n, 2)."""
    data, offsets = flat(texts)
    words, first = word_hashes(data, offsets)
    n, sizes = len(texts), np.diff(first)
    text = np.repeat(np.arange(n), sizes)
    place = np.arange(len(words)) - first[text] if len(words) else np.zeros(0, np.int64)
    # A shingle is the sum of its words times powers of a constant; short texts take what they have.
    h = np.zeros(len(words), np.uint64)
    factor = 1
    for k in range(width):
        part = np.zeros(len(words), np.uint64)
        if k < len(words):
            part[: len(words) - k] = words[k:]
            part[place + k >= sizes[text]] = 0
        h += part * _U(factor)
        factor = factor * 0xD1342543DE82EF95 % (1 << 64)
    starts = (place + width <= sizes[text]) | (place == 0)
    key = (text[starts].astype(np.uint64) << _U(32)) | (mix(h[starts]) >> _U(32))
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    unique = key[at]
    counts = np.diff(np.append(at, len(key)))
    cut = np.searchsorted(unique >> _U(32), np.arange(n + 1, dtype=np.uint64))
    order = np.zeros((n, 2), np.uint64)
    full = sizes > 0
    if len(words):
        for j, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            order[full, j] = np.add.reduceat(mix(words + place.astype(np.uint64) * _U(salt)), first[:-1][full])
    return (unique & _U(0xFFFFFFFF)).astype(np.uint32), counts, cut, order


def idf_table(docs: DataFrame, text: str) -> np.ndarray:
    """Weight factor per hashed shingle bucket, 1 - IDF_SPAN to 1, from the counts of all documents."""
    size = 1 << IDF_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for start, end in blocks(batch.column(0)):
                ids, _, cut, _ = shingles(batch.column(0).slice(start, end - start))
                total[:size] += np.bincount(ids >> np.uint32(32 - IDF_BITS), minlength=size)
                total[size] += int((np.diff(cut) > 0).sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    rows = docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(size + 1)
    n[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    documents, usual = max(n[size], 1.0), n[:size].mean()
    # What a bucket holds above the usual comes from a shingle of that many documents.
    frequency = np.clip(n[:size] - usual, 1.0, documents)
    idf = 1 - np.log(frequency) / np.log(max(documents, 2.0))
    return (1 - IDF_SPAN + IDF_SPAN * idf).astype(np.float32)


def draw_samples(ids: np.ndarray, log_weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(SAMPLES, texts): hash of the drawn shingle and its weight step, for texts that begin at ``starts``.

    Improved consistent weighted sampling: t = floor(ln w / r + b), ln y = r (t - b), and the smallest
    ln c - ln y - r is drawn, with r and c from Gamma(2, 1) and b uniform, all from the shingle's hash.
    """
    gamma, log_gamma, uniform, _, seeds = sampling_plan()
    sizes = np.diff(np.append(starts, len(ids)))
    base = mix(ids.astype(np.uint64) + _U(1))
    mask = _U((1 << _TABLE_BITS) - 1)
    out = np.zeros((SAMPLES, len(starts)), np.uint64)
    for k in range(SAMPLES):
        h = base * seeds[k]
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        r = gamma[(h >> _U(50)).astype(np.int64)]
        log_c = log_gamma[((h >> _U(36)) & mask).astype(np.int64)]
        b = uniform[((h >> _U(22)) & mask).astype(np.int64)]
        t = np.floor(log_weight / r + b)
        value = log_c - r * (t - b) - r
        lowest = np.minimum.reduceat(value, starts)
        hit = np.flatnonzero(value == np.repeat(lowest, sizes))
        # The first shingle of the lowest value in each text; equal values come in the order of ids.
        drawn = hit[np.searchsorted(hit, starts)]
        out[k] = mix(base[drawn] + t[drawn].astype(np.int64).astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(k))
    return out


def _weights(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return ((1 + np.log(counts)) * idf[ids >> np.uint32(32 - IDF_BITS)]).astype(np.float32)


def _packed(counts: np.ndarray) -> bytes:
    """Counts in as many bytes each as the largest needs, up to eight; nothing where all are 1."""
    most = int(counts.max())
    return b"" if most == 1 else counts.astype(next(k for k in ("<u1", "<u2", "<u4", "<u8") if most <= np.iinfo(k).max)).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if data else np.ones(n, np.int64)


def sketches(docs: DataFrame, idf, key: str, text: str) -> DataFrame:
    """(id, copy_hi, copy_lo, size, buckets) of documents with words: word sequence hash, shingles and bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, _, picks, _ = sampling_plan()
        for batch in batches:
            for start, end in blocks(batch.column(1), 1 << 20):
                ids, counts, cut, order = shingles(batch.column(1).slice(start, end - start))
                rows = np.flatnonzero(np.diff(cut) > 0)
                if not len(rows):
                    continue
                weight = _weights(ids, counts, idf.value)
                starts = cut[:-1][rows]
                drawn = draw_samples(ids, np.log(weight), starts)
                bands = np.zeros((BANDS, len(rows)), np.uint64)
                for j in range(BANDS):
                    for i in picks[j]:
                        bands[j] = mix(bands[j] * _U(31) + drawn[i] + _U(j))
                place = np.log(np.add.reduceat(weight, starts, dtype=np.float64)) / np.log(CLASS_RATIO)
                low, high = np.floor(place), np.floor(place - np.log(SIMILARITY) / np.log(CLASS_RATIO) + 1e-6)
                values = []
                for i in range(len(rows)):
                    classes = {int(low[i]), int(high[i])}
                    values.append(np.concatenate([mix(bands[:, i] + _U((c & 0xFFFF) * 0xD6E8FEB86659FD93 % (1 << 64))) for c in classes]).view(np.int64))
                sizes = np.array([len(v) for v in values])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start).take(pa.array(rows)),
                        pa.array(order[rows, 0].view(np.int64)),
                        pa.array(order[rows, 1].view(np.int64)),
                        pa.array(np.diff(cut)[rows], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(values))),
                    ],
                    ["id", "copy_hi", "copy_lo", "size", "buckets"],
                )

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, copy_hi long, copy_lo long, size long, buckets array<long>"
    )


def weighted_sets(docs: DataFrame, idf, key: str, text: str) -> DataFrame:
    """(id, ids, weights): the weighted shingle set of every document with words, as binary columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in blocks(batch.column(1)):
                ids, counts, cut, _ = shingles(batch.column(1).slice(start, end - start))
                rows = np.flatnonzero(np.diff(cut) > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start).take(pa.array(rows, pa.int64())),
                        pa.array([ids[cut[i] : cut[i + 1]].tobytes() for i in rows], pa.binary()),
                        pa.array([_packed(counts[cut[i] : cut[i + 1]]) for i in rows], pa.binary()),
                    ],
                    ["id", "ids", "counts"],
                )

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, ids binary, counts binary")


def similarities(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of all (shingles, counts) sets on the left with all on the right.

    The smaller of two weights is a sum over levels: a count reaches every level up to itself, and a
    level adds the logarithm of its step. So common weight is a product of 0-1 matrices.
    """
    rows = left if right is left else left + right
    sizes = np.array([len(ids) for ids, _ in rows])
    ids, counts = (np.concatenate([r[k] for r in rows]) for k in (0, 1))
    row = np.repeat(np.arange(len(rows)), sizes)
    factor = idf[ids >> np.uint32(32 - IDF_BITS)].astype(np.float64)
    total = np.bincount(row, (1 + np.log(counts)) * factor, len(rows))
    key, step = ids.astype(np.uint64) << _U(32), factor
    many = np.flatnonzero(counts > 1)
    if len(many):
        levels = np.unique(counts[many])
        reached = np.searchsorted(levels, counts[many], "right")
        level = np.arange(reached.sum()) - np.repeat(np.cumsum(reached) - reached, reached)
        at = np.repeat(many, reached)
        rise = np.diff(np.log(levels), prepend=0.0)
        key, row, step = np.concatenate([key, key[at] + level.astype(np.uint64) + _U(1)]), np.concatenate([row, row[at]]), np.concatenate([step, factor[at] * rise[level]])
    order = np.argsort(key, kind="stable")
    key, row, step = key[order], row[order], step[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    column = np.cumsum(first) - 1
    # A shingle of one document is common to no pair.
    shared = np.bincount(column)[column] > 1
    column, row, step = column[shared], row[shared], step[shared]
    first = np.concatenate([[True], column[1:] != column[:-1]]) if len(column) else np.zeros(0, bool)
    column = np.cumsum(first) - 1
    n, m = len(left), len(right)
    common = np.zeros((n, m))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        width = int(column[b - 1]) + 1 - low
        has = np.zeros((len(rows), width))
        has[row[a:b], column[a:b] - low] = 1
        weight = np.zeros(width)
        weight[column[a:b] - low] = step[a:b]
        common += (has[:n] * weight) @ (has.T if right is left else has[n:].T)
    out = common / (total[:n, None] + (total if right is left else total[n:])[None, :] - common)
    if right is left:
        np.fill_diagonal(out, 1.0)
    return out


def spanning_forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the symmetric matrix ``linked`` connects, one less than members per component."""
    seen, out = np.zeros(len(linked), bool), []
    for start in np.flatnonzero(linked.any(axis=1)).tolist():
        if seen[start]:
            continue
        seen[start] = True
        frontier = np.array([start])
        while len(frontier):
            reach = linked[frontier]
            fresh = np.flatnonzero(reach.any(axis=0) & ~seen)
            out += zip(frontier[reach[:, fresh].argmax(axis=0)].tolist(), fresh.tolist(), strict=True)
            seen[fresh] = True
            frontier = fresh
    return out


def _tasks(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` (bucket, part, side, id, group) with their sets, the rows of a part together and in order of sides."""
    return rows.join(sets, "id").select("bucket", "part", "side", "id", "group", "ids", "counts").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "side")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """(bucket, rows) of each part of ``_tasks``; a part is held whole and is bounded by two chunks."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["bucket"], row["part"]) != key:
                if held:
                    yield key[0], held
                key, held = (row["bucket"], row["part"]), []
            held.append(row)
    if held:
        yield key[0], held


def _sets(rows: list[dict]) -> list[tuple[np.ndarray, np.ndarray]]:
    found = [np.frombuffer(r["ids"], np.uint32) for r in rows]
    return [(x, _unpacked(r["counts"], len(x))) for x, r in zip(found, rows, strict=True)]


def _chunked(members: DataFrame) -> DataFrame:
    """``members`` with ``chunks``, the number of chunks of their bucket, and ``chunk``, their own.

    What is known of a bucket is staged, so that adaptive execution can split a hot bucket's join.
    """
    known = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("total") / CHUNK_SHINGLES))
    known = stage(known.where("n > 1").select("bucket", chunks.alias("chunks")), "chunks")
    return members.join(known, "bucket").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))


def with_leaders(members: DataFrame, sets: DataFrame, idf) -> DataFrame:
    """(bucket, id, leader, similarity) of every member but the leader, its bucket's smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _parts(batches):
            own, lead = [r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1]
            if not own:
                continue
            nearest: dict[int, float] = {}
            # Rows that share an id are one document: its best text counts.
            for r, s in zip(own, similarities(_sets(own), _sets(lead), idf.value).max(axis=1).tolist(), strict=True):
                nearest[r["id"]] = max(s, nearest.get(r["id"], 0.0))
            n = len(nearest)
            columns = [pa.array([bucket] * n, pa.int64()), pa.array(list(nearest), pa.int64()), pa.array([lead[0]["id"]] * n, pa.int64()), pa.array(list(nearest.values()), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "id", "leader", "similarity"])

    chunked = stage(_chunked(members), "chunked")
    leaders = chunked.groupBy("bucket", "chunks").agg(F.min("id").alias("leader"))
    own = chunked.join(stage(leaders.select("bucket", "leader"), "leaders"), "bucket").where("id <> leader")
    own = own.select("bucket", F.col("chunk").alias("part"), F.lit(0).alias("side"), "id", F.lit(0).cast("long").alias("group"))
    each = leaders.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("part"), F.lit(1).alias("side"), F.col("leader").alias("id"), F.lit(0).cast("long").alias("group"))
    return _tasks(own.unionByName(each), sets).mapInArrow(run, "bucket long, id long, leader long, similarity double")


def among_members(members: DataFrame, sets: DataFrame, idf, similarity: float) -> DataFrame:
    """(a, b): links that connect whatever is similar enough in a bucket and in different groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _parts(batches):
            group = np.array([r["group"] for r in rows], np.int64)
            if (group == group[0]).all():
                continue
            n = sum(r["side"] == 0 for r in rows)
            own = _sets(rows)
            linked = np.zeros((len(rows), len(rows)), bool)
            if n == len(rows):
                linked = similarities(own, own, idf.value) >= similarity
            elif n:
                linked[:n, n:] = similarities(own[:n], own[n:], idf.value) >= similarity
                linked |= linked.T
            linked &= group[:, None] != group[None, :]
            found = spanning_forest(linked)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([rows[i]["id"] for i, _ in found], pa.int64()), pa.array([rows[j]["id"] for _, j in found], pa.int64())], ["a", "b"])

    chunked = _chunked(members)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")
    pairs = chunked.select("bucket", "id", "group", "chunk", "chunks", other)
    part = F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other")
    rows = pairs.select("bucket", part.alias("part"), F.when(F.col("chunk") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "group")
    return _tasks(rows, sets).mapInArrow(run, "a long, b long")


def bucket_links(members: DataFrame, sets: DataFrame, idf, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): verified links that connect all documents which share a bucket and are similar enough.

    What is aggregated per bucket is staged before it is joined back, so that adaptive execution can
    split the hot side of that join. ``members`` has the distinct (bucket, id, size) of buckets with
    two documents or more; size is the number of shingles.
    """
    judged = stage(with_leaders(members, sets, idf).withColumn("distance", 1 - F.col("similarity")), "judged")
    linked = F.col("similarity") >= similarity
    links = judged.where(linked).select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    # Per bucket: the nearest member that is not linked to the leader. Leaders have met everyone.
    nearest = judged.groupBy("bucket").agg(F.min(F.when(~linked, F.col("distance"))).alias("nearest")).where("nearest IS NOT NULL")
    ruled_out = F.col("nearest") - F.col("distance") > 1 - similarity + 1e-9
    left = judged.join(stage(nearest, "nearest"), "bucket").where(~(linked & ruled_out)).select("bucket", "id")
    # What is connected so far is one group; a bucket of one group is done.
    groups = stage(components(links), "groups")
    placed = stage(left.join(groups, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("group")), "placed")
    several = placed.groupBy("bucket").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("bucket")
    open_ones = placed.join(stage(several, "several"), "bucket", "left_semi").join(members.select("bucket", "id", "size"), ["bucket", "id"])
    return links.unionByName(stage(among_members(open_ones, sets, idf, similarity), "links"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, group_id, kept): one row per distinct id; the smallest id of a group is its group_id and is kept."""
    spark = docs.sparkSession
    for_texts(spark)
    idf = spark.sparkContext.broadcast(idf_table(docs, text))  # 2**IDF_BITS numbers
    known = docs.where(F.col(key).isNotNull())
    drawn = stage(sketches(known, idf, key, text), "sketches")
    # Equal word sequences: all copies link with the smallest id.
    first = drawn.groupBy("copy_hi", "copy_lo").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("copy_hi", "copy_lo", "first")
    copies = stage(drawn.select("id", "copy_hi", "copy_lo").join(stage(first, "first"), ["copy_hi", "copy_lo"]).where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")), "copies")
    # Copies leave before the buckets are spread out.
    alone = drawn.select("id", "size", "buckets").join(copies.select(F.col("a").alias("id")), "id", "left_anti")
    singles = alone.select("id", "size", F.explode(F.array_distinct("buckets")).alias("bucket")).groupBy("bucket", "id").agg(F.max("size").alias("size"))
    # Bands of one group mostly have the same members: one bucket of them is enough.
    told = [F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("total"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("parity")]
    kinds = singles.groupBy("bucket").agg(*told).where("low < high").groupBy("n", "low", "high", "total", "parity").agg(F.min("bucket").alias("bucket"))
    members = stage(singles.join(stage(kinds.select("bucket"), "buckets"), "bucket", "left_semi"), "members")
    wanted = stage(members.select("id").distinct(), "wanted")
    sets = stage(weighted_sets(known, idf, key, text).join(wanted, "id", "left_semi"), "sets")
    links = bucket_links(members, sets, idf, similarity).unionByName(copies)
    groups = components(links)
    ids = docs.select(F.col(key).alias("id")).distinct()
    joined = ids.join(groups, "id", "left")
    group = F.coalesce(F.col("component"), F.col("id"))
    return joined.select("id", group.alias("group_id"), F.coalesce(group == F.col("id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per group of near duplicates, and all rows with a null id, with the columns of ``docs``.

    The smallest id of a group stays. Where ids repeat, every row is judged on its own: unlike texts of
    one id all stay, and of alike ones the smallest text of the smallest id.
    """
    repeated = docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1")
    if repeated.isEmpty():
        gone = near_duplicates(docs, key, text, similarity).where(~F.col("kept")).select(F.col("id").alias("_gone"))
        return docs.join(stage(gone, "gone"), F.col(key) == F.col("_gone"), "left_anti")
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, body = (F.col(names[docs.columns.index(c)]) for c in (key, text))
    rows = stage(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows.where(own.isNotNull()), "row", names[docs.columns.index(text)], similarity)
    placed = groups.select("group_id", F.col("id").alias("row")).join(rows.select("row", own.alias("own"), F.sha2(body, 256).alias("digest")), "row")
    first = placed.groupBy("group_id").agg(F.min(F.struct("own", "digest", "row")).alias("first")).select(F.col("first.row").alias("row"))
    kept = rows.where(own.isNull()).unionByName(rows.join(stage(first, "first"), "row", "left_semi").select(rows.columns))
    return kept.select([F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
