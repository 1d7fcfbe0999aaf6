"""Operator 2, n-gram Jaccard join: documents whose sets of 5-word shingles are nearly equal.

PartEnum signatures. Sizes of sets fall into bands; within a band, a Jaccard similarity of
0.8 bounds the Hamming distance of two sets by some k. The domain of shingles is partitioned
by hash, and subsets of the partitions are enumerated so that two sets with at most k different
shingles share a signature, the hash of what one subset of partitions holds:

* small k: k + 4 partitions, all subsets that leave k out;
* else: first-level partitions of two halves each, more than k halves, subsets of one half.

Equal sets are one class. Classes that share fewer signatures with others than a link needs drop
out. Of each signature group, members meet one leader a turn, first the one with most company: the
text that a family was made from links most of it at once. Links are verified on the texts.
What they join needs no further comparison; members of a signature group that are still in
different components meet once more, where they share one of their rarest shingles early enough
(prefix and position filters, exact too), which keeps a large family of loosely similar
texts from comparing all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsgraph.llm.repeats import packed_texts, stored
from newsgraph.llm.textkit import PLAIN_WORD, Rolling, Slice, fold_case, mix, rows_of, signed, slices, small, text_column
from newsgraph.operators.components import stars

SHINGLE = 5
#: A link: PER_CENT * union <= 100 * intersection.
PER_CENT = 80
#: Largest distance whose partitions are enumerated in subsets of several.
ENUMERATED = 3
#: Rounds in which members meet one leader each before the open rest is compared.
LEADER_ROUNDS = 2
#: Shingles whose signatures one task groups, about.
TASK_SHINGLES = 1_500_000

_ONE = np.uint64(1)


def band_bounds() -> list[int]:
    """Smallest set size of each band; sets below the first link with equal sets only."""
    bounds = [4]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 2, bounds[-1] * 3 // 2))
    return bounds


_BOUNDS = np.array(band_bounds())


def distance(band: int) -> int:
    """Most different shingles of two linked sets that sign in ``band``."""
    return 2 * (int(_BOUNDS[band + 1]) - 1) * (100 - PER_CENT) // (100 + PER_CENT)


def partitions(band: int) -> tuple[int, int]:
    """Number of partitions, and of those that a subset has."""
    k = distance(band)
    if k <= ENUMERATED:
        return k + 4, 4
    halves = k + 2 + -(-k * 15 // 100)
    return halves + halves % 2, 1


def shingle_sets(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted by document, and how many each has.

    A document with fewer words than a shingle has its whole word sequence as one.
    """
    folded = Slice(part.first, fold_case(part.data), part.offsets)
    start, end, first = folded.words(PLAIN_WORD)
    rolling = Rolling(folded.word_hashes(start, end))
    lengths = np.diff(first)
    doc, place = rows_of(np.where(lengths > 0, np.maximum(lengths - SHINGLE + 1, 1), 0))
    at = first[doc] + place
    hashes = rolling.of(at, np.minimum(at + SHINGLE, first[doc + 1]))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.bincount(doc[new], minlength=part.size)


def _set_hashes(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set, scrambled: equal sets have equal ones."""
    edges = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64)])
        out.append(mix(sums[edges[1:]] - sums[edges[:-1]] + counts.astype(np.uint64)))
    return out[0], out[1]


def classes(docs: DataFrame) -> DataFrame:
    """Columns doc_id, h1, h2, n: the class (set hashes) and the size of each document's set."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for part in slices(batch.column(1)):
                hashes, counts = shingle_sets(part)
                one, two = _set_hashes(hashes, counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.size), signed(one), signed(two), pa.array(counts)],
                    names=["doc_id", "h1", "h2", "n"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs))
            .mapInArrow(kernel, "doc_id long, h1 long, h2 long, n long"))


def _signatures(hashes: np.ndarray, band: int) -> np.ndarray:
    """The signatures of one set in one band."""
    parts, chosen = partitions(band)
    k = distance(band)
    scrambled = mix(hashes ^ np.uint64(0x632BE59BD9B4E019))
    own = (scrambled >> np.uint64(32)).astype(np.uint64) * np.uint64(parts) >> np.uint64(32)
    sums = np.zeros(parts, np.uint64)
    np.add.at(sums, own.astype(np.int64), scrambled)
    filled = np.bincount(own.astype(np.int64), minlength=parts) > 0
    if chosen == 1:
        content, some, name = sums, filled, np.arange(parts, dtype=np.uint64)
    else:
        subsets = np.array(list(combinations(range(parts), chosen)))
        content, some = mix(sums[subsets] + subsets.astype(np.uint64)).sum(1, dtype=np.uint64), filled[subsets].any(1)
        name = np.arange(len(subsets), dtype=np.uint64)
    # with more filled partitions than differences, one that agrees is filled: empty ones need no signature
    keep = some if filled.sum() > k else np.ones(len(content), bool)
    return mix(mix(content + name * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(band))[keep]


def needed(hashes: np.ndarray, band: int) -> int:
    """Signatures of the set that a linked set must have too, at least."""
    parts, chosen = partitions(band)
    if chosen > 1:
        return 1
    scrambled = mix(hashes ^ np.uint64(0x632BE59BD9B4E019))
    filled = len(np.unique((scrambled >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)))
    most = min(len(hashes) * 100 // PER_CENT, int(_BOUNDS[band + 1]) - 1)
    return max(1, filled - (len(hashes) + most) * (100 - PER_CENT) // (100 + PER_CENT))


def bands_of(n: int) -> list[int]:
    """The band of a size, and the next one if a larger partner may be there."""
    if n < _BOUNDS[0]:
        return []
    own = int(np.searchsorted(_BOUNDS, n, "right")) - 1
    return [own, own + 1] if n * 100 >= int(_BOUNDS[own + 1]) * PER_CENT else [own]


def shared_signatures(docs: DataFrame, shingles: int) -> DataFrame:
    """Columns sig, member, need: the signatures that several classes have.

    ``member`` is the class hash with its last bit telling the band (own, or the next). Tasks
    send packed arrays, one per target, instead of a row per signature; the number of targets
    follows that of all ``shingles``, so what one of them holds does not grow with the data.
    """
    targets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles // TASK_SHINGLES))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for part in slices(batch.column(0)):
                hashes, counts = shingle_sets(part)
                one = _set_hashes(hashes, counts)[0]
                edges = np.concatenate([[0], np.cumsum(counts)])
                sigs, members, needs = [], [], []
                for i in np.unique(one, return_index=True)[1].tolist():
                    own = hashes[edges[i]:edges[i + 1]]
                    for upper, band in enumerate(bands_of(len(own))):
                        found = _signatures(own, band)
                        sigs.append(found)
                        members.append(np.full(len(found), one[i] & ~_ONE | np.uint64(upper)))
                        needs.append(np.full(len(found), needed(own, band), np.uint32))
                if not sigs:
                    continue
                sig, member, need = map(np.concatenate, (sigs, members, needs))
                target = (sig % np.uint64(targets)).astype(np.int64)
                order = np.argsort(target, kind="stable")
                cut = np.searchsorted(target[order], np.arange(targets + 1))
                sig, member, need = sig[order], member[order], need[order]
                rows = [(t, sig[a:b].tobytes(), member[a:b].tobytes(), need[a:b].tobytes())
                        for t, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 3))],
                    names=["target", "sigs", "members", "needs"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, members, needs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for batch in batches:
            for out, kind, column in zip((sigs, members, needs), (np.uint64, np.uint64, np.uint32), batch.columns[1:]):
                out += [np.frombuffer(b, kind) for b in column.to_pylist()]
        sig, member, need = map(np.concatenate, (sigs, members, needs))
        order = np.lexsort((member, sig))
        sig, member, need = sig[order], member[order], need[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (member[1:] != member[:-1])
        sig, member, need = sig[new], member[new], need[new]
        same = np.zeros(len(sig) + 1, bool)
        same[1:-1] = sig[1:] == sig[:-1]
        several = same[1:] | same[:-1]
        for at in np.array_split(np.flatnonzero(several), several.sum() // 100_000 + 1):
            yield pa.RecordBatch.from_arrays([signed(sig[at]), signed(member[at]), pa.array(need[at].astype(np.int64))],
                                             names=["sig", "member", "need"])

    return (docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(text_column(docs))
            .mapInArrow(sign, "target long, sigs binary, members binary, needs binary")
            .repartition(targets, "target").mapInArrow(group, "sig long, member long, need long"))


def similar(left: np.ndarray, right: np.ndarray) -> bool:
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= PER_CENT * (len(left) + len(right) - both)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link, judged on the texts of one document each."""
    unpack = zstandard.ZstdDecompressor

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for low in range(0, len(batch), 200):
                part = batch.slice(low, 200)
                open_ = unpack().decompress
                packs = {p for c in (2, 3) for p in part.column(c).to_pylist()}
                sets: dict[bytes, np.ndarray] = {}
                names = list(packs)
                for cut in slices(pa.array([open_(p) for p in names], pa.large_binary())):
                    hashes, counts = shingle_sets(cut)
                    edges = np.concatenate([[0], np.cumsum(counts)])
                    for i in range(cut.size):
                        sets[names[cut.first + i]] = hashes[edges[i]:edges[i + 1]]
                link = [similar(sets[x], sets[y]) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(link, pa.bool_())],
                                                 names=["a", "b", "link"])

    one = texts.select(F.col("class").alias("a"), F.col("packed").alias("left"))
    two = texts.select(F.col("class").alias("b"), F.col("packed").alias("right"))
    return (pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right")
            .mapInArrow(kernel, "a long, b long, link boolean"))


def meeting_on_rare_shingles(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Columns class, other: members with different labels that share one of their rarest shingles.

    Shingles of all sets stand in one order, rare ones first. Two linked sets of n and m shingles share at
    least a = 0.8 / 1.8 (n + m), so the first that they share has a - 1 shared ones behind it: its
    place is at most n - a + 1 in the one, and m - a + 1 in the other. Shingles that one set alone has
    take their places in that order, but need not travel.
    """
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in small(batches):
            texts = pa.array([unpack.decompress(t) for t in batch.column(2).to_pylist()], pa.large_binary())
            for part in slices(texts):
                hashes, counts = shingle_sets(part)
                row = pa.array(part.first + np.repeat(np.arange(part.size), counts))
                yield pa.RecordBatch.from_arrays(
                    [signed(hashes), batch.column(0).take(row), batch.column(1).take(row),
                     pa.array(np.repeat(counts, counts))], names=["key", "class", "label", "n"])

    each = stored(members.join(texts, "class").select("class", "label", "packed")
                  .mapInArrow(kernel, "key long, class long, label long, n long"), "shingles")
    shared = stored(each.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"), "frequencies")
    common = each.join(shared, "key")
    order = Window.partitionBy("class").orderBy("df", "key")
    ranked = common.withColumns({"rank": F.row_number().over(order),
                                 "alone": F.col("n") - F.count("*").over(Window.partitionBy("class"))})
    place = F.col("rank") + F.col("alone")
    rare = stored(ranked.filter(place <= F.col("n") - F.ceil(F.col("n") * PER_CENT / 100) + 1)
                  .select("key", "class", "label", "n", place.alias("place")), "rare")
    other = rare.toDF("key", "other", "theirs", "m", "there")
    least = F.ceil((F.col("n") + F.col("m")) * PER_CENT / (100 + PER_CENT))
    return rare.join(other, (rare["key"] == other["key"]) & (F.col("label") < F.col("theirs"))
                     & (F.col("place") <= F.col("n") - least + 1) & (F.col("there") <= F.col("m") - least + 1)
                     ).select("class", "other")


def with_most_company(groups: DataFrame) -> DataFrame:
    """Columns class, weight: how often each class meets another one in the signature groups (sig, class).

    The text that a family of near copies was made from differs least from all of them, so it
    shares most signatures; it should lead.
    """
    company = groups.groupBy("sig").agg((F.count("*") - 1).alias("others"))
    return groups.join(company, "sig").groupBy("class").agg(F.sum("others").alias("weight"))


def components(docs: DataFrame) -> DataFrame:
    """Columns doc_id, n_shingles, component_id, one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable by links, itself included. Documents
    without words, or with a null text, have an empty set, 0 shingles, and their own id; a row
    without an id links with nothing and has a null component. Repeated rows and ties are
    documents like others. Other columns are ignored.
    """
    base = stored(classes(docs), "classes")
    class_of = F.col("h1").bitwiseAND(F.lit(-2)).alias("class")
    named = base.filter("n > 0 and doc_id is not null")
    by_class = stored(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
                      .select(class_of, "rep", "n"), "reps")
    shingles = base.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = stored(shared_signatures(docs, shingles), "signatures")
    enough = (shared.groupBy("member").agg(F.count("*").alias("have"), F.first("need").alias("need"))
              .filter("have >= need").select("member"))
    groups = stored(shared.join(enough, "member").select("sig", F.col("member").bitwiseAND(F.lit(-2)).alias("class"))
                    .distinct(), "groups")
    alive = groups.select("class").distinct().join(by_class, "class")
    texts = stored(packed_texts(docs, "doc_id").join(alive, F.col("doc_id") == F.col("rep"))
                   .dropDuplicates(["class", "rep"]).select("class", "packed"), "texts")
    sizes = stored(alive.select("class", "n"), "sizes")
    spark = docs.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    labels = spark.createDataFrame([], "class long, label long")
    tested = links
    weights = stored(with_most_company(groups), "weights")
    led = None
    for turn in range(LEADER_ROUNDS + 1):
        if turn:
            groups = groups.drop("label").join(labels, "class", "left")
            groups = stored(groups.withColumn("label", F.coalesce("label", "class")), f"labelled{turn}")
            mixed = groups.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x != y")
            groups = stored(groups.join(stored(mixed.select("sig"), f"mixed{turn}"), "sig"), f"open{turn}")
        else:
            groups = groups.withColumn("label", F.col("class"))
        if turn < LEADER_ROUNDS:
            free = groups if led is None else groups.join(led, ["sig", "class"], "left_anti")
            leader = free.join(weights, "class").groupBy("sig").agg(F.max(F.struct("weight", "class", "label")).alias("l"))
            other = stored(leader.select("sig", F.col("l.class").alias("other"), F.col("l.label").alias("theirs")),
                           f"leaders{turn}")
            mine = other.select("sig", F.col("other").alias("class"))
            led = mine if led is None else led.unionByName(mine)
            # each member meets the leader with which it shares most signatures
            shared_with = groups.join(other, "sig").filter("label != theirs").groupBy("class", "other").agg(F.count("*").alias("n"))
            met = shared_with.groupBy("class").agg(F.max_by("other", F.struct("n", "other")).alias("other"))
        else:  # whatever is still apart in a group meets where rare shingles are shared
            met = meeting_on_rare_shingles(groups.select("class", "label").distinct(), texts)
        pairs = (met.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()
                 .join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
                 .filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PER_CENT).select("a", "b"))
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti") if turn else pairs, f"pairs{turn}")
        if pairs.isEmpty():  # a leader may have met all others before; the last turn looks at every pair
            continue
        judged = stored(verified(pairs, texts), f"judged{turn}")
        tested = tested.unionByName(judged.select("a", "b"))
        new = judged.filter("link").select("a", "b")
        if not new.isEmpty():
            links = links.unionByName(new)
            labels = stars(links).select(F.col("a").alias("class"), F.col("b").alias("label"))
    grouped = by_class.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    smallest = grouped.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = grouped.join(smallest, "label").select("class", F.col("component_id")).distinct()
    return (base.select("doc_id", F.col("n").alias("n_shingles"),
                        F.when(F.col("n") > 0, F.col("h1").bitwiseAND(F.lit(-2))).alias("class"))
            .join(of_class, "class", "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
                    .alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with only the smallest doc_id of each component; rows without an id stay.

    Rows that repeat the smallest id of their component all stay.
    """
    named = components(docs.filter(F.col("doc_id").isNotNull())).filter("doc_id = component_id").select("doc_id")
    keep = named.distinct().unionByName(docs.sparkSession.createDataFrame([(None,)], "doc_id long")).toDF("kept")
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["kept"]), "left_semi")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
