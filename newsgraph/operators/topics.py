"""Tokens, vocabulary, topic models, coherence, dominant topics."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsgraph.functions.plan import once

WORD = r"\p{L}+"
# Words that carry no topic; an argument everywhere, this is the default
STOP_WORDS = (
    "a about after all also an and any are as at be because been but by can could did do does for "
    "from had has have he her his how i if in into is it its just more most new no not of on one only "
    "or other our out over said she so some such than that the their them then there they this to two "
    "up was we were what when where which who will with would you your").split()
# Fixed value: keeps logarithms finite in the coherence measure
EPSILON = 1e-12
#: Cells of documents that are settled together, about: what a topic takes then fits a cache.
BLOCK_CELLS = 16384
#: Cells that a task holds at a time, about; many documents together keep blocks full.
POOL_CELLS = 1 << 20
#: Steps after which blocks are formed anew, and the share of a block's documents that makes it smaller before.
ROUND = 8
COMPACT = 0.7
#: Documents of a task that fits models, about.
TASK_DOCUMENTS = 20_000


def tokens(texts: DataFrame, key: str = "Record_ID", text: str = "text",
           stop_words: Sequence[str] = STOP_WORDS, min_length: int = 3) -> DataFrame:
    """(key, tokens): lower-case words in order, without stop words and short words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    keep = lambda w: (F.length(w) >= min_length) & ~w.isin(list(stop_words))
    return texts.select(key, once(F.filter(words, keep)).alias("tokens"))


def lemmatise(docs: DataFrame, lemmas: DataFrame, key: str = "Record_ID") -> DataFrame:
    """Tokens replaced through a (form, lemma) table; other tokens stay, as do repeated rows.

    A document meets each of its different forms once, and only those with a lemma go
    back to it, as a map. Of several lemmas of one form the smallest counts.
    """
    one = lemmas.groupBy("form").agg(F.min("lemma").alias("lemma"))
    each = docs.select(key, F.explode(F.array_distinct("tokens")).alias("form")).distinct()
    found = each.join(one, "form").groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("form", "lemma"))).alias("_lemmas"))
    swapped = F.transform("tokens", lambda t: F.coalesce(F.try_element_at("_lemmas", t), t))
    return docs.join(found, key, "left").select(
        key, F.when(F.col("_lemmas").isNull(), F.col("tokens")).otherwise(swapped).alias("tokens"))


def vocabulary(docs: DataFrame, min_docs: int = 5, max_share: float = 0.5, max_terms: int = 10_000,
               ) -> DataFrame:
    """(term, docs, index): terms in at least ``min_docs`` documents and at most ``max_share``
    of them; the most frequent ``max_terms``, equal counts in term order."""
    total = docs.agg(F.count(F.lit(1))).scalar()
    counts = (docs.select(F.explode(F.array_distinct("tokens")).alias("term"))
              .groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
              .where((F.col("docs") >= min_docs) & (F.col("docs") <= F.lit(max_share) * total)))
    top = counts.orderBy(F.desc("docs"), "term").limit(max_terms)
    # at most max_terms rows meet in this window
    order = Window.orderBy(F.desc("docs"), "term")
    return top.select("term", "docs", (F.row_number().over(order) - 1).cast("long").alias("index"))


def doc_term_matrix(docs: DataFrame, vocab: DataFrame, key: str = "Record_ID") -> DataFrame:
    """(key, index, n): occurrences of vocabulary terms; Spark chooses the join by size."""
    each = docs.select(key, F.explode("tokens").alias("term"))
    return (each.join(vocab.select("term", "index"), "term")
            .groupBy(key, "index").agg(F.count(F.lit(1)).alias("n")))


def term_vectors(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Adds ``features``: counts of ``terms``, made row by row without a shuffle.

    Documents without any of the terms stay, with an empty vector.
    """
    model = CountVectorizerModel.from_vocabulary(list(terms), inputCol="tokens", outputCol="features")
    return model.transform(docs)


@dataclass(frozen=True)
class TopicModel:
    """Topics as pseudo-counts of terms (k x vocabulary), and the bound after each pass."""

    counts: np.ndarray
    alpha: float
    inner: int
    tolerance: float
    bounds: tuple[float, ...] = ()

    def weights(self) -> np.ndarray:
        return self.counts / self.counts.sum(axis=1, keepdims=True)


def digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: six steps of recurrence, then the asymptotic series."""
    z = x + 6.0
    r = 1.0 / (z * z)
    return (np.log(z) - 0.5 / z - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r / 240)))
            - sum(1.0 / (x + i) for i in range(6)))


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp(digamma(x)), in few passes: the six steps are one fraction, the logarithm is a factor."""
    z = x + 6.0
    r = 1.0 / z
    series = r * r
    series = r * (0.5 + r * (1 / 12 - series * (1 / 120 - series * (1 / 252 - series / 240))))
    y = x * (x + 5.0)
    steps = (x + 2.5) * ((y + 20 / 3) * y + 8.0) / (y * ((y + 10.0) * y + 24.0))
    return z * np.exp(-series - 6.0 * steps)


def log_gamma(x: np.ndarray) -> np.ndarray:
    z = x + 6.0
    r = 1.0 / (z * z)
    return ((z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z
            - sum(np.log(x + i) for i in range(6)))


def _expected_logs(pseudo: np.ndarray) -> np.ndarray:
    return digamma(pseudo) - digamma(pseudo.sum(axis=1, keepdims=True))


def first_counts(k: int, terms: int, seed: int) -> np.ndarray:
    """Uneven pseudo-counts between 0.5 and 1.5 to begin with, the same on every machine."""
    x = (np.arange(terms)[None, :] * k + np.arange(k)[:, None] + 1 + seed) * 1640531527 % (1 << 31)
    for shift, factor in ((15, 1123411259), (13, 1633244958)):
        x = (x ^ (x >> shift)) * factor % (1 << 31)
    return 0.5 + x / (1 << 31)


def _blocks(docs: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """``docs`` by length, shortest first, so many together that their padded cells stay in a processor's cache."""
    docs = docs[np.argsort(lengths[docs], kind="stable")]
    low = 0
    while low < len(docs):
        some = lengths[docs[low:low + max(1, BLOCK_CELLS // int(lengths[docs[low]]))]]
        fit = (some * np.arange(1, len(some) + 1) <= BLOCK_CELLS) & (some <= some[0] + some[0] // 4 + 8)
        high = low + max(1, int(fit.sum()))
        yield docs[low:high]
        low = high


def _settle(lengths: np.ndarray, terms: np.ndarray, n: np.ndarray, topics: np.ndarray, model: TopicModel) -> np.ndarray:
    """Topic pseudo-counts of documents, none empty.

    A document is done when its counts move by less than the tolerance, whatever others do. It then leaves its
    block, and blocks are formed anew after some steps. Expected logs lack the digamma of the counts' sum here:
    it is one factor for all topics of a document, and shares do not change with it.
    """
    k, first = len(topics), np.cumsum(lengths) - lengths
    gammas = np.repeat((model.alpha + np.add.reduceat(n, first) / k)[:, None], k, axis=1)
    todo = np.arange(len(lengths))
    for begin in range(0, model.inner, ROUND):
        left = [_steps(docs, lengths, first, terms, n, topics, model, gammas, min(ROUND, model.inner - begin))
                for docs in _blocks(todo, lengths)]
        todo = np.concatenate(left)
        if not len(todo):
            break
    return gammas


def _steps(docs: np.ndarray, lengths: np.ndarray, first: np.ndarray, terms: np.ndarray, n: np.ndarray,
           topics: np.ndarray, model: TopicModel, gammas: np.ndarray, steps: int) -> np.ndarray:
    """Some steps for one block, written to ``gammas``; returns the documents that are not done."""
    place = np.arange(lengths[docs[-1]])[:, None]
    real = place < lengths[docs]
    at = np.where(real, first[docs] + place, 0)
    counts, own = np.where(real, n[at], 0.0), terms[at]
    cells = np.empty((len(place), len(topics), len(docs)))  # place in the document, topic, document
    for t, row in enumerate(topics):
        cells[:, t] = row[own]
    gamma = gammas[docs].T
    live = np.ones(len(docs), bool)
    for _ in range(steps):
        theta = exp_digamma(gamma)
        norm = np.einsum("lkd,kd->ld", cells, theta)
        np.divide(counts, np.maximum(norm, 1e-300, out=norm), out=norm)
        step = model.alpha + theta * np.einsum("lkd,ld->kd", cells, norm)
        moved = np.abs(step - gamma).sum(axis=0) / len(topics)
        gamma = step if live.all() else np.where(live, step, gamma)
        live &= moved >= model.tolerance
        left = np.count_nonzero(live)
        if not left:
            break
        if left <= COMPACT * len(live):
            gammas[docs] = gamma.T
            docs, counts, gamma, cells, live = docs[live], counts[:, live], gamma[:, live], cells[:, :, live], live[live]
    gammas[docs] = gamma.T
    return docs[live]


def _usage(lengths: np.ndarray, terms: np.ndarray, n: np.ndarray, gamma: np.ndarray, topics: np.ndarray,
           ) -> tuple[np.ndarray, float]:
    """How often each topic uses each term in some documents (topic x term), and the cells' part of the bound."""
    used, bound = np.zeros(topics.shape), 0.0
    theta = np.exp(_expected_logs(gamma)).T
    ends = np.cumsum(lengths)
    low, begin = 0, 0
    while low < len(lengths):
        high = max(low + 1, int(np.searchsorted(ends, begin + BLOCK_CELLS, "right")))
        own, counts = terms[begin:ends[high - 1]], n[begin:ends[high - 1]]
        weights = np.repeat(theta[:, low:high], lengths[low:high], axis=1)
        norm = np.zeros(len(own))
        for weight, row in zip(weights, topics):
            norm += weight * row[own]
        np.maximum(norm, 1e-300, out=norm)
        bound += float((counts * np.log(norm)).sum())
        counts = counts / norm
        for total, weight in zip(used, weights):
            total += np.bincount(own, weight * counts, len(total))
        low, begin = high, int(ends[high - 1])
    return used * topics, bound


def _cells(vectors: DataFrame, *keep: str) -> DataFrame:
    """Sparse vectors as two arrays that Arrow can carry."""
    plain = F.unwrap_udt("features")
    return vectors.select(*keep, plain["indices"].alias("indices"), plain["values"].alias("values"))


def _documents(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, terms and counts of a batch's vectors."""
    indices, values = batch.column(at), batch.column(at + 1)
    return (pc.list_value_length(indices).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
            indices.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
            values.flatten().to_numpy(zero_copy_only=False))


def _pools(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents that are not empty, of as many batches together as have about POOL_CELLS."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        lengths, terms, n = _documents(batch, 0)
        held.append((lengths[lengths > 0], terms, n))
        size += len(terms)
        if size >= POOL_CELLS:
            yield tuple(map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held)))


def _sufficient(models: Sequence[TopicModel]):
    """Per task and model: how often each term is used by each topic, and the documents' part of the bound."""
    topics = [np.exp(_expected_logs(m.counts)) for m in models]
    widest = max(map(len, topics))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, bounds = [np.zeros(t.shape) for t in topics], [0.0] * len(topics)
        for lengths, terms, n in _pools(batches):
            for m, (model, own) in enumerate(zip(models, topics)):
                alpha, k = np.array(model.alpha), len(own)
                gamma = _settle(lengths, terms, n, own, model)
                part, bound = _usage(lengths, terms, n, gamma, own)
                used[m] += part
                bounds[m] += bound + float(
                    ((alpha - gamma) * _expected_logs(gamma)).sum() + (log_gamma(gamma) - log_gamma(alpha)).sum()
                    + (log_gamma(alpha * k) - log_gamma(gamma.sum(axis=1))).sum())
        for m, (own, bound) in enumerate(zip(used, bounds)):
            met = np.flatnonzero(own.any(axis=0))
            columns = [pa.array(np.append(row[met], 0.0 if t else bound)) for t, row in enumerate(own)]
            columns += [pa.nulls(len(met) + 1, pa.float64())] * (widest - len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(met) + 1, m), pa.int32()), pa.array(np.append(met, -1), pa.int32()), *columns],
                names=["model", "index", *[f"s{t}" for t in range(widest)]])

    return kernel


def fit_models(vectors: DataFrame, ks: Sequence[int], iterations: int = 20, seed: int = 42, inner: int = 50,
               tolerance: float = 1e-3) -> list[TopicModel]:
    """Variational LDA for each number of topics, all in the same passes over all documents.

    A pass settles every document against the topics of each model in Arrow batches; tasks give one row per model
    and term they met, which combine to one k x vocabulary table a model, the only thing that leaves Spark (its size
    is bounded by the vocabulary). No table of document-term pairs is shuffled. Priors are 1 / k. Documents
    without terms take part in nothing. Vectors not kept by the caller are kept here.
    """
    keep = vectors.storageLevel == StorageLevel.NONE
    if keep:
        vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        row = vectors.select(F.unwrap_udt("features")["size"]).first()
        size = row[0] if row else 0
        models = [TopicModel(first_counts(k, size, seed), 1.0 / k, inner, tolerance) for k in ks]
        cells = _cells(vectors)
        names = [f"s{t}" for t in range(max(ks))] if ks else []
        schema = ", ".join(["model int, index int", *[f"{c} double" for c in names]])
        for _ in range(iterations if size and models else 0):
            found = (cells.mapInArrow(_sufficient(models), schema).groupBy("model", "index")
                     .agg(*[F.sum(c).alias(c) for c in names]).toPandas())
            models = [_next(model, found[found["model"] == m]) for m, model in enumerate(models)]
        return models
    finally:
        if keep:
            vectors.unpersist()


def _next(model: TopicModel, found) -> TopicModel:
    """The model after a pass, from what all documents gave."""
    k, size = model.counts.shape
    sums = found[found["index"] >= 0]
    counts = np.full((k, size), model.alpha)
    counts[:, sums["index"].to_numpy()] += sums[[f"s{t}" for t in range(k)]].to_numpy().T
    logs, p = _expected_logs(model.counts), np.array(model.alpha)
    own = (((p - model.counts) * logs).sum() + (log_gamma(model.counts) - log_gamma(p)).sum()
           + (log_gamma(p * size) - log_gamma(model.counts.sum(axis=1))).sum())
    bound = float(found.loc[found["index"] < 0, "s0"].sum() + own)
    return TopicModel(counts, model.alpha, model.inner, model.tolerance, (*model.bounds, bound))


def fit_lda(vectors: DataFrame, k: int, iterations: int = 20, seed: int = 42, inner: int = 50,
            tolerance: float = 1e-3) -> TopicModel:
    """The model of ``fit_models`` for one number of topics."""
    return fit_models(vectors, [k], iterations, seed, inner, tolerance)[0]


def topic_top_terms(model: TopicModel, terms: Sequence[str], top: int = 10) -> DataFrame:
    """(topic, rank, term, weight); k x top rows. Weights equal to nine decimals stand in term order."""
    rows = []
    for topic, weights in enumerate(model.weights()):
        best = sorted(zip((-weights).round(9).tolist(), terms, weights.tolist()))[:top]
        rows += [(topic, rank, term, weight) for rank, (_, term, weight) in enumerate(best, 1)]
    return SparkSession.active().createDataFrame(rows, "topic int, rank int, term string, weight double")


def dominant_topic(model: TopicModel, vectors: DataFrame, key: str = "Record_ID") -> DataFrame:
    """(key, Topic_Label, share, total): the largest topic of each document, first one on ties.

    A document without any vocabulary term stays, with a null label and share and a total of 0.
    """
    topics = np.exp(_expected_logs(model.counts))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, n = _documents(batch, 1)
            some = lengths > 0
            shares = np.zeros((len(batch), len(topics)))
            if some.any():
                gamma = _settle(lengths[some], terms, n, topics, model)
                shares[some] = gamma / gamma.sum(axis=1, keepdims=True)
            best = shares.round(9).argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f"Topic {t}" for t in best], pa.string(), mask=~some),
                 pa.array(shares[np.arange(len(best)), best], mask=~some), pa.array(shares.sum(axis=1))],
                names=[key, "Topic_Label", "share", "total"])

    kind = vectors.schema[key].dataType.simpleString()
    return _cells(vectors, key).mapInArrow(kernel, f"`{key}` {kind}, Topic_Label string, share double, total double")


# ---- coherence -------------------------------------------------------------

def _group_windows(groups: dict[str, list[str]], window: int):
    """Per task: windows of each group, over documents that each stand in one row."""
    words = sorted({t for terms in groups.values() for t in terms})
    number = {t: i for i, t in enumerate(words)}
    member = np.zeros((len(groups), len(words)), bool)
    for row, terms in zip(member, groups.values()):
        row[[number[t] for t in terms]] = True

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(groups), np.int64)
        known = pa.array(words, pa.string())
        for batch in batches:
            tokens = batch.column(0)
            lengths = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            term = pc.index_in(tokens.flatten(), known)
            hit = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
            term = term.drop_null().to_numpy()
            doc = np.repeat(np.arange(len(lengths)), lengths)[hit]
            p = hit - (np.cumsum(lengths) - lengths)[doc]
            last = np.maximum(lengths - window, 0)[doc]
            low, high = np.maximum(p - window + 1, 0), np.minimum(p, last)
            for g, terms in enumerate(member):
                own = np.flatnonzero(terms[term])
                if not len(own):
                    continue
                begin, end, same = low[own], high[own], doc[own]
                # what the occurrence before has covered, in the same document
                np.maximum(begin[1:], end[:-1] + 1, out=begin[1:], where=same[1:] == same[:-1])
                found[g] += np.maximum(end - begin + 1, 0).sum()
        met = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(groups), pa.string()).take(pa.array(met)), pa.array(found[met])],
                                         names=["group", "added"])

    return kernel


def window_counts(docs: DataFrame, groups: DataFrame, window: int = 110, key: str = "Record_ID",
                  ) -> DataFrame:
    """(group, windows): sliding windows that hold any term of the group.

    ``groups`` is a small (group, term) table. An occurrence at position p lies
    in the windows that start at p - window + 1 ... p; a group's windows are the
    union of these runs. It follows from each occurrence and the one before, so
    no window is ever written out. A document shorter than the window is one window.
    Documents are counted where they lie, and tasks give a row per group; only rows that
    share a key, which count as one document, are brought together.
    """
    terms: dict[str, list[str]] = {}
    for r in groups.select("group", "term").collect():
        terms.setdefault(r["group"], []).append(r["term"])
    repeated = (docs.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
                .where("_rows > 1").select("_key").persist(StorageLevel.MEMORY_AND_DISK))
    alone, several = docs, None
    if not repeated.count():
        repeated.unpersist()
    else:
        same = F.col(key).eqNullSafe(F.col("_key"))
        alone, several = docs.join(repeated, same, "left_anti"), docs.join(repeated, same, "left_semi")
    added = alone.select("tokens").mapInArrow(_group_windows(terms, window), "group string, added long")
    if several is not None:
        added = added.unionByName(_shared_windows(several, groups, window, key))
    return added.groupBy("group").agg(F.sum("added").cast("long").alias("windows"))


def _shared_windows(docs: DataFrame, groups: DataFrame, window: int, key: str) -> DataFrame:
    """(group, added): windows that each occurrence adds, where rows may share a key."""
    last = F.greatest(F.size("tokens") - window, F.lit(0))
    hits = (docs.select(key, last.alias("last"), F.posexplode("tokens").alias("p", "term"))
            .join(F.broadcast(groups.select("group", "term")), "term"))
    previous = F.lag("p").over(Window.partitionBy(key, "group").orderBy("p"))
    begin = F.greatest(F.least(F.coalesce(previous, F.lit(-1)), F.col("last")) + 1,
                       F.col("p") - window + 1, F.lit(0))
    added = F.greatest(F.least(F.col("p"), F.col("last")) - begin + 1, F.lit(0))
    return hits.select("group", added.cast("long").alias("added"))


def total_windows(docs: DataFrame, window: int = 110) -> int:
    n = F.when(F.size("tokens") > 0, F.greatest(F.size("tokens") - window, F.lit(0)) + 1).otherwise(0)
    return docs.agg(F.sum(n.cast("long"))).first()[0] or 0


def coherence_cv(docs: DataFrame, topics: dict[int, Sequence[str]], window: int = 110,
                 key: str = "Record_ID") -> DataFrame:
    """(topic, coherence): the c_v measure of each topic's top terms.

    Normalised pointwise mutual information over sliding windows gives each term
    a vector against all terms of its topic; a topic scores the mean cosine
    between its terms' vectors and their sum. Only group counts, a number set by
    topics and terms, reach the driver.
    """
    spark = docs.sparkSession
    names: dict[tuple[str, ...], str] = {}
    for terms in topics.values():
        for i, a in enumerate(terms):
            names[(a,)] = a
            for b in terms[i + 1:]:
                names[tuple(sorted((a, b)))] = " ".join(sorted((a, b)))
    groups = spark.createDataFrame(
        [(name, t) for pair, name in names.items() for t in pair], "group string, term string")
    counts = {r["group"]: r["windows"] for r in window_counts(docs, groups, window, key).collect()}
    total = total_windows(docs, window)
    rows = [(topic, _cv(list(terms), counts, total)) for topic, terms in topics.items()]
    return spark.createDataFrame(rows, "topic int, coherence double")


def _cv(terms: list[str], counts: dict[str, int], total: int) -> float:
    if not terms or not total:
        return math.nan
    n = len(terms)
    single = [counts.get(t, 0) for t in terms]
    m = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            if i == j:
                both = single[i]
            else:
                either = counts.get(" ".join(sorted((terms[i], terms[j]))), 0)
                both = single[i] + single[j] - either
            if single[i] and single[j]:
                p = both / total
                m[i, j] = (math.log((p + EPSILON) / (single[i] / total * single[j] / total))
                           / -math.log(p + EPSILON)) if p < 1 else 1.0
    whole = m.sum(axis=0)
    norms = np.linalg.norm(m, axis=1) * np.linalg.norm(whole)
    return float(np.mean(np.divide(m @ whole, norms, out=np.zeros(n), where=norms > 0)))


def best_k(scores: Iterable[tuple[int, float]]) -> int:
    """The k of the best mean coherence, to nine decimals; the smaller k on ties."""
    return max(scores, key=lambda s: (-math.inf if s[1] is None or math.isnan(s[1]) else round(s[1], 9), -s[0]))[0]


def select_k(docs: DataFrame, terms: Sequence[str], ks: Iterable[int], top: int = 10,
             iterations: int = 20, seed: int = 42, window: int = 110, key: str = "Record_ID"):
    """Fits one model per k and scores it; returns (table of k and coherence, best model).

    The best mean coherence wins, the smaller k on ties. All fits share their passes over vectors that
    are kept, dealt out evenly; all topics are scored in one pass over the tokens.
    """
    ks = sorted(ks)
    different = sorted(set(ks))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // TASK_DOCUMENTS))
    vectors = (term_vectors(docs, terms).select(key, "features").repartition(tasks)
               .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        models = dict(zip(different, fit_models(vectors, different, iterations, seed)))
    finally:
        vectors.unpersist()
    tops: dict[tuple[int, int], list[str]] = {}
    for k in different:
        for r in topic_top_terms(models[k], terms, top).orderBy("topic", "rank").collect():
            tops.setdefault((k, r["topic"]), []).append(r["term"])
    found = coherence_cv(docs, dict(enumerate(tops.values())), window, key)
    values = {r["topic"]: r["coherence"] for r in found.collect()}
    scores = []
    for k in ks:
        own = [values[i] for i, (of, _) in enumerate(tops) if of == k]
        scores.append((k, sum(own) / len(own) if own else None))
    best = best_k(scores)
    table = docs.sparkSession.createDataFrame(
        [(k, c, k == best) for k, c in scores], "k int, coherence double, chosen boolean")
    return table, models[best]
