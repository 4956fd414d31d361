"""Benchmark decontamination by latent semantic retrieval.

1. Words of all documents are hashed to ``TERMS`` term numbers once and kept as packed arrays.
2. Document frequencies over all documents give the inverse document frequencies.
3. A distributed randomised SVD of the TF-IDF matrix of the passages gives a latent basis: every task multiplies its passages
   with a random matrix and back (A^T A G), the parts are added up, and the small factor is decomposed on the driver. All
   passages of all documents take part in this fit, and every window of every document is searched.
4. Windows of all documents that hold enough of an item's rarest words (a leak can't do without) and the item are projected on the
   basis; windows near their item by cosine are candidates.
5. A candidate is a leak if the longest common subsequence of words covers enough of the item and its answer, the item's
   last words, stands in the window as well. This catches copies and paraphrases that keep most words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearwell.llm.blocks import SMALL_BLOCK, hash_strings, in_levels, split_words, stored, text_blocks

#: Term numbers that words are hashed to; also the height of the random matrix.
TERMS = 1 << 14
#: Latent dimensions, and further random directions that are cut off after the decomposition.
RANK, EXTRA = 40, 8
#: Words of a passage for the decomposition, and the step between windows.
PASSAGE, STEP = 64, 4
#: Least cosine of a candidate window, where an item's words do not ask for a lower one, least share of an item's words in the common subsequence, words of an answer and
#: least share of them that the window must hold in order.
COSINE, COVERED, ANSWER_WORDS, ANSWER_COVERED = 0.65, 0.75, 5, 0.6
#: Standard deviations that the cosine of a leak may fall short of what its words in common let expect.
SPREAD = 3.0
#: Log-frequency that is taken off a term's weight: terms in more than a fifth of the documents are left with ``LEAST_WEIGHT``.
COMMON, LEAST_WEIGHT = 1.5, 0.05
#: Items that are sent to the tasks at once: RANK * 4 bytes and their words each.
ITEM_BLOCK = 20_000
#: Packed terms that a task unfolds at once: some 130,000 words, each a row of floats.
TERM_BYTES = 1 << 18
#: Places of an item's rarest words that a window is asked for, where the item is long enough.
RARE_PLACES = 4
#: Items with fewer words are too short to say anything.
LEAST_WORDS = 5


def _strip(texts: pa.StringArray) -> pa.StringArray:
    """Punctuation is blank, so that it parts words and never belongs to one; ASCII bytes never stand inside other characters."""
    if not len(texts):
        return texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(_BLANKED[data]))


_BLANKED = np.arange(256, dtype=np.uint8)
_BLANKED[[i for i in range(33, 127) if not chr(i).isalnum()]] = 32


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code of each word of all texts, the hash of each code, and where each text's words begin."""
    words, at = split_words(_strip(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))))
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), hash_strings(coded.dictionary), at


def _terms_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 14)).astype(np.int64)


def term_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of all words and where each text's words begin."""
    codes, hashes, at = word_codes(texts)
    return _terms_of(hashes).astype(np.uint16)[codes], at


def packed_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, terms: two bytes a word)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, limit=SMALL_BLOCK):
            terms, at = term_numbers(batch.column("text"))
            packed = [terms[s:e].tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.record_batch([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "terms"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, terms binary"), "terms")


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("terms")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    at = np.concatenate([[0], np.cumsum(sizes)])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), dtype=np.uint16).astype(np.int64), at


def _summed(parts: DataFrame) -> np.ndarray:
    """The sum of all tasks' vectors (rows: number of the slice, bytes), added slice by slice and level by level: no task adds up
    more than about ``FAN_IN`` parts."""
    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in rows.column("part"))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "part"])

    rows = in_levels(parts, ["slice"], add, "slice int, part binary").collect()
    return np.concatenate([np.frombuffer(r.part) for r in sorted(rows)]) if rows else np.zeros(0)


def _sliced(x: np.ndarray, slices: int = 16) -> pa.RecordBatch:
    return pa.record_batch([pa.array(range(slices), pa.int32()), pa.array([p.tobytes() for p in np.array_split(x, slices)], pa.binary())], names=["slice", "part"])


def inverse_frequencies(terms: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + documents with the term)) - COMMON, LEAST_WEIGHT at least, over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(TERMS + 1)
        for batch in text_blocks(batches, "terms", TERM_BYTES):
            x, at = _unpacked(batch)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(at))
            # a term's first place in a document, found without sorting: the last write of a reversed pass is the first place
            seen = np.zeros((min(256, batch.num_rows), TERMS), dtype=bool)
            for low in range(0, batch.num_rows, 256):
                part = slice(at[low], at[min(low + 256, batch.num_rows)])
                seen[:] = False
                seen[doc[part] - low, x[part]] = True
                held[:TERMS] += seen.sum(axis=0)
            held[TERMS] += batch.num_rows
        yield _sliced(held)

    held = _summed(terms.select("terms").mapInArrow(run, "slice int, part binary"))
    if not len(held):
        return np.ones(TERMS)
    return np.maximum(np.log((1 + held[TERMS]) / (1 + held[:TERMS])) - COMMON, LEAST_WEIGHT)


def latent_basis(terms: DataFrame, idf: np.ndarray, rank: int = RANK, extra: int = EXTRA) -> np.ndarray:
    """TERMS x rank: IDF times the leading right singular vectors of all passages' TF-IDF matrix A, each over its singular value.

    One pass over the corpus forms Z = A^T (A G) for a random G. Q is an orthonormal basis of Z, and the small matrix
    T = (Q^T Z)(Q^T G)^+ stands for Q^T A^T A Q; its eigenvectors turn Q to singular vectors.
    """
    random = (np.random.default_rng(11).standard_normal((TERMS, rank + extra))).astype(np.float32)
    weighted = terms.sparkSession.sparkContext.broadcast((random * idf[:, None]).astype(np.float32))
    scale = terms.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = weighted.value
        z = np.zeros((TERMS, g.shape[1]))
        for batch in text_blocks(batches, "terms", TERM_BYTES):
            x, at = _unpacked(batch)
            if not len(x):
                continue
            # passages of PASSAGE words, begun anew in each document
            own = np.arange(len(x)) - np.repeat(at[:-1], np.diff(at))
            starts = np.flatnonzero(own % PASSAGE == 0)
            y = np.add.reduceat(g[x], starts, axis=0)
            norm = np.sqrt(np.add.reduceat((scale.value**2)[x], starts))
            y /= np.maximum(norm, 1e-9)[:, None] ** 2
            which = np.cumsum(own % PASSAGE == 0) - 1
            # the places of each term in a row, so that one pass adds up all columns
            order = np.argsort(x.astype(np.uint16), kind="stable")
            first = np.flatnonzero(np.diff(x[order], prepend=-1))
            z[x[order[first]]] += np.add.reduceat(y[which[order]], first, axis=0)
        yield _sliced((z * scale.value[:, None]).ravel())

    z = _summed(terms.select("terms").mapInArrow(run, "slice int, part binary"))
    if not len(z) or not np.any(z):
        return (random[:, :rank] * idf[:, None]).astype(np.float32)
    z = z.reshape(TERMS, -1)
    q, _ = np.linalg.qr(z)
    t = (q.T @ z) @ np.linalg.pinv(q.T @ random)
    values, vectors = np.linalg.eigh((t + t.T) / 2)
    top = np.argsort(-values)[:rank]
    singular = np.sqrt(np.maximum(values[top], 1e-4 * max(values[top[0]], 1e-9)))
    return ((q @ vectors[:, top]) * idf[:, None] / singular).astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row at a time as bits of one integer."""
    places: dict[int, int] = {}
    for i, t in enumerate(b.tolist()):
        places[t] = places.get(t, 0) | (1 << i)
    full = (1 << len(b)) - 1
    v = full
    for t in a.tolist():
        m = v & places.get(t, 0)
        v = ((v + m) | (v - m)) & full
    return len(b) - v.bit_count()


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def window_of(words: int, cosine: float = COSINE, covered: float = COVERED) -> tuple[int, float]:
    """Length of the windows in which an item of ``words`` words is looked for, about its own, and their least cosine.

    ``m`` of the item's words are left in the best window on a copy that begins anywhere and lacks as many words as it may.
    If words were unit vectors at random, the cosine would be m / sqrt(item * window) on average; it may fall short of that by
    ``SPREAD`` standard deviations, from the random directions and from the weights of the words that are missing.
    """
    def expected(n: int) -> float:
        held = min(max(min(r + words, s + n) - max(r, s) for s in (0, STEP)) for r in range(STEP))
        return (int(np.ceil(covered * words)) - (words - held)) / np.sqrt(words * n)

    own = STEP * max(1, words // STEP)
    n = max(range(own, own + 3 * STEP, STEP), key=expected)
    e = max(0.0, expected(n))
    return n, min(cosine, e - SPREAD * float(np.sqrt((1 - e * e) / RANK + covered * (1 - covered) / words)))


def needed(words: int, covered: float) -> int:
    """How many places of a window must hold rare words of an item of ``words`` words."""
    return min(RARE_PLACES, int(np.ceil(covered * words)))


def rare_words(words: list[np.ndarray], idf: np.ndarray, covered: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (word, number of the item): of each item the words with the rarest terms, just so many that a leak holds ``needed`` of
    their places.

    A leak may miss ``w - ceil(covered * w)`` of an item's ``w`` words, so of words that stand in so many places more, these are there.
    """
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, w in enumerate(words):
        distinct, times = np.unique(w, return_counts=True)
        order = np.argsort(-idf[_terms_of(distinct)], kind="stable")
        may_miss = len(w) - int(np.ceil(covered * len(w)))
        n = int(np.searchsorted(np.cumsum(times[order]), may_miss + needed(len(w), covered))) + 1
        keys.append(distinct[order[:n]])
        owners.append(np.full(len(keys[-1]), i))
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((owner, key))
    return key[order], owner[order]


def _runs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start, start + 1, ... of each run, and the number of the run."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes), run


def _finder(basis, items, covered: float, answer_covered: float):
    """Leaks (doc_id, item_id, start, cosine, covered) in batches of texts.

    Only windows that hold several of an item's rare words can cover it, so such words that stand together ask for the windows around
    them and no window meets all items. Words are compared by their 64-bit hashes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = basis.value
        ids, words, answers, windows, bounds, rare, owner = items.value
        windows, bounds, lists = np.array(windows, dtype=np.int64), np.array(bounds), [w.tolist() for w in words]
        targets = _unit(np.array([b[_terms_of(w)].sum(axis=0) for w in words]).reshape(-1, b.shape[1]))
        # steps around a window that the rest of the item may take
        around = np.array([1 + max(0, -(-(len(w) - n) // STEP)) for w, n in zip(words, windows.tolist())], dtype=np.int64)
        least = np.array([needed(len(w), covered) for w in words], dtype=np.int64)
        for batch in text_blocks(batches, limit=SMALL_BLOCK):
            best: dict[tuple[int, int], tuple[float, float, int]] = {}
            coded, hashes, at = word_codes(batch.column("text"))
            low, high = (np.searchsorted(rare, hashes, side=s) for s in ("left", "right"))
            place = np.flatnonzero((high > low)[coded])
            if len(place):
                size, x = np.diff(at), hashes[coded]
                entry, hit = _runs(low[coded[place]], (high - low)[coded[place]])
                item, place = owner[entry], place[hit]
                doc = np.searchsorted(at, place, side="right") - 1
                # as many rare words of an item as are needed, no further apart than a window and its surroundings reach
                order = np.lexsort((place, item, doc))
                item, place, doc = item[order], place[order], doc[order]
                last = np.arange(len(item)) + least[item] - 1
                end = np.minimum(last, len(item) - 1)
                full = (last == end) & (item[end] == item) & (doc[end] == doc) & (place[end] - place < windows[item] + 2 * around[item] * STEP)
                near = np.zeros(len(item), dtype=bool)
                for t in range(RARE_PLACES):
                    near[np.flatnonzero(full & (t < least[item])) + t] = True
                item, place, doc = item[near], place[near], doc[near]
            if len(place):
                # windows begin at each STEP words of a document; those whose surroundings hold the place
                n, slack, own = windows[item], around[item] * STEP, place - at[doc]
                last = (size[doc] - 1) // STEP
                begin = np.clip(-(-(own - n - slack + 1) // STEP), 0, last)
                end = np.clip((own + slack) // STEP, 0, last)
                step, k = _runs(begin, end - begin + 1)
                item, doc = item[k], doc[k]
                _, one = np.unique((doc * len(words) + item) * (last.max() + 1) + step, return_index=True)
                step, item, doc = step[one], item[one], doc[one]
                # sums of the steps before each step, for the documents that are asked for
                asked, doc_at = np.unique(doc, return_inverse=True)
                spots, _ = _runs(at[asked], size[asked])
                steps_of = -(-size[asked] // STEP)
                inner = np.concatenate([[0], np.cumsum(steps_of)])
                of_step, run_of = _runs(np.zeros(len(asked), np.int64), steps_of)
                starts = of_step * STEP + (np.cumsum(size[asked]) - size[asked])[run_of]
                sums = np.vstack([np.zeros((1, b.shape[1])), np.cumsum(np.add.reduceat(b[_terms_of(x[spots])], starts, axis=0), axis=0, dtype=np.float64)])
                start = inner[doc_at] + step
                window = sums[np.minimum(start + windows[item] // STEP, inner[doc_at + 1])] - sums[start]
                cos = np.einsum("ij,ij->i", window, targets[item]) / (np.sqrt(np.einsum("ij,ij->i", window, window)) + 1e-9)
                keep = np.flatnonzero(cos >= bounds[item])
                for j in keep[np.argsort(-cos[keep], kind="stable")].tolist():
                    d, i, c, at_word = int(doc[j]), int(item[j]), float(cos[j]), int(step[j]) * STEP
                    room = int(around[i]) * STEP
                    held = x[at[d] + max(0, at_word - room) : min(at[d + 1], at[d] + at_word + int(windows[i]) + room)]
                    there, known = sum(map(set(held.tolist()).__contains__, lists[i])) / len(lists[i]), best.get((d, i))
                    if there < covered or (known and (there, c) < known[:2]):  # cannot cover it, or become the best
                        continue
                    share = common_subsequence(words[i], held) / len(words[i])
                    if share >= covered and common_subsequence(answers[i], held) >= answer_covered * len(answers[i]):
                        best[d, i] = max(best.get((d, i), (0.0, 0.0, 0)), (share, c, -at_word))
            found = [(d, ids[i], -at_word, c, share) for (d, i), (share, c, at_word) in best.items()]
            docs = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.record_batch(
                [docs, *(pa.array([f[k] for f in found], t) for k, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.float64()), (4, pa.float64())))],
                names=["doc_id", "item_id", "start", "cosine", "covered"])

    return run


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, covered: float = COVERED,
    answer_words: int = ANSWER_WORDS, answer_covered: float = ANSWER_COVERED, least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Leaks of ``benchmark`` (item_id, text, ...) in ``docs`` (doc_id, text, ...): (doc_id, item_id, start, cosine, covered).

    One row for each document and item, the best window's; ``start`` is in words, ``covered`` the share of the item's words in
    the common subsequence. Words are what stands between white space and punctuation, in lower case. Items of
    fewer than ``least_words`` words, null texts and rows without an id are never matched. Repeated rows are one in
    the result; other columns are ignored; empty tables give no leaks. Jobs run when this is called. Items are sent to the tasks
    in blocks of ``ITEM_BLOCK``, each with one pass over the texts; windows of equal cover and cosine tie to the earlier one.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms = packed_terms(docs)
    idf = inverse_frequencies(terms)
    basis = spark.sparkContext.broadcast(latent_basis(terms, idf))
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    rows = stored(rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-rows.count() // ITEM_BLOCK)))).cast("int")), "items")
    found = None
    for (block,) in sorted(rows.select("block").distinct().collect()):
        own = rows.where(F.col("block") == block).orderBy("item_id", "text").collect()
        codes, hashes, at = word_codes(pa.array([r.text for r in own], pa.string()))
        words = [hashes[codes[s:e]] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
        kept = [i for i, w in enumerate(words) if len(w) >= least_words]
        windows = [window_of(len(words[i]), cosine, covered) for i in kept]
        items = spark.sparkContext.broadcast((
            [own[i].item_id for i in kept], [words[i] for i in kept], [words[i][-answer_words:] for i in kept], [n for n, _ in windows], [c for _, c in windows],
            *rare_words([words[i] for i in kept], idf, covered)))
        part = texts.where("doc_id is not null").mapInArrow(
            _finder(basis, items, covered, answer_covered), "doc_id long, item_id long, start long, cosine double, covered double")
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, start long, cosine double, covered double")
    best = F.max(F.struct("covered", "cosine", (-F.col("start")).alias("s")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", (-F.col("b.s")).alias("start"), F.col("b.cosine").alias("cosine"), F.col("b.covered").alias("covered"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a leak; documents without a doc_id stay."""
    leaks = find_leaks(docs, benchmark).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(leaks, docs["doc_id"].cast("long") == leaks["_leak"], "left_anti")
