"""Language identification of whole and of mixed texts.

Words are runs of letters and marks. A word's scripts narrow its candidate languages; each candidate's score is the mean
log probability of the word's character n-grams (naive Bayes, learned here); Viterbi with a switching penalty then labels
every word, so a text falls into spans of one language each. The text's language is the one that most letters carry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearwell.llm.blocks import hash_strings, in_levels, mixed, text_blocks

#: Hash bins of character n-grams for each language.
BINS = 1 << 16
#: Lengths of character n-grams, over words with a mark at either end; the whole word is a feature as well.
SIZES = (1, 2, 3, 4)
#: Log-odds that a switch of language costs, in units of a word's mean n-gram score.
SWITCH = 3.0
#: A language stays a candidate for a script that at least this share of its learned letters is written in.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
#: Distinct words whose n-grams a task holds at once, and bytes of text whose words are coded together.
WORD_BLOCK, TEXT_BYTES = 32_768, 8 << 20

# First code points of blocks and the scripts that they hold (0 is any other).
SCRIPT_STARTS = (0x0, 0x41, 0x5B, 0x61, 0x7B, 0xC0, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x900, 0x980, 0xA00, 0xB80,
                 0xC00, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00,
                 0xD7B0, 0xF900, 0xFB00, 0x20000, 0x30000)
SCRIPT_NAMES = ("other", "latin", "other", "latin", "other", "latin", "other", "greek", "cyrillic", "armenian", "hebrew", "arabic",
                "other", "devanagari", "bengali", "other", "tamil", "other", "thai", "other", "georgian", "hangul", "other",
                "latin", "greek", "other", "hiragana", "katakana", "other", "han", "other", "hangul", "other", "han", "other",
                "han", "other")
SCRIPTS = tuple(dict.fromkeys(SCRIPT_NAMES))
_SCRIPT_OF = np.array([SCRIPTS.index(n) for n in SCRIPT_NAMES])


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased runs of letters of all texts, and where each text's begin."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), r"[^\p{L}\p{M}]+")
    words = lists.flatten()
    kept = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    at = np.frombuffer(lists.buffers()[1], dtype=np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    before = np.concatenate([[0], np.cumsum(kept)])
    return words.filter(pa.array(kept)).dictionary_encode(), before[at - at[0]]


def _points(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between two marks, and where each word begins."""
    text = "".join(f"\x02{w}\x03" for w in words.to_pylist())
    at = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2)])
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), at


def _features(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bin) of every n-gram of distinct words."""
    points, at = _points(words)
    word = np.repeat(np.arange(len(words)), np.diff(at))
    ends = at[1:][word]
    rows, bins = [np.arange(len(words))], [mixed(hash_strings(words))]
    for n in SIZES:
        rolled = np.zeros(max(0, len(points) - n + 1), dtype=np.uint64)
        for i in range(n):
            rolled = mixed(rolled ^ (points[i : i + len(rolled)].astype(np.uint64) + np.uint64((n << 40) + (i << 32))))
        inside = np.arange(len(rolled)) + n <= ends[: len(rolled)]
        if n == 1:
            inside &= points[: len(rolled)] > 3
        rows.append(word[: len(rolled)][inside])
        bins.append(rolled[inside])
    return np.concatenate(rows), (np.concatenate(bins) % np.uint64(BINS)).astype(np.int64)


def _scripts(words: pa.StringArray) -> np.ndarray:
    """Letters of each word in each script."""
    points, at = _points(words)
    kind = _SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, points, side="right") - 1]
    out = np.zeros((len(words), len(SCRIPTS)))
    inner = points > 3
    np.add.at(out, (np.repeat(np.arange(len(words)), np.diff(at))[inner], kind[inner]), 1)
    return out


class Model:
    """Log probabilities of bins by language, and the languages that each script allows."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        self.languages = languages
        smooth = counts + 0.5
        self.log = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32).copy() if languages else np.zeros((BINS, 0), np.float32)
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.allowed = (share >= SCRIPT_SHARE).T  # script, language

    def word_scores(self, words: pa.StringArray) -> np.ndarray:
        """Mean log probability of each word's n-grams by language; far below all others where no script of it allows one."""
        out = np.zeros((len(words), len(self.languages)))
        for low in range(0, len(words), WORD_BLOCK):
            part = words.slice(low, WORD_BLOCK)
            rows, bins = _features(part)
            n = np.maximum(1, np.bincount(rows, minlength=len(part)))
            for k in range(len(self.languages)):
                out[low : low + len(part), k] = np.bincount(rows, weights=self.log[bins, k], minlength=len(part)) / n
            # words in a script that nobody has learned stay open to all
            main = self.allowed[_scripts(part).argmax(axis=1)]
            out[low : low + len(part)] -= 50.0 * ~(main | ~main.any(axis=1, keepdims=True))
        return out


def label_words(scores: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Viterbi over the words of all texts of a block side by side: one step takes the i-th word of every text that has one."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    starts, size = at[:-1][order], size[order]
    langs = scores.shape[1]
    come_from = np.zeros((len(scores), langs), dtype=np.int16)
    best = np.zeros((len(order), langs))
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    for i, n in enumerate(active.tolist()):
        rows = starts[:n] + i
        if i:
            top = best[:n].argmax(axis=1)
            jump = best[np.arange(n), top][:, None] - switch
            stay = best[:n] >= jump
            come_from[rows] = np.where(stay, np.arange(langs), top[:, None])
            best[:n] = np.where(stay, best[:n], jump)
        best[:n] += scores[rows]
    labels = np.zeros(len(scores), dtype=np.int16)
    state = best.argmax(axis=1) if langs else np.zeros(len(order), dtype=np.int64)
    for i in range(len(active) - 1, -1, -1):
        n = active[i]
        rows = starts[:n] + i
        labels[rows] = state[:n]
        if i:
            state[:n] = come_from[rows, state[:n]]
    return labels


def fit(labelled: DataFrame) -> Model:
    """Learn from ``labelled`` (text, lang), all rows of it; rows without a lang or text teach nothing.

    Tasks count n-grams by language and hand on one packed row of counts for each language; one row of each language, of
    ``BINS`` numbers, reaches the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in text_blocks(batches, limit=TEXT_BYTES):
            coded, at = _words(batch.column("text"))
            if not len(coded):
                continue
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            index = coded.indices.to_numpy(zero_copy_only=False)
            times = {lang: np.bincount(index[np.repeat(langs == lang, np.diff(at))], minlength=len(coded.dictionary)).astype(np.float64)
                     for lang in sorted(set(langs))}
            for low in range(0, len(coded.dictionary), WORD_BLOCK):
                part = coded.dictionary.slice(low, WORD_BLOCK)
                rows, bins = _features(part)
                scripts = _scripts(part)
                for lang, all_times in times.items():
                    own = all_times[low : low + len(part)]
                    new = np.concatenate([np.bincount(bins, weights=own[rows], minlength=BINS), own @ scripts])
                    held[lang] = held[lang] + new if lang in held else new
        yield pa.record_batch([pa.array(list(held), pa.string()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["lang", "counts"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in rows.column("counts"))
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([total.tobytes()], pa.binary())], names=["lang", "counts"])

    parts = labelled.where("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    packed = parts.mapInArrow(count, "lang string, counts binary")
    # level by level, so that no task adds up all tasks' rows of one language
    rows = sorted(in_levels(packed, ["lang"], add, "lang string, counts binary").collect())
    counts = np.array([np.frombuffer(r.counts) for r in rows]).reshape(len(rows), BINS + len(SCRIPTS))
    return Model([r.lang for r in rows], counts[:, :BINS], counts[:, BINS:])


def _letters_by(texts: pa.Array, model: Model, switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels of all words, the text that each is in, where each text's words begin, and letters by text and language."""
    coded, at = _words(texts)
    n, langs = len(texts), max(1, len(model.languages))
    text = np.repeat(np.arange(n), np.diff(at))
    index = coded.indices.to_numpy(zero_copy_only=False)
    if not len(index) or not model.languages:
        return np.zeros(len(index), np.int16), text, at, np.zeros((n, langs))
    labels = label_words(model.word_scores(coded.dictionary)[index], at, switch)
    has_letter = pc.match_substring_regex(coded.dictionary, r"\p{L}").to_numpy(zero_copy_only=False)
    letters = (pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False) * has_letter)[index].astype(np.float64)
    return labels, text, at, np.bincount(text * langs + labels, weights=letters, minlength=n * langs).reshape(-1, langs)


def identify(df: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """``df`` (doc_id, text, ...) to (doc_id, lang_pred, score, spans), a row for each row; only the text is looked at.

    ``spans`` are (start, end, lang) in words from 0, end exclusive. ``score`` is the share of the text's letters in spans
    of ``lang_pred``. A text that is null or has no letter, and any text where nothing was learned, is ``und`` with 0 and
    no spans. Ties go to the language first by name. Repeated rows give repeated rows; other columns are ignored.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = model.languages
        for batch in text_blocks(batches, limit=TEXT_BYTES):
            labels, text, at, by = _letters_by(batch.column("text"), model, switch)
            total, top = by.sum(axis=1), by.argmax(axis=1)
            pred = [langs[k] if n else UNKNOWN for k, n in zip(top.tolist(), total.tolist())]
            score = by[np.arange(len(by)), top] / np.maximum(1, total)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            if langs and len(labels):
                cut = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (text[1:] != text[:-1])]))
                ends = np.append(cut[1:], len(labels))
                for t, s, e, k in zip(text[cut].tolist(), cut.tolist(), ends.tolist(), labels[cut].tolist()):
                    spans[t].append({"start": s - int(at[t]), "end": e - int(at[t]), "lang": langs[k]})
            yield pa.record_batch([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(spans, kind)],
                                  names=["doc_id", "lang_pred", "score", "spans"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")


def held_out(doc_id: F.Column) -> F.Column:
    """The documents that are never learned from; rows without a doc_id are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text has no letters or no language for ``least`` of its letters; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in text_blocks(batches, limit=TEXT_BYTES):
            by = _letters_by(batch.column("text"), model, SWITCH)[-1]
            yield batch.filter(pa.array((by.sum(axis=1) > 0) & (by.max(axis=1) >= least * by.sum(axis=1))))

    return docs.mapInArrow(run, docs.schema)
