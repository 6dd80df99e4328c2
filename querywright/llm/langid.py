"""Language mixtures of documents.

A model holds, for each language, smoothed log probabilities of hashed byte trigrams of lower-cased words. A document is
a bag of words; a word's likelihood under a language is the product of its trigrams' (tempered by `POWER`, as
neighbouring trigrams overlap). Expectation-maximisation estimates the document's language proportions. Language sets are
nested by falling proportion; a further language is taken only if the log likelihood grows by more than the penalty
PENALTY * ln(1 + words).

Fitting reads at most about `docs_per_lang` documents of each language, dealt by a hash of their id, so the model does not
depend on partitioning; trigram counts are added up by Spark, and what reaches the driver is languages x BUCKETS numbers.

Defined results: a text that is null or has no letter is "und" with score 0. A word's case does not matter. Languages with
no training text cannot be predicted; with no model at all every text is "und". Of languages with equal proportions or
likelihoods the one that sorts first comes first. Repeated rows give repeated results, null ids are ids like any other, an
empty table gives no rows, and only the named columns are read, whatever the others are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from querywright.llm.common import chunk_rows, map_arrow, map_chunks, with_columns

BUCKETS = 1 << 15
POWER = 0.5
PENALTY = 2.0
ROUNDS = 12
MEMO = 200_000
#: A model has BUCKETS numbers for each language; more labels than there are languages are an error.
MAX_LANGS = 8000
_LETTER = regex.compile(r"\p{L}")
#: What separates words: everything but letters and marks.
_WORD = regex.compile(r"[\p{L}\p{M}]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram of the words, each word between two blanks, and where each word's trigrams start."""
    data = [f" {w} ".encode("utf-8", "surrogatepass") for w in words]
    size = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
    raw = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint32)
    key = raw[:-2] * np.uint32(65536) + raw[1:-1] * np.uint32(256) + raw[2:]
    key = (key * np.uint32(2654435761)) >> np.uint32(32 - 15)
    ends = np.cumsum(size)
    inside = np.ones(len(key), dtype=bool)
    for back in (1, 2):  # trigrams that reach into the next word
        stop = ends[:-1] - back
        inside[stop[stop < len(key)]] = False
    starts = np.concatenate([[0], np.cumsum(size - 2)[:-1]])
    return key[inside].astype(np.int64), starts


class Model:
    """Languages and their log probabilities (BUCKETS x languages)."""

    def __init__(self, langs: list[str], logp: np.ndarray):
        self.langs, self.logp = langs, logp
        self._memo: dict[str, int] = {}
        self._rows = np.zeros((0, len(langs)))

    def __reduce__(self):
        return Model, (self.langs, self.logp.astype(np.float32))

    def index(self, words: list[str]) -> np.ndarray:
        """Row of each word in self._rows; unseen words are scored together. The memo is emptied when it is full."""
        memo = self._memo
        new = [w for w in dict.fromkeys(words) if w not in memo]
        if len(memo) + len(new) > MEMO and memo:
            memo.clear()
            self._rows = self._rows[:0]
            new = list(dict.fromkeys(words))
        if new:
            keys, starts = trigrams(new)
            made = np.add.reduceat(self.logp[keys].astype(np.float64), starts, axis=0) * POWER
            memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
            self._rows = np.concatenate([self._rows, made])
        return np.fromiter(map(memo.__getitem__, words), dtype=np.int64, count=len(words))

    def mixtures(self, texts: list[str | None]) -> list[list[tuple[str, float]]]:
        """For each text the chosen languages and their proportions, largest first; none if it has no letter."""
        bags = [Counter(words_of(t)) if t and _LETTER.search(t) else None for t in texts]
        full = [i for i, b in enumerate(bags) if b]
        out: list[list[tuple[str, float]]] = [[] for _ in texts]
        n = len(self.langs)
        if not full or not n:
            return out
        words = [w for i in full for w in bags[i]]
        count = np.fromiter((c for i in full for c in bags[i].values()), dtype=np.float64, count=len(words))
        starts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in full])[:-1]]).astype(np.int64)
        sizes = np.diff(np.append(starts, len(words)))
        at = self.index(words)  # may replace the rows
        logs = self._rows[at]
        top = logs.max(axis=1)
        like = np.exp(np.maximum(logs - top[:, None], -50.0))
        total = np.add.reduceat(count, starts)

        def fit(allowed: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Proportions and log likelihoods (less the common part) of the documents `which`."""
            take = np.repeat(which, sizes)
            p, c, size = like[take], count[take], sizes[which]
            s = np.concatenate([[0], np.cumsum(size)[:-1]])
            pi = allowed / allowed.sum(axis=1, keepdims=True)
            for _ in range(ROUNDS):
                joint = p * np.repeat(pi, size, axis=0)
                mix = joint.sum(axis=1)
                pi = np.add.reduceat(joint * (c / mix)[:, None], s, axis=0) / total[which][:, None]
            mix = (p * np.repeat(pi, size, axis=0)).sum(axis=1)
            return pi, np.add.reduceat(c * np.log(mix), s)

        def reach(pi: np.ndarray, which: np.ndarray) -> np.ndarray:
            """What no set of languages can exceed: the likelihood is concave in the proportions, so its slope at any bounds it."""
            take = np.repeat(which, sizes)
            p, c, size = like[take], count[take], sizes[which]
            s = np.concatenate([[0], np.cumsum(size)[:-1]])
            mix = (p * np.repeat(pi, size, axis=0)).sum(axis=1)
            return np.add.reduceat(c * np.log(mix), s) + np.add.reduceat(p * (c / mix)[:, None], s, axis=0).max(axis=1) - total[which]

        single = np.add.reduceat(np.log(like) * count[:, None], starts, axis=0)
        first = np.argmax(single, axis=1)
        best, value = np.eye(n)[first], single[np.arange(len(full)), first]
        enough = value + PENALTY * np.log1p(total) - 1e-9 * total
        # Most documents have one language: the slope close to that one tells that no other is worth its penalty.
        rest = np.minimum(0.02, 4 / total)[:, None]
        open_ = np.full(len(full), n > 1)
        if n > 1:
            open_ = reach(best * (1 - rest) + rest / n, open_) > enough
        order = np.zeros((len(full), n), dtype=np.int64)
        if open_.any():
            at = np.flatnonzero(open_)
            pi, _ = fit(np.ones((len(at), n)), open_)
            order[at] = np.argsort(-pi, axis=1, kind="stable")
            open_[at] = reach(pi, open_) > enough[at]
        for k in range(2, n + 1):
            if not open_.any():
                break
            allowed = np.zeros((len(full), n))
            np.put_along_axis(allowed, order[:, :k], 1.0, axis=1)
            got, score = fit(allowed[open_], open_)
            at = np.flatnonzero(open_)
            better = score > value[at] + PENALTY * np.log1p(total[at])
            best[at[better]], value[at[better]] = got[better], score[better]
            open_[at[~better]] = False
        for i, row in zip(full, best, strict=True):
            out[i] = [(self.langs[j], float(row[j])) for j in np.argsort(-row, kind="stable") if row[j] > 0]
        return out


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 2000) -> Model:
    """A model of the labelled rows: those with text and label. At most about `docs_per_lang` of each label are read."""
    labelled = df.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)))
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"{len(sizes)} labels are more than {MAX_LANGS} languages")
    dealt = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20))
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, int((1 << 20) * min(1.0, docs_per_lang / v)))])
    chosen = labelled.filter(dealt < F.try_element_at(share, F.col(lang_col)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for a, b in chunk_rows(batch.column(1), 4 << 20):
                for lang, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    if words := words_of(text):
                        total.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                        total[lang] += np.bincount(trigrams(words)[0], minlength=BUCKETS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    counts = map_arrow(chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), count, StructType.fromDDL("lang string, bucket int, n long")).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toPandas()
    langs = sorted(got["lang"].unique())
    logp = np.zeros((BUCKETS, len(langs)))
    for j, lang in enumerate(langs):
        mine = got[got["lang"] == lang]
        c = np.full(BUCKETS, 0.5)
        c[mine["bucket"].to_numpy()] += mine["n"].to_numpy()
        logp[:, j] = np.log(c / c.sum())
    return Model(langs, logp)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score (its proportion), mixture (lang:proportion, largest first). Reads text alone."""

    def work(ids: list, texts: list) -> dict:
        found = model.mixtures(texts)
        return {
            "doc_id": ids,
            "lang_pred": [m[0][0] if m else "und" for m in found],
            "score": [min(1.0, m[0][1]) if m else 0.0 for m in found],
            "mixture": [",".join(f"{lang}:{p:.4f}" for lang, p in m) for m in found],
        }

    kind = dict(df.dtypes)[id_col]
    return map_chunks(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), work, StructType.fromDDL(f"doc_id {kind}, lang_pred string, score double, mixture string"), limit=2 << 20)


def with_language(df: DataFrame, model: Model, text_col: str = "text", to: str = "lang_pred") -> DataFrame:
    """All columns and the predicted language."""
    return with_columns(df, [text_col], lambda texts: {to: [m[0][0] if m else "und" for m in model.mixtures(texts)]}, {to: "string"})


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
