"""Language identification by string kernels.

The kernel counts the character n-grams (n = 1..3, blended spectrum) present in
both of two lower-cased texts, and is normalised by the n-grams each of them has
in the vocabulary of the landmarks. Landmarks are whole training texts of every
language; the Nystroem map of a text is its kernel row against the landmarks
times the inverse square root of the landmarks' own kernel. One-versus-rest
kernel ridge regression is solved in that space. Presence rows times the landmark
matrix times the weights is linear, so scoring is a batched matrix product of
presence rows with one (n-grams x languages) matrix and reads each text once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.llm.common import frees_memory

SPECTRUM = 3
LANDMARKS = 64           # expected landmark texts per language
SAMPLE = 1500            # expected training texts per language (documented bound)
RIDGE = 1e-3
UNKNOWN = "und"
TABLE_CELLS = 1 << 23    # n-gram codes looked up directly; larger alphabets search
BATCH = 64


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def gram_codes(cp: np.ndarray) -> np.ndarray:
    """Distinct n-grams of up to three characters as 63-bit integers."""
    c = cp + 1
    parts = [c]
    if len(c) > 1:
        parts.append((c[:-1] << 21) | c[1:])
    if len(c) > 2:
        parts.append((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])
    return np.unique(np.concatenate(parts))


class GramIndex:
    """Numbers of the vocabulary's n-grams. Small alphabets use direct tables by
    compact character number, others a sorted search; both give the same."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        ones = vocabulary[vocabulary < 1 << 21] - 1
        size = len(ones) + 1
        self.size = size
        self.dense = size ** SPECTRUM <= TABLE_CELLS
        if not self.dense:
            return
        self.chars = np.zeros(int(ones.max()) + 2 if len(ones) else 1, np.int64)
        self.chars[ones] = np.arange(1, size)
        tables = [np.full(size ** n, -1, np.int32) for n in range(1, SPECTRUM + 1)]
        number = np.arange(len(vocabulary), dtype=np.int32)
        a, b, c = vocabulary >> 42, (vocabulary >> 21) & 0x1FFFFF, vocabulary & 0x1FFFFF
        ch = lambda x: self.chars[x - 1]
        one, two, three = (a == 0) & (b == 0), (a == 0) & (b > 0), a > 0
        tables[0][ch(c[one])] = number[one]
        tables[1][ch(b[two]) * size + ch(c[two])] = number[two]
        tables[2][(ch(a[three]) * size + ch(b[three])) * size + ch(c[three])] = number[three]
        self.tables = tables

    def positions(self, cp: np.ndarray) -> list[np.ndarray]:
        """Vocabulary number of the n-gram at every position (-1: not in it)."""
        if self.dense:
            x = self.chars[np.minimum(cp, len(self.chars) - 1)]
            out = [self.tables[0][x]]
            if len(x) > 1:
                pair = x[:-1] * self.size + x[1:]
                out.append(self.tables[1][pair])
                if len(x) > 2:
                    out.append(self.tables[2][pair[:-1] * self.size + x[2:]])
            return out
        c = cp + 1
        codes = [c]
        if len(c) > 1:
            codes.append((c[:-1] << 21) | c[1:])
        if len(c) > 2:
            codes.append((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])
        out = []
        for x in codes:
            at = np.minimum(np.searchsorted(self.vocabulary, x), len(self.vocabulary) - 1)
            out.append(np.where(self.vocabulary[at] == x, at, -1).astype(np.int32))
        return out

    def presence(self, text: str, row: np.ndarray) -> tuple[int, float]:
        """Mark the text's n-grams in ``row``; returns how many are present and
        the share of n-gram positions that are in the vocabulary."""
        cp = code_points(text)
        known = total = 0
        for p in self.positions(cp) if len(cp) else []:
            hit = p[p >= 0]
            row[hit] = 1
            known += len(hit)
            total += len(p)
        return int(row.sum()), known / total if total else 0.0


@dataclass
class LanguageModel:
    languages: list[str]
    vocabulary: np.ndarray    # sorted n-gram codes
    weights: np.ndarray       # n-grams x languages
    bias: np.ndarray


def _unit_hash(id_col: str, salt: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang", sample: int = SAMPLE, landmarks: int = LANDMARKS,
        ridge: float = RIDGE) -> LanguageModel | None:
    """Fit from rows with a text and a language; None if there are none.

    Per language about ``sample`` rows are drawn by a hash of the id (all of
    them when there are fewer), the first ``landmarks`` of them as landmarks.
    Rows without label or letter are ignored. The driver holds the landmarks'
    n-grams and one kernel row of ``landmarks x languages`` numbers per sampled
    text, whatever the size of the corpus.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & has_letter(F.col(text_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
        F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    langs = sorted(counts)
    u = _unit_hash("id", "language-sample")

    def share(k: int) -> Column:
        pairs = [F.lit(x) for c in langs for x in (c, min(1.0, k / counts[c]))]
        return F.create_map(*pairs)[F.col("lang")]

    def grams(batches):
        for b in batches:
            codes = [gram_codes(code_points(x.as_py())).tolist() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(codes, pa.list_(pa.int64()))],
                ["id", "lang", "codes"])

    marks = (rows.where(u < share(landmarks)).mapInArrow(grams, "id long, lang string, codes array<long>")
             .collect())
    marks = sorted(((r["lang"], -1 if r["id"] is None else r["id"], r["codes"]) for r in marks))
    if not marks:   # a tiny table: take the first row by hash
        first = rows.orderBy(u, "id").limit(1).mapInArrow(
            grams, "id long, lang string, codes array<long>").collect()
        marks = [(r["lang"], -1 if r["id"] is None else r["id"], r["codes"]) for r in first]
    sets = [np.array(m[2], np.int64) for m in marks]
    vocabulary = np.unique(np.concatenate(sets))
    m = len(sets)

    def landmark_matrix() -> np.ndarray:
        out = np.zeros((len(vocabulary), m), np.float32)
        for j, s in enumerate(sets):
            out[np.searchsorted(vocabulary, s), j] = 1 / np.sqrt(len(s))
        return out

    def kernel_rows(batches):
        index, marked = GramIndex(vocabulary), landmark_matrix()
        for b in batches:
            ks = []
            for x in b.column(1):
                row = np.zeros(len(vocabulary), np.float32)
                n, _ = index.presence(x.as_py(), row)
                ks.append(((row @ marked) / np.sqrt(max(n, 1))).tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(ks, pa.list_(pa.float32()))],
                ["id", "lang", "k"])

    got = rows.where(u < share(sample)).mapInArrow(
        frees_memory(kernel_rows), "id long, lang string, k array<float>").collect()
    got = sorted((r["lang"], -1 if r["id"] is None else r["id"], r["k"]) for r in got)
    marked = landmark_matrix().astype(np.float64)
    k_nm = np.array([g[2] for g in got], np.float64).reshape(len(got), m)
    k_mm = marked.T @ marked
    val, vec = np.linalg.eigh(k_mm)
    root = vec @ np.diag(np.where(val > 1e-6, 1 / np.sqrt(np.maximum(val, 1e-6)), 0)) @ vec.T
    z = np.hstack([k_nm @ root, np.ones((len(got), 1))])
    y = np.array([[1.0 if g[0] == c else -1.0 for c in langs] for g in got]).reshape(-1, len(langs))
    # every language weighs the same, however many rows it has
    per = {c: sum(g[0] == c for g in got) for c in langs}
    wt = np.array([1 / per[g[0]] for g in got])
    reg = ridge * np.eye(m + 1) * max(len(langs), 1) / max(m, 1)
    reg[-1, -1] = 1e-9
    w = np.linalg.solve((z * wt[:, None]).T @ z + reg, (z * wt[:, None]).T @ y)
    return LanguageModel(langs, vocabulary, marked @ root @ w[:-1], w[-1])


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text",
            names: tuple = ("lang_pred", "score", "coverage")) -> DataFrame:
    """The rows of ``docs`` with lang_pred, score and coverage (named ``names``).

    lang_pred is a learned language, or ``und`` (score and coverage 0) where the
    text is null or has no letter, and everywhere if nothing was learned. score
    maps the best one-versus-rest value from [-1, 1] to [0, 1], clipped;
    coverage is the share of the text's n-grams that some landmark has. Whole
    texts are read; equal values go to the first language by name.
    """
    out = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()),
                        T.StructField(names[1], T.DoubleType()),
                        T.StructField(names[2], T.DoubleType())])
    at_text = docs.columns.index(text_col)

    def run(batches):
        if model is not None:
            index = GramIndex(model.vocabulary)
            rows = np.zeros((BATCH, len(model.vocabulary)))
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                width = b.num_columns - 1
                letters = b.column(width).to_pylist()
                texts = [t if x else None for t, x in zip(b.column(at_text).to_pylist(), letters)]
                lang, score, cover = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
                known = [i for i, t in enumerate(texts) if t is not None]
                if model is not None and known:
                    rows[:len(known)] = 0
                    n = np.ones(len(known))
                    for j, i in enumerate(known):
                        n[j], cover[i] = index.presence(texts[i], rows[j])
                    f = rows[:len(known)] @ model.weights / np.sqrt(np.maximum(n, 1))[:, None]
                    f = f + model.bias
                    for j, i in enumerate(known):
                        best = int(f[j].argmax())
                        lang[i] = model.languages[best]
                        # rounded: the last bits depend on a row's place in its batch
                        score[i] = round(float(min(1.0, max(0.0, (1 + f[j, best]) / 2))), 9)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k) for k in range(width)), pa.array(lang, pa.string()),
                     pa.array(score, pa.float64()), pa.array(cover, pa.float64())], out.names)

    return docs.select("*", has_letter(F.col(text_col)).alias("_letter")).mapInArrow(frees_memory(run), out)


def held_out(id_col: str = "doc_id") -> Column:
    """The fifth of documents that is never learned from (null id: the empty id)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", names: tuple = ("lang_pred", "score", "coverage"),
             **kw) -> DataFrame:
    """Learn from the rows that are not held out, predict every row of ``docs``. Columns
    of ``docs`` that are named like a result give way to it."""
    train = docs.select(id_col, text_col, lang_col).where(~held_out(id_col))
    return predict(docs.drop(*names), fit(train, id_col, text_col, lang_col, **kw), text_col, names)
